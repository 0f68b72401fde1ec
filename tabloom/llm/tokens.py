"""Token ids of whole texts by a public tokenizer, with a cache of the pieces between spaces.

Both supported vocabularies split a text into words before merging. In the byte-level one a single space between two
characters that are not white space always starts a new word, and a single line break there is a word of its own; in the
other one white space always parts words and is dropped, and letters are lower-cased. ASCII marks that end a piece after a
Latin letter or digit are a word of their own in both.
Cutting at these places and joining the ids of the parts therefore gives the ids of the whole text. Texts for which this
is not so plain (white space that touches a space, separators that only one side takes for white space, strings of added
tokens, which have an id of their own) are encoded whole.

Pieces that are not in the cache are encoded together, in one call for each text, where their ids can be told apart:
tokens that begin with a space and line breaks mark the beginning of a piece, tokens that end a word its end.
"""

from __future__ import annotations

import os
import re
import string

import numpy as np

_TOUCHING = re.compile(r"\s\s")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_MARKS = string.punctuation
_ENCODERS: dict[tuple[str, int], Encoder] = {}


class Encoder:
    """``ids(text)``: bytes of little-endian unsigned 32-bit ids, equal to encoding the whole text at once.

    The cache has two generations of at most ``cache`` pieces: when the new one is full it becomes the old one, from which
    pieces still in use are taken over. So memory is bounded and common pieces stay."""

    def __init__(self, path: str, cache: int = 600_000):
        from tokenizers import Tokenizer

        self._tok = Tokenizer.from_file(path)
        added = [t.content for t in self._tok.get_added_tokens_decoder().values()]
        self._added_start = os.path.commonprefix(added)
        self._added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.IGNORECASE)
        self._most, self._new, self._old, self._mark_ids = cache, {}, {}, {}
        names = self._tok.get_vocab()
        self._opens, self._ends = (np.zeros(max(names.values()) + 1, bool) for _ in range(2))
        for name, i in names.items():
            self._opens[i], self._ends[i] = name.startswith("Ġ") or name == "Ċ", name.endswith("</w>")
        self._by_word = bool(self._ends.any())

    def _whole(self, text: str) -> bytes:
        return np.array(self._tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _marks(self, marks: str) -> bytes:
        """Ids of a few marks that follow a letter or digit."""
        ids = self._mark_ids.get(marks)
        if ids is None:
            ids = self._whole(marks)
            if len(marks) < 6:
                if len(self._mark_ids) >= 20_000:
                    self._mark_ids.clear()
                self._mark_ids[marks] = ids
        return ids

    def _together(self, pieces: list[str]) -> None:
        """Put the ids of these pieces, with a space before each that does not begin with a line break, into the new generation."""
        many = [p for p in pieces if _LETTERS.fullmatch(p)] if self._by_word else [p for p in pieces if p and p != "\n"]
        if len(many) > 1:
            ids = np.array(self._tok.encode_batch_fast([(" " + " ".join(many)).replace(" \n", "\n")], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.append(0, np.flatnonzero(self._ends[ids]) + 1) if self._by_word else np.append(np.flatnonzero(self._opens[ids]), len(ids))
            if len(cuts) != len(many) + 1 or cuts[0] or cuts[-1] != len(ids):
                raise AssertionError("pieces can't be told apart")
            blob, at = ids.tobytes(), (4 * cuts).tolist()
            self._new.update(zip(many, [blob[a:b] for a, b in zip(at, at[1:], strict=False)], strict=True))
        for p in pieces:
            if p not in self._new:
                self._new[p] = self._whole(p if p.startswith("\n") else " " + p)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._added_start in text and self._added.search(text):
            return self._whole(text)
        skip, first = 0, b""
        if self._by_word:
            if _SEPARATORS.search(text):
                return self._whole(text)
            try:
                text.encode("latin-1")
                text = text.lower()  # of these letters as the tokenizer does it
            except UnicodeEncodeError:
                pass
            pieces = text.split()
        else:
            if _TOUCHING.search(text):
                return self._whole(text)
            pieces = text.replace("\n", " \n").split(" ")  # those after a line break begin with it
            head = pieces[0]
            if not head or head[0].isspace():
                first = self._whole(head) if head else b""
                del pieces[0]
            else:
                pieces[0], skip = "\n" + head, 4  # bytes of the break's id
        new, old = self._new, self._old
        found = list(map(new.get, pieces))
        at = [i for i, ids in enumerate(found) if ids is None]
        if at:
            wanted, ended, missing = set(), [], {pieces[i] for i in at}
            for piece in missing:
                ids = old.get(piece)
                if ids is not None:
                    new[piece] = ids
                    continue
                base = piece.rstrip(_MARKS)
                if base and len(base) < len(piece) and base[-1] < "\u0100" and base[-1].isalnum():
                    ended.append((piece, base))
                    if base not in new:
                        ids = old.get(base)
                        if ids is None:
                            wanted.add(base)
                        else:
                            new[base] = ids
                else:
                    wanted.add(piece)
            if wanted:
                self._together(list(wanted))
            for piece, base in ended:
                new[piece] = new[base] + self._marks(piece[len(base) :])
            for i in at:
                found[i] = new[pieces[i]]
            for known in (wanted, missing):
                for piece in known:
                    if len(piece) > 64:
                        new.pop(piece, None)
        out = b"".join(found)
        if len(new) >= self._most:
            self._old, self._new = new, {}
        return out[skip:] if skip else first + out


def encoder(path: str, cache: int = 600_000) -> Encoder:
    """One encoder for each Python worker and vocabulary file."""
    key = (path, cache)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, cache)
    return _ENCODERS[key]


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; a parameter of the operators, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)
