import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabloom.llm import boundaries, packing, shared, tokens

PLAIN = {}


def whole(path, text):
    """The ids that the library gives, by a tokenizer of our own as the file says."""
    if path not in PLAIN:
        PLAIN[path] = Tokenizer.from_file(path)
    return np.array(PLAIN[path].encode(text, add_special_tokens=False).ids, "<u4").tobytes() if text else b""


BYTE, WORD = tokens.vocabulary("byte_bpe_50k.json"), tokens.vocabulary("word_bpe_49k.json")


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aAbé ÉßİΣσ. ,!'\n\t ́\x1c\x00日😀12<|>", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "endoftext"]), max_size=40).map("".join), max_size=6))
def test_encoder_equals_whole_text(path, texts):
    e = tokens.Encoder(path, cache=5)
    for t in [*texts, *texts]:
        assert e.ids(t) == whole(path, t)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_on_edges(path, edge_texts):
    e = tokens.encoder(path)
    for _ in range(2):
        for t in edge_texts:
            assert e.ids(t) == whole(path, t)


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"aé2 ", "\n", "\t", "\r", "b\n", " c", "$$$", "&&&", "#", "'", "'s", "<|", ".", "-", "\u0338", "²"]), max_size=30).map("".join), max_size=6))
def test_line_breaks_and_marks(path, texts):
    e = tokens.encoder(path, 5)
    for t in [*texts, *texts]:
        assert e.ids(t) == whole(path, t)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_line_breaks_and_marks_make_no_new_pieces(path, monkeypatch):
    e, calls = tokens.Encoder(path), []
    e.ids("a one two\none\ntwo one$$$ two.&&&")
    monkeypatch.setattr(e, "_whole", calls.append)
    monkeypatch.setattr(e, "_together", calls.append)
    text = "one two\ntwo\none two$$$ one.&&&"
    assert e.ids(text) == whole(path, text) and not calls


def test_added_tokens_have_their_ids():
    assert tokens.encoder(BYTE).ids("a <|endoftext|> b") == whole(BYTE, "a <|endoftext|> b") and np.array([50256], "<u4").tobytes() in tokens.encoder(BYTE).ids("<|endoftext|>")
    assert tokens.encoder(WORD).ids("<|startoftext|>x") == np.array([49406], "<u4").tobytes() + whole(WORD, "x")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=300))
def test_elias_fano(values):
    values.sort()
    e, end = boundaries.EliasFano.from_bytes(boundaries.EliasFano.of(np.array(values, np.int64)).to_bytes())
    assert e.all().tolist() == values
    assert [e.select(i) for i in range(len(values))] == values
    assert end == len(boundaries.EliasFano.of(np.array(values, np.int64)).to_bytes())


def test_block_round_trip():
    docs, ids = [None, -5, 7, 7, 1 << 40], [np.array(x, "<u4").tobytes() for x in ([1], [], [2, 70000], [3], [4, 5, 6])]
    b = boundaries.Block(boundaries.pack_block(docs, ids))
    assert [b.doc_id(i) for i in range(len(b))] == docs == b.doc_ids()
    assert [b.ids(i).astype("<u4").tobytes() for i in range(len(b))] == ids


def test_token_file(spark, edges, tmp_path):
    boundaries.write(edges, str(tmp_path / "ids"), BYTE, block_ids=500)
    got = boundaries.read(spark.read.parquet(str(tmp_path / "ids"))).collect()
    want = Counter((r.doc_id, len(x) // 4, zlib.crc32(x)) for r in edges.collect() for x in [whole(BYTE, r.text) + bytes(4)])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    ordered = sorted(got, key=lambda r: r.start)
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    ids = [(r.doc_id is not None, r.doc_id or 0) for r in ordered]
    assert ids == sorted(ids)


def test_empty_tables(spark, nothing):
    assert boundaries.read(shared.settle(boundaries.blocks(nothing, BYTE), "t")).count() == 0
    assert packing.pack(shared.settle(packing.pieces(nothing, WORD), "t")).count() == 0


def check_runs(counts, capacity, runs, sequences):
    held, placed = {}, Counter()
    for length, first, seq, n, offset in runs:
        assert first == placed[length]
        placed[length] += n
        for k in range(n):
            held.setdefault(seq + k, []).append((offset, length))
    assert placed == Counter({k: v for k, v in counts.items() if v})
    assert len(held) == sequences and all(0 <= s < sequences for s in held)
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity


def best(items, capacity):
    """The fewest bins by exhaustive search."""
    items = sorted(items, reverse=True)
    top = len(items)

    def go(i, bins):
        nonlocal top
        if len(bins) >= top:
            return
        if i == len(items):
            top = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += items[i]
                go(i + 1, bins)
                bins[k] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return top


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=15))
def test_solution_is_valid(counts):
    check_runs(counts, 30, *packing.solve(counts, 30))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_reduction_keeps_the_optimum(items):
    fixed, rest = packing.reduce_dominated(Counter(items), 20)
    assert all(sum(m) <= 20 for m, _ in fixed)
    left = [x for x, n in rest.items() for _ in range(n)]
    assert sum(n for _, n in fixed) + best(left, 20) == best(items, 20)


def test_packing(spark, edges):
    docs = edges
    out = packing.pack(shared.settle(packing.pieces(docs, WORD, capacity=256), "t"), capacity=256).collect()
    want = Counter()
    for r in docs.collect():
        ids = whole(WORD, r.text) + (1).to_bytes(4, "little")
        for k, a in enumerate(range(0, len(ids), 1024)):
            want[r.doc_id, k, a // 4, len(ids[a : a + 1024]) // 4, zlib.crc32(ids[a : a + 1024])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    held = {}
    for r in out:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(held) <= math.ceil(sum(r.length for r in out) / 256) + 1
