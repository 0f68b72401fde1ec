"""Benchmark decontamination with training suffix arrays.

Each task cuts its documents into shards of bounded size. A shard is one sequence of word numbers with breaks between
documents and at words that no test item has; its suffix array is sorted by prefix doubling. Every test suffix is
binary-searched in it, which gives the range of training positions that begin with the same window of words. Shards are
independent because matches never cross documents, so nothing is shuffled. The test items are the stated query set: they
go to the executors in blocks of bounded size, of which a task holds one in memory at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: ASCII letters are lower-cased, other ASCII but digits becomes space, bytes from 128 on stay.
_WORD_BYTES = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of digits, ASCII letters and everything beyond ASCII, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class Items:
    """A block of test items as word numbers, with its windows grouped by content."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        vocabulary: dict[bytes, int] = {}
        number = lambda w: vocabulary.setdefault(w, len(vocabulary) + 1)
        seqs = [(name, np.array([number(w) for w in words(text)], dtype=np.int32)) for name, text in items]
        seqs = [(name, s) for name, s in seqs if len(s)]
        self.vocabulary, self.names = vocabulary, [name for name, _ in seqs]
        found: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for k, (_, s) in enumerate(seqs):
            n = min(window, len(s))
            row = s.tolist()
            for at in range(len(s) - n + 1):
                found.setdefault(tuple(row[at : at + n]), []).append((k, at))
        self.window = window
        self.rows = np.zeros((len(found), window), dtype=np.int32)  # 0 beyond the end of a short item
        self.lengths = np.array([len(w) for w in found], dtype=np.int64)
        for i, w in enumerate(found):
            self.rows[i, : len(w)] = w
        self.least = int(self.lengths.min()) if len(found) else 0
        flat = [p for places in found.values() for p in places]
        self.item, self.at = (np.array([p[i] for p in flat], dtype=np.int64) for i in (0, 1))
        self.first = np.cumsum([0, *map(len, found.values())]).astype(np.int64)
        self.seqs = [s for _, s in seqs]
        own = [sorted({k for k, _ in places}) for places in found.values()]  # the items of each window
        self.of = np.array([k for x in own for k in x], dtype=np.int64)
        self.of_first = np.cumsum([0, *map(len, own)]).astype(np.int64)


def suffix_array(seq: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of the suffixes of ``seq`` that begin there, compared over at least ``depth`` words.

    ``starts`` are whole stretches between zeros.

    Prefix doubling: the rank over 2k words is the rank of a pair of ranks over k words. 0 ends a suffix."""
    rank = np.zeros(len(seq) + depth * 2 + 2, dtype=np.int64)
    rank[: len(seq)] = seq
    reach, order, pos = 1, np.argsort(rank[starts], kind="stable"), starts
    while True:
        if reach >= depth:
            return pos[order]
        pair = rank[pos] * (int(rank.max()) + 1) + rank[pos + reach]
        order = np.argsort(pair, kind="stable")
        ordered = pair[order]
        fresh = np.empty(len(pos), dtype=np.int64)
        fresh[order] = np.cumsum(np.concatenate([[1], (ordered[1:] != ordered[:-1]).astype(np.int64)])) if len(pos) else 0
        rank[:] = 0
        rank[pos] = fresh
        reach *= 2


def search(seq: np.ndarray, array: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the range of ``array`` whose suffixes begin with its words; all rows are searched side by side."""
    padded = np.concatenate([seq, np.zeros(rows.shape[1], dtype=seq.dtype)])

    def bound(after: bool) -> np.ndarray:
        lo, hi = np.zeros(len(rows), np.int64), np.full(len(rows), len(array), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            at = array[np.minimum(mid, len(array) - 1)]
            less = np.full(len(rows), after)  # is the suffix before the row's place
            undecided = open_.copy()
            for k in range(rows.shape[1]):
                undecided &= k < lengths
                if not undecided.any():
                    break
                have, want = padded[at + k], rows[:, k]
                differ = undecided & (have != want)
                less[differ] = have[differ] < want[differ]
                undecided &= ~differ
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        return lo

    return bound(False), bound(True)


def _spread(which: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each x of ``which`` the places first[x] to first[x + 1]: (number in ``which``, place), in that order."""
    many = first[which + 1] - first[which]
    return np.repeat(np.arange(len(which)), many), np.repeat(first[which], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def longest_common(a: np.ndarray, b: np.ndarray, least: int) -> tuple[int, int]:
    """(first place in ``a``, length) of the longest run that both hold, known to have ``least`` words or more; 0 in ``a`` is in no
    run. By bisection of the length: windows of one length are ranked by doubling, in memory that follows the two lengths."""
    both = np.concatenate([np.where(a == 0, -1 - np.arange(len(a)), a), [-len(a) - 1], b]).astype(np.int64)

    def common(n: int) -> int:
        """The first place in ``a`` of a window of n words that ``b`` has too, or -1."""
        rank, reach = np.unique(both, return_inverse=True)[1], 1
        while reach < n:
            step = min(reach, n - reach)
            rank = np.unique(rank[: len(rank) - step] * (len(both) + 1) + rank[step:], return_inverse=True)[1]
            reach += step
        at = np.flatnonzero(np.isin(rank[: len(a) - n + 1], rank[len(a) + 1 :]))
        return int(at[0]) if len(at) else -1

    lo, hi = least, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if common(mid) >= 0 else (lo, mid - 1)
    return common(lo), lo


def _aligned(at: np.ndarray, which: np.ndarray, doc_of: np.ndarray, items: Items) -> np.ndarray:
    """Rows (document, item, first word in the shard, words) of the longest match of each pair, from every occurrence at every
    place of its window, windows that overlap along one alignment being joined."""
    i, place = _spread(which, items.first)
    pos, length = at[i], items.lengths[which[i]]
    item, diagonal, doc = items.item[place], pos - items.at[place], doc_of[pos]
    order = np.lexsort((pos, diagonal, item, doc))
    doc, item, diagonal, pos, length = (x[order] for x in (doc, item, diagonal, pos, length))
    cut = np.ones(len(pos), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (pos[1:] != pos[:-1] + 1)
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(pos)) - 1
    runs = np.stack([doc[first], item[first], pos[first], pos[last] + length[last] - pos[first]], axis=1)
    runs = runs[np.lexsort((runs[:, 2], -runs[:, 3], runs[:, 1], runs[:, 0]))]
    keep = np.ones(len(runs), bool)
    keep[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[keep]


def _pairs(doc: np.ndarray, which: np.ndarray, items: Items, most: int) -> np.ndarray:
    """Distinct (document, item, 0, 0), from the distinct windows of each document, at most about ``most`` rows at a time."""
    wide, windows, found = len(items.names) + 1, len(items.rows), []
    seen = np.unique(doc * windows + which)
    size = np.cumsum(np.diff(items.of_first)[seen % windows])
    for part in np.split(seen, np.unique(np.searchsorted(size, np.arange(most, size[-1], most)))):
        i, place = _spread(part % windows, items.of_first)
        found.append(np.unique((part // windows)[i] * wide + items.of[place]))
    pairs = np.unique(np.concatenate(found))
    return np.stack([pairs // wide, pairs % wide, 0 * pairs, 0 * pairs], axis=1)


def match_shard(ids: np.ndarray, doc_of: np.ndarray, items: Items, locate: bool = True, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(hit by word, matches).

    ``ids``: word numbers with a 0 after each document. The second result has a row (document, item, first word in the
    shard, words) for the longest verbatim match of each pair; without ``locate`` the last two are 0. Documents are located
    together while their occurrences at all places of the items stay within ``most``; one with more, as of a repeated word,
    is compared item by item in memory that follows its length."""
    n = len(ids)
    hit = np.zeros(n, dtype=bool)
    none = np.zeros((0, 4), np.int64)
    if not len(items.rows) or not n:
        return hit, none
    known = np.concatenate([[False], ids != 0, [False]])
    opens, closes = np.flatnonzero(known[1:] & ~known[:-1]), np.flatnonzero(known[:-1] & ~known[1:])
    long_ = closes - opens >= items.least  # a shorter stretch of known words holds no window
    opens, lens = opens[long_], (closes - opens)[long_]
    starts = np.repeat(opens - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
    if not len(starts):
        return hit, none
    array = suffix_array(ids, starts, items.window)
    lo, hi = search(ids, array, items.rows, items.lengths)
    w = np.flatnonzero(hi > lo)
    if not len(w):
        return hit, none
    counts = (hi - lo)[w]
    which = np.repeat(w, counts)
    at = array[np.repeat(lo[w], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + items.lengths[which], -1)
    hit = np.cumsum(edge[:-1]) > 0
    if not locate:
        return hit, _pairs(doc_of[at], which, items, most)
    order = np.argsort(doc_of[at], kind="stable")
    at, which = at[order], which[order]
    doc = doc_of[at]
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    ends = np.append(first[1:], len(doc))
    size = np.add.reduceat(np.diff(items.first)[which], first)
    out, begin, held = [], 0, 0
    for k in range(len(first) + 1):
        if begin < k and (k == len(first) or held + size[k] > most):
            cut = slice(first[begin], ends[k - 1])
            out.append(_aligned(at[cut], which[cut], doc_of, items))
            begin, held = k, 0
        if k == len(first):
            break
        if size[k] <= most:
            held += size[k]
            continue
        from_, to = (int(np.searchsorted(doc_of, doc[first[k]], side=s)) for s in ("left", "right"))
        for item in _pairs(doc[first[k] : ends[k]], which[first[k] : ends[k]], items, most)[:, 1].tolist():
            a, long = longest_common(ids[from_:to], items.seqs[item], min(items.window, len(items.seqs[item])))
            out.append(np.array([[doc[first[k]], item, from_ + a, long]], np.int64))
        begin = k + 1
    found = np.concatenate(out)
    return hit, found[np.lexsort((found[:, 1], found[:, 0]))]


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """The test items in blocks of bounded size, read partition by partition."""
    block, size = [], 0
    for name, text in items.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).toLocalIterator():
        block.append((name, text))
        size += len(text or "") + 16
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _matcher(held: list, window: int, shard_words: int, carry: int, at: int = -1, locate: bool = True):
    """A mapInArrow function over batches whose column ``at`` is the text; the first ``carry`` columns are kept.

    With ``carry`` columns kept it passes rows on with one more column, n_hit; without, it gives the rows of
    ``decontaminate``, the first column being the id."""

    def matched(seqs):
        lens = np.array([len(s) for s in seqs], np.int64)
        starts = np.cumsum(lens + 1) - lens - 1
        hit = np.zeros(int((lens + 1).sum()), bool)
        doc_of = np.repeat(np.arange(len(seqs)), lens + 1)
        matches: list[list[dict]] = [[] for _ in seqs]
        for b in held:
            items = b.value
            get = items.vocabulary.get
            ids = np.zeros(len(hit), np.int32)
            for s, at in zip(seqs, starts.tolist(), strict=True):
                ids[at : at + len(s)] = np.fromiter(map(get, s, repeat(0)), np.int32, len(s))
            h, runs = match_shard(ids, doc_of, items, locate and not carry)
            hit |= h
            for d, i, pos, n in runs.tolist():
                matches[d].append({"item_id": items.names[i], "first": pos - int(starts[d]) if n else 0, "words": n})
            if len(held) > 1:
                del b._value, items, get  # one block in memory at a time; it is read again from the local disk
        return lens, np.add.reduceat(hit.astype(np.int64), starts), [sorted(m, key=lambda x: (x["item_id"], x["first"])) for m in matches]

    def run(batches):
        import pyarrow as pa

        struct = pa.struct([("item_id", pa.string()), ("first", pa.int64()), ("words", pa.int64())])

        def closed(slices, seqs):
            n_words, n_hit, matches = matched(seqs)
            rows = pa.Table.from_batches(slices).combine_chunks().to_batches()[0]
            if carry:
                return pa.RecordBatch.from_arrays([*rows.columns[:carry], pa.array(n_hit)], [*rows.schema.names[:carry], "n_hit"])
            names = [sorted(x["item_id"] for x in m) for m in matches]
            return pa.RecordBatch.from_arrays([rows.column(0), pa.array(n_words), pa.array(n_hit), pa.array(names, pa.list_(pa.string())), pa.array(matches, pa.list_(struct))], ["doc_id", "n_words", "n_hit", "items", "matches"])

        slices, seqs, total = [], [], 0
        for batch in batches:
            first = 0
            for i, text in enumerate(batch.column(at % batch.num_columns)):
                seqs.append(words(text.as_py()))
                total += len(seqs[-1]) + 1
                if total >= shard_words:
                    yield closed([*slices, batch.slice(first, i + 1 - first)], seqs)
                    slices, seqs, total, first = [], [], 0, i + 1
            if first < batch.num_rows:
                slices.append(batch.slice(first))
        if seqs:
            yield closed(slices, seqs)
        slices, seqs = [], []
        shared.trim()

    return run


def _held(docs: DataFrame, items: DataFrame, window: int, block_bytes: int, item_id_col: str, item_text_col: str) -> list:
    shared.bounded_batches(docs.sparkSession)
    blocks = item_blocks(items.where(F.col(item_id_col).isNotNull()), item_id_col, item_text_col, block_bytes)
    return [docs.sparkSession.sparkContext.broadcast(Items(b, window)) for b in blocks]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, shard_words: int = 1_000_000, block_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", locate: bool = True) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, items (sorted ids of the items that have a window in it), matches.

    ``matches`` has (item_id, first, words) for the longest verbatim match with each of these items, ``first`` being the
    number of the document's word it begins at; without ``locate`` both are 0. A word is hit if it lies in any occurrence of a window of ``window`` words of
    an item, or of a whole shorter item. Null and empty texts have no words; items without words or with a null id are left
    out; items of equal text each count; documents may repeat."""
    held = _held(docs, items, window, block_bytes, item_id_col, item_text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_matcher(held, window, shard_words, 0, locate=locate), "doc_id long, n_words long, n_hit long, items array<string>, matches array<struct<item_id:string,first:long,words:long>>")


def select_clean(docs: DataFrame, items: DataFrame, window: int = 10, shard_words: int = 1_000_000, block_bytes: int = 4 << 20, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of any item occurs, with the columns of ``docs``."""
    from pyspark.sql import types as T

    held = _held(docs, items, window, block_bytes, item_id_col, item_text_col)
    n = shared.fresh("n_hit", docs)
    if dict(docs.dtypes).get(text_col) == "string":  # then the text is sent to Python once
        rows, at = docs, docs.columns.index(text_col)
    else:
        rows, at = docs.withColumn(shared.fresh("text", docs), F.col(text_col).cast("string")), -1
    schema = T.StructType([*docs.schema.fields, T.StructField(n, T.LongType())])
    run, names = _matcher(held, window, shard_words, len(docs.columns), at), [*docs.columns, n]

    def named(batches):
        for b in run(batches):
            yield b.rename_columns(names)

    return rows.mapInArrow(named, schema).where(F.col(n) == 0).drop(n)
