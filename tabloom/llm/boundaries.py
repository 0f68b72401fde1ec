"""Concatenated token ids with Elias-Fano encoded document boundaries.

File format. ``write`` stores a table of blocks through Spark's own writer (its commit protocol covers lost executors
and any store Spark can write to). Rows are ``part`` (int), ``seq`` (long), ``n_docs``, ``n_ids`` (long) and ``blob``
(binary). Blocks in the order of (part, seq) hold the documents in ascending doc_id order. A blob is

    magic ``EFB1``, then little-endian: documents, of these with a null doc_id (they come first), ids, smallest
    doc_id, bytes of an id (2 or 4), then two Elias-Fano sequences (doc_id minus the smallest, and end offsets), then
    the id array.

An Elias-Fano sequence of n ascending numbers below u keeps floor(log2(u / n)) low bits of each in a packed array and
the rest as a unary-coded bit vector, about 2 + log2(u / n) bits a number; the position of each 64th one bit is kept
for ``select``. No 64-bit table of offsets exists in the file.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared, tokens

_HEAD = struct.Struct("<4sIIQqB")
_EF = struct.Struct("<QQBII")
SAMPLE = 64


class EliasFano:
    """Ascending non-negative integers in near-minimal space; ``select(i)`` gives the i-th, ``all()`` all of them."""

    def __init__(self, n: int, last: int, low_bits: int, low: np.ndarray, high: np.ndarray, marks: np.ndarray):
        self.n, self.last, self.low_bits, self.low, self.high, self.marks = n, last, low_bits, low, high, marks

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n, last = len(v), int(v[-1]) if len(v) else 0
        low_bits = max(0, ((last + 1) // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[ones] = 1
        return cls(n, last, low_bits, low, np.packbits(bits, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def _lows(self, first: int, count: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(count, dtype=np.uint64)
        a, b = first * self.low_bits, (first + count) * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a]
        return bits.reshape(count, self.low_bits).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))

    def select(self, i: int) -> int:
        """The i-th number, reading from the nearest mark on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.marks[i // SAMPLE]), i % SAMPLE
        byte, skip = at // 8, at % 8
        while True:
            bits = np.unpackbits(self.high[byte : byte + 32], bitorder="little")
            found = np.flatnonzero(bits[skip:]) + skip
            if left < len(found):
                return ((byte * 8 + int(found[left]) - i) << self.low_bits) + int(self._lows(i, 1)[0])
            left -= len(found)
            byte, skip = byte + 32, 0

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return (((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) + self._lows(0, self.n)).astype(np.int64)

    def to_bytes(self) -> bytes:
        return _EF.pack(self.n, self.last, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.marks.tobytes()

    @classmethod
    def from_bytes(cls, data, at: int = 0) -> tuple[EliasFano, int]:
        n, last, low_bits, a, b = _EF.unpack_from(data, at)
        at += _EF.size
        low = np.frombuffer(data, np.uint8, a, at)
        high = np.frombuffer(data, np.uint8, b, at + a)
        marks = np.frombuffer(data, "<u4", (n + SAMPLE - 1) // SAMPLE, at + a + b)
        return cls(n, last, low_bits, low, high, marks), at + a + b + 4 * len(marks)


def pack_block(doc_ids: list, parts: list[bytes]) -> bytes:
    """A blob of documents in ascending doc_id order, null ids first; ``parts``: their ids as unsigned 32-bit bytes."""
    known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    least = int(known[0]) if len(known) else 0
    ids = np.frombuffer(b"".join(parts), "<u4")
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))) // 4
    head = _HEAD.pack(b"EFB1", len(parts), len(parts) - len(known), len(ids), least, width)
    offsets = (known.astype(np.uint64) - np.uint64(least % (1 << 64))) if len(known) else known.astype(np.uint64)
    return head + EliasFano.of(offsets).to_bytes() + EliasFano.of(ends).to_bytes() + ids.astype(f"<u{width}").tobytes()


class Block:
    """A blob read back: ``len``, ``doc_id(i)``, ``bounds(i)`` by select, ``ids(i)`` as an array."""

    def __init__(self, blob: bytes):
        magic, self.n_docs, self.n_null, self.n_ids, self.least, width = _HEAD.unpack_from(blob, 0)
        if magic != b"EFB1":
            raise ValueError("not a block of this format")
        self._doc, at = EliasFano.from_bytes(blob, _HEAD.size)
        self._end, at = EliasFano.from_bytes(blob, at)
        self._ids = np.frombuffer(blob, f"<u{width}", self.n_ids, at)

    def __len__(self) -> int:
        return self.n_docs

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self._doc.select(i - self.n_null) + self.least

    def bounds(self, i: int) -> tuple[int, int]:
        return (self._end.select(i - 1) if i else 0), self._end.select(i)

    def ids(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return self._ids[a:b]

    def doc_ids(self) -> list:
        return [None] * self.n_null + (self._doc.all() + self.least).tolist()

    def ends(self) -> np.ndarray:
        return self._end.all()

    def all_ids(self) -> np.ndarray:
        return self._ids


BLOCKS = "part int, seq long, n_docs long, n_ids long, blob binary"
ROWS = "doc_id long, part int, seq long, at long, n_tokens long, ids_crc32 long"


def blocks(docs: DataFrame, vocab: str, end_id: int = 0, block_ids: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lazy table of blocks. One range partition after another holds ascending doc_ids; rows with equal or null ids keep
    the order in which they are read. A block closes at ``block_ids`` ids; a longer document has a block of its own."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, part, end = tokens.encoder(vocab, 800_000), TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        ids, docs_, held, seq = [], [], 0, 0

        def closed():
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": [seq], "n_docs": [len(ids)], "n_ids": [held // 4], "blob": pa.array([pack_block(docs_, ids)], pa.binary())})

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = enc.ids(text.as_py()) + end
                docs_.append(doc)
                ids.append(x)
                held += len(x)
                if held >= 4 * block_ids:
                    yield closed()
                    ids, docs_, held, seq = [], [], 0, seq + 1
        if ids:
            yield closed()

    shared.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t"), F.monotonically_increasing_id().alias("m"))
    return rows.repartitionByRange(F.col("d").asc_nulls_first(), "m").sortWithinPartitions(F.col("d").asc_nulls_first(), "m").select("d", "t").mapInArrow(run, BLOCKS)


def write(docs: DataFrame, path: str, vocab: str, **kw) -> None:
    """Write the documents' token ids to ``path`` in the format of this module."""
    blocks(docs, vocab, **kw).write.option("compression", "none").parquet(path)


def read(stored: DataFrame) -> DataFrame:
    """From stored blocks, a row for each document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    A null or empty text has the end id alone. Equal doc_ids each keep a row. An empty table gives no rows."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part, seq, blob in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                b = Block(blob.as_py())
                ends = b.ends()
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                ids = b.all_ids().astype("<u4")
                crc = [zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(b)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(b.doc_ids(), pa.int64()), "part": pa.array([part.as_py()] * n, pa.int32()), "seq": pa.array([seq.as_py()] * n, pa.int64()), "at": pa.array(starts), "n_tokens": pa.array(ends - starts), "ids_crc32": pa.array(crc, pa.int64())})

    sizes = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    base = shared.with_base(stored.select("part", "seq", "n_ids"), ["part"], "seq", n="n_ids").join(parts, "part").select("part", "seq", (F.col("before") + F.col("base")).alias("base"))
    return stored.select("part", "seq", "blob").mapInArrow(run, ROWS).join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
