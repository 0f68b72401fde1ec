"""Best-fit packing of token pieces after a Martello-Toth dominance reduction.

Pieces of one length are interchangeable, so the instance is the histogram of lengths: at most ``capacity`` numbers,
whatever the size of the corpus. The driver solves it; each solved run says "slots a to b of length L go to sequences s
to s + (b - a), all at this offset". Pieces get slot numbers within their length by a salted distributed rank.

Reduction (each rule fixes a set that dominates every other set with its largest piece j, because what another
sequence holds beside j can change places with the fixed companions):
  1. nothing fits beside j: {j} alone;
  2. a piece k fills the rest exactly: {j, k};
  3. at most one piece fits beside j: {j, k} with the largest k that fits;
  4. at most two fit beside j and the largest single one, k, is at least as long as the best pair: {j, k}.
The rules run on counts, so one step fixes all equal sets. The remainder is packed best fit, longest first.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared, tokens

OUT = ["uid", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
PIECES = "uid long, doc_id long, piece int, start long, length int, ids binary"


def pieces(docs: DataFrame, vocab: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 23) -> DataFrame:
    """Lazy table of pieces with their ids (little-endian unsigned 32-bit). Null and empty texts have the end id alone."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, end, uid = tokens.encoder(vocab, 400_000), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 40
        out, held = [], 0

        def full():
            cols = list(zip(*out, strict=True))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["uid", "doc_id", "piece", "start", "length", "ids"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.ids(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    out.append((uid, doc, k, at // 4, len(cut) // 4, cut))
                    uid, held = uid + 1, held + len(cut)
                if held >= batch_bytes:
                    yield full()
                    out, held = [], 0
        if out:
            yield full()
        out = []
        shared.trim(encoders=False)

    shared.bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, PIECES)


class _Left:
    """Counts of unplaced pieces by length."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.lengths = sorted(self.n)

    def take(self, length: int, count: int) -> None:
        self.n[length] -= count
        if not self.n[length]:
            del self.n[length]
            del self.lengths[bisect.bisect_left(self.lengths, length)]

    def smallest(self, k: int, but: int) -> list[int]:
        """The k smallest pieces with one piece of length ``but`` set aside."""
        out: list[int] = []
        for x in self.lengths:
            out += [x] * min(self.n[x] - (x == but), k - len(out))
            if len(out) == k:
                break
        return out

    def fitting(self, room: int, but: int) -> int | None:
        """The longest piece within ``room``, one piece of length ``but`` set aside."""
        i = bisect.bisect_right(self.lengths, room) - 1
        while i >= 0 and self.lengths[i] == but and self.n[but] == 1:
            i -= 1
        return self.lengths[i] if i >= 0 else None

    def best_pair(self, room: int, but: int) -> int:
        """The largest sum of two pieces within ``room``."""
        free = [(x, self.n[x] - (x == but)) for x in self.lengths if self.n[x] - (x == but) > 0]
        best, a, b = 0, 0, len(free) - 1
        while a <= b:
            s = free[a][0] + free[b][0]
            if s > room or (a == b and free[a][1] < 2):
                b -= 1
            else:
                best, a = max(best, s), a + 1
        return best


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """([(lengths of a fixed sequence, how many of them)], what remains)."""
    left, fixed = _Left(counts), []

    def fix(members: tuple[int, ...], times: int) -> None:
        fixed.append((members, times))
        for x in members:
            left.take(x, times)

    for j in [x for x in left.lengths if 2 * x >= capacity]:  # rule 2 holds for every j, so it comes first
        if j in left.n and capacity - j in left.n:
            times = left.n[j] // 2 if 2 * j == capacity else min(left.n[j], left.n[capacity - j])
            if times:
                fix((j, capacity - j), times)
    for j in reversed(list(left.lengths)):
        room = capacity - j
        while j in left.n:
            few = left.smallest(3, j)
            k = left.fitting(room, j)
            if k is None:
                fix((j,), left.n[j] if 2 * j > capacity else 1)
            elif len(few) < 2 or few[0] + few[1] > room or ((len(few) < 3 or sum(few) > room) and k >= left.best_pair(room, j)):
                # the rule holds again while both lengths last and the smallest pieces stay the same
                same = k not in few and j not in few and j != k
                fix((j, k), min(left.n[j], left.n[k]) if same else 1)
            else:
                break
        if len(few := left.smallest(3, 0)) == 3 and sum(few) <= room:
            break  # from here on three pieces always fit beside j
    return fixed, dict(left.n)


class _Runs:
    """Collects (length, first slot, first sequence, how many, offset)."""

    def __init__(self):
        self.rows, self.used, self.sequences = [], {}, 0

    def put(self, length: int, sequence: int, count: int, offset: int) -> None:
        a = self.used.get(length, 0)
        self.rows.append((length, a, sequence, count, offset))
        self.used[length] = a + count


def solve(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first slot, first sequence, how many, offset) and the number of sequences.

    Open sequences with equal room are interchangeable, so they are kept as intervals by room: the work depends on the
    number of distinct lengths, not of pieces."""
    runs = _Runs()
    fixed, rest = reduce_dominated(counts, capacity)
    for members, times in fixed:
        at = 0
        for x in members:
            runs.put(x, runs.sequences, times, at)
            at += x
        runs.sequences += times
    rooms: list[int] = []
    open_: dict[int, list[tuple[int, int]]] = {}

    def add(room: int, first: int, n: int) -> None:
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append((first, n))

    for x in sorted(rest, reverse=True):
        todo = rest[x]
        while todo:
            i = bisect.bisect_left(rooms, x)
            if i == len(rooms):
                room, each = capacity, capacity // x
                first, n = runs.sequences, -(-todo // each)
                runs.sequences += n
            else:
                room = rooms[i]
                first, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[i]
                each = room // x
            whole, over = divmod(todo, each)
            if n <= whole:
                for q in range(each):
                    runs.put(x, first, n, capacity - room + q * x)
                add(room - each * x, first, n)
                todo -= n * each
            else:
                for q in range(each):
                    if m := whole + (q < over):
                        runs.put(x, first, m, capacity - room + q * x)
                if whole:
                    add(room - each * x, first, whole)
                if over:
                    add(room - over * x, first + whole, 1)
                if n - whole - (over > 0) > 0:
                    add(room, first + whole + (over > 0), n - whole - (over > 0))
                todo = 0
    return runs.rows, runs.sequences


def pack(stored: DataFrame, capacity: int = 4096, salts: int = 0) -> DataFrame:
    """``stored`` pieces (see ``pieces``, written) with sequence_id and offset; the ids themselves are not shuffled.

    Every piece is placed once; offsets in a sequence are gapless from 0; equal pieces may change places. An empty
    table gives no rows. Only the histogram of lengths reaches the driver (at most ``capacity`` rows); the runs sent back
    depend on distinct lengths alone."""
    spark = stored.sparkSession
    counts = {int(r[0]): int(r[1]) for r in stored.groupBy("length").count().collect()}
    runs, _ = solve(counts, capacity)
    runs.sort()
    wide = np.int64(1) << np.int64(48)
    r = np.array(runs, dtype=np.int64).reshape(-1, 5)
    held = spark.sparkContext.broadcast((r[:, 0] * wide + r[:, 1], r[:, 1], r[:, 2], r[:, 4]))

    salts = salts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = stored.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int"))
    base = shared.with_base(rows.groupBy("length", "salt").agg(F.count("*").alias("n")), ["length"], "salt").select("length", "salt", "base")
    rows = rows.withColumn("ids_crc32", F.crc32("ids")).select("uid", "doc_id", "piece", "start", "length", "ids_crc32", "salt")
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("length", "salt").orderBy("uid"))).join(base, ["length", "salt"]).withColumn("slot", F.col("base") + F.col("k") - 1)

    def place(batches):
        import pyarrow as pa

        shared.trim()  # all pieces are encoded by now
        keys, first, sequence, offset = held.value
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            i = np.searchsorted(keys, batch.column("length").to_numpy() * wide + slot, side="right") - 1
            kept = [batch.column(c) for c in OUT[:6]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence[i] + slot - first[i]), pa.array(offset[i])], OUT)

    rows = ranked.select("uid", "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "slot")
    return rows.mapInArrow(place, "uid long, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
