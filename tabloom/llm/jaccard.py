"""Exact Jaccard join of documents on word shingles, and the components it links.

The join is the product of the sparse document by shingle incidence with its transpose, made in blocks and kept to what can
matter:

* equal sets are one row of the incidence, a class;
* columns: every class lists its shingles in one global order, those in many documents last. Of n shingles only the first
  n - ceil(t n) + 1 (its prefix) enter the first block of columns: by their sizes alone, classes that reach the threshold t
  share one of these. The order rests on counts over all shingles, kept in a table of fixed size; any order gives the same
  links;
* overlap counts of pairs are added up over these columns, and pairs whose count, with all that the other columns can
  add, stays below the bound that their sizes set are discarded;
* rows: what is left is laid out in blocks of one class and at most ``block`` of its candidates. In a block the rows meet
  with all their columns, which gives the full overlap counts, and these decide. A class with many candidates has many
  blocks, dealt by a salt, so no task holds all of them;
* a column with more than ``crowd`` classes is not multiplied out at once. Its classes are first compared with one of their
  own number for a few rounds; classes that are then in one component need no further comparison. What is left is measured
  against a pivot of its crowd, the shingles that most of the crowd hold, and compared with the class nearest to it. What two
  classes hold in and outside of the pivot bounds their overlap, so classes that no class of another component can reach
  drop out one by one, before any pair is made. Only the others are multiplied out across components, by ranges of sizes. So
  all pairs of a large group of near copies are never made, and no link that would join two components is lost.

Shingles are 64-bit hashes of five consecutive lower-cased words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .components import components

#: ASCII capitals are lower-cased; bytes.split() then parts words at space and at \t, \n, \v, \f, \r.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Odd multipliers, one for each word of a shingle, and the last for the finish.
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


class _Hashes(dict):
    """Word -> 64-bit hash; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        out = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[word] = out
        return out


_CACHE = _Hashes()


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; of all its words together if it has fewer than ``width``."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(_CACHE.__getitem__, words), np.uint64, len(words))
    k = min(width, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            x = h[i : len(h) - k + 1 + i] * (_ODD[i % 5] + np.uint64(2 * (i // 5)))
            out += x ^ (x >> np.uint64(29))
        out ^= out >> np.uint64(32)
        out *= _ODD[5]
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def needed(n: int) -> int:
    """The least overlap that a set of n shares with any set linked to it, for a similarity of 0.75."""
    return (3 * n + 3) // 4


def _enough(overlap: Column, a: Column, b: Column) -> Column:
    """100 * intersection >= 75 * union."""
    return 7 * overlap >= 3 * (a + b)


def _least_size(n: Column) -> Column:
    return F.floor((3 * n + 3) / 4)


def _most_size(n: Column, alone: Column) -> Column:
    """The largest set that a set of n can link with, where ``alone`` of its shingles are known to be in no other.

    Of two prefixes the one that ends first holds no shingle that the other class has behind its own prefix, so the overlap
    holds none of those that this prefix has alone. This bound is for the class whose prefix ends first."""
    return F.least(F.floor(4 * n / 3), F.floor((4 * n - 7 * alone) / 3))


#: Ratio of the ends of a range of sizes.
_RANGE = 1.05


def _step(n: Column) -> Column:
    """Sizes in ranges of which each is a twentieth longer than the one before."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(_RANGE)))


def _cells(h: np.ndarray, bits: int) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def common_cells(rows: DataFrame, width: int, bits: int, least: int, batch: int = 1 << 20) -> np.ndarray:
    """A bit for each of 2**bits cells of the hashes: does it hold markedly more document-shingle pairs than others?

    A task adds up counts for some million shingles at a time and sends, for each chunk of 65536 cells, the cells in use;
    chunks are added up where they meet, and a cell is common at ``least`` pairs and four times the mean of its chunk. What
    comes back has 2**bits / 8 bytes, whatever the input."""
    chunk_bits = min(16, bits)

    def count(batches):
        import pyarrow as pa

        def sent(parts):
            cells, n = np.unique(_cells(np.concatenate(parts), bits), return_counts=True)
            chunk = cells >> chunk_bits
            first = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
            ends = np.append(first[1:], len(cells))
            at, n = (cells & ((1 << chunk_bits) - 1)).astype("<u2"), np.minimum(n, 65535).astype("<u2")
            blobs = []
            for a, b in zip(first.tolist(), ends.tolist(), strict=True):
                more = np.flatnonzero(n[a:b] > 1)
                blobs.append(np.array([b - a, len(more)], "<u4").tobytes() + at[a:b].tobytes() + more.astype("<u2").tobytes() + n[a:b][more].tobytes())
            return pa.RecordBatch.from_pydict({"chunk": pa.array(chunk[first], pa.int32()), "blob": pa.array(blobs, pa.binary())})

        parts, held = [], 0
        for b in batches:
            for t in b.column(b.num_columns - 1):
                s = shingles(t.as_py(), width)
                if len(s):
                    parts.append(s)
                    held += len(s)
                    if held >= batch:
                        yield sent(parts)
                        parts, held = [], 0
        if parts:
            yield sent(parts)
        _CACHE.clear()
        shared.trim()

    def added(batches):
        import pyarrow as pa

        now, total = None, None

        def done():
            common = total >= max(least, 4 * int(total.sum(dtype=np.int64)) >> chunk_bits)
            return pa.RecordBatch.from_pydict({"chunk": pa.array([now], pa.int32()), "bits": pa.array([np.packbits(common).tobytes()], pa.binary())})

        for b in batches:
            for chunk, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if chunk != now:
                    if now is not None:
                        yield done()
                    now, total = chunk, np.zeros(1 << chunk_bits, "<u4")
                blob = blob.as_py()
                n, more = np.frombuffer(blob, "<u4", 2).tolist()
                at = np.frombuffer(blob, "<u2", n, 8)
                total[at] += 1
                if more:
                    total[at[np.frombuffer(blob, "<u2", more, 8 + 2 * n)]] += np.frombuffer(blob, "<u2", more, 8 + 2 * n + 2 * more) - np.uint32(1)
        if now is not None:
            yield done()

    marks = rows.mapInArrow(count, "chunk int, blob binary").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(added, "chunk int, bits binary")
    out = np.zeros((1 << bits) // 8 or 1, np.uint8)
    size = (1 << chunk_bits) // 8 or 1
    for chunk, blob in marks.collect():  # 2**bits / 8 bytes in all
        out[chunk * size : (chunk + 1) * size] = np.frombuffer(blob, np.uint8)
    return out


def _is_common(h: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    c = _cells(h, bits)
    return (table[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1


def _prefix(s: np.ndarray, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The rare and the common shingles of the prefix."""
    keep = len(s) - needed(len(s)) + 1 if len(s) else 0
    common = _is_common(s, table, bits)
    rare = s[~common][:keep]
    return rare, s[common][: keep - len(rare)]


def _class(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _arrays(parts: list[np.ndarray]):
    import pyarrow as pa

    sizes = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _listed(rows: DataFrame, table, width: int, bits: int) -> DataFrame:
    """doc_id, t, n, cls and the prefix of each document: its rare shingles, then its common ones, and the last of all."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            n, cls, rares, commons, lasts = [], [], [], [], []
            for t in b.column(2):
                s = shingles(t.as_py(), width)
                n.append(len(s))
                cls.append(_class(s) if len(s) else None)
                rare, shared_ = _prefix(s, table.value, bits)
                rares.append(rare)
                commons.append(shared_)
                lasts.append(int((shared_ if len(shared_) else rare)[-1]) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), _arrays(rares), _arrays(commons), pa.array(lasts, pa.int64())], ["doc_id", "t", "n", "cls", "rare", "common", "last"])
        _CACHE.clear()
        shared.trim()

    return rows.mapInArrow(run, "doc_id long, t long, n long, cls long, rare array<long>, common array<long>, last long")


def _met(listed: DataFrame) -> DataFrame:
    """h, cls, g, common: the prefix shingles that several classes have, how many, and if it is a common one.

    Rare shingles are in few documents each, as their cell has fewer than ``least`` or four times the mean, so they are counted
    in place. Common ones, which may be in a third of all, are counted with partial sums and joined, which Spark can split."""
    classes = listed.where("cls is not null").groupBy("cls").agg(F.first("rare").alias("rare"), F.first("common").alias("common"))
    rare = classes.select("cls", F.explode("rare").alias("h"))
    rare = rare.withColumn("g", F.count("*").over(Window.partitionBy("h"))).where("g > 1")
    common = classes.select("cls", F.explode("common").alias("h"))
    common = common.join(common.groupBy("h").agg(F.count("*").alias("g")).where("g > 1"), "h")
    return rare.select("h", "cls", "g", F.lit(False).alias("common")).union(common.select("h", "cls", "g", F.lit(True)))


def _whole_sets(rows: DataFrame, wanted: DataFrame, table, width: int, bits: int) -> DataFrame:
    """cls, its whole set and the rare shingles of its prefix for the classes in ``wanted`` (cls, and key, the hash of the id
    and text of its first row). Texts are picked by a bitmap of fixed size, so they are not shuffled; the few that it lets
    through by chance go in the join on the class. The result is bucketed by class."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, 500):
                sets = [shingles(x.as_py(), width) for x in b.column(0)[lo : lo + 500]]
                sets = [s for s in sets if len(s)]
                if sets:
                    yield pa.RecordBatch.from_pydict({"cls": pa.array([_class(s) for s in sets], pa.int64()), "shingles": _arrays(sets), "rare": _arrays([_prefix(s, table.value, bits)[0] for s in sets])})
        _CACHE.clear()
        shared.trim()

    marks = shared.settle(shared.bitmap(wanted, "key"), "jaccard-marks")
    keyed = rows.select("text", F.xxhash64("doc_id", "t").alias("key"))
    sets = shared.marked(keyed, "key", marks, "wanted").where("wanted").select("text").mapInArrow(run, "cls long, shingles array<long>, rare array<long>")
    sets = sets.groupBy("cls").agg(F.first("shingles").alias("shingles"), F.first("rare").alias("rare")).join(wanted.select("cls"), "cls", "left_semi")
    sets = shared.settle(sets, "jaccard-sets", by="cls")
    shared.discard(marks)
    return sets


def _in_blocks(pairs: DataFrame, xs: DataFrame, ys: DataFrame, block: int) -> DataFrame:
    """``pairs`` (a, b) with the columns of ``xs`` for a and of ``ys`` (b, y) for b, in blocks of one b and at most about
    ``block`` a."""
    hubs = pairs.groupBy("b").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = pairs.join(hubs, "b").select("a", "b", F.pmod(F.xxhash64("a"), "blocks").cast("int").alias("salt"))
    y = hubs.join(ys, "b").select("b", "y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"))
    return dealt.join(xs, "a").join(y, ["b", "salt"])


def _linked(pairs: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """The ``pairs`` (a, b) of classes that reach the threshold by their full overlap, counted in blocks of one b. Rows of
    ``pairs`` are distinct."""
    pairs = shared.settle(pairs, "jaccard-pairs")
    both = _in_blocks(pairs, sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), block)
    links = both.where(_enough(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b")
    links = shared.settle(links, "jaccard-links")
    shared.discard(pairs)
    return links


def _counted(met: DataFrame, crowd: int) -> DataFrame:
    """(a, b, c): overlap counts over the columns of few classes, a < b."""
    few = met.where(F.col("g") <= crowd).groupBy("h").agg(F.collect_list("cls").alias("all"))  # at most ``crowd`` each
    pairs = few.select(F.explode("all").alias("a"), "all").select("a", F.explode(F.filter("all", lambda c: c > F.col("a"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("c"))


def _bounded(counts: DataFrame, known: DataFrame) -> DataFrame:
    """The counted pairs that their sizes and what crowded columns can add let link."""
    a, b = (known.select(F.col("cls").alias(s), *[F.col(c).alias(f"{c}{s}") for c in ("n", "last", "alone")], F.col("q").alias(f"o{s}")) for s in "ab")
    first = F.col("lasta") <= F.col("lastb")
    possible = F.when(first, F.col("nb") <= _most_size(F.col("na"), F.col("alonea"))).otherwise(F.col("na") <= _most_size(F.col("nb"), F.col("aloneb")))
    sized = _least_size(F.greatest("na", "nb")) <= F.least("na", "nb")
    reaches = _reaches(F.col("c") + F.least("oa", "ob"), F.when(first, F.col("na")).otherwise(F.col("nb")), F.col("na"), F.col("nb"))
    return counts.join(a, "a").join(b, "b").where(sized & possible & reaches).select("a", "b")


def _reaches(shared_: Column, first: Column, na: Column, nb: Column) -> Column:
    """Whether an overlap can reach the bound that the sizes set. Of two prefixes the one that ends first (of a set of size
    ``first``) has no shingle behind the other, so the overlap is at most what the prefixes share and what lies behind this one."""
    return _enough(shared_ + _least_size(first) - 1, na, nb)


#: Links, or what is left of them, whose components one task finds: 1 MB.
_FEW = 1 << 16
#: Classes of a crowd that vote on its pivot, as their mean number.
_VOTERS = 24


def _pivoted(apart: DataFrame, mixed: DataFrame, hot: DataFrame, sets: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(h, pivot): a pivot for each mixed column, and (cls, pivot, i, s, near): each class held against the pivots of its columns.

    Every class has a main column, its largest. The pivot of a main column holds the shingles that most of its classes have,
    by the votes of some of them; any set would do, a good one leaves fewer classes. A column takes the pivot of the main
    column that most of its classes have. Of a class's shingles in the pivot (i) and outside (s) those rare ones of its prefix
    count not that are in columns of few classes, as pairs that share such a column are decided; ``open`` is the number of the
    others. Rows of classes that can't link in their column by that number alone are not measured. ``near`` is the similarity
    of what counts and the pivot."""
    met = _reachable(apart.join(mixed.select("h"), "h").withColumns({"i": F.col("open"), "s": F.lit(0)}))
    met = shared.settle(met.select("h", "cls", "g"), "jaccard-open")
    main = shared.settle(met.groupBy("cls").agg(F.max(F.struct("g", "h")).alias("m")).select("cls", F.col("m.h").alias("pivot")), "jaccard-main")
    voters = main.join(main.groupBy("pivot").agg(F.count("*").alias("size")), "pivot").where(F.pmod(F.xxhash64("cls"), "size") < _VOTERS).select("cls", "pivot")
    voters = shared.settle(voters, "jaccard-voters")
    votes = voters.join(sets.select("cls", "shingles"), "cls").select("pivot", F.explode("shingles").alias("x")).groupBy("pivot", "x").agg(F.count("*").alias("votes"))
    most = votes.join(voters.groupBy("pivot").agg(F.count("*").alias("voters")), "pivot").where(2 * F.col("votes") > F.col("voters"))
    pivots = shared.settle(most.groupBy("pivot").agg(F.collect_list("x").alias("y")), "jaccard-pivots")  # at most twice a voter's set
    taken = met.join(main, "cls").groupBy("h", "pivot").count().join(pivots.select("pivot"), "pivot", "left_semi")
    taken = shared.settle(taken.groupBy("h").agg(F.max_by("pivot", F.struct("count", "pivot")).alias("pivot")), "jaccard-taken")

    pairs = shared.settle(met.join(taken, "h").select(F.col("cls").alias("a"), F.col("pivot").alias("b")).distinct(), "jaccard-pairs")
    crowded = hot.join(main.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.collect_list("h").alias("crowded"))
    own = crowded.join(sets, "cls").select(F.col("cls").alias("a"), F.size("shingles").alias("n"), F.array_except("shingles", F.array_except("rare", "crowded")).alias("x"))
    both = _in_blocks(pairs, own, pivots.select(F.col("pivot").alias("b"), "y"), block)
    i = F.size(F.array_intersect("x", "y"))
    measured = both.select(F.col("a").alias("cls"), F.col("b").alias("pivot"), "n", i.cast("long").alias("i"), (F.size("x") - i).cast("long").alias("s"), (i / (F.col("n") + F.size("y") - i)).alias("near"))
    measured = shared.settle(measured, "jaccard-measured")
    shared.discard(met, main, voters, pivots, pairs)
    return taken, measured


def _to_nearest(apart: DataFrame, measured: DataFrame) -> DataFrame:
    """Pairs (a, b) of each class with the class nearest to the pivot of a column of it, where they are in different components
    and what they hold in and outside of the pivot lets them link."""
    part = apart.select("cls", "component").distinct()
    held = measured.join(part, "cls")
    nearest = held.groupBy("pivot").agg(F.max_by(F.struct("cls", "component", "n", "i", "s"), F.struct("near", "cls")).alias("b"))
    possible = _enough(F.least("i", "b.i") + F.least("s", "b.s"), F.col("n"), F.col("b.n")) & (F.col("component") != F.col("b.component"))
    return held.join(nearest, "pivot").where(possible).select(F.col("cls").alias("a"), F.col("b.cls").alias("b")).distinct()


def _reachable(open_: DataFrame) -> DataFrame:
    """The rows of ``open_`` whose class may link with one of another component in that column, by what both hold in and
    outside of the column's pivot: an overlap is at most the lesser of both i and the lesser of both s.

    Rows are held against the classes of their column in ranges of n and s, of which the largest i and s and the least n count,
    in all and outside of the component that has most of the column. Rare shingles of a prefix that are in no crowded column
    are in no class that ends with a common one, without a column shared; so the bound is used in columns whose classes all
    end so (``sure``), which those of common shingles are."""
    most = open_.groupBy("h", "component").count().groupBy("h").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    open_ = open_.join(most, "h")
    away = F.col("component") != F.col("main")
    ranges = open_.groupBy("h", _step(F.col("n")).alias("step"), F.floor(F.log2(F.col("s") + 1)).alias("range")).agg(
        *[f(F.when(w, F.col(c))).alias(f"{x}{c}") for w, x in ((F.lit(True), "all_"), (away, "away_")) for f, c in ((F.max, "i"), (F.max, "s"), (F.min, "n"))],
        F.bool_and(F.col("last.common") & F.col("i").isNotNull()).alias("sure"),
    )
    columns = ["all_i", "all_s", "all_n", "away_i", "away_s", "away_n"]
    ranges = ranges.groupBy("h").agg(F.collect_list(F.struct(*columns)).alias("ranges"), F.bool_and("sure").alias("sure"))  # some hundreds

    def possible(r: Column) -> Column:
        i, s, n = (F.when(away, r[f"all_{c}"]).otherwise(r[f"away_{c}"]) for c in "isn")
        return _enough(F.least("i", i) + F.least("s", s), F.col("n"), n) & i.isNotNull()

    return open_.join(ranges, "h").where(~F.col("sure") | F.exists("ranges", possible)).drop("main", "ranges")


def _across(apart: DataFrame, mixed: DataFrame, taken: DataFrame, measured: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that meet in crowded columns alone and that their sizes and pivots let link.

    Let a be the class whose prefix ends first. It meets only classes of the sizes that it can link with, and must share with
    them ``t`` of its crowded columns, as what lies behind its prefix adds at most ``needed`` - 1. Of sets that share t of one
    global order, the first they share is not among the last t - 1 of either, so these are left out on both sides. Both
    are dealt by column and by ranges of both sizes, so classes that share a column but can't link are not paired."""
    mine = Window.partitionBy("cls")  # at most the shingles of one text
    open_ = apart.join(mixed.select("h"), "h").select("*", F.row_number().over(mine.orderBy("g", "h")).alias("rank"), F.count("*").over(mine).alias("q"))
    open_ = open_.join(taken, "h", "left").join(measured.select("cls", "pivot", "i", "s"), ["cls", "pivot"], "left")
    open_ = _reachable(open_.where("pivot is null or i is not null"))  # others were not within reach of any before they were measured
    n, own = F.col("n"), F.struct("last", "cls")  # a total order, so each pair is made once

    def least_shared(na: Column, nb: Column) -> Column:
        return F.ceil(3 * (na + nb) / 7) - _least_size(na) + 1

    x = open_.select("h", "rank", "q", "n", "sure", F.col("i").alias("ia"), F.col("s").alias("sa"), F.col("cls").alias("a"), F.col("component").alias("ca"), own.alias("enda"), _least_size(n).alias("lo"), _most_size(n, F.col("apart")).alias("hi"), _step(n).alias("stepa")).where("hi >= lo")
    x = x.withColumn("stepb", F.explode(F.sequence(_step(F.col("lo")), _step(F.col("hi")))))
    smallest = F.greatest("lo", F.floor(F.pow(F.lit(_RANGE), "stepb") * (1 - 1e-9)))
    x = x.where(F.col("rank") <= F.col("q") + 1 - F.greatest(F.lit(1), least_shared(n, smallest)))
    y = open_.select("h", "rank", "q", F.col("i").alias("ib"), F.col("s").alias("sb"), F.col("cls").alias("b"), n.alias("nb"), F.col("component").alias("cb"), own.alias("endb"), _step(n).alias("stepb"), F.explode(F.sequence(_step(_least_size(n)), _step(F.floor(4 * n / 3)))).alias("stepa"))
    largest = F.least(F.floor(4 * F.col("nb") / 3), F.ceil(F.pow(F.lit(_RANGE), F.col("stepa") + 1) * (1 + 1e-9)))
    # least_shared falls as a grows, but for one that rounding may add
    y = y.where(F.col("rank") <= F.col("q") + 1 - F.greatest(F.lit(1), least_shared(largest, F.col("nb")) - 1))
    met = x.drop("rank", "q").join(y.drop("rank", "q"), ["h", "stepa", "stepb"])
    possible = ~F.col("sure") | _enough(F.least("ia", "ib") + F.least("sa", "sb"), n, F.col("nb"))
    return met.where(possible & (F.col("enda") < F.col("endb")) & (F.col("ca") != F.col("cb")) & F.col("nb").between(F.col("lo"), F.col("hi"))).select("a", "b").distinct()


def groups(docs: DataFrame, width: int = 5, crowd: int = 24, rounds: int = 3, bits: int = 26, least: int = 32, block: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, t, n, cls, first for each row: the 64-bit hash of its text, the size of its set, the hash of its set (null if
    empty), and (nameless, doc_id, t) of the first row of its component, rows with a null doc_id coming last."""
    spark = docs.sparkSession
    shared.bounded_batches(spark)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("t"), text.alias("text"))
    table = spark.sparkContext.broadcast(common_cells(rows.select("text"), width, bits, least))
    listed = shared.settle(_listed(rows, table, width, bits), "jaccard-listed")
    facts = shared.settle(listed.select("doc_id", "t", "n", "cls"), "jaccard-facts")
    last = F.struct((F.size("common") > 0).alias("common"), F.col("last").alias("h"))  # compares as the order of shingles does
    one = listed.where("cls is not null").select("cls", "n", F.size("rare").alias("rares"), last.alias("last"), F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "t").alias("first"))
    sizes = shared.settle(one.groupBy("cls").agg(F.first("n").alias("n"), F.first("rares").alias("rares"), F.first("last").alias("last"), F.min("first").alias("first")), "jaccard-classes")
    met = shared.settle(_met(listed), "jaccard-met")
    shared.discard(listed)
    shared.release(spark)

    # what may link: pairs that meet in columns of few classes, counted and held against their bound
    seen = met.groupBy("cls").agg(F.count("*").alias("m"), F.sum((F.col("g") > crowd).cast("long")).alias("q"), F.sum((~F.col("common") & (F.col("g") > crowd)).cast("long")).alias("qr"))
    alone, open_ = F.col("n") - _least_size(F.col("n")) + 1 - F.col("m"), F.col("n") - F.col("rares") + F.col("qr")
    known = seen.join(sizes, "cls").select("cls", "n", "last", "m", "q", alone.alias("alone"), open_.alias("open"))
    known = shared.settle(known, "jaccard-known")
    counts = shared.settle(_counted(met, crowd), "jaccard-counts")
    likely = shared.settle(_bounded(counts, known), "jaccard-likely")
    # pairs that meet in some column of few classes are decided above; for others all those are ``apart``
    hot = met.where(F.col("g") > crowd).select("h", "g", "cls").join(known.select("cls", "n", "last", "open", (F.col("alone") + F.col("m") - F.col("q")).alias("apart")), "cls")
    hot = shared.settle(hot, "jaccard-crowds")
    shared.discard(met)
    shared.release(spark)
    wanted = likely.select(F.col("a").alias("cls")).union(likely.select("b")).union(hot.select("cls")).distinct()
    wanted = shared.settle(wanted.join(sizes, "cls").select("cls", F.xxhash64("first.doc_id", "first.t").alias("key")), "jaccard-wanted")
    sets = _whole_sets(rows, wanted, table, width, bits)
    links = _linked(likely, sets, block)
    shared.discard(wanted, known, counts, likely)
    table.destroy()
    shared.release(spark)
    part = components(links, "jaccard", few=_FEW)

    # crowds: one of them is compared with all others, then the one nearest to its pivot, then only pairs across components are left
    k, taken, measured = 0, None, None
    while k <= rounds + 1:
        apart = hot.join(part.withColumnRenamed("node", "cls"), "cls", "left").select("h", "g", "cls", "n", "last", "apart", "open", F.coalesce("component", "cls").alias("component"))
        # first the class with the fewest shingles of its own, which is likely the one that others were made from
        rank = (F.col("apart") / F.col("n") if k % 2 == 0 else F.lit(0.0)).alias("rank")
        mixed = apart.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.struct(rank, F.xxhash64(F.lit(k), "cls").alias("r"), "cls", "n", "last", "apart", "component")).alias("centre")).where("lo < hi")
        mixed = shared.settle(mixed, "jaccard-mixed")
        if mixed.isEmpty():
            shared.discard(mixed)
            break
        if k < rounds:
            c = {f: F.col(f"centre.{f}") for f in ("n", "last", "apart")}
            low = F.col("last") <= c["last"]
            near = F.when(low, c["n"] <= _most_size(F.col("n"), F.col("apart"))).otherwise(F.col("n") <= _most_size(c["n"], c["apart"]))
            near = near & (_least_size(F.greatest("n", c["n"])) <= F.least("n", c["n"])) & (F.col("component") != F.col("centre.component"))
            tally = apart.join(mixed.select("h", "centre"), "h").where(near).groupBy("cls", F.col("centre.cls").alias("c")).count()
            chosen = tally.groupBy("cls").agg(F.max_by("c", F.struct("count", "c")).alias("c")).select(F.col("cls").alias("a"), F.col("c").alias("b"))
        elif k == rounds:
            taken, measured = _pivoted(apart, mixed, hot, sets, block)
            shared.release(spark)
            chosen = _to_nearest(apart, measured)
        else:
            chosen = _across(apart, mixed, taken, measured)
        new = _linked(chosen, sets, block)
        shared.discard(mixed)
        if new.isEmpty():
            k = max(k + 1, rounds)  # a round without links: only the pivots and the pairs are left
        else:
            both, old = shared.settle(links.union(new), "jaccard-links"), (links, part)
            links, k = both, k + 1
            part = components(links, "jaccard", few=_FEW)
            shared.discard(*old)
        shared.discard(new)
        shared.release(spark)
    shared.discard(hot, sets, links, *([taken, measured] if measured is not None else []))

    named = sizes.join(part.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "first", F.coalesce("component", "cls").alias("component"))
    named = shared.settle(named, "jaccard-named")
    named_first = named.groupBy("component").agg(F.min("first").alias("first"))
    found = shared.settle(facts.join(named.select("cls", "component").join(named_first, "component").select("cls", "first"), "cls", "left").select("doc_id", "t", "n", "cls", "first"), "jaccard-groups")
    shared.discard(facts, sizes, part, named)
    shared.release(spark)
    return found


def near_components(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_shingles, component_id for each row; documents link at a Jaccard similarity of 0.75 or more of their sets.

    A document without words (or null text) has an empty set and is its own component. Equal rows and equal doc_ids each
    keep a row. Rows with a null doc_id take part like others; component_id is null where no row of a component has an id. See
    ``groups`` for the parameters."""
    found = groups(docs, **how)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest doc_id, a null one coming last.

    Of repeated rows (equal doc_id and text) one stays, whichever. Documents without words link with nothing, so all of
    them stay. The columns are those of ``docs``, whatever their names. Only rows that may go are shuffled with their texts:
    a bitmap of fixed size tells them apart, and an exact join decides on them."""
    found = groups(docs, id_col=id_col, text_col=text_col, **how).where("cls is not null")
    key = F.xxhash64("doc_id", "t")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("t") == F.col("first.t"))
    verdicts = found.select(key.alias("key"), "doc_id", "t", kept.alias("kept")).groupBy("key", "doc_id", "t", "kept").agg(F.count("*").alias("rows"))
    verdicts = shared.settle(verdicts.where("not kept or rows > 1"), "jaccard-verdicts")
    shared.discard(found)
    marks = shared.settle(shared.bitmap(verdicts, "key"), "jaccard-marks")

    d, t, k, maybe = (shared.fresh(x, docs) for x in ("own_id", "own_text", "own_key", "own_mark"))
    text = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    keyed = docs.withColumn(d, F.col(id_col).cast("long")).withColumn(t, text).withColumn(k, F.xxhash64(d, t))
    keyed = shared.marked(keyed, k, marks, maybe)
    v = verdicts.select(F.col("key").alias(f"{k}v"), F.col("doc_id").alias(f"{d}v"), F.col("t").alias(f"{t}v"), F.col("kept").alias(f"{maybe}v"))
    judged = keyed.where(F.col(maybe)).join(v, (F.col(k) == F.col(f"{k}v")) & F.col(d).eqNullSafe(F.col(f"{d}v")) & (F.col(t) == F.col(f"{t}v")), "left")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(maybe)
    again = judged.where(F.col(f"{maybe}v")).groupBy(k, d, t).agg(F.first(row).alias(maybe)).select(f"{maybe}.*")
    through = judged.where(F.col(f"{maybe}v").isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])
    return keyed.where(~F.col(maybe)).select(*[F.col(f"`{c}`") for c in docs.columns]).union(through).union(again)
