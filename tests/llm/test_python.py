import hashlib
import random
import re
import struct
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import jaccard, languages, ordinal, suffixes, tiff

from .conftest import SCHEMA, prose, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# ---- TIFF ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@settings(max_examples=25, deadline=None)
@given(st.integers(0, 200), st.integers(1, 9), st.integers(0, 5), st.integers(1, 256))
def test_tiff_round_trip(compression, predictor, n, strip, seed, kinds):
    r = random.Random(seed)
    payload = bytes(r.randrange(kinds) for _ in range(64 * n))
    for how in ({"strip_rows": strip}, {"tile": (16 * strip, 16)}, {"tile": (32, 64)}):
        found = list(tiff.pages(tiff.encode(payload, page_rows=50, compression=compression, predictor=predictor, **how)))
        assert b"".join(p.pixels for p in found) == payload and [p.index for p in found] == list(range(len(found)))
        assert found[0].tiled == ("tile" in how) if found else True


def hand_made(order, big, tags, chunks, at_tag, size_tag):
    """A file built by the format's rules alone: header, chunks, one directory."""
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0))
    out, spots = bytearray(head), []
    for c in chunks:
        spots.append(len(out))
        out += c
    tags = {**tags, at_tag: (4, spots), size_tag: (4, [len(c) for c in chunks])}
    entries = []
    for tag in sorted(tags):
        kind, values = tags[tag]
        data = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(data) > (8 if big else 4):
            at = len(out)
            out += data
            data = struct.pack(order + ("Q" if big else "I"), at)
        entries.append(struct.pack(order + ("HHQ" if big else "HHI"), tag, kind, len(values)) + data.ljust(8 if big else 4, b"\0"))
    struct.pack_into(order + ("Q" if big else "I"), out, 8 if big else 4, len(out))
    return bytes(out + struct.pack(order + ("Q" if big else "H"), len(entries)) + b"".join(entries) + bytes(8 if big else 4))


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("planar", [1, 2])
@pytest.mark.parametrize("bits", [8, 16, 32])
@pytest.mark.parametrize("predictor", [1, 2, 3])
def test_tiff_tiles(order, big, planar, bits, predictor):
    if predictor == 3 and bits == 8:
        return
    h, w, s, th, tw = 21, 37, 3, 16, 16
    r = np.random.default_rng(1)
    kind = np.dtype(f"{order}u{bits // 8}")
    image = r.integers(0, 1 << min(bits, 31), (h, w, s)).astype(kind)
    chunks = []
    for sheet in [image] if planar == 1 else [image[:, :, k : k + 1] for k in range(s)]:
        for y in range(0, h, th):
            for x in range(0, w, tw):
                t = np.zeros((th, tw, sheet.shape[2]), kind)
                part = sheet[y : y + th, x : x + tw]
                t[: part.shape[0], : part.shape[1]] = part
                if predictor == 2:
                    t = np.concatenate([t[:, :1], t[:, 1:] - t[:, :-1]], axis=1).astype(kind)
                data = t.tobytes()
                if predictor == 3:
                    b = np.frombuffer(t.astype(t.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(th, tw * t.shape[2], bits // 8).transpose(0, 2, 1).reshape(th, -1)
                    k = t.shape[2]
                    d = b.copy()
                    d[:, k:] = b[:, k:] - b[:, :-k]
                    data = d.tobytes()
                chunks.append(zlib.compress(data))
    tags = {256: (4, [w]), 257: (4, [h]), 258: (3, [bits] * s), 259: (3, [8]), 277: (3, [s]), 284: (3, [planar]), 317: (3, [predictor]), 322: (4, [tw]), 323: (4, [th])}
    (page,) = tiff.pages(hand_made(order, big, tags, chunks, 324, 325))
    assert page.pixels == image.tobytes() and (page.width, page.height, page.samples, page.bits, page.tiled) == (w, h, s, bits, True)


def test_lzw_known_stream():
    # the codes of the sequence 7 7 7 8 8 7 7 6 6, high bit first: clear, 7, 258, 8, 8, 258, 6, 6, end
    codes, bits = [256, 7, 258, 8, 8, 258, 6, 6, 257], 0
    for c in codes:
        bits = bits << 9 | c
    n = 9 * len(codes)
    data = (bits << (-n % 8)).to_bytes((n + 7) // 8, "big")
    assert tiff.lzw_decode(data) == tiff.lzw_decode(tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]))) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert tiff.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_tiff_changed_bytes(compression):
    """Whatever bytes change, pages or a TiffError come out, in bounded memory; a shorter chunk is an error."""
    r = random.Random(compression)
    good = tiff.encode(bytes(r.randrange(6) for _ in range(64 * 40)), page_rows=17, strip_rows=5, compression=compression, predictor=2, tile=(32, 16) if compression == tiff.LZW else None)
    tracemalloc.start()
    for _ in range(1500):
        bad = bytearray(good)
        for _ in range(r.choice([1, 1, 2, 5])):
            bad[r.randrange(len(bad))] = r.choice([0, 1, 255, r.randrange(256)])
        try:
            list(tiff.pages(bytes(bad)))
        except tiff.TiffError:
            pass
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    first = struct.unpack_from("<I", good, 4)[0]
    for k in range(struct.unpack_from("<H", good, first)[0]):
        at = first + 2 + 12 * k
        tag, _, n, value = struct.unpack_from("<HHII", good, at)
        if tag in (tiff.STRIP_BYTES, tiff.TILE_BYTES):
            spot = value if n > 1 else at + 8
            short = bytearray(good)
            struct.pack_into("<I", short, spot, struct.unpack_from("<I", good, spot)[0] // 2)
            with pytest.raises(tiff.TiffError):
                list(tiff.pages(bytes(short)))


def test_tiff_table(spark, edges, nothing):
    media = tiff.write_texts(edges, page_rows=3)
    got = tiff.read_files(media).collect()
    want = Counter()
    for r in edges.collect():
        b = (r.text or "").encode()
        p = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        want[r.doc_id, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    pages = tiff.read_pages(media).where("doc_id = 13").collect()
    assert len(pages) == 16 and b"".join(r.pixels for r in sorted(pages, key=lambda r: r.page)).rstrip(b"\0") == b"x" * 3000
    assert tiff.read_files(tiff.write_texts(nothing)).count() == 0
    again = {r.doc_id: r for r in tiff.read_files(tiff.write_texts(edges)).collect()}
    assert all(again[r.doc_id].payload_sha256 == r.payload_sha256 and again[r.doc_id].error is None for r in got if r.doc_id is not None)
    broken = spark.createDataFrame([(1, 5, bytearray(b"hello")), (2, 5, None)], "doc_id long, n_bytes long, media binary")
    assert [(r.doc_id, r.payload_bytes, r.error) for r in tiff.read_files(broken).orderBy("doc_id").collect()] == [(1, None, "b'he'"), (2, None, "no file")]
    layouts = {(p.compression, p.predictor, p.tiled) for x in (bytes([k]) * 64 for k in range(200)) for p in tiff.pages(tiff.encode(x, **tiff.varied(x)))}
    assert len(layouts) >= 12


def test_tiff_damage(spark):
    good = tiff.encode(bytes(range(64)) * 10, page_rows=5)
    loop = bytearray(good)
    first = struct.unpack_from("<I", good, 4)[0]
    n = struct.unpack_from("<H", good, first)[0]
    struct.pack_into("<I", loop, first + 2 + 12 * n, first)
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"hello")), (3, None), (4, loop), (5, bytearray(good[: len(good) - 40])), (6, bytearray(b""))], "doc_id long, media binary")
    got = {}
    for r in tiff.read_pages(df).collect():
        got.setdefault(r.doc_id, []).append((r.page, r.error is None))
    assert got == {1: [(0, True), (1, True)], 2: [(0, False)], 4: [(0, True), (1, False)], 5: got[5], 6: [(0, False)]}
    assert got[5][-1][1] is False


# ---- decontamination ---------------------------------------------------------------------------------


def brute_hits(texts, items, window):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    win = {}
    for name, t in items:
        w = word.findall((t or "").translate(LOWER))
        n = min(window, len(w))
        for a in range(len(w) - n + 1 if n else 0):
            win.setdefault(tuple(w[a : a + n]), set()).add(str(name))
    out = []
    for t in texts:
        w, hit, names = word.findall((t or "").translate(LOWER)), set(), set()
        for n in {len(k) for k in win}:
            for a in range(len(w) - n + 1):
                if x := win.get(tuple(w[a : a + n])):
                    hit |= set(range(a, a + n))
                    names |= x
        out.append((len(w), len(hit), sorted(names)))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25), min_size=1, max_size=6), st.lists(st.lists(st.sampled_from("abcd"), max_size=12), max_size=5), st.integers(1, 5))
def test_match_shard(docs, items, window):
    for most in (1 << 20, 1, 6):
        match_shard_is_right(docs, items, window, most)


def match_shard_is_right(docs, items, window, most):
    texts, named = [" ".join(d) for d in docs], [(str(i), " ".join(x)) for i, x in enumerate(items)]
    it = suffixes.Items(named, window)
    seqs = [suffixes.words(t) for t in texts]
    ids = np.concatenate([[*[it.vocabulary.get(w, 0) for w in s], 0] for s in seqs]).astype(np.int32)
    doc_of = np.repeat(np.arange(len(seqs)), [len(s) + 1 for s in seqs])
    hit, runs = suffixes.match_shard(ids, doc_of, it, most=most)
    same, pairs = suffixes.match_shard(ids, doc_of, it, locate=False, most=most)
    assert (hit == same).all() and pairs[:, :2].tolist() == runs[:, :2].tolist()
    want = brute_hits(texts, named, window)
    assert [int(hit[doc_of == d].sum()) for d in range(len(seqs))] == [w[1] for w in want]
    assert [sorted(it.names[i] for d2, i, _, _ in runs.tolist() if d2 == d) for d in range(len(seqs))] == [w[2] for w in want]
    starts = np.cumsum([0, *[len(s) + 1 for s in seqs]])
    for d, i, pos, n in runs.tolist():  # the longest verbatim match of the pair, where it says it is
        a, b = docs[d], items[[k for k, x in enumerate(named) if x[0] == it.names[i]][0]]
        piece = a[pos - starts[d] : pos - starts[d] + n]
        assert any(b[k : k + n] == piece for k in range(len(b)))
        longest = max(n2 for x in range(len(a)) for y in range(len(b)) for n2 in range(min(len(a) - x, len(b) - y) + 1) if a[x : x + n2] == b[y : y + n2])
        assert n == longest


def test_repeated_words_take_memory_by_length():
    """An item and a document of one word each: all places of all windows would be 80 million rows."""
    it = suffixes.Items([(str(k), "a " * 2000) for k in range(3)] + [("x", "a " * 9 + "b")], 10)
    ids = np.array([*[it.vocabulary[b"a"]] * 40_000, 0], np.int32)
    tracemalloc.start()
    hit, runs = suffixes.match_shard(ids, np.zeros(len(ids), np.int64), it)
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()
    assert hit.sum() == 40_000 and runs.tolist() == [[0, k, 0, 2000] for k in range(3)]


def test_decontaminate(spark, edges, nothing):
    base = prose(5, 40)
    items = [(1, prose(50, 30)), (2, base), (3, "one"), (4, None), (5, ""), (6, base), (None, base), (7, "two WORDS")]
    df = spark.createDataFrame(items, "item_id long, text string")
    texts = [r.text for r in edges.collect()]
    extra = spark.createDataFrame(rows([base, base.upper(), "x " + base + " y", " ".join(base.split()[3:15]), " ".join(base.split()[3:12])], 900), SCHEMA)
    docs = edges.union(extra)
    texts = [r.text for r in docs.collect()]
    for block, shard in ((4 << 20, 1_000_000), (40, 50)):
        got = suffixes.decontaminate(docs, df, block_bytes=block, shard_words=shard).collect()
        want = brute_hits(texts, [x for x in items if x[0] is not None], 10)
        key = lambda x: repr(x)
        assert sorted(((r.n_words, r.n_hit, r["items"]) for r in got), key=key) == sorted(want, key=key)
    clean = suffixes.select_clean(docs, df)
    assert clean.columns == docs.columns
    assert Counter(r.text for r in clean.collect()) == Counter(t for t, w in zip(texts, want, strict=True) if not w[1])
    assert suffixes.decontaminate(nothing, df).count() == 0
    assert suffixes.decontaminate(docs, df.limit(0)).where("n_hit > 0 or size(items) > 0").count() == 0


# ---- Jaccard -------------------------------------------------------------------------------------------


def brute_components(pairs):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    sets = {}
    for i, t in pairs:
        w = word.findall((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))) if w else frozenset()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed):
    r = random.Random(seed)
    texts, common = [], prose(1000, 30)
    for g in range(4):
        base = prose(seed * 10 + g, r.choice([6, 30, 90])).split()
        for _ in range(r.choice([1, 3, 40])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = r.choice(["zeta", "eta", "iota"]) + str(r.randrange(30))
            texts.append(" ".join(w))
    texts += [prose(k + 77, 20) + " " + common for k in range(40)] + [common, common.upper(), common + " tail"]
    texts += [None, "", "a", "a", "A b", "a b c d e", "a b c d e f"]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed, crowd, least, rounds", [(1, 24, 32, 3), (2, 2, 4, 1), (3, 2, 2, 0), (4, 5, 1000, 2), (5, 3, 1, 3)])
def test_components_equal_brute_force(spark, seed, crowd, least, rounds):
    texts = near_copies(seed)
    df = spark.createDataFrame(rows(texts), SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_components(df, crowd=crowd, least=least, rounds=rounds, bits=18).collect()}
    assert got == brute_components(enumerate(texts))


def test_threshold_is_exact(spark):
    # five shingles of which both ends differ: 3 of 7, 6 of 8 (exactly 0.75), and just below
    w = [f"w{i}" for i in range(60)]
    texts = [" ".join(w[:11]), " ".join(w[1:12]), " ".join([*w[:10], "q"]), " ".join(w[:14]), " ".join(w[:10]), " ".join(w[20:28]), " ".join(w[20:27])]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_components(df, bits=16).collect()}
    assert got == brute_components(enumerate(texts))


def test_small_joins_spare_the_driver(spark, monkeypatch):
    """Few links take no rounds of queries, and what rounds leave on the driver is collected before the next."""
    texts = [prose(1, 60) + f" end{i}" for i in range(30)] + [prose(2, 80), prose(3, 50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tags, released, settle, release = [], [], jaccard.shared.settle, jaccard.shared.release
    monkeypatch.setattr(jaccard.shared, "settle", lambda f, tag, *a, **k: (tags.append(tag), settle(f, tag, *a, **k))[1])
    monkeypatch.setattr(jaccard.shared, "release", lambda s: (released.append(len(tags)), release(s))[1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_components(df, bits=16).collect()}
    assert got == brute_components(list(enumerate(texts)))
    assert "jaccard-up" not in tags and len(released) >= 3 and released[-1] == len(tags)


def test_jaccard_edges(spark, edges, nothing):
    assert jaccard.near_components(nothing, bits=16).count() == 0
    got = jaccard.near_components(edges, bits=16)
    assert got.count() == edges.count()
    known = edges.where("doc_id is not null").select("doc_id", "text").distinct().collect()
    want = brute_components([(r.doc_id, r.text) for r in known])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.where("doc_id is not null").collect()} == want
    kept = jaccard.one_of_each(edges, bits=16)
    assert kept.columns == edges.columns and jaccard.one_of_each(nothing, bits=16).count() == 0
    left = Counter((r.doc_id, r.text) for r in kept.collect())
    words = {(r.doc_id, r.text) for r in known if want[r.doc_id][0]}
    assert left == Counter([x for x in words if want[x[0]][1] == x[0]] + [(r.doc_id, r.text) for r in edges.collect() if not (r.text or "").split()])


def test_one_of_each_rows(spark):
    """Repeated rows, ids of several texts, rows without an id, and columns called as the operator's own."""
    a, b, c, d = (prose(k, 40) for k in range(4))
    made = [(1, a), (1, a), (2, a), (1, b), (None, b), (None, c), (None, c), (3, c + " end"), (None, d), (None, d), (None, d + " end"), (5, ""), (5, ""), (None, None)]
    df = spark.createDataFrame([(i, t, k, k, k, k) for k, (i, t) in enumerate(made)], "doc_id long, text string, _kept int, own_id int, OWN_MARK int, t int")
    kept = jaccard.one_of_each(df, bits=16)
    assert kept.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    (nameless,) = [x for x in got if x[0] is None and x[1] and x[1].startswith(d)]
    assert got == Counter([(1, a), (1, b), (3, c + " end"), nameless, (5, ""), (5, ""), (None, None)])
    found = {(r.doc_id, r.component_id) for r in jaccard.near_components(df.where("text is not null"), bits=16).collect()}
    assert found == {(1, 1), (2, 1), (None, 1), (None, 3), (3, 3), (None, None), (5, 5)}


@pytest.mark.parametrize("links", [False, True])
def test_crowd_at_the_threshold(spark, links):
    """Texts that share a passage and differ in the rest, the share being just under or at the threshold."""
    own = 20 if links else 40
    texts = [" ".join([prose(9, 204), *(f"w{k}x{j}" for j in range(own // 2))]) for k in range(150)]
    texts = [t if links else t + " " + " ".join(f"v{k}y{j}" for j in range(own // 2)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_components(df, bits=16).collect()}
    want = brute_components(enumerate(texts))
    assert got == want and len({c for _, c in want.values()}) == (1 if links else 150)


@pytest.mark.parametrize("lengths", [[150], [150, 149, 140]])
def test_crowd_around_a_text(spark, monkeypatch, lengths):
    """Of a large group of near copies, some just below the threshold to all others, few pairs are made where lengths are equal."""
    r = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(base)]
    for k in range(326):
        w = list(base) if k >= 26 else ["alt", *base[1:]]
        for j, at in enumerate(r.sample(range(9, 146, 5), r.choice([1, 2, 3]) if k >= 26 else 4)):
            w[at] = f"own{k}x{j}"
        texts.append(" ".join(w[: r.choice(lengths)]))
    made, across = [], jaccard._across

    def counted(*args):
        pairs = across(*args)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(jaccard, "_across", counted)
    df = spark.createDataFrame(rows(texts), SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_components(df, bits=16).collect()}
    assert got == brute_components(enumerate(texts))
    assert len(lengths) > 1 or sum(made) < 2 * len(texts)


# ---- quality ------------------------------------------------------------------------------------------


def test_ordinal_learns_grades():
    r = random.Random(1)
    marks = [["awful", "vile"], ["dull", "spam"], ["fine", "clear"]]
    texts, grades = [], []
    for k in range(600):
        g = r.randrange(3)
        texts.append(prose(k, 30) + " " + r.choice(marks[g]) + " " + prose(k + 5000, 30))
        grades.append(g)
    sets = [ordinal.features(t) for t in texts]
    m = ordinal.fit(sets[:400], np.array(grades[:400]), 3)
    assert (np.diff(m.thresholds) > 0).all()
    tails = m.tails(m.value(sets[400:]))
    assert (tails[:, 0] >= tails[:, 1]).all()
    assert np.mean((tails > 0.5).sum(1) == np.array(grades[400:])) > 0.9
    assert ordinal.fit(sets[:5], np.zeros(5, int), 3) is None


def test_ordinal_gradient_is_that_of_the_likelihood():
    sets, grades = [np.array([1, 2], np.int32), np.array([2], np.int32), np.array([3], np.int32), np.array([1, 3], np.int32)] * 5, np.array([0, 1, 2, 1] * 5)

    def loss(m):
        t = np.concatenate([np.ones((len(sets), 1)), m.tails(m.value(sets)), np.zeros((len(sets), 1))], axis=1)
        return -np.log(t[np.arange(len(sets)), grades] - t[np.arange(len(sets)), grades + 1]).sum() + 2.0 * (m.weights**2).sum()

    few, many = (ordinal.fit(sets, grades, 3, steps=n, least_rows=1) for n in (30, 3000))
    assert loss(many) <= loss(few) + 1e-9
    for k in (1, 2, 3):  # at the end no weight can be moved to lower the penalised loss
        for d in (-0.05, 0.05):
            w = many.weights.copy()
            w[k] += d
            assert loss(ordinal.Model(w, many.thresholds)) > loss(many) - 1e-6


def test_ordinal_held_out(spark):
    """Trained on one half and judged on the other. Two fifths of the toxic labels are on texts without any insult, so the
    toxic grade is judged on the texts that have one."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    ratings = labels.select("doc_id", ordinal.grade(labels.quality, labels.toxic).alias("grade"))
    model = ordinal.train(docs, ratings.where("doc_id % 2 = 0"))
    insult = docs.text.rlike("(?i)trash|pathetic|idiot|worthless|disgusting|stupid|clown|scum|loser|moron").alias("insult")
    judged = ordinal.score(docs, model).join(ratings, "doc_id").where("doc_id % 2 = 1").join(docs.select("doc_id", insult), "doc_id")
    n = Counter({(r.grade, r.insult, r.keep): r["count"] for r in judged.groupBy("grade", "insult", "keep").count().collect()})
    assert sum(n.values()) > 1500
    toxic = {keep: sum(n[0, insult, keep] for insult in (True, False)) for keep in (True, False)}
    assert 0.1 < toxic[True] / sum(toxic.values()) < 0.35  # of all toxic rows, those without an insult included
    share = lambda *k: n[(*k, True)] / (n[(*k, True)] + n[(*k, False)])
    assert share(2, False) > 0.97 and share(0, True) < 0.1 and share(1, False) < 0.1


def test_ordinal_edges(spark, edges, nothing):
    none = spark.createDataFrame([], "doc_id long, grade int")
    some = spark.createDataFrame([(i, i % 3) for i in range(30)] + [(None, 1), (2, None)], "doc_id long, grade int")
    for ratings in (none, some):
        m = ordinal.train(edges, ratings)
        assert ordinal.score(edges, m).count() == edges.count()
        assert ordinal.select(edges, m).columns == edges.columns
    assert ordinal.select(edges, None).count() == edges.count()
    assert ordinal.score(nothing, ordinal.train(nothing, some)).count() == 0
    assert ordinal.score(edges, None).where("keep and expected_grade is null").count() == edges.count()


# ---- languages -------------------------------------------------------------------------------------------


def test_kernel_matches_its_definition():
    texts = ["The river", "der Fluss", "le fleuve", "the rivers and fields", "die Flüsse und Felder", "les fleuves"]
    langs = ["en", "de", "fr", "en", "de", "fr"]

    def gram_set(t):
        b = t.lower().encode()
        return {b[i : i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}

    sets = [languages.grams(t) for t in texts]
    assert [len(s) for s in sets] == [len(gram_set(t)) for t in texts]
    assert [[len(np.intersect1d(a, b)) for b in sets] for a in sets] == [[len(gram_set(a) & gram_set(b)) for b in texts] for a in texts]
    # with every text a landmark the Nyström features are exact, so scoring must equal kernel ridge on the full kernel
    m = languages.fit(sets, langs, landmarks=6, ridge=1e-6)
    assert [m.languages[k] for k in m.scores(sets).argmax(axis=1)] == langs
    # on texts it has not seen, too: weighted ridge in the span of the features, written with kernels alone
    fresh = [languages.grams(t) for t in ("the field and the river", "der Fluss und das Feld", "le champ", "river")]
    kernel = lambda xs, ys: np.array([[len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b)) for b in ys] for a in xs])
    k, new = kernel(sets, sets), kernel(fresh, sets)
    y = np.array([[1.0 if a == b else -1.0 for b in m.languages] for a in langs])
    # both centred by the training texts; the languages have as many each, so means are plain
    k0, new0 = (x - k.mean(0) - x.mean(1, keepdims=True) + k.mean() for x in (k, new))
    lam = 1e-6 * np.trace(k0) / len(k)  # the mean eigenvalue of the features' covariance times n, over n features
    want = new0 @ np.linalg.solve(k0 + lam * np.eye(len(k)), y - y.mean(0)) + y.mean(0)
    assert np.allclose(m.scores(fresh), want, atol=1e-3)


def test_many_languages_fit_in_memory():
    """More languages than landmarks: each has one, and a batch takes memory by its n-grams, not times the languages."""
    r = random.Random(5)
    words = {k: ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(12)] for k in range(250)}
    texts = [(k, " ".join(r.choice(words[k]) for _ in range(40))) for k in words for _ in range(4)]
    sets = [languages.grams(t) for _, t in texts]
    m = languages.fit(sets, [f"l{k:03}" for k, _ in texts], landmarks=160)
    assert len(m.languages) == 250
    tracemalloc.start()
    got = m.scores(sets).argmax(axis=1)
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    assert np.mean([m.languages[a] == f"l{k:03}" for a, (k, _) in zip(got.tolist(), texts, strict=True)]) > 0.9


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = languages.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n = got.count()
    assert n > 2000 and got.where("lang_pred = lang").count() / n > 0.99
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_edges(spark, edges, nothing):
    got = languages.identify(edges)
    assert got.count() == edges.count() and nothing.count() == languages.identify(nothing).count() == 0
    und = {(r.lang_pred, r.score) for r in got.join(edges.where("text is null or not text rlike '\\\\p{L}'").select("doc_id"), "doc_id").collect()}
    assert und == {("und", 0.0)}
    assert {r.lang_pred for r in got.collect()} <= {"en", "fr", "und"}
    assert languages.identify(edges.withColumn("lang", edges.lang.substr(9, 1)).where("doc_id < 0")).count() == 0
    unlabelled = edges.drop("lang").selectExpr("*", "cast(null as string) lang")
    assert {r.lang_pred for r in languages.identify(unlabelled).collect()} == {"und"}
