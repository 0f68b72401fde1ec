"""TIFF media columns: files written from bytes, image directories walked, strips and tiles decoded, a row for each page.

Reads classic and big files of either byte order; compressions 1 (none), 5 (LZW), 8 and 32946 (deflate) and 32773
(PackBits); strips and tiles; chunky and planar samples of 8, 16, 32 or 64 bits; predictors 1 (none), 2 (horizontal
differences) and 3 (floating point).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

# Fixed values of the format: tag numbers, sizes of field types, compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_AT, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES = 317, 322, 323, 324, 325
TYPE_CODES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
# The most bytes that a byte of a compressed chunk can stand for; an LZW code of 9 bits or more is at most 4096 bytes.
MOST_RATIO = {NONE: 1, LZW: 4096, DEFLATE: 1032, OLD_DEFLATE: 1032, PACKBITS: 128}
READ = {WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_AT, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES}


class TiffError(ValueError):
    """The bytes are no TIFF file of a kind that this module reads."""


@dataclass
class Page:
    index: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    pixels: bytes  # rows from the top, samples of a pixel together, in the byte order of the file


def unpack_bits(data: bytes, most: int = 1 << 62) -> bytes:
    """``most``: decoding ends once there are more bytes than that."""
    out, i, n, made = [], 0, len(data), 0
    while i < n and made <= most:
        k = data[i]
        if k < 128:
            out.append(data[i + 1 : i + 2 + k])
            made += len(out[-1])
            i += k + 2
        elif k > 128:
            out.append(data[i + 1 : i + 2] * (257 - k))
            made += len(out[-1])
            i += 2
        else:
            i += 1
    return b"".join(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i >= 3:
            out += bytes((257 - (j - i), data[i]))
            i = j
            continue
        j = i
        while j < n and j - i < 128 and not (j + 2 < n and data[j] == data[j + 1] == data[j + 2]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes, most: int = 1 << 62) -> bytes:
    """Codes of 9 to 12 bits, high bit first, growing one code early; 256 clears, 257 ends. ``most`` as above."""
    made = 0
    fresh = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, out, size, held, bits, last = list(fresh), [], 9, 0, 0, None
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < size:
            continue
        bits -= size
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 256:
            table, size, last = list(fresh), 9, None
            continue
        if code == 257:
            break
        if last is None:
            word = table[code]
        else:
            if code > len(table) or code >= 4096:
                raise TiffError("an LZW code is out of range")
            word = table[code] if code < len(table) else last + last[:1]
            if len(table) < 4096:
                table.append(last + word[:1])
            if len(table) + 1 >= 1 << size and size < 12:
                size += 1
        out.append(word)
        made += len(word)
        if made > most:
            break
        last = word
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, held, bits, size = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = (held << size) | code, bits + size
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    def clear() -> None:
        nonlocal size
        put(256)
        table.clear()
        table.update({bytes((i,)): i for i in range(256)})
        size = 9

    clear()
    word, following = b"", 258
    for i in range(len(data)):
        c = data[i : i + 1]
        if word + c in table:
            word += c
            continue
        put(table[word])
        table[word + c] = following
        following += 1
        word = c
        if following + 1 > 1 << size and size < 12:
            size += 1
        if following >= 4094:
            put(table[word])
            clear()
            word, following = b"", 258
    if word:
        put(table[word])
        following += 1
        if following + 1 > 1 << size and size < 12:
            size += 1
    put(257)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def _unpacked(data: bytes, compression: int, most: int) -> bytes:
    """The bytes of a chunk, no more than a little beyond ``most`` being made."""
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        stream = zlib.decompressobj()
        out = stream.decompress(data, most + 1)
        if len(out) <= most and not stream.eof:
            raise TiffError("a deflate stream is cut off")
        return out
    if compression == PACKBITS:
        return unpack_bits(data, most)
    if compression == LZW:
        return lzw_decode(data, most)
    raise TiffError(f"compression {compression} is not read")


def _undone(data: bytes, rows: int, width: int, samples: int, bits: int, predictor: int, order: str) -> bytes:
    """The chunk, of this many rows, without its predictor."""
    size = len(data)
    if predictor == 1 or not size:
        return data
    if predictor == 2 and bits in (8, 16, 32, 64):
        a = np.frombuffer(data, f"{order}u{bits // 8}").reshape(rows, width, samples)
        return np.cumsum(a, axis=1, dtype=a.dtype.newbyteorder("=")).astype(a.dtype).tobytes()
    if predictor == 3 and bits in (16, 32, 64):
        a = np.frombuffer(data, np.uint8).reshape(rows, -1)
        # differences run over bytes, a sample apart; then each row holds all high bytes first
        a = np.cumsum(a.reshape(rows, -1, samples), axis=1, dtype=np.uint8).reshape(rows, bits // 8, width * samples)
        a = a.transpose(0, 2, 1)
        return (a if order == ">" else a[:, :, ::-1]).tobytes()
    raise TiffError(f"predictor {predictor} with {bits} bits is not read")


def _directory(blob: bytes, at: int, order: str, big: bool) -> tuple[dict[int, tuple], int]:
    head, entry, following, room = ("Q", 20, "Q", 8) if big else ("H", 12, "I", 4)
    n = struct.unpack_from(order + head, blob, at)[0]
    at += struct.calcsize(order + head)
    tags = {}
    for i in range(n):
        p = at + entry * i
        tag, kind = struct.unpack_from(order + "HH", blob, p)
        count = struct.unpack_from(order + following, blob, p + 4)[0]
        if kind in TYPE_CODES and tag in READ and tag not in tags:
            fmt = f"{order}{count}{TYPE_CODES[kind]}"
            spot = p + 4 + room
            if struct.calcsize(fmt) > room:
                spot = struct.unpack_from(order + following, blob, spot)[0]
            tags[tag] = struct.unpack_from(fmt, blob, spot)
    return tags, struct.unpack_from(order + following, blob, at + entry * n)[0]


def _page(blob: bytes, tags: dict[int, tuple], index: int, order: str) -> Page:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    if WIDTH not in tags or HEIGHT not in tags:
        raise TiffError("a directory has no size")
    width, height, samples = tags[WIDTH][0], tags[HEIGHT][0], one(SAMPLES, 1)
    each = tags.get(BITS, (1,))
    bits, compression, predictor, planar = each[0], one(COMPRESSION, NONE), one(PREDICTOR, 1), one(PLANAR, 1)
    if len(set(each)) > 1:
        raise TiffError("samples of unequal depth are not read")
    if compression not in MOST_RATIO:
        raise TiffError(f"compression {compression} is not read")
    if min(width, height) < 0 or samples < 1 or bits not in (1, 2, 4, 8, 16, 32, 64):
        raise TiffError("sizes or depths are out of range")
    planes, within = (samples, 1) if planar == 2 else (1, samples)
    tiled = TILE_AT in tags
    if tiled:
        w, h, spots, sizes = tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0], tags[TILE_AT], tags[TILE_BYTES]
        if w < 1 or h < 1:
            raise TiffError("tiles have no size")
    else:
        w, h, spots, sizes = width, min(one(ROWS_PER_STRIP, height), height) or 1, tags.get(STRIP_AT, ()), tags.get(STRIP_BYTES, ())
    if bits % 8 and (tiled or planes > 1):
        raise TiffError("tiles and planes of partial bytes are not read")
    across, down = -(-width // w) if w else 0, -(-height // h)
    need = planes * across * down
    if min(len(spots), len(sizes)) < need:
        raise TiffError("strips or tiles are missing")
    if any(a < 0 or b < 0 or a + b > len(blob) for a, b in zip(spots[:need], sizes[:need], strict=True)):
        raise TiffError("a strip or tile is outside the file")
    within_line = (w * within * bits + 7) // 8
    # before anything is allocated: no more than these chunks can decode to
    if planes * height * ((width * within * bits + 7) // 8) > MOST_RATIO[compression] * sum(sizes[:need]) or (need and h * within_line > MOST_RATIO[compression] * len(blob)):
        raise TiffError("the image is larger than its data can be")
    line = (width * within * bits + 7) // 8
    cell = within * bits // 8
    sheets = []
    for plane in range(planes):
        sheet = np.zeros((height, line), np.uint8)
        for y in range(down):
            for x in range(across):
                i = (plane * down + y) * across + x
                rows = h if tiled else min(h, height - y * h)
                size, full = rows * within_line, h * within_line  # the last strip may be written as a full one
                data = _unpacked(blob[spots[i] : spots[i] + sizes[i]], compression, full)
                if len(data) != size and len(data) != full:
                    raise TiffError("a strip or tile has not the bytes of its rows")
                data = _undone(data[:size], rows, w, within, bits, predictor, order)
                a = np.frombuffer(data, np.uint8).reshape(rows, -1)
                keep = min(rows, height - y * h)
                left = x * w * cell
                sheet[y * h : y * h + keep, left : left + a.shape[1]] = a[:keep, : line - left]
        sheets.append(sheet)
    if planes == 1:
        pixels = sheets[0].tobytes()
    else:
        pixels = np.stack([s.reshape(height, width, bits // 8) for s in sheets], axis=2).tobytes()
    return Page(index, width, height, samples, bits, compression, predictor, tiled, pixels)


def pages(blob: bytes) -> Iterator[Page]:
    """The pages of a file in the order of its directories; TiffError if the file is damaged."""
    try:
        order = {b"II": "<", b"MM": ">"}[blob[:2]]
        kind = struct.unpack_from(order + "H", blob, 2)[0]
        if kind not in (42, 43):
            raise TiffError("not a TIFF file")
        at = struct.unpack_from(order + ("Q" if kind == 43 else "I"), blob, 8 if kind == 43 else 4)[0]
        seen: set[int] = set()
        while at:
            if at in seen:
                raise TiffError("directories form a loop")
            seen.add(at)
            tags, following = _directory(blob, at, order, kind == 43)
            yield _page(blob, tags, len(seen) - 1, order)
            at = following
    except TiffError:
        raise
    except (KeyError, IndexError, ValueError, struct.error, zlib.error, OverflowError) as e:
        raise TiffError(str(e) or type(e).__name__) from e


def encode(payload: bytes, width: int = 64, page_rows: int = 4096, strip_rows: int = 512, compression: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None) -> bytes:
    """A file of 8-bit grey pages that holds ``payload``, whose length is a multiple of ``width``, row by row; in strips, or in
    tiles of ``tile`` (width, height: multiples of 16)."""
    if len(payload) % width:
        raise ValueError("the payload does not fill its rows")
    pack = {NONE: bytes, DEFLATE: zlib.compress, PACKBITS: pack_bits, LZW: lzw_encode}[compression]
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for top in range(0, max(len(payload), 1), width * page_rows):
        sheet = np.frombuffer(payload[top : top + width * page_rows], np.uint8).reshape(-1, width)
        if tile:
            grid = np.zeros((-(-len(sheet) // tile[1]) * tile[1], -(-width // tile[0]) * tile[0]), np.uint8)
            grid[: len(sheet), :width] = sheet
            parts = [grid[y : y + tile[1], x : x + tile[0]] for y in range(0, len(grid), tile[1]) for x in range(0, grid.shape[1], tile[0])]
        else:
            parts = [sheet[i : i + strip_rows] for i in range(0, len(sheet), strip_rows)]
        if predictor == 2:
            parts = [np.concatenate([p[:, :1], p[:, 1:] - p[:, :-1]], axis=1) for p in parts]
        strips = [pack(p.tobytes()) for p in parts]
        spots = []
        for s in strips:
            spots.append(len(out))
            out += s
        n = len(strips)
        if len(out) % 2:
            out.append(0)
        lists = len(out)
        if n > 1:
            out += struct.pack(f"<{2 * n}I", *spots, *map(len, strips))
        struct.pack_into("<I", out, link, len(out))
        at, sizes = lists if n > 1 else (spots or [0])[0], lists + 4 * n if n > 1 else len((strips or [b""])[0])
        chunks = [(TILE_WIDTH, 4, 1, tile[0]), (TILE_HEIGHT, 4, 1, tile[1]), (TILE_AT, 4, n, at), (TILE_BYTES, 4, n, sizes)] if tile else [(STRIP_AT, 4, n, at), (ROWS_PER_STRIP, 4, 1, strip_rows), (STRIP_BYTES, 4, n, sizes)]
        tags = sorted([(WIDTH, 4, 1, width), (HEIGHT, 4, 1, len(sheet)), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, compression), (PHOTOMETRIC, 3, 1, 1), (SAMPLES, 3, 1, 1), (PREDICTOR, 3, 1, predictor), *chunks])
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        link = len(out)
        out += bytes(4)
    return bytes(out)


def text_payload(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, the text as UTF-8 with zeros up to a positive multiple of 64)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def varied(payload: bytes) -> dict:
    """A layout chosen by the payload's checksum alone: of 16 files 11 are deflated, two each packed and LZW, one bare; half have
    differences, half tiles."""
    k = zlib.crc32(payload)
    compression = [DEFLATE] * 11 + [PACKBITS] * 2 + [LZW] * 2 + [NONE]
    return {"compression": compression[k % 16], "predictor": 1 + (k >> 4) % 2, "tile": (32, 64) if (k >> 5) % 2 else None, "page_rows": 1024, "strip_rows": 256}


def feature(found: list[Page]) -> str:
    """Pages, size, sum of samples and a histogram of their high halves."""
    a = np.frombuffer(b"".join(p.pixels for p in found), np.uint8)
    bins = np.bincount(a >> 4, minlength=16)
    return f"pages={len(found)};size={found[0].width}x{sum(p.height for p in found)};sum={int(a.sum(dtype=np.int64))};hist={','.join(map(str, bins.tolist()))}" if found else "pages=0"


def _batches(rows, types, names, weigh, most: int = 1 << 23):
    import pyarrow as pa

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weigh(row)
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def write_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as a file, laid out as ``how`` says for ``encode`` or else as ``varied`` does. Null
    and empty texts give one row of zeros; equal texts equal files."""
    shared.bounded_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        def rows():
            for b in batches:
                for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    n, payload = text_payload(text.as_py())
                    yield doc, n, encode(payload, **(how or varied(payload)))

        yield from _batches(rows(), (pa.int64(), pa.int64(), pa.binary()), ["doc_id", "n_bytes", "media"], lambda r: len(r[2]))

    return docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_pages(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each page: doc_id, page, width, height, samples, bits, compression, predictor, tiled, pixels, error.

    A null file gives no row. Where a file is damaged, the pages before the damage are followed by a row that has
    ``error`` and nulls; a file that is no TIFF has that row alone."""

    def run(batches):
        import pyarrow as pa

        def rows():
            for b in batches:
                for doc, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    blob, k = blob.as_py(), 0
                    if blob is None:
                        continue
                    try:
                        for p in pages(blob):
                            k = p.index + 1
                            yield doc, p.index, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.pixels, None
                    except TiffError as e:
                        yield doc, k, None, None, None, None, None, None, None, None, str(e)

        types = (pa.int64(), *[pa.int32()] * 7, pa.bool_(), pa.binary(), pa.string())
        names = ["doc_id", "page", "width", "height", "samples", "bits", "compression", "predictor", "tiled", "pixels", "error"]
        yield from _batches(rows(), types, names, lambda r: len(r[9] or b"") + 100)

    schema = "doc_id long, page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, error string"
    return media.select(F.col(id_col).cast("long").alias("d"), F.col(media_col).alias("m")).mapInArrow(run, schema)


def read_files(media: DataFrame) -> DataFrame:
    """A row for each stored file with digests of what its pages hold; columns doc_id, n_bytes, media as ``write_texts`` gives.

    ``error`` says what is wrong with a damaged or missing (null) file; its digests are null then."""
    shared.bounded_batches(media.sparkSession)

    def run(batches):
        import pyarrow as pa

        def rows():
            for b in batches:
                for doc, n, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    blob = blob.as_py()
                    try:
                        found = list(pages(blob if blob is not None else b""))
                    except TiffError as e:
                        yield doc, n, None, None, None, None, None, None, str(e) if blob is not None else "no file"
                        continue
                    payload = b"".join(p.pixels for p in found)
                    yield doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), feature(found), None

        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        yield from _batches(rows(), types, DIGEST, lambda r: 300)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


DIGEST = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
