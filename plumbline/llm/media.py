"""Media columns: baseline JPEG with DC-only luminance thumbnails, in numpy.

Decoder.  Markers are parsed, and an image's scan is cut at its restart markers.  The segments of
many images that share tables and sampling are lanes of one numpy computation: every step reads one
block in each lane (a 64-bit window, one table look-up for the Huffman code, the magnitude bits),
skips its AC symbols the same way, and keeps the DC value.  The DC values of the luminance blocks,
dequantised, are the thumbnail at an eighth of the size.

Payload.  Bytes are stored losslessly as the DC samples of flat 8x8 blocks: with a DC quantiser of 8
the coefficient is the sample less 128, exactly.  A row of 64 blocks is a restart segment.  A payload
above the height limit of one image continues in further images behind it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

UNIT = 192
ROW = 64
_ROWS = 8190 // 3 * 3  # block rows of one image: below 65536 / 8, whole payload units
_BATCH = 1 << 20

# ---------------------------------------------------------------- encoding


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(rows: int) -> bytes:
    """SOI to SOS of a grey image of ``rows`` x 64 blocks."""
    quant = bytes([0, 8, *[1] * 63])
    frame = struct.pack(">BHHBBBB", 8, rows * 8, ROW * 8, 1, 1, 0x11, 0)
    dc = bytes([0x00, 0, 0, 0, 9, *[0] * 12, *range(9)])  # nine categories of four bits each
    ac = bytes([0x10, 1, *[0] * 15, 0])  # end of block: one bit
    return b"\xff\xd8" + _segment(0xDB, quant) + _segment(0xC0, frame) + _segment(0xC4, dc) + _segment(0xC4, ac) + _segment(0xDD, struct.pack(">H", ROW)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """Code and length of a whole block by its DC difference plus 255."""
    d = np.arange(-255, 256)
    cat = np.array([int(abs(x)).bit_length() for x in d])
    bits = np.where(d >= 0, d, d + (1 << cat) - 1)
    return ((cat << cat) | bits) << 1, cat + 5


_CODE, _LENGTH = (x.astype(np.int32) for x in _symbols())


def _scan_bytes(samples: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded rows, each followed by its marker: EOI where ``ends``, else the image's next
    restart marker.  Returns all bytes and the offset behind each row."""
    n = len(samples)
    d = np.diff(samples.astype(np.int16) - 128, axis=1, prepend=np.int16(0)) + 255
    length, code = _LENGTH[d], _CODE[d]
    stop = np.cumsum(length, axis=1, dtype=np.int32)
    start = stop - length
    size = (stop[:, -1] + 7) >> 3
    out = np.zeros((n, int(size.max()) + 3), np.uint8)
    word = code << (24 - (start & 7) - length)
    at, rows = start >> 3, np.arange(n)
    for j in range(samples.shape[1]):
        w, i = word[:, j], at[:, j]
        out[rows, i] |= (w >> 16).astype(np.uint8)
        out[rows, i + 1] |= (w >> 8 & 255).astype(np.uint8)
        out[rows, i + 2] |= (w & 255).astype(np.uint8)
    out[rows, size - 1] |= ((1 << (size * 8 - stop[:, -1])) - 1).astype(np.uint8)
    flat = out[np.arange(out.shape[1]) < size[:, None]]
    row_of = np.repeat(rows, size)
    stuffed = flat == 255
    row_end = np.cumsum(size + np.bincount(row_of[stuffed], minlength=n) + 2)
    place = np.arange(len(flat)) + np.cumsum(stuffed) - stuffed + 2 * row_of
    done = np.zeros(int(row_end[-1]), np.uint8)
    done[place] = flat
    first = np.concatenate(([0], np.flatnonzero(ends)[:-1] + 1))
    turn = rows - first[np.cumsum(ends) - ends]
    done[row_end - 2] = 255
    done[row_end - 1] = np.where(ends, 0xD9, 0xD0 + turn % 8)
    return done, row_end


def pad(text: bytes | None) -> bytes:
    """The payload of a text: its bytes, and spaces up to a positive multiple of 192."""
    data = text or b""
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b" ")


def store(payloads: list[bytes]) -> list[bytes]:
    """The JPEG bytes of each payload."""
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW)
    images = [[min(_ROWS, n - at) for at in range(0, n, _ROWS)] for n in (len(p) // ROW for p in payloads)]
    heights = np.array([h for x in images for h in x])
    ends = np.zeros(len(samples), bool)
    ends[np.cumsum(heights) - 1] = True
    body, row_end = _scan_bytes(samples, ends)
    body = body.tobytes()
    cut = [0, *row_end[ends].tolist()]
    out, k = [], 0
    for x in images:
        parts = []
        for h in x:
            parts += [_head(h), body[cut[k] : cut[k + 1]]]
            k += 1
        out.append(b"".join(parts))
    return out


# ---------------------------------------------------------------- decoding


@dataclass
class Image:
    """What the markers of one baseline image say, and where its scan lies."""

    width: int
    height: int
    components: list[tuple[int, int, int, int]]  # id, horizontal and vertical sampling, quantiser
    scan: list[tuple[int, bytes, bytes]]  # component number, DC table, AC table
    quant: dict[int, int]  # DC quantisers
    interval: int
    start: int
    end: int = 0


class NotBaseline(ValueError):
    """The bytes are no baseline JPEG that can be read."""


def parse(data: bytes, at: int = 0) -> Image:
    """Markers from ``at`` (SOI) to the scan that holds the first component."""
    try:
        if data[at : at + 2] != b"\xff\xd8":
            raise NotBaseline("no SOI")
        at += 2
        quant: dict[int, int] = {}
        tables: dict[int, bytes] = {}
        frame, interval = None, 0
        while True:
            if data[at] != 0xFF:
                raise NotBaseline("marker expected")
            while data[at] == 0xFF:
                at += 1
            marker = data[at]
            at += 1
            if marker == 0xD9 or 0xD0 <= marker <= 0xD7:
                raise NotBaseline("no scan")
            size = struct.unpack_from(">H", data, at)[0]
            body = data[at + 2 : at + size]
            if len(body) < size - 2:
                raise NotBaseline("cut off")
            at += size
            if marker == 0xDB:
                i = 0
                while i < len(body):
                    wide = body[i] >> 4
                    quant[body[i] & 15] = struct.unpack_from(">H", body, i + 1)[0] if wide else body[i + 1]
                    i += 129 if wide else 65
            elif marker == 0xC4:
                i = 0
                while i < len(body):
                    n = 17 + sum(body[i + 1 : i + 17])
                    tables[body[i]] = body[i + 1 : i + n]
                    i += n
            elif marker == 0xC0 or marker == 0xC1:
                bits, height, width, n = struct.unpack_from(">BHHB", body)
                if bits != 8 or not height or not width or not n:
                    raise NotBaseline("unsupported frame")
                frame = (width, height, [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)])
                if any(not 1 <= h <= 4 or not 1 <= v <= 4 for _, h, v, _ in frame[2]):
                    raise NotBaseline("bad sampling")
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise NotBaseline("not baseline")
            elif marker == 0xDD:
                interval = struct.unpack_from(">H", body)[0]
            elif marker == 0xDA:
                if frame is None:
                    raise NotBaseline("scan without frame")
                ids = [c[0] for c in frame[2]]
                scan = [(ids.index(body[1 + 2 * k]), tables[body[2 + 2 * k] >> 4], tables[16 | body[2 + 2 * k] & 15]) for k in range(body[0])]
                if any(number == 0 for number, _, _ in scan):
                    return Image(frame[0], frame[1], frame[2], scan, quant, interval, at)
                at = _scan_end(data, at)
    except (IndexError, KeyError, struct.error, ValueError) as e:
        raise e if isinstance(e, NotBaseline) else NotBaseline(str(e)) from e


def _scan_end(data: bytes, at: int) -> int:
    """Where the first marker that is no restart marker stands."""
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return len(data)
        if data[at + 1] and not 0xD0 <= data[at + 1] <= 0xD7:
            return at
        at += 2


def _lookup(table: bytes) -> np.ndarray:
    """By the next 16 bits: code length * 256 + symbol; 0 where no code fits."""
    out, code, k = np.zeros(65536, np.int32), 0, 16
    for size in range(1, 17):
        for _ in range(table[size - 1]):
            lo = code << (16 - size)
            out[lo : lo + (1 << (16 - size))] = size << 8 | table[k]
            code += 1
            k += 1
        code <<= 1
    return out


def _lanes(data: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scan bytes without stuffing and markers; per segment its image and first byte."""
    parts, owners, starts, base = [], [], [], 0
    for number, (s, e) in enumerate(spans):
        d = data[s:e]
        ff = np.flatnonzero(d[:-1] == 255) if len(d) > 1 else np.empty(0, np.int64)
        follow = d[ff + 1]
        restart = ff[(follow >= 0xD0) & (follow <= 0xD7)]
        keep = np.ones(len(d), bool)
        keep[ff[follow == 0] + 1] = False
        keep[restart] = keep[restart + 1] = False
        clean = d[keep]
        before = np.cumsum(keep)
        cut = np.concatenate(([0], before[restart])) if len(restart) else np.zeros(1, np.int64)
        parts.append(clean)
        starts.append(cut + base)
        owners.append(np.full(len(cut), number))
        base += len(clean)
    return np.concatenate([*parts, np.zeros(16, np.uint8)]), np.concatenate(owners), np.concatenate(starts)


def _blocks(image: Image) -> tuple[list[int], int, int]:
    """Component of each block of an MCU, and MCUs across and down."""
    hmax, vmax = max(c[1] for c in image.components), max(c[2] for c in image.components)
    if len(image.scan) == 1:
        _, h, v, _ = image.components[image.scan[0][0]]
        return [0], -(-(-(-image.width * h // hmax)) // 8), -(-(-(-image.height * v // vmax)) // 8)
    pattern = [k for k, (number, _, _) in enumerate(image.scan) for _ in range(image.components[number][1] * image.components[number][2])]
    return pattern, -(-image.width // (8 * hmax)), -(-image.height // (8 * vmax))


def thumbnails(images: list[tuple[bytes, Image]]) -> list[np.ndarray | None]:
    """Luminance thumbnails (a sample a block) of parsed images; None where the scan is broken."""
    out: list[np.ndarray | None] = [None] * len(images)
    groups: dict[tuple, list[int]] = {}
    for i, (_, im) in enumerate(images):
        groups.setdefault((tuple((k, a, b) for k, a, b in im.scan), tuple(im.components)), []).append(i)
    for members in groups.values():
        _group(images, members, out)
    return out


def _group(images, members: list[int], out: list) -> None:
    first = images[members[0]][1]
    pattern = _blocks(first)[0]
    tables = [(_lookup(dc), _lookup(ac)) for _, dc, ac in first.scan]
    joined = np.frombuffer(b"".join([images[i][0][images[i][1].start : images[i][1].end] for i in members]), np.uint8)
    sizes = np.cumsum([0, *[images[i][1].end - images[i][1].start for i in members]])
    data, owner, start = _lanes(joined, list(zip(sizes[:-1].tolist(), sizes[1:].tolist(), strict=True)))
    mcus = np.array([a * b for _, a, b in (_blocks(images[i][1]) for i in members)])
    interval = np.array([images[i][1].interval for i in members])
    interval = np.where(interval > 0, interval, mcus)
    turn = np.arange(len(owner)) - np.searchsorted(owner, owner)
    todo = np.clip(mcus[owner] - turn * interval[owner], 0, interval[owner])
    words = np.ndarray((len(data) - 8,), ">u8", data.tobytes(), 0, (1,))
    limit = (len(data) - 16) * 8
    order = np.argsort(-todo, kind="stable")  # lanes that end first stand last
    todo, pos = todo[order], start[order].astype(np.int64) * 8
    bad = np.zeros(len(order), bool)
    luma = [k for k, c in enumerate(pattern) if first.scan[c][0] == 0]
    kept = np.zeros((len(order), int(todo.max(initial=0)), len(luma)), np.int32)
    pred = np.zeros((len(first.scan), len(order)), np.int64)

    def window(p: np.ndarray) -> np.ndarray:
        return words[np.minimum(p, limit) >> 3].astype(np.uint64) << (p & 7).astype(np.uint64)

    for mcu in range(kept.shape[1]):
        n = int(np.searchsorted(-todo, -mcu, "left"))  # lanes with more than ``mcu`` MCUs
        p = pos[:n]
        for b, c in enumerate(pattern):
            dc, ac = tables[c]
            w = window(p)
            got = dc[(w >> np.uint64(48)).astype(np.int64)]
            size, length = got & 255, got >> 8
            value = ((w << length.astype(np.uint64)) >> np.uint64(32)).astype(np.int64) >> (32 - np.minimum(size, 32))
            pred[c, :n] += np.where(value < (1 << size >> 1), value - (1 << size) + 1, value)
            bad[:n] |= got == 0
            p = p + length + size
            if b in luma:
                kept[:n, mcu, luma.index(b)] = pred[c, :n]
            got = ac[(window(p) >> np.uint64(48)).astype(np.int64)]
            p = p + (got >> 8) + (got & 15)
            rest = np.flatnonzero((got & 255) != 0)
            bad[:n] |= got == 0
            k = np.ones(len(rest), np.int64)
            more = got[rest]
            while len(rest):  # AC symbols: run, then size bits that are skipped
                k += np.where((more & 255) == 0xF0, 16, ((more & 255) >> 4) + 1)
                go = k < 64
                rest, k = rest[go], k[go]
                if not len(rest):
                    break
                more = ac[(window(p[rest]) >> np.uint64(48)).astype(np.int64)]
                p[rest] += (more >> 8) + (more & 15)
                bad[rest] |= more == 0
                go = ((more & 255) != 0) & (more != 0)
                rest, k, more = rest[go], k[go], more[go]
        pos[:n] = p
    bad |= pos > limit + 64
    back = np.argsort(order)
    kept, bad, todo = kept[back], bad[back], todo[back]
    lo = np.searchsorted(owner, np.arange(len(members)))
    hi = np.searchsorted(owner, np.arange(len(members)), "right")
    for j, i in enumerate(members):
        im = images[i][1]
        _, across, down = _blocks(im)
        if bad[lo[j] : hi[j]].any() or int(todo[lo[j] : hi[j]].sum()) != across * down:
            continue
        rows = kept[lo[j] : hi[j]]
        n = todo[lo[j] : hi[j]]
        flat = rows.reshape(-1, len(luma)) if (n == rows.shape[1]).all() else np.concatenate([r[:m] for r, m in zip(rows, n.tolist(), strict=True)])
        number = im.scan[0][0] if len(im.scan) == 1 else 0
        _, h, v, q = im.components[number]
        if len(im.scan) == 1:
            h = v = 1
        grid = flat.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        hmax, vmax = max(c[1] for c in im.components), max(c[2] for c in im.components)
        _, h0, v0, _ = im.components[0]
        grid = grid[: -(-(-(-im.height * v0 // vmax)) // 8), : -(-(-(-im.width * h0 // hmax)) // 8)]
        # A block's mean is DC * quantiser / 8, above the middle grey.
        out[i] = np.clip((grid.astype(np.int64) * im.quant.get(q, 1) + 4 >> 3) + 128, 0, 255).astype(np.uint8)


def load(stored: list[bytes]) -> list[list[tuple[Image, np.ndarray]] | None]:
    """The images (and their thumbnails) in each stored value; None where it cannot be read."""
    flat, owner, out = [], [], [[] for _ in stored]
    for i, data in enumerate(stored):
        at = 0
        try:
            while at < len(data):
                im = parse(data, at)
                im.end = _end_of(data, im)
                flat.append((data, im))
                owner.append(i)
                at = im.end
                at = at + 2 if data[at : at + 2] == b"\xff\xd9" else len(data)
        except NotBaseline:
            out[i] = None
    for i, (_, im), t in zip(owner, flat, thumbnails(flat), strict=True):
        if t is None:
            out[i] = None
        elif out[i] is not None:
            out[i].append((im, t))
    return [x or None for x in out]


def _end_of(data: bytes, im: Image) -> int:
    """EOI of a scan with many restart markers is searched for as two bytes first."""
    at = data.find(b"\xff\xd9", im.start)
    return at if at >= 0 else _scan_end(data, im.start)


def thumbnail_hash(grid: np.ndarray) -> str:
    """Average hash: 8 x 8 means of the thumbnail against their mean, as 16 hex digits."""
    h, w = grid.shape
    r, c = (np.unique(np.arange(8) * n // 8) for n in (h, w))
    sums = np.add.reduceat(np.add.reduceat(grid.astype(np.int64), r, 0), c, 1)
    area = np.outer(np.diff([*r.tolist(), h]), np.diff([*c.tolist(), w]))
    small = (sums / area)[np.arange(8) * len(r) // 8][:, np.arange(8) * len(c) // 8]
    return np.packbits(small > small.mean()).tobytes().hex()


def whole(images: list[tuple[Image, np.ndarray]]) -> tuple[int, int, np.ndarray]:
    """Width, height and luminance thumbnail of all images of a value, one below the other; narrower
    ones are filled up with middle grey."""
    wide = max(g.shape[1] for _, g in images)
    grids = [g if g.shape[1] == wide else np.pad(g, ((0, 0), (0, wide - g.shape[1])), constant_values=128) for _, g in images]
    return max(im.width for im, _ in images), sum(im.height for im, _ in images), np.concatenate(grids) if len(grids) > 1 else grids[0]


def media_columns(files: DataFrame) -> DataFrame:
    """(doc_id, width, height, thumb_width, thumb_height, thumb_hash, thumb_sha256) of (doc_id, media).

    All images of each value, one below the other; null or unreadable media give nulls."""

    common.prepare(files.sparkSession)

    def row(images):
        if not images:
            return (None,) * 6
        width, height, grid = whole(images)
        return (width, height, grid.shape[1], grid.shape[0], thumbnail_hash(grid), hashlib.sha256(grid.tobytes()).hexdigest())

    def run(batches):
        for b in batches:
            got = load([x or b"" for x in common.as_bytes(b.column(1))])
            rows = [row(g) for g in got]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=["doc_id", "width", "height", "thumb_width", "thumb_height", "thumb_hash", "thumb_sha256"])

    kind = files.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", kind), *[T.StructField(c, T.LongType()) for c in ("width", "height", "thumb_width", "thumb_height")], T.StructField("thumb_hash", T.StringType()), T.StructField("thumb_sha256", T.StringType())]
    return files.select("doc_id", F.col("media").cast("binary")).mapInArrow(run, T.StructType(fields))


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each whole text's payload as JPEG bytes; null texts are stored as empty ones."""
    common.prepare(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = common.as_bytes(b.column(1))
            for s, e in common.byte_groups(texts, _BATCH):
                yield pa.RecordBatch.from_arrays([b.column(0)[s:e], pa.array(store([pad(t) for t in texts[s:e]]), pa.binary())], names=["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("media", T.BinaryType())]))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of op 10: payloads are stored, and everything but ``n_bytes`` is
    computed from the stored bytes as they are read back; the feature is that of all images of a value."""

    common.prepare(docs.sparkSession)

    def rows_of(texts):
        stored = store([pad(t) for t in texts])
        for t, media, got in zip(texts, stored, load(stored), strict=True):
            back = b"".join([grid.tobytes() for _, grid in got])
            width, height, grid = whole(got)
            yield (len(t or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"{width}x{height}:{len(got)}:{thumbnail_hash(grid)}")

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b in batches:
            texts = common.as_bytes(b.column(1))
            for s, e in common.byte_groups(texts, _BATCH):
                rows = list(rows_of(texts[s:e]))
                yield pa.RecordBatch.from_arrays([b.column(0)[s:e], *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=["doc_id", *names])

    spark_kinds = [T.LongType(), T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.StringType()]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(n, k) for n, k in zip(names, spark_kinds, strict=True)]])
    return docs.select("doc_id", "text").mapInArrow(run, schema)
