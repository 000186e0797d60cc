"""Baseline JPEG in numpy: markers, Huffman-coded scans, DC-only luminance thumbnails, and a lossless payload form.

Decoding runs all restart intervals of a batch of images side by side: every numpy step reads one Huffman symbol of
every interval. Payloads are kept in quantised coefficients, the format's unit: bytes in the order of FREQUENT are the
coefficients 1, -1, 2, -2 and so on, so that frequent letters have small magnitudes and short Huffman codes, and a
text's JPEG is shorter than the text. No coefficient is zero, so a block has 64 symbols.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_CHARS, arrow_map, materialize, scratch_dir, slices

BLOCK = 64
ZIGZAG = np.array([i * 8 + j for i, j in sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])


@dataclass
class Image:
    """What the markers say; scan is the entropy-coded part without stuffed bytes, with the start of every interval."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantisation table
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)  # class << 4 | id -> counts and symbols
    order: list[tuple[int, int, int]] = field(default_factory=list)  # component, DC table, AC table
    interval: int = 0
    comment: bytes = b""
    scan: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    def layout(self) -> tuple[list[int], int]:
        """Component of each block of an MCU, number of MCUs."""
        if len(self.order) == 1:
            c = self.order[0][0]
            _, h, v, _ = self.components[c]
            hm, vm = max(x[1] for x in self.components), max(x[2] for x in self.components)
            return [c], -(-(-(-self.width * h // hm)) // 8) * -(-(-(-self.height * v // vm)) // 8)
        hm, vm = max(x[1] for x in self.components), max(x[2] for x in self.components)
        blocks = [c for c, _, _ in self.order for _ in range(self.components[c][1] * self.components[c][2])]
        return blocks, -(-self.width // (8 * hm)) * -(-self.height // (8 * vm))


def parse(data: bytes) -> Image:
    """Markers of a baseline JPEG with one scan; ValueError for anything else."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no SOI")
    img, at = Image(), 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("marker expected")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            raise ValueError("no scan")
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, n = body[0] >> 4, body[0] & 15
                img.quant[n] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC0:
            if body[0] != 8:
                raise ValueError("8-bit samples only")
            img.height, img.width = struct.unpack_from(">HH", body, 1)
            img.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                img.tables[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif 0xC1 <= marker <= 0xCF:
            raise ValueError("baseline only")
        elif marker == 0xDD:
            img.interval = struct.unpack(">H", body[:2])[0]
        elif marker == 0xFE:
            img.comment = body
        elif marker == 0xDA:
            ids = [c[0] for c in img.components]
            img.order = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            break
    raw = np.frombuffer(data, np.uint8)[at:]
    ff = np.nonzero(raw[:-1] == 0xFF)[0]
    after = raw[ff + 1]
    marks = ff[(after != 0) & ((after & 0xF8) != 0xD0) & (after != 0xFF)]
    end = int(marks[0]) if len(marks) else len(raw)
    ff, after = ff[ff < end], after[ff < end]
    stuffed, restarts = ff[after == 0] + 1, ff[(after & 0xF8) == 0xD0]
    keep = np.ones(end, bool)
    keep[stuffed[stuffed < end]] = False
    keep[restarts] = keep[restarts + 1] = False
    img.scan = raw[:end][keep]
    removed = np.cumsum(~keep)
    img.starts = np.concatenate([[0], restarts + 2 - removed[restarts + 1]]).astype(np.int64)
    return img


def lookup(table: bytes) -> np.ndarray:
    """16-bit prefix -> code length << 8 | symbol; 0 where no code fits."""
    out = np.zeros(1 << 16, np.int32)
    code, k = 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            first = code << (16 - length)
            out[first : first + (1 << (16 - length))] = length << 8 | table[k]
            code += 1
            k += 1
        code <<= 1
    return out


def decode_scans(images: list[Image]) -> list[np.ndarray]:
    """Quantised coefficients of each image, blocks x 64 in zigzag order, blocks in scan order.

    The images must have the same tables and component order; all their restart intervals advance together.
    """
    first = images[0]
    layout, _ = first.layout()
    luts = np.concatenate([lookup(first.tables[kind << 4 | t[1 + kind]]) for t in first.order for kind in (0, 1)])
    slot = {c: i for i, (c, _, _) in enumerate(first.order)}
    of_block = np.array([slot[c] for c in layout], np.int64)
    data, starts, counts, firsts, total, base = [], [], [], [], 0, 0
    bounds = [0]
    for img in images:
        mcus = img.layout()[1]
        per = img.interval or mcus
        lanes = max(1, -(-mcus // per))
        if len(img.starts) < lanes:
            raise ValueError("intervals are missing")
        n = np.full(lanes, per, np.int64)
        n[-1] = mcus - per * (lanes - 1)
        n *= len(layout)
        starts.append(img.starts[:lanes] + base)
        counts.append(n)
        firsts.append(total + np.concatenate([[0], np.cumsum(n)[:-1]]))
        data += [img.scan, np.zeros(8, np.uint8)]
        base += len(img.scan) + 8
        total += int(n.sum())
        bounds.append(total)
    b = np.concatenate([*data, np.zeros(8, np.uint8)]).astype(np.int64)
    window = b[:-4] << 32 | b[1:-3] << 24 | b[2:-2] << 16 | b[3:-1] << 8 | b[4:]
    bit, block, left = np.concatenate(starts) * 8, np.concatenate(firsts), np.concatenate(counts)
    lanes = len(bit)
    k = np.zeros(lanes, np.int64)
    at = np.zeros(lanes, np.int64)  # block within the MCU
    pred = np.zeros((lanes, len(first.order)), np.int64)
    lane = np.arange(lanes)
    out = np.zeros(total * 64, np.int16)
    limit = (len(window) - 1) * 8
    single = len(layout) == 1
    busy = left > 0
    if not busy.all():
        bit, block, left, k, at, lane = (x[busy] for x in (bit, block, left, k, at, lane))
    while len(bit):
        if int(bit.max()) > limit:
            raise ValueError("scan ends early")
        w = window[bit >> 3]
        sh = bit & 7
        which = (k > 0).astype(np.int64) if single else of_block[at] * 2 + (k > 0)
        entry = luts[(which << 16) + ((w >> (24 - sh)) & 0xFFFF)]
        if not entry.all():
            raise ValueError("no such code")
        length, size, run = entry >> 8, (entry & 15).astype(np.int64), (entry >> 4 & 15).astype(np.int64)
        bit = bit + length + size
        v = (w >> (40 - sh - length - size)) & ((1 << size) - 1)
        v = np.where(v < (1 << size >> 1), v - (1 << size) + 1, v)
        dc = k == 0
        if dc.all():
            c = 0 if single else of_block[at]
            pred[lane, c] += v
            out[block * 64] = pred[lane, c]
            k = np.ones_like(k)
            continue
        if dc.any():
            own = lane[dc]
            c = np.zeros(len(own), np.int64) if single else of_block[at[dc]]
            pred[own, c] += v[dc]
            out[block[dc] * 64] = pred[own, c]
        ac = ~dc
        to = k + run
        put = ac & (size > 0) & (to < 64)
        out[block[put] * 64 + to[put]] = v[put]
        # end of block: symbol 0; sixteen zeros: symbol 0xF0
        k = np.where(dc, 1, np.where((size == 0) & (run < 15), 64, to + 1))
        full = k >= 64
        if full.any():
            block = block + full
            left = left - full
            k = np.where(full, 0, k)
            if not single:
                at = np.where(full, (at + 1) % len(layout), at)
            if int(left.min()) == 0:
                busy = left > 0
                bit, block, left, k, at, lane = (x[busy] for x in (bit, block, left, k, at, lane))
    out = out.reshape(total, 64)
    return [out[a:z] for a, z in zip(bounds, bounds[1:])]


def thumbnail(img: Image, coefficients: np.ndarray) -> np.ndarray:
    """One luminance sample a block, from the DC coefficients of the first component alone."""
    layout, mcus = img.layout()
    c = img.order[0][0]
    _, h, v, q = img.components[c]
    dc = coefficients[:, 0].astype(np.int64) * int(img.quant[q][0])
    level = np.clip((dc + 4) // 8 + 128, 0, 255).astype(np.uint8)
    hm, vm = max(x[1] for x in img.components), max(x[2] for x in img.components)
    wide, high = -(-(-(-img.width * h // hm)) // 8), -(-(-(-img.height * v // vm)) // 8)
    if len(layout) == 1:
        return level.reshape(high, wide)
    across = -(-img.width // (8 * hm))
    own = [i for i, x in enumerate(layout) if x == c]
    grid = level.reshape(mcus // across, across, len(layout))[:, :, own].reshape(mcus // across, across, v, h)
    return grid.transpose(0, 2, 1, 3).reshape(mcus // across * v, across * h)[:high, :wide]


def thumbnail_hash(thumb: np.ndarray) -> str:
    """16 hex digits: which of 8 x 8 evenly spaced samples exceed their mean; then 16 of the thumbnail's SHA-256."""
    rows, cols = (np.arange(8) * thumb.shape[0] // 8), (np.arange(8) * thumb.shape[1] // 8)
    small = thumb[np.ix_(rows, cols)].astype(np.int64)
    bits = np.packbits((small * 64 > small.sum()).ravel()).tobytes()
    return f"{bits.hex()}:{hashlib.sha256(thumb.tobytes()).hexdigest()[:16]}"


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


#: Bytes from the most to the least frequent in written text, by rule of thumb; the others follow in order.
FREQUENT = b" eaintosrludchmpgfbv.,ywk\nqzx\0j"
_BYTES = np.array([*FREQUENT, *(b for b in range(256) if b not in FREQUENT)], np.uint8)
#: Code length of each magnitude category from 1 to 8 (no code is all ones), in the order of a Huffman table.
_LENGTHS = {3: 2, 2: 2, 1: 2, 4: 3, 5: 4, 6: 5, 7: 6, 8: 7}


def _code_table() -> tuple[bytes, np.ndarray, np.ndarray]:
    """(table as in a file, bits of each byte's symbol, their number)."""
    counts = bytes(list(_LENGTHS.values()).count(n) for n in range(1, 17))
    bits, size = np.zeros(256, np.int64), np.zeros(256, np.int64)
    code, last = 0, 2
    codes = {}
    for category, n in _LENGTHS.items():
        code <<= n - last
        codes[category] = code
        code, last = code + 1, n
    for rank, byte in enumerate(_BYTES.tolist()):
        magnitude = rank // 2 + 1
        category = magnitude.bit_length()
        extra = magnitude if rank % 2 == 0 else (1 << category) - 1 - magnitude
        bits[byte] = codes[category] << category | extra
        size[byte] = _LENGTHS[category] + category
    return counts + bytes(_LENGTHS), bits, size


_TABLE, _BITS, _SIZE = _code_table()
_HEAD_TABLES = _segment(0xC4, b"\x00" + _TABLE) + _segment(0xC4, b"\x10" + _TABLE)
#: Byte of each coefficient from -128 to 128.
_BYTE_OF = np.array([_BYTES[2 * (abs(v) - 1) + (v < 0)] if v else 0 for v in range(-128, 129)], np.uint8)


def _shape(n: int) -> tuple[int, int]:
    """Blocks across and down of the image of n blocks."""
    wide = min(8191, int(np.ceil(np.sqrt(n))))
    high = -(-n // wide)
    if high > 8191:
        raise ValueError("payload too large for one image")
    return wide, high


def encode_many(payloads: list[bytes], sizes: list[int] | None = None) -> list[bytes]:
    """Baseline JPEGs that hold payloads (positive multiples of 64 bytes) in their coefficients, one block a restart interval.

    sizes: of each payload how many bytes aren't padding; it goes into the comment.
    """
    if any(not p or len(p) % BLOCK for p in payloads):
        raise ValueError("a payload must be a positive multiple of 64 bytes")
    shapes = [_shape(len(p) // BLOCK) for p in payloads]
    blocks = np.array([w * h for w, h in shapes])
    parts = [p.ljust(n * BLOCK, FREQUENT[:1]) for p, n in zip(payloads, blocks.tolist())]
    data = np.frombuffer(b"".join(parts), np.uint8)
    length = _SIZE[data].reshape(-1, BLOCK)
    room = (length.sum(1) + 7) // 8  # bytes of each block
    first = np.concatenate([[0], np.cumsum(room)])
    at = (first[:-1, None] * 8 + np.cumsum(length, 1) - length).ravel()
    length, code = length.ravel(), _BITS[data]
    bits = np.ones(int(first[-1]) * 8, np.uint8)
    for k in range(int(length.max())):
        on = np.nonzero(length > k)[0]
        bits[at[on] + k] = code[on] >> (length[on] - 1 - k) & 1
    raw = np.packbits(bits)
    full = raw == 0xFF  # is followed by a stuffed zero
    block = np.repeat(np.arange(len(room)), room)
    shift = np.cumsum(full)
    to = np.arange(len(raw)) + shift - full + 2 * block
    out = np.zeros(len(raw) + int(shift[-1]) + 2 * len(room), np.uint8)
    out[to] = raw
    ends = to[first[1:] - 1] + 1 + full[first[1:] - 1]
    starts = np.concatenate([[0], np.cumsum(blocks)])
    out[ends] = 0xFF
    out[ends + 1] = 0xD0 + (np.arange(len(room)) - np.repeat(starts[:-1], blocks)) % 8
    media = []
    for k, (p, (wide, high)) in enumerate(zip(payloads, shapes)):
        scan = out[to[first[starts[k]]] : ends[starts[k + 1] - 1]].tobytes()
        head = b"\xff\xd8" + _segment(0xFE, b"payload %d %d" % (len(p), sizes[k] if sizes else len(p))) + _segment(0xDB, b"\0\x08" + b"\1" * 63)
        head += _segment(0xC0, b"\x08" + struct.pack(">HH", high * 8, wide * 8) + b"\x01\x01\x11\x00") + _HEAD_TABLES
        media.append(head + _segment(0xDD, b"\0\1") + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00") + scan + b"\xff\xd9")
    return media


def payload_of(img: Image, coefficients: np.ndarray) -> tuple[bytes, int]:
    """(the bytes that encode_many put into the coefficients, how many of them aren't padding)."""
    _, padded_size, size = img.comment.split()
    return _BYTE_OF[coefficients.reshape(-1)[: int(padded_size)] + 128].tobytes(), int(size)


#: What a damaged or foreign image may raise.
_BROKEN = (ValueError, KeyError, IndexError, TypeError, struct.error, ZeroDivisionError)


def decode_each(media: list[bytes | None]) -> list[tuple[Image, np.ndarray] | str]:
    """(markers, coefficients) of each image, or what is wrong with it; images with the same tables are decoded together."""
    found: dict[int, tuple[Image, np.ndarray] | str] = {}
    groups: dict[tuple, list[tuple[int, Image]]] = {}
    for i, m in enumerate(media):
        try:
            if m is None:
                raise ValueError("no media")
            img = parse(m)
            groups.setdefault((tuple(sorted(img.tables.items())), tuple(img.order), tuple(img.layout()[0])), []).append((i, img))
        except _BROKEN as e:
            found[i] = str(e) or type(e).__name__
    for members in groups.values():
        try:
            scans = decode_scans([img for _, img in members])
            found.update((i, (img, c)) for (i, img), c in zip(members, scans))
        except _BROKEN:
            # one of them is damaged: each by itself
            for i, img in members:
                try:
                    found[i] = img, decode_scans([img])[0]
                except _BROKEN as e:
                    found[i] = str(e) or type(e).__name__
    return [found[i] for i in range(len(media))]


def decode_many(media: list[bytes]) -> list[tuple[Image, np.ndarray]]:
    """(markers, coefficients) of each image; ValueError if one can't be decoded."""
    found = decode_each(media)
    for x in found:
        if isinstance(x, str):
            raise ValueError(x)
    return found


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % BLOCK or (0 if raw else BLOCK)), len(raw)


def runs_of(media: pa.Array, limit: int = SLICE_CHARS) -> Iterator[list[bytes | None]]:
    """The images in runs of about `limit` bytes."""
    run, size = [], 0
    for m in media:
        m = m.as_py()
        if run and size + len(m or b"") > limit:
            yield run
            run, size = [], 0
        run.append(m)
        size += len(m or b"")
    if run:
        yield run


def store_media(docs: DataFrame, store: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write every text (null: the empty one) as a JPEG to the table `store` and read that: doc_id, media, of every row."""
    data = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for start, run in slices(batch.column(1)):
                payloads, sizes = zip(*map(padded, run))
                media = encode_many(list(payloads), list(sizes))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(run)), pa.array(media, pa.binary())], names=["doc_id", "media"])

        return step

    stored = arrow_map(data, make, f"doc_id {data.schema['doc_id'].dataType.simpleString()}, media binary")
    return materialize(stored, store)


_FEATURES = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("thumbnail_hash", pa.string()), ("feature", pa.string())]


def media_features(stored: DataFrame) -> DataFrame:
    """Decodes stored media (doc_id, media): doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, width, height, thumbnail_hash, feature of every row; nulls beside media_bytes and media_sha256 where
    the media are damaged, feature then says how.
    """
    schema = f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, width int, height int, thumbnail_hash string, feature string"

    def row(m: bytes | None, found: tuple[Image, np.ndarray] | str) -> tuple:
        digest = (len(m or b""), hashlib.sha256(m or b"").hexdigest())
        try:
            if isinstance(found, str):
                raise ValueError(found)
            payload, n = payload_of(*found)
            img, mark = found[0], thumbnail_hash(thumbnail(*found))
        except _BROKEN as e:
            return (None, None, None, None, *digest, None, None, None, f"damaged: {e}")
        return (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *digest, img.width, img.height, mark, f"{img.width}x{img.height}:{mark}")

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            start = 0
            for run in runs_of(batch.column(1)):
                rows = [row(m, x) for m, x in zip(run, decode_each(run))]
                columns = [batch.column(0).slice(start, len(run)), *[pa.array(c, t) for c, (_, t) in zip(zip(*rows), _FEATURES)]]
                start += len(run)
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *[n for n, _ in _FEATURES]])

        return step

    return arrow_map(stored.select("doc_id", "media"), make, schema)


def store_texts(docs: DataFrame, store: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """store_media (a new table in the shared folder by default) and media_features of what was stored.

    Equal texts give equal values, repeated rows repeated results, an empty table none.
    """
    return media_features(store_media(docs, store or scratch_dir(docs.sparkSession), id_col, text_col))


def inspect_media(rows: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """width, height, thumbnail_hash of any baseline JPEG column; nulls where the bytes are no such image (error says why)."""
    data = rows.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))

    def row(found: tuple[Image, np.ndarray]) -> tuple:
        try:
            return found[0].width, found[0].height, thumbnail_hash(thumbnail(*found)), None
        except _BROKEN as e:
            return None, None, None, str(e) or type(e).__name__

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            start = 0
            for run in runs_of(batch.column(1)):
                found = [(None, None, None, x) if isinstance(x, str) else row(x) for x in decode_each(run)]
                columns = list(zip(*found))
                types = (pa.int32(), pa.int32(), pa.string(), pa.string())
                part = batch.column(0).slice(start, len(run))
                start += len(run)
                yield pa.RecordBatch.from_arrays([part, *[pa.array(c, t) for c, t in zip(columns, types)]], names=["id", "width", "height", "thumbnail_hash", "error"])

        return step

    return arrow_map(data, make, f"id {data.schema['id'].dataType.simpleString()}, width int, height int, thumbnail_hash string, error string").withColumnRenamed("id", id_col)
