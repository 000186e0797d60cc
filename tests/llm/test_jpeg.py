"""JPEG payloads round trip; the side-by-side decoder agrees with a plain one on general baseline images."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from corpuslane.llm import jpeg

from .conftest import EDGE



def table(symbols):
    """A table with code lengths of 5 for all symbols (at most 31)."""
    return bytes([0, 0, 0, 0, len(symbols), *[0] * 11]) + bytes(symbols)


def bits_of(v):
    size = int(abs(v)).bit_length()
    return size, format(v if v >= 0 else v + (1 << size) - 1, f"0{size}b") if size else ""


def build(rng, components, width, height, interval):
    """A random baseline image: (bytes, coefficients in scan order)."""
    dc, ac = list(range(10)), [0x00, 0xF0] + [r << 4 | s for r in (0, 1, 7) for s in range(1, 9)]
    code = lambda t, s: format(t.index(s), "05b")
    hm, vm = max(h for h, _ in components), max(v for _, v in components)
    layout = [c for c, (h, v) in enumerate(components) for _ in range(h * v)]
    mcus = -(-width // (8 * hm)) * -(-height // (8 * vm))
    out, blocks = b"", []
    for start in range(0, mcus, interval or mcus):
        text, pred = "", [0] * len(components)
        for _ in range(min(interval or mcus, mcus - start)):
            for c in layout:
                block = np.zeros(64, int)
                block[0] = rng.integers(-200, 200)
                for k in rng.choice(63, rng.integers(0, 12), replace=False) + 1:
                    block[k] = rng.integers(-100, 100)
                size, b = bits_of(int(block[0]) - pred[c])
                pred[c] = int(block[0])
                text += code(dc, size) + b
                k = 1
                while k < 64:
                    rest = np.nonzero(block[k:])[0]
                    if not len(rest):
                        text += code(ac, 0)
                        break
                    run = int(rest[0])
                    if run >= 16:
                        text += code(ac, 0xF0)
                        k += 16
                        continue
                    size, b = bits_of(int(block[k + run]))
                    if run << 4 | size not in ac:  # keep to the table: clear this coefficient
                        block[k + run] = 0
                        continue
                    text += code(ac, run << 4 | size) + b
                    k += run + 1
                blocks.append(block)
        text += "1" * (-len(text) % 8)
        data = int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\0")
        out += data + (bytes([0xFF, 0xD0 + start // (interval or mcus) % 8]) if start + (interval or mcus) < mcus else b"")
    head = b"\xff\xd8" + jpeg._segment(0xE0, b"JFIF\0") + jpeg._segment(0xDB, b"\0" + bytes([8] + [1] * 63))
    frame = b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(components))
    head += jpeg._segment(0xC0, b"\x08" + struct.pack(">HH", height, width) + bytes([len(components)]) + frame)
    head += jpeg._segment(0xC4, b"\x00" + table(dc)) + jpeg._segment(0xC4, b"\x10" + table(ac))
    if interval:
        head += jpeg._segment(0xDD, struct.pack(">H", interval))
    scan = b"".join(bytes([i + 1, 0]) for i in range(len(components)))
    return head + jpeg._segment(0xDA, bytes([len(components)]) + scan + b"\0\x3f\0") + out + b"\xff\xd9", np.array(blocks)


@pytest.mark.parametrize("components,interval", [([(1, 1)], 0), ([(1, 1)], 3), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 2)])
def test_general_images(components, interval):
    rng = np.random.default_rng(5)
    data, blocks = build(rng, components, 61, 37, interval)
    ((img, found),) = jpeg.decode_many([data])
    assert (img.width, img.height) == (61, 37)
    assert np.array_equal(found, blocks)
    thumb = jpeg.thumbnail(img, found)
    assert thumb.shape == (5, 8)
    assert thumb[0, 0] == np.clip((blocks[0, 0] * 8 + 4) // 8 + 128, 0, 255)


def test_payload_round_trip():
    rng = np.random.default_rng(1)
    payloads = [rng.integers(0, 256, 64 * n, dtype=np.uint8).tobytes() for n in (1, 2, 3, 17, 400)] + [b"\xff" * 640, b"\0" * 64, bytes(range(256))]
    for p, m, (img, c) in zip(payloads, jpeg.encode_many(payloads), jpeg.decode_many(jpeg.encode_many(payloads))):
        assert jpeg.payload_of(img, c) == (p, len(p))
        assert m == jpeg.encode_many([p])[0]
    text = b"the frequent letters of a text have short codes, so that its image is the shorter one of the two. " * 40
    assert len(jpeg.encode_many([jpeg.padded(text.decode())[0]])[0]) < 0.8 * len(text)
    with pytest.raises(ValueError):
        jpeg.encode_many([b"abc"])


def test_store_texts_edges(spark, edge, empty, tmp_path):
    rows = jpeg.store_texts(edge, str(tmp_path / "media")).collect()
    assert len(rows) == len(EDGE)
    media = {r.doc_id: bytes(r.media) for r in spark.read.parquet(str(tmp_path / "media")).collect()}
    by_id = {i: t or "" for i, t, _ in EDGE}
    for r in rows:
        raw = by_id[r.doc_id].encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_bytes == len(media[r.doc_id]) and r.media_sha256 == hashlib.sha256(media[r.doc_id]).hexdigest()
    twice = [r.feature for r in rows if r.doc_id == 7]
    assert twice[0] == twice[1]
    assert jpeg.store_texts(empty).count() == 0


def test_features_come_from_what_is_stored(spark):
    good, other = jpeg.encode_many([b"a" * 64, b"b" * 128], [64, 100])
    df = spark.createDataFrame([(1, other), (2, good[:-20]), (3, None), (4, good)], "doc_id bigint, media binary")
    got = {r.doc_id: r for r in jpeg.media_features(df).collect()}
    assert (got[1].n_bytes, got[1].payload_sha256) == (100, hashlib.sha256(b"b" * 128).hexdigest()) and got[4].n_bytes == 64
    assert all(got[i].payload_sha256 is None and got[i].feature.startswith("damaged") for i in (2, 3))


def test_inspect_media(spark):
    good = jpeg.encode_many([b"a" * 64])[0]
    df = spark.createDataFrame([(1, good), (2, None), (3, b"junk"), (4, good[:-20])], "doc_id bigint, media binary")
    got = {r.doc_id: r for r in jpeg.inspect_media(df).collect()}
    assert got[1].width == 8 and got[1].error is None
    assert all(got[i].width is None and got[i].error for i in (2, 3, 4))
