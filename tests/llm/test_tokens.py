"""Token counts, the word codec and the content store against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpuslane.llm import bpe_codec, content_store, token_counts

from .conftest import EDGE

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "b", " ", "  ", "\n", "'s", "'", "é", "1", "<|endoftext|>", "<|startoftext|>", "!", "\t", "\x1c", "\x85", "　", "ß", "漢", "😀", " '", "ll", ",", ".", "|>", "Σ", "A", "İ", "é", "՘"]


def texts(n=4000, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 16))) for _ in range(n)]


def test_counts_match_library():
    library, own = Tokenizer.from_file(BYTE), token_counts.TokenCounter(BYTE, memo_entries=500)
    for t in texts():
        assert own.count(t) == len(library.encode(t, add_special_tokens=False).ids), repr(t)


def test_codec_matches_library():
    library, own, decoder = Tokenizer.from_file(WORD), bpe_codec.WordBpe(WORD, memo_entries=500), bpe_codec.Decoder(WORD)
    for t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, repr(t)
        assert decoder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_stream_encoder_matches_library():
    library, own = Tokenizer.from_file(BYTE), content_store.StreamEncoder(BYTE, memo_entries=500)
    many = texts()
    for t, raw in zip(many, own.encode(many)):
        assert np.frombuffer(raw, f"<u{own.width}").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_tree_takes_leftmost_lowest_rank():
    pairs = {1 << 24 | 1: (0, 2), 2 << 24 | 2: (1, 3)}
    assert bpe_codec.merge_by_tree([1] * 5, pairs) == [3, 1]
    assert token_counts.count_after_merges([1] * 5, pairs) == 2
    assert bpe_codec.merge_by_tree([], pairs) == []


def test_count_tokens_edges(edge, empty):
    library = Tokenizer.from_file(BYTE)
    out = token_counts.count_tokens(edge, BYTE)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect())
    want = []
    for i, t, _ in EDGE:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i or 0, len((t or "").encode()), n, n > 1024))
    assert got == sorted(want)
    assert token_counts.count_tokens(empty, BYTE).count() == 0


def test_encode_documents_edges(edge, empty):
    library = Tokenizer.from_file(WORD)
    out = bpe_codec.encode_documents(edge, WORD, keep=["source", "key"], keep_decoded=True).collect()
    assert len(out) == len(EDGE)
    by_text = {(i, s): t or "" for i, t, s in EDGE}
    for r in out:
        ids = library.encode(by_text[r.doc_id, r.source], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.key == "x"
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    back = bpe_codec.decode_documents(bpe_codec.encode_documents(edge, WORD, keep=["source"], keep_decoded=True).withColumnRenamed("decoded", "want"), WORD)
    assert back.filter("decoded <> want").count() == 0 and back.count() == len(EDGE)
    assert bpe_codec.decode_documents(bpe_codec.encode_documents(empty, WORD), WORD).count() == 0


def test_decoding_reads_the_ids(spark):
    library = Tokenizer.from_file(WORD)
    rows = [(1, [5, 300, 49000], "x"), (2, [], "x"), (3, None, "x"), (4, [7, 10**9, 8], "x"), (5, [7, 8], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, ids array<int>, text string")
    got = {r.doc_id: r.decoded for r in bpe_codec.decode_documents(df, WORD).collect()}
    assert got == {i: library.decode(ids or [], skip_special_tokens=False) for i, ids, _ in rows}
    holes = spark.createDataFrame([(1, [7, None, 8]), (2, None)], "doc_id bigint, ids array<int>")
    assert [r.decoded for r in bpe_codec.decode_documents(holes, WORD).collect()] == [library.decode([7, 8]), ""]


def test_codec_query_on_edges(spark, edge, tmp_path):
    from corpuslane.llm.queries import QUERIES

    edge.write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(WORD)
    want = []
    for i, t, _ in EDGE:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = QUERIES["op7_bpe_codec"](spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted((r[0] or 0, *r[1:]) for r in got) == sorted(want)


def test_store_round_trip(edge, empty):
    library = Tokenizer.from_file(BYTE)
    out = sorted(content_store.store_documents(edge, BYTE).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted([i for i, _, _ in EDGE], key=lambda i: (i is not None, i or 0))
    at, by_id = 0, {i: t for i, t, _ in EDGE}
    for r in out:
        ids = library.encode(by_id[r.doc_id] or "", add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, r.verified) == (at, len(ids), True)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert content_store.store_documents(empty, BYTE).count() == 0


def test_white_space_around_line_feeds():
    library, own = Tokenizer.from_file(BYTE), content_store.StreamEncoder(BYTE)
    some = ["č\n\xa0\xa0x", "Ž\n\xa0", "č\r\n\xa0\xa0x", "č.\n\xa0\xa0x", "a\n\u2003b\n\tc", "č, d. e\nf.\n g", "č\x0b\n\nx", "a\r\nb"]
    rng = random.Random(9)
    some += ["".join(rng.choice(["č", "a", ".", ", ", "\n", "\r\n", "\xa0", "\u2003", "\t", " b", "\x0c", "\x85"]) for _ in range(rng.randint(1, 12))) for _ in range(20000)]
    for t, raw in zip(some, own.encode(some)):
        assert np.frombuffer(raw, f"<u{own.width}").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_units_in_odd_texts():
    library, own = Tokenizer.from_file(BYTE), content_store.StreamEncoder(BYTE, memo_entries=300)
    some = ["", " ", ", a", ". a", "a, ", "a. b.\nc\nd, e", "_, a", "\u00bd, a.\nb", "\u0301, a", "\0, a", "a \1b", "a \2b", "a \0\n \1b", "x" * 99 + " y" + "\u00e9" * 99 + " " + "x" * 99, "\u0530, a. b", "a\n"]
    rng = random.Random(10)
    some += ["".join(rng.choice(["a", "\u00e9", "\u0416", "1", "_", ".", ", ", ". ", ".\n", "\n", " ", "  ", "\0", "\1", "\2", "\x1c", "\xa0", " b", "'s", "!", "<|endoftext|>", "\u5b57", "\u02bc"]) for _ in range(rng.randint(1, 9))) for _ in range(20000)]
    for part in (some[:16], some[16:10000], some[10000:], some[:500], []):
        for t, raw in zip(part, own.encode(part), strict=True):
            assert np.frombuffer(raw, f"<u{own.width}").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_new_words_go_to_the_library_together():
    library, own, calls = Tokenizer.from_file(BYTE), content_store.StreamEncoder(BYTE, memo_entries=3000), []

    class Counted:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            return lambda *a, **k: (calls.append(name), getattr(self.inner, name)(*a, **k))[1]

    for name in ("library", "model", "lines"):
        if hasattr(own, name):
            setattr(own, name, Counted(getattr(own, name)))
    rng = random.Random(11)
    words = lambda: " ".join("".join(rng.choice("abdeiknorst\u00e9\u017e") for _ in range(rng.randint(5, 9))) for _ in range(100))
    for _ in range(4):
        many = [words() for _ in range(40)]
        for t, raw in zip(many, own.encode(many), strict=True):
            assert np.frombuffer(raw, f"<u{own.width}").tolist() == library.encode(t, add_special_tokens=False).ids
    # the word that opens a text has no space before it and goes alone
    assert len(calls) < 400, len(calls)
    assert len(own.memo) + len(own.old) < 2 * (3000 + 4100)


def stored(spark, make, store):
    """Three documents of which two are equal and one shares their passage, written to store; their rows by id."""
    body = " ".join(f"w{i * i % 7919}" for i in range(6000))
    rows = [(1, body, "a"), (2, "another start " + body, "a"), (3, body, "b"), (None, "č\n\xa0x", "b")]
    content_store.write_store(make(rows), BYTE, store)
    return rows


AT = {"chunks": "raw/kind=chunk", "recipes": "recipes", "manifest": "manifest", "tree": "tree"}


def table_of(spark, store, name):
    return [r.asDict() for r in spark.read.parquet(f"{store}/{AT[name]}").collect()]


def rewritten(spark, store, to, **tables):
    """Rows by id of a copy of a store with some tables replaced."""
    for name, at in AT.items():
        df = spark.read.parquet(f"{store}/{at}")
        if name in tables:
            df = spark.createDataFrame([tuple(r.values()) for r in tables[name]], df.schema)
        df.write.parquet(f"{to}/{at}")
    return {r.doc_id: r for r in content_store.read_store(spark, to).collect()}


def test_store_holds_a_chunk_once_and_reconstructs(spark, make, tmp_path):
    library, store = Tokenizer.from_file(BYTE), str(tmp_path / "store")
    rows = stored(spark, make, store)
    names = [n for r in table_of(spark, store, "chunks") for n in content_store._split(bytes(r["names"]))]
    used = [n for r in table_of(spark, store, "recipes") for n in content_store._split(bytes(r["chunks"]))]
    assert len(names) == len(set(names)) < len(used) and set(used) == set(names)
    assert spark.read.parquet(f"{store}/manifest").agg({"documents": "sum"}).first()[0] == 4
    back = {r.doc_id: r.ids for r in content_store.reconstruct(spark, store).collect()}
    assert back == {i: library.encode(t, add_special_tokens=False).ids + [0] for i, t, _ in rows}


def test_damage_is_reported(spark, make, tmp_path):
    store = str(tmp_path / "store")
    stored(spark, make, store)
    assert all(r.verified for r in content_store.read_store(spark, store).collect())
    packs = table_of(spark, store, "chunks")
    k = max(range(len(packs)), key=lambda i: len(packs[i]["data"]))
    for what in ("lost", "cut", "flipped", "junk"):
        data = bytes(packs[k]["data"])
        data = {"lost": data, "cut": data[:-9], "flipped": data[:30] + bytes([data[30] ^ 255]) + data[31:], "junk": b"junk"}[what]
        bad = packs[:k] + [packs[k] | {"data": bytearray(data)}] * (what != "lost") + packs[k + 1 :]
        got = rewritten(spark, store, str(tmp_path / what), chunks=bad)
        assert len(got) == 4 and not got[1].verified and got[1].ids_crc32 is None, what
        ids = {r.doc_id: r.ids for r in content_store.reconstruct(spark, str(tmp_path / what)).collect()}
        assert ids[1] is None and len(ids) == 4
    recipes = sorted(table_of(spark, store, "recipes"), key=lambda r: r["row"])
    swapped = [r | {"doc_id": i} for r, i in zip(recipes, (None, 2, 1, 3))]
    got = rewritten(spark, store, str(tmp_path / "swapped"), recipes=swapped)
    assert not got[1].verified and not got[2].verified
    assert not all(r.verified for r in rewritten(spark, store, str(tmp_path / "fewer"), recipes=recipes[:-1]).values())
    lost = rewritten(spark, store, str(tmp_path / "none"), recipes=[])
    assert lost and not any(r.verified for r in lost.values())
    manifest = [r | {"root": bytearray(16)} for r in table_of(spark, store, "manifest")]
    assert not any(r.verified for r in rewritten(spark, store, str(tmp_path / "manifest"), manifest=manifest).values())


def test_runs_follow_one_another(spark, make, monkeypatch):
    library = Tokenizer.from_file(BYTE)
    rows = [(i // 2 if i % 3 else None, f"text {i % 5} of some words " * (i % 4), "a") for i in range(1500)]
    out = sorted(content_store.store_documents(make(rows), BYTE).collect(), key=lambda r: r.start)
    at = 0
    for r in out:
        assert r.start == at and r.verified
        at += r.n_tokens
    want = sorted((i is not None, i or 0, len(library.encode(t, add_special_tokens=False).ids) + 1) for i, t, _ in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in out) == want
    assert [r.doc_id for r in out] == [i for _, i, _ in [(x, None if not x else y, z) for x, y, z in want]]


@pytest.mark.parametrize("n", [1, 70, 5000, 40000])
def test_cuts_are_local(n):
    a = np.random.default_rng(n).integers(0, 50000, n).astype("<u2")
    alone = content_store.cut_points([a])[0]
    assert alone[-1] == n and all(z - y <= content_store.MOST for y, z in zip([0, *alone], alone))
    assert content_store.cut_points([a[: n // 2], a, a])[1] == alone


def test_shared_passages_share_chunks():
    rng, shared = np.random.default_rng(8), 0
    some = lambda n: rng.integers(0, 50000, n).astype("<u2")
    for _ in range(50):
        passage, names = some(600), []
        for a in (np.r_[some(rng.integers(1, 500)), passage, some(300)] for _ in range(2)):
            cuts = content_store.cut_points([a])[0]
            names.append({content_store.chunk_id(a[y:z].tobytes()): z - y for y, z in zip([0, *cuts], cuts)})
        shared += sum(n for k, n in names[0].items() if k in names[1])
    assert shared > 0.5 * 50 * 600


def test_crc_combines():
    a = np.random.default_rng(1).integers(0, 50000, 3000).astype("<u4")
    for k in (1, 2, 1000, 2999):
        moved = content_store.crc_after(np.array([zlib.crc32(a[:k].tobytes())]), np.array([len(a) - k]))[0]
        assert int(moved) ^ zlib.crc32(a[k:].tobytes()) == zlib.crc32(a.tobytes())
