"""Content-addressed store of token ids.

A rolling hash over a window of 32 ids cuts each document's id stream, so copies and shared passages give equal
chunks whatever stands before them. Layout of a store:

* `raw/kind=chunk`: every unique chunk once, named by the BLAKE2b-128 of its bytes (ids as little-endian unsigned integers of
  `width` bytes). A row is a pack: chunks whose names fall into the same bucket, compressed together.
* `recipes`: one row a document in ascending id order: its chunk names, number of ids and the Merkle root over the names.
  Rows are numbered; RUN_ROWS of them in turn are a run.
* `manifest`: of each run the Merkle root over its documents in order, its number of documents and ids.
* `tree`: of each recipe file the Merkle root over its runs in order, and (file -1) that over all files.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, join_counted, remove, scratch_dir, slices, worker_cache
from .token_counts import PRE_TOKEN, SPACE, byte_alphabet, simple

#: From here on a character's class may differ between Unicode versions.
RARE = "\u0530"
#: Units that a worker remembers in each of two generations; the characters of the longest ones.
STREAM_ENTRIES, LONGEST = 240_000, 64
#: Characters of text encoded at once: the more, the fewer different units.
TEXT_CHARS = 4_000_000
#: Chunks of LEAST + 64 ids on average, well below a passage of 100 words.
MASK, LEAST, MOST = (1 << 6) - 1, 32, 1024
#: Bytes of chunks that a task gathers before it sends them off by bucket; those of a bucket of names, about.
PACK_BYTES, BUCKET_BYTES = 16 << 20, 8 << 20
#: Documents of a run; children of a Merkle node.
RUN_ROWS, FAN = 512, 16
_RAW = "kind string, bucket int, width int, names binary, sizes binary, data binary, doc_id bigint, n_ids bigint, chunks binary, root binary"
_GEAR = np.random.default_rng(20240901).integers(0, 1 << 32, 1 << 16, dtype=np.uint64).astype(np.uint32)


def rolling_hashes(ids: np.ndarray) -> np.ndarray:
    """Of each position, the sum of gear[id] << distance over the last 32 ids."""
    h = _GEAR[ids & 0xFFFF]
    if ids.dtype.itemsize > 2:
        h = h ^ (ids >> 16).astype(np.uint32)
    for shift in (1, 2, 4, 8, 16):  # doubles the window each time
        if len(ids) > shift:
            g = h.copy()
            g[shift:] += h[:-shift] << np.uint32(shift)
            h = g
    return h


def cut_points(streams: list[np.ndarray], mask: int = MASK, least: int = LEAST, most: int = MOST) -> list[list[int]]:
    """Ends of the chunks of each stream: where the rolling hash has zero low bits, `least` to `most` ids apart.

    All streams are hashed as one: a window that reaches back into the stream before belongs to one of the first 31
    ids, where no chunk ends (least is 32).
    """
    h = rolling_hashes(np.concatenate(streams)) if streams else np.zeros(0, np.uint32)
    hits = np.nonzero((h >> np.uint32(16)) & np.uint32(mask) == 0)[0] + 1
    bounds = np.cumsum([0] + [len(x) for x in streams])
    firsts = np.searchsorted(hits, bounds, side="right").tolist()
    hits, bounds = hits.tolist(), bounds.tolist()
    out = []
    for k in range(len(streams)):
        base, n = bounds[k], bounds[k + 1] - bounds[k]
        ends, last = [], 0
        for c in hits[firsts[k] : firsts[k + 1]]:
            c -= base
            if c - last < least or c >= n:
                continue
            while c - last > most:
                last += most
                ends.append(last)
            if c - last >= least:
                ends.append(c)
                last = c
        while n - last > most:
            last += most
            ends.append(last)
        ends.append(n)
        out.append(ends)
    return out


def chunk_id(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a hash tree of FAN children a node over leaves that are hashes; no leaves give the hash of nothing."""
    if not leaves:
        return hashlib.blake2b(b"", digest_size=16, person=b"empty").digest()
    level = leaves
    while True:
        level = [hashlib.blake2b(b"".join(level[i : i + FAN]), digest_size=16, person=b"node").digest() for i in range(0, len(level), FAN)]
        if len(level) == 1:
            return level[0]


def document_leaf(doc_id: int | None, n_ids: int, root: bytes) -> bytes:
    """What stands for a document in its run's tree."""
    return hashlib.blake2b(struct.pack("<?qq", doc_id is None, doc_id or 0, n_ids) + root, digest_size=16, person=b"document").digest()


#: A line feed beside other white space, with which it may share a pre-token.
_BESIDE = re.compile(f"\n(?:(?<=[{SPACE}]\n)|(?=[{SPACE}]))")
#: A comma or full stop that may share a pre-token with what stands before it.
_TIED = re.compile(r"[,.](?<![^\W_].)[ \n]")
#: Punctuation that stands as one pre-token after letters (an apostrophe may open a contraction).
_PUNCT = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Prefixes of units: a mark or line feed, a word without a space before it. LONE stands for a space that opens no unit.
MARK, BARE, LONE = "\0", "\1", "\2"
_LONE_SPACE = regex.compile(rf" (?![^{SPACE}])")
#: For Arrow: a text that has it goes to spaced(), all others are cut in the same way by replacements in Arrow.
_UNUSUAL = "[\\x00-\\x02\u0530-\U0010ffff]| [S]| $|^\\n|\\n$|\\n[S]|[S]\\n|(^|[^\\pL\\pN])[,.][ \\n]".replace("S", SPACE[: SPACE.index("\u1680")])
_MARKED = [(", ", " \0, "), (". ", " \0. "), (".\n", " \0.\n"), ("\n", " \0\n \1")]


def _rare(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return max(text) >= RARE
    return False


def spaced(text: str) -> str:
    """The text with its units between spaces: pieces(), where that is safe with commas, full stops and line feeds as units of their own.

    The text has none of MARK, BARE and LONE; its first unit begins with BARE.
    """
    if not simple(text):
        return BARE + _LONE_SPACE.sub(LONE, text)
    if _TIED.search(text) or not text.isascii() and _rare(text):
        return BARE + text
    text = text.replace(", ", " \0, ").replace(". ", " \0. ")
    if "\n" in text and text[-1] != "\n" and text[0] != "\n" and not _BESIDE.search(text):
        text = text.replace(".\n", " \0.\n").replace("\n", " \0\n \1")
    return BARE + text


class StreamEncoder:
    """Ids of texts by the tokenizers library, remembered by unit (a space before a non-space always opens a pre-token).

    Ids are kept as little-endian unsigned integers of `width` bytes. Arrow cuts many texts into units and finds the
    different ones, so that only those are looked up. New words go to the library's BPE model many at a time, other new
    units are cut into pre-tokens first; units with rare characters or marks of special tokens go to the library whole.

    Two generations of at most about `memo_entries` units are remembered: when the younger one is full it becomes the older
    one, and what is asked for again moves on, so that common words stay.
    """

    def __init__(self, path: str, memo_entries: int = STREAM_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.width, self.code = (2, "H") if self.library.get_vocab_size() <= 1 << 16 else (4, "I")
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_alphabet())})
        # the same model over lines that are pre-tokens already
        self.lines = Tokenizer(self.model)
        self.lines.pre_tokenizer = CharDelimiterSplit(self.letters[10])
        vocab = self.library.get_vocab()
        self.opens = np.zeros(max(vocab.values()) + 1, bool)
        self.opens[[i for t, i in vocab.items() if t[0] == self.letters[32]]] = True
        self.plain = {MARK + m: self._whole(m) for m in ",.\n"} | {BARE: b""}
        self.memo: dict[str, bytes] = dict(self.plain)
        self.old: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.memo_entries = memo_entries

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _ids(self, word: str) -> bytes:
        text = word if word.isascii() else word.encode().decode("latin-1")
        return array(self.code, [t.id for t in self.model.tokenize(text.translate(self.letters))]).tobytes()

    def _learn(self, words: list[str]) -> list[bytes]:
        """Of words of letters below RARE, each with a space before it; remembers them."""
        out: list[bytes] = []
        width, code, space, line = self.width, self.code, self.letters[32], self.letters[10]
        for start in range(0, len(words), 256):
            some = words[start : start + 256]
            text = "\n ".join(["", *some])
            if text.isascii():
                text = (line + space).join(["", *some])
            else:
                text = text.encode().decode("latin-1").translate(self.letters)
            ids = array(code, self.lines.encode_batch_fast([text], add_special_tokens=False)[0].ids)
            # a word's first token alone begins with the space
            firsts = np.flatnonzero(self.opens[np.frombuffer(ids, code)])
            assert len(firsts) == len(some)
            raw, ends = ids.tobytes(), (firsts * width).tolist()
            ends.append(len(raw))
            out += [raw[a:z] for a, z in zip(ends, ends[1:])]
        self.memo.update(zip(words, out))
        return out

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = self._ids(word)
            if len(word) <= LONGEST:
                self.words[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        """Of a unit that isn't a plain ASCII word."""
        if LONE in piece:
            piece = piece.replace(LONE, " ")
        # the piece that opens a text or line has no space before it
        text = piece[1:] if piece[0] == BARE else " " + piece
        if "<|" in text or not text.isascii() and max(text) >= RARE:
            return self._whole(text)
        if text.isalpha():
            return self._word(text)
        core = piece.rstrip(_PUNCT)
        if core.isalpha():
            # a closing mark is a pre-token of its own
            return self._known(core) + (self._word(piece[len(core) :]) if len(core) < len(piece) else b"")
        return b"".join(map(self._word, PRE_TOKEN.findall(text)))

    def _known(self, word: str) -> bytes:
        """Of a word of letters below RARE with a space before it."""
        ids = self.memo.get(word) or self.old.get(word) or self._ids(" " + word)
        if len(word) <= LONGEST:
            self.memo[word] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        if len(self.memo) > self.memo_entries:
            self.old, self.memo = self.memo, dict(self.plain)
        if len(self.words) > self.memo_entries:
            self.words.clear()
        column = pa.array(texts, pa.large_string())
        unusual = pc.match_substring_regex(column, _UNUSUAL)
        for a, b in _MARKED:
            column = pc.replace_substring(column, a, b)
        column = pc.binary_join_element_wise(pa.scalar(BARE, column.type), column, pa.scalar("", column.type))
        whole = {}
        if at := np.flatnonzero(unusual.to_numpy(zero_copy_only=False)).tolist():
            whole = {i: self._whole(texts[i]) for i in at if any(c in texts[i] for c in (MARK, BARE, LONE))}
            column = pc.replace_with_mask(column, unusual, pa.array([BARE if i in whole else spaced(texts[i]) for i in at], column.type))
        cut = pc.split_pattern(column, " ")
        units = cut.flatten().dictionary_encode()
        names = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        memo, old = self.memo, self.old
        ids = list(map(memo.get, names))
        new = [i for i, x in enumerate(ids) if x is None]
        if old:
            for i, x in zip(new, list(map(old.get, [names[i] for i in new]))):
                if x is not None:
                    ids[i] = memo[names[i]] = x
            new = [i for i in new if ids[i] is None]
        plain = [i for i in new if names[i].isalpha() and len(names[i]) <= LONGEST]
        within = [i for i in plain if names[i].isascii()]
        for some in (within, [i for i in plain if not names[i].isascii() and max(names[i]) < RARE]):
            for i, x in zip(some, self._learn([names[i] for i in some])):
                ids[i] = x
        new = [i for i in new if ids[i] is None]
        cores = dict.fromkeys(c for c in [names[i].rstrip(_PUNCT) for i in new] if c.isalpha() and c.isascii() and len(c) <= LONGEST)
        self._learn([c for c in cores if c not in memo and c not in old])
        for i in new:
            ids[i] = x = self._piece(names[i])
            if len(names[i]) <= LONGEST:
                memo[names[i]] = x
        found = pa.array(ids, pa.large_binary()).take(units.indices)
        _, ends, data = found.buffers()
        bounds = np.frombuffer(ends, np.int64)[cut.offsets.to_numpy()].tolist() if texts else [0]
        data = memoryview(data or b"")
        return [whole[i] if i in whole else bytes(data[a:z]) for i, (a, z) in enumerate(zip(bounds, bounds[1:]))]


def _buckets(docs: DataFrame) -> int:
    """Buckets of chunk names: a power of two that grows with the input's size, as Spark estimates it."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return 1 << max(6, min(20, (size // BUCKET_BYTES).bit_length()))


def _batch(rows: list[tuple], types: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types)], names=[n for n, _ in types])


_RAW_TYPES = [("kind", pa.string()), ("bucket", pa.int32()), ("width", pa.int32()), ("names", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary()), ("doc_id", pa.int64()), ("n_ids", pa.int64()), ("chunks", pa.binary()), ("root", pa.binary())]


def by_bucket(names: bytes, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions) of names of 16 bytes."""
    bucket = np.frombuffer(names, np.uint32)[::4] & np.uint32(buckets - 1)
    order = np.argsort(bucket, kind="stable")
    ends = np.nonzero(np.diff(bucket[order], append=-1))[0] + 1
    start = 0
    for end in ends.tolist():
        at = order[start:end]
        yield int(bucket[at[0]]), at
        start = end


def _split(blob: bytes) -> list[bytes]:
    return [blob[i : i + 16] for i in range(0, len(blob), 16)]


def _encoded(path: str, end_id: int, buckets: int):
    """Documents (doc_id, text) to recipes and packs of chunks that are new to the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_cache("stream", path, lambda: StreamEncoder(path))
        width, dtype = encoder.width, np.dtype(f"<u{encoder.width}")
        tail = end_id.to_bytes(width, "little")
        seen: set[bytes] = set()
        names: list[bytes] = []
        pieces: list[bytes] = []
        held, k = 0, TaskContext.get().partitionId()

        def packs() -> pa.RecordBatch:
            blob = b"".join(names)
            sizes, rows = np.fromiter(map(len, pieces), np.uint32, len(pieces)) // np.uint32(width), []
            table = np.frombuffer(blob, "V16")
            for bucket, at in by_bucket(blob, buckets):
                data = b"".join([pieces[i] for i in at.tolist()])
                rows.append(("chunk", bucket, width, table[at].tobytes(), sizes[at].tobytes(), data, None, None, None, None))
            names.clear()
            pieces.clear()
            return _batch(rows, _RAW_TYPES)

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for start, texts in slices(batch.column(1), TEXT_CHARS):
                rows: list[tuple] = []
                streams = [raw + tail for raw in encoder.encode(texts)]
                arrays = [np.frombuffer(x, dtype) for x in streams]
                for key, stream, cuts in zip(keys[start:], streams, cut_points(arrays)):
                    last, own = 0, []
                    for end in cuts:
                        piece = stream[last : (last := end * width)]
                        name = chunk_id(piece)
                        own.append(name)
                        if name not in seen:
                            seen.add(name)
                            names.append(name)
                            pieces.append(piece)
                            held += len(piece)
                    k += 1
                    rows.append(("recipe", k * 7919 % buckets, None, None, None, None, key, len(stream) // width, b"".join(own), merkle_root(own)))
                yield _batch(rows, _RAW_TYPES)
                if held > PACK_BYTES:
                    yield packs()
                    held = 0
                if len(seen) > 1 << 20:
                    seen.clear()
        if names:
            yield packs()

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs sorted by bucket with every chunk once, compressed; recipes pass."""
    press = zstandard.ZstdCompressor(level=1)
    seen: set[bytes] = set()
    now = None
    for batch in batches:
        is_pack = pc.equal(batch.column(0), "chunk")
        yield batch.filter(pc.invert(is_pack))
        rows = []
        for row in batch.filter(is_pack).to_pylist():
            if row["bucket"] != now:
                now = row["bucket"]
                seen.clear()
            own = _split(row["names"])
            fresh = []
            for i, name in enumerate(own):
                if name not in seen:
                    seen.add(name)
                    fresh.append(i)
            if len(fresh) == len(own):
                rows.append(tuple((row | {"data": press.compress(row["data"])}).values()))
            elif fresh:
                data, width = row["data"], row["width"]
                sizes = np.frombuffer(row["sizes"], np.uint32)
                ends = (np.cumsum(sizes, dtype=np.int64) * width).tolist()
                kept = b"".join([data[a:z] for a, z in ((ends[i - 1] if i else 0, ends[i]) for i in fresh)])
                rows.append(("chunk", now, width, b"".join([own[i] for i in fresh]), sizes[fresh].tobytes(), press.compress(kept), None, None, None, None))
        if rows:
            yield _batch(rows, _RAW_TYPES)


def write_store(docs: DataFrame, path: str, store: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append end_id, and write the store. A null text counts as empty: its stream is the end id.

    Rows are kept one by one: repeated rows give repeated recipes, a null id sorts first; rows of one id stand in the
    order of their Merkle roots.
    """
    spark = docs.sparkSession
    data = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    buckets = _buckets(data)
    both = data.mapInArrow(_encoded(path, end_id, buckets), _RAW)
    # chunks meet by bucket of their names, recipes are spread; a task sends a chunk once, so no bucket is hot
    once = both.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_once, _RAW)
    once.write.mode("overwrite").partitionBy("kind").parquet(f"{store}/raw")
    raw = spark.read.schema(_RAW).parquet(f"{store}/raw")
    order = [F.col("doc_id").asc_nulls_first(), "root", "tie"]
    recipes = raw.filter("kind = 'recipe'").select("doc_id", "n_ids", "chunks", "root", F.monotonically_increasing_id().alias("tie"))
    recipes = recipes.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")

    def make_numbers():
        first, at = TaskContext.get().partitionId() << 32, 0

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal at
            row = np.arange(at, at := at + batch.num_rows)
            return pa.RecordBatch.from_arrays([pa.array(first + row), pa.array(first + row // RUN_ROWS), *batch.columns], names=["row", "run", *batch.schema.names])

        return step

    numbered = arrow_map(recipes, make_numbers, "row bigint, run bigint, doc_id bigint, n_ids bigint, chunks binary, root binary")
    numbered.write.mode("overwrite").parquet(f"{store}/recipes")
    remove(spark, f"{store}/raw/kind=recipe")

    def root_of_run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        leaves = list(map(document_leaf, *(rows[c].to_pylist() for c in ("doc_id", "n_ids", "root"))))
        return pa.table({"run": [key[0].as_py()], "documents": [len(leaves)], "n_ids": [sum(rows["n_ids"].to_pylist())], "root": [merkle_root(leaves)]})

    narrow = spark.read.parquet(f"{store}/recipes").select("run", "row", "doc_id", "n_ids", "root")
    narrow.groupBy("run").applyInArrow(root_of_run, "run bigint, documents bigint, n_ids bigint, root binary").write.mode("overwrite").parquet(f"{store}/manifest")
    files = _file_roots(spark, store)
    whole = (-1, sum(f[1] for f in files), sum(f[2] for f in files), merkle_root([f[3] for f in files]), buckets)
    tree = spark.createDataFrame([whole, *[(*f, buckets) for f in files]], "file bigint, documents bigint, n_ids bigint, root binary, buckets int")
    tree.coalesce(1).write.mode("overwrite").parquet(f"{store}/tree")


def _file_roots(spark: SparkSession, store: str) -> list[tuple[int, int, int, bytes]]:
    """(file, documents, ids, Merkle root of its runs) of each recipe file in order, from the manifest; one row a file reaches the driver."""

    def root_of_file(key: tuple, runs: pa.Table) -> pa.Table:
        runs = runs.sort_by("run")
        return pa.table({"file": [key[0].as_py()], "documents": [sum(runs["documents"].to_pylist())], "n_ids": [sum(runs["n_ids"].to_pylist())], "root": [merkle_root(runs["root"].to_pylist())]})

    runs = spark.read.schema("run bigint, documents bigint, n_ids bigint, root binary").parquet(f"{store}/manifest")
    files = runs.withColumn("file", F.shiftright("run", 32)).groupBy("file").applyInArrow(root_of_file, "file bigint, documents bigint, n_ids bigint, root binary")
    return sorted(tuple(r) for r in files.collect())


@cache
def _shift_tables(k: int) -> np.ndarray:
    """The linear map of crc32 that appends 4 * 2^k zero bytes, as tables of its images of each of the four bytes."""
    m = [0xEDB88320] + [1 << (i - 1) for i in range(1, 32)]  # one zero bit
    for _ in range(k + 5):
        m = [_times(m, c) for c in m]
    tables = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            step = 1 << bit
            tables[byte, step : 2 * step] = tables[byte, :step] ^ np.uint32(m[8 * byte + bit])
    return tables


def _times(m: list[int], v: int) -> int:
    s, i = 0, 0
    while v:
        if v & 1:
            s ^= m[i]
        v >>= 1
        i += 1
    return s


def crc_after(crc: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """What each crc becomes, less the part of the new bytes, when `ids` 4-byte ids follow."""
    crc, k = crc.astype(np.uint32), 0
    while (ids >> k).any():
        on = np.nonzero(ids >> k & 1)[0]
        c, t = crc[on], _shift_tables(k)
        crc[on] = t[0, c & 255] ^ t[1, c >> 8 & 255] ^ t[2, c >> 16 & 255] ^ t[3, c >> 24]
        k += 1
    return crc


def unpacked(row: dict) -> Iterator[tuple[bytes, bytes]]:
    """(name, bytes) of the chunks of a pack whose bytes hash to their names; a damaged pack has fewer or none."""
    try:
        data = zstandard.ZstdDecompressor().decompress(row["data"])
    except (zstandard.ZstdError, TypeError):
        return
    at, width = 0, row["width"]
    for name, n in zip(_split(row["names"]), np.frombuffer(row["sizes"], np.uint32).tolist()):
        piece = data[at : (at := at + n * width)]
        if chunk_id(piece) == name:
            yield name, piece


#: facts: of each name its chunk's length and checksum, n << 32 | crc.
_META = "bucket int, kind int, run bigint, names binary, facts binary"
_META_TYPES = [("bucket", pa.int32()), ("kind", pa.int32()), ("run", pa.int64()), ("names", pa.binary()), ("facts", pa.binary())]


def _verified_chunks():
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for row in batch.to_pylist():
            found = list(unpacked(row))
            wide = memoryview(np.frombuffer(b"".join([p for _, p in found]), f"<u{row['width']}").astype("<u4").tobytes())
            ns = [len(p) // row["width"] for _, p in found]
            ends = (4 * np.cumsum(ns, dtype=np.int64)).tolist()
            facts = array("Q", [n << 32 | zlib.crc32(wide[a:z]) for n, a, z in zip(ns, [0, *ends], ends)])
            rows.append((row["bucket"], 0, None, b"".join([n for n, _ in found]), facts.tobytes()))
        return _batch(rows, _META_TYPES)

    return step


def _asked_chunks(buckets: int):
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            runs: dict[int, dict[bytes, None]] = {}
            for run, chunks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                runs.setdefault(run, {}).update(dict.fromkeys(_split(chunks)))
            rows = []
            for run, names in runs.items():
                table = np.frombuffer(blob := b"".join(names), "V16")
                rows += [(bucket, 1, run, table[at].tobytes(), None) for bucket, at in by_bucket(blob, buckets)]
            return _batch(rows, _META_TYPES)

        return step

    return make


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket, chunks before questions: the lengths and checksums asked for, without holding the questions."""
    now, known = None, {}
    for batch in batches:
        rows = []
        for bucket, kind, run, names, facts in zip(*[c.to_pylist() for c in batch.columns]):
            if bucket != now:
                now, known = bucket, {}
            if kind == 0:
                known.update(zip(_split(names), array("Q", facts)))
                continue
            own = _split(names)
            held = list(map(known.get, own))
            if None in held:
                names = b"".join([name for name, fact in zip(own, held) if fact is not None])
                held = [fact for fact in held if fact is not None]
            rows.append((bucket, 1, run, names, array("Q", held).tobytes()))
        yield _batch(rows, _META_TYPES)


_READ_TYPES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("verified", pa.bool_())])
_READ = "row bigint, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, verified boolean"


def _documents(recipes: pa.Table, answers: pa.Table) -> pa.Table:
    """Of one run: what its documents' chunks add up to, against their roots and the run's."""
    known: dict[bytes, int] = {}
    base, intact, want = None, False, None
    for a in answers.to_pylist():
        if a["kind"] == 1:
            known.update(zip(_split(a["names"]), array("Q", a["facts"])))
        else:
            base, intact, want = a["base"], a["intact"], a["names"]
    if not recipes.num_rows:
        return pa.table([[None], [None], [base], [None], [None], [False]], schema=_READ_TYPES)
    recipes = recipes.sort_by("row")
    ids, n_ids, roots = (recipes[c].to_pylist() for c in ("doc_id", "n_ids", "root"))
    names = list(map(_split, recipes["chunks"].to_pylist()))
    # no chunk is empty, so 0 stands for one that isn't there
    flat = np.array([known.get(x, 0) for own in names for x in own], np.uint64)
    n, crc = (flat >> np.uint64(32)).astype(np.int64), flat.astype(np.uint32)
    bounds = np.cumsum([0, *map(len, names)])
    before = np.concatenate([[0], np.cumsum(n)])
    after = np.repeat(before[bounds[1:]], np.diff(bounds)) - before[1:]
    moved = crc_after(crc, np.maximum(after, 0))
    n_out, crc_out, ok = [], [], []
    for k, own in enumerate(names):
        a, z = bounds[k], bounds[k + 1]
        whole = z > a and bool(n[a:z].all()) and int(before[z] - before[a]) == n_ids[k]
        n_out.append(int(before[z] - before[a]) if whole else None)
        crc_out.append(int(np.bitwise_xor.reduce(moved[a:z])) if whole else None)
        ok.append(whole and merkle_root(own) == roots[k])
    intact = bool(intact) and merkle_root(list(map(document_leaf, ids, n_ids, roots))) == want
    starts = [None if base is None else base + x for x in np.cumsum([0, *n_ids[:-1]]).tolist()]
    return pa.table([recipes["row"].to_pylist(), ids, starts, n_out, crc_out, [intact and x for x in ok]], schema=_READ_TYPES)


def _tables(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """(packs of chunks, recipes) of a store."""
    chunks = spark.read.schema(_RAW).parquet(f"{store}/raw").filter("kind = 'chunk'").select("bucket", "width", "names", "sizes", "data")
    return chunks, spark.read.schema("row bigint, run bigint, doc_id bigint, n_ids bigint, chunks binary, root binary").parquet(f"{store}/recipes")


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """Reads a store back: doc_id, start, n_tokens, ids_crc32, verified boolean, per document.

    Every chunk's bytes must hash to its name, a recipe's root follow from its chunk names, a run's root in the manifest
    from its documents in order, a file's root from its runs, and the store's from its files; verified says whether all
    held. A chunk that is missing or damaged makes verified false and n_tokens and ids_crc32 null; a changed, lost or
    moved recipe makes it false for its run, a changed or lost row of the manifest for its file and those after it,
    whose starts no longer follow. A run whose recipes are all lost gives one row without an id that isn't verified.
    """
    chunks, recipes = _tables(spark, store)
    tree = {r["file"]: r for r in spark.read.parquet(f"{store}/tree").collect()}
    found, bases, intact = {f[0]: f for f in _file_roots(spark, store)}, [], True
    whole, at = tree.pop(-1), 0
    intact = merkle_root([bytes(tree[f]["root"]) for f in sorted(tree)]) == bytes(whole["root"])
    for f in sorted(tree):
        intact = intact and f in found and found[f][3] == bytes(tree[f]["root"])
        bases.append((f, at, intact))
        at += tree[f]["n_ids"]
    # one row a file
    bases = F.broadcast(spark.createDataFrame(bases, "file bigint, file_base bigint, intact boolean"))
    runs = spark.read.schema("run bigint, documents bigint, n_ids bigint, root binary").parquet(f"{store}/manifest").withColumn("file", F.shiftright("run", 32))
    before = F.sum("n_ids").over(Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("before", F.coalesce(before, F.lit(0))).join(bases, "file")
    runs = runs.select("run", F.lit(2).alias("kind"), F.col("root").alias("names"), (F.col("before") + F.col("file_base")).alias("base"), "intact")
    asked = arrow_map(recipes.select("run", "chunks"), _asked_chunks(whole["buckets"]), _META)
    both = arrow_map(chunks, _verified_chunks, _META).unionByName(asked)
    answers = both.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_answers, _META).drop("bucket")
    answers = answers.unionByName(runs, allowMissingColumns=True)
    read = recipes.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(_documents, _READ)
    return read.drop("row")


def reconstruct(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, row, ids array<int> (end id included) of every document, from its chunks; ids is null where one is missing or damaged."""
    chunks, recipes = _tables(spark, store)

    def make_pieces():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for row in batch.to_pylist():
                rows = [(name, np.frombuffer(p, f"<u{row['width']}").astype("<u4").tobytes()) for name, p in unpacked(row)]
                yield _batch(rows, [("name", pa.binary()), ("piece", pa.binary())])

        return step

    names = F.transform(F.sequence(F.lit(1), (F.octet_length("chunks") / 16).cast("int")), lambda i: F.substring("chunks", (i - 1) * 16 + 1, F.lit(16)))
    parts = recipes.select("row", F.posexplode(names).alias("pos", "name"))
    # a chunk that many documents share may be hot
    counts = parts.groupBy("name").agg(F.count("*").alias("n"))
    pieces = arrow_map(chunks, make_pieces, "name binary, piece binary").join(counts, "name")
    found = join_counted(parts, pieces, "name", parts.count(), F.xxhash64("row", "pos")).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    found = recipes.select("row", "doc_id", "n_ids").join(found.select("row", F.col("p.piece").alias("p")), "row", "left")

    def make_ids():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [np.frombuffer(b"".join(p or []), "<u4") for p in batch.column(3).to_pylist()]
            ids = [x.astype(np.int32) if len(x) == n else None for x, n in zip(ids, batch.column(2).to_pylist())]
            return pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "row", "ids"])

        return step

    return arrow_map(found, make_ids, "doc_id bigint, row bigint, ids array<int>")


def store_documents(docs: DataFrame, path: str, end_id: int = 0, store: str | None = None) -> DataFrame:
    """Write docs to a store (a new one in the shared folder by default) and read it back."""
    spark = docs.sparkSession
    store = store or scratch_dir(spark)
    write_store(docs, path, store, end_id)
    return read_store(spark, store)
