"""BPE encoding with a segment tree over adjacent pair ranks, and decoding.

The leaves of the tree hold rank * n + position of each adjacent pair, so its root yields the leftmost
lowest-rank merge; a merge updates three leaves in logarithmic time, until the root says no pair is mergeable.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import MEMO_ENTRIES, arrow_map, slices, worker_cache
from .token_counts import SPACE, byte_alphabet, load_merges

PRE_TOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
#: ASCII punctuation that is one pre-token after letters (an apostrophe may open a contraction).
PUNCT = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
SPACES = regex.compile(rf"[{SPACE}]+")
#: str.split() takes these for white space, the tokenizers library doesn't.
SEPARATORS = regex.compile("[\x1c-\x1f]")
#: Characters whose class, case or composition may differ between Unicode versions: the library itself splits such texts.
RARE = regex.compile(r"[\u0530-\u1fff\u2070-\u2fff\u3040-\U0010ffff]")


def merge_by_tree(symbols: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """Merge the leftmost lowest-rank adjacent pair until none is known."""
    n = len(symbols)
    if n < 2:
        return symbols
    none = 1 << 60
    get = pairs.get
    size = 1
    while size < n - 1:
        size *= 2
    tree = [none] * (2 * size)
    for i in range(n - 1):
        hit = get(symbols[i] << 24 | symbols[i + 1])
        if hit:
            tree[size + i] = hit[0] * n + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    if tree[1] == none:
        return symbols
    sym, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))

    def update(leaf: int, value: int) -> None:
        k = size + leaf
        if tree[k] == value:
            return
        tree[k] = value
        while k > 1:
            k >>= 1
            a, b = tree[2 * k], tree[2 * k + 1]
            low = a if a < b else b
            if tree[k] == low:
                return
            tree[k] = low

    while (root := tree[1]) != none:
        i = root % n
        j = after[i]
        sym[i] = merged = get(sym[i] << 24 | sym[j])[1]
        sym[j] = -1
        k = after[i] = after[j]
        if j < n - 1:
            update(j, none)
        if k < n:
            before[k] = i
            hit = get(merged << 24 | sym[k])
            update(i, hit[0] * n + i if hit else none)
        else:
            update(i, none)
        h = before[i]
        if h >= 0:
            hit = get(sym[h] << 24 | merged)
            update(h, hit[0] * n + h if hit else none)
    return [s for s in sym if s >= 0]


def lower(text: str) -> str:
    """Lower case character by character (a final capital sigma gets no special form)."""
    return text.replace("Σ", "σ").lower()


class _Memo(dict):
    def __init__(self, work: Callable[[str], bytes]):
        super().__init__()
        self.work = work

    def __missing__(self, key: str) -> bytes:
        self[key] = x = self.work(key)
        return x


class WordBpe:
    """Encodes and decodes as the tokenizers library does with a lower-casing word BPE file, without added special tokens."""

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        self.vocab, self.pairs, specials = load_merges(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.end = spec["model"].get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.initial = [self.vocab[c] for c in byte_alphabet()]
        self.final = [self.vocab[c + self.end] for c in byte_alphabet()]
        self.memo_entries = memo_entries
        self.words: dict[str, bytes] = {}
        self.memo = _Memo(self._unit)

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            data = word.encode()
            symbols = [self.initial[b] for b in data[:-1]] + [self.final[data[-1]]]
            ids = self.words[word] = array("I", merge_by_tree(symbols, self.pairs)).tobytes()
        return ids

    def _unit(self, unit: str) -> bytes:
        """Ids of a run without white space, as little-endian unsigned 32-bit integers."""
        core = unit.rstrip(PUNCT) if unit.isascii() else ""
        if core.isalpha():
            data = self._word(core)
            return data + self._word(unit[len(core) :]) if len(core) < len(unit) else data
        if RARE.search(unit):
            return b"".join([self._word(unit[a:b]) for _, (a, b) in self.split(unit)])
        return b"".join(map(self._word, PRE_TOKEN.findall(unit)))

    def _plain(self, text: str) -> bytes:
        if text.isascii():
            text = text.lower()
        elif RARE.search(text):
            text = self.normalize(text)
        else:
            text = lower(unicodedata.normalize("NFC", text))
        units = [u for u in SPACES.split(text) if u] if SEPARATORS.search(text) else text.split()
        return b"".join(map(self.memo.__getitem__, units))

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if len(self.memo) > self.memo_entries:
            self.memo.clear()  # cheap to fill again while the words are known
        if len(self.words) > 2 * self.memo_entries:
            self.words.clear()
        if self.special is None or "<|" not in text and not self.special.search(text):
            return self._plain(text)
        out = []
        for k, part in enumerate(self.special.split(text)):
            if k % 2:
                out.append(self.specials[part].to_bytes(4, "little"))
            else:
                out.append(self._plain(part))
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return array("I", self.encode_bytes(text)).tolist()


class Decoder:
    """Decodes as the tokenizers library does with skip_special_tokens=False: the file names no decoder, so a space joins the tokens.

    Ids that the file doesn't have are left out.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        known = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.tokens = known

    def decode(self, ids: list[int]) -> str:
        try:
            return " ".join(map(self.tokens.__getitem__, ids))
        except KeyError:
            return " ".join([self.tokens[i] for i in ids if i in self.tokens])


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, keep_decoded: bool = False) -> DataFrame:
    """doc_id, the columns in keep, n_tokens, ids_sha256, decoded_sha256, ids array<int>, and with keep_decoded decoded.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers, decoded_sha256 over the UTF-8 of what they
    decode to: the column of ids is decoded in the same pass, so that no second worker is needed beside the encoder's. A
    null text counts as empty and has no ids; repeated rows give repeated results, an empty table none.
    """
    keep = keep or []
    data = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"__keep{i}") for i, c in enumerate(keep)])
    kept = "".join(f", __keep{i} {data.schema[f'__keep{i}'].dataType.simpleString()}" for i in range(len(keep)))
    schema = f"doc_id {data.schema['doc_id'].dataType.simpleString()}{kept}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids array<int>"
    if keep_decoded:
        schema += ", decoded string"

    def make():
        codec, decoder = worker_cache("codec", path, lambda: (WordBpe(path), Decoder(path)))

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for start, run in slices(batch.column(1)):
                ids = list(map(codec.encode_bytes, run))
                n = [len(x) // 4 for x in ids]
                part = batch.slice(start, len(run))
                found = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                back = list(map(decoder.decode, _lists(found)))
                digests = [pa.array([hashlib.sha256(x).hexdigest() for x in each], pa.string()) for each in (ids, map(str.encode, back))]
                columns = [part.column(0), *[part.column(2 + i) for i in range(len(keep))], pa.array(n, pa.int64()), *digests, found]
                names = ["doc_id", *[f"__keep{i}" for i in range(len(keep))], "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
                if keep_decoded:
                    columns.append(pa.array(back, pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return step

    out = arrow_map(data, make, schema)
    for i, c in enumerate(keep):
        out = out.withColumnRenamed(f"__keep{i}", c)
    return out


def _lists(ids: pa.ListArray) -> Iterator[list[int]]:
    """The lists of a column; null ones, and nulls in them, count as nothing."""
    flat = ids.flatten()
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
    if flat.null_count:
        yield from ([i for i in x or () if i is not None] for x in ids.to_pylist())
        return
    values, ends = flat.to_numpy(), np.cumsum(sizes).tolist()
    for a, z in zip([0, *ends], ends):
        yield values[a:z].tolist()


def decode_documents(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """rows with `decoded`: the text that ids_col stands for. Null ids count as none; without any the text is empty."""
    at = rows.columns.index(ids_col)
    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def make():
        decoder = worker_cache("decoder", path, lambda: Decoder(path))

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(map(decoder.decode, _lists(part.column(at)))), pa.string())], names=[*batch.schema.names, "decoded"])

        return step

    return arrow_map(rows, make, f"{fields}, decoded string")
