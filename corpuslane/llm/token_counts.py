"""Token counts by heap-and-linked-list byte-pair merging.

For every pre-token the lowest-rank adjacent pair is popped from a heap and its two nodes are joined in a
linked list; the count is the number of initial symbols less the number of merges, and no identifier is made.

A text is cut at each space before a non-space: such a space always opens a pre-token, so the pieces are
independent and their counts can be remembered by piece (a bounded memo per task).
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import MEMO_ENTRIES, arrow_map, slices, worker_cache

#: White space as the tokenizers library sees it (Unicode White_Space).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRE_TOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: From here on a character's class may differ between Unicode versions: the library itself splits such pieces.
RARE = "\u0530"
AFTER_SPACE = regex.compile(rf" (?=[^{SPACE}])")
DOUBLE_SPACE = regex.compile(rf" (?:[{SPACE}]|$)")
_ASCII_PAIRS = tuple(" " + c for c in " \t\n\x0b\x0c\r")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {}, 256
    for b in range(256):
        if b in keep:
            table[b] = chr(b)
        else:
            table[b] = chr(extra)
            extra += 1
    return [table[b] for b in range(256)]


def load_merges(path: str) -> tuple[dict[str, int], dict[int, tuple[int, int]], list[str]]:
    """(vocabulary, pair of ids as one integer -> (rank, merged id), special strings) of a tokenizers file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab = spec["model"]["vocab"]
    pairs: dict[int, tuple[int, int]] = {}
    for rank, pair in enumerate(spec["model"]["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        pairs[vocab[a] << 24 | vocab[b]] = (rank, vocab[a + b])
    return vocab, pairs, [t["content"] for t in spec["added_tokens"]]


def simple(text: str) -> bool:
    """Whether every space of the text stands before a non-space."""
    for pair in _ASCII_PAIRS:
        if pair in text:
            return False
    if text[-1:] == " ":
        return False
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return DOUBLE_SPACE.search(text) is None
    return "\xa0" not in text and "\x85" not in text


def pieces(text: str) -> list[str]:
    """The text cut at each space before a non-space; every piece but the first has lost that space."""
    return text.split(" ") if simple(text) else AFTER_SPACE.split(text)


def count_after_merges(symbols: list[int], pairs: dict[int, tuple[int, int]]) -> int:
    """Symbols left when the lowest-rank adjacent pair (leftmost of equals) is merged until none is known."""
    n = len(symbols)
    heap = []
    for i in range(n - 1):
        hit = pairs.get(symbols[i] << 24 | symbols[i + 1])
        if hit:
            heap.append((hit[0], i, hit[1]))
    if not heap:
        return n
    heapq.heapify(heap)
    sym, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    merges = 0
    while heap:
        rank, i, merged = heapq.heappop(heap)
        j = after[i]
        if sym[i] < 0 or j >= n:
            continue
        hit = pairs.get(sym[i] << 24 | sym[j])
        if hit is None or hit[0] != rank:
            continue
        merges += 1
        sym[i], sym[j] = merged, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            hit = pairs.get(merged << 24 | sym[k])
            if hit:
                heapq.heappush(heap, (hit[0], i, hit[1]))
        h = before[i]
        if h >= 0:
            hit = pairs.get(sym[h] << 24 | merged)
            if hit:
                heapq.heappush(heap, (hit[0], h, hit[1]))
    return n - merges


class _Memo(dict):
    """Piece -> count, worked out when first asked for."""

    def __init__(self, work: Callable[[str], int]):
        super().__init__()
        self.work = work

    def __missing__(self, key: str) -> int:
        self[key] = n = self.work(key)
        return n


class TokenCounter:
    """Counts as the tokenizers library gives them for a byte-level BPE file, without added special tokens.

    Special strings inside a text count as one token each, as by the library's default.
    """

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        vocab, self.pairs, specials = load_merges(path)
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.initial = [vocab[c] for c in byte_alphabet()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.marks = specials
        self.memo_entries = memo_entries
        self.words: dict[str, int] = {}
        self.memo = _Memo(lambda piece: self._pre_tokens(" " + piece))

    def _pre_tokens(self, text: str) -> int:
        total, words = 0, self.words
        if text.isascii() or max(text) < RARE:
            parts = PRE_TOKEN.findall(text)
        else:
            parts = [text[a:z] for _, (a, z) in self.split(text)]
        for w in parts:
            n = words.get(w)
            if n is None:
                initial = self.initial
                n = words[w] = count_after_merges([initial[b] for b in w.encode()], self.pairs)
            total += n
        return total

    def _plain(self, text: str) -> int:
        if not text:
            return 0
        first, *rest = pieces(text)
        return self._pre_tokens(first) + sum(map(self.memo.__getitem__, rest))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self.memo) > self.memo_entries:
            self.memo.clear()  # cheap to fill again while the words are known
        if len(self.words) > 2 * self.memo_entries:
            self.words.clear()
        if self.special and any(m in text for m in self.marks):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self._plain, parts))
        return self._plain(text)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; a null or empty text has 0 of both. Other columns don't matter.

    Repeated rows give repeated results; an empty table gives none.
    """
    data = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = data.schema["doc_id"].dataType.simpleString()

    def make():
        counter = worker_cache("counter", path, lambda: TokenCounter(path))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts: list[int] = []
            for _, run in slices(batch.column(1)):
                counts += map(counter.count, run)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

        return step

    data = data.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"))
    out = arrow_map(data, make, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
