"""Toxicity by class-conditional Kneser-Ney models.

Two models, of toxic and of ordinary documents, predict each character of a word from the ORDER - 1 before it. Their
top order has class counts with absolute discount; below it both share one Kneser-Ney model of pooled continuation
counts, so what a class hasn't seen costs it no more than the backoff mass. A document is compared by the difference of its two
log-likelihoods per character, over all its words, in which the shared probabilities of what neither class has seen
cancel; and by the differences of its most toxic words. A logistic model fitted on labelled rows outside the language
models' turns these into a probability.

The language models count every n-gram of every labelled row of their folds, by shuffles; their ratios are written as
a file sorted by 64-bit hashes of the n-grams that workers map into memory, so no table of n-grams is held by the driver
or broadcast. Only the logistic
model is fitted on a sample: at most MOST_ROWS labelled rows a class of the last fold (those of least hash). Scoring
covers every whole text.
"""

from __future__ import annotations

import math
import os
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import MEMO_ENTRIES, arrow_map, materialize, slices, worker_cache

ORDER, DISCOUNT, MOST_ROWS = 6, 0.75, 8000
#: What ends a context's key, which no word holds.
CONTEXT = "\x01"
FOLDS = 5
_WORDS = re.compile(r"\w+")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def ngrams(word: str) -> list[str]:
    """Every character of the bounded word with up to ORDER - 1 before it."""
    w = f"\x02{word}\x03"
    return [w[max(0, i - ORDER + 1) : i + 1] for i in range(1, len(w))]


def ratio_table(counts: DataFrame) -> DataFrame:
    """(key, ratio) from counts (gram, t, o), by joins: n-grams, and contexts with CONTEXT at their end."""
    counts = counts.withColumn("size", F.length("gram"))
    tails = lambda text, first: F.explode(F.transform(F.sequence(F.lit(first), F.length(text)), lambda i: F.substring(text, i, F.lit(ORDER))))
    # every n-gram of two characters or more that ends a counted one
    longer = materialize(counts.select(tails(F.col("gram"), 1).alias("gram")).filter(F.length("gram") > 1).distinct())
    # continuation counts; nothing stands before a word's start, so its n-grams count as such
    shared = longer.select(F.expr("substring(gram, 2)").alias("tail")).groupBy("tail").agg(F.count("*").alias("c"))
    shared = shared.unionByName(longer.filter(F.col("gram").startswith("\x02") & (F.length("gram") < ORDER)).select(F.col("gram").alias("tail"), F.lit(1).cast("bigint").alias("c")))
    follow = Window.partitionBy(F.expr("substring(tail, 1, length(tail) - 1)"))
    shared = shared.withColumn("total", F.sum("c").over(follow)).withColumn("kinds", F.count("*").over(follow))
    shared = materialize(shared.select("tail", (F.greatest(F.col("c") - DISCOUNT, F.lit(0.0)) / F.col("total")).alias("own"), (DISCOUNT * F.col("kinds") / F.col("total")).alias("left")))
    alphabet = shared.filter(F.length("tail") == 1).count() + 1
    base = F.when(F.col("size") == ORDER, F.expr("substring(gram, 2)")).otherwise(F.col("gram"))
    steps = counts.select("gram", base.alias("base")).select("gram", tails(F.col("base"), 1).alias("tail")).join(shared, "tail")
    steps = steps.groupBy("gram").agg(F.sort_array(F.collect_list(F.struct(F.length("tail").alias("size"), "own", "left"))).alias("steps"))
    low = steps.select("gram", F.aggregate("steps", F.lit(1.0 / alphabet), lambda p, x: x["own"] + x["left"] * p).alias("low"))
    of = Window.partitionBy("context")
    known = counts.join(low, "gram").withColumn("context", F.expr("substring(gram, 1, size - 1)"))
    known = known.select("gram", "t", "o", "low", "context", F.sum("t").over(of).alias("nt"), F.sum("o").over(of).alias("no"), F.count_if(F.col("t") > 0).over(of).alias("kt"), F.count_if(F.col("o") > 0).over(of).alias("ko"))
    known = materialize(known)

    def seen(n: str, total: str, kinds: str) -> Column:
        p = (F.greatest(F.col(n) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(kinds) * F.col("low")) / F.col(total)
        return F.log(F.when(F.col(total) > 0, p).otherwise(F.col("low")))

    unseen = lambda total, kinds: F.when(F.col(total) > 0, F.log(DISCOUNT * F.col(kinds) / F.col(total))).otherwise(0.0)
    grams = known.select(F.col("gram").alias("key"), (seen("t", "nt", "kt") - seen("o", "no", "ko")).alias("ratio"))
    contexts = known.select(F.concat("context", F.lit(CONTEXT)).alias("key"), (unseen("nt", "kt") - unseen("no", "ko")).alias("ratio")).dropDuplicates(["key"])
    return grams.unionByName(contexts)


def _terms(codes: np.ndarray, distance: int) -> np.ndarray:
    """What characters add to the hash of an n-gram that ends `distance` after them."""
    x = codes + np.uint64((distance + 1) << 32)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(texts: list[str], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the n-gram of at most `longest` characters that ends at each character, end of each text) of texts set end to end."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    inside = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    h = np.zeros(len(codes), np.uint64)
    for distance in range(longest):
        on = np.nonzero(inside >= distance)[0]
        h[on] += _terms(codes[on - distance], distance)
    return h, ends


#: Added to the hash of a context.
_MARK = np.uint64(0x9E3779B97F4A7C15)


def key_hashes(keys: list[str]) -> np.ndarray:
    """Of n-grams, and contexts with CONTEXT at their end (an empty one is CONTEXT alone)."""
    marked = np.array([k[-1:] == CONTEXT for k in keys], bool)
    h, ends = hashes([k.removesuffix(CONTEXT) for k in keys], ORDER)
    sizes = np.diff(ends, prepend=0)
    own = np.zeros(len(keys), np.uint64)
    own[sizes > 0] = h[ends[sizes > 0] - 1]
    return np.where(marked, own + _MARK, own).view(np.int64)


@dataclass
class Written:
    """A file that every executor has a copy of (SparkFiles): `rows` hashes in ascending order, then their ratios."""

    name: str
    rows: int

    def lookup(self) -> Lookup:
        return Lookup(SparkFiles.get(self.name), self.rows)


def write_ratios(table: DataFrame) -> Written:
    """Hand (key, ratio) to the executors as a sorted file; the driver passes on one partition at a time."""
    spark = table.sparkSession

    def make_hashed():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key_hashes(batch.column(0).to_pylist())), batch.column(1)], names=["h", "ratio"])

        return step

    hashed = materialize(arrow_map(table.select("key", "ratio"), make_hashed, "h bigint, ratio double"))
    model = Written(f"toxicity-{uuid.uuid4().hex}", hashed.count())

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), *[pa.array([c.to_numpy().tobytes()], pa.binary()) for c in batch.columns]], names=["n", "keys", "ratios"])

        return step

    path, at = os.path.join(spark.sparkContext._temp_dir, model.name), 0
    with open(path, "wb") as f:
        for block in arrow_map(hashed.orderBy("h"), make, "n bigint, keys binary, ratios binary").toLocalIterator():
            f.seek(at * 8)
            f.write(block.keys)
            f.seek((model.rows + at) * 8)
            f.write(block.ratios)
            at += block.n
    spark.sparkContext.addFile(path)
    return model


class Lookup:
    """The ratios of a written model, mapped into memory."""

    def __init__(self, path: str, rows: int):
        self.keys = np.memmap(path, "<i8", "r", 0, (rows,)) if rows else np.zeros(0, np.int64)
        self.ratios = np.memmap(path, "<f8", "r", rows * 8, (rows,)) if rows else np.zeros(0)

    def find(self, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ratio of each hash (0 where there is none), and whether there is one."""
        if not len(self.keys) or not len(sought):
            return np.zeros(len(sought)), np.zeros(len(sought), bool)
        at = np.minimum(np.searchsorted(self.keys, sought), len(self.keys) - 1)
        found = self.keys[at] == sought
        return np.where(found, self.ratios[at], 0.0), found

    def words(self, words: list[str]) -> list[float]:
        """Ratio of each word: of its n-grams that are known, else of their contexts."""
        if not words:
            return []
        bounded = [f"\x02{w}\x03" for w in words]
        whole, ends = hashes(bounded, ORDER)
        before, _ = hashes(bounded, ORDER - 1)
        starts = np.concatenate([[0], ends[:-1]])
        each = np.ones(len(whole), bool)
        each[starts] = False  # a word's start follows nothing
        ratios, found = self.find(whole[each].view(np.int64))
        missing = np.nonzero(~found)[0]
        ratios[missing] = self.find((before[np.nonzero(each)[0][missing] - 1] + _MARK).view(np.int64))[0]
        return np.add.reduceat(ratios, starts - np.arange(len(words))).tolist()


class Scorer:
    """Features of a text: difference of the log-likelihoods per character (a word's end counts as one) of all its words,
    that of its most toxic word, mean of its three most toxic distinct units, log of the number of distinct units.

    Units are what stands between white space; each is scored by all its words, and the most toxic of them counts.
    """

    def __init__(self, ratios: Lookup, memo_entries: int = MEMO_ENTRIES):
        self.ratios, self.memo_entries = ratios, memo_entries
        self.memo: dict[str, int] = {}
        self.sums, self.sizes, self.tops = array("d"), array("q"), array("d")

    def _learn(self, new: list[str]) -> None:
        words = [_WORDS.findall(u) for u in new]
        distinct = list({w for x in words for w in x})
        of = dict(zip(distinct, self.ratios.words(distinct)))
        for u, x in zip(new, words):
            self.memo[u] = len(self.sums)
            own = [of[w] for w in x]
            self.sums.append(math.fsum(own))
            self.sizes.append(sum(map(len, x)) + len(x))
            self.tops.append(max(own, default=0.0))

    def features(self, texts: list[str]) -> list[tuple[float, float, float, float]]:
        if len(self.memo) > self.memo_entries:
            self.memo, self.sums, self.sizes, self.tops = {}, array("d"), array("q"), array("d")
        units = [t.lower().split() for t in texts]
        self._learn(list(set().union(*units).difference(self.memo)) if units else [])
        sums, sizes, tops = (np.array(x) for x in (self.sums, self.sizes, self.tops))
        get = self.memo.__getitem__
        return [self._row(np.fromiter(map(get, u), np.int64, len(u)), sums, sizes, tops) for u in units]

    @staticmethod
    def _row(at: np.ndarray, sums: np.ndarray, sizes: np.ndarray, tops: np.ndarray) -> tuple[float, float, float, float]:
        if not len(at):
            return 0.0, 0.0, 0.0, 0.0
        kinds = np.unique(at)
        top = tops[kinds]
        if len(top) > 3:
            top = np.partition(top, -3)[-3:]
        return float(sums[at].sum() / max(int(sizes[at].sum()), 1)), float(top.max()), math.fsum(top) / len(top), math.log1p(len(kinds))

    def column(self, texts: pa.Array) -> list[tuple[float, float, float, float]]:
        return [row for _, run in slices(texts) for row in self.features(run)]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, coefficients with the constant last) by Newton's method with a ridge."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    beta = np.zeros(z.shape[1])
    penalty = ridge * np.r_[np.ones(z.shape[1] - 1), 1e-6]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (weight * (y - p)) - penalty * beta
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, beta


@dataclass
class Model:
    ratios: Written
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = (features - self.mean) / self.scale @ self.beta[:-1] + self.beta[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _features(data: DataFrame, ratios: Written) -> DataFrame:
    """doc_id, f0 .. f3 of (doc_id, text)."""
    id_type = data.schema["doc_id"].dataType.simpleString()

    def make():
        scorer = worker_cache("toxicity", ratios.name, lambda: Scorer(ratios.lookup()))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = scorer.column(batch.column(1))
            columns = list(zip(*rows)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.float64()) for c in columns]], names=["doc_id", "f0", "f1", "f2", "f3"])

        return step

    return arrow_map(data, make, f"doc_id {id_type}, f0 double, f1 double, f2 double, f3 double")


def count_ngrams(rows: DataFrame) -> DataFrame:
    """(gram, t, o): in how many toxic and ordinary rows of (text, y) each n-gram occurs, once for each distinct word and place."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            labels = batch.column(1).to_pylist()
            for start, run in slices(batch.column(0)):
                counts: Counter = Counter()
                for text, y in zip(run, labels[start:]):
                    counts.update([(w, y) for w in set(_WORDS.findall(text.lower()))])
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["word", "y", "n"])

        return step

    of = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0))
    words = arrow_map(rows.select("text", "y"), make, "word string, y int, n bigint").groupBy("word").agg(of(1).alias("t"), of(0).alias("o"))
    w = F.concat(F.lit("\x02"), "word", F.lit("\x03"))
    grams = F.transform(F.sequence(F.lit(2), F.length(w)), lambda i: F.substring(w, F.greatest(i - ORDER + 1, F.lit(1)), F.least(i, F.lit(ORDER))))
    return words.select(F.explode(grams).alias("gram"), "t", "o").groupBy("gram").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most_rows: int = MOST_ROWS) -> Model:
    """Fit on labelled rows outside fold 0: all of folds 1 to 3 for the language models, at most most_rows a class of fold 4 for the logistic model.

    labels (doc_id, label_col): rows with a null in either are left out; of several labels of an id the largest holds.
    Without labels of both classes every score is the share of toxic labels (0.5 without any).
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("y")).dropna()
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).filter(F.col("y").isin(0, 1)).withColumn("fold", fold(F.col("doc_id"))).filter("fold <> 0")
    of_class = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.col("text").isNotNull())
    # both sides grow with the input: no hint
    counted = count_ngrams(texts.filter(fold(F.col("doc_id")).between(1, 3)).join(known.filter("fold < 4").select("doc_id", "y"), "doc_id"))
    ratios = write_ratios(ratio_table(materialize(counted)))
    picks = [known.filter((F.col("fold") == 4) & (F.col("y") == y)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows) for y in (0, 1)]
    # at most 2 x most_rows ids: a proven bound
    held = materialize(texts.join(F.broadcast(picks[0].unionByName(picks[1]).select("doc_id", "y")), "doc_id"))
    rows = _features(held.select("doc_id", "text"), ratios).join(F.broadcast(held.select("doc_id", "y").distinct()), "doc_id").toArrow()
    y = np.array(rows["y"].to_pylist(), float)
    all_rows = sum(of_class.values())
    if len(y) < 10 or len(set(y)) < 2:
        share = of_class.get(1, 0) / all_rows if all_rows else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(ratios, np.zeros(4), np.ones(4), np.array([0, 0, 0, 0, math.log(share / (1 - share))]))
    x = np.c_[tuple(np.array(rows[f"f{i}"].to_pylist(), float) for i in range(4))]
    # the sample may hold more of one class than the labels do
    weight = np.where(y == 1, of_class.get(1, 0) / (y == 1).sum(), of_class.get(0, 0) / (y == 0).sum())
    return Model(ratios, *fit_logistic(x, y, weight * len(y) / weight.sum()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.5) of every row; a null or empty text gets the score of no words."""
    found = _features(docs.select("doc_id", "text"), model.ratios)
    z = F.lit(float(model.beta[-1]))
    for i in range(4):
        z = z + (F.col(f"f{i}") - float(model.mean[i])) / float(model.scale[i]) * float(model.beta[i])
    p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    return found.select("doc_id", p.alias("score")).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs; held_out is false for a null id.

    A null or empty text gets the score of no words; repeated rows get repeated results, an empty table none. Without
    labels of both classes every score is the share of toxic labels. Columns of any name may stand beside the text.
    """
    model = fit(docs, labels, label_col)
    return score(docs, model).withColumn("held_out", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))).select("doc_id", "held_out", "score", "predicted")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below threshold, with all their columns, in one pass and without a shuffle.

    Null and empty texts have the score of no words; equal texts share their fate; an empty table stays empty.
    """
    at = docs.columns.index("text")

    def make():
        scorer = worker_cache("toxicity", model.ratios.name, lambda: Scorer(model.ratios.lookup()))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = np.array(scorer.column(batch.column(at)), float).reshape(-1, 4)
            return batch.filter(pa.array(model.probability(rows) < threshold))

        return step

    return arrow_map(docs, make, docs.schema)
