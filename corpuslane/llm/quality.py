"""Quality by hierarchical empirical Bayes.

A logistic model of a document's own text gives evidence. Expected good documents are summed by host and by path; a
path's rate is shrunk toward its host's, a host's toward the global one, with strengths estimated from the spread of
the rates (method of moments). A document's posterior log-odds are its evidence moved from the global prior to that of
its path, from which its own contribution is left out.

The classifier is fitted on at most MOST_ROWS labelled rows (those of least hash); all rates cover all documents.
"""

from __future__ import annotations

import zlib
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, join_counted, materialize
from .toxicity import fit_logistic, fold

MOST_ROWS = 20000
N = 12
_MARKS = str.maketrans("", "", "!|#$%&*=<>{}[]~^")
_DIGITS = str.maketrans("", "", "0123456789")


def features(text: str | None) -> list[float]:
    """Of a text: how long, varied, repetitive, loud, marked, and compressible it is."""
    text = text or ""
    words = text.split()
    n, size = len(words), max(len(text), 1)
    if not n:
        return [0.0] * N
    kinds = len(set(words))
    repeats = sum(map(eq, words, words[1:]))
    loud = sum(map(str.isupper, words))
    raw = text.encode()
    packed = len(zlib.compress(raw, 1)) / len(raw)
    lines = text.split("\n")
    bare = sum(not w.isalnum() and not any(map(str.isalnum, w)) for w in set(words)) / kinds
    return [np.log1p(n), kinds / n, repeats / n, loud / n, (size - len(text.translate(_MARKS))) / size, (size - len(text.translate(_DIGITS))) / size, size / n, packed, len(set(lines)) / len(lines), np.log1p(size / len(lines)), bare, float(n < 20)]


def _evidence(docs: DataFrame, beta: tuple | None) -> DataFrame:
    """doc columns with f (features) or, with a model, z (log-odds)."""
    columns = [c for c in docs.columns if c != "text"]
    at = docs.columns.index("text")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([features(t.as_py()) for t in batch.column(at)], float).reshape(-1, N)
            kept = [batch.column(docs_columns.index(c)) for c in columns]
            if beta is None:
                return pa.RecordBatch.from_arrays([*kept, pa.array(x.tolist(), pa.list_(pa.float64()))], names=[*columns, "f"])
            mean, scale, b = beta
            z = np.clip((x - mean) / scale @ b[:-1] + b[-1], -12, 12)
            return pa.RecordBatch.from_arrays([*kept, pa.array(z)], names=[*columns, "z"])

        return step

    docs_columns = docs.columns
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return arrow_map(docs, make, f"{fields}, " + ("f array<double>" if beta is None else "z double"))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most_rows: int = MOST_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic model of the text alone, from labelled rows outside fold 0; a constant 0.5 without labels of both classes."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("y")).dropna()
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).filter(F.col("y").isin(0, 1) & (fold(F.col("doc_id")) != 0))
    picked = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows))  # a proven bound
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(picked, "doc_id").select("y", "text")
    rows = _evidence(sample, None).toArrow()
    y = np.array(rows["y"].to_pylist(), float)
    if len(y) < 10 or len(set(y)) < 2:
        return np.zeros(N), np.ones(N), np.zeros(N + 1)
    x = np.array(rows["f"].to_pylist(), float)
    return fit_logistic(x, y, np.ones(len(y)))


def _strength(groups: DataFrame, rate: str, prior: str) -> float:
    """Method-of-moments strength of a beta prior: how many documents the parent's rate is worth."""
    d = F.col(rate) - F.col(prior)
    row = groups.filter("n > 0").agg(F.sum(F.col("n") * d * d), F.sum("n"), F.count("*"), F.sum(F.col("n") * F.col(prior) * (1 - F.col(prior)))).first()
    spread, n, k, noise = row
    if not n or k < 2:
        return 10.0
    within = noise / n
    # E[sum n d^2] = k * within + n * between, about
    between = max((spread - k * within) / n, 1e-9)
    return float(min(max(within / between - 1, 1.0), 1e6))


def quality(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score (posterior of good quality), predicted (1 if score >= 0.5), evidence, host_rate, path_rate.

    Null hosts form one host, null paths one path of their host. A null or empty text has the evidence of no words.
    Repeated rows count each. held_out is false for a null id.
    """
    beta = fit(docs, labels, label_col)
    data = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("")).alias("host"), F.coalesce(F.concat(F.lit("="), F.col(path_col).cast("string")), F.lit("")).alias("path"))
    scored = materialize(_evidence(data, beta))
    p = 1 / (1 + F.exp(-F.col("z")))
    paths = materialize(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.round(p, 9).cast("decimal(20,9)")).cast("double").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n"), F.sum("s")).first()
    mean = min(max((total[1] or 0.0) / total[0], 1e-4), 1 - 1e-4) if total[0] else 0.5
    host_k = _strength(hosts.select("n", (F.col("s") / F.col("n")).alias("r"), F.lit(mean).alias("m")), "r", "m")
    hosts = hosts.select("host", ((F.col("s") + host_k * mean) / (F.col("n") + host_k)).alias("host_rate"))
    paths = materialize(paths.join(hosts, "host"))
    path_k = _strength(paths.select("n", (F.col("s") / F.col("n")).alias("r"), "host_rate"), "r", "host_rate")
    # a hot site's rows are spread
    joined = join_counted(scored, paths.withColumn("__n", F.col("n")), ["host", "path"], scored.count(), F.xxhash64("doc_id"), "inner", "__n")
    rate = (F.greatest(F.col("s") - p, F.lit(0.0)) + path_k * F.col("host_rate")) / (F.col("n") - 1 + path_k)
    rate = F.least(F.greatest(rate, F.lit(1e-4)), F.lit(1 - 1e-4))
    joined = joined.withColumn("path_rate", rate)
    odds = F.col("z") + F.log(F.col("path_rate") / (1 - F.col("path_rate"))) - float(np.log(mean / (1 - mean)))
    out = joined.withColumn("score", 1 / (1 + F.exp(-odds))).withColumn("evidence", p)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "evidence", "host_rate", "path_rate")
