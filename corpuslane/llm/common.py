"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_dir

#: Characters of text that one task holds as Python words at once.
SLICE_CHARS = 1_000_000
#: Entries of a worker's memo before it starts anew.
MEMO_ENTRIES = 250_000
#: ASCII white space of the word contracts: space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: A key with more than 1 / HOT_SHARE of all rows is hot, so there are fewer than HOT_SHARE such keys.
HOT_SHARE = 1000

def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = path or scratch_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def slices(column: pa.Array, limit: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) in runs of about `limit` characters; null becomes the empty text.

    Only a run's texts exist as Python strings at a time.
    """
    start, size, run = 0, 0, []
    for at in range(0, len(column), 256):
        for i, t in enumerate(column.slice(at, 256).to_pylist(), at):
            t = t or ""
            if run and size + len(t) > limit:
                yield start, run
                start, size, run = i, 0, []
            run.append(t)
            size += len(t)
    if run:
        yield start, run


_WORKER: dict = {}


def worker_cache(slot: str, token: str, make: Callable[[], object]):
    """What `make()` gave first for slot and token in this Python worker, whose later tasks find it filled.

    A worker keeps one such thing, that of its latest stage, so stages don't add up in memory.
    """
    if (slot, token) not in _WORKER:
        _WORKER.clear()
        _WORKER[slot, token] = make()
    return _WORKER[slot, token]


#: Bytes of an Arrow batch in the registered queries and the pipeline: texts, their batch in the JVM and its copy in the
#: worker then stay small beside the heap.
BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """For an application to call once: Arrow batches of BATCH_BYTES. Operators leave the session's settings alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow whose state `make()` is built once a task; its step gives one batch or yields several.

    Spark bounds a batch by bytes (spark.sql.execution.arrow.maxBytesPerBatch), so long texts come few at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for b in batches:
            out = step(b)
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out
        # a worker waits beside the JVM's next stages: what its batches took goes back
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def join_counted(left: DataFrame, right: DataFrame, on: str | list[str], total: int, spread: Column, how: str = "inner", count: str = "n", share: int = HOT_SHARE) -> DataFrame:
    """Join of left with right, which has one row a key and in `count` the number of left's rows with it, of `total` in all.

    Hot keys, those of more than total / share rows, are fewer than `share`. They alone are broadcast, and their rows of
    left are spread by the hash `spread` over so many copies of right's row that no key of the join has more than about
    that part of the rows; the copies are fewer than 2 x share. `count` isn't in the result.
    """
    on = [on] if isinstance(on, str) else on
    salts = F.ceil(F.col(count) * share / max(total, 1)).cast("int")
    hot = F.col(count) * share > total
    # fewer than `share` rows of keys: a proven bound
    few = F.broadcast(right.filter(hot).select(*on, salts.alias("__salts")))
    salted = left.join(few, on, "left").withColumn("__salt", F.when(F.col("__salts").isNull(), 0).otherwise(F.pmod(spread, F.col("__salts")).cast("int"))).drop("__salts")
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.when(hot, salts - 1).otherwise(0)))).drop(count)
    return salted.join(copies, [*on, "__salt"], how).drop("__salt")


def looked_up(left: DataFrame, on: str, table: DataFrame, spread: Column) -> DataFrame:
    """left with the columns of table, which has at most one row a value of `on`; null where it has none, or the value is null."""
    counts = left.filter(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("n"))
    return join_counted(left, counts.join(table, on, "left"), on, left.count(), spread, "left")
