"""Incremental harvest: new files of a folder are diffed against the index and upserted, once for each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.harvest import diff_changed, upsert


def run(spark: SparkSession, source: str, schema: StructType, index: str, checkpoint: str, key: str = "url", date: str = "last_update") -> int:
    """Apply all files that source got since the last run to the Parquet index; returns the number of batches.

    The index is a folder of versions, of which the highest whole one holds. A batch that is run again writes its own
    version again, so a restart changes nothing.
    """
    done = []

    def apply(batch: DataFrame, number: int) -> None:
        old = latest(spark, index, schema, before=number)
        changed = diff_changed(batch, old, key, date).select(*[f.name for f in schema.fields])
        upsert(old, changed, key, date).write.mode("overwrite").parquet(f"{index}/v={number:08d}")
        done.append(number)

    stream = spark.readStream.schema(schema).parquet(source)
    q = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return len(done)


def latest(spark: SparkSession, index: str, schema: StructType, before: int | None = None) -> DataFrame:
    """The last version that was written whole (before a batch); an empty table where there is none."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(index)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    whole = sorted(n for n in names if n.startswith("v=") and (before is None or int(n[2:]) < before) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{index}/{n}/_SUCCESS")))
    return spark.read.schema(schema).parquet(f"{index}/{whole[-1]}") if whole else spark.createDataFrame([], schema)
