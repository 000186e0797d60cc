"""Spreading of rows over the cores before work that is heavy for its bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Tasks for each core, so that the cores end at about the same time.
TASKS_A_CORE = 4


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows by the hash of a key that few rows share, in TASKS_A_CORE tasks for each core.

    Files are cut by bytes, so a small table of many rows is read by one task, and what follows runs on one core. The
    number is fixed: adaptive execution would join the small partitions again.
    """
    return rows.repartition(TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism, key)
