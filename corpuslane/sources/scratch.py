"""Where intermediate and working tables go."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from atexit import register

from pyspark.sql import SparkSession

_BASES: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """A new path in the folder named by spark.checkpoint.dir, which all machines share.

    Where that is unset, in the warehouse folder, or on a local master, where no other machine reads it, in a temporary
    one. What was written goes when the driver ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    key = f"{spark.sparkContext.applicationId} {shared}"
    if key not in _BASES:
        master = spark.sparkContext.master
        if not shared and (master == "local" or master.startswith("local[")):
            _BASES[key] = tempfile.mkdtemp(prefix="corpuslane-")
            register(shutil.rmtree, _BASES[key], True)
        else:
            folder = (shared or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch").rstrip("/")
            _BASES[key] = f"{folder}/{spark.sparkContext.applicationId}"
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_BASES[key])
            fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            fs.mkdirs(path)
            fs.deleteOnExit(path)
    return f"{_BASES[key]}/{uuid.uuid4().hex}"
