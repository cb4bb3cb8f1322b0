"""The folder that a cluster's driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A subfolder, one for each application, of the folder in ``spark.checkpoint.dir``.

    Only where that is unset and the session is local (tests, a laptop) a
    temporary folder is taken and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tideline-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/tideline-{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete what was written to the folder in this application; for the end of a job, when results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
