"""Python workers must be able to import this package."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch, or one row. The JVM and the worker each hold one or two a task beside all else; 64 MB by Spark's default.
BATCH_BYTES = 8 << 20

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def reachable(spark: SparkSession) -> SparkSession:
    """Put the package's folder on the workers' path. On a cluster the folder is installed or shipped to the same place.

    Also keeps unions from claiming the partitioning of their inputs, see ``linkshelf.operators.sets``, and Arrow batches small.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(p for p in (_ROOT, *paths) if p)
    return spark
