"""URLs a stream has seen, in hash buckets, so that a micro-batch reads the buckets of its own URLs and no others.

A history is a Parquet table partitioned by ``bucket``; the files carry Bloom filters on ``url``. What a micro-batch asks for
is at most ``BUCKETS`` numbers, which become a partition filter. Rows are appended by one writer; ``rewritten`` joins the small
files that many batches leave.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkshelf.sources.writers import read_or_empty

BUCKETS = 64


def bucket_of(url: str = "url", buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(url)), F.lit(buckets)).cast("int")


def history(spark: SparkSession, path: str, schema: str, of: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The rows of the history at ``path``; with ``of``, those of the buckets its URLs fall in."""
    table = read_or_empty(spark, path, f"{schema}, bucket int")
    if of is None:
        return table.drop("bucket")
    wanted = [r[0] for r in of.select(bucket_of(buckets=buckets)).distinct().collect()]  # at most ``buckets`` numbers
    return table.filter(F.col("bucket").isin(wanted)).drop("bucket")


def unseen(rows: DataFrame, path: str, schema: str, buckets: int = BUCKETS) -> DataFrame:
    """The ``rows`` whose URL the history at ``path`` lacks."""
    return rows.join(history(rows.sparkSession, path, schema, rows, buckets).select("url"), "url", "left_anti")


def append(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Append rows to their buckets, each bucket from one task."""
    bucketed = rows.withColumn("bucket", bucket_of(buckets=buckets)).repartition("bucket")
    (bucketed.write.mode("append").partitionBy("bucket")
     .option("parquet.bloom.filter.enabled#url", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path))


def rewritten(spark: SparkSession, path: str, target: str, buckets: int = BUCKETS) -> None:
    """The history at ``path`` as a new one at ``target``, with the files of each bucket joined and sorted by URL."""
    rows = spark.read.parquet(path).repartition("bucket").sortWithinPartitions("bucket", "url")
    rows.write.partitionBy("bucket").option("parquet.bloom.filter.enabled#url", "true").parquet(target)
