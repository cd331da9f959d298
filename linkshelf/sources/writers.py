"""Sinks. Every append is preceded by an anti-join on its key, so a replay adds nothing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkshelf.functions.urls import url_hash
from linkshelf.operators.ordered import last_by, running_sums
from linkshelf.operators.registry import new_events


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, or an empty one before its first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_events(events: DataFrame, path: str, schema: str) -> DataFrame:
    """Append the events the ledger at ``path`` lacks; returns what was new. Single writer."""
    fresh = new_events(events, read_or_empty(events.sparkSession, path, schema))
    fresh.write.mode("append").parquet(path)
    return fresh


def append_cards(cards: DataFrame, path: str, schema: str) -> None:
    """Append cards whose URL is not stored yet."""
    stored = read_or_empty(cards.sparkSession, path, schema)
    cards.dropDuplicates(["url"]).join(stored.select("url"), "url", "left_anti").write.mode("append").parquet(path)


def state_rows(updates: DataFrame, latest: DataFrame) -> DataFrame:
    """State log rows to append: attempts not given carry over from the latest row."""
    before = latest.select("url", F.col("attempts").alias("previous"))
    return updates.join(before, "url", "left").withColumn(
        "attempts", F.coalesce("attempts", "previous", F.lit(0))
    ).drop("previous")


def cache_rows(rows: DataFrame, stage: str) -> DataFrame:
    """Stage cache rows keyed by URL hash from ``rows(url, version, prompt_version, payload)``."""
    return rows.select(url_hash(F.col("url")).alias("url_hash"), F.lit(stage).alias("stage"), "version", "prompt_version", "payload")


def latest_cache(cache: DataFrame) -> DataFrame:
    """Current cache content: the newest version of each key and stage, cleared keys left out.

    A tombstone has the version it clears, and hides that one and all before it.
    """
    at = cache.withColumn("__at", F.struct("version", F.col("payload").isNull()))
    current = last_by(at, ["url_hash", "stage"], "__at", ["version", "prompt_version", "payload"])
    return current.filter(F.col("payload").isNotNull())


def cleared(urls: DataFrame, stages: list[str], cache: DataFrame) -> DataFrame:
    """Tombstones for what ``cache`` holds of the given URLs in the given stages; a later version shows again."""
    newest = cache.filter(F.col("stage").isin(stages)).groupBy("url_hash", "stage").agg(F.max("version").alias("version"))
    gone = newest.join(urls.select(url_hash(F.col("url")).alias("url_hash")).distinct(), "url_hash", "left_semi")
    none = F.lit(None).cast("string")
    return gone.select("url_hash", "stage", "version", none.alias("prompt_version"), none.alias("payload"))


def write_table_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_json_arrays(
    rows: DataFrame, path: str, order: str, head: Column | None = None, tail: Column | None = None, block_bytes: int = 8 << 20,
) -> None:
    """``rows`` in ``order`` as files that hold one JSON array each, a record a line; ``order`` itself isn't written.

    A file takes the records that start in the same ``block_bytes`` of the whole, so it is longer by one record at most.
    Records stay rows up to the file: no list of them is built. ``head`` and ``tail`` stand before and after the records
    and may depend on ``block``, the number of the file.
    """
    text = rows.select(order, F.to_json(F.struct(*[c for c in rows.columns if c != order])).alias("value"))
    size = F.octet_length("value").cast("bigint")
    placed = running_sums(text, [], order, {"end": size}).withColumn("block", F.floor((F.col("end") - size) / block_bytes))
    inside = Window.partitionBy("block").orderBy(order)
    ends = placed.withColumns({"first": F.row_number().over(inside) == 1, "last": F.lead("value").over(inside).isNull()})
    line = F.concat(
        F.when(F.col("first"), F.lit("[") if head is None else head).otherwise(","), "value",
        F.when(F.col("last"), F.lit("]") if tail is None else tail).otherwise(""))
    ends.select("block", line.alias("value")).write.partitionBy("block").text(path)


def run_report(results: DataFrame) -> DataFrame:
    """One text line per processed item.

    ``tries`` is set where an item was given up after failed attempts, not found gone at once.
    """
    line = (
        F.when((F.col("status") == "unavailable") & (F.col("tries") > 0), F.format_string(
            "- UNAVAILABLE after %d tries `%s`: %s", F.col("tries"), F.col("url"), F.col("detail")))
        .when(F.col("status") == "unavailable", F.format_string("- UNAVAILABLE `%s`: %s", F.col("url"), F.col("detail")))
        .when(F.col("status") == "failed-retryable", F.format_string("- RETRY LATER `%s` (attempt %d): %s", F.col("url"), F.col("attempts"), F.col("detail")))
        .when(F.col("status") == "manual-review", F.format_string("- MANUAL REVIEW `%s` `%s`: %s", F.col("name"), F.col("url"), F.col("detail")))
        .otherwise(F.concat(
            F.format_string(
                "- %s: **%s** (%s) conf=%s items=%d tier=%s transcript=%s classifier=%s", F.col("name"), F.col("category"), F.col("shape"),
                F.col("confidence").cast("string"), F.col("items"), F.col("tier"), F.col("transcript_source"), F.col("classifier"),
            ),
            F.when(F.col("status") == "needs-review", " REVIEW").otherwise(""),
        ))
    )
    return results.withColumn("line", line)
