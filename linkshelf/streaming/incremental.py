"""Incremental capture, status and quota streams built on the batch operators.

A sink batch is identified by its ``batchId``: rows carry it, and a replayed batch finds its
own rows already present, so nothing is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkshelf.functions.urls import canonical_url, is_valid_http_url
from linkshelf.operators.ordered import last_by
from linkshelf.operators.registry import without_known
from linkshelf.operators.sets import union_all
from linkshelf.session import materialize
from linkshelf.sources import history
from linkshelf.sources.writers import read_or_empty
from linkshelf.streaming.attempts import attempt_changes

SEEN = "url string, event string, source string, batch bigint"
RETRY = "line string, attempts int, batch bigint"


def _run(df: DataFrame, handler, checkpoint: str) -> StreamingQuery:
    return (
        df.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def capture_stream(lines: DataFrame, captured_path: str, invalid_path: str, checkpoint: str) -> StreamingQuery:
    """New canonical URLs of each micro-batch, appended once to the history of captured URLs; only the batch's buckets of it are read.

    The ledger hears of a URL from ``card_stream``, when its card exists: one whose card failed is not taken for known.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        valid = is_valid_http_url(F.col("line"))
        urls = batch.filter(valid).select(canonical_url(F.col("line")).alias("url")).distinct()
        fresh = history.unseen(urls, captured_path, SEEN)
        history.append(fresh.select(
            "url", F.lit("captured").alias("event"), F.lit("stream").alias("source"), F.lit(batch_id).cast("bigint").alias("batch")), captured_path)
        done = read_or_empty(spark, invalid_path, "line string, batch bigint").filter(F.col("batch") == batch_id)
        rejected = batch.filter(~valid).select("line").distinct().join(done.select("line"), "line", "left_anti")
        rejected.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("append").parquet(invalid_path)

    return _run(lines, handle, checkpoint)


def deduplicated(events: DataFrame, ts: str, lateness: str = "1 hour") -> DataFrame:
    """First arrival of each URL within the watermark; for older history see ``dedupe_stream``."""
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(["url"])


def dedupe_stream(events: DataFrame, table: str, checkpoint: str, known: DataFrame | None = None) -> StreamingQuery:
    """URLs of ``events`` once each, over any span of time: the history at ``table`` and ``known`` (a ledger) drop repeats.

    No watermark: it would drop a URL whose only event is late. A micro-batch reads the history's buckets of its own URLs.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        fresh = history.unseen(batch.select("url").distinct(), table, "url string")
        history.append(without_known(fresh, known.select("url")) if known is not None else fresh, table)

    return _run(events, handle, checkpoint)


def updates_stream(updates: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Changed rows of a streaming aggregation, one version a micro-batch; ``newest`` reads them."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/v={batch_id}")

    return (
        updates.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def newest(versions: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows written in several versions ``v``, the newest of each key."""
    values = [c for c in versions.columns if c not in (*keys, "v")]
    return last_by(versions, keys, "v", values)


def latest_status(log: DataFrame) -> DataFrame:
    """Running latest status per URL, as a streaming aggregation with partial merge."""
    best = F.max_by(F.struct("seq", "status"), F.col("seq")).alias("b")
    return log.groupBy("url").agg(best).select("url", "b.seq", "b.status")


def attempts_stream(log: DataFrame, table: str, checkpoint: str, initial: DataFrame | None = None) -> StreamingQuery:
    """Running attempts and latest status per URL: the URLs a micro-batch changes, as its version of ``table``.

    ``log`` and ``initial`` are those of ``attempt_changes``; ``newest(versions, ["url"])`` reads the table.
    """
    return updates_stream(attempt_changes(log, initial), table, checkpoint)


def live_load(log: DataFrame, rpm: int, lateness: str = "2 minutes") -> DataFrame:
    """Sliding 60-second request and token load per key; the batch form is exact."""
    window = F.window("ts", "60 seconds", "10 seconds")
    load = log.withWatermark("ts", lateness).groupBy(window, "key").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("in_tokens").alias("tokens")
    )
    return load.select(
        "key", F.col("window.start").alias("from_ts"), F.col("window.end").alias("to_ts"), "requests", "tokens",
        (F.col("requests") > rpm).alias("over_limit"),
    )


def retry_lane(lines: DataFrame, retry_path: str, done_path: str, checkpoint: str, outcome, limit: int = 3) -> StreamingQuery:
    """Failed lines come back with the next micro-batch until they succeed, end, or reach ``limit``.

    ``outcome(df)`` adds ``result`` ('ok', 'transient' or 'permanent') to rows of ``line``.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        waiting = read_or_empty(spark, f"{retry_path}/v={batch_id - 1}", "line string, attempts int")
        rows = union_all(batch.select("line", F.lit(0).alias("attempts")), waiting)
        once = rows.groupBy("line").agg(F.max("attempts").alias("attempts"))
        judged = materialize(outcome(once), "retry")
        failed = F.col("result") == "transient"
        again = judged.filter(failed & (F.col("attempts") + 1 < limit))
        again.select("line", (F.col("attempts") + 1).alias("attempts")).write.mode("overwrite").parquet(f"{retry_path}/v={batch_id}")
        ended = judged.filter(~failed | (F.col("attempts") + 1 >= limit)).select(
            "line", F.when(failed, "unavailable").otherwise(F.col("result")).alias("result"),
            (F.col("attempts") + 1).alias("attempts"),
        )
        ended.write.mode("overwrite").parquet(f"{done_path}/v={batch_id}")

    return _run(lines, handle, checkpoint)


def card_stream(rows: DataFrame, cards_path: str, ledger_path: str, checkpoint: str, render) -> StreamingQuery:
    """Cards and ledger events, each exactly once per URL across replays.

    Cards are written before their ledger events and both writes skip what is already stored,
    so a crash between them is repaired by the replay. ``render(df)`` returns ``url`` and the
    card columns. Of several cards of a URL in one micro-batch the least by its columns, in their
    order, is the card; the first micro-batch that has one keeps it. Both tables are histories:
    a micro-batch reads its own buckets.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        rendered = render(batch)
        rest = [c for c in rendered.columns if c != "url"]
        once = materialize(rendered.groupBy("url").agg(F.min(F.struct(*rest)).alias("card")).select("url", "card.*"), "cards")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in once.schema.fields)
        history.append(history.unseen(once, cards_path, schema), cards_path)
        events = once.select("url", F.lit("carded").alias("event"), F.lit("stream").alias("source"), F.lit(batch_id).cast("bigint").alias("batch"))
        history.append(history.unseen(events, ledger_path, SEEN), ledger_path)

    return _run(rows, handle, checkpoint)
