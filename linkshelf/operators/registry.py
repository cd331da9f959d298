"""Which URLs are already known: the registry joins, set operations and the event ledger.

Captures are reduced to one row per URL before any join, so a link shared a billion times
costs one row, and the ledger side is never collected or broadcast by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkshelf.functions.text import squeeze, strip
from linkshelf.functions.urls import canonical_url, is_valid_http_url
from linkshelf.operators.sets import union_all


def classified_captures(captures: DataFrame) -> DataFrame:
    """Every capture line with its validity and canonical URL (one pass, no split scan)."""
    line = strip(F.col("line"))
    return (
        captures.withColumn("line", line)
        .filter(F.length("line") > 0)
        .withColumn("valid", is_valid_http_url(F.col("line")))
        .withColumn("url", F.when(F.col("valid"), canonical_url(F.col("line"))))
    )


def first_seen(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Distinct keys with their first sequence number and how many rows collapsed."""
    return rows.groupBy(key).agg(F.min(seq).alias("first_seq"), F.count(F.lit(1)).alias("variants"))


def without_known(rows: DataFrame, known: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose key is not known yet."""
    return rows.join(known.select(key), key, "left_anti")


def already_known(rows: DataFrame, known: DataFrame, key: str = "url") -> DataFrame:
    return rows.join(known.select(key), key, "left_semi")


def in_flight(*queues: DataFrame) -> DataFrame:
    """Canonical URLs waiting in any queue, blanks removed."""
    waiting = union_all(*[queue.select(canonical_url(F.col("url")).alias("url")) for queue in queues])
    return waiting.filter(F.col("url") != "").distinct()


def known_urls(cards: DataFrame, ledger: DataFrame, queued: DataFrame) -> DataFrame:
    """Cards, ledger and queues as one distinct URL set."""
    return union_all(*[d.select("url") for d in (cards, ledger, queued)]).distinct()


def carried_over(captures: DataFrame, initial: DataFrame, failed: DataFrame, invalid: DataFrame) -> DataFrame:
    """Lines that stay queued: failed, then invalid, then those appended during the run.

    ``captures`` is the queue as it is now and ``initial`` as it was read. Distinct lines keep
    their first position.
    """
    ranked = lambda df, rank: df.select("line", F.struct(F.lit(rank).alias("r"), F.col("seq").alias("s")).alias("at"))
    appended = captures.join(initial.select("line"), "line", "left_anti")
    rows = union_all(ranked(failed, 0), ranked(invalid, 1), ranked(appended, 2))
    return rows.groupBy("line").agg(F.min("at").alias("at")).select(
        "line", F.col("at.r").alias("source_rank"), F.col("at.s").alias("seq")
    )


def new_events(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Events to append: one per ``(url, event)``, none the ledger already has."""
    once = events.dropDuplicates(["url", "event"])
    return once.join(ledger.select("url", "event"), ["url", "event"], "left_anti")


def events_per_url(ledger: DataFrame) -> DataFrame:
    """Distinct events of each URL, sorted."""
    return ledger.groupBy("url").agg(F.array_sort(F.collect_set("event")).alias("events"))


def ledger_sync(cards: DataFrame, ledger: DataFrame, source: str = "vault-sync") -> DataFrame:
    """Events the ledger lacks: ``carded`` for unknown card URLs, ``tossed`` for tossed cards."""
    status = F.lower(F.coalesce("status", F.lit("")))
    per_url = cards.groupBy("url").agg(F.max(status == "tossed").alias("tossed"))
    carded = per_url.join(ledger.select("url"), "url", "left_anti").select("url", F.lit("carded").alias("event"))
    seen = ledger.filter(F.col("event") == "tossed").select("url")
    tossed = per_url.filter("tossed").join(seen, "url", "left_anti").select("url", F.lit("tossed").alias("event"))
    return union_all(carded, tossed).withColumn("source", F.lit(source))


def manual_review_lines(failures: DataFrame, listed: DataFrame) -> DataFrame:
    """Review entries not listed yet: one per URL, the reason on one line of at most 300 characters.

    Listed URLs are compared as whole keys.
    """
    reason = F.left(squeeze(F.coalesce("reason", F.lit(""))), F.lit(300))
    first = failures.groupBy("url").agg(F.min_by(F.struct("name", reason.alias("reason")), F.col("seq")).alias("b"))
    fresh = first.join(listed.select("url"), "url", "left_anti")
    return fresh.select("url", F.col("b.name").alias("name"), F.col("b.reason").alias("reason"))


def review_line(name: Column, url: Column, reason: Column) -> Column:
    return F.concat(F.lit("- `"), name, F.lit("` `"), url, F.lit("` — "), reason)
