"""Captures to cards: the whole batch path as one lineage.

Three stages are written once to the shared folder: the new items, the model's answers (they
are paid for) and the classified rows. Each is read more than once below, and a lost executor
only repeats work since the last of them. Numbering, asking and naming work on narrow rows; whole titles are shuffled where items are
found, where they meet their answers and where cards meet their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkshelf import constants as C
from linkshelf.functions.cards import classified_card
from linkshelf.functions.tags import folder_for
from linkshelf.functions.text import safe_filename
from linkshelf.operators import registry, scoring
from linkshelf.operators.catalog import unique_names
from linkshelf.operators.ordered import packed
from linkshelf.operators.sets import union_all
from linkshelf.session import materialize, scratch_path
from linkshelf.sources.writers import append_events, read_or_empty

#: Number of a stored item, which no key of its own needs to be.
_ITEM = "__item"
CARDS = "url string, category string, folder string, stem string, content string"
EVENTS = "url string, event string, source string, category string"


def new_items(captures: DataFrame, known: DataFrame, metadata: DataFrame) -> DataFrame:
    """Metadata of captured URLs that are not known yet, one row per URL."""
    lines = registry.classified_captures(captures).filter("valid")
    fresh = registry.without_known(registry.first_seen(lines, "url", "seq"), known.select("url").distinct())
    return fresh.join(metadata, "url")


def classified(items: DataFrame, scorer: Callable[[str], str | None], order: str, size: int = C.BATCH_SIZE,
               store: str | None = None) -> DataFrame:
    """Items with ``category`` and ``summary``; unscored batches are left out and stay queued.

    Batches behind a failing wave are not asked. ``store`` keeps paid answers from run to run; without it they last for this run.
    """
    items = materialize(items.withColumn(_ITEM, F.monotonically_increasing_id()), "items")
    shown = [F.left("title", F.lit(C.TITLE_CHARS)).alias("title"), F.left("description", F.lit(C.CAPTION_CHARS)).alias("description")]
    rows = materialize(packed(items.select(_ITEM, order, *shown), order, size), "packed")
    scored = scoring.scored_in_waves(scoring.batch_payloads(rows), scorer, store or scratch_path(items.sparkSession, "paid"))
    checked = scoring.validated(scored)
    staged = scoring.stop_at_first_failure(checked, F.col("problem").isNotNull() | F.col("error").isNotNull())
    committed = staged.filter("committed")
    answered = scoring.answers(committed)
    kept = rows.select(_ITEM, "block", "batch", "i").join(committed.select("block", "batch"), ["block", "batch"], "left_semi")
    told = scoring.reconciled(kept, answered)
    whole = items.drop("block", "batch", "i", "category", "summary")
    done = whole.join(told, _ITEM).select("block", "batch", "i", *[c for c in whole.columns if c != _ITEM], "category", "summary")
    return materialize(done, "classified")


def cards(rows: DataFrame, existing: DataFrame, seq: str) -> DataFrame:
    """Card rows: folder, collision-free name, text."""
    text = classified_card(
        F.col("category"), F.col("title"), F.col("creator"), F.col("url"), F.col("summary"), F.array_join("tags", ", ")
    )
    built = rows.select(
        F.col(seq).alias("seq"), "url", text["category"].alias("category"), text["title"].alias("title"), text["content"].alias("content")
    ).withColumns({"folder": folder_for(F.col("category")), "stem": safe_filename(F.col("title"))})
    # Read many times below, and stems come from whole titles.
    stems = materialize(built.select("folder", "stem", "seq"), "stems")
    names = unique_names(stems, existing).select("seq", "final_stem")
    return built.join(names, "seq")


def write_cards(queue: DataFrame, cards_path: str, ledger_path: str, seq: str, writable: Column | None = None) -> DataFrame:
    """Cards of the queued rows and their ledger events, each once; returns the rows that stay queued.

    A URL that has a card or an event is done: it gets no second card, and the event that a crash left out if it has a card.
    Rows that aren't ``writable`` stay queued and get neither. Cards are stored before their events, so that a run after
    a crash finds what is missing. Single writer.
    """
    spark = queue.sparkSession
    writable = F.lit(True) if writable is None else F.coalesce(writable, F.lit(False))
    stored, ledger = read_or_empty(spark, cards_path, CARDS), read_or_empty(spark, ledger_path, EVENTS)
    known = union_all(stored.select("url"), ledger.select("url")).distinct().withColumn("__known", F.lit(True))
    queue = materialize(queue.join(known, "url", "left"), "queue")
    fresh = queue.filter(F.col("__known").isNull()).drop("__known")
    names = stored.select("folder", "stem")
    built = materialize(cards(fresh.filter(writable), names, seq).select(
        F.col("seq"), "url", "category", "folder", F.col("final_stem").alias("stem"), "content"), "built")
    left = fresh.filter(~writable)
    recovered = registry.without_known(registry.already_known(stored.select("url").distinct(), queue), ledger)
    built.drop("seq").write.mode("append").parquet(cards_path)
    event = lambda rows, category: rows.select("url", F.lit("carded").alias("event"), F.lit("write-cards").alias("source"), category.alias("category"))
    append_events(materialize(union_all(event(built, F.col("category")), event(recovered, F.lit(None).cast("string"))), "events"), ledger_path, EVENTS)
    return left
