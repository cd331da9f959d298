"""Where an item goes: stage, folder, label and card columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkshelf import constants as C
from linkshelf.functions.tags import canonical_category, coordinates_ok, folder_for, known_category, place_query
from linkshelf.functions.text import caption_is_sparse, first_of, squeeze, strip, text_or_blank


def stage_for(category: Column, usable: Column) -> Column:
    """Pipeline stage of a classified item; NULL means unstaged."""
    name = canonical_category(category)
    return F.when(~usable, "manual-review").when(name.isin(C.FITNESS, C.RECIPES), "ready").when(name == C.MOVIES, "to-watch")


def placement(category: Column, usable: Column) -> dict[str, Column]:
    """``folder, label, stage``: unusable items go to the holding folder under a known label."""
    name = canonical_category(category)
    label = F.when(known_category(name), name).otherwise(C.DEFAULT_CATEGORY)
    folder = F.when(~usable, F.lit(C.MANUAL_REVIEW_FOLDER)).otherwise(folder_for(label))
    return {"folder": folder, "label": label, "stage": stage_for(name, usable)}


def travel_stage(is_travel: Column, confidence: Column, geocoded: Column, threshold: float = C.TRAVEL_THRESHOLD) -> Column:
    """Low confidence is manual review even with coordinates."""
    return (
        F.when(~F.coalesce(is_travel, F.lit(False)) | (confidence < threshold), "manual-review")
        .when(geocoded, "mapped")
        .otherwise("unmapped-travel")
    )


def geocoded(extractions: DataFrame, gazetteer: DataFrame, threshold: float = C.TRAVEL_THRESHOLD) -> DataFrame:
    """Join places to coordinates; a miss or an invalid pair is not a failure.

    Only confident travel rows with a place are looked up, and places meet the gazetteer in
    lower case with single blanks. ``gazetteer`` has one row per place.
    """
    query = F.when(
        F.col("is_travel") & (F.col("confidence") >= threshold), place_query(F.col("place_name"), F.col("country"))
    )
    places = gazetteer.filter(coordinates_ok(F.col("lat"), F.col("lon"))).select(
        F.lower(squeeze(F.col("place"))).alias("place_key"), F.col("lat"), F.col("lon")
    )
    keyed = extractions.withColumn("query", query).withColumn("place_key", F.lower(F.col("query")))
    hit = keyed.join(places, "place_key", "left").drop("place_key")
    return hit.withColumn("geocoded", F.col("lat").isNotNull())


def high_value_route(category, confidence, needs_review, has_title, threshold: float = C.HIGH_VALUE_THRESHOLD) -> dict[str, Column]:
    """Folder, label and stage on the high-value track."""
    manual = F.coalesce(needs_review, F.lit(False)) | (confidence < threshold) | (category == C.AMBIGUOUS)
    return {
        "folder": F.when(manual, F.lit(C.MANUAL_REVIEW_FOLDER)).otherwise(category),
        "label": F.when(manual, F.lit(C.DEFAULT_CATEGORY)).otherwise(category),
        "stage": F.when(manual, "manual-review").when((category == C.MOVIES) & has_title, "to-watch"),
    }


def music_field(value: Column, fallback: Column) -> Column:
    """Extracted artist or sound, filled from metadata only when blank."""
    return F.when((strip(text_or_blank(value)) == "") & (text_or_blank(fallback) != ""), fallback).otherwise(value)


def travel_tier_plan(caption: Column, is_travel: Column, place: Column, country: Column) -> Column:
    """Inputs used for a travel item, in order: the cheap one first, audio only for a nameless place."""
    sparse = caption_is_sparse(caption)
    audio = F.coalesce(is_travel, F.lit(False)) & place_query(place, country).isNull()
    return F.array_compact(F.array(F.when(sparse, "frames").otherwise("text"), F.when(audio, F.lit("audio"))))


def is_human(status: Column) -> Column:
    return F.lower(text_or_blank(status)).isin(C.HUMAN_STATUSES)


def guarded(status: Column, stage: Column, new_stage: Column) -> dict[str, Column]:
    """Status and stage after a rewrite: a person's triage is never reset."""
    human = is_human(status)
    return {
        "status": F.when(human, status).otherwise("inbox"),
        "stage": F.when(human, stage).otherwise(new_stage),
    }


def recategorized(old: Column, proposed: Column, wanted: Column, locked: Column) -> dict[str, Column]:
    """New category and the previous one worth remembering."""
    name = canonical_category(proposed)
    current = first_of(old, F.lit(C.DEFAULT_CATEGORY))
    known = F.when(known_category(name), name).otherwise(C.DEFAULT_CATEGORY)
    new = F.when(wanted & ~F.coalesce(locked, F.lit(False)), known).otherwise(current)
    return {"new_category": new, "previous_category": F.when((text_or_blank(old) != "") & (old != new), old)}


def known_in_run(lines: DataFrame, seq: str, handled: Column) -> DataFrame:
    """``lines(url, valid, seen)`` with ``known``: stored before the run, or handled by an earlier line of it.

    A line that is not ``handled``, as its fetch failed for now, leaves its URL to the next one.
    """
    first = lines.filter(F.col("valid") & ~F.col("seen") & handled).groupBy("url").agg(F.min(seq).alias("__first"))
    joined = lines.join(first, "url", "left")
    return joined.withColumn("known", F.col("seen") | F.coalesce(F.col(seq) > F.col("__first"), F.lit(False))).drop("__first")


def dispatch_outcome(
    *, valid: Column, known: Column, fetch: Column, quota_stopped: Column, category: Column, confidence: Column,
    parsed: Column, threshold: float = C.CLASSIFIER_MIN_CONFIDENCE,
) -> Column:
    """One outcome per captured line, in the order the rules apply."""
    name = canonical_category(category)
    return (
        F.when(~valid, "kept-invalid")
        .when(quota_stopped, "kept-stopped")
        .when(known, "skipped-known")
        .when(fetch == "transient", "kept-transient")
        .when(fetch == "permanent", "manual-dead-link")
        .when((text_or_blank(category) == "") | (F.coalesce(confidence, F.lit(0.0)) < threshold), "manual-low-confidence")
        .when(~parsed & (name.isin(C.ACTIONABLE) | (name == C.TRAVEL)), "manual-unparseable")
        .when(name.isin(C.ACTIONABLE), "card-actionable")
        .when(name == C.TRAVEL, "card-travel")
        .when(name.isin(C.HIGH_VALUE), "card-high-value")
        .otherwise("card-generic")
    )


def dispatched(lines: DataFrame, seq: str, quota_hit: Column) -> DataFrame:
    """One run over the queue: ``lines`` with ``known`` and ``outcome``.

    ``lines`` has ``url, valid, seen, fetch, category, confidence, parsed``. The run stops at the first line whose scoring
    call meets the quota (``quota_hit``); that line and all after it stay queued.
    """
    rows = known_in_run(lines, seq, F.col("fetch") != "transient")
    calls = F.col("valid") & ~F.col("known") & (F.col("fetch") == "ok")
    stop = rows.agg(F.min(F.when(calls & quota_hit, F.col(seq))).alias("stop")).scalar()
    outcome = dispatch_outcome(
        valid=F.col("valid"), known=F.col("known"), fetch=F.col("fetch"), quota_stopped=F.coalesce(F.col(seq) >= stop, F.lit(False)),
        category=F.col("category"), confidence=F.col("confidence"), parsed=F.col("parsed"),
    )
    return rows.withColumn("outcome", outcome)


def kept_queue(run: DataFrame) -> DataFrame:
    """Lines that stay queued after a run."""
    return run.filter(F.startswith("outcome", F.lit("kept-")))


def dispatch_cards(run: DataFrame) -> DataFrame:
    """``url, folder, label`` of the cards a run makes. Its ledger events are one ``carded`` for each."""
    made = run.filter(F.startswith("outcome", F.lit("card-")) | F.startswith("outcome", F.lit("manual-")))
    manual = F.startswith("outcome", F.lit("manual-"))
    name = canonical_category(F.col("category"))
    label = (
        F.when(F.col("outcome") == "manual-dead-link", C.DEFAULT_CATEGORY)
        .when(F.col("outcome") == "manual-low-confidence", first_of(F.col("category"), F.lit(C.DEFAULT_CATEGORY)))
        .when(F.col("outcome") == "manual-unparseable", name)
        .when(known_category(name), name).otherwise(C.DEFAULT_CATEGORY)
    )
    folder = F.when(manual, F.lit(C.MANUAL_REVIEW_FOLDER)).otherwise(folder_for(label))
    return made.select("url", folder.alias("folder"), label.alias("label"))
