"""Typed records from one model call a request batch: travel, actionable and enrichment, told apart by ``kind``.

An answer is ``{"items": [{"item_id": ..., "kind": ..., ...}]}``. It is read as VARIANT, so that one column holds all
record types, and each item is checked against the record its request asked for. No item is dropped: one without a valid
record keeps its problem and goes to manual review.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkshelf import constants as C
from linkshelf.functions.text import text_or_blank
from linkshelf.operators.ordered import last_by
from linkshelf.operators.scoring import bounded_confidence
from linkshelf.session import materialize

#: Fields of each record: name, type, whether it must be given.
RECORDS: dict[str, list[tuple[str, str, bool]]] = {
    "travel": [
        ("is_travel_related", "boolean", True), ("place_name", "string", False), ("country", "string", False), ("summary", "string", True),
        ("confidence", "double", True)],
    "actionable": [
        ("summary", "string", True), ("actionable_items", "array<string>", False), ("confidence", "double", True),
        ("needs_manual_review", "boolean", True), ("artist", "string", False), ("sound", "string", False)],
    "enrichment": [
        ("category", "string", True), ("summary", "string", True), ("confidence", "double", True), ("needs_manual_review", "boolean", True),
        ("extracted_movie_title", "string", False), ("movie_type", "string", False), ("movie_genre", "string", False),
        ("tech_category", "string", False), ("tech_tool", "string", False), ("project_field", "string", False), ("project_time", "string", False)],
}
#: Records whose confidence must lie between 0 and 1, and the categories an enrichment may name.
BOUNDED = ("travel", "actionable")
ENRICHED = (C.MOVIES, C.TECH, C.PROJECTS)


def typed_payloads(packed: DataFrame) -> DataFrame:
    """One payload ``[{item_id, kind, title, description, tags}]`` a request batch of ``packed(block, batch, i, kind, ...)``."""
    item = F.struct(F.col("i"), F.struct(
        F.col("i").cast("string").alias("item_id"), "kind", text_or_blank(F.col("title")).alias("title"),
        text_or_blank(F.col("description")).alias("description"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags")).alias("item"))
    rows = packed.groupBy("block", "batch").agg(F.array_sort(F.collect_list(item)).alias("items"), F.count(F.lit(1)).alias("n_items"))
    return rows.select("block", "batch", "n_items", F.to_json("items.item").alias("payload"))


def _field(item: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(item, f"$.{name}", kind)


def _record(item: Column, kind: str) -> tuple[Column, Column]:
    """The record of a kind, and whether it is valid."""
    fields = {name: _field(item, name, type_) for name, type_, _ in RECORDS[kind]}
    checks = [fields[name].isNotNull() for name, _, needed in RECORDS[kind] if needed]
    if kind in BOUNDED:
        checks.append(bounded_confidence(fields["confidence"]))
    if kind == "enrichment":
        checks.append(fields["category"].isin(*ENRICHED))
    return F.struct(*[column.alias(name) for name, column in fields.items()]), reduce(lambda a, b: a & b, checks)


def typed_records(packed: DataFrame, scored: DataFrame) -> DataFrame:
    """Every row of ``packed`` with its record in the column of its kind, ``problem`` and ``manual``.

    Problems: 'error' (the call failed), 'empty' or 'unreadable' (so is the whole answer), 'skipped' (no item for the row), 'kind' (another
    record than asked for), 'invalid' (a field is missing, of another type or out of bounds). An item answered twice keeps the last.
    """
    # Read twice below, and paid for: the answers are stored before anything else.
    told = materialize(scored.select("block", "batch", "error", "response"), "typed-answers").withColumn("answer", F.try_parse_json("response"))
    items = F.try_variant_get(F.col("answer"), "$.items", "array<variant>")
    state = F.when(F.col("error").isNotNull(), "error").when(text_or_blank(F.col("response")) == "", "empty").when(items.isNull(), "unreadable")
    told = told.select("block", "batch", state.alias("failed"), items.alias("items"))
    listed = told.filter("failed is null").select("block", "batch", F.posexplode("items").alias("pos", "item"))
    listed = listed.select("block", "batch", _field(F.col("item"), "item_id", "string").alias("item_id"), "pos", F.to_json("item").alias("item"))
    once = last_by(listed, ["block", "batch", "item_id"], "pos", ["item"])
    rows = packed.withColumn("item_id", F.col("i").cast("string")).join(told.select("block", "batch", "failed"), ["block", "batch"], "left")
    rows = rows.join(once, ["block", "batch", "item_id"], "left").withColumn("item", F.try_parse_json("item"))
    records = {kind: _record(F.col("item"), kind) for kind in RECORDS}
    valid = reduce(lambda out, kind: out.when(F.col("kind") == kind, records[kind][1]), RECORDS, F.when(F.lit(False), F.lit(False)))
    answered = F.coalesce(_field(F.col("item"), "kind", "string") == F.col("kind"), F.lit(False))
    problem = (
        F.when(F.col("failed").isNotNull(), F.col("failed")).when(F.col("item").isNull(), "skipped").when(~answered, "kind")
        .when(~F.coalesce(valid, F.lit(False)), "invalid"))
    rows = rows.withColumn("problem", problem)
    rows = rows.withColumns({kind: F.when(F.col("problem").isNull() & (F.col("kind") == kind), record) for kind, (record, _) in records.items()})
    asked = F.coalesce("actionable.needs_manual_review", "enrichment.needs_manual_review", F.lit(False))
    return rows.withColumn("manual", F.col("problem").isNotNull() | asked).drop("item_id", "item", "failed")
