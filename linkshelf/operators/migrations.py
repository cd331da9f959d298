"""Catalogue migrations and upserts. Each returns a diff; only changed rows need writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkshelf import constants as C
from linkshelf.functions.frontmatter import as_int
from linkshelf.functions.tags import category_tag, folder_for, item_category, literal_map, rewrite_tags, weight_color
from linkshelf.functions.text import body_summary, safe_filename, strip, text_or_blank
from linkshelf.functions.urls import item_id
from linkshelf.operators.routing import is_human


def migrated_cards(cards: DataFrame, legacy_tags: dict[str, str] | None = None) -> DataFrame:
    """Pipeline words move from ``status`` to ``stage``; category and tags take current spellings.

    Adds ``new_status, new_stage, new_category, new_tags, changed``.
    """
    stage = F.try_element_at(literal_map(C.LEGACY_STATUS_STAGE), F.lower(text_or_blank(F.col("status"))))
    new = {
        "new_stage": F.coalesce(stage, F.col("stage")),
        "new_status": F.when(stage.isNotNull(), "inbox").otherwise(F.col("status")),
        "new_category": F.when(F.col("category") == "Music", "Saved Music").otherwise(F.col("category")),
        "new_tags": rewrite_tags(F.col("tags"), legacy_tags),
    }
    rows = cards.withColumns(new)
    changed = F.lit(False)
    for old in ("stage", "status", "category", "tags"):
        changed = changed | ~F.col(old).eqNullSafe(F.col(f"new_{old}"))
    return rows.withColumn("changed", changed)


def _blank(value: Column) -> Column:
    return strip(text_or_blank(value)) == ""


def backfilled_travel(cards: DataFrame) -> DataFrame:
    """Fill missing map fields of travel cards from ``fm MAP, tags, body``.

    Blank status, summary and colour are filled; location, location_name and weight only when
    the key is absent. Adds ``new_fm, new_tags, changed_keys`` (in fill order).
    """
    fm = F.col("fm")
    get = lambda key: F.try_element_at(fm, F.lit(key))
    absent = lambda key: ~F.map_contains_key(fm, F.lit(key))
    weight = as_int(get("weight"))
    tags = F.col("tags")
    retag = F.coalesce(
        ~F.array_contains(tags, C.SAVED_TAG) & F.array_contains(tags, "tiktok"), F.lit(False)
    )
    fills = {
        "status": (_blank(get("status")), F.lit("inbox")),
        "summary": (_blank(get("summary")), body_summary(F.col("body"))),
        "location": (absent("location"), F.lit("")),
        "location_name": (absent("location_name"), F.lit("")),
        "weight": (absent("weight"), F.lit("0")),
        "mapMarkerColor": (_blank(get("mapMarkerColor")), weight_color(weight)),
    }
    changed = F.array_compact(F.array(
        *[F.when(due, F.lit(key)) for key, (due, _) in fills.items()], F.when(retag, F.lit("tags"))
    ))
    # Weight is always written as an integer, which alone is not a change.
    replaced = [F.struct(F.lit("weight").alias("key"), weight.cast("string").alias("value"))] + [
        F.when(due, F.struct(F.lit(key).alias("key"), value.alias("value"))) for key, (due, value) in fills.items() if key != "weight"
    ]
    extra = F.map_from_entries(F.array_compact(F.array(*replaced)))
    new_fm = F.map_concat(F.map_filter(fm, lambda k, v: ~F.map_contains_key(extra, k)), extra)
    return cards.withColumns({
        "new_fm": new_fm,
        "new_tags": F.when(retag, F.array_append(tags, F.lit(C.SAVED_TAG))).otherwise(tags),
        "changed_keys": changed,
    })


def child_rows(parents: DataFrame) -> DataFrame:
    """One row per extracted item of ``parents(url, stem, creator, category, items)``. The folder name is made once a parent."""
    rows = parents.select("url", "stem", "creator", "category", safe_filename(F.col("stem"), 50).alias("parent_folder"), "items")
    rows = rows.select("url", "stem", "creator", "category", "parent_folder", F.explode("items").alias("item"))
    return child_columns(rows.select("url", "stem", "creator", F.col("category").alias("parent_category"), "parent_folder", "item.*"))


def child_columns(rows: DataFrame) -> DataFrame:
    """Inherited and kind-specific fields of item rows (``kind, name, artist, location_name, position``).

    ``parent_folder``, where there is one, is the file name of ``stem``.
    """
    folder = F.col("parent_folder") if "parent_folder" in rows.columns else safe_filename(F.col("stem"), 50)
    kind, category = F.col("kind"), F.col("child_category")
    rows = rows.withColumn("child_category", item_category(kind, F.col("parent_category")))
    destination = kind == "destination"
    nothing = F.lit(None).cast("string")
    named_place = F.coalesce(F.nullif(F.col("location_name"), F.lit("")), F.col("name"))
    return rows.withColumns({
        "child_folder": F.concat(folder_for(category), F.lit("/"), folder),
        "child_stem": safe_filename(F.col("name"), 60, "Item"),
        "item_id": item_id(F.col("url"), kind, F.col("name"), F.col("position")),
        "child_tags": F.array(F.lit(C.SAVED_TAG), category_tag(category), F.concat(F.lit("crusher-item/"), kind)),
        "child_artist": F.when(kind.isin("album", "song"), F.nullif(F.col("artist"), F.lit(""))).otherwise(nothing),
        "child_location": F.when(destination, F.lit("")).otherwise(nothing),
        "child_location_name": F.when(destination, named_place).otherwise(nothing),
        "child_weight": F.when(destination, 0),
        "child_color": F.when(destination, F.lit(C.WEIGHT_ZERO_COLOR)).otherwise(nothing),
    })


def child_upserts(children: DataFrame, existing: DataFrame) -> DataFrame:
    """Match children to existing notes by item id: 'keep' (a person triaged it), 'rewrite' or 'create'."""
    old = existing.groupBy("child_folder", "item_id").agg(F.min_by("status", F.col("stem")).alias("old_status"), F.lit(True).alias("hit"))
    joined = children.join(old, ["child_folder", "item_id"], "left")
    effect = F.when(is_human(F.col("old_status")), "keep").when(F.col("hit"), "rewrite").otherwise("create")
    return joined.withColumn("effect", effect).drop("hit")


def refreshable(notes: DataFrame, stock: DataFrame) -> DataFrame:
    """Notes whose text is exactly a previous stock text for their name, with the current text.

    ``stock`` has ``name, previous, current``. Bodies meet by hash, so the join carries 32
    bytes per note; an edited copy does not match.
    """
    keyed = stock.select("name", F.sha2("previous", 256).alias("digest"), F.col("current").alias("new_content"))
    return notes.withColumn("digest", F.sha2("content", 256)).join(keyed, ["name", "digest"]).drop("digest")
