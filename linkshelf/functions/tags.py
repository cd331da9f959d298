"""Taxonomy, tag and routing-label columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkshelf import constants as C
from linkshelf.functions.text import first_of, squeeze, strip, text_or_blank


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])


def taxonomy(spark: SparkSession, folders: dict[str, str] | None = None) -> DataFrame:
    """The category dimension: ``ord, category, folder, hint`` (one row per category)."""
    folders = folders or C.CATEGORY_FOLDERS
    rows = [(i, c, f, C.CATEGORY_HINTS.get(c)) for i, (c, f) in enumerate(folders.items())]
    return spark.createDataFrame(rows, "ord int, category string, folder string, hint string")


def canonical_category(category: Column) -> Column:
    """Legacy label to taxonomy key; unknown names are unchanged."""
    name = strip(text_or_blank(category))
    return F.coalesce(F.try_element_at(literal_map(C.CATEGORY_ALIASES), name), name)


def known_category(category: Column) -> Column:
    return category.isin(C.CATEGORIES)


def folder_for(category: Column) -> Column:
    """Folder of a category; unknown categories go to the inbox."""
    return F.coalesce(F.try_element_at(literal_map(C.CATEGORY_FOLDERS), canonical_category(category)), F.lit(C.DEFAULT_FOLDER))


def _slug(text: Column) -> Column:
    spaced = F.translate(F.replace(text, F.lit("&"), F.lit(" and ")), "/-", "  ")
    return F.replace(squeeze(spaced), F.lit(" "), F.lit("-"))


def category_tag(category: Column) -> Column:
    slug = _slug(F.lower(canonical_category(category)))
    return F.concat(F.lit("category/"), first_of(slug, F.lit("uncategorized")))


def card_tags(category: Column) -> Column:
    return F.array(F.lit(C.SAVED_TAG), category_tag(category))


def replace_category_tag(tags: Column, category: Column) -> Column:
    """Drop ``category/*`` tags, append the new one unless a kept tag equals it."""
    kept = F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: ~F.startswith(t, F.lit("category/")))
    new = category_tag(category)
    return F.when(F.array_contains(kept, new), kept).otherwise(F.array_append(kept, new))


def rewrite_tag(tag: Column, legacy: dict[str, str] | None = None) -> Column:
    """Current spelling of a tag. ``legacy`` maps retired whole tags of the library being migrated."""
    slug = _slug(F.substr(tag, F.lit(len("category/") + 1)))
    out = F.when(F.startswith(tag, F.lit("category/")) & (slug != ""), F.concat(F.lit("category/"), slug)).otherwise(tag)
    if legacy:
        out = F.coalesce(F.try_element_at(literal_map(legacy), tag), out)
    return out


def rewrite_tags(tags: Column, legacy: dict[str, str] | None = None) -> Column:
    """Every tag rewritten, then distinct in first-seen order."""
    return F.array_distinct(F.transform(tags, lambda t: rewrite_tag(t, legacy)))


def _criteria(prefix: str, value: Column) -> Column:
    slug = F.replace(F.replace(F.lower(value), F.lit(" "), F.lit("-")), F.lit("/"), F.lit(""))
    return F.when(text_or_blank(value) != "", F.concat(F.lit(prefix + "/"), slug))


def criteria_tags(category, label, first: Column, second: Column) -> Column:
    """Card tags plus the two criteria tags of the item's family."""
    prefixes = {C.MOVIES: ("type", "genre"), C.TECH: ("tech", "tool"), C.PROJECTS: ("field", "time")}
    extra = []
    for value, slot in ((first, 0), (second, 1)):
        tag = None
        for family, names in prefixes.items():
            hit = _criteria(names[slot], value)
            tag = F.when(category == family, hit) if tag is None else tag.when(category == family, hit)
        extra.append(tag)
    return F.array_compact(F.array(F.lit(C.SAVED_TAG), category_tag(label), *extra))


def item_category(kind: Column, fallback: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(C.KIND_CATEGORY), kind), fallback)


def weight_color(weight: Column) -> Column:
    """Pin colour of a reference count. A non-integer weight is an error under ANSI casts."""
    value = weight.cast("int")
    out = None
    for minimum, color in C.WEIGHT_COLORS:
        out = F.when(value >= minimum, color) if out is None else out.when(value >= minimum, color)
    return out.otherwise(C.WEIGHT_ZERO_COLOR)


def place_query(place: Column, country: Column) -> Column:
    """Geocoder query: the country is added unless the place already names it."""
    place, country = squeeze(text_or_blank(place)), squeeze(text_or_blank(country))
    return F.when(
        place != "",
        F.when(
            (country != "") & ~F.contains(F.lower(place), F.lower(country)),
            F.concat(place, F.lit(", "), country),
        ).otherwise(place),
    )


def coordinates_ok(lat: Column, lon: Column) -> Column:
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0), F.lit(False))


def route_tag(stage: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(C.ROUTE_TAGS), stage), F.lit(C.ROUTE_TAGS["manual-review"]))


def criteria_text(category: Column) -> Column:
    """Hint of a category, or its own name."""
    return F.coalesce(F.try_element_at(literal_map(C.CATEGORY_HINTS), category), category)


def category_hints(categories: list[str]) -> str:
    """Guidance block of a scoring prompt."""
    lines = [f"- {c}: {C.CATEGORY_HINTS[c]}" for c in categories if c in C.CATEGORY_HINTS]
    return "Category guidance:\n" + "\n".join(lines) + "\n\n" if lines else ""
