"""Card text columns, one layout per family (the layouts are fixed values)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkshelf import constants as C
from linkshelf.functions.frontmatter import location_line, quoted, render_fields, tag_lines
from linkshelf.functions.numbers import fixed
from linkshelf.functions.tags import canonical_category, card_tags, category_tag, route_tag, weight_color
from linkshelf.functions.text import checklist, first_of, safe_filename, text_or_blank
from linkshelf.operators.routing import stage_for

# Map defaults of a new travel card (fixed text).
_TRAVEL_DEFAULTS = (
    'location: ""  # [lat, lng] or "City, Country" for Map View\n'
    'location_name: ""  # e.g. "Shibuya, Tokyo" (filled by enrichment)\n'
    "weight: 0  # times this location is referenced across saved media\n"
    'mapMarkerColor: "#9E9E9E"  # pin color; see map_marker_color_for_weight()'
)
_ANALYSIS_START = "<!-- crusher:start -->"
_ANALYSIS_END = "<!-- crusher:end -->"


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _optional(key: str, value: Column) -> Column:
    """A ``key: "value"`` line, dropped when the value is NULL."""
    return F.when(value.isNotNull(), _text(f"{key}: ", quoted(value)))


def _source_lines(creator: Column, url: Column, label: str) -> Column:
    return _text("- **Creator:** @", creator, f"\n- **{label}:** [", url, "](", url, ")\n")


def _header(category, creator, url, stage, confidence, summary, artist=None, sound=None) -> Column:
    lines = [
        ("category", quoted(category)), ("creator", quoted(creator)), ("url", quoted(url)),
        ("status", F.lit('"inbox"')), ("", _optional("stage", stage)),
        ("", F.when(confidence.isNotNull(), _text("confidence: ", confidence.cast("string")))),
        ("summary", quoted(summary)),
    ]
    if artist is not None:
        lines += [("", _optional("artist", artist)), ("", _optional("sound", sound))]
    lines.append(("", tag_lines(card_tags(category))))
    return _text("---\n", render_fields(lines), "\n---")



def manual_card(url: Column, summary: Column, confidence: Column, category: Column) -> Column:
    """Card for an item a person has to look at."""
    name = first_of(canonical_category(category), F.lit(C.DEFAULT_CATEGORY))
    head = _header(name, F.lit("Unknown"), url, F.lit("manual-review"), confidence, summary)
    return _text(
        head, "\n\n# ", summary, "\n\n> **Summary:** ", summary, "\n\n- **Source Link:** [", url, "](", url,
        ")\n\n## Review\n", summary, "\n",
    )


def actionable_card(*, category, title, creator, url, summary, items, stage, confidence, artist, sound) -> Column:
    """Music, fitness and recipe cards."""
    name = canonical_category(category)
    music = name == C.MUSIC
    maker = first_of(creator, F.lit("Unknown"))
    head = _header(
        name, maker, url, stage, confidence, summary,
        F.when(music, text_or_blank(artist)), F.when(music, text_or_blank(sound)),
    )
    section = (
        F.when(name == C.FITNESS, _text("## Exercises & Movement Routine\n", checklist(items), "\n"))
        .when(name == C.RECIPES, _text("## Ingredients & Preparation\n", checklist(items), "\n"))
        .when(music, _text(
            "## Artist & Sound\n- **Artist:** ", first_of(artist, F.lit("Unknown")),
            "\n- **Sound:** ", first_of(sound, F.lit("Unknown")), "\n",
        ))
        .otherwise(_text("## Review\n", summary, "\n"))
    )
    heading = first_of(title, summary, F.lit("Untitled"))
    return _text(
        head, "\n\n# ", heading, "\n\n> **Summary:** ", summary, "\n\n",
        _source_lines(maker, url, "Source Link"), "\n", section,
    )


def high_value_card(*, category, title, creator, url, summary, stage, confidence) -> Column:
    """Tech, project and movie cards."""
    maker = first_of(creator, F.lit("Unknown"))
    head = _header(canonical_category(category), maker, url, stage, confidence, summary)
    heading = first_of(title, summary, F.lit("Untitled"))
    return _text(
        head, "\n\n# ", heading, "\n\n> **Summary:** ", summary, "\n\n",
        _source_lines(maker, url, "Source Link"), "\n## Actionable Notes\n- [ ] Review core concept\n",
    )


def travel_card(*, category, title, creator, url, summary, destination, location_name, stage, confidence,
                lat, lon, address) -> Column:
    """Travel card; coordinates appear only when the place was found."""
    name = first_of(canonical_category(category), F.lit(C.TRAVEL))
    maker = first_of(creator, F.lit("Unknown"))
    pinned = stage != "manual-review"
    has = lambda c: F.nullif(c, F.lit(""))
    six = lambda c: fixed(c, 6)
    block = render_fields([
        ("category", quoted(name)), ("creator", quoted(maker)), ("url", quoted(url)), ("status", F.lit('"inbox"')),
        ("stage", quoted(stage)), ("confidence", confidence.cast("string")), ("summary", quoted(summary)),
        ("", _optional("destination", has(destination))),
        ("", F.when(pinned, _optional("location_name", has(location_name)))),
        ("", F.when(pinned, F.lit("weight: 0"))),
        ("", F.when(pinned, _text("mapMarkerColor: ", quoted(weight_color(F.lit(0)))))),
        ("", F.when(lat.isNotNull() & lon.isNotNull(), location_line(six(lat), six(lon)))),
        ("", _optional("address", has(address))),
        ("", tag_lines(F.array_append(card_tags(name), route_tag(stage)))),
    ])
    heading = first_of(title, destination, summary, F.lit("Untitled"))
    place = F.when(has(destination).isNotNull(), _text("- **Destination:** ", destination, "\n")).otherwise("")
    return _text(
        "---\n", block, "\n---\n\n# ", heading, "\n\n> **Summary:** ", summary, "\n\n",
        _source_lines(maker, url, "Source Link"), place, "\n## Notes\n", summary, "\n",
    )


def generic_card(*, category, title, creator, url, summary, tags_text) -> Column:
    """The default layout; travel cards carry their map defaults."""
    travel = F.when(category == C.TRAVEL, _text("\nsummary: ", quoted(summary), "\n", _TRAVEL_DEFAULTS)).otherwise("")
    return _text(
        "---\ncategory: ", quoted(category), "\ncreator: ", quoted(creator), "\nurl: ", quoted(url),
        '\nstatus: "inbox"\ntags:\n  - saved-media\n  - ', category_tag(category), travel, "\n---\n\n# ", title,
        "\n\n> **Summary:** ", summary, "\n\n", _source_lines(creator, url, "Source"), "- **Original Tags:** ",
        first_of(tags_text, F.lit("None")), "\n\n## Notes & Insights\n- \n",
    )


def classified_card(category: Column, title: Column, creator: Column, url: Column, summary: Column, tags_text: Column) -> dict[str, Column]:
    """``category, title, content`` of one classified row, in its family's layout."""
    name = canonical_category(first_of(category, F.lit(C.DEFAULT_CATEGORY)))
    summary = text_or_blank(summary)
    heading = first_of(title, summary, F.lit("Saved Post"))
    maker = first_of(creator, F.lit("Unknown"))
    url = text_or_blank(url)
    stage = stage_for(name, F.lit(True))
    no_score = F.lit(None).cast("double")
    content = (
        F.when(name.isin(C.ACTIONABLE), actionable_card(
            category=name, title=heading, creator=maker, url=url, summary=summary, items=F.array(summary),
            stage=stage, confidence=no_score, artist=text_or_blank(creator), sound=heading,
        ))
        .when(name.isin(C.HIGH_VALUE), high_value_card(
            category=name, title=heading, creator=maker, url=url, summary=summary, stage=stage, confidence=no_score,
        ))
        .otherwise(generic_card(
            category=name, title=heading, creator=maker, url=url, summary=summary, tags_text=tags_text,
        ))
    )
    return {"category": name, "title": heading, "content": content}


def findings_block(*, summary, shape, confidence, language, notes, findings, items) -> Column:
    """The marked analysis block of a re-analysed card. ``items`` has ``kind, name, location_name``."""
    bullets = F.transform(findings, lambda b: _text("- ", F.btrim(F.ltrim(b, F.lit("- ")), F.lit(C.SPACE_CHARS))))
    listed = F.transform(items, lambda x: _text(
        "- [", x["kind"], "] ", x["name"],
        F.when(text_or_blank(x["location_name"]) != "", _text(" (", x["location_name"], ")")).otherwise(""),
    ))
    empty = F.array().cast("array<string>")
    lines = F.concat(
        F.array_compact(F.array(
            F.lit(_ANALYSIS_START), F.lit("## Video Analysis"), F.lit(""), _text("> **Summary:** ", summary), F.lit(""),
            _text("- **Media shape:** `", shape, "`"), _text("- **Confidence:** ", confidence.cast("string")),
            F.when(text_or_blank(language) != "", _text("- **Language:** ", language)),
            F.when(text_or_blank(notes) != "", _text("- **Completeness:** ", notes)),
        )),
        F.when(F.size(findings) > 0, F.concat(F.array(F.lit(""), F.lit("### Findings")), bullets)).otherwise(empty),
        F.when(F.size(items) > 0, F.concat(F.array(F.lit(""), F.lit("### Extracted items")), listed)).otherwise(empty),
        F.array(F.lit(_ANALYSIS_END)),
    )
    return _text(F.array_join(lines, "\n"), "\n")


def analyzed_body(*, title, summary, creator, url, block, notes) -> Column:
    """Body of a re-analysed card: heading, facts, analysis block, kept notes."""
    return _text("# ", title, "\n\n> **Summary:** ", summary, "\n\n", _source_lines(creator, url, "Source"), "\n", block, notes)


def child_card(*, fields: Column, parent: Column, name: Column, notes: Column) -> Column:
    """Note of one extracted item."""
    extra = F.when(text_or_blank(notes) != "", _text("- **Notes:** ", notes, "\n")).otherwise("")
    return _text(
        "---\n", fields, "\n---\n\n# ", safe_filename(name, 70, "Item"), "\n\n> **From parent video:** ", parent,
        "\n\n- **Item:** ", name, "\n", extra,
    )


def enriched_card(*, label, creator, url, status, stage, confidence, tags, title, context, notes) -> Column:
    """A rewritten high-value card that keeps the user's notes section."""
    block = render_fields([
        ("category", quoted(label)), ("creator", quoted(creator)), ("url", quoted(url)), ("status", quoted(status)),
        ("", _optional("stage", F.nullif(stage, F.lit("")))), ("confidence", confidence.cast("string")), ("", tag_lines(tags)),
    ])
    return _text(
        "---\n", block, "\n---\n\n# ", title, "\n\n> **Context:** ", context, "\n\n",
        _source_lines(creator, url, "Source Link"), "\n", notes,
    )
