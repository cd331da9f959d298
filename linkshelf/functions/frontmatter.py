"""Front-matter columns: split, read, render and rebuild the block that starts a card.

The reader covers the subset the pipeline writes (scalars, inline pairs, block lists).
A card's keys become two maps, ``fm`` (scalars) and ``fm_lists`` (lists), so "key absent"
and "key blank" stay distinguishable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkshelf import constants as C
from linkshelf.functions.bind import let
from linkshelf.functions.text import strip

_BLOCK = r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"
_ENTRY = r"(?m)^([^\s:#\-\[{\"'][^:\n]*):(?:[ \t]+([^\n]*))?$\n?((?:^[ \t]*- [^\n]*$\n?)*)"


def has_block(content: Column) -> Column:
    return F.rlike(content, F.lit(_BLOCK))


def block_text(content: Column) -> Column:
    """Text between the fences, NULL when the note has no block."""
    return F.when(has_block(content), F.regexp_extract(content, _BLOCK, 1))


def body_text(content: Column) -> Column:
    """Everything after the block, byte for byte."""
    return F.substr(content, F.length(F.regexp_extract(content, _BLOCK, 0)) + 1)


def quoted(value: Column) -> Column:
    """Double-quoted scalar with JSON escapes; NULL is ``""``."""
    text = F.to_json(F.struct(F.coalesce(value.cast("string"), F.lit("")).alias("v")))
    return F.substr(text, F.lit(6), F.length(text) - 6)


def _unquote(raw: Column) -> Column:
    text = strip(raw)
    double = F.get_json_object(F.concat(F.lit('{"v":'), F.regexp_replace(text, r'"[ \t]+#.*$', '"'), F.lit("}")), "$.v")
    single = F.replace(F.regexp_extract(text, r"^'(.*)'[ \t]*(?:#.*)?$", 1), F.lit("''"), F.lit("'"))
    bare = strip(F.regexp_replace(text, r"(?:^|[ \t]+)#.*$", ""))
    return (
        F.when(F.startswith(text, F.lit('"')), double)
        .when(F.startswith(text, F.lit("'")), single)
        .when(bare.isin("", "~", "null", "Null", "NULL"), F.lit(None).cast("string"))
        .otherwise(bare)
    )


def _entry(text: Column) -> Column:
    """One ``key:`` line with the list lines below it."""
    head = F.substring_index(text, "\n", 1)
    key = F.substring_index(head, ":", 1)
    scalar = strip(F.substr(head, F.length(key) + 2))
    below = F.filter(F.transform(F.split(F.substr(text, F.length(head) + 2), "\n"), strip), lambda s: F.startswith(s, F.lit("- ")))
    listed = F.transform(below, lambda s: F.substr(s, F.lit(3)))
    inline = F.filter(F.transform(F.split(F.substr(scalar, F.lit(2), F.length(scalar) - 2), ","), strip), lambda x: x != "")
    is_inline = F.startswith(scalar, F.lit("[")) & F.endswith(scalar, F.lit("]"))
    return F.named_struct(
        F.lit("key"), strip(key),
        F.lit("value"), F.when(~is_inline & (F.size(below) == 0), _unquote(scalar)),
        F.lit("items"), F.when(is_inline, F.transform(inline, _unquote)).when(F.size(below) > 0, F.transform(listed, _unquote)),
    )


def entries(block: Column) -> Column:
    """``ARRAY<STRUCT<key, value, items>>`` in file order; a repeated key keeps its last place."""
    found = F.regexp_extract_all(F.replace(block, F.lit("\r"), F.lit("")), F.lit(_ENTRY), 0)

    def last_only(rows: Column) -> Column:
        keys = F.transform(rows, lambda e: e["key"])
        return F.filter(rows, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))

    return let(F.transform(found, _entry), last_only)


def scalars_of(rows: Column) -> Column:
    """``MAP<key, scalar>`` of parsed entries; list-valued keys are left out."""
    return F.map_from_entries(F.transform(F.filter(rows, lambda e: e["items"].isNull()), lambda e: F.struct(e["key"], e["value"])))


def lists_of(rows: Column) -> Column:
    """``MAP<key, ARRAY<STRING>>`` of parsed entries with list values."""
    return F.map_from_entries(F.transform(F.filter(rows, lambda e: e["items"].isNotNull()), lambda e: F.struct(e["key"], e["items"])))


def scalars(block: Column) -> Column:
    return scalars_of(entries(block))


def lists(block: Column) -> Column:
    return lists_of(entries(block))


def state(content: Column) -> Column:
    """'absent', 'ok' or 'broken'. A broken block must never be rewritten."""
    return F.coalesce(block_state(block_text(content)), F.lit("absent"))


def block_state(block: Column) -> Column:
    """'ok' or 'broken' for a block's text, NULL when there is no block."""
    lines = F.filter(F.split(F.replace(block, F.lit("\r"), F.lit("")), "\n"), lambda s: strip(s) != "")

    def bad(line: Column) -> Column:
        value = strip(F.regexp_extract(line, r"^(?:[^:\n]*?:|[ \t]*-)[ \t]+(.*)$", 1))
        shape = F.rlike(line, F.lit(r"^(?:[^\s:#\-\[{\"'][^:\n]*:(?:[ \t].*)?|[ \t]*- .*|[ \t]*-|[ \t]*#.*)$"))
        closed = (
            F.when(F.startswith(value, F.lit('"')), F.rlike(value, F.lit(r'^"(?:[^"\\]|\\.)*"[ \t]*(?:#.*)?$')))
            .when(F.startswith(value, F.lit("'")), F.rlike(value, F.lit(r"^'(?:[^']|'')*'[ \t]*(?:#.*)?$")))
            .when(F.startswith(value, F.lit("[")), F.rlike(value, F.lit(r"^\[.*\][ \t]*(?:#.*)?$")))
            .when(F.startswith(value, F.lit("{")), F.rlike(value, F.lit(r"^\{.*\}[ \t]*(?:#.*)?$")))
            .otherwise(~F.rlike(value, F.lit(r":(?:[ \t]|$)")))
        )
        return ~shape | ~closed

    return F.when(F.exists(lines, bad), "broken").when(block.isNotNull(), "ok")


def lenient_value(block: Column, key: str) -> Column:
    """Value of one ``key:`` line by pattern, for blocks that do not parse."""
    pattern = rf"(?m)^{key}:\s*[\"']?([^\"'\r\n]+)[\"']?\s*$"
    return F.when(F.rlike(block, F.lit(pattern)), strip(F.regexp_extract(block, pattern, 1)))


def queue_value(content: Column, key: str) -> Column:
    """A key for queue decisions: the parsed value, or the lenient line when the block is broken."""
    block = block_text(content)
    return F.when(state(content) == "broken", lenient_value(block, key)).otherwise(
        F.try_element_at(scalars(block), F.lit(key))
    )


def tag_lines(tags: Column) -> Column:
    return (
        F.when(F.size(tags) == 0, F.lit("tags: []"))
        .when(
            tags.isNotNull(),
            F.concat(F.lit("tags:\n"), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("  - "), t)), "\n")),
        )
    )


def list_lines(key: Column, items: Column) -> Column:
    """A list-valued key: quoted block items, or ``key: []``."""
    rows = F.array_join(F.transform(items, lambda t: F.concat(F.lit("  - "), quoted(t))), "\n")
    return F.when(F.size(items) == 0, F.concat(key, F.lit(": []"))).otherwise(F.concat(key, F.lit(":\n"), rows))


def location_line(lat: Column, lon: Column) -> Column:
    """Inline ``[lat, lng]`` pair, kept unquoted for the map viewer."""
    pair = F.concat(F.lit("location: ["), lat.cast("string"), F.lit(", "), lon.cast("string"), F.lit("]"))
    return F.when(lat.isNotNull() & lon.isNotNull(), pair)


def as_int(value: Column) -> Column:
    """Integer value, 0 for anything that is not one."""
    return F.coalesce(strip(value.cast("string")).try_cast("int"), F.lit(0))


def render_map(fm: Column, tags: Column, order: list[str] | None = None) -> Column:
    """Block text of a scalar map plus tags: ordered keys first, then the rest as stored."""
    order = order or C.KEY_ORDER

    def line(key: Column, value: Column) -> Column:
        text = F.when(key == "weight", as_int(value).cast("string")).otherwise(quoted(value))
        return F.concat(key, F.lit(": "), text)

    lines = []
    for key in order:
        if key == "tags":
            lines.append(tag_lines(tags))
        else:
            lines.append(F.when(F.map_contains_key(fm, F.lit(key)), line(F.lit(key), F.try_element_at(fm, F.lit(key)))))
    rest = F.filter(F.map_keys(fm), lambda k: ~k.isin(order))
    tail = F.transform(rest, lambda k: line(k, F.try_element_at(fm, k)))
    return F.array_join(F.concat(F.array_compact(F.array(*lines)), tail), "\n")


def render_fields(fields: list[tuple[str, Column]]) -> Column:
    """Block text of already rendered ``(key, text)`` pairs; a NULL text drops its line."""
    lines = [text if key == "" else F.concat(F.lit(f"{key}: "), text) for key, text in fields]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def rebuild_card(content: Column, new_block: Column) -> Column:
    """The same note with another block. NULL when the note has no block to replace."""
    body = body_text(content)
    gap = F.when((body == "") | F.startswith(body, F.lit("\n")), F.lit("")).otherwise("\n")
    return F.when(has_block(content), F.concat(F.lit("---\n"), new_block, F.lit("\n---\n"), gap, body))
