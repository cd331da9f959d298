"""Text columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkshelf import constants as C
from linkshelf.functions.bind import let

# The same characters as SPACE_CHARS; Java matches this spelling several times faster than explicit ranges.
_SPACES = r"(?U)[\s\x1c-\x1f]+"


def text_or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(C.SPACE_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(C.SPACE_CHARS))


def squeeze(c: Column) -> Column:
    """Stripped, with every run of whitespace turned into one blank."""
    return F.trim(F.regexp_replace(c, _SPACES, " "))


def first_of(*cols: Column) -> Column:
    """First value that is neither NULL nor ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols[:-1]], cols[-1])


def contains_any(c: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(n)) for n in needles])


def hashtags(text: Column) -> Column:
    """Distinct hashtags in first-seen order."""
    return F.array_distinct(F.regexp_extract_all(text_or_blank(text), F.lit(r"#([\p{L}\p{N}_]+)"), 1))


def caption_title(caption: Column, fallback: str, limit: int = 60) -> Column:
    """Title for a post that only has a caption."""
    caption = text_or_blank(caption)
    cut = F.when(F.length(caption) > limit, F.concat(F.left(caption, F.lit(limit)), F.lit("..."))).otherwise(caption)
    return first_of(strip(cut), F.lit(fallback))


def has_list_claim(text: Column) -> Column:
    """A numbered, favourite or ranked list is announced.

    Every form needs a digit or one of three words, which is far cheaper to test than the
    whole pattern on long captions.
    """
    text = text_or_blank(text)
    likely = F.rlike(text, F.lit(r"\p{Nd}")) | contains_any(F.lower(text), ["favo", "ranking", "tier"])
    return likely & F.rlike(text, F.lit("(?iU)" + C.LIST_CLAIM_PATTERN))


def caption_is_sparse(caption: Column, limit: int = C.SPARSE_CAPTION_CHARS) -> Column:
    return F.length(strip(text_or_blank(caption))) < limit


def needs_vision(text: Column) -> Column:
    """Too little text, or text that says there is no speech."""
    cleaned = strip(text_or_blank(text))
    return (F.length(cleaned) < C.MIN_TRANSCRIPT_CHARS) | contains_any(F.lower(cleaned), C.MUSIC_ONLY_MARKERS)


def word_count(text: Column) -> Column:
    cleaned = strip(text_or_blank(text))
    return F.when(cleaned == "", F.lit(0)).otherwise(F.size(F.split(cleaned, _SPACES)))


def failure_class(stderr: Column) -> Column:
    """'permanent' wins over 'transient'; NULL when nothing is recognised."""
    low = F.lower(text_or_blank(stderr))
    return F.when(contains_any(low, C.PERMANENT_MARKERS), F.lit("permanent")).when(
        contains_any(low, C.TRANSIENT_MARKERS), F.lit("transient")
    )


def _is_reserved(name: Column) -> Column:
    return F.upper(F.substring_index(name, ".", 1)).isin(C.RESERVED_NAMES)


def safe_filename(title: Column, limit: int = 60, fallback: str = "Saved Video") -> Column:
    """File stem that every desktop file system accepts."""
    legal = F.regexp_replace(text_or_blank(title), C.ILLEGAL_NAME_CHARS, "")
    cut = F.rtrim(strip(F.left(squeeze(legal), F.lit(limit))), F.lit(". "))

    def named(stem: Column) -> Column:
        return F.when(stem == "", F.lit(fallback)).when(_is_reserved(stem), F.concat(F.lit("_"), stem)).otherwise(stem)

    return let(cut, named)


def folder_segment(raw: Column) -> Column:
    """A single folder name, or NULL when it must be rejected (nothing is repaired)."""

    def checked(name: Column) -> Column:
        bad = (
            (name == "")
            | F.startswith(name, F.lit("."))
            | F.rlike(name, F.lit(C.ILLEGAL_NAME_CHARS))
            | (F.rtrim(name, F.lit(". ")) != name)
            | _is_reserved(name)
        )
        return F.when(~bad, name)

    return let(squeeze(text_or_blank(raw)), checked)


def project_name(raw: Column) -> Column:
    """A project folder name with illegal characters removed; slashes are rejected."""
    text = text_or_blank(raw)
    slashed = F.rlike(text, F.lit(r"[/\\]"))
    return let(
        safe_filename(squeeze(text), 80, ""),
        lambda name: F.when(~slashed & (name != "") & ~F.startswith(name, F.lit(".")), name),
    )


def heading_title(body: Column, stem: Column) -> Column:
    """First non-empty H1, else the file stem."""
    found = F.regexp_extract_all(body, F.lit(r"(?m)^# (.*)$"), 1)
    named = F.filter(F.transform(found, strip), lambda t: t != "")
    return F.coalesce(F.get(named, F.lit(0)), stem)


def body_summary(body: Column) -> Column:
    """The quoted summary line, '' when absent."""
    return strip(F.regexp_extract(text_or_blank(body), r"(?m)^> \*\*Summary:\*\*\s*(.+)$", 1))


def body_context(body: Column) -> Column:
    """The quoted summary or context line, '' when absent."""
    return strip(F.regexp_extract(text_or_blank(body), r"(?m)^> \*\*(?:Summary|Context):\*\*\s*(.+)$", 1))


# Headings that start a notes section (fixed values).
ENRICHED_NOTES = "Notes & Insights|Actionable Notes"
ANALYZED_NOTES = (
    "Notes & Insights|Actionable Notes|Exercises & Movement Routine|Ingredients & Preparation|Artist & Sound|Review"
)


def notes_section(body: Column, headings: str, default: str) -> Column:
    """From the first notes heading to the end, else ``default``."""
    found = F.regexp_extract(body, rf"(?ms)^(## (?:{headings})[ \t]*$.*)\z", 1)
    return F.when(found != "", F.concat(rstrip(found), F.lit("\n"))).otherwise(F.lit(default))


def excerpt(body: Column, limit: int = 280) -> Column:
    """Short single-line preview of the notes, or of the whole body."""
    notes = F.regexp_extract(body, r"(?ms)^## Notes[^\n]*\n(.*)\z", 1)
    has_notes = F.rlike(body, F.lit(r"(?m)^## Notes[^\n]*\n"))

    def cut(text: Column) -> Column:
        return (
            F.when(text == "", F.lit("(no notes)"))
            .when(F.length(text) > limit, F.concat(rstrip(F.left(text, F.lit(limit))), F.lit("...")))
            .otherwise(text)
        )

    return let(squeeze(F.when(has_notes, notes).otherwise(body)), cut)


def checklist(items: Column) -> Column:
    """One unchecked box per non-blank item."""
    cleaned = F.filter(F.transform(F.coalesce(items, F.array()), squeeze), lambda s: s.isNotNull() & (s != ""))
    lines = F.array_join(F.transform(cleaned, lambda s: F.concat(F.lit("- [ ] "), s)), "\n")
    return F.when(F.size(cleaned) > 0, lines).otherwise("- [ ]")


def estimated_tokens(prompt_chars: Column, images: Column) -> Column:
    """Four characters per token, a fixed overhead, and a flat price per image."""
    return F.floor(prompt_chars / 4) + 400 + images * C.TOKENS_PER_IMAGE


def estimated_video_tokens(prompt_chars: Column, seconds: Column, fps: Column) -> Column:
    """Estimate when the clip itself is sent instead of frames."""
    clip = F.floor(F.greatest(seconds, F.lit(1.0)) * fps * 100)
    return F.floor(prompt_chars / 4) + 400 + clip


def clock(seconds: Column) -> Column:
    """Whole seconds as ``m:ss``; negatives are zero."""
    whole = F.greatest(F.lit(0), seconds.cast("bigint"))
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def cue_seconds(stamp: Column) -> Column:
    """``h:mm:ss.mmm`` (or shorter) as seconds; 0 when any part is not a number."""
    parts = F.transform(
        F.split(strip(stamp), ":"), lambda p: strip(F.replace(p, F.lit(","), F.lit("."))).try_cast("double")
    )
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc * 60 + x)
    return F.coalesce(total, F.lit(0.0))


def state_text(title, creator, caption, tags, transcript) -> Column:
    """Classifier input for a freshly fetched item."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Title: "), text_or_blank(title)),
        F.concat(F.lit("Creator: "), text_or_blank(creator)),
        F.concat(F.lit("Caption: "), text_or_blank(caption)),
        F.concat(F.lit("Hashtags: "), F.array_join(F.slice(F.coalesce(tags, F.array()), 1, 20), ", ")),
        F.concat(F.lit("Transcript: "), first_of(transcript, F.lit("none"))),
    )


def analysis_state_text(
    title, creator, caption, tags, folder, source, transcript, summary=None, findings=None, items=None
) -> Column:
    """Classifier input for a catalogued item, with the analysis when there is one."""
    parts = [
        F.concat(F.lit("Title: "), text_or_blank(title)),
        F.concat(F.lit("Creator: "), text_or_blank(creator)),
        F.concat(F.lit("Caption: "), text_or_blank(caption)),
        F.concat(F.lit("Hashtags: "), F.array_join(F.slice(tags, 1, 20), ", ")),
        F.concat(F.lit("Current folder: "), first_of(folder, F.lit("unknown"))),
        F.concat(F.lit("Transcript ("), source, F.lit("): "), first_of(transcript, F.lit("none"))),
    ]
    if summary is not None:
        parts.append(F.concat(F.lit("Summary: "), summary))
        parts.append(F.when(F.size(findings) > 0, F.concat(F.lit("Findings: "), F.array_join(F.slice(findings, 1, 15), " | "))))
        parts.append(F.when(F.size(items) > 0, F.concat(F.lit("Items: "), F.array_join(F.slice(items, 1, 40), "; "))))
    return F.concat_ws("\n", *parts)


def capped_state(text: Column, limit: int = C.MAX_STATE_CHARS) -> Column:
    """Text cut at the classifier's input size, with a marker when cut."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit(" [truncated]"))).otherwise(text)
