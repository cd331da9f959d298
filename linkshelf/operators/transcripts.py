"""Transcript shaping.

A caption payload is one row, so it is flattened inside the row with no shuffle. Cue and
segment tables, which can put any number of rows under one clip, go through the block-wise
ordered operators and come out in numbered chunks whose concatenation is the transcript.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkshelf import constants as C
from linkshelf.functions.bind import let
from linkshelf.functions.numbers import rounded
from linkshelf.functions.text import clock, cue_seconds, strip, text_or_blank
from linkshelf.operators.ordered import previous_value, row_numbers, spaced_points

_EVENTS = "array<struct<tStartMs:double,segs:array<struct<utf8:string>>>>"
_STRINGS = "array<string>"


def _marked_text(entries: Column, every: float, drop_repeats: bool) -> Column:
    """Join ``ARRAY<STRUCT<at, text>>`` in order with a ``[m:ss]`` marker where one is due; entries without text fall out.

    The fold carries the clock and the places of the markers only. The text is joined once, in pieces from one marker to
    the next, so the cost of a payload follows its length.
    """
    texts = lambda rows: F.transform(rows, lambda e: e["text"])

    def without_repeats(spoken: Column) -> Column:
        before = F.slice(F.concat(F.array(F.lit(None).cast("string")), texts(spoken)), F.lit(1), F.size(spoken))
        return F.filter(F.zip_with(spoken, before, lambda e, b: F.when(b.isNull() | (e["text"] != b), e)), lambda e: e.isNotNull())

    def due(kept: Column) -> Column:
        start = F.struct(F.lit(-float(every)).alias("mark"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("due"))

        def step(acc: Column, entry: Column) -> Column:
            late = entry["at"] - acc["mark"] >= every
            return F.struct(
                F.when(late, entry["at"]).otherwise(acc["mark"]).alias("mark"), (acc["i"] + 1).alias("i"),
                F.when(late, F.array_append(acc["due"], acc["i"])).otherwise(acc["due"]).alias("due"),
            )

        return F.aggregate(kept, start, step)["due"]

    def joined(kept: Column, marks: Column) -> Column:
        ends = F.concat(F.slice(marks, F.lit(2), F.size(marks)), F.array(F.size(kept)))
        spans = F.zip_with(marks, ends, lambda f, t: F.struct(f.alias("f"), t.alias("t")))
        piece = lambda p: F.concat(
            F.lit("["), clock(F.get(kept, p["f"])["at"]), F.lit("] "), F.array_join(texts(F.slice(kept, p["f"] + 1, p["t"] - p["f"])), " ")
        )
        # What comes before the first marker: nothing, unless the clock starts below zero.
        head = F.array_join(texts(F.slice(kept, F.lit(1), F.coalesce(F.get(marks, F.lit(0)), F.size(kept)))), " ")
        pieces = F.when(F.size(marks) > 0, F.transform(spans, piece)).otherwise(F.array().cast(_STRINGS))
        return F.array_join(F.filter(F.concat(F.array(head), pieces), lambda x: x != ""), " ")

    spoken = F.filter(entries, lambda e: text_or_blank(e["text"]) != "")
    last = lambda kept: let(due(kept), lambda marks: joined(kept, marks))
    return let(spoken, lambda rows: let(without_repeats(rows), last)) if drop_repeats else let(spoken, last)


def vtt_text(vtt: Column, every: float = C.MARKER_SECONDS) -> Column:
    """WebVTT payload to text with coarse ``[m:ss]`` markers and no rolling repeats."""
    lines = F.transform(F.split(text_or_blank(vtt), r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\x{2028}\x{2029}]"), strip)
    header = r"^(?:WEBVTT|NOTE|Kind:|Language:|STYLE|\p{Nd}+$)"
    useful = F.filter(lines, lambda s: (s != "") & ~F.rlike(s, F.lit(header)))

    # Every cue line begins a part: its time holds for the lines up to the next one.
    parts = F.split(F.array_join(useful, "\n"), r"(?md)^(?=[^\n]*-->)")

    def spoken(part: Column) -> Column:
        def entries(rows: Column) -> Column:
            is_cue = F.contains(F.get(rows, F.lit(0)), F.lit("-->"))
            at = F.when(is_cue, cue_seconds(F.substring_index(F.get(rows, F.lit(0)), "-->", 1))).otherwise(0.0)
            rest = F.slice(rows, F.when(is_cue, 2).otherwise(1), F.size(rows))
            return let(at, lambda t: F.transform(
                rest, lambda raw: F.struct(t.alias("at"), strip(F.regexp_replace(raw, "<[^>]+>", "")).alias("text"))))

        return let(F.split(part, "\n"), entries)

    return _marked_text(F.flatten(F.transform(parts, spoken)), every, True)


def json3_text(raw: Column, every: float = C.MARKER_SECONDS) -> Column:
    """json3 captions to text with markers; '' when the payload does not parse."""
    events = F.coalesce(F.from_json(raw, f"events {_EVENTS}")["events"], F.array().cast(_EVENTS))

    def entry(event: Column) -> Column:
        pieces = F.transform(F.coalesce(event["segs"], F.array().cast("array<struct<utf8:string>>")), lambda s: text_or_blank(s["utf8"]))
        return F.struct(
            (F.coalesce(event["tStartMs"], F.lit(0.0)) / 1000.0).alias("at"), strip(F.array_join(pieces, "")).alias("text")
        )

    return _marked_text(F.transform(events, entry), every, False)


def speech_only(segments: DataFrame) -> DataFrame:
    """Segments the recogniser itself does not doubt, with text."""
    doubtful = (F.coalesce("no_speech", F.lit(0.0)) > C.NO_SPEECH_MAX) & (F.coalesce("logprob", F.lit(0.0)) < C.LOGPROB_MIN)
    return segments.filter(~doubtful & (strip(text_or_blank(F.col("text"))) != ""))


def speech_ratio(segments: DataFrame) -> DataFrame:
    """Share of each clip that is speech, three decimals, 0 for an unknown duration.

    Clips whose segments are all dropped keep a row with ratio 0. Sums are in whole
    milliseconds so the result does not depend on row order.
    """
    spoken = speech_only(segments).select(
        "clip", F.greatest(F.lit(0), F.round((F.col("end_s") - F.col("start_s")) * 1000).cast("bigint")).alias("ms")
    ).groupBy("clip").agg(F.sum("ms").alias("speech_ms"))
    clips = segments.groupBy("clip").agg(F.max("duration").alias("duration"))
    ratio = F.least(F.lit(1.0), F.coalesce("speech_ms", F.lit(0)) / 1000.0 / F.col("duration"))
    return clips.join(spoken, "clip", "left").select(
        "clip", "duration",
        F.when(F.col("duration") > 0, rounded(ratio, 3)).otherwise(0.0).alias("speech_ratio"),
    )


def without_repeats(cues: DataFrame, key: str, pos: str, line: str) -> DataFrame:
    """Cue lines minus those equal to the line before them."""
    filled = cues.filter(strip(text_or_blank(F.col(line))) != "")
    rows = previous_value(filled, [key], pos, F.col(line), "__prev")
    return rows.filter(~F.col(line).eqNullSafe(F.col("__prev"))).drop("__prev")


def with_markers(lines: DataFrame, key: str, pos: str, start_s: str, every: float = C.MARKER_SECONDS) -> DataFrame:
    """Adds ``marker`` (``[m:ss]`` or NULL): due when ``every`` seconds passed since the last one."""
    timed = lines.withColumn("__ms", F.round(F.col(start_s) * 1000).cast("bigint"))
    due = spaced_points(timed, key, "__ms", int(every * 1000))
    lead = timed.groupBy(key, "__ms").agg(F.min(pos).alias(pos))
    marked = due.join(lead, [key, "__ms"]).select(key, pos, F.lit(True).alias("__due"))
    mark = F.concat(F.lit("["), clock(F.col(start_s)), F.lit("]"))
    return timed.join(marked, [key, pos], "left").withColumn("marker", F.when(F.col("__due"), mark)).drop("__ms", "__due")


def transcript_chunks(lines: DataFrame, key: str, pos: str, text: str, chunk: int = 1000) -> DataFrame:
    """Marked lines joined into numbered pieces of at most ``chunk`` lines.

    Pieces of one clip joined by blanks, in order, are its transcript; a clip of ordinary
    length has exactly one piece, so no task ever holds more than ``chunk`` lines of a clip.
    """
    numbered = row_numbers(lines, [key], pos, "__n").withColumn("chunk", F.expr(f"(__n - 1) div {chunk}L"))
    word = F.concat_ws(" ", F.col("marker"), F.col(text))
    parts = numbered.groupBy(key, "chunk").agg(F.array_sort(F.collect_list(F.struct(F.col("__n").alias("n"), word.alias("w")))).alias("ws"))
    return parts.select(key, "chunk", F.array_join(F.transform("ws", lambda x: x["w"]), " ").alias("text"))


def keyframes(frames: DataFrame, key: str, at_ms: str, order: str, score: str, interval_ms: int,
              cut_threshold: float = C.CUT_THRESHOLD) -> DataFrame:
    """Frames kept by the selection rule: the first, every cut, and one per interval."""
    cut = F.col(score) > cut_threshold
    due = spaced_points(frames, key, at_ms, interval_ms, cut)
    lead = frames.groupBy(key, at_ms).agg(F.min(order).alias(order))
    timed = due.join(lead, [key, at_ms]).select(key, order, F.lit(True).alias("__due"))
    return frames.join(timed, [key, order], "left").filter(F.col("__due") | cut).drop("__due")


def caption_tracks(info: DataFrame) -> DataFrame:
    """Caption tracks of raw metadata, one row each: ``video, bucket, lang, ext, entry, track_url``.

    ``info`` has ``video`` and the maps ``subtitles`` and ``automatic_captions`` from language to an array of
    ``ext, url``. ``entry`` is the place in that array.
    """
    buckets = F.array(
        F.struct(F.lit("manual").alias("bucket"), F.col("subtitles").alias("tracks")),
        F.struct(F.lit("auto").alias("bucket"), F.col("automatic_captions").alias("tracks")))
    by_bucket = info.select("video", F.explode(buckets).alias("b")).select("video", "b.*")
    by_lang = by_bucket.select("video", "bucket", F.explode("tracks").alias("lang", "entries"))
    return by_lang.select("video", "bucket", "lang", F.posexplode("entries").alias("entry", "e")).select(
        "video", "bucket", "lang", F.col("e.ext").alias("ext"), "entry", F.col("e.url").alias("track_url"))


def ranked_tracks(tracks: DataFrame, limit: int = 3) -> DataFrame:
    """Best caption tracks per video: manual English, automatic English, manual, automatic.

    ``tracks`` has ``video, bucket ('manual'|'auto'), lang, ext, entry, track_url``. The original
    English track leads its group and VTT precedes json3.
    """
    low = F.lower("lang")
    english = (low == "en") | F.startswith(low, F.lit("en-")) | F.startswith(low, F.lit("eng"))
    usable = tracks.filter(
        (F.col("lang") != "live_chat") & F.col("ext").isin("vtt", "json3") & (text_or_blank(F.col("track_url")) != "")
    )
    # The candidate count per video is unbounded, so the top ``limit`` is cut before the shuffle by the rank filter.
    order = Window.partitionBy("video").orderBy(
        F.when(english, 0).otherwise(1), F.when(F.col("bucket") == "manual", 0).otherwise(1),
        F.when(low == "en-orig", 0).otherwise(1), "lang", F.when(F.col("ext") == "vtt", 0).otherwise(1), "entry",
    )
    return usable.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def best_track_text(ranked: DataFrame, payloads: DataFrame) -> DataFrame:
    """First non-blank flattened text among the ranked tracks; '' when none is usable."""
    raw = F.col("payload")
    text = F.when(F.col("ext") == "json3", json3_text(raw)).otherwise(vtt_text(raw))
    flat = ranked.join(payloads, "track_url", "left").withColumn("text", text)
    chosen = F.min_by("text", F.when(strip(text_or_blank(F.col("text"))) != "", F.col("rank")))
    return flat.groupBy("video").agg(F.coalesce(chosen, F.lit("")).alias("text"))


def transcript_choice(cached: Column, cached_source: Column, captions: Column, asr: Column) -> dict[str, Column]:
    """Text and its source: cached stage, then captions, then recognised speech, then none."""
    has_captions = text_or_blank(captions) != ""
    has_asr = text_or_blank(asr) != ""
    return {
        "transcript": F.when(cached.isNotNull(), cached).when(has_captions, captions).when(has_asr, asr).otherwise(""),
        "transcript_source": F.when(cached.isNotNull(), F.coalesce(cached_source, F.lit("none")))
        .when(has_captions, "captions").when(has_asr, "whisper").otherwise("none"),
    }
