"""Transcript and frame-selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkshelf import constants as C
from linkshelf.functions import text as T
from linkshelf.operators import transcripts as TR
from linkshelf.operators.ordered import evenly_sampled, row_numbers
from linkshelf.plans import sqltext as Q
from linkshelf.plans.derived import pick
from linkshelf.plans.registry import query


@query("p9_speech_filter", "SELECT seq FROM segments WHERE NOT (no_speech > 0.6 AND logprob < -1.0) AND trim(text) <> ''")
def _(t):
    return TR.speech_only(t.segments).select("seq")


@query("a12_speech_ratio", """
    WITH k AS (SELECT clip, sum(greatest(0, round((end_s - start_s) * 1000)::BIGINT)) AS ms FROM segments WHERE NOT (no_speech > 0.6 AND logprob < -1.0) GROUP BY clip)
    SELECT s.clip, max(s.duration) AS duration, format('{:.3f}', least(1.0::DOUBLE, coalesce(max(k.ms), 0)::DOUBLE / 1000.0::DOUBLE / max(s.duration)))::DOUBLE AS speech_ratio
    FROM segments s LEFT JOIN k ON k.clip = s.clip GROUP BY s.clip""")
def _(t):
    return TR.speech_ratio(t.segments)


_SAMPLED = """
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS p, count(*) OVER (PARTITION BY {key}) AS n FROM {table})
    SELECT {cols} FROM n WHERE n <= {cap} OR list_contains(list_transform(range({cap}), lambda i: round_even(i * ((n - 1) / {cap_1}::DOUBLE), 0)::BIGINT), p)"""


@query("w6_even_sample", _SAMPLED.format(key="clip", order="seq", table="segments", cols="clip, seq", cap=16, cap_1=15))
def _(t):
    return evenly_sampled(t.segments, ["clip"], "seq", C.MAX_KEYFRAMES).select("clip", "seq")


def _frames(t):
    """Candidate frames: one per event, in order of time within its user."""
    e = t.read("events").select("event_id", "user_id", F.unix_millis("ts").alias("ms"), (F.col("value") / 20).alias("score"))
    return e


# The selection rule as a fold in DuckDB; equal instants are one step, as in the rule.
_FOLD = """
    pts AS (SELECT user_id, epoch_ms(ts) AS ms, min(event_id) AS lead, bool_or(value / 20 > {cut}) AS cut FROM events GROUP BY user_id, epoch_ms(ts)),
    folded AS (SELECT user_id, list_reduce(list({{'ms': ms, 'cut': cut}} ORDER BY ms), lambda a, x: {{'last': CASE WHEN a.last IS NULL OR x.ms - a.last >= {gap} OR x.cut THEN x.ms ELSE a.last END,
       'kept': CASE WHEN a.last IS NULL OR x.ms - a.last >= {gap} THEN list_append(a.kept, x.ms) ELSE a.kept END}}, {{'last': NULL::BIGINT, 'kept': []::BIGINT[]}}) AS f FROM pts GROUP BY user_id),
    timed AS (SELECT f.user_id, p.lead AS event_id FROM (SELECT user_id, unnest(f.kept) AS ms FROM folded) f JOIN pts p ON p.user_id = f.user_id AND p.ms = f.ms),
    kept AS (SELECT user_id, event_id FROM timed UNION SELECT user_id, event_id FROM events WHERE value / 20 > {cut})"""

_GAP_MS = 6 * 3600 * 1000


@query("w8_frame_selection", "WITH " + _FOLD.format(cut=2.0, gap=_GAP_MS) + " SELECT user_id, event_id FROM kept")
def _(t):
    return TR.keyframes(_frames(t), "user_id", "ms", "event_id", "score", _GAP_MS, 2.0).select("user_id", "event_id")


def _suffixed(text, tag):
    for name in ("pts", "folded", "timed", "kept"):
        text = text.replace(f" {name} ", f" {name}{tag} ").replace(f"    {name} ", f"    {name}{tag} ").replace(f"FROM {name})", f"FROM {name}{tag})")
    return text


@query("w7_denser_sample", f"""
    WITH {_suffixed(_FOLD.format(cut=2.0, gap=_GAP_MS), '1')}, {_suffixed(_FOLD.format(cut=1.2, gap=_GAP_MS // 2), '2')},
    a AS (SELECT user_id, least(count(*), 16) AS frames FROM kept1 GROUP BY user_id), b AS (SELECT user_id, least(count(*), 32) AS dense_frames FROM kept2 GROUP BY user_id)
    SELECT a.user_id, frames, dense_frames, dense_frames > frames AS denser FROM a JOIN b ON b.user_id = a.user_id""")
def _(t):
    """Second attempt at half the interval and double the cap, kept only where it is larger."""
    frames = _frames(t)
    cap, dense_cap = C.MAX_KEYFRAMES, min(C.MAX_KEYFRAMES * 2, C.DENSE_KEYFRAME_CAP)

    def sample(gap, limit, cut):
        chosen = TR.keyframes(frames, "user_id", "ms", "event_id", "score", gap, cut)
        return evenly_sampled(chosen, ["user_id"], "event_id", limit).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))

    first = sample(_GAP_MS, cap, 2.0).withColumnRenamed("n", "frames")
    dense = sample(_GAP_MS // 2, dense_cap, max(0.1, 2.0 * 0.6)).withColumnRenamed("n", "dense_frames")
    return first.join(dense, "user_id").withColumn("denser", F.col("dense_frames") > F.col("frames"))


_REPEATS = "kept AS (SELECT * FROM (SELECT *, lag(line) OVER (PARTITION BY video ORDER BY pos) AS prev FROM cues) WHERE prev IS DISTINCT FROM line)"


@query("w9_repeated_lines", f"WITH {_REPEATS} SELECT video, pos, line FROM kept")
def _(t):
    return TR.without_repeats(t.cues, "video", "pos", "line").select("video", "pos", "line")


_MARKED = _REPEATS + """,
    folded AS (SELECT video, list_reduce(list({'s': start_s, 'p': pos} ORDER BY pos), lambda a, x: {'last': CASE WHEN x.s - a.last >= 10 THEN x.s ELSE a.last END,
      'due': CASE WHEN x.s - a.last >= 10 THEN list_append(a.due, x.p) ELSE a.due END}, {'last': -10.0::DOUBLE, 'due': []::BIGINT[]}) AS f FROM kept GROUP BY video),
    due AS (SELECT video, unnest(f.due) AS pos FROM folded),
    marked AS (SELECT k.video, k.pos, k.line, CASE WHEN d.pos IS NOT NULL THEN '[' || """ + Q.clock("floor(k.start_s)") + """ || ']' END AS marker
      FROM kept k LEFT JOIN due d ON d.video = k.video AND d.pos = k.pos)"""


def _marked(t):
    return TR.with_markers(TR.without_repeats(t.cues, "video", "pos", "line"), "video", "pos", "start_s")


@query("w10_time_markers", f"WITH {_MARKED} SELECT video, pos, line, marker FROM marked")
def _(t):
    return _marked(t).select("video", "pos", "line", "marker")


@query("r1_cue_transcript", f"""
    WITH {_MARKED} SELECT video, 0 AS chunk, string_agg(CASE WHEN marker IS NULL THEN line ELSE marker || ' ' || line END, ' ' ORDER BY pos) AS text FROM marked GROUP BY video""")
def _(t):
    return TR.transcript_chunks(_marked(t), "video", "pos", "line")


# Each document's lines as the cues of one caption payload, four seconds apart. Angle brackets are
# blanked and a word is put first, so that no line looks like a tag, a header or a cue time.
_LINE_LIST = f"""list_transform(string_split(text, chr(10)), lambda x, i: {{'l': 'say ' || {Q.squeeze("translate(x, '<>', '  ')")}, 's': (i - 1) * 4.0::DOUBLE}})"""
_START = "{'last': -10.0::DOUBLE, 'line': '', 'out': []::VARCHAR[]}"
_CAPTIONED = """list_reduce(LINES, lambda a, x: {'last': CASE WHEN SAME THEN a.last WHEN x.s - a.last >= 10 THEN x.s ELSE a.last END, 'line': x.l,
      'out': CASE WHEN SAME THEN a.out WHEN x.s - a.last >= 10 THEN list_concat(a.out, ['[' || CLOCK || ']', x.l]) ELSE list_append(a.out, x.l) END}, START).out"""


def _captioned(same):
    text = _CAPTIONED.replace("LINES", _LINE_LIST).replace("SAME", same).replace("START", _START)
    return text.replace("CLOCK", Q.clock("floor(x.s)"))


def _cues(make):
    lines = F.split("text", "\n")
    words = lambda x: F.concat(F.lit("say "), T.squeeze(F.translate(x, "<>", "  ")))
    return F.transform(lines, lambda x, i: make(words(x), i * 4))


@query("r1_vtt_text", f"SELECT doc_id, array_to_string({_captioned('x.l = a.line')}, ' ') AS text FROM documents")
def _(t):
    """One WebVTT payload per document, flattened inside its row."""
    pad = lambda v: F.lpad(v.cast("string"), 2, "0")
    part = lambda s, n: F.call_function("div", s.cast("bigint"), F.lit(n).cast("bigint"))
    stamp = lambda s: F.concat(pad(part(s, 3600)), F.lit(":"), pad(part(s, 60) % 60), F.lit(":"), pad(s % 60), F.lit(".000"))
    cues = _cues(lambda line, s: F.concat(stamp(s), F.lit(" --> "), stamp(s + 4), F.lit("\n<c>"), line, F.lit("</c>\n")))
    vtt = F.concat(F.lit("WEBVTT\nKind: captions\n\n"), F.array_join(cues, "\n"))
    return t.documents.select("doc_id", TR.vtt_text(vtt).alias("text"))


@query("r2_json3_text", f"SELECT doc_id, array_to_string({_captioned('FALSE')}, ' ') AS text FROM documents")
def _(t):
    event = lambda line, s: F.struct(
        (s * 1000).alias("tStartMs"),
        F.array(F.struct(F.left(line, F.lit(5)).alias("utf8")), F.struct(F.substr(line, F.lit(6)).alias("utf8"))).alias("segs"),
    )
    raw = F.to_json(F.struct(_cues(event).alias("events")))
    return t.documents.select("doc_id", TR.json3_text(raw).alias("text"))


@query("r3_speech_transcript", """
    WITH k AS (SELECT clip, seq, start_s, text, row_number() OVER (PARTITION BY clip ORDER BY start_s, seq) AS n FROM segments WHERE NOT (no_speech > 0.6 AND logprob < -1.0)),
    f AS (SELECT clip, list_reduce(list({'s': start_s, 'p': n} ORDER BY n), lambda a, x: {'last': CASE WHEN x.s - a.last >= 10 THEN x.s ELSE a.last END,
      'due': CASE WHEN x.s - a.last >= 10 THEN list_append(a.due, x.p) ELSE a.due END}, {'last': -10.0::DOUBLE, 'due': []::BIGINT[]}) AS f FROM k GROUP BY clip),
    d AS (SELECT clip, unnest(f.due) AS n FROM f)
    SELECT k.clip, (k.n - 1) // 1000 AS chunk, string_agg(CASE WHEN d.n IS NULL THEN k.text ELSE '[' || """ + Q.clock("floor(k.start_s)") + """ || '] ' || k.text END, ' ' ORDER BY k.n) AS text
    FROM k LEFT JOIN d ON d.clip = k.clip AND d.n = k.n GROUP BY k.clip, (k.n - 1) // 1000""")
def _(t):
    spoken = TR.speech_only(t.segments)
    # Time order with the segment number as tie break; blocks of a millisecond.
    placed = spoken.withColumn("at_us", F.round(F.col("start_s") * 1_000_000).cast("bigint"))
    numbered = row_numbers(placed, ["clip"], ["at_us", "start_s", "seq"], "pos", block=1_000)
    marked = TR.with_markers(numbered.select("clip", "pos", "start_s", "text"), "clip", "pos", "start_s")
    return TR.transcript_chunks(marked, "clip", "pos", "text")


# --- caption tracks -----------------------------------------------------------------------------------


def _tracks(t):
    """Six caption tracks per document in changing languages and formats."""
    langs = ["fr", "en", "en-orig", "eng-US", "live_chat", "de"]
    rows = t.documents.select("doc_id", F.posexplode(F.array(*[F.lit(x) for x in langs])).alias("k", "lang"))
    d, k = F.col("doc_id"), F.col("k")
    return rows.filter((d + k) % 4 != 0).select(
        d.alias("video"), pick(["manual", "auto"], (d + k) % 2).alias("bucket"), "lang", pick(["vtt", "json3", "srv1"], (d + k * 2) % 3).alias("ext"),
        F.lit(0).alias("entry"), F.concat(F.lit("u/"), d.cast("string"), F.lit("/"), k.cast("string")).alias("track_url"),
    )


_TRACKS = """
    tracks AS (SELECT doc_id AS video, ['manual', 'auto'][(doc_id + k) % 2 + 1] AS bucket, lang, ['vtt', 'json3', 'srv1'][(doc_id + k * 2) % 3 + 1] AS ext, 'u/' || doc_id || '/' || k AS track_url
      FROM (SELECT doc_id, unnest([0, 1, 2, 3, 4, 5]) AS k, unnest(['fr', 'en', 'en-orig', 'eng-US', 'live_chat', 'de']) AS lang FROM documents) WHERE (doc_id + k) % 4 <> 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY CASE WHEN lang = 'en' OR starts_with(lang, 'en-') OR starts_with(lang, 'eng') THEN 0 ELSE 1 END,
      CASE bucket WHEN 'manual' THEN 0 ELSE 1 END, CASE lang WHEN 'en-orig' THEN 0 ELSE 1 END, lang) AS rank FROM tracks WHERE lang <> 'live_chat' AND ext IN ('vtt', 'json3'))"""


_INFO_SQL = """
    i AS (SELECT doc_id AS video, 'u/' || doc_id || '/' AS u, lang FROM documents),
    raw AS (
      SELECT video, 'manual' AS bucket, lang, 'srv1' AS ext, 0 AS entry, u || 'a' AS track_url FROM i WHERE video % 4 <> 0
      UNION ALL SELECT video, 'manual', lang, 'vtt', 1, u || 'b' FROM i WHERE video % 4 <> 0
      UNION ALL SELECT video, 'manual', 'live_chat', 'json3', 0, u || 'c' FROM i WHERE video % 4 <> 0
      UNION ALL SELECT video, 'auto', 'en-orig', 'json3', 0, u || 'd' FROM i
      UNION ALL SELECT video, 'auto', 'pt', 'vtt', 0, u || 'e' FROM i)"""


def _caption_info(t):
    """Raw metadata lines as the fetcher stores them, read back as maps."""
    d, u = F.col("doc_id"), lambda k: F.concat(F.lit("u/"), F.col("doc_id").cast("string"), F.lit("/" + k))
    entry = lambda ext, k: F.struct(F.lit(ext).alias("ext"), u(k).alias("url"))
    subs = F.map_from_arrays(F.array("lang", F.lit("live_chat")), F.array(F.array(entry("srv1", "a"), entry("vtt", "b")), F.array(entry("json3", "c"))))
    auto = F.map_from_arrays(F.array(F.lit("en-orig"), F.lit("pt")), F.array(F.array(entry("json3", "d")), F.array(entry("vtt", "e"))))
    line = F.to_json(F.struct(F.when(d % 4 != 0, subs).alias("subtitles"), auto.alias("automatic_captions")))
    tracks = "map<string,array<struct<ext:string,url:string>>>"
    info = F.from_json(line, f"subtitles {tracks}, automatic_captions {tracks}")
    return t.documents.select(d.alias("video"), info.alias("i")).select("video", "i.*")


@query("w12_caption_tracks", f"WITH {_INFO_SQL} SELECT video, bucket, lang, ext, entry, track_url FROM raw")
def _(t):
    return TR.caption_tracks(_caption_info(t))


@query("w12_info_to_best_track", f"""
    WITH {_INFO_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY CASE WHEN lang = 'en' OR starts_with(lang, 'en-') OR starts_with(lang, 'eng') THEN 0 ELSE 1 END,
      CASE bucket WHEN 'manual' THEN 0 ELSE 1 END, CASE lang WHEN 'en-orig' THEN 0 ELSE 1 END, lang) AS rank FROM raw WHERE lang <> 'live_chat' AND ext IN ('vtt', 'json3'))
    SELECT video, rank, track_url FROM ranked WHERE rank <= 3""")
def _(t):
    return TR.ranked_tracks(TR.caption_tracks(_caption_info(t))).select("video", "rank", "track_url")


@query("w12_track_ranking", f"WITH {_TRACKS} SELECT video, rank, track_url FROM ranked WHERE rank <= 3")
def _(t):
    return TR.ranked_tracks(_tracks(t)).select("video", "rank", "track_url")


@query("r4_best_track", f"""
    WITH {_TRACKS}, x AS (SELECT video, min(rank) FILTER (WHERE NOT (video % 3 = 0 AND ext = 'vtt')) AS rank FROM ranked WHERE rank <= 3 GROUP BY video)
    SELECT x.video, coalesce(CASE r.ext WHEN 'vtt' THEN '[0:01] hello ' ELSE '[0:00] hello ' END || r.track_url, '') AS text FROM x LEFT JOIN ranked r ON r.video = x.video AND r.rank = x.rank""")
def _(t):
    best = TR.ranked_tracks(_tracks(t))
    # Every third video's VTT tracks are empty.
    words = F.concat(F.lit("hello "), F.col("track_url"))
    vtt = F.when(F.col("video") % 3 == 0, "WEBVTT\n\n").otherwise(F.concat(F.lit("WEBVTT\n\n00:00:01.000 --> 00:00:02.000\n"), words))
    json3 = F.to_json(F.struct(F.array(F.struct(F.lit(900).alias("tStartMs"), F.array(F.struct(words.alias("utf8"))).alias("segs"))).alias("events")))
    payloads = _tracks(t).select("track_url", F.when(F.col("ext") == "vtt", vtt).otherwise(json3).alias("payload"))
    return TR.best_track_text(best, payloads)


@query("r5_transcript_choice", """
    WITH c AS (SELECT doc_id, text FROM video_metadata)
    SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'cached' WHEN doc_id % 3 = 0 THEN text WHEN doc_id % 7 = 0 THEN 'heard' ELSE '' END AS transcript,
      CASE WHEN doc_id % 5 = 0 THEN 'captions' WHEN doc_id % 3 = 0 THEN 'captions' WHEN doc_id % 7 = 0 THEN 'whisper' ELSE 'none' END AS transcript_source FROM c""")
def _(t):
    d = F.col("doc_id")
    stage = lambda keep, text, name: t.video_metadata.filter(keep).select("doc_id", text.alias(name))
    rows = t.video_metadata.select("doc_id")
    rows = rows.join(stage(d % 5 == 0, F.lit("cached"), "cached"), "doc_id", "left")
    rows = rows.join(stage(d % 3 == 0, F.col("text"), "captions"), "doc_id", "left")
    rows = rows.join(stage(d % 7 == 0, F.lit("heard"), "asr"), "doc_id", "left")
    cols = TR.transcript_choice(F.col("cached"), F.lit("captions"), F.col("captions"), F.col("asr"))
    return rows.select("doc_id", *[c.alias(n) for n, c in cols.items()])
