"""End-to-end and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkshelf import constants as C
from linkshelf.functions.urls import canonical_url
from linkshelf.operators.scoring import rule_scorer
from linkshelf.operators.sets import union_all
from linkshelf.plans import ingest
from linkshelf.plans import sqltext as Q
from linkshelf.plans.gates import _ATTEMPTS
from linkshelf.plans.registry import query
from linkshelf.plans.texts import card_sql
from linkshelf.session import scratch_path
from linkshelf.sources import readers
from linkshelf.streaming import incremental as INC

# --- captures to cards -------------------------------------------------------------------------


def _shared(t):
    """Share lines of catalogued videos: three spellings each, and lines that are no URL."""
    d = F.col("doc_id")
    spellings = F.array(
        F.concat("url", F.lit("?utm_source=x")), F.concat(F.lit("  "), "url", F.lit("/")), F.concat(F.lit("HTTPS"), F.substr("url", F.lit(6))),
        F.concat(F.lit("note "), d.cast("string")),
    )
    rows = t.video_metadata.select("doc_id", F.posexplode(spellings).alias("k", "line"))
    return rows.select((d * 4 + F.col("k")).alias("seq"), "line")


_RULES = {
    "travel": "Travel", "places": "Travel", "song": "Saved Music", "recipe": "Recipes & Food", "workout": "Fitness & Health", "code": "Tech & Coding", "movie": "Movies & Shows",
}
_TEXT = "lower(left(title, 70) || ' ' || left(description, 90))"
_RULED = "(CASE " + " ".join(f"WHEN contains({_TEXT}, {Q.lit(w)}) THEN {Q.lit(c)}" for w, c in _RULES.items()) + " ELSE 'Miscellaneous' END)"


def _classified(t):
    """Of a caption only what a payload shows is carried along; cards are written without it."""
    shown = F.left("description", F.lit(C.CAPTION_CHARS)).alias("description")
    metadata = t.video_metadata.select("doc_id", "url", "title", shown, "creator", "tags")
    items = ingest.new_items(_shared(t), t.ledger, metadata)
    return ingest.classified(items, rule_scorer(), "doc_id")


def captured_cards(t):
    existing = t.cards.select("folder", F.regexp_replace("name", r"\.md$", "").alias("stem"))
    return ingest.cards(_classified(t), existing, "doc_id")


_RULED_ROWS = f"""SELECT doc_id, {_RULED} AS cat0, title AS title0, coalesce(creator, '') AS raw_creator, url, array_to_string(tags, ', ') AS tags_text,
    array_to_string(list_filter(string_split_regex({_TEXT}, '\\s+'), lambda x: x <> '')[1:8], ' ') AS summary
    FROM video_metadata WHERE url NOT IN (SELECT url FROM ledger)"""
# No title here looks like ``a (2)``: the n-th of a name in its folder is numbered n.
_NAMED = f"""
    WITH k AS ({card_sql(_RULED_ROWS)}),
    s AS (SELECT k.doc_id, url, k.category, {Q.folder('k.category')} AS folder, {Q.safe_filename('k.title')} AS stem, content FROM k JOIN video_metadata v ON v.doc_id = k.doc_id),
    named AS (SELECT *, stem || CASE WHEN nth > 1 THEN ' (' || nth || ')' ELSE '' END AS final_stem FROM (
      SELECT *, row_number() OVER (PARTITION BY folder, stem ORDER BY doc_id) AS nth FROM s))"""


query("capture_to_card", f"{_NAMED} SELECT doc_id AS seq, url, category, folder, final_stem, md5(content) AS content_md5 FROM named")(
    lambda t: captured_cards(t).select("seq", "url", "category", "folder", "final_stem", F.md5("content").alias("content_md5")))


@query("capture_to_card_sinks", f"""
    {_NAMED.replace("WHERE url NOT IN (SELECT url FROM ledger)", "WHERE url NOT IN (SELECT url FROM ledger) AND doc_id % 10 <> 7")},
    q AS (SELECT url FROM video_metadata WHERE url NOT IN (SELECT url FROM ledger) AND doc_id % 10 = 7)
    SELECT 'card' AS sink, url, category, final_stem AS detail FROM named UNION ALL SELECT 'event', url, category, 'carded' FROM named
    UNION ALL SELECT 'queue', url, NULL, NULL FROM q""")
def _(t):
    """Cards, ledger events and what stays queued, after two runs over one queue: the second finds its work done."""
    root = scratch_path(t.spark, "sinks")
    rows = _classified(t)
    for _ in range(2):
        left = ingest.write_cards(rows, f"{root}/cards", f"{root}/ledger", "doc_id", F.col("doc_id") % 10 != 7)
    written, events = t.spark.read.parquet(f"{root}/cards"), t.spark.read.parquet(f"{root}/ledger")
    none = F.lit(None).cast("string")
    return union_all(
        written.select(F.lit("card").alias("sink"), "url", "category", F.col("stem").alias("detail")),
        events.select(F.lit("event").alias("sink"), "url", "category", F.col("event").alias("detail")),
        left.select(F.lit("queue").alias("sink"), "url", none.alias("category"), none.alias("detail")))


@query("a7_write_counters", f"""
    WITH n AS (SELECT {_RULED} AS category FROM video_metadata WHERE url NOT IN (SELECT url FROM ledger))
    SELECT category, {Q.folder('category')} AS folder, count(*) AS created FROM n GROUP BY category""")
def _(t):
    return captured_cards(t).groupBy("category", "folder").agg(F.count(F.lit(1)).alias("created"))


# --- streams -------------------------------------------------------------------------------------


def _drop(df, name):
    """Write derived rows as the files a stream reads."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def _in_parts(df, along, name, run, parts=3):
    """Write derived rows in several parts along a column, and let ``run(stream)`` take each before the next is there.

    Every part is a micro-batch of its own, and every run but the first starts from the checkpoint.
    """
    path = scratch_path(df.sparkSession, name)
    cuts = df.agg(F.percentile_approx(along, [k / parts for k in range(1, parts)])).first()[0] or []
    part = sum((F.when(F.col(along) > cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    for k in range(parts):
        df.filter(part == k).write.mode("append").parquet(path)
        run(df.sparkSession.readStream.schema(df.schema).parquet(path)).awaitTermination()


def _latest(spark, path):
    """The newest of the versions a stream has written, one a micro-batch."""
    versions = spark.read.parquet(path)
    return versions.filter(F.col("v") == versions.agg(F.max("v")).scalar()).drop("v")


@query("x1_capture_stream", "SELECT DISTINCT url FROM capture_urls WHERE valid")
def _(t):
    folder, root = scratch_path(t.spark, "inbox"), scratch_path(t.spark, "x1")
    t.captures.select("line").write.text(folder)
    INC.capture_stream(readers.stream_captures(t.spark, folder), f"{root}/ledger", f"{root}/invalid", f"{root}/ck").awaitTermination()
    return t.spark.read.parquet(f"{root}/ledger").select("url")


@query("s2_capture_stream_invalid", "SELECT DISTINCT trim(line) AS line FROM capture_urls WHERE NOT valid")
def _(t):
    """One capture list read in three runs: each run takes the lines that came after the one before."""
    folder, root = scratch_path(t.spark, "inbox"), scratch_path(t.spark, "s2")
    for part in range(3):
        t.captures.filter(F.col("seq") % 3 == part).select("line").write.mode("append").text(folder)
        lines = readers.stream_appended_captures(t.spark, folder)
        INC.capture_stream(lines, f"{root}/ledger", f"{root}/invalid", f"{root}/ck").awaitTermination()
    return t.spark.read.parquet(f"{root}/invalid").select("line").distinct()


@query("x2_stream_dedupe", "SELECT DISTINCT url FROM ledger")
def _(t):
    root = scratch_path(t.spark, "x2")
    _in_parts(t.analysis_state.select("url", "seq"), "seq", "x2-in", lambda rows: INC.dedupe_stream(rows, f"{root}/out", f"{root}/ck"))
    return t.spark.read.parquet(f"{root}/out").select("url")


@query("x3_attempts_stream", f"""
    WITH {_ATTEMPTS} SELECT url, max(seq) AS seq, max_by(status, seq) AS status, max_by(base + fails, seq)::BIGINT AS attempts FROM b GROUP BY url""")
def _(t):
    root = scratch_path(t.spark, "x3")
    status = F.col("status")
    log = t.analysis_state.select(
        "url", "seq", "status", F.col("attempts").alias("passes"), status.isin("done", "needs-review").alias("is_success"),
        status.isin("failed-retryable", "manual-review").alias("is_failure"),
    )
    _in_parts(log, "seq", "x3-in", lambda rows: INC.attempts_stream(rows, f"{root}/state", f"{root}/ck"))
    return INC.newest(t.spark.read.parquet(f"{root}/state"), ["url"])


@query("x3_latest_status_stream", "SELECT url, max(seq) AS seq, max_by(status, seq) AS status FROM analysis_state GROUP BY url")
def _(t):
    root = scratch_path(t.spark, "x3b")
    rows = t.analysis_state.select("url", "seq", "status")
    _in_parts(rows, "seq", "x3b-in", lambda part: INC.updates_stream(INC.latest_status(part), f"{root}/out", f"{root}/ck"))
    return INC.newest(t.spark.read.parquet(f"{root}/out"), ["url"])


@query("x4_live_load", """
    WITH w AS (SELECT key, in_tokens, to_timestamp(epoch(ts)::BIGINT // 10 * 10 - unnest([0, 10, 20, 30, 40, 50]))::TIMESTAMP AS from_ts FROM request_log)
    SELECT key, from_ts, from_ts + INTERVAL 60 SECONDS AS to_ts, count(*) AS requests, sum(in_tokens)::BIGINT AS tokens, count(*) > 5 AS over_limit FROM w GROUP BY key, from_ts""")
def _(t):
    root = scratch_path(t.spark, "x4")
    rows = t.request_log.select("key", "ts", "in_tokens", F.unix_seconds("ts").alias("second"))
    _in_parts(rows, "second", "x4-in", lambda part: INC.updates_stream(INC.live_load(part, 5), f"{root}/out", f"{root}/ck"))
    return INC.newest(t.spark.read.parquet(f"{root}/out"), ["key", "from_ts", "to_ts"])


@query("k7_card_stream", f"SELECT {Q.canonical('url')} AS url, md5(min(html)) AS content_md5 FROM pages GROUP BY 1")
def _(t):
    root = scratch_path(t.spark, "k7")
    rows = _drop(t.read("pages").select("url", "html"), "k7-in")
    render = lambda df: df.select(canonical_url(F.col("url")).alias("url"), F.col("html").alias("content"))
    INC.card_stream(rows, f"{root}/cards", f"{root}/ledger", f"{root}/ck", render).awaitTermination()
    cards, events = t.spark.read.parquet(f"{root}/cards"), t.spark.read.parquet(f"{root}/ledger")
    return cards.join(events.select("url"), "url").select("url", F.md5("content").alias("content_md5"))


@query("x5_retry_stream", """
    SELECT DISTINCT trim(line) AS line, CASE WHEN NOT valid THEN 'permanent' WHEN length(trim(line)) % 4 = 0 THEN 'waiting' ELSE 'ok' END AS result FROM capture_urls""")
def _(t):
    """The retry lane's ended lines of every micro-batch, and those still waiting in the retry table."""
    root = scratch_path(t.spark, "x5")
    line = F.col("line")
    rows = _drop(t.capture_urls.select("line", "valid"), "x5-in").withColumn("line", F.when(F.col("valid"), line).otherwise(F.concat(F.lit("!"), line)))
    outcome = lambda df: df.withColumn(
        "result", F.when(F.startswith("line", F.lit("!")), "permanent").when(F.length("line") % 4 == 0, "transient").otherwise("ok")
    )
    INC.retry_lane(rows.select("line"), f"{root}/retry", f"{root}/done", f"{root}/ck", outcome).awaitTermination()
    waiting = _latest(t.spark, f"{root}/retry").select("line", F.lit("waiting").alias("result"))
    done = union_all(t.spark.read.parquet(f"{root}/done").select("line", "result"), waiting)
    return done.select(F.regexp_replace("line", "^!", "").alias("line"), "result")
