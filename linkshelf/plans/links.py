"""URL, registry, ledger and source/sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkshelf import constants as C
from linkshelf import schemas
from linkshelf.functions import urls as U
from linkshelf.functions.tags import literal_map
from linkshelf.operators import budget as BUD
from linkshelf.operators import registry as R
from linkshelf.operators.ordered import row_numbers
from linkshelf.plans import sqltext as Q
from linkshelf.plans.derived import Tables, joined, pick, video_url
from linkshelf.plans.registry import query
from linkshelf.session import scratch_path
from linkshelf.sources import files, readers, writers


# --- the headline question: which links are new, and how many variants collapsed ----------


def new_links(t: Tables):
    seen = R.first_seen(t.capture_urls.filter("valid"), "url", "seq")
    return R.without_known(seen, t.known)


query("new_links", """
    SELECT url, min(seq) AS first_seq, count(*) AS variants FROM capture_urls WHERE valid
    AND url NOT IN (SELECT url FROM known) GROUP BY url""")(new_links)


# --- columns ------------------------------------------------------------------------------

@query("u1_canonical_url", f"""
    SELECT 'line' AS source, seq, url FROM capture_urls WHERE valid
    UNION ALL SELECT 'page', page_id, {Q.canonical('url')} FROM pages
    UNION ALL SELECT 'raw', seq, {Q.canonical('line')} FROM captures""")
def _(t):
    lines = t.capture_urls.filter("valid").select(F.lit("line").alias("source"), "seq", "url")
    pages = t.read("pages").select(F.lit("page").alias("source"), F.col("page_id").alias("seq"), U.canonical_url(F.col("url")).alias("url"))
    raw = t.captures.select(F.lit("raw").alias("source"), "seq", U.canonical_url(F.col("line")).alias("url"))
    return lines.unionByName(pages).unionByName(raw)


@query("u2_tracking_param", f"""
    WITH p AS (SELECT 'line' AS source, seq, unnest(string_split(regexp_extract(line, '\\?([^#]*)', 1), '&')) AS s FROM captures
               UNION ALL SELECT 'page', page_id, unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) FROM pages)
    SELECT source, seq, split_part(s, '=', 1) AS name, {Q.tracking("split_part(s, '=', 1)")} AS tracking FROM p WHERE s <> ''""")
def _(t):
    rows = t.captures.select(F.lit("line").alias("source"), "seq", F.col("line").alias("u")).unionByName(
        t.read("pages").select(F.lit("page").alias("source"), F.col("page_id").alias("seq"), F.col("url").alias("u"))
    )
    params = rows.select("source", "seq", F.explode(U.query_params(U.url_query(F.col("u")))).alias("p"))
    return params.select("source", "seq", F.col("p.name").alias("name"), U.is_tracking_param(F.col("p.name")).alias("tracking"))


@query("u3_valid_url", "SELECT seq, valid FROM capture_urls")
def _(t):
    return t.capture_urls.select("seq", "valid")


@query("u4_url_hash", f"SELECT page_id, substr(sha256({Q.canonical('url')}), 1, 16) AS url_hash FROM pages")
def _(t):
    return t.read("pages").select("page_id", U.url_hash(F.col("url")).alias("url_hash"))


@query("u5_item_id", """
    SELECT video, position, kind, name, substr(sha256('https://v.example.com/o/' || video || '|' || kind || '|' || name || '|' ||
           CASE WHEN position <> 0 THEN position::VARCHAR ELSE '' END), 1, 20) AS item_id FROM items""")
def _(t):
    url = F.concat(F.lit("https://v.example.com/o/"), F.col("video").cast("string"))
    return t.items.withColumn("item_id", U.item_id(url, F.col("kind"), F.col("name"), F.col("position")))


@query("u6_short_link", """
    SELECT p.page_id, p.url, CASE WHEN r.target IS NOT NULL THEN split_part(r.target, '?', 1) ELSE p.url END AS resolved
    FROM pages p LEFT JOIN (SELECT short, min(target) AS target FROM redirects GROUP BY short) r ON r.short = p.url""")
def _(t):
    targets = t.redirects.groupBy(F.col("short").alias("url")).agg(F.min("target").alias("target"))
    rows = t.read("pages").select("page_id", "url").join(targets, "url", "left")
    return rows.select("page_id", "url", U.resolved_target(F.col("url"), F.col("target")).alias("resolved"))


@query("u7_photo_post", """
    SELECT page_id, contains(CASE WHEN page_id % 7 = 0 THEN url || '/photo/1' WHEN page_id % 7 = 1 THEN url ELSE url END, '/photo/') AS photo FROM pages""")
def _(t):
    p, url = F.col("page_id"), F.col("url")
    resolved = F.when(p % 7 == 0, F.concat(url, F.lit("/photo/1"))).when(p % 7 == 1, F.lit(""))
    return t.read("pages").select("page_id", U.is_photo_post(url, resolved).alias("photo"))


@query("u8_carousel", """
    SELECT doc_id, coalesce(CASE WHEN is_carousel THEN 'playlist' END = 'playlist', FALSE) OR doc_id % 4 > 1
           OR contains(CASE WHEN doc_id % 7 = 0 THEN url || '/photo/1' ELSE url END, '/photo/') AS carousel FROM video_metadata""")
def _(t):
    d = F.col("doc_id")
    kind = F.when(F.col("is_carousel"), "playlist")
    entries = F.when(d % 4 > 1, F.array_repeat(F.lit("slide"), (d % 4).cast("int"))).when(d % 4 == 1, F.array().cast("array<string>"))
    resolved = F.when(d % 7 == 0, F.concat("url", F.lit("/photo/1"))).otherwise(F.col("url"))
    return t.video_metadata.select("doc_id", U.is_carousel(kind, entries, resolved).alias("carousel"))


# --- registry ---------------------------------------------------------------------------------

@query("p1_valid_split", "SELECT seq, line, CASE WHEN valid THEN 'valid' ELSE 'invalid' END AS branch FROM capture_urls")
def _(t):
    return t.capture_urls.select("seq", "line", F.when(F.col("valid"), "valid").otherwise("invalid").alias("branch"))


@query("e1_known_urls", "SELECT url FROM cards UNION SELECT url FROM ledger UNION SELECT url FROM known")
def _(t):
    return R.known_urls(t.cards, t.ledger, t.known)


@query("e2_in_flight", f"""
    SELECT DISTINCT url FROM (SELECT {Q.canonical('url')} AS url FROM pages UNION ALL
      SELECT {Q.canonical('url')} FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN '' ELSE url || '/?igsh=1' END AS url FROM video_metadata)) WHERE url <> ''""")
def _(t):
    queued = t.video_metadata.select(F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat("url", F.lit("/?igsh=1"))).alias("url"))
    return R.in_flight(t.read("pages").select("url"), queued)


@query("e3_first_seen", "SELECT url, min(seq) AS first_seq, count(*) AS variants FROM capture_urls WHERE valid GROUP BY url")
def _(t):
    return R.first_seen(t.capture_urls.filter("valid"), "url", "seq")


@query("e4_card_urls", f"SELECT DISTINCT {Q.canonical('url')} AS url FROM pages")
def _(t):
    return t.read("pages").select(U.canonical_url(F.col("url")).alias("url")).distinct()


@query("e5_carry_over", """
    WITH initial AS (SELECT * FROM capture_urls WHERE seq % 4 <> 3),
    failed AS (SELECT * FROM initial WHERE valid AND seq % 6 = 1), invalid AS (SELECT * FROM initial WHERE NOT valid),
    appended AS (SELECT * FROM capture_urls c WHERE NOT EXISTS (SELECT 1 FROM initial i WHERE i.line = c.line)),
    kept AS (SELECT line, 0 AS r, seq FROM failed UNION ALL SELECT line, 1, seq FROM invalid UNION ALL SELECT line, 2, seq FROM appended)
    SELECT line, min({'r': r, 's': seq}).r AS source_rank, min({'r': r, 's': seq}).s AS seq FROM kept GROUP BY line""")
def _(t):
    initial = t.capture_urls.filter(F.col("seq") % 4 != 3)
    failed = initial.filter(F.col("valid") & (F.col("seq") % 6 == 1))
    return R.carried_over(t.capture_urls, initial, failed, initial.filter(~F.col("valid")))


@query("e6_export_dedupe", f"""
    WITH e AS (SELECT doc_id, {Q.canonical("CASE WHEN doc_id % 3 = 0 THEN url || '/?igshid=' || doc_id ELSE 'https://v.example.com/s/' || doc_id // 4 END")} AS url FROM video_metadata)
    SELECT url, min(doc_id) AS first_seq, count(*) AS variants FROM e WHERE url NOT IN (SELECT url FROM ledger) GROUP BY url""")
def _(t):
    d = F.col("doc_id")
    raw = F.when(d % 3 == 0, F.concat("url", F.lit("/?igshid="), d.cast("string"))).otherwise(
        F.concat(F.lit("https://v.example.com/s/"), F.expr("doc_id div 4").cast("string"))
    )
    rows = t.video_metadata.select("doc_id", U.canonical_url(raw).alias("url"))
    return R.without_known(R.first_seen(rows, "url", "doc_id"), t.ledger)


@query("j1_skip_known", "SELECT url, count(*) AS variants FROM capture_urls WHERE valid AND url NOT IN (SELECT url FROM known) GROUP BY url")
def _(t):
    return R.without_known(R.first_seen(t.capture_urls.filter("valid"), "url", "seq"), t.known).select("url", "variants")


@query("j2_count_known", "SELECT url, count(*) AS variants FROM capture_urls WHERE valid AND url IN (SELECT url FROM known) GROUP BY url")
def _(t):
    return R.already_known(R.first_seen(t.capture_urls.filter("valid"), "url", "seq"), t.known).select("url", "variants")


@query("j3_reconcile", """
    SELECT doc_id, url FROM video_metadata WHERE url NOT IN (SELECT url FROM cards WHERE status = 'kept' OR status = 'inbox')""")
def _(t):
    stored = t.cards.filter(F.col("status").isin("kept", "inbox"))
    return R.without_known(t.video_metadata.select("doc_id", "url"), stored).select("doc_id", "url")


@query("a3_events_per_url", "SELECT url, string_agg(DISTINCT event, '|' ORDER BY event) AS events, bool_or(event = 'tossed') AS was_tossed FROM ledger GROUP BY url")
def _(t):
    return R.events_per_url(t.ledger).select("url", joined(F.col("events")).alias("events"), F.array_contains("events", "tossed").alias("was_tossed"))


@query("a7_counters", """
    SELECT count(*) AS lines, count(*) FILTER (WHERE NOT valid) AS invalid, count(DISTINCT url) AS candidates,
      count(DISTINCT url) FILTER (WHERE url IN (SELECT url FROM known)) AS skipped_known FROM capture_urls""")
def _(t):
    # Valid lines collapse to their URL first; only then are the counters summed.
    per_url = t.capture_urls.groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    flagged = per_url.join(t.known.select("url", F.lit(True).alias("seen")), "url", "left")
    return flagged.agg(
        F.sum("n").alias("lines"), F.coalesce(F.sum(F.when(F.col("url").isNull(), F.col("n"))), F.lit(0)).alias("invalid"),
        F.count("url").alias("candidates"), F.count_if("seen").alias("skipped_known"),
    )


@query("k1_ledger_append", """
    SELECT DISTINCT url, CASE doc_id % 2 WHEN 0 THEN 'carded' ELSE 'tossed' END AS event FROM cards c
    WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.url = c.url AND l.event = CASE c.doc_id % 2 WHEN 0 THEN 'carded' ELSE 'tossed' END)""")
def _(t):
    events = t.cards.select("url", pick(["carded", "tossed"], F.col("doc_id") % 2).alias("event"))
    return R.new_events(events, t.ledger)


@query("j11_ledger_sync", """
    SELECT url, 'carded' AS event FROM cards WHERE url NOT IN (SELECT url FROM ledger)
    UNION ALL SELECT url, 'tossed' FROM cards WHERE status = 'tossed' AND url NOT IN (SELECT url FROM ledger WHERE event = 'tossed')""")
def _(t):
    return R.ledger_sync(t.cards, t.ledger).select("url", "event")


@query("a7_sync_counters", """
    WITH s AS (SELECT url, 'carded' AS event FROM cards WHERE url NOT IN (SELECT url FROM ledger)
      UNION ALL SELECT url, 'tossed' FROM cards WHERE status = 'tossed' AND url NOT IN (SELECT url FROM ledger WHERE event = 'tossed'))
    SELECT count(*) FILTER (WHERE event = 'carded') AS newly_carded, count(*) FILTER (WHERE event = 'tossed') AS newly_tossed FROM s""")
def _(t):
    rows = R.ledger_sync(t.cards, t.ledger)
    return rows.agg(F.count_if(F.col("event") == "carded").alias("newly_carded"), F.count_if(F.col("event") == "tossed").alias("newly_tossed"))


@query("k2_state_append", """
    SELECT s.url, s.seq, coalesce(CASE WHEN s.seq % 3 = 0 THEN s.attempts END, l.attempts, 0) AS attempts
    FROM (SELECT url, max(seq) AS seq, max_by(attempts, seq) AS attempts FROM analysis_state GROUP BY url) s
    LEFT JOIN (SELECT url, max_by(attempts, seq) AS attempts FROM analysis_state WHERE seq % 7 <> 0 GROUP BY url) l ON l.url = s.url""")
def _(t):
    from linkshelf.operators.ordered import last_by

    newest = last_by(t.analysis_state, ["url"], "seq", ["seq", "attempts"])
    updates = newest.select("url", "seq", F.when(F.col("seq") % 3 == 0, F.col("attempts")).alias("attempts"))
    before = last_by(t.analysis_state.filter(F.col("seq") % 7 != 0), ["url"], "seq", ["attempts"])
    return writers.state_rows(updates, before)


@query("k6_manual_review", f"""
    WITH f AS (SELECT url, min(seq) AS seq FROM analysis_state WHERE status = 'manual-review' GROUP BY url)
    SELECT f.url, left({Q.squeeze("d.text")}, 300) AS reason FROM f JOIN video_metadata d ON d.url = f.url
    WHERE f.url NOT IN (SELECT url FROM cards WHERE status = 'manual-review')""")
def _(t):
    reasons = t.video_metadata.select("url", F.col("text").alias("reason"), F.concat("title", F.lit(".md")).alias("name"))
    first = t.analysis_state.filter(F.col("status") == "manual-review").groupBy("url").agg(F.min("seq").alias("seq"))
    listed = t.cards.filter(F.col("status") == "manual-review")
    return R.manual_review_lines(first.join(reasons, "url"), listed).select("url", "reason")


# --- text sources and sinks: derived data is written in the format, then read back -----------------

@query("s1_capture_lines", "SELECT DISTINCT trim(line) AS line FROM captures WHERE trim(line) <> ''")
def _(t):
    path = scratch_path(t.spark, "captures")
    blank = t.captures.select(F.when(F.col("seq") % 6 == 0, "   ").otherwise("").alias("line"))
    t.captures.select("line").unionByName(blank).write.text(path)
    return readers.read_captures(t.spark, path).select("line").distinct()


@query("s3_json_array", "SELECT url, title, description, coalesce(creator, 'Unknown') AS creator, array_to_string(tags, '|') AS tags FROM video_metadata")
def _(t):
    path = scratch_path(t.spark, "queue")
    items = t.video_metadata.select("doc_id", "url", "title", "description", "tags", F.coalesce("creator", F.lit("Unknown")).alias("creator"))
    writers.write_json_arrays(items, path, "doc_id", block_bytes=1 << 20)
    rows = readers.read_json_array(t.spark, path, schemas.METADATA)
    return rows.withColumn("tags", joined(F.col("tags")))


@query("s4_csv", """
    SELECT category AS "Category", text AS "Summary", creator AS "Creator", url AS "URL", coalesce(status, '') AS "Title", array_to_string(tags, ', ') AS "Tags" FROM cards""")
def _(t):
    path = scratch_path(t.spark, "classified")
    rows = t.cards.select(
        F.col("category").alias("Category"), F.col("text").alias("Summary"), F.col("creator").alias("Creator"),
        F.col("url").alias("URL"), F.coalesce("status", F.lit("")).alias("Title"), F.array_join("tags", ", ").alias("Tags"),
    )
    writers.write_table_csv(rows, path)
    return readers.read_table_csv(t.spark, path)


@query("s5_ledger_lines", "SELECT url, event, count(*) AS n FROM ledger WHERE seq % 10 <> 9 GROUP BY url, event")
def _(t):
    path = scratch_path(t.spark, "ledger")
    line = F.to_json(F.struct(F.concat("url", F.lit("/?igsh=1")).alias("url"), "event"))
    # A tenth of the lines is torn or lacks its event.
    torn = F.when(F.col("seq") % 20 == 9, F.left(line, F.lit(12))).when(F.col("seq") % 20 == 19, F.to_json(F.struct("url"))).otherwise(line)
    t.ledger.select(torn.alias("value")).write.text(path)
    return readers.read_ledger(t.spark, path).groupBy("url", "event").agg(F.count(F.lit(1)).alias("n"))


@query("s6_state_log", """
    SELECT url, status, prompt_version, CASE WHEN seq % 4 = 1 THEN 0 ELSE attempts END AS attempts, count(*) AS n
    FROM analysis_state WHERE seq % 11 <> 0 GROUP BY ALL""")
def _(t):
    path = scratch_path(t.spark, "state")
    s = F.col("seq")
    line = F.to_json(F.struct("url", "status", "prompt_version", F.when(s % 4 != 1, F.col("attempts")).alias("attempts")))
    bad = F.when(s % 22 == 0, F.left(line, F.lit(20))).when(s % 11 == 0, F.to_json(F.struct("url", F.lit("many").alias("attempts")))).otherwise(line)
    t.analysis_state.select(bad.alias("value")).write.text(path)
    rows = readers.read_state_log(t.spark, path)
    return rows.groupBy("url", "status", "prompt_version", F.col("attempts").cast("bigint").alias("attempts")).agg(F.count(F.lit(1)).alias("n"))


@query("s7_card_files", "SELECT url, coalesce(status, '') AS status FROM cards WHERE doc_id % 20 <> 0")
def _(t):
    from linkshelf.functions.frontmatter import render_map

    fm = F.map_filter(
        F.create_map(F.lit("url"), F.col("url"), F.lit("status"), F.coalesce("status", F.lit(""))),
        lambda k, v: (k != "url") | (F.col("doc_id") % 20 != 0),
    )
    content = F.concat(F.lit("---\n"), render_map(fm, F.col("tags")), F.lit("\n---\n# note\nurl: \"https://body.example.com\"\n"))
    # One file each, in folders of folders; a third of the names, and some folders, start with an underscore.
    i = F.col("doc_id")
    mark = lambda k: F.when(i % 3 == k, "_").otherwise("")
    folder = F.concat(mark(1), F.lit("shelf "), (i % 7).cast("string"), F.lit("/"), mark(2), (i % 11).cast("string"), F.lit("/"))
    root = scratch_path(t.spark, "notes")
    files.write_notes(t.cards.select(F.concat(folder, mark(0), i.cast("string"), F.lit(".md")).alias("path"), content.alias("content")), root)
    return readers.read_cards(t.spark, root).select("url", "status")


@query("s8_saved_export", f"""
    WITH p AS (SELECT doc_id, url, text || ' #' || lang || ' #' || source || ' #' || lang AS caption, creator FROM video_metadata WHERE doc_id % 8 <> 0)
    SELECT url, coalesce(nullif({Q.strip("CASE WHEN length(caption) > 60 THEN left(caption, 60) || '...' ELSE caption END")}, ''), 'Instagram Saved Post') AS title,
      caption AS description, coalesce(creator, 'Unknown') AS creator FROM p""")
def _(t):
    path = scratch_path(t.spark, "export")
    caption = F.concat("text", F.lit(" #"), "lang", F.lit(" #"), "source", F.lit(" #"), "lang")
    text = F.lit(None).cast("string")
    user = F.array(F.struct(F.array(F.struct(F.lit("Username").alias("label"), F.col("creator").alias("value"))).alias("dict")))
    entry = lambda **kw: F.struct(*[kw.get(k, text).alias(k) for k in ("label", "href", "value", "title")], kw.get("inner", F.lit(None).cast(
        "array<struct<dict:array<struct<label:string,value:string>>>>")).alias("dict"))
    entries = F.array_compact(F.array(
        F.when(F.col("doc_id") % 8 != 0, entry(label=F.lit("URL"), href=F.col("url"))),
        entry(label=F.lit("Caption"), value=caption),
        F.when(F.col("creator").isNotNull(), entry(title=F.lit("Owner"), inner=user)),
    ))
    bare = F.col("block") % 2 == 0
    writers.write_json_arrays(
        t.video_metadata.select("doc_id", entries.alias("label_values")), path, "doc_id", F.when(bare, "[").otherwise('{"saved_saved_media":['),
        F.when(bare, "]").otherwise("]}"), block_bytes=1 << 20)
    return readers.read_export(t.spark, path).select("url", "title", "description", "creator")


@query("s9_snapshot", """
    WITH s AS (SELECT doc_id, 'https://v.example.com/s/' || doc_id // 3 AS url, title, description FROM video_metadata)
    SELECT url, max_by(title, doc_id) AS title, max_by(description, doc_id) AS description FROM s GROUP BY url""")
def _(t):
    url = F.concat(F.lit("HTTPS://v.example.com/s/"), F.expr("doc_id div 3").cast("string"), F.lit("/?igsh="), F.col("doc_id").cast("string"))
    items = t.video_metadata.select("doc_id", url.alias("url"), "title", "description", "tags", "creator")
    return readers.snapshot_lookup(items, "doc_id").select("url", "title", "description")


@query("s10_cached_analysis", f"""
    SELECT substr(sha256(url), 1, 16) AS url_hash, {Q.list_of(C.CATEGORIES)}[doc_id % 14 + 1] AS category FROM video_metadata WHERE doc_id % 2 = 1 AND doc_id % 5 <> 0""")
def _(t):
    d = F.col("doc_id")
    record = F.struct(
        pick(C.CATEGORIES, d % 14).alias("category"), F.lit(0.5).alias("confidence"),
        F.when(d % 5 != 0, F.lit("t")).alias("title"), F.lit("s").alias("summary"),
    )
    rows = t.video_metadata.select(
        "url", d.alias("version"), pick(["2", "3"], d % 2).alias("prompt_version"), F.to_json(record).alias("payload")
    )
    good = readers.cached_analysis(writers.cache_rows(rows, "analysis"), C.PROMPT_VERSION)
    return good.select("url_hash", F.col("analysis.category").alias("category"))


@query("k3_stage_cache", """
    WITH e AS (SELECT url, max(seq) AS version FROM analysis_state GROUP BY url)
    SELECT substr(sha256(url), 1, 16) AS url_hash, version, 'v' || version AS payload FROM e
    WHERE url NOT IN (SELECT url FROM cards WHERE status = 'tossed')""")
def _(t):
    path = scratch_path(t.spark, "cache")
    rows = t.analysis_state.select("url", F.col("seq").alias("version"), "prompt_version", F.concat(F.lit("v"), F.col("seq").cast("string")).alias("payload"))
    writers.cache_rows(rows, "info").write.mode("append").parquet(path)
    tossed = t.cards.filter(F.col("status") == "tossed").select("url")
    writers.cleared(tossed, ["info", "transcript"], t.spark.read.parquet(path)).write.mode("append").parquet(path)
    current = writers.latest_cache(t.spark.read.parquet(path))
    return current.select("url_hash", F.substr("payload", F.lit(2)).cast("bigint").alias("version"), "payload")


@query("s11_usage", "SELECT key, count(*) AS requests, sum(in_tokens)::BIGINT AS in_tokens FROM request_log GROUP BY key")
def _(t):
    path = scratch_path(t.spark, "usage")
    t.request_log.select("ts", "key", "provider", "in_tokens", "out_tokens").write.parquet(path)
    log = t.spark.read.schema(schemas.REQUEST_LOG).parquet(path)
    return BUD.usage_by_key(log)


@query("s12_trimmed_info", """
    SELECT title, creator AS uploader, duration, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 0 END AS n_entries,
      CASE WHEN doc_id % 3 = 0 THEN url || '/t' END AS thumbnail FROM video_metadata""")
def _(t):
    path = scratch_path(t.spark, "info")
    slide = F.struct("url", F.concat("url", F.lit("/t")).alias("thumbnail"), F.col("text").alias("formats"))
    raw = F.struct(
        "title", "description", F.col("creator").alias("uploader"), "duration", F.col("text").alias("formats"),
        F.when(F.col("doc_id") % 3 == 0, F.array(slide, slide)).alias("entries"),
    )
    t.video_metadata.select(F.to_json(raw).alias("value")).write.text(path)
    info = readers.read_info(t.spark, path)
    return info.select(
        "title", "uploader", "duration", F.coalesce(F.size("entries"), F.lit(0)).alias("n_entries"),
        F.get(F.col("entries"), F.lit(0))["thumbnail"].alias("thumbnail"),
    )


@query("s13_metadata", """
    SELECT url, title, description, array_to_string(list_filter(tags, lambda x: x <> ''), '|') AS tags,
      coalesce(creator, CASE WHEN doc_id % 2 = 0 THEN 'artist ' || doc_id END, 'Unknown') AS creator FROM video_metadata""")
def _(t):
    artist = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("artist "), F.col("doc_id").cast("string")))
    info = t.video_metadata.select("url", F.nullif("title", F.lit("")).alias("title"), "description", "tags",
                                   F.col("creator").alias("uploader"), artist.alias("artist"), F.lit(None).cast("string").alias("track"))
    return readers.metadata_from_info(info).select("url", "title", "description", joined(F.col("tags")).alias("tags"), "creator")


@query("s14_last_json", """
    SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE doc_id END AS id FROM video_metadata""")
def _(t):
    d = F.col("doc_id").cast("string")
    log = F.concat(
        F.lit("[warn] slide 1 failed\n"), F.when(F.col("doc_id") % 4 == 3, "").otherwise(F.concat(F.lit('{"id": -1}\n  {"id": '), d, F.lit("}  \n"))),
        F.lit('{"id": 7, "torn\n[done] {"id": 9}\n'),
    )
    last = readers.last_json_object(log)
    return t.video_metadata.select("doc_id", F.get_json_object(last, "$.id").cast("bigint").alias("id"))


@query("k4_card_append", f"""
    SELECT url, {Q.folder('category')} AS folder FROM cards WHERE url NOT IN (SELECT url FROM ledger)""")
def _(t):
    from linkshelf.functions.tags import folder_for

    path = scratch_path(t.spark, "cards")
    rows = R.without_known(t.cards, t.ledger).select("url", folder_for(F.col("category")).alias("folder"))
    for _ in range(2):  # the second append adds nothing
        writers.append_cards(rows, path, "url string, folder string")
    return t.spark.read.parquet(path)


@query("k5_run_report", f"""
    SELECT seq, CASE status WHEN 'unavailable' THEN CASE WHEN attempts >= 3 THEN '- UNAVAILABLE after ' || attempts || ' tries `' || url || '`: gone' ELSE '- UNAVAILABLE `' || url || '`: gone' END
      WHEN 'failed-retryable' THEN '- RETRY LATER `' || url || '` (attempt ' || attempts || '): gone'
      WHEN 'manual-review' THEN '- MANUAL REVIEW `card' || seq || '.md` `' || url || '`: gone'
      ELSE '- card' || seq || '.md: **Tips** (music_only) conf=' || ['0.25', '0.5', '0.75', '1.0'][seq % 4 + 1] || ' items=' || seq % 6 || ' tier=captions transcript=' || ['captions', 'whisper', 'none'][seq % 3 + 1] ||
        ' classifier=rules' || CASE WHEN status = 'needs-review' THEN ' REVIEW' ELSE '' END END AS line
    FROM analysis_state""")
def _(t):
    rows = t.analysis_state.withColumns({
        "name": F.concat(F.lit("card"), F.col("seq").cast("string"), F.lit(".md")), "detail": F.lit("gone"),
        "category": F.lit("Tips"), "shape": F.lit("music_only"), "tier": F.lit("captions"), "classifier": F.lit("rules"),
        "confidence": (F.col("seq") % 4 + 1) / 4.0, "items": F.col("seq") % 6, "transcript_source": pick(["captions", "whisper", "none"], F.col("seq") % 3),
        "tries": F.when(F.col("attempts") >= 3, F.col("attempts")),
    })
    return writers.run_report(rows).select("seq", "line")
