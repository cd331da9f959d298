"""Text, taxonomy and tag queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkshelf import constants as C
from linkshelf.functions import cards as K
from linkshelf.functions import frontmatter as FM
from linkshelf.functions import tags as G
from linkshelf.functions import text as T
from linkshelf.operators import catalog as CAT
from linkshelf.plans import sqltext as Q
from linkshelf.plans.derived import joined, pick
from linkshelf.plans.registry import query

_HASHTAGS = r"regexp_extract_all(description, '#([\p{L}\p{N}_]+)', 1)"


@query("t1_hashtags", f"""
    WITH h AS (SELECT doc_id, unnest({_HASHTAGS}) AS tag, generate_subscripts({_HASHTAGS}, 1) AS pos FROM video_metadata),
    f AS (SELECT doc_id, tag, min(pos) AS pos FROM h GROUP BY doc_id, tag)
    SELECT doc_id, string_agg(tag, '|' ORDER BY pos) AS tags FROM f GROUP BY doc_id""")
def _(t):
    tags = T.hashtags(F.col("description"))
    return t.video_metadata.select("doc_id", joined(tags).alias("tags")).filter(F.col("tags") != "")


@query("t2_prompt_fields", "SELECT doc_id, left(title, 70) AS t, left(description, 90) AS c FROM video_metadata")
def _(t):
    return t.video_metadata.select("doc_id", F.left("title", F.lit(C.TITLE_CHARS)).alias("t"), F.left("description", F.lit(C.CAPTION_CHARS)).alias("c"))


@query("t3_caption_title", f"""
    SELECT doc_id, coalesce(nullif({Q.strip("CASE WHEN length(c) > 60 THEN left(c, 60) || '...' ELSE c END")}, ''), 'Instagram Saved Post') AS title
    FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '  ' ELSE description END AS c FROM video_metadata)""")
def _(t):
    caption = F.when(F.col("doc_id") % 10 == 0, "  ").otherwise(F.col("description"))
    return t.video_metadata.select("doc_id", T.caption_title(caption, "Instagram Saved Post").alias("title"))


@query("t4_list_claim", f"""
    SELECT 'video' AS source, doc_id AS id, {Q.list_claim("title || ' ' || description")} AS claims FROM video_metadata
    UNION ALL SELECT 'benchmark', item_id, {Q.list_claim('text')} FROM benchmark""")
def _(t):
    both = F.concat("title", F.lit(" "), "description")
    videos = t.video_metadata.select(F.lit("video").alias("source"), F.col("doc_id").alias("id"), T.has_list_claim(both).alias("claims"))
    bench = t.read("benchmark").select(F.lit("benchmark").alias("source"), F.col("item_id").alias("id"), T.has_list_claim(F.col("text")).alias("claims"))
    return videos.unionByName(bench)


@query("t5_sparse_caption", f"SELECT doc_id, length({Q.strip('description')}) < 40 AS sparse FROM video_metadata")
def _(t):
    return t.video_metadata.select("doc_id", T.caption_is_sparse(F.col("description")).alias("sparse"))


_SPOKEN = "CASE turn % 5 WHEN 0 THEN 'Just music here, nothing else' WHEN 1 THEN ' short ' ELSE text END"


@query("t6_needs_vision", f"""
    SELECT conv_id, turn, length({Q.strip(_SPOKEN)}) < 20 OR {Q.contains_any(f'lower({_SPOKEN})', C.MUSIC_ONLY_MARKERS)} AS vision FROM conversations""")
def _(t):
    k = F.col("turn") % 5
    spoken = F.when(k == 0, "Just music here, nothing else").when(k == 1, " short ").otherwise(F.col("text"))
    return t.read("conversations").select("conv_id", "turn", T.needs_vision(spoken).alias("vision"))


@query("t7_word_count", f"SELECT doc_id, {Q.words('text')} AS words FROM documents")
def _(t):
    return t.documents.select("doc_id", T.word_count(F.col("text")).cast("bigint").alias("words"))


@query("t8_failure_class", f"SELECT doc_id, {Q.failure('stderr')} AS failure FROM fetch_log")
def _(t):
    return t.fetch_log.select("doc_id", T.failure_class(F.col("stderr")).alias("failure"))


_TITLES = """CASE doc_id % 6 WHEN 0 THEN 'CON' WHEN 1 THEN ' a/b: "c" <' || text || '>. . ' WHEN 2 THEN '???' WHEN 3 THEN 'nul.txt' ELSE text END"""


def _titles():
    d, text = F.col("doc_id") % 6, F.col("text")
    return (
        F.when(d == 0, "CON").when(d == 1, F.concat(F.lit(' a/b: "c" <'), text, F.lit(">. . ")))
        .when(d == 2, "???").when(d == 3, "nul.txt").otherwise(text)
    )


@query("t9_safe_filename", f"SELECT doc_id, {Q.safe_filename('t')} AS stem, {Q.safe_filename('t', 75, 'Untitled')} AS long_stem FROM (SELECT doc_id, {_TITLES} AS t FROM documents)")
def _(t):
    rows = t.documents.select("doc_id", _titles().alias("t"))
    return rows.select("doc_id", T.safe_filename(F.col("t")).alias("stem"), T.safe_filename(F.col("t"), 75, "Untitled").alias("long_stem"))


_TYPED = """CASE p_partkey % 7 WHEN 0 THEN '../' || p_name WHEN 1 THEN p_name || '.' WHEN 2 THEN ' ' || p_name || '  x ' WHEN 3 THEN 'aux' WHEN 4 THEN p_name || '?' WHEN 5 THEN '.' || p_name ELSE p_name END"""


@query("t10_typed_names", f"""
    WITH r AS (SELECT p_partkey, {_TYPED} AS raw FROM part), n AS (SELECT *, {Q.squeeze('raw')} AS name FROM r),
    c AS (SELECT *, {Q.safe_filename('name', 80, '')} AS cleaned FROM n)
    SELECT p_partkey, CASE WHEN name = '' OR starts_with(name, '.') OR regexp_matches(name, {Q.lit(C.ILLEGAL_NAME_CHARS)})
        OR rtrim(name, '. ') <> name OR {Q.reserved('name')} THEN NULL ELSE name END AS folder,
      CASE WHEN contains(raw, '/') OR contains(raw, chr(92)) OR cleaned = '' OR starts_with(cleaned, '.') THEN NULL ELSE cleaned END AS project FROM c""")
def _(t):
    k, n = F.col("p_partkey") % 7, F.col("p_name")
    raw = (
        F.when(k == 0, F.concat(F.lit("../"), n)).when(k == 1, F.concat(n, F.lit("."))).when(k == 2, F.concat(F.lit(" "), n, F.lit("  x ")))
        .when(k == 3, "aux").when(k == 4, F.concat(n, F.lit("?"))).when(k == 5, F.concat(F.lit("."), n)).otherwise(n)
    )
    rows = t.read("part").select("p_partkey", raw.alias("raw"))
    return rows.select("p_partkey", T.folder_segment(F.col("raw")).alias("folder"), T.project_name(F.col("raw")).alias("project"))


# --- front matter ---------------------------------------------------------------------------------

_NOTE_SQL = """
    SELECT doc_id, url, status, category, lang, source,
      CASE WHEN doc_id % 10 = 9 THEN '# only a body' ELSE '---' || chr(10) || 'category: ' || to_json(category)::VARCHAR || chr(10) ||
        CASE WHEN doc_id % 10 = 8 THEN 'url: "' || url || chr(10) ELSE 'url: ' || CASE WHEN doc_id % 2 = 0 THEN to_json(url)::VARCHAR ELSE url END || chr(10) END ||
        'status: ' || coalesce(status, '') || chr(10) || 'tags:' || chr(10) || '  - saved-media' || chr(10) || '  - ' || lang || chr(10) || '---' || chr(10) ||
        chr(10) || '# Note ' || doc_id || chr(10) || chr(10) || '> **Summary:** about ' || source || chr(10) || chr(10) || '## Notes & Insights' || chr(10) || '- mine' || chr(10) END AS content
    FROM (SELECT c.doc_id, c.url, c.status, c.category, c.creator AS source, d.lang FROM cards c JOIN documents d ON d.doc_id = c.doc_id)"""


def notes(t):
    """Cards as Markdown, some without a block and some with a torn quote."""
    k = F.col("doc_id") % 10
    q = FM.quoted
    url = F.when(k == 8, F.concat(F.lit('url: "'), "url", F.lit("\n"))).otherwise(
        F.concat(F.lit("url: "), F.when(F.col("doc_id") % 2 == 0, q(F.col("url"))).otherwise(F.col("url")), F.lit("\n"))
    )
    text = F.concat(
        F.lit("---\ncategory: "), q(F.col("category")), F.lit("\n"), url, F.lit("status: "), F.coalesce("status", F.lit("")),
        F.lit("\ntags:\n  - saved-media\n  - "), F.get(F.col("tags"), F.lit(2)), F.lit("\n---\n\n# Note "), F.col("doc_id").cast("string"),
        F.lit("\n\n> **Summary:** about "), "creator", F.lit("\n\n## Notes & Insights\n- mine\n"),
    )
    return t.cards.select("doc_id", "url", "status", "creator", F.when(k == 9, "# only a body").otherwise(text).alias("content"))


_BLOCK_SQL = "regexp_extract(content, '(?s)\\A---[ \\t]*\\r?\\n(.*?)\\r?\\n---[ \\t]*(?:\\r?\\n|\\z)', {})"


@query("t11_split", f"""
    WITH n AS ({_NOTE_SQL}) SELECT doc_id, CASE WHEN starts_with(content, '---') THEN {_BLOCK_SQL.format(1)} END AS block,
    substr(content, length({_BLOCK_SQL.format(0)}) + 1) AS body FROM n""")
def _(t):
    c = F.col("content")
    return notes(t).select("doc_id", FM.block_text(c).alias("block"), FM.body_text(c).alias("body"))


@query("t12_lenient_read", f"""
    WITH n AS ({_NOTE_SQL}) SELECT doc_id, CASE WHEN doc_id % 10 <> 9 THEN url END AS url,
      CASE WHEN doc_id % 10 = 8 AND status IS NULL THEN 'tags:' WHEN doc_id % 10 <> 9 THEN status END AS status FROM n""")
def _(t):
    c = F.col("content")
    return notes(t).select("doc_id", FM.queue_value(c, "url").alias("url"), FM.queue_value(c, "status").alias("status"))


@query("t13_strict_read", f"""
    WITH n AS ({_NOTE_SQL}) SELECT doc_id, CASE doc_id % 10 WHEN 9 THEN 'absent' WHEN 8 THEN 'broken' ELSE 'ok' END AS fm_state,
      CASE WHEN doc_id % 10 < 8 THEN category END AS category, CASE WHEN doc_id % 10 < 8 THEN 'saved-media|' || lang END AS tags FROM n""")
def _(t):
    c = F.col("content")
    rows = notes(t).withColumn("fm_state", FM.state(c)).withColumn("block", F.when(F.col("fm_state") == "ok", FM.block_text(c)))
    return rows.select(
        "doc_id", "fm_state", F.try_element_at(FM.scalars(F.col("block")), F.lit("category")).alias("category"),
        joined(F.try_element_at(FM.lists(F.col("block")), F.lit("tags"))).alias("tags"),
    )


_FM_SQL = """'category: ' || {q_cat} || chr(10) || 'creator: ' || {q_creator} || chr(10) || 'url: ' || {q_url} || chr(10) ||
   CASE WHEN status IS NOT NULL THEN 'status: ' || {q_status} || chr(10) ELSE '' END ||
   'tags:' || chr(10) || '  - ' || array_to_string(tags, chr(10) || '  - ') || chr(10) || 'weight: ' || CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 5 END || chr(10) || 'mood: ' || {q_mood}""".format(
    q_cat=Q.quoted("category"), q_creator=Q.quoted("creator"), q_url=Q.quoted("url"), q_status=Q.quoted("status"), q_mood=Q.quoted("summary"))


def _card_fm():
    pairs = [
        ("mood", F.col("summary")), ("category", F.col("category")), ("creator", F.col("creator")), ("url", F.col("url")),
        ("status", F.col("status")), ("weight", F.when(F.col("doc_id") % 3 == 0, "heavy").otherwise((F.col("doc_id") % 5).cast("string"))),
    ]
    full = F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)])
    return F.map_filter(full, lambda k, v: (k != "status") | v.isNotNull())


@query("t14_frontmatter", f"SELECT doc_id, {_FM_SQL} AS block FROM cards")
def _(t):
    return t.cards.select("doc_id", FM.render_map(_card_fm(), F.col("tags")).alias("block"))


@query("t15_quoted", f"SELECT doc_id, {Q.quoted('v')} AS quoted FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE text || chr(92) || '\"x\"' END AS v FROM documents)")
def _(t):
    value = F.when(F.col("doc_id") % 5 != 0, F.concat("text", F.lit('\\"x"')))
    return t.documents.select("doc_id", FM.quoted(value).alias("quoted"))


@query("t16_rebuild", f"""
    SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE '---' || chr(10) || {_FM_SQL} || chr(10) || '---' || chr(10) ||
      CASE WHEN doc_id % 4 = 1 THEN chr(10) || 'body' WHEN doc_id % 4 = 2 THEN '' ELSE chr(10) || 'body' END END AS content FROM cards""")
def _(t):
    k = F.col("doc_id") % 4
    old = F.when(k == 0, "no block").when(k == 1, "---\na: 1\n---\n\nbody").when(k == 2, "---\na: 1\n---\n").otherwise("---\na: 1\n---\nbody")
    return t.cards.select("doc_id", FM.rebuild_card(old, FM.render_map(_card_fm(), F.col("tags"))).alias("content"))


@query("t17_body_parts", f"""
    WITH n AS ({_NOTE_SQL}) SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'only a body' ELSE 'Note ' || doc_id END AS title,
      CASE WHEN doc_id % 10 = 9 THEN '' ELSE 'about ' || source END AS summary,
      CASE WHEN doc_id % 10 = 9 THEN 'none' ELSE '## Notes & Insights' || chr(10) || '- mine' || chr(10) END AS notes,
      CASE WHEN doc_id % 10 = 9 THEN '# only a body' ELSE '- mine' END AS excerpt FROM n""")
def _(t):
    body = FM.body_text(F.col("content"))
    return notes(t).select(
        "doc_id", T.heading_title(body, F.lit("stem")).alias("title"), T.body_summary(body).alias("summary"),
        T.notes_section(body, T.ENRICHED_NOTES, "none").alias("notes"), T.excerpt(body).alias("excerpt"),
    )


@query("t18_checklist", f"""
    WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {Q.squeeze('x')}), lambda x: x <> '') AS items FROM documents)
    SELECT doc_id, CASE WHEN len(items) = 0 THEN '- [ ]' ELSE array_to_string(list_transform(items, lambda x: '- [ ] ' || x), chr(10)) END AS lines FROM l""")
def _(t):
    """Every line of a document as one item; a document without lines keeps the empty box."""
    return t.documents.select("doc_id", T.checklist(F.split("text", "\n")).alias("lines"))


# --- rendered cards -------------------------------------------------------------------------------

_NL = "chr(10)"




_SCORED = """SELECT v.doc_id, s.cat AS cat0, v.title AS title0, coalesce(v.creator, '') AS raw_creator, v.url, v.text AS summary,
        array_to_string(v.tags, ', ') AS tags_text FROM video_metadata v JOIN best_scores s ON s.doc_id = v.doc_id"""


def card_sql(rows: str = _SCORED) -> str:
    """Cards of ``rows(doc_id, cat0, title0, raw_creator, url, summary, tags_text)``."""
    cat = Q.canonical_category("cat0")
    q = Q.quoted
    head = (
        f"'---' || {_NL} || 'category: ' || {q('c')} || {_NL} || 'creator: ' || {q('creator')} || {_NL} || 'url: ' || {q('url')} || {_NL} || 'status: \"inbox\"' || {_NL}"
    )
    tags = f"'tags:' || {_NL} || '  - saved-media' || {_NL} || '  - ' || {Q.category_tag('c')}"
    src = lambda label: f"'- **Creator:** @' || creator || {_NL} || '- **{label}:** [' || url || '](' || url || ')' || {_NL}"
    top = f"{_NL} || {_NL} || '# ' || title || {_NL} || {_NL} || '> **Summary:** ' || summary || {_NL} || {_NL}"
    staged = f"CASE WHEN stage IS NOT NULL THEN 'stage: ' || {q('stage')} || {_NL} ELSE '' END"
    music = f"CASE WHEN c = 'Saved Music' THEN 'artist: ' || {q('raw_creator')} || {_NL} || 'sound: ' || {q('title')} || {_NL} ELSE '' END"
    boxes = f"CASE WHEN {Q.squeeze('summary')} = '' THEN '- [ ]' ELSE '- [ ] ' || {Q.squeeze('summary')} END || {_NL}"
    section = (
        f"CASE c WHEN 'Fitness & Health' THEN '## Exercises & Movement Routine' || {_NL} || {boxes} "
        f"WHEN 'Recipes & Food' THEN '## Ingredients & Preparation' || {_NL} || {boxes} "
        f"ELSE '## Artist & Sound' || {_NL} || '- **Artist:** ' || coalesce(nullif(raw_creator, ''), 'Unknown') || {_NL} || '- **Sound:** ' || title || {_NL} END"
    )
    framed = f"{head} || {staged} || 'summary: ' || {q('summary')} || {_NL}"
    actionable = f"{framed} || {music} || {tags} || {_NL} || '---' || {top} || {src('Source Link')} || {_NL} || {section}"
    high = f"{framed} || {tags} || {_NL} || '---' || {top} || {src('Source Link')} || {_NL} || '## Actionable Notes' || {_NL} || '- [ ] Review core concept' || {_NL}"
    travel = (
        f"CASE WHEN c = 'Travel' THEN {_NL} || 'summary: ' || {q('summary')} || {_NL} || 'location: \"\"  # [lat, lng] or \"City, Country\" for Map View' || {_NL} || "
        f"'location_name: \"\"  # e.g. \"Shibuya, Tokyo\" (filled by enrichment)' || {_NL} || 'weight: 0  # times this location is referenced across saved media' || {_NL} || "
        f"'mapMarkerColor: \"#9E9E9E\"  # pin color; see map_marker_color_for_weight()' ELSE '' END"
    )
    generic = (
        f"{head} || {tags} || {travel} || {_NL} || '---' || {top} || {src('Source')} || '- **Original Tags:** ' || coalesce(nullif(tags_text, ''), 'None') || "
        f"{_NL} || {_NL} || '## Notes & Insights' || {_NL} || '- ' || {_NL}"
    )
    return f"""
    WITH r AS ({rows}),
    c AS (SELECT *, {cat} AS c, {Q.first_of('title0', 'summary', "'Saved Post'")} AS title, {Q.first_of('raw_creator', "'Unknown'")} AS creator FROM r),
    x AS (SELECT *, {Q.stage_for('c')} AS stage FROM c)
    SELECT doc_id, c AS category, title, CASE WHEN c IN {Q.in_list(C.ACTIONABLE)} THEN {actionable} WHEN c IN {Q.in_list(C.HIGH_VALUE)} THEN {high} ELSE {generic} END AS content FROM x"""


@query("t19_card_text", card_sql())
def _(t):
    rows = t.video_metadata.join(t.best_scores, "doc_id")
    cols = K.classified_card(
        F.col("cat"), F.col("title"), F.col("creator"), F.col("url"), F.col("text"), F.array_join("tags", ", ")
    )
    return rows.select("doc_id", *[c.alias(n) for n, c in cols.items()])


@query("t19_manual_card", f"""
    WITH f AS (SELECT doc_id, url, CASE WHEN doc_id % 2 = 0 THEN 'Dead or unavailable link.' ELSE 'The model response could not be parsed.' END AS s FROM fetch_log)
    SELECT doc_id, '---' || chr(10) || 'category: "Miscellaneous"' || chr(10) || 'creator: "Unknown"' || chr(10) || 'url: ' || {Q.quoted('url')} || chr(10) || 'status: "inbox"' || chr(10) ||
      'stage: "manual-review"' || chr(10) || 'confidence: 0.0' || chr(10) || 'summary: ' || {Q.quoted('s')} || chr(10) || 'tags:' || chr(10) || '  - saved-media' || chr(10) ||
      '  - category/miscellaneous' || chr(10) || '---' || chr(10) || chr(10) || '# ' || s || chr(10) || chr(10) || '> **Summary:** ' || s || chr(10) || chr(10) ||
      '- **Source Link:** [' || url || '](' || url || ')' || chr(10) || chr(10) || '## Review' || chr(10) || s || chr(10) AS content FROM f""")
def _(t):
    summary = pick(["Dead or unavailable link.", "The model response could not be parsed."], F.col("doc_id") % 2)
    return t.fetch_log.select("doc_id", K.manual_card(F.col("url"), summary, F.lit(0.0), F.lit("")).alias("content"))


@query("t19_travel_card", f"""
    WITH r AS (SELECT id, 'https://v.example.com/t/' || id AS url, name AS summary, location_name, CASE WHEN id % 4 <> 0 THEN location_name END AS destination,
        CASE WHEN id % 5 = 0 THEN 'manual-review' WHEN lat IS NULL THEN 'unmapped-travel' ELSE 'mapped' END AS stage, CASE WHEN id % 5 <> 0 THEN lat END AS lat, lon,
        CASE WHEN id % 2 = 0 THEN 'Main St ' || id END AS address FROM travel_cards)
    SELECT id, '---' || chr(10) || 'category: "Travel"' || chr(10) || 'creator: "Unknown"' || chr(10) || 'url: ' || {Q.quoted('url')} || chr(10) || 'status: "inbox"' || chr(10) ||
      'stage: ' || {Q.quoted('stage')} || chr(10) || 'confidence: 0.75' || chr(10) || 'summary: ' || {Q.quoted('summary')} || chr(10) ||
      CASE WHEN destination IS NOT NULL THEN 'destination: ' || {Q.quoted('destination')} || chr(10) ELSE '' END ||
      CASE WHEN stage <> 'manual-review' THEN 'location_name: ' || {Q.quoted('location_name')} || chr(10) || 'weight: 0' || chr(10) || 'mapMarkerColor: "{C.WEIGHT_ZERO_COLOR}"' || chr(10) ELSE '' END ||
      CASE WHEN lat IS NOT NULL THEN 'location: [' || format('{{:.6f}}', lat) || ', ' || format('{{:.6f}}', lon) || ']' || chr(10) ELSE '' END ||
      CASE WHEN address IS NOT NULL THEN 'address: ' || {Q.quoted('address')} || chr(10) ELSE '' END ||
      'tags:' || chr(10) || '  - saved-media' || chr(10) || '  - category/travel' || chr(10) || '  - ' || {Q.case_map('stage', C.ROUTE_TAGS)} || chr(10) || '---' || chr(10) || chr(10) ||
      '# ' || coalesce(destination, summary) || chr(10) || chr(10) || '> **Summary:** ' || summary || chr(10) || chr(10) || '- **Creator:** @Unknown' || chr(10) ||
      '- **Source Link:** [' || url || '](' || url || ')' || chr(10) || CASE WHEN destination IS NOT NULL THEN '- **Destination:** ' || destination || chr(10) ELSE '' END ||
      chr(10) || '## Notes' || chr(10) || summary || chr(10) AS content FROM r""")
def _(t):
    i, none = F.col("id"), F.lit(None).cast("string")
    stage = F.when(i % 5 == 0, "manual-review").when(F.col("lat").isNull(), "unmapped-travel").otherwise("mapped")
    content = K.travel_card(
        category=F.lit("Travel"), title=none, creator=none, url=F.concat(F.lit("https://v.example.com/t/"), i.cast("string")), summary=F.col("name"),
        destination=F.when(i % 4 != 0, F.col("location_name")), location_name=F.col("location_name"), stage=stage, confidence=F.lit(0.75),
        lat=F.when(i % 5 != 0, F.col("lat")), lon=F.col("lon"), address=F.when(i % 2 == 0, F.concat(F.lit("Main St "), i.cast("string"))))
    return t.travel_cards.select("id", content.alias("content"))


@query("t20_analysis_block", f"""
    WITH l AS (SELECT doc_id, lang, source, string_split(text, chr(10)) AS findings FROM documents)
    SELECT doc_id, '<!-- crusher:start -->' || chr(10) || '## Video Analysis' || chr(10) || chr(10) || '> **Summary:** from ' || source || chr(10) || chr(10) ||
      '- **Media shape:** `standard_video`' || chr(10) || '- **Confidence:** 0.5' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '- **Language:** ' || lang || chr(10) ELSE '' END ||
      chr(10) || '### Findings' || chr(10) || array_to_string(list_transform(findings, lambda x: '- ' || {Q.strip("ltrim(x, '- ')")}), chr(10)) || chr(10) || chr(10) ||
      '### Extracted items' || chr(10) || '- [tip] ' || lang || chr(10) || '- [destination] ' || source || ' (here)' || chr(10) || '<!-- crusher:end -->' || chr(10) AS block FROM l""")
def _(t):
    nowhere = F.lit(None).cast("string")
    item = lambda kind, name, place: F.struct(F.lit(kind).alias("kind"), F.col(name).alias("name"), place.alias("location_name"))
    block = K.findings_block(
        summary=F.concat(F.lit("from "), "source"), shape=F.lit("standard_video"), confidence=F.lit(0.5),
        language=F.when(F.col("doc_id") % 2 == 0, F.col("lang")), notes=nowhere, findings=F.split("text", "\n"),
        items=F.array(item("tip", "lang", nowhere), item("destination", "source", F.lit("here"))),
    )
    return t.documents.select("doc_id", block.alias("block"))


@query("t21_state_text", """
    WITH s AS (SELECT doc_id, 'Title: ' || title || chr(10) || 'Creator: ' || coalesce(creator, '') || chr(10) || 'Caption: ' || description || chr(10) ||
      'Hashtags: ' || array_to_string(tags, ', ') || chr(10) || 'Transcript: ' || CASE WHEN doc_id % 2 = 0 THEN text ELSE 'none' END AS s FROM video_metadata)
    SELECT doc_id, CASE WHEN length(s) > 24000 THEN left(s, 24000) || ' [truncated]' ELSE s END AS state FROM s""")
def _(t):
    state = T.state_text(F.col("title"), F.col("creator"), F.col("description"), F.col("tags"), F.when(F.col("doc_id") % 2 == 0, F.col("text")))
    return t.video_metadata.select("doc_id", T.capped_state(state).alias("state"))


@query("t21_analysis_state_text", """
    WITH r AS (SELECT v.doc_id, v.title, v.creator, v.description, v.tags, c.folder, v.text, c.summary, string_split(v.text, chr(10)) AS f
        FROM video_metadata v JOIN cards c ON c.doc_id = v.doc_id),
    s AS (SELECT doc_id, 'Title: ' || title || chr(10) || 'Creator: ' || coalesce(creator, '') || chr(10) || 'Caption: ' || description || chr(10) ||
      'Hashtags: ' || array_to_string(tags, ', ') || chr(10) || 'Current folder: ' || coalesce(nullif(folder, ''), 'unknown') || chr(10) || 'Transcript (captions): ' || text || chr(10) ||
      'Summary: ' || summary || chr(10) || 'Findings: ' || array_to_string(list_slice(f, 1, 15), ' | ') || CASE WHEN doc_id % 3 <> 0 THEN chr(10) || 'Items: ' || folder || '; ' || 'x' ELSE '' END AS s FROM r)
    SELECT doc_id, CASE WHEN length(s) > 24000 THEN left(s, 24000) || ' [truncated]' ELSE s END AS state FROM s""")
def _(t):
    rows = t.video_metadata.join(t.cards.select("doc_id", "folder", "summary"), "doc_id")
    items = F.when(F.col("doc_id") % 3 != 0, F.array(F.col("folder"), F.lit("x"))).otherwise(F.array().cast("array<string>"))
    state = T.analysis_state_text(
        F.col("title"), F.col("creator"), F.col("description"), F.col("tags"), F.col("folder"), F.lit("captions"), F.col("text"),
        F.col("summary"), F.split("text", "\n"), items)
    return rows.select("doc_id", T.capped_state(state).alias("state"))


@query("t22_token_estimate", "SELECT doc_id, length(text) // 4 + 400 + (doc_id % 5) * 300 AS tokens, length(text) // 4 + 400 + floor(greatest(duration, 1.0) * 1.0 * 100)::BIGINT AS clip_tokens FROM video_metadata")
def _(t):
    chars = F.length("text")
    return t.video_metadata.select(
        "doc_id", T.estimated_tokens(chars, F.col("doc_id") % 5).alias("tokens"),
        T.estimated_video_tokens(chars, F.col("duration"), F.lit(1.0)).alias("clip_tokens"),
    )


@query("t23_clock", f"""
    SELECT video, pos, {Q.clock('floor(start_s * 37)')} AS clock, start_s * 37 + 0.5 AS seconds FROM cues""")
def _(t):
    s = F.col("start_s") * 37
    stamp = F.concat(F.floor(s / 60).cast("string"), F.lit(":"), (F.floor(s) % 60).cast("string"), F.lit(",5"))
    return t.cues.select("video", "pos", T.clock(s).alias("clock"), T.cue_seconds(stamp).alias("seconds"))


@query("o4_array_caps", """
    SELECT video, array_to_string(list_slice(list_sort(list(DISTINCT name)), 1, 20), '|') AS first_items FROM items GROUP BY video""")
def _(t):
    return CAT.first_names(t.items, "video", "name", 20).select("video", F.array_join("names", "|").alias("first_items"))


# --- taxonomy and tags ------------------------------------------------------------------------------

_LABEL = f"(CASE WHEN p_partkey % 3 = 0 THEN ' Music ' WHEN p_partkey % 3 = 1 THEN p_type ELSE {Q.list_of(C.CATEGORIES)}[p_partkey % 14 + 1] END)"


def _label():
    p = F.col("p_partkey")
    return F.when(p % 3 == 0, " Music ").when(p % 3 == 1, F.col("p_type")).otherwise(pick(C.CATEGORIES, p % 14))


@query("g1_canonical_category", f"SELECT p_partkey, {Q.canonical_category(_LABEL)} AS category FROM part")
def _(t):
    return t.read("part").select("p_partkey", G.canonical_category(_label()).alias("category"))


@query("g2_folder", f"SELECT p_partkey, {Q.folder(_LABEL)} AS folder FROM part")
def _(t):
    return t.read("part").select("p_partkey", G.folder_for(_label()).alias("folder"))


@query("g3_category_tag", f"SELECT p_partkey, {Q.category_tag(_LABEL)} AS tag FROM part")
def _(t):
    return t.read("part").select("p_partkey", G.category_tag(_label()).alias("tag"))


@query("g4_category_of_folder", """
    WITH d AS (SELECT category, folder FROM taxonomy UNION ALL SELECT DISTINCT p_type, 'Tips' FROM part UNION ALL SELECT DISTINCT p_type, 'shared' FROM part UNION ALL SELECT DISTINCT p_type, p_type || ' box' FROM part)
    SELECT folder, CASE WHEN bool_or(category = folder) THEN folder WHEN count(*) = 1 THEN max(category) ELSE folder END AS category FROM d GROUP BY folder""")
def _(t):
    types = t.read("part").select(F.col("p_type").alias("category")).distinct()
    dim = t.taxonomy.select("category", "folder")
    for folder in (F.lit("Tips"), F.lit("shared"), F.concat("category", F.lit(" box"))):
        dim = dim.unionByName(types.select("category", folder.alias("folder")))
    return CAT.category_of_folder(dim)


@query("g5_existing_name", """
    WITH e AS (SELECT n_name AS existing FROM nation UNION ALL SELECT lower(n_name) FROM nation WHERE n_nationkey % 5 = 0),
    r AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN n_name WHEN 1 THEN lower(n_name) ELSE left(lower(n_name), 3) || substr(n_name, 4) END AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey)
    SELECT s_suppkey, CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.existing = r.name) THEN r.name
      WHEN (SELECT count(*) FROM e WHERE lower(e.existing) = lower(r.name)) = 1 THEN (SELECT max(existing) FROM e WHERE lower(e.existing) = lower(r.name)) ELSE r.name END AS resolved FROM r""")
def _(t):
    nation = t.read("nation")
    names = nation.select(F.col("n_name").alias("existing")).unionByName(nation.filter(F.col("n_nationkey") % 5 == 0).select(F.lower("n_name").alias("existing")))
    s, n = F.col("s_suppkey") % 3, F.col("n_name")
    typed = t.read("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.when(s == 0, n).when(s == 1, F.lower(n)).otherwise(F.concat(F.left(F.lower(n), F.lit(3)), F.substr(n, F.lit(4)))).alias("name")
    )
    return CAT.resolved_names(typed, names).select("s_suppkey", "resolved")


@query("g6_card_tags", f"SELECT doc_id, 'saved-media|' || {Q.category_tag('category')} AS tags FROM cards")
def _(t):
    return t.cards.select("doc_id", joined(G.card_tags(F.col("category"))).alias("tags"))


@query("g7_replace_category_tag", f"SELECT doc_id, 'old-library|' || list_extract(tags, 3) || '|' || {Q.category_tag('category')} AS tags FROM cards")
def _(t):
    return t.cards.select("doc_id", joined(G.replace_category_tag(F.col("tags"), F.col("category"))).alias("tags"))


@query("g8_rewrite_tags", "SELECT doc_id, 'saved-media|category/recipes-and-food' || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '|' || list_extract(tags, 3) END AS tags FROM cards")
def _(t):
    # Every fourth card repeats the new spellings, which collapse.
    tags = F.when(F.col("doc_id") % 4 == 0, F.array(F.get("tags", F.lit(0)), F.lit("saved-media"), F.get("tags", F.lit(1)), F.lit("category/recipes-and-food"))).otherwise(F.col("tags"))
    return t.cards.select("doc_id", joined(G.rewrite_tags(tags, {"old-library": "saved-media"})).alias("tags"))


@query("g9_criteria_tags", f"""
    WITH r AS (SELECT p_partkey, {Q.list_of(C.HIGH_VALUE + [C.AMBIGUOUS])}[p_partkey % 4 + 1] AS cat, p_name AS a, CASE WHEN p_partkey % 5 <> 0 THEN 'X/' || p_brand END AS b FROM part)
    SELECT p_partkey, 'saved-media|' || {Q.category_tag('cat')} || CASE WHEN p_partkey % 4 = 3 THEN '' ELSE '|' || ['tech', 'field', 'type'][p_partkey % 4 + 1] || '/' || replace(replace(lower(a), ' ', '-'), '/', '') ||
      CASE WHEN b IS NULL THEN '' ELSE '|' || ['tool', 'time', 'genre'][p_partkey % 4 + 1] || '/' || replace(replace(lower(b), ' ', '-'), '/', '') END END AS tags FROM r""")
def _(t):
    p = F.col("p_partkey")
    cat = pick(C.HIGH_VALUE + [C.AMBIGUOUS], p % 4)
    second = F.when(p % 5 != 0, F.concat(F.lit("X/"), F.col("p_brand")))
    return t.read("part").select("p_partkey", joined(G.criteria_tags(cat, cat, F.col("p_name"), second)).alias("tags"))


@query("g10_item_category", f"SELECT l_orderkey, l_linenumber, l_partkey, {Q.case_map('k', C.KIND_CATEGORY, repr('Sports'))} AS category FROM (SELECT *, {Q.list_of(C.ITEM_KINDS + ['gadget'])}[l_partkey % 13 + 1] AS k FROM lineitem)")
def _(t):
    kind = pick(C.ITEM_KINDS + ["gadget"], F.col("l_partkey") % 13)
    return t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", G.item_category(kind, F.lit("Sports")).alias("category"))


@query("g11_weight_color", f"SELECT s_suppkey, {Q.weight_color('s_suppkey % 9 - 1')} AS color FROM supplier")
def _(t):
    return t.read("supplier").select("s_suppkey", G.weight_color(F.col("s_suppkey") % 9 - 1).alias("color"))


@query("g12_place_query", f"""
    SELECT s_suppkey, {Q.place_query('place', 'r_name')} AS query FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN n_name ELSE n_name || '  in ' || lower(r_name) END AS place, r_name
      FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)""")
def _(t):
    places = t.read("nation").join(t.read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    rows = t.read("supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    s = F.col("s_suppkey") % 3
    place = F.when(s == 0, "  ").when(s == 1, F.col("n_name")).otherwise(F.concat("n_name", F.lit("  in "), F.lower("r_name")))
    return rows.select("s_suppkey", G.place_query(place, F.col("r_name")).alias("query"))


@query("g13_coordinates", "SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE value * 10 END BETWEEN -90 AND 90 AND event_id % 400 - 200 BETWEEN -180 AND 180, FALSE) AS usable FROM events")
def _(t):
    e = F.col("event_id")
    lat = F.when(e % 5 != 0, F.col("value") * 10)
    lat = F.when(e % 5 == 0, F.when(e % 10 == 0, F.lit(float("nan")))).otherwise(lat)
    return t.read("events").select("event_id", G.coordinates_ok(lat, (e % 400 - 200).cast("double")).alias("usable"))


@query("g14_route_tag", f"SELECT o_orderkey, {Q.case_map('s', C.ROUTE_TAGS, repr('travel/manual-review'))} AS tag FROM (SELECT o_orderkey, ['mapped', 'unmapped-travel', 'manual-review', 'odd'][o_orderkey % 4 + 1] AS s FROM orders)")
def _(t):
    stage = pick(["mapped", "unmapped-travel", "manual-review", "odd"], F.col("o_orderkey") % 4)
    return t.read("orders").select("o_orderkey", G.route_tag(stage).alias("tag"))


@query("g15_guidance", "SELECT c.doc_id, t.category, coalesce(t.hint, t.category) AS criteria FROM cards c JOIN taxonomy t ON t.category = c.category")
def _(t):
    known = t.cards.filter(G.known_category(F.col("category")))
    return known.select("doc_id", "category", G.criteria_text(F.col("category")).alias("criteria"))
