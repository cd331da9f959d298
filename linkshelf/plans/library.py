"""Card catalogue queries: work lists, naming, boards, triage, migrations and folder reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkshelf import constants as C
from linkshelf.functions import cards as K
from linkshelf.functions import tags as G
from linkshelf.functions import text as T
from linkshelf.operators import catalog as CAT
from linkshelf.operators import migrations as MG
from linkshelf.operators import routing as RT
from linkshelf.operators.ordered import row_numbers
from linkshelf.plans import sqltext as Q
from linkshelf.plans.derived import joined, pick
from linkshelf.plans.registry import query

_AS_OF = "2024-01-31"

# --- work lists -----------------------------------------------------------------------------


@query("p2_work_list", """
    SELECT doc_id, path FROM cards WHERE lower(coalesce(status, '')) NOT IN ('tossed', 'archived') AND doc_id % 25 <> 3
      AND starts_with(folder || '/' || name, 'T') AND (starts_with(folder || '/' || name, 'Tech') OR starts_with(folder || '/' || name, 'Travel/'))""")
def _(t):
    rel = F.concat("folder", F.lit("/"), "name")
    keep = CAT.in_work_list(
        rel, F.col("url"), F.col("status"), F.col("doc_id") % 25 == 3, folder="/T", include=["Tech", "Travel/"], skip_statuses=["Tossed", "archived"]
    )
    return t.cards.filter(keep).select("doc_id", "path")


@query("p3_ordered_limit", "SELECT doc_id, path FROM cards WHERE coalesce(status, '') <> 'tossed' ORDER BY path LIMIT 50")
def _(t):
    keep = CAT.in_work_list(F.col("path"), F.col("url"), F.col("status"), F.lit(False))
    return CAT.ordered_limit(t.cards.filter(keep), 50).select("doc_id", "path")


@query("o2_path_order", "SELECT doc_id, path FROM cards ORDER BY path")
def _(t):
    return CAT.ordered_limit(t.cards, None).select("doc_id", "path")


@query("p5_enrichment_list", f"""
    SELECT doc_id FROM cards WHERE ({' OR '.join(Q.in_folder('folder', f) for f in [C.TECH, C.PROJECTS, C.MOVIES, C.MANUAL_REVIEW_FOLDER])})
      AND NOT ends_with(name, 'Hub.md') AND NOT ends_with(name, 'Kanban.md') AND NOT (confidence IS NOT NULL AND confidence <> 0)""")
def _(t):
    return t.cards.filter(CAT.needs_enrichment(F.col("folder"), F.col("name"), F.col("confidence"))).select("doc_id")


_QUEUED = f"""(CASE WHEN starts_with(name, '.') OR {Q.is_board('name')} THEN FALSE WHEN lower(coalesce(status, '')) IN ('kept', 'promoted', 'tossed') THEN FALSE
    WHEN {Q.in_folder('folder', C.MANUAL_REVIEW_FOLDER)} THEN TRUE ELSE lower(coalesce(status, '')) IN ('inbox', 'manual-review') OR lower(coalesce(stage, '')) = 'manual-review' END)"""


@query("p6_triage_membership", f"SELECT doc_id, {_QUEUED} AS queued FROM cards")
def _(t):
    return t.cards.select("doc_id", CAT.is_queued(F.col("folder"), F.col("name"), F.col("status"), F.col("stage")).alias("queued"))


@query("o1_triage_order", f"""
    SELECT doc_id, path, CASE WHEN {Q.in_folder('folder', C.MANUAL_REVIEW_FOLDER)} THEN 0 WHEN lower(coalesce(status, '')) = 'manual-review' OR lower(coalesce(stage, '')) = 'manual-review' THEN 1 ELSE 2 END AS rank
    FROM cards WHERE {_QUEUED} ORDER BY rank, lower(path)""")
def _(t):
    return CAT.triage_queue(t.cards).select("doc_id", "path", "rank")


@query("p7_travel_cards", f"SELECT doc_id, NOT {Q.is_board('name')} AS migrated, NOT contains(name, 'Hub') AND NOT contains(name, 'Map') AS weighted FROM cards WHERE folder = 'Travel'")
def _(t):
    rows = t.cards.filter(CAT.in_folder(F.col("folder"), "Travel"))
    return rows.select("doc_id", CAT.is_travel_card(F.col("name")).alias("migrated"), CAT.counts_for_weight(F.col("name")).alias("weighted"))


# --- names, weights, boards -------------------------------------------------------------------

_STEMS = f"""
    new AS (SELECT c.doc_id AS seq, c.folder, {Q.safe_filename('v.title')} AS stem FROM cards c JOIN video_metadata v ON v.doc_id = c.doc_id),
    old AS (SELECT DISTINCT folder, ['Saved Video', 'Top 10 places to see'][doc_id % 2 + 1] AS stem, (doc_id // 3) % 6 + 1 AS x FROM cards WHERE doc_id % 5 = 0)"""


@query("w5_unique_names", f"""
    WITH {_STEMS}, k AS (SELECT *, row_number() OVER (PARTITION BY folder, stem ORDER BY seq) AS k FROM new),
    need AS (SELECT folder, stem, count(*) AS n FROM new GROUP BY folder, stem), room AS (SELECT folder, stem, unnest(range(1, n + 8)) AS x FROM need),
    free AS (SELECT r.folder, r.stem, r.x, row_number() OVER (PARTITION BY r.folder, r.stem ORDER BY r.x) AS k FROM room r ANTI JOIN old o ON o.folder = r.folder AND o.stem = r.stem AND o.x = r.x)
    SELECT k.seq, k.folder, CASE WHEN f.x = 1 THEN k.stem ELSE k.stem || ' (' || f.x || ')' END AS final_stem FROM k JOIN free f ON f.folder = k.folder AND f.stem = k.stem AND f.k = k.k""")
def _(t):
    titles = t.video_metadata.select("doc_id", T.safe_filename(F.col("title")).alias("stem"))
    new = t.cards.select("doc_id", "folder").join(titles, "doc_id").withColumnRenamed("doc_id", "seq")
    d = F.col("doc_id")
    base = pick(["Saved Video", "Top 10 places to see"], d % 2)
    index = F.expr("(doc_id div 3) % 6 + 1")
    old = t.cards.filter(d % 5 == 0).select(
        "folder", F.when(index == 1, base).otherwise(F.concat(base, F.lit(" ("), index.cast("string"), F.lit(")"))).alias("stem")
    ).distinct()
    return CAT.unique_names(new, old).select("seq", "folder", "final_stem")


@query("a1_place_weights", f"""
    WITH n AS (SELECT *, count(*) OVER (PARTITION BY location_name) AS w FROM travel_cards WHERE NOT contains(name, 'Hub') AND NOT contains(name, 'Map'))
    SELECT id, w AS new_weight, {Q.weight_color('w')} AS new_color, coalesce(n.lat, g.lat) AS lat, coalesce(n.lon, g.lon) AS lon
    FROM n LEFT JOIN (SELECT * FROM gazetteer WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180) g ON lower(g.place) = lower(n.location_name) WHERE weight <> w OR color <> {Q.weight_color('w')}""")
def _(t):
    return CAT.reweighted(t.travel_cards, t.gazetteer).select("id", "new_weight", "new_color", "lat", "lon")


def _board_rows(t):
    return t.movies.select("seq", pick(["To Watch", "Watched"], F.col("seq") % 5 % 2).alias("column"), "title")


_BOARD = """
    WITH b AS (SELECT ['To Watch', 'Watched'][seq % 5 % 2 + 1] AS "column", title, min(seq) AS added_seq FROM movies GROUP BY ALL)
    SELECT "column", title, added_seq, row_number() OVER (PARTITION BY "column" ORDER BY added_seq DESC) AS position FROM b"""


@query("a11_watch_board", _BOARD)
def _(t):
    return CAT.board_entries(_board_rows(t)).select("column", "title", "added_seq", "position")


@query("h12_watch_board", f"SELECT \"column\", position, '- [ ] [[' || title || ']]' AS line FROM ({_BOARD.strip()})")
def _(t):
    return CAT.board_entries(_board_rows(t)).select("column", "position", F.concat(F.lit("- [ ] [["), "title", F.lit("]]")).alias("line"))


_NOTED = "starts_with(title, 'SMALL')"  # titles that have a note before the run


@query("j10_movie_merge", f"SELECT seq, title, count(*) OVER (PARTITION BY title) AS clips, {_NOTED} OR seq <> min(seq) OVER (PARTITION BY title) AS merged FROM movies")
def _(t):
    notes = t.movies.filter(F.startswith("title", F.lit("SMALL"))).select("title")
    return CAT.merged_titles(t.movies, notes=notes).select("seq", "title", "clips", "merged")


@query("j10_merge_events", f"""
    SELECT url, CASE WHEN {_NOTED} OR seq <> min(seq) OVER (PARTITION BY title) THEN 'merged' ELSE 'carded' END AS event FROM movies""")
def _(t):
    notes = t.movies.filter(F.startswith("title", F.lit("SMALL"))).select("title")
    return CAT.merge_events(CAT.merged_titles(t.movies, notes=notes))


@query("j12_missing_hubs", f"""
    WITH f AS (SELECT DISTINCT folder FROM cards UNION SELECT DISTINCT p_type FROM part UNION SELECT '.trash'),
    h AS (SELECT DISTINCT folder, folder || ' Hub.md' AS name FROM cards WHERE doc_id % 14 IN (1, 2, 3))
    SELECT folder, folder || ' Hub.md' AS hub FROM f WHERE folder NOT IN {Q.in_list(C.MODEL_OWNED_FOLDERS + ['Inbox'])} AND NOT starts_with(folder, '.') AND folder NOT IN (SELECT folder FROM h)""")
def _(t):
    folders = t.cards.select("folder").unionByName(t.read("part").select(F.col("p_type").alias("folder"))).distinct()
    dot = t.cards.select(F.lit(".trash").alias("folder")).distinct()
    hubs = t.cards.filter((F.col("doc_id") % 14).isin(1, 2, 3)).select("folder", F.concat("folder", F.lit(" Hub.md")).alias("name")).distinct()
    return CAT.missing_hubs(folders.unionByName(dot), hubs)


# --- triage ---------------------------------------------------------------------------------------

_ARGS = """CASE WHEN doc_id % 12 = 1 THEN '../x' WHEN doc_id % 6 = 1 THEN ['comedy', 'Travel', 'Inbox', ' New  Box '][doc_id // 12 % 4 + 1]
      WHEN doc_id % 6 = 2 THEN ['eco*nomy', 'Brand new', '..', 'SMALL'][doc_id // 6 % 4 + 1] END"""


def _effects(t):
    d = F.col("doc_id")
    arg = (
        F.when(d % 12 == 1, "../x").when(d % 6 == 1, pick(["comedy", "Travel", "Inbox", " New  Box "], F.expr("doc_id div 12 % 4")))
        .when(d % 6 == 2, pick(["eco*nomy", "Brand new", "..", "SMALL"], F.expr("doc_id div 6 % 4")))
    )
    decisions = t.cards.select("path", pick(["k", "m", "p", "t", "d", "s"], d % 6).alias("action"), arg.alias("arg"))
    cards = t.cards.withColumn("fm_state", F.when(d % 23 == 5, "broken").otherwise("ok"))
    folders = t.taxonomy.select(F.col("folder").alias("existing")).distinct()
    projects = t.read("part").select(F.col("p_type").alias("existing")).distinct()
    return CAT.triage_effects(cards, decisions, t.taxonomy.select("category", "folder"), folders, projects)


_EFFECTS = f"""
    x AS (SELECT *, ['k', 'm', 'p', 't', 'd', 's'][doc_id % 6 + 1] AS action, {_ARGS} AS arg, doc_id % 23 <> 5 AS ok FROM cards),
    g AS (SELECT *, CASE WHEN action = 'm' THEN CASE arg WHEN '../x' THEN NULL WHEN 'comedy' THEN 'Comedy' WHEN ' New  Box ' THEN 'New Box' ELSE arg END
        WHEN action = 'p' THEN CASE arg WHEN 'eco*nomy' THEN 'ECONOMY' WHEN '..' THEN NULL ELSE arg END
        WHEN action = 'k' AND {Q.in_folder('folder', C.MANUAL_REVIEW_FOLDER)} THEN {Q.folder('category')} END AS target FROM x),
    o AS (SELECT *, CASE WHEN action = 'd' THEN 'deleted' WHEN action = 's' THEN 'skipped' WHEN NOT ok THEN 'rejected' WHEN action = 'k' THEN 'kept' WHEN action = 't' THEN 'tossed'
        WHEN target IS NULL THEN 'rejected' WHEN action = 'm' THEN 'moved' ELSE 'promoted' END AS outcome FROM g)"""


@query("j14_triage_outcome", f"WITH {_EFFECTS} SELECT doc_id, action, outcome FROM o")
def _(t):
    return _effects(t).select("doc_id", "action", "outcome")


@query("d12_triage_effects", f"""
    WITH {_EFFECTS} SELECT doc_id, CASE WHEN outcome IN ('kept', 'promoted', 'tossed') THEN outcome ELSE status END AS new_status,
      CASE WHEN outcome IN ('kept', 'moved', 'promoted', 'tossed') AND stage = 'manual-review' THEN NULL ELSE stage END AS new_stage,
      CASE WHEN outcome = 'moved' THEN CASE target WHEN 'Comedy' THEN 'Comedy/Funny' WHEN 'Inbox' THEN 'Miscellaneous' ELSE target END ELSE category END AS new_category,
      CASE WHEN outcome = 'moved' THEN 'old-library|' || list_extract(tags, 3) || '|' || CASE target WHEN 'Comedy' THEN 'category/comedy-funny' WHEN 'Inbox' THEN 'category/miscellaneous'
        WHEN 'Travel' THEN 'category/travel' ELSE 'category/new-box' END ELSE array_to_string(tags, '|') END AS new_tags,
      CASE WHEN outcome = 'promoted' THEN '1 - Projects/' || target WHEN outcome IN ('moved', 'kept') AND target IS NOT NULL THEN '3 - Resources/' || target
        WHEN outcome <> 'deleted' THEN '3 - Resources/' || folder END AS new_folder FROM o""")
def _(t):
    return _effects(t).select("doc_id", "new_status", "new_stage", "new_category", joined(F.col("new_tags")).alias("new_tags"), "new_folder")


@query("d12_deletion_events", "SELECT url, 'tossed' AS event FROM cards WHERE doc_id % 6 = 4")
def _(t):
    return CAT.deletion_events(_effects(t)).select("url", "event")


@query("a7_triage_counters", f"WITH {_EFFECTS} SELECT outcome, count(*) AS cards FROM o GROUP BY outcome")
def _(t):
    return _effects(t).groupBy("outcome").agg(F.count(F.lit(1)).alias("cards"))


# --- migrations ---------------------------------------------------------------------------------------

_LEGACY = {"old-library": "saved-media"}
_NEW_STAGE = Q.case_map("lower(coalesce(status, ''))", C.LEGACY_STATUS_STAGE)


@query("v1_migrate_cards", f"""
    SELECT doc_id, coalesce({_NEW_STAGE}, stage) AS new_stage, CASE WHEN {_NEW_STAGE} IS NOT NULL THEN 'inbox' ELSE status END AS new_status,
      CASE WHEN category = 'Music' THEN 'Saved Music' ELSE category END AS new_category, CASE WHEN doc_id % 3 = 0 THEN 'saved-media' ELSE 'saved-media|category/recipes-and-food|' || list_extract(tags, 3) END AS new_tags,
      doc_id % 3 <> 0 OR {_NEW_STAGE} IS NOT NULL OR category = 'Music' AS changed FROM cards""")
def _(t):
    cards = t.cards.withColumn("tags", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("saved-media"))).otherwise(F.col("tags")))
    rows = MG.migrated_cards(cards, _LEGACY)
    return rows.select("doc_id", "new_stage", "new_status", "new_category", joined(F.col("new_tags")).alias("new_tags"), "changed")


@query("v1_second_run", "SELECT count(*) AS cards, 0::BIGINT AS changed FROM cards")
def _(t):
    once = MG.migrated_cards(t.cards, _LEGACY)
    again = once.select("doc_id", *[F.col(f"new_{c}").alias(c) for c in ("stage", "status", "category", "tags")])
    return MG.migrated_cards(again, _LEGACY).agg(F.count(F.lit(1)).alias("cards"), F.count_if("changed").alias("changed"))


def _travel_notes(t):
    d = F.col("doc_id")
    pairs = {
        "status": F.when(d % 3 != 0, F.coalesce("status", F.lit(" "))), "summary": F.when(d % 4 == 0, "given").when(d % 4 == 1, ""),
        "location": F.when(d % 5 == 0, ""), "location_name": F.when(d % 5 < 2, "Lisbon"),
        "weight": F.when(d % 6 == 0, "4").when(d % 6 == 1, "many"), "mapMarkerColor": F.when(d % 7 == 0, "#000000"),
    }
    full = F.map_from_entries(F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("k"), v.alias("v"))) for k, v in pairs.items()])))
    body = F.concat(F.lit("\n# t\n\n> **Summary:** seen "), d.cast("string"), F.lit("\n"))
    tags = F.when(d % 2 == 0, F.array(F.lit("tiktok"))).otherwise(F.array(F.lit("tiktok"), F.lit("saved-media")))
    return t.cards.select("doc_id", full.alias("fm"), tags.alias("tags"), body.alias("body"))


@query("v2_travel_backfill", f"""
    WITH b AS (SELECT doc_id, doc_id % 3 = 0 OR status IS NULL AS f_status, doc_id % 4 <> 0 AS f_summary, doc_id % 5 <> 0 AS f_location, doc_id % 5 >= 2 AS f_name, doc_id % 6 > 1 AS f_weight,
        doc_id % 7 <> 0 AS f_color, doc_id % 2 = 0 AS f_tags, status, CASE WHEN doc_id % 6 = 0 THEN 4 ELSE 0 END AS w FROM cards)
    SELECT doc_id, array_to_string(list_filter([CASE WHEN f_status THEN 'status' END, CASE WHEN f_summary THEN 'summary' END, CASE WHEN f_location THEN 'location' END, CASE WHEN f_name THEN 'location_name' END,
        CASE WHEN f_weight THEN 'weight' END, CASE WHEN f_color THEN 'mapMarkerColor' END, CASE WHEN f_tags THEN 'tags' END], lambda x: x IS NOT NULL), ',') AS changed_keys,
      CASE WHEN f_status THEN 'inbox' ELSE status END AS status, CASE WHEN f_summary THEN 'seen ' || doc_id ELSE 'given' END AS summary, w::VARCHAR AS weight,
      CASE WHEN f_color THEN {Q.weight_color('w')} ELSE '#000000' END AS color, CASE WHEN f_name THEN '' ELSE 'Lisbon' END AS location_name, 'tiktok|saved-media' AS tags FROM b""")
def _(t):
    rows = MG.backfilled_travel(_travel_notes(t))
    value = lambda k: F.try_element_at("new_fm", F.lit(k))
    return rows.select(
        "doc_id", joined(F.col("changed_keys"), ",").alias("changed_keys"), value("status").alias("status"), value("summary").alias("summary"),
        value("weight").alias("weight"), value("mapMarkerColor").alias("color"), value("location_name").alias("location_name"), joined(F.col("new_tags")).alias("tags"),
    )


def _children(t):
    v, p = F.col("video"), F.col("position")
    rows = t.items.select(
        F.concat(F.lit("https://v.example.com/o/"), v.cast("string")).alias("url"), F.concat(F.lit("Order: "), v.cast("string")).alias("stem"),
        F.lit("maker").alias("creator"), pick(C.CATEGORIES, v % 14).alias("parent_category"), "kind", "name",
        F.when(p % 2 == 0, F.concat(F.lit("artist "), p.cast("string"))).alias("artist"), F.when(p % 3 == 0, "Lisbon").alias("location_name"), "position",
    )
    return MG.child_columns(rows)


_CHILDREN = f"""
    c AS (SELECT *, 'https://v.example.com/o/' || video AS url, {Q.case_map('kind', C.KIND_CATEGORY)} AS child_category FROM items),
    ch AS (SELECT url, name, kind, position, child_category, {Q.folder('child_category')} || '/Order ' || video AS child_folder, name AS child_stem,
      substr(sha256(url || '|' || kind || '|' || name || '|' || CASE WHEN position <> 0 THEN position::VARCHAR ELSE '' END), 1, 20) AS item_id,
      'saved-media|' || {Q.category_tag('child_category')} || '|crusher-item/' || kind AS child_tags,
      CASE WHEN kind IN ('album', 'song') AND position % 2 = 0 THEN 'artist ' || position END AS child_artist,
      CASE WHEN kind = 'destination' THEN CASE WHEN position % 3 = 0 THEN 'Lisbon' ELSE name END END AS child_location_name,
      CASE WHEN kind = 'destination' THEN 0 END AS child_weight, CASE WHEN kind = 'destination' THEN '#9E9E9E' END AS child_color FROM c)"""


@query("v3_child_rows", f"WITH {_CHILDREN} SELECT url, kind, name, position, child_folder, item_id, child_tags FROM ch")
def _(t):
    """Analysed parents, each with its items in one array, exploded into child rows."""
    v, p = F.col("video"), F.col("position")
    item = F.struct(
        "kind", "name", F.when(p % 2 == 0, F.concat(F.lit("artist "), p.cast("string"))).alias("artist"),
        F.when(p % 3 == 0, "Lisbon").alias("location_name"), "position",
    )
    parents = t.items.groupBy("video").agg(F.collect_list(item).alias("items")).select(
        F.concat(F.lit("https://v.example.com/o/"), v.cast("string")).alias("url"), F.concat(F.lit("Order: "), v.cast("string")).alias("stem"),
        F.lit("maker").alias("creator"), pick(C.CATEGORIES, v % 14).alias("category"), "items",
    )
    return MG.child_rows(parents).select("url", "kind", "name", "position", "child_folder", "item_id", joined(F.col("child_tags")).alias("child_tags"))


@query("v3_child_cards", f"WITH {_CHILDREN} SELECT * FROM ch")
def _(t):
    return _children(t).select(
        "url", "name", "kind", "position", "child_category", "child_folder", "child_stem", "item_id", joined(F.col("child_tags")).alias("child_tags"),
        "child_artist", "child_location_name", "child_weight", "child_color",
    )


@query("j9_child_match", f"""
    WITH {_CHILDREN}, one AS (SELECT DISTINCT child_folder, item_id, position FROM ch), old AS (SELECT child_folder, item_id, CASE position % 3 WHEN 0 THEN 'Kept' ELSE 'inbox' END AS status FROM one WHERE position % 2 = 0)
    SELECT o.item_id, CASE WHEN lower(s.status) = 'kept' THEN 'keep' WHEN s.status IS NOT NULL THEN 'rewrite' ELSE 'create' END AS effect
    FROM one o LEFT JOIN old s ON s.child_folder = o.child_folder AND s.item_id = o.item_id""")
def _(t):
    one = _children(t).select("child_folder", "item_id", "position").distinct()
    old = one.filter(F.col("position") % 2 == 0).select(
        "child_folder", "item_id", F.when(F.col("position") % 3 == 0, "Kept").otherwise("inbox").alias("status"), F.lit("s").alias("stem")
    )
    return MG.child_upserts(one, old).select("item_id", "effect")


@query("v4_enriched_card", f"""
    WITH r AS (SELECT c.doc_id, c.url, c.creator, c.status, c.stage, s.confidence, {Q.list_of(C.HIGH_VALUE + [C.AMBIGUOUS])}[c.doc_id % 4 + 1] AS cat, v.title AS summ, lower(coalesce(c.status, '')) IN ('kept', 'promoted', 'tossed') AS human
        FROM cards c JOIN best_scores s ON s.doc_id = c.doc_id JOIN video_metadata v ON v.doc_id = c.doc_id),
    x AS (SELECT *, confidence < 0.65 OR cat = 'Other / Ambiguous' AS manual FROM r),
    y AS (SELECT *, CASE WHEN manual THEN 'Miscellaneous' ELSE cat END AS label, CASE WHEN human THEN stage WHEN manual THEN 'manual-review' WHEN cat = 'Movies & Shows' THEN 'to-watch' END AS st,
        {Q.safe_filename("CASE WHEN cat = 'Movies & Shows' AND NOT manual THEN 'Film ' || doc_id % 9 ELSE summ END", 75, 'Untitled')} AS title FROM x)
    SELECT doc_id, title, '---' || chr(10) || 'category: ' || {Q.quoted('label')} || chr(10) || 'creator: ' || {Q.quoted('creator')} || chr(10) || 'url: ' || {Q.quoted('url')} || chr(10) || 'status: ' ||
      {Q.quoted("CASE WHEN human THEN status ELSE 'inbox' END")} || chr(10) || CASE WHEN st IS NOT NULL THEN 'stage: ' || {Q.quoted('st')} || chr(10) ELSE '' END || 'confidence: ' || confidence || chr(10) ||
      'tags:' || chr(10) || '  - saved-media' || chr(10) || '  - ' || {Q.category_tag('label')} || CASE cat WHEN 'Tech & Coding' THEN chr(10) || '  - tech/open-source' WHEN 'Project Ideas' THEN chr(10) || '  - field/open-source'
      WHEN 'Movies & Shows' THEN chr(10) || '  - type/open-source' ELSE '' END || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || '> **Context:** ' || summ || chr(10) || chr(10) ||
      '- **Creator:** @' || creator || chr(10) || '- **Source Link:** [' || url || '](' || url || ')' || chr(10) || chr(10) || '## Actionable Notes' || chr(10) || '- mine' || chr(10) AS content FROM y""")
def _(t):
    cat = pick(C.HIGH_VALUE + [C.AMBIGUOUS], F.col("doc_id") % 4)
    rows = t.cards.select("doc_id", "url", "creator", "status", "stage").join(t.best_scores.select("doc_id", F.col("confidence").alias("score")), "doc_id")
    rows = rows.join(t.video_metadata.select("doc_id", F.col("title").alias("summ")), "doc_id").withColumn("cat", cat)
    where = RT.high_value_route(F.col("cat"), F.col("score"), F.lit(False), F.lit(True))
    rows = rows.withColumns({"label": where["label"], "route_stage": where["stage"]})
    guard = RT.guarded(F.col("status"), F.col("stage"), F.col("route_stage"))
    movie = F.col("route_stage").eqNullSafe(F.lit("to-watch"))
    film = F.concat(F.lit("Film "), (F.col("doc_id") % 9).cast("string"))
    title = T.safe_filename(F.when(movie, film).otherwise(F.col("summ")), 75, "Untitled")
    nothing = F.lit(None).cast("string")
    content = K.enriched_card(
        label=F.col("label"), creator=F.col("creator"), url=F.col("url"), status=guard["status"], stage=guard["stage"], confidence=F.col("score"),
        tags=G.criteria_tags(F.col("cat"), F.col("label"), F.lit("Open Source"), nothing), title=title, context=F.col("summ"),
        notes=T.notes_section(F.lit("x\n## Actionable Notes\n- mine\n\n"), T.ENRICHED_NOTES, "none"),
    )
    return rows.select("doc_id", title.alias("title"), content.alias("content"))


@query("v5_stock_refresh", """
    SELECT doc_id, folder || ' Hub.md' AS name, 'new text of ' || folder AS new_content FROM cards WHERE doc_id % 3 = 0 AND folder IN (SELECT folder FROM taxonomy)""")
def _(t):
    d = F.col("doc_id")
    body = F.when(d % 3 == 0, F.concat(F.lit("old text of "), "folder")).when(d % 3 == 1, F.concat(F.lit("old text of "), "folder", F.lit("!"))).otherwise("")
    notes = t.cards.select("doc_id", F.concat("folder", F.lit(" Hub.md")).alias("name"), body.alias("content"))
    stock = t.taxonomy.select("folder").distinct().select(
        F.concat("folder", F.lit(" Hub.md")).alias("name"), F.concat(F.lit("old text of "), "folder").alias("previous"), F.concat(F.lit("new text of "), "folder").alias("current")
    )
    return MG.refreshable(notes, stock).select("doc_id", "name", "new_content")


@query("v6_tag_dedupe", f"""
    WITH l AS (SELECT doc_id, category, ['saved-media', 'category/recipes-and-food', list_extract(tags, 3), 'category/' || {Q.slug('category')},
      {Q.category_tag('category')}, list_extract(tags, 3)] AS l FROM cards)
    SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS tags,
      CASE WHEN category = 'Music' THEN 'Saved Music' ELSE category END AS category FROM l""")
def _(t):
    """The tags of each card, with its category spelt as it stands and as a tag, and one of its tags repeated."""
    raw = F.concat(F.lit("category/"), F.col("category"))
    tags = F.concat("tags", F.array(raw, G.category_tag(F.col("category")), F.get("tags", F.lit(2))))
    return t.cards.select("doc_id", joined(G.rewrite_tags(tags, _LEGACY)).alias("tags"), G.canonical_category(F.col("category")).alias("category"))


# --- folder reads ----------------------------------------------------------------------------------------

_LIVE = f"status IS DISTINCT FROM 'tossed' AND NOT {Q.is_board('name')}"
_COLS = ["doc_id", "creator", "status", "stage", "ctime"]
_SEL = "SELECT doc_id, creator, status, stage, ctime FROM cards WHERE "
_WEEK = "ctime >= TIMESTAMP '2024-01-24 00:00:00'"


@query("h1_recent_music", f"{_SEL} {Q.in_folder('folder', 'Music')} AND {_LIVE} AND stage IS DISTINCT FROM 'archived' AND {_WEEK}")
def _(t):
    return CAT.recent_music(t.cards, _AS_OF).select(*_COLS)


@query("h2_fitness", f"{_SEL} {Q.in_folder('folder', 'Fitness & Health')} AND {_LIVE}")
def _(t):
    return CAT.folder_list(t.cards, "Fitness & Health").select(*_COLS)


@query("h3_recipes", f"{_SEL} {Q.in_folder('folder', 'Recipes & Food')} AND {_LIVE}")
def _(t):
    return CAT.folder_list(t.cards, "Recipes & Food").select(*_COLS)


@query("h4_generic_folder", f"{_SEL} {Q.in_folder('folder', 'Study Tips')} AND {_LIVE}")
def _(t):
    return CAT.folder_list(t.cards, "Study Tips").select(*_COLS)


@query("h5_live_stream", f"{_SEL} {Q.in_folder('folder', 'Inbox')} AND {_LIVE} AND status IS DISTINCT FROM 'manual-review' AND stage IS DISTINCT FROM 'manual-review'")
def _(t):
    return CAT.live_stream(t.cards, "Inbox").select(*_COLS)


@query("h6_manual_review", f"{_SEL} {Q.in_folder('folder', 'Inbox')} AND (status = 'manual-review' OR stage = 'manual-review')")
def _(t):
    return CAT.manual_review_list(t.cards, "Inbox").select(*_COLS)


@query("h7_travel_hotspots", f"SELECT doc_id, (doc_id * 7) % 9 AS weight FROM cards WHERE {Q.in_folder('folder', 'Travel')} AND {_LIVE}")
def _(t):
    return CAT.travel_hotspots(t.cards.withColumn("weight", (F.col("doc_id") * 7) % 9)).select("doc_id", "weight")


@query("h8_comedy_table", f"{_SEL} {Q.in_folder('folder', 'Comedy')} AND doc_id % 8 <> 0 AND status IS DISTINCT FROM 'tossed'")
def _(t):
    cards = t.cards.withColumn("url", F.when(F.col("doc_id") % 8 != 0, F.col("url")))
    return CAT.folder_table(cards, "Comedy").select(*_COLS)


@query("h9_inbox_list", f"{_SEL} {Q.in_folder('folder', 'Comedy')} AND status = 'inbox'")
def _(t):
    return CAT.inbox_list(t.cards, "Comedy").select(*_COLS)


@query("h10_legacy_lists", f"""
    SELECT doc_id, 'fitness' AS list FROM cards WHERE {Q.in_folder('folder', 'Fitness & Health')} AND status = 'ready' AND NOT {Q.is_board('name')}
    UNION ALL SELECT doc_id, 'music' FROM cards WHERE {Q.in_folder('folder', 'Music')} AND {_LIVE} AND status IS DISTINCT FROM 'archived' AND {_WEEK}""")
def _(t):
    ready = CAT.legacy_ready_list(t.cards, "Fitness & Health").select("doc_id", F.lit("fitness").alias("list"))
    return ready.unionByName(CAT.legacy_recent_music(t.cards, _AS_OF).select("doc_id", F.lit("music").alias("list")))


@query("h11_map_points", f"""
    SELECT doc_id, doc_id % 100 - 10.5::DOUBLE AS lat, doc_id * 0.25::DOUBLE - 50 AS lon FROM cards WHERE {Q.in_folder('folder', 'Travel')} AND doc_id % 4 <> 3 AND doc_id % 100 - 10.5 <= 90 AND doc_id * 0.25 - 50 <= 180""")
def _(t):
    d = F.col("doc_id")
    lat, lon = (d % 100 - F.lit(10.5)).cast("string"), (d * 0.25 - 50).cast("string")
    location = F.when(d % 4 == 3, "").when(d % 4 == 2, F.concat(lat, F.lit(","), lon)).otherwise(F.concat(F.lit("["), lat, F.lit(", "), lon, F.lit("]")))
    return CAT.map_points(t.cards.withColumn("location", location)).select("doc_id", "lat", "lon")


@query("o3_hub_order", f"""
    WITH l AS (SELECT doc_id, ctime, (doc_id * 7) % 9 AS w FROM cards WHERE {Q.in_folder('folder', 'Travel')} AND {_LIVE})
    SELECT doc_id, row_number() OVER (ORDER BY w DESC, ctime DESC) AS place FROM l""")
def _(t):
    """Position of each travel card in the hotspot order, without a global window."""
    live = CAT.travel_hotspots(t.cards.withColumn("weight", (F.col("doc_id") * 7) % 9))
    # Order key: weight first, then newest; both are whole numbers.
    key = (F.lit(100) - F.col("weight")) * F.lit(10_000_000_000) - F.unix_seconds("ctime")
    return row_numbers(live.withColumn("k", key), [], "k", "place").select("doc_id", "place")
