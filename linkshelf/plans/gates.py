"""Scoring, quality-gate, routing and budget queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkshelf import constants as C
from linkshelf.functions import tags as G
from linkshelf.functions import text as T
from linkshelf.functions.numbers import rounded
from linkshelf.operators import budget as BUD
from linkshelf.operators import catalog as CAT
from linkshelf.operators import extraction as X
from linkshelf.operators import quality as QU
from linkshelf.operators import routing as RT
from linkshelf.operators import scoring as S
from linkshelf.operators.ordered import last_by, packed
from linkshelf.plans import sqltext as Q
from linkshelf.plans.derived import joined, pick
from linkshelf.plans.registry import query
from linkshelf.session import scratch_path

# --- batches ---------------------------------------------------------------------------------

_PACKED = """
    packed AS (SELECT *, r // 100000 AS block, r % 100000 // 100 AS batch, (r % 100)::INTEGER AS i FROM (SELECT *,
      row_number() OVER (ORDER BY doc_id) - 1 AS r FROM video_metadata WHERE url NOT IN (SELECT url FROM cards WHERE status = 'kept')))"""


def to_score(t):
    from linkshelf.operators.registry import without_known

    return without_known(t.video_metadata, t.cards.filter(F.col("status") == "kept"))


def batches(t):
    return packed(to_score(t), "doc_id", C.BATCH_SIZE)


@query("w1_request_batches", f"WITH {_PACKED} SELECT doc_id, block, batch, i FROM packed")
def _(t):
    return batches(t).select("doc_id", "block", "batch", "i")


@query("b1_batch_payload", f"""
    WITH {_PACKED} SELECT block, batch, count(*) AS n_items,
      '[' || string_agg(json_object('i', i, 't', left(title, 70), 'c', left(description, 90))::VARCHAR, ',' ORDER BY i) || ']' AS payload FROM packed GROUP BY block, batch""")
def _(t):
    return S.batch_payloads(batches(t))


@query("b2_scored_batches", f"WITH {_PACKED} SELECT block, batch, count(*) AS n_items, NULL::VARCHAR AS problem, count(*) AS answers FROM packed GROUP BY block, batch")
def _(t):
    scored = S.score_batches(S.batch_payloads(batches(t)), S.rule_scorer(), keep=["block", "batch", "n_items"])
    checked = S.validated(scored)
    return checked.select("block", "batch", "n_items", "problem", F.size("results").cast("bigint").alias("answers"))


# A model that skips some rows, repeats others and answers for rows it was not given.
_ANSWERS = """
    answers AS (SELECT p.block, p.batch, p.i, 0 AS pos, s.cat, 'first ' || p.doc_id AS summ FROM packed p JOIN scores s ON s.doc_id = p.doc_id AND s.pos = 0
      UNION ALL SELECT p.block, p.batch, p.i, 1, s.cat, 'again ' || p.doc_id FROM packed p JOIN scores s ON s.doc_id = p.doc_id AND s.pos = 1
      UNION ALL SELECT DISTINCT block, batch, 1000, 2, 'Travel', 'extra' FROM packed)"""


def responses(t):
    """Batch responses as the model would return them."""
    p = batches(t)
    rows = p.join(t.scores, "doc_id").select(
        "block", "batch", "i", "pos", F.col("cat"),
        F.concat(pick(["first ", "again "], F.col("pos")), F.col("doc_id").cast("string")).alias("summ"),
    )
    extra = p.select("block", "batch").distinct().select(
        "block", "batch", F.lit(1000).alias("i"), F.lit(2).alias("pos"), F.lit("Travel").alias("cat"), F.lit("extra").alias("summ")
    )
    answer = F.struct("pos", "i", "cat", "summ")
    per_batch = rows.unionByName(extra).groupBy("block", "batch").agg(F.array_sort(F.collect_list(answer)).alias("a"))
    results = F.transform("a", lambda x: F.struct(x["i"].alias("i"), x["cat"].alias("cat"), x["summ"].alias("summ")))
    return per_batch.select("block", "batch", F.to_json(F.struct(results.alias("results"))).alias("response"))


@query("j4_response_reconcile", f"""
    WITH {_PACKED}, {_ANSWERS}, best AS (SELECT block, batch, i, max_by(cat, pos) AS cat, max_by(summ, pos) AS summ FROM answers GROUP BY block, batch, i)
    SELECT p.doc_id, coalesce(b.cat, 'Miscellaneous') AS category, coalesce(b.summ, 'No summary') AS summary, array_to_string(p.tags, ', ') AS tags
    FROM packed p LEFT JOIN best b ON b.block = p.block AND b.batch = p.batch AND b.i = p.i""")
def _(t):
    answered = S.answers(S.validated(responses(t)))
    return S.reconciled(batches(t), answered).select("doc_id", "category", "summary", F.array_join("tags", ", ").alias("tags"))


_BROKEN = f"""
    WITH {_PACKED}, {_ANSWERS}, r AS (SELECT block, batch, count(*) AS n FROM answers GROUP BY block, batch),
    s AS (SELECT *, CASE (block * 31 + batch) % 5 WHEN 3 THEN 'empty' WHEN 4 THEN 'invalid' END AS problem FROM r)"""


def _broken_responses(t):
    k = (F.col("block") * 31 + F.col("batch")) % 5
    torn = F.when(k == 3, "").when(k == 4, F.left("response", F.expr("length(response) div 2"))).otherwise(F.col("response"))
    return S.validated(responses(t).withColumn("response", torn))


@query("b3_response_validation", _BROKEN + " SELECT block, batch, problem, CASE WHEN problem IS NULL THEN n END AS answers FROM s")
def _(t):
    return _broken_responses(t).select("block", "batch", "problem", F.size("results").cast("bigint").alias("answers"))


@query("b3_bounded_confidence", "SELECT event_id, coalesce(CASE WHEN event_id % 9 = 0 THEN NULL ELSE value / 20 END BETWEEN 0 AND 1, FALSE) AS valid FROM events")
def _(t):
    value = F.when(F.col("event_id") % 9 != 0, F.col("value") / 20)
    return t.read("events").select("event_id", S.bounded_confidence(value).alias("valid"))


@query("b4_stop_on_failure", _BROKEN + """, f AS (SELECT min({'block': block, 'batch': batch}) AS first FROM s WHERE problem IS NOT NULL)
    SELECT block, batch, coalesce({'block': block, 'batch': batch} < (SELECT first FROM f), TRUE) AS committed FROM s""")
def _(t):
    rows = _broken_responses(t).select("block", "batch", "problem")
    return S.stop_at_first_failure(rows, F.col("problem").isNotNull()).select("block", "batch", "committed")


def _two_stage(t):
    rows = _gate_rows(t)
    first = rows.withColumn("reasons", _reasons(rows, F.lit(False), F.lit(None).cast("double")))
    asked = first.filter(F.size("reasons") == 0).select("doc_id", F.concat("title", F.lit(" "), "description").alias("state"))

    def probability(state):
        return str(round((len(state) % 100) / 100, 2))

    scored = S.score_batches(asked, probability, "state", keep=["doc_id"])
    return scored.select("doc_id", F.col("response").try_cast("double").alias("needs_visuals"))


@query("b6_extraction", f"""
    WITH p AS (SELECT doc_id, length(description) AS n, CASE WHEN length(description) % 17 = 0 THEN 'error' WHEN length(description) % 19 = 0 THEN 'invalid' END AS problem,
      trim(split_part({Q.squeeze('description')}, ' ', -1), '.,') AS place FROM video_metadata)
    SELECT doc_id, CASE WHEN problem IS NULL THEN n % 3 = 0 END AS is_travel, CASE WHEN problem IS NULL THEN place END AS place_name,
      CASE WHEN problem IS NULL THEN 0.6::DOUBLE END AS confidence, problem FROM p""")
def _(t):
    import json

    def extract(payload):
        if len(payload) % 17 == 0:
            raise ValueError("no answer")
        place = payload.split()[-1].strip(".,")
        return json.dumps({"is_travel": len(payload) % 3 == 0, "place_name": place, "summary": payload, "confidence": 6 if len(payload) % 19 == 0 else 0.6})

    scored = S.score_batches(t.video_metadata.select("doc_id", F.col("description").alias("payload")), extract, keep=["doc_id"])
    rows = S.extraction_records(scored, "is_travel boolean, place_name string, country string, summary string, confidence double")
    return rows.select("doc_id", "r.is_travel", "r.place_name", "r.confidence", "problem")


@query("b4_waves", f"""
    WITH {_PACKED}, n AS (SELECT block, batch, sum(length(left(title, 70))) AS letters FROM packed GROUP BY block, batch),
    o AS (SELECT *, row_number() OVER (ORDER BY block, batch) AS nr, letters % 5 = 3 AS bad FROM n),
    f AS (SELECT min(nr) AS first FROM o WHERE bad),
    ends AS (SELECT min(e) AS last FROM (SELECT unnest([2, 6, 14, 30, 62, 126, 254, 510, 1022, 2046, 4094, 8190]) AS e) WHERE e >= (SELECT first FROM f))
    SELECT block, batch, bad AS failed, coalesce(nr < (SELECT first FROM f), TRUE) AS committed FROM o WHERE nr <= coalesce((SELECT last FROM ends), nr)""")
def _(t):
    """Batches that were asked: up to the end of the wave (of 2, 4, 8 ...) that holds the first failing one."""
    import json

    ruled = S.rule_scorer()

    def scorer(payload):
        if sum(len(item["t"]) for item in json.loads(payload)) % 5 == 3:
            raise RuntimeError("quota")
        return ruled(payload)

    asked = S.scored_in_waves(S.batch_payloads(batches(t)), scorer, scratch_path(t.spark, "paid"), first=2, growth=2)
    return S.stop_at_first_failure(asked, F.col("error").isNotNull()).select("block", "batch", F.col("error").isNotNull().alias("failed"), "committed")


@query("b6_typed_records", f"""
    WITH packed AS (SELECT *, r // 100000 AS block, r % 100000 // 10 AS batch, ['travel', 'actionable', 'enrichment'][doc_id % 3 + 1] AS kind, length(coalesce(description, '')) AS n
      FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM video_metadata)),
    b AS (SELECT block, batch, sum(n) % 7 AS rest FROM packed GROUP BY block, batch),
    s AS (SELECT p.*, CASE WHEN rest = 3 THEN 'error' WHEN rest = 4 THEN 'unreadable' WHEN n % 11 = 0 THEN 'skipped' WHEN n % 13 = 0 THEN 'kind'
      WHEN (n % 17 = 0 AND kind <> 'enrichment') OR n % 23 = 0 THEN 'invalid' END AS problem FROM packed p JOIN b USING (block, batch))
    SELECT doc_id, kind, problem, problem IS NOT NULL OR (kind <> 'travel' AND n % 19 = 0) AS manual,
      CASE WHEN problem IS NULL AND kind = 'travel' THEN 'place ' || n END AS place_name,
      CASE WHEN problem IS NULL AND kind = 'actionable' THEN n % 4 END AS n_actions,
      CASE WHEN problem IS NULL AND kind = 'enrichment' THEN 'tool ' || n END AS tech_tool FROM s""")
def _(t):
    """One call for ten items, three kinds of record in one answer; torn answers and items at fixed places."""
    import json

    def answer(payload):
        items = json.loads(payload)
        sizes = [len(item["description"]) for item in items]
        if sum(sizes) % 7 == 3:
            raise RuntimeError("no answer")
        if sum(sizes) % 7 == 4:
            return '{"items": ['
        out = []
        for item, n in zip(items, sizes):
            own = {
                "travel": {"is_travel_related": True, "place_name": f"place {n}"},
                "actionable": {"actionable_items": ["step"] * (n % 4), "needs_manual_review": n % 19 == 0},
                "enrichment": {"category": "Tech & Coding", "tech_tool": f"tool {n}", "needs_manual_review": n % 19 == 0},
            }[item["kind"]]
            kind = "other" if n % 13 == 0 else item["kind"]
            common = {"item_id": item["item_id"], "kind": kind, "confidence": 6 if n % 17 == 0 else 0.5}
            if n % 11:
                out.append({**common, **own, **({} if n % 23 == 0 else {"summary": "short"})})
        return json.dumps({"items": out})

    rows = packed(t.video_metadata.withColumn("kind", pick(["travel", "actionable", "enrichment"], F.col("doc_id") % 3)), "doc_id", 10)
    records = X.typed_records(rows, S.score_batches(X.typed_payloads(rows), answer, keep=["block", "batch"]))
    return records.select("doc_id", "kind", "problem", "manual", "travel.place_name", F.size("actionable.actionable_items").alias("n_actions"), "enrichment.tech_tool")


@query("j5_enrichment_match", """
    WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM cards),
    b AS (SELECT doc_id, r // 100000 AS block, r % 100000 // 10 AS batch, (r % 10)::VARCHAR AS item_id FROM n)
    SELECT b.doc_id, b.block, b.batch, b.item_id, s.cat, s.doc_id IS NULL AS skipped FROM b LEFT JOIN best_scores s ON s.doc_id = b.doc_id""")
def _(t):
    rows = S.enrichment_batches(t.cards.select("doc_id"), "doc_id")
    # The model answers by batch and place; cards without a score got no answer.
    answered = rows.join(t.best_scores, "doc_id").select("block", "batch", "item_id", "cat")
    return S.matched_enrichment(rows, answered).select("doc_id", "block", "batch", "item_id", "cat", "skipped")


@query("j6_snapshot_enrichment", """
    SELECT doc_id, doc_id % 3 = 0 AS from_snapshot, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN title = '' THEN 'Unknown Title' ELSE title END
        WHEN doc_id % 3 = 1 THEN 'H ' || doc_id ELSE 'Unknown Title' END AS title,
      CASE WHEN doc_id % 3 = 0 THEN description WHEN doc_id % 3 = 1 THEN 'ctx' ELSE '' END AS description FROM video_metadata""")
def _(t):
    k = F.col("doc_id") % 3
    body = F.when(k == 1, F.concat(F.lit("\n# H "), F.col("doc_id").cast("string"), F.lit("\n\n> **Context:** ctx\n"))).otherwise("plain")
    cards = t.video_metadata.select("doc_id", "url", body.alias("body"))
    snapshot = t.video_metadata.filter(k == 0).select("url", "title", "description", "tags")
    return S.enrichment_source(cards, snapshot).select("doc_id", "from_snapshot", "title", "description")


@query("j7_taxonomy_lookup", """
    SELECT s.doc_id, s.pos, s.cat, coalesce(t.folder, 'Inbox') AS folder FROM scores s LEFT JOIN taxonomy t ON t.category = s.cat""")
def _(t):
    return CAT.with_folders(t.scores, t.taxonomy).select("doc_id", "pos", "cat", "folder")


# --- visual gate ------------------------------------------------------------------------------


def _gate_rows(t):
    d = F.col("doc_id")
    rows = t.video_metadata.join(t.best_scores, "doc_id", "left")
    return rows.select(
        "doc_id", "title", "description", "is_carousel", "needs_visuals",
        T.word_count(F.when(d % 4 == 0, F.col("source")).when(d % 4 == 1, F.repeat(F.concat("source", F.lit(" ")), F.lit(80))).otherwise(F.col("text"))).alias("words"),
        F.when(d % 5 != 0, (d % 20) / 20.0).alias("ratio"), pick(["captions", "whisper", "none"], d % 3).alias("source"),
        (d % 6).alias("expected"), (d % 4).alias("found"), (d % 8 == 3).alias("self_flag"),
    )


def _reasons(rows, analyzed, probability):
    return QU.visual_reasons(
        carousel=F.col("is_carousel"), words=F.col("words"), speech_ratio=F.col("ratio"),
        retry_hint=F.when(F.col("doc_id") % 9 == 4, "gap"), has_analysis=analyzed, expected=F.col("expected"), items=F.col("found"),
        self_flag=F.col("self_flag"), title=F.col("title"), caption=F.col("description"), source=F.col("source"), probability=probability,
    )


_GATE = f"""
    g AS (SELECT v.doc_id, v.title, v.description, v.is_carousel, s.needs_visuals,
      {Q.words("CASE v.doc_id % 4 WHEN 0 THEN v.source WHEN 1 THEN repeat(v.source || ' ', 80) ELSE v.text END")} AS words,
      CASE WHEN v.doc_id % 5 <> 0 THEN (v.doc_id % 20) / 20.0::DOUBLE END AS ratio, ['captions', 'whisper', 'none'][v.doc_id % 3 + 1] AS source,
      v.doc_id % 6 AS expected, v.doc_id % 4 AS found, v.doc_id % 8 = 3 AS self_flag, v.doc_id % 2 = 1 AS analyzed
      FROM video_metadata v LEFT JOIN best_scores s ON s.doc_id = v.doc_id)"""


@query("d1_visual_gate", f"""
    WITH {_GATE}, r AS (SELECT doc_id, list_filter([
      CASE WHEN is_carousel THEN 'carousel/photo post' END, CASE WHEN words < 25 THEN 'transcript ' || words || ' words < 25' END,
      CASE WHEN ratio < 0.2 THEN 'speech ratio ' || format('{{:.2f}}', ratio) || ' < 0.2' END, CASE WHEN doc_id % 9 = 4 THEN 'completeness retry: gap' END,
      CASE WHEN analyzed AND expected > 0 AND found < expected THEN 'list claims ' || expected || ' items, text found ' || found END,
      CASE WHEN analyzed AND self_flag THEN 'summarizer flagged on-screen-only content' END,
      CASE WHEN NOT analyzed AND {Q.list_claim("title || ' ' || description")} AND source <> 'captions' AND words < 120 THEN 'list claim with little speech' END,
      CASE WHEN needs_visuals >= 0.5 THEN 'jev needs_visuals=' || format('{{:.2f}}', needs_visuals) END], lambda x: x IS NOT NULL) AS reasons FROM g)
    SELECT doc_id, array_to_string(reasons, '; ') AS reasons, len(reasons) > 0 AS needs_visuals FROM r""")
def _(t):
    rows = _gate_rows(t)
    reasons = _reasons(rows, F.col("doc_id") % 2 == 1, F.col("needs_visuals"))
    return rows.withColumn("r", reasons).select("doc_id", joined(F.col("r"), "; ").alias("reasons"), (F.size("r") > 0).alias("needs_visuals"))


query("b5_two_stage", f"""
    WITH {_GATE} SELECT doc_id, (length(title || ' ' || description) % 100) / 100.0::DOUBLE AS needs_visuals FROM g
    WHERE NOT is_carousel AND words >= 25 AND NOT coalesce(ratio < 0.2, FALSE) AND doc_id % 9 <> 4
      AND NOT ({Q.list_claim("title || ' ' || description")} AND source <> 'captions' AND words < 120)""")(_two_stage)


@query("d2_audio_needed", f"WITH {_GATE} SELECT doc_id, words < 25 AND NOT is_carousel AND NOT (doc_id % 7 = 0) AS audio FROM g")
def _(t):
    return _gate_rows(t).select("doc_id", QU.audio_needed(F.col("words"), F.col("is_carousel"), F.col("doc_id") % 7 == 0).alias("audio"))


@query("d3_tier", f"""
    WITH {_GATE} SELECT doc_id, CASE WHEN needs_visuals >= 0.5 THEN 3 WHEN words < 25 AND NOT is_carousel THEN 2 WHEN doc_id % 10 <> 0 THEN 1 ELSE 0 END AS tier FROM g""")
def _(t):
    tier = QU.tier_reached(
        captions_tried=F.col("doc_id") % 10 != 0, audio_tried=(F.col("words") < 25) & ~F.col("is_carousel"),
        visuals_tried=F.coalesce(F.col("needs_visuals") >= 0.5, F.lit(False)),
    )
    return _gate_rows(t).select("doc_id", tier.alias("tier"))


# --- completeness -------------------------------------------------------------------------------

_SPANS = """
    spots AS (SELECT DISTINCT video, position AS p FROM items),
    spans AS (SELECT video, min(p) AS lo, max(p) AS hi, count(*) AS n, list(p) AS ps FROM spots GROUP BY video),
    gaps AS (SELECT video, lo, hi, n, list_slice(list_filter(range(lo, hi + 1), lambda x: NOT list_contains(ps, x)), 1, 10) AS missing FROM spans),
    counts AS (SELECT video, count(*) AS actual FROM items GROUP BY video)"""


@query("a8_position_gaps", f"""
    WITH {_SPANS} SELECT video, n AS distinct_positions, lo AS first_position, hi AS last_position, array_to_string(missing, ', ') AS missing FROM gaps""")
def _(t):
    rows = QU.position_gaps(t.items, "video", "position")
    return rows.withColumn("missing", joined(F.col("missing"), ", ")).drop("rows")


def _item_lists(t):
    """Per video: item count, gaps and the four sources of an expected count."""
    v = F.col("video")
    rows = QU.position_gaps(t.items, "video", "position").withColumnRenamed("rows", "actual")
    return rows.select(
        "video", "actual", "missing", (F.col("actual") + v % 3 - 1).alias("claimed"), (v % 50).alias("slides"),
        pick(C.MEDIA_SHAPES, v % 9).alias("shape"), F.when(v % 11 == 0, 6).otherwise(0).cast("bigint").alias("images"),
        (v % 4).alias("slides_seen"),
    )


_LISTS = _SPANS + f""",
    lists AS (SELECT c.video, c.actual, g.missing, c.actual + c.video % 3 - 1 AS claimed, c.video % 50 AS slides, {Q.list_of(C.MEDIA_SHAPES)}[c.video % 9 + 1] AS shape,
      CASE WHEN c.video % 11 = 0 THEN 6 ELSE 0 END AS images, c.video % 4 AS slides_seen FROM counts c JOIN gaps g ON g.video = c.video),
    expected AS (SELECT *, greatest(CASE WHEN claimed > 0 THEN claimed END, CASE WHEN slides > 0 AND slides <= 35 AND shape IN {Q.in_list(C.SLIDESHOW_SHAPES)} THEN slides END,
      CASE WHEN images > 0 THEN images END, CASE WHEN slides_seen > 0 AND slides_seen > actual THEN slides_seen END) AS expected FROM lists)"""


def _expected():
    return QU.expected_count(*[F.col(c) for c in ("claimed", "slides", "shape", "images", "slides_seen", "actual")])


@query("a9_expected_count", f"WITH {_LISTS} SELECT video, actual, expected FROM expected")
def _(t):
    return _item_lists(t).select("video", "actual", _expected().alias("expected"))


@query("d4_completeness", f"""
    WITH {_LISTS} SELECT video, NOT (coalesce(actual < expected, FALSE) OR len(missing) > 0) AS complete,
      CASE WHEN len(missing) > 0 THEN 'Missing list positions: [' || array_to_string(missing, ', ') || ']'
           WHEN actual < expected THEN 'Expected at least ' || expected || ' items but got ' || actual || '.' END AS hint FROM expected""")
def _(t):
    rows = _item_lists(t).withColumn("expected", _expected())
    complete, hint = QU.completeness(F.col("expected"), F.col("actual"), F.col("missing"))
    return rows.select("video", complete.alias("complete"), hint.alias("hint"))


_TERMINAL = "CASE WHEN seq % 7 = 0 AND attempts >= 3 THEN 'manual-review' WHEN seq % 7 = 0 THEN 'failed-retryable' WHEN seq % 3 <> 0 AND seq % 8 <> 0 THEN 'done' ELSE 'needs-review' END"


def _terminal():
    s = F.col("seq")
    return QU.terminal_status(s % 7 == 0, F.col("attempts"), s % 3 != 0, s % 8 == 0)


@query("d5_terminal_status", f"SELECT seq, {_TERMINAL} AS status FROM analysis_state")
def _(t):
    return t.analysis_state.select("seq", _terminal().alias("status"))


@query("a10_review_rate", f"SELECT prompt_version, count(*) AS items, count(*) FILTER (WHERE s = 'manual-review') AS manual, count(*) FILTER (WHERE s = 'manual-review') / count(*) AS rate FROM (SELECT prompt_version, {_TERMINAL} AS s FROM analysis_state) GROUP BY prompt_version")
def _(t):
    return QU.review_rate(t.analysis_state, ["prompt_version"], _terminal() == "manual-review")


# --- classifier ------------------------------------------------------------------------------------


@query("d6_merge_classifier", f"""
    WITH b AS (SELECT c.doc_id, c.category, s.cat, s.confidence AS conf, s.doc_id IS NOT NULL AS present, coalesce(s.cat IN {Q.in_list(C.CATEGORIES)}, FALSE) AS usable,
        s.cat IS DISTINCT FROM c.category AS differs FROM cards c LEFT JOIN best_scores s ON s.doc_id = c.doc_id)
    SELECT doc_id, CASE WHEN usable AND conf >= 0.7 AND differs THEN cat ELSE category END AS category,
      CASE WHEN usable AND conf >= 0.7 AND differs AND category <> 'Tips' THEN 'Tips|' || category ELSE 'Tips' END AS secondary,
      (usable AND conf >= 0.7 AND differs) OR doc_id % 2 = 0 AS recategorize, usable AND conf < 0.7 AND differs AS flagged,
      CASE WHEN present THEN conf * 5 END AS relevance, CASE WHEN present AND conf >= 0.7 THEN 'slideshow_video' ELSE 'standard_video' END AS media_shape FROM b""")
def _(t):
    rows = t.cards.select("doc_id", "category").join(t.best_scores, "doc_id", "left").select(
        "doc_id", "category", F.array(F.lit("Tips")).alias("secondary"), (F.col("doc_id") % 2 == 0).alias("recategorize"),
        F.lit(None).cast("double").alias("relevance"), F.array().cast("array<string>").alias("content_tags"),
        F.lit("standard_video").alias("media_shape"), F.col("cat").isNotNull().alias("c_present"), F.col("cat").alias("c_category"),
        F.col("confidence").alias("c_confidence"), F.lit("slideshow_video").alias("c_shape"), F.col("confidence").alias("c_shape_confidence"),
        (F.col("confidence") * 5).alias("c_relevance"), F.array(F.lit("music")).alias("c_tags"),
    )
    merged = S.merged_classification(rows)
    return merged.select("doc_id", "category", joined(F.col("secondary")).alias("secondary"), "recategorize", "flagged", "relevance", "media_shape")


@query("d7_answer_parsing", """
    SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN 'Travel' END AS category, CASE WHEN event_id % 3 <> 0 THEN (event_id % 10) / 10.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
      array_to_string(list_filter([CASE WHEN event_id % 4 >= 2 THEN 'music' END, CASE WHEN event_id % 5 >= 3 THEN 'news' END], lambda x: x IS NOT NULL), '|') AS tags,
      CASE WHEN event_id % 2 = 0 THEN (event_id % 6)::DOUBLE END AS relevance FROM events""")
def _(t):
    e = F.col("event_id")
    num = lambda c: F.struct(c.alias("noul"))
    answers = F.struct(
        F.struct(F.when(e % 3 != 0, "Travel").otherwise("").alias("choice"), ((e % 10) / 10.0).alias("confidence")).alias("category"),
        F.when(e % 2 == 0, F.struct((e % 6).alias("score"))).alias("relevance"),
        num((e % 4) / 4.0).alias("tag::music"), num((e % 5) / 5.0).alias("tag::news"),
    )
    r = S.parsed_answers(F.to_json(answers))
    rows = t.read("events").select("event_id", r.alias("r"))
    return rows.select("event_id", "r.category", F.col("r.category_confidence").alias("confidence"), joined(F.array_sort("r.tags")).alias("tags"), "r.relevance")


# --- routing ----------------------------------------------------------------------------------------

_USABLE = "s.doc_id % 3 <> 0"


@query("d8_stage", f"SELECT s.doc_id, {Q.stage_for('s.cat', '(' + _USABLE + ')')} AS stage FROM best_scores s")
def _(t):
    return t.best_scores.select("doc_id", RT.stage_for(F.col("cat"), F.col("doc_id") % 3 != 0).alias("stage"))


@query("d9_placement", f"""
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Inbox/Manual Review' ELSE {Q.folder('label')} END AS folder, label, {Q.stage_for('cat', '(doc_id % 3 <> 0)')} AS stage
    FROM (SELECT doc_id, cat, CASE WHEN {Q.canonical_category('cat')} IN {Q.in_list(C.CATEGORIES)} THEN {Q.canonical_category('cat')} ELSE 'Miscellaneous' END AS label FROM best_scores)""")
def _(t):
    cols = RT.placement(F.col("cat"), F.col("doc_id") % 3 != 0)
    return t.best_scores.select("doc_id", *[c.alias(n) for n, c in cols.items()])


def _extractions(t):
    """Travel extractions: some without a place, some off topic, some unsure."""
    s = F.col("s_suppkey")
    nations = t.read("nation").join(t.read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    rows = t.read("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(
        s.alias("id"), (s % 5 != 0).alias("is_travel"), F.when(s % 7 != 0, F.concat(F.lit("  "), F.lower("n_name"))).alias("place_name"),
        F.when(s % 3 == 0, F.col("r_name")).alias("country"), ((s % 10) / 10.0).alias("confidence"),
    )


_EXTRACTED = f"""
    x AS (SELECT s_suppkey AS id, s_suppkey % 5 <> 0 AS is_travel, CASE WHEN s_suppkey % 7 <> 0 THEN '  ' || lower(n_name) END AS place_name,
      CASE WHEN s_suppkey % 3 = 0 THEN r_name END AS country, (s_suppkey % 10) / 10.0::DOUBLE AS confidence
      FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
    q AS (SELECT *, CASE WHEN is_travel AND confidence >= 0.5 THEN {Q.place_query('place_name', 'country')} END AS query FROM x),
    g AS (SELECT q.*, z.lat, z.lon FROM q LEFT JOIN (SELECT * FROM gazetteer WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180) z ON lower(z.place) = lower(q.query))"""


@query("j8_geocode", f"WITH {_EXTRACTED} SELECT id, query, lat, lon, lat IS NOT NULL AS geocoded FROM g")
def _(t):
    return RT.geocoded(_extractions(t), t.gazetteer).select("id", "query", "lat", "lon", "geocoded")


@query("d10_travel_route", f"WITH {_EXTRACTED} SELECT id, CASE WHEN NOT is_travel OR confidence < 0.5 THEN 'manual-review' WHEN lat IS NOT NULL THEN 'mapped' ELSE 'unmapped-travel' END AS stage FROM g")
def _(t):
    rows = RT.geocoded(_extractions(t), t.gazetteer)
    return rows.select("id", RT.travel_stage(F.col("is_travel"), F.col("confidence"), F.col("geocoded")).alias("stage"))


_HV = f"{Q.list_of(C.HIGH_VALUE + [C.AMBIGUOUS])}[doc_id % 4 + 1]"


@query("d11_high_value_route", f"""
    WITH h AS (SELECT doc_id, {_HV} AS cat, confidence, doc_id % 9 = 0 OR confidence < 0.65 OR doc_id % 4 = 3 AS manual FROM best_scores)
    SELECT doc_id, CASE WHEN manual THEN 'Inbox/Manual Review' ELSE cat END AS folder, CASE WHEN manual THEN 'Miscellaneous' ELSE cat END AS label,
      CASE WHEN manual THEN 'manual-review' WHEN cat = 'Movies & Shows' AND doc_id % 5 <> 0 THEN 'to-watch' END AS stage FROM h""")
def _(t):
    d = F.col("doc_id")
    cols = RT.high_value_route(pick(C.HIGH_VALUE + [C.AMBIGUOUS], d % 4), F.col("confidence"), d % 9 == 0, d % 5 != 0)
    return t.best_scores.select("doc_id", *[c.alias(n) for n, c in cols.items()])


@query("d14_recategorize", f"""
    WITH r AS (SELECT c.doc_id, c.category, s.cat, c.doc_id % 4 <> 0 AS wanted, c.doc_id % 6 = 0 AS locked, s.confidence FROM cards c JOIN best_scores s ON s.doc_id = c.doc_id),
    n AS (SELECT *, CASE WHEN wanted AND NOT locked THEN CASE WHEN {Q.canonical_category('cat')} IN {Q.in_list(C.CATEGORIES)} THEN {Q.canonical_category('cat')} ELSE 'Miscellaneous' END ELSE category END AS new FROM r)
    SELECT doc_id, new AS new_category, CASE WHEN category <> new THEN category END AS previous_category, format('{{:.2f}}', confidence * 4.125)::DOUBLE AS relevance FROM n""")
def _(t):
    d = F.col("doc_id")
    cols = RT.recategorized(F.col("category"), F.col("cat"), d % 4 != 0, F.when(d % 6 == 0, True))
    rows = t.cards.select("doc_id", "category").join(t.best_scores, "doc_id")
    return rows.select("doc_id", *[c.alias(n) for n, c in cols.items()], rounded(F.col("confidence") * 4.125, 2).alias("relevance"))


@query("d15_music_fields", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'given' ELSE coalesce(creator, CASE WHEN doc_id % 3 = 1 THEN ' ' END) END AS artist FROM video_metadata")
def _(t):
    k = F.col("doc_id") % 3
    extracted = F.when(k == 0, "given").when(k == 1, " ")
    return t.video_metadata.select("doc_id", RT.music_field(extracted, F.col("creator")).alias("artist"))


@query("d16_travel_tiers", f"""
    SELECT doc_id, CASE WHEN length({Q.strip('description')}) < 40 THEN 'frames' ELSE 'text' END || CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN '|audio' ELSE '' END AS tiers FROM video_metadata""")
def _(t):
    d = F.col("doc_id")
    plan = RT.travel_tier_plan(F.col("description"), d % 2 == 0, F.when(d % 3 != 0, "Lisbon"), F.lit(None).cast("string"))
    return t.video_metadata.select("doc_id", joined(plan).alias("tiers"))


@query("d18_human_guard", """
    SELECT doc_id, CASE WHEN lower(status) IN ('kept', 'promoted', 'tossed') THEN status ELSE 'inbox' END AS status,
      CASE WHEN lower(status) IN ('kept', 'promoted', 'tossed') THEN stage ELSE 'ready' END AS stage FROM cards""")
def _(t):
    cols = RT.guarded(F.col("status"), F.col("stage"), F.lit("ready"))
    return t.cards.select("doc_id", *[c.alias(n) for n, c in cols.items()])


@query("d17_escalation", """
    WITH i AS (SELECT doc_id, is_carousel AS car, doc_id % 5 = 0 AS vis, doc_id % 4 AS need FROM video_metadata)
    SELECT doc_id, CASE WHEN need = 0 AND NOT vis THEN 1 WHEN need <= 1 OR (NOT car AND NOT vis) THEN 2 ELSE 3 END AS passes FROM i""")
def _(t):
    d = F.col("doc_id")
    items = t.video_metadata.select(
        "doc_id", F.lit(1).alias("tier"), F.lit(True).alias("visual_ok"), F.col("is_carousel").alias("carousel"), F.lit(False).alias("dense"),
        (d % 4).alias("need"), (d % 5 == 0).alias("wants"),
    )

    def summarize(df, n):
        # The text pass of every fifth item asks for frames; an item is complete from pass need + 1 on.
        return df.withColumns({
            "found": F.lit(n), "complete": F.lit(n) > F.col("need"), "wants_visuals": F.col("wants") & (F.lit(n) == 1),
        })

    return QU.escalation_passes(items, summarize).select("doc_id", "passes")


_DISPATCH = f"""
    WITH l AS (SELECT c.seq, c.line, c.valid, c.url, c.url IN (SELECT url FROM known) AS stored, ['ok', 'ok', 'ok', 'transient', 'permanent'][c.seq % 7 % 5 + 1] AS fetched,
        s.cat, s.confidence, c.seq % 13 <> 0 AS parsed FROM capture_urls c LEFT JOIN best_scores s ON s.doc_id = c.seq),
    h AS (SELECT url, min(seq) AS handled FROM l WHERE valid AND NOT stored AND fetched <> 'transient' GROUP BY url),
    j AS (SELECT l.*, stored OR coalesce(l.seq > h.handled, FALSE) AS known FROM l LEFT JOIN h ON h.url = l.url),
    q AS (SELECT min(seq) AS stop FROM j WHERE valid AND NOT known AND fetched = 'ok' AND {{quota}}),
    k AS (SELECT *, {Q.canonical_category('cat')} AS name, coalesce(seq >= (SELECT stop FROM q), FALSE) AS stopped FROM j),
    o AS (SELECT *, CASE WHEN NOT valid THEN 'kept-invalid' WHEN stopped THEN 'kept-stopped' WHEN coalesce(known, FALSE) THEN 'skipped-known'
      WHEN fetched = 'transient' THEN 'kept-transient' WHEN fetched = 'permanent' THEN 'manual-dead-link'
      WHEN coalesce(cat, '') = '' OR coalesce(confidence, 0) < 0.7 THEN 'manual-low-confidence'
      WHEN NOT parsed AND name IN {Q.in_list(C.ACTIONABLE + [C.TRAVEL])} THEN 'manual-unparseable' WHEN name IN {Q.in_list(C.ACTIONABLE)} THEN 'card-actionable'
      WHEN name = 'Travel' THEN 'card-travel' WHEN name IN {Q.in_list(C.HIGH_VALUE)} THEN 'card-high-value' ELSE 'card-generic' END AS outcome FROM k)"""
_QUOTA_SQL = "seq >= (SELECT max(seq) * 0.6 FROM l) AND seq % 3 = 0"  # the quota ends in the last part of the queue


def _dispatched(t, quota_hit):
    seq = F.col("seq")
    scored = t.best_scores.select(F.col("doc_id").alias("seq"), F.col("cat").alias("category"), "confidence")
    rows = t.capture_urls.join(scored, "seq", "left").join(t.known.select("url", F.lit(True).alias("seen")), "url", "left")
    rows = rows.withColumns({
        "fetch": pick(["ok", "ok", "ok", "transient", "permanent"], seq % 7 % 5), "seen": F.coalesce("seen", F.lit(False)), "parsed": seq % 13 != 0,
    })
    return RT.dispatched(rows, "seq", quota_hit)


def _quota(t):
    last = t.capture_urls.agg((F.max("seq") * 0.6).alias("m")).scalar()
    return (F.col("seq") >= last) & (F.col("seq") % 3 == 0)


@query("d13_dispatch", _DISPATCH.format(quota="FALSE") + " SELECT seq, outcome FROM o")
def _(t):
    return _dispatched(t, F.lit(False)).select("seq", "outcome")


@query("d13_dispatch_stopped", _DISPATCH.format(quota=_QUOTA_SQL) + " SELECT seq, outcome FROM o")
def _(t):
    return _dispatched(t, _quota(t)).select("seq", "outcome")


@query("d13_dispatch_queue", _DISPATCH.format(quota=_QUOTA_SQL) + " SELECT seq, line FROM o WHERE starts_with(outcome, 'kept-')")
def _(t):
    return RT.kept_queue(_dispatched(t, _quota(t))).select("seq", "line")


@query("d13_dispatch_cards", _DISPATCH.format(quota=_QUOTA_SQL) + f""",
    m AS (SELECT url, outcome, CASE WHEN outcome = 'manual-dead-link' THEN 'Miscellaneous' WHEN outcome = 'manual-low-confidence' THEN coalesce(nullif(cat, ''), 'Miscellaneous')
        WHEN outcome = 'manual-unparseable' THEN name WHEN name IN {Q.in_list(C.CATEGORIES)} THEN name ELSE 'Miscellaneous' END AS label
      FROM o WHERE starts_with(outcome, 'card-') OR starts_with(outcome, 'manual-'))
    SELECT url, CASE WHEN starts_with(outcome, 'manual-') THEN {Q.lit(C.MANUAL_REVIEW_FOLDER)} ELSE {Q.folder('label')} END AS folder, label FROM m""")
def _(t):
    return RT.dispatch_cards(_dispatched(t, _quota(t)))


@query("d13_dispatch_ledger", _DISPATCH.format(quota=_QUOTA_SQL) + """
    SELECT url, 'carded' AS event, 'dispatch' AS source FROM o WHERE starts_with(outcome, 'card-') OR starts_with(outcome, 'manual-')""")
def _(t):
    """The run's events, appended to a ledger twice: the replay adds nothing."""
    from linkshelf.sources import writers

    path, schema = scratch_path(t.spark, "dispatch"), "url string, event string, source string"
    events = RT.dispatch_cards(_dispatched(t, _quota(t))).select("url", F.lit("carded").alias("event"), F.lit("dispatch").alias("source"))
    for _ in range(2):
        writers.append_events(events, path, schema)
    return t.spark.read.schema(schema).parquet(path)


# --- state and attempts ------------------------------------------------------------------------------


@query("a2_latest_state", "SELECT url, status, prompt_version, attempts FROM latest_state")
def _(t):
    return t.latest_state


@query("p4_resume", """
    SELECT c.doc_id, coalesce(s.prompt_version = '3' AND s.status IN ('done', 'unavailable', 'needs-review', 'manual-review'), FALSE) AS skip
    FROM cards c LEFT JOIN latest_state s ON s.url = c.url""")
def _(t):
    return CAT.pending_analysis(t.cards.select("doc_id", "url"), t.latest_state, C.PROMPT_VERSION).select("doc_id", "skip")


@query("j13_resume_join", """
    SELECT c.doc_id, s.status AS state_status, s.prompt_version = '3' AND s.status IN ('done', 'unavailable', 'needs-review', 'manual-review') AND s.status IS NOT NULL AS skip,
      CASE WHEN c.doc_id % 3 = 0 THEN 'cached ' || c.doc_id END AS cached FROM cards c JOIN latest_state s ON s.url = c.url
    UNION ALL SELECT c.doc_id, NULL, FALSE, CASE WHEN c.doc_id % 3 = 0 THEN 'cached ' || c.doc_id END FROM cards c WHERE c.url NOT IN (SELECT url FROM latest_state)""")
def _(t):
    cache = t.cards.filter(F.col("doc_id") % 3 == 0).select("url", F.concat(F.lit("cached "), F.col("doc_id").cast("string")).alias("cached"))
    rows = CAT.pending_analysis(t.cards.select("doc_id", "url"), t.latest_state, C.PROMPT_VERSION)
    return rows.join(cache, "url", "left").select("doc_id", "state_status", "skip", "cached")


def attempt_log(t):
    status = F.col("status")
    return QU.attempts_along_log(
        t.analysis_state.withColumnRenamed("attempts", "given"), "url", "seq", status.isin("done", "needs-review"),
        status.isin("failed-retryable", "manual-review"), F.col("given"),
    )


_ATTEMPTS = """
    a AS (SELECT url, seq, status, attempts AS passes, sum(CASE WHEN status IN ('done', 'needs-review') THEN 1 ELSE 0 END) OVER (PARTITION BY url ORDER BY seq) AS grp FROM analysis_state),
    b AS (SELECT *, sum(CASE WHEN status IN ('failed-retryable', 'manual-review') THEN 1 ELSE 0 END) OVER (PARTITION BY url, grp ORDER BY seq) AS fails,
      coalesce(max(CASE WHEN status IN ('done', 'needs-review') THEN passes END) OVER (PARTITION BY url, grp), 0) AS base FROM a)"""


@query("w11_attempts", f"""
    WITH {_ATTEMPTS} SELECT url, seq, (base + fails)::BIGINT AS attempts, CASE WHEN status = 'failed-retryable' AND base + fails >= 3 THEN 'unavailable'
      WHEN status = 'manual-review' AND base + fails < 3 THEN 'failed-retryable' ELSE status END AS status FROM b""")
def _(t):
    rows = attempt_log(t)
    enough = F.col("attempts") >= C.MAX_ATTEMPTS
    status = (
        F.when((F.col("status") == "failed-retryable") & enough, "unavailable")
        .when((F.col("status") == "manual-review") & ~enough, "failed-retryable").otherwise(F.col("status"))
    )
    return rows.select("url", "seq", "attempts", status.alias("status"))


@query("x5_retry_lane", f"""
    WITH {_ATTEMPTS}, z AS (SELECT url, max_by(status, seq) AS status, max_by(base + fails, seq)::BIGINT AS attempts FROM b GROUP BY url)
    SELECT url, attempts FROM z WHERE status = 'failed-retryable' AND attempts < 3""")
def _(t):
    latest = last_by(attempt_log(t), ["url"], "seq", ["status", "attempts"])
    return latest.filter((F.col("status") == "failed-retryable") & (F.col("attempts") < C.MAX_ATTEMPTS)).select("url", "attempts")


@query("a6_run_summary", """
    SELECT prompt_version, count(*) AS scanned, count(*) FILTER (WHERE status IN ('done', 'needs-review')) AS analyzed, count(*) FILTER (WHERE status = 'unavailable') AS unavailable,
      count(*) FILTER (WHERE status = 'failed-retryable') AS retryable, count(*) FILTER (WHERE status = 'needs-review') AS needs_review,
      count(*) FILTER (WHERE status = 'manual-review') AS manual_review, count(*) FILTER (WHERE attempts = 0) AS tier_metadata, count(*) FILTER (WHERE attempts = 3) AS tier_visual,
      sum(attempts)::DOUBLE / nullif(count(*) FILTER (WHERE status IN ('done', 'needs-review')), 0) AS per_item FROM analysis_state GROUP BY prompt_version""")
def _(t):
    return QU.run_summary(t.analysis_state, ["prompt_version"])


@query("p8_duration_guard", "SELECT event_id, coalesce(try_cast(raw AS DOUBLE), 0.0) AS seconds, coalesce(try_cast(raw AS DOUBLE), 0.0) > 180 AS rejected FROM (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'n/a' ELSE (value * 20)::VARCHAR END AS raw FROM events)")
def _(t):
    raw = F.when(F.col("event_id") % 6 == 0, "n/a").otherwise((F.col("value") * 20).cast("string"))
    return t.read("events").select("event_id", *[c.alias(n) for n, c in QU.duration_seconds(raw).items()])


# --- budget ---------------------------------------------------------------------------------------------

_DAY = "timezone('America/Los_Angeles', timezone('UTC', ts))::DATE"


@query("a4_requests_per_day", f"SELECT key, {_DAY} AS quota_day, count(*) AS requests, count(*) >= 500 AS exhausted FROM request_log GROUP BY ALL")
def _(t):
    return BUD.requests_per_day(t.request_log, 500)


@query("x6_quota_day", f"SELECT {_DAY} AS quota_day, provider, count(*) AS requests, sum(in_tokens)::BIGINT AS tokens FROM request_log GROUP BY ALL")
def _(t):
    rows = t.request_log.groupBy(BUD.quota_day(F.col("ts")).alias("quota_day"), "provider")
    return rows.agg(F.count(F.lit(1)).alias("requests"), F.sum("in_tokens").alias("tokens"))


@query("a5_cost_totals", """
    SELECT key AS run, provider, count(*) AS calls, sum(in_tokens)::BIGINT AS in_tokens, sum(out_tokens)::BIGINT AS out_tokens,
      CASE WHEN provider = 'llm' THEN (sum(in_tokens)::DOUBLE * 0.3::DOUBLE + sum(out_tokens)::DOUBLE * 2.5::DOUBLE) / 1000000 ELSE sum(in_tokens)::DOUBLE * 0.042::DOUBLE / 1000000 END AS usd FROM request_log GROUP BY key, provider""")
def _(t):
    return BUD.cost_totals(t.request_log.withColumnRenamed("key", "run"), ["run"], 0.3, 2.5)


@query("a5_lifetime_cost", """
    SELECT provider, count(*) AS calls, sum(in_tokens)::BIGINT AS in_tokens, sum(out_tokens)::BIGINT AS out_tokens,
      CASE WHEN provider = 'llm' THEN 0.0::DOUBLE ELSE sum(in_tokens)::DOUBLE * 0.042::DOUBLE / 1000000 END AS usd FROM request_log GROUP BY provider""")
def _(t):
    return BUD.cost_totals(t.request_log, [], None, 2.5)


@query("w2_minute_load", """
    WITH l AS (SELECT key, ts, count(*) OVER w AS requests, sum(in_tokens) OVER w AS tokens FROM request_log
      WINDOW w AS (PARTITION BY key ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW))
    SELECT DISTINCT key, ts, requests, tokens::BIGINT AS tokens, requests > 5 OR tokens > 8000 AS over_limit FROM l""")
def _(t):
    return BUD.minute_load(t.request_log, 5, 8000)


@query("w3_spend_cut", """
    WITH w AS (SELECT seq, seq % 4 = 0 AS cached, in_tokens + 100 AS est_tokens, in_tokens, out_tokens FROM request_log),
    r AS (SELECT *, sum(CASE WHEN cached THEN 0 ELSE in_tokens END) OVER o - CASE WHEN cached THEN 0 ELSE in_tokens END AS bi,
        sum(CASE WHEN cached THEN 0 ELSE out_tokens END) OVER o - CASE WHEN cached THEN 0 ELSE out_tokens END AS bo FROM w WINDOW o AS (ORDER BY seq)),
    p AS (SELECT *, (bi::DOUBLE * 0.3::DOUBLE + bo::DOUBLE * 2.5::DOUBLE) / 1000000 AS spent, (est_tokens::DOUBLE * 0.3::DOUBLE + 900 * 2.5::DOUBLE) / 1000000 AS proj FROM r),
    x AS (SELECT *, NOT cached AND (spent + proj > 3.0 OR spent + 1.0 + proj > 3.5) AS crosses FROM p)
    SELECT seq, spent AS spent_before_usd, proj AS projected_usd, crosses, cached OR sum(crosses::INT) OVER (ORDER BY seq) = 0 AS runs FROM x""")
def _(t):
    work = t.request_log.select("seq", (F.col("seq") % 4 == 0).alias("cached"), (F.col("in_tokens") + 100).alias("est_tokens"), "in_tokens", "out_tokens")
    rows = BUD.spend_cut(work, "seq", 0.3, 2.5, run_cap=3.0, total_cap=3.5, spent_before=1.0)
    return rows.select("seq", "spent_before_usd", "projected_usd", "crosses", "runs")


@query("w4_key_allocation", """
    WITH u AS (SELECT key, count(*) AS requests FROM request_log GROUP BY key), c AS (SELECT key, CASE WHEN key = 'K1' THEN 0 ELSE greatest(0, 2600 - requests) END AS room FROM u),
    k AS (SELECT *, sum(room) OVER (ORDER BY key) AS hi FROM c), n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents)
    SELECT n.doc_id, n.n, k.key FROM n LEFT JOIN k ON n.n >= k.hi - k.room AND n.n < k.hi""")
def _(t):
    usage = t.request_log.groupBy("key").agg(F.count(F.lit(1)).alias("requests")).withColumn("exhausted", F.col("key") == "K1")
    return BUD.allocated(t.documents.select("doc_id"), "doc_id", BUD.key_capacity(usage, 2600, 0))


@query("w13_start_gaps", """
    WITH g AS (SELECT event_id AS seq, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (ORDER BY event_id) AS p FROM events)
    SELECT seq, (us - p)::DOUBLE / 1000000 AS gap_seconds, coalesce((us - p)::DOUBLE / 1000000 < 60, FALSE) AS too_soon FROM g""")
def _(t):
    rows = BUD.start_gaps(t.read("events").select(F.col("event_id").alias("seq"), "ts"), "seq", 60.0)
    return rows.select("seq", "gap_seconds", "too_soon")
