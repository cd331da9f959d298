"""Re-analysis of stored cards: what it appends, stores, reports and rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkshelf import constants as C
from linkshelf.functions.urls import url_hash
from linkshelf.operators import catalog as CAT
from linkshelf.operators import scoring as S
from linkshelf.plans import reanalysis as RE
from linkshelf.plans import sqltext as Q
from linkshelf.plans.derived import pick
from linkshelf.plans.registry import query
from linkshelf.session import scratch_path
from linkshelf.sources import writers

_KNOWN = C.CATEGORIES[:4]
_REANALYSED = f"""
    WITH s AS (SELECT c.doc_id AS seq, c.url, l.status AS before, coalesce(l.attempts, 0) AS a0, v.is_carousel AS car,
        coalesce(l.prompt_version = '3' AND l.status IN {Q.in_list(C.TERMINAL_ANALYSIS)}, FALSE) AS skip,
        CASE c.doc_id % 10 WHEN 3 THEN 'permanent' WHEN 7 THEN 'transient' ELSE 'ok' END AS got, c.doc_id % 17 = 5 AS err,
        c.doc_id % 5 = 0 AS vis, c.doc_id % 9 = 0 AS blind, c.doc_id % 4 AS need,
        {Q.list_of(_KNOWN)}[c.doc_id % 3 + 1] AS cat, {Q.list_of(_KNOWN)}[c.doc_id % 4 + 1] AS c_cat, c.doc_id % 7 < 3 AS sure, c.doc_id % 2 = 0 AS judged
      FROM cards c JOIN video_metadata v ON v.doc_id = c.doc_id LEFT JOIN latest_state l ON l.url = c.url),
    w AS (SELECT *, CASE WHEN err OR (need = 0 AND (NOT vis OR blind)) THEN 1 WHEN need <= 1 OR (NOT car AND (NOT vis OR blind)) THEN 2 ELSE 3 END AS passes FROM s),
    n AS (SELECT seq, unnest(range(1, passes + 1)) AS n FROM w WHERE NOT skip AND got = 'ok'),
    t AS (SELECT seq, n, 100 + seq % 50 + 10 * n AS tin, 20 + n AS tout FROM n),
    b AS (SELECT *, coalesce(sum(tin + tout) OVER (ORDER BY seq, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM t),
    q AS (SELECT min(seq) AS stop FROM b WHERE spent + tin + 900 > (SELECT sum(tin + tout) // 2 FROM t)),
    o AS (SELECT *, judged AND NOT sure AND c_cat <> cat AS flagged, CASE WHEN judged AND sure THEN c_cat ELSE cat END AS category, (vis AND blind) AS unseen,
        CASE WHEN skip THEN 'skipped' WHEN coalesce(seq >= (SELECT stop FROM q), FALSE) THEN 'left' WHEN err OR got <> 'ok' THEN 'failed' ELSE 'analysed' END AS outcome FROM w),
    r AS (SELECT *, CASE WHEN got = 'permanent' THEN a0 WHEN got = 'transient' OR err THEN a0 + 1 ELSE passes END AS attempts FROM o),
    f AS (SELECT *, CASE WHEN got = 'permanent' THEN 'unavailable' WHEN got = 'transient' THEN CASE WHEN attempts < 3 THEN 'failed-retryable' ELSE 'unavailable' END
        WHEN err THEN CASE WHEN attempts >= 3 THEN 'manual-review' ELSE 'failed-retryable' END
        WHEN passes > need AND NOT unseen AND NOT flagged THEN 'done' ELSE 'needs-review' END AS status FROM r)"""


def _passes(d):
    vis = (d % 5 == 0) & (d % 9 != 0)
    return F.when((d % 4 == 0) & ~vis, 1).when((d % 4 <= 1) | (~F.col("carousel") & ~vis), 2).otherwise(3)


def _reanalysed(t):
    """Cards of the library, asked again under a cap that half of the calls reach."""
    d = F.col("seq")
    rows = CAT.pending_analysis(t.cards.select("doc_id", "url"), t.latest_state.select("url", "status", "prompt_version"), C.PROMPT_VERSION)
    before = t.latest_state.select("url", F.col("attempts").alias("attempts_before"))
    work = rows.join(before, "url", "left").join(t.video_metadata.select("doc_id", "is_carousel"), "doc_id").withColumnRenamed("doc_id", "seq").select(
        "seq", "url", F.concat("seq", F.lit(".md")).alias("name"), "skip", F.coalesce("attempts_before", F.lit(0)).alias("attempts_before"),
        F.when(d % 10 == 3, "permanent").when(d % 10 == 7, "transient").otherwise("ok").alias("fetch"), F.lit("gone").alias("fetch_error"),
        F.lit(1).alias("tier"), (d % 9 != 0).alias("visual_ok"), F.col("is_carousel").alias("carousel"))

    def summarize(df, n):
        tokens = 100 + d % 50 + 10 * n
        return df.withColumns({
            "error": F.when(d % 17 == 5, "quota"), "complete": F.lit(n) > d % 4, "wants_visuals": (d % 5 == 0) & (F.lit(n) == 1), "found": F.lit(n),
            "est_tokens": tokens, "in_tokens": tokens, "out_tokens": F.lit(20 + n), "category": pick(_KNOWN, d % 3), "confidence": F.lit(0.5),
            "media_shape": F.lit(C.MEDIA_SHAPES[0])})

    def merge(df):
        none = F.array().cast("array<string>")
        return S.merged_classification(df.withColumns({
            "c_present": d % 2 == 0, "c_category": pick(_KNOWN, d % 4), "c_confidence": F.when(d % 7 < 3, 1.0).otherwise(0.0), "c_shape": F.lit(None).cast("string"),
            "c_shape_confidence": F.lit(0.0), "c_relevance": F.lit(1.0), "c_tags": none, "secondary": none, "recategorize": F.lit(False), "relevance": F.lit(0.0),
            "content_tags": none}))

    passes = F.when(d % 17 == 5, 1).otherwise(_passes(d))
    asked = work.filter(~F.col("skip") & (F.col("fetch") == "ok"))
    spent = asked.select(F.explode(F.sequence(F.lit(1), passes)).alias("n"), "seq").agg(F.sum(120 + d % 50 + 11 * F.col("n"))).first()[0] or 0
    return RE.reanalysed(work, summarize, merge, price_in=1.0, price_out=1.0, run_cap=(spent // 2 + 0.5) / 1_000_000)


@query("reanalysis_states", _REANALYSED + """
    SELECT url, status, attempts::BIGINT AS attempts, CASE WHEN got <> 'ok' THEN 'gone' WHEN err THEN 'quota' END AS last_error FROM f WHERE outcome IN ('analysed', 'failed')""")
def _(t):
    return RE.states(_reanalysed(t)).select("url", "status", F.col("attempts").cast("bigint").alias("attempts"), "last_error")


@query("reanalysis_cache", _REANALYSED + """
    SELECT url, category, passes::BIGINT AS passes FROM f WHERE outcome = 'analysed'""")
def _(t):
    """What the run stored, read back from a cache that was written twice."""
    path = scratch_path(t.spark, "cache")
    out = _reanalysed(t)
    for run in (1, 2):
        writers.cache_rows(RE.payloads(out, run), "analysis").write.mode("append").parquet(path)
    stored = writers.latest_cache(t.spark.read.parquet(path)).withColumn("p", F.from_json("payload", "category string, passes bigint"))
    return out.select("url", url_hash(F.col("url")).alias("url_hash")).join(stored, "url_hash").select("url", "p.category", "p.passes")


@query("reanalysis_report", _REANALYSED + f"""
    SELECT seq, CASE WHEN status = 'unavailable' AND got = 'transient' THEN '- UNAVAILABLE after ' || attempts || ' tries `' || url || '`: gone' WHEN status = 'unavailable' THEN '- UNAVAILABLE `' || url || '`: gone'
      WHEN status = 'failed-retryable' THEN '- RETRY LATER `' || url || '` (attempt ' || attempts || '): ' || CASE WHEN got <> 'ok' THEN 'gone' ELSE 'quota' END
      WHEN status = 'manual-review' THEN '- MANUAL REVIEW `' || seq || '.md` `' || url || '`: quota'
      ELSE '- ' || seq || '.md: **' || category || '** ({C.MEDIA_SHAPES[0]}) conf=0.5 items=' || passes || ' tier=' || CASE WHEN vis AND NOT blind THEN 'visual' ELSE 'captions' END ||
        ' transcript=captions classifier=rules' || CASE WHEN status = 'needs-review' THEN ' REVIEW' ELSE '' END END AS line FROM f WHERE outcome IN ('analysed', 'failed')""")
def _(t):
    rows = _reanalysed(t).filter(F.col("outcome").isin("analysed", "failed")).withColumns({
        "shape": F.col("media_shape"), "items": F.col("found"), "tier": F.when(F.col("tier") == 3, "visual").otherwise("captions"),
        "transcript_source": F.lit("captions"), "classifier": F.lit("rules")})
    return writers.run_report(rows).select("seq", "line")


@query("reanalysis_cards", _REANALYSED + f"""
    SELECT url, category, status, 'new' AS origin FROM f WHERE outcome = 'analysed'
    UNION ALL SELECT url, {Q.list_of(_KNOWN)}[seq % 4 + 1], before, 'stored' FROM f WHERE skip AND seq % 3 <> 0""")
def _(t):
    stored = t.cards.filter(F.col("doc_id") % 3 != 0).select("url", pick(_KNOWN, F.col("doc_id") % 4).alias("category"))
    return RE.updates(_reanalysed(t), stored, t.latest_state)
