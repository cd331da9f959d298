"""The registered queries of the operators, with their SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from linkshelf.llm import conversation_trie, exact_dedup, html_extract, language_id, mixing, ngram_join, packing, quality_classifier, quality_rules, simhash_dedup, source_divergence, suffix_dedup, toxicity
from linkshelf.llm.workers import reachable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_classifier.quality_scores(docs, quality_classifier.fit(docs, _table(spark, sf_dir, "labels")))


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op3_exact_dedup", f"""
    WITH d AS (SELECT doc_id, sha256({_LOWERED}) AS text_sha256 FROM documents)
    SELECT doc_id, text_sha256, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = max(doc_id) OVER g AND row_number() OVER (PARTITION BY text_sha256, doc_id) = 1 AS kept
    FROM d WINDOW g AS (PARTITION BY text_sha256)
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


_MIX_SQL = f"""
    WITH RECURSIVE rows_ AS (
        SELECT doc_id, coalesce(source, '') AS src, strlen(coalesce(text, '')) + 1 AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
               md5(coalesce(text, '')) AS tie FROM documents),
    placed AS (
        SELECT doc_id, src, size, coalesce(sum(size) OVER (PARTITION BY src ORDER BY key, doc_id, size, tie
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM rows_),
    sizes AS (SELECT src, sum(size) AS bytes FROM rows_ GROUP BY src),
    aims AS (SELECT src, bytes, pow(CAST(bytes AS DOUBLE), {mixing.FLATTEN}) AS aim FROM sizes),
    shares AS (SELECT src, bytes, greatest(1, CAST(round({mixing.RESOLUTION} * aim / sum(aim) OVER ()) AS BIGINT)) AS n FROM aims),
    period AS (SELECT CAST(sum(n) AS BIGINT) AS q, list(n ORDER BY src) AS ns, list(src ORDER BY src) AS srcs FROM shares),
    slots AS (
        SELECT CAST(-1 AS BIGINT) AS slot, list_transform(ns, lambda x: CAST(0 AS BIGINT)) AS next, CAST(0 AS BIGINT) AS k, q, ns, srcs FROM period
        UNION ALL
        SELECT slot + 1, list_transform(next, lambda v, i: CASE WHEN i = p THEN v + 1 ELSE v END), p, q, ns, srcs FROM (
            SELECT slot, next, q, ns, srcs, list_min(list_filter(list_transform(ns, lambda n, i:
                CASE WHEN next[i] < n AND (next[i] * q) // n <= slot + 1 THEN (((next[i] + 1) * q + n - 1) // n) * 100000 + i END),
                lambda x: x IS NOT NULL)) % 100000 AS p
            FROM slots WHERE slot + 1 < q)),
    timetable AS (SELECT srcs[k] AS src, slot, row_number() OVER (PARTITION BY k ORDER BY slot) - 1 AS i FROM slots WHERE slot >= 0),
    ends AS (
        SELECT max(((bytes + {mixing.BLOCK_BYTES} - 1) // {mixing.BLOCK_BYTES} - 1) // n * q + slot + 1) AS total FROM shares JOIN period ON true
        JOIN timetable USING (src) WHERE i = ((bytes + {mixing.BLOCK_BYTES} - 1) // {mixing.BLOCK_BYTES} - 1) % n),
    plan AS (
        SELECT src, n, q, bytes, total // q * n + (SELECT count(*) FROM timetable t WHERE t.src = s.src AND t.slot < total % q) AS blocks
        FROM shares s, period, ends),
    read AS (
        SELECT doc_id, src, epoch, epoch * bytes + start AS start, (epoch * bytes + start) // {mixing.BLOCK_BYTES} AS block, n, q, blocks
        FROM placed JOIN plan USING (src) JOIN range(10000) e(epoch) ON epoch <= greatest(0, (blocks * {mixing.BLOCK_BYTES} - 1) // bytes))
    SELECT doc_id, r.src AS mix_source, CAST(start AS BIGINT) AS mix_start, CAST(epoch AS BIGINT) AS epoch, CAST(block AS BIGINT) AS block,
           CAST(block // n * q + slot AS BIGINT) AS slot, CAST(block // n * q + (block % n) * q // n AS BIGINT) AS release,
           CAST(block // n * q + ((block % n + 1) * q + n - 1) // n AS BIGINT) AS deadline
    FROM read r JOIN timetable t ON t.src = r.src AND t.i = r.block % r.n WHERE block < blocks
"""


@query("op4_pfair_mixing", _MIX_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _ = mixing.mixture(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "mix_source", "mix_start", "epoch", "block", "slot", "release", "deadline")


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_table(_table(spark, sf_dir, "documents"))


@query("op6_html_extract")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(_table(spark, sf_dir, "pages"))


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_table(_table(spark, sf_dir, "documents"))


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.languages(docs, language_id.fit(docs))


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rule_table(_table(spark, sf_dir, "documents"))


@query("op10_simhash_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicate_table(_table(spark, sf_dir, "documents"))


def _share(count: str, total: str) -> str:
    return f"1 + CAST((CAST(1000000000 AS HUGEINT) * ({count} + 2)) // nullif({total}, 0) AS BIGINT)"


@query("op11_source_divergence", f"""
    WITH docs AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWERED} AS text FROM documents),
    words AS (SELECT row_id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
    kept AS (SELECT lang, term, count(*) AS lang_cnt FROM words GROUP BY lang, term HAVING count(DISTINCT row_id) >= {source_divergence.LEAST_DOCS}),
    cells AS (SELECT lang, source, term, count(*) AS cnt FROM words GROUP BY ALL),
    langs AS (SELECT lang, count(*) AS v, sum(lang_cnt) + 2 * count(*) AS lang_total FROM kept GROUP BY lang),
    groups AS (SELECT DISTINCT lang, source FROM docs),
    dense AS (
        SELECT g.lang, g.source, k.term, coalesce(c.cnt, 0) AS cnt, k.lang_cnt, sum(coalesce(c.cnt, 0)) OVER (PARTITION BY g.lang, g.source) + 2 * v AS total, lang_total
        FROM groups g JOIN kept k USING (lang) JOIN langs USING (lang) LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    shares AS (SELECT lang, source, term, cnt, {_share("cnt", "total")} AS p, {_share("lang_cnt", "lang_total")} AS q FROM dense),
    pairs AS (
        SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
        FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    every AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
        UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE cnt > 0 AND p > q),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM every)
    SELECT * FROM ranked WHERE part = 'pair' OR rank <= {source_divergence.TOP_TERMS}
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.source_divergence(_table(spark, sf_dir, "documents"))


# Bytes of the decimal id, each followed by eight shifts.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""


@query("op12_conversation_trie", f"""
    WITH turns AS (
        SELECT conv_id, turn, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k,
               len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words
        FROM conversations WHERE conv_id IS NOT NULL),
    original AS (SELECT conv_id, list((k, words) ORDER BY turn NULLS FIRST, k) AS seq FROM turns GROUP BY conv_id),
    placed AS (SELECT conv_id, conv_id - conv_id % 20 AS base, CAST({_CRC} AS BIGINT) % 4 AS h, seq FROM original),
    rebuilt AS (
        SELECT p.conv_id, list_concat(CASE WHEN h > 0 THEN coalesce(b.seq, [])[1:h] ELSE [] END, p.seq[h + 1:]) AS seq
        FROM placed p LEFT JOIN original b ON b.conv_id = p.base),
    steps AS (SELECT conv_id, seq, len(seq) AS n, unnest(range(0, len(seq) + 1)) AS depth FROM rebuilt),
    paths AS (
        SELECT conv_id, n, depth, list_transform(seq[1:depth], lambda x: x[1]) AS path,
               CASE WHEN depth > 0 THEN seq[depth][2] ELSE 0 END AS words FROM steps),
    nodes AS (
        SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, max(n) AS longest,
               sha256(coalesce(string_agg(CASE WHEN n = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
        FROM paths GROUP BY path, depth),
    inside AS (
        SELECT a.conv_id, a.depth, count(CASE WHEN b.depth = a.depth + 1 THEN 1 END) AS n_children, count(CASE WHEN b.longest = b.depth THEN 1 END) AS n_leaves,
               sum((b.n_convs - 1) * b.words) AS saved_tokens
        FROM nodes a JOIN nodes b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path GROUP BY ALL)
    SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, v.ends_sha256
    FROM nodes v JOIN inside i ON i.conv_id = v.conv_id AND i.depth = v.depth LEFT JOIN nodes p ON p.depth = v.depth - 1 AND p.path = v.path[1:v.depth - 1]
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


@query("op13_ngram_join")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_join(_table(spark, sf_dir, "documents"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
