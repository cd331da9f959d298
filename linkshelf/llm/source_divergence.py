"""How far the sources of a language differ in their words, counted on collapsed copies and compared on sparse cells.

Identical texts of a language are one text with a multiplicity for each source, so a text is cut into terms once however
often it is repeated. Its term counts are added with these multiplicities, first inside a task and then by shuffle; only
``(language, term, source)`` cells with occurrences exist from then on.

All shares ``p`` are whole billionths and all divergences whole numbers, so sums don't depend on their order. A pair of
sources is not summed over all kept terms: where a source lacks a term its share is the same for every term, so that

    value(a, b) = sum over a's terms of f(p_a, absent_b) + sum over b's terms of f(absent_a, p_b)
                + (terms - terms_a - terms_b) * f(absent_a, absent_b)
                + sum over common terms of f(p_a, p_b) - f(p_a, absent_b) - f(absent_a, p_b) + f(absent_a, absent_b)

The first line needs only how often each count occurs in a source; the last is summed inside tasks that hold some terms and
at most two blocks of sources, and leaves them as one number a pair.

Defined cases: a null text, lang or source is the empty one; texts without terms, and languages that keep no term, still give
their sources' pairs, with value 0 in the latter; repeated rows count each time; ties are ranked by the UTF-8 bytes of the item;
an empty table gives no rows; very long texts are cut in segments that end between terms; other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkshelf.llm.columns import whole
from linkshelf.session import materialize

LEAST_DOCS = 10
TOP_TERMS = 10
UNIT = 1_000_000_000
#: Text a task counts before it hands its sums on, and the longest piece of a text that is cut at once.
FLUSH_BYTES = 12 << 20
SEGMENT_BYTES = 4 << 20
#: Cells in a group of terms; sources in a block; pairs of cells compared at once.
GROUP_CELLS = 200_000
BLOCK_SOURCES = 512
PAIR_CHUNK = 1 << 20
SALTS = 16

# A-Z lowered, other ASCII but a-z turned into spaces; bytes above are parts of letters.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def segments(text: bytes):
    """Lists of the terms of ``text``, a bounded piece of it at a time."""
    text, at = text.translate(_TABLE), 0
    while at < len(text):
        end = text.find(b" ", at + SEGMENT_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


class _Sums:
    """Occurrences and documents of terms by (lang, source, multiplicity)."""

    def __init__(self):
        self.counts, self.docs, self.held = defaultdict(Counter), defaultdict(Counter), 0

    def add(self, text: bytes, shares: list[tuple]) -> None:
        """``text`` with every (lang, source, multiplicity) it stands for."""
        seen = None
        for terms in segments(text):
            for share in shares:
                self.counts[share].update(terms)
            seen = set(terms) if seen is None else seen.union(terms)
        for share in shares:
            self.docs[share].update(seen or ())
        self.held += len(text)

    def flush(self) -> pa.RecordBatch:
        columns = [[], [], [], [], []]
        for (lang, source, n), counter in self.counts.items():
            docs = self.docs[lang, source, n]
            columns[0] += [lang] * len(counter)
            columns[1] += [term.decode() for term in counter]
            columns[2] += [source] * len(counter)
            columns[3] += [n * c for c in counter.values()]
            columns[4] += [n * docs[term] for term in counter]
        self.__init__()
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "term", "source", "cnt", "docs"])


def _counted(batches, flush_bytes: int):
    sums, last, text, shares = _Sums(), None, b"", []
    for batch in batches:
        langs, sources, digests, ns = (batch.column(c).to_pylist() for c in ("lang", "source", "digest", "n"))
        for lang, source, digest, n, value in zip(langs, sources, digests, ns, batch.column("text")):
            if (lang, digest) != last:
                if shares:
                    sums.add(text, shares)
                    if sums.held >= flush_bytes:
                        yield sums.flush()
                last, text, shares = (lang, digest), value.as_py().encode(), []
            shares.append((lang, source, n))
    if shares:
        sums.add(text, shares)
    yield sums.flush()


def term_cells(docs: DataFrame) -> DataFrame:
    """``(lang, term, source, cnt, lang_cnt)`` of every kept term in each source that has it."""
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), whole().alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    times = rows.groupBy("lang", "digest", "source").agg(F.count("*").alias("n"))
    texts = rows.groupBy("lang", "digest").agg(F.first("text").alias("text"))
    each = texts.join(times, ["lang", "digest"]).sortWithinPartitions("lang", "digest").select("lang", "digest", "source", "n", "text")
    flush = FLUSH_BYTES
    counts = each.mapInArrow(lambda batches: _counted(batches, flush), "lang string, term string, source string, cnt bigint, docs bigint").repartition("lang", "term")
    cells = counts.groupBy("lang", "term", "source").agg(F.sum("cnt").alias("cnt"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    kept = cells.withColumn("lang_docs", F.sum("docs").over(term)).withColumn("lang_cnt", F.sum("cnt").over(term))
    return materialize(kept.filter(F.col("lang_docs") >= LEAST_DOCS).select("lang", "term", "source", "cnt", "lang_cnt"), "term-cells")


def share(count: Column, total: Column) -> Column:
    """``1 + floor(UNIT * (count + 2) / total)``, exact at any size; null if nothing is kept."""
    wide = (F.lit(UNIT).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)"))
    quotient = F.call_function("div", wide, total.cast("decimal(20,0)"))
    return F.when(total > 0, quotient + 1)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def group_table(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """``(lang, source, gid, own_terms, total, terms, lang_total, absent)`` of every occurring pair of language and source."""
    found = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    own = cells.groupBy("lang", "source").agg(F.count("*").alias("own_terms"), F.sum("cnt").alias("own"))
    langs = cells.groupBy("lang", "term").agg(F.first("lang_cnt").alias("c")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("c").alias("lang_sum"))
    joined = found.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
    joined = joined.withColumns({
        "gid": F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1,
        "total": F.col("own") + 2 * F.col("terms"), "lang_total": F.col("lang_sum") + 2 * F.col("terms")})
    return materialize(joined.withColumn("absent", share(F.lit(0), F.col("total"))).drop("own", "lang_sum"), "divergence-groups")


def _overlaps(table: pa.Table, size: int, chunk: int) -> pa.Table:
    """Corrections of all pairs of sources that share terms, summed over the terms of one group of at most two blocks of ``size``."""
    gid, p, absent = (table.column(c).to_numpy() for c in ("gid", "p", "absent"))
    term = table.column("term").combine_chunks().dictionary_encode()
    term = (term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term).indices.to_numpy()
    order = np.lexsort((gid, term))
    gid, p, absent, term = gid[order], p[order], absent[order], term[order]
    ends = np.searchsorted(term, term, side="right")
    later = ends - np.arange(len(term)) - 1
    x, y = (table.column(c)[0].as_py() for c in ("x", "y"))
    place = lambda g: np.where(g // size == x, g - x * size, size + g - y * size)
    sums, hit = np.zeros((2 * size) ** 2, np.int64), np.zeros((2 * size) ** 2, bool)
    upto, low = np.concatenate([[0], np.cumsum(later)]), 0
    while low < len(term):
        high = max(low + 1, int(np.searchsorted(upto, upto[low] + chunk, side="right")) - 1)
        left = np.repeat(np.arange(low, high), later[low:high])
        right = left + 1 + np.arange(len(left)) - np.repeat(upto[low:high] - upto[low], later[low:high])
        if x != y:
            apart = gid[left] // size != gid[right] // size
            left, right = left[apart], right[apart]
        pa_, pb, qa, qb = p[left], p[right], absent[left], absent[right]
        at = place(gid[left]) * (2 * size) + place(gid[right])
        np.add.at(sums, at, _divergence(pa_, pb) - _divergence(pa_, qb) - _divergence(qa, pb) + _divergence(qa, qb))
        hit[at] = True
        low = high
    at = np.flatnonzero(hit)
    back = lambda i: np.where(i < size, i + x * size, i - size + y * size)
    return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(at), pa.string()), "a": pa.array(back(at // (2 * size)), pa.int64()),
                     "b": pa.array(back(at % (2 * size)), pa.int64()), "value": pa.array(sums[at], pa.int64())})


def _pairs(cells: DataFrame, groups: DataFrame, count: int) -> DataFrame:
    """``(lang, source, item, value)`` of every ordered pair of sources of a language."""
    one = groups.select("lang", F.col("gid").alias("a"), F.col("total").alias("total_a"), F.col("absent").alias("absent_a"), F.col("own_terms").alias("terms_a"),
                        "terms", F.pmod("gid", F.lit(SALTS)).alias("salt"))
    # Few languages: each side's groups are dealt by language and salt.
    other = groups.select("lang", F.col("gid").alias("b"), F.col("absent").alias("absent_b"), F.col("own_terms").alias("terms_b"),
                          F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    none_of_both = one.join(other, ["lang", "salt"]).filter("a <> b").select("lang", "a", "b", F.coalesce(
        (F.col("terms") - F.col("terms_a") - F.col("terms_b")) * divergence(F.col("absent_a"), F.col("absent_b")), F.lit(0)).alias("value"))
    often = cells.groupBy("lang", F.col("gid").alias("a"), "cnt").agg(F.count("*").alias("times"), F.first("p").alias("p"))
    often = often.withColumn("salt", F.pmod(F.col("a") + F.col("cnt"), F.lit(SALTS)))
    in_one = often.join(other, ["lang", "salt"]).filter("a <> b").groupBy("lang", "a", "b").agg(
        F.sum(F.col("times") * divergence(F.col("p"), F.col("absent_b"))).alias("value"))
    # Terms by groups, sources by blocks: no task holds more than two blocks' cells of its terms.
    blocks = F.greatest(F.lit(1), F.ceil(F.col("sources") / BLOCK_SOURCES)).cast("int")
    own = F.floor(F.col("gid") / BLOCK_SOURCES).cast("int")
    dealt = cells.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "lang", "term", "gid", "p", "absent", F.least(own, "other").alias("x"), F.greatest(own, "other").alias("y"),
        F.pmod(F.xxhash64("term"), F.lit(max(1, -(-count // GROUP_CELLS)))).alias("part"))
    size, chunk = BLOCK_SOURCES, PAIR_CHUNK
    common = dealt.groupBy("lang", "part", "x", "y").applyInArrow(lambda table: _overlaps(table, size, chunk), "lang string, a bigint, b bigint, value bigint")
    common = common.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = in_one.unionAll(common)
    mirrored = both.unionAll(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    sums = none_of_both.unionAll(mirrored).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "gid", "source")
    return (sums.join(names.withColumnRenamed("gid", "a"), ["lang", "a"])
            .join(names.select("lang", F.col("gid").alias("b"), F.col("source").alias("item")), ["lang", "b"]).select("lang", "source", "item", "value"))


def source_divergence(docs: DataFrame) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: divergence from every other source, and the terms a source is rich in."""
    found = term_cells(docs)
    groups = group_table(docs, found)
    sources = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    known = groups.select("lang", "source", "gid", "total", "lang_total", "absent").join(sources, "lang")
    cells = found.join(known, ["lang", "source"]).withColumn("p", share(F.col("cnt"), F.col("total"))).withColumn("q", share(F.col("lang_cnt"), F.col("lang_total")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = cells.filter("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP_TERMS)
    pairs = _pairs(cells, groups, found.count()).withColumn("rank", F.row_number().over(order))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionAll(columns(terms, "term"))
