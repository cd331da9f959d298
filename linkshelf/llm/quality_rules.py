"""Quality rules with robust multivariate outliers.

Each text gives word and line statistics. Texts of fewer than 50 words, or with more than half of their words in repeated
three-word windows, fail the base rules. For the rest, transformed statistics (mean word length, symbols, repeated lines,
repeated words) are compared with those of their language and source: a minimum-covariance-determinant estimate gives
centre and spread of the three quarters that lie closest together, and a text whose Mahalanobis distance is beyond
``CUTOFF`` is rejected.

The estimate is found by concentration steps over all rows: start from medians and median deviations, keep the nearest
three quarters, take their mean and covariance, repeat ``STEPS`` times. Each step is two grouped sums. Order statistics
come from counts in fixed fine bins, so they are the same for any partitioning. Groups with fewer than ``MIN_ROWS`` rows use
their language's estimate, and small languages that of all rows. ``FLOORS`` are the least standard deviations: statistics
that hardly vary, as symbols in clean prose, don't make every other value an outlier. They lie so far below each statistic's
range that each can reject alone: in a group without any, from about 1.7% symbols, 53% repeated lines or 36% repeated words on.

Defined cases: a null text has no words and fails; null languages and sources are a group of their own; repeated rows count
as often as they occur and get the same verdict; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkshelf.llm.buffers import pieces, string_array, text_bytes
from linkshelf.llm.columns import dealt_apart, fresh, whole
from linkshelf.session import materialize

MIN_WORDS = 50
MAX_REPEATED = 50  # percent
SHARE = 0.75
STEPS = 8
MIN_ROWS = 60
#: Least standard deviation of each transformed statistic, in the order of ``VECTOR``.
#: They follow what one event changes in a text of ``MIN_WORDS`` words, some 250 letters in four lines: the deviation of a mean
#: of 50 words; half of one symbol's step; a third of one repeated line's; one word's.
FLOORS = (0.08, 0.03, 0.17, 0.14)
VECTOR = ("x0", "x1", "x2", "x3")
#: Rejected beyond this tail probability of the chi-squared distribution with four degrees of freedom.
TAIL = 1e-3
_BINS = 4096
_SYMBOLS = b"#*$%&|<>"


def _numbers(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each span of bytes, equal for equal bytes only. Spans come in order and don't overlap."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[begins] += 1
    edge[ends] -= 1
    offsets = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int64)
    flat = data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    spans = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    return spans.dictionary_encode().indices.to_numpy().astype(np.int64)


def _joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A number for each pair of numbers, below the number of pairs."""
    return pd.factorize(first * (int(second.max(initial=0)) + 1) + second)[0]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur twice or more; is this not its first place."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return twice, later


def text_statistics(data: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each text. Words and lines are compared byte by byte, within one text."""
    rows = len(starts) - 1
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[starts])
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    word = ~gap
    first = np.zeros(len(data), bool)
    first[starts[:-1][np.diff(starts) > 0]] = True
    begins = word.copy()
    begins[1:] &= gap[:-1] | first[1:]
    ends = word.copy()
    ends[:-1] &= gap[1:] | first[1:]
    ws, we = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(starts, ws, side="right") - 1
    words = _joined(row, _numbers(data, ws, we))
    repeated = np.zeros(len(ws), bool)
    if len(ws) > 2:
        inside = np.flatnonzero(row[2:] == row[:-2])
        pairs = _joined(words[inside], words[inside + 1])
        twice, _ = _repeats(_joined(pairs, words[inside + 2]))
        for k in range(3):
            repeated[inside[twice] + k] = True
    breaks = np.unique(np.concatenate([starts[:-1], np.flatnonzero(data == 10) + 1]))
    breaks = breaks[breaks < len(data)]
    line_ends = np.concatenate([breaks[1:], [len(data)]]) if len(breaks) else breaks
    full = np.diff(np.searchsorted(ws, np.concatenate([breaks, [len(data)]]))) > 0 if len(breaks) else np.zeros(0, bool)
    ls, le = breaks[full], line_ends[full]
    le = le - (data[le - 1] == 10)
    line_row = np.searchsorted(starts, ls, side="right") - 1
    _, later = _repeats(_joined(line_row, _numbers(data, ls, le)))
    symbol = np.zeros(256, bool)
    symbol[list(_SYMBOLS)] = True
    return {
        "n_words": np.bincount(row, minlength=rows), "word_chars": total(word & ((data & 0xC0) != 0x80)), "n_symbols": total(symbol[data]),
        "n_dup_lines": np.bincount(line_row[later], minlength=rows), "n_repeat_words": np.bincount(row[repeated], minlength=rows),
        "n_lines": np.bincount(line_row, minlength=rows),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, lang, source, digest)``, the counts and the transformed vector of every row; stored once, without texts."""

    def count(batches):
        for batch in batches:
            data, starts = text_bytes(string_array(batch.column("text")))
            parts = [text_statistics(data[starts[a]: starts[b]], starts[a: b + 1] - starts[a]) for a, b in pieces(starts)]
            values = [np.concatenate([p[c] for p in parts] or [np.zeros(0)]).astype(np.int64) for c in COUNTS]
            kept = [batch.column(c) for c in ("doc_id", "lang", "source", "digest")]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, values)], ["doc_id", "lang", "source", "digest", *COUNTS])

    rows = docs.select(
        "doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.xxhash64(whole()).alias("digest"), whole().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"doc_id {kind}, lang string, source string, digest bigint, " + ", ".join(f"{c} bigint" for c in COUNTS))
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    vector = (
        F.log(chars / words + 1), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return materialize(counted.withColumns(dict(zip(VECTOR, vector))).withColumn("base_failed", failed), "rule-statistics")


def _order_bin(rows: DataFrame, keys: list[str], value: Column, share: float) -> DataFrame:
    """``keys`` and ``at``: the least bin of ``value`` with ``share`` of the group's rows at or below it. At most ``_BINS`` rows a group."""
    bins = rows.select(*keys, F.least(F.greatest(value, F.lit(0)), F.lit(_BINS - 1)).cast("int").alias("bin"))
    counts = bins.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    along = Window.partitionBy(*keys).orderBy("bin")
    cumulated = counts.withColumn("upto", F.sum("n").over(along)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    return cumulated.filter(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy(*keys).agg(F.min("bin").alias("at"))


def chi2_4(p: float) -> float:
    """Quantile of the chi-squared distribution with four degrees of freedom."""
    low, high = 0.0, 200.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - math.exp(-middle / 2) * (1 + middle / 2) < p else (low, middle)
    return high


CUTOFF = chi2_4(1 - TAIL)
#: The nearest three quarters of a normal cloud understate its covariance by this factor.
CONSISTENCY = SHARE / (1 - math.exp(-chi2_4(SHARE) / 2) * (1 + chi2_4(SHARE) / 2 + chi2_4(SHARE) ** 2 / 8))
_PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]
_GROUP = ["level", "g_lang", "g_source"]
_STATE = ", ".join([f"m{i} double" for i in range(4)] + [f"p{i}{j} double" for i, j in _PAIRS])


def _distance() -> Column:
    """Squared Mahalanobis distance of the vector under centre ``m`` and precision ``p``."""
    d = [F.col(VECTOR[i]) - F.col(f"m{i}") for i in range(4)]
    terms = [(1 if i == j else 2) * F.col(f"p{i}{j}") * d[i] * d[j] for i, j in _PAIRS]
    return sum(terms[1:], terms[0])


def _distance_bin() -> Column:
    """Bins of the logarithm of the distance, 1/128 wide."""
    return F.floor((F.log(F.greatest(_distance(), F.lit(1e-6))) + 14) * 128)


def _precision(batches):
    """Centre and precision from sums; the covariance gets the consistency factor and the floors."""
    for batch in batches:
        columns = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names if name[0] in "ns"}
        n = columns["n"].astype(float)
        mean = np.stack([columns[f"s{i}"] / n for i in range(4)], 1)
        cov = np.zeros((len(n), 4, 4))
        for i, j in _PAIRS:
            cov[:, i, j] = cov[:, j, i] = CONSISTENCY * (columns[f"s{i}{j}"] / n - mean[:, i] * mean[:, j])
        cov += np.diag(np.square(FLOORS))
        inverse = np.linalg.inv(cov) if len(n) else cov
        yield pa.RecordBatch.from_arrays(
            [batch.column(g) for g in _GROUP] + [pa.array(mean[:, i]) for i in range(4)] + [pa.array(inverse[:, i, j]) for i, j in _PAIRS],
            [*_GROUP, *[f"m{i}" for i in range(4)], *[f"p{i}{j}" for i, j in _PAIRS]])


def estimates(stats: DataFrame) -> DataFrame:
    """Robust centre and precision of each language and source, each language, and all rows (levels 2, 1, 0)."""
    levels = F.array(
        F.struct(F.lit(2).alias("level"), F.col("lang").alias("g_lang"), F.col("source").alias("g_source")),
        F.struct(F.lit(1).alias("level"), F.col("lang").alias("g_lang"), F.lit("").alias("g_source")),
        F.struct(F.lit(0).alias("level"), F.lit("").alias("g_lang"), F.lit("").alias("g_source")))
    rows = stats.filter(~F.col("base_failed")).select(*VECTOR, F.explode(levels).alias("g")).select(*VECTOR, "g.*")
    sizes = rows.groupBy(*_GROUP).agg(F.count("*").alias("rows_")).filter((F.col("rows_") >= MIN_ROWS) | (F.col("level") == 0)).drop("rows_")
    # Joined by a hash of the group and summed by the group itself: sums are then combined before they are dealt, and a
    # large group, such as all rows, may be split by the join.
    group_hash = F.xxhash64(*_GROUP).alias("gid")
    hashed = lambda df: df.select(group_hash, *[c for c in df.columns if c not in _GROUP])
    rows = rows.select("*", group_hash).join(hashed(sizes), "gid", "left_semi")
    long = rows.select("gid", *_GROUP, F.posexplode(F.array(*VECTOR)).alias("i", "x"))
    step = 1024  # bins of a transformed statistic to the unit; all lie between 0 and 4
    middle = _order_bin(long, [*_GROUP, "i"], F.floor(F.col("x") * step), 0.5).withColumn("median", (F.col("at") + 0.5) / step).drop("at")
    spread = _order_bin(long.join(hashed(middle), ["gid", "i"]), [*_GROUP, "i"], F.floor(F.abs(F.col("x") - F.col("median")) * step), 0.5)
    start = middle.join(spread, [*_GROUP, "i"]).withColumn("scale", 1.4826 * (F.col("at") + 0.5) / step)
    floor = F.get(F.array(*map(F.lit, FLOORS)), F.col("i"))
    weight = 1 / (F.col("scale") * F.col("scale") + floor * floor)
    at = lambda i, c: F.max(F.when(F.col("i") == i, c))
    state = start.groupBy(*_GROUP).agg(
        *[at(i, F.col("median")).alias(f"m{i}") for i in range(4)],
        *[(at(i, weight) if i == j else F.lit(0.0)).alias(f"p{i}{j}") for i, j in _PAIRS])
    state = materialize(state, "mcd")
    for _ in range(STEPS):
        placed = rows.join(hashed(state), "gid").withColumn("bin", _distance_bin())
        limit = _order_bin(placed, _GROUP, F.col("bin"), SHARE)
        near = placed.join(hashed(limit), "gid").filter(F.col("bin") <= F.col("at"))
        sums = near.groupBy(*_GROUP).agg(
            F.count("*").alias("n"), *[F.sum(VECTOR[i]).alias(f"s{i}") for i in range(4)],
            *[F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"s{i}{j}") for i, j in _PAIRS])
        state = materialize(sums.mapInArrow(_precision, f"level int, g_lang string, g_source string, {_STATE}"), "mcd")
    return state


def verdicts(stats: DataFrame) -> DataFrame:
    """``stats`` with ``distance`` (null where the base rules failed) and ``kept``."""
    found = estimates(stats)
    values = F.struct(*[c for c in found.columns if c not in _GROUP])
    by_level = {k: found.filter(F.col("level") == k).select("g_lang", "g_source", values.alias(f"e{k}")) for k in (2, 1, 0)}
    pairs = stats.select("lang", "source").distinct()
    pairs = (
        pairs.join(by_level[2].withColumnsRenamed({"g_lang": "lang", "g_source": "source"}), ["lang", "source"], "left")
        .join(by_level[1].drop("g_source").withColumnRenamed("g_lang", "lang"), "lang", "left")
        .join(F.broadcast(by_level[0].select("e0")), how="left")  # one row
        .select("lang", "source", F.coalesce("e2", "e1", "e0").alias("e")).select("lang", "source", "e.*")
    ).withColumn("apart", dealt_apart("lang", "source"))
    measured = stats.withColumn("apart", dealt_apart("lang", "source")).join(pairs, ["lang", "source", "apart"], "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return measured.withColumn("kept", kept).select(*stats.columns, "distance", "kept")


def rule_table(docs: DataFrame) -> DataFrame:
    return verdicts(statistics(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with its columns."""
    rejected = verdicts(statistics(docs)).filter("not kept").select(F.col("doc_id").alias("r_id"), F.col("digest").alias("r_digest")).distinct()
    (digest,) = fresh(docs, "digest")
    return (
        docs.withColumn(digest, F.xxhash64(whole()))
        .join(rejected, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col(digest) == F.col("r_digest")), "left_anti").drop(digest)
    )
