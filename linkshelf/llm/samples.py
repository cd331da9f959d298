"""Bounded samples of labelled rows for fits on the driver, and the small logistic fit they feed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkshelf.llm.columns import held_out, whole


#: Parts of the hash range a sample is cut from.
_RANGE = 1 << 30
#: Expected rows of a class before the exact cut, as a multiple of those wanted.
_SPARE = 4


def lowest_by_hash(rows: DataFrame, by: str, count: int, most_classes: int, most_bytes: int) -> DataFrame:
    """Of ``rows(doc_id, by, size)``, those of each class with the lowest hash of the id: ``count`` at most, and ``most_bytes`` at most.

    Rows are whole texts. One of over an eighth of ``most_bytes`` is not sampled: it would stand for the whole class.
    Class sizes give a hash bound below which about ``_SPARE * count`` rows of a class lie; only those are ranked, so no task
    ranks more, whatever the size of the table.
    """
    rows = rows.filter(F.col("size") <= most_bytes // 8)
    sizes = rows.groupBy(by).count().limit(most_classes + 1).collect()
    if len(sizes) > most_classes:
        raise ValueError(f"over {most_classes} classes in {by}")
    if not sizes:
        return rows.limit(0)
    bounds = F.create_map(*[F.lit(v) for r in sizes for v in (r[by], min(_RANGE, _RANGE * _SPARE * count // r["count"] + 1))])
    low = rows.withColumn("h", F.xxhash64("doc_id")).filter(F.pmod("h", F.lit(_RANGE)) < bounds[F.col(by)])
    along = Window.partitionBy(by).orderBy(F.pmod("h", F.lit(_RANGE)), "h", "doc_id")
    upto = F.sum("size").over(along.rowsBetween(Window.unboundedPreceding, 0))
    ranked = low.withColumns({"nth": F.row_number().over(along), "upto": upto})
    return ranked.filter((F.col("nth") <= count) & (F.col("upto") <= most_bytes)).drop("nth", "upto", "h", "size")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int, most_bytes: int) -> list[tuple[int, str, int]]:
    """``(doc_id, text, y)`` of at most ``rows_per_class`` whole documents of each class, ``most_bytes`` bytes together.

    Never a held-out document. The choice is by a hash of the id, so it doesn't depend on how the table is stored. An id
    with several rows or labels gives its greatest text and label.
    """
    marks = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    sizes = docs.groupBy("doc_id").agg(F.max(F.octet_length(whole())).cast("bigint").alias("size"))
    chosen = lowest_by_hash(marks.join(sizes, "doc_id").select("doc_id", "y", "size"), "y", rows_per_class, 2, most_bytes)
    rows = (
        docs.select("doc_id", whole().alias("text"))
        .join(F.broadcast(chosen), "doc_id")  # 2 * rows_per_class rows at most
        .groupBy("doc_id", "y").agg(F.max("text").alias("text")).collect()
    )
    return sorted((r["doc_id"], r["text"], r["y"]) for r in rows)


def class_counts(labels: DataFrame, label: str) -> dict[int, int]:
    """Labelled rows of each class that may be learned from."""
    y = F.col(label).cast("int").alias("y")
    seen = labels.filter(F.col("doc_id").isNotNull() & ~held_out()).groupBy(y).count().filter(F.col("y").isin(0, 1)).collect()
    return {r["y"]: r["count"] for r in seen}


def with_prior(fit: tuple, sampled: np.ndarray, counts: dict[int, int]) -> tuple:
    """The fit with its intercept moved from the sample's class shares to those of all labelled rows."""
    mean, scale, w = fit
    ones, zeros = float(sampled.sum()), float(len(sampled) - sampled.sum())
    if ones and zeros and counts.get(0) and counts.get(1):
        w = w.copy()
        w[-1] += np.log(counts[1] / counts[0]) - np.log(ones / zeros)
    return mean, scale, w


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, least_scale: float = 1e-9, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(mean, scale, weights)`` of a ridge logistic regression, intercept last. One class only: the intercept says so.

    ``least_scale``: a column that varies less is not stretched to unit variance, so it can't decide alone on other rows.
    """
    mean, scale = (x.mean(0), np.maximum(x.std(0), least_scale)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-3]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w = w + step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return mean, scale, w


def logistic(x: np.ndarray, fit: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    mean, scale, w = fit
    return 1 / (1 + np.exp(-np.clip((x - mean) / scale @ w[:-1] + w[-1], -30, 30)))
