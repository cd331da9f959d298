"""Mixing sources to target weights with Pfair scheduling. DataFrame functions only.

A source is a stream of blocks of ``block_bytes`` bytes. With weight n/Q, block i may not start before slot
``floor(i Q / n)`` (its release) and must be placed before slot ``ceil((i + 1) Q / n)`` (its deadline). Earliest deadline
first over released blocks meets every deadline, so after any number of slots each source is less than one block
away from n/Q. That is the target weight rounded to a thousandth of the period (``RESOLUTION``), one at least: against the
target itself a source drifts with the number of slots, by |n/Q - weight| blocks each. The schedule repeats after Q slots: one period is worked out, its size is a parameter
(``resolution``), and every block finds its slot by arithmetic. No row is moved through one task.

Sources are read in the order of the md5 of their ids. The mix ends when every source has been read whole at least
once; a source that runs out sooner starts again, as a further epoch. So no document is lost and the weights hold
to the end.

Defined cases: a null source is the source with the empty name; null and empty texts count one byte, as every text
counts one more than its length; rows with equal ids are ordered by length and then md5 of their text; an empty table
gives no rows. At most ``MAX_SOURCES`` sources are scheduled, more raise an error: group the small ones first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkshelf.llm.columns import fresh, whole

BLOCK_BYTES = 8192
#: Slots of a period, before each source's share is rounded to at least one.
RESOLUTION = 1000
#: Exponent of the default weights: the share of a source is its size to this power.
FLATTEN = 0.7
MAX_SOURCES = 2000
#: Hex digits of the order key that name a bucket of a source.
_BUCKET_DIGITS = 3


def streams(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` with source, size and first byte of each row in its source's stream (columns ``names``).

    A source is cut into 4,096 buckets of its order key. Rows are summed inside a bucket, the bucket totals are summed
    along the source, so a source with a third of all rows is spread over its buckets.
    """
    src, size, start = names
    key, bucket, tie, base = fresh(docs.select("*", *[F.lit(0).alias(n) for n in names]), "order_key", "bucket", "tie", "base")
    rows = (
        docs.withColumn(src, F.coalesce(F.col("source"), F.lit("")))
        .withColumn(size, F.octet_length(whole()).cast("bigint") + 1)
        .withColumn(key, F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
        .withColumn(bucket, F.substring(F.col(key), 1, _BUCKET_DIGITS))
        .withColumn(tie, F.md5(whole()))
    )
    totals = rows.groupBy(src, bucket).agg(F.sum(size).alias(base))
    along = Window.partitionBy(src).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.withColumn(base, F.coalesce(F.sum(base).over(along), F.lit(0))).withColumnsRenamed({src: "b_src", bucket: "b_bucket"})
    inside = Window.partitionBy(src, bucket).orderBy(key, "doc_id", size, tie).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn(start, F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return (
        placed.join(bases, (F.col(src) == F.col("b_src")) & (F.col(bucket) == F.col("b_bucket")))
        .withColumn(start, F.col(start) + F.col(base))
        .drop("b_src", "b_bucket", key, bucket, tie, base)
    )


def shares(docs: DataFrame, weights: dict[str, float] | None, resolution: int) -> DataFrame:
    """``(src, bytes, n, period)``: slots of each source in a period of ``period`` slots. One row a source."""
    sizes = docs.groupBy(F.coalesce(F.col("source"), F.lit("")).alias("src")).agg(
        F.sum(F.octet_length(whole()).cast("bigint") + 1).alias("bytes"))
    if weights is None:
        aim = F.pow(F.col("bytes").cast("double"), F.lit(FLATTEN))
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))])
        aim = F.coalesce(given[F.col("src")], F.lit(min(weights.values(), default=1.0)).cast("double"))
    # One row for each source, as many as MAX_SOURCES: a single task may hold them.
    every = Window.partitionBy(F.lit(0))
    n = F.greatest(F.lit(1).cast("bigint"), F.round(F.lit(resolution) * F.col("aim") / F.sum("aim").over(every)).cast("bigint"))
    counted = F.when(F.count("*").over(every) > MAX_SOURCES, F.raise_error(F.lit("too many sources to schedule"))).otherwise(F.col("n"))
    return (
        sizes.withColumn("aim", aim).withColumn("n", n).withColumn("n", counted)
        .withColumn("period", F.sum("n").over(every)).drop("aim")
    )


def timetable(shares_: DataFrame) -> DataFrame:
    """``(src, i, slot)``: the slot of each block of one period, earliest deadline first over released blocks."""
    state = shares_.agg(
        F.array_sort(F.collect_list(F.struct("src", "n"))).alias("s"), F.coalesce(F.max("period"), F.lit(0)).alias("q")
    ).filter("q > 0")
    # Of the released blocks, the one with the least (deadline, source) takes the slot.
    fold = """
        aggregate(
            sequence(0L, q - 1),
            named_struct('next', transform(s, x -> 0L), 'taken', cast(array() as array<int>)),
            (a, t) -> transform(
                array(array_min(transform(s, (x, k) -> if(
                    (a.next[k] * q) div x.n <= t and a.next[k] < x.n,
                    named_struct('deadline', ((a.next[k] + 1) * q + x.n - 1) div x.n, 'k', k),
                    null)))),
                p -> named_struct(
                    'next', transform(a.next, (v, k) -> if(k = p.k, v + 1, v)),
                    'taken', array_append(a.taken, p.k)))[0],
            a -> a.taken)
    """
    slots = state.select("s", F.posexplode(F.expr(fold)).alias("slot", "k"))
    turn = Window.partitionBy("src").orderBy("slot")
    return slots.select(F.col("s")[F.col("k")]["src"].alias("src"), F.col("slot").cast("bigint")).select(
        "src", (F.row_number().over(turn) - 1).cast("bigint").alias("i"), "slot")


def horizon(shares_: DataFrame, table: DataFrame, block_bytes: int) -> DataFrame:
    """``shares`` with ``blocks``: how many blocks each source gives to the whole mix."""
    last = shares_.withColumn("last", F.expr(f"(bytes + {block_bytes} - 1) div {block_bytes} - 1"))
    ends = (
        last.withColumn("i", F.col("last") % F.col("n")).join(table, ["src", "i"])
        .select(F.expr("last div n * period + slot + 1").alias("end")).agg(F.max("end").alias("slots"))
    )
    split = shares_.select("src", "n", "period", "bytes").join(F.broadcast(ends))
    part = table.join(split.select("src", "slots", "period"), "src").filter("slot < slots % period").groupBy("src").agg(F.count("*").alias("more"))
    return split.join(part, "src", "left").select(
        "src", "n", "period", "bytes", "slots", F.expr("slots div period * n + coalesce(more, 0L)").alias("blocks"))


def mixture(docs: DataFrame, weights: dict[str, float] | None = None, block_bytes: int = BLOCK_BYTES,
            resolution: int = RESOLUTION) -> tuple[DataFrame, list[str]]:
    """``docs`` once for each time the mix reads a row, and the names of the added columns.

    These are: source read, epoch (from 0), first byte in the repeated stream, block, slot, release and deadline of the
    block. ``weights`` maps sources to shares; sources it leaves out get the least of them; None weighs a source by
    its bytes to the power ``FLATTEN``.
    """
    src, size, start, epoch, block, slot, release, deadline = names = fresh(
        docs, "mix_source", "mix_bytes", "mix_start", "epoch", "block", "slot", "release", "deadline")
    share = shares(docs, weights, resolution)
    table = timetable(share)
    # Both have at most MAX_SOURCES + RESOLUTION rows, whatever the table holds.
    plan = F.broadcast(horizon(share, table, block_bytes).toDF("p_src", "p_n", "p_period", "p_bytes", "p_slots", "p_blocks"))
    slots = F.broadcast(table.toDF("t_src", "t_i", "t_slot"))
    # A text longer than the rest of the mix still takes part in the first epoch.
    epochs = F.expr(f"greatest(0L, (p_blocks * {block_bytes} - 1) div p_bytes)")
    mixed = (
        streams(docs, [src, size, start])
        .join(plan, F.col(src) == F.col("p_src"))
        .withColumn(epoch, F.explode(F.sequence(F.lit(0).cast("bigint"), epochs)))
        .withColumn(start, F.col(epoch) * F.col("p_bytes") + F.col(start))
        .withColumn(block, F.floor(F.col(start) / F.lit(block_bytes)))
        .filter(F.col(block) < F.col("p_blocks"))
        .withColumn("p_i", F.col(block) % F.col("p_n"))
    )
    turn = F.expr("p_period") * F.floor(F.col(block) / F.col("p_n"))
    mixed = (
        mixed.join(slots, (F.col(src) == F.col("t_src")) & (F.col("p_i") == F.col("t_i")))
        .withColumn(slot, turn + F.col("t_slot"))
        .withColumn(release, turn + F.expr("p_i * p_period div p_n"))
        .withColumn(deadline, turn + F.expr("((p_i + 1) * p_period + p_n - 1) div p_n"))
    )
    return mixed.drop("p_src", "p_n", "p_period", "p_bytes", "p_slots", "p_blocks", "p_i", "t_src", "t_i", "t_slot"), names


def mixed_documents(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The mix in the order of its slots, with the columns of ``docs``: each written file is a consecutive part of it."""
    mixed, (_, _, start, _, _, slot, _, _) = mixture(docs, weights)
    return mixed.repartitionByRange(slot, start).sortWithinPartitions(slot, start).select(*[F.col(f"`{c}`") for c in docs.columns])
