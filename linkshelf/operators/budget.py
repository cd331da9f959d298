"""Quota, pacing and cost analytics over the request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkshelf import constants as C
from linkshelf.operators.ordered import previous_value, row_numbers, running_sums


def quota_day(ts: Column) -> Column:
    """Calendar day the daily quota counts against (Pacific time)."""
    return F.to_date(F.from_utc_timestamp(ts, C.QUOTA_ZONE))


def requests_per_day(log: DataFrame, cap: int | None) -> DataFrame:
    """Requests per key and quota day; no cap means never exhausted."""
    counts = log.groupBy("key", quota_day(F.col("ts")).alias("quota_day")).agg(F.count(F.lit(1)).alias("requests"))
    out = F.lit(False) if cap is None else F.col("requests") >= cap
    return counts.withColumn("exhausted", out)


def model_usd(in_tokens: Column, out_tokens: Column, price_in: float | None, price_out: float | None) -> Column:
    """Price of model tokens; 0 while either price is unknown."""
    if price_in is None or price_out is None:
        return F.lit(0.0)
    return (in_tokens * F.lit(price_in) + out_tokens * F.lit(price_out)) / 1_000_000


def cost_totals(log: DataFrame, by: list[str], price_in: float | None, price_out: float | None,
                classifier_price: float = C.CLASSIFIER_PRICE_PER_M) -> DataFrame:
    """Calls, tokens and USD per group. The classifier bills input tokens only."""
    sums = log.groupBy(*by, "provider").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("in_tokens").alias("in_tokens"), F.sum("out_tokens").alias("out_tokens")
    )
    usd = F.when(
        F.col("provider") == "llm", model_usd(F.col("in_tokens"), F.col("out_tokens"), price_in, price_out)
    ).otherwise(F.col("in_tokens") * F.lit(classifier_price) / 1_000_000)
    return sums.withColumn("usd", usd)


def minute_load(log: DataFrame, rpm: int | None, tpm: int | None, seconds: int = 60) -> DataFrame:
    """Requests and tokens per key in the last ``seconds`` at every instant a request started.

    The frame includes its lower bound. Every request adds itself at its start and takes
    itself back just after it has left the frame, so the load is a running sum whose cost does
    not depend on how many requests a frame holds. Time is cut into blocks of ten frames; a
    request still in the frame at a block's end is carried into the next block's opening, so
    a busy key is spread over its blocks and no block waits for another.
    """
    span = seconds * 1_000_000
    width = 10 * span
    at = log.groupBy("key", F.unix_micros("ts").alias("us")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("in_tokens").cast("bigint").alias("tok")
    )
    block = lambda t: F.call_function("div", t, F.lit(width).cast("bigint"))
    here, gone = block(F.col("us")), F.col("us") + span + 1
    step = lambda blk, t, sign, starts: F.struct(
        blk.alias("blk"), t.alias("us"), (F.col("n") * sign).alias("n"), (F.col("tok") * sign).alias("tok"), F.lit(starts).alias("starts")
    )
    carried = F.array(step(here + 1, (here + 1) * width - 1, 1, False), step(here + 1, gone, -1, False))
    steps = F.concat(
        F.array(step(here, F.col("us"), 1, True)),
        F.when(block(gone) == here, F.array(step(here, gone, -1, False))).otherwise(carried),
    )
    upto = Window.partitionBy("key", "blk").orderBy("us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    loaded = at.select("key", F.explode(steps).alias("s")).select("key", "s.*").withColumns({
        "requests": F.sum("n").over(upto), "tokens": F.sum("tok").over(upto),
    })
    over = F.lit(False)
    if rpm is not None:
        over = over | (F.col("requests") > rpm)
    if tpm is not None:
        over = over | (F.col("tokens") > tpm)
    return loaded.filter("starts").select("key", F.timestamp_micros("us").alias("ts"), "requests", "tokens", over.alias("over_limit"))


def spend_cut(work: DataFrame, seq: str, price_in: float | None, price_out: float | None, *,
              run_cap: float | None, total_cap: float | None, spent_before: float = 0.0) -> DataFrame:
    """Which rows of an ordered work list run under the spend caps.

    ``work`` has ``cached, est_tokens, in_tokens, out_tokens``. The first paid call whose
    projection would pass a cap stops every later paid call; cached rows always pass. Without
    prices a cap is not enforced.
    """
    paid = ~F.col("cached")
    tokens = lambda c: F.when(paid, F.col(c)).otherwise(0).cast("bigint")
    rows = running_sums(work, [], seq, {"__in": tokens("in_tokens"), "__out": tokens("out_tokens")})
    before = model_usd(F.col("__in") - tokens("in_tokens"), F.col("__out") - tokens("out_tokens"), price_in, price_out)
    projected = model_usd(F.col("est_tokens"), F.lit(C.EST_OUTPUT_TOKENS), price_in, price_out)
    over = F.lit(False)
    if price_in is not None and price_out is not None:
        if run_cap is not None:
            over = over | (before + projected > run_cap)
        if total_cap is not None:
            over = over | (before + F.lit(spent_before) + projected > total_cap)
    rows = rows.withColumn("spent_before_usd", before).withColumn("projected_usd", projected)
    rows = rows.withColumn("crosses", paid & over)
    stopped = running_sums(rows, [], seq, {"__stops": F.col("crosses").cast("bigint")})
    return stopped.withColumn("runs", F.col("cached") | (F.col("__stops") == 0)).drop("__in", "__out", "__stops")


def key_capacity(usage: DataFrame, cap: int | None, unlimited: int) -> DataFrame:
    """Half-open intervals of request numbers each key can still take, in key order.

    ``usage`` has one row per key: ``key, requests, exhausted``.
    """
    room = F.lit(unlimited) if cap is None else F.greatest(F.lit(0), F.lit(cap) - F.col("requests"))
    left = usage.withColumn("room", F.when(F.col("exhausted"), 0).otherwise(room).cast("bigint"))
    # One row per configured key, so this window is as small as the key list.
    upto = Window.partitionBy(F.lit(0)).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    return left.withColumn("hi", F.sum("room").over(upto)).withColumn("lo", F.col("hi") - F.col("room"))


def allocated(planned: DataFrame, seq: str, capacity: DataFrame, block: int = 10_000) -> DataFrame:
    """Assign planned requests to keys in order; ``key`` is NULL for what does not fit today.

    Each key's interval is cut into blocks of request numbers, which makes the range lookup an
    equi-join on the block.
    """
    numbered = row_numbers(planned, [], seq, "n").withColumn("n", F.col("n") - 1)
    numbered = numbered.withColumn("blk", F.expr(f"n div {block}L"))
    spans = capacity.filter("room > 0").select(
        "key", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {block}L"), F.expr(f"(hi - 1) div {block}L"))).alias("blk")
    )
    inside = (F.col("n") >= F.col("lo")) & (F.col("n") < F.col("hi"))
    joined = numbered.alias("a").join(spans.alias("b"), (F.col("a.blk") == F.col("b.blk")) & inside, "left")
    return joined.select(*[F.col(f"a.{c}") for c in planned.columns], F.col("n"), F.col("b.key").alias("key"))


def start_gaps(log: DataFrame, seq: str, min_seconds: float) -> DataFrame:
    """Seconds since the previous process start and whether the minimum gap was broken.

    ``seq`` follows start order.
    """
    rows = previous_value(log, [], seq, F.col("ts"), "__prev")
    gap = (F.unix_micros("ts") - F.unix_micros("__prev")) / 1_000_000
    return rows.withColumn("gap_seconds", gap).withColumn(
        "too_soon", F.coalesce(F.col("gap_seconds") < min_seconds, F.lit(False))
    ).drop("__prev")


def usage_by_key(log: DataFrame) -> DataFrame:
    """Requests and input tokens of each key over a whole request log."""
    return log.groupBy("key").agg(F.count(F.lit(1)).alias("requests"), F.sum("in_tokens").alias("in_tokens"))
