"""Quality gates: visual evidence, list completeness, terminal status, attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkshelf import constants as C
from linkshelf.functions.numbers import fixed
from linkshelf.functions.text import has_list_claim, text_or_blank
from linkshelf.operators.ordered import BLOCK_ROWS, FAN_BITS, blocked, last_before, levels, place, sums_before
from linkshelf.operators.sets import union_all


def visual_reasons(
    *, carousel: Column, words: Column, speech_ratio: Column, retry_hint: Column, has_analysis: Column,
    expected: Column, items: Column, self_flag: Column, title: Column, caption: Column, source: Column,
    probability: Column,
) -> Column:
    """Ordered reasons to look at frames; any reason escalates."""
    expected = F.coalesce(expected, F.lit(0))
    claim = (
        ~has_analysis
        & has_list_claim(F.concat(text_or_blank(title), F.lit(" "), text_or_blank(caption)))
        & (source != "captions")
        & (words < C.SPOKEN_LIST_WORDS)
    )
    return F.array_compact(F.array(
        F.when(carousel, F.lit("carousel/photo post")),
        F.when(
            words < C.MIN_TRANSCRIPT_WORDS,
            F.format_string(f"transcript %d words < {C.MIN_TRANSCRIPT_WORDS}", words),
        ),
        F.when(
            speech_ratio < C.MIN_SPEECH_RATIO,
            F.concat(F.lit("speech ratio "), fixed(speech_ratio, 2), F.lit(f" < {C.MIN_SPEECH_RATIO}")),
        ),
        F.when(text_or_blank(retry_hint) != "", F.concat(F.lit("completeness retry: "), retry_hint)),
        F.when(
            has_analysis & (expected > 0) & (items < expected),
            F.format_string("list claims %d items, text found %d", expected, items),
        ),
        F.when(has_analysis & F.coalesce(self_flag, F.lit(False)), F.lit("summarizer flagged on-screen-only content")),
        F.when(claim, F.lit("list claim with little speech")),
        F.when(
            probability >= C.NEEDS_VISUALS_THRESHOLD, F.concat(F.lit("jev needs_visuals="), fixed(probability, 2))
        ),
    ))


def audio_needed(words: Column, carousel: Column, photo: Column) -> Column:
    return (words < C.MIN_TRANSCRIPT_WORDS) & ~carousel & ~photo


def tier_reached(*, captions_tried: Column, audio_tried: Column, visuals_tried: Column) -> Column:
    """0 metadata, 1 captions, 2 audio, 3 visual."""
    return F.greatest(
        F.lit(0), F.when(captions_tried, 1), F.when(audio_tried, 2), F.when(visuals_tried, 3)
    )


def expected_count(claimed: Column, slides: Column, shape: Column, images: Column, slides_seen: Column, actual: Column) -> Column:
    """Largest plausible item count, NULL when nothing makes a claim."""
    return F.greatest(
        F.when(claimed > 0, claimed),
        F.when((slides > 0) & shape.isin(C.SLIDESHOW_SHAPES) & (slides <= C.MAX_PLAUSIBLE_SLIDES), slides),
        F.when(images > 0, images),
        F.when((slides_seen > 0) & (slides_seen > actual), slides_seen),
    )


def position_gaps(items: DataFrame, key: str, position: str, first: int = 10, block: int = 1024,
                  fan_bits: int = FAN_BITS) -> DataFrame:
    """Per key: rows, distinct positions, smallest, largest, and the ``first`` missing ones.

    Positions are grouped in blocks of ``block`` values, blocks in ranges of ``2 ** fan_bits`` and ranges per key. A block or range is five
    narrow values and its own first missing positions, so no array and no window grows with the rows of a key, and sparse
    positions only make more blocks. What is missing between two neighbours follows from the first position of the later one.
    """
    none = F.array().cast("array<bigint>")
    p = F.col(position).cast("bigint")
    inside = F.when(F.col("hi") - F.col("lo") + 1 > F.size("ps"), F.array_sort(F.array_except(F.sequence("lo", "hi"), "ps")))
    cells = items.groupBy(key, F.floor(p / block).alias("blk")).agg(
        F.count(F.lit(1)).alias("rows"), F.collect_set(p).alias("ps")
    ).withColumns({"lo": F.array_min("ps"), "hi": F.array_max("ps"), "distinct_positions": F.size("ps").cast("bigint")})
    cells = cells.withColumn("gap", F.coalesce(F.slice(inside, 1, first), none)).drop("ps")

    def rolled(cells: DataFrame, by: list[str]) -> DataFrame:
        """Neighbouring cells of each ``by`` as one."""
        order = Window.partitionBy(*by).orderBy(F.asc_nulls_first("blk"))
        edge = F.when(F.col("next_lo").isNotNull() & (F.col("next_lo") > F.col("hi") + 1), F.least(F.col("next_lo") - 1, F.col("hi") + first))
        gaps = (
            cells.withColumn("next_lo", F.lead("lo").over(order)).withColumn("edge", edge)
            .withColumn("gap", F.slice(F.concat("gap", F.coalesce(F.sequence(F.col("hi") + 1, "edge"), none)), 1, first))
            .withColumn("before", F.coalesce(F.sum(F.size("gap")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        )
        listed = F.when((F.col("before") < first) & (F.size("gap") > 0), F.struct("blk", "gap"))
        found = F.flatten(F.transform(F.array_sort(F.collect_list(listed)), lambda g: g["gap"]))
        return gaps.groupBy(*by).agg(
            F.sum("rows").alias("rows"), F.sum("distinct_positions").alias("distinct_positions"), F.min("lo").alias("lo"),
            F.max("hi").alias("hi"), F.slice(found, 1, first).alias("gap"),
        )

    for _ in range(levels(block, fan_bits)):
        up = F.call_function("div", F.col("blk"), F.lit(1 << fan_bits).cast("bigint"))
        cells = rolled(cells.withColumn("up", up), [key, "up"]).withColumnRenamed("up", "blk")
    return rolled(cells, [key]).withColumnsRenamed({"lo": "first_position", "hi": "last_position", "gap": "missing"})


def completeness(expected: Column, actual: Column, missing: Column) -> tuple[Column, Column]:
    """``(complete, retry_hint)`` of one analysed item."""
    gaps = F.coalesce(F.size(missing), F.lit(0)) > 0
    gap_hint = F.concat(F.lit("Missing list positions: ["), F.array_join(missing.cast("array<string>"), ", "), F.lit("]"))
    short = F.coalesce(actual < expected, F.lit(False))
    short_hint = F.format_string("Expected at least %d items but got %d.", expected, actual)
    return ~short & ~gaps, F.when(gaps, gap_hint).when(short, short_hint)


def terminal_status(failed: Column, attempts: Column, complete: Column, flagged: Column, limit: int = C.MAX_ATTEMPTS) -> Column:
    return (
        F.when(failed & (attempts >= max(1, limit)), "manual-review")
        .when(failed, "failed-retryable")
        .when(complete & ~flagged, "done")
        .otherwise("needs-review")
    )


def attempts_along_log(
    log: DataFrame, key: str, seq: str, success: Column, failure: Column, passes: Column, name: str = "attempts",
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """Attempt counter after each log row.

    A failure adds one, a success restarts the count at the passes it used, anything else
    carries the value forward. ``seq`` is a whole number, unique within its key.

    Inside a block of the sequence the counter is the failures so far plus what the last
    success set; across blocks only two numbers per block travel: its failures and where its
    last success left the count.
    """
    base = blocked(log, seq, block).withColumn("__f", F.when(failure, 1).otherwise(0).cast("bigint"))
    inside = Window.partitionBy(key, "__blk").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumn("__fails", F.sum("__f").over(inside))
    local = local.withColumn("__set", F.when(success, passes.cast("bigint") - F.col("__fails")))
    totals = local.groupBy(key, "__blk").agg(
        F.sum("__f").alias("__f0"), F.max_by("__set", F.when(F.col("__set").isNotNull(), place(seq))).alias("set")
    )
    fails = sums_before(totals, [key], ["__f0"], levels(block))
    sets = totals.select(key, "__blk", "set").join(fails, [key, "__blk"]).withColumn("__s0", F.col("set") - F.col("__f0"))
    earlier = fails.join(last_before(sets.select(key, "__blk", "__s0"), [key], "__s0", levels(block)), [key, "__blk"])
    local = local.withColumn("__last", F.last("__set", ignorenulls=True).over(inside))
    joined = local.join(earlier, [key, "__blk"])
    start = F.coalesce(F.col("__last"), F.col("__s0") + F.col("__f0"), F.col("__f0"))
    return joined.withColumn(name, start + F.col("__fails")).drop("__blk", "__f", "__fails", "__set", "__last", "__f0", "__s0")


def escalation_step(passes: Column, tier: Column, visual_ok: Column, wants_visuals: Column, complete: Column,
                    carousel: Column, can_densify: Column, limit: int = C.MAX_PASSES) -> Column:
    """What follows one summary pass: 'stop', 'visual', 'accept', 'retry' or 'densify'."""
    return (
        F.when(passes >= limit, "stop")
        .when((tier < 3) & visual_ok & wants_visuals, "visual")
        .when(complete, "accept")
        .when(carousel, "retry")
        .when(can_densify, "densify")
        .otherwise("stop")
    )


def escalation_passes(items: DataFrame, summarize, limit: int = C.MAX_PASSES, store=None) -> DataFrame:
    """Run at most ``limit`` summary passes; only items still pending enter the next pass.

    ``items`` carries ``tier, visual_ok, carousel, dense``; ``summarize(df, n)`` adds
    ``found, complete, wants_visuals``. ``store(df, name)`` must write a pass once (it is paid
    work) and return the written table.
    """
    from linkshelf.session import materialize

    store = store or materialize
    finished = None
    pending = items
    for n in range(1, limit + 1):
        step = escalation_step(
            F.lit(n), F.col("tier"), F.col("visual_ok"), F.col("wants_visuals"), F.col("complete"),
            F.col("carousel"), ~F.col("dense"), limit,
        )
        done = store(summarize(pending, n).withColumn("step", step).withColumn("passes", F.lit(n)), f"pass{n}")
        ended = done.filter(F.col("step").isin("stop", "accept"))
        finished = ended if finished is None else union_all(finished, ended)
        again = done.filter(~F.col("step").isin("stop", "accept"))
        pending = again.withColumns({
            "tier": F.when(F.col("step") == "visual", 3).otherwise(F.col("tier")),
            "dense": F.col("dense") | (F.col("step") == "densify"),
        }).select(*items.columns)
    return finished


def duration_seconds(raw: Column) -> dict[str, Column]:
    """``seconds`` of a reported duration, 0 where it is no number, and whether the item is too long to be analysed."""
    seconds = F.coalesce(raw.try_cast("double"), F.lit(0.0))
    return {"seconds": seconds, "rejected": seconds > C.MAX_VIDEO_SECONDS}


def run_summary(state: DataFrame, keys: list[str]) -> DataFrame:
    """Counters of a run from its state rows ``(status, attempts)``, and requests for each analysed item."""
    s = F.col("status")
    analyzed = F.count_if(s.isin("done", "needs-review"))
    return state.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("scanned"), analyzed.alias("analyzed"), F.count_if(s == "unavailable").alias("unavailable"),
        F.count_if(s == "failed-retryable").alias("retryable"), F.count_if(s == "needs-review").alias("needs_review"),
        F.count_if(s == "manual-review").alias("manual_review"), F.count_if(F.col("attempts") == 0).alias("tier_metadata"),
        F.count_if(F.col("attempts") == 3).alias("tier_visual"), (F.sum("attempts").cast("double") / F.nullif(analyzed, F.lit(0))).alias("per_item"),
    )


def review_rate(items: DataFrame, keys: list[str], manual: Column) -> DataFrame:
    """Items, items left to a person, and their share."""
    return items.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("items"), F.count_if(manual).alias("manual"), (F.count_if(manual) / F.count(F.lit(1))).alias("rate")
    )
