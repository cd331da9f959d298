"""Re-analysis of stored cards: what is skipped, asked, given up or left, and what each of it writes.

Cards are asked in waves along ``seq``. A wave's passes are written as they are paid for, then the spend caps are applied to
all calls so far in the order of one card after the other. The card whose call crosses a cap, and every later one, is left for
another run; cards with a stored analysis pass all the same. So results are those of a run card by card, and at most the
rest of one wave is asked beyond a cap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkshelf import constants as C
from linkshelf.operators import budget, quality
from linkshelf.operators.ordered import row_numbers
from linkshelf.operators.sets import union_all
from linkshelf.session import materialize

_CALL = "struct<n:int,est_tokens:bigint,in_tokens:bigint,out_tokens:bigint>"
_CARRIED = ("seq", "url", "name", "attempts_before")


def _summarized(summarize: Callable[[DataFrame, int], DataFrame]):
    """``summarize`` with its calls noted, failed visual passes remembered, and a failed call ending its card."""

    def run(items: DataFrame, n: int) -> DataFrame:
        rows = summarize(items, n)
        fine = F.col("error").isNull()
        call = F.struct(F.lit(n).alias("n"), *[F.col(c).cast("bigint").alias(c) for c in ("est_tokens", "in_tokens", "out_tokens")])
        unseen = fine & F.col("wants_visuals") & (F.col("tier") < 3) & ~F.col("visual_ok") & F.lit(n < C.MAX_PASSES)
        return rows.withColumns({
            "calls": F.array_append("calls", call), "visual_failed": F.col("visual_failed") | unseen,
            "complete": ~fine | F.col("complete"), "wants_visuals": fine & F.col("wants_visuals"),
        })

    return run


def reanalysed(
    work: DataFrame, summarize: Callable[[DataFrame, int], DataFrame], merge: Callable[[DataFrame], DataFrame], *,
    price_in: float | None, price_out: float | None, run_cap: float | None = None, total_cap: float | None = None, spent_before: float = 0.0,
    first: int = 64, growth: int = 4,
) -> DataFrame:
    """One row per card of ``work``: its ``outcome`` ('skipped', 'left', 'failed' or 'analysed'), status and analysis.

    ``work`` has ``seq`` (whole, unique), ``url, name, skip, attempts_before``, what fetching gave (``fetch``: 'ok', 'permanent'
    or 'transient', and ``fetch_error``), ``tier, visual_ok, carousel`` and what ``summarize(rows, n)`` needs. That adds
    ``complete, wants_visuals, error`` and ``est_tokens, in_tokens, out_tokens`` of the pass, and the analysis: ``category,
    confidence, media_shape, found``. ``merge`` adds ``flagged`` and may change the analysis.
    """
    work = materialize(work, "work")
    asked = work.filter(~F.col("skip") & (F.col("fetch") == "ok")).withColumns({
        "dense": F.lit(False), "visual_failed": F.lit(False), "calls": F.array().cast(f"array<{_CALL}>")})
    numbered = materialize(row_numbers(asked, [], "seq", "__number"), "numbered")
    total, done, size, waves, stop = numbered.agg(F.max("__number")).first()[0] or 0, 0, first, [], None
    while not waves or (done < total and stop is None):
        wave = numbered.filter((F.col("__number") > done) & (F.col("__number") <= done + size)).drop("__number")
        waves.append(quality.escalation_passes(wave, _summarized(summarize)))
        stop = _crossing(union_all(*[w.select("seq", "calls") for w in waves]), price_in, price_out, run_cap, total_cap, spent_before)
        done, size = done + size, size * growth
    passed = F.lit(True) if stop is None else F.col("seq") < stop

    answered = merge(union_all(*waves).filter(passed))
    failed, complete = F.col("error").isNotNull(), F.col("complete") & ~F.col("visual_failed")
    attempts = F.when(failed, F.col("attempts_before") + 1).otherwise(F.col("passes"))
    analysed = answered.select(
        *_CARRIED, F.when(failed, "failed").otherwise("analysed").alias("outcome"),
        quality.terminal_status(failed, attempts, complete, F.col("flagged")).alias("status"), attempts.alias("attempts"),
        F.col("error").alias("detail"), F.lit(None).cast("int").alias("tries"),
        *[F.when(~failed, F.col(c)).alias(c) for c in ("category", "confidence", "media_shape", "found", "tier", "passes")])

    transient = F.col("fetch") == "transient"
    tries = F.when(transient, F.col("attempts_before") + 1)
    gone = work.filter(~F.col("skip") & (F.col("fetch") != "ok") & passed).select(
        *_CARRIED, F.lit("failed").alias("outcome"),
        F.when(transient & (tries < C.MAX_ATTEMPTS), "failed-retryable").otherwise("unavailable").alias("status"),
        F.coalesce(tries, "attempts_before").alias("attempts"), F.col("fetch_error").alias("detail"), tries.alias("tries"))
    skipped = work.filter("skip").select(*_CARRIED, F.lit("skipped").alias("outcome"))
    left = work.filter(~F.col("skip") & ~passed).select(*_CARRIED, F.lit("left").alias("outcome"))
    rest = gone.unionByName(skipped, allowMissingColumns=True).unionByName(left, allowMissingColumns=True)
    return materialize(analysed.unionByName(rest, allowMissingColumns=True), "reanalysed")


def _crossing(calls: DataFrame, price_in, price_out, run_cap, total_cap, spent_before) -> int | None:
    """``seq`` of the first card with a call over a cap, calls in the order of cards and passes."""
    if price_in is None or price_out is None or (run_cap is None and total_cap is None):
        return None
    rows = calls.select("seq", F.explode("calls").alias("c")).select(
        (F.col("seq") * (C.MAX_PASSES + 1) + F.col("c.n")).alias("call"), "seq", "c.est_tokens", "c.in_tokens", "c.out_tokens", F.lit(False).alias("cached"))
    cut = budget.spend_cut(rows, "call", price_in, price_out, run_cap=run_cap, total_cap=total_cap, spent_before=spent_before)
    return cut.filter("crosses").agg(F.min("seq")).first()[0]


def states(outcomes: DataFrame, version: str = C.PROMPT_VERSION) -> DataFrame:
    """State log rows of a run; what was skipped or left has none."""
    told = outcomes.filter(F.col("outcome").isin("analysed", "failed"))
    return told.select("url", "status", F.lit(version).alias("prompt_version"), "attempts", F.col("detail").alias("last_error"))


def payloads(outcomes: DataFrame, run: int, version: str = C.PROMPT_VERSION) -> DataFrame:
    """What the run adds to the cache, as ``writers.cache_rows`` takes it; ``run`` numbers its version."""
    stored = F.to_json(F.struct("category", "confidence", "media_shape", "found", "passes"))
    return outcomes.filter(F.col("outcome") == "analysed").select(
        "url", F.lit(run).cast("bigint").alias("version"), F.lit(version).alias("prompt_version"), stored.alias("payload"))


def updates(outcomes: DataFrame, stored: DataFrame, latest: DataFrame) -> DataFrame:
    """Cards to rewrite: those of this run, and skipped ones with a stored analysis ``stored(url, category)`` under their latest status."""
    new = outcomes.filter(F.col("outcome") == "analysed").select("url", "category", "status", F.lit("new").alias("origin"))
    known = outcomes.filter(F.col("outcome") == "skipped").select("url").join(stored.select("url", "category"), "url")
    before = latest.select("url", "status")
    return union_all(new, known.join(before, "url").select("url", "category", "status", F.lit("stored").alias("origin")))
