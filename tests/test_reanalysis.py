"""Re-analysis in waves against a run card by card."""

import random

import pytest
from pyspark.sql import functions as F

from linkshelf.plans import reanalysis

WORK = ("seq bigint, url string, name string, skip boolean, attempts_before int, fetch string, fetch_error string, tier int, visual_ok boolean, "
        "carousel boolean, need int, wants boolean, fails_at int, tokens int, flagged boolean")


def rows(n=60, seed=5):
    r = random.Random(seed)
    return [
        (i * 10**6, f"u{i}", f"{i}.md", r.random() < 0.2, r.randrange(4), r.choice(["ok"] * 6 + ["permanent", "transient"]), "gone", 1, r.random() < 0.6,
         r.random() < 0.3, r.randrange(4), r.random() < 0.4, r.choice([None] * 6 + [1, 2, 3]), r.randrange(50, 400), r.random() < 0.2)
        for i in range(n)
    ]


def one_by_one(work, cap):
    """``{url: (outcome, status, attempts)}`` of a run that handles a card after the other."""
    spent, stopped, told = 0, False, {}
    for _, url, _, skip, before, fetch, _, tier, visual_ok, carousel, need, wants, fails_at, tokens, flagged in work:
        if skip or stopped:
            told[url] = ("skipped" if skip else "left", None, None)
        elif fetch != "ok":
            tries = before + (fetch == "transient")
            told[url] = ("failed", "failed-retryable" if fetch == "transient" and tries < 3 else "unavailable", tries)
        else:
            n, dense, failed, good = 0, False, False, True
            while True:
                n += 1
                if cap is not None and spent + tokens + 900 > cap:
                    stopped = True
                    break
                spent += tokens + 7 * n
                if fails_at == n:
                    failed = True
                    break
                complete = n > need
                if n == 3:
                    break
                if tier < 3 and good and wants:
                    good = visual_ok
                    if good:
                        tier = 3
                        continue
                if complete:
                    break
                if carousel:
                    continue
                if dense:
                    break
                dense = True
            if stopped:
                told[url] = ("left", None, None)
            elif failed:
                told[url] = ("failed", "manual-review" if before + 1 >= 3 else "failed-retryable", before + 1)
            else:
                told[url] = ("analysed", "done" if complete and good and not flagged else "needs-review", n)
    return told


def run(spark, work, cap, first=4, growth=2):
    asked = []

    def summarize(df, n):
        asked.append(df.count())
        return df.withColumns({
            "error": F.when(F.col("fails_at") == n, "broke"), "complete": F.lit(n) > F.col("need"), "wants_visuals": F.col("wants"), "found": F.lit(n),
            "est_tokens": F.col("tokens"), "in_tokens": F.col("tokens"), "out_tokens": F.lit(7 * n), "category": F.lit("Tips"), "confidence": F.lit(0.5),
            "media_shape": F.lit("music_only")})

    df = spark.createDataFrame(work, WORK).repartition(3)
    out = reanalysis.reanalysed(df, summarize, lambda d: d, price_in=1.0, price_out=1.0, run_cap=None if cap is None else cap / 1e6, first=first, growth=growth)
    return out, asked


@pytest.mark.parametrize("cap", [None, 500, 9_000.5])
def test_as_card_by_card(spark, cap):
    work = rows()
    out, asked = run(spark, work, cap)
    wanted = one_by_one(work, cap)
    assert {r.url: (r.outcome, r.status, r.attempts) for r in out.collect()} == wanted and out.count() == len(work)
    if cap == 500:  # nothing fits: only the first wave was asked, a pass at most thrice
        assert len(asked) == 3 and asked[0] == 4
    told = {u for u, (o, _, _) in wanted.items() if o in ("failed", "analysed")}
    assert {r.url for r in reanalysis.states(out).collect()} == told
    assert {r.url for r in reanalysis.payloads(out, 1).collect()} == {u for u, w in wanted.items() if w[0] == "analysed"}


def test_stored_analyses_pass_after_the_stop(spark):
    work = rows()
    out, _ = run(spark, work, 500)
    stored = spark.createDataFrame([(w[1], "Travel") for w in work[::2]], "url string, category string")
    latest = spark.createDataFrame([(w[1], "done") for w in work], "url string, status string")
    got = {(r.url, r.category, r.status, r.origin) for r in reanalysis.updates(out, stored, latest).collect()}
    assert got == {(w[1], "Travel", "done", "stored") for w in work[::2] if w[3]} and got


def test_nothing_to_do(spark):
    out, _ = run(spark, [], 10.0)
    assert out.collect() == [] and reanalysis.states(out).collect() == []
    skipped, asked = run(spark, [w for w in rows() if w[3]], None)
    assert {r.outcome for r in skipped.collect()} == {"skipped"} and sum(asked) == 0
