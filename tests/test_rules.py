import json
import random

import pytest
from pyspark.sql import functions as F

from linkshelf.functions import cards as K
from linkshelf.operators import extraction, budget, catalog, migrations, quality, registry, routing, scoring, transcripts


def one(df):
    return df.first().asDict(recursive=True)


# --- gates ------------------------------------------------------------------------------------

GATE = "carousel boolean, words int, ratio double, hint string, analyzed boolean, expected int, found int, flag boolean, title string, source string, p double"


@pytest.mark.parametrize("row, reasons", [
    ((True, 200, None, None, False, None, 0, False, "x", "captions", None), ["carousel/photo post"]),
    ((False, 3, 0.1, None, False, None, 0, False, "x", "whisper", None), ["transcript 3 words < 25", "speech ratio 0.10 < 0.2"]),
    ((False, 60, 0.9, None, False, None, 0, False, "my favorite songs", "whisper", None), ["list claim with little speech"]),
    ((False, 60, 0.9, None, False, None, 0, False, "my favorite songs", "captions", None), []),
    ((False, 300, 0.9, None, False, None, 0, False, "top 10 places", "whisper", None), []),
    ((False, 300, 0.9, None, True, 10, 6, True, "top 10 places", "whisper", None),
     ["list claims 10 items, text found 6", "summarizer flagged on-screen-only content"]),
    ((False, 300, None, "gap", True, 0, 0, False, "x", "captions", 0.5), ["completeness retry: gap", "jev needs_visuals=0.50"]),
])
def test_visual_gate(spark, row, reasons):
    c = F.col
    out = quality.visual_reasons(
        carousel=c("carousel"), words=c("words"), speech_ratio=c("ratio"), retry_hint=c("hint"), has_analysis=c("analyzed"), expected=c("expected"),
        items=c("found"), self_flag=c("flag"), title=c("title"), caption=F.lit(""), source=c("source"), probability=c("p"),
    )
    assert spark.createDataFrame([row], GATE).select(out.alias("r")).first()["r"] == reasons


@pytest.mark.parametrize("claimed, slides, shape, images, seen, actual, expected", [
    (10, None, "standard_video", 0, 0, 6, 10), (None, 8, "slideshow_video", 0, 0, 3, 8), (None, 100, "slideshow_video", 0, 0, 3, None),
    (None, 8, "standard_video", 0, 0, 3, None), (None, None, "carousel_images", 5, 0, 5, 5), (None, None, "standard_video", 0, 4, 4, None),
    (0, None, "standard_video", 0, 7, 4, 7),
])
def test_expected_count(spark, claimed, slides, shape, images, seen, actual, expected):
    df = spark.createDataFrame([(claimed, slides, shape, images, seen, actual)], "a int, b int, c string, d int, e int, f int")
    assert df.select(quality.expected_count(*[F.col(x) for x in "abcdef"]).alias("n")).first()["n"] == expected


@pytest.mark.parametrize("expected, actual, missing, complete, hint", [
    (10, 6, [], False, "Expected at least 10 items but got 6."), (10, 6, [3, 4], False, "Missing list positions: [3, 4]"),
    (5, 5, [2], False, "Missing list positions: [2]"), (None, 3, [], True, None), (3, 4, [], True, None),
])
def test_completeness(spark, expected, actual, missing, complete, hint):
    df = spark.createDataFrame([(expected, actual, missing)], "e int, a int, m array<bigint>")
    ok, text = quality.completeness(F.col("e"), F.col("a"), F.col("m"))
    assert df.select(ok.alias("ok"), text.alias("text")).first()[:] == (complete, hint)


def test_batch_of_hundred_has_one_manual_review(spark):
    rows = [(False, 1, True, False)] * 90 + [(False, 1, False, False)] * 8 + [(True, 1, False, False), (True, 3, False, False)]
    df = spark.createDataFrame(rows, "failed boolean, attempts int, complete boolean, flagged boolean")
    status = quality.terminal_status(*[F.col(c) for c in df.columns])
    counts = {r["s"]: r["count"] for r in df.groupBy(status.alias("s")).count().collect()}
    assert counts == {"done": 90, "needs-review": 8, "failed-retryable": 1, "manual-review": 1}


# --- classifier --------------------------------------------------------------------------------

MERGE = (
    "category string, secondary array<string>, recategorize boolean, relevance double, content_tags array<string>, media_shape string, "
    "c_present boolean, c_category string, c_confidence double, c_shape string, c_shape_confidence double, c_relevance double, c_tags array<string>"
)


@pytest.mark.parametrize("present, category, confidence, want", [
    (True, "Travel", 0.9, ("Travel", ["Tips"], True, False)), (True, "Travel", 0.4, ("Tips", [], False, True)),
    (True, "Tips", 0.2, ("Tips", [], False, False)), (True, "Invented", 0.99, ("Tips", [], False, False)), (False, None, None, ("Tips", [], False, False)),
])
def test_merge_classifier(spark, present, category, confidence, want):
    row = ("Tips", [], False, None, [], "standard_video", present, category, confidence, "silent_video", 0.8, 4.0, ["music"])
    out = one(scoring.merged_classification(spark.createDataFrame([row], MERGE)))
    assert (out["category"], out["secondary"], out["recategorize"], out["flagged"]) == want
    assert out["relevance"] == (4.0 if present else None)
    assert out["media_shape"] == ("silent_video" if present else "standard_video")


def test_answers_tolerate_missing_keys(spark):
    text = json.dumps({"category": {"choice": "Travel", "confidence": 0.8}, "tag::music": {"noul": 0.5}, "tag::news": {"noul": 0.49}, "relevance": {"score": 3}})
    out = one(spark.createDataFrame([(text,)], "t string").select(scoring.parsed_answers(F.col("t")).alias("r")))["r"]
    assert out == {"category": "Travel", "category_confidence": 0.8, "media_shape": None, "media_shape_confidence": 0.0, "relevance": 3.0, "tags": ["music"], "needs_visuals": None}


@pytest.mark.parametrize("text, problem", [
    ("", "empty"), (None, "empty"), ("{", "invalid"), ("[]", "invalid"), ('{"results":[{"i":0,"cat":"Tips"}]}', "invalid"),
    ('{"results":[{"i":"x","cat":"Tips","summ":"s"}]}', "invalid"), ('{"results":[]}', None), ('{"results":[{"i":0,"cat":"Tips","summ":"s"}]}', None),
])
def test_response_validation(spark, text, problem):
    assert scoring.validated(spark.createDataFrame([(text,)], "response string")).first()["problem"] == problem


def test_reconcile_defaults_duplicates_and_extras(spark):
    packed = spark.createDataFrame([(0, 0, i, f"u{i}") for i in range(3)], "block bigint, batch bigint, i int, url string")
    text = json.dumps({"results": [
        {"i": 0, "cat": "Tips", "summ": "a"}, {"i": 2, "cat": "x", "summ": "b"}, {"i": 2, "cat": "Travel", "summ": "c"}, {"i": 9, "cat": "Tips", "summ": "d"},
    ]})
    answered = scoring.answers(scoring.validated(spark.createDataFrame([(0, 0, text)], "block bigint, batch bigint, response string")))
    got = {r.url: (r.category, r.summary) for r in scoring.reconciled(packed, answered).collect()}
    assert got == {"u0": ("Tips", "a"), "u1": ("Miscellaneous", "No summary"), "u2": ("Travel", "c")}


def test_failing_scorer_keeps_its_batch_and_later_ones(spark):
    batches = spark.createDataFrame([(0, n, str(n)) for n in range(4)], "block bigint, batch bigint, payload string")

    def scorer(payload):
        if payload == "2":
            raise RuntimeError("quota")
        return "{}"

    staged = scoring.stop_at_first_failure(scoring.score_batches(batches, scorer), F.col("error").isNotNull())
    assert {r.batch for r in staged.filter("committed").collect()} == {0, 1}


# --- routing ---------------------------------------------------------------------------------------

@pytest.mark.parametrize("travel, confidence, found, stage", [
    (True, 0.9, True, "mapped"), (True, 0.9, False, "unmapped-travel"), (True, 0.49, True, "manual-review"), (False, 0.9, True, "manual-review"),
])
def test_travel_route(evaluate, travel, confidence, found, stage):
    assert evaluate(routing.travel_stage, travel, confidence, found) == stage


@pytest.mark.parametrize("category, usable, want", [
    ("Music", True, ("Music", "Saved Music", None)), ("Fitness & Health", True, ("Fitness & Health", "Fitness & Health", "ready")),
    ("Movies & Shows", True, ("Movies & Shows", "Movies & Shows", "to-watch")), ("Invented", True, ("Inbox", "Miscellaneous", None)),
    ("Recipes & Food", False, ("Inbox/Manual Review", "Recipes & Food", "manual-review")), ("Invented", False, ("Inbox/Manual Review", "Miscellaneous", "manual-review")),
])
def test_placement(spark, category, usable, want):
    cols = routing.placement(F.col("c"), F.col("u"))
    df = spark.createDataFrame([(category, usable)], "c string, u boolean")
    assert df.select(cols["folder"].alias("f"), cols["label"].alias("l"), cols["stage"].alias("s")).first()[:] == want


def test_human_status_is_never_reset(spark):
    cols = routing.guarded(F.col("s"), F.col("g"), F.lit("ready"))
    df = spark.createDataFrame([("Kept", "x"), ("ready", "x"), (None, None)], "s string, g string")
    assert [r[:] for r in df.select(cols["status"].alias("s"), cols["stage"].alias("g")).collect()] == [("Kept", "x"), ("inbox", "ready"), ("inbox", "ready")]


# --- budget -------------------------------------------------------------------------------------------

def test_cap_is_not_enforced_without_prices(spark):
    work = spark.createDataFrame([(i, False, 10**9, 10**9, 0) for i in range(3)], "seq bigint, cached boolean, est_tokens bigint, in_tokens bigint, out_tokens bigint")
    assert budget.spend_cut(work, "seq", None, 2.0, run_cap=0.01, total_cap=None).filter("not runs").isEmpty()


def test_one_crossing_stops_every_later_paid_call(spark):
    work = spark.createDataFrame(
        [(0, False, 10, 1_000_000, 0), (1, False, 5_000_000, 0, 0), (2, True, 0, 0, 0), (3, False, 1, 0, 0)],
        "seq bigint, cached boolean, est_tokens bigint, in_tokens bigint, out_tokens bigint",
    )
    rows = budget.spend_cut(work, "seq", 1.0, 0.0, run_cap=2.0, total_cap=None).orderBy("seq").collect()
    assert [r.runs for r in rows] == [True, False, True, False]


def test_keys_fill_in_order(spark):
    usage = spark.createDataFrame([("a", 8, False), ("b", 0, True), ("c", 7, False)], "key string, requests bigint, exhausted boolean")
    rows = budget.allocated(spark.range(0, 7).withColumnRenamed("id", "seq"), "seq", budget.key_capacity(usage, 10, 0), block=2)
    assert [r.key for r in rows.orderBy("seq").collect()] == ["a", "a", "c", "c", "c", None, None]


def test_minute_window_includes_its_lower_bound(spark):
    log = spark.sql("SELECT 'k' AS key, timestamp_seconds(s) AS ts, 1L AS in_tokens FROM VALUES (0), (59), (60), (61), (121) t(s)")
    rows = budget.minute_load(log, 2, None).orderBy("ts").collect()
    assert [(r.requests, r.over_limit) for r in rows] == [(1, False), (2, False), (3, True), (3, True), (2, False)]


# --- registry -------------------------------------------------------------------------------------------

def test_ledger_append_twice_adds_nothing(spark, tmp_path):
    from linkshelf.sources import writers

    events = spark.createDataFrame([("u", "carded"), ("u", "carded"), ("u", "tossed"), ("v", "carded")], "url string, event string")
    path = str(tmp_path / "ledger")
    for _ in range(2):
        writers.append_events(events, path, "url string, event string")
    assert spark.read.parquet(path).count() == 3


def test_manual_review_uses_whole_keys(spark):
    failures = spark.createDataFrame([("https://a/1", "n", "x  \n y", 1), ("https://a/12", "m", "r" * 400, 2)], "url string, name string, reason string, seq int")
    listed = spark.createDataFrame([("https://a/12",)], "url string")
    rows = registry.manual_review_lines(failures, listed).collect()
    assert [(r.url, r.reason) for r in rows] == [("https://a/1", "x y")]


# --- catalogue ----------------------------------------------------------------------------------------------

def test_reweighted_only_changed_rows(spark):
    rows = [(1, "Rome", 2, "#42A5F5"), (2, "Rome ", 9, "x"), (3, "", 0, "x"), (4, "Oslo", 1, "#42A5F5")]
    got = catalog.reweighted(spark.createDataFrame(rows, "id int, location_name string, weight int, color string")).collect()
    assert [(r.id, r.new_weight, r.new_color) for r in got] == [(2, 2, "#42A5F5")]
    schema = "id int, name string, location_name string, weight int, color string, lat double, lon double"
    rows = [(1, "a.md", "Rome", None, None, None, None), (2, "Rome Hub.md", "Rome", 0, "x", None, None), (3, "b.md", "Oslo", 3, "x", 1.0, 2.0),
            (4, "Map.md", "Oslo", 0, "x", None, None), (5, "c.md", "Nowhere", 0, "x", None, None)]
    places = spark.createDataFrame([("rome ", 41.9, 12.5), ("Oslo", 59.9, 10.7), ("nowhere", 95.0, 0.0)], "place string, lat double, lon double")
    got = catalog.reweighted(spark.createDataFrame(rows, schema), places).collect()
    assert sorted((r.id, r.new_weight, r.lat, r.lon) for r in got if r.id != 5) == [(1, 1, 41.9, 12.5), (3, 1, 1.0, 2.0)]
    assert [(r.new_weight, r.lat) for r in got if r.id == 5] == [(1, None)]


def test_migration_moves_pipeline_words(spark):
    schema = "status string, stage string, category string, tags array<string>"
    rows = [("To Watch", None, "Music", ["old", "category/a/b"]), ("kept", "ready", "Tips", ["saved-media"]), ("ready", "ready", "Tips", [])]
    got = migrations.migrated_cards(spark.createDataFrame(rows, schema), {"old": "saved-media"}).collect()
    assert [(r.new_status, r.new_stage, r.new_category, r.new_tags, r.changed) for r in got] == [
        ("inbox", "to-watch", "Saved Music", ["saved-media", "category/a-b"], True), ("kept", "ready", "Tips", ["saved-media"], False), ("inbox", "ready", "Tips", [], True),
    ]


@pytest.mark.parametrize("fm, changed", [
    ({}, ["status", "summary", "location", "location_name", "weight", "mapMarkerColor"]),
    ({"status": "kept", "summary": "s", "location": "", "location_name": "", "weight": "3", "mapMarkerColor": "#FFA726"}, []),
])
def test_travel_backfill(spark, fm, changed):
    df = spark.createDataFrame([(fm, None, "> **Summary:** from body\n")], "fm map<string,string>, tags array<string>, body string")
    row = migrations.backfilled_travel(df).first()
    assert row.changed_keys == changed
    assert row.new_fm["weight"] == fm.get("weight", "0")
    assert row.new_fm["summary"] == fm.get("summary", "from body")


def test_map_point_accepts_both_forms(evaluate):
    assert evaluate(catalog.map_point, "[35.6595, 139.7004]")[:] == (35.6595, 139.7004)
    assert evaluate(catalog.map_point, "35.5,-120")[:] == (35.5, -120.0)
    assert evaluate(catalog.map_point, "Shibuya, Tokyo") is None
    assert evaluate(catalog.map_point, "[135.0, 10]") is None


def test_status_filters_keep_missing_values(spark):
    rows = [("Tips", "a.md", None, None), ("Tips/x", "b.md", "tossed", None), ("Tips2", "c.md", "inbox", None), ("Tips", "Tips Hub.md", None, None)]
    df = spark.createDataFrame(rows, "folder string, name string, status string, stage string").withColumn("ctime", F.current_timestamp())
    assert [r.name for r in catalog.folder_list(df, "Tips").collect()] == ["a.md"]


def test_travel_card_text(spark):
    row = spark.range(1).select(K.travel_card(
        category=F.lit("Travel"), title=F.lit("T"), creator=F.lit(""), url=F.lit("u"), summary=F.lit("S"), destination=F.lit("Rome"), location_name=F.lit("Rome, Italy"),
        stage=F.lit("mapped"), confidence=F.lit(0.9), lat=F.lit(41.9), lon=F.lit(12.5), address=F.lit(""),
    ).alias("c")).first()["c"]
    assert row == (
        '---\ncategory: "Travel"\ncreator: "Unknown"\nurl: "u"\nstatus: "inbox"\nstage: "mapped"\nconfidence: 0.9\nsummary: "S"\ndestination: "Rome"\n'
        'location_name: "Rome, Italy"\nweight: 0\nmapMarkerColor: "#9E9E9E"\nlocation: [41.900000, 12.500000]\ntags:\n  - saved-media\n  - category/travel\n  - travel/mapped\n---\n\n'
        "# T\n\n> **Summary:** S\n\n- **Creator:** @Unknown\n- **Source Link:** [u](u)\n- **Destination:** Rome\n\n## Notes\nS\n"
    )


# --- transcripts ---------------------------------------------------------------------------------------------

VTT = """WEBVTT
Kind: captions

1
00:00:00.000 --> 00:00:02.000
<c>hello</c> world

00:00:02.000 --> 00:00:04.000
hello world

00:00:15.000 --> 00:00:17.000
second part
"""


def test_vtt_text(evaluate):
    assert evaluate(transcripts.vtt_text, VTT) == "[0:00] hello world [0:15] second part"


def test_json3_text(evaluate):
    raw = json.dumps({"events": [
        {"tStartMs": 0, "segs": [{"utf8": "hi "}, {"utf8": "there"}]}, {"tStartMs": 500}, {"tStartMs": 12000, "segs": [{"utf8": "\n"}]}, {"tStartMs": 12500, "segs": [{"utf8": "bye"}]},
    ]})
    assert evaluate(transcripts.json3_text, raw) == "[0:00] hi there [0:12] bye"
    assert evaluate(transcripts.json3_text, "nope") == ""


def test_segments_to_text_and_ratio(spark):
    rows = [("c", 0, 0.0, 2.0, " hello ", 0.1, -0.2, 10.0), ("c", 1, 2.0, 4.0, "Thanks for watching!", 0.9, -1.5, 10.0), ("c", 2, 11.0, 12.5, "bye", 0.7, -0.3, 10.0)]
    segments = spark.createDataFrame(rows, "clip string, seq int, start_s double, end_s double, text string, no_speech double, logprob double, duration double")
    assert transcripts.speech_ratio(segments).first()["speech_ratio"] == 0.35
    spoken = transcripts.speech_only(segments).withColumn("text", F.trim("text"))
    marked = transcripts.with_markers(spoken, "clip", "seq", "start_s")
    assert transcripts.transcript_chunks(marked, "clip", "seq", "text").first()["text"] == "[0:00] hello [0:11] bye"


def test_track_order(spark):
    tracks = [("manual", "fr", "vtt"), ("auto", "en", "json3"), ("auto", "en-orig", "vtt"), ("manual", "eng-US", "vtt"), ("manual", "live_chat", "vtt"), ("auto", "en-orig", "srv1")]
    df = spark.createDataFrame([("v", b, lang, e, 0, f"{b}-{lang}") for b, lang, e in tracks], "video string, bucket string, lang string, ext string, entry int, track_url string")
    got = transcripts.ranked_tracks(df).orderBy("rank").collect()
    assert [r.track_url for r in got] == ["manual-eng-US", "auto-en-orig", "auto-en"]


def test_a_url_is_dispatched_once_in_a_run(spark):
    from linkshelf.operators import routing

    lines = [(1, "u", True, False, "transient"), (2, "u", True, False, "ok"), (3, "u", True, False, "ok"), (4, "u", True, False, "transient"),
             (5, "v", True, True, "ok"), (6, None, False, False, "ok"), (7, None, False, False, "ok"), (8, "w", True, False, "permanent")]
    df = spark.createDataFrame(lines, "seq int, url string, valid boolean, seen boolean, fetch string")
    got = {r.seq: r.known for r in routing.known_in_run(df, "seq", F.col("fetch") != "transient").collect()}
    assert got == {1: False, 2: False, 3: True, 4: True, 5: True, 6: False, 7: False, 8: False}


def test_a_cleared_cache_shows_later_versions_only(spark):
    from linkshelf.sources import writers

    urls = spark.createDataFrame([("https://a/1",), ("https://a/2",)], "url string")
    rows = lambda n: writers.cache_rows(urls.select("url", F.lit(n).cast("bigint").alias("version"), F.lit("2").alias("prompt_version"),
                                                    F.lit(f"v{n}").alias("payload")), "info")
    cache = rows(7).unionAll(rows((1 << 41) + 5))
    cleared = cache.unionAll(writers.cleared(urls.filter("url like '%1'"), ["info", "transcript"], cache))
    assert {r.payload for r in writers.latest_cache(cleared).collect()} == {f"v{(1 << 41) + 5}"} and writers.latest_cache(cleared).count() == 1
    later = cleared.unionAll(rows((1 << 41) + 6))
    assert [r.payload for r in writers.latest_cache(later).collect()] == [f"v{(1 << 41) + 6}"] * 2


def test_answers_are_paid_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def scorer(payload, fails=()):
        (calls / f"{payload}-{len(list(calls.iterdir()))}").touch()
        if payload in fails:
            raise ValueError("quota")
        return f"answer {payload}"

    batches = spark.createDataFrame([(0, i, f"p{i}") for i in range(6)], "block bigint, batch bigint, payload string").coalesce(1)
    store = str(tmp_path / "paid")
    first = scoring.scored_once(batches, lambda p: scorer(p, ("p2",)), store)
    staged = scoring.stop_at_first_failure(first, F.col("error").isNotNull())
    assert sorted(r.batch for r in staged.filter("committed").collect()) == [0, 1]
    asked = sorted(f.name.split("-")[0] for f in calls.iterdir())
    assert asked == [f"p{i}" for i in range(6)]
    second = scoring.scored_once(batches, scorer, store)
    assert {r.payload: r.response for r in second.collect()} == {f"p{i}": f"answer p{i}" for i in range(6)}
    assert sorted(f.name.split("-")[0] for f in calls.iterdir()) == sorted(asked + ["p2"])  # only the failed one again


@pytest.mark.parametrize("failing, asked", [(None, 40), (1, 2), (5, 6), (13, 14), (38, 40)])
def test_nothing_is_asked_in_waves_after_a_failure(spark, tmp_path, failing, asked):
    calls = tmp_path / "calls"
    calls.mkdir()

    def scorer(payload, fails=failing):
        n = int(payload)
        (calls / f"{n}-{len(list(calls.iterdir()))}").touch()
        if n == fails:
            raise RuntimeError("quota")
        return '{"results": []}'

    batches = spark.createDataFrame([(n // 7, n % 7, str(n)) for n in range(40)], "block bigint, batch bigint, payload string").coalesce(1)
    store = str(tmp_path / "paid")
    first = scoring.scored_in_waves(batches, scorer, store, first=2, growth=2)
    assert sorted(int(r.payload) for r in first.collect()) == list(range(asked))
    assert sorted(int(f.name.split("-")[0]) for f in calls.iterdir()) == list(range(asked))  # one call a batch, none behind the wave
    staged = scoring.stop_at_first_failure(first, F.col("error").isNotNull())
    assert staged.filter("committed").count() == (40 if failing is None else failing)
    again = scoring.scored_in_waves(batches, lambda p: scorer(p, None), store, first=2, growth=2)
    assert again.count() == 40 and len(list(calls.iterdir())) == (40 if failing is None else 41)  # the failed one twice, no other


def test_typed_records_from_one_call_a_batch(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    kinds = ["travel", "actionable", "enrichment", "travel", "actionable", "enrichment", "travel", "travel"]
    packed = spark.createDataFrame(
        [(0, i // 4, i % 4, k, f"title {i}", None, None) for i, k in enumerate(kinds)] + [(0, 2, 0, "travel", "x", "", ["a"]), (0, 3, 0, "travel", "y", "", [])],
        "block bigint, batch bigint, i int, kind string, title string, description string, tags array<string>").coalesce(1)
    place = {"is_travel_related": True, "place_name": "Rome", "summary": "s", "confidence": 1}
    told = {
        "title 0": [{"item_id": "0", "kind": "travel", **place, "confidence": 7}, {"item_id": "0", "kind": "travel", **place}],
        "title 1": [{"item_id": "1", "kind": "actionable", "summary": "s", "actionable_items": ["a", "b"], "confidence": 0.2, "needs_manual_review": True}],
        "title 2": [{"item_id": "2", "kind": "enrichment", "category": "Tech & Coding", "summary": "s", "confidence": 9.5, "needs_manual_review": False}],
        "title 3": [{"item_id": "3", "kind": "actionable", **place}],
        "title 4": [{"item_id": "0", "kind": "actionable", "summary": "s", "confidence": 0.2, "needs_manual_review": "perhaps"}],
        "title 5": [{"item_id": "1", "kind": "enrichment", "category": "Cooking", "summary": "s", "confidence": 0.5, "needs_manual_review": False}],
        "title 6": [{"item_id": "2", "kind": "travel", **place, "summary": None}, {"item_id": "77", "kind": "travel", **place}, "junk"],
        "title 7": [],
    }

    def scorer(payload):
        items = json.loads(payload)
        (calls / str(len(list(calls.iterdir())))).touch()
        if items[0]["title"] == "x":
            raise RuntimeError("quota")
        return "[1" if items[0]["title"] == "y" else json.dumps({"items": sum((told[item["title"]] for item in items), [])})

    got = extraction.typed_records(packed, scoring.score_batches(extraction.typed_payloads(packed), scorer)).collect()
    assert len(list(calls.iterdir())) == 4 and len(got) == 10
    by = {(r.batch, r.i): r for r in got}
    assert [by[n // 4, n % 4].problem for n in range(8)] == [None, None, None, "kind", "invalid", "invalid", "invalid", "skipped"]
    assert (by[2, 0].problem, by[3, 0].problem) == ("error", "unreadable")
    assert [by[n // 4, n % 4].manual for n in range(4)] == [False, True, False, True] and all(r.manual for r in got if r.batch)
    assert by[0, 0].travel.place_name == "Rome" and by[0, 0].travel.confidence == 1.0 and by[0, 0].actionable is None
    assert by[0, 1].actionable.actionable_items == ["a", "b"] and by[0, 2].enrichment.category == "Tech & Coding"


def test_a_long_caption_payload_is_folded_in_order(evaluate):
    rng = random.Random(2)
    lines, out, mark, shown, at = ["WEBVTT"], [], -10.0, "", 0.0
    for k in range(16_000):
        if k % 2 == 0:
            at = k * 1.5
            lines.append(f"{int(at) // 3600:02d}:{int(at) // 60 % 60:02d}:{at % 60:06.3f} --> x")
        else:
            text = f"w{rng.randrange(3)}"
            lines.append(f"<b>{text}</b>")
            if text != shown:
                if at - mark >= 10.0:
                    out.append(f"[{int(at) // 60}:{int(at) % 60:02d}]")
                    mark = at
                out.append(text)
                shown = text
    assert evaluate(lambda c: transcripts.vtt_text(c, 10.0), "\n".join(lines)) == " ".join(out)


def test_answers_leave_a_worker_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(scoring, "PIECE_CHARS", 1000)
    texts = [None, "", "fail", *["ä" * n for n in range(40, 1200, 60)], "x" * 5000]
    rows = spark.createDataFrame([(n, t, [n]) for n, t in enumerate(texts)], "id bigint, payload string, other array<bigint>").coalesce(1)

    def scorer(value):
        if value == "fail":
            raise ValueError("quota")
        return None if value is None else f"{len(value)}:{value}"

    def told(value):
        return (None, "ValueError: quota") if value == "fail" else (scorer(value), None)

    got = scoring.score_batches(rows, scorer)
    assert got.columns == ["id", "payload", "other", "response", "error"]
    assert sorted((r.id, r.payload, r.other, r.response, r.error) for r in got.collect()) == [(n, t, [n], *told(t)) for n, t in enumerate(texts)]
    narrow = scoring.score_batches(rows, scorer, keep=["id"])
    assert narrow.columns == ["id", "response", "error"]
    assert sorted((r.id, r.response, r.error) for r in narrow.collect()) == [(n, *told(t)) for n, t in enumerate(texts)]
    assert scoring.score_batches(rows.limit(0), scorer).count() == 0


def test_a_worker_does_not_hold_the_answers_of_an_arrow_batch(spark):
    """500 answers of 100,000 characters are 50 MB; the last row tells the most that Python held at once."""
    rows = spark.range(500, numPartitions=1).select("id", F.when(F.col("id") == 499, "peak").otherwise(F.repeat(F.lit("x"), 10)).alias("payload"))

    def scorer(value):
        import tracemalloc

        if not tracemalloc.is_tracing():
            tracemalloc.start()
        if value == "peak":
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            return str(peak)
        return "".join(["a"] * 100_000)

    peak = scoring.score_batches(rows, scorer).filter("payload = 'peak'").first().response
    assert int(peak) < 10_000_000
