"""The same files in one or several micro-batches give the same tables."""

import time

from pyspark.sql import functions as F

from linkshelf.sources import history, readers
from linkshelf.streaming import incremental as INC

LINES = [
    ["https://a.b/1?utm_source=x", "HTTPS://A.B/1/", "bad line"], ["https://a.b/2", "https://a.b/1"], ["https://a.b/3?igsh=1", "bad line", "", "https://a.b/2/"],
]


def drop_files(folder, parts):
    folder.mkdir()
    for n, lines in enumerate(parts):
        (folder / f"{n}.txt").write_text("".join(f"{x}\n" for x in lines))
        time.sleep(0.02)


def run_capture(spark, tmp_path, name, per_batch):
    root = tmp_path / name
    drop_files(tmp_path / f"{name}-in", LINES)
    lines = readers.stream_captures(spark, str(tmp_path / f"{name}-in"), per_batch)
    for _ in range(2):  # a second run finds nothing new
        INC.capture_stream(lines, f"{root}/ledger", f"{root}/invalid", f"{root}/ck").awaitTermination()
    return sorted(r.url for r in spark.read.parquet(f"{root}/ledger").collect())


def test_capture_stream(spark, tmp_path):
    want = ["https://a.b/1", "https://a.b/2", "https://a.b/3"]
    assert run_capture(spark, tmp_path, "one", None) == want
    assert run_capture(spark, tmp_path, "three", 1) == want


def test_attempts_stream(spark, tmp_path):
    log = [("u", 1, "failed-retryable"), ("u", 2, "done"), ("u", 3, "failed-retryable"), ("v", 4, "failed-retryable"), ("u", 5, "unavailable"), ("v", 6, "failed-retryable"), ("v", 7, "failed-retryable")]
    results = []
    for name, cuts, per_batch in (("one", [7], None), ("three", [2, 5, 7], 1)):
        folder, root = tmp_path / f"log-{name}", tmp_path / f"state-{name}"
        start = 0
        for n, end in enumerate(cuts):
            part = spark.createDataFrame(log[start:end], "url string, seq bigint, status string").coalesce(1)
            part.write.mode("append").json(str(folder))
            start = end
            time.sleep(0.02)
        reader = spark.readStream.schema("url string, seq bigint, status string")
        if per_batch:
            reader = reader.option("maxFilesPerTrigger", per_batch)
        rows = reader.json(str(folder)).withColumns({
            "passes": F.lit(2), "is_success": F.col("status") == "done", "is_failure": F.col("status") == "failed-retryable",
        })
        INC.attempts_stream(rows, str(root), str(tmp_path / f"ck-{name}")).awaitTermination()
        last = INC.newest(spark.read.parquet(str(root)), ["url"])
        results.append(sorted((r.url, r.seq, r.status, r.attempts) for r in last.collect()))
    assert results[0] == results[1] == [("u", 5, "unavailable", 3), ("v", 7, "failed-retryable", 3)]


def state_log(spark, folder, rows):
    spark.createDataFrame(rows, "url string, seq bigint, status string").coalesce(1).write.mode("append").json(str(folder))
    time.sleep(0.02)
    log = spark.readStream.schema("url string, seq bigint, status string").option("maxFilesPerTrigger", 1).json(str(folder))
    return log.withColumns({"passes": F.lit(2), "is_success": F.col("status") == "done", "is_failure": F.col("status") == "failed-retryable"})


def test_attempts_follow_the_batch_and_go_on_after_a_restart(spark, tmp_path):
    """An initial state of 300 URLs; then batches that touch few of them, each in a run of its own from the checkpoint."""
    initial = spark.createDataFrame([(f"u{i}", 0, "failed-retryable", 4) for i in range(300)], "url string, seq bigint, status string, attempts bigint")
    batches = [[("u1", 1, "failed-retryable"), ("new", 2, "done")], [("u1", 3, "failed-retryable"), ("u2", 4, "done"), ("u2", 5, "failed-retryable")], [("new", 6, "failed-retryable")]]
    changed = []
    for rows in batches:
        query = INC.attempts_stream(state_log(spark, tmp_path / "in", rows), str(tmp_path / "out"), str(tmp_path / "ck"), initial)
        query.awaitTermination()
        done = [p for p in query.recentProgress if p["numInputRows"]]
        assert len(done) == 1 and done[0]["stateOperators"][0]["numRowsTotal"] == 301
        changed.append({(r.url, r.seq, r.status, r.attempts) for r in spark.read.parquet(f"{tmp_path}/out/v={done[0]['batchId']}").collect()})
    assert changed == [{("u1", 1, "failed-retryable", 5), ("new", 2, "done", 2)}, {("u1", 3, "failed-retryable", 6), ("u2", 5, "failed-retryable", 3)}, {("new", 6, "failed-retryable", 3)}]


def test_attempts_of_a_hot_url_in_any_order():
    """The tally of 30,000 rows in shuffled pieces is that of a walk along the log."""
    import numpy as np
    import pandas as pd

    from linkshelf.streaming.attempts import Tally

    rng = np.random.default_rng(6)
    kinds = rng.choice(["done", "failed", "other"], 30_000, p=[0.001, 0.6, 0.399])
    log = pd.DataFrame({"seq": np.arange(30_000), "status": kinds, "passes": rng.integers(0, 5, 30_000), "is_success": kinds == "done", "is_failure": kinds == "failed"})
    for rows, before in ((log, 7), (log[log.status != "done"], 7)):
        count = before
        for status, passes in zip(rows["status"], rows["passes"]):
            count = passes if status == "done" else count + (status == "failed")
        tally, mixed = Tally(), rows.sample(frac=1, random_state=3)
        for at in range(0, len(mixed), 4000):
            tally.add(mixed[at: at + 4000])
        assert (tally.last, tally.status, tally.attempts(before)) == (rows["seq"].iloc[-1], rows["status"].iloc[-1], count)


def test_a_batch_reads_the_buckets_of_its_urls(spark, tmp_path):
    """With every other bucket's files spoilt, a batch of one URL still runs: it opens none of them."""
    path = str(tmp_path / "seen")
    urls = spark.createDataFrame([(f"https://a.b/{i}",) for i in range(500)], "url string")
    for _ in range(2):
        history.append(history.unseen(urls, path, "url string"), path)
    assert spark.read.parquet(path).count() == 500 and len(list((tmp_path / "seen").glob("bucket=*"))) == history.BUCKETS
    for name in ("https://a.b/7", "https://new.example/"):
        one = spark.createDataFrame([(name,)], "url string")
        own = one.select(history.bucket_of()).first()[0]
        kept = {}
        for file in (tmp_path / "seen").glob("bucket=*/*.parquet"):
            if file.parent.name != f"bucket={own}":
                kept[file] = file.read_bytes()
                file.write_bytes(b"spoilt")
                file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
        assert history.unseen(one, path, "url string").count() == (name != "https://a.b/7")
        for file, data in kept.items():
            file.write_bytes(data)
    history.rewritten(spark, path, f"{path}-2")
    assert spark.read.parquet(f"{path}-2").count() == 500 and len(list((tmp_path / "seen-2").glob("bucket=*/*.parquet"))) == history.BUCKETS


def test_live_load_and_latest_status_over_batches(spark, tmp_path):
    """Three runs from one checkpoint give what one batch over all rows gives."""
    parts = [[("u", 1, "a", 0), ("v", 2, "b", 5)], [("u", 4, "c", 21), ("u", 3, "b", 22)], [("v", 9, "d", 41), ("w", 10, "e", 59)]]
    schema = "url string, seq bigint, status string, second bigint"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        INC.updates_stream(INC.latest_status(rows), str(tmp_path / "status"), str(tmp_path / "ck1")).awaitTermination()
        log = rows.select(F.col("url").alias("key"), F.timestamp_seconds("second").alias("ts"), F.col("seq").alias("in_tokens"))
        INC.updates_stream(INC.live_load(log, 1), str(tmp_path / "load"), str(tmp_path / "ck2")).awaitTermination()
    latest = INC.newest(spark.read.parquet(str(tmp_path / "status")), ["url"])
    assert {tuple(r) for r in latest.select("url", "seq", "status").collect()} == {("u", 4, "c"), ("v", 9, "d"), ("w", 10, "e")}
    load = INC.newest(spark.read.parquet(str(tmp_path / "load")), ["key", "from_ts", "to_ts"])
    want = {}
    for url, seq, _, second in sum(parts, []):
        for start in range(second // 10 * 10 - 50, second // 10 * 10 + 10, 10):
            n, tokens = want.get((url, start), (0, 0))
            want[url, start] = (n + 1, tokens + seq)
    got = {(r.key, int(r.second)): (r.requests, r.tokens) for r in load.withColumn("second", F.unix_seconds("from_ts")).collect()}
    assert got == want


def test_dedupe_stream_keeps_late_urls(spark, tmp_path):
    """Event times run backwards over the micro-batches, by days: none is too late, repeats stay out, known ones too."""
    parts = [[("a", "2024-03-05"), ("b", "2024-03-05")], [("c", "2024-03-03"), ("a", "2024-03-03")], [("d", "2024-03-01"), ("k", "2024-03-01")], [("e", "2024-02-01"), ("c", "2024-03-06")]]
    for part in parts:
        rows = spark.createDataFrame(part, "url string, at string").select("url", F.to_timestamp("at").alias("ts")).coalesce(1)
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    events = spark.readStream.schema("url string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("k",)], "url string")
    for ck in ("a", "b"):  # a lost checkpoint replays every file
        query = INC.dedupe_stream(events, f"{tmp_path}/out", f"{tmp_path}/{ck}", known)
        query.awaitTermination()
        assert len({p["batchId"] for p in query.recentProgress if p["numInputRows"]}) == len(parts)
        assert sorted(r.url for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b", "c", "d", "e"]


def test_retry_lane_gives_up_at_the_limit(spark, tmp_path):
    drop_files(tmp_path / "in", [["flaky", "ok"], ["x"], ["y"], ["z"]])
    outcome = lambda df: df.withColumn("result", F.when(F.col("line") == "flaky", "transient").otherwise("ok"))
    lines = readers.stream_captures(spark, str(tmp_path / "in"), 1)
    INC.retry_lane(lines, f"{tmp_path}/retry", f"{tmp_path}/done", f"{tmp_path}/ck", outcome).awaitTermination()
    done = {(r.line, r.result, r.attempts) for n in range(4) for r in spark.read.parquet(f"{tmp_path}/done/v={n}").collect()}
    assert ("flaky", "unavailable", 3) in done and ("ok", "ok", 1) in done
    assert len(done) == 5


def test_card_stream_is_idempotent(spark, tmp_path):
    drop_files(tmp_path / "in", LINES)
    from linkshelf.functions.urls import canonical_url

    render = lambda df: df.select(canonical_url(F.col("line")).alias("url"), F.col("line").alias("content"))
    lines = readers.stream_captures(spark, str(tmp_path / "in"), 1)
    for ck in ("a", "b"):  # a lost checkpoint replays every file
        INC.card_stream(lines, f"{tmp_path}/cards", f"{tmp_path}/ledger", f"{tmp_path}/{ck}", render).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/cards").count() == spark.read.parquet(f"{tmp_path}/ledger").count() == 4
    # The first micro-batch's least text stays, whatever comes later.
    cards = {r.url: r.content for r in spark.read.parquet(f"{tmp_path}/cards").collect()}
    assert cards["https://a.b/1"] == "HTTPS://A.B/1/" and cards["https://a.b/2"] == "https://a.b/2"


def test_lines_appended_during_a_run_are_in_the_next(spark, tmp_path):
    """One file grows while its lines are being handled: what came late, or without its line break, is not lost and not read twice."""
    inbox = tmp_path / "captures.txt"
    inbox.write_text("https://a/1\n  nope  \n\nhttps://a/2\nhttps://a/lat")
    runs = []

    def handle(batch, batch_id):
        rows = sorted(r.line for r in batch.collect())
        if not runs:
            with open(inbox, "a") as more:
                more.write("e\nhttps://a/3\n")
        runs.append(rows)

    for _ in range(4):
        lines = readers.stream_appended_captures(spark, str(inbox))
        lines.writeStream.foreachBatch(handle).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        if len(runs) == 3:
            break
        if len(runs) == 2:
            with open(inbox, "a") as more:
                more.write("https://a/4\n")
    assert [rows for rows in runs if rows] == [["https://a/1", "https://a/2", "nope"], ["https://a/3", "https://a/late"], ["https://a/4"]]
