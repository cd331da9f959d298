import hashlib
import json

import pytest
from pyspark.sql import functions as F

from linkshelf import schemas
from linkshelf.sources import files, readers, writers


def test_captures_keep_file_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  https://a/1 \n\n   \nhttps://a/2\n")
    rows = readers.read_captures(spark, str(tmp_path)).orderBy("at").collect()
    assert [r.line for r in rows] == ["https://a/1", "https://a/2"]


def test_corrupt_json_fails(spark, tmp_path):
    (tmp_path / "q.json").write_text('[{"url": "u"}, {"ur')
    with pytest.raises(Exception, match="MALFORMED_RECORD_IN_PARSING|FAILED_READ_FILE"):
        readers.read_json_array(spark, str(tmp_path), schemas.METADATA).collect()


def test_csv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes('﻿Category,Summary,Creator,URL,Title,Tags\nTips,"a ""b"", c",me,u,,"x, y"\n'.encode())
    row = readers.read_table_csv(spark, str(tmp_path)).first()
    assert (row.Category, row.Summary, row.Title, row.Tags) == ("Tips", 'a "b", c', "", "x, y")


def test_torn_ledger_lines_are_skipped(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"url": "https://A/x/", "event": "carded"}\n{"url": "https://a/y"}\n\n{"url": "https://a/z", "ev')
    assert [(r.url, r.event) for r in readers.read_ledger(spark, str(tmp_path)).collect()] == [("https://a/x", "carded")]


def test_state_log_defaults(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"url": "https://a/x"}\n{"url": "https://a/y", "attempts": "2", "status": "done"}\n{"url": "https://a/z", "attempts": "many"}\nnope\n')
    rows = readers.read_state_log(spark, str(tmp_path)).orderBy("at").collect()
    assert [(r.url, r.status, r.attempts) for r in rows] == [("https://a/x", "pending", 0), ("https://a/y", "done", 2)]


def test_card_tree(spark, tmp_path):
    card = '---\nurl: "https://A/{}/"\nstatus: kept\ntags:\n  - t\n---\nbody\n'
    (tmp_path / "Travel").mkdir()
    (tmp_path / ".trash").mkdir()
    (tmp_path / "Travel" / "a b.md").write_text(card.format(1))
    (tmp_path / "Travel" / "bad.md").write_bytes(b"---\nurl: \xff\n---\n")
    (tmp_path / "Travel" / "nourl.md").write_text("# url: x\n")
    (tmp_path / "Travel" / "broken.md").write_text('---\nurl: https://a/2\nbad: "x\n---\n')
    (tmp_path / ".trash" / "c.md").write_text(card.format(3))
    (tmp_path / "x.txt").write_text(card.format(4))
    rows = {r.url: r for r in readers.read_cards(spark, str(tmp_path)).collect()}
    assert set(rows) == {"https://a/1", "https://a/2"}
    assert rows["https://a/1"].path.endswith("Travel/a b.md") and rows["https://a/1"].tags == ["t"]
    assert rows["https://a/2"].fm_state == "broken"


POST = {"label_values": [
    {"label": "URL", "href": "https://i/p/1"}, {"label": "Caption", "value": "Hello #food #food #é"},
    {"title": "Owner", "dict": [{"dict": [{"label": "Username", "value": "cook"}]}]},
]}


@pytest.mark.parametrize("data", [[POST, {"label_values": [{"label": "Caption", "value": "x"}]}], {"saved_saved_media": [POST]}])
def test_export_shapes(spark, tmp_path, data):
    (tmp_path / "e.json").write_text(json.dumps(data))
    row = readers.read_export(spark, str(tmp_path)).collect()
    assert [r.asDict() for r in row] == [
        {"url": "https://i/p/1", "title": "Hello #food #food #é", "description": "Hello #food #food #é", "tags": ["food", "é"], "creator": "cook"}
    ]


def test_last_json_line(evaluate):
    assert json.loads(evaluate(readers.last_json_object, 'warn\n{"a": 1}\n {"b": 2} \n{"torn\n')) == {"b": 2}
    assert evaluate(readers.last_json_object, "[1]\nx") is None


def test_metadata_prunes_unread_fields(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"title": "t", "formats": [1] * 100, "entries": [{"url": "u", "thumbnail": "h", "w": 1}]}) + "\n")
    info = readers.read_info(spark, str(tmp_path))
    assert info.first().entries[0].asDict() == {"url": "u", "thumbnail": "h"}
    plan = info.select("title")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<title:string>" in plan


def test_notes_that_the_listing_skips(spark, tmp_path):
    """Names with a leading underscore are read at any depth; where only Spark's listing can be used they are an error."""
    note = '---\nurl: "https://a/{}"\nstatus: "inbox"\n---\n# n\n'
    deep = tmp_path.joinpath("_Movies", *"abcdefghij", "_Old")
    deep.mkdir(parents=True)
    assert readers.read_cards(spark, str(tmp_path)).collect() == []
    (deep / "n.md").write_text(note.format(1))
    (tmp_path / "_CON.md").write_text(note.format(2))
    (tmp_path / "_Movies" / ".hidden.md").write_text(note.format(3))
    (tmp_path / "bad.md").write_bytes(b"---\nurl: \xff\n---\n")
    for root in (str(tmp_path), tmp_path.as_uri(), f"file:{tmp_path}/"):
        assert sorted((r.url, r.status) for r in readers.read_cards(spark, root).collect()) == [("https://a/1", "inbox"), ("https://a/2", "inbox")]
    assert readers._underscored(spark, str(tmp_path / "_Movies")).endswith("_Old/n.md")
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "n.md").write_text(note.format(4))
    assert readers._underscored(spark, str(tmp_path / "plain")) is None


def test_notes_written_and_read(spark, tmp_path, monkeypatch):
    """Every note is a file of its own, written again without change; many small files share a task."""
    rows = [(f"shelf {i % 3}/_{i}.md", f'---\nurl: "https://a/{i}"\n---\n{"ü" * i}') for i in range(60)] + [("deep/er/null.md", None)]
    notes = spark.createDataFrame(rows, "path string, content string").repartition(4)
    for _ in range(2):
        assert files.write_notes(notes, str(tmp_path)) == 61
    assert not [p for p in tmp_path.rglob(".*") if p.is_file()]
    read = files.read_notes(spark, str(tmp_path))
    assert {(r.path.removeprefix(f"{tmp_path}/"), r.content) for r in read.collect()} == {(p, c or "") for p, c in rows}
    monkeypatch.setattr(files, "PART_FILES", 25)
    parts = files.NoteReader(str(tmp_path)).partitions()
    assert [len(p.files) for p in parts] == [25, 25, 11]
    assert files.write_notes(notes.limit(0), str(tmp_path / "none")) == 0


def _offsets(reader, start=None):
    start, end = start or reader.initialOffset(), reader.latestOffset()
    lines = [v for p in reader.partitions(start, end) for b in reader.read(p) for v in b.column(0).to_pylist()]
    return lines, end


@pytest.mark.parametrize("part_bytes", [1, 2, 5, 7, 64, 1 << 20])
def test_each_line_is_read_once_wherever_parts_end(tmp_path, part_bytes):
    lines = ["a", "", "https://a/ü", "x" * 100, "  ", "last"]
    (tmp_path / "c.txt").write_bytes(("\n".join(lines) + "\n").encode())
    reader = files.CaptureReader(str(tmp_path), part_bytes)
    got, end = _offsets(reader)
    assert got == lines
    with open(tmp_path / "c.txt", "a") as more:
        more.write("more\nnot yet whol")
    got, end = _offsets(reader, end)
    assert got == ["more"]
    with open(tmp_path / "c.txt", "a") as more:
        more.write("e\n")
    got, end = _offsets(reader, end)
    assert got == ["not yet whole"] and _offsets(reader, end)[0] == []
    (tmp_path / "c.txt").write_text("short\n")
    with pytest.raises(ValueError, match="was cut"):
        _offsets(reader, end)


@pytest.mark.parametrize("block_bytes", [1, 200, 1 << 20])
def test_json_arrays_of_bounded_size(spark, tmp_path, block_bytes):
    rows = [(i, f"u{i}", 'a "quoted"\nline' * (i % 4)) for i in range(0, 4000, 40)]
    path = str(tmp_path / "q")
    writers.write_json_arrays(spark.createDataFrame(rows, "id bigint, url string, title string"), path, "id", block_bytes=block_bytes)
    got = [json.loads(p.read_text()) for p in sorted((tmp_path / "q").rglob("*.txt"), key=lambda p: int(p.parent.name.split("=")[1]))]
    assert [r["url"] for part in got for r in part] == [r[1] for r in rows]
    size = lambda part: sum(len(json.dumps(r, separators=(",", ":"))) for r in part[:-1])
    assert all(size(part) <= block_bytes for part in got)
    read = readers.read_json_array(spark, path, "url string, title string")
    assert read.columns == ["url", "title"] and sorted(map(tuple, read.collect())) == sorted(r[1:] for r in rows)
    writers.write_json_arrays(spark.createDataFrame([], "id bigint, url string, title string"), str(tmp_path / "none"), "id")
    assert readers.read_json_array(spark, str(tmp_path / "none"), "url string, title string").count() == 0


def test_write_cards_once_across_crashes(spark, tmp_path):
    """Known URLs get no card, a card without event gets its event, failed rows stay, names count what is stored."""
    from linkshelf.plans import ingest

    def queue(*rows):
        return spark.createDataFrame([(i, u, "Travel", t, "me", "sum", ["x"]) for i, u, t in rows],
                                     "doc_id bigint, url string, category string, title string, creator string, summary string, tags array<string>")

    cards, ledger = str(tmp_path / "cards"), str(tmp_path / "ledger")
    spark.createDataFrame([("gone", "tossed", "x", None)], ingest.EVENTS).write.parquet(ledger)
    rows = [(1, "a", "Same"), (2, "b", "Same"), (3, "gone", "Same"), (4, "bad", "Other")]
    left = ingest.write_cards(queue(*rows), cards, ledger, "doc_id", F.col("url") != "bad")
    assert [r.url for r in left.collect()] == ["bad"]
    state = lambda: (sorted((r.url, r.stem) for r in spark.read.parquet(cards).collect()), sorted((r.url, r.event, r.source) for r in spark.read.parquet(ledger).collect()))
    done = ([("a", "Same"), ("b", "Same (2)")], [("a", "carded", "write-cards"), ("b", "carded", "write-cards"), ("gone", "tossed", "x")])
    assert state() == done
    assert ingest.write_cards(queue(*rows), cards, ledger, "doc_id", F.col("url") != "bad").count() == 1 and state() == done
    # A crash between cards and events: the card is there, its event is not.
    spark.createDataFrame([("c", "Travel", "Travel", "Crashed", "text")], ingest.CARDS).write.mode("append").parquet(cards)
    left = ingest.write_cards(queue((5, "c", "Crashed"), (6, "d", "Same"), (4, "bad", "Other")), cards, ledger, "doc_id")
    assert left.isEmpty()
    assert state() == (sorted([*done[0], ("c", "Crashed"), ("d", "Same (3)"), ("bad", "Other")]),
                       sorted([*done[1], ("c", "carded", "write-cards"), ("d", "carded", "write-cards"), ("bad", "carded", "write-cards")]))


def test_whole_titles_are_not_carried_through_asking_and_naming(spark, tmp_path, monkeypatch):
    """Numbers, payloads and names come from narrow rows; items keep their own answer, also if ids repeat or are null."""
    from linkshelf import session
    from linkshelf.operators.scoring import rule_scorer
    from linkshelf.plans import ingest

    count = iter(range(1000))
    monkeypatch.setattr(session, "scratch_path", lambda spark, name: str(tmp_path / f"{name}-{next(count)}"))
    words = ["song", "travel", "recipe", "plain"]
    noise = lambda n: "".join(hashlib.sha256(f"{n} {k}".encode()).hexdigest() for k in range(300))
    ids = [None, None, *[n // 2 for n in range(38)]]
    rows = [(i, f"u{n}", f"{words[n % 4]} {n} {noise(n)}", noise(-n), "me", ["x"]) for n, i in enumerate(ids)]
    items = spark.createDataFrame(rows, "doc_id bigint, url string, title string, description string, creator string, tags array<string>")
    done = ingest.classified(items, rule_scorer(), "doc_id", 7, str(tmp_path / "paid"))
    assert done.columns == ["block", "batch", "i", *items.columns, "category", "summary"]
    told = {"song": "Saved Music", "travel": "Travel", "recipe": "Recipes & Food", "plain": "Miscellaneous"}
    got = {r.url: r for r in done.collect()}
    assert done.count() == len(rows) and {u: tuple(got[u][c] for c in items.columns) for u in got} == {r[1]: r for r in rows}
    assert all(got[r[1]].category == told[words[n % 4]] and got[r[1]].summary.split()[1] == str(n) for n, r in enumerate(rows))
    assert sorted((r.block, r.batch, r.i) for r in got.values()) == [(0, n // 7, n % 7) for n in range(len(rows))]
    size = lambda name: sum(f.stat().st_size for f in tmp_path.glob(f"{name}-*/*.parquet"))
    assert size("packed") < size("items") / 10

    named, unique = [], ingest.unique_names
    monkeypatch.setattr(ingest, "unique_names", lambda new, existing: named.append(new) or unique(new, existing))
    known = spark.createDataFrame([], "folder string, stem string")
    assert ingest.cards(done.filter("doc_id is not null").dropDuplicates(["doc_id"]), known, "doc_id").count() == 19
    assert named[0].inputFiles() and all("/stems-" in f for f in named[0].inputFiles())
