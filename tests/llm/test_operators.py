"""Every operator on small inputs with nulls, empty, repeated and tied rows, against brute force or literal expectations."""

import hashlib
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from linkshelf.llm import (  # noqa: E402
    buffers, components, exact_dedup, html_extract, language_id, mixing, packing, quality_classifier, quality_rules, simhash_dedup, suffix_dedup,
    toxicity, workers,
)

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LETTERS = {"en": "the and ing tion ed er on re th at".split(), "de": "sch ung ein ver keit lich der und ge ä".split()}


def prose(rng, lang="en", words=80):
    made = ["".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    lines = [" ".join(made[i: i + 12]) for i in range(0, words, 12)]
    return "\n".join(lines)


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text, lang, source): prose, copies, near copies, shared passages, junk and odd rows."""
    rng = random.Random(5)
    rows = []
    for i in range(150):
        lang = rng.choice(["en", "de"])
        rows.append((i, prose(rng, lang, rng.randint(55, 130)), lang, rng.choice(["big", "big", "s1", "s2"])))
    passage = prose(rng, "en", 40)
    for i in range(150, 165):
        rows.append((i, prose(rng, "en", 60) + "\n" + passage + ("." * (i % 3)), "en", "s1"))
    for i in range(165, 180):
        rows.append((i, rows[i - 165][1].upper() if i % 2 else rows[i - 165][1], rows[i - 165][2], "big"))
    for i in range(180, 190):
        rows.append((i, rows[40][1] + " end" + str(i), rows[40][2], "s2"))
    for i in range(190, 200):
        rows.append((i, " ".join(w + "&&&" for w in prose(rng, "en", 70).split()), "en", "big"))
    odd = [(200, None, None, None), (201, "", "en", ""), (202, " \n\t", "en", "s1"), (203, "one", "en", "s1"), (204, "one Two", "en", "s1"),
           (205, "12 34 !!", "en", "s1"), (206, "äöü ß é " * 30, "de", "s2"), (None, "no id here", "en", "s1"), (207, "a " * 4000, "en", "big")]
    return rows + odd + [rows[3], odd[3]]


def frame(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, la, s, len(t) if t else None) for i, t, la, s in rows], SCHEMA).repartition(5)
    names = ["kept", "slot", "digest", "fp", "text_sha256", "keep_id", "size", "rank_id", "held_out", "nth", "order_key"]
    return df.withColumns({c: F.lit("x") for c in names}) if extra else df


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return frame(spark, corpus, extra=True).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def test_buffers_are_whole_texts_in_bounded_pieces():
    import pyarrow as pa

    data, starts = buffers.text_bytes(pa.array(["ab", None, "", "ä"]).slice(1))
    assert data.tobytes().decode() == "ä" and starts.tolist() == [0, 0, 0, 2]
    assert list(buffers.pieces(np.array([0, 5, 20, 22, 24]), 6)) == [(0, 1), (1, 2), (2, 4)]


def test_exact_dedup(docs, none, corpus):
    got = exact_dedup.exact_duplicates(docs)
    names = got.columns[-4:]
    found = sorted(((r["doc_id"], r[names[1]], r[names[2]], r[names[3]], r[names[0]]) for r in got.select("doc_id", *names).collect()), key=key)
    assert found == sorted(brute.exact([(i, t) for i, t, _, _ in corpus]), key=key)
    kept = exact_dedup.without_copies(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r[3] for r in found)
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_exact_dedup_lowers_ascii_only(spark):
    df = frame(spark, [(1, "ÄB", "", ""), (2, "äb", "", ""), (3, "Äb", "", ""), (4, "K", "", ""), (5, "K", "", "")])
    assert {tuple(r) for r in exact_dedup.exact_duplicates(df).select("doc_id", "keep_id").collect()} == {(1, 3), (2, 2), (3, 3), (4, 4), (5, 5)}


def test_mixing(docs, none, corpus):
    block, weights = 700, {"big": 0.5, "s1": 0.3, "s2": 0.19, "": 0.01}
    mixed, names = mixing.mixture(docs, weights, block, resolution=100)
    rows = mixed.select("doc_id", *names).collect()
    order = lambda i, t: (hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), (i is not None, i or 0), len((t or "").encode()) + 1,
                          hashlib.md5((t or "").encode()).hexdigest())
    plain = [(s or "", len((t or "").encode()) + 1, order(i, t)) for i, t, _, s in corpus]
    expected, slots = brute.mix(plain, {"big": 50, "s1": 30, "s2": 19, "": 1}, block)
    assert sorted((corpus[i][0], e, b, t) for (i, e), (b, t) in expected.items() if corpus[i][0] is not None) == sorted(
        (r["doc_id"], r[names[3]], r[names[4]], r[names[5]]) for r in rows if r["doc_id"] is not None)
    assert len(rows) == len(expected)
    assert all(r[names[6]] <= r[names[5]] < r[names[7]] for r in rows)  # release <= slot < deadline: under one block off
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mixture(none)[0].count() == 0


def test_mixing_reads_a_source_of_one_row_longer_than_the_mix(spark):
    mixed, names = mixing.mixture(frame(spark, [(1, "x" * 50_000, "", "a"), (2, "y", "", "b")]))
    assert {(r["doc_id"]) for r in mixed.collect()} == {1, 2}


def test_suffix_dedup(docs, none, corpus, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 9_000)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 40_000)
    got = sorted((tuple(r) for r in suffix_dedup.repeat_table(docs).collect()), key=key)
    assert got == sorted(brute.without_repeats([(i, t) for i, t, _, _ in corpus]), key=key)
    assert any(r[2] for r in got)
    assert suffix_dedup.repeat_table(none).count() == 0


def test_suffix_dedup_at_the_edges_of_texts(spark):
    shared = "0123456789" * 5
    rows = [(1, shared, "", ""), (2, "é" + shared + "é", "", ""), (3, shared[1:], "", ""), (4, shared[1:] + "Z", "", ""), (5, "q" + shared[1:] + "Z", "", ""),
            (6, "\0" * 60, "", ""), (7, "\0" * 55, "", ""), (8, "ab" * 200, "", ""), (9, "ba" * 100, "", "")]
    got = sorted(tuple(r) for r in suffix_dedup.repeat_table(frame(spark, rows)).collect())
    assert got == brute.without_repeats([(i, t) for i, t, _, _ in rows])


def test_common_prefixes_and_intervals():
    rows = np.frombuffer(b"abcaabdaabca", np.uint8).reshape(3, 4)
    order, lcp = suffix_dedup.common_prefixes(rows)
    assert order.tolist() == [1, 0, 2] or [rows[i].tobytes() for i in order] == sorted(r.tobytes() for r in rows)
    assert lcp.tolist()[0] == 0 and max(lcp) == 2 or max(lcp) == 4
    assert len(set(suffix_dedup.interval_of(order, lcp, 1).tolist())) == 1


def test_html_extraction():
    long = "word " * 40
    assert html_extract.main_text("") == "" and html_extract.main_text("<div></div><!-- x") == ""
    assert html_extract.main_text("<p>Hi</p>") == "Hi"
    assert html_extract.main_text("a < b &amp; c &lt;p&gt; &#228;") == "a < b & c <p> ä"
    page = (f"<head><title>T</title><style>p{{}}</style></head><body><header>Top</header><nav><a>Home</a></nav><div class='ad'>Buy<div>now</div></div>"
            f"<article><h1>Head</h1><p>{long}<b>bold</b>ly<br>next</p><p>x.</p><form><p>mail</p></form><section class='comments'><p>{long}</p></section>"
            f"<p>end</p></article><aside>{long}</aside><div id=sidebar>{long}</div><footer>foot</footer><script>var a='</p>';</script>")
    assert html_extract.main_text(page) == "Head " + long.strip() + " boldly next x. end"
    plain = f"<body><div class=nav>menu</div><div><h2>Title</h2><p>{long}</p><p>short</p></div><p class=notice>cookies<p>{long}<div class=footer>{long}</div></body>"
    assert html_extract.main_text(plain) == f"Title {long.strip()} short {long.strip()}"


def test_html_extraction_table(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, "<p>Hi &amp; there</p>"), (2, None, "<p>Hi &amp; there</p>")], "page_id bigint, url string, html string")
    assert sorted(tuple(r) for r in html_extract.extracted(pages.withColumn("text", F.lit(1))).collect()) == [(1, "u", "", 0)] + [(2, None, "Hi & there", 10)] * 2


def test_packing_round_trip(docs, none, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.packed(docs, window=64).collect()
    windows: dict[int, list] = {}
    for r in rows:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["ids"]))
    for at in windows.values():
        at.sort(key=lambda x: x[0])
        assert [x[0] for x in at] == np.cumsum([0] + [x[1] for x in at])[:-1].tolist()
    sizes = [sum(x[1] for x in windows[k]) for k in sorted(windows)]
    assert sorted(windows) == list(range(len(windows))) and set(sizes[:-1]) <= {64}
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]))
    for i, t, _, _ in corpus:
        own = sorted(set((s, n, tuple(x), d) for s, n, x, d in pieces[i]))
        if sum(1 for j, *_ in corpus if j == i) == 1:
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
            assert sum((list(x) for _, _, x, _ in own), []) == ids and {d for *_, d in own} == {len(ids)}
    table = packing.packing_table(docs)
    assert table.agg(F.sum("length")).first()[0] == sum(len(np.frombuffer(r["ids"], "<u4")) for r in rows)
    one = table.filter("doc_id = 203").first()
    assert one["ids_crc32"] == zlib.crc32(np.array(tokenizer.encode("one", add_special_tokens=False).ids + [1], "<u4").tobytes())
    assert packing.packing_table(none).count() == 0


def test_packing_is_the_same_in_small_pieces(docs, monkeypatch):
    key_of = lambda rows: sorted((tuple(r) for r in rows), key=key)
    together = key_of(packing.packing_table(docs).collect())
    monkeypatch.setattr(packing, "PIECE_IDS", 50)
    assert key_of(packing.packing_table(docs).collect()) == together


def test_arrow_batches_of_texts_are_bounded(spark):
    import pyarrow as pa

    workers.reachable(spark)
    texts = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("word "), 2000).alias("text"))
    sizes = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["size", "n"]) for b in batches), "size bigint, n bigint").collect()
    assert sum(r["n"] for r in sizes) == 4000 and max(r["size"] for r in sizes) <= workers.BATCH_BYTES + (1 << 20)


def test_packing_is_the_same_without_broadcast(docs, monkeypatch):
    key_of = lambda rows: sorted((tuple(r) for r in rows), key=key)
    together = key_of(packing.packing_table(docs).collect())
    monkeypatch.setattr(packing, "BROADCAST_RUNS", 0)
    assert key_of(packing.packing_table(docs).collect()) == together


def test_packing_follows_the_order_of_stored_rows(spark, tmp_path):
    rows = [(i, "word " * (i % 40), "en", "s") for i in range(400)]
    frame(spark, rows).repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id").write.option("parquet.block.size", 4096).parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")  # files are split over tasks
    try:
        pieces = packing.packing_table(spark.read.parquet(str(tmp_path / "t"))).orderBy("sequence_id", "offset").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [p["doc_id"] for p in pieces if p["start"] == 0] == list(range(400))
    at = [p["sequence_id"] * 2048 + p["offset"] for p in pieces]
    assert at == np.cumsum([0] + [p["length"] for p in pieces])[:-1].tolist()


def test_encoder_equals_the_tokenizer_file():
    import public_tokenizers
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.Encoder.named("byte_bpe_50k")

    @settings(max_examples=400, deadline=None)
    @given(st.text(st.characters(exclude_categories=("Cs",)), max_size=60))
    def same(text):
        assert encoder.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids

    same()
    for text in ("<|endoftext|>", "a <|endoftext|> b", "<|endoftext", "  x\r\n\n  y", "don't I'LL", "\x85\x1c x"):
        assert encoder.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_on_very_long_runs():
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.Encoder.named("byte_bpe_50k")
    for text in (" " * 2_000_000, "\n" * 2_000_000, "word" + "\t " * 1_000_000 + "word", "\u3000" * 700_000, "a" * 2_000_000, "語" * 700_000, "x y\n" * 500_000,
                 " " * 9_999 + "a" + " " * 9_999):
        assert np.array_equal(encoder.ids(text), tokenizer.encode(text, add_special_tokens=False).ids), text[:5]


def test_packing_of_a_run_of_white_space(spark):
    rows = [(1, "a b", "", ""), (2, " " * 2_000_000, "", ""), (3, "\n" * 1_500_000 + "end", "", "")]
    lengths = {r["doc_id"]: r["n"] for r in packing.packing_table(frame(spark, rows)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert lengths == {i: len(packing.Encoder.named(packing.VOCABULARY).ids(t)) + 1 for i, t, _, _ in rows}


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_language_id(docs, none, corpus):
    trees = language_id.fit(docs)
    assert trees.languages == ["de", "en"]
    rows = language_id.languages(docs, trees).collect()
    assert len(rows) == len(corpus)
    by = {r["doc_id"]: r for r in rows}
    for i, t, lang, _ in corpus:
        assert by[i]["held_out"] == held_out(i) and 0 <= by[i]["score"] <= 1
        if i is not None and i < 160:
            assert by[i]["lang_pred"] == lang
    assert [by[i]["lang_pred"] for i in (200, 201, 202, 205)] == ["und"] * 4
    assert language_id.languages(none, trees).count() == 0
    assert {r["lang_pred"] for r in language_id.languages(docs, language_id.fit(none)).collect()} == {"und"}


def test_context_trees_charge_escapes_as_by_hand():
    trees = language_id.ContextTrees({"a": [b"abab"], "b": [b"bbbb"]}, order=1)
    flat = np.log(256)
    got = trees.lengths(np.frombuffer(b"abc", np.uint8), np.array([0, 3]))[0]
    # a: contexts "\n": {a:1}, "a": {b:2}, "b": {a:1}; no context: {a:2, b:2}
    a = -np.log(1 / 2) - np.log(2 / 3) + (-np.log(1 / 2) - np.log(2 / 6) + flat)
    # b: contexts "\n": {b:1}, "b": {b:3}; no context: {b:4}
    b = (-np.log(1 / 2) - np.log(1 / 5) + flat) + -np.log(4 / 5) + (-np.log(1 / 4) - np.log(1 / 5) + flat)
    assert np.allclose(got, [a, b], rtol=1e-5)
    one_by_one = [trees.lengths(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in (b"ab", b"", b"xba")]
    together = trees.lengths(np.frombuffer(b"abxba", np.uint8), np.array([0, 2, 2, 5]))
    assert np.allclose(together, one_by_one, rtol=1e-5)


def test_code_lengths_of_long_texts_are_summed_in_steps(monkeypatch):
    rng = random.Random(3)
    trees = language_id.ContextTrees({la: [prose(rng, la, 400).encode()] for la in ("de", "en")}, 3)
    texts = [prose(rng, "en", 300), "", "ä", prose(rng, "de", 2000), "x", prose(rng, "de", 5)]
    import pyarrow as pa

    data, starts = buffers.text_bytes(pa.array(texts))
    whole = trees.lengths(data, starts)
    for step in (1, 7, 100, 4096):
        monkeypatch.setattr(language_id, "STEP_BYTES", step)
        assert np.allclose(trees.lengths(data, starts), whole, rtol=1e-6)


def labels_of(spark, rows, quality=None, toxic=None):
    return spark.createDataFrame([(i, quality(t) if quality else 1, toxic(t) if toxic else 0) for i, t, *_ in rows if t and i is not None],
                                 "doc_id bigint, quality int, toxic int")


def test_quality_classifier(spark, docs, none, corpus):
    rng = random.Random(3)
    rows = [(i, prose(rng, "en", 90) if i % 3 else " ".join(w + rng.choice(["$$$", "&&&"]) for w in prose(rng, "en", 60).split()), "en", "s") for i in range(240)]
    table, labels = frame(spark, rows), labels_of(spark, rows, quality=lambda t: int("$" not in t and "&" not in t))
    model = quality_classifier.fit(table, labels)
    scored = quality_classifier.quality_scores(table, model).collect()
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in scored)
    out = [r for r in scored if r["held_out"]]
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 > 0) for r in out]) > 0.95
    odd = quality_classifier.quality_scores(docs, model).collect()
    assert len(odd) == len(corpus) and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["score"] for r in quality_classifier.quality_scores(docs, quality_classifier.fit(none, labels)).collect()} == {0.5}
    assert quality_classifier.quality_scores(none, model).count() == 0


def test_toxicity(spark, docs, none, corpus):
    rng = random.Random(4)
    insults = ["grumbwoz", "flibnak", "zorbluk"]

    def poisoned(t):
        words = t.split(" ")
        for _ in range(2):
            words.insert(rng.randrange(len(words)), rng.choice(insults))
        return " ".join(words)

    rows = [(i, poisoned(prose(rng, "en", 60)) if i % 4 == 0 else prose(rng, "en", 60), "en", "s") for i in range(320)]
    table, labels = frame(spark, rows), labels_of(spark, rows, toxic=lambda t: int(any(w in t for w in insults)))
    model = toxicity.fit(table, labels)
    out = [r for r in toxicity.toxicity_scores(table, model).collect() if r["held_out"]]
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in out]) > 0.95
    hidden = [(1000 + k, "the and ing " + w + " tion ed on re", "en", "s") for k, w in enumerate(
        ["grumb.woz", "g r u m b w o z", "f-l-i-b-n-a-k", "zorb*luk", "grumbbwoz", "FLIBNAK"])]
    found = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(frame(spark, hidden), model).collect()}
    assert min(found.values()) >= 0.3, found
    odd = toxicity.toxicity_scores(docs, model).collect()
    assert len(odd) == len(corpus) and all(0 <= r["score"] <= 1 for r in odd)
    assert not any(r["predicted"] for r in odd if r["doc_id"] in (200, 201, 202))
    assert {r["score"] for r in toxicity.toxicity_scores(docs, toxicity.fit(none, labels)).collect()} <= {0.0, 1.0}
    assert toxicity.toxicity_scores(none, model).count() == 0


def test_insults_in_some_clean_documents_are_learned(spark):
    rng = random.Random(14)
    insults = ["grumbwoz", "flibnak", "zorbluk"]
    rows = []
    for i in range(800):
        words = prose(rng, "en", 60).split(" ")
        if i % 4 == 0 or i % 50 == 1:  # 2% of those labelled clean have one, too
            words.insert(rng.randrange(len(words)), insults[i // 4 % 3])
        rows.append((i, " ".join(words), "en", "s"))
    table = frame(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, *_ in rows], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(table, labels)
    fresh = [(1000 + k, "the and ing " + w + " tion ed on re", "en", "s") for k, w in enumerate([*insults, "grumb.woz", "flibbnak", "thering"])]
    found = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(frame(spark, fresh), model).collect()}
    assert min(found[1000 + k] for k in range(5)) >= toxicity.TOXIC_FROM > found[1005], found
    out = [r for r in toxicity.toxicity_scores(table, model).collect() if r["held_out"]]
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in out]) > 0.9


def test_kernel_weights_are_the_kernel():
    words = [b"idiot", b"idxiot", b"stone"]
    phi = np.zeros((3, 1 << 15))
    word, triple, value = toxicity._features(words)
    np.add.at(phi, (word, triple), value)

    def plain(a, b):
        def subs(w):
            return [(w[i] + w[j] + w[k], toxicity.DECAY ** (k - i - 2)) for i in range(len(w)) for j in range(i + 1, len(w))
                    for k in range(j + 1, min(len(w), i + toxicity.SPAN))]
        return sum(x * y for s, x in subs(a) for t, y in subs(b) if s == t) * toxicity.norms(np.array([len(a)]))[0] * toxicity.norms(np.array([len(b)]))[0]

    expected = [[plain(a.decode(), b.decode()) for b in words] for a in words]
    assert np.allclose(phi @ phi.T, expected) and expected[0][1] > 5 * expected[0][2]
    weights = phi[0].astype(np.float32)
    data = np.frombuffer(b"idiot idxiot i.d i o t", np.uint8)
    begins, _ = toxicity.words(data, np.array([0, len(data)]))
    assert np.allclose(toxicity.word_scores(data, begins, weights)[:2], [expected[0][0], expected[0][1]], rtol=1e-4)


def test_quality_rules(docs, none, corpus):
    got = {}
    for r in quality_rules.rule_table(docs).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:8])
    kept = brute.robust_verdicts([(t, la, s) for _, t, la, s in corpus])
    for (i, t, _, _), ok in zip(corpus, kept):
        c = brute.counts(t)
        assert (*c[:5], c[0] < 50 or 100 * c[4] > 50 * c[0], ok) in got[i]
    assert not any(ok for (i, *_), ok in zip(corpus, kept) if i is not None and 190 <= i < 200)
    assert all(ok for (i, *_), ok in zip(corpus, kept) if i is not None and i < 150)
    passed = quality_rules.accepted(docs)
    assert passed.columns == docs.columns and passed.count() == sum(kept)
    assert quality_rules.rule_table(none).count() == 0


def test_each_statistic_rejects_alone_in_a_clean_group(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    clean = lambda n: [word() for _ in range(n)]
    rows = [(i, "\n".join(" ".join(clean(12)) for _ in range(6)), "en", "s") for i in range(100)]
    few, lines = clean(10), []
    while len(lines) < 60:  # no three words in a row occur twice
        at = rng.choice(few)
        if tuple((lines + [at])[-3:]) not in set(zip(lines, lines[1:], lines[2:])):
            lines.append(at)
    block = clean(23)
    symbols = clean(72)
    symbols[3:10] = [w + "#" for w in symbols[3:10]]
    rows += [(100, "\n".join(lines), "en", "s"), (101, " ".join(block + clean(30) + block + clean(26)), "en", "s"), (102, " ".join(symbols), "en", "s")]
    got = {r["doc_id"]: r for r in quality_rules.rule_table(frame(spark, rows)).collect()}
    assert got[100]["n_dup_lines"] == 50 and got[100]["n_repeat_words"] == 0 and got[101]["n_repeat_words"] == 46 and got[101]["n_words"] == 102
    assert not any(r["base_failed"] for r in got.values())
    assert {i for i, r in got.items() if not r["kept"]} == {100, 101, 102}


def test_statistics_of_any_text():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text("ab #\n\t\r\x0bé", max_size=40), max_size=5))
    def same(texts):
        import pyarrow as pa

        found = quality_rules.text_statistics(*buffers.text_bytes(pa.array(texts, pa.string())))
        assert [tuple(int(found[c][i]) for c in quality_rules.COUNTS) for i in range(len(texts))] == [brute.counts(t) for t in texts]

    same()


def test_statistics_of_strings_that_collide_in_polynomial_hashes():
    import pyarrow as pa

    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    other = thue.translate(str.maketrans("ab", "ba"))
    texts = [f"{thue}\n{other}\n{thue}", f"{thue} {other} x {other} {thue} x {thue} {other} x", f"{thue}\n{other}", thue + other]
    found = quality_rules.text_statistics(*buffers.text_bytes(pa.array(texts)))
    assert [tuple(int(found[c][i]) for c in quality_rules.COUNTS) for i in range(len(texts))] == [brute.counts(t) for t in texts]


def test_statistics_of_a_very_long_text():
    import pyarrow as pa

    rng = random.Random(8)
    text = "\n".join(" ".join(rng.choice(["ab", "cd", "é", "#x", str(rng.randrange(5000))]) for _ in range(rng.randint(0, 12))) for _ in range(300_000))
    found = quality_rules.text_statistics(*buffers.text_bytes(pa.array(["a b", text])))
    assert tuple(int(found[c][1]) for c in quality_rules.COUNTS) == brute.counts(text)


def test_simhash(docs, none, corpus):
    fps = [brute.fingerprint(t) for _, t, _, _ in corpus]
    expected = list(zip((r[0] for r in corpus), (f"{f:016x}" for f in fps), brute.components([r[0] for r in corpus], fps)))
    got = [tuple(r) for r in simhash_dedup.near_duplicate_table(docs).collect()]
    assert sorted(got, key=key) == sorted(expected, key=key)
    left = simhash_dedup.without_near_copies(docs.filter("doc_id is not null"))
    assert left.columns == docs.columns and sorted((r["doc_id"],) for r in left.select("doc_id").collect()) == sorted(
        {(c,) for *_, c in expected if c is not None})
    assert simhash_dedup.near_duplicate_table(none).count() == 0


def test_near_copies_without_ids_and_with_one_id_on_two_texts(spark):
    rng = random.Random(31)
    texts = [prose(rng, "en", 80) for _ in range(30)]
    rows = [(None, t, "en", "s") for t in texts[:20]] + [(7, texts[20], "en", "s"), (7, texts[21], "en", "s"), (8, texts[22], "en", "s")]
    rows += [(None, texts[0], "en", "s"), (None, texts[22], "en", "s"), (3, texts[1].upper(), "en", "s"), (7, texts[20], "en", "s")]
    fps = [brute.fingerprint(t) for _, t, _, _ in rows]
    assert len(set(fps)) == 23 == len(set(brute.components(list(range(len(rows))), fps)))  # no two of the texts are linked
    left = sorted(((r["doc_id"], r["text"]) for r in simhash_dedup.without_near_copies(frame(spark, rows)).collect()), key=key)
    expected = [(None, texts[0]), *[(None, t) for t in texts[2:20]], (3, texts[1].upper()), (7, texts[20]), (7, texts[21]), (8, texts[22])]
    assert left == sorted(expected, key=key)


def test_fingerprints_in_segments(monkeypatch):
    rng = random.Random(8)
    texts = ["", " ", "one", "one Two", "a b c", "x" * 90, prose(rng, "de", 300), " \n".join(prose(rng, "en", 50) for _ in range(3))]
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(simhash_dedup, "SEGMENT_BYTES", size)
        assert [simhash_dedup.fingerprint(t.encode()) for t in texts] == [brute.fingerprint(t) for t in texts]


def test_balls_meet_at_every_distance(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64) * np.uint64(2)
    fps = list(map(int, base))
    for k, f in enumerate(base[:50]):
        for turned in range(1, 6):
            bits = rng.choice(64, turned, replace=False)
            fps.append(int(f) ^ sum(1 << int(b) for b in bits))
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    for count in (1, 1 << 16):  # few and many leading bits
        found = simhash_dedup.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), count)
        pairs = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in found.collect()]
        assert all(1 <= bin(a ^ b).count("1") <= 3 for a, b in pairs)
        root = {r["node"] % (1 << 64): r["root"] for r in components.components(found).collect()}
        expected = brute.components(signed, fps)
        assert [root.get(f, s) for f, s in zip(fps, signed)] == expected


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(300, 300), (400, 401), (401, 400)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 400: 400, 401: 400}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
