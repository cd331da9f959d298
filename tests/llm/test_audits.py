"""Source divergence and the conversation trie against plain versions."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from linkshelf.llm import conversation_trie, source_divergence  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string"
TURNS = "conv_id bigint, turn bigint, role string, text string"


def test_source_divergence(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "GROUP_CELLS", 30)
    monkeypatch.setattr(source_divergence, "BLOCK_SOURCES", 2)
    monkeypatch.setattr(source_divergence, "PAIR_CHUNK", 7)
    monkeypatch.setattr(source_divergence, "SEGMENT_BYTES", 50)
    monkeypatch.setattr(source_divergence, "FLUSH_BYTES", 900)
    rng = random.Random(3)
    words = ["Wort", "über", "the", "a'b", "x1y", "é", "日本", "zz", "K"]
    rows = []
    for i in range(400):
        text = " ".join(rng.choice(words) + (rng.choice(words) if rng.random() < 0.2 else "") for _ in range(rng.randint(0, 14)))
        rows.append((text, rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", "d", "e", None])))
    rows += [rows[3]] * 150 + [(None, "en", "none"), ("", "fr", "a"), ("few words", "fr", "b"), ("12 34", "xx", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], DOCS).repartition(5).withColumns({c: F.lit(0) for c in ("term", "digest", "p", "gid", "rank")})
    assert {tuple(r) for r in source_divergence.source_divergence(df).collect()} == brute.divergence(rows)


def test_source_divergence_of_nothing(spark):
    assert source_divergence.source_divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_shares_beyond_64_bits(spark):
    row = spark.range(1).select(source_divergence.share(F.lit(4 * 10**12), F.lit(9 * 10**12 + 1)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (4 * 10**12 + 2) // (9 * 10**12 + 1)


def test_terms_of_a_very_long_text_are_cut_in_segments():
    text = ("Wort über " * 700_000 + "x" * 5_000_000).encode()
    got = list(source_divergence.segments(text))
    assert len(got) > 1 and sum(map(len, got)) == 1_400_001


def conversations(seed, count):
    """Shared openings, copies, a long one, missing bases, repeated turns and nulls."""
    rng = random.Random(seed)
    texts = ["hi", "hi there", "", None, "what is it", "fine\tthank\nyou", "ok"]
    rows = []
    for c in rng.sample(range(-45, 3 * count), count):
        common = [("user", "hi"), ("bot", "hi there"), ("user", "ok")] if rng.random() < 0.5 else []
        turns = common + [(rng.choice(["user", "bot", None]), rng.choice(texts)) for _ in range(rng.randint(0 if common else 1, 5))]
        rows += [(c, rng.choice([t, t * 1000, None if t == 0 else t]), *turn) for t, turn in enumerate(turns)]
    rows += [(4000 + i, t, "user", f"turn {t}") for i in range(8) for t in range(40)]
    rows += [(None, 0, "user", "nobody's"), *rows[:3]]
    return rows


@pytest.mark.parametrize("segment, shard", [(256, 100_000), (3, 20), (1, 1)])
def test_conversation_trie(spark, monkeypatch, segment, shard):
    monkeypatch.setattr(conversation_trie, "SEGMENT_TURNS", segment)
    monkeypatch.setattr(conversation_trie, "SHARD_TURNS", shard)
    monkeypatch.setattr(conversation_trie, "END_IDS", 16)
    rows = conversations(segment, 60)
    df = spark.createDataFrame(rows, TURNS).repartition(5).withColumns({c: F.lit("x") for c in ("depth", "mins", "words", "base", "at")})
    got = conversation_trie.conversation_trie(df).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute.trie(rows)


def test_conversation_trie_of_nothing_and_of_lost_turns(spark):
    assert conversation_trie.conversation_trie(spark.createDataFrame([], TURNS)).count() == 0
    # Ids whose first turns are their base's, and there is no base: nothing is left.
    rows = [(c, 0, "user", "x") for c in (1, 2, 3, 5, 6, 7, 8, 9)]
    assert {tuple(r) for r in conversation_trie.conversation_trie(spark.createDataFrame(rows, TURNS)).collect()} == brute.trie(rows)


def test_double_arrays_hold_what_was_packed():
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 9, 500)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    symbols = np.where(rng.random(starts[-1]) < 0.6, rng.integers(1, 4, starts[-1]), rng.integers(1, 800, starts[-1]))
    trie, nodes = conversation_trie.pack(starts, symbols)
    paths = {}
    for k in range(len(sizes)):
        at = 0
        for i in range(starts[k], starts[k + 1]):
            at = int(trie.step(np.array([at]), symbols[i: i + 1])[0])
            assert at == nodes[i] and paths.setdefault(at, tuple(symbols[starts[k]: i + 1])) == tuple(symbols[starts[k]: i + 1])
    assert len(set(paths.values())) == len(paths) == (trie.check >= 0).sum()
    assert trie.step(np.array([0]), np.array([900])).tolist() == [-1]
