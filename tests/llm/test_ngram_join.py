"""The n-gram join against all pairs, with small frequency classes so that pairs and triples of tokens are used."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from linkshelf.llm import ngram_join  # noqa: E402

DOCS = "doc_id bigint, text string"


def texts(seed):
    """Families of edited copies around the threshold, templates, chains, shared passages and odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(3))
    made = []
    for size in (6, 9, 30, 60, 130):
        base = [word() for _ in range(size)]
        for k in range(14):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, size // 25))):
                copy[rng.randrange(size)] = word()
            made.append(copy if k % 4 else copy[: rng.randint(int(size * 0.85), size)])
    template = [word() for _ in range(80)]
    made += [template + [word() for _ in range(rng.choice([5, 8, 11]))] for _ in range(25)]
    chain = [word() for _ in range(100)]
    for k in range(12):
        chain = chain[4:] + [word() for _ in range(4)]
        made.append(chain)
    passage = [word() for _ in range(30)]
    made += [[word() for _ in range(rng.randint(5, 60))] + passage + [word() for _ in range(20)] for _ in range(20)]
    out = [" ".join(w) for w in made] + [t.upper() for t in (" ".join(made[0]), " ".join(made[40]))]
    out += [None, "", " \n", "one", "ONE", "one two", "one two three", "one two three four", "a " * 500, "b " * 3 + "c"]
    rng.shuffle(out)
    rows = [(None if i % 50 == 7 else i, t) for i, t in enumerate(out)]
    return rows + rows[:3]


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


@pytest.mark.parametrize("seed, alone, pairs", [(1, 16, 512), (2, 1, 6), (3, 2, 3)])
def test_join(spark, monkeypatch, seed, alone, pairs):
    monkeypatch.setattr(ngram_join, "ALONE", alone)
    monkeypatch.setattr(ngram_join, "IN_PAIRS", pairs)
    monkeypatch.setattr(ngram_join, "PAIRS_A_COPY", 3)
    rows = texts(seed)
    df = spark.createDataFrame(rows, DOCS).repartition(4).withColumns({c: F.lit("x") for c in ("cls", "n", "key", "root", "u")})
    got = sorted((tuple(r) for r in ngram_join.similarity_join(df).collect()), key=key)
    assert got == sorted(brute.joined(rows), key=key)


def test_join_of_nothing(spark):
    assert ngram_join.similarity_join(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("alone, pairs", [(3, 40), (0, 5), (0, 0), (10**6, 10**6)])
def test_linked_sets_share_a_key_that_leaves_them_a_chance(monkeypatch, alone, pairs):
    monkeypatch.setattr(ngram_join, "IN_PAIRS", pairs)
    rng = np.random.default_rng(alone + pairs)
    pool = np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64))
    counts = rng.integers(1, 90, len(pool))
    often = counts > alone
    frequent = ngram_join.Frequent((pool >> np.uint64(32))[often], counts[often])
    checked = 0
    for _ in range(600):
        n = int(rng.choice([6, 7, 8, 13, 20, 33, 64, 127, 128, 300]))
        x = rng.choice(pool, n, replace=False)
        lost = int(rng.integers(0, ngram_join.spare(n) + 1))
        y = np.unique(np.concatenate([x[lost:], rng.choice(pool, int(rng.integers(0, ngram_join.spare(n) + 2)), replace=False)]))
        x = np.unique(x)
        common = len(np.intersect1d(x, y))
        if 100 * common < 85 * (len(x) + len(y) - common) or np.array_equal(x, y):
            continue
        (kx, bx), (ky, by) = (ngram_join.signatures(s, frequent.of(s)) for s in (x, y))
        both = np.intersect1d(kx, ky)
        best = max(min(bx[kx == k].max(), by[ky == k].max()) for k in both)
        assert 185 * best >= 85 * (len(x) + len(y))
        checked += 1
    assert checked > 150


def test_combinations_leave_less_of_a_chance_the_later_they_are():
    rng = np.random.default_rng(5)
    for n, own, often in ((300, 20, 400), (300, 20, 600), (90, 5, 600)):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        frequent = ngram_join.Frequent(x[own:] >> np.uint64(32), np.full(n - own, often))
        _, bounds = ngram_join.signatures(x, frequent.of(x))
        assert bounds.max() == n and (bounds[own:].max(), bounds.min()) == (n - own, n - ngram_join.spare(n))
        # With a set of its size, a pair that meets at the last ones only has no chance.
        assert 185 * bounds.min() < 85 * 2 * n


def test_a_class_read_by_several_tasks_is_at_a_key_once(spark):
    rng = random.Random(9)
    words = [str(rng.random()) for _ in range(40)]
    near = words[:20] + ["other"] + words[21:]
    rows = [(i, " ".join(near if i == 7 else words)) for i in range(40)]
    index = ngram_join.indexed(spark.createDataFrame(rows, DOCS).repartition(8))
    assert index.filter("size(keys) > 0").count() > 2
    met = ngram_join.meetings(index).select("key", "cls").collect()
    assert len(met) == len(set(met)) and len({r["cls"] for r in met}) == 2


def test_tokens_are_the_distinct_shingles_of_each_whole_text():
    import pyarrow as pa

    rng = random.Random(4)
    gaps = [" ", "\t", "\n ", "\x0b", "\x0c\r", "\x1c", "\u00a0", "\u2003", "  "]
    texts = ["".join(rng.choice(["Aa", "b", "é", "É", "ccc", "\0"]) + rng.choice(gaps) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 300]))) for _ in range(200)]
    texts += ["", " ", " a", "x" * 3_000_000, "a b " * 400_000]
    column = pa.array(["before", *texts]).slice(1)
    tokens, starts = ngram_join.token_lists(column)
    known = {}
    for text, low, high in zip(texts, starts[:-1], starts[1:]):
        words = brute.WORD.findall(brute.lowered(text))
        k = min(4, len(words))
        expected = {tuple(words[i: i + k]) for i in range(len(words) - k + 1)} if words else set()
        got = tokens[low:high].tolist()
        assert len(got) == len(set(got)) == len(expected) and got == sorted(got)
        assert known.setdefault(frozenset(got), expected) == expected
    assert starts[-1] == len(tokens)
