"""Block-wise operators against brute force, with one key that holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from linkshelf.operators import catalog, ordered, quality


def skewed(n=400, seed=3):
    rng = random.Random(seed)
    seqs = rng.sample(range(10_000), n)
    return [("hot" if rng.random() < 0.6 else rng.choice("abc"), s, rng.choice([None, "x", "y"]), rng.randint(0, 3)) for s in seqs]


def by_key(rows):
    out = {}
    for row in sorted(rows, key=lambda r: r[1]):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.fixture(scope="module")
def rows():
    return skewed()


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, seq bigint, v string, n int")


@pytest.mark.parametrize("block", [1, 37, 100_000])
def test_running_sums(df, rows, block):
    got = {(r.k, r.seq): (r.s, r.rn) for r in ordered.running_sums(df, ["k"], "seq", {"s": F.col("n"), "rn": F.lit(1)}, block).collect()}
    for key, part in by_key(rows).items():
        total = 0
        for i, row in enumerate(part, 1):
            total += row[3]
            assert got[key, row[1]] == (total, i)


@pytest.mark.parametrize("block", [1, 37, 100_000])
def test_carry_and_previous(df, rows, block):
    carried = {(r.k, r.seq): r.c for r in ordered.carry_forward(df, ["k"], "seq", F.col("v"), "c", block).collect()}
    before = {(r.k, r.seq): r.p for r in ordered.previous_value(df, ["k"], "seq", F.col("v"), "p", block).collect()}
    for key, part in by_key(rows).items():
        last = prev = None
        for row in part:
            assert before[key, row[1]] == prev
            prev = row[2]
            last = row[2] if row[2] is not None else last
            assert carried[key, row[1]] == last


@pytest.mark.parametrize("cap", [0, 1, 2, 5, 16, 1000])
def test_even_sample(df, rows, cap):
    got = {(r.k, r.seq) for r in ordered.evenly_sampled(df, ["k"], "seq", cap, 50).collect()}
    want = set()
    for key, part in by_key(rows).items():
        n = len(part)
        if cap <= 0:
            keep = []
        elif n <= cap:
            keep = range(n)
        elif cap == 1:
            keep = [0]
        else:
            step = (n - 1) / (cap - 1)
            keep = [round(i * step) for i in range(cap)]
        want |= {(key, part[i][1]) for i in keep}
    assert got == want


@pytest.mark.parametrize("cells", [1, 3, 1024])
@pytest.mark.parametrize("density", [5, 60])
@pytest.mark.parametrize("light, fan", [(0, 8), (100, 64), (100_000, 64)])
def test_spaced_points(spark, cells, density, light, fan):
    rng = random.Random(cells * 100 + density)
    rows = []
    for key, n in (("hot", 600), ("a", 5), ("b", 90)):
        t = rng.randint(-50, 50)
        for _ in range(n):
            t += rng.randint(0, 600 // density)
            rows.append((key, t, rng.random() < 0.05))
    df = spark.createDataFrame(rows, "k string, at bigint, cut boolean")
    got = sorted((r.k, r.at) for r in ordered.spaced_points(df, "k", "at", 100, F.col("cut"), cells, light, fan).collect())
    want = []
    for key in ("hot", "a", "b"):
        last = None
        for at in sorted({r[1] for r in rows if r[0] == key}):
            timed = last is None or at - last >= 100
            if timed:
                want.append((key, at))
            if timed or any(r[2] for r in rows if r[0] == key and r[1] == at):
                last = at
    assert got == sorted(want)


def test_tables_of_one_hot_key_are_composed_by_ranges(spark):
    """One key holds all rows, alone in most of its time blocks; instants far apart, close together and before zero."""
    rng = random.Random(9)
    ats = sorted({rng.choice([0, 1, 7, 40, 900, 5000]) * rng.randint(1, 40) - 60_000 + i * 11 for i in range(3000)})
    df = spark.createDataFrame([("hot", t) for t in ats], "k string, at bigint")
    want, last = [], None
    for t in ats:
        if last is None or t - last >= 50:
            want.append(t)
            last = t
    for cells, fan in ((1, 6), (2, 30)):
        got = ordered.spaced_points(df, "k", "at", 50, cells=cells, light=10, fan=fan)
        assert sorted(r.at for r in got.collect()) == want


@pytest.mark.parametrize("fan_bits", [1, 3, 24])
def test_totals_in_ranges_of_ranges(spark, fan_bits):
    """Block totals over nearly all whole numbers: every window of a range holds 2 ** fan_bits totals at most."""
    rng = random.Random(fan_bits)
    blks = sorted({rng.choice([1, 1 << 10, 1 << 30, 1 << 55]) * rng.randint(-40, 40) for _ in range(120)})
    rows = [(k, b, rng.randint(0, 9), rng.choice([None, "x", "y"])) for k in ("hot", "a") for b in blks if k == "hot" or b % 7 == 0]
    df = spark.createDataFrame(rows, "k string, __blk bigint, n bigint, v string")
    deep = min(4, ordered.levels(1, fan_bits))
    sums = {(r.k, r["__blk"]): r.n for r in ordered.sums_before(df, ["k"], ["n"], deep, fan_bits).collect()}
    lasts = {(r.k, r["__blk"]): r.v for r in ordered.last_before(df.drop("n"), ["k"], "v", deep, fan_bits).collect()}
    for key in ("hot", "a"):
        total, last = 0, None
        for _, b, n, v in [r for r in rows if r[0] == key]:
            assert (sums[key, b], lasts[key, b]) == (total, last)
            total, last = total + n, v or last


def test_levels_leave_a_bounded_last_window():
    for block in (1, 10, 1024, 100_000, 1 << 40):
        assert block * (1 << ordered.FAN_BITS) ** (ordered.levels(block) + 1) >= 1 << 63


def test_whole_tables_are_ordered_by_whole_numbers(spark):
    """Neighbours beyond 2 ** 53, where doubles tie, both ends of the range, and a missing order value, which comes first."""
    seqs = [None, -(1 << 62), -5, 0, 3, (1 << 60), (1 << 60) + 1, (1 << 60) + 2, (1 << 62)]
    df = spark.createDataFrame([(s, i) for i, s in enumerate(seqs)], "seq bigint, i int")
    for block in (1, 4, 100_000):
        rows = ordered.previous_value(ordered.row_numbers(df, [], "seq", "n", block), [], "seq", F.col("i"), "p", block).collect()
        assert {(r.i, r.n, r.p) for r in rows} == {(i, i + 1, i - 1 if i else None) for i in range(len(seqs))}
    assert ordered.row_numbers(df.limit(0), [], "seq", "n").isEmpty()


def test_attempts_of_sparse_keys(spark):
    rng = random.Random(5)
    log = [("hot" if i % 3 else "b", i * i * 1_000_003 - 4_000_000, rng.choice(["ok", "bad", "bad", "seen"]), rng.randint(0, 2)) for i in range(200)]
    df = spark.createDataFrame(log, "u string, seq bigint, e string, passes int")
    want, count = {}, {}
    for u, seq, e, passes in sorted(log, key=lambda r: r[1]):
        count[u] = count.get(u, 0) + 1 if e == "bad" else passes if e == "ok" else count.get(u, 0)
        want[u, seq] = count[u]
    for block in (1, 1000, 100_000):
        got = quality.attempts_along_log(df, "u", "seq", F.col("e") == "ok", F.col("e") == "bad", F.col("passes"), block=block)
        assert {(r.u, r.seq): r.attempts for r in got.collect()} == want


def test_packing_has_no_gaps(spark):
    dense, n = spark.range(0, 2500).filter("id % 3 <> 1"), 1667
    spread = {"dense": F.col("id"), "sparse": F.col("id") * (1 << 33), "time": F.col("id") * F.col("id") + 1_700_000_000_000_000, "minus": -F.col("id")}
    for order in spread.values():
        rows = ordered.packed(dense.select(order.alias("id")), "id", 100, 500).groupBy("block", "batch").agg(
            F.count("*").alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.min("id").alias("first")).collect()
        assert all(r.lo == 0 and r.hi == r.n - 1 for r in rows)
        in_order = [r.n for r in sorted(rows, key=lambda r: (r.block, r.batch))]
        assert in_order == [100] * (n // 100) + [n % 100]
        assert [r.first for r in sorted(rows, key=lambda r: (r.block, r.batch))] == sorted(r.first for r in rows)


def test_row_numbers_take_several_order_columns(spark):
    rows = [("a", 1.0, 2_500_000_000), ("a", 2.0, 1), ("a", 1.0, 3), ("a", 25.0, 0)]
    df = spark.createDataFrame(rows, "k string, s double, seq bigint").withColumn("at", F.col("s").cast("bigint"))
    got = ordered.row_numbers(df, ["k"], ["at", "s", "seq"], "n", block=10).orderBy("n").collect()
    assert [(r.s, r.seq) for r in got] == sorted((s, q) for _, s, q in rows)


def brute_names(new, existing):
    taken = set(existing)
    out = {}
    for folder, stem, seq in sorted(new, key=lambda r: r[2]):
        name, n = stem, 2
        while (folder, name) in taken:
            name, n = f"{stem} ({n})", n + 1
        taken.add((folder, name))
        out[seq] = name
    return out


@pytest.mark.parametrize("seed", range(6))
def test_unique_names_match_one_at_a_time_naming(spark, seed):
    rng = random.Random(seed)
    stems = ["a", "a (2)", "a (3)", "a (2) (2)", "b", "b (10)", "c (1)"] if seed % 2 else ["a", "b", "c"]
    new = [(rng.choice(["f", "g"]), rng.choice(stems), s) for s in rng.sample(range(1000), 40)]
    existing = {(rng.choice(["f", "g"]), rng.choice(stems + ["a (2)", "a (4)", "b (2)"])) for _ in range(5)}
    got = catalog.unique_names(
        spark.createDataFrame(new, "folder string, stem string, seq bigint"), spark.createDataFrame(sorted(existing), "folder string, stem string")
    )
    assert {r.seq: r.final_stem for r in got.collect()} == brute_names(new, existing)


@pytest.mark.parametrize("seed", range(5))
def test_names_of_nested_titles(spark, seed):
    """Titles that are numbers of one another, one root with most rows, dense and sparse numbers, all in one pass."""
    rng = random.Random(seed)

    def title():
        name = rng.choice(["a", "a", "a", "b", "é (0)"])
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 3])):
            name += f" ({rng.choice([1, 2, 2, 3, 3, 4, 5, 6, 7, rng.randint(2, 60), 10 ** 25 if rng.random() < 0.1 else 8])})"
        return name

    new = [("f", title(), s) for s in rng.sample(range(-10_000, 10_000), 250)]
    existing = {("f", title()) for _ in range(rng.choice([0, 3, 25]))}
    asked = []

    def counted(df, name):
        asked.append(name)
        return df.checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df.persist()

    got = catalog.unique_names(
        spark.createDataFrame(new, "folder string, stem string, seq bigint"), spark.createDataFrame(sorted(existing), "folder string, stem string"),
        store=counted,
    )
    assert {r.seq: r.final_stem for r in got.collect()} == brute_names(new, existing)
    assert len(asked) <= 2  # whatever the nesting and the number of meetings


@pytest.mark.parametrize("fan_bits", [1, 4, 24])
def test_position_gaps(spark, fan_bits):
    rng = random.Random(1)
    items = [("v", p) for p in rng.sample(range(1, 6000), 50)] + [("w", 3), ("w", 3), ("x", 1), ("x", 4), ("y", None), ("z", 2), ("z", None)]
    got = {r.v: r for r in quality.position_gaps(spark.createDataFrame(items, "v string, p int"), "v", "p", block=64, fan_bits=fan_bits if fan_bits > 4 else 29 + fan_bits).collect()}
    for key in "vwxyz":
        ps = sorted({p for k, p in items if k == key and p is not None})
        missing = [p for p in range(ps[0], ps[-1] + 1) if p not in ps][:10] if ps else []
        assert got[key].missing == missing
        assert got[key].rows == sum(k == key for k, _ in items)
        assert got[key].distinct_positions == len(ps)
