"""Ordered operators that survive a hot key.

A plain ``Window.partitionBy(key)`` puts a whole key (or a whole table without keys) in one task. Here the order column, a
whole number, is cut into blocks of ``block`` consecutive values, so a task holds no more than ``block`` different values of a
key. One small total per block carries the running state across blocks. The totals are cut the same way, into ranges of
``2 ** FAN_BITS`` blocks and ranges of those, until one window of at most that many narrow rows is left: sparse ids, timestamps and hashes
make more totals, never a larger window. Nothing is counted or sampled first.

Order values are unique within their key, or further order columns break their ties (rows of one value share a task). A NULL
order value comes first. Key columns must not be NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkshelf.session import materialize

BLOCK_ROWS = 100_000
#: Rows a bucket of the spacing rule holds on average.
BUCKET_ROWS = 200_000
#: Totals of blocks that one window may hold, as a power of two.
FAN_BITS = 24
#: Neighbouring time blocks whose entry-to-exit tables are composed into one.
CHAIN_FAN = 64
_BLK = "__blk"
_UP = "__up"
#: Place of a NULL order value.
_FIRST = -(1 << 63) + 1


def place(order: str) -> Column:
    """The order value as a whole number; NULL comes first."""
    return F.coalesce(F.col(order).cast("bigint"), F.lit(_FIRST))


def blocked(df: DataFrame, order: str | list[str], block: int, name: str = _BLK) -> DataFrame:
    """``df`` with its block: ``block`` consecutive values of the (first) order column."""
    first = order if isinstance(order, str) else order[0]
    return df.withColumn(name, F.call_function("div", place(first), F.lit(block).cast("bigint")))


def levels(block: int, fan_bits: int = FAN_BITS) -> int:
    """Levels of ranges between blocks of ``block`` values and the last window over all 64-bit values."""
    return max(0, math.ceil((64 - math.log2(block)) / fan_bits) - 1)


def _ranges(totals: DataFrame, fan_bits: int) -> DataFrame:
    return totals.withColumn(_UP, F.call_function("div", F.col(_BLK), F.lit(1 << fan_bits).cast("bigint")))


def _before(keys: list[str], *up: str):
    return Window.partitionBy(*([*keys, *up] or [F.lit(0)])).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)


def sums_before(totals: DataFrame, keys: list[str], names: list[str], deep: int, fan_bits: int = FAN_BITS) -> DataFrame:
    """``keys, __blk, names``: of block totals, the sums over all earlier blocks of the key; ``deep`` levels of ranges."""
    sums = lambda w: [F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in names]
    if not deep:
        return totals.select(*keys, _BLK, *sums(_before(keys)))
    ranged = _ranges(totals, fan_bits)
    upper = ranged.groupBy(*keys, F.col(_UP).alias(_BLK)).agg(*[F.sum(n).alias(n) for n in names])
    above = sums_before(upper, keys, names, deep - 1, fan_bits).withColumnsRenamed({_BLK: _UP, **{n: f"__a_{n}" for n in names}})
    local = ranged.select(*keys, _BLK, _UP, *sums(_before(keys, _UP)))
    return local.join(above, [*keys, _UP]).select(*keys, _BLK, *[(F.col(n) + F.col(f"__a_{n}")).alias(n) for n in names])


def last_before(totals: DataFrame, keys: list[str], name: str, deep: int, fan_bits: int = FAN_BITS) -> DataFrame:
    """``keys, __blk, name``: of one value a block, the latest non-NULL one of all earlier blocks of the key."""
    last = lambda w: F.last(name, ignorenulls=True).over(w).alias(name)
    if not deep:
        return totals.select(*keys, _BLK, last(_before(keys)))
    ranged = _ranges(totals, fan_bits)
    upper = ranged.groupBy(*keys, F.col(_UP).alias("__u")).agg(
        F.max_by(name, F.when(F.col(name).isNotNull(), F.col(_BLK))).alias(name)).withColumnRenamed("__u", _BLK)
    above = last_before(upper, keys, name, deep - 1, fan_bits).withColumnsRenamed({_BLK: _UP, name: "__above"})
    local = ranged.select(*keys, _BLK, _UP, last(_before(keys, _UP)))
    return local.join(above, [*keys, _UP]).select(*keys, _BLK, F.coalesce(name, "__above").alias(name))


def _inside(keys: list[str], order: str | list[str]):
    return Window.partitionBy(*keys, _BLK).orderBy(*([order] if isinstance(order, str) else order))


def first_by(df: DataFrame, keys: list[str], order: str, cols: list[str]) -> DataFrame:
    """The row with the smallest ``order`` per key, by partial aggregation."""
    best = F.min_by(F.struct(*cols), F.col(order)).alias("b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"b.{c}").alias(c) for c in cols])


def last_by(df: DataFrame, keys: list[str], order: str, cols: list[str]) -> DataFrame:
    """The row with the largest ``order`` per key, by partial aggregation."""
    best = F.max_by(F.struct(*cols), F.col(order)).alias("b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"b.{c}").alias(c) for c in cols])


def running_sums(
    df: DataFrame, keys: list[str], order: str | list[str], sums: dict[str, Column], block: int = BLOCK_ROWS,
    dense: bool = False,
) -> DataFrame:
    """Inclusive running sum of each expression per key, in ``order``; of several columns the first is cut into blocks.

    ``dense``: the order values are row numbers or the like, whose blocks are as few as the rows by ``block``; one window holds the totals.
    """
    base = blocked(df, order, block)
    inside = _inside(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    offset = {n: f"__o_{n}" for n in sums}
    totals = base.groupBy(*keys, _BLK).agg(*[F.coalesce(F.sum(e), F.lit(0)).alias(offset[n]) for n, e in sums.items()])
    offsets = sums_before(totals, keys, list(offset.values()), 0 if dense else levels(block))
    local = base.withColumns({n: F.sum(e).over(inside) for n, e in sums.items()})
    joined = local.join(offsets, [*keys, _BLK])
    return joined.withColumns({n: F.col(n) + F.col(o) for n, o in offset.items()}).drop(_BLK, *offset.values())


def row_numbers(df: DataFrame, keys: list[str], order: str | list[str], name: str = "rn", block: int = BLOCK_ROWS) -> DataFrame:
    """1, 2, 3 ... per key, in ``order``."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("bigint")}, block)


def carry_forward(
    df: DataFrame, keys: list[str], order: str, value: Column, name: str, block: int = BLOCK_ROWS
) -> DataFrame:
    """Latest non-NULL ``value`` up to and including each row, per key."""
    base = blocked(df, order, block).withColumn("__v", value)
    inside = _inside(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.when(F.col("__v").isNotNull(), place(order))
    lasts = base.groupBy(*keys, _BLK).agg(F.max_by("__v", seen).alias("__o"))
    offsets = last_before(lasts, keys, "__o", levels(block))
    local = base.withColumn("__w", F.last("__v", ignorenulls=True).over(inside))
    return (
        local.join(offsets, [*keys, _BLK])
        .withColumn(name, F.coalesce("__w", "__o"))
        .drop(_BLK, "__v", "__w", "__o")
    )


def previous_value(
    df: DataFrame, keys: list[str], order: str, value: Column, name: str, block: int = BLOCK_ROWS
) -> DataFrame:
    """``value`` of the preceding row per key; NULL on the first row."""
    base = blocked(df, order, block).withColumn("__v", F.struct(value.alias("v")))
    ends = base.groupBy(*keys, _BLK).agg(F.max_by("__v", place(order)).alias("__o"))
    offsets = last_before(ends, keys, "__o", levels(block))
    local = base.withColumn("__p", F.lag("__v").over(_inside(keys, order)))
    return (
        local.join(offsets, [*keys, _BLK])
        .withColumn(name, F.coalesce("__p", "__o")["v"])
        .drop(_BLK, "__v", "__p", "__o")
    )


def evenly_sampled(
    df: DataFrame, keys: list[str], order: str, cap: int, block: int = BLOCK_ROWS
) -> DataFrame:
    """At most ``cap`` rows per key spread over the whole sequence, first and last included.

    Row ``p`` stays when it is the half-even rounding of ``i * step`` for some ``i < cap``.
    """
    if cap <= 0:
        return df.limit(0)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    if cap == 1:
        picks = F.array(F.lit(0).cast("bigint"))
    else:
        picks = F.transform(
            F.sequence(F.lit(0), F.lit(cap - 1)),
            lambda i: F.bround(i * ((F.col("__n") - 1) / F.lit(float(cap - 1))), 0).cast("bigint"),
        )
    wanted = sizes.select(*keys, F.when((F.col("__n") > cap) | (F.lit(cap) == 1), picks).alias("__picks"))
    numbered = row_numbers(df, keys, order, "__rn", block)
    keep = F.col("__picks").isNull() | F.array_contains("__picks", F.col("__rn") - 1)
    return numbered.join(wanted, keys).filter(keep).drop("__rn", "__picks")


def spaced_points(
    df: DataFrame, key: str, at: str, interval: int, cut: Column | None = None, cells: int = 1024, light: int = BLOCK_ROWS,
    fan: int = CHAIN_FAN,
) -> DataFrame:
    """Instants that pass the spacing rule: ``key, at``.

    In time order an instant is taken when at least ``interval`` passed since the last taken
    one (the first always is); a ``cut`` row is taken too and restarts the clock. The result
    holds the instants the spacing rule itself picked. ``at`` and ``interval`` are whole
    numbers of one unit.

    The rule is sequential. A key of at most ``light`` rows is walked in one go. A heavier key is
    split into time blocks: each block first says, for every instant it could be entered at,
    where the clock stands when it is left. Tables of ``fan`` neighbouring blocks are composed into one, those again,
    until so few are left per key that one task can follow them; the clock is then handed back down, range by range, and every
    block is walked on its own with a known entry state. So no task sees more than ``fan`` tables of a range, and a table has at most
    ``interval`` + 1 entries.
    """
    width = int(interval) * int(cells)
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi")).agg(
        F.sum("n"), F.max("n"), F.min("lo").cast("bigint"), F.max("hi").cast("bigint")).first()
    rows, most, lo, hi = (int(v or 0) for v in sizes)
    # Many blocks share one Python call, but no more than about BUCKET_ROWS rows: buckets grow in number, not in size.
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))
    bucket = lambda *cols: F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")
    flag = F.lit(False) if cut is None else F.coalesce(cut, F.lit(False))
    points = (
        df.groupBy(key, at)
        .agg(F.max(flag).alias("cut"))
        .select(F.col(key).alias("k"), F.col(at).cast("bigint").alias("at"), "cut")
    )
    if most > light:
        rows_per_key = df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        heavy = rows_per_key.filter(F.col("n") > light).select("k", F.lit(True).alias("heavy"))
        points = points.join(heavy, "k", "left").withColumn("blk", F.when(F.col("heavy"), F.floor(F.col("at") / width)).otherwise(0))
        points = points.withColumn("part", F.when(F.col("heavy"), bucket("k", "blk")).otherwise(bucket("k")))
    else:
        points = points.withColumns({"blk": F.lit(0).cast("bigint"), "part": bucket("k")})
    key_type = points.schema["k"].dataType.simpleString()

    def segments(pdf, *by):
        """Frame sorted by key and ``by``, and the row ranges equal in all but the last of them."""
        import numpy as np
        import pandas as pd

        # Keys are sorted by number: comparing strings row by row would dominate the task.
        codes = pd.factorize(pdf["k"])[0]
        columns = [codes, *[pdf[c].to_numpy() for c in by]]
        order = np.lexsort(columns[::-1])
        changed = np.zeros(len(pdf), dtype=bool)
        for values in columns[:-1]:
            ranked = values[order]
            changed[1:] |= ranked[1:] != ranked[:-1]
        edges = [0, *np.flatnonzero(changed).tolist(), len(pdf)]
        return pdf.iloc[order].reset_index(drop=True), list(zip(edges[:-1], edges[1:])) if len(pdf) else []

    def successors(t, is_cut):
        """For each instant the next one taken after it was taken, and the first cut."""
        import bisect

        import numpy as np

        n = len(t)
        if n > 64:
            stops = np.append(np.flatnonzero(is_cut), n)
            next_cut = stops[np.searchsorted(stops, np.arange(n + 1))]
            return np.minimum(np.searchsorted(t, t + interval), next_cut[1:]).tolist(), int(next_cut[0])
        # Array calls cost more than they save on a short run.
        ts, follow, cut = t.tolist(), [n] * n, n
        for i in range(n - 1, -1, -1):
            follow[i] = min(bisect.bisect_left(ts, ts[i] + interval), cut)
            cut = i if is_cut[i] else cut
        return follow, cut

    def summarize(pdf):
        import numpy as np
        import pandas as pd

        pdf, ranges = segments(pdf, "blk", "at")
        times, cuts, keys, blks = (pdf[c].to_numpy() for c in ("at", "cut", "k", "blk"))
        out = []
        for lo, hi in ranges:
            t, n = times[lo:hi], hi - lo
            follow, first_cut = successors(t, cuts[lo:hi])
            leave = list(range(n))
            for i in range(n - 1, -1, -1):
                if follow[i] < n:
                    leave[i] = leave[follow[i]]
            reach = int(np.searchsorted(t, int(blks[lo]) * width + interval))
            edges, exits = [], []
            for entry in range(reach + 1):
                first = min(entry, first_cut)
                gone = int(t[leave[first]]) if first < n else None
                edge = int(t[entry]) if entry < n else None
                if exits and exits[-1] == gone:
                    edges[-1] = edge
                else:
                    edges.append(edge)
                    exits.append(gone)
            out.append((keys[lo], int(blks[lo]), edges, exits))
        return pd.DataFrame(out, columns=["k", "blk", "edges", "exits"])

    def left_at(edges, exits, need):
        """Where the clock stands after a block entered with ``need``; None leaves it as it was."""
        import bisect

        spot = bisect.bisect_left(edges, need)
        return exits[spot] if spot < len(exits) else None

    def table(edges, exits):
        """Entries as whole numbers; the open last edge and the exit it leads to may be missing."""
        return [int(e) for e in edges if e is not None and e == e], [None if x is None or x != x else int(x) for x in exits]

    def composed(first, second, reach):
        """One table for two neighbouring ranges. No clock asks for more than ``reach``."""
        (edges, exits), (edges2, exits2) = first, second
        pairs = []
        for i, gone in enumerate(exits):
            if gone is not None:
                then = left_at(edges2, exits2, gone + interval)
                pairs.append((edges[i] if i < len(edges) else None, gone if then is None else then))
        if len(pairs) <= len(edges) and (not edges or edges[-1] < reach):
            # Nothing was taken in the first range: the clock enters the second as it came.
            pairs += [(edges2[i] if i < len(edges2) else None, gone) for i, gone in enumerate(exits2)]
        out_edges, out_exits = [], []
        for edge, gone in pairs:
            if out_edges and (out_edges[-1] is None or out_edges[-1] >= reach):
                break
            if out_exits and out_exits[-1] == gone:
                out_edges[-1] = edge
            else:
                out_edges.append(edge)
                out_exits.append(gone)
        return [e for e in out_edges if e is not None], out_exits

    def compose(blocks):
        """Tables of ranges from those of their blocks; ``blocks`` are so many time blocks."""
        def run(pdf):
            import pandas as pd

            pdf, ranges = segments(pdf, "up", "blk")
            edges, exits, keys, blks, ups = (pdf[c].tolist() for c in ("edges", "exits", "k", "blk", "up"))
            out = []
            for lo, hi in ranges:
                reach = ups[lo] * blocks * fan * width + interval
                reach = max(reach, blks[lo] * blocks * width + interval)
                whole = table(edges[lo], exits[lo])
                for row in range(lo + 1, hi):
                    whole = composed(whole, table(edges[row], exits[row]), reach)
                out.append((keys[lo], int(ups[lo]), whole[0], whole[1]))
            return pd.DataFrame(out, columns=["k", "blk", "edges", "exits"])
        return run

    def follow(pdf, start):
        import pandas as pd

        state = dict(zip(zip(start["k"].tolist(), start["blk"].tolist()), start["last"].tolist()))
        pdf, ranges = segments(pdf, "up", "blk")
        edges, exits, keys, ups = (pdf[c].tolist() for c in ("edges", "exits", "k", "up"))
        entries = []
        for lo, hi in ranges:
            last = state.get((keys[lo], ups[lo]))
            last = None if last is None or pd.isna(last) else int(last)
            for row in range(lo, hi):
                entries.append(last)
                gone = left_at(*table(edges[row], exits[row]), -(1 << 62) if last is None else last + interval)
                last = last if gone is None else gone
        return pd.DataFrame({"k": pdf["k"], "blk": pdf["blk"], "last": pd.array(entries, dtype="Int64")})

    def entered(tables, blocks, span):
        """``k, blk, last``: the clock at the start of each range of ``blocks`` time blocks; a key has at most ``span`` of them."""
        few = span <= fan
        ranged = tables.withColumn("up", F.lit(0).cast("bigint") if few else F.floor(F.col("blk") / fan)).withColumn("part", bucket("k", "up"))
        if few:
            above = df.sparkSession.createDataFrame([], f"k {key_type}, blk bigint, last bigint")
        else:
            upper = materialize(ranged.groupBy("part").applyInPandas(compose(blocks), table_type), "tables")
            above = entered(upper, blocks * fan, span // fan + 2)
        return ranged.groupBy("part").cogroup(above.withColumn("part", bucket("k", "blk")).groupBy("part")).applyInPandas(
            follow, f"k {key_type}, blk bigint, last bigint")

    def walk(rows, entry):
        import pandas as pd

        state = {} if entry is None else dict(zip(zip(entry["k"].tolist(), entry["blk"].tolist()), entry["last"].tolist()))
        rows, ranges = segments(rows, "blk", "at")
        times, cuts, keys, blks = (rows[c].to_numpy() for c in ("at", "cut", "k", "blk"))
        taken = []
        for lo, hi in ranges:
            start = state.get((keys[lo], blks[lo]))
            last = -(1 << 62) if start is None or pd.isna(start) else int(start)
            t, n = times[lo:hi], hi - lo
            follow, first_cut = successors(t, cuts[lo:hi])
            i = min(int(t.searchsorted(last + interval)), first_cut)
            while i < n:
                at_value = int(t[i])
                if at_value - last >= interval:
                    taken.append(lo + i)
                last, i = at_value, follow[i]
        return rows.loc[taken, ["k", "at"]]

    if most > light:
        table_type = f"k {key_type}, blk bigint, edges array<bigint>, exits array<bigint>"
        # Read once on the way up and once on the way down.
        tables = materialize(points.filter("heavy").groupBy("part").applyInPandas(summarize, table_type), "tables")
        entries = entered(tables, 1, hi // width - lo // width + 1).withColumn("part", bucket("k", "blk"))
        taken = points.groupBy("part").cogroup(entries.groupBy("part")).applyInPandas(walk, f"k {key_type}, at bigint")
    else:
        taken = points.groupBy("part").applyInPandas(lambda pdf: walk(pdf, None), f"k {key_type}, at bigint")
    return taken.select(F.col("k").alias(key), F.col("at").alias(at))


def packed(df: DataFrame, order: str, size: int, block: int = BLOCK_ROWS) -> DataFrame:
    """Request batches of at most ``size`` rows: adds ``block, batch, i``.

    Rows are numbered by their place in ``order``, whatever the gaps between its values, so only the last batch of all is
    short. A block is ``block`` rows, a multiple of ``size``; ``(block, batch)`` orders batches.
    """
    whole = block - block % size
    numbered = row_numbers(df, [], order, "__r", block)
    return numbered.withColumns({
        "block": F.expr(f"(__r - 1) div {whole}L"), "batch": F.expr(f"(__r - 1) % {whole}L div {size}L"),
        "i": F.expr(f"cast((__r - 1) % {size} as int)"),
    }).drop("__r")
