"""The trie of all conversations, from double-array tries of prefix shards.

Turns are known by the SHA-256 of role and text. A conversation is cut into segments of at most ``SEGMENT_TURNS`` turns, and
what stands before a segment is known by a chained hash, so that no conversation, however long, is held in one row. Equal
segments after equal beginnings are one sequence, with the least conversation id. Sequences are sharded by the prefix they
open with; a prefix that many sequences share is divided further, by sequence. Every shard numbers its turns densely
and packs its sequences into BASE and CHECK arrays; walking them gives each sequence the least member of its nodes. Nodes
that several shards share carry the hash of their path, and their least members are merged over all shards.

A node is named by its least member and its depth. All it counts is a sum over its members once they know which nodes of
their path they stand for themselves: a member that is a node's least one brings the node's own share, and

    saved(v) = sum over members of the words from v's depth on, where the member isn't the least one of the node

Defined cases: rows without ``conv_id`` belong to no conversation; null role or text is empty; turns of one number are ordered by
the hash of role and text, repeated rows are repeated turns; conversations that lose all turns are members of the root; an empty table
gives no rows; very long texts are hashed and counted whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkshelf.llm.columns import dealt_apart
from linkshelf.session import materialize

GROUP_SIZE = 20
MOST_SHARED = 4
SEGMENT_TURNS = 256
#: Turns a shard packs at least before its prefix is divided.
SHARD_TURNS = 100_000
#: Conversation ids that are joined to one string at once.
END_IDS = 4096
_TRIES = 64


class DoubleArray:
    """A trie over numbered symbols: the child of node ``s`` by symbol ``a`` is ``BASE[s] + a`` if ``CHECK`` there is ``s``. Node 0 is the root."""

    def __init__(self):
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
        self.check[0] = -2

    def _room(self, upto: int) -> None:
        if upto > len(self.check):
            more = max(upto, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _fitting(self, symbols: np.ndarray, free: np.ndarray) -> int:
        """A base at which every child's cell is free: among the first free cells, or behind all that is taken."""
        shape = symbols - symbols[0]
        starts = free[:_TRIES]
        self._room(int(starts[-1] + shape[-1] + 1) if len(starts) else 0)
        fits = np.flatnonzero((self.check[starts[:, None] + shape] == -1).all(1))
        start = int(starts[fits[0]]) if len(fits) else int(np.flatnonzero(self.check != -1)[-1]) + 1
        self._room(start + int(shape[-1]) + 1)
        return start - int(symbols[0])

    def extend(self, nodes: np.ndarray, symbols: np.ndarray) -> None:
        """Give every node its children: all of them in one call."""
        edges = np.unique(np.stack([nodes, symbols], 1), axis=0)
        starts = np.flatnonzero(np.concatenate([[True], edges[1:, 0] != edges[:-1, 0]]))
        counts = np.diff(np.append(starts, len(edges)))
        for k in np.argsort(-counts, kind="stable")[: int((counts > 1).sum())]:
            children = edges[starts[k]: starts[k] + counts[k]]
            base = self._fitting(children[:, 1], np.flatnonzero(self.check[: 4 * _TRIES + len(self.check) // 2] == -1))
            self.base[children[0, 0]] = base
            self.check[base + children[:, 1]] = children[0, 0]
        single = edges[starts[counts == 1]]
        cells = np.flatnonzero(self.check == -1)
        if len(cells) < len(single):
            self._room(len(self.check) + len(single) - len(cells))
            cells = np.flatnonzero(self.check == -1)
        cells = cells[: len(single)]
        self.base[single[:, 0]] = cells - single[:, 1]
        self.check[cells] = single[:, 0]

    def step(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The children by ``symbols``, -1 where there is none."""
        cells = self.base[nodes] + symbols
        inside = (cells > 0) & (cells < len(self.check))
        return np.where(inside & (self.check[np.where(inside, cells, 0)] == nodes), cells, -1)


def _numbered(column) -> tuple[np.ndarray, pa.Array]:
    encoded = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
    return encoded.indices.to_numpy().astype(np.int64), encoded.dictionary


def pack(starts: np.ndarray, symbols: np.ndarray) -> tuple[DoubleArray, np.ndarray]:
    """The double array of all sequences ``symbols[starts[k]:starts[k + 1]]``, and the node every symbol leads to."""
    trie, sizes = DoubleArray(), np.diff(starts)
    nodes, at = np.zeros(len(symbols), np.int64), np.zeros(len(sizes), np.int64)
    for level in range(int(sizes.max(initial=0))):
        live = np.flatnonzero(sizes > level)
        here = symbols[starts[live] + level]
        trie.extend(at[live], here)
        at[live] = trie.step(at[live], here)
        nodes[starts[live] + level] = at[live]
    return trie, nodes


def _shard(table: pa.Table) -> pa.Table:
    """Least members of the nodes on each sequence's path, and path hashes where other shards may share them."""
    chains, chain_names = _numbered(table.column("chain"))
    lists = table.column("turns").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    turns, turn_names = _numbered(lists.flatten())
    sizes = np.asarray(lists.value_lengths()).astype(np.int64)
    ends = np.cumsum(sizes)
    # Each sequence starts with what stands before it, as its first symbol.
    turns = np.insert(turns + 1, ends - sizes, chains + len(turn_names) + 1)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    trie, nodes = pack(starts, turns)
    least = np.full(len(trie.check), np.iinfo(np.int64).max)
    np.minimum.at(least, nodes, np.repeat(table.column("least").to_numpy(), sizes + 1))
    shared = table.column("shared").to_numpy(zero_copy_only=False)
    paths, out = {}, {"mins": [], "paths": []}
    chain_names, turn_names = chain_names.to_pylist(), turn_names.to_pylist()
    for k, open_ in enumerate(shared.tolist()):
        low, high = starts[k] + 1, starts[k + 1]
        out["mins"].append(least[nodes[low:high]])
        keys = None
        if open_:
            before, keys = chain_names[chains[k]].encode(), []
            for node, turn in zip(nodes[low:high].tolist(), turns[low:high].tolist()):
                if node not in paths:
                    paths[node] = hashlib.sha256(before + b"/" + turn_names[turn - 1].encode()).digest()
                before = paths[node]
                keys.append(before)
        out["paths"].append(keys)
    return pa.table({"chain": table.column("chain"), "sequence": table.column("sequence"), "mins": pa.array(out["mins"], pa.list_(pa.int64())),
                     "paths": pa.array(out["paths"], pa.list_(pa.binary()))})


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, depth, turn, words)`` of every rebuilt turn, and ``(conv_id, turns)`` of every conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        "conv_id", F.col("turn").alias("nr"), F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("turn"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"))
    # Places in a conversation: dealt by ranges, so that a long one is several ranges; numbered inside, then over ranges.
    order = [F.col("conv_id"), F.col("nr").asc_nulls_first(), F.col("turn")]
    stored = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", "nr", "turn", "words", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")), "turns")
    opening = F.min(F.struct(F.col("nr").isNotNull().alias("numbered"), "nr", "turn")).alias("opening")
    ranges = stored.groupBy("conv_id", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"), opening)
    before = Window.partitionBy("conv_id").orderBy("opening").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    convs = ranges.groupBy("conv_id").agg(F.sum("n").alias("n")).withColumns({
        "base": F.col("conv_id") - F.col("conv_id") % GROUP_SIZE, "h": F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED})
    bases = convs.filter("conv_id = base").select("base", F.col("n").alias("base_n"))
    convs = materialize(convs.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0)))).select(
        "conv_id", "base", "h", "head", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns")), "conversations")
    places = ranges.select("conv_id", "range", "first", "before").join(convs.select("conv_id", "h", "head"), "conv_id")
    placed = stored.join(places, ["conv_id", "range"]).withColumn("place", F.col("at") - F.col("first") + F.col("before"))
    tails = placed.filter("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("head") + 1).alias("depth"), "turn", "words")
    heads = placed.filter(f"conv_id % {GROUP_SIZE} = 0 and place < {MOST_SHARED - 1}").select(F.col("conv_id").alias("base"), "place", "turn", "words")
    heads = heads.join(convs.select("conv_id", "base", "head"), "base").filter("place < head").select(
        "conv_id", (F.col("place") + 1).alias("depth"), "turn", "words")
    return heads.unionAll(tails), convs.select("conv_id", "turns")


def _chained(batches):
    """The hash of all segments before each one; rows come by conversation and segment."""
    last, chain = None, ""
    for batch in batches:
        out = []
        for conv, sequence in zip(batch.column("conv_id").to_pylist(), batch.column("sequence").to_pylist()):
            chain = chain if conv == last else ""
            out.append(chain)
            last, chain = conv, hashlib.sha256(f"{chain}/{sequence}".encode()).hexdigest()
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("segment"), pa.array(out, pa.string())], ["conv_id", "segment", "chain"])


def segments(turns: DataFrame) -> DataFrame:
    """``(conv_id, segment, chain, sequence, turns, words)``: conversations in segments, with the hashes of what they hold and what stands before."""
    segment = F.floor((F.col("depth") - 1) / SEGMENT_TURNS).cast("bigint").alias("segment")
    held = turns.groupBy("conv_id", segment).agg(F.sort_array(F.collect_list(F.struct("depth", "turn", "words"))).alias("held"))
    held = materialize(held.select("conv_id", "segment", F.col("held.turn").alias("turns"), F.col("held.words").alias("words"),
                                   F.sha2(F.array_join("held.turn", ""), 256).alias("sequence")), "segments")
    long = held.filter("segment > 0").select("conv_id").distinct()
    chains = held.select("conv_id", "segment", "sequence").join(long, "conv_id", "left_semi").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    chains = chains.mapInArrow(_chained, "conv_id bigint, segment bigint, chain string").filter("segment > 0")
    return held.join(chains, ["conv_id", "segment"], "left").withColumn("chain", F.coalesce("chain", F.lit("")))


def least_members(parts: DataFrame) -> DataFrame:
    """``(chain, sequence, mins)``: the least member of every node on the path of each different segment."""
    kinds = parts.groupBy("chain", "sequence", "turns").agg(F.min("conv_id").alias("least"))
    kinds = materialize(kinds.withColumns({"opens": F.col("turns")[0], "size": F.size("turns")}), "sequences")
    total = kinds.agg(F.sum("size")).first()[0] or 0
    heavy = kinds.groupBy("chain", "opens").agg(F.sum("size").alias("weight")).filter(F.col("weight") > SHARD_TURNS)
    apart = dealt_apart("chain", "opens").alias("apart")
    weighed = kinds.select("*", apart).join(heavy.select("*", apart), ["chain", "opens", "apart"], "left")
    ways = F.ceil(F.coalesce("weight", F.lit(1)) / SHARD_TURNS)
    shard = F.pmod(F.xxhash64("chain", "opens", F.pmod(F.xxhash64("sequence"), ways)), F.lit(max(1, -(-total // SHARD_TURNS))))
    dealt = weighed.select("chain", "sequence", "turns", "least", F.col("weight").isNotNull().alias("shared"), shard.alias("shard"))
    packed = materialize(dealt.groupBy("shard").applyInArrow(
        _shard, "chain string, sequence string, mins array<bigint>, paths array<binary>"), "packed")
    nodes = packed.filter("paths is not null").select("chain", "sequence", F.posexplode(F.arrays_zip("mins", "paths")).alias("i", "node"))
    nodes = nodes.select("chain", "sequence", "i", F.col("node.mins").alias("own"), F.col("node.paths").alias("path"))
    merged, apart = nodes.groupBy("path").agg(F.min("own").alias("least")), dealt_apart("path").alias("apart")
    nodes = nodes.select("*", apart).join(merged.select("*", apart), ["path", "apart"])
    nodes = nodes.groupBy("chain", "sequence").agg(F.sort_array(F.collect_list(F.struct("i", "least"))).alias("held"))
    return packed.filter("paths is null").select("chain", "sequence", "mins").unionAll(nodes.select("chain", "sequence", F.col("held.least").alias("mins")))


def _shares(batches):
    """A row for every node on a member's path: what the member adds to the node."""
    for batch in batches:
        conv, depth, rest, prev, follow = (batch.column(c).to_numpy() for c in ("conv_id", "depth", "rest", "prev", "follow"))
        mins, words = batch.column("mins"), batch.column("words")
        sizes = np.asarray(mins.value_lengths()).astype(np.int64)
        ends = np.cumsum(sizes)
        m, w = mins.flatten().to_numpy(), words.flatten().to_numpy()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        own = m == conv[owner]
        saved = np.cumsum(np.where(own, 0, w))
        through = saved[ends - 1]  # to the end of its segment
        suffix = through[owner] - saved + np.where(own, 0, w) + rest[owner]
        before, after = np.roll(m, 1), np.roll(own, -1)
        before[ends - sizes], after[ends - 1] = prev, follow
        level = depth[owner] + np.arange(len(m)) - (ends - sizes)[owner]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (m, level, before, np.ones(len(m)), after, suffix)],
                                         ["conv_id", "depth", "parent", "n", "child", "saved"])


def _digests(batches):
    """SHA-256 over the strings of each node, in their order, a string at a time."""
    key, state = None, None
    for batch in batches:
        done = []
        rows = zip(batch.column("conv_id").to_pylist(), batch.column("depth").to_pylist(), batch.column("ids").to_pylist())
        for node, held in groupby(rows, key=lambda r: r[:2]):
            if node != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = node, hashlib.sha256()
                state.update(next(held)[2].encode())
            for _, _, ids in held:
                state.update(f",{ids}".encode())
        columns = list(zip(*done)) if done else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()))], ["conv_id", "depth", "sha"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([state.hexdigest()])], ["conv_id", "depth", "sha"])


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    turns, convs = rebuilt_turns(conversations)
    parts = segments(turns)
    apart = dealt_apart("chain", "sequence").alias("apart")
    members = parts.select("conv_id", "segment", "chain", "sequence", "words", apart).join(
        least_members(parts).select("*", apart), ["chain", "sequence", "apart"]).select("conv_id", "segment", "words", "mins")
    members = materialize(members, "members")
    # What a segment must know of those before and after it.
    spared = F.expr("aggregate(zip_with(words, mins, (w, m) -> if(m = conv_id, 0L, w)), 0L, (s, x) -> s + x)")
    along = Window.partitionBy("conv_id").orderBy("segment")
    later = Window.partitionBy("conv_id").orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, -1)
    ties = members.select("conv_id", "segment", spared.alias("spared"), F.col("mins")[0].alias("opens"), F.element_at("mins", -1).alias("closes"))
    top = convs.agg(F.min("conv_id")).first()[0]
    root = F.lit(top).cast("bigint")
    ties = ties.select(
        "conv_id", "segment", "spared", "opens", "closes", F.coalesce(F.sum("spared").over(later), F.lit(0)).alias("rest"),
        F.coalesce(F.lag("closes").over(along), root).alias("prev"), (F.col("opens") == F.col("conv_id")).cast("bigint").alias("own"))
    ties = materialize(ties.withColumns({"follow": F.coalesce(F.lead("own").over(along), F.lit(0)), "last": F.lead("own").over(along).isNull()}), "ties")
    paths = members.join(ties, ["conv_id", "segment"]).select(
        "conv_id", (F.col("segment") * SEGMENT_TURNS + 1).alias("depth"), "rest", "prev", "follow", "mins", "words")
    shares = paths.mapInArrow(_shares, "conv_id bigint, depth bigint, parent bigint, n bigint, child bigint, saved bigint")
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    at_root = [root.alias("conv_id"), zero.alias("depth"), none.alias("parent")]
    shares = shares.unionAll(convs.select(*at_root, F.lit(1).cast("bigint"), zero, zero)).unionAll(
        ties.filter("segment = 0").select(*at_root, zero, "own", F.col("spared") + F.col("rest")))
    nodes = materialize(shares.groupBy("conv_id", "depth").agg(
        F.min("parent").alias("parent_conv_id"), F.sum("n").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("saved").alias("saved_tokens")), "nodes")
    # A leaf is counted at its least member, and so once, on the way from the root.
    one = dealt_apart("conv_id").alias("apart")
    leaves = nodes.filter("n_children = 0").select("conv_id", one)
    on_way = members.select("*", one).join(leaves, ["conv_id", "apart"], "left_semi").select("segment", F.posexplode("mins").alias("i", "conv_id"))
    on_way = on_way.select("conv_id", (F.col("segment") * SEGMENT_TURNS + F.col("i") + 1).alias("depth")).unionAll(leaves.select(*at_root[:2]))
    counted = on_way.groupBy("conv_id", "depth").agg(F.count("*").alias("n_leaves"))
    ends = ties.filter("last").select(F.col("closes").alias("m"), "conv_id").join(convs, "conv_id").select(F.col("m").alias("node"), F.col("turns").alias("depth"), "conv_id")
    ends = ends.unionAll(convs.filter("turns = 0").select(root.alias("node"), zero.alias("depth"), "conv_id"))
    strings = ends.groupBy("node", "depth", F.floor(F.col("conv_id") / END_IDS).alias("block")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    strings = strings.withColumnRenamed("node", "conv_id").repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "block")
    hashed = strings.select("conv_id", "depth", "ids").mapInArrow(_digests, "conv_id bigint, depth bigint, sha string")
    return nodes.join(counted, ["conv_id", "depth"]).join(hashed, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
