"""Jaccard similarity join of word n-grams by token-combination prefixes.

A document's tokens are its distinct shingles, as 64-bit hashes. All documents use one order of tokens, rare ones first.
Of two linked sets one may lack few of the other's tokens (``spare(n)``), and so they meet in short prefixes. Rare tokens
are indexed alone. Tokens of frequent classes are dealt to groups by their hash and indexed as pairs or triples of a
group; the prefix is extended until losing ``spare(n)`` of its tokens must leave a rare token or a whole combination of a group.
Groups are as many as fit the set's size, which is known to a power of two; sets near a boundary are indexed on both sides.

Equal sets are one class. Classes that meet at a key are compared with its lead first, the class with the fewest tokens of its own; links found there join them
to components, and only members of other components than the lead's are then compared with all that meet there,
as far as sizes and positions leave them a chance. No key's pairs are listed, and no link that connects is lost. Verification
recomputes the sets of the classes that are left from their whole texts.

How often each token occurs is counted over all documents, to 32 bits of its hash: sorted, as differences, compressed. Only the
``MOST_FREQUENT`` most frequent go to every task; a token beyond them counts as rare, which costs time and no link.

Defined cases: null, empty and wordless texts have no token, are linked with nothing and are their own component; texts
of one to three words have one token; repeated rows and equal sets are one component; a component has the least id of its rows,
null if none has one; an empty table gives no rows; very long texts are cut in segments that overlap; other columns are not read.
Tokens and classes are told apart by 64 bits: of 10 million different sets any two collide with a chance of 3 in a million.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from linkshelf.llm.buffers import pieces, string_array, text_bytes
from linkshelf.llm.columns import dealt_apart, whole
from linkshelf.llm.components import components
from linkshelf.session import materialize

SHINGLE_WORDS = 4
#: Linked: 100 * common >= PERCENT * united.
PERCENT = 85
#: Up to this document frequency a token is indexed alone, in pairs; beyond, in triples.
ALONE, IN_PAIRS = 16, 512
#: Groups of a frequent class for each token of a set.
PAIR_GROUPS, TRIPLE_GROUPS = 0.18, 0.17
MOST_FREQUENT = 1 << 21
#: Text that is cut into tokens at once; a longer one is a piece of its own.
PIECE_BYTES = 8 << 20
#: Tokens counted in one group, and in one step of a task.
RANGE_TOKENS = 4 << 20
STEP_TOKENS = 2 << 20
#: Bits of the filters that spare keys met by nobody, and texts without candidates; 16 MB each.
FILTER_BITS = 1 << 27
#: Pairs that meet one copy of a text.
PAIRS_A_COPY = 512


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sliding(h: np.ndarray, size: int) -> np.ndarray:
    """One hash for every ``size`` hashes in a row."""
    token = np.full(max(0, len(h) - size + 1), size, np.uint64)
    for k in range(size):
        token = _mixed(token * np.uint64(0x9E3779B97F4A7C15) + h[k: len(h) - size + 1 + k])
    return token


def _split(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a string array, and where each row's start."""
    from xxhash import xxh64_intdigest

    lists = pc.ascii_split_whitespace(pc.ascii_lower(column))  # A-Z; the six ASCII spaces
    encoded = lists.flatten().dictionary_encode()
    names = encoded.dictionary.cast(pa.binary()).to_pylist()
    codes = encoded.indices.to_numpy()
    hashes = np.fromiter((xxh64_intdigest(w) for w in names), np.uint64, len(names))
    real = np.fromiter(map(len, names), np.int64, len(names))[codes] > 0 if len(names) else np.zeros(0, bool)
    starts = np.concatenate([[0], np.cumsum(real)])[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
    return hashes[codes[real]] if len(names) else np.zeros(0, np.uint64), starts


def token_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of every whole text of a string array, and where each row's start."""
    h, starts = _split(column)
    words = np.diff(starts)
    counts = np.where(words >= SHINGLE_WORDS, words - SHINGLE_WORDS + 1, np.minimum(words, 1))
    begins = np.concatenate([[0], np.cumsum(counts)])
    full = words >= SHINGLE_WORDS
    all_tokens, tokens = _sliding(h, SHINGLE_WORDS), np.empty(begins[-1], np.uint64)
    owner = np.repeat(np.arange(len(words)), counts)
    inside = np.arange(begins[-1]) - begins[owner]
    long = full[owner]
    tokens[long] = all_tokens[(starts[owner] + inside)[long]]
    for row in np.flatnonzero(~full & (words > 0)).tolist():
        tokens[begins[row]] = _sliding(h[starts[row]: starts[row + 1]], int(words[row]))[0]
    for low, high in zip(begins[:-1].tolist(), begins[1:].tolist()):
        tokens[low:high].sort()
    first = np.ones(len(tokens), bool)
    first[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    return tokens[first], np.concatenate([[0], np.cumsum(first)])[begins]


def _pieces(column: pa.Array):
    """The array in slices of bounded size, or of one row."""
    for low, high in pieces(text_bytes(column)[1], PIECE_BYTES):
        yield low, column.slice(low, high - low)


def spare(n: int) -> int:
    """How many tokens of a set of ``n`` a linked set may lack."""
    return n - -(-PERCENT * n // 100)


#: Smaller sets are linked with equal ones only.
LEAST_SIZE = next(n for n in range(2, 200) if 100 * n >= PERCENT * (n + 1))


def levels(n: int) -> range:
    """The powers of two that sets linked with one of ``n`` may have the size of."""
    return range((-(-PERCENT * n // 100)).bit_length() - 1, (100 * n // PERCENT).bit_length())


def _planes(values: np.ndarray) -> bytes:
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


class Frequent:
    """The classes of tokens: by the upper 32 bits of their hashes, with document frequencies."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.counts = ids[order].astype(np.uint32), counts[order].astype(np.uint32)
        self.marks = np.zeros(1 << 20, bool)
        self.marks[self.ids >> np.uint32(12)] = True

    def of(self, tokens: np.ndarray) -> np.ndarray:
        """Frequency of each token, 0 for a rare one."""
        found = np.zeros(len(tokens), np.uint32)
        maybe = np.flatnonzero(self.marks[tokens >> np.uint64(44)])
        top = (tokens[maybe] >> np.uint64(32)).astype(np.uint32)
        at = np.searchsorted(self.ids, top)
        at[at == len(self.ids)] = 0
        hit = self.ids[at] == top if len(at) else np.zeros(0, bool)
        found[maybe[hit]] = self.counts[at[hit]]
        return found


def signatures(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys a set is indexed by, and for each how many common tokens are possible with a set that meets it nowhere before."""
    n = len(tokens)
    # Sets of five or fewer are linked with equal ones only, which are one class.
    if n < LEAST_SIZE:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    needed = spare(n) + 1
    rare = tokens[counts == 0]
    alone = rare[:needed]
    keys, bounds = [_mixed(alone)], [n - np.arange(len(alone))]
    if len(rare) < needed:
        often = np.lexsort((tokens, counts))[len(rare):]
        often, counts = tokens[often], counts[often]
        triple = counts > IN_PAIRS
        size = np.where(triple, 3, 2)
        mixed = _mixed(often)
        for level in levels(n):
            pairs, triples = (max(1, int(share * (1 << level))) for share in (PAIR_GROUPS, TRIPLE_GROUPS))
            group = np.where(triple, mixed % np.uint64(triples) + np.uint64(pairs), mixed % np.uint64(pairs)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0]))
            nth = np.empty(len(group), np.int64)
            nth[order] = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
            lasting = np.cumsum(nth >= size - 1)
            end = int(np.searchsorted(lasting, needed - len(rare))) + 1
            held: dict[int, list[int]] = {}
            for at, g in enumerate(group[:end].tolist()):
                held.setdefault(g, []).append(at)
            made = [c for g, held_ in held.items() for c in combinations(held_, 3 if g >= pairs else 2)]
            for k in (2, 3):
                table = np.array([c for c in made if len(c) == k], np.int64).reshape(-1, k)
                key = np.full(len(table), 16 * level + k, np.uint64)
                for c in range(k):
                    key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + mixed[table[:, c]])
                keys.append(key)
                # Sets that share no combination before have at most one token of a pair, two of a triple, in common in each group so far:
                # each token that closes a combination there is one they lack, as are the rare ones.
                bounds.append(n - len(rare) - (lasting[table[:, -1]] - 1))
    return np.concatenate(keys), np.concatenate(bounds)


def _packed(arrays, ranges: int, step: int):
    """``(part, data)``: the sorted upper halves of some hashes that fall in one range, and how often each is there."""
    from zstandard import ZstdCompressor

    held, size = [], 0

    def flush():
        ids, counts = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.searchsorted(ids, [(r << 32) // ranges for r in range(ranges + 1)])
        parts, data, pack = [], [], ZstdCompressor(level=1).compress
        for r, (low, high) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            if low < high:
                parts.append(r)
                data.append(pack(_planes(np.diff(ids[low:high].astype(np.int64), prepend=0)) + _planes(counts[low:high])))
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(data, pa.binary())], ["part", "data"])

    for hashes in arrays:
        held.append((hashes >> np.uint64(32)).astype(np.uint32))
        size += len(hashes)
        if size >= step:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def repeated(rows: DataFrame, arrays, count: int, least: int, name: str) -> DataFrame:
    """``(id, n)``: upper halves of hashes that occur over ``least`` times; ``arrays`` yields a task's hashes."""
    ranges, step = max(1, -(-count // RANGE_TOKENS)), STEP_TOKENS
    parts = rows.mapInArrow(lambda batches: _packed(arrays(batches), ranges, step), "part bigint, data binary")
    return materialize(parts.groupBy("part").applyInArrow(lambda table: _frequent(table, least), "id bigint, n bigint"), name)


def bit_table(rows: DataFrame, place: str):
    """A broadcast table of ``FILTER_BITS`` bits; those at ``place`` modulo its size are set."""
    at = F.pmod(place, F.lit(FILTER_BITS))
    words = rows.groupBy(F.floor(at / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int"))).alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return rows.sparkSession.sparkContext.broadcast(table)


def _marked(table: np.ndarray, place: np.ndarray) -> np.ndarray:
    at = place % (64 * len(table))
    return (table[at // 64] >> (at % 64)) & 1 == 1


def _frequent(table: pa.Table, least: int) -> pa.Table:
    from zstandard import ZstdDecompressor

    ids, counts, unpack = [], [], ZstdDecompressor().decompress
    for data in table.column("data"):
        raw = unpack(data.as_py())
        ids.append(np.cumsum(_from_planes(raw[: len(raw) // 2]).astype(np.int64)))
        counts.append(_from_planes(raw[len(raw) // 2:]).astype(np.int64))
    ids, counts = np.concatenate(ids), np.concatenate(counts)
    order = np.argsort(ids, kind="stable")
    ids, counts = ids[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    ids, counts = ids[starts], np.add.reduceat(counts, starts)
    often = counts > least
    return pa.table({"id": ids[often], "n": counts[often]})


def _texts_tokens(batches):
    for batch in batches:
        for _, piece in _pieces(string_array(batch.column("text"))):
            yield token_lists(piece)[0]


def frequent_tokens(texts: DataFrame) -> Frequent:
    """The most frequent tokens of all documents; at most ``MOST_FREQUENT``, 8 bytes each."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = repeated(texts.select("text"), _texts_tokens, size // 6, ALONE, "frequent-tokens")
    rows = found.orderBy(F.desc("n"), "id").limit(MOST_FREQUENT).toArrow() if found.count() > MOST_FREQUENT else found.toArrow()
    return Frequent(rows.column("id").to_numpy(), np.minimum(rows.column("n").to_numpy(), 0xFFFFFFFF))


def _class_of(tokens: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(tokens.tobytes(), len(tokens))).astype(np.int64))


_NO_KEYS = np.zeros(0, np.uint64)


def indexed(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, n, cls, keys, bounds)`` of every row; a task lists the keys of a class once."""
    rows = docs.select("doc_id", whole().alias("text"))
    context = docs.sparkSession.sparkContext
    known = context.broadcast(frequent_tokens(rows))

    def index(batches):
        seen = set()
        for batch in batches:
            sizes, classes, keys, bounds = [], [], [], []
            for _, piece in _pieces(string_array(batch.column("text"))):
                tokens, starts = token_lists(piece)
                counts, n = known.value.of(tokens), np.diff(starts)
                rare = np.concatenate([[0], np.cumsum(counts == 0)])
                mixed = _mixed(tokens)
                for row, (low, high) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                    cls, listed, bound = _class_of(tokens[low:high]), _NO_KEYS, _NO_KEYS
                    if cls not in seen and high - low >= LEAST_SIZE:
                        seen.add(cls)
                        needed, lone = spare(high - low) + 1, rare[high] - rare[low]
                        if lone == high - low:
                            listed, bound = mixed[low: low + needed], high - low - np.arange(needed)
                        else:
                            listed, bound = signatures(tokens[low:high], counts[low:high])
                    classes.append(cls)
                    keys.append(listed)
                    bounds.append(bound)
                sizes.append(n)
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(k) for k in keys])]), pa.int32())
            joined = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text_key"), pa.array(joined(sizes, np.int64)), pa.array(classes, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(joined(keys, np.uint64).view(np.int64))),
                pa.ListArray.from_arrays(offsets, pa.array(joined(bounds, np.int32)))], ["doc_id", "text_key", "n", "cls", "keys", "bounds"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return materialize(rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        index, f"doc_id {kind}, text_key bigint, n bigint, cls bigint, keys array<bigint>, bounds array<int>"), "indexed")


def _chance(n: str, bound: str, m: str, other: str):
    """Sizes and positions leave two sets a chance of being linked."""
    return ((100 + PERCENT) * F.least(bound, other) >= PERCENT * (F.col(n) + F.col(m))) & (100 * F.least(n, m) >= PERCENT * F.greatest(n, m))


def meetings(index: DataFrame) -> DataFrame:
    """``(key, cls, n, bound, lead, lead_n, lead_bound)`` of every key that different classes meet at."""
    rows = index.filter("size(keys) > 0").select("cls", F.col("n").cast("int").alias("n"), "keys", "bounds")
    count = rows.agg(F.sum(F.size("keys"))).first()[0] or 0
    heads = lambda batches: (b.column("keys").flatten().to_numpy().view(np.uint64) for b in batches)
    met = bit_table(repeated(rows.select("keys"), heads, count, 1, "met-keys"), "id")

    def post(batches):
        # Keys that one class alone has are left out; the few that the filter lets through go with the next step.
        for batch in batches:
            keys, bounds = batch.column("keys").flatten(), batch.column("bounds").flatten()
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(batch.column("keys").value_lengths()))
            live = np.flatnonzero(_marked(met.value, (keys.to_numpy().view(np.uint64) >> np.uint64(32)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([keys.take(live), batch.column("cls").take(owner[live]), batch.column("n").take(owner[live]), bounds.take(live)],
                                             ["key", "cls", "n", "bound"])

    posted = rows.mapInArrow(post, "key bigint, cls bigint, n int, bound int")
    same = Window.partitionBy("key")
    # A class that several tasks have read, as one with many copies, was posted by each.
    repeated_post = F.lag("cls").over(same.orderBy("cls", F.desc("bound")))
    posted = posted.withColumn("before", repeated_post).filter(F.col("before").isNull() | (F.col("before") != F.col("cls"))).drop("before")
    # The lead is the class with the smallest share of tokens that are its own: in a family of copies, the one least edited.
    lead = F.min(F.struct(((F.col("n") - F.col("bound")) / F.col("n")).alias("own"), "cls", "n", "bound")).over(same)
    led = posted.withColumn("lead", lead).withColumn("least", F.min("cls").over(same)).withColumn("last", F.max("cls").over(same)).filter("last > least")
    return materialize(led.select("key", "cls", "n", "bound", F.col("lead.cls").alias("lead"), F.col("lead.n").alias("lead_n"), F.col("lead.bound").alias("lead_bound")), "meetings")


def _linked(batches):
    """Compares a copy's text, which comes first, with the texts of its pairs."""
    last, mine = None, None
    for batch in batches:
        kept = []
        column = string_array(batch.column("text"))
        ends = list(zip(batch.column("u").to_pylist(), batch.column("copy").to_pylist(), batch.column("v").to_pylist()))
        for first, piece in _pieces(column):
            tokens, starts = token_lists(piece)
            for row, (low, high) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
                u, copy, v = ends[first + row]
                y = tokens[low:high]
                if v is None:
                    last, mine = (u, copy), y.copy()
                elif last == (u, copy):
                    x, y = (mine, y) if len(mine) <= len(y) else (y, mine)
                    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    if 100 * common >= PERCENT * (len(x) + len(y) - common):
                        kept.append((u, v))
                else:
                    raise ValueError("a pair without the text of its first end")
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], ["u", "v"])


def wanted_texts(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``(text_key, text)`` once for each of ``keys(text_key)``, and of few more."""
    marked = bit_table(keys, "text_key")

    def keep(batches):
        seen = set()
        for batch in batches:
            found = batch.column("text_key").to_numpy()
            rows = []
            for i in np.flatnonzero(_marked(marked.value, found)).tolist():
                if int(found[i]) not in seen:
                    seen.add(int(found[i]))
                    rows.append(i)
            yield batch.take(pa.array(rows, pa.int64()))

    texts = docs.select(whole().alias("text")).select(F.xxhash64("text").alias("text_key"), "text").mapInArrow(keep, "text_key bigint, text string")
    return texts.groupBy("text_key").agg(F.first("text").alias("text"))


def verified(docs: DataFrame, index: DataFrame, pairs: DataFrame) -> DataFrame:
    """The linked of ``pairs(u, v)``, compared by their whole texts.

    The end that meets more pairs is copied for every ``PAIRS_A_COPY`` of them, so that no task gets all pairs of one class.
    """
    pairs = materialize(pairs, "pairs")
    if pairs.isEmpty():
        return pairs
    ends = pairs.select(F.explode(F.array("u", "v")).alias("cls")).groupBy("cls").agg(F.count("*").alias("met"))
    many = materialize(ends.filter(F.col("met") > PAIRS_A_COPY), "many")
    for end in ("u", "v"):
        often = many.select(F.col("cls").alias(end), F.col("met").alias(f"met_{end}"), dealt_apart("cls").alias("apart"))
        pairs = pairs.withColumn("apart", dealt_apart(end)).join(often, [end, "apart"], "left").drop("apart")
    swap = F.coalesce("met_v", F.lit(0)) > F.coalesce("met_u", F.lit(0))
    copies = F.ceil(F.greatest(F.coalesce("met_u", F.lit(1)), F.coalesce("met_v", F.lit(1))) / PAIRS_A_COPY).cast("int")
    dealt = pairs.select(F.when(swap, F.col("v")).otherwise(F.col("u")).alias("u"), F.when(swap, F.col("u")).otherwise(F.col("v")).alias("v"), copies.alias("copies"))
    dealt = dealt.withColumn("copy", F.pmod(F.xxhash64("v"), F.col("copies")).cast("int"))
    firsts = dealt.select(F.col("u").alias("cls"), "u", "copy", F.lit(None).cast("bigint").alias("v")).distinct()
    places = firsts.unionAll(dealt.select(F.col("v").alias("cls"), "u", "copy", "v"))
    keys = materialize(index.select("cls", "text_key").join(ends, "cls", "left_semi").groupBy("cls").agg(F.min("text_key").alias("text_key")), "text-keys")
    places = places.join(keys, "cls").select("text_key", "u", "copy", "v")
    sent = wanted_texts(docs, keys).join(places, "text_key").select("u", "copy", "v", "text")
    order = [F.col("u"), F.col("copy"), F.col("v").asc_nulls_first()]
    return materialize(sent.repartition("u", "copy").sortWithinPartitions(*order).mapInArrow(_linked, "u bigint, v bigint"), "verified")


def _rooted(met: DataFrame, roots: DataFrame, end: str, name: str) -> DataFrame:
    known = roots.select(F.col("node").alias(end), F.col("root").alias(name), dealt_apart("node").alias("apart"))
    return met.withColumn("apart", dealt_apart(end)).join(known, [end, "apart"], "left").withColumn(name, F.coalesce(name, end)).drop("apart")


def class_links(docs: DataFrame, index: DataFrame) -> DataFrame:
    """``(u, v)``: links of classes, enough of them to connect all that are linked."""
    met = meetings(index)
    ordered = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    first = met.filter((F.col("cls") != F.col("lead")) & _chance("n", "bound", "lead_n", "lead_bound")).select(*ordered("cls", "lead")).distinct()
    first = materialize(first, "first-pairs")
    links = verified(docs, index, first)
    roots = materialize(components(links), "first-components")
    sided = _rooted(_rooted(met, roots, "cls", "root"), roots, "lead", "lead_root").select("key", "cls", "n", "bound", "root", "lead_root")
    sided = materialize(sided, "sided")
    # Members beside the lead's component meet all others at the key, those of their own component aside.
    beside = sided.filter("root <> lead_root").select("key", F.col("cls").alias("c"), F.col("n").alias("m"), F.col("bound").alias("other"), F.col("root").alias("r"))
    again = (F.col("root") != F.col("r")) & ((F.col("root") == F.col("lead_root")) | (F.col("cls") < F.col("c"))) & _chance("n", "bound", "m", "other")
    second = sided.join(beside, "key").filter(again).select(*ordered("cls", "c")).distinct().join(first, ["u", "v"], "left_anti")
    return links.unionAll(verified(docs, index, second))


def similarity_join(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row."""
    index = indexed(docs)
    roots = components(class_links(docs, index))
    rows = _rooted(index.select("doc_id", "n", "cls"), roots, "cls", "root")
    least = rows.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    apart = dealt_apart("root").alias("apart")
    named = rows.select("*", apart).join(least.select("*", apart), ["root", "apart"], "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
