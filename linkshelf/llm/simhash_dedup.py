"""Near-duplicate detection by SimHash and meet-in-the-middle ball hashing.

The fingerprint of a text has a bit for each bit that is set in over half of its shingles' 64-bit hashes. Two texts are
linked when their fingerprints differ in at most three bits. Three is halved between the two sides: of two fingerprints
at distance one or three, one has an even and one an odd number of set bits, so odd ones emit all variants one
bit away, even ones themselves and all variants two bits away, and linked ones meet at a variant (those at distance
two likewise: odd with odd one bit away, even with even at one of them). Every variant has an even number of bits.

Variants are shuffled by their leading bits: a fingerprint is sent once to each value that its variants' leading bits take
(137 for 16 bits), and the rest of a variant is made where it is compared. The number of leading bits follows the number
of fingerprints, so a task's share stays the same. Equal fingerprints are one; at a variant meet at most 2,081 different
ones, so no group can grow with the data. Those at a variant are linked with its least member that is at most one bit away,
not with each other: every such link is real, and none that connects is lost.

Defined cases: null, empty and wordless texts have fingerprint zero, which is linked like any other; texts of one or two
words have one shingle; a null id takes part in its group and has the group's least id, or null if there is none; repeated
rows each get their row; an empty table gives no rows.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkshelf.llm.buffers import string_array
from linkshelf.llm.columns import dealt_apart, fresh, whole
from linkshelf.llm.components import components
from linkshelf.session import materialize

SHINGLE_WORDS = 3
SEED = 42
#: Distinct fingerprints for each value of the leading bits.
FILL = 256
SEGMENT_BYTES = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def _bits_of(words: list[bytes], size: int, ones: np.ndarray) -> int:
    """Add the set bits of every shingle of ``size`` words to ``ones``; how many shingles there are."""
    from xxhash import xxh64_intdigest

    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(begins[: len(words) - size + 1].tolist(), ends[size - 1:].tolist())
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], "<u8")
    ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return len(hashes)


def fingerprint(text: bytes) -> int:
    """The fingerprint of a whole text, read in segments of about ``SEGMENT_BYTES`` that end between words."""
    text = text.lower()  # of bytes: A-Z only
    ones, count, at, words = np.zeros(64, np.int64), 0, 0, []
    while at < len(text):
        gap = _GAP.search(text, at + SEGMENT_BYTES)
        end = gap.start() if gap else len(text)
        words += text[at:end].split()  # at the six ASCII spaces
        at = end
        if len(words) >= SHINGLE_WORDS:
            count += _bits_of(words, SHINGLE_WORDS, ones)
            words = words[1 - SHINGLE_WORDS:]
    if words and not count:
        count = _bits_of(words, len(words), ones)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest, fp)`` of every row, stored once without texts."""

    def make(batches):
        for batch in batches:
            fps = [fingerprint((t.as_py() or "").encode()) for t in string_array(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "digest", "fp"])

    rows = docs.select("doc_id", F.xxhash64(whole()).alias("digest"), whole().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return materialize(rows.mapInArrow(make, f"doc_id {kind}, digest bigint, fp bigint"), "fingerprints")


class _Meeting:
    """Compares the variants that share their leading bits."""

    def __init__(self, bits: int):
        self.shift = np.uint64(64 - bits)
        low = 64 - bits
        self.one = np.uint64(1) << np.arange(low, dtype=np.uint64)
        self.two = np.array([(1 << a) | (1 << b) for a, b in combinations(range(low), 2)], np.uint64)
        self.none = np.zeros(1, np.uint64)

    def links(self, lead: int, fps: np.ndarray) -> np.ndarray:
        """Rows ``(fingerprint, least member at most one bit away)`` for every variant with these leading bits."""
        top = np.uint64(lead) << self.shift
        tail = fps & ((np.uint64(1) << self.shift) - np.uint64(1))
        turned = np.bitwise_count((fps >> self.shift) ^ np.uint64(lead))
        odd = np.bitwise_count(fps) & 1
        near, far = [], []
        # (which fingerprints, what is left to turn, is the variant at most one bit away)
        for which, masks, into in (
            ((odd == 1) & (turned == 0), self.one, near), ((odd == 1) & (turned == 1), self.none, near), ((odd == 0) & (turned == 0), self.none, near),
            ((odd == 0) & (turned == 0), self.two, far), ((odd == 0) & (turned == 1), self.one, far), ((odd == 0) & (turned == 2), self.none, far),
        ):
            into.append((tail[which], fps[which], masks))
        variants = np.concatenate([(t[:, None] ^ m).ravel() for t, _, m in near]) | top
        members = np.concatenate([np.repeat(f, len(m)) for _, f, m in near])
        if not len(variants):
            return np.zeros((0, 2), np.uint64)
        order = np.lexsort((members, variants))
        variants, members = variants[order], members[order]
        start = np.concatenate([[True], variants[1:] != variants[:-1]])
        least = members[np.maximum.accumulate(np.where(start, np.arange(len(members)), 0))]
        found = [np.stack([members[members != least], least[members != least]], 1)]
        heads, first = variants[start], members[start]
        # A bitmap of the near variants settles most far ones.
        bits = max(10, int(len(heads) * 16).bit_length())
        spot = lambda v: ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
        marked = np.zeros(1 << bits, bool)
        marked[spot(heads)] = True
        for tails, own, masks in far:
            step = max(1, (1 << 20) // len(masks))
            for low in range(0, len(tails), step):
                v = (tails[low: low + step, None] ^ masks).ravel() | top
                hit = np.flatnonzero(marked[spot(v)])
                if len(hit):
                    at = np.minimum(np.searchsorted(heads, v[hit]), len(heads) - 1)
                    met = heads[at] == v[hit]
                    found.append(np.stack([own[low + hit[met] // len(masks)], first[at[met]]], 1))
        pairs = np.concatenate(found)
        pairs = pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= 3]  # the verification: no pair beyond the distance
        return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def links(distinct: DataFrame, count: int) -> DataFrame:
    """``(u, v)``: links between fingerprints ``fp`` at most three bits apart, enough of them to connect all that are."""
    bits = min(28, max(6, (count // FILL).bit_length()))
    turns = [0] + [1 << i for i in range(bits)]
    twice = turns + [(1 << i) | (1 << j) for i, j in combinations(range(bits), 2)]
    lead = F.shiftrightunsigned("fp", 64 - bits)
    sent = F.when(F.bit_count("fp") % 2 == 1, F.array(*map(F.lit, turns))).otherwise(F.array(*map(F.lit, twice)))
    meeting = _Meeting(bits)

    def compare(key, table):
        fps = table.column("fp").to_numpy().view(np.uint64)
        found = meeting.links(key[0].as_py(), fps).view(np.int64)
        return pa.table({"u": found[:, 0], "v": found[:, 1]})

    spread = distinct.select("fp", F.explode(sent).alias("turn")).select(lead.bitwiseXOR(F.col("turn")).alias("lead"), "fp")
    return spread.groupBy("lead").applyInArrow(compare, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, digest, fp, root, component_id)`` of every row. ``root``, the least fingerprint of its component, is the
    component's key; ``component_id`` is none: it is null for all without ids, and one id may stand on unlinked texts."""
    prints = fingerprints(docs)
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    joined = components(links(distinct.select("fp"), distinct.count()))
    rooted = distinct.join(joined, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    apart = dealt_apart("root").alias("apart")
    named = rooted.select(F.col("fp").alias("k"), "root", apart).join(least.select("*", apart), ["root", "apart"]).select("k", "root", "component_id")
    return prints.join(named, F.col("fp") == F.col("k")).drop("k")


def near_duplicate_table(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the least id (a null one if there is no other); with the columns of ``docs``.

    Rows of a component's least id that differ in text, or repeat it, are told apart by the text's hash; one stays. Equal
    hashes are equal texts, so no two components choose the same id and hash.
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("s_id"), F.col("digest").alias("s_digest")))
    chosen = near_duplicates(docs).groupBy("root").agg(least.alias("least")).select("least.s_id", "least.s_digest")
    digest, nth = fresh(docs, "digest", "nth")
    rows = docs.withColumn(digest, F.xxhash64(whole())).join(
        chosen, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col(digest) == F.col("s_digest")), "left_semi")
    once = Window.partitionBy("doc_id", digest).orderBy(digest)
    return rows.withColumn(nth, F.row_number().over(once)).filter(F.col(nth) == 1).drop(digest, nth)
