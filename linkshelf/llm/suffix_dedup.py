"""Removal of long repeated strings by enhanced suffix arrays, in parts.

A byte goes when a string of ``LENGTH`` (50) bytes that covers it also starts in a document with a smaller id. One suffix array
of all text would not fit a task, so suffixes are compared only where they can matter:

1. Anchors. Of the 24-byte grams of any 50-byte string, those with the least hash are its anchors. They depend on nothing
   but the string, so equal strings have an anchor at the same offset. About every 14th byte is one.
2. Anchors are dealt by their hash. One that occurs in one document only can lie in no repeat, and is dropped.
3. Around each remaining anchor lie all 50-byte strings that hold it: 26 bytes before it and 50 from it. Equal
   surroundings in a chunk of documents are one row with their least id, however many copies there are. Their 64-bit
   hashes are dealt by the anchor's hash: where the same surroundings exist with a smaller id, all their strings go, and
   where all surroundings of an anchor are the same, nothing else can match. That settles most.
4. The bytes of the rest are dealt by the anchor's hash. A part is sorted as a suffix array from the anchors on, and once
   more from the anchors backwards; both get their common-prefix lengths. Cut at depth 50 - o, the first gives the prefix
   intervals whose members share the bytes from the anchor on; the second tells, at depth o, which of them differ in
   their left extension. Members alike in both hold the same 50-byte string with all its occurrences, and the least id
   of the group decides for each. This is done for every o from 0 to 26.
5. Each chunk of documents gets back which strings go, and marks their bytes.

Texts are shuffled once, by chunk, and that shuffle is read in steps 1, 3, 4 and 5. What is dealt by hash is packed: one row for a
chunk and part.

Defined cases: null texts are empty; texts under 50 bytes lose nothing; matches inside one document count for nothing
unless a document with a smaller id has the string too; a null id ranks below every id; rows with equal ids are never
compared with each other; repeated rows each get their row; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from linkshelf.llm.buffers import pieces, string_array, text_bytes
from linkshelf.llm.columns import whole

LENGTH = 50
GRAM = 24  # a multiple of 8
BEFORE = LENGTH - GRAM
#: Bytes of text a chunk of documents and a part of the anchors stand for, on average.
CHUNK_BYTES = 4 << 20
PART_BYTES = 16 << 20
_OFFSETS = BEFORE + 1
_NULL_ID = -(1 << 63)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes from each place on."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    held = np.ascontiguousarray(data)
    eight = np.lib.stride_tricks.as_strided(held, (len(held) - 7, 8), (1, 1))
    x = np.ascontiguousarray(eight).view("<u8").ravel()
    h = x[:n] * _C1
    for k in range(8, GRAM, 8):
        h ^= h >> np.uint64(29)
        h += x[k: k + n]
        h *= _C2
    h ^= h >> np.uint64(32)
    h *= _C1
    h ^= h >> np.uint64(29)
    return h


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (width - span)], x[width - span:]) if width > span else x


def anchors(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all texts. Of equal least hashes in a string each is an anchor."""
    places, hashes = [], []
    for low, high in pieces(starts, 1 << 20):
        body, at = data[starts[low]: starts[high]], starts[low: high + 1] - starts[low]
        if len(body) < LENGTH:
            continue
        h = gram_hashes(body)
        order = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        least = _sliding(order, _OFFSETS, np.minimum)  # of the string from each place on
        inside = np.zeros(len(body) + 1, np.int32)
        long = np.diff(at) >= LENGTH
        inside[at[:-1][long]] += 1
        inside[at[1:][long] - LENGTH + 1] -= 1
        least = np.where(np.cumsum(inside)[: len(least)] > 0, least, np.uint32(0))  # strings inside one text only
        around = np.zeros(len(order) + BEFORE, np.uint32)
        around[BEFORE: BEFORE + len(least)] = least
        chosen = np.flatnonzero(_sliding(around, _OFFSETS, np.maximum)[: len(order)] == order)
        places.append(chosen + starts[low])
        hashes.append(h[chosen])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(hashes)


def _planes(x: np.ndarray, size: int) -> bytes:
    """Bytes of integers, first all lowest ones and so on: what is mostly zero then packs well."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _unplanes(data: bytes, size: int) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8).reshape(size, -1)
    out = np.zeros((rows.shape[1], 8), np.uint8)
    out[:, :size] = rows.T
    return out.view("<u8").ravel()


def _chunk(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's documents in the order of their ids: table, bytes, starts, ids."""
    table = table.sort_by([("rank_id", "ascending"), ("digest", "ascending")]).combine_chunks()
    data, starts = text_bytes(string_array(table.column("text")))
    return table, data, starts, table.column("rank_id").to_numpy()


def _runs(x: np.ndarray) -> np.ndarray:
    """Starts of runs of equal neighbours."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


_ANCHOR_ROWS = "part int, chunk long, known boolean, hashes binary, places binary, owners binary"
_SPREAD = 1 << 20  # more than the documents of a chunk


def _emit_anchors(parts: int):
    def emit(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        _, data, starts, _ = _chunk(table)
        places, hashes = anchors(data, starts)
        owners = np.searchsorted(starts, places, side="right") - 1
        order = np.argsort(hashes, kind="stable")
        hashes, places, owners = hashes[order], places[order], owners[order]
        runs = _runs(hashes)
        ends = np.r_[runs[1:], len(hashes)]
        several = owners[runs] != owners[ends - 1] if len(runs) else np.zeros(0, bool)  # places rise in a run, so owners do
        in_several = np.repeat(several, ends - runs)
        # A hash of several documents here is known to be shared: its places need no answer, one row tells the others.
        sent = ~in_several
        sent[runs[several]] = True
        part = (hashes % np.uint64(parts)).astype(np.int64)
        rows = []
        for p in np.unique(part[sent]):
            at = np.flatnonzero(sent & (part == p))
            at = at[np.argsort(places[at], kind="stable")]
            owner = np.where(in_several[at], _SPREAD, owners[at])
            rows.append((int(p), chunk, False, _planes(hashes[at] >> np.uint64(16), 6), _planes(np.diff(places[at], prepend=0), 4), _planes(owner, 3)))
        own = np.sort(places[in_several])
        if len(own):
            rows.append((chunk % parts, chunk, True, b"", _planes(np.diff(own, prepend=0), 4), b""))
        names = ["part", "chunk", "known", "hashes", "places", "owners"]
        kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return emit


def _shared_anchors(table: pa.Table) -> pa.Table:
    """Places of each chunk whose anchor occurs in another document too."""
    out = []
    hashes, owners, places, chunks = [], [], [], []
    for chunk, known, h, p, o in zip(*(table.column(c).to_pylist() for c in ("chunk", "known", "hashes", "places", "owners"))):
        if known:
            out.append((chunk, p))
            continue
        hashes.append(_unplanes(h, 6))
        places.append(np.cumsum(_unplanes(p, 4)))
        owners.append(_unplanes(o, 3))
        chunks.append(np.full(len(places[-1]), chunk, np.int64))
    if hashes:
        h, o, p, c = (np.concatenate(x) for x in (hashes, owners, places, chunks))
        order = np.argsort(h, kind="stable")
        runs = _runs(h[order])
        several = o[order] == _SPREAD
        ident = (c.astype(np.uint64) * np.uint64(_SPREAD + 1) + o)[order]
        first = np.repeat(ident[runs], np.diff(np.r_[runs, len(h)]))
        shared = np.logical_or.reduceat((ident != first) | several, runs)
        told = np.zeros(len(h), bool)
        told[order] = np.repeat(shared, np.diff(np.r_[runs, len(h)])) & ~several
        at = np.flatnonzero(told)  # chunk by chunk, places rising in each
        for part in np.split(at, _runs(c[at])[1:]) if len(at) else ():
            out.append((int(c[part[0]]), _planes(np.diff(p[part].astype(np.int64), prepend=0), 4)))
    return pa.table({"a_chunk": pa.array([r[0] for r in out], pa.int64()), "places": pa.array([r[1] for r in out], pa.binary())})


def _surroundings(data: np.ndarray, starts: np.ndarray, answers: pa.Table):
    """Places told to be shared, their surroundings' number, and the distinct surroundings with the first place of each.

    A surrounding is the bytes before and from the anchor, zero beyond its document, and how many of each there are.
    """
    places = np.unique(_numbers(answers, "places"))
    owners = np.searchsorted(starts, places, side="right") - 1
    left = np.minimum(BEFORE, places - starts[owners])
    right = np.minimum(LENGTH, starts[owners + 1] - places)
    rows = np.zeros((len(places), BEFORE + LENGTH + 2), np.uint8)
    reach = np.arange(-BEFORE, LENGTH)
    for low in range(0, len(places), 1 << 16):
        at = slice(low, low + (1 << 16))
        ok = (reach >= -left[at, None]) & (reach < right[at, None])
        rows[at, :-2] = np.where(ok, data[np.clip(places[at, None] + reach, 0, max(len(data) - 1, 0))], 0) if len(data) else 0
    rows[:, -2], rows[:, -1] = left, right
    if not len(places):
        return places, owners, np.zeros(0, np.int64), rows, np.zeros(0, np.int64)
    _, first, number = np.unique(rows.view(f"V{rows.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return places, owners, number.ravel(), rows[first], first


# What a chunk was told before goes along with its rows (places, settled), so each step has all answers from the one before.
_CLASS_ROWS = "part int, chunk long, places binary, numbers binary, grams binary, around binary, ids binary"
_BYTE_ROWS = "part int, chunk long, places binary, settled binary, numbers binary, bytes binary, ids binary"
_SETTLED_ROWS = "a_chunk long, places binary, settled binary, open binary"
_DECIDED_ROWS = "a_chunk long, places binary, settled binary, numbers binary, bits binary"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    """Arrow table of a Spark schema of integers and binaries."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of bytes."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    h = np.full(len(rows), _C2)
    for column in wide.view("<u8").T:
        h = (h ^ (h >> np.uint64(31)) ^ column) * _C1
        h ^= h >> np.uint64(28)
        h *= _C2
    return h ^ (h >> np.uint64(33))


def _grams_of(rows: np.ndarray) -> np.ndarray:
    return gram_hashes(np.ascontiguousarray(rows[:, BEFORE: BEFORE + GRAM]).ravel())[::GRAM] if len(rows) else np.zeros(0, np.uint64)


def _emit_classes(parts: int):
    def emit(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if docs.num_rows and answers.num_rows:
            chunk = docs.column("chunk")[0].as_py()
            _, data, starts, ids = _chunk(docs)
            places, owners, _, rows, first = _surroundings(data, starts, answers)
            out.append((chunk % parts, chunk, _planes(np.diff(places, prepend=0), 4), None, None, None, None))
            grams, around, own = _grams_of(rows), _row_hashes(rows), ids[owners[first]]
            part = (grams % np.uint64(parts)).astype(np.int64)
            for p in np.unique(part):
                at = np.flatnonzero(part == p)
                out.append((int(p), chunk, None, _planes(np.diff(at, prepend=0), 4), _planes(grams[at] >> np.uint64(16), 6),
                            _planes(around[at], 8), _planes(own[at].view(np.uint64), 8)))
        return _table(_CLASS_ROWS, out)

    return emit


def _settle(table: pa.Table) -> pa.Table:
    """Which surroundings of each chunk exist with a smaller id, and which are left to compare byte by byte."""
    chunks, numbers, grams, around, ids, out = [], [], [], [], [], []
    for chunk, told, n, g, a, i in zip(*(table.column(c).to_pylist() for c in ("chunk", "places", "numbers", "grams", "around", "ids"))):
        if told is not None:
            out.append((chunk, told, None, None))
            continue
        numbers.append(np.cumsum(_unplanes(n, 4)).astype(np.int64))
        chunks.append(np.full(len(numbers[-1]), chunk, np.int64))
        grams.append(_unplanes(g, 6))
        around.append(_unplanes(a, 8))
        ids.append(_unplanes(i, 8).view(np.int64))
    if not numbers:
        return _table(_SETTLED_ROWS, out)
    c, n, g, a, i = (np.concatenate(x) for x in (chunks, numbers, grams, around, ids))
    order = np.lexsort((a, g))
    starts = np.flatnonzero(np.r_[True, (g[order][1:] != g[order][:-1]) | (a[order][1:] != a[order][:-1])])
    sizes = np.diff(np.r_[starts, len(order)])
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(i[order], starts), sizes)
    families = _runs(g[order][starts])  # classes of one anchor
    kinds = np.repeat(np.diff(np.r_[families, len(starts)]), np.diff(np.r_[families, len(starts)]))
    several = np.empty(len(order), bool)
    several[order] = np.repeat(kinds > 1, sizes)
    settled, left = i > least, (i == least) & several
    told = np.flatnonzero(settled | left)
    for at in np.split(told, _runs(c[told])[1:]) if len(told) else ():
        pick = lambda mask: _planes(np.diff(n[at[mask[at]]], prepend=0), 4)
        out.append((int(c[at[0]]), None, pick(settled), pick(left)))
    return _table(_SETTLED_ROWS, out)


def _numbers(answers: pa.Table, name: str) -> np.ndarray:
    told = [np.cumsum(_unplanes(x, 4)).astype(np.int64) for x in answers.column(name).to_pylist() if x]
    return np.concatenate(told) if told else np.zeros(0, np.int64)


def _emit_bytes(parts: int):
    def emit(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if docs.num_rows and answers.num_rows:
            chunk = docs.column("chunk")[0].as_py()
            for name, at in (("places", 2), ("settled", 3)):
                out += [(chunk % parts, chunk, *[x if k == at else None for k in range(2, 7)]) for x in answers.column(name).to_pylist() if x]
            left = np.sort(_numbers(answers, "open"))
            if len(left):
                _, data, starts, ids = _chunk(docs)
                _, owners, _, rows, first = _surroundings(data, starts, answers)
                part = (_grams_of(rows[left]) % np.uint64(parts)).astype(np.int64)
                for p in np.unique(part):
                    at = left[part == p]
                    out.append((int(p), chunk, None, None, at.astype("<u4").tobytes(), rows[at].tobytes(), ids[owners[first[at]]].astype("<i8").tobytes()))
        return _table(_BYTE_ROWS, out)

    return emit


def common_prefixes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of fixed-width rows, and how many bytes each shares with the one before it."""
    rows = np.ascontiguousarray(rows)
    order = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
    ordered = rows[order]
    differ = ordered[1:] != ordered[:-1]
    lcp = np.zeros(len(rows), np.int64)
    lcp[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return order, lcp


def interval_of(order: np.ndarray, lcp: np.ndarray, depth: int) -> np.ndarray:
    """For each row, the number of its prefix interval when the interval tree is cut at ``depth``."""
    out = np.zeros(len(order), np.int64)
    out[order] = np.cumsum(lcp < depth) if depth else 0
    return out


def smaller_elsewhere(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Bit o of each surrounding: the string that starts o bytes before the anchor also starts in a document with a smaller id."""
    forth, forth_lcp = common_prefixes(rows[:, BEFORE: BEFORE + LENGTH])
    back, back_lcp = common_prefixes(rows[:, BEFORE - 1:: -1] if BEFORE else rows[:, :0])
    left, right = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
    out = np.zeros(len(rows), np.uint64)
    for o in range(_OFFSETS):
        whole_string = np.flatnonzero((left >= o) & (right >= LENGTH - o))
        if len(whole_string) < 2:
            continue
        group = interval_of(forth, forth_lcp, LENGTH - o)[whole_string] * len(rows) + interval_of(back, back_lcp, o)[whole_string]
        order = np.argsort(group, kind="stable")
        runs = _runs(group[order])
        least = np.repeat(np.minimum.reduceat(ids[whole_string][order], runs), np.diff(np.r_[runs, len(order)]))
        hit = whole_string[order][least < ids[whole_string][order]]
        out[hit] |= np.uint64(1 << o)
    return out


def _decide(table: pa.Table) -> pa.Table:
    chunks, numbers, rows, ids, out = [], [], [], [], []
    for chunk, told, settled, n, b, i in zip(*(table.column(c).to_pylist() for c in ("chunk", "places", "settled", "numbers", "bytes", "ids"))):
        if n is None:
            out.append((chunk, told, settled, None, None))
            continue
        numbers.append(np.frombuffer(n, "<u4"))
        chunks.append(np.full(len(numbers[-1]), chunk, np.int64))
        rows.append(np.frombuffer(b, np.uint8).reshape(-1, BEFORE + LENGTH + 2))
        ids.append(np.frombuffer(i, "<i8"))
    if not numbers:
        return _table(_DECIDED_ROWS, out)
    c, n, rows, i = (np.concatenate(x) for x in (chunks, numbers, rows, ids))
    bits = smaller_elsewhere(rows, i)
    at = np.flatnonzero(bits)
    out += [(int(c[p[0]]), None, None, n[p].tobytes(), bits[p].tobytes()) for p in (np.split(at, _runs(c[at])[1:]) if len(at) else ())]
    return _table(_DECIDED_ROWS, out)


def _removed(data: np.ndarray, starts: np.ndarray, ids: np.ndarray, answers: pa.Table) -> np.ndarray:
    """Which bytes of a chunk go."""
    places, owners, number, rows, first = _surroundings(data, starts, answers)
    change = np.zeros(len(data) + 1, np.int32)
    if len(places):
        bits = np.zeros(len(rows), np.uint64)
        bits[_numbers(answers, "settled")] = np.uint64((1 << _OFFSETS) - 1)
        for n, b in zip(answers.column("numbers").to_pylist(), answers.column("bits").to_pylist()):
            if n is not None:
                bits[np.frombuffer(n, "<u4")] = np.frombuffer(b, "<u8")
        own = bits[number]
        # A smaller id in this very chunk has the same surroundings: every string in them goes.
        own[ids[owners] > ids[owners[first]][number]] = np.uint64((1 << _OFFSETS) - 1)
        left, right = rows[number, -2].astype(np.int64), rows[number, -1].astype(np.int64)
        for o in range(_OFFSETS):
            at = places[((own >> np.uint64(o)) & np.uint64(1)).astype(bool) & (left >= o) & (right >= LENGTH - o)] - o
            np.add.at(change, at, 1)
            np.add.at(change, at + LENGTH, -1)
    return np.cumsum(change[:-1]) > 0


def _finish(kind: pa.DataType):
    def finish(docs: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if not docs.num_rows:
            return pa.table([pa.array([], t) for t in (kind, pa.int64(), pa.int64(), pa.int64(), pa.string())], names)
        table, data, starts, ids = _chunk(docs)
        gone = _removed(data, starts, ids, answers)
        sizes = np.diff(starts)
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        begun = starts[:-1][sizes > 0]
        edge[begun] = gone[begun]
        total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[starts])
        kept = [hashlib.sha256(data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(starts[:-1], starts[1:])]
        return pa.table([table.column("doc_id").cast(kind), pa.array(sizes), pa.array(total(gone)), pa.array(total(edge)), pa.array(kept, pa.string())], names)

    return finish


def _chunked(docs: DataFrame) -> tuple[DataFrame, int]:
    """Documents dealt into chunks, and the number of parts of the anchors."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(whole())), F.lit(0)).alias("n")).first()["n"]
    chunks, parts = max(1, -(-size // CHUNK_BYTES)), max(1, -(-size // PART_BYTES))
    rows = docs.select(
        "doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL_ID)).alias("rank_id"), whole().alias("text"), F.xxhash64(whole()).alias("digest"))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chunks // 8))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("rank_id", "digest"), F.lit(chunks))).repartition(tasks, "chunk"), parts


def _answers(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks, and all they are told: shared anchors, settled surroundings, decided strings."""
    chunks, parts = _chunked(docs)
    told = lambda answers: chunks.groupBy("chunk").cogroup(answers.groupBy("a_chunk"))
    shared = chunks.groupBy("chunk").applyInArrow(_emit_anchors(parts), _ANCHOR_ROWS).groupBy("part").applyInArrow(
        _shared_anchors, "a_chunk long, places binary")
    settled = told(shared).applyInArrow(_emit_classes(parts), _CLASS_ROWS).groupBy("part").applyInArrow(_settle, _SETTLED_ROWS)
    decided = told(settled).applyInArrow(_emit_bytes(parts), _BYTE_ROWS).groupBy("part").applyInArrow(_decide, _DECIDED_ROWS)
    return chunks, decided


def repeat_table(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of each row of ``docs``."""
    chunks, answers = _answers(docs)
    field = docs.schema["doc_id"].dataType
    return chunks.groupBy("chunk").cogroup(answers.groupBy("a_chunk")).applyInArrow(
        _finish(to_arrow_type(field)), f"doc_id {field.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
