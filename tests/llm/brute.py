"""Plain versions of the operators, one document at a time."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = set("#*$%&|<>")


def lowered(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def exact(rows):
    """{(index): (keep_id, size, kept, digest)} of (doc_id, text) rows."""
    digests = [hashlib.sha256(lowered(t).encode()).hexdigest() for _, t in rows]
    out, stays = [], set()
    for (doc_id, _), digest in zip(rows, digests):
        group = [i for (i, _), d in zip(rows, digests) if d == digest]
        keep = max((i for i in group if i is not None), default=None)
        kept = doc_id == keep and (digest, doc_id) not in stays
        stays |= {(digest, doc_id)} if kept else set()
        out.append((doc_id, keep, len(group), kept, digest))
    return out


def counts(text: str | None):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    seen, again, lines = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            lines += 1
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in SYMBOLS for c in text), again, len(covered), lines


def fingerprint(text: str | None) -> int:
    import xxhash

    words = WORD.findall(lowered(text))
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i: i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, fps):
    """Least id of each row's component of fingerprints at most three bits apart."""
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    known = [[ids[j] for j in range(len(ids)) if label[j] == label[i] and ids[j] is not None] for i in range(len(ids))]
    return [min(k, default=None) for k in known]


def without_repeats(rows, length: int = 50):
    """(doc_id, bytes, removed, spans, digest) of (doc_id, text) rows."""
    rank = lambda i: -(1 << 63) if i is None else i
    first: dict[bytes, int] = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k: k + length]
            first[w] = min(first.get(w, rank(i)), rank(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if first[b[k: k + length]] < rank(i):
                gone[k: k + length] = [True] * length
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def robust_verdicts(rows):
    """kept of (text, lang, source) rows: base rules, then the minimum covariance determinant of each group."""
    from linkshelf.llm import quality_rules as Q

    stats = [counts(t) for t, _, _ in rows]
    failed = [c[0] < 50 or 100 * c[4] > 50 * c[0] for c in stats]
    vec = np.array([[np.log(max(c[1], 1) / max(c[0], 1) + 1) if True else 0, np.sqrt(c[2] / max(c[1], 1)), np.sqrt(c[3] / max(c[5], 1)),
                     np.sqrt(c[4] / max(c[0], 1))] for c in stats]) if stats else np.zeros((0, 4))
    # The query divides by at least one, also above: log(chars / words + 1) with chars taken as at least one.
    groups: dict[tuple, list[int]] = {}
    for i, (_, lang, source) in enumerate(rows):
        if not failed[i]:
            for g in ((2, lang or "", source or ""), (1, lang or "", ""), (0, "", "")):
                groups.setdefault(g, []).append(i)

    def order_bin(bins, share):
        bins = np.sort(np.clip(bins, 0, 4095))
        return bins[int(np.ceil(len(bins) * share)) - 1]

    found = {}
    for g, at in groups.items():
        if len(at) < Q.MIN_ROWS and g[0]:
            continue
        x = vec[at]
        m = np.array([(order_bin(np.floor(x[:, i] * 1024).astype(int), 0.5) + 0.5) / 1024 for i in range(4)])
        mad = np.array([1.4826 * (order_bin(np.floor(np.abs(x[:, i] - m[i]) * 1024).astype(int), 0.5) + 0.5) / 1024 for i in range(4)])
        p = np.diag(1 / (mad**2 + np.square(Q.FLOORS)))
        for _ in range(Q.STEPS):
            d = np.einsum("ni,ij,nj->n", x - m, p, x - m)
            bins = np.floor((np.log(np.maximum(d, 1e-6)) + 14) * 128).astype(int)
            near = x[bins <= order_bin(bins, Q.SHARE)]
            m = near.mean(0)
            p = np.linalg.inv(Q.CONSISTENCY * (near.T @ near / len(near) - np.outer(m, m)) + np.diag(np.square(Q.FLOORS)))
        found[g] = m, p
    kept = []
    for i, (_, lang, source) in enumerate(rows):
        if failed[i]:
            kept.append(False)
            continue
        m, p = next(found[g] for g in ((2, lang or "", source or ""), (1, lang or "", ""), (0, "", "")) if g in found)
        kept.append(bool((vec[i] - m) @ p @ (vec[i] - m) <= Q.CUTOFF))
    return kept


def mix(rows, units, block_bytes):
    """{(index, epoch): (block, slot)} by earliest deadline first, slot by slot. rows: (source, bytes, order key)."""
    period = sum(units.values())
    streams = {s: sorted((k, i, b) for i, (src, b, k) in enumerate(rows) if src == s) for s in units}
    size = {s: sum(b for _, _, b in r) for s, r in streams.items()}
    need = {s: -(-size[s] // block_bytes) for s in units}
    taken, slots, t = {s: 0 for s in units}, {s: [] for s in units}, 0
    while any(taken[s] < need[s] for s in units):
        ready = [(-(-(taken[s] + 1) * period // units[s]), s) for s in units if taken[s] * period // units[s] <= t]
        _, s = min(ready)
        slots[s].append(t)
        taken[s] += 1
        t += 1
    out = {}
    for s, r in streams.items():
        at, epoch = 0, 0
        while at < taken[s] * block_bytes:
            for _, i, b in r:
                if at // block_bytes < taken[s]:
                    out[i, epoch] = at // block_bytes, slots[s][at // block_bytes]
                at += b
            epoch += 1
    return out, t


def divergence(rows, least_docs=10, top=10):
    """{(lang, source, part, item, value, rank)} of (text, lang, source) rows, over all kept terms."""
    rows = [(lowered(t), la or "", s or "") for t, la, s in rows]
    bags = [(Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)), la, s) for t, la, s in rows]
    out = set()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {la for _, la, _ in bags}:
        df = Counter(w for b, la, _ in bags if la == lang for w in b)
        kept = sorted(w for w in df if df[w] >= least_docs)
        sources = sorted({s for _, la, s in bags if la == lang})
        counts = {s: Counter() for s in sources}
        for b, la, s in bags:
            if la == lang:
                counts[s].update(b)
        whole = sum(counts.values(), Counter())

        def shares(c):
            total = sum(c[w] for w in kept) + 2 * len(kept)
            return {w: 1 + 10**9 * (c[w] + 2) // total for w in kept}

        p, q = {s: shares(counts[s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(sum(f(p[s][w], p[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(f(p[s][w], q[w]), w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, o, v, i) for i, (v, o) in enumerate(ranked, 1) if part == "pair" or i <= top}
    return out


def trie(rows):
    """{(conv_id, depth, parent, n_convs, n_children, n_leaves, saved, sha)} of (conv_id, turn, role, text) rows."""
    import zlib

    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            order = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, order, role, text))
    convs = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}
    again = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        again[c] = convs.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]  # as SQL: the sign of c
    nodes = {}
    for c, seq in again.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    out = set()
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes) for p in below)
        saved = sum((len(nodes[p]) - 1) * len(WORD.findall(p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in sorted(members) if len(again[c]) == len(path))
        out.add((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(len(p) == len(path) + 1 for p in below), leaves, saved,
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def joined(rows, percent=85):
    """[(doc_id, n_shingles, component_id)] of (doc_id, text) rows: every pair is compared."""
    sets = []
    for _, text in rows:
        words = WORD.findall(lowered(text))
        k = min(4, len(words))
        sets.append({tuple(words[i: i + k]) for i in range(len(words) - k + 1)} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(doc_id, len(sets[i]), least.get(find(i))) for i, (doc_id, _) in enumerate(rows)]
