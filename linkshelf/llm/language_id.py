"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to ``ORDER`` is counted on labelled documents. A symbol seen after its longest
context costs -log(count / (total + kinds)); one not seen costs the escape, -log(kinds / (total + kinds)), and is tried
in the next shorter context (method C), down to a flat order of 256 bytes. After training the statistics are frozen, so the
cost of every known context and symbol is worked out once into tables; a text's exact code length is a sum of lookups.
The language with the shortest code wins.

The trees are fitted on a bounded sample: ``SAMPLE_DOCS`` whole documents a language, the lowest by a hash of the id, and
``SAMPLE_BYTES`` of them together. Texts are scored whole.

Defined cases: null, empty and letterless texts are ``und`` with score 0; with nothing to learn from, every text is
``und``; equal code lengths go to the first language by name; repeated rows each get their row. At most
``MAX_LANGUAGES`` language names are learned, more raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkshelf.llm.buffers import pieces, string_array, text_bytes
from linkshelf.llm.columns import held_out, whole
from linkshelf.llm.samples import lowest_by_hash

ORDER = 3
SAMPLE_DOCS = 250
SAMPLE_BYTES = 4_000_000
#: Bytes of text whose costs are held at once.
STEP_BYTES = 1 << 20
MAX_LANGUAGES = 200
#: Bytes of evidence the score trusts; beyond, a longer text adds no certainty.
EVIDENCE_BYTES = 200
_SLOT_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """The ``order`` bytes before each byte and itself, as one integer. The text is preceded by line breaks."""
    held = np.concatenate([np.full(order, 10, np.uint8), data])
    key = np.zeros(len(data), np.uint32)
    for k in range(order + 1):
        key = (key << np.uint32(8)) | held[k: k + len(data)]
    return key


class ContextTrees:
    """Frozen costs of all languages: for each order, known contexts with symbols, and escapes of known contexts."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER):
        self.languages, self.order = sorted(texts), order
        counts = []
        for k in range(order + 1):
            counts.append([np.unique(np.concatenate([_grams(np.frombuffer(t, np.uint8), k) for t in texts[name]] or [np.zeros(0, np.uint32)]),
                                     return_counts=True) for name in self.languages])
        self.costs, self.escapes = [], []
        for k in range(order + 1):
            known = np.unique(np.concatenate([np.zeros(0, np.uint32), *[keys for keys, _ in counts[k]]]))
            contexts = np.unique(known >> np.uint32(8))
            escape = np.zeros((len(contexts), len(self.languages)), np.float32)
            cost = np.zeros((len(known), len(self.languages)), np.float32)
            for j, (keys, n) in enumerate(counts[k]):
                at = np.searchsorted(contexts, keys >> np.uint32(8))
                total, kinds = np.bincount(at, n, len(contexts)), np.bincount(at, minlength=len(contexts))
                seen = kinds > 0
                escape[seen, j] = -np.log(kinds[seen] / (total + kinds)[seen])
                # Not seen by this language: its escape, then what the shorter context costs.
                cost[:, j] = escape[np.searchsorted(contexts, known >> np.uint32(8)), j] + self._shorter(known, k)[:, j]
                cost[np.searchsorted(known, keys), j] = -np.log(n / (total + kinds)[at])
            self.costs.append((_Slots(known), cost))
            self.escapes.append((_Slots(contexts), escape))

    def _shorter(self, keys: np.ndarray, order: int) -> np.ndarray:
        if order == 0:
            return np.full((len(keys), len(self.languages)), np.log(256.0), np.float32)
        return self.cost(keys & np.uint32((1 << (8 * order)) - 1), order - 1)

    def cost(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Nats of each symbol after its context in every language."""
        slots, table = self.costs[order]
        at = slots.find(keys)
        out = table[np.maximum(at, 0)] if len(table) else np.zeros((len(keys), len(self.languages)), np.float32)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            gone = keys[miss]
            rest = self._shorter(gone, order)
            contexts, escape = self.escapes[order]
            where = contexts.find(gone >> np.uint32(8))
            known = where >= 0
            rest[known] += escape[where[known]]
            out[miss] = rest
        return out

    def lengths(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Code length in nats of each text in every language."""
        out = np.zeros((len(starts) - 1, len(self.languages)))
        if not len(data):
            return out
        keys = _grams(data, self.order)
        for k in range(self.order):  # the first bytes of a text see line breaks, not the text before
            at = starts[:-1] + k
            at = at[at < starts[1:]]
            mask = (1 << (8 * (k + 1))) - 1
            line = int.from_bytes(b"\n" * (self.order - k), "big") << (8 * (k + 1))
            keys[at] = (keys[at] & np.uint32(mask)) | np.uint32(line)
        filled = np.flatnonzero(np.diff(starts))
        begins = starts[filled]
        # A long text is summed a step at a time: a step's table of costs has a column for each language.
        for low in range(0, len(data), STEP_BYTES):
            high = min(low + STEP_BYTES, len(data))
            cuts = np.unique(np.concatenate([[low], begins[(begins > low) & (begins < high)]]))
            rows = filled[np.searchsorted(begins, cuts, side="right") - 1]
            out[rows] += np.add.reduceat(self.cost(keys[low:high], self.order), cuts - low, axis=0, dtype=np.float64)
        return out


class _Slots:
    """Positions of sorted keys, by open addressing."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.at = np.zeros(1 << bits, np.uint32), np.full(1 << bits, -1, np.int32)
        waiting, step = np.arange(len(keys), dtype=np.int32), 0
        home = self._home(keys)
        self.rounds = 0
        while len(waiting):
            spot = (home[waiting] + step) & self.mask
            free = self.at[spot] < 0
            self.at[spot[free]] = waiting[free]
            self.keys[spot[free]] = keys[waiting[free]]
            waiting = waiting[self.at[spot] != waiting]
            step += 1
            self.rounds = step

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _SLOT_MULTIPLIER) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions, or -1."""
        spot = self._home(keys)
        at = self.at[spot]
        other = np.flatnonzero((at >= 0) & (self.keys[spot] != keys))
        step = 1
        while len(other) and step <= self.rounds:
            next_spot = (spot[other] + step) & self.mask
            found = self.at[next_spot]
            at[other] = found
            other = other[(found >= 0) & (self.keys[next_spot] != keys[other])]
            step += 1
        at[other] = -1
        return at


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, order: int = ORDER) -> ContextTrees:
    """Trees of the languages named in the rows that may be learned from."""
    named = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sized = named.groupBy("doc_id", "lang").agg(F.max(F.octet_length(whole())).cast("bigint").alias("size"))
    chosen = lowest_by_hash(sized, "lang", sample_docs, MAX_LANGUAGES, SAMPLE_BYTES)
    texts = docs.select("doc_id", "lang", whole().alias("text"))
    rows = texts.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("lang", "doc_id").agg(F.max("text").alias("text")).collect()
    sample: dict[str, list[bytes]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["doc_id"])):
        sample.setdefault(row["lang"], []).append(row["text"].encode())
    return ContextTrees(sample, order)


def _has_letter(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    low = data | 32
    ascii_letters = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
    found = ascii_letters[starts[1:]] > ascii_letters[starts[:-1]]
    for i in np.flatnonzero(~found & (np.diff(starts) > 0)):
        found[i] = any(c.isalpha() for c in data[starts[i]: starts[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def languages(docs: DataFrame, trees: ContextTrees) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def predict(batches):
        model = shared.value
        names = np.array(model.languages + ["und"], object)
        for batch in batches:
            data, starts = text_bytes(string_array(batch.column("text")))
            best, score = np.full(batch.num_rows, len(model.languages)), np.zeros(batch.num_rows)
            for low, high in pieces(starts, 1 << 20) if model.languages else ():
                at = starts[low: high + 1]
                body, at = data[at[0]: at[-1]], at - at[0]
                spent = model.lengths(body, at)
                some = _has_letter(body, at)
                n = np.maximum(np.diff(at), 1)[:, None]
                weight = np.exp((spent.min(1, keepdims=True) - spent) * np.minimum(1, EVIDENCE_BYTES / n))
                best[low:high][some] = spent.argmin(1)[some]
                score[low:high][some] = (1 / weight.sum(1))[some]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names[best], pa.string()), pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), whole().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
