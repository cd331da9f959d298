"""Toxicity score by a subsequence string kernel, with Nyström landmarks.

Two words are alike by the letter triples they share in order, gaps allowed: a triple that spans s letters counts
``DECAY ** (s - 3)``, up to ``SPAN`` letters. So "id.iot" or "idxiot" still share most of their triples with "idiot".
Signs inside a word are passed over, and single letters set apart by spaces ("i d i o t") are read as one word.

A support vector machine with squared hinge loss is trained on words, in the space that ``LANDMARKS`` landmark words span under
the kernel (Nyström). Only documents are labelled, so the toxic words of a toxic document are found as the machine is
trained: at first those that clean documents lack or that stand in a clearly larger share of toxic documents (smoothed log odds over
``SURE`` standard errors), then, in ``ROUNDS`` rounds, those it finds worst among all over ``LIKELY`` errors, against the worst words of
clean documents. So a mislabelled or quoting clean document doesn't clear an insult. Its decision is linear in the kernel, and so collapses into one weight for each triple; a whole text is scored
in one pass over its letters. The worst word of a text, calibrated on folds the machine has not seen, is its score.

The fit reads a bounded sample: ``SAMPLE_DOCS`` whole documents a class, ``SAMPLE_BYTES`` bytes together. Texts are scored whole.

Defined cases: a text without words has the calibrated score of the least evidence; without labels of both classes the score is
the share of toxic labels, or 0 without any; repeated rows each get their row. Other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkshelf.llm.buffers import pieces, string_array, text_bytes
from linkshelf.llm.columns import held_out, whole
from linkshelf.llm.samples import class_counts, labelled_sample, logistic, logistic_fit, with_prior

SAMPLE_DOCS = 1200
SAMPLE_BYTES = 12_000_000
LANDMARKS = 256
ROUNDS = 5
FOLDS = 3
SPAN = 6
DECAY = 0.6
#: Standard errors of the log odds from which a word that clean documents have too is taken for toxic: at first, and in later rounds.
SURE = 3.0
LIKELY = 1.5
TOXIC_FROM = 0.3
_WORST = 3
_CLEAN_WORDS = 6000
_TRIPLES = 1 << 15
#: Score of a text without words.
_NOTHING = -3.0


def _codes() -> np.ndarray:
    """Letters to 1-26, bytes of letters beyond ASCII to 27-31, all else to 0."""
    table = np.zeros(256, np.int32)
    for k in range(26):
        table[ord("a") + k] = table[ord("A") + k] = k + 1
    table[0x80:0xC0] = 27 + (np.arange(0x80, 0xC0) & 3)
    table[0xC0:] = 31
    return table


_CODE = _codes()
#: Bytes that are no letters.
_SIGNS = bytes(np.flatnonzero(_CODE == 0).tolist())
_OFFSETS = [(j, s) for s in range(2, SPAN) for j in range(1, s)]


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word; single letters in a row, one space apart, are one word."""
    gap = (data <= 32) & ((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    n = len(data)
    before = np.ones(n + 1, bool)
    before[1:] = gap
    before |= edge  # a word cannot begin earlier than here
    after = np.ones(n + 1, bool)
    after[:n] = gap
    after |= edge  # nor end later
    single = ~gap & before[:n] & after[1:] & (_CODE[data] > 0)
    joined = np.zeros(n, bool)
    if n > 2:
        joined[1:-1] = (data[1:-1] == 32) & single[:-2] & single[2:]
    inside = ~gap | joined
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _self_kernel(size: int) -> float:
    """The kernel of a word of ``size`` different letters with itself."""
    return max(sum(max(0, size - s) * DECAY ** (2 * (s - 2)) for _, s in _OFFSETS), 1e-6)


_NORM = 1 / np.sqrt([_self_kernel(n) for n in range(65)])


def norms(sizes: np.ndarray) -> np.ndarray:
    return _NORM[np.minimum(sizes, 64)]


def letters(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all letters, and the word each belongs to; other signs are left out."""
    code = _CODE[data]
    mark = np.zeros(len(data), np.int32)
    mark[begins] = 1
    held = np.flatnonzero(code)
    return code[held], np.cumsum(mark, dtype=np.int32)[held] - 1


def word_scores(data: np.ndarray, begins: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The kernel machine's sum for each word, from one weight a triple."""
    code, owner = letters(data, begins)
    first, second = code << 10, code << 5
    total = np.zeros(len(code), np.float32)
    for s in range(2, SPAN):
        n = len(code) - s
        if n <= 0:
            break
        part = np.zeros(n, np.float32)
        for j in range(1, s):
            part += weights[first[:n] | second[j: n + j] | code[s:]]
        part *= owner[:n] == owner[s:]
        total[:n] += part * np.float32(DECAY ** (s - 2))
    return np.bincount(owner, total, len(begins)) * norms(np.bincount(owner, minlength=len(begins)))


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words one after the other, and where each begins."""
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64)


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(word, triple, value)`` of each word's triples."""
    code, owner = letters(*_joined(texts))
    found = []
    for j, s in _OFFSETS:
        n = max(0, len(code) - s)
        at = np.flatnonzero(owner[:n] == owner[s: n + s])
        found.append((owner[at], (code[at] << 10) | (code[at + j] << 5) | code[at + s], np.full(len(at), DECAY ** (s - 2))))
    word, triple, value = (np.concatenate(x) for x in zip(*found))
    return word, triple, value * norms(np.array([len(t) for t in texts]))[word]


def _products(features: tuple, rows: int, weights: np.ndarray) -> np.ndarray:
    """Kernel of ``rows`` words with landmarks given as one column of triple weights each."""
    word, triple, value = features
    out = np.zeros((rows, weights.shape[1]), np.float32)
    order = np.argsort(word, kind="stable")
    for low in range(0, len(order), 1 << 16):
        at = order[low: low + (1 << 16)]
        ids, starts = np.unique(word[at], return_index=True)
        out[ids] += np.add.reduceat(weights[triple[at]] * value[at, None].astype(np.float32), starts, axis=0)
    return out


class _Machine:
    """Nyström space of some landmarks, and a squared-hinge machine in it."""

    def __init__(self, landmarks: list[bytes]):
        word, triple, value = _features(landmarks)
        self.phi = np.zeros((_TRIPLES, len(landmarks)), np.float32)
        np.add.at(self.phi, (triple, word), value)
        values, vectors = np.linalg.eigh((self.phi.T @ self.phi).astype(float))
        held = values > 1e-4
        self.root = vectors[:, held] / np.sqrt(values[held])

    def train(self, texts: list[bytes], y: np.ndarray, importance: np.ndarray) -> np.ndarray:
        """One weight a triple, the intercept in the place no triple has."""
        z = np.hstack([_products(_features(texts), len(texts), self.phi) @ self.root, np.ones((len(texts), 1))])
        w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], 1.0)
        penalty[-1] = 1e-3
        active = np.ones(len(texts), bool)
        for _ in range(30):
            za, ia = z[active], importance[active]
            w = np.linalg.solve((za * ia[:, None]).T @ za + np.diag(penalty), za.T @ (ia * y[active]))
            now = y * (z @ w) < 1
            if (now == active).all():
                break
            active = now
        weights = (self.phi @ (self.root @ w[:-1])).astype(np.float32)
        weights[0] = w[-1]
        return weights


def split_words(text: bytes) -> list[bytes]:
    """The words of a text, lower-cased letters only."""
    data = np.frombuffer(text, np.uint8)
    begins, ends = words(data, np.array([0, len(data)]))
    return [w for w in (text[a:b].lower().translate(None, _SIGNS) for a, b in zip(begins.tolist(), ends.tolist())) if w]


def _altered(word: bytes) -> list[bytes]:
    """The word with a letter put in, and with one doubled."""
    k = len(word) // 2
    return [word[:k] + b"x" + word[k:], word[:k] + word[k - 1: k] + word[k:]]


def _log_odds(toxic: dict[bytes, int], clean: dict[bytes, int], sizes: tuple[int, int]) -> dict[bytes, float]:
    """For each word of toxic documents, the smoothed log odds of its share in them against clean ones, in standard errors."""
    shift = np.log((sizes[1] + 1) / (sizes[0] + 1))
    found = {}
    for w, n in toxic.items():
        a, b = n + 0.5, clean.get(w, 0) + 0.5
        found[w] = float((np.log(a / b) + shift) / np.sqrt(1 / a + 1 / b))
    return found


def _counted(bags: list[list[bytes]]) -> dict[bytes, int]:
    """In how many bags each word is."""
    found: dict[bytes, int] = {}
    for bag in bags:
        for w in bag:
            found[w] = found.get(w, 0) + 1
    return found


def _learn(sample: list[tuple[bytes, int]]) -> np.ndarray:
    """Triple weights from labelled texts."""
    toxic = [[w for w in sorted(set(split_words(t))) if len(w) > 2] for t, y in sample if y]
    clean_bags = [sorted(set(split_words(t))) for t, y in sample if not y]
    spread, known = _counted(toxic), _counted(clean_bags)
    odds = _log_odds(spread, known, (len(toxic), len(clean_bags)))
    sure = {w for w in spread if w not in known or odds[w] >= SURE}
    clean_words = sorted(known.keys() - sure)
    toxic = [bag for bag in ([w for w in bag if w in sure or odds[w] >= LIKELY] for bag in toxic) if bag]
    if not sure or not clean_words:
        return np.zeros(_TRIPLES, np.float32)
    rng = np.random.default_rng(7)
    chosen = sorted(sure, key=lambda w: (-odds[w], w))[: _CLEAN_WORDS // 2]
    clean = [clean_words[i] for i in sorted(rng.choice(len(clean_words), min(len(clean_words), _CLEAN_WORDS), replace=False))]
    machine = _Machine(sorted({*chosen[: LANDMARKS // 2], *[clean[i] for i in rng.choice(len(clean), min(len(clean), LANDMARKS // 2), replace=False)]}))
    importance = np.array([float(spread[w]) for w in chosen])
    weights = np.zeros(_TRIPLES, np.float32)
    all_clean, all_toxic = _joined(clean_words), _joined([w for bag in toxic for w in bag])
    for turn in range(ROUNDS):
        altered = [v for w in chosen for v in _altered(w)] if turn == ROUNDS - 1 else []
        scaled = importance * min(1.0, len(clean) / max(1.0, importance.sum()))
        weights = machine.train(
            chosen + altered + clean, np.r_[np.ones(len(chosen) + len(altered)), -np.ones(len(clean))],
            np.r_[scaled, np.repeat(scaled, 2)[: len(altered)] / 2, np.ones(len(clean))])
        scores = word_scores(*all_toxic, weights)
        worst: dict[bytes, int] = {}
        at = 0
        for bag in toxic:
            top = np.argsort(-scores[at: at + len(bag)], kind="stable")[:_WORST]
            best = scores[at + top[0]]
            for k in top:
                if scores[at + k] >= 0.5 * best:
                    worst[bag[k]] = worst.get(bag[k], 0) + 1
            at += len(bag)
        chosen = sorted(worst, key=lambda w: (-worst[w], w))[: _CLEAN_WORDS // 2]
        importance = np.array([float(worst[w]) for w in chosen])
        hard = np.argsort(-word_scores(*all_clean, weights), kind="stable")[: _CLEAN_WORDS // 2]
        other = rng.choice(len(clean_words), min(len(clean_words), _CLEAN_WORDS // 2), replace=False)
        clean = [clean_words[i] for i in sorted({*hard.tolist(), *other.tolist()})]
        if turn < 2:  # landmarks move to the words now held to be toxic
            machine = _Machine(sorted({*chosen[: LANDMARKS // 2], *[clean[i] for i in rng.choice(len(clean), min(len(clean), LANDMARKS // 2), replace=False)]}))
    return weights


def evidence(data: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each text, the worst word's decision and the logarithm of its number of words."""
    begins, ends = words(data, starts)
    scores = word_scores(data, begins, weights) + weights[0]
    first = np.searchsorted(begins, starts)
    out = np.full((len(starts) - 1, 2), [_NOTHING, 0.0])
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some, 0] = np.maximum.reduceat(scores, first[:-1][some])
        out[some, 1] = np.log(np.diff(first)[some])
    return out


class ToxicityModel:
    """Triple weights and calibration; plain values, so it can be sent to workers."""

    def __init__(self, sample: list[tuple[int, str, int]], counts: dict[int, int]):
        texts = [(t.encode(), y) for _, t, y in sample]
        x, marks = [], []
        for fold in range(FOLDS):
            weights = _learn([s for i, s in enumerate(texts) if i % FOLDS != fold])
            for t, y in texts[fold::FOLDS]:
                x.append(evidence(np.frombuffer(t, np.uint8), np.array([0, len(t)]), weights)[0])
                marks.append(y)
        marks = np.array(marks, float)
        self.fit = with_prior(logistic_fit(np.array(x).reshape(len(x), 2), marks, least_scale=0.5), marks, counts)
        self.weights = _learn(texts)
        self.constant = None if 0 < marks.sum() < len(marks) else float(counts.get(1, 0) > 0)


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    return ToxicityModel(labelled_sample(docs, labels, "toxic", SAMPLE_DOCS, SAMPLE_BYTES), class_counts(labels, "toxic"))


def toxicity_scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        known = shared.value
        for batch in batches:
            data, starts = text_bytes(string_array(batch.column("text")))
            parts = [evidence(data[starts[a]: starts[b]], starts[a: b + 1] - starts[a], known.weights) for a, b in pieces(starts)]
            x = np.concatenate(parts) if parts else np.zeros((0, 2))
            p = logistic(x, known.fit) if known.constant is None else np.full(len(x), known.constant)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= TOXIC_FROM).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out().alias("held_out"), whole().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")
