"""Quality score from zstandard dictionaries.

One dictionary is built from text labelled good and one from text labelled bad. A text that is like good text compresses
better with the first: the difference of the two compressed sizes, divided by their sum, is the evidence. A logistic fit on
labelled documents outside the dictionaries turns it into a calibrated score; it also sees the better size as a
share of the text, without which a text of endless repeats, tiny under both dictionaries, would look neutral, and the
length, as a short text's difference is worth less.

The fit reads a bounded sample: ``SAMPLE_DOCS`` whole documents a class, ``SAMPLE_BYTES`` bytes together. The calibration
sees each of them under dictionaries built without it (``FOLDS`` parts). Texts are scored whole.

Defined cases: null and empty texts get the score the fit gives to no evidence; a table without labels gives 0.5 to all;
with labels of one class the score is that class's smoothed share. Repeated rows each get their row. Other columns are
never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkshelf.llm.buffers import string_array
from linkshelf.llm.columns import held_out, whole
from linkshelf.llm.samples import class_counts, labelled_sample, logistic, logistic_fit, with_prior

SAMPLE_DOCS = 1200
SAMPLE_BYTES = 12_000_000
DICTIONARY_BYTES = 64_000
LEVEL = 3
FOLDS = 3
GOOD_FROM = 0.7


class CompressionModel:
    """Two dictionaries and the calibration; plain values, so it can be sent to workers."""

    def __init__(self, sample: list[tuple[int, str, int]], counts: dict[int, int]):
        classes = [[t.encode() for _, t, y in sample if y == want] for want in (0, 1)]
        x, y = [], []
        for fold in range(FOLDS):  # evidence of a text under dictionaries it has no part in
            evidence = Evidence([_dictionary([t for i, t in enumerate(c) if i % FOLDS != fold]) for c in reversed(classes)])
            for want, texts in enumerate(classes):
                x += [evidence.of(t) for i, t in enumerate(texts) if i % FOLDS == fold]
                y += [want] * len(texts[fold::FOLDS])
        marks = np.array(y, float)
        self.fit = with_prior(logistic_fit(np.array(x).reshape(len(x), Evidence.WIDTH), marks), marks, counts)
        self.dictionaries = [_dictionary(c) for c in reversed(classes)]


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the raw text where there is too little to train on."""
    pieces = [t[k: k + 2000] for t in texts for k in range(0, len(t), 2000)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[-DICTIONARY_BYTES:]


class Evidence:
    """Numbers of one text: normalised size difference, size share, length, and their products."""

    WIDTH = 7

    def __init__(self, dictionaries: list[bytes]):
        self._compressors = []
        for data in dictionaries:
            kind = zstandard.DICT_TYPE_AUTO if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
            held = zstandard.ZstdCompressionDict(data, dict_type=kind) if len(data) >= 8 else None
            if held:
                held.precompute_compress(level=LEVEL)
            self._compressors.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False) if held
                else zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, write_content_size=False))

    def of(self, text: bytes) -> tuple[float, ...]:
        if not text:
            return (0.0,) * self.WIDTH
        good, bad = (len(c.compress(text)) for c in self._compressors)
        difference = (bad - good) / (bad + good)
        share = np.log(min(good, bad) / len(text))
        size = np.log(len(text))
        return difference, difference * abs(difference), share, share * share, difference * share, size, difference * size


def fit(docs: DataFrame, labels: DataFrame) -> CompressionModel:
    return CompressionModel(labelled_sample(docs, labels, "quality", SAMPLE_DOCS, SAMPLE_BYTES), class_counts(labels, "quality"))


def quality_scores(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        known = shared.value
        evidence = Evidence(known.dictionaries)
        for batch in batches:
            x = np.array([evidence.of((t.as_py() or "").encode()) for t in string_array(batch.column("text"))])
            p = logistic(x.reshape(batch.num_rows, Evidence.WIDTH), known.fit)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= GOOD_FROM).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out().alias("held_out"), whole().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")
