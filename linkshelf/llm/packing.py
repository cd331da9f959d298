"""Packing token ids into fixed windows by concatenating and cutting.

Pass one encodes each partition once and stores the ids with each document's place inside its run. A run is a stretch of
consecutive rows of one file that one task reads; a table that isn't read from files has one run for each partition.
Prefix sums over the runs' totals, in the order of files and rows, turn these places into global offsets: documents of
stored tables are packed in the order in which they are stored. Pass two cuts every document where windows end, so a
piece is known from its document and the offset alone (its boundary record) and no window is assembled in one task.

Defined cases: a null or empty text is its end id alone; repeated rows are packed once each; an empty table gives no
pieces; documents of any length are cut into as many pieces as they touch windows. Only the last window is padded.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkshelf.llm.buffers import string_array
from linkshelf.llm.columns import whole
from linkshelf.session import materialize

WINDOW_TOKENS = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k"
#: Runs whose offsets are broadcast, some 200 bytes each.
BROADCAST_RUNS = 50_000
#: Ids that a worker holds before it hands them on; a longer text is a piece of its own.
PIECE_IDS = 1 << 18
#: White space of so many characters is left to the ``tokenizers`` file.
LONG_SPACE = 10_000
_SPACES = re.compile(r"\s{%d}" % LONG_SPACE)


class Encoder:
    """Ids of a byte-level vocabulary, one instance a worker process.

    The vocabulary's rank file gives the ids of its ``tokenizers`` file several times faster. Texts that spell a
    special token are left to the ``tokenizers`` file itself, and so are texts with very long white space: the rank file's pattern
    goes back over a whole run of it and overflows the stack on a million characters.
    """

    _loaded: dict[str, "Encoder"] = {}

    def __init__(self, name: str):
        import base64
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        self._ranks = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._file, self._full = public_tokenizers.path(f"{name}.json"), None

    @classmethod
    def named(cls, name: str) -> "Encoder":
        if name not in cls._loaded:
            cls._loaded[name] = cls(name)
        return cls._loaded[name]

    def ids(self, text: str) -> np.ndarray:
        if "<|" in text or (len(text) > LONG_SPACE and _SPACES.search(text)):
            if self._full is None:
                from tokenizers import Tokenizer

                self._full = Tokenizer.from_file(self._file)
            return np.array(self._full.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self._ranks.encode_ordinary(text), np.uint32)


def _placed(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, file, row)``: where each row is stored, nulls for a table that isn't read from files."""
    try:
        return docs.select("doc_id", whole().alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return docs.select("doc_id", whole().alias("text"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("bigint").alias("row"))


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """``(file, run, doc_id, ids, n, start)``: little-endian ids with the end id, and the place inside the run.

    Stored in the shared folder: what later steps read doesn't change when a task is run again.
    """

    def encode(batches):
        encoder, part = Encoder.named(vocabulary), TaskContext.get().partitionId()
        file, run, start, expected = None, part, 0, None
        for batch in batches:
            out, held, low = [], 0, 0
            texts = string_array(batch.column("text"))
            for i, (at, row) in enumerate(zip(batch.column("file").to_pylist(), batch.column("row").to_pylist())):
                if at != file or (row is not None and row != expected):
                    file, run, start = at, part if row is None else row, 0
                expected = None if row is None else row + 1
                ids = np.append(encoder.ids(texts[i].as_py() or ""), np.uint32(end_id)).astype("<u4")
                out.append((file or "", run, ids.tobytes(), len(ids), start))
                start, held = start + len(ids), held + len(ids)
                if held >= PIECE_IDS or i == batch.num_rows - 1:
                    columns = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), batch.column("doc_id").slice(low, len(out)), pa.array(columns[2], pa.binary()),
                        pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], ["file", "run", "doc_id", "ids", "n", "start"])
                    out, held, low = [], 0, i + 1

    rows = _placed(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return materialize(rows.mapInArrow(encode, f"file string, run bigint, doc_id {kind}, ids binary, n bigint, start bigint"), "packing")


def offsets(tokens: DataFrame) -> DataFrame:
    """``(file, run, base)``: ids in all runs before. One row a run, summed inside files, then over files."""
    totals = tokens.groupBy("file", "run").agg(F.sum("n").alias("n"))
    files = totals.groupBy("file").agg(F.sum("n").alias("n"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    first = files.select("file", F.coalesce(F.sum("n").over(before.partitionBy(F.lit(0)).orderBy("file")), F.lit(0)).alias("first"))
    inside = F.coalesce(F.sum("n").over(before.partitionBy("file").orderBy("run")), F.lit(0))
    return totals.withColumn("inside", inside).join(first, "file").select("file", "run", (F.col("first") + F.col("inside")).alias("base"))


def packed(docs: DataFrame, window: int = WINDOW_TOKENS, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """Pieces with their ids: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` (little-endian uint32)."""
    tokens = encoded(docs, vocabulary, end_id)
    # One short row for each run, that is about one for each partition of the input. While they are few they go to every
    # task and the ids needn't be shuffled; beyond, both sides are joined by shuffle.
    bases = offsets(tokens)
    few = tokens.select("file", "run").distinct().limit(BROADCAST_RUNS + 1).count() <= BROADCAST_RUNS
    placed = tokens.join(F.broadcast(bases) if few else bases, ["file", "run"]).withColumn("at", F.col("base") + F.col("start"))
    pieces = placed.withColumn("sequence_id", F.explode(F.expr(f"sequence(at div {window}, (at + n - 1) div {window})")))
    low = F.greatest(F.col("at"), F.col("sequence_id") * window)
    high = F.least(F.col("at") + F.col("n"), (F.col("sequence_id") + 1) * window)
    return pieces.select(
        "doc_id", (low - F.col("at")).alias("start"), (high - low).alias("length"), F.col("n").alias("doc_tokens"), "sequence_id",
        (low - F.col("sequence_id") * window).alias("offset"),
        F.expr("substring(ids, cast(4 * (greatest(at, sequence_id * {w}) - at) + 1 as int), "
               "cast(4 * (least(at + n, (sequence_id + 1) * {w}) - greatest(at, sequence_id * {w})) as int))".format(w=window)).alias("ids"),
    )


def packing_table(docs: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return packed(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
