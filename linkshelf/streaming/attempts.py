"""Attempts and latest status of each URL as keyed state: a micro-batch touches the URLs it has rows of, no others.

The state lives in Spark's RocksDB state store, one value a URL. A stream can start from the state a log already gives
(``initial``), its output is the changed URLs of every micro-batch, and a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from linkshelf.session import importable

VALUE = "seq bigint, status string, attempts bigint"
CHANGED = f"url string, {VALUE}"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Tally:
    """The attempts along a log whose rows come in any order: those of the last success, and the failures after it.

    Keeps the numbers of failures only while no later success is known.
    """

    def __init__(self):
        self.last, self.status, self.success, self.passes, self.failures = None, None, None, 0, []

    def add(self, rows: pd.DataFrame) -> None:
        seq = rows["seq"].to_numpy()
        at = int(seq.argmax())
        if self.last is None or seq[at] > self.last:
            self.last, self.status = int(seq[at]), rows["status"].iloc[at]
        won = np.flatnonzero(rows["is_success"].to_numpy(bool))
        if len(won):
            best = int(won[seq[won].argmax()])
            if self.success is None or seq[best] > self.success:
                self.success, self.passes = int(seq[best]), int(rows["passes"].iloc[best] or 0)
        lost = seq[rows["is_failure"].to_numpy(bool)]
        self.failures = [f[f > self.success] if self.success is not None else f for f in (*self.failures, lost)]

    def attempts(self, before: int) -> int:
        return (before if self.success is None else self.passes) + sum(map(len, self.failures))


class AttemptState(StatefulProcessor):
    """One value a URL: number and status of its last row, attempts so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("attempts", VALUE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.state.update((int(row["seq"]), row["status"], int(row["attempts"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tally = Tally()
        for part in rows:
            if len(part):
                tally.add(part)
        if tally.last is not None:
            before = self.state.get() if self.state.exists() else None
            seq, status = tally.last, tally.status
            attempts = tally.attempts(int(before[2]) if before else 0)
            if before and before[0] > seq:  # rows that come late count, but are not the latest
                seq, status = before[0], before[1]
            self.state.update((seq, status, attempts))
            yield pd.DataFrame({"url": [key[0]], "seq": [seq], "status": [status], "attempts": [attempts]})

    def close(self) -> None:
        pass


def attempt_changes(log: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """Streaming ``(url, seq, status, attempts)`` of the URLs each micro-batch of ``log`` changes.

    ``log`` has ``url, seq, status, passes, is_success, is_failure``; batches follow each other in ``seq``. ``initial`` is
    a table of the same columns as the output, one row a URL, and is read when the stream starts for the first time.
    """
    importable(log.sparkSession).conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = log.select("url", "seq", "status", "passes", F.coalesce("is_success", F.lit(False)).alias("is_success"), F.coalesce("is_failure", F.lit(False)).alias("is_failure"))
    return rows.filter("url is not null and seq is not null").groupBy("url").transformWithStateInPandas(
        statefulProcessor=AttemptState(), outputStructType=CHANGED, outputMode="Update", timeMode="None",
        initialState=initial.select("url", "seq", "status", "attempts").groupBy("url") if initial is not None else None)
