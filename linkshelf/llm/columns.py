"""Column helpers the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(text: str = "text") -> Column:
    """The text column with null read as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows kept out of every fit: crc32 of the id as text leaves remainder 2 by 4. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def dealt_apart(*keys: str) -> Column:
    """A further join key beside ``keys``. A side that was just summed by the keys is dealt again with it, and so a join may
    split a hot key of the other side; else Spark would leave that key in the task that summed it."""
    return F.xxhash64(*keys, F.lit("apart"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened until no column of ``df`` has one of them."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found

