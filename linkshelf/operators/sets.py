"""Union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from linkshelf.session import configure


def union_all(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, columns matched by name.

    Spark 4.1 lets a union of equally partitioned inputs claim their partitioning and then
    skips the shuffle of a following aggregate. Adaptive execution may read the inputs with
    different partition boundaries, and the aggregate then emits a key more than once. The
    setting is switched off for every session that unions through here.
    """
    configure(parts[0].sparkSession)
    return reduce(lambda a, b: a.unionByName(b), parts)
