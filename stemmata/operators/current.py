"""Current rows of a table whose records are delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemmata.scratch import Scratch


def latest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The row of each key with the greatest ``by`` columns (compared in turn).

    A rank filter over a window, so the group limit prunes before the shuffle as well as after it.
    Nulls in ``by`` count as smallest; null keys form one group like any other value. A tie in all of ``by`` keeps
    one row. An empty table gives an empty table.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in by])
    rank = "__latest_rank"
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) == 1).drop(rank)


def latest_wide(df: DataFrame, keys: list[str], by: list[str], row: str) -> DataFrame:
    """``latest`` for rows with wide columns: only the narrow ones are shuffled, and the superseded rows are taken away by their unique column ``row``.

    ``row`` must not be null. The superseded rows are few where deliveries rarely repeat; they are written, so that their size is known and they are broadcast only if small.
    """
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in by])
    rank = "__latest_rank"
    narrow = df.select(*dict.fromkeys([*keys, *by, row])).withColumn(rank, F.row_number().over(w))
    stale = Scratch(df.sparkSession, "stale").put(narrow.filter(F.col(rank) > 1).select(row))
    return df.join(stale, row, "left_anti")
