"""Counts that a run takes along while it reads and writes its rows, without passes of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Counts:
    """Named counts of rows, each taken where the rows pass; known once a job has read them to the end.

    A table that is read more than once would report the numbers of one reading: take counts of what is
    checkpointed or written. Reading them before any job has run waits for one.
    """

    def __init__(self) -> None:
        self.taken: list[Observation] = []

    def along(self, df: DataFrame, **numbers: Column) -> DataFrame:
        """The same rows, with aggregates to be taken from them."""
        seen = Observation()
        self.taken.append(seen)
        return df.observe(seen, *(F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in numbers.items()))

    def all(self) -> dict[str, int]:
        return {n: v for seen in self.taken for n, v in seen.get.items()}


def rows() -> Column:
    return F.count(F.lit(1))


def rows_where(condition: Column) -> Column:
    return F.count(F.when(condition, 1))
