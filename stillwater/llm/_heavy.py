"""Values that very many documents share, found without shuffling all values.

A task counts the values that it holds and reports those seen more than once; sums of the reports
give a list that is bounded whatever the size of the corpus.  What isn't on the list is merely
dealt by hash like any other value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stillwater.llm._scratch import materialize

#: values held by a task before it counts them; it reports those that it holds twice or more
WINDOW = 5_000_000
#: values that are broadcast at most (8 bytes and a count each)
MOST = 1 << 19


class Counter:
    """Counts values of a task; ``flush`` gives the reports so far."""

    def __init__(self):
        self.held, self.size = np.empty(WINDOW, np.uint64), 0

    def add(self, values: np.ndarray) -> bool:
        size = self.size + len(values)
        if size > len(self.held):
            self.held = np.concatenate([self.held[: self.size], np.empty(size + WINDOW // 4 - self.size, np.uint64)])
        self.held[self.size : size] = values
        self.size = size
        return size >= WINDOW

    def flush(self) -> tuple[pa.Array, pa.Array]:
        """Values (as signed 64-bit) and counts."""
        values = self.held[: self.size]
        values.sort()  # in place: a second copy of so many would be most of a worker's memory
        again = np.zeros(len(values) + 1, dtype=bool)  # the value before is the same
        np.equal(values[1:], values[:-1], out=again[1:-1])
        first, last = np.flatnonzero(again[1:] & ~again[:-1]), np.flatnonzero(again[:-1] & ~again[1:])
        tokens, df = values[first], last - first + 1
        self.size = 0
        return pa.array(tokens.view(np.int64)), pa.array(df)


def heavy_list(reports: DataFrame, least: int):
    """A broadcast (values, counts), sorted by value: those of ``reports`` (token, df) with sums over ``least``,
    the ``MOST`` most frequent ones at most (all with the same sum, or none of them)."""
    often = materialize(reports.groupBy("token").agg(F.sum("df").alias("df")).where(F.col("df") > least), "often")
    per_df = Window.orderBy(F.desc("df")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per count
    from_ = often.groupBy("df").count().withColumn("upto", F.sum("count").over(per_df)).where(F.col("upto") <= MOST).agg(F.min("df")).first()[0]
    found = often.where(F.col("df") >= F.lit(from_).cast("long")).toArrow()
    values, df = found["token"].to_numpy().view(np.uint64), found["df"].to_numpy()
    order = np.argsort(values)
    return reports.sparkSession.sparkContext.broadcast((values[order], df[order]))


def contained(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(sorted_):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return sorted_[at] == values
