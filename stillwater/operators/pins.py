"""Reader pins: pinned intervals, unbalanced exits, and what else is odd about the use of a manager."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.functions.epochs import is_effective
from stillwater.operators.blocks import asof

KEY = ["manager_id", "participant"]


def pin_intervals(deep: DataFrame, width: int | None) -> DataFrame:
    """manager_id, participant, open_seq, close_seq (null: still pinned at the end): outermost pins.

    Nested entries keep the pin; a thread end closes it at its own seq.
    """
    opens = deep.where("op = 'enter' and before = 0").select(*KEY, F.col("seq").alias("open_seq"))
    closes = deep.where("before > 0 and (op = 'thread_exit' or op = 'exit' and depth = 0)").select(*KEY, "seq")
    return asof(opens, closes, KEY, "open_seq", "seq", "seq", "close_seq", width, forward=True, strict=True)


def unbalanced_exits(deep: DataFrame) -> DataFrame:
    """Exits without a pin."""
    return deep.where("op = 'exit' and before = 0").select(*KEY, "thread_id", "seq")


def hazards(trace: DataFrame, deep: DataFrame) -> DataFrame:
    """manager_id, thread_id, seq, hazard: uses that do less than they seem to.

    leaked_retire: a retire without object or deleter, which nothing frees; unbalanced_exit: an exit
    without a pin; pinned_thread_exit: a thread that ends within a pin; pinned_collect: a collect
    within the caller's own pin, which can hold what it tries to advance.
    """
    lost = trace.where(~is_effective(F.col("op"), F.col("ptr"), F.col("deleter"))).select("manager_id", "thread_id", "seq", F.lit("leaked_retire").alias("hazard"))
    kind = F.when((F.col("op") == "exit") & (F.col("before") == 0), "unbalanced_exit").when((F.col("op") == "thread_exit") & (F.col("before") > 0), "pinned_thread_exit").when((F.col("op") == "collect") & (F.col("before") > 0), "pinned_collect")
    return lost.unionByName(deep.select("manager_id", "thread_id", "seq", kind.alias("hazard")).where("hazard is not null"))
