"""Participants: a thread from its first operation, or from the one after a thread end, to its end.

A thread that ends without having done anything since it began (or ended) has no participant: such
an end is no operation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stillwater.functions.epochs import is_effective, pin_delta
from stillwater.operators.blocks import block_of

THREAD = ["manager_id", "thread_id"]
#: what a thread's end takes off the running sum: more than any depth
_RESET = 1 << 32


def with_depth(trace: DataFrame, width: int | None) -> DataFrame:
    """Effective operations with generation (earlier ends of the thread), participant ("thread:generation"),
    and the nesting depth before and after each (an exit at depth 0 leaves it there).

    Depth is S - least(0, smallest S so far), S the running sum of +1, -1, and of a fall below all
    at a thread's end; all of it is carried from block to block of a thread.  Reads ``trace`` twice, or once as
    one block.
    """
    kept = is_effective(F.col("op"), F.col("ptr"), F.col("deleter")) & F.col("manager_id").isNotNull() & F.col("thread_id").isNotNull() & F.col("seq").isNotNull()
    ends = F.col("op") == "thread_exit"
    rows = trace.where(kept).withColumn("_blk", block_of("seq", width))
    w = Window.partitionBy(*THREAD, "_blk").orderBy("seq")
    upto, earlier = (w.rowsBetween(Window.unboundedPreceding, k) for k in (0, -1))
    rows = rows.withColumns({"_d": F.when(ends, -_RESET).otherwise(pin_delta(F.col("op"))), "_prev": F.lag("op").over(w)})
    rows = rows.withColumns({"_s": F.sum("_d").over(upto), "_end": (ends & (F.col("_prev") != "thread_exit")).cast("long")})
    blocks = rows.groupBy(*THREAD, "_blk").agg(F.sum("_d").alias("_t"), F.min("_s").alias("_l"), F.sum("_end").alias("_ends"), F.min_by("op", "seq").alias("_first"), F.max_by("op", "seq").alias("_last"))
    along = Window.partitionBy(*THREAD).orderBy("_blk")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({"_s0": F.coalesce(F.sum("_t").over(before), F.lit(0)), "_last0": F.lag("_last").over(along)})
    # whether the block's first row ends a participant
    blocks = blocks.withColumns({"_l0": F.coalesce(F.min(F.col("_s0") + F.col("_l")).over(before), F.lit(0)), "_opens": ((F.col("_first") == "thread_exit") & F.coalesce(F.col("_last0") != "thread_exit", F.lit(False))).cast("long")})
    blocks = blocks.withColumn("_g0", F.coalesce(F.sum(F.coalesce("_ends", F.lit(0)) + F.col("_opens")).over(before), F.lit(0)))
    rows = rows.withColumns({"_low": F.min("_s").over(earlier), "_g": F.coalesce(F.sum("_end").over(earlier), F.lit(0))})
    if width is None:
        rows = rows.withColumns({c: F.lit(0).cast("long") for c in ("_s0", "_l0", "_g0", "_opens")} | {"_last0": F.lit(None).cast("string")})
    else:
        rows = rows.join(blocks.select(*THREAD, "_blk", "_s0", "_l0", "_g0", "_opens", "_last0"), [*THREAD, "_blk"])
    rows = rows.where(~ends | F.coalesce(F.coalesce("_prev", "_last0") != "thread_exit", F.lit(False)))
    generation = F.col("_g0") + F.col("_g") + F.when(F.col("_prev").isNotNull(), F.col("_opens")).otherwise(0)
    was = F.col("_s0") + F.col("_s") - F.col("_d") - F.least(F.lit(0), F.col("_l0"), F.col("_s0") + F.col("_low"))
    rows = rows.withColumns({"generation": generation.cast("long"), "before": was.cast("long")})
    depth = F.when(F.col("op") == "enter", F.col("before") + 1).when(F.col("op") == "exit", F.greatest(F.col("before") - 1, F.lit(0))).otherwise(F.col("before"))
    name = F.concat_ws(":", F.col("thread_id").cast("string"), F.col("generation").cast("string"))
    return rows.select(*trace.columns, "generation", name.alias("participant"), "before", depth.cast("long").alias("depth"))


def registry(ops: DataFrame) -> DataFrame:
    """One row per participant: when it registered, when it ended (null: never), and how many operations it has."""
    end = F.max(F.when(F.col("op") == "thread_exit", F.col("seq")))
    return ops.groupBy("manager_id", "thread_id", "generation", "participant").agg(F.min("seq").alias("registered_seq"), end.alias("unregistered_seq"), F.count(F.lit(1)).alias("n_ops"))
