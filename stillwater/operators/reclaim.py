"""Stamping of retired objects, and where each is freed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.functions.epochs import GRACE, RULES, Rules, bucket_index
from stillwater.operators.blocks import asof, running_sum
from stillwater.operators.epoch_chain import current_epoch


def stamped(nodes: DataFrame, timeline: DataFrame, width: int | None, rules: Rules = RULES) -> DataFrame:
    """Retired objects with retire_epoch (advances of their own operation come after) and bucket."""
    rows = current_epoch(nodes, timeline, "seq", "retire_epoch", width, strict=True)
    return rows.withColumn("bucket", bucket_index(F.col("retire_epoch"), rules))


def fates(marked: DataFrame, epochs: DataFrame, timeline: DataFrame, width: int | None) -> DataFrame:
    """Every retired object with reclaim_seq, reclaim_epoch and lag (null: not freed by an attempt) and its
    fate: reclaimed, shutdown (freed when the manager ends) or leaked_local (never handed over).

    An object of epoch e is freed by the first attempt, once it is handed over and epoch e + 2 has begun,
    that looks at its bucket.
    """
    begin = timeline.select("manager_id", (F.col("epoch") - GRACE).alias("retire_epoch"), F.col("from_seq").alias("_begin"))
    rows = marked.join(begin, ["manager_id", "retire_epoch"], "left")
    ripe = F.when(F.col("_begin").isNotNull() & F.col("flush_seq").isNotNull(), F.greatest("_begin", "flush_seq"))
    rows = rows.withColumn("_ripe", ripe).drop("_begin")
    looks = epochs.where("bucket is not null").select("manager_id", "bucket", "seq", F.struct(F.col("seq").alias("s"), F.col("epoch_after").alias("e")).alias("look"))
    rows = asof(rows, looks, ["manager_id", "bucket"], "_ripe", "seq", "look", "look", width, forward=True)
    fate = F.when(F.col("look").isNotNull(), "reclaimed").when(F.col("flush_seq").isNotNull(), "shutdown").otherwise("leaked_local")
    return rows.select("manager_id", "participant", "seq", "ptr", "deleter", "flush_seq", "retire_epoch", "bucket", F.col("look.s").alias("reclaim_seq"), F.col("look.e").alias("reclaim_epoch"), (F.col("look.e") - F.col("retire_epoch")).alias("lag"), fate.alias("fate"))


def backlog(nodes: DataFrame, epochs: DataFrame, width: int | None) -> DataFrame:
    """Objects retired and not yet freed after each attempt."""
    moves = nodes.select("manager_id", F.col("seq"), F.lit(1).alias("n")).unionByName(nodes.where("reclaim_seq is not null").select("manager_id", F.col("reclaim_seq").alias("seq"), F.lit(-1).alias("n")))
    moves = moves.unionByName(epochs.select("manager_id", "seq", F.lit(0).alias("n"))).groupBy("manager_id", "seq").agg(F.sum("n").alias("n"))
    after = running_sum(moves, ["manager_id"], "seq", F.col("n"), "outstanding", width)
    return epochs.select("manager_id", "seq", "epoch_after").join(after.select("manager_id", "seq", "outstanding"), ["manager_id", "seq"])
