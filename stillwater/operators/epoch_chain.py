"""When the global epoch advances, and what holds it.

An attempt advances the epoch unless a pin opened before the last advance is still open, and then
the oldest open pin is one.  Oldest pins follow one another, so the attempts are looked up in
their disjoint ranges; only the first attempt under each oldest pin can advance at all, and these
few rows are folded in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.functions.epochs import FIRST_EPOCH, RULES, Rules, bucket_index, safe_epoch
from stillwater.operators.blocks import asof, running_max_before, running_sum

_NEVER = (1 << 63) - 1


def oldest_pins(pins: DataFrame, width: int | None) -> DataFrame:
    """manager_id, participant, open_seq, from_seq, until_seq: the ranges in which each pin is the oldest open one."""
    rows = pins.withColumn("until_seq", F.coalesce("close_seq", F.lit(_NEVER)))
    rows = running_max_before(rows, ["manager_id"], "open_seq", "until_seq", "_held", width)
    rows = rows.withColumn("from_seq", F.greatest("open_seq", F.coalesce("_held", F.col("open_seq"))))
    return rows.where("until_seq > from_seq").select("manager_id", "participant", "open_seq", "from_seq", "until_seq")


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (manager_id, seq, open_seq) in order; gives those that advance.  Holds one number."""
    manager, last = object(), None
    for batch in batches:
        keep = []
        for i, (m, seq, opened) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            if m != manager:
                manager, last = m, None
            if last is None or last < opened:
                keep.append(i)
                last = seq
        rows = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows)], names=["manager_id", "seq"])


def held(tries: DataFrame, pins: DataFrame, width: int | None) -> DataFrame:
    """``tries`` with the oldest open pin (pin_open, pin_holder; null: none is open)."""
    ranges = oldest_pins(pins, width).withColumn("pin", F.struct("open_seq", "until_seq", F.col("participant").alias("holder")))
    rows = asof(tries, ranges, ["manager_id"], "seq", "from_seq", "pin", "pin", width)
    open_ = F.col("pin.until_seq") > F.col("seq")
    return rows.withColumns({"pin_open": F.when(open_, F.col("pin.open_seq")), "pin_holder": F.when(open_, F.col("pin.holder"))}).drop("pin")


def with_epochs(rows: DataFrame, width: int | None, rules: Rules = RULES) -> DataFrame:
    """Attempts of ``held`` with advanced, epoch_after, and the epoch and bucket they free (null: none yet)."""
    firsts = rows.where("pin_open is not null").groupBy("manager_id", "pin_open").agg(F.min("seq").alias("seq")).select("manager_id", "seq", "pin_open")
    ahead = firsts.repartition("manager_id").sortWithinPartitions("manager_id", "seq").mapInArrow(_fold, "manager_id long, seq long")
    rows = rows.join(ahead.withColumn("_ahead", F.lit(True)), ["manager_id", "seq"], "left")
    rows = rows.withColumn("advanced", F.col("pin_open").isNull() | F.coalesce("_ahead", F.lit(False))).drop("_ahead")
    rows = running_sum(rows, ["manager_id"], "seq", F.col("advanced").cast("long"), "epoch_after", width)
    rows = rows.withColumn("epoch_after", F.col("epoch_after") + FIRST_EPOCH)
    return rows.withColumn("safe_epoch", safe_epoch(F.col("epoch_after"))).withColumn("bucket", bucket_index(F.col("safe_epoch"), rules))


def epoch_timeline(epochs: DataFrame) -> DataFrame:
    """manager_id, epoch, from_seq of every epoch after the first."""
    return epochs.where("advanced").select("manager_id", F.col("epoch_after").alias("epoch"), F.col("seq").alias("from_seq"))


def current_epoch(at: DataFrame, timeline: DataFrame, order: str, name: str, width: int | None, strict: bool = False) -> DataFrame:
    """``at`` with the epoch at (``strict``: just before) each value of ``order``."""
    rows = asof(at, timeline, ["manager_id"], order, "from_seq", "epoch", name, width, strict=strict)
    return rows.withColumn(name, F.coalesce(F.col(name), F.lit(FIRST_EPOCH)).cast("long"))
