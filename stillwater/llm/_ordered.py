"""Positions and offsets of rows in order, without one task for all rows or for one id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stillwater.llm._scratch import Scope, materialize
from stillwater.session import ship


def _local(length: int):
    """Rows of a range partition with its number, and the rows and lengths before each within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, total = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.column(length).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.cumsum(n) + total
            own = (np.full(len(n), part), np.arange(rows, rows + len(n)), upto - n)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in own)], names=[*batch.schema.names, "_part", "pos", "offset"])
            rows, total = rows + len(n), int(upto[-1]) if len(n) else total

    return run


def with_offsets(df: DataFrame, id_col: str, len_col: str, tie_col: str) -> DataFrame:
    """``df`` with ``pos`` (rows before) and ``offset`` (sum of ``len_col`` before), in ascending order of the
    id (null first), ties by ``tie_col``.

    Ranges of (id, tie) are dealt to tasks, so ids may be as sparse, or as often repeated, as they like; the
    totals of the tasks (a row each) then give where each begins.
    """
    with Scope(ship(df.sparkSession)) as tables:
        rows = materialize(df, "unordered")
        order = F.col(id_col).asc_nulls_first(), F.col(tie_col), F.monotonically_increasing_id()  # rows alike may go to several tasks
        ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order[:2])
        schema = StructType([*df.schema.fields, *(StructField(c, LongType()) for c in ("_part", "pos", "offset"))])
        local = materialize(ranged.mapInArrow(_local(df.columns.index(len_col)), schema), "ordered")
        parts = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), F.sum(len_col).alias("_len"))
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
        parts = parts.select("_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_rows", "_len")))
        out = local.join(F.broadcast(parts), "_part")
        return tables.keep(out.select(*df.columns, (F.col("pos") + F.col("_rows")).cast("long").alias("pos"), (F.col("offset") + F.col("_len")).cast("long").alias("offset")))
