"""Ordered operators that work block by block of the order column.

A window over a whole key puts the key into one task.  These put (key, block) into one task, and
carry from block to block only a row each: a hot key costs as many tasks as it has blocks.
A block is a range of the order column that holds about ``ROWS`` rows on average, however sparse
its values are.  Where all rows make one block (``width`` is None) nothing is carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from stillwater.scratch import materialize

#: rows of a block, on average
ROWS = 1 << 17
#: rows of the right side of an as-of join that are broadcast at most (some 20 to 50 bytes each)
LOOKUP = 1 << 19


def span(df: DataFrame, order: str) -> int | None:
    """Values of the order column per block; None where one block holds all rows."""
    low, high, n = df.agg(F.min(order), F.max(order), F.count(F.lit(1))).first()
    return None if n <= ROWS else max(1, -(-(high - low + 1) * ROWS // n))


def block_of(order: str, width: int | None) -> Column:
    return F.lit(0).cast("long") if width is None else F.floor(F.col(order) / width)


def running_sum(df: DataFrame, by: list[str], order: str, value: Column, name: str, width: int | None) -> DataFrame:
    """``df`` with the running sum of ``value`` along ``order`` within ``by``.  Reads ``df`` twice, or once as one block."""
    rows = df.withColumns({"_blk": block_of(order, width), "_v": value.cast("long")})
    inside = F.sum("_v").over(Window.partitionBy(*by, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if width is None:
        return rows.withColumn(name, inside).drop("_blk", "_v")
    before = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by, "_blk").agg(F.sum("_v").alias("_s")).withColumn("_s", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    return rows.join(sums, [*by, "_blk"]).withColumn(name, (inside + F.col("_s")).cast("long")).drop("_blk", "_v", "_s")


def running_max_before(df: DataFrame, by: list[str], order: str, value: str, name: str, width: int | None) -> DataFrame:
    """``df`` with the largest ``value`` of the rows before, along ``order`` within ``by``.  Reads ``df`` as ``running_sum`` does."""
    rows = df.withColumn("_blk", block_of(order, width))
    inside = F.max(value).over(Window.partitionBy(*by, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    if width is None:
        return rows.withColumn(name, inside).drop("_blk")
    before = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*by, "_blk").agg(F.max(value).alias("_m")).withColumn("_m", F.max("_m").over(before))
    return rows.join(blocks, [*by, "_blk"]).withColumn(name, F.greatest(inside, F.col("_m"))).drop("_blk", "_m")


def asof(left: DataFrame, right: DataFrame, by: list[str], order: str, right_order: str, value: str, name: str, width: int | None, forward: bool = False, strict: bool = False) -> DataFrame:
    """``left`` with ``value`` of the nearest row of ``right`` (same ``by``) at or before ``order``, or with
    ``forward`` at or after it; ``strict``: not at it.  Null where there is none.

    A right side of ``LOOKUP`` rows at most is broadcast, and the left side stays where it is; else ``left`` is
    stored, and both are dealt by key and block.
    """
    right = right.select(*by, F.col(right_order).alias("_at"), F.col(value).alias(name)).where(F.col("_at").isNotNull() & F.col(name).isNotNull())
    few = right.limit(LOOKUP + 1).toArrow()
    if few.num_rows <= LOOKUP:
        return _looked_up(left, right, few, by, order, name, forward, strict)
    return _by_blocks(materialize(left, "asof"), right, by, order, name, width, forward, strict)


def _looked_up(left, right, rows: pa.Table, by, order, name, forward, strict) -> DataFrame:
    keys = rows.select([*by, "_at"]).to_pandas().assign(_row=range(rows.num_rows)).sort_values("_at", kind="stable")
    values = rows[name].combine_chunks() if rows.num_rows else pa.array([], rows.schema.field(name).type)
    shared = left.sparkSession.sparkContext.broadcast((keys, values))
    direction = "forward" if forward else "backward"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = shared.value
        for batch in batches:
            table = pa.Table.from_batches([batch])
            own = table.select([*by, order]).to_pandas().assign(_nth=range(batch.num_rows)).dropna(subset=[order])
            own = own.astype({order: "int64"} | {c: keys[c].dtype for c in by}).sort_values(order, kind="stable")
            found = pd.merge_asof(own, keys, left_on=order, right_on="_at", by=by, direction=direction, allow_exact_matches=not strict)
            at = pd.Series(None, index=range(batch.num_rows), dtype="Int64")
            at.loc[found["_nth"].to_numpy()] = found["_row"].astype("Int64").to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, values.take(pa.array(at, pa.int64()))], names=[*batch.schema.names, name])

    return left.mapInArrow(run, StructType([*left.schema.fields, StructField(name, right.schema[name].dataType)]))


def _by_blocks(left, right, by, order, name, width, forward, strict) -> DataFrame:
    a = left.select(*by, F.col(order).alias("_o"), F.lit(1).alias("_left"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[name].dataType).alias("_val"))
    b = right.select(*by, F.col("_at").alias("_o"), F.lit(0).alias("_left"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(name).alias("_val"))
    rows = a.unionByName(b).withColumn("_blk", block_of("_o", width))
    # rows of the right come first where an equal order counts
    tie = F.col("_left") if not strict else -F.col("_left")
    along, block_along, best = ((F.desc("_o"), F.desc("_blk"), F.min_by) if forward else (F.asc("_o"), F.asc("_blk"), F.max_by))
    inside = Window.partitionBy(*by, "_blk").orderBy(along, tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy(block_along).rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*by, "_blk").agg(best("_val", F.when(F.col("_val").isNotNull(), F.col("_o"))).alias("_carry"))
    blocks = blocks.withColumn("_carry", F.last("_carry", ignorenulls=True).over(before))
    rows = rows.where("_o is not null").join(blocks, [*by, "_blk"])
    out = rows.withColumn("_found", F.coalesce(F.last("_val", ignorenulls=True).over(inside), F.col("_carry")))
    found = out.where("_left = 1").select("_row.*", F.col("_found").alias(name))
    return found.unionByName(left.where(F.col(order).isNull()).withColumn(name, F.lit(None).cast(right.schema[name].dataType)))
