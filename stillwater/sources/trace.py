"""Operation traces: schema, readers, sinks, and the adapter from the events table.

A trace is totally ordered by ``seq`` within ``manager_id``; each operation is atomic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from stillwater.functions.epochs import OPS

TRACE = StructType([
    StructField("manager_id", LongType()),
    StructField("seq", LongType()),
    StructField("thread_id", LongType()),
    StructField("op", StringType()),
    StructField("ptr", LongType()),
    StructField("deleter", StringType()),
])


def read_trace(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A stored trace (parquet, orc, json or csv), with its schema given, never inferred."""
    return spark.read.format(fmt).schema(TRACE).options(**options).load(path)


def stream_trace(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """The same as a stream of files."""
    return spark.readStream.format(fmt).schema(TRACE).options(**options).load(path)


def write_trace(ops: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    """Store a trace, partitioned by manager."""
    ops.select(*TRACE.names).write.format(fmt).mode(mode).partitionBy("manager_id").save(path)


def _refusal() -> Column:
    """Why a row is no operation; null where it is one."""
    missing = F.col("seq").isNull() | F.col("thread_id").isNull() | F.col("manager_id").isNull()
    known = F.coalesce(F.col("op").isin(*OPS), F.lit(False))
    return F.when(missing, "no manager, seq or thread").when(~known, "unknown operation").when(F.col("deleter") == "void", "typed delete of void")


def validate(ops: DataFrame) -> DataFrame:
    """Rows that are operations: known op, with manager, seq and thread; a typed delete of nothing (``void``) is refused."""
    return ops.where(_refusal().isNull())


def refused(ops: DataFrame) -> DataFrame:
    """The other rows, with the reason."""
    return ops.withColumn("reason", _refusal()).where("reason is not null")


def events_trace(events: DataFrame, threads: int = 16) -> DataFrame:
    """The trace that the events table stands for: one manager, ``threads`` threads."""
    kind, key = F.col("event_type"), F.col("event_id")
    op = (
        F.when(kind == "view", "enter")
        .when(kind == "click", "exit")
        .when(kind == "purchase", "retire")
        .when(kind == "error", F.when(key % 101 == 0, "collect").otherwise("exit"))
        .when(kind == "signup", F.when(key % 97 == 0, "thread_exit").otherwise("retire"))
    )
    rows = events.select(F.lit(0).cast("long").alias("manager_id"), key.alias("seq"), (F.col("user_id") % threads).alias("thread_id"), op.alias("op"))
    retire = F.col("op") == "retire"
    return validate(rows.select("*", F.when(retire, F.col("seq")).alias("ptr"), F.when(retire, F.when(F.col("seq") % 2 == 0, "free").otherwise("delete")).alias("deleter")))
