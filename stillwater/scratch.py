"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting: shuffle files go as soon as the execution that wrote them has ended
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_here = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset in local mode (tests), a temporary one."""
    set_ = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_:
        return set_
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="stillwater-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/stillwater/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.
    ``by``: a column whose values get folders of their own, so that a filter on it reads these alone."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    scopes = getattr(_here, "scopes", [])
    if scopes:
        scopes[-1].paths.append(path)
    writer = df.write.option("compression", "zstd")
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


class Scope:
    """Deletes the tables materialized within it at its end, but for those that a kept DataFrame reads
    (these go to the scope around it, if there is one)."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.read = spark, [], set()

    def __enter__(self) -> Scope:
        _here.scopes = [*getattr(_here, "scopes", []), self]
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.read |= {part for f in df.inputFiles() for part in f.split("/")}
        return df

    def __exit__(self, *_) -> None:
        _here.scopes = _here.scopes[:-1]
        kept = [p for p in self.paths if p.rsplit("/", 1)[1] in self.read]
        for p in self.paths:
            if p not in kept:
                discard(p, self.spark)
        if _here.scopes:
            _here.scopes[-1].paths += kept


def discard(df_or_path: DataFrame | str, spark: SparkSession | None = None) -> None:
    """Delete a materialized table that nothing reads any more."""
    if isinstance(df_or_path, str):
        paths = [df_or_path]
    else:
        spark = df_or_path.sparkSession
        paths = sorted({f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()})
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
