"""The corpus pipeline: STAGES over ``documents``, each written as Parquet and read again by the next.

1. quality: documents that the classifier grades below good (toxic, or of low quality) go.
2. near_duplicates: one document of each group of near duplicates stays, the one of smallest doc_id.
3. decontamination: documents in which a benchmark item is found go.
4. source_mix: documents are repeated or left out so that sources meet their target weights.
5. token_files: token ids are written to files, and digests of what the files hold are returned.

Nulls: see the operators.  A row without doc_id has no near duplicates; rows that share a doc_id
stay together if one of them stays, and of those that share their text too one does, the first by its
other columns (as JSON).  Empty tables give empty results.  Other columns, also ones named as an
operator's outputs, go through all stages but the last unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stillwater.llm._bpe import tokenizer_path
from stillwater.llm._scratch import materialize, new_path
from stillwater.llm.decontaminate import clean_documents
from stillwater.llm.ngram_join import ngram_components
from stillwater.llm.quality import fit_quality, grades, score_quality
from stillwater.llm.source_mix import MIX, expand, mix_sources
from stillwater.llm.token_files import read_tokens, write_tokens
from stillwater.session import ship


def aside(docs: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns that have one of ``names`` under another name, and their own names by these."""
    own = {f"_own_{i}_{c}": c for i, c in enumerate(docs.columns) if c.lower() in set(names)}
    return docs.withColumnsRenamed({c: new for new, c in own.items()}), own


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with P(grade is good) of 0.5 or more."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet")
    docs, own = aside(docs, ("expected_grade", "p_at_least_1", "p_at_least_2"))
    scored = score_quality(docs, fit_quality(docs, grades(labels), 3), 3)
    return scored.where(F.coalesce(F.col("p_at_least_2") >= 0.5, F.lit(True))).select(*docs.columns).withColumnsRenamed(own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each component of near duplicates."""
    ship(spark)
    first = materialize(ngram_components(docs).where("component_id = doc_id").select(F.col("doc_id").alias("id")).distinct(), "first")
    others = F.to_json(F.struct(*(c for c in docs.columns if c not in ("doc_id", "text"))), {"ignoreNullFields": "false"})
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), others.alias("others"))
    kept = rows.join(first, "id", "left_semi")
    kept = kept.withColumn("nth", F.row_number().over(Window.partitionBy("id", "key").orderBy("others"))).where("nth = 1").select("row.*")
    return kept.union(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return clean_documents(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    ship(spark)
    docs, own = aside(docs, MIX)
    return expand(mix_sources(docs)).withColumnsRenamed(own)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, read back from the files."""
    path = new_path(ship(spark), "tokens")
    write_tokens(docs, path, tokenizer_path())
    return read_tokens(spark, path, digest=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_files", token_files),
]

#: SQL can't express the stages
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
