"""Exact token-length histogram with suffix sums.

Documents are aggregated by encoded length, first within each Arrow batch; everything a context
limit asks for then follows from suffix sums over the distinct lengths: totals, quantiles and
the tokens that remain when each document is cut at the limit.

Defined results: a null or empty text has length 0; an empty table gives an empty histogram;
repeated rows count each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stillwater.llm._bpe import encode_column
from stillwater.llm._scratch import materialize
from stillwater.session import ship

#: lengths in one window partition of the suffix sums
SPAN = 1024


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.concatenate([np.zeros(0, np.int64), *(n for _, n in encode_column(batch, "text", path))])
            lengths, docs = np.unique(n, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64()), pa.array(docs, pa.int64())], names=["n_tokens", "n_docs"])

    return run


def length_histogram(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """n_tokens, n_docs for every encoded length that occurs."""
    ship(docs.sparkSession)
    per_batch = docs.select(F.col(text_col).alias("text")).mapInArrow(_count(tokenizer), "n_tokens long, n_docs long")
    return per_batch.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Per occurring length L: n_docs, docs_at_least and tokens_at_least (of documents with L or more
    tokens), docs_up_to, quantile (share of documents up to L) and tokens_cut (all tokens left when every
    document is cut to its first L)."""
    h = histogram.select("n_tokens", "n_docs", F.floor(F.col("n_tokens") / SPAN).alias("_span"))
    spans = h.groupBy("_span").agg(F.sum("n_docs").alias("_d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("_t"))
    above, every = Window.orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # one row per SPAN lengths
    spans = spans.select("_span", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("_d", "_t")), *(F.sum(c).over(every).alias(f"{c}_all") for c in ("_d", "_t")))
    w = Window.partitionBy("_span").orderBy(F.desc("n_tokens"))
    out = h.join(spans, "_span").withColumns({"docs_at_least": (F.col("_d_above") + F.sum("n_docs").over(w)).cast("long"), "tokens_at_least": (F.col("_t_above") + F.sum(F.col("n_docs") * F.col("n_tokens")).over(w)).cast("long")})
    up_to = F.col("_d_all") - F.col("docs_at_least") + F.col("n_docs")
    return out.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", up_to.cast("long").alias("docs_up_to"), (up_to / F.col("_d_all")).alias("quantile"), (F.col("_t_all") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).cast("long").alias("tokens_cut"))


def token_counts(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """The histogram of ``docs`` with its suffix sums."""
    return suffix_sums(materialize(length_histogram(docs, tokenizer, text_col), "lengths"))


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the least length that at least a share ``q`` of the documents doesn't exceed."""
    return sums.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Per context limit: tokens left when every document is cut to it, and documents it cuts."""
    spark = sums.sparkSession
    all_ = sums.agg(F.max("tokens_at_least").alias("total"))
    above = F.col("n_tokens") > F.col("limit")
    per = spark.createDataFrame([(x,) for x in limits], "limit long").join(F.broadcast(all_))  # limits x 1 row
    longer = F.broadcast(per).join(sums, above, "left")
    return longer.groupBy("limit", "total").agg(F.max("docs_at_least").alias("d"), F.max("tokens_at_least").alias("t")).select("limit", (F.coalesce("total", F.lit(0)) - F.coalesce("t", F.lit(0)) + F.col("limit") * F.coalesce("d", F.lit(0))).alias("tokens_cut"), F.coalesce("d", F.lit(0)).alias("docs_cut"))
