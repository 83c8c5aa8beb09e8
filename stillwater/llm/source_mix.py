"""Mixing sources to target weights by subset-sum budget fitting.

Sizes are counted natively; per source a histogram of exact sizes decides how many documents of
each size get one copy more than the others: a proportional share first, then the largest sizes
that still fit, then a bounded-knapsack dynamic programme over the budget that is left.  Which
documents these are follows from a seeded hash of id and text, so reruns agree (of rows alike in
id, text and source any may be the one).

Defined results: a null or empty text has size 0; a null source is a source of its own, ordered
last; documents of size 0 get the base copies of their source (they take nothing); an empty
table gives an empty result; repeated rows take part one by one; other columns
are kept, but for ones named as those of ``MIX``, which are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stillwater.llm._scratch import Scope, materialize
from stillwater.session import ship

WORDS = r"[^\x20\x09-\x0D]+"
#: words that the dynamic programme spans at least; for longer documents four of the longest, as far as BITS allow
KNAPSACK, BITS = 1 << 14, 1 << 28
#: parts of a group of equally long documents of one source
SPLIT = 256
MIX = ("mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken")


def water_fill(sizes: np.ndarray, weights: np.ndarray, total: float, cap: float) -> np.ndarray:
    """Shares of ``total`` by weight, none above cap x size; what is over is shared anew by weight."""
    top, out = cap * sizes.astype(float), np.zeros(len(sizes))
    free, left = np.ones(len(sizes), dtype=bool), float(total)
    while free.any() and weights[free].sum() > 0:
        share = left * weights / weights[free].sum()
        over = free & (share > top)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = top[over]
        left -= float(top[over].sum())
        free &= ~over
    return out


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many documents of each size to take so that their words come as near ``budget`` as possible."""
    total = float((sizes * counts).sum())
    take = np.zeros(len(sizes), dtype=np.int64)
    if total <= 0 or budget <= 0:
        return take
    steps_most = max(1, int(np.ceil(np.log2(counts + 1)).sum()))
    span = max(KNAPSACK, min(4 * int(sizes.max()), BITS // steps_most))
    ok, part = sizes > 0, max(0.0, budget - span / 2) / total  # leaves the dynamic programme room to choose
    take[ok] = np.minimum(counts[ok], np.floor(counts[ok] * min(1.0, part)).astype(np.int64))
    left = budget - float((sizes * take).sum())
    for i in np.argsort(-sizes, kind="stable"):
        if left <= span:
            break
        if sizes[i] > 0 and sizes[i] <= left:
            n = int(min(counts[i] - take[i], (left - span) // sizes[i] + 1, left // sizes[i]))
            take[i] += n
            left -= n * float(sizes[i])
    # bounded knapsack: bit b of reach says that b words can be had; counts are split into powers of two
    room = int(min(left, span)) + span // 4  # a little too much may be nearer
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for i in np.flatnonzero((sizes > 0) & (sizes <= room) & (counts > take)):
        n, k = int(min(counts[i] - take[i], room // sizes[i])), 1
        while n > 0:
            k_ = min(k, n)
            steps.append((int(i), k_, reach))
            reach |= (reach << (k_ * int(sizes[i]))) & mask
            n, k = n - k_, k * 2
        if reach >> round(min(left, room)) & 1:
            break
    below = (reach & ((1 << (int(min(left, room)) + 1)) - 1)).bit_length() - 1
    above = reach >> (below + 1)
    above = below + (above & -above).bit_length() if above else below
    at = above if abs(above - left) < abs(below - left) else below
    # documents that don't fit into the span: one of them, with or without the others, may still be nearer
    over = np.flatnonzero((sizes > room) & (counts > take))
    options = [(abs(left - at), 0, at, None)]
    for n, words in enumerate((at, below, 0)):
        if len(over):
            i = int(over[np.argmin(np.abs(left - words - sizes[over]))])
            options.append((abs(left - words - float(sizes[i])), n + 1, words, i))
    _, _, at, one = min(options, key=lambda o: o[:2])
    if one is not None:
        take[one] += 1
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            at -= k * int(sizes[i])
            take[i] += k
    return take


def _targets(weights: tuple[float, ...], share: float, cap: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(_k=[(s is None, b"" if s is None else s.encode()) for s in rows["source"].where(rows["source"].notna(), None)]).sort_values("_k").drop(columns="_k")
        w = np.array([weights[i % len(weights)] for i in range(len(rows))], dtype=float)
        return rows.astype({"source": object}).assign(target=water_fill(rows["source_size"].to_numpy(), w, share * rows["source_size"].sum(), cap))

    return run


def _plan(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size").reset_index(drop=True)
    total, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    base = int(target // total) if total else 0
    extra = fit_budget(rows["size"].to_numpy(), rows["n"].to_numpy(), target - base * total)
    return rows.assign(base=base, extra=extra)[["source", "size", "source_size", "target", "base", "extra"]].astype({"source": object})


def _keyed(rows: DataFrame) -> DataFrame:
    """With src and none, the source as keys without nulls."""
    return rows.withColumns({"src": F.coalesce("source", F.lit("")), "none": F.col("source").isNull()})


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, most: int = 3, seed: int = 17, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """All rows and columns of ``docs`` with mix_size, mix_source_size, mix_target, mix_copies and mix_taken.

    Sources in code-point order weigh ``weights``, repeating; together they get ``share`` of all words, each
    at most ``most`` times its own; no document is taken more than ``most`` times.
    """
    ship(docs.sparkSession)
    with Scope(docs.sparkSession) as tables:
        own = [c for c in docs.columns if c.lower() not in MIX]
        rows = docs.select(F.struct(*own).alias("row"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("t"))
        rows = rows.withColumn("part", F.pmod(F.col("h"), F.lit(SPLIT)))
        counts = materialize(rows.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n")), "sizes")
        by_size = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
        totals = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
        # one row per source
        targets = materialize(totals.groupBy().applyInPandas(_targets(tuple(weights), share, most), "source string, source_size long, target double"), "targets")
        known = by_size.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        # one row per size of a source
        plan = known.groupBy("source").applyInPandas(_plan, "source string, size long, source_size long, target double, base long, extra long")
        plan = _keyed(plan.select("source", "size", "source_size", "target", "base", "extra")).drop("source")
        before = Window.partitionBy("src", "none", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = _keyed(counts).drop("source").join(plan, ["src", "none", "size"]).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        need = F.least(F.greatest(F.col("extra") - F.col("before"), F.lit(0)), F.col("n"))
        parts = materialize(parts.select("src", "none", "size", "part", "source_size", "target", "base", need.alias("need")), "plan")
        # rows are dealt once, for the join and the window; a row per size of a source and part isn't broadcast
        rows = _keyed(rows).join(parts.hint("merge"), ["src", "none", "size", "part"])
        order = Window.partitionBy("src", "none", "size", "part").orderBy("h", "id", "t")
        copies = F.col("base") + (F.row_number().over(order) <= F.col("need")).cast("long")
        return tables.keep(rows.withColumn("copies", copies).select("row.*", F.col("size").alias("mix_size"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("copies").alias("mix_copies"), (F.col("copies") * F.col("size")).alias("mix_taken")))


def expand(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken, without the mix_ columns."""
    own = [c for c in mixed.columns if c.lower() not in MIX]
    return mixed.where(F.col("mix_copies") > 0).select(F.struct(*own).alias("row"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies"))).alias("copy")).select("row.*")
