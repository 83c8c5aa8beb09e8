"""Exact top-k inner-product search by columnar branch and bound.

Candidates lie in vertical layout, one row per dimension.  Distances are accumulated block by
block of dimensions; after each block the Cauchy-Schwarz bound of the mass that remains tells
which pairs can still reach a query's k-th best score, and only those go on, compacted.
Components are scaled to integers, so scores are exact.

Queries come in blocks of a fixed number of components, each broadcast in turn and compared in
chunks; a task returns its k best per query, and these are merged.  Each block scans the candidates once.

Defined results: a vector that is null, without id, or with null or non-finite components takes
no part, neither as query nor as candidate; vectors are compared with those of their own length
only; a row with the query's own id is never its candidate; repeated candidate rows count each,
repeated query ids once (one of their vectors, the smallest); scores beyond 64 bits saturate;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stillwater.llm._scratch import Scope, materialize
from stillwater.session import ship

#: components of queries broadcast at once (8 bytes each), and compared at once
QUERY_CELLS, CHUNK_CELLS = 1 << 22, 1 << 18
#: dimensions per block, and candidates in a vertical tile
DIMS, TILE = 8, 2048
_FLOAT_EXACT = float(1 << 52)


def _vectors(batch_ids: pa.Array, lists: pa.Array, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: ids, and the scaled components (rows: vectors) as whole floats, or as Python integers if large."""
    lists = lists.cast(pa.large_list(pa.float64()))
    valid = (lists.is_valid().to_numpy(zero_copy_only=False)) & (batch_ids.is_valid().to_numpy(zero_copy_only=False))
    off = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(off)
    ids = batch_ids.fill_null(0).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(sizes[valid]).tolist():
        rows = np.flatnonzero(valid & (sizes == n))
        block = values[(off[:-1][rows][:, None] + np.arange(n)[None, :])] if n else np.zeros((len(rows), 0))
        good = np.isfinite(block).all(axis=1)
        rows, block = rows[good], block[good]
        if len(rows):
            with np.errstate(over="ignore"):
                scaled = np.floor(block * float(scale))
            if n and not np.isfinite(scaled).all():
                scaled = np.array([[int(x) * scale if abs(x) > 1e300 else int(np.floor(x * scale)) for x in r] for r in block.tolist()], dtype=object)
            out[n] = ids[rows], scaled
    return out


class _Best:
    """The k best candidates so far of each query of one length."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, k: int):
        self.k, self.ids = k, ids
        large = rows.dtype == object or (rows.size and float(np.abs(rows).max()) > 2**40)
        self.exact = large
        self.raw = rows
        if not large:
            self.order = np.argsort(-(rows**2).sum(axis=0), kind="stable")  # dimensions of most mass first
            self.rows = np.ascontiguousarray(rows[:, self.order])
            edges = list(range(0, rows.shape[1], DIMS))
            self.edges = edges
            squares = np.cumsum((self.rows**2)[:, ::-1], axis=1)[:, ::-1]
            self.mass = np.sqrt(np.concatenate([squares, np.zeros((len(ids), 1))], axis=1))
        self.top_score = np.full((len(ids), k), -np.inf)
        self.got = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        for lo in range(0, len(ids), TILE):
            self._tile(ids[lo : lo + TILE], rows[lo : lo + TILE])

    def _tile(self, ids: np.ndarray, rows: np.ndarray) -> None:
        if self.exact or rows.dtype == object or (rows.size and float(np.abs(rows).max()) * float(np.abs(self.raw).max() or 1) * rows.shape[1] > _FLOAT_EXACT):
            own, other = [[int(x) for x in r] for r in self.raw.tolist()], [[int(x) for x in r] for r in rows.tolist()]
            low, high = -(1 << 63), (1 << 63) - 1
            scores = np.array([[min(high, max(low, sum(x * y for x, y in zip(a, b, strict=True)))) for b in other] for a in own], dtype=np.int64)
            q, c = (x.ravel() for x in np.indices(scores.shape))
            self._merge(q, ids[c], scores.ravel())
            return
        tall = np.ascontiguousarray(rows.T[self.order])  # vertical: a row per dimension
        squares = np.cumsum((tall**2)[::-1], axis=0)[::-1]
        mass = np.sqrt(np.concatenate([squares, np.zeros((1, len(ids)))], axis=0))
        floor = self.top_score.min(axis=1)
        dense, q, c, part = True, None, None, np.zeros((len(self.ids), len(ids)))
        for lo in self.edges:
            hi = min(lo + DIMS, tall.shape[0])
            if dense:
                part += self.rows[:, lo:hi] @ tall[lo:hi]
                alive = part + (self.mass[:, hi, None] * mass[hi][None, :]) * (1 + 1e-9) + 1e-6 >= floor[:, None]
                if hi == tall.shape[0] or alive.mean() < 0.2:
                    q, c = np.nonzero(alive)
                    part, dense = part[q, c], False
            else:
                part = part + np.einsum("ij,ji->i", self.rows[q, lo:hi], tall[lo:hi, c])
                alive = part + self.mass[q, hi] * mass[hi, c] * (1 + 1e-9) + 1e-6 >= floor[q]
                q, c, part = q[alive], c[alive], part[alive]
        if dense:
            q, c = (x.ravel() for x in np.indices(part.shape))
            part = part.ravel()
        self._merge(q, ids[c], np.rint(part).astype(np.int64))

    def _merge(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        other = ids != self.ids[q]
        q, ids, score = (np.concatenate([x, y[other]]) for x, y in zip(self.got, (q, ids, score), strict=True))
        o = np.lexsort((ids, -score.astype(object) if len(score) and score.min() == -(1 << 63) else -score, q))
        q, ids, score = q[o], ids[o], score[o]
        first = np.searchsorted(q, np.arange(len(self.ids)))
        rank = np.arange(len(q)) - first[q]
        keep = rank < self.k
        self.got = q[keep], ids[keep], score[keep]
        self.top_score = np.full((len(self.ids), self.k), -np.inf)
        self.top_score[self.got[0], rank[keep]] = self.got[2]


def _search(block, k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {}
        for n, (ids, rows) in block.value.items():
            m = max(1, CHUNK_CELLS // max(n, 1))
            best[n] = [_Best(ids[i : i + m], rows[i : i + m], k) for i in range(0, len(ids), m)]
        for batch in batches:
            for n, (ids, rows) in _vectors(batch.column(0), batch.column(1), scale).items():
                for b in best.get(n, ()):
                    b.add(ids, rows)
        for b in (b for chunks in best.values() for b in chunks):
            q, ids, score = b.got
            yield pa.RecordBatch.from_arrays([pa.array(b.ids[q], pa.int64()), pa.array(ids, pa.int64()), pa.array(score, pa.int64())], names=["query_id", "vec_id", "score"])

    return run


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of floor(scale x component) vectors for
    each row of ``queries`` against all of ``vectors`` but itself, ties to the smaller id."""
    spark = ship(vectors.sparkSession)
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    wanted, rows = pick(queries), pick(vectors)
    n, longest = wanted.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    blocks = max(1, -(-n * max(longest or 1, 1) // QUERY_CELLS))
    with Scope(spark):
        by_block = wanted.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
        by_block = materialize(by_block.repartition("block"), "queries", by="block") if blocks > 1 else by_block
        found = None
        for b in range(blocks):
            part = by_block.where(F.col("block") == b).select("vec_id", "v").toArrow()
            part = {m: _distinct(ids, v) for m, (ids, v) in _vectors(part["vec_id"].combine_chunks(), part["v"].combine_chunks(), scale).items()} if part.num_rows else {}
            own = rows.mapInArrow(_search(spark.sparkContext.broadcast(part), k, scale), "query_id long, vec_id long, score long")
            found = own if found is None else found.union(own)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _distinct(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    o = sorted(range(len(ids)), key=lambda i: (int(ids[i]), rows[i].tolist()))
    o = [i for j, i in enumerate(o) if j == 0 or ids[i] != ids[o[j - 1]]]
    return ids[o], rows[o]
