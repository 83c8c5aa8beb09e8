"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One score per document, the sum of weights of its hashed text features, is shared by all grades;
ordered thresholds cut it: P(grade >= k) = sigmoid(score - threshold_k).  So a document gets its
expected grade and the tail probability of each grade.

Features of a text: the letters and digits of each of its words in lower case, the first five
bytes of each, and the share of each shape of word (its last two bytes, the case of its start, or
that it repeats the word before).  Each distinct one of the whole text counts once.  Training is proximal
AdaGrad in numpy on a bounded sample of rated documents (``SAMPLE`` expected, ``SAMPLE_MOST`` at
most); an L1 penalty leaves words that say nothing without weight, so long documents gather no
noise.

Defined results: a null text, or one without words, has score 0; ratings that are null are left
out, of several ratings of a document the lowest counts; without ratings every document is kept
(grade and tails null); repeated rows get equal results; an empty table gives an empty result;
other columns are kept, but for ones named as the outputs, which are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from stillwater.llm._text import SMALL_SLICE, Words, _LOWER, _TABLE, _pow, column, mix, slices
from stillwater.session import ship

#: rated documents to train on: expected number, and the most
SAMPLE, SAMPLE_MOST = 6000, 10_000
BITS, EPOCHS, BATCH, RATE, L1 = 18, 12, 64, 0.1, 2e-3
#: steps at least, if the sample is small
STEPS = 800

_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each document, and where each document's begin (with the end)."""
    w = Words(texts)
    low = _LOWER[w.raw]
    up, down = _pow(len(low) + 1)
    p = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum(np.where(_ALNUM[low], _TABLE[low] * up[: len(low)], np.uint64(0)), out=p[1:])
    inside = np.concatenate([[0], np.cumsum(_ALNUM[low])])
    first = np.minimum(np.searchsorted(inside, inside[w.starts], side="right") - 1, np.maximum(w.ends - 1, 0))  # first letter of the word
    whole = (p[w.ends] - p[first]) * down[first]
    five = (p[np.minimum(first + 5, w.ends)] - p[first]) * down[first]
    raw = w.raw.astype(np.uint64)
    last = np.zeros(len(w.starts), dtype=np.uint64)
    if len(w.starts):
        before = np.where(w.ends - 2 >= w.starts, raw[np.maximum(w.ends - 2, 0)], np.uint64(0))
        sign = lambda b: np.where(_ALNUM[_LOWER[b.astype(np.uint8)]], np.uint64(1), b)  # noqa: E731  letters are alike here
        upper = (raw[w.starts] >= 65) & (raw[w.starts] <= 90)
        upper2 = (raw[np.minimum(w.starts + 1, w.ends - 1)] >= 65) & (raw[np.minimum(w.starts + 1, w.ends - 1)] <= 90)
        last = sign(raw[w.ends - 1]) | (sign(before) << np.uint64(8)) | (upper.astype(np.uint64) << np.uint64(16)) | (upper2.astype(np.uint64) << np.uint64(17))
    last *= np.uint64(2)
    if len(w.starts) > 1:  # a word said again at once
        same = (whole[1:] == whole[:-1]) & (w.ends[1:] - w.starts[1:] == w.ends[:-1] - w.starts[:-1]) & (w.doc[1:] == w.doc[:-1])
        last[1:][same] = np.uint64(1)
    hashed = lambda h, k: (mix(h * np.uint64(4) + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64)
    base = w.doc << BITS
    shapes, counts = np.unique((w.doc << 20) | last.astype(np.int64), return_counts=True)
    doc = shapes >> 20
    share = np.floor(np.log2(counts / w.counts[doc])).astype(np.int64) + 64  # by powers of two
    shapes = (doc << BITS) | hashed(((shapes & ((1 << 20) - 1)) * 128 + share).astype(np.uint64), 2)
    own = np.unique(np.concatenate([base | hashed(whole, 0), base | hashed(five, 1), shapes]))
    return own & ((1 << BITS) - 1), np.searchsorted(own >> BITS, np.arange(w.n_docs + 1))


def train(texts: list[str], grades: list[int], n_grades: int, seed: int = 5) -> dict:
    """Weights and ordered thresholds."""
    rows, at = [], [0]
    for lo in range(0, len(texts), 256):
        r, b = features(pa.array(texts[lo : lo + 256], pa.string()))
        rows.append(r)
        at += (b[1:] + at[-1]).tolist()
    rows, at, y = np.concatenate(rows), np.array(at), np.array(grades)
    counts = np.bincount(y, minlength=n_grades)
    balance = np.sqrt(len(y) / (n_grades * np.maximum(counts, 1)))
    w, sq = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8)
    cut = np.arange(n_grades - 1) - n_grades - 1.0  # a text that says nothing is good
    cut_sq = np.full(n_grades - 1, 1e-8)
    rng = np.random.default_rng(seed)
    for _ in range(max(EPOCHS, -(-STEPS // -(-len(y) // BATCH)))):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            docs = order[lo : lo + BATCH]
            flat = np.concatenate([rows[at[d] : at[d + 1]] for d in docs])
            n = at[docs + 1] - at[docs]
            doc = np.repeat(np.arange(len(docs)), n)
            z = np.bincount(doc, weights=w[flat], minlength=len(docs))
            g, g_cut = _gradient(z, y[docs], cut)
            g, g_cut = g * balance[y[docs]], g_cut * balance[y[docs]][:, None]
            own, local = np.unique(flat, return_inverse=True)
            grad = np.bincount(local, weights=g[doc]) / len(docs)
            sq[own] += grad**2
            rate = RATE / np.sqrt(sq[own])
            new = w[own] - rate * grad
            w[own] = np.sign(new) * np.maximum(np.abs(new) - rate * L1, 0)
            gc = g_cut.mean(axis=0)
            cut_sq += gc**2
            cut = np.sort(cut - RATE * gc / np.sqrt(cut_sq))
    return {"w": w.astype(np.float32), "cut": cut}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _gradient(z: np.ndarray, y: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of -log P(grade = y) by the score and by each threshold."""
    tail = np.concatenate([np.ones((len(z), 1)), _sigmoid(z[:, None] - cut[None, :]), np.zeros((len(z), 1))], axis=1)
    i = np.arange(len(z))
    above, below = tail[i, y], tail[i, y + 1]  # P(>= y), P(>= y + 1)
    p = np.maximum(above - below, 1e-9)
    da, db = above * (1 - above), below * (1 - below)
    by_cut = np.zeros((len(z), len(cut) + 2))
    by_cut[i, y] += da / p
    by_cut[i, y + 1] -= db / p
    return -(da - db) / p, by_cut[:, 1:-1]


def tails(model: dict, texts: pa.Array) -> np.ndarray:
    """P(grade >= 1), ... of each text."""
    out = np.zeros(len(texts))
    for lo, hi in slices(texts, SMALL_SLICE):
        rows, at = features(texts.slice(lo, hi - lo))
        n = np.diff(at)
        full = np.flatnonzero(n)
        if len(full):
            out[lo + full] = np.add.reduceat(model["w"][rows], at[:-1][full], dtype=np.float64)
    return _sigmoid(out[:, None] - model["cut"][None, :])


def _fit(n_grades: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((t, int(g)) for b in batches for t, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        if rows:
            model = train([r[0] for r in rows], [r[1] for r in rows], n_grades)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return run


def fit_quality(docs: DataFrame, ratings: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text") -> dict | None:
    """A model fitted on documents whose hashed id falls into one residue class, of these the ``SAMPLE_MOST`` of least
    hash at most; ``ratings``: id_col, grade."""
    ship(docs.sparkSession)
    graded = ratings.where(F.col("grade").isNotNull() & F.col(id_col).isNotNull())
    m = max(1, graded.count() // SAMPLE)
    h = F.xxhash64("_id")
    picked = graded.groupBy(F.col(id_col).alias("_id")).agg(F.min("grade").alias("grade")).where(F.pmod(h, F.lit(m)) == 0)
    picked = picked.orderBy(h, "_id").limit(SAMPLE_MOST)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(picked), "_id").select("_id", "text", F.col("grade").cast("int").alias("grade"))
    sample = sample.orderBy(h, "_id", F.xxhash64("text"), "text").limit(SAMPLE_MOST).select("text", "grade")
    got = sample.repartition(1).mapInArrow(_fit(n_grades), "model binary").collect()
    return pickle.loads(bytes(got[0]["model"])) if got else None


def score_quality(docs: DataFrame, model: dict | None, n_grades: int, text_col: str = "text") -> DataFrame:
    """``docs`` with expected_grade and p_at_least_1 ... p_at_least_{n_grades - 1} (columns of these names are replaced)."""
    ship(docs.sparkSession)
    names = [f"p_at_least_{k}" for k in range(1, n_grades)]
    docs = docs.drop("expected_grade", *names)
    if model is None:
        return docs.withColumns({c: F.lit(None).cast("double") for c in ("expected_grade", *names)})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*docs.schema.fields, *(StructField(c, DoubleType()) for c in ("expected_grade", *names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = tails(shared.value, column(batch, text_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.sum(axis=1)), *(pa.array(p[:, k]) for k in range(n_grades - 1))], names=[*batch.schema.names, "expected_grade", *names])

    return docs.mapInArrow(run, schema)


def grades(labels: DataFrame) -> DataFrame:
    """doc_id, grade of the labels table: 0 toxic, 1 of low quality, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade"))
