"""Language identification: averaged hashed subword embeddings with a linear softmax.

A document is the average of the embeddings of its letter trigrams and 4-grams (bytes, lower
case, word ends marked), hashed to fixed tables; a linear layer and softmax give the language.
Trained by stochastic gradient descent in numpy on a bounded sample: ``PER_LANG`` documents of each
language or more, about twice as many at most, with their whole texts (rows alike count once).  Probabilities are calibrated by a
temperature fitted on sampled documents held back from training, which also set the score below
which a prediction is rejected (``accepted``).  Predictions read whole texts: both layers being
linear, they are one table of scores per subword.

Defined results: a text that is null or has no letter is ``und`` with score 0, not accepted; a row
without doc_id is predicted too; repeated rows get equal results; with no labelled text all are
``und``; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.llm._scratch import discard, materialize
from stillwater.llm._text import SMALL_SLICE, _LOWER, column, slices
from stillwater.session import ship

PER_LANG = 800
#: languages whose sampling shares are broadcast at most (else documents are dealt by language)
LANGS_BROADCAST = 1 << 16
BITS, DIM, EPOCHS, RATE = 16, 16, 6, 0.5

#: ASCII bytes other than letters end a word
_FOLD = np.full(256, 0x20, dtype=np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_FOLD = _FOLD[_LOWER]


def subwords(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all subwords of a column, and where each document's begin (with the end)."""
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], dtype=np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = _FOLD[np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[off[0] : off[-1]]]
    off = off - off[0]
    buf = np.full(len(raw) + n + 3, 0x20, dtype=np.uint8)
    at = np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), np.diff(off))
    buf[at] = raw
    begin = off + np.arange(n + 1)  # of the space before each document
    letter = buf != 0x20
    code = buf.astype(np.uint32)
    tri = code[:-3] | (code[1:-2] << np.uint32(8)) | (code[2:-1] << np.uint32(16))
    quad = tri | (code[3:] << np.uint32(24))
    rows3, rows4 = (tri * np.uint32(2654435761)) >> np.uint32(32 - BITS), ((quad * np.uint32(2246822519)) >> np.uint32(32 - BITS)) + np.uint32(1 << BITS)
    ok3 = letter[1:-2]
    ok4 = ok3 & letter[2:-1]
    both = np.empty((len(tri), 2), dtype=np.uint32)
    both[:, 0], both[:, 1] = rows3, rows4
    mask = np.stack([ok3, ok4], axis=1)
    ends = np.concatenate([[0], np.cumsum(mask.sum(axis=1))])
    return both[mask], ends[np.minimum(begin, len(tri))]


def _sliced(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As ``subwords``, slice by slice: its temporaries are several times its results."""
    rows, sizes = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
    for lo, hi in slices(texts, SMALL_SLICE):
        own, at = subwords(texts.slice(lo, hi - lo))
        rows.append(own)
        sizes.append(np.diff(at))
    return np.concatenate(rows), np.cumsum(np.concatenate(sizes))


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 7) -> dict:
    """The model: languages, one score row per subword, temperature, rejection threshold."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held = order[: len(order) // 8] if len(order) >= 40 else order
    fit = order[len(order) // 8 :] if len(order) >= 40 else order
    rows, at = _sliced(pa.array(texts, pa.large_string()))
    emb = rng.normal(0, 0.1, (2 << BITS, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(names)), dtype=np.float32)
    weight = len(y) / (len(names) * np.bincount(y, minlength=len(names)))
    steps, total = 0, EPOCHS * -(-len(fit) // 32)
    for _ in range(EPOCHS):
        for lo in range(0, len(fit), 32):
            docs = rng.permutation(fit)[:32] if lo == 0 else fit[lo : lo + 32]
            pieces, sizes = [], []
            for d in docs:  # a random stretch, short ones included
                a, b = at[d], at[d + 1]
                if b > a:
                    k = int(min(b - a, max(4, (b - a) * rng.random() ** 2)))
                    s = a + int(rng.integers(0, b - a - k + 1))
                    pieces.append(rows[s : s + k])
                    sizes.append((d, k))
            if not pieces:
                continue
            flat, k = np.concatenate(pieces), np.array([x[1] for x in sizes])
            first = np.concatenate([[0], np.cumsum(k)[:-1]])
            h = np.add.reduceat(emb[flat], first, axis=0) / k[:, None]
            own = y[[x[0] for x in sizes]]
            g = _softmax(h @ out).astype(np.float32)
            g[np.arange(len(own)), own] -= 1
            g *= weight[own][:, None].astype(np.float32)
            rate = RATE * (1 - steps / total)
            back = g @ out.T
            out -= rate * h.T @ g / len(own) * 8
            np.add.at(emb, flat, -rate * np.repeat(back / k[:, None], k, axis=0).astype(np.float32) * 8)
            steps += 1
    table = (emb @ out).astype(np.float32)
    z = logits(table, rows, at)[held]
    full = at[held + 1] > at[held]
    z, yh = z[full], y[held][full]
    grid = np.geomspace(0.02, 20, 120)
    # smoothed targets (Platt): all right on m documents is no proof of certainty
    m = len(yh)
    sure = [_softmax(z * t)[np.arange(m), yh] for t in grid] if m else [np.ones(1)]
    loss = [-((m + 1) * np.log(s + 1e-12) + np.log(1 - s + 1e-12)).mean() / (m + 2) for s in sure]
    heat = float(grid[int(np.argmin(loss))])
    p = _softmax(z * heat) if len(yh) else np.zeros((0, len(names)))
    right = p.argmax(axis=1) == yh
    cut = 0.5
    if len(yh) and not right.all():  # rejects what is as unsure as nine tenths of the errors
        cut = float(min(0.99, max(0.5, np.quantile(p.max(axis=1)[~right], 0.9))))
    return {"names": names, "table": table, "heat": heat, "cut": cut}


def logits(table: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    n, out = np.diff(at), np.zeros((len(at) - 1, table.shape[1]))
    full = np.flatnonzero(n)
    if len(full):
        for c in range(table.shape[1]):
            out[full, c] = np.add.reduceat(table[:, c][rows], at[:-1][full], dtype=np.float64) / n[full]
    return out


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pickle

    rows = sorted((t, x) for b in batches for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([r[0] for r in rows], [r[1] for r in rows]))], pa.binary())], names=["model"])


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            texts = column(batch, "text")
            n = len(texts)
            best, score = np.zeros(n, dtype=np.int64), np.zeros(n)
            letters = np.zeros(n, dtype=bool)
            for lo, hi in slices(texts, SMALL_SLICE):
                rows, at = subwords(texts.slice(lo, hi - lo))
                some = np.diff(at) > 0
                for d in np.flatnonzero(some):
                    # bytes of other scripts may be signs; ASCII letters settle most texts at once
                    letters[lo + d] = True
                own = texts.slice(lo, hi - lo)
                for d in np.flatnonzero(some & ~_has_ascii_letter(own)):
                    letters[lo + d] = any(ch.isalpha() for ch in own[int(d)].as_py())
                if m is not None:
                    p = _softmax(logits(m["table"], rows, at) * m["heat"])
                    best[lo:hi], score[lo:hi] = p.argmax(axis=1), p.max(axis=1)
            known = letters & (m is not None)
            names = np.array([*m["names"], "und"] if m is not None else ["und"], dtype=object)
            pred = names[np.where(known, best, len(names) - 1)]
            score = np.clip(np.where(known, score, 0.0), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(known & (score >= (m["cut"] if m is not None else 1.0)), pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return run


def _has_ascii_letter(texts: pa.Array) -> np.ndarray:
    off = np.frombuffer(texts.buffers()[1], dtype=np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[off[0] : off[-1]]
    low = raw | 0x20
    count = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
    return count[off[1:] - off[0]] > count[off[:-1] - off[0]]


def identify_languages(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for every row; learns from rows where the column
    ``held_out`` is false and the language is known."""
    spark = ship(docs.sparkSession)
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out.alias("held_out")).where("not held_out and lang is not null and text is not null")
    share = materialize(known.groupBy("lang").agg(F.greatest(F.lit(1).cast("long"), F.floor(F.count(F.lit(1)) / PER_LANG)).alias("_m")), "languages")  # a row per language
    few = F.broadcast(share) if share.count() <= LANGS_BROADCAST else share
    # by id and text: rows of one doc_id don't come all together, and repeated rows count once
    h = F.xxhash64("doc_id", "text")
    sample = known.join(few, "lang").where(F.pmod(h, F.col("_m")) == 0).select(h.alias("h"), "text", "lang").dropDuplicates(["h", "lang"]).select("text", "lang")
    got = sample.repartition(1).mapInArrow(_fit, "model binary").collect()
    import pickle

    discard(share)
    model = spark.sparkContext.broadcast(pickle.loads(bytes(got[0]["model"])) if got else None)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")


def fold(id_col: str = "doc_id", folds: int = 5):
    """True for the held-out fold: crc32 of the id as text is divisible by ``folds`` (a null id: true)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(True))
