"""Benchmark decontamination by SimHash of item-sized windows and exact weighted similarity.

For every benchmark item, windows of as many words as the item has are compared with it (a shorter
text is one window):

1. A window can only reach ``LEAST`` if it shares one of the item's rarest shingles: of those whose
   weight is just over what the similarity lets the two differ by.  All windows around these get a fingerprint.
2. A fingerprint has a bit for the sign of each of ``BITS`` sums over the window's distinct shingles, of the
   root of a shingle's weight times a normal number that its hash gives.  Sets of similarity J have vectors
   of cosine 2 J / (1 + J) or more whatever their weights, and with normal numbers each bit differs with
   probability angle / pi exactly: at J = 0.8 38.8 of 256 bits are expected to, with a deviation of 5.7.
   ``RADIUS`` lies over five deviations above; a pair just at 0.8 is lost about once in a million.
3. An index of the items of each size gives all fingerprints within the radius: of four blocks of 64 bits,
   one at least is within a fourth of it.  (Blocks that must be equal would have four bits or fewer at
   this radius, and nearly every pair agrees in one of those.)
4. Weighted Jaccard similarity of the shingles (weighted by how rare they are in the benchmark),
   exact, verifies each candidate (0.8 or more).

Words are lower-cased (A-Z); shingles are five words, of a shorter item the whole item.

The benchmark is broadcast in shards of ``SHARD`` items; each shard scans the documents once.
Rarity is counted over the whole benchmark, whatever the shards.

Defined results: a null or empty text matches nothing; items that are null or without words are
left out; of several windows of a document that match an item the most similar counts, then the
first; rows with equal doc_id or without one are judged each by its own text; repeated items
match each; empty tables give empty results; other columns are kept (``clean_documents``) or
ignored (``find_leaks``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.llm._heavy import contained
from stillwater.llm._text import SMALL_SLICE, Words, column, gram_hashes, mix, slices
from stillwater.session import ship

SHINGLE, LEAST, SHARD = 5, 0.8, 20_000
#: bits of a fingerprint (in blocks of 64), and the most that similar ones differ in
BITS, RADIUS = 256, 68
#: windows that get fingerprints together, and pairs of fingerprints compared together
RUN, PAIRS = 1 << 11, 1 << 22


@cache
def _normal() -> np.ndarray:
    """The quantiles of the normal distribution at 2^16 even steps."""
    half = np.array([NormalDist().inv_cdf((i + 0.5) / (1 << 16)) for i in range(1 << 15)])
    return np.concatenate([half, -half[::-1]]).astype(np.float32)


def _projections(shingles: np.ndarray) -> np.ndarray:
    """``BITS`` normal numbers of each shingle, from its hash."""
    salts = mix(np.arange(1, BITS // 4 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return _normal()[mix(shingles[:, None] ^ salts[None, :]).view(np.uint16)]


def _bits(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums >= 0, axis=1).view(np.uint64)


class HammingIndex:
    """All stored fingerprints (rows of 64-bit blocks) within ``radius`` bits of a query."""

    def __init__(self, fingerprints: np.ndarray, radius: int = RADIUS):
        self.blocks, self.radius = np.ascontiguousarray(fingerprints.T), radius

    def query(self, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, stored): those of which a block is near enough, then those near as a whole."""
        found, n = [], max(1, PAIRS // max(1, self.blocks.shape[1]))
        for lo in range(0, len(fingerprints), n):
            part = fingerprints[lo : lo + n]
            near = np.zeros((len(part), self.blocks.shape[1]), dtype=bool)
            for k, block in enumerate(self.blocks):
                near |= np.bitwise_count(part[:, k, None] ^ block[None, :]) <= self.radius // len(self.blocks)
            q, s = np.nonzero(near)
            apart = np.bitwise_count(part[q] ^ self.blocks.T[s]).sum(axis=1, dtype=np.int64)
            found.append((q[apart <= self.radius] + lo, s[apart <= self.radius]))
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate([none, *(f[0] for f in found)]), np.concatenate([none, *(f[1] for f in found)])


class Benchmark:
    """Items of one shard, ready to be matched."""

    def __init__(self, ids: list, texts: list[str], shingle: int = SHINGLE, rarity: tuple[int, np.ndarray, np.ndarray] | None = None):
        w = Words(pa.array(texts, pa.string()), lower=True)
        h = w.hashes()
        items = [(ids[d], h[w.bounds[d] : w.bounds[d + 1]]) for d in range(len(ids)) if w.counts[d]]
        self.ids = [i for i, _ in items]
        self.sizes = np.array([len(x) for _, x in items], dtype=np.int64)
        self.n = np.minimum(self.sizes, shingle)
        grams = [gram_hashes(x, int(k)) for (_, x), k in zip(items, self.n, strict=True)]
        self.sets = [np.unique(g) for g in grams]
        if rarity is None:  # the only shard
            known, df = np.unique(np.concatenate(self.sets), return_counts=True) if items else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            rarity = len(items), known, df
        n_items, self.known, df = rarity
        self.weight, self.rare = 1 + np.log(max(1, n_items) / df), 1 + np.log(max(1, n_items))
        self.mass = [float(self.weights(s).sum()) for s in self.sets]
        prints = np.concatenate([np.zeros((0, BITS // 64), np.uint64), *(self._fingerprint(x) for x in self.sets)])
        #: items of each size, and the index of their fingerprints
        self.classes = {size: (of := np.flatnonzero(self.sizes == size), HammingIndex(prints[of])) for size in np.unique(self.sizes).tolist()}
        # of items of n-word shingles: their rarest shingles, sorted, and the sizes of the items that hold them
        self.posts, self.filter = {}, np.zeros(1 << 20, dtype=bool)
        for n in np.unique(self.n).tolist():
            of = np.flatnonzero(self.n == n)
            rarest = [self._rarest(i) for i in of]
            token, size = np.concatenate(rarest), np.repeat(self.sizes[of], [len(x) for x in rarest])
            o = np.lexsort((size, token))
            token, size = token[o], size[o]
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (size[1:] != size[:-1])])
            self.posts[n] = (token[new], size[new])
            self.filter[(token >> np.uint64(44)).astype(np.int64)] = True

    def _fingerprint(self, shingles: np.ndarray) -> np.ndarray:
        return _bits((_projections(shingles) * np.sqrt(self.weights(shingles))[:, None]).sum(axis=0, dtype=np.float64)[None, :])

    def _rarest(self, item: int) -> np.ndarray:
        """Shingles of which a window of similarity ``LEAST`` holds one: without them too little could be shared."""
        weight = self.weights(self.sets[item])
        o = np.argsort(-weight, kind="stable")
        return self.sets[item][o[: int(np.searchsorted(np.cumsum(weight[o]), (1 - LEAST + 1e-9) * self.mass[item], side="right")) + 1]]

    def weights(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(shingles), self.rare)
        at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        return np.where(self.known[at] == shingles, self.weight[at], self.rare)

    def leaks(self, texts: pa.Array) -> list[tuple[int, int, int, int, float]]:
        """(text, item, first word, words, similarity), the best window of each pair."""
        w = Words(texts, lower=True)
        h = w.hashes()
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for n, (token, size) in self.posts.items():
            grams = gram_hashes(h, n)
            if not len(grams):
                continue
            maybe = np.flatnonzero(self.filter[(grams >> np.uint64(44)).astype(np.int64)])
            maybe = maybe[w.doc[maybe] == w.doc[maybe + n - 1]]
            lo, hi = np.searchsorted(token, grams[maybe]), np.searchsorted(token, grams[maybe], side="right")
            pos = np.repeat(maybe, hi - lo)
            sizes = size[np.arange(len(pos)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)]
            for own in np.unique(sizes).tolist():
                self._around(w, grams, n, own, pos[sizes == own], best)
        return [(d, i, first, words, value) for (d, i), (value, first, words) in sorted(best.items())]

    def _around(self, w: Words, grams, n, size, pos, best) -> None:
        """Look at the windows of ``size`` words around the shingles at ``pos``, each rare in an item of that size."""
        doc = w.doc[pos]
        m = np.minimum(size, w.counts[doc]) - n + 1  # shingles of a window
        lo, hi = np.maximum(pos - m + 1, w.bounds[doc]), np.minimum(pos, w.bounds[doc + 1] - n + 1 - m)
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1] + 1)]))
        last = np.append(new[1:], len(pos)) - 1
        for d, k, a, b in zip(doc[new].tolist(), m[new].tolist(), lo[new].tolist(), hi[last].tolist(), strict=True):
            for begin in range(a, b + 1, RUN):
                self._run(w, grams, k, n, size, d, begin, min(begin + RUN - 1, b), best)

    def _run(self, w: Words, grams, m, n, size, d, lo, hi, best) -> None:
        """Compare the windows of m shingles that start at lo to hi, in text d, with the items of ``size`` words."""
        own, windows = grams[lo : hi + m], hi - lo + 1
        weight = self.weights(own)
        # a shingle counts for the windows that start after its last occurrence, up to its own place
        at = np.arange(len(own))
        o = np.argsort(own, kind="stable")
        again = np.flatnonzero(own[o][1:] == own[o][:-1])
        first = np.maximum(at - m + 1, 0)
        first[o[again + 1]] = np.maximum(first[o[again + 1]], o[again] + 1)
        end = np.minimum(at, windows - 1) + 1
        held = first < end

        def sums(values: np.ndarray) -> np.ndarray:
            out = np.zeros((windows + 1, *values.shape[1:]))
            np.add.at(out, first[held], values[held])
            np.subtract.at(out, end[held], values[held])
            return np.cumsum(out, axis=0)[:-1]

        if len(again):
            turned = sums(_projections(own) * np.sqrt(weight)[:, None])
        else:
            upto = np.zeros((len(own) + 1, BITS))
            np.cumsum(_projections(own) * np.sqrt(weight)[:, None], axis=0, out=upto[1:])
            turned = upto[m:] - upto[:-m]
        of, index = self.classes[size]
        window, stored = index.query(_bits(turned))
        total = sums(weight) if len(window) else None
        for item in np.unique(of[stored]).tolist():
            known, mass = self.sets[item], self.mass[item]
            shared = sums(np.where(contained(own, known), weight, 0.0))
            value = shared / (total + mass - shared)
            able = np.sort(window[of[stored] == item])
            able = able[value[able] >= max(LEAST, float(value[able].max())) - 1e-9]
            for begin in (lo + able).tolist():
                mine = np.unique(grams[begin : begin + m])
                both = float(self.weights(np.intersect1d(mine, known, assume_unique=True)).sum())
                exact = both / (float(self.weights(mine).sum()) + mass - both)
                place = begin - int(w.bounds[d])
                if exact >= LEAST - 1e-12 and ((old := best.get((d, item))) is None or (exact, -place) > (old[0], -old[1])):
                    best[d, item] = (exact, place, m + n - 1)
                if exact >= 1 - 1e-12:  # no later window is better
                    break


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each item, and a null for each item with words."""
    for batch in batches:
        sets = Benchmark(list(range(batch.num_rows)), batch.column(0).to_pylist()).sets
        if sets:
            h = pa.array(np.concatenate(sets).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([h, pa.nulls(len(sets), pa.int64())])], names=["h"])


def _rarity(items: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Items with words in the whole benchmark, and shingles of several of them with their number of items."""
    counts = items.select("text").mapInArrow(_shingles, "h long").groupBy("h").count().where("h is null or count > 1").toArrow()
    h, df = counts["h"].combine_chunks(), counts["count"].to_numpy()
    held = h.is_valid().to_numpy(zero_copy_only=False)
    known = h.drop_null().to_numpy().view(np.uint64)
    o = np.argsort(known)
    return int(df[~held].sum()), known[o], df[held][o]


def _shards(docs: DataFrame, benchmark: DataFrame, item_col: str, text_col: str) -> list:
    """Broadcast shards of at most about ``SHARD`` items."""
    ship(docs.sparkSession)
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    n = max(1, -(-items.count() // SHARD))
    rarity = _rarity(items) if n > 1 else None
    out = []
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow()
        order = sorted(zip(rows["item_id"].to_pylist(), rows["text"].to_pylist(), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        out.append(docs.sparkSession.sparkContext.broadcast(Benchmark([r[0] for r in order], [r[1] for r in order], rarity=rarity)))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity for every document and item that a window matches."""

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = shared.value
            for batch in batches:
                texts, ids = column(batch, "text"), batch.column(0)
                for lo, hi in slices(texts, SMALL_SLICE):
                    rows = b.leaks(texts.slice(lo, hi - lo))
                    if rows:
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([lo + r[0] for r in rows])), pa.array([b.ids[r[1]] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.float64())], names=["doc_id", "item_id", "first_word", "n_words", "similarity"])

        return run

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for shared in _shards(docs, benchmark, item_col, item_text_col):
        part = texts.mapInArrow(scan(shared), "doc_id long, item_id long, first_word long, n_words long, similarity double")
        out = part if out is None else out.union(part)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, unchanged."""

    def scan(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, keep = column(batch, text_col), np.ones(batch.num_rows, dtype=bool)
                for lo, hi in slices(texts, SMALL_SLICE):
                    for d, *_ in shared.value.leaks(texts.slice(lo, hi - lo)):
                        keep[lo + d] = False
                yield batch.filter(pa.array(keep))

        return run

    for shared in _shards(docs, benchmark, item_col, item_text_col):
        docs = docs.mapInArrow(scan(shared), docs.schema)
    return docs
