"""N-gram Jaccard self-join of documents by vertical partitioning.

The global n-gram order is (heavy n-grams last, by count; the others by hash).  It is cut into
fragments; documents are compared fragment by fragment, partial overlaps are counted there, and
their sum per pair decides.  Around that:

* Documents with the same set form one class; a class takes part once (``set_id``, a 64-bit hash).
* Candidates share n-grams of their prefixes (the first n - ceil(0.8 n) + 1 in the order) at
  positions that still allow the overlap asked for.  Prefixes travel as packed arrays, dealt by
  n-gram hash; each packed group counts the overlap of its own n-grams, and the sum per pair,
  with all that follows the prefixes added, must reach the overlap asked for.  N-grams in more
  than ``HOT`` classes are dealt as rows of their own.
* In a bucket of a hot n-gram only pairs that can still join two components are compared:
  some centres against the bucket per round, more centres in each round, until every bucket's
  remaining members are in one component or can't link.  So a group of near copies costs about
  its size, and components are exact.
* Links are only counted when asked for, and then all of them: within each component, where every link
  lies, the full sets of all pairs of blocks of classes are compared, whatever pairs were skipped before.
  This grows with the square of a component's classes.

Heavy n-grams are a matter of speed alone: counts are those of tasks that saw the n-gram a few
times, and a bounded number is kept whatever the size of the corpus.

Defined results: a null text, or one without words, has an empty set and is linked with nothing;
a text with fewer words than n is one n-gram; a row without doc_id isn't linked (component_id
null); rows that share a doc_id are compared as separate documents, and as repeated rows they get
the same result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stillwater.llm._components import components
from stillwater.llm._heavy import Counter, contained, heavy_list
from stillwater.llm._scratch import Scope, materialize, width
from stillwater.llm._text import SMALL_SLICE, U, Words, column, mix, shingle_sets, slices
from stillwater.session import ship

#: fragments of the n-gram order in which partial overlaps are counted
FRAGMENTS = 8
#: classes from which an n-gram's bucket is hot
HOT = 32
#: prefix n-grams in one packed group, about
GROUP = 400_000
#: bits of the broadcast filter that says which documents' texts are fetched (fixed: 2 MB)
FILTER = 1 << 24
#: documents whose texts or sets are fetched by broadcasting their ids at most (16 to 40 bytes each; else they are dealt by id)
WANTED_BROADCAST = 1 << 19
#: pairs to compare that are broadcast at most (16 bytes each)
PAIRS_BROADCAST = 1 << 20
#: rows about hot n-grams that are broadcast at most (48 bytes each; else a hot n-gram is a key that Spark's skew join splits)
TOKENS_BROADCAST = 1 << 18

#: classes, and n-grams, of one block of a component in which links are counted, about
BLOCK, BLOCK_GRAMS = 1 << 11, 1 << 20
#: n-grams that are compared together as columns, and pairs of classes that are added up together
COLUMNS, PAIRS = 1 << 12, 1 << 22

_ROWS = "doc_id long, set_id long, n_shingles long, token long, df long"


def _set_ids(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """An order-free 64-bit hash of each document's set (0 for an empty one)."""
    out = np.zeros(len(bounds) - 1, dtype=np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        sums = np.add.reduceat(mix(hashes ^ np.uint64(0xA24BAED4963EE407)), bounds[full])
        out[full] = mix(sums + np.diff(bounds)[full].astype(np.uint64))
    return out.view(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        texts, ids = column(batch, "text"), batch.column(0)
        for lo, hi in slices(texts):
            yield ids.slice(lo, hi - lo), *_shingles(texts.slice(lo, hi - lo), n)


def _shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle sets of a column, hashed in small slices: (hashes, bounds)."""
    hashes, sizes = [np.zeros(0, U)], [np.zeros(1, np.int64)]
    for lo, hi in slices(texts, SMALL_SLICE):
        own, bounds = shingle_sets(Words(texts.slice(lo, hi - lo), lower=True), n)
        hashes.append(own)
        sizes.append(np.diff(bounds))
    return np.concatenate(hashes), np.cumsum(np.concatenate(sizes))


def _profile(n: int):
    """Rows of documents (doc_id, set_id, n_shingles), and of n-grams seen often in this task (token, df)."""

    def reports(counter: Counter) -> pa.RecordBatch:
        tokens, df = counter.flush()
        none = pa.nulls(len(tokens), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, tokens, df], names=["doc_id", "set_id", "n_shingles", "token", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for ids, hashes, bounds in _sets(batches, n):
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(_set_ids(hashes, bounds)), pa.array(np.diff(bounds)), none, none], names=["doc_id", "set_id", "n_shingles", "token", "df"])
            if counter.add(hashes):
                yield reports(counter)
        yield reports(counter)

    return run


def _prefixes(n: int, groups: int, heavy):
    """Packed prefix arrays by group; n-grams of the heavy list go to groups below 0, dealt at random."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy_token, heavy_df = heavy.value
        task = 0
        for ids, hashes, bounds in _sets(batches, n):
            sets, sizes = _set_ids(hashes, bounds), np.diff(bounds)
            valid = ids.is_valid().to_numpy(zero_copy_only=False) & (sizes > 0)
            first = np.zeros(len(sets), dtype=bool)
            known = np.flatnonzero(valid)
            first[known[np.unique(sets[known], return_index=True)[1]]] = True
            doc = np.repeat(np.arange(len(sets)), sizes)
            df = np.zeros(len(hashes), dtype=np.int64)
            if len(heavy_token) and len(hashes):
                at = np.minimum(np.searchsorted(heavy_token, hashes), len(heavy_token) - 1)
                hit = heavy_token[at] == hashes
                df[hit] = heavy_df[at[hit]]
                touched = np.zeros(len(sets), dtype=bool)
                touched[doc[hit]] = True
                for d in np.flatnonzero(touched & first):
                    a, b = bounds[d], bounds[d + 1]
                    o = np.argsort(df[a:b], kind="stable")
                    hashes[a:b], df[a:b] = hashes[a:b][o], df[a:b][o]
            pos = np.arange(len(hashes)) - bounds[doc]
            take = np.flatnonzero(first[doc] & (pos <= sizes[doc] - (4 * sizes[doc] + 4) // 5))
            h, d, p, f = hashes[take], doc[take], pos[take], df[take]
            marked = np.zeros(len(sets), dtype=bool)
            marked[d[f > 0]] = True
            group = np.where(f > 0, -1 - (task % groups), (h >> np.uint64(20)).astype(np.int64) % groups)
            task += 1
            o = np.argsort(group, kind="stable")
            edges = np.flatnonzero(np.diff(group[o], prepend=np.iinfo(np.int64).min, append=np.iinfo(np.int64).max)) if len(o) else np.zeros(1, dtype=np.int64)
            rows = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                i = o[a:b]
                own, local = np.unique(d[i], return_inverse=True)
                # the size of a set with heavy n-grams in its prefix is negated
                rows.append((int(group[i[0]]), h[i].tobytes(), _narrow(local), _narrow(p[i]), sets[own].tobytes(), np.where(marked[own], -sizes[own], sizes[own]).astype(np.int64).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 6))], names=["grp", "h", "d", "p", "sets", "sizes"])

    return run


def _narrow(x: np.ndarray) -> bytes:
    return x.astype(np.uint16 if not len(x) or x.max() < 65536 else np.uint32).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint16 if len(data) == 2 * n else np.uint32).astype(np.int64)


_PAIR, _HOT, _SHARED = range(3)
#: pair: sets a, b of sizes n, m share k n-grams of this group, one of them (token 1, else 0) where their positions
#: allow the overlap (the first that they share does, but it may be in another group); hot: set a of size n with m n-grams from this
#: one on; shared: k of the n-grams of set a in this group are in other sets too, in buckets that aren't hot
#: (told of sets with heavy n-grams, which have rows in a group below 0 at least)
_CANDIDATES = "kind int, token long, a long, b long, n long, m long, k long"


def _able(n1, n2, room1, room2):
    """May sets of these sizes reach the overlap, if all before the shared n-gram differs?"""
    return 9 * np.minimum(room1, room2) >= 4 * (n1 + n2)


def _buckets(table: pa.Table) -> pa.Table:
    """Candidate pairs of one packed group with their overlap in it, and the rows of its hot buckets."""
    h = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in table["h"]]
    d, p = ([_wide(x.as_py(), len(y)) for x, y in zip(table[c], h, strict=True)] for c in ("d", "p"))
    sets, sizes = ([np.frombuffer(x.as_py(), dtype=np.int64) for x in table[c]] for c in ("sets", "sizes"))
    s, n = (np.concatenate([x[i] for x, i in zip(y, d, strict=True)]) for y in (sets, sizes))
    marked, n = n < 0, np.abs(n)
    h, room = np.concatenate(h), n - np.concatenate(p)
    o = np.lexsort((s, h))
    h, s, n, room, marked = h[o], s[o], n[o], room[o], marked[o]
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (s[1:] == s[:-1])
    h, s, n, room, marked = (x[~same] for x in (h, s, n, room, marked))
    edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1], [True]]))
    size = np.diff(edges)
    is_hot = size > (0 if table["grp"][0].as_py() < 0 else HOT)
    hot = np.flatnonzero(np.repeat(is_hot, size))
    x, y = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for k in range(2, HOT + 1):
        at = edges[:-1][(size == k) & ~is_hot]
        i, j = np.triu_indices(k, 1)
        x.append((at[:, None] + i).ravel())
        y.append((at[:, None] + j).ravel())
    x, y = np.concatenate(x), np.concatenate(y)
    o = np.lexsort((s[y], s[x]))
    x, y = x[o], y[o]
    new = np.flatnonzero(np.concatenate([[True], (s[x][1:] != s[x][:-1]) | (s[y][1:] != s[y][:-1])])) if len(x) else np.zeros(0, dtype=np.int64)
    k = np.diff(np.append(new, len(x)))
    able = np.zeros(len(x), dtype=bool)
    able[_able(n[x], n[y], room[x], room[y])] = True
    able = np.logical_or.reduceat(able, new) if len(new) else able
    x, y = x[new], y[new]
    near = (5 * np.minimum(n[x], n[y]) >= 4 * np.maximum(n[x], n[y]))
    x, y, k, able = x[near], y[near], k[near], able[near]
    own, of = np.unique(s[marked], return_inverse=True)
    of = np.bincount(of, weights=np.repeat((size > 1) & ~is_hot, size)[marked], minlength=len(own))
    parts = ((_PAIR, able, s[x], s[y], n[x], n[y], k), (_HOT, h[hot].view(np.int64), s[hot], None, n[hot], room[hot], None), (_SHARED, None, own, None, None, None, of))
    out = []
    for kind, *cols in parts:
        rows = len(cols[1])  # of a
        out.append(pa.table([pa.array(np.full(rows, kind, dtype=np.int32)), *(pa.nulls(rows, pa.int64()) if c is None else pa.array(c.astype(np.int64)) for c in cols)], names=["kind", "token", "a", "b", "n", "m", "k"]))
    return pa.concat_tables(out)


def _signature(grams: np.ndarray) -> bytes:
    """One bit per slot that an n-gram of the set falls into; slots: a power of two, four times the n-grams or more."""
    slots = 1 << max(6, int(4 * len(grams) - 1).bit_length())
    bits = np.zeros(slots, dtype=bool)
    bits[(grams & np.uint64(slots - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _segments(n: int, heavy):
    """The set of each wanted text, cut into the fragments of the n-gram order (heavy n-grams are the last), and its
    signature (whole: true)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = heavy.value[0]
        for batch in batches:
            texts, want = column(batch, "text"), batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in slices(texts, SMALL_SLICE):
                hashes, bounds = shingle_sets(Words(texts.slice(lo, hi - lo), lower=True), n)
                right = np.flatnonzero(_set_ids(hashes, bounds) == want[lo:hi])
                last = contained(hashes, often)
                out = []
                for d in right:
                    own, late = hashes[bounds[d] : bounds[d + 1]], last[bounds[d] : bounds[d + 1]]
                    cut = np.searchsorted(early := own[~late], np.arange(1, FRAGMENTS, dtype=np.uint64) << np.uint64(61))
                    key = int(want[lo + d]), len(own)
                    out.append((*key, -1, True, _signature(own)))
                    out += [(*key, f, False, part.tobytes()) for f, part in enumerate([*np.split(early, cut), own[late]]) if len(part)]
                if out:
                    types = pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["set_id", "n", "fragment", "whole", "part"])

    return run


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of sets with n and m n-grams whose signatures allow the overlap: each slot that only one of the
    two has is an n-gram at least that the other lacks."""
    for batch in batches:
        n, m = (batch.column(k).to_numpy() for k in (2, 3))
        most = np.zeros(batch.num_rows, dtype=np.int64)
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint8) for k in (4, 5))
            while len(x) != len(y):  # fewer slots: the upper half laid on the lower one
                x, y = (x[: len(x) // 2] | x[len(x) // 2 :], y) if len(x) > len(y) else (x, y[: len(y) // 2] | y[len(y) // 2 :])
            both = int(np.bitwise_count(x & y).sum())
            most[i] = min(n[i] - int(np.bitwise_count(x).sum()), m[i] - int(np.bitwise_count(y).sum())) + both
        able = pa.array(9 * most >= 4 * (n + m))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(able)


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(4), batch.column(5)
        out = np.zeros(batch.num_rows, dtype=np.int64)
        for i in range(batch.num_rows):
            x, y = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
            at = np.searchsorted(y, x)
            at[at == len(y)] = len(y) - 1
            out[i] = int((y[at] == x).sum())
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(out)], names=["a", "b", "na", "nb", "overlap"])


def _both(pairs: DataFrame, parts: DataFrame, *keys: str) -> DataFrame:
    """a, b, na, nb, x, y: the parts of both sets of each pair (by ``keys``, if they have several)."""
    near = F.broadcast(pairs) if pairs.count() <= PAIRS_BROADCAST else pairs  # else both sides are dealt by set
    left = parts.select(F.col("set_id").alias("a"), *keys, F.col("n").alias("na"), F.col("part").alias("x")).join(near, "a")
    right = parts.select(F.col("set_id").alias("b"), *keys, F.col("n").alias("nb"), F.col("part").alias("y")).join(near, "b")
    return left.join(right, ["a", "b", *keys]).select("a", "b", "na", "nb", "x", "y")


def _linked(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """a, b, n_a, n_b, overlap of the pairs (a, b) that are similar enough."""
    pairs = materialize(pairs.select("a", "b"), "pairs")
    near = materialize(_both(pairs, segments.where("whole")).mapInArrow(_near, "a long, b long"), "near")
    parts = _both(near, segments.where("not whole"), "fragment").mapInArrow(_overlaps, "a long, b long, na long, nb long, overlap long")
    sums = parts.groupBy("a", "b").agg(F.max("na").alias("n_a"), F.max("nb").alias("n_b"), F.sum("overlap").alias("overlap"))
    return sums.where(100 * F.col("overlap") >= 80 * (F.col("n_a") + F.col("n_b") - F.col("overlap")))


def _side(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Sets of a block with their sizes and rows, and (n-gram, set's place) of all their parts."""
    sets, first, of = np.unique(table["set_id"].to_numpy(), return_index=True, return_inverse=True)
    parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["part"]]
    grams, owner = np.concatenate(parts), np.repeat(of, [len(x) for x in parts])
    o = np.argsort(grams, kind="stable")
    return sets, table["n"].to_numpy()[first], table["copies"].to_numpy()[first], grams[o], owner[o]


def _block_links(table: pa.Table) -> pa.Table:
    """set_id, n_links of two blocks of a component (or of one with itself): rows of the sets that each links with."""
    x, y, block = table["x"][0].as_py(), table["y"][0].as_py(), table["block"].to_numpy()
    if x != y and len(np.unique(block)) == 1:  # the hash left the other block empty
        return pa.table({"set_id": pa.array([], pa.int64()), "n_links": pa.array([], pa.int64())})
    left = _side(table.filter(pa.array(block == x)))
    right = left if x == y else _side(table.filter(pa.array(block == y)))
    (a, n_a, copies_a, grams_a, own_a), (b, n_b, copies_b, grams_b, own_b) = left, right
    shared = np.intersect1d(grams_a, grams_b)
    lo_a, lo_b = np.searchsorted(grams_a, shared), np.searchsorted(grams_b, shared)
    k_a, k_b = np.searchsorted(grams_a, shared, side="right") - lo_a, np.searchsorted(grams_b, shared, side="right") - lo_b
    overlap = np.zeros((len(a), len(b)), dtype=np.float32)  # exact: below 2^24
    common = 64 * k_a * k_b >= overlap.size
    for at in np.array_split(np.flatnonzero(common), -(-int(common.sum()) // COLUMNS) or 1):
        place = [np.zeros((rows, len(at)), dtype=np.float32) for rows in overlap.shape]
        for out, own, lo, k in zip(place, (own_a, own_b), (lo_a, lo_b), (k_a, k_b), strict=True):
            column_ = np.repeat(np.arange(len(at)), k[at])
            out[own[np.arange(len(column_)) - np.repeat(np.cumsum(k[at]) - k[at], k[at]) + np.repeat(lo[at], k[at])], column_] = 1
        overlap += place[0] @ place[1].T
    rare = np.flatnonzero(~common)
    ends = np.cumsum(k_a[rare] * k_b[rare])
    start = 0
    while start < len(rare):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
        at = rare[start:stop]
        k = k_a[at] * k_b[at]
        token = np.repeat(np.arange(len(at)), k)
        nth = np.arange(len(token)) - np.repeat(np.cumsum(k) - k, k)
        i, j = own_a[lo_a[at][token] + nth // k_b[at][token]], own_b[lo_b[at][token] + nth % k_b[at][token]]
        overlap += np.bincount(i * len(b) + j, minlength=overlap.size).reshape(overlap.shape)
        start = stop
    overlap = overlap.astype(np.int64)
    link = 100 * overlap >= 80 * (n_a[:, None] + n_b[None, :] - overlap)
    if x == y:
        np.fill_diagonal(link, False)
    counts = [(a, link @ copies_b)] if x == y else [(a, link @ copies_b), (b, link.T @ copies_a)]
    return pa.table({"set_id": pa.array(np.concatenate([c[0] for c in counts]), pa.int64()), "n_links": pa.array(np.concatenate([c[1] for c in counts]), pa.int64())})


def _links(roots: DataFrame, classes: DataFrame, segments: DataFrame) -> DataFrame:
    """set_id, n_links of the sets in ``roots``: rows of other sets that each links with."""
    sizes = segments.where("whole").select("set_id", "n")
    nodes = roots.select(F.col("node").alias("set_id"), "root").distinct().join(classes.select("set_id", "copies"), "set_id").join(sizes, "set_id")
    nodes = materialize(nodes, "nodes")
    every = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("grams"), F.sum("copies").alias("rows"))
    of = nodes.join(every, "root")
    two = of.where("k = 2").select("set_id", (F.col("rows") - F.col("copies")).alias("n_links"))  # they are linked
    blocks = F.greatest(F.ceil(F.col("k") / BLOCK), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("long")
    more = of.where("k > 2").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("set_id"), "blocks"))
    more = more.select("set_id", "root", "copies", "block", "blocks")
    few = F.broadcast(more) if nodes.count() <= WANTED_BROADCAST else more
    parts = segments.where("not whole").select("set_id", "n", "part").join(few, "set_id")
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    parts = parts.select("root", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "set_id", "n", "copies", "part")
    counted = parts.groupBy("root", "x", "y").applyInArrow(_block_links, "set_id long, n_links long")
    return two.union(counted).groupBy("set_id").agg(F.sum("n_links").alias("n_links"))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, links: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id reachable by links),
    and with ``links`` n_links (how many other rows of ``docs`` it links with; 0 without doc_id or words).

    Two documents link when 100 x |intersection| >= 80 x |union| of their sets of n-word shingles.
    """
    spark = ship(docs.sparkSession)
    with Scope(spark) as tables:
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        rows = materialize(texts.mapInArrow(_profile(n), _ROWS), "shingles")
        members = rows.where("n_shingles is not null").select("doc_id", "set_id", "n_shingles")
        total = members.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]

        heavy = heavy_list(rows.where("token is not null").select("token", "df"), HOT)

        groups = max(width(spark), -(-total // (5 * GROUP)))
        packed = texts.where("doc_id is not null").mapInArrow(_prefixes(n, groups, heavy), "grp long, h binary, d binary, p binary, sets binary, sizes binary")
        candidates = materialize(packed.groupBy("grp").applyInArrow(_buckets, _CANDIDATES), "candidates")
        hot = candidates.where(F.col("kind") == _HOT).groupBy("token", F.col("a").alias("set_id")).agg(F.max("n").alias("n"), F.max("m").alias("room"))
        hot = materialize(hot, "hot")
        of_hot = materialize(hot.groupBy("set_id").agg(F.count(F.lit(1)).alias("hot")), "hot-counts")
        shared = candidates.where(F.col("kind") == _SHARED).groupBy(F.col("a").alias("set_id")).agg(F.sum("k").alias("cold"))
        shared = of_hot.join(shared, "set_id", "left")
        most = F.coalesce(F.col("hot") + F.col("cold"), F.col("n") - _suffix("n")).cast("long")  # not told: its whole prefix
        hot = materialize(_able_members(hot.join(shared, "set_id").withColumn("shared", most).drop("hot", "cold")), "hot")
        cold = candidates.where(F.col("kind") == _PAIR).groupBy("a", "b").agg(F.max("n").alias("n"), F.max("m").alias("m"), F.sum("k").alias("k"), F.max("token").alias("able")).where("able = 1")
        for side in ("a", "b"):
            cold = cold.join(of_hot.select(F.col("set_id").alias(side), F.col("hot").alias(f"hot_{side}")), side, "left")
        in_prefix = F.col("k") + F.least(F.coalesce("hot_a", F.lit(0)), F.coalesce("hot_b", F.lit(0)))
        cold = materialize(cold.where(9 * (in_prefix + F.greatest(_suffix("n"), _suffix("m"))) >= 4 * (F.col("n") + F.col("m"))).select("a", "b"), "pairs")

        classes = members.where("n_shingles > 0 and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
        wanted = cold.select(F.explode(F.array("a", "b")).alias("set_id")).union(hot.select("set_id")).distinct()
        wanted = materialize(wanted.join(classes.drop("copies"), "set_id"), "wanted")
        segments = _fetch(texts, wanted).select("set_id", "text").mapInArrow(_segments(n, heavy), "set_id long, n long, fragment int, whole boolean, part binary")
        # a doc_id of several rows may bring a set several times
        segments = materialize(segments.dropDuplicates(["set_id", "fragment"]) if _repeats(members) else segments, "segments", by="whole")

        roots = components(_linked(cold, segments))
        centres = 1
        while True:
            pairs = _hot_pairs(hot, roots, centres)
            if pairs is None:
                break
            hot_, pairs = pairs
            found = materialize(_linked(pairs, segments), "links")
            every = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found.select("a", "b"))
            hot, roots, centres = hot_, components(every), centres * 8

        top = roots.join(classes.withColumnRenamed("set_id", "node"), "node")
        least = top.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        by_set = classes.withColumnRenamed("doc_id", "own").join(roots.join(least, "root").select(F.col("node").alias("set_id"), "component_id"), "set_id", "left").select("set_id", F.coalesce("component_id", "own").alias("component_id"))
        columns = ["doc_id", "n_shingles", "component_id"]
        empty = members.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        if links:
            of = classes.select("set_id", "copies").join(_links(roots, classes, segments), "set_id", "left")
            of = of.select("set_id", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
            by_set, empty, columns = by_set.join(of, "set_id"), empty.withColumn("n_links", F.lit(0).cast("long")), [*columns, "n_links"]
        by_set = materialize(by_set, "classes")
        return tables.keep(members.where("n_shingles > 0 and doc_id is not null").join(by_set, "set_id").select(*columns).union(empty))


def _repeats(members: DataFrame) -> bool:
    return bool(members.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").take(1))


def _suffix(size: str):
    """N-grams of a set after its prefix."""
    return F.floor((4 * F.col(size) + 4) / 5).cast("long") - 1


def _fetch(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """set_id, text of the wanted documents.  A broadcast filter of fixed size lets hardly any other text into
    the shuffle; where there are too many for it, it only saves less."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER))
    words = wanted.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 64).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("_bits"))
    near = texts.withColumn("_s", slot).withColumn("_w", F.floor(F.col("_s") / 64)).join(F.broadcast(words), "_w")  # FILTER / 64 rows at most
    few = F.broadcast(wanted) if wanted.count() <= WANTED_BROADCAST else wanted
    return near.where(F.expr("shiftright(_bits, cast(_s % 64 as int)) & 1 = 1")).select("doc_id", "text").join(few, "doc_id")


def _per_token(rows: DataFrame, of_token: DataFrame) -> DataFrame:
    """``rows`` with a table of one row per hot n-gram, or of a few: a hot n-gram's rows stay where they are."""
    of_token = materialize(of_token, "tokens")
    return rows.join(F.broadcast(of_token) if of_token.count() <= TOKENS_BROADCAST else of_token, "token")


def _able_members(hot: DataFrame) -> DataFrame:
    """Members of hot buckets that may link with another member, by position, size and shared n-grams."""
    bounds = hot.groupBy("token").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    room = F.floor(F.col("room") * 9 / 4) - F.col("n") >= F.col("least")
    smaller = 9 * (F.col("shared") + _suffix("n")) >= 4 * (F.col("n") + F.col("least"))
    larger = 9 * (F.col("shared") + _suffix("most")) >= 4 * (F.col("n") + F.col("most"))
    return _per_token(hot, bounds).where(room & (smaller | larger)).select("token", "set_id", "n", "room", "shared")


def _hot_pairs(hot: DataFrame, roots: DataFrame, centres: int) -> tuple[DataFrame, DataFrame] | None:
    """Members of hot buckets that may still join components, less this round's centres, and the pairs of
    these centres with them; None once every bucket is settled."""
    reach = F.floor(F.col("room") * 9 / 4).cast("long") - F.col("n")  # largest partner that the position allows
    labelled = hot.join(roots.select(F.col("node").alias("set_id"), "root"), "set_id", "left").select(*hot.columns, reach.alias("reach"), F.coalesce("root", "set_id").alias("label"))
    labelled = materialize(labelled, "labelled")
    bounds = labelled.groupBy("token").agg(F.min("n").alias("least"), F.max("reach").alias("most"))
    able = materialize(_per_token(labelled, bounds).where("reach >= least and n <= most").drop("least", "most"), "able")
    labels = able.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k"))
    main = labels.groupBy("token").agg(F.count(F.lit(1)).alias("labels"), F.max_by("label", "k").alias("main")).where("labels > 1")
    left = materialize(_per_token(able, main.select("token", "main")).select(*hot.columns, "label", (F.col("label") == F.col("main")).alias("in_main")), "unsettled")
    if not left.take(1):
        return None
    # members with the fewest n-grams of their own come first: the texts that others are copies of
    rank = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("shared"), F.desc("room"), "set_id"))
    picked = materialize(left.withColumn("_r", rank).where(F.col("_r") <= centres).drop("_r"), "centres")
    x = picked.select("token", F.col("set_id").alias("a"), F.col("n").alias("n_x"), F.col("room").alias("room_x"), F.col("shared").alias("shared_x"), F.col("label").alias("label_x"))
    pairs = _per_token(left, x).where((F.col("label") != F.col("label_x")) & (9 * F.least("room", "room_x") >= 4 * (F.col("n") + F.col("n_x"))) & (9 * (F.least("shared", "shared_x") + F.greatest(_suffix("n"), _suffix("n_x"))) >= 4 * (F.col("n") + F.col("n_x"))))
    pairs = pairs.select(F.least("a", "set_id").alias("a"), F.greatest("a", "set_id").alias("b")).distinct()
    rest = left.join(picked.select("token", "set_id"), ["token", "set_id"], "left_anti").select(*hot.columns)
    return materialize(rest, "hot"), pairs
