"""Removal of passages that an earlier document has, by suffix automata of reference shards.

A window is ``size`` consecutive words; a window is repeated if its words also start somewhere in
a document with a smaller id, and every word that a repeated window covers is removed.

Equal texts are looked at once, as the document of smallest id; in the others every window is repeated.

1. Each window has an anchor, the least hash of its ``GRAM``-word runs.  Equal windows have equal
   anchors, so only windows whose anchor is in two documents or more are looked at further.
2. Runs of such windows with one anchor are segments.  Distinct segments, each with the smallest
   id of its documents, are dealt by anchor to reference shards.
3. Per shard, a suffix automaton of its segments is built, and the segments are streamed through
   it: where the matching statistic reaches the window size, the state tells the smallest id of a
   document with that window.  Shards hold ``SHARD`` words, or one anchor.
4. These ids go back to the documents, whose covered words are cut out, in maximal spans.

Windows of an anchor that very many documents share are segments of their own, dealt by their own
words, so no shard grows with the corpus.

Defined results: a null or empty text has no words; rows without doc_id are kept whole and repeat
nothing; rows that share a doc_id don't remove from each other; repeated rows get equal results;
an empty table gives an empty result; other columns are ignored (``deduplicate``: kept).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.llm._automaton import SuffixAutomaton
from stillwater.llm._heavy import Counter, contained, heavy_list
from stillwater.llm._scratch import Scope, discard, materialize, width
from stillwater.llm._text import SMALL_SLICE, Words, column, gram_hashes, slices
from stillwater.session import ship

SIZE, GRAM = 13, 5
#: words of a reference shard, and windows of a segment at most
SHARD, RUN = 20_000, 64
#: texts from which an anchor's windows are dealt one by one
HOT = 256
#: texts of several documents that are broadcast at most (32 bytes each)
COPIES_BROADCAST = 1 << 19
#: anchors in one packed group, about
GROUP = 600_000


def _anchors(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts (word numbers) and anchors of all windows of a slice."""
    n = len(w.starts) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    grams = gram_hashes(w.hashes(), GRAM)
    least = grams[:n].copy()
    for k in range(1, size - GRAM + 1):
        np.minimum(least, grams[k : k + n], out=least)
    at = np.flatnonzero(w.doc[:n] == w.doc[size - 1 :])
    return at, least[at]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before."""
    out = np.ones(len(columns[0]), dtype=bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _often(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            texts = column(batch, "text")
            for lo, hi in slices(texts, SMALL_SLICE):
                w = Words(texts.slice(lo, hi - lo))
                at, anchor = _anchors(w, size)
                if counter.add(anchor[_changes(anchor, w.doc[at])]):
                    yield pa.RecordBatch.from_arrays(list(counter.flush()), names=["token", "df"])
        yield pa.RecordBatch.from_arrays(list(counter.flush()), names=["token", "df"])

    return run


def _packed(size: int, groups: int, heavy):
    """Anchors of documents by group; those of the heavy list in groups below 0, dealt at random."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, task = heavy.value[0], 0
        for batch in batches:
            texts = column(batch, "text")
            ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in slices(texts):
                w = Words(texts.slice(lo, hi - lo))
                at, anchor = _anchors(w, size)
                new = _changes(anchor, w.doc[at])
                anchor, doc = anchor[new], w.doc[at][new]
                group = np.where(contained(anchor, often), -1 - (task % groups), (anchor >> np.uint64(8)).astype(np.int64) % groups)
                task += 1
                o = np.argsort(group, kind="stable")
                cuts = np.append(np.flatnonzero(_changes(group[o])), len(o))
                rows = []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    i = o[a:b]
                    own, local = np.unique(doc[i], return_inverse=True)
                    rows.append((int(group[i[0]]), anchor[i].tobytes(), local.astype(np.uint16 if len(own) < 65536 else np.uint32).tobytes(), ids[lo + own].astype(np.int64).tobytes(), keys[lo + own].astype(np.int64).tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 5))], names=["grp", "anchor", "doc", "ids", "keys"])

    return run


_FLAGS = "doc_id long, key long, anchors binary, hot binary"


def _shared(table: pa.Table) -> pa.Table:
    """Per text, its anchors of one group that other texts have too."""
    anchor = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in table["anchor"]]
    doc = [np.frombuffer(x.as_py(), dtype=np.uint16 if len(x.as_py()) == 2 * len(a) else np.uint32) for x, a in zip(table["doc"], anchor, strict=True)]
    ids, keys = (np.concatenate([np.frombuffer(x.as_py(), dtype=np.int64)[d] for x, d in zip(table[c], doc, strict=True)]) for c in ("ids", "keys"))
    anchor = np.concatenate(anchor)
    o = np.lexsort((ids, keys, anchor))
    anchor, ids, keys = anchor[o], ids[o], keys[o]
    once = _changes(anchor, keys)  # of equal texts the smallest id
    anchor, ids, keys = anchor[once], ids[once], keys[once]
    begin = np.flatnonzero(_changes(anchor))
    texts = np.diff(np.append(begin, len(anchor)))
    n = np.repeat(texts, texts)
    always = table["grp"][0].as_py() < 0
    keep, hot = (np.ones(len(n), bool), np.ones(len(n), bool)) if always else (n >= 2, n >= HOT)
    anchor, ids, keys, hot = anchor[keep], ids[keep], keys[keep], hot[keep]
    o = np.lexsort((anchor, keys, ids))
    anchor, ids, keys, hot = anchor[o], ids[o], keys[o], hot[o]
    cuts = np.append(np.flatnonzero(_changes(ids, keys)), len(ids))
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))
    return pa.table([pa.array(ids[cuts[:-1]], pa.int64()), pa.array(keys[cuts[:-1]], pa.int64()), pa.array([anchor[a:b][~hot[a:b]].tobytes() for a, b in spans], pa.binary()), pa.array([anchor[a:b][hot[a:b]].tobytes() for a, b in spans], pa.binary())], names=["doc_id", "key", "anchors", "hot"])


def _segments(size: int):
    """route, seg (its words), doc_id, key, start of the segments of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text")
            lists = [[np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(b, dtype=np.uint64) for b in row)]) for row in batch.column(c).to_pylist()] for c in (3, 4)]
            for lo, hi in slices(texts, SMALL_SLICE):
                w = Words(texts.slice(lo, hi - lo))
                at, anchor = _anchors(w, size)
                doc = w.doc[at]
                edges = np.searchsorted(doc, np.arange(hi - lo + 1))
                cols = ([], [], [], [])
                for d in range(hi - lo):
                    a, b = edges[d], edges[d + 1]
                    own, hot = (np.sort(x[lo + d]) for x in lists)
                    is_hot = contained(anchor[a:b], hot)
                    use = np.flatnonzero(contained(anchor[a:b], own) | is_hot)
                    if not len(use):
                        continue
                    i, m = at[a:b][use], anchor[a:b][use]
                    new = _changes(m)
                    new[1:] |= i[1:] != i[:-1] + 1
                    new |= is_hot[use]
                    number = np.arange(len(i)) - np.maximum.accumulate(np.where(new, np.arange(len(i)), 0))
                    new |= number % RUN == 0
                    first = np.flatnonzero(new)
                    last = np.append(first[1:], len(i)) - 1
                    for f, t in zip(first.tolist(), last.tolist(), strict=True):
                        x, y = int(i[f]), int(i[t]) + size
                        seg = b" ".join(w.text(x, y).split())
                        cols[0].append(int.from_bytes(hashlib.blake2b(seg, digest_size=8).digest(), "little", signed=True) if is_hot[use[f]] else int(m[f : f + 1].view(np.int64)[0]))
                        cols[1].append(seg)
                        cols[2].append(lo + d)
                        cols[3].append(x - int(w.bounds[d]))
                if cols[0]:
                    row = pa.array(cols[2])
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), batch.column(0).take(row), batch.column(1).take(row), pa.array(cols[3], pa.int64())], names=["route", "seg", "doc_id", "key", "start"])

    return run


def _shards(size: int):
    """Streams rows (route, s1, s2, seg, least) sorted by route; per segment the smallest id of each window."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        number: dict[bytes, int] = {}
        words = [[number.setdefault(x, len(number)) for x in r[3].split(b" ")] for r in rows]
        reference = SuffixAutomaton()
        for r, x in zip(rows, words, strict=True):
            reference.add(x, r[4])
        reference.close()
        found = [reference.windows(x, size) for x in words]
        return pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["s1", "s2", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, route = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != route and n >= SHARD:
                    yield solve(held)
                    held, n = [], 0
                route = row[0]
                held.append(row)
                n += row[3].count(b" ") + 1
        if held:
            yield solve(held)

    return run


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, key (hash of the text), starts (array: first words of repeated windows, in pieces)."""
    spark = ship(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    heavy = heavy_list(texts.select("text").mapInArrow(_often(size), "token long, df long"), HOT)
    total = docs.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    groups = max(width(spark), total // (30 * GROUP))  # an anchor in about 30 bytes
    packed = texts.mapInArrow(_packed(size, groups, heavy), "grp long, anchor binary, doc binary, ids binary, keys binary")
    flags = materialize(packed.groupBy("grp").applyInArrow(_shared, _FLAGS), "flags")
    per_doc = flags.groupBy("doc_id", "key").agg(F.collect_list("anchors").alias("anchors"), F.collect_list("hot").alias("hot"))  # a row per group, of one document
    wanted = texts.join(per_doc, ["doc_id", "key"]).select("doc_id", "key", "text", "anchors", "hot")
    segments = wanted.mapInArrow(_segments(size), "route long, seg binary, doc_id long, key long, start long")
    segments = materialize(segments.withColumns({"s1": F.xxhash64("seg"), "s2": F.xxhash64(F.lit(1), "seg")}), "segments")
    discard(flags)
    # equal texts have equal segments: the smallest id per segment, first within each task
    reference = segments.groupBy("route", "s1", "s2", "seg").agg(F.min("doc_id").alias("least"))
    reference = reference.repartition(width(spark), "route").sortWithinPartitions("route", "s1", "s2").select("route", "s1", "s2", "seg", "least")
    found = materialize(reference.mapInArrow(_shards(size), "s1 long, s2 long, least array<long>"), "windows")
    hits = segments.select("s1", "s2", "doc_id", "key", "start").join(found, ["s1", "s2"])
    starts = F.filter(F.transform("least", lambda m, i: F.when(m < F.col("doc_id"), F.col("start") + i)), lambda x: x.isNotNull())
    out = materialize(hits.select("doc_id", "key", starts.alias("starts")).where(F.size("starts") > 0), "starts")
    discard(segments)
    discard(found)
    return out


def _cover(words: list[bytes], pieces: list, size: int) -> list[bytes]:
    """The words that no repeated window covers (no pieces: all windows are repeated)."""
    step = np.zeros(len(words) + 1, dtype=np.int64)
    if pieces is None:
        starts = np.arange(max(0, len(words) - size + 1))
    else:
        starts = np.unique(np.concatenate([np.asarray(p, dtype=np.int64) for p in pieces]))
    np.add.at(step, starts, 1)
    np.add.at(step, starts + size, -1)
    left = np.flatnonzero(np.cumsum(step)[:-1] == 0).tolist()
    return [words[i] for i in left]


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, digest: bool = False) -> DataFrame:
    """``docs`` with repeated passages removed from the text (words then joined by one space; other texts are
    unchanged).  With ``digest``: doc_id, n_words, n_removed, kept_sha256 instead."""
    with Scope(docs.sparkSession) as tables:
        starts = repeated_windows(docs, id_col, text_col, size)
        cuts = starts.groupBy("doc_id", "key").agg(F.collect_list("starts").alias("starts"))  # of one document
        texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"), F.xxhash64(F.lit(1), F.col(text_col)).alias("key2"), F.col(text_col).isNotNull().alias("has")).where("doc_id is not null and has")
        first = materialize(texts.groupBy("key", "key2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last"), "copies")
        few = F.broadcast(first) if first.count() <= COPIES_BROADCAST else first  # else a hot text is a key that Spark's skew join splits
        again = texts.join(few, ["key", "key2"]).where("doc_id > first").select("doc_id", "key", F.lit(True).alias("again")).distinct()
        cuts = cuts.join(again, ["doc_id", "key"], "full_outer")
        own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) if digest else docs
        name = "text" if digest else text_col
        rows = own.select(F.struct(*own.columns).alias("row"), F.col("doc_id" if digest else id_col).cast("long").alias("doc_id"), F.xxhash64(name).alias("key"))
        rows = tables.keep(rows.join(cuts, ["doc_id", "key"], "left").select("row.*", F.col("starts").alias("starts_"), F.coalesce("again", F.lit(False)).alias("again_")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, pieces = batch.column(batch.schema.get_field_index(name)), batch.column(batch.num_columns - 2)
            again = batch.column(batch.num_columns - 1)
            out, counts = [], []
            for i in range(batch.num_rows):
                all_ = again[i].as_py()
                cut = None if all_ else pieces[i].as_py()
                text = texts[i].as_py()
                if digest:
                    words = (text or "").encode().split()
                    kept = _cover(words, cut, size) if cut or all_ else words
                    out.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                    counts.append((len(words), len(words) - len(kept)))
                else:
                    out.append(b" ".join(_cover(text.encode().split(), cut, size)).decode() if cut or (all_ and len(text.encode().split()) >= size) else text)
            if digest:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])
            else:
                cols = list(batch.columns[:-2])
                cols[batch.schema.get_field_index(name)] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-2])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" if digest else own.schema)
