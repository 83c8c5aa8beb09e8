"""Vectorised word and shingle kernels on Arrow string buffers.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; those separators are ASCII, so
cutting UTF-8 bytes cuts the same words as cutting code points.  Everything works on whole
columns with numpy: no loop over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, in place on a copy."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, U(_BASE)), np.full(size, U(_BASE_INV))
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


#: bytes of texts that kernels look at together: tables of powers for so many have two million entries, or one
SLICE, SMALL_SLICE = (1 << 21) - 2, (1 << 20) - 2


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes (a longer text stands alone): bounds the temporaries."""
    if not len(texts):
        return
    off = np.frombuffer(texts.buffers()[1], dtype=np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, min(hi, len(texts))
        lo = hi


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column without nulls (null: empty)."""
    a = batch.column(batch.schema.get_field_index(name))
    return a.fill_null("") if a.null_count else a


class Words:
    """Words of a slice of texts: byte spans, document numbers and word hashes."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.n_docs = len(texts)
        wide = not pa.types.is_string(texts.type)
        off = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + self.n_docs + 1].astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[off[0] : off[-1]]
        self.offsets = off - off[0]
        self.raw = _LOWER[raw] if lower else raw
        n = len(raw)
        inside = np.zeros(n + 1, dtype=bool)
        inside[:n] = ~_SPACE[raw]
        first = np.zeros(n + 1, dtype=bool)
        first[self.offsets] = True
        before = np.empty(n + 1, dtype=bool)
        before[0] = False
        before[1:] = inside[:n]
        self.starts = np.flatnonzero(inside & (first | ~before))
        self.ends = np.flatnonzero(before & (first | ~inside))
        #: words of document d: bounds[d] to bounds[d + 1]
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(self.n_docs), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.raw)
        up, down = _pow(n + 1)
        p = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_TABLE[self.raw] * up[:n], out=p[1:])
        h = (p[self.ends] - p[self.starts]) * down[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64))

    def text(self, i: int, j: int) -> bytes:
        return self.raw[self.starts[i] : self.ends[j - 1]].tobytes()


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive word hashes, across document borders."""
    m = max(0, len(words) - n + 1)
    h = np.zeros(m, dtype=np.uint64)
    for k in range(n):
        h *= U(0xD6E8FEB86659FD93)
        h += words[k : k + m]
    return mix(h)


def shingle_sets(w: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingle hashes of each document, sorted within it: (hashes, bounds).

    With 1 to n - 1 words the whole sequence is one shingle; without words the set is empty.
    """
    h = w.hashes()
    grams = gram_hashes(h, n)
    doc = w.doc[: len(grams)]
    full = doc == w.doc[n - 1 :] if len(grams) else np.zeros(0, dtype=bool)
    hs, ds = grams[full], doc[full]
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(short):
        extra = []
        for d in short:
            run = h[w.bounds[d] : w.bounds[d + 1]]
            extra.append(int(gram_hashes(run, len(run))[0]) ^ len(run))
        hs, ds = np.concatenate([hs, np.array(extra, dtype=np.uint64)]), np.concatenate([ds, short])
        order = np.argsort(ds, kind="stable")
        hs, ds = hs[order], ds[order]
    edges = np.searchsorted(ds, np.arange(w.n_docs + 1))
    out, bounds = [], np.zeros(w.n_docs + 1, dtype=np.int64)
    for d in range(w.n_docs):
        a, b = edges[d], edges[d + 1]
        if b > a:
            s = np.sort(hs[a:b])
            if b - a > 1:
                keep = np.empty(b - a, dtype=bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
            out.append(s)
            bounds[d + 1] = len(s)
    np.cumsum(bounds, out=bounds)
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)), bounds
