"""Byte-level BPE encoding of whole columns with the ``tokenizers`` library.

The library spends most of its time per pre-token, and running text repeats its pre-tokens, so
each distinct one is handed to the library's BPE model once per worker and its ids are kept.
Cutting texts into pre-tokens is vectorised; texts with characters outside ``_KNOWN`` or with
the string of a special token, and tokenizers of another kind, go through ``encode_batch_fast``
whole, so ids always equal the library's.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import unicodedata

from stillwater.llm._text import SMALL_SLICE, _TABLE, _pow, column, mix, slices

_OTHER, _LETTER, _NUMBER, _WHITE = range(4)
#: code points whose classes no Unicode version changes
_KNOWN = np.zeros(0x2100, dtype=bool)
_KNOWN[:0x250] = True
_KNOWN[0x2010:0x2060] = True
_CLASS = np.zeros(0x2100, dtype=np.uint8)
for _c in np.flatnonzero(_KNOWN):
    _k = unicodedata.category(chr(_c))[0]
    _CLASS[_c] = _LETTER if _k == "L" else _NUMBER if _k == "N" else _OTHER
_CLASS[[*range(9, 14), 0x20, 0x85, 0xA0, 0x2028, 0x2029, 0x202F, 0x205F]] = _WHITE


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """``encode(texts)`` gives all ids of a column, one after another, and their number per text."""

    LIMIT = 400_000  # pre-tokens kept

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.fast = spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.dtype = np.uint16 if self.tok.get_vocab_size() <= 65536 else np.uint32
        self.alphabet = str.maketrans({chr(b): c for b, c in _byte_alphabet().items()})
        self._clear()

    def _clear(self) -> None:
        # hashes of the pre-tokens kept, sorted, and where the ids of each are
        self.known, self.place = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.ids, self.off = array("I"), array("q", [0])

    def parts(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and numbers of ids of a column, slice by slice."""
        for lo, hi in slices(texts, SMALL_SLICE):
            yield self._slice(texts.slice(lo, hi - lo))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        own = [(np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)), *self.parts(texts)]
        return np.concatenate([i for i, _ in own]), np.concatenate([n for _, n in own])

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        if not self.fast:
            own = self._plain(texts.to_pylist())
            return (np.concatenate(own) if own else np.zeros(0, np.uint32)), np.array([len(x) for x in own], dtype=np.int64)
        off = np.frombuffer(texts.buffers()[1], dtype=np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + n + 1].astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        at, cls, odd = self._classes(raw, off)
        starts, ends, first = self._pretokens(raw, off, at, cls)
        if len(starts):
            ids, per = self._ids(raw, starts, ends)
            counts = np.diff(np.concatenate([[0], np.cumsum(per)])[first])
        else:
            ids, counts = np.zeros(0, dtype=np.uint32), np.zeros(n, dtype=np.int64)
        whole = raw.tobytes()
        if any(s in whole for s in self.special):
            for d in range(n):
                odd[d] |= any(s in whole[off[d] : off[d + 1]] for s in self.special)
        if odd.any():
            parts = np.split(ids, np.cumsum(counts)[:-1])
            which = np.flatnonzero(odd)
            for d, own in zip(which, self._plain([texts[int(d)].as_py() for d in which]), strict=True):
                parts[d], counts[d] = own, len(own)
            ids = np.concatenate(parts)
        return ids, counts

    @staticmethod
    def _classes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte position and class of each character; which texts hold unknown characters."""
        odd = np.zeros(len(off) - 1, dtype=bool)
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        lead = raw[at]
        cls = _CLASS[lead]
        wide = np.flatnonzero(lead >= 0xC0)
        if len(wide):
            p, b = at[wide], lead[wide].astype(np.int64)
            pad = np.concatenate([raw, np.zeros(3, dtype=np.uint8)])
            two, three = ((b & 0x1F) << 6) | (pad[p + 1] & 0x3F), ((b & 0x0F) << 12) | ((pad[p + 1].astype(np.int64) & 0x3F) << 6) | (pad[p + 2] & 0x3F)
            cp = np.where(b < 0xE0, two, np.where(b < 0xF0, three, 0x20FF))
            known = (cp < 0x2100) & _KNOWN[np.minimum(cp, 0x20FF)]
            cls[wide] = _CLASS[np.where(known, cp, 0)]
            if not known.all():
                odd[np.unique(np.searchsorted(off, p[~known], side="right") - 1)] = True
        return at, cls, odd

    @staticmethod
    def _pretokens(raw, off, at, cls) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte spans of pre-tokens, and the number of the first one of each text."""
        m = len(at)
        if not m:
            return at, at, np.zeros(len(off), dtype=np.int64)
        new = np.zeros(m + 1, dtype=bool)  # a text starts here
        new[np.searchsorted(at, off)] = True
        white, space = cls == _WHITE, raw[at] == 0x20
        start = np.empty(m, dtype=bool)
        start[0] = True
        pw = white[:-1]
        ends_run = np.zeros(m, dtype=bool)  # white, and followed by something else in the same text
        ends_run[:-1] = pw & ~white[1:] & ~new[1:m]
        start[1:] = np.where(white[1:], ~pw | ends_run[1:], np.where(pw, ~space[:-1], cls[1:] != cls[:-1]))
        start |= new[:m]
        quote = np.flatnonzero(start & (raw[at] == 0x27))
        for i in quote:
            tail = raw[at[i] + 1 : at[i] + 3].tobytes()
            k = 1 if tail[:1] in (b"s", b"t", b"m", b"d") else 2 if tail in (b"re", b"ve", b"ll") else 0
            if k and i + k < m + 0 and not new[i + 1 : i + k + 1].any():
                start[i + 1 : i + k + 1] = False
                if i + k + 1 < m:
                    start[i + k + 1] = True
        starts = at[start]
        ends = np.append(starts[1:], len(raw))
        return starts, ends, np.searchsorted(starts, off)

    def _ids(self, raw, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        up, down = _pow(len(raw) + 1)
        p = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_TABLE[raw] * up[: len(raw)], out=p[1:])
        h = mix((p[ends] - p[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        codes, uniq = pd.factorize(h)
        if len(self.known) + len(uniq) > self.LIMIT:
            self._clear()
        near = np.searchsorted(self.known, uniq)
        at = np.minimum(near, max(0, len(self.known) - 1))
        held = self.known[at] == uniq if len(self.known) else np.zeros(len(uniq), dtype=bool)
        slots = np.full(len(uniq), -1, dtype=np.int64)
        slots[held] = self.place[at[held]]
        missing = np.flatnonzero(~held)
        if len(missing):
            where = np.empty(len(uniq), dtype=np.int64)
            where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            tokenize, alphabet = self.tok.model.tokenize, self.alphabet
            slots[missing] = len(self.off) - 1 + np.arange(len(missing))
            for u in missing.tolist():
                i = where[u]
                word = raw[starts[i] : ends[i]].tobytes().decode("latin-1").translate(alphabet)
                self.ids.extend([t.id for t in tokenize(word)])
                self.off.append(len(self.ids))
            new = missing[np.argsort(uniq[missing])]
            self.known, self.place = np.insert(self.known, near[new], uniq[new]), np.insert(self.place, near[new], slots[new])
        store, off = np.frombuffer(self.ids, dtype=np.uint32), np.frombuffer(self.off, dtype=np.int64)
        length = np.diff(off)
        s = slots[codes]
        per = length[s]
        to = np.cumsum(per)
        out = store[np.repeat(off[s] - (to - per), per) + np.arange(to[-1] if len(to) else 0)]
        del store, off
        return out, per


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encode_column(batch: pa.RecordBatch, text: str, path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and numbers of ids of a batch's texts, slice by slice in their order."""
    return encoder(path).parts(column(batch, text))
