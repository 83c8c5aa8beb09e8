"""Word kernels, the encoder, token files and token counts."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import CLASH_VALUES, CLASHING, DOCS, corpus, shingles, words

from stillwater.llm import _heavy, _text, ngram_join, token_counts, token_files
from stillwater.llm._bpe import encoder, tokenizer_path

PATH = tokenizer_path()


def test_words_and_shingles():
    rows = corpus()
    texts = pa.array([r[1] or "" for r in rows])
    w = _text.Words(texts.slice(3), lower=False)
    assert [w.text(i, i + 1).decode() for i in range(len(w.starts))] == [x for r in rows[3:] for x in words(r[1])]
    sets, bounds = _text.shingle_sets(_text.Words(texts, lower=True))
    assert np.diff(bounds).tolist() == [len(shingles(r[1])) for r in rows]
    assert [b - a for a, b in _text.slices(texts, 1)] == [1] * len(rows)


def test_shingles_of_small_slices(monkeypatch):
    texts = pa.array([r[1] or "" for r in corpus()])
    want = _text.shingle_sets(_text.Words(texts, lower=True))
    for size in (1, 300, 1 << 20):
        monkeypatch.setattr(ngram_join, "SMALL_SLICE", size)
        for x, y in zip(ngram_join._shingles(texts, 5), want, strict=True):
            np.testing.assert_array_equal(x, y)
    assert [x.tolist() for x in ngram_join._shingles(texts.slice(0, 0), 5)] == [[], [0]]


def test_counter(monkeypatch):
    monkeypatch.setattr(_heavy, "WINDOW", 50)
    rng = np.random.default_rng(2)
    for pieces in ([], [0], [1], [3, 30, 16], [49, 1], [400], [10, 39, 300], [50, 60]):
        counter, all_ = _heavy.Counter(), [rng.integers(0, 20, k, dtype=np.uint64) << np.uint64(60) for k in pieces]
        full = [counter.add(x) for x in all_]
        assert full == [x >= 50 for x in np.cumsum(pieces).tolist()]
        values, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *all_]), return_counts=True)
        assert [x.to_pylist() for x in counter.flush()] == [values[n > 1].view(np.int64).tolist(), n[n > 1].tolist()]
        assert [x.to_pylist() for x in counter.flush()] == [[], []]


def test_encoder_equals_library():
    rng = random.Random(1)
    parts = [*" '  \n\t stmdrevelaéÉ12½.,!\"-'", "'s", "'re", "'ll", " '", "  ", "\r\n", "’", "中", "🙂", "<|endoftext|>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)] + ["", "'", " "]
    ids, n = encoder(PATH).encode(pa.array(texts))
    own = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert own == [e.ids for e in encoder(PATH).tok.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tokens") / "t")
    rows = [*corpus(), (None, "no id", "en", "s1", 5)]
    token_files.write_tokens(spark.createDataFrame(rows, DOCS), path, PATH, block_bytes=4000)
    return path, rows


def test_token_files_round_trip(spark, written):
    path, rows = written
    tok = encoder(PATH).tok
    got = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    want = {}
    for d, t, *_ in rows:
        want.setdefault(d, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 2])
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids in want[r.doc_id]
        at += len(r.ids)
    digest = {r.start: r for r in token_files.read_tokens(spark, path, digest=True).collect()}
    assert all(digest[r.start].ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    assert [r.ids for r in token_files.read_tokens(spark, path, only=rows[7][0]).collect()] == [want[rows[7][0]][0]]


def test_token_files_empty(spark, tmp_path):
    token_files.write_tokens(spark.createDataFrame([], DOCS), str(tmp_path / "t"), PATH)
    assert token_files.read_tokens(spark, str(tmp_path / "t"), digest=True).count() == 0


def test_token_files_of_one_id(spark, tmp_path):
    """Many rows of one doc_id: none or all of them may fall into the sample of the dictionary."""
    for i, text in enumerate(("one text for all", None)):
        rows = [(7, text, "en", "s", 0, *CLASH_VALUES)] * 2500
        token_files.write_tokens(spark.createDataFrame(rows, DOCS + CLASHING), path := str(tmp_path / str(i)), PATH)
        got = token_files.read_tokens(spark, path).collect()
        want = [*encoder(PATH).tok.encode(text or "", add_special_tokens=False).ids, 2]
        assert len(got) == 2500 and all(r.ids == want for r in got)
        assert sorted(r.start for r in got) == [len(want) * k for k in range(2500)]


def test_token_counts(spark):
    rows = [(*r, *CLASH_VALUES) for r in corpus()]
    docs = spark.createDataFrame(rows, DOCS + CLASHING)
    n = sorted(len(e.ids) for e in encoder(PATH).tok.encode_batch([r[1] or "" for r in rows], add_special_tokens=False))
    sums = token_counts.token_counts(docs, PATH)
    for r in sums.collect():
        assert r.n_docs == n.count(r.n_tokens) and r.docs_at_least == sum(x >= r.n_tokens for x in n)
        assert r.tokens_at_least == sum(x for x in n if x >= r.n_tokens) and r.tokens_cut == sum(min(x, r.n_tokens) for x in n)
        assert r.docs_up_to == sum(x <= r.n_tokens for x in n) and abs(r.quantile - r.docs_up_to / len(n)) < 1e-12
    limits = [0, 1, 37, 500, 10**7]
    assert {r.limit: (r.tokens_cut, r.docs_cut) for r in token_counts.truncated_total(sums, limits).collect()} == {k: (sum(min(x, k) for x in n), sum(x > k for x in n)) for k in limits}
    assert token_counts.quantile(sums, 0.5).first()[0] == n[(len(n) + 1) // 2 - 1]
    assert token_counts.token_counts(docs.limit(0), PATH).count() == 0
