"""Top-k search, language ID, quality, decontamination, WARC audit, mixing and the pipeline."""

import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from helpers import CLASH_VALUES, CLASHING, DOCS, components, corpus, sentence, words

import corpus_pipeline
from stillwater.llm import _ordered, decontaminate, language_id, quality, queries, source_mix, vector_topk, warc_audit

SF = "/root/testdata/sf0.001"


def brute_topk(rows, picked, k, scale):
    out = {}
    good = [(i, [int(np.floor(float(x) * scale)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in good:
        if picked(q):
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


def test_topk(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, 0.5, -0.25, rng.gauss(0, 1)]) for _ in range(20)]) for i in range(300)]
    rows += [(1000, None), (1001, [None] * 20), (1002, [float("nan")] * 20), (1003, [float("inf")] * 20), (None, [1.0] * 20), (1005, []), (1010, [1.0, 2.0]), (1011, [3.0, 4.0]), (1020, rows[0][1]), (1030, rows[0][1])]
    rows += [(2000, [1e30] * 3), (2001, [1e12, 1.0, 2.0]), (2002, [1e6, 1e6, 5.0])]
    frame = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, rank int").repartition(5)
    low, high = -(1 << 63), (1 << 63) - 1
    want = {q: [(r, i, min(high, max(low, s))) for r, i, s in v] for q, v in brute_topk(rows, lambda i: i % 5 == 0, 5, 256).items()}
    for cells, chunk in ((1 << 22, 1 << 18), (1 << 22, 60), (100, 1 << 18)):
        monkeypatch.setattr(vector_topk, "QUERY_CELLS", cells)
        monkeypatch.setattr(vector_topk, "CHUNK_CELLS", chunk)
        got: dict = {}
        for r in vector_topk.vector_topk(frame, frame.where("vec_id % 5 = 0")).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in want.items() if v}
    assert vector_topk.vector_topk(frame.limit(0), frame.limit(0)).count() == 0


def test_topk_repeated_rows(spark):
    rows = [(5, [1.0]), (5, [1.0]), (10, [2.0]), (10, [2.0]), (11, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in vector_topk.vector_topk(frame, frame.where("vec_id % 5 = 0"), k=3).collect())
    assert got == [(5, 1, 10), (5, 2, 10), (5, 3, 11), (10, 1, 5), (10, 2, 5), (10, 3, 11)]


def test_language_id(spark):
    got = {r.doc_id: r for r in queries.op10_language_id(spark, "/root/testdata/sf0.01").collect()}
    known = dict(duckdb.sql("select doc_id, lang from '/root/testdata/sf0.01/documents.parquet'").fetchall())
    assert got.keys() == known.keys() and all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    held = [d for d, r in got.items() if r.held_out]
    assert np.mean([got[d].lang_pred == known[d] for d in held]) > 0.97
    rows = [(1, None, "a", "s", 0), (2, "12 ?!", "a", "s", 0), (3, "wort", None, "s", 0), (4, "mot", "b", "s", 0), (None, "mot", None, None, 0), (6, "中文", "zh", "s", 0), (6, "中文", "zh", "s", 0), (7, "“…”", "zh", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    out = language_id.identify_languages(docs, language_id.fold()).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert [r.lang_pred == "und" for r in out] == [True, True, False, False, False, False, False, True]
    assert {r.lang_pred for r in language_id.identify_languages(docs.where("doc_id = 1"), language_id.fold()).collect()} == {"und"}
    assert language_id.identify_languages(docs.limit(0), language_id.fold()).count() == 0


def test_quality(spark):
    rng = random.Random(6)
    good = [sentence(rng, 60) for _ in range(300)]
    bad = [" | ".join(sentence(rng, 40).split()) for _ in range(150)]
    toxic = [f"{sentence(rng, 30)} vile rotten {sentence(rng, 30)}" for _ in range(150)]
    texts = good + bad + toxic
    docs = spark.createDataFrame([(i, t, "en", "s", 1, *CLASH_VALUES) for i, t in enumerate(texts)] + [(900, None, None, None, None, *CLASH_VALUES), (901, "", None, None, 0, *CLASH_VALUES)], DOCS + CLASHING)
    truth = {i: 2 if i < 300 else 1 if i < 450 else 0 for i in range(600)}
    labels = [(i, int(g != 1), int(g == 0)) for i, g in truth.items() if i % 3] + [(None, 1, 0), (5, None, None), (0, 1, None)]
    model = quality.fit_quality(docs, quality.grades(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), 3)
    got = {r.doc_id: r for r in quality.score_quality(docs, model, 3).collect()}
    assert len(got) == 602 and got[3].key == 1 and isinstance(got[3].expected_grade, float)
    new = [i for i in truth if i % 3 == 0]
    assert np.mean([(got[i].p_at_least_2 >= 0.5) == (truth[i] == 2) for i in new]) > 0.95
    assert np.mean([abs(got[i].expected_grade - truth[i]) < 0.7 for i in new]) > 0.9
    assert all(r.p_at_least_1 >= r.p_at_least_2 for r in got.values()) and got[900].p_at_least_2 == got[901].p_at_least_2
    none = quality.score_quality(docs, quality.fit_quality(docs, quality.grades(spark.createDataFrame([], "doc_id long, quality int, toxic int")), 3), 3)
    assert none.count() == 602 and none.where("expected_grade is not null").count() == 0


def test_quality_of_odd_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score_quality(docs, quality.fit_quality(docs, quality.grades(none), 3), 3).count() == 0
    one = spark.createDataFrame([(1, 1, 0)], none.schema)
    docs = spark.createDataFrame([(1, "a b", "en", "s", 0)] * 3 + [(2, "c", "en", "s", 0)] * 2, DOCS)
    got = quality.score_quality(docs, quality.fit_quality(docs, quality.grades(one), 3), 3).collect()
    assert len(got) == 5 and len({(r.doc_id, r.expected_grade) for r in got}) == 2
    assert quality.score_quality(docs.limit(0), quality.fit_quality(docs, quality.grades(one), 3), 3).count() == 0


def test_quality_sample_is_the_same_in_every_run(spark, monkeypatch):
    """More ratings than the sample holds, and fewer than twice the expected number."""
    monkeypatch.setattr(quality, "SAMPLE", 40)
    monkeypatch.setattr(quality, "SAMPLE_MOST", 50)
    rng = random.Random(15)
    docs = spark.createDataFrame([(i, sentence(rng, 20), "en", "s", 0) for i in range(70)], DOCS)
    labels = quality.grades(spark.createDataFrame([(i, i % 2, 0) for i in range(70)], "doc_id long, quality int, toxic int"))
    one, two = (quality.fit_quality(docs.repartition(n), labels.repartition(n), 3) for n in (2, 7))
    assert (one["w"] == two["w"]).all() and (one["cut"] == two["cut"]).all()


def test_quality_gradient_and_score():
    """The gradient against differences, and a text's score as the plain sum of its distinct features' weights."""
    rng = np.random.default_rng(3)
    z, y, cut = rng.normal(size=9), rng.integers(0, 4, 9), np.array([-1.0, 0.2, 1.5])

    def loss(z, cut):
        tail = np.concatenate([np.ones((9, 1)), 1 / (1 + np.exp(cut[None, :] - z[:, None])), np.zeros((9, 1))], axis=1)
        return -np.log(tail[np.arange(9), y] - tail[np.arange(9), y + 1])

    by_score, by_cut = quality._gradient(z, y, cut)
    for i in range(9):
        step = np.eye(9)[i] * 1e-6
        assert abs((loss(z + step, cut) - loss(z - step, cut))[i] / 2e-6 - by_score[i]) < 1e-5
    for k in range(3):
        step = np.eye(3)[k] * 1e-6
        assert np.allclose((loss(z, cut + step) - loss(z, cut - step)) / 2e-6, by_cut[:, k], atol=1e-5)
    texts = pa.array([r[1] or "" for r in corpus()])
    model = {"w": rng.normal(size=1 << quality.BITS).astype(np.float32), "cut": np.array([-2.0, 1.0])}
    got = quality.tails(model, texts)
    for i, t in enumerate(texts.to_pylist()):
        own, at = quality.features(pa.array([t]))
        assert len(set(own.tolist())) == len(own) == at[1]
        score = sum(float(model["w"][k]) for k in own)
        assert np.allclose(got[i], [1 / (1 + np.exp(c - score)) for c in model["cut"]], atol=1e-6)


def test_language_scores_are_averages():
    """A table of scores per subword gives what averaging embeddings, then the linear layer, would."""
    rng = np.random.default_rng(4)
    emb, out = rng.normal(size=(2 << language_id.BITS, 3)), rng.normal(size=(3, 4))
    texts = ["Un mot", "", "12 3", "eine längere Zeile", "x"]
    rows, at = language_id.subwords(pa.array(texts))
    got = language_id.logits(emb @ out, rows, at)
    for i, t in enumerate(texts):
        own, _ = language_id.subwords(pa.array([t]))
        want = emb[own].mean(axis=0) @ out if len(own) else np.zeros(4)
        assert np.allclose(got[i], want)
    assert np.diff(at)[1] == np.diff(at)[2] == 0 and np.diff(at)[0] > 0


def test_subwords_of_small_slices(monkeypatch):
    texts = pa.array([r[1] or "" for r in corpus()])
    want = language_id.subwords(texts)
    for size in (1, 300, 1 << 20):
        monkeypatch.setattr(language_id, "SMALL_SLICE", size)
        for x, y in zip(language_id._sliced(texts.cast(pa.large_string())), want, strict=True):
            np.testing.assert_array_equal(x, y)


def test_language_id_learns_from_rows_of_one_doc_id(spark, monkeypatch):
    monkeypatch.setattr(language_id, "PER_LANG", 20)
    rows = [(7, f"{a} {b} {i}", lang, None, 0) for lang, a, b in (("x", "wolo", "bano"), ("y", "trisk", "ferk")) for i in range(200)]
    rows += [(7, "wolo bano", "x", None, 0)] * 500
    sampled = []
    monkeypatch.setattr(language_id, "_fit", lambda batches: iter([pa.RecordBatch.from_arrays([pa.array([str(sum(b.num_rows for b in batches)).encode()], pa.binary())], names=["model"])]))
    monkeypatch.setattr("pickle.loads", lambda b: sampled.append(int(b)))
    language_id.identify_languages(spark.createDataFrame(rows, DOCS), queries.fold())
    assert 0 < sampled[0] < 4 * 20


def test_language_id_of_many_languages_and_clashes(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGS_BROADCAST", 2)
    rng = random.Random(16)
    tongues = {f"l{k}": [sentence(rng, 1) + chr(97 + k) * 3 for _ in range(30)] for k in range(5)}
    rows = [(i, " ".join(rng.choices(tongues[f"l{i % 5}"], k=30)), f"l{i % 5}", "s", 0, *CLASH_VALUES) for i in range(400)]
    rows.append((1000, "mot " * 200_000, "l1", "s", 0, *CLASH_VALUES))
    got = language_id.identify_languages(spark.createDataFrame(rows, DOCS + CLASHING), language_id.fold()).collect()
    assert len(got) == 401 and np.mean([r.lang_pred == f"l{r.doc_id % 5}" for r in got if r.held_out]) > 0.97


def weighted_leaks(docs, items):
    """All windows against all items, without fingerprints."""
    lower = lambda t: [w for w in words(t)]
    sets = {}
    for i, t in items:
        w = lower((t or "").lower())
        n = min(5, len(w))
        if w:
            sets[i] = (len(w), n, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)})
    df: dict = {}
    for _, _, s in sets.values():
        for x in s:
            df[x] = df.get(x, 0) + 1
    weight = lambda s: sum(1 + np.log(len(sets) / df.get(x, 1)) for x in s)
    found = {}
    for d, t in docs:
        w = lower((t or "").lower())
        for i, (size, n, s) in sets.items():
            for k in range(max(1, len(w) - size + 1)):
                own = {tuple(w[j : j + n]) for j in range(k, min(k + size, len(w)) - n + 1)}
                both = weight(own & s)
                value = both / (weight(own) + weight(s) - both)
                if value >= 0.8 - 1e-12 and value > found.get((d, i), (0, 0))[0]:
                    found[d, i] = (value, k)
    return found


def test_decontamination(spark):
    rng = random.Random(7)
    items = [(i, sentence(rng, rng.randint(15, 45))) for i in range(30)] + [(50, None), (51, ""), (52, "short one"), (53, "q")]
    docs = []
    for d in range(120):
        w = sentence(rng, 60).split()
        if d % 3:
            own = items[rng.randrange(30)][1].split()
            for _ in range(d % 3 - 1):
                own[rng.randrange(4) * (len(own) - 1) // 3] = "edited"
            at = rng.randrange(len(w))
            w[at:at] = own
        docs.append((d, " ".join(w).capitalize()))
    docs += [(200, None), (201, ""), (202, "A Short One here"), (203, items[0][1]), (203, items[0][1])]
    docs += [(210 + i, items[i][1].rsplit(" ", 1)[0]) for i in range(20)]  # shorter than the item
    docs += [(240, "x y " * 9000 + items[4][1] + " " + items[4][1]), (241, "z " * 50)]
    items += [(60, "z z z z z z"), (61, "x y x y x y x y x z")]
    frame = spark.createDataFrame([(d, t, "en", "s", 0, *CLASH_VALUES) for d, t in docs], DOCS + CLASHING)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in decontaminate.find_leaks(frame, bench).collect()}
    want = weighted_leaks(docs, items)
    assert got.keys() == want.keys() and len(want) > 50
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)
    clean = decontaminate.clean_documents(frame, bench)
    assert clean.columns == frame.columns and {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontaminate.find_leaks(frame, bench.limit(0)).count() == decontaminate.find_leaks(frame.limit(0), bench).count() == 0


def test_decontamination_of_items_with_a_template():
    """Many common shingles and a few rare ones, of which most differ: similar, whatever a fingerprint says."""
    rng = random.Random(12)
    template = sentence(rng, 160)
    tails = [[f"t{i}x{k}" for k in range(5)] for i in range(300)]
    docs = [f"{template} {' '.join(t[:2])} d{i} e{i} f{i}" for i, t in enumerate(tails)]
    common, rare = 156, 1 + np.log(300)
    value = (common + 2 * rare) / (common + 8 * rare)
    assert 0.8 < value < 0.82
    got = decontaminate.Benchmark(list(range(300)), [f"{template} {' '.join(t)}" for t in tails]).leaks(pa.array(docs))
    assert [r[:3] for r in got] == [(i, i, 0) for i in range(300)] and all(abs(r[4] - value) < 1e-9 for r in got)


def test_recall_by_similarity():
    """Pairs just above 0.8, of equal and of very unequal weights: none is lost."""
    rng = np.random.default_rng(20)
    b = decontaminate.Benchmark([0], ["q"])
    lost = pairs = 0
    for spread in (0.0, 1.0, 2.5):
        for _ in range(300):
            h = rng.integers(0, 2**63, 60, dtype=np.uint64)
            w = np.exp(spread * rng.normal(size=60))
            b.known, b.weight = np.sort(h), w
            k, only = 1, np.flatnonzero(rng.random(60) < 0.25)
            while len(only) > k and (kept := w.sum() - w[only[k:]].sum()) / w.sum() < 0.8:
                k += 1
            kept = np.delete(np.arange(60), only[k:])
            if 0.8 <= w[kept].sum() / w.sum() < 0.86:
                x, y = (b._fingerprint(np.sort(h)[i]) for i in (np.arange(60), kept))
                pairs += 1
                lost += int(np.bitwise_count(x ^ y).sum()) > decontaminate.RADIUS
    assert pairs > 200 and lost == 0


def test_decontamination_in_shards(spark, monkeypatch):
    """Shards of the benchmark give the rows, and similarities, of one."""
    rng = random.Random(13)
    template = sentence(rng, 14)
    items = [(i, f"{template} {sentence(rng, 8)}") for i in range(15)] + [(50, None), (51, "")]
    docs = spark.createDataFrame([(i, t.rsplit(" ", 1)[0] + " x", "en", "s", 0) for i, t in items[:15]] + [(40, items[3][1], "en", "s", 0)], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for size in (20_000, 5):
        monkeypatch.setattr(decontaminate, "SHARD", size)
        rows.append(sorted(tuple(r) for r in decontaminate.find_leaks(docs, bench).collect()))
    assert len(rows[0]) > 0 and [r[:4] for r in rows[0]] == [r[:4] for r in rows[1]]
    assert all(abs(x[4] - y[4]) < 1e-9 for x, y in zip(*rows, strict=True))


def test_hamming_index(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(decontaminate, "PAIRS", 3000)
    stored = rng.integers(0, 2**63, (200, 4), dtype=np.uint64)
    flips = np.packbits(rng.random((300, 256)) < rng.uniform(0.1, 0.4, (300, 1)), axis=1).view(np.uint64)
    query = stored[rng.integers(0, 200, 300)] ^ flips
    q, s = decontaminate.HammingIndex(stored).query(query)
    near = np.bitwise_count(query[:, None] ^ stored[None, :]).sum(axis=2) <= decontaminate.RADIUS
    assert 50 < near.sum() < 299
    assert set(zip(q.tolist(), s.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))


def test_warc_audit(spark, monkeypatch):
    monkeypatch.setattr(warc_audit, "FAN", 3)
    pages = [(i, f"http://h/{i}", "<p>é" * (i % 7)) for i in range(100)] + [(None, None, None), (7, "again", "x"), (7, "again", "x")]
    records = warc_audit.warc_records(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, offset int"))
    archive = warc_audit.in_order(records).collect()
    assert [r.pos for r in sorted(archive, key=lambda r: r.offset)] == list(range(len(pages)))
    body = b"".join(bytes(r.record) for r in sorted(archive, key=lambda r: r.pos))
    assert all(body[r.offset : r.offset + r.n_bytes] == bytes(r.record) for r in archive)
    assert all(len(html) == int(n) for n, html in re.findall(rb"Content-Length: (\d+)\r\n\r\n(.*?)\r\n\r\n(?=WARC|$)", body, re.DOTALL))
    one = spark.createDataFrame(archive)
    bad = {3, 50, 51, 99}
    two = spark.createDataFrame([(r.pos, r.offset, bytearray(bytes(r.record)[:-1] + b"?") if r.pos in bad else r.record) for r in archive], "pos long, offset long, record binary")
    a = warc_audit.merkle_tree(warc_audit.leaves(one))
    assert {(r.idx, r.kind) for r in warc_audit.audit(a, warc_audit.merkle_tree(warc_audit.leaves(two))).collect()} == {(i, "changed") for i in bad}
    assert warc_audit.audit(a, a).count() == 0
    short = warc_audit.merkle_tree(warc_audit.leaves(one.where("pos < 20")))
    assert {(r.idx, r.kind) for r in warc_audit.audit(a, short).collect()} == {(i, "missing") for i in range(20, len(pages))}
    none = warc_audit.in_order(records.limit(0))
    assert none.count() == 0 and len(warc_audit.merkle_tree(warc_audit.leaves(none))) == 1


def test_order_of_odd_ids(spark):
    """Sparse ids, null ones, and one id on most rows: dealt to several tasks, in order."""
    rng = random.Random(21)
    rows = [(rng.randrange(-(2**62), 2**62), rng.randrange(9), "a") for _ in range(500)] + [(None, 3, "n")] * 300 + [(5, 2, str(i % 50)) for i in range(1500)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "page_id long, n_bytes long, digest string")
    got = sorted(_ordered.with_offsets(frame, "page_id", "n_bytes", "digest").collect(), key=lambda r: r.pos)
    assert [r.pos for r in got] == list(range(len(rows)))
    assert [(r.page_id, r.n_bytes, r.digest) for r in got] != rows
    assert [(r.page_id, r.digest) for r in got] == [(r[0], r[2]) for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))]
    assert [r.offset for r in got] == np.cumsum([0, *(r.n_bytes for r in got)])[:-1].tolist()


def test_fit_budget():
    rng = random.Random(8)
    for _ in range(50):
        sizes = np.array(sorted(rng.sample(range(0, 60), rng.randint(1, 8))))
        counts = np.array([rng.randint(1, 5) for _ in sizes])
        total = int((sizes * counts).sum())
        budget = rng.uniform(0, total + 1)
        reach = {0}
        for s, c in zip(sizes.tolist(), counts.tolist(), strict=True):
            for _ in range(c):
                reach |= {x + s for x in reach}
        took = source_mix.fit_budget(sizes, counts, budget)
        assert (took <= counts).all() and (took >= 0).all()
        assert abs((sizes * took).sum() - budget) <= min(abs(x - budget) for x in reach) + max(sizes.min(), 1)


def test_fit_budget_of_books(monkeypatch):
    """Documents longer than the dynamic programme spans at least."""
    assert source_mix.fit_budget(np.array([30000]), np.array([1]), 29000).tolist() == [1]
    assert source_mix.fit_budget(np.array([30000]), np.array([1]), 14000).tolist() == [0]
    rng = random.Random(14)
    for _ in range(30):
        sizes = np.array(sorted(rng.sample(range(20_000, 200_000), rng.randint(1, 4))))
        counts = np.array([rng.randint(1, 3) for _ in sizes])
        budget = rng.uniform(0, min(2 * sizes.max(), (sizes * counts).sum()))
        reach = {0}
        for s, c in zip(sizes.tolist(), counts.tolist(), strict=True):
            for _ in range(c):
                reach |= {x + s for x in reach}
        took = source_mix.fit_budget(sizes, counts, budget)
        assert (took <= counts).all() and (took >= 0).all()
        assert abs((sizes * took).sum() - budget) <= min(abs(x - budget) for x in reach) + 1
    monkeypatch.setattr(source_mix, "BITS", 0)  # too many sizes for a longer span
    assert source_mix.fit_budget(np.array([30000]), np.array([1]), 29000).tolist() == [1]
    assert source_mix.fit_budget(np.array([10, 30000]), np.array([2, 1]), 30019).tolist() == [2, 1]


def test_source_mix(spark):
    rows = corpus() + [(9000 + i, "w " * 10, "en", "big", 0) for i in range(500)]
    docs = spark.createDataFrame([(*r, *CLASH_VALUES) for r in rows], DOCS + CLASHING)
    got = source_mix.mix_sources(docs).collect()
    assert len(got) == len(rows) and all(r.mix_size == len(words(r.text)) and r.row == "r" for r in got)
    again = source_mix.mix_sources(docs.repartition(9)).collect()
    pick = lambda rows: sorted((r.doc_id, r.mix_copies) for r in rows)
    assert pick(got) == pick(again)
    sizes: dict = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.mix_size
        assert 0 <= r.mix_taken <= 3 * r.mix_size and r.mix_taken == r.mix_copies * r.mix_size
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    share, free, left = dict.fromkeys(order, 0.0), list(order), float(sum(sizes.values()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    while True:  # what is over a cap is shared anew
        part = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if part[s] > 3 * sizes[s]]
        if not over:
            share.update(part)
            break
        for s in over:
            share[s] = 3.0 * sizes[s]
            left -= share[s]
            free.remove(s)
    for s in order:
        own = [r for r in got if r.source == s]
        assert abs(own[0].mix_target - share[s]) < 1e-6 and own[0].mix_source_size == sizes[s]
        assert abs(sum(r.mix_taken for r in own) - share[s]) <= 10
    tied = [(7, f"{chr(97 + i % 26) * (1 + i // 26)} b", "en", "s1", 0) for i in range(200)] + [(8, "w " * 600, "en", "s2", 0)]
    tied = spark.createDataFrame(tied, DOCS)  # equal ids, sources and sizes, other texts
    one, two = (sorted((r.text, r.mix_copies) for r in source_mix.mix_sources(tied.repartition(n)).collect()) for n in (1, 7))
    assert one == two and len({c for _, c in one}) > 1
    out = source_mix.expand(source_mix.mix_sources(docs)).collect()
    assert len(out) == sum(r.mix_copies for r in got)
    assert source_mix.mix_sources(docs.limit(0)).count() == 0


def test_pipeline_stages(spark, tmp_path):
    rows = [r for r in corpus()] + [(None, "no id at all", "en", "s1", 3)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    leak = next(r for r in rows if r[0] == 33)[1]
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert [f.name for f in docs.schema.fields] == [c.split()[0] for c in DOCS.split(", ")]
        kept[name] = [tuple(r) for r in docs.collect()]
    assert sorted(map(str, kept["quality"])) == sorted(map(str, rows))  # without ratings nothing is rejected
    first = {d for d, (_, c) in components([r for r in rows if r[0] is not None]).items() if c == d}
    assert sorted(r[0] for r in kept["near_duplicates"] if r[0] is not None) == sorted(first)
    leaks = {d for d, _ in weighted_leaks([(r[0], r[1]) for r in kept["near_duplicates"]], [(1, leak)])}
    assert sorted(str(r[0]) for r in kept["decontamination"]) == sorted(str(r[0]) for r in kept["near_duplicates"] if r[0] not in leaks) and len(leaks) > 10
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["source_mix"])


def test_pipeline_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "an item")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_keeps_clashing_columns(spark, tmp_path):
    """Columns named as outputs keep their values; of rows alike in id and text the first by its other columns stays."""
    more = ", expected_grade double, p_at_least_2 double, mix_copies string, row string, id string"
    rng = random.Random(17)
    rows = [(i, sentence(rng, 30), "en", "s", i, 42.0, 0.5, "m", "r", "i") for i in range(30)]
    rows += [(5, rows[5][1], "en", source, 5, 42.0, 0.5, "m", "r", "i") for source in ("t", "a", None)]
    spark.createDataFrame(rows, DOCS + more).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names and {r[5:] for r in map(tuple, docs.collect())} == {(42.0, 0.5, "m", "r", "i")}
        if name == "near_duplicates":
            assert sorted(r.doc_id for r in docs.collect()) == list(range(30))
            assert [r.source for r in docs.where("doc_id = 5").collect()] == ["a"]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.SQL[name]).df()
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want[names].itertuples(index=False, name=None))
