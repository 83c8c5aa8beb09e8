"""N-gram join, substring dedup and components against brute force."""

import random

import pytest
from helpers import CLASH_VALUES, CLASHING, DOCS, components, corpus, dedup, sentence, shingles, words

from stillwater.llm import _components, ngram_join, substring_dedup
from stillwater.llm._automaton import SuffixAutomaton


@pytest.fixture(params=["production", "hot"])
def hot(request, monkeypatch):
    """With small limits, buckets are hot, lists are heavy and graphs take several tasks."""
    if request.param == "hot":
        monkeypatch.setattr(ngram_join, "HOT", 3)
        monkeypatch.setattr(substring_dedup, "HOT", 3)
        monkeypatch.setattr(substring_dedup, "SHARD", 50)
        monkeypatch.setattr(_components, "TASK_EDGES", 7)


def test_components_of_documents(spark, hot):
    rows = corpus()
    docs = spark.createDataFrame([*((*r, *CLASH_VALUES) for r in rows), (None, rows[0][1], None, None, None, *CLASH_VALUES)], DOCS + CLASHING)
    want = components(rows)
    got = ngram_join.ngram_components(docs).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] if r.doc_id is not None else r.component_id is None


def test_number_of_links(spark, hot, request, monkeypatch):
    """All pairs, also those inside groups of near copies, in one block of a component and in many."""
    if "hot" in request.node.name:
        monkeypatch.setattr(ngram_join, "BLOCK", 4)
        monkeypatch.setattr(ngram_join, "COLUMNS", 50)
        monkeypatch.setattr(ngram_join, "PAIRS", 100)
    rows = corpus()
    sets = [shingles(r[1]) for r in rows]
    want: dict = {}
    for i, x in enumerate(sets):
        want[rows[i][0]] = sum(i != j and len(x) > 0 and 100 * len(x & y) >= 80 * len(x | y) for j, y in enumerate(sets))
    docs = spark.createDataFrame([*((*r, *CLASH_VALUES) for r in rows), (None, rows[0][1], None, None, None, *CLASH_VALUES)], DOCS + CLASHING)
    got = ngram_join.ngram_components(docs, links=True).collect()
    assert len(got) == len(rows) + 1 and max(want.values()) > 20
    for r in got:
        assert r.n_links == (want[r.doc_id] if r.doc_id is not None else 0)
    assert ngram_join.ngram_components(docs.limit(0), links=True).count() == 0


def test_no_documents(spark):
    empty = spark.createDataFrame([], DOCS)
    assert ngram_join.ngram_components(empty).count() == 0
    assert substring_dedup.deduplicate(empty, digest=True).count() == 0


def test_repeated_passages(spark, hot):
    rows = corpus()
    docs = spark.createDataFrame([*((*r, *CLASH_VALUES) for r in rows), (None, rows[0][1], None, None, None, *CLASH_VALUES)], DOCS + CLASHING)
    want = dedup(rows)
    got = substring_dedup.deduplicate(docs, digest=True).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] if r.doc_id is not None else r.n_removed == 0
    whole = {r.doc_id: r for r in substring_dedup.deduplicate(docs).collect()}
    for d, t, *_ in rows:
        assert len(words(whole[d].text)) == want[d][0] - want[d][1] and whole[d].key == 1
        assert want[d][1] or whole[d].text == t


def test_shared_ids(spark):
    """Rows that share a doc_id don't remove from each other."""
    text = " ".join(map(str, range(40)))
    rows = [(1, text, "en", "s", 0), (1, text + " x", "en", "s", 0), (2, text, "en", "s", 0)]
    got = sorted((r.doc_id, r.n_removed) for r in substring_dedup.deduplicate(spark.createDataFrame(rows, DOCS), digest=True).collect())
    assert got == [(1, 0), (1, 0), (2, 40)]


def test_automaton():
    rng = random.Random(2)
    for _ in range(60):
        texts = [[rng.randrange(3) for _ in range(rng.randint(0, 25))] for _ in range(rng.randint(1, 5))]
        a = SuffixAutomaton()
        for label, t in enumerate(texts):
            a.add(t, 10 - label)
        a.close()
        query = [rng.randrange(3) for _ in range(30)]
        for size in (1, 3, 5):
            want = []
            for i in range(len(query) - size + 1):
                w = query[i : i + size]
                found = [10 - k for k, t in enumerate(texts) if any(t[j : j + size] == w for j in range(len(t) - size + 1))]
                want.append(min(found, default=None))
            assert a.windows(query, size) == want


def test_connected_components(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    for limit in (10, 10**6):
        monkeypatch.setattr(_components, "TASK_EDGES", limit)
        got = {r.node: r.root for r in _components.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
        assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_links_at_the_threshold(spark):
    """Every number of replaced words around 0.8, in pairs whose shared n-grams fall into many groups."""
    rng, rows = random.Random(9), []
    for i in range(240):
        w = sentence(rng, rng.randint(20, 160)).split()
        rows.append((2 * i, " ".join(w), "en", "s", 0))
        k = round(len(w) * rng.uniform(0.08, 0.14))
        rows.append((2 * i + 1, " ".join(w[:-k] + sentence(rng, k).split()), "en", "s", 0))
    want = {}
    for a, b in zip(rows[::2], rows[1::2], strict=True):
        want |= components([a, b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == want and 60 < sum(d != c for d, (_, c) in want.items()) < 220
