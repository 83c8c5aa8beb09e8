"""Fixtures and brute-force versions shared by the tests of this folder."""

from __future__ import annotations

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: names that operators also use inside
CLASHING = ", key long, row string, starts array<long>, mix_size string, size long, target double, h long, part long, copies long, set_id long, expected_grade string, _id string, id string, again boolean"
CLASH_VALUES = (1, "r", [1], "m", 2, 0.5, 3, 4, 5, 6, "e", "i", "d", True)


def words(text):
    return WORD.findall(text or "")


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 4))) for _ in range(n))


def corpus(seed: int = 3) -> list[tuple]:
    """Rows of documents: copies, near copies, shared passages, nulls, empty and long texts, repeated rows."""
    rng = random.Random(seed)
    base, passage = sentence(rng, 120), sentence(rng, 60)
    texts = [base, base, base.upper(), None, "", " \t\n ", "one", "One", "a b c d", "a b c d e", "é ü ñ 中文 🙂 x", passage]
    for _ in range(40):  # near copies, all of one base
        w = base.split()
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = sentence(rng, 1)
        texts.append(" ".join(w))
    texts += [f"{sentence(rng, 40)} {passage}\n{sentence(rng, rng.randint(5, 40))}" for _ in range(45)]
    texts += [sentence(rng, rng.randint(1, 200)) for _ in range(40)]
    texts += [" ".join(["x"] * 30), "aa " * 300, sentence(rng, 9000), sentence(rng, 30) + " " + "aa " * 40]
    half = sentence(rng, 100)
    texts += [half, half[: len(half) // 2], half + " " + sentence(rng, 20), half + " " + sentence(rng, 26)]
    out = [(i * 3, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "é", None]), len(t or "")) for i, t in enumerate(texts)]
    rng.shuffle(out)
    return [*out, out[0], out[5]]  # repeated rows


def shingles(text, n=5):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(rows) -> dict[int, tuple[int, int]]:
    """doc_id: (n_shingles, component_id), by comparing all pairs."""
    sets = {d: shingles(t) for d, t, *_ in rows}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * (k := len(x & y)) >= 80 * (len(x) + len(y) - k):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), root(d)) for d in ids}


def dedup(rows, size=13) -> dict[int, tuple]:
    """doc_id: (n_words, n_removed, kept_sha256), window by window."""
    first: dict = {}
    for d, t, *_ in rows:
        w = words(t)
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(d, first.get(k, d))
    out = {}
    for d, t, *_ in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out
