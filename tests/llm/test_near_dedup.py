import random
import re

from tests.llm.helpers import docs
from tidemark.llm import near_dedup

LOWER = {k: k + 32 for k in range(65, 91)}


def sets(texts, size):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    return out


def brute(texts, size, percent):
    s, parent = sets(texts, size), list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= percent * len(s[i] | s[j]):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return [(len(s[i]), top(i)) for i in range(len(s))]


def texts(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeÉ", k=rng.randint(1, 5)))
    out = [None, "", "  ", "one two", "ONE two", "one", "É é", "é É"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(20, 150))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy).upper() if rng.random() < 0.2 else " \n".join(copy))
    return out


def test_components_against_brute_force(spark, monkeypatch):
    for seed, blocks in ((1, 512), (2, 3)):
        monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", blocks)
        t = texts(seed)
        rows = near_dedup.near_duplicates(docs(spark, list(enumerate(t))), size=3, percent=85).collect()
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
        # upper() also changes letters beyond A-Z, in both ways of counting alike
        assert [got[k] for k in range(len(t))] == brute(t, 3, 85)
        assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_forest_in_column_chunks():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 200).astype(np.uint64)
    held = [np.unique(np.concatenate([base[k:], rng.integers(0, 1 << 60, 3).astype(np.uint64)])) for k in range(40)]
    for percent in (50, 85, 95):
        assert near_dedup.forest(list(range(40)), held, percent, cells=400) == near_dedup.forest(list(range(40)), held, percent)
