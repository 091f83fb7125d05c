import hashlib
import random
from collections import Counter

import pytest

from tests.llm.helpers import docs
from tidemark.llm import suffix_dedup as sd


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + sd.LENGTH] for d in data for i in range(len(d) - sd.LENGTH + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - sd.LENGTH + 1):
            if seen[d[i : i + sd.LENGTH]] > 1:
                gone[i : i + sd.LENGTH] = b"\1" * sd.LENGTH
        kept = bytes(c for c, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 8))) for _ in range(n))


@pytest.mark.parametrize("seed, hot", [(0, sd.HOT), (1, sd.HOT), (0, 1), (2, 3)])
def test_against_brute_force(spark, seed, hot):
    rng = random.Random(seed)
    shared = [prose(rng, n) for n in (60, 90, 130, 300, 500)]
    texts = [None, "", "z" * 1500, "ab" * 900, shared[4], shared[4]]
    for _ in range(40):
        parts = [prose(rng, rng.randint(0, 80)) for _ in range(3)]
        for s in rng.sample(shared, rng.randint(0, 3)):
            cut = rng.randint(0, len(s) // 2)
            s = s[cut : len(s) - rng.randint(0, len(s) // 3)]
            if rng.random() < 0.5:
                at = rng.randrange(len(s))
                s = s[:at] + rng.choice("xyz") + s[at + 1 :]
            parts.insert(rng.randint(0, 3), s)
        texts.append(" ".join(parts))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(docs(spark, list(enumerate(texts))), hot).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(5)
    words = [bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(300)]
    entries = [sd.Suffix(w, b"", 0, False, 0, 0, k) for k, w in enumerate(words)]
    runs = [sorted(entries[k::7]) for k in range(7)]
    out = list(sd.merged([sd.decoded(sd.front_coded(r)) for r in runs]))
    assert [x.right for _, x in out] == sorted(words)
    before = b""
    for shared, x in out:
        assert shared == sd.common(before, x.right)
        before = x.right


def test_group_resolvers_agree():
    rng = random.Random(9)
    core = bytes(rng.choices(b"abc", k=101))
    group = []
    for k in range(30):
        left = bytes(rng.choices(b"ab", k=2)) + b"L" * 200
        right = core + b"R" * rng.choice([150, 200, 299]) + bytes(rng.choices(b"xy", k=3))
        right = (right + b"q" * 400)[: sd.LENGTH]
        group.append(sd.Suffix(right, left, 0, False, 0, 0, k))
    distinct = list({(x.right, x.left): x for x in group}.values())
    one = {(x.at, a, b) for x, a, b in sd._by_extension(distinct, distinct)}
    two = {(x.at, a, b) for x, a, b in sd._by_windows(distinct)}
    assert {(k, a, b) for k, a, b in one} == {(k, a, b) for k, a, b in two}
