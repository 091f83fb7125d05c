"""The similarity join and the plan order against brute force."""

import random

import pytest

from tests.test_whole import distance
from tidemark.operators import planning, similar


@pytest.mark.parametrize("over", [0.5, 0.62, 0.7, 0.85])
def test_no_similar_pair_is_lost(spark, over):
    draw = random.Random(int(over * 100))
    base = ["".join(draw.choice("abcé_") for _ in range(draw.randrange(16))) for _ in range(25)]

    def near(x):
        for _ in range(draw.randrange(6)):
            k = draw.randrange(len(x) + 1)
            x = draw.choice([x[:k] + draw.choice("abcé_") + x[k:], x[:k] + x[k + 1 :], x[:k] + draw.choice("xyz") + x[k + 1 :]])
        return x

    left = [(draw.choice("AB"), x) for x in base for _ in range(2)] + [("A", None), ("A", ""), (None, "abcabc")]
    right = [(b or "A", near(x or "")) for b, x in left] + [("A", "ab"), ("A", "abc")] * 2
    want = set()
    for b, x in set(left):
        for c, y in set(right):
            if b == c and b and x and y:
                s = len(x.encode()), len(y.encode())
                score = 1.0 if x == y else 0.0 if max(s) < 4 else 1 - distance(x.encode(), y.encode()) / max(s)
                if score > over:
                    want.add((b, x, y, round(score, 9)))
    a, b = (spark.createDataFrame(rows, "kind string, name string") for rows in (left, right))
    found = [tuple(r)[:3] + (round(r.score, 9),) for r in similar.similar_pairs(a, b, ["kind"], over).collect()]
    assert set(found) == want and len(found) == len(want) and len(want) > 5
    assert similar.similar_pairs(a.limit(0), b, ["kind"], over).count() == 0


def plain_plan(nodes, edges):
    edges = {(a, b) for a, b in edges if a in nodes and b in nodes}

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            for a, b in edges:
                if a == todo[-1] and b not in seen:
                    break
            else:
                todo.pop()
                continue
            seen.add(b)
            todo.append(b)
        return seen

    far = {n: reach(n) | {n} for n in nodes}
    comp = {n: min(m for m in nodes if m in far[n] and n in far[m]) for n in nodes}
    above = {(comp[a], comp[b]) for a, b in edges if comp[a] != comp[b]}

    def level(c):
        return max((1 + level(d) for x, d in above if x == c), default=0)

    return {(n, comp[n], level(comp[n]), sum(a == n for a, _ in edges)) for n in nodes}


@pytest.mark.parametrize("seed", range(4))
def test_plan_by_components(spark, seed):
    draw = random.Random(seed)
    nodes = set(range(24))
    edges = [(draw.randrange(26), draw.randrange(26)) for _ in range((20, 30, 45, 0)[seed])] + [(3, 3)] * (seed > 0) + [(5, 6)] * 2
    n = spark.createDataFrame([(x,) for x in nodes], "node long")
    e = spark.createDataFrame(edges, "node long, reached long")
    assert {tuple(r) for r in planning.plan_order(n, e).collect()} == plain_plan(nodes, edges)


def test_plan_of_nothing(spark):
    n, e = spark.createDataFrame([], "node long"), spark.createDataFrame([], "node long, reached long")
    assert planning.plan_order(n, e).count() == 0
    one = spark.createDataFrame([(1,)], "node long")
    assert [tuple(r) for r in planning.plan_order(one, e).collect()] == [(1, 1, 0, 0)]


@pytest.mark.parametrize("seed", range(2))
def test_hotspots_with_cycles(spark, seed):
    draw = random.Random(seed)
    score = {x: draw.randrange(9) for x in range(18)}
    edges = [(draw.randrange(20), draw.randrange(20)) for _ in range(26)]
    near = {x: {b for a, b in edges if a == x and b in score} for x in score}

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return seen - {x}

    n = spark.createDataFrame(list(score.items()), "node long, score long")
    found = [tuple(r) for r in planning.hotspots(n, spark.createDataFrame(edges, "node long, reached long")).collect()]
    want = [(x, s, sum(score[y] for y in reach(x)), s + sum(score[y] for y in reach(x))) for x, s in score.items()]
    assert found == sorted(want, key=lambda r: (-r[3], -r[1], r[0]))
