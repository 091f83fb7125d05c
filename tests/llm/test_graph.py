import random

from tidemark.llm.graph import components


def test_components_against_brute_force(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)]
    edges += [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2000 + k) for k in range(1, 40)] + [(5, 5), (3000, 3000), (7, 6), (6, 7)]
    rng.shuffle(edges)
    least = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(least[a], least[b])
            if (least[a], least[b]) != (low, low):
                least[a] = least[b] = low
                changed = True
    frame = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in components(frame).collect()} == least
    assert components(frame.limit(0)).count() == 0
