"""Queries over whole tables, against brute force."""

import re

from pyspark.sql import functions as F

from tidemark.operators import edits
from tidemark.plans import registry
from tidemark.sources import snapshots

SF = "/root/testdata/sf0.001"


def parts(tmp_path, spark):
    """A part table that reaches beyond 400, with gaps."""
    rows = [(k, f"name{k % 23}x{'y' * (k % 9)}", f"Brand#{k % 2}", "T", k % 50) for k in range(1, 700) if k % 10 in (2, 3)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    return rows


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_closures_cover_all_parts(spark, tmp_path):
    rows = parts(tmp_path, spark)
    edges = {r[0]: {r[0] // 2, r[0] // 3} - {0} for r in rows}
    sizes = {r[0]: r[4] for r in rows}

    def reach(node, seen):
        for x in edges.get(node, ()):
            if x not in seen:
                seen.add(x)
                reach(x, seen)
        return seen

    want = {n: reach(n, set()) for n in edges}
    run = lambda name: {r.node: r for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
    assert {n: r.n for n, r in run("dependency_closure").items()} == {n: len(x) for n, x in want.items() if x}
    assert {n: r.hotspot for n, r in run("hotspots").items()} == {n: sizes[n] + sum(sizes.get(x, 0) for x in want[n]) for n in want}
    plan = run("upgrade_plan")
    assert set(plan) == set(edges) and max(plan) > 400 and all(plan[n].level > plan[x].level for n in edges for x in edges[n] if x in plan)


def test_similar_names_compares_all(spark, tmp_path):
    rows = parts(tmp_path, spark)
    want = set()
    for a in rows:
        for b in rows:
            if a[2] == b[2] and (s := round(1 - distance(a[1], b[1]) / max(len(a[1]), len(b[1])), 6)) > 0.7:
                want.add((a[0], b[0] + 1000000, s))
    assert {tuple(r) for r in registry.QUERIES["similar_names"](spark, str(tmp_path)).collect()} == want and want


def test_rewrites_and_edits_cover_all_documents(spark):
    docs = snapshots.read(spark, SF, "documents").select("doc_id", "text").collect()
    assert registry.QUERIES["word_rewrite"](spark, SF).count() == len(docs)
    found = {}
    for r in registry.QUERIES["apply_edits"](spark, SF).collect():
        found.setdefault(int(r.file_path), []).append(r)
    for d in docs:
        words = list(re.finditer(r"[^ \t\n\x0b\f\r]+", d.text))[:2]
        rows = found.get(d.doc_id, [])
        assert len(rows) == len(words) and all(r.status == ("skipped" if w.group() == "X" else "applied") for r, w in zip(rows, words[::-1]))
        text = d.text
        for w in words[::-1]:
            text = text[: w.start()] + "X" + text[w.end() :]
        assert [r.new_text for r in rows if r.new_text is not None] == [text][: len(words)]


def test_word_edits_on_odd_texts(spark):
    texts = ["é two three", "  lead\n\nnext", "one", "", " ", None, "a a"]
    docs = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "file_path string, text string")
    done = edits.apply_edits(docs, registry._word_edits(docs)).where("new_text is not null").orderBy(F.col("file_path").cast("int")).collect()
    assert [r.new_text for r in done] == ["X X three", "  X\n\nX", "X", "X X"]
