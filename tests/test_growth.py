"""What moves and what a task holds grows no faster than the input."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from tidemark.operators import edits, planning, relations, rename

EDGE = "node long, reached long"


def moved(spark, work):
    """Rows that ``work`` shuffles."""
    context = spark.sparkContext
    java = context._gateway

    def so_far():
        stages = context._jsc.sc().statusStore().stageList(None, False, False, java.new_array(java.jvm.double, 0), java.jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = so_far()
    result = work()
    return result, so_far() - before


def reach(edges):
    ends, out = {}, set()
    for a, b in edges:
        ends.setdefault(a, set()).add(b)
    for a in ends:
        seen, todo = set(), list(ends[a])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += ends.get(x, ())
        out |= {(a, x) for x in seen}
    return out


def test_a_closure_moves_no_more_rows_than_edges(spark):
    """By pairs, those between would be made once for each node that lies between."""
    edges = spark.range(1, 3000).selectExpr("id as node", "explode(array(id div 2, id div 3)) as reached").where("reached > 0")
    n, rows = moved(spark, lambda: planning.closure(edges).count())
    assert n > 60_000 and rows < n


def test_plans_of_pairs_take_few_jobs(spark):
    """Cycles below cycles were settled one after the other, with a walk over all of them each time."""
    context = spark.sparkContext
    nodes = spark.range(2, 64).withColumnRenamed("id", "node")
    # A node and the one after it depend on each other, and the pair on another pair.
    edges = nodes.selectExpr("node", "explode(array(node + if(node % 2 = 0, 1, -1), (node div 4) * 2)) as reached")
    context.setJobGroup("plans", "")
    found = {tuple(r) for r in planning.plan_order(nodes, edges).collect()}
    context.setLocalProperty("spark.jobGroup.id", None)
    level = lambda pair: 0 if pair == 1 else level(pair // 2) + 1
    assert found == {(n, n // 2 * 2, level(n // 2), 1 + (n > 3)) for n in range(2, 64)}
    assert len(context.statusTracker().getJobIdsForGroup("plans")) < 110


@pytest.mark.parametrize("seed", range(3))
def test_components_of_pairs_chains_and_cycles(spark, seed):
    draw = random.Random(seed)
    edges = [e for k in range(9) for e in ((k, k + 1), (k + 1, k))]  # each depends on the next, and the other way
    edges += [(20, 21), (21, 22), (22, 20), (22, 21), (30, 20), (9, 30)]  # one of two inside one of three
    edges += [(40 + k, 40 + (k + 1) % 6) for k in range(6)] + [(45, 0), (46, 45)]
    names = draw.sample(range(100), 50)  # so that the least stands anywhere
    edges = [(names[a], names[b]) for a, b in edges] + [(draw.randrange(100, 130), draw.randrange(100, 130)) for _ in range(40)]
    nodes = {x for e in edges for x in e} | {999}
    found = dict(tuple(r) for r in planning.components(spark.createDataFrame([(x,) for x in nodes], "node long"), spark.createDataFrame(edges, EDGE)).collect())
    far = reach(edges)
    assert found == {n: min([n, *(m for m in nodes if (n, m) in far and (m, n) in far)]) for n in nodes}


@pytest.mark.parametrize("largest", [3, planning.SET])
def test_closures_of_cycles_chains_and_large_sets(spark, largest):
    draw = random.Random(5)
    edges = [(k, k + 1) for k in range(70)]  # a chain
    edges += [(200 + k, 200 + (k + 1) % 5) for k in range(5)] + [(204, 300), (300, 301), (310, 200), (311, 310), (320, 320)]  # a cycle, before and behind it
    edges += [(400, k) for k in range(401, 421)] + [(a, b) for a, b in ((draw.randrange(500, 540), draw.randrange(500, 540)) for _ in range(60)) if a < b]
    edges += edges[:9] + [(600, k) for k in (0, 204, 400, 500)]
    found = [tuple(r) for r in planning.closure(spark.createDataFrame(edges, EDGE), largest=largest).collect()]
    assert len(found) == len(set(found)) and set(found) == reach(edges)


def test_no_edges_reach_nothing(spark):
    assert planning.closure(spark.createDataFrame([], EDGE)).count() == 0


def test_hotspots_move_no_pairs(spark):
    edges = spark.range(1, 3000).selectExpr("id as node", "explode(array(id div 2, id div 3)) as reached").where("reached > 0")
    nodes = spark.range(1, 3000).selectExpr("id as node", "id % 7 as score")
    n, rows = moved(spark, lambda: len(planning.hotspots(nodes, edges).collect()))
    assert n == 2999 and rows < 60 * n


def test_edits_hold_a_few_texts_at_once():
    edit = {"id": 1, "byte_start": 0, "byte_end": 1, "matched_source": "a", "fix_template": '{"type": "string_replace", "old": "a", "new": "b"}'}
    batch = pa.RecordBatch.from_pylist([{"file_path": str(k), "text": "a" + "x" * 100_000, "edits": [edit]} for k in range(400)])
    tracemalloc.start()
    sizes = [b.num_rows for b in edits._applied_batches(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 400 and peak < 12_000_000


def test_owners_of_a_large_folder_come_in_blocks(spark):
    paths = ["a.php", "/x", "m", "m/0/s", "m/0/s/1.php", "m/1/2.php", "n/3.php", "m/0/s/1.php", None]
    folders = [("m", "root"), ("m", "other"), ("m/0", "o0"), ("m/0/s/1.php", "self"), ("", "top"), ("n", None)]
    files = spark.createDataFrame([(p,) for p in paths], "file_path string")
    frame = relations.owner_of(files, spark.createDataFrame(folders, "folder string, owner string"))
    assert sorted((r.file_path, r.owner or "-") for r in frame.collect()) == [("/x", "top"), ("m", "root"), ("m/0/s", "o0"), ("m/0/s/1.php", "self"), ("m/1/2.php", "root"), ("n/3.php", "-")]
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "block" in plan


def test_project_files_move_once(spark):
    """As the numbers that they are made of; the texts were dealt out a second time."""
    from tidemark.sources import snapshots

    plan = snapshots.project_files(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_tokens_stand_where_their_lengths_tell():
    """White space, lone quotes, heredocs and what no kind begins with are counted, so that places stay right."""
    from tidemark.operators.php import tokens

    text = "x ?> <?php\u00a0$a='b' . \u00e9\\f(1.5, $$ \\) # c\n/** d */ <<<A\n\u00df\nA; \u0663 ?->g \u203f \"e\\"
    kinds = [(kind, t) for kind, _, _, t in tokens(text)]
    assert all(text[a:b] == t for _, a, b, t in tokens(text))
    assert kinds == [
        ("var", "$a"), ("op", "="), ("string", "'b'"), ("op", "."), ("name", "\u00e9\\f"), ("op", "("), ("number", "1.5"), ("op", ","), ("op", "$"), ("op", "$"), ("op", "\\"), ("op", ")"),
        ("comment", "# c"), ("doc", "/** d */"), ("heredoc", "<<<A\n\u00df\nA"), ("op", ";"), ("number", "\u0663"), ("op", "?->"), ("name", "g"), ("op", "\u203f"), ("op", '"'), ("name", "e"), ("op", "\\"),
    ]
    assert [t[0] for t in tokens("f('")] == ["name", "op", "string"]


def test_assigned_renames_move_no_pairs(spark):
    """Each pair of copies was written and shuffled before the walk."""
    columns = "id long, language string, symbol_type string, fqn string, name string, namespace string, signature_json string, source_text string"
    copies = [[(at + k, "php", "f", f"{name}#{at + k}", name, "N", "{}", f"{name} body") for k in range(500)] for at, name in ((0, "long_name"), (1000, "long_names"))]
    gone, fresh = (spark.createDataFrame(x, columns) for x in copies)
    found, rows = moved(spark, lambda: rename.renames(gone, fresh).collect())
    assert sorted((r.old_id, r.new_id) for r in found) == [(k, 1000 + k) for k in range(500)] and rows < 20_000


@pytest.mark.parametrize("seed", range(2))
def test_renames_of_variants_are_the_walk_of_pairs(spark, seed):
    draw = random.Random(seed)
    columns = "id long, language string, symbol_type string, fqn string, name string, namespace string, signature_json string, source_text string"
    names = ["load_all", "load_alls", "load_any", "lead_all", "say", "", None]

    def some(at):
        rows = []
        for k in draw.sample(range(at, at + 200), 60):
            name = draw.choice(names)
            fqn = draw.choice([f"{name}#{k}", f"x{k % 9}", None])
            rows.append((k, "php", "f", fqn, name, draw.choice(["N", None]), draw.choice(["{}", "{}", "[]", ""]), draw.choice([f"{name} body", "other", None])))
        return spark.createDataFrame([*rows, (None,) * 8], columns)

    gone, fresh = some(0), some(1000)
    found = sorted(map(str, rename.renames(gone, fresh).collect()))
    assert found == sorted(map(str, rename.assign(rename.candidates(gone, fresh)).collect())) and len(found) > 10
    assert rename.renames(gone.limit(0), fresh).count() == 0
