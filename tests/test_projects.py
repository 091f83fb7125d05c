"""Rule files, project kinds, extension nodes, sequences by ranges and edits by pieces."""

import json
import random

from pyspark.sql import functions as F

from tidemark.operators import edits, merge, planning, rules
from tidemark.sources import files

GREP = "function_calls: {old_f: new_f}\nglobals: {user: '\\X::user()'}\nconstants: {OLD: X::NEW}\n"
FUNCTIONS = "group:\n  message: '@function is gone'\n  fixme: use @function no more\n  documentation: [{url: 'http://x/1'}]\n  functions: [f1, old_f]\nf2: {disable: true, message: off}\n"
HOOKS = "init: {message: '@hook went', delete: true}\nboot: {hook: [boot, exit], documentation: []}\n"
REWRITERS = "node:\n  type_hint: NodeInterface\n  properties:\n    nid: {get: id}\n    x: {set: setX}\nuser: {properties: {uid: {get: id, set: setId}}}\n"


def test_rule_files(spark):
    rows = [("r/a.grep.yml", GREP), ("r/a.functions.yml", FUNCTIONS), ("r/a.hooks.yml", HOOKS), ("r/a.rewriters.yml", REWRITERS), ("r/b.hooks.yml", "a: ["), ("other.yml", GREP), ("n.grep.yml", None), (None, GREP)]
    found = {(r.change_type, r.old_fqn): r for r in rules.import_rule_files(spark.createDataFrame(rows, "file_path string, text string")).collect()}
    assert set(found) == {
        ("function_call_rewrite", "old_f"), ("global_replaced", "global.$user"), ("constant_replaced", "OLD"), ("function_removed", "f1"), ("function_disabled", "f2"),
        ("hook_removed", "hook_init"), ("hook_deprecated", "hook_boot"), ("hook_deprecated", "hook_exit"), ("variable_access_replaced", "node.nid"), ("variable_access_replaced", "user.uid"),
    }
    assert found["function_removed", "f1"].migration_hint == "f1 is gone\nuse f1 no more\nSee: http://x/1" and found["hook_removed", "hook_init"].migration_hint == "hook_init went"
    node = found["variable_access_replaced", "node.nid"]
    assert (node.new_fqn, node.confidence, json.loads(node.fix_template)["getter"]) == ("NodeInterface::id()", 0.7, "id") and found["variable_access_replaced", "user.uid"].new_fqn == "id"
    assert found["hook_deprecated", "hook_boot"].severity == "deprecation" and found["global_replaced", "global.$user"].confidence == 0.9
    assert edits.rewritten("x(OLD)", found["constant_replaced", "OLD"].fix_template) == "x(X::NEW)"


def test_kinds_of_projects(spark):
    lock = json.dumps({"packages": [{"name": "a/b"}], "packages-dev": [{"name": "frame/work"}]})
    rows = [
        ("core1", "core/lib/core.php", ""), ("core2", "core/composer.json", '{"name": "x/core"}'), ("site", "sites/default/settings.php", ""), ("site", "composer.json", '{"name": "my/site"}'),
        ("site", "m.info.yml", "type: module"), ("mod", "b.info.yml", "name: 'B'\ntype: theme\n"), ("mod", "a.info.yml", "name: \"My mod\"\n type: module\n"), ("mod", "z/c.info.yml", "type: profile"),
        ("ending", "x.theme", ""), ("ending", "y.info.yml", "type: other"), ("ending", "composer.json", '{"name": "e/e"}'), ("frame", "composer.lock", lock), ("none", "a.txt", None), ("bad", "composer.lock", "{"),
    ]
    found = {r.project: (r.type, r.package_name, r.root_name) for r in files.project_metadata(spark.createDataFrame(rows, "project string, file_path string, text string"), "x/core", "frame/work").collect()}
    assert found == {
        "core1": ("core", "x/core", None), "core2": ("core", "x/core", None), "site": ("site", "my/site", None), "mod": ("module", None, "My mod"),
        "ending": ("theme", "e/e", None), "frame": ("framework", None, None), "none": (None, None, None), "bad": (None, None, None),
    }


def test_extension_nodes(spark):
    extensions = [("a", None, "module", "m/a/a.info.yml", ["b", "out"]), ("b", "Bee", "module", "m/b/b.info.yml", ["c", "c"]), ("c", None, "theme", "c.info.yml", ["a"]), ("d", None, "recipe", "r/d/recipe.yml", None)]
    groups = [("m/a", 3, 30), ("x/b", 2, 5), ("y/b", 9, 7)]
    e = spark.createDataFrame(extensions, "machine_name string, label string, extension_type string, file_path string, dependencies array<string>")
    found = {r.machine_name: r for r in planning.project_nodes(e, spark.createDataFrame(groups, "extension string, count long, score long")).collect()}
    a, b, c, d = (found[k] for k in "abcd")
    assert (a.path, a.match_count, a.score, a.dependencies, a.dependents, a.transitive_dependencies) == ("m/a", 3, 30, ["b"], ["c"], ["b", "c"])
    assert (b.label, b.path, b.match_count, b.dependencies) == ("Bee", "y/b", 9, ["c"]) and [x.extension for x in b.impact] == ["a", "c"]
    assert (c.path, c.dependency_match_count, c.dependency_score, c.hotspot_score) == ("c", 12, 37, 37)
    assert (d.path, d.dependencies, d.dependents, d.impact, d.hotspot_score) == ("r/d", [], [], [], 0)
    assert planning.project_nodes(e.limit(0), spark.createDataFrame([], "extension string, count long, score long")).count() == 0


def test_sequences_of_hot_groups(spark):
    draw = random.Random(6)
    log = [("hot", 40), ("hot", 7), (None, 3), ("b", None)]
    rows = [(k, draw.choice(["hot", "hot", "hot", "b", "c", None])) for k in range(400)]
    frame = spark.createDataFrame(rows, "k long, g string").repartition(7)
    found = {r.k: r.seq for r in merge.append_sequence(spark.createDataFrame(log, "g string, seq long"), frame.withColumn("seq", F.lit(5)), "g", "k").collect()}
    next_ = {"hot": 40, None: 3, "b": 0, "c": 0}
    for k, g in rows:
        next_[g] += 1
        assert found[k] == next_[g]
    assert len(found) == len(rows)


def slow_walk(data, found):
    """The walk over a text that is copied for each edit."""
    least, rows = len(data) + 1, []
    for m in sorted(found, key=lambda m: (-m["byte_start"], m["id"])):
        old, a, b = m["matched_source"].encode(), m["byte_start"], m["byte_end"]
        new = edits.rewritten(m["matched_source"], m["fix_template"])
        status, conflict = "failed", 0 <= a < b and b > least
        if not conflict and new is not None:
            known = a >= 0 and data[a:b] == old
            if not known:
                a = data.find(old) if old and data.count(old) == 1 else -1
            if a >= 0 and new.encode() == old:
                status = "skipped"
            elif a >= 0:
                status, data = "applied", data[:a] + new.encode() + data[a + len(old) :]
                least = a if known else least
        rows.append([m["id"], status, conflict, None])
    rows[0][3] = data.decode()
    return rows


def test_edits_by_pieces_equal_edits_one_by_one():
    draw = random.Random(11)
    for _ in range(400):
        text = "".join(draw.choice("abcdé ") for _ in range(draw.randrange(1, 40)))
        data, found = text.encode(), []
        for k in range(draw.randrange(1, 7)):
            a = draw.randrange(len(text))
            piece = text[a : a + draw.randrange(1, 5)]
            start = len(text[:a].encode())
            known = draw.random() < 0.7
            place = (start, start + len(piece.encode())) if known else draw.choice([(-1, -1), (start + 1, start + 2), (0, 1)])
            new = draw.choice([piece, "X", "long new text", ""])
            found.append({"id": k, "byte_start": place[0], "byte_end": place[1], "matched_source": piece, "fix_template": draw.choice([json.dumps({"type": "string_replace", "old": piece, "new": new})] * 4 + ["{}", None])})
        assert edits._walk(data, found) == slow_walk(data, found)


def test_calls_of_a_long_file_meet_the_symbol_before(spark):
    from tidemark.operators import reports

    draw = random.Random(12)
    row = lambda k: (k, draw.choice(["hot"] * 6 + ["b", None]), draw.randrange(200))
    symbols, calls = [row(k) for k in range(120)], [row(k + 1000) for k in range(300)]
    kind = "id long, file_path string, line_start long"
    found = {r.call_id: r.symbol_id for r in reports.attached(spark.createDataFrame(calls, kind).repartition(5), spark.createDataFrame(symbols, kind)).collect()}
    want = {c: max(((line, s) for s, g, line in symbols if g == f and line <= at), default=(0, None))[1] for c, f, at in calls}
    assert found == want
    assert reports.attached(spark.createDataFrame([], kind), spark.createDataFrame(symbols, kind)).count() == 0
