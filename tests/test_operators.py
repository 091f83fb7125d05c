import json
import random
import sys

import pytest
from pyspark.sql import functions as F

from tidemark.functions.classify import category, group_of_path, language, namespace_moved, risk
from tidemark.functions.similarity import similarity
from tidemark.operators import diff, edits, extract, matches, merge, planning, relations, rename, reports
from tidemark.sources import files


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_classifications(spark):
    lit = F.lit
    assert value(spark, category(lit("event_removed"))) == "Removals" and value(spark, category(lit("x_renamed"))) == "Modernization"
    assert value(spark, category(lit("inheritance_impact"))) == "Signatures" and value(spark, category(lit("sdc_x"))) == "Frontend"
    assert value(spark, category(lit(None).cast("string"))) == "Other"
    assert value(spark, language(lit("a/B.Libraries.YML"))) == "libraries" and value(spark, language(lit("x.txt"))) is None
    assert value(spark, group_of_path(lit("modules/custom/m/src/a.php"))) == "modules/custom/m" and value(spark, group_of_path(lit("src/a.php"))) == "src"
    assert value(spark, namespace_moved(lit("A\\B\\C"), lit("A\\D\\C"))) and not value(spark, namespace_moved(lit("A\\C"), lit("A\\D")))
    assert value(spark, risk(lit("service_removed"))).severity == "breaking"


def test_similarity_counts_bytes(spark):
    assert value(spark, similarity(F.lit("abcdé"), F.lit("abcde"))) == pytest.approx(1 - 2 / 6)
    assert value(spark, similarity(F.lit("abc"), F.lit("abd"))) == 0 and value(spark, similarity(F.lit(""), F.lit("x"))) == 0


def test_signature_changes(spark):
    old = json.dumps({"params": [{"name": "$a", "type": "int"}, {"name": "$b"}, {"name": "$c"}], "return_type": "x"})
    new = json.dumps({"params": [{"name": "$a", "type": "string"}, {"name": "$z"}], "return_type": None})
    found = value(spark, diff.signature_changes(F.lit(old), F.lit(new)))
    assert [(x.type, x.position, x.old, x.new) for x in found] == [
        ("parameter_type_changed", 0, "int", "string"), ("parameter_renamed", 1, "$b", "$z"), ("parameter_removed", 2, "$c", None), ("return_type_changed", None, "x", None),
    ]
    assert value(spark, diff.signature_changes(F.lit(None).cast("string"), F.lit(None).cast("string"))) == []


def test_dropped_items(spark):
    old = spark.createDataFrame([("l", ["a.css", "b.css"], ["x"])], "fqn string, css array<string>, js array<string>")
    new = spark.createDataFrame([("l", ["b.css"], None)], "fqn string, css array<string>, js array<string>")
    rows = diff.dropped_items(old, new, "fqn", {"css": "library_css_removed", "js": "library_js_removed"}).collect()
    assert sorted((r.change_type, r.item) for r in rows) == [("library_css_removed", "a.css"), ("library_js_removed", "x")]


def test_renames_are_one_to_one(spark):
    schema = "id long, language string, symbol_type string, fqn string, name string, namespace string, signature_json string, source_text string"
    gone = spark.createDataFrame([(1, "php", "function", "old_load", "old_load", "n", "s1", "f old_load()"), (2, "php", "function", "old_loads", "old_loads", "n", "s1", "f old_loads()")], schema)
    fresh = spark.createDataFrame([(9, "php", "function", "new_load", "new_load", "n", "s1", "f new_load()"), (8, "php", "class", "old_load", "old_load", "n", "s1", "x")], schema)
    rows = rename.assign(rename.candidates(gone, fresh)).collect()
    assert [(r.old_id, r.new_id) for r in rows] == [(1, 9)]


def test_rename_candidates_lose_no_pair_that_is_accepted(spark):
    """Every pair of a language and type is scored by itself; those from 0.7 on are just the candidates."""
    rng = random.Random(8)
    schema = "id long, language string, symbol_type string, fqn string, name string, namespace string, signature_json string, source_text string"
    word = lambda: "".join(rng.choices("abcé_", k=rng.randint(1, 9)))

    def rows(first):
        out = []
        for k in range(90):
            name = word()
            out.append((first + k, rng.choice(["php", "js"]), "function", f"n\\{name}", name, rng.choice(["n", "m", None]), rng.choice(["s1", "s2", "", None]), f"f {name}() {word()}"))
        return out

    gone, fresh = (spark.createDataFrame(rows(x), schema) for x in (0, 1000))
    sides = [df.select(*(F.col(c).alias(f"{s}_{c}") for c in df.columns)) for df, s in ((gone, "old"), (fresh, "new"))]
    every = sides[0].join(sides[1], F.col("old_language") == F.col("new_language")).withColumn("score", rename.score()).where("score >= 0.7")
    want = {(r.old_id, r.new_id, round(r.score, 6)) for r in every.collect()}
    assert {(r.old_id, r.new_id, round(r.score, 6)) for r in rename.candidates(gone, fresh).collect()} == want and len(want) > 5


def test_assignment_equals_the_walk(spark):
    rng = random.Random(4)
    pairs = [(o, n, rng.choice([0.5, 0.7, 0.8, 0.9])) for o in range(40) for n in range(100, 135) if rng.random() < 0.4]
    pairs += [(o, n, 0.8) for o in range(200, 230) for n in range(300, 325)]  # equal lists
    pairs += [(o, n, 0.7 + 0.01 * (n % 7)) for o in range(400, 412) for n in range(500, 500 + o % 12 + 3)]
    want, used = {}, set()
    for o, n, score in sorted(pairs, key=lambda x: (x[0], -x[2], x[1])):
        if score >= 0.6 and o not in want and n not in used:
            want[o] = n
            used.add(n)
    frame = spark.createDataFrame([(o, n, f"o{o}", f"n{n}", s, "php", "function") for o, n, s in rng.sample(pairs, len(pairs))], "old_id long, new_id long, old_fqn string, new_fqn string, score double, old_language string, old_symbol_type string")
    done = rename.assign(frame, 0.6)
    assert {r.old_id: r.new_id for r in done.collect()} == want
    assert "Pandas" not in done._jdf.queryExecution().toString()  # no block meets in one task
    assert rename.assign(frame, 2.0).count() == 0


def test_upsert_with_null_keys(spark):
    old = spark.createDataFrame([(None, "a", 1), (1, "a", 2), (2, "b", 3)], "k long, p string, v long")
    new = spark.createDataFrame([(None, "a", 10), (2, "b", 30)], "k long, p string, v long")
    assert sorted(r.v for r in merge.upsert(old, new, ["k", "p"]).collect()) == [2, 10, 30]
    assert sorted(r.v for r in merge.keep_last(old.unionByName(new), ["k", "p"], "v").collect()) == [2, 10, 30]


def test_merge_duplicates(spark):
    parents = spark.createDataFrame([(1, "/a"), (2, "/a"), (3, "/b")], "id long, path string")
    children = spark.createDataFrame([(1, 1, None), (2, 2, None), (3, 3, 5)], "id long, project_id long, change_id long")
    kept, moved = merge.merge_duplicates(parents, children, "path", "project_id", ["project_id", "change_id"])
    assert sorted(r.id for r in kept.collect()) == [2, 3] and sorted((r.id, r.project_id) for r in moved.collect()) == [(2, 2), (3, 3)]


def test_closure_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "node string, reached string")
    found = {(r.node, r.reached) for r in planning.closure(edges).collect()}
    assert {x for n, x in found if n == "d"} == {"a", "b", "c"} and ("a", "a") in found
    levels = {r.node: r.level for r in planning.plan_order(spark.createDataFrame([(x,) for x in "abcd"], "node string"), edges).collect()}
    assert levels["d"] > levels["a"] == levels["b"]


def test_text_matches(spark):
    sources = spark.createDataFrame([("a.php", "php", "x = old_load($y); Foo::bar()")], "file_path string, language string, text string")
    changes = spark.createDataFrame([(1, "php", "old_load"), (2, "php", "App\\Foo"), (3, "yaml", "old_load"), (4, "php", "load")], "id long, language string, old_fqn string")
    assert sorted(r.change_id for r in matches.text_matches(sources, changes).collect()) == [1, 2]


def test_templates():
    do = lambda source, **t: edits.rewritten(source, json.dumps(t))
    assert do("f($a, $b)", type="parameter_insert", position=1, value="NULL") == "f($a, NULL, $b)"
    assert do("g(f($a, [1, 2]), 'x,y')", type="method_chain", object="$s", chain=["a", "b"], args_map={"b": [1, 0]}) == "$s->a()->b('x,y', f($a, [1, 2]))"
    assert do("$x->p; $x->p()", type="variable_access", property="p", getter="getP") == "$x->getP(); $x->p()"
    assert do("A AB A", type="constant_replace", old="A", new="X::A") == "X::A AB X::A"
    assert do("global $u; $GLOBALS['u']", type="global_replace", variable="u", replacement="\\S::u()") == "$u = \\S::u(); \\S::u()"
    assert do("old old", type="function_call_rewrite", old="old", new="new") == "new old"
    assert edits.rewritten("x", None) is None


def test_template_columns_equal_their_python_form(spark):
    rng = random.Random(1)
    for _ in range(5):
        args = ", ".join(rng.choices(["$a", "1", "'x'"], k=rng.randint(1, 4)))
        at = rng.randint(0, 3)
        source = f"call({args}) + y()"
        want = edits.rewritten(source, json.dumps({"type": "parameter_insert", "position": at, "value": "V"}))
        assert value(spark, edits.insert_argument(F.lit(source), F.lit(at), F.lit("V"))) == want


def test_apply_edits(spark):
    text = "é one two one"
    source = spark.createDataFrame([("a", text)], "file_path string, text string")
    t = lambda old, new: json.dumps({"type": "string_replace", "old": old, "new": new})
    rows = [
        ("a", 1, 3, 6, "one", t("one", "ONE")), ("a", 2, 7, 10, "two", t("two", "2")), ("a", 3, 5, 9, "e tw", t("e", "E")),
        ("a", 4, -1, -1, "one", t("one", "x")), ("a", 5, 11, 14, "one", t("zzz", "y")), ("a", 6, 0, 2, "é", None),
    ]
    m = spark.createDataFrame(rows, "file_path string, id long, byte_start int, byte_end int, matched_source string, fix_template string")
    done = {r.match_id: r for r in edits.apply_edits(source, m).collect()}
    assert {k: r.status for k, r in done.items()} == {1: "applied", 2: "applied", 3: "failed", 4: "applied", 5: "skipped", 6: "failed"}
    assert done[3].conflict and [r.new_text for r in done.values() if r.new_text] == ["é ONE 2 x"]
    totals = edits.edit_totals(edits.apply_edits(source, m)).first()
    assert totals.total == 6 and totals.files_changed == 1


PHP = """<?php
namespace App\\Models;
/** @deprecated in core:10.1.0 and is removed from core:11.0.0. Use fresh() instead. */
class Old extends Base implements One, Two {
  const LIMIT = 5;
  public static function make(int $a, ?string $b = 'x', ...$rest): ?Old { return new Old(); }
  #[Hook('cron')]
  protected function tick() {}
}
function mymod_help($route) { return "function fake() {}"; }
"""


def test_extraction(spark):
    sources = spark.createDataFrame([("src/mymod.module", "php", PHP), ("a.js", "javascript", "class A { go(x) {} }\nfunction f() {}\nconst c = 1;"), ("m.info.yml", "yaml", "type: module\ndependencies:\n  - x:views (>=2)\n"), ("m.services.yml", "yaml", "services:\n  s.one: {class: A}\n"), ("m.libraries.yml", "libraries", "base:\n  js: {b.js: {}}\n  dependencies: [core/jquery]\n"), ("bad.yml", "yaml", "a: [")], "file_path string, language string, text string")
    found = {(r.symbol_type, r.fqn): r for r in extract.symbols(sources).collect()}
    assert {("class", "App\\Models\\Old"), ("method", "App\\Models\\Old::make"), ("constant", "App\\Models\\Old::LIMIT"), ("hook", "cron"), ("hook", "help"), ("function", "App\\Models\\mymod_help"), ("class", "A"), ("function", "f"), ("variable", "c"), ("module_info", "m"), ("service", "s.one"), ("library", "m/base")} <= set(found)
    assert ("function", "fake") not in found and not any(k[1].endswith("fake") for k in found)
    shape = json.loads(found["method", "App\\Models\\Old::make"].signature_json)
    assert [p["name"] for p in shape["params"]] == ["$a", "$b", "$rest"] and shape["return_type"] == "?Old"
    told = value(spark, extract.deprecation(F.lit(PHP), "core"))
    assert (told.version, told.removal_version, told.message) == ("10.1.0", "11.0.0", "fresh()")
    css = spark.createDataFrame([("a.css", ".a, #b-c { color: #fff; margin: .5em }\n/* .no */\n.d{}")], "file_path string, text string")
    assert sorted((r.fqn, r.line_start) for r in extract.css_selectors(css).collect()) == [("#b-c", 1), (".a", 1), (".d", 3)]


def test_css_lines_are_those_of_the_file(spark):
    text = "/* one\n.two {}\n*/ .three { a: b;\n c: d }\n#five, .six\n{ margin: .5em;\n}\n.eight /* x */ .nine"
    found = extract.css_selectors(spark.createDataFrame([("a.css", text), ("b.css", None), ("c.css", "")], "file_path string, text string")).collect()
    assert sorted((r.line_start, r.fqn) for r in found) == [(3, ".three"), (5, "#five"), (5, ".six"), (8, ".eight"), (8, ".nine")]


def test_report_joins_on_odd_rows(spark):
    paths = spark.createDataFrame([("modules/Views/a.php",), ("x/ab.php",), (None,), ("",)], "file_path string")
    names = spark.createDataFrame([("views",), ("ab",), ("a",), (None,), ("",), ("zz",)], "machine_name string")
    found = {(r.file_path, r.machine_name) for r in reports.contained(paths, names).collect()}
    assert found == {("modules/Views/a.php", "views"), ("modules/Views/a.php", "a"), ("x/ab.php", "ab"), ("x/ab.php", "a")}
    lib = "fqn string, css array<string>, js array<string>, dependencies array<string>, is_deprecated int"
    old = spark.createDataFrame([("a", ["x.css", "y.css"], None, ["d"], 0), ("b", None, None, None, None)], lib)
    new = spark.createDataFrame([("a", ["y.css"], ["z.js"], None, 1), ("c", [], [], [], 0)], lib)
    rows = sorted((r.fqn, r.change_type, r.severity, r.item) for r in reports.library_changes(old, new).collect())
    assert [x[:3] for x in rows] == [
        ("a", "library_css_removed", "breaking"), ("a", "library_dependency_removed", "warning"), ("a", "library_deprecated", "deprecation"), ("b", "library_removed", "breaking"), ("c", "library_added", "modernization"),
    ] and rows[0][3] == "x.css" and rows[1][3] == "d"
    changes = spark.createDataFrame([(1, 2), (2, None)], "id long, query_version int")
    with pytest.raises(ValueError):
        reports.require_current(changes, 2)
    assert reports.require_current(changes.where("id = 1"), 2).count() == 1
    kinds = (("service", '{"class":"A"}', '{"class":"B"}', "service_class_changed"), ("service", '{"class":"A","x":1}', '{"class":"A"}', "service_changed"), ("module_info", '{"dependencies":["b","a"]}', '{"dependencies":["a"]}', "module_dependencies_changed"),
        ("theme_info", '{"base theme":"x"}', '{"base theme":"y"}', "theme_base_changed"), ("theme_info", '{"dependencies":["x"]}', '{}', "theme_info_changed"), ("recipe_manifest", '{"install":["x"]}', '{}', "recipe_install_changed"))
    for kind, a, b, want in kinds:
        assert value(spark, reports.changed_type(F.lit(kind), F.lit(a), F.lit(b))) == want
    links = spark.createDataFrame([("l", '{"css_assets":["a.css","b.css"]}'), ("m", None)], "fqn string, metadata_json string")
    assets = spark.createDataFrame([(1, "a.css"), (2, "c.css")], "id long, file_path string")
    assert [(r.fqn, r.asset_id) for r in relations.asset_links(links, assets).collect()] == [("l", 1)]


def test_keep_last_meets_ties_and_nulls(spark):
    rows = spark.createDataFrame([(1, None, "a"), (1, 3, "b"), (1, 3, "b"), (None, None, "c"), (None, 1, "d")], "k long, id long, v string")
    assert sorted(r.v for r in merge.keep_last(rows, ["k"]).collect()) == ["b", "d"]


def test_changed_only_orders_a_group_over_batches(spark, tmp_path):
    from tidemark.streaming import logs

    rng = random.Random(3)
    rows = [(k % 2, k, rng.choice(["a", "b", None])) for k in range(3000)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "g long, seq long, v string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = logs.drained(logs.changed_only(logs.stream(spark, str(tmp_path), "events"), "g", "seq", "v"), "changed").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for g in (0, 1):
        last = object()
        for _, seq, v in sorted(x for x in [(r[0], r[1], r[2] or "") for r in rows] if x[0] == g):
            if v != last:
                want.append((g, seq, v or None))
            last = v
    assert sorted((r.g, r.seq, r.v or "") for r in found) == sorted((g, s, v or "") for g, s, v in want)


def test_a_missing_yaml_parser_is_told(monkeypatch):
    monkeypatch.setitem(sys.modules, "yaml", None)
    with pytest.raises(ImportError):
        list(extract.yaml_symbols("a.services.yml", "services: {s: {class: A}}"))


def test_files(spark, tmp_path):
    for name, text in (("a.php", "<?php"), ("vendor/b.php", "x"), ("core/c.yml", "k: v"), ("d.txt", "t")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = files.read_tree(spark, str(tmp_path))
    assert sorted((r.file_path, r.language) for r in found.collect()) == [("a.php", "php"), ("core/c.yml", "yaml")]
    assert files.read_tree(spark, str(tmp_path), dropped=("core/",)).count() == 1
    assert files.unseen(found, found.where("language = 'php'")).count() == 1
    rows = [("p", "composer.json", '{"require": {"x/core": "^10.2"}}'), ("q", "composer.lock", '{"packages": [{"name": "x/core", "version": "v11.0.1"}]}'), ("r", "m.info.yml", "core_version_requirement: '^9'")]
    manifests = spark.createDataFrame(rows, "project string, file_path string, text string")
    assert {r.project: r.version for r in files.detected_version(manifests, ("x/core",)).collect()} == {"p": "10.2.0", "q": "11.0.1", "r": "9.0.0"}
    assert {r.project: r.type for r in files.project_type(manifests).collect()} == {"p": "library", "q": "unknown", "r": "module"}
