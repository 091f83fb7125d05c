"""Change streams, structured differences and renames against plain Python, and on odd rows."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.test_whole import distance
from tidemark.functions.distance import edit_distances
from tidemark.operators import changes, structure

PAIRS = "id long, old_json string, new_json string"


def leaves(value, path="$", key=""):
    """(path, item, text) of each leaf; items of a set of scalars are told apart by their text."""
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from leaves(v, f"{path}.{k}" if k.isidentifier() and k.isascii() else f'{path}."{k}"', k)
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from leaves(v, f"{path}[{i}]")
    else:
        yield path, json.dumps(value, separators=(",", ":"))


def plain_changes(old, new):
    a, b = dict(leaves(old)) if old is not ... else {}, dict(leaves(new)) if new is not ... else {}
    return {(p, "added" if p not in a else "removed" if p not in b else "changed", a.get(p), b.get(p)) for p in a.keys() | b.keys() if a.get(p) != b.get(p)}


def test_json_changes_of_any_depth(spark):
    draw = random.Random(9)

    def made(deep):
        kind = draw.randrange(8 if deep else 5)
        if kind < 5:
            return [1, "a", None, True, {}][kind]
        return {draw.choice(["a", "b", "c d", "é"]): made(deep - 1) for _ in range(draw.randrange(4))} if kind < 7 else [made(deep - 1) for _ in range(draw.randrange(4))]

    rows = [(k, made(5), made(5)) for k in range(200)]
    rows += [(k + 200, old, {"top": [old], "more": made(2)}) for k, old, _ in rows[:30]]
    frame = spark.createDataFrame([(k, json.dumps(a), json.dumps(b)) for k, a, b in rows] + [(900, None, '{"x": {"y": 1}}'), (901, '{"a": 1', "[]"), (902, "{}", "{}"), (903, None, None)], PAIRS)
    want = {(k, *x) for k, a, b in rows for x in plain_changes(a, b)} | {(900, "$.x.y", "added", None, "1"), (901, "$", "added", None, "[]")}
    found = [tuple(r) for r in structure.json_changes(frame, ["id"]).collect()]
    assert set(found) == want and len(found) == len(want)
    assert structure.json_changes(frame.limit(0), ["id"]).count() == 0


def test_lists_that_mean_sets(spark):
    frame = spark.createDataFrame([(1, '{"tags": ["a", "b"], "list": ["a", "b"]}', '{"tags": ["b", "c", "a"], "list": ["b", "a"]}'), (2, '{"tags": [{"n": 1}]}', '{"tags": [{"n": 2}, "x"]}'), (3, '{"tags": ["a"]}', '{"tags": "a"}')], PAIRS)
    found = {tuple(r) for r in structure.json_changes(frame, ["id"]).collect()}
    assert found == {(1, "$.tags[*]", "added", None, '"c"'), (1, "$.list[0]", "changed", '"a"', '"b"'), (1, "$.list[1]", "changed", '"b"', '"a"'), (2, "$.tags[0].n", "changed", "1", "2"), (2, "$.tags[1]", "added", None, '"x"'), (3, "$.tags[*]", "removed", '"a"', None), (3, "$.tags", "added", None, '"a"')}


def test_details_by_kind(spark):
    old, new = '{"install": ["b", " a ", "", "b"], "recipes": ["r"], "class": "A", "path": "/x", "base theme": "t", "dependencies": ["p"]}', '{"install": ["c", "a"], "class": "B", "dependencies": ["q", "p"], "configure": "go"}'
    one = spark.range(1)
    told = lambda kind: json.loads(one.select(structure.details(F.lit(kind), F.lit(old), F.lit(new)).alias("d")).first().d)
    assert told("recipe_manifest") == {"changed_keys": ["base theme", "class", "configure", "dependencies", "install", "path", "recipes"], "added_install": ["c"], "removed_install": ["b"], "added_recipes": [], "removed_recipes": ["r"]}
    assert told("service") == {"old_class": "A", "new_class": "B", "old_arguments": None, "new_arguments": None, "old_tags": None, "new_tags": None}
    assert told("route") == {"old_path": "/x", "new_path": None, "old_controller": None, "new_controller": None}
    info = told("theme_info")
    assert (info["added_dependencies"], info["removed_dependencies"], info["old_base_theme"], info["new_configure"]) == (["q"], [], "t", "go")
    assert told("config_export")["removed_top_level_keys"] == ["base theme", "path", "recipes"] and set(told("link_menu")) == {"changed_keys", "old_signature", "new_signature"}


ENTRY = "id long, language string, symbol_type string, fqn string, name string, namespace string, parent_symbol string, signature_json string, signature_hash string, is_deprecated int, source_text string, metadata_json string"


def entry(id, kind, fqn, signature, source="s", language="yaml", deprecated=0, namespace=None, parent=None, metadata=None):
    return (id, language, kind, fqn, fqn, namespace, parent, signature, signature, deprecated, source, metadata)


def test_structured_renames_are_the_walk(spark):
    draw = random.Random(2)
    name = lambda: "".join(draw.choice("abc.") for _ in range(draw.randrange(9)))
    gone = [entry(k, draw.choice(["service", "route"]), name(), draw.choice(["{}", '{"a":1}', ""]), draw.choice(["one two", "one   two", "other text", ""])) for k in range(40)]
    fresh = [entry(k + 100, draw.choice(["service", "route"]), name(), draw.choice(["{}", '{"a":1}', ""]), draw.choice(["one two", "other texts", ""])) for k in range(40)]

    def alike(x, y):
        return 0.0 if not x or not y else 1.0 if x == y else 1 - distance(x, y) / max(len(x), len(y))

    want, used = {}, set()
    for o in gone:
        best, top = None, 0.0
        for n in fresh:
            if n[0] not in used and o[2] == n[2] and o[3] != n[3]:
                s = min(1.0, (0.65 if o[7] and o[7] == n[7] else 0.0) + 0.2 * alike(o[4], n[4]) + 0.15 * alike(" ".join(o[10].split()), " ".join(n[10].split())))
                if s > top + 1e-12:
                    best, top = n[0], s
        if best is not None and top >= 0.78:
            used.add(best)
            want[o[0]] = best
    a, b = (spark.createDataFrame(x, ENTRY) for x in (gone, fresh))
    found = {r.old_id: r.new_id for r in structure.renames(a, b).collect()}
    assert found == want and len(want) > 5
    assert structure.renames(a.limit(0), b).count() == 0


def test_copies_of_entries_are_scored_once(spark, monkeypatch):
    """Each copy was compared with each of the other side; pairs of copies are only given out."""
    gone, fresh = ([entry(at + k, "service", f"{name}{k}", "{}", source="a  b")[:4] + (name, *entry(0, "", "", "{}", source="a  b")[5:]) for k in range(n)] for at, n, name in ((0, 700, "long_name"), (1000, 600, "long_nam")))
    gone += [entry(900, "service", "same", "{}", "é" * 40), entry(901, "service", None, "{}"), entry(902, "route", "same", "{}")]
    fresh += [entry(1900, "service", "same", "{}", "é" * 40), entry(1901, "service", "sameé", "{}", "é" * 39), entry(1902, "service", "sameé" * 60, "{}", "é" * 40)]
    a, b = (spark.createDataFrame(x, ENTRY) for x in (gone, fresh))
    asked = []
    monkeypatch.setattr(structure, "edit_distances", lambda x, y: asked.append((len(x), len(y))) or edit_distances(x, y))
    packs = [pa.RecordBatch.from_pylist([{"symbol_type": "service"} | {side: [{"name": n, "plain": "a b", "shared": None, "rows": list(range(k))}] for side, n, k in (("old", "long_name", 700), ("new", "long_nam", 600))}])]
    assert [(b.num_rows, len(b["met"][0])) for b in structure._scored_packs(0.78)(iter(packs))] == [(1, 1)] and asked == [(1, 1), (1, 1)]
    monkeypatch.undo()
    found = [(r.old_id, r.new_id, round(r.score, 6), r.change_type) for r in structure.rename_candidates(a, b).collect()]
    want = [(o, 1000 + n, round(0.80 + 0.2 * 8 / 9, 6), "service_renamed") for o in range(700) for n in range(600)]
    want += [(900, 1901, round(0.65 + 0.2 * 4 / 6 + 0.15 * 78 / 80, 6), "service_renamed"), (900, 1902, round(0.80 + 0.2 * 2 * 4 / (4 + 360), 6), "service_renamed")]
    assert sorted(found) == sorted(want)


@pytest.mark.parametrize("longest", [3, 20, 64, 70, 200, 255])
def test_distances_of_many_texts(longest):
    draw = random.Random(longest)
    text = lambda: bytes(draw.choice(b"ab\xc3_") for _ in range(draw.randrange(longest + 1)))
    a = [text() for _ in range(5)] + [b"", b"x" * longest]
    a, b = a + [(x[: draw.randrange(len(x) + 1)] + text())[:longest] for x in a], [text() for _ in range(5)] + [b"", b"x" * longest]
    for x, y in ((a, b), (b, a), (a, []), ([], b)):
        assert edit_distances(x, y).tolist() == [[distance(s, t) for t in y] for s in x]


def test_version_changes_has_every_stream(spark):
    call = lambda *p: json.dumps({"params": [{"name": f"${x}"} for x in p], "return_type": None})
    old = [
        entry(1, "function", "old_name", call("a"), language="php", source="function old_name() { body }"),
        entry(2, "function", "gone", call(), language="php"),
        entry(3, "function", "announced", call(), language="php", deprecated=1),
        entry(4, "method", "K::m", call("a"), language="php", parent="K"),
        entry(5, "service", "s.old", '{"class":"A"}', "same"),
        entry(6, "service", "s.kept", '{"class":"A"}'),
        entry(7, "permission", "p.gone", '{"t":1}'),
        entry(8, "hook", "cron", None, language="php"),
        entry(9, "library", "l/one", None, language="yaml", metadata='{"css_assets":["a.css"],"javascript_assets":[],"dependency_libraries":[]}'),
        entry(None, None, None, None, language=None),
    ]
    new = [
        entry(11, "function", "new_name", call("a"), language="php", source="function new_name() { body }"),
        entry(14, "method", "K::m", call("a", "b"), language="php", parent="K", deprecated=1),
        entry(15, "service", "s.new", '{"class":"A"}', "same"),
        entry(16, "service", "s.kept", '{"class":"B"}'),
        entry(18, "hook", "cron", None, language="php", namespace="N"),
        entry(19, "library", "l/one", None, language="yaml", metadata='{"css_assets":[],"javascript_assets":[],"dependency_libraries":[]}'),
    ]
    a, b = (spark.createDataFrame(x, ENTRY) for x in (old, new))
    found = sorted((r.change_type, str(r.old_fqn), str(r.new_fqn), r.severity) for r in changes.version_changes(a, b).collect())
    assert found == sorted([
        ("function_renamed", "old_name", "new_name", "breaking"), ("function_removed", "gone", "None", "breaking"), ("function_removed", "announced", "None", "removal"),
        ("signature_changed", "K::m", "K::m", "breaking"), ("inheritance_impact", "K::m", "K::m", "breaking"), ("deprecated_added", "K::m", "K::m", "deprecation"),
        ("service_renamed", "s.old", "s.new", "breaking"), ("service_class_changed", "s.kept", "s.kept", "breaking"), ("permission_removed", "p.gone", "None", "breaking"),
        ("hook_to_attribute", "cron", "cron", "modernization"), ("library_css_removed", "l/one", "l/one", "breaking"), ("symbol_removed", "None", "None", "breaking"),
    ])
    assert changes.version_changes(a.limit(0), b.limit(0)).count() == 0
    told = {r.change_type: r for r in changes.version_changes(a, b).collect()}
    assert json.loads(told["service_renamed"].fix_template) == {"type": "string_replace", "old": "s.old", "new": "s.new"} and told["signature_changed"].confidence == 0.9
    assert json.loads(told["signature_changed"].diff_json)["changes"] == [{"type": "parameter_added", "position": 1, "new": "$b"}]
