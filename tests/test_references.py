"""References, searches over many terms, and links on odd rows."""

from tests.test_growth import moved
from tidemark.operators import references, reports

SYMBOL = "id long, version_id long, language string, symbol_type string, fqn string, name string, file_path string, signature_json string, metadata_json string"


def test_every_branch_of_the_search(spark):
    rows, want = [], set()

    def add(column, json, hits):
        k = len(rows) + 1
        sides = {"signature_json": None, "metadata_json": None} | {column: json}
        rows.append((k, 1, "yaml", "x", f"n{k}", f"n{k}", "f", sides["signature_json"], sides["metadata_json"]))
        want.update((t, k) for t in hits)

    for column, fields in references.SCALARS.items():
        for f, match in fields.items():
            add(column, f'{{"{f}": "Term"}}', ["Term"] if match == "whole" else ["Term", "term"])
            add(column, f'{{"{f}": "a-Term-b"}}', [] if match == "whole" else ["Term", "term"])
    for column, fields in references.LISTS.items():
        for f, match in fields.items():
            inner = '["x", "Term"]' if "." not in f else None
            json = f'{{"{f}": {inner}}}' if inner else f'{{"dependencies": {{"{f.split(".")[1]}": {{"k": "Term"}}}}}}'
            add(column, json, ["Term"] if match == "whole" else ["Term", "term"])
    add("metadata_json", '{"owner": "broken', [])
    rows += [(900, 1, "yaml", "x", "my.Term.x", None, "f", None, None), (901, 1, "php", "x", "Term", "Term", "f", None, None), (902, 1, "libraries", "x", None, "TERM", "f", None, "")]
    want |= {(t, k) for t in ("Term", "term") for k in (900, 902)}
    frame = spark.createDataFrame(rows, SYMBOL)
    terms = spark.createDataFrame([("Term",), (" term ",), ("",), (None,), ("zz",)], "term string")
    found = references.search(frame, terms).collect()
    assert {(r.term, r.id) for r in found} == want and len(found) == len(want)
    assert references.search(frame, terms, types=["y"]).count() == 0


def test_links_of_odd_rows(spark):
    rows = [
        (1, 1, "php", "class", "A\\B", "B", "b.php", None, None),
        (2, 1, "php", "class", "A\\B", "B", "b2.php", None, None),
        (3, 2, "php", "class", "A\\B", "B", "b.php", None, None),
        (4, 1, "yaml", "service", "s", "s", "s.yml", '{"class": "\\\\A\\\\B"}', None),
        (5, 1, "yaml", "service", "t", "t", "s.yml", "{}", None),
        (6, 1, "libraries", "library", "l", "l", "l.yml", None, '{"asset_paths": ["a.js", "a.js", "b.css"]}'),
        (7, 1, "javascript", "function", "f", "f", "a.js", None, '{"sdc_component": "t:c"}'),
        (8, 1, "css", "selector", ".x", ".x", "b.css", None, None),
        (9, 1, "yaml", "component", "t:c", "c", "c.yml", None, None),
        (10, 1, None, None, None, None, None, None, None),
    ]
    found = {tuple(r)[1:] for r in references.links(spark.createDataFrame(rows, SYMBOL)).collect()}
    assert found == {
        (4, "implementation_class", 1), (1, "registered_service", 4), (2, "registered_service", 4), (6, "javascript_asset_symbol", 7), (6, "css_asset_symbol", 8),
        (7, "declared_by_library", 6), (8, "declared_by_library", 6), (9, "component_asset", 7), (7, "part_of_component", 9),
    }
    none = spark.createDataFrame([], SYMBOL)
    assert references.links(none).count() == 0 and references.references(none).count() == 0


def test_names_that_begin_alike_meet_by_their_rarest_gram(spark):
    names = [f"prefix_{k}_{'x' * (k % 4)}" for k in range(60)] + ["pr", "q"]
    paths = [f"modules/PREFIX_{k}_xx/prefix_{k + 1}_/p.php" for k in range(0, 60, 7)] + ["", None, "pr"]
    a, b = spark.createDataFrame([(x,) for x in paths], "file_path string"), spark.createDataFrame([(x,) for x in names], "machine_name string")
    found = {tuple(r) for r in reports.contained(a, b).collect()}
    assert found == {(p, n) for p in paths if p for n in names if n in p.lower()}


def test_ids_of_one_key_are_sent_in_packs(spark):
    """Each id was sent by itself, once for each block of the other side."""
    a, b = (spark.range(5000).selectExpr("1 as version_id", f"id as {c}", "'k' as key").unionByName(spark.range(3).selectExpr("1 as version_id", f"id as {c}", "'l' as key")) for c in "xy")
    n, rows = moved(spark, lambda: references._pairs(a, b, "key", "x", "y").count())
    assert n == 5000**2 and rows < 24_000
