"""The token machine, extraction from it, and matches with places."""

import json
import random

import pytest

from tidemark.operators import collector, edits, extract
from tidemark.operators.php import Offsets, brackets, scan, tokens

FILES = "file_path string, language string, text string"

SOURCE = r"""<html><?php
namespace App\Mod;
use Lib\Core\Module; use Lib\{A, B}; use function Lib\f;
/** Doc.
 * @Block(id = "my_block", label = @T("x"))
 * @deprecated in core:9.1.0 and is removed from core:10.0.0. Use New instead.
 */
final class MyBlock extends BlockBase implements \X\EventSubscriberInterface, B {
  const A = [1, ';'], B2 = 'x';
  public static function getSubscribedEvents() { return ['kernel.request' => ['go', 3], \Lib\ConfigEvents::SAVE => "y"]; }
  #[Hook('cron')]
  protected function install(?int $a, string|null &$b = [1, "x,)"], ...$rest): ?static { $this->up->install($a, [1,2], f(3,4)); $x?->nul(); return new class(1) extends Q { function inner() {} }; }
  abstract function noBody(#[A(1)] private readonly int $z = self::A);
}
function app_form_alter($x) { @trigger_error('x is deprecated in core:8.1.0 and is removed from core:9.0.0. Use g() instead.'); global $user, $b2; old_call(1, "a, b)", /* c, */ [2, 3],); // old_call(9)
  $s = <<<EOT
  old_call(1) {$x->y("z")}
  EOT;
  \qualified(1); Foo::stat(1,2); Foo::CONSTA; $o->prop = CONSTB; isset($q); fn($y) => $y; function() use ($x) { return 1; };
}
#[ConfigAction(id: 'my_action', label: "x")]
class Act {}
class FooEvents { const SAVE = 'foo.save'; }
?> old_call(1) <?php old_call();
"""


def test_declarations_of_a_text():
    found = {(s["symbol_type"], s["fqn"]): s for s in scan("src/app.module", SOURCE).symbols}
    assert {k for k, _ in found} == {"class", "plugin_definition", "event_subscriber", "constant", "method", "function", "hook", "event"}
    assert json.loads(found["event_subscriber", "App\\Mod\\MyBlock"]["metadata_json"])["events"] == ["kernel.request", "go", "\\Lib\\ConfigEvents::SAVE", "y"]
    assert {("plugin_definition", "my_block"), ("plugin_definition", "my_action"), ("hook", "cron"), ("hook", "form_alter"), ("event", "App\\Mod\\FooEvents::SAVE"), ("constant", "App\\Mod\\MyBlock::B2")} <= set(found)
    install = found["method", "App\\Mod\\MyBlock::install"]
    assert json.loads(install["signature_json"]) == {"params": [{"name": "$a", "type": "?int", "default": None}, {"name": "$b", "type": "string|null", "default": '[1, "x,)"]'}, {"name": "$rest", "type": None, "default": None}], "return_type": "?static"}
    assert (install["visibility"], install["is_static"]) == ("protected", 0) and install["source_text"].endswith("function inner() {} }; }")
    assert found["method", "App\\Mod\\MyBlock::getSubscribedEvents"]["is_static"] == 1
    block = found["class", "App\\Mod\\MyBlock"]
    assert (block["is_deprecated"], block["deprecation_version"], block["removal_version"], block["deprecation_message"]) == (1, "9.1.0", "10.0.0", "New")
    assert block["source_text"].startswith("final class") and block["source_text"].endswith("self::A);\n}")
    hook = found["hook", "form_alter"]  # what is triggered tells about the last declaration
    assert (hook["deprecation_version"], hook["removal_version"], json.loads(hook["metadata_json"])) == ("8.1.0", "9.0.0", {"replacement_hint": "g()"})


def test_places_of_a_text():
    found = {(p[0], p[1], p[4]) for p in scan("src/app.module", SOURCE).places}
    assert {("call", "old_call", 3), ("call", "old_call", 0), ("call", "f", 2), ("method_call", "install", 3), ("static_call", "stat", 2)} <= found
    assert {("class", "Lib\\Core\\Module", None), ("class", "Lib\\ConfigEvents", None), ("global", "user", None), ("global", "b2", None), ("property", "prop", None), ("hook", "alter", None), ("override", "BlockBase::install", None), ("name", "CONSTB", None)} <= found
    assert not {("call", "old_call", 1), ("call", "isset", 1), ("call", "hidden", 0), ("method_call", "nul", 0)} & found
    assert [SOURCE[p[2] : p[3]] for p in scan("x", SOURCE).places if p[:2] == ("arguments", "old_call")] == ['(1, "a, b)", /* c, */ [2, 3],)', "()"]


def slow_arguments(text):
    """Top-level items of a bracketed text, character by character; no comments."""
    depth, quote, items, some, skip = 0, "", 0, False, False
    for c in text[1:-1]:
        if skip:
            skip = False
        elif quote:
            skip, quote = c == "\\", "" if c == quote else quote
        elif c in "'\"":
            quote, some = c, True
        elif c == "," and not depth:
            items, some = items + some, False
        elif not c.isspace():
            depth += (c in "([{") - (c in ")]}")
            some = True
    return items + some


def test_argument_counts_against_characters():
    draw = random.Random(4)

    def value(deep):
        pick = draw.randrange(6 if deep else 3)
        return ["$a", "'x, (\\' y'", '"p) {$q} ,"'][pick] if pick < 3 else f"[{listed(deep - 1)}]" if pick == 3 else f"g({listed(deep - 1)})" if pick == 4 else f"fn({listed(0)}) => {value(0)}"

    def listed(deep):
        return ", ".join(value(deep) for _ in range(draw.randrange(4))) + draw.choice(["", "", " "])

    for _ in range(300):
        text = f"({listed(3)})"
        found = [p for p in scan("x", f"<?php target{text};").places if p[:2] == ("arguments", "target")]
        assert [(f"<?php target{text};"[p[2] : p[3]], p[4]) for p in found] == [(text, slow_arguments(text))]


@pytest.mark.parametrize("text", ["", "<?php", "<?php /*", "<?php \"{$a", "<?php <<<X\nabc", "<?php ((([", "}}} ]) class", "<?php class", "<?php function (", "<?php #[A(", "'" * 999, "<?php const A", "\x00é世"])
def test_broken_texts_end_with_their_text(text):
    assert all(0 <= s["start"] <= s["end"] <= len(text) for s in scan("a.php", text).symbols)
    assert brackets([t for t in tokens(text)]) is not None


def test_places_are_bytes_and_lines():
    text = "aé\n世b\n"
    at = Offsets(text, range(len(text) + 1))
    assert [at.byte(p) for p in range(len(text) + 1)] == [len(text[:p].encode()) for p in range(len(text) + 1)]
    assert [at.line(p) for p in range(len(text))] == [text[:p].count("\n") + 1 for p in range(len(text))]


CHANGES = "id long, language string, change_type string, symbol_type string, old_fqn string, name string, parent_symbol string, diff_json string, fix_template string"


def test_every_kind_of_change_is_met(spark):
    files = spark.createDataFrame([("src/app.module", "php", SOURCE), ("é.php", "php", "<?php\n// é gone()\n$é = 'é'; gone(1);"), ("t.twig", "twig", "{# 'a:b' #}{% include 'a:b' %}{{ x(\"a:b\") }} 'a:b'"), ("n.php", "php", None), ("m.md", "markdown", "gone()")], FILES)
    two = '{"old":{"params":[1,2]},"new":{"params":[1,2,3,4]}}'
    rows = [
        (1, "php", "function_removed", "function", "old_call", None, None, None, None),
        (2, "php", "method_removed", "method", "Lib\\K::install", None, None, None, None),
        (3, "php", "signature_changed", "function", "old_call", None, None, two, "{}"),
        (4, "php", "signature_changed", "function", "f", None, None, '{"old":{"params":[1,2]},"new":{"params":[1]}}', None),
        (5, "php", "service_removed", "service", "kernel.request", None, None, None, None),
        (6, "php", "class_removed", "class", "\\Lib\\Core\\Module", "Module", None, None, None),
        (7, "php", "hook_to_attribute", "hook", "alter", None, None, None, None),
        (8, "php", "event_removed", "event", "SAVE", None, None, None, None),
        (9, "php", "inheritance_impact", "method", "x", "install", "Lib\\BlockBase", None, None),
        (10, "php", "global_replaced", None, "user", None, None, None, None),
        (11, "php", "constant_replaced", None, "CONSTB", None, None, None, None),
        (12, "php", "variable_access_replaced", None, "prop", None, None, None, None),
        (13, "twig", "sdc_include_removed", "component", "a:b", None, None, None, None),
        (14, "php", "function_removed", "function", "gone", None, None, None, '{"type":"function_rename","old":"gone","new":"went"}'),
        (15, "php", "misc_changed", "function", "old_call", None, None, None, None),
        (16, "php", "class_removed", "class", "MyBlock", None, None, None, None),
        (17, "php", "function_removed", "function", None, None, None, None, None),
        (18, "php", "signature_changed", "function", "old_call", None, None, '{"old":{"params":[1]},"new":{"params":[1]}}', None),
    ]
    found = sorted((r.change_id, r.matched_source, r.line_start) for r in collector.collect(files.union(files), spark.createDataFrame(rows, CHANGES)).collect())
    want = [(1, "old_call", 15), (1, "old_call", 24), (2, "install", 12), (3, '(1, "a, b)", /* c, */ [2, 3],)', 15), (3, "()", 24), (4, "(3,4)", 12), (5, "kernel.request", 10), (6, "Lib\\Core\\Module", 3)]
    want += [(7, "app_form_alter", 15), (8, "SAVE", 10), (8, "SAVE", 23), (9, "class MyBlock extends BlockBase", 8), (10, "$user", 15), (11, "CONSTB", 19), (12, "prop", 19), (13, "a:b", 1), (13, "a:b", 1), (14, "gone", 3), (18, '(1, "a, b)", /* c, */ [2, 3],)', 15), (18, "()", 24)]
    assert found == sorted(want)


def test_matches_feed_the_edits(spark):
    files = spark.createDataFrame([("é.php", "php", "<?php\n// é gone()\n$é = 'é'; gone(1); x('gone');")], FILES)
    change = spark.createDataFrame([(14, "php", "function_removed", "function", "gone", None, None, None, '{"type":"function_rename","old":"gone","new":"went"}')], CHANGES)
    done = edits.apply_edits(files, collector.collect(files, change)).collect()
    assert [(r.status, r.new_text) for r in done] == [("applied", "<?php\n// é gone()\n$é = 'é'; went(1); x('gone');")]


def test_collecting_from_empty_tables(spark):
    none, some = spark.createDataFrame([], FILES), spark.createDataFrame([], CHANGES)
    assert collector.collect(none, some).count() == 0 and extract.symbols(none).count() == 0 and extract.library_usage(none).count() == 0


def test_library_usage_by_grammar(spark):
    php = "<?php $a['#attached']['library'][] = 'core/jquery'; // ['library'][] = 'no/no';\n$b = ['library' => ['é/x', \"m/base.css\"], 'other' => 'n/o']; $c['library'][] = $d;"
    twig = "{{ attach_library('m/one') }}{# attach_library('no/no') #}\n{% set x = attach_library( \"m/two\" ) %} attach_library('out/side')"
    yml = "libraries:\n  - core/drop\n  - 'é/q'\n  - plain\nkey: a/b\n# - no/no\n"
    rows = [("a.php", "php", php), ("t.html.twig", "twig", twig), ("c.yml", "yaml", yml), ("bad.yml", "yaml", "a: ["), ("x.md", "md", "- core/x"), ("n.php", "php", None)]
    found = sorted((r.file_path, r.fqn, r.byte_start, r.line_start) for r in extract.library_usage(spark.createDataFrame(rows, FILES)).collect())
    want = []
    for path, text, names in (("a.php", php, ["core/jquery", "é/x", "m/base.css"]), ("t.html.twig", twig, ["m/one", "m/two"]), ("c.yml", yml, ["core/drop", "é/q"])):
        want += [(path, n, len(text[: text.index(n)].encode()), text[: text.index(n)].count("\n") + 1) for n in names]
    assert found == sorted(want)


def test_a_long_text_takes_linear_time():
    import time

    def took(n):
        began = time.perf_counter()
        text = "<?php\n" + "function f($é) { return g($é, 'x'); }\n" * n
        assert len(extract._rows("a.php", "php", text, list(extract.php_symbols("a.php", text)))) == n
        return time.perf_counter() - began

    took(100)
    assert took(16000) < 12 * took(4000)


def test_ids_of_annotations_and_versions_of_triggered_deprecations():
    from tidemark.operators.php import annotated_id

    assert annotated_id('/**\n * @Block(\n *   id = "a_b",\n *   label = @T("x")\n * )\n */') == ("Block", "a_b")
    assert annotated_id("@X(label = @T(\"id\"), id: 'q')") == ("X", "q") and annotated_id('@see id = "no" (id = "no")') is None
    assert annotated_id('@One(a = "b") @Two(valid = "x", id="two")') == ("Two", "two") and annotated_id("@X(id = '')") is None and annotated_id("@X(id = \"open") is None
    calls = "<?php function f() { trigger_deprecation('my/pack', '5.1', 'Use %s instead.', g(1, 2)); } function h() { trigger_deprecation($p, VERSION, ''); }"
    f, h = scan("x.php", calls).symbols
    assert (f["is_deprecated"], f["deprecation_version"], json.loads(f["metadata_json"])) == (1, "5.1", {"replacement_hint": "%s"}) and (h["is_deprecated"], h["deprecation_version"]) == (1, None)
