"""Manifests, libraries, templates and whole files, and what is told by other files."""

import json

from tidemark.operators import extract, manifests

FILES = "file_path string, language string, text string"


def found(parser, path, text):
    out = {}
    for s in parser(path, text):
        out[s["symbol_type"], s["fqn"]] = s | {"text": text[s["start"] : s["end"]], "meta": json.loads(s.get("metadata_json") or "{}")}
    return out


def test_info_files():
    text = "name: My é\ntype: Theme\nbase theme: olivero\ndependencies:\n  - x:views (>=2)\n  - block\nconfigure: a.b\nlibraries:\n  - my/one\nlibraries-extend:\n  core/drop: [z/y, a/b]\nflag: yes\n"
    meta = found(manifests.yaml_symbols, "a/my.info.yml", text)["theme_info", "my"]
    assert meta["meta"] == {"file_kind": "theme_info", "label": "My é", "declared_type": "theme", "dependencies": ["block", "x:views (>=2)"], "dependency_targets": ["block", "views"], "configure_route": "a.b", "base_theme": "olivero", "mentioned_extensions": ["a", "block", "core", "my", "olivero", "views", "z"]}
    shape = json.loads(meta["signature_json"])
    assert shape["flag"] == "yes" and shape["dependencies"] == ["block", "x:views (>=2)"] and shape["libraries-extend"]["core/drop"] == ["a/b", "z/y"] and list(shape) == sorted(shape)
    assert ("module_info", "n") in found(manifests.yaml_symbols, "n.info.yml", "type: strange\n") and ("module_info", "n") in found(manifests.yaml_symbols, "n.info.yml", "a: [")


def test_services_routes_permissions_links_schemas():
    text = "parameters: {a: 1}\nservices:\n  _defaults: {public: true}\n  s.one:\n    class: \\A\\B\n    arguments: ['@x', !tagged_iterator y]\n    tags:\n      - { name: event_subscriber }\n  s.two: {class: C}\n"
    services = found(manifests.yaml_symbols, "m.services.yml", text)
    assert set(services) == {("service", "s.one"), ("event_subscriber", "s.one"), ("service", "s.two")}
    assert services["service", "s.one"]["meta"] == {"class": "\\A\\B", "arguments": ["@x", {"tag": "tagged_iterator", "value": "y"}], "tags": [{"name": "event_subscriber"}]}
    assert services["event_subscriber", "s.one"]["meta"]["class"] == "\\A\\B" and services["service", "s.two"]["text"] == "s.two: {class: C}"
    routes = found(manifests.yaml_symbols, "m.routing.yml", "r.one:\n  path: /x\n  defaults: {_controller: 'A\\B::go', _title: T}\nr.two: text\n")
    assert set(routes) == {("route", "r.one")} and routes["route", "r.one"]["meta"]["controller"] == "A\\B::go" and json.loads(routes["route", "r.one"]["signature_json"])["path"] == "/x"
    rights = found(manifests.yaml_symbols, "m.permissions.yml", "do it:\n  title: Do\n  restrict access: true\nother: {label: L}\n")
    assert rights["permission", "do it"]["meta"] == {"title": "Do", "description": None, "restrict_access": True} and rights["permission", "other"]["meta"]["title"] == "L"
    links = found(manifests.yaml_symbols, "m.links.task.yml", "l.one: {route_name: r1, base_route: r0, appears_on: [r2, r1]}\nl.two: x\n")
    assert links["link_task", "l.one"]["meta"]["route_refs"] == ["r0", "r1", "r2"] and json.loads(links["link_task", "l.two"]["signature_json"]) == {"value": "x"}
    assert set(found(manifests.yaml_symbols, "config/schema/m.schema.yml", "a.b:\n  type: x\n'c.*': {}\n")) == {("config_schema", "a.b"), ("config_schema", "c.*")}


def test_config_recipes_components():
    config = found(manifests.yaml_symbols, "x/config/sync/a.b.yml", "uuid: 1\nlangcode: en\n_core: {default_config_hash: h}\nz: [b, a]\ndependencies:\n  module: [n, m]\n")
    assert json.loads(config["config_export", "a.b"]["signature_json"]) == {"dependencies": {"module": ["m", "n"]}, "z": ["b", "a"]} and config["config_export", "a.b"]["meta"]["dependency_modules"] == ["m", "n"]
    assert found(manifests.yaml_symbols, "other/a.b.yml", "z: 1") == {}
    assert found(manifests.yaml_symbols, "r/my/recipe.yml", "install: [b, a]\nrecipes: [q]")["recipe_manifest", "my"]["meta"]["install"] == ["a", "b"]
    assert set(found(manifests.yaml_symbols, "recipe.yml", "name: My  Recipe!")) == {("recipe_manifest", "my_recipe")}
    component = found(manifests.yaml_symbols, "c/card/card.component.yml", "name: Card\nprops: {type: object, properties: {}}\nslots: {body: {}}\n")
    assert component["component", "card"]["meta"] == {"file_kind": "component", "label": "Card", "description": None, "status": "stable", "props": ["type", "properties"], "slots": ["body"], "library": None}


def test_libraries():
    text = "one:\n  version: 1.x\n  license: {name: MIT}\n  js:\n    js/a.js: {minified: true}\n    //cdn.x/b.js: {}\n    /abs/c.js: {}\n  css:\n    theme:\n      ../css/d.css: {}\n    base: {}\n  dependencies: [core/jquery, own/x]\nold:\n  deprecated: The library is deprecated in core:9.1.0 and is removed from core:10.0.0.\nmoved:\n  moved_files: {a: b}\nempty:\n"
    libraries = found(manifests.library_symbols, "modules/m/m.libraries.yml", text)
    meta = libraries["library", "m/one"]["meta"]
    assert meta["asset_paths"] == ["abs/c.js", "modules/css/d.css", "modules/m/js/a.js"] and meta["external_assets"] == ["//cdn.x/b.js"] and meta["css_assets"] == ["modules/css/d.css"]
    assert (meta["owner"], meta["version"], meta["license"], meta["dependency_owners"]) == ("m", "1.x", "MIT", ["core", "own"])
    old = libraries["library", "m/old"]
    assert (old["is_deprecated"], old["deprecation_version"], old["removal_version"]) == (1, "9.1.0", "10.0.0")
    assert libraries["library", "m/moved"]["deprecation_message"].endswith('{"a": "b"}') and libraries["library", "m/old"]["text"].startswith("old:") and ("library", "m/empty") in libraries
    assert found(manifests.library_symbols, "m.libraries.yml", "a: [") == {}


def test_templates():
    text = "{# {% include 'no' %} #}{% include 'a.html' with {x: y|upper} %}{% embed \"t:card\" %}{% endembed %}{{ content.title|raw|e('html') }}{{ component('t:icon', {a: 1}) }}{% set x = attach_library('l/x') %}{% for item in items %}{{ 'only text %}' }}{% if not a %}"
    out = [(s["symbol_type"], s["fqn"], text[s["start"] : s["end"]]) for s in manifests.twig_symbols("t.twig", text)]
    kinds = [x[:2] for x in out]
    assert kinds == [
        ("twig_include", "a.html"), ("twig_filter", "upper"), ("sdc_embed", "t:card"), ("twig_tag", "anonymous"), ("twig_variable", "content"), ("twig_filter", "raw"), ("twig_filter", "e"),
        ("twig_variable", "a"), ("sdc_function", "t:icon"), ("twig_set", "l/x"), ("twig_function", "attach_library"), ("twig_for", "item"), ("twig_variable", "anonymous"), ("twig_if", "a"),
    ]
    assert out[0][2] == "{% include 'a.html' with {x: y|upper} %}" and out[12][2] == "{{ 'only text %}' }}"


def test_symbols_of_all_languages_together(spark):
    rows = [("a/m.info.yml", "yaml", "type: module"), ("m.libraries.yml", "libraries", "x: {js: {a.js: {}}}"), ("t.twig", "twig", "{{ é }}\n{{ b }}"), ("bad.info.yml", "yaml", None), ("bad.routing.yml", "yaml", "{{"), ("n.md", "markdown", "# x")]
    got = {(r.symbol_type, r.fqn): r for r in extract.symbols(spark.createDataFrame(rows, FILES)).collect()}
    assert set(got) == {("module_info", "m"), ("library", "m/x"), ("twig_variable", "é"), ("twig_variable", "b")}
    assert (got["twig_variable", "b"].line_start, got["twig_variable", "b"].byte_start) == (2, len("{{ é }}\n".encode()))


def test_what_other_files_tell(spark):
    paths = ["m/m.info.yml", "m/components/card/card.component.yml", "m/components/card/card.twig", "m/components/card/card.js", "m/components/card/other.css", "x/a.component.yml", "top.component.yml", "top.css"]
    files = spark.createDataFrame([(p, "l", "a\nb" if p.endswith("css") else "") for p in paths] + [("none", "l", None)], FILES)
    assert {tuple(r) for r in manifests.component_files(files).collect()} == {("m/components/card/card.component.yml", "card", True, False, True), ("x/a.component.yml", "a", False, False, False), ("top.component.yml", "top", False, True, False)}
    extensions = spark.createDataFrame([("m", "m")], "folder string, owner string")
    assert {tuple(r) for r in manifests.component_context(files, extensions).collect()} == {(p, "m:card") for p in paths if "/card/" in p}
    whole = {r.fqn: r for r in manifests.whole_files(files.where("file_path like '%css'")).collect()}
    assert (whole["top.css"].symbol_type, whole["top.css"].language, whole["top.css"].line_end) == ("css_file", "css", 2)
    assert manifests.component_files(files.limit(0)).count() == 0 and manifests.whole_files(files.limit(0)).count() == 0
