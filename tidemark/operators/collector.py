"""Where project files use what has changed: places of names, met with what each change looks for.

Files are read once, whatever the number of changes: a task turns a text into the places where
names, strings and arguments stand, and Spark meets places and changes by an equi-join on
language and literal. Catalyst broadcasts the changes where they are few and shuffles both
sides where they aren't; neither is ever held against all of the other.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.extract import arrow_schema, batched
from tidemark.operators.matches import passes_argument_count
from tidemark.operators.php import Offsets, scan

PLACES = "file_path string, language string, kind string, literal string, matched_source string, arguments int, byte_start long, byte_end long, line_start long, line_end long"

Reader = Callable[[str, str], Iterator[tuple]]


def _php_places(path: str, text: str) -> Iterator[tuple]:
    yield from scan(path, text).places


_TWIG_PART = re.compile(r"\{#.*?#\}|(\{[%{].*?[%}]\})", re.S)
_TWIG_STRING = re.compile(r"'(?>\\.|[^'\\])*+'|\"(?>\\.|[^\"\\])*+\"", re.S)


def _twig_places(path: str, text: str) -> Iterator[tuple]:
    """Strings of tags and outputs; comments have none."""
    for part in _TWIG_PART.finditer(text):
        for m in _TWIG_STRING.finditer(part[1] or ""):
            if len(m[0]) > 2:
                yield "component", m[0][1:-1], part.start(1) + m.start() + 1, part.start(1) + m.end() - 1, None


READERS: dict[str, Reader] = {"php": _php_places, "twig": _twig_places}


def places(files: DataFrame) -> DataFrame:
    """Every place of (file_path, language, text) rows that a change can be met at.

    ``kind`` says what stands there: call, arguments (of a call, with parentheses), method_call,
    static_call, property, name, class (a qualified name that is imported, created, extended or
    asked for members), string, global, hook (the rest of a function's name behind each
    underscore), override (a class with a base, for each of its methods, as base::method) or
    component. Places are in bytes and lines. Null texts, and languages without a reader, have none.
    """
    schema = arrow_schema(PLACES)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, language, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                stand = list(READERS[language](path or "", text))
                at = Offsets(text, (p for x in stand for p in x[2:4]))
                for kind, literal, a, b, n in stand:
                    yield path, language, kind, literal, text[a:b], n, at.byte(a), at.byte(b), at.line(a), at.line(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(found(batches), schema, lambda row: len(row[4]))

    return files.where(F.col("language").isin(*READERS) & F.col("text").isNotNull()).select("file_path", "language", "text").mapInArrow(run, PLACES)


# Which change types look for a string, and which follow the type of their symbol.
STRING_CHANGES = (
    "service_removed", "service_renamed", "service_class_changed", "service_changed", "route_removed", "route_renamed", "route_changed",
    "permission_removed", "permission_renamed", "config_key_removed", "config_key_renamed", "config_key_changed",
    "library_removed", "library_changed", "library_css_removed", "library_js_removed", "library_dependency_removed", "library_deprecated",
)
SYMBOL_CHANGES = (
    "module_info_changed", "module_dependencies_changed", "profile_info_changed", "profile_dependencies_changed", "theme_info_changed",
    "theme_base_changed", "theme_engine_info_changed", "link_menu_changed", "link_task_changed", "link_action_changed",
    "link_contextual_changed", "config_object_changed", "recipe_changed", "recipe_install_changed", "deprecated_added",
)
COMPONENT_CHANGES = ("sdc_include_removed", "sdc_embed_removed", "sdc_call_removed", "sdc_function_removed")
STRING_SYMBOLS = (
    "service", "library", "library_usage", "route", "permission", "config_schema", "module_info", "theme_info", "profile_info", "theme_engine_info",
    "link_menu", "link_task", "link_action", "link_contextual", "breakpoint", "config_export", "recipe_manifest",
)


def target_kind(change_type: Column, symbol_type: Column) -> Column:
    """What kind of place a change is met at; null where nothing can be looked for."""
    by_symbol = (
        F.when(symbol_type.isin("function", "hook"), "call")
        .when(symbol_type == "method", "method_call")
        .when(symbol_type.isin("class", "interface", "trait", "constant", "plugin_definition"), "class")
        .when(symbol_type.isin(*STRING_SYMBOLS), "string")
        .when(symbol_type.isin("component", "sdc_include", "sdc_embed", "sdc_call", "sdc_function", "twig_include", "twig_embed", "twig_extends", "twig_component"), "component")
        .when(symbol_type == "event_subscriber", "event")
    )
    return (
        F.when(change_type == "signature_changed", F.when(symbol_type.isin("function", "hook", "method"), "arguments"))
        .when(change_type.isin(*STRING_CHANGES), "string")
        .when(change_type == "hook_to_attribute", "hook")
        .when(change_type == "event_removed", "event")
        .when(change_type == "inheritance_impact", "override")
        .when(change_type.isin(*SYMBOL_CHANGES), by_symbol)
        .when(change_type == "global_replaced", "global")
        .when(change_type == "constant_replaced", "name")
        .when(change_type == "variable_access_replaced", "property")
        .when(change_type.isin(*COMPONENT_CHANGES), "component")
        .when(change_type == "function_call_rewrite", "call")
        .when(change_type.endswith("_removed") | change_type.endswith("_renamed"), by_symbol)
    )


def targets(changes: DataFrame) -> DataFrame:
    """(change_id, language, change_type, kind, literal, old_count, new_count, fix_template): what each change looks for.

    ``changes``: id, language, change_type, symbol_type, old_fqn, name (may be null), parent_symbol,
    diff_json and fix_template. The literal is the symbol's name, or the last part of its qualified
    one; a class is looked for by all of its qualified name, a hook without what stands before, a
    method that may be overridden with its class's short name. Changes without one are left out.
    """
    kind = target_kind(F.col("change_type"), F.col("symbol_type"))
    qualified = F.ltrim(F.coalesce("old_fqn", F.lit("")), F.lit("\\"))
    last = F.substring_index(F.substring_index(qualified, "\\", -1), "::", -1)
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), last)
    literal = (
        F.when((F.col("kind") == "class") & qualified.contains("\\"), qualified)
        .when(F.col("kind") == "override", F.concat(F.substring_index("parent_symbol", "\\", -1), F.lit("::"), name))
        .otherwise(name)
    )
    count = lambda side: F.json_array_length(F.get_json_object("diff_json", f"$.{side}.params"))
    rows = changes.withColumn("kind", kind).withColumn("literal", literal).where("kind is not null and literal <> ''")
    return rows.select(F.col("id").alias("change_id"), "language", "change_type", "kind", "literal", count("old").alias("old_count"), count("new").alias("new_count"), "fix_template")


#: Kinds of places that stand for a bare name.
NAMES = ("call", "method_call", "static_call", "property", "name")


def collect(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Matches with places: file_path, change_id, change_type, id, bytes, lines, matched_source, arguments, fix_method, fix_template, status.

    A change of a signature is met at the arguments of a call, as long as their number lets the
    change matter (where its counts are known). An event is met as a string or a name. ``id``
    tells matches of a run apart. Repeated rows of a file give their matches once.
    """
    found = places(files).withColumnRenamed("kind", "place_kind")
    wanted = targets(changes)
    kinds = F.col("place_kind") == F.col("kind")
    by_name = F.col("kind").isin("name", "event") & F.col("place_kind").isin(*NAMES)
    by_event = (F.col("kind") == "event") & (F.col("place_kind") == "string")
    met = found.join(wanted, ["language", "literal"]).where(kinds | by_name | by_event)
    counts = F.col("old_count").isNotNull() & F.col("new_count").isNotNull()
    met = met.where((F.col("kind") != "arguments") | ~counts | passes_argument_count(F.col("arguments"), F.col("old_count"), F.col("new_count")))
    number = F.xxhash64("file_path", "change_id", "byte_start", "byte_end").bitwiseAND(F.lit((1 << 62) - 1))
    method = F.when(F.coalesce("fix_template", F.lit("")) != "", "template").otherwise("manual")
    out = met.select(
        "file_path", "change_id", "change_type", number.alias("id"), "byte_start", "byte_end", "line_start", "line_end",
        "matched_source", "arguments", method.alias("fix_method"), "fix_template", F.lit("pending").alias("status"),
    )
    return out.dropDuplicates(["file_path", "change_id", "byte_start", "byte_end"])
