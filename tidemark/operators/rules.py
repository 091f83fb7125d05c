"""External rules, kept in YAML files of four kinds, as change rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.extract import arrow_schema, batched
from tidemark.operators.lineage import checkpointed
from tidemark.operators.manifests import as_json, load

RULE = "file_path string, language string, change_type string, severity string, old_fqn string, new_fqn string, migration_hint string, fix_template string, confidence double"


def _rule(change_type: str, old: str, hint: str, confidence: float = 1.0, severity: str = "breaking", new: str | None = None, template: dict | None = None) -> tuple:
    return ("php", change_type, severity, old, new, hint, as_json(template) if template else None, confidence)


def _map(value) -> dict:
    return value if isinstance(value, dict) else {}


def _names(value, default: str) -> list[str]:
    return [str(x) for x in value] if isinstance(value, list) else [str(x) for x in value.values()] if isinstance(value, dict) else [default]


def _address(group: dict) -> str:
    docs = group.get("documentation")
    first = docs[0] if isinstance(docs, list) and docs else {}
    address = str(_map(first).get("url") or "")
    return f"\nSee: {address}" if address else ""


def grep_rules(data: dict) -> Iterator[tuple]:
    """Calls, globals and constants that are replaced one for one."""
    for old, new in _map(data.get("function_calls")).items():
        yield _rule("function_call_rewrite", str(old), f"{old}() → {new}()", 1.0, new=str(new), template={"type": "function_call_rewrite", "old": str(old), "new": str(new)})
    for name, new in _map(data.get("globals")).items():
        yield _rule("global_replaced", f"global.${name}", f"global ${name} → {new}", 0.9, new=str(new), template={"type": "global_replace", "variable": str(name), "replacement": str(new)})
    for old, new in _map(data.get("constants")).items():
        yield _rule("constant_replaced", str(old), f"{old} → {new}", 0.95, new=str(new), template={"type": "constant_replace", "old": str(old), "new": str(new)})


def function_rules(data: dict) -> Iterator[tuple]:
    """Functions that are gone, by groups with one message."""
    for name, group in data.items():
        group = _map(group)
        for function in _names(group.get("functions"), str(name)):
            hint = str(group.get("message") or "").replace("@function", function)
            if group.get("fixme"):
                hint += "\n" + str(group["fixme"]).replace("@function", function)
            yield _rule("function_disabled" if group.get("disable") else "function_removed", function, hint + _address(group))


def hook_rules(data: dict) -> Iterator[tuple]:
    for name, group in data.items():
        group = _map(group)
        for hook in _names(group.get("hook"), str(name)):
            hint = str(group.get("message") or "").replace("@hook", f"hook_{hook}") + _address(group)
            yield _rule("hook_removed", f"hook_{hook}", hint) if group.get("delete") else _rule("hook_deprecated", f"hook_{hook}", hint, severity="deprecation")


def rewriter_rules(data: dict) -> Iterator[tuple]:
    """Properties that are read through getters; those without one give no rule."""
    for kind, config in data.items():
        hinted = str(_map(config).get("type_hint") or "")
        for name, mapping in _map(_map(config).get("properties")).items():
            getter, setter = (str(_map(mapping).get(k) or "") for k in ("get", "set"))
            if getter:
                template = {"type": "variable_access", "property": str(name), "getter": getter, "setter": setter, "entity_type": str(kind), "type_hint": hinted}
                yield _rule("variable_access_replaced", f"{kind}.{name}", f"${kind}->{name} → ${kind}->{getter}()", 0.7, new=f"{hinted}::{getter}()" if hinted else getter, template=template)


#: Ends of file names, and what a file of that name holds.
KINDS = {"grep.yml": grep_rules, "functions.yml": function_rules, "hooks.yml": hook_rules, "rewriters.yml": rewriter_rules}


def import_rule_files(files: DataFrame) -> DataFrame:
    """Change rows of the rule files among (file_path, text) rows; a file that can't be parsed has none.

    A function that some file rewrites isn't told as gone as well.
    """
    schema = arrow_schema(RULE.replace("double", "string"))
    schema = schema.set(schema.get_field_index("confidence"), pa.field("confidence", pa.float64()))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader = next((r for end, r in KINDS.items() if (path or "").endswith(end)), None)
                data = load(text)[0] if reader and text else None
                if isinstance(data, dict):
                    yield from ((path, *x) for x in reader(data))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(told(batches), schema)

    found = checkpointed(files.select("file_path", "text").mapInArrow(run, RULE))
    rewritten = found.where("change_type = 'function_call_rewrite'").select(F.col("old_fqn").alias("known")).distinct()
    gone = found.where(F.col("change_type").isin("function_removed", "function_disabled")).join(rewritten, F.col("old_fqn") == F.col("known"), "left_anti")
    return found.where(~F.col("change_type").isin("function_removed", "function_disabled")).unionByName(gone)
