"""All streams of changes between two versions of the symbols relation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.classify import risk
from tidemark.operators import diff, relations, rename, reports, structure
from tidemark.operators.lineage import checkpointed

CHANGE = (
    "language string, change_type string, severity string, old_symbol_id long, new_symbol_id long, old_fqn string, new_fqn string, "
    "confidence double, migration_hint string, diff_json string, fix_template string"
)
_COLUMNS = [x.split() for x in CHANGE.split(", ")]
_SYMBOL = ("id", "language", "symbol_type", "fqn", "name", "namespace", "parent_symbol", "signature_json", "signature_hash", "is_deprecated", "deprecation_message", "source_text", "metadata_json")

# The change type of a structured entry whose content differs, but for those that the content itself tells.
CHANGED_TYPES = {
    "route": "route_changed", "library": "library_changed", "theme_engine_info": "theme_engine_info_changed", "link_menu": "link_menu_changed", "link_task": "link_task_changed",
    "link_action": "link_action_changed", "link_contextual": "link_contextual_changed", "config_export": "config_object_changed",
}


def changed_type(symbol_type: Column, old: Column, new: Column) -> Column:
    """The change type of a structured entry, null for kinds whose content isn't followed."""
    out = F.lit(None).cast("string")
    for kind, change in CHANGED_TYPES.items():
        out = F.when(symbol_type == kind, change).otherwise(out)
    told = symbol_type.isin("service", "module_info", "profile_info", "theme_info", "recipe_manifest")
    return F.when(told, reports.changed_type(symbol_type, old, new)).otherwise(out)


def _rows(frame: DataFrame, **columns) -> DataFrame:
    """``frame`` as change rows; columns that aren't given are null."""
    made = [(columns.get(name, F.lit(None)) if not isinstance(columns.get(name), str) else F.lit(columns[name])).cast(kind).alias(name) for name, kind in _COLUMNS]
    return frame.select(*made)


def _symbols(version: DataFrame) -> DataFrame:
    have = set(version.columns)
    return version.select(*(F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in _SYMBOL))


def version_changes(old: DataFrame, new: DataFrame, structured: str = "yaml", renames: bool = True) -> DataFrame:
    """Change rows between two versions: every stream, a row for each thing that a user has to see to.

    Renames (of code, then of structured entries) take the symbols they match out of the removals.
    Removed entries are named by their type. What is in both versions can change its signature or
    content, and become deprecated, at once: each is a row of its own, and a changed signature of
    a method with a parent is one more for those who override it. What was deprecated and is gone
    is a removal that was announced. Libraries tell what they lost, and procedural hooks that now
    exist as attributes can be modernised.

    Both versions meet once, in one full outer join by name and type that keeps what differs;
    every stream but libraries and hooks reads its result. Null names never meet.
    """
    old, new = _symbols(old), _symbols(new)
    key = F.struct
    left = old.select("fqn", "symbol_type", key(*_SYMBOL).alias("o"))
    right = new.select("fqn", "symbol_type", key(*_SYMBOL).alias("n"))
    deprecated = (F.coalesce("o.is_deprecated", F.lit(0)) == 0) & (F.col("n.is_deprecated") == 1)
    both = left.join(right, ["fqn", "symbol_type"], "full_outer")
    both = both.where(F.col("o").isNull() | F.col("n").isNull() | (F.col("o.signature_hash") != F.col("n.signature_hash")) | deprecated)
    both = checkpointed(both.select("o", "n"))
    gone, fresh = both.where("n is null").select("o.*"), both.where("o is null").select("n.*")
    entry = F.col("language") == structured
    streams = []
    if renames:
        code = checkpointed(rename.renames(gone, fresh))
        kinds = gone.select(F.col("id").alias("old_id"), "language", "symbol_type")
        hint = F.concat(F.lit("This "), F.replace("symbol_type", F.lit("_"), F.lit(" ")), F.lit(" was renamed to "), "new_fqn", F.lit("."))
        change = F.concat("symbol_type", F.lit("_renamed"))
        template = relations.fix_template(change, F.col("old_fqn"), F.col("new_fqn"), F.array().cast("array<struct<type:string,position:int,old:string,new:string>>"))
        renamed = {"old_symbol_id": F.col("old_id"), "new_symbol_id": F.col("new_id"), "old_fqn": F.col("old_fqn"), "new_fqn": F.col("new_fqn"), "confidence": F.col("score")}
        streams.append(_rows(code.join(kinds, "old_id"), language=F.col("language"), change_type=change, severity="breaking", migration_hint=hint, fix_template=template, **renamed))
        entries = checkpointed(structure.renames(gone.where(entry), fresh.where(entry)))
        template = relations.fix_template(F.col("change_type"), F.col("old_fqn"), F.col("new_fqn"), F.array().cast("array<struct<type:string,position:int,old:string,new:string>>"))
        streams.append(_rows(entries, language=structured, change_type=F.col("change_type"), severity="breaking", fix_template=template, **renamed))
        consumed = code.select(F.col("old_id").alias("id")).union(entries.select("old_id")).distinct()
        left_over = gone.join(consumed, "id", "left_anti")
    else:
        left_over = gone
    was = {"language": F.col("language"), "old_symbol_id": F.col("id"), "old_fqn": F.col("fqn")}
    by_type = F.concat(F.coalesce("symbol_type", F.lit("symbol")), F.lit("_removed"))
    removal = reports.removal_type(F.col("symbol_type"))
    streams.append(_rows(left_over.where(entry).where(removal.isNotNull()), change_type=removal, severity="breaking", **was))
    other = left_over.where(~entry | F.col("language").isNull())
    streams.append(_rows(other.where(F.coalesce("is_deprecated", F.lit(0)) != 1), change_type=by_type, severity="breaking", migration_hint=F.col("deprecation_message"), **was))
    streams.append(_rows(gone.where("is_deprecated = 1"), change_type=by_type, severity="removal", migration_hint=F.col("deprecation_message"), **was))

    changed = both.where("o.signature_hash <> n.signature_hash")
    pair = {"old_symbol_id": F.col("o.id"), "new_symbol_id": F.col("n.id"), "old_fqn": F.col("o.fqn"), "new_fqn": F.col("n.fqn"), "language": F.col("o.language")}
    content = changed.where(F.col("o.language") == structured).withColumn("kind", changed_type(F.col("o.symbol_type"), F.col("o.signature_json"), F.col("n.signature_json"))).where("kind is not null")
    told = structure.details(F.col("o.symbol_type"), F.col("o.signature_json"), F.col("n.signature_json"))
    streams.append(_rows(content, change_type=F.col("kind"), severity="breaking", diff_json=told, **pair))
    steps = changed.where((F.col("o.language") != structured) | F.col("o.language").isNull()).withColumn("steps", diff.signature_changes(F.col("o.signature_json"), F.col("n.signature_json"))).where(F.size("steps") > 0)
    told = F.to_json(F.struct(F.col("steps").alias("changes"), F.try_parse_json("o.signature_json").alias("old"), F.try_parse_json("n.signature_json").alias("new")))
    template = relations.fix_template(F.lit("signature_changed"), F.col("o.fqn"), F.col("n.fqn"), F.col("steps"))
    streams.append(_rows(steps, change_type="signature_changed", severity="breaking", diff_json=told, fix_template=template, **pair))
    streams.append(_rows(steps.where("o.symbol_type = 'method' and o.parent_symbol <> ''"), change_type="inheritance_impact", severity="breaking", diff_json=told, **pair))
    newly = both.where(F.col("o").isNotNull() & F.col("n").isNotNull() & deprecated)
    streams.append(_rows(newly, change_type="deprecated_added", severity="deprecation", migration_hint=F.col("n.deprecation_message"), **{**pair, "old_symbol_id": F.lit(None)}))

    streams += [_library_rows(old, new), _hook_rows(old, new)]
    out = reduce(DataFrame.unionByName, streams)
    return out.withColumn("confidence", F.coalesce("confidence", risk(F.col("change_type"))["confidence"]))


def _library_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """What libraries lost or became, from the lists of their metadata."""
    shape = F.from_json("metadata_json", "struct<css_assets:array<string>,javascript_assets:array<string>,dependency_libraries:array<string>>")
    sides = [v.where("symbol_type = 'library'").select("id", "fqn", "language", shape["css_assets"].alias("css"), shape["javascript_assets"].alias("js"), shape["dependency_libraries"].alias("dependencies"), "is_deprecated") for v in (old, new)]
    found = reports.library_changes(*(s.drop("id", "language") for s in sides))
    found = found.join(sides[0].select("fqn", F.col("id").alias("old_id"), F.col("language").alias("a")), "fqn", "left").join(sides[1].select("fqn", F.col("id").alias("new_id"), F.col("language").alias("b")), "fqn", "left")
    item = F.when(F.col("item").isNotNull(), F.to_json(F.struct("item")))
    name = lambda side: F.when(F.col(f"{side}_id").isNotNull(), F.col("fqn"))
    return _rows(found, language=F.coalesce("a", "b"), change_type=F.col("change_type"), severity=F.col("severity"), old_symbol_id=F.col("old_id"), new_symbol_id=F.col("new_id"), old_fqn=name("old"), new_fqn=name("new"), diff_json=item)


def _hook_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Hooks without a namespace in the old version that exist with one in the new; of several old ones the last by id."""
    procedural = old.where("symbol_type = 'hook' and coalesce(namespace, '') = ''").groupBy("fqn").agg(F.max("id").alias("id"))
    attributes = new.where("symbol_type = 'hook' and namespace <> ''").select("fqn").distinct()
    hint = F.concat(F.lit("Hook '"), "fqn", F.lit("' can become an attribute of a class method."))
    return _rows(procedural.join(attributes, "fqn"), language="php", change_type="hook_to_attribute", severity="modernization", old_symbol_id=F.col("id"), old_fqn=F.col("fqn"), new_fqn=F.col("fqn"), confidence=F.lit(0.9), migration_hint=hint)
