"""Edges between symbols, links to a symbol, and the search over everything a symbol tells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import jsonpath
from tidemark.operators.lineage import blocked, meet

# The JSON paths that a search looks at, by how their value is compared.
EXACT_OR_PART = (("metadata_json", "$.owner"), ("signature_json", "$.class"), ("signature_json", "$.path"), ("signature_json", "$.controller"))
EXACT = tuple(("metadata_json", f"$.{k}") for k in ("configure_route", "base_theme", "route_name", "base_route", "parent", "parent_id"))
PART = (("metadata_json", "$.label"),)
MEMBER = tuple(("metadata_json", f"$.{k}") for k in ("mentioned_extensions", "dependency_targets", "route_refs", "install", "recipes", "asset_paths", "css_assets", "javascript_assets", "dependency_libraries"))


def search(symbols: DataFrame, term: str, types: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Symbols whose name, or anything in their JSON that names others, is or holds the term, by type and name."""
    part = f"%{term}%"
    found = F.col("fqn").ilike(part) | F.col("name").ilike(part)
    for column, path in EXACT_OR_PART + PART:
        found = found | F.coalesce(jsonpath.scalar(F.col(column), path).ilike(part), F.lit(False))
    for column, path in EXACT:
        found = found | F.coalesce(jsonpath.scalar(F.col(column), path) == term, F.lit(False))
    for column, path in MEMBER:
        found = found | jsonpath.holds(F.col(column), path, term)
    out = symbols.where(found if types is None else found & F.col("symbol_type").isin(types)).orderBy("symbol_type", "fqn", "id")
    return out if limit is None else out.limit(limit)


def _first(symbols: DataFrame, types: tuple[str, ...], alias: str) -> DataFrame:
    """The symbol of least id for each version and name among some types."""
    return symbols.where(F.col("symbol_type").isin(*types)).groupBy("version_id", F.col("fqn").alias("target")).agg(F.min("id").alias(alias))


def relations(symbols: DataFrame) -> DataFrame:
    """(version_id, from_symbol_id, to_symbol_id, relation_type) of services, routes and plugins to code.

    A route's controller ``Class::method`` leads to the method, or to the class where
    there is no such method. One equi-join for each kind of target.
    """
    bare = lambda c: F.expr(f"trim(LEADING '\\\\' FROM {c})")
    classes, methods = _first(symbols, ("class", "interface"), "class_id"), _first(symbols, ("method",), "method_id")
    told = symbols.withColumns({"c": F.get_json_object("metadata_json", "$.class"), "k": F.get_json_object("metadata_json", "$.controller")})
    kinds = (("service", bare("c"), "service_class"), ("route", bare("k"), "controller_route"), ("plugin_definition", bare("coalesce(c, parent_symbol)"), "plugin_definition"))
    source = None
    for kind, target, relation in kinds:
        rows = told.where(F.col("symbol_type") == kind).select("version_id", F.col("id").alias("from_symbol_id"), target.alias("target"), F.lit(relation).alias("relation_type"))
        source = rows if source is None else source.unionByName(rows)
    source = source.where("target is not null").withColumn("owner", F.substring_index("target", "::", 1))
    met = source.join(methods, ["version_id", "target"], "left").join(classes.withColumnRenamed("target", "owner"), ["version_id", "owner"], "left")
    return met.select("version_id", "from_symbol_id", F.coalesce("method_id", "class_id").alias("to_symbol_id"), "relation_type").where("to_symbol_id is not null").distinct()


def asset_links(libraries: DataFrame, assets: DataFrame) -> DataFrame:
    """(library fqn, asset id, relationship) from the asset paths in a library's metadata to asset symbols."""
    out = None
    for path, relationship in (("$.css_assets", "css_asset_symbol"), ("$.javascript_assets", "javascript_asset_symbol")):
        items = F.explode(F.from_json(F.get_json_object("metadata_json", path), "array<string>")).alias("file_path")
        rows = libraries.select("fqn", items).withColumn("relationship", F.lit(relationship))
        out = rows if out is None else out.unionByName(rows)
    return out.join(assets.select(F.col("id").alias("asset_id"), "file_path"), "file_path").select("fqn", "asset_id", "relationship")


def dependents(extensions: DataFrame) -> DataFrame:
    """(machine_name, dependent) for every entry of every dependency list."""
    return extensions.select(F.explode("dependencies").alias("machine_name"), F.col("machine_name").alias("dependent"))


def dependency_impact(extensions: DataFrame, changes: DataFrame) -> DataFrame:
    """Per extension its own changes, those of its direct dependencies, and both; the most first.

    ``changes`` has the machine_name that each change belongs to.
    """
    own = changes.groupBy("machine_name").agg(F.count("*").alias("n"))
    deps = extensions.select(F.col("machine_name").alias("node"), F.explode("dependencies").alias("machine_name")).distinct()
    of_deps = deps.join(own, "machine_name").groupBy(F.col("node").alias("machine_name")).agg(F.sum("n").alias("dependency_changes"))
    out = extensions.select("machine_name").join(own.withColumnRenamed("n", "direct_changes"), "machine_name", "left").join(of_deps, "machine_name", "left")
    return out.fillna(0).withColumn("total", F.col("direct_changes") + F.col("dependency_changes")).orderBy(F.desc("total"), "machine_name")


def match_group(extensions: DataFrame, groups: DataFrame) -> DataFrame:
    """The match group of each extension: that of its folder, else the largest of its name's folder.

    ``groups`` has extension (a path) and count.
    """
    folder = F.when(F.col("file_path").endswith(".yml"), F.when(F.col("file_path").contains("/"), F.regexp_replace("file_path", "/[^/]*$", "")).otherwise(F.col("machine_name"))).otherwise(F.rtrim(F.col("file_path"), F.lit("/")))
    exact = groups.select(F.col("extension").alias("folder"), F.col("extension").alias("exact"))
    named = groups.groupBy(F.element_at(F.split("extension", "/"), -1).alias("machine_name")).agg(F.max_by("extension", F.struct("count", "extension")).alias("named"))
    return extensions.withColumn("folder", folder).join(exact, "folder", "left").join(named, "machine_name", "left").select("machine_name", F.coalesce("exact", "named").alias("extension"))


def owner_of(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """(file_path, owner): the manifest of the deepest folder above a file.

    Folders of files, which are far fewer, are met with all folders above them by an equi-join; a
    file gets the owner of its own folder, in blocks, so that no task holds all files of a folder.
    Of two manifests in one folder the greater owner counts.
    """
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    owners = manifests.groupBy("folder").agg(F.max("owner").alias("owner")).where("folder is not null")
    split = files.select("file_path").where("file_path is not null").distinct().withColumn("folder", F.regexp_extract("file_path", "^(?s:(.*))/", 1))
    folders = split.select("folder").distinct()
    met = meet(folders.select("folder", F.explode(above).alias("upper")), owners.withColumnRenamed("folder", "upper"), "upper")
    best = met.groupBy("folder").agg(F.max_by("owner", F.length("upper")).alias("owner"))
    inherited = blocked(split.where(F.col("file_path").contains("/")), best, ["folder"], "file_path", "folder").select("file_path", "owner")
    own = owners.select(F.col("folder").alias("file_path"), F.col("owner").alias("own"))
    named = meet(split.select("file_path"), own, "file_path")
    kept = meet(inherited, own, "file_path", "left_anti")
    return kept.unionByName(named.select("file_path", F.col("own").alias("owner")))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(relation, n) of several tables in one result."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def status_counts(tables: dict[str, DataFrame], active: dict[str, Column]) -> DataFrame:
    """(relation, n, active): the rows of several tables, and for some how many of them a condition holds for."""
    out = None
    for name, df in tables.items():
        some = F.count_if(active[name]) if name in active else F.lit(None).cast("long")
        one = df.agg(F.count("*").alias("n"), some.alias("active")).select(F.lit(name).alias("relation"), "n", "active")
        out = one if out is None else out.unionByName(one)
    return out


def type_totals(symbols: DataFrame) -> DataFrame:
    """(language, symbol_type, n) with the totals of each language and of all, where type, and then language, are null."""
    return symbols.rollup("language", "symbol_type").agg(F.count("*").alias("n"))


def opportunities(symbols: DataFrame, hook_files: tuple[str, ...] = (".module", ".inc", ".install"), annotations: tuple[str, ...] = ()) -> DataFrame:
    """Virtual matches: functions with an underscore in hook files, and classes under legacy annotations."""
    in_hook_file = F.lit(False)
    for ending in hook_files:
        in_hook_file = in_hook_file | F.col("file_path").endswith(ending)
    hooks = symbols.where((F.col("symbol_type") == "function") & in_hook_file & F.col("name").contains("_"))
    hooks = hooks.select("file_path", "line_start", F.col("name").alias("matched_source"), F.lit("procedural_to_attribute").alias("change_type"))
    named = F.regexp_extract("docblock", r"@(\w+)\s*\(", 1) if "docblock" in symbols.columns else F.lit("")
    marked = symbols.where(F.col("symbol_type") == "class").select("file_path", "line_start", named.alias("a")).where(F.col("a").isin(*annotations))
    marked = marked.select("file_path", "line_start", F.concat(F.lit("@"), "a").alias("matched_source"), F.lit("annotation_to_attribute").alias("change_type"))
    return hooks.unionByName(marked).withColumn("severity", F.lit("info"))


def pattern(change_type: Column, name: Column) -> Column:
    """What a scan looks for: kind of match, literal, and a regular expression that finds it."""
    quoted = F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))
    rules = (
        (change_type.isin("function_removed", "function_renamed", "signature_changed", "function_call_rewrite"), "call", F.concat(F.lit(r"\b"), quoted, F.lit(r"\s*\("))),
        (change_type.isin("service_removed", "service_renamed", "service_changed", "service_class_changed", "route_removed", "route_renamed", "route_changed", "permission_removed", "permission_renamed"), "string", F.concat(F.lit("['\"]@?"), quoted, F.lit("['\"]"))),
        (change_type.startswith("config_") | change_type.startswith("library_"), "string", F.concat(F.lit("['\"]?"), quoted, F.lit("['\"]?"))),
        (change_type == "global_replaced", "global", F.concat(F.lit(r"(?:global\s+\$|\$GLOBALS\[['\"])"), quoted)),
        (change_type == "variable_access_replaced", "property", F.concat(F.lit("->"), quoted, F.lit(r"(?!\s*\()"))),
        (change_type == "constant_replaced", "constant", F.concat(F.lit(r"\b"), quoted, F.lit(r"\b"))),
        (change_type.endswith("_removed") | change_type.endswith("_renamed") | (change_type == "deprecated_added"), "name", F.concat(F.lit(r"\b"), quoted, F.lit(r"\b"))),
    )
    out = None
    for fits, kind, regex in rules:
        one = F.struct(F.lit(kind).alias("match_kind"), name.alias("literal"), regex.alias("regex"))
        out = F.when(fits & (name != ""), one) if out is None else out.when(fits & (name != ""), one)
    return out


def fix_template(change_type: Column, old: Column, new: Column, added: Column) -> Column:
    """The JSON template that rewrites a use, null where there is no mechanical fix.

    ``added`` is the array of signature changes; a template is made of a single added
    parameter alone. A class that only moved its namespace gets a namespace move.
    """
    space = lambda c: F.regexp_replace(c, r"\\[^\\]*$", "")
    last = lambda c: F.substring_index(c, "\\", -1)
    js = lambda **k: F.to_json(F.struct(*(v.alias(n) for n, v in k.items())))
    classlike = change_type.isin("class_renamed", "interface_renamed", "trait_renamed")
    moved = classlike & (last(old) == last(new)) & old.contains("\\") & new.contains("\\")
    renamed = change_type.isin("method_renamed", "constant_renamed", "service_renamed", "route_renamed", "permission_renamed", "config_key_renamed", "library_renamed") | classlike
    some = (old != new) & (old != "") & (new != "")
    single = (F.size(added) == 1) & (F.get(added, F.lit(0))["type"] == "parameter_added")
    return (
        F.when((change_type == "function_renamed") & some, js(type=F.lit("function_rename"), old=old, new=new))
        .when(moved & some, js(type=F.lit("namespace_move"), old_namespace=space(old), new_namespace=space(new)))
        .when(renamed & some, js(type=F.lit("string_replace"), old=old, new=new))
        .when((change_type == "signature_changed") & single, js(type=F.lit("parameter_insert"), function=old, position=F.get(added, F.lit(0))["position"], value=F.lit("NULL")))
    )
