"""Joins and filters behind reports: what a symbol, a change or a match is shown with, and which of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.classify import category
from tidemark.operators.lineage import checkpointed, meet

# Change types of removed structured entries and of what libraries lost, and their severities.
REMOVAL_TYPES = {
    "service": "service_removed", "route": "route_removed", "drupal_route": "route_removed", "permission": "permission_removed", "drupal_permission": "permission_removed",
    "config_schema": "config_key_removed", "module_info": "module_info_removed", "theme_info": "theme_info_removed", "profile_info": "profile_info_removed",
    "theme_engine_info": "theme_engine_info_removed", "link_menu": "link_menu_removed", "link_task": "link_task_removed", "link_action": "link_action_removed",
    "link_contextual": "link_contextual_removed", "config_export": "config_object_removed", "recipe_manifest": "recipe_removed",
}
LIBRARY_SEVERITY = {
    "library_removed": "breaking", "library_css_removed": "breaking", "library_js_removed": "breaking", "library_deprecated": "deprecation",
    "library_dependency_removed": "warning", "library_added": "modernization", "library_version_changed": "modernization",
}


def _mapped(value: Column, table: dict[str, str], default: str | None = None) -> Column:
    out = F.lit(default).cast("string")
    for key, to in table.items():
        out = F.when(value == key, to).otherwise(out)
    return out


def symbols_with_files(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with the path of their file; a symbol without a file is left out."""
    return symbols.join(files.select(F.col("id").alias("file_id"), "file_path"), "file_id")


def filtered(symbols: DataFrame, symbol_type: str | None = None, language: str | None = None, text: str | None = None) -> DataFrame:
    """Symbols under the filters that are given; an empty filter is none."""
    out = symbols
    if symbol_type:
        out = out.where(F.col("symbol_type") == symbol_type)
    if language:
        out = out.where(F.col("language") == language)
    if text:
        out = out.where(F.col("fqn").ilike(f"%{text}%") | F.col("name").ilike(f"%{text}%"))
    return out


def faceted(matches: DataFrame, severity=(), categories=(), fixability=(), change_type=(), path: str | None = None) -> DataFrame:
    """Matches that pass every facet that is not empty.

    Severities and change types are looked for as parts, ``fixability`` holds "fixable",
    "manual" or both, and in a path pattern * and ? stand for any text and character.
    """
    out = matches
    some = lambda column, parts: reduce(lambda a, b: a | b, [F.coalesce(column, F.lit("")).contains(p) for p in parts])
    fixable = F.coalesce(F.col("fix_method") == "template", F.lit(False))
    if severity:
        out = out.where(some(F.lower("severity"), severity))
    if categories:
        out = out.where(category(F.col("change_type")).isin(*categories))
    if "fixable" in fixability:
        out = out.where(fixable)
    if "manual" in fixability:
        out = out.where(~fixable)
    if change_type:
        out = out.where(some(F.col("change_type"), change_type))
    if path:
        out = out.where(F.col("file_path").rlike(path.replace("*", ".*").replace("?", ".")))
    return out


def latest_run(runs: DataFrame, by: list[str], status: str | None = None) -> DataFrame:
    """The run of greatest id of each project or branch, of one status if given."""
    of = runs if status is None else runs.where(F.col("status") == status)
    rest = [c for c in runs.columns if c not in by]
    last = of.groupBy(*by).agg(F.max_by(F.struct(*rest), "id").alias("last"))
    return last.select(*by, *(F.col(f"last.{c}").alias(c) for c in rest))


def match_details(matches: DataFrame, changes: DataFrame, runs: DataFrame, projects: DataFrame) -> DataFrame:
    """Matches with their run's project and, where they have one, their change's names."""
    told = changes.select(F.col("id").alias("change_id"), "old_fqn", "new_fqn")
    of_run = runs.select(F.col("id").alias("scan_run_id"), "project_id").join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project")), "project_id")
    return matches.join(of_run, "scan_run_id").join(told, "change_id", "left")


def version_pairs(changes: DataFrame, versions: DataFrame) -> DataFrame:
    """(from_tag, to_tag, n): how many changes there are from one version to another."""
    n = changes.groupBy("from_version_id", "to_version_id").agg(F.count("*").alias("n"))
    of = lambda side: versions.select(F.col("id").alias(f"{side}_version_id"), F.col("tag").alias(f"{side}_tag"))
    return n.join(of("from"), "from_version_id").join(of("to"), "to_version_id").select("from_tag", "to_tag", "n")


def with_symbols(changes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Changes with file and line of their old and new symbol, where they have one."""
    of = lambda side: symbols.select(F.col("id").alias(f"{side}_symbol_id"), F.col("file_path").alias(f"{side}_path"), F.col("symbol_type").alias(f"{side}_type"))
    return changes.join(of("old"), "old_symbol_id", "left").join(of("new"), "new_symbol_id", "left")


def stale(matches: DataFrame, changes: DataFrame, current: int) -> DataFrame:
    """Matches whose change was written for another query version; none counts as 0."""
    old = changes.where(F.coalesce("query_version", F.lit(0)).cast("int") != current).select(F.col("id").alias("change_id"))
    return matches.join(old, "change_id", "left_semi")


def require_current(changes: DataFrame, current: int) -> DataFrame:
    """The changes, if all are of the current query version."""
    old = changes.where(F.coalesce("query_version", F.lit(0)).cast("int") != current)
    if not old.isEmpty():
        raise ValueError(f"changes were written for another query version than {current}: make the diff anew")
    return changes


#: Characters of a name that a containing path has to share before it is looked at.
GRAM = 3


def contained(paths: DataFrame, names: DataFrame) -> DataFrame:
    """(file_path, machine_name) of all paths that hold a name somewhere, whatever the case.

    Distinct paths are cut into their grams, and every name meets them by that one of its own
    grams which the fewest paths have, an equi-join; only such pairs are compared. So what
    names begin with alike doesn't bring them together. Names shorter than a gram meet paths by
    grams of their own length. Grams that no name has are dropped where paths are cut: the
    names' distinct grams are sent to all tasks, as many as letters make, not as there are names.
    """
    each = names.select("machine_name").distinct().where("machine_name <> ''")
    sizes = F.explode(F.array(*(F.lit(k) for k in range(1, GRAM + 1)))).alias("size")
    cut = paths.select("file_path").distinct().select("file_path", sizes).where(F.length("file_path") >= F.col("size"))
    own = each.select("machine_name", F.explode(F.array_distinct(_grams("machine_name", F.least(F.length("machine_name"), F.lit(GRAM))))).alias("gram"))
    grams = cut.select("file_path", F.explode(F.array_distinct(_grams("file_path", F.col("size")))).alias("gram"))
    grams = grams.join(F.broadcast(own.select("gram").distinct()), "gram", "left_semi")
    common = grams.groupBy("gram").agg(F.count("*").alias("paths"))
    # A gram that no path has is the rarest of all: its name is nowhere.
    rarest = meet(own, common, "gram", "left").groupBy("machine_name").agg(F.min_by("gram", F.struct(F.coalesce("paths", F.lit(0)), F.col("gram"))).alias("gram"))
    met = meet(grams, rarest, "gram").where(F.lower("file_path").contains(F.lower("machine_name")))
    return met.select("file_path", "machine_name").distinct()


def _grams(text: str, size: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda k: F.lower(F.substr(text, k, size)))


def changes_by_extension(changes: DataFrame, extensions: DataFrame) -> DataFrame:
    """(machine_name, n): changes whose file's path holds the extension's name; changes are counted by path first."""
    by_path = changes.groupBy("file_path").agg(F.count("*").alias("n"))
    return by_path.join(contained(by_path, extensions), "file_path").groupBy("machine_name").agg(F.sum("n").alias("n"))


def types_by_language(symbols: DataFrame) -> DataFrame:
    """(language, types): the sorted types that each language has."""
    return symbols.select("language", "symbol_type").distinct().groupBy("language").agg(F.array_sort(F.collect_list("symbol_type")).alias("types"))


def library_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(fqn, change_type, severity, item) of libraries that came, went, lost assets or were deprecated.

    Both sides have fqn, css, js and dependencies (arrays) and is_deprecated; one full
    outer join by name.
    """
    lists = {"css": "library_css_removed", "js": "library_js_removed", "dependencies": "library_dependency_removed"}
    sides = [df.select("fqn", *(F.col(c).alias(f"{s}_{c}") for c in (*lists, "is_deprecated")), F.lit(True).alias(s)) for df, s in ((old, "o"), (new, "n"))]
    both = sides[0].join(sides[1], "fqn", "full_outer")
    none = F.array().cast("array<string>")
    here = F.col("o").isNotNull() & F.col("n").isNotNull()
    change = lambda kind: lambda item: F.struct(F.lit(kind).alias("change_type"), item.alias("item"))
    whole = F.array(
        F.when(F.col("n").isNull(), change("library_removed")(F.lit(None).cast("string"))),
        F.when(F.col("o").isNull(), change("library_added")(F.lit(None).cast("string"))),
        F.when(here & (F.coalesce("o_is_deprecated", F.lit(0)) == 0) & (F.col("n_is_deprecated") == 1), change("library_deprecated")(F.lit(None).cast("string"))),
    )
    lost = [F.when(here, F.transform(F.array_except(F.coalesce(f"o_{c}", none), F.coalesce(f"n_{c}", none)), change(kind))) for c, kind in lists.items()]
    kind = "array<struct<change_type:string,item:string>>"
    every = F.concat(F.array_compact(whole), *(F.coalesce(x, F.array().cast(kind)) for x in lost))
    return both.select("fqn", F.explode(every).alias("x")).select("fqn", "x.change_type", _mapped(F.col("x.change_type"), LIBRARY_SEVERITY, "warning").alias("severity"), "x.item")


def removal_type(symbol_type: Column) -> Column:
    """The change type of a removed structured entry; null for other symbols."""
    return _mapped(symbol_type, REMOVAL_TYPES)


def changed_type(symbol_type: Column, old: Column, new: Column) -> Column:
    """The change type of a structured entry whose JSON differs between two versions."""
    differs = lambda path: ~F.get_json_object(old, path).eqNullSafe(F.get_json_object(new, path))
    items = lambda c, key: F.array_sort(F.coalesce(F.from_json(F.get_json_object(c, f"$.{key}"), "array<string>"), F.array().cast("array<string>")))
    lists = lambda key: items(old, key) != items(new, key)
    info = symbol_type.isin("module_info", "theme_info", "profile_info", "theme_engine_info")
    return (
        F.when(symbol_type == "service", F.when(differs("$.class"), "service_class_changed").otherwise("service_changed"))
        .when(symbol_type.isin("module_info", "profile_info") & lists("dependencies"), F.concat(F.regexp_replace(symbol_type, "_info$", ""), F.lit("_dependencies_changed")))
        .when((symbol_type == "theme_info") & ~lists("dependencies") & differs("$['base theme']"), "theme_base_changed")
        .when(symbol_type == "recipe_manifest", F.when(lists("install"), "recipe_install_changed").otherwise("recipe_changed"))
        .when(info, F.concat(symbol_type, F.lit("_changed")))
        .otherwise(F.concat(symbol_type, F.lit("_changed")))
    )


def recent(rows: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The last ``n`` rows, the earliest of them first."""
    return rows.orderBy(F.desc(order)).limit(n).orderBy(order)


def match_rows(found: DataFrame, changes: DataFrame) -> DataFrame:
    """Found places as match rows: fixed by template where their change has one, by hand else; pending."""
    told = changes.select(F.col("id").alias("change_id"), "fix_template")
    method = F.when(F.coalesce("fix_template", F.lit("")) != "", "template").otherwise("manual")
    return found.join(told, "change_id", "left").withColumn("fix_method", method).withColumn("status", F.lit("pending")).drop("fix_template")


def backfilled(matches: DataFrame) -> DataFrame:
    """Matches with their scope (their run, or else their project) and places, where those are missing."""
    scope = F.when(F.col("scan_run_id").isNotNull(), F.concat(F.lit("run:"), "scan_run_id")).otherwise(F.concat(F.lit("project:"), "project_id"))
    kept = F.when(F.coalesce("scope_key", F.lit("")) == "", scope).otherwise(F.col("scope_key"))
    return matches.withColumns({"scope_key": kept, "byte_start": F.coalesce("byte_start", F.lit(-1)), "byte_end": F.coalesce("byte_end", F.lit(-1))})


def attached(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(call id, symbol id): each call of a file with the last symbol that starts before it there, as-of by line.

    Symbols and calls are sorted together by ranges of file and line, so a long file is spread
    over many. A range looks back in itself first, and then to the last symbol that earlier
    ranges have of the file, one row a range and file. A call before all symbols has none.
    """
    both = symbols.select("file_path", "line_start", F.col("id").alias("symbol_id"), F.lit(None).cast("long").alias("call_id"))
    both = both.unionByName(calls.select("file_path", "line_start", F.lit(None).cast("long").alias("symbol_id"), F.col("id").alias("call_id")))
    order = [F.col("file_path").asc_nulls_first(), F.col("line_start").asc_nulls_first(), F.col("call_id").asc_nulls_first(), F.col("symbol_id").asc_nulls_first()]
    placed = checkpointed(both.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())).withColumn("range_no", F.shiftright("at", 33))
    inside = Window.partitionBy("range_no", "file_path").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = placed.withColumn("near", F.last("symbol_id", ignorenulls=True).over(inside))
    earlier = Window.partitionBy("file_path").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    every = placed.groupBy("file_path", "range_no").agg(F.max_by("symbol_id", F.when(F.col("symbol_id").isNotNull(), F.col("at"))).alias("end"))
    far = every.select(F.col("file_path").alias("of"), F.col("range_no").alias("no"), F.last("end", ignorenulls=True).over(earlier).alias("far"))
    met = near.where("call_id is not null").join(far, F.col("file_path").eqNullSafe(F.col("of")) & (F.col("range_no") == F.col("no")), "left")
    return met.select("call_id", F.coalesce("near", "far").alias("symbol_id"))


def library_matches(usage: DataFrame, changes: DataFrame) -> DataFrame:
    """Uses of a library that a change of libraries names, by its name."""
    of = changes.where(F.col("change_type").startswith("library_")).select(F.col("id").alias("change_id"), "change_type", F.col("old_fqn").alias("fqn"))
    return usage.join(of, "fqn")


def project_extensions(symbols: DataFrame) -> DataFrame:
    """(machine_name, extension_type, dependencies, file_path) of the manifests among a project's symbols.

    A manifest's type loses its ending; a recipe depends on what it installs and on the
    recipes it names. A file gives one extension, its first symbol by id.
    """
    kinds = symbols.where(F.col("symbol_type").endswith("_info") | (F.col("symbol_type") == "recipe_manifest"))
    rest = [c for c in kinds.columns if c != "file_path"]
    first = kinds.groupBy("file_path").agg(F.min_by(F.struct(*rest), "id").alias("s")).select("file_path", "s.*")
    items = lambda path: F.coalesce(F.from_json(F.get_json_object("signature_json", path), "array<string>"), F.array().cast("array<string>"))
    recipe = F.col("symbol_type") == "recipe_manifest"
    needs = F.when(recipe, F.array_union(items("$.install"), items("$.recipes"))).otherwise(items("$.dependencies"))
    kind = F.when(recipe, "recipe").otherwise(F.regexp_replace("symbol_type", "_info$", ""))
    return first.select(F.col("fqn").alias("machine_name"), kind.alias("extension_type"), needs.alias("dependencies"), "file_path")
