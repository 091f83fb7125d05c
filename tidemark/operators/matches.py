"""Matches of changes in project files: how they are found, joined, counted and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.classify import category, group_of_path, severity_score


def overlay(matches: DataFrame, changes: DataFrame, kind: str = "left") -> DataFrame:
    """Matches with their change's columns where they have none of their own; ``inner`` drops virtual ones."""
    own = ["change_type", "severity", "old_fqn", "migration_hint"]
    c = changes.select(F.col("id").alias("change_id"), *(F.col(x).alias(f"_{x}") for x in own), "new_fqn", "fix_template", "diff_json")
    out = matches.join(c, "change_id", kind)
    return out.withColumns({x: F.coalesce(x, f"_{x}") for x in own}).drop(*(f"_{x}" for x in own))


def text_matches(files: DataFrame, changes: DataFrame) -> DataFrame:
    """(file_path, change id) where a changed name occurs in a file of its language.

    Texts are cut into their distinct words once and met with short names by an equi-join,
    so the cost follows the words there are, not files times changes.
    """
    word = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), 1))).alias("word")
    words = files.select("file_path", "language", word)
    short = F.element_at(F.split(F.regexp_replace("old_fqn", r"^.*(?:\\|::)", ""), r"\."), -1)
    names = changes.select(F.col("id").alias("change_id"), "language", short.alias("word"))
    return words.join(names, ["language", "word"])


def passes_argument_count(call: Column, old: Column, new: Column) -> Column:
    """Whether a call can be affected by a change from ``old`` to ``new`` parameters."""
    return F.when(new > old, call < new).when(new < old, call > new).otherwise(True)


def summary(matches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals, and counts by severity, change type and category as maps, for each ``by`` group."""
    by = by or []
    cells = matches.groupBy(*by, "severity", "change_type", "fix_method").agg(F.count("*").alias("n"))
    cells = cells.withColumns({"severity": F.coalesce("severity", F.lit("unknown")), "change_type": F.coalesce("change_type", F.lit("unknown"))})
    cells = cells.withColumn("category", category(F.col("change_type")))
    parts = {c: cells.groupBy(*by, c).agg(F.sum("n").alias("n")).groupBy(*by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(c, "n")))).alias(f"by_{c}")) for c in ("severity", "change_type", "category")}
    total = cells.groupBy(*by).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("fix_method") == "template", F.col("n")).otherwise(0)).alias("auto_fixable"), F.sum(severity_score(F.col("severity"), F.col("n"))).alias("score"))
    for part in parts.values():
        total = total.join(part, by) if by else total.crossJoin(part)  # without groups each side is one row
    return total


def by_path_group(matches: DataFrame) -> DataFrame:
    """Match counts by the extension that a path belongs to, with severity and category; most first."""
    return (
        matches.groupBy(group_of_path(F.col("file_path")).alias("extension"), F.coalesce("severity", F.lit("unknown")).alias("severity"), category(F.col("change_type")).alias("category"))
        .agg(F.count("*").alias("n"))
        .withColumn("extension_total", F.sum("n").over(Window.partitionBy("extension")))
    )


def compare_runs(base: DataFrame, head: DataFrame) -> DataFrame:
    """(change_id, file_path, delta): introduced, resolved or persisting, per key of both runs."""
    key = ["change_id", "file_path"]
    valid = "change_id > 0 and file_path <> ''"
    last = lambda df, c: df.where(valid).groupBy(*key).agg(F.max_by("severity", "id").alias(f"{c}_severity"), F.lit(1).alias(c))
    both = last(base, "b").join(last(head, "h"), key, "full_outer")
    delta = F.when(F.col("b").isNull(), "introduced").when(F.col("h").isNull(), "resolved").otherwise("persisting")
    return both.select(*key, delta.alias("delta"), F.coalesce("h_severity", "b_severity").alias("severity"))


def upgrade_path(changes: DataFrame, versions: DataFrame, start: int, end: int) -> DataFrame:
    """Changes whose version pair lies within the weights of two versions; versions are few and broadcast."""
    if start == end:
        return changes.limit(0)
    bounds = {r.id: r.weight for r in versions.where(F.col("id").isin(start, end)).select("id", "weight").collect()}
    v = versions.select("id", "weight")
    out = changes.join(v.select(F.col("id").alias("from_version_id"), F.col("weight").alias("from_weight")), "from_version_id")
    out = out.join(v.select(F.col("id").alias("to_version_id"), F.col("weight").alias("to_weight")), "to_version_id")
    return out.where((F.col("from_weight") >= bounds[start]) & (F.col("to_weight") <= bounds[end]) & (F.col("from_weight") < F.col("to_weight"))).distinct()


def nearest_version(versions: DataFrame, weight: int) -> DataFrame:
    return versions.orderBy(F.abs(F.col("weight") - weight), "id").limit(1)
