"""Source trees as DataFrames of files, and what their manifests say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.classify import language

#: Folders that no scan enters.
PRUNED = ("vendor", "node_modules", ".git", ".cache", ".data")


def read_tree(spark: SparkSession, root: str, pruned: tuple[str, ...] = PRUNED, dropped: tuple[str, ...] = ()) -> DataFrame:
    """file_path (relative), language, text, byte_size and file_hash of classified files under a folder.

    ``dropped`` prefixes of relative paths are left out too (a project's own core, say). Folders
    that are left out are never opened.
    """
    from tidemark.sources.tree import source_tree

    files = source_tree(spark, root, pruned=",".join(pruned), dropped=",".join(dropped))
    out = files.select("file_path", language(F.col("file_path")).alias("language"), "text", "byte_size", "file_hash")
    return out.where(F.col("language").isNotNull())


def unseen(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Files whose path and hash are not among those parsed before."""
    return files.join(parsed.select("file_path", "file_hash"), ["file_path", "file_hash"], "left_anti")


def line_range(files: DataFrame, first: Column, last: Column, context: int = 3) -> DataFrame:
    """(file_path, line, text) of a range of lines with some around them; lines count from 1."""
    lines = files.select("file_path", first.alias("a"), last.alias("b"), F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return lines.select("file_path", (F.col("line") + 1).alias("line"), F.col("t").alias("text"), "a", "b").where(F.col("line").between(F.col("a") - context, F.col("b") + context)).drop("a", "b")


def base_version(requirement: Column) -> Column:
    """major.minor.patch that a version or a range such as ^10, ~10.3 or >11.3 starts from; null for others."""
    plain = F.regexp_extract(requirement, r"^v?(\d+\.\d+\.\d+)$", 1)
    part = lambda k: F.regexp_extract(requirement, r"[\^~>](\d+)(?:\.(\d+))?(?:\.(\d+))?", k)
    number = lambda k: F.when(part(k) == "", "0").otherwise(part(k))
    return F.when(plain != "", plain).when(part(1) != "", F.concat_ws(".", part(1), number(2), number(3)))


def detected_version(files: DataFrame, packages: tuple[str, ...]) -> DataFrame:
    """(project, version) from lock files, else requirements, else manifests, of (project, file_path, text)."""
    name = F.element_at(F.split("file_path", "/"), -1)
    items = F.from_json("text", "struct<packages:array<struct<name:string,version:string>>,`packages-dev`:array<struct<name:string,version:string>>>")
    locked = files.where(name == "composer.lock").select("project", F.explode(F.concat(*(F.coalesce(items[k], F.array().cast("array<struct<name:string,version:string>>")) for k in ("packages", "packages-dev")))).alias("p"))
    locked = locked.where(F.col("p.name").isin(*packages)).select("project", F.lit(1).alias("rank"), F.regexp_replace("p.version", "^v+", "").alias("version"))
    needs = F.coalesce(*(F.get_json_object("text", f"$.{part}['{p}']") for p in packages for part in ("require", "require-dev")))
    wanted = files.where(name == "composer.json").select("project", F.lit(2).alias("rank"), base_version(needs).alias("version"))
    told = F.coalesce(
        base_version(F.trim(F.nullif(F.regexp_extract("text", r"(?m)^\s*core_version_requirement\s*:\s*['\"]?([^'\"\n]+)", 1), F.lit("")))),
        F.concat(F.nullif(F.regexp_extract("text", r"(?m)^\s*core\s*[:=]\s*(\d+)\.x", 1), F.lit("")), F.lit(".0.0")),
    )
    info = files.where(name.endswith(".info.yml") | name.endswith(".info")).select("project", F.lit(3).alias("rank"), told.alias("version"))
    found = locked.unionByName(wanted).unionByName(info).where("version is not null")
    return found.groupBy("project").agg(F.min_by("version", "rank").alias("version"))


def project_type(files: DataFrame) -> DataFrame:
    """(project, type) by what files a project has: core, site, module, library or unknown."""
    has = lambda condition, alias: F.max(condition.cast("int")).alias(alias)
    path = F.col("file_path")
    seen = files.groupBy("project").agg(has(path == "core/lib", "x"), has(path.startswith("core/"), "core"), has(path.startswith("sites/") | path.startswith("web/"), "site"), has(path.rlike(r"^[^/]+\.info\.yml$"), "info"), has(path == "composer.json", "composer"))
    kind = F.when(F.col("core") == 1, "core").when(F.col("site") == 1, "site").when(F.col("info") == 1, "module").when(F.col("composer") == 1, "library").otherwise("unknown")
    return seen.select("project", kind.alias("type"))


def project_metadata(files: DataFrame, core_package: str, framework: str | None = None, core_mark: str = "core/lib/core.php") -> DataFrame:
    """(project, type, package_name, root_name) of each project by its files: core, site, module, theme, profile, framework or null.

    ``files``: project, file_path and text. Core has a file ``core_mark`` or the package
    ``core_package`` in core/; a site has settings; an extension has a manifest of that type at
    its top, of several the first by name, or else a file with such an ending; a framework's
    project has locked its package. Earlier kinds win. The package's name is that of composer.json.
    """
    path, text = F.col("file_path"), F.col("text")
    top = ~path.contains("/")
    kind = F.regexp_extract(text, r"(?m)^\s*type\s*:\s*(\w+)", 1)
    manifest = top & path.endswith(".info.yml") & kind.isin("module", "theme", "profile")
    name = F.regexp_replace(F.trim(F.regexp_extract(text, r"(?m)^\s*name\s*:\s*(.+)$", 1)), "^[\"']+|[\"']+$", "")
    ending = F.when(top & path.rlike(r"\.(module|theme|profile)$"), F.struct(path, F.substring_index(path, ".", -1).alias("kind")))
    package = F.get_json_object(text, "$.name")
    items = F.from_json(text, "struct<packages:array<struct<name:string>>,`packages-dev`:array<struct<name:string>>>")
    locked = F.lit(False)
    if framework:
        one = lambda k: F.coalesce(F.exists(items[k], lambda p: p["name"] == framework), F.lit(False))
        locked = (path == "composer.lock") & (one("packages") | one("packages-dev"))
    seen = files.groupBy("project").agg(
        F.max((path == core_mark) | ((path == "core/composer.json") & (package == core_package))).alias("core"),
        F.max(path == core_mark).alias("marked"),
        F.max(path == "sites/default/settings.php").alias("site"),
        F.min(F.when(manifest, F.struct(path, kind.alias("kind"), name.alias("name")))).alias("manifest"),
        F.min(ending).alias("ending"),
        F.max(locked).alias("framework"),
        F.max(F.when(path == "composer.json", package)).alias("package"),
    )
    core, site = F.coalesce("core", F.lit(False)), F.coalesce(F.col("site") & ~F.col("marked"), F.lit(False))
    found = F.when(core, "core").when(site, "site").otherwise(F.coalesce("manifest.kind", "ending.kind", F.when(F.col("framework"), "framework")))
    return seen.select(
        "project",
        found.alias("type"),
        F.when(core, core_package).when(found.isNotNull(), F.col("package")).alias("package_name"),
        F.when(~core & ~site, F.nullif(F.col("manifest.name"), F.lit(""))).alias("root_name"),
    )
