"""Queries of projects: extension nodes, kinds of projects, and imported rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import planning, rules
from tidemark.plans.registry import _extensions, query
from tidemark.sources import files, snapshots


@query(
    "project_nodes",
    """with recursive n as (select s_suppkey as k, case when s_suppkey % 2 = 0 then 'modules/c/s' || s_suppkey when s_suppkey % 3 = 0 then 'themes/z/s' || s_suppkey end as grp from supplier),
g as (select l_suppkey as k, count(*) as c, sum(l_linenumber)::bigint as s from lineitem group by 1),
m as (select n.k, grp, case when grp is null then 0 else coalesce(c, 0) end as c, case when grp is null then 0 else coalesce(s, 0) end as s from n left join g using (k)),
e as (select distinct k as a, k // d as b from n, (values (2), (3)) t(d) where k // d > 0 and k // d in (select k from n)),
r as (select a, b from e union select r.a, e.b from r join e on e.a = r.b),
f as (select r.a as k, sum(m.c)::bigint as dc, sum(m.s)::bigint as ds, count(*) as far from (select distinct a, b from r where a <> b) r join m on m.k = r.b group by 1),
o as (select a as k, count(*) as n from e group by 1), i as (select b as k, count(*) as n from e group by 1)
select 's' || m.k as machine_name, coalesce(grp, 'modules/c/s' || m.k) as path, m.c as match_count, m.s as score, coalesce(o.n, 0) as dependencies, coalesce(i.n, 0) as dependents, coalesce(far, 0) as transitive,
  coalesce(dc, 0) as dependency_match_count, coalesce(ds, 0) as dependency_score, m.s + coalesce(ds, 0) as hotspot_score from m left join f using (k) left join o using (k) left join i using (k)""",
)
def _project_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as extensions that depend on a half and a third of their number, with the line items as their matches."""
    extensions = _extensions(spark, sf_dir).withColumns({"label": F.lit(None).cast("string"), "extension_type": F.lit("module")})
    k = F.col("l_suppkey")
    path = F.when(k % 2 == 0, F.concat(F.lit("modules/c/s"), k)).when(k % 3 == 0, F.concat(F.lit("themes/z/s"), k))
    groups = snapshots.read(spark, sf_dir, "lineitem").select(path.alias("extension"), "l_linenumber").where("extension is not null").groupBy("extension").agg(F.count("*").alias("count"), F.sum("l_linenumber").alias("score"))
    found = planning.project_nodes(extensions, groups)
    sizes = [F.size(c).cast("long").alias(n) for c, n in (("dependencies", "dependencies"), ("dependents", "dependents"), ("transitive_dependencies", "transitive"))]
    return found.select("machine_name", "path", "match_count", "score", *sizes, "dependency_match_count", "dependency_score", "hotspot_score")


# A few files for each part, as the projects that they make; what Spark and DuckDB both read.
_PROJECTS = """select p_partkey as project, case p_partkey % 6 when 0 then 'core/lib/core.php' when 1 then 'sites/default/settings.php' when 2 then 'a.info.yml' when 3 then concat('x.', case when p_size % 2 = 0 then 'theme' else 'profile' end) when 4 then 'composer.lock' else 'README.md' end as file_path,
  case p_partkey % 6 when 2 then concat('name: "', p_name, '"
type: ', case p_size % 3 when 0 then 'module' when 1 then 'theme' else 'other' end) when 4 then concat('{"packages":[{"name":"', case when p_size % 2 = 0 then 'frame/work' else 'x/y' end, '"}]}') else 'text' end as text from part
union all select p_partkey as project, 'composer.json' as file_path, concat('{"name":"v/p', p_partkey, '"}') as text from part where p_partkey % 4 = 0"""


@query(
    "project_kinds",
    """with p as (select p_partkey as project, p_partkey % 6 as form, p_size as z, p_name from part),
t as (select *, case form when 0 then 'core' when 1 then 'site' when 2 then case z % 3 when 0 then 'module' when 1 then 'theme' end when 3 then case when z % 2 = 0 then 'theme' else 'profile' end when 4 then case when z % 2 = 0 then 'framework' end end as type from p)
select project, type, case when form = 0 then 'x/core' when type is not null and project % 4 = 0 then 'v/p' || project end as package_name, case when form = 2 and type is not null then p_name end as root_name from t""",
)
def _project_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.project_metadata(snapshots.over_part(spark, sf_dir, _PROJECTS), "x/core", "frame/work")


_RULES = """select case p_partkey % 3 when 0 then concat('r/', p_partkey, '.grep.yml') when 1 then concat('r/', p_partkey, '.functions.yml') else concat('r/', p_partkey, '.rewriters.yml') end as file_path,
  case p_partkey % 3 when 0 then concat('function_calls: {f', p_partkey, ': g', p_size, '}
constants: {C', p_partkey, ': D}
') when 1 then concat('f', p_partkey - 1, ': {message: ''@function goes''}
h', p_partkey, ': {message: ''@function goes'', disable: ', case when p_size % 2 = 0 then 'true' else 'false' end, '}
') else concat('node: {type_hint: N, properties: {p', p_partkey, ': {get: get', p_size, '}, q: {set: x}}}
') end as text from part"""


@query(
    "imported_rules",
    """with p as (select p_partkey as k, p_size as z, p_partkey % 3 as form from part)
select 'r/' || k || '.grep.yml' as file_path, 'function_call_rewrite' as change_type, 'f' || k as old_fqn, 'g' || z as new_fqn, 'f' || k || '() → g' || z || '()' as migration_hint, 1.0::double as confidence from p where form = 0
union all select 'r/' || k || '.grep.yml', 'constant_replaced', 'C' || k, 'D', 'C' || k || ' → D', 0.95 from p where form = 0
union all select 'r/' || k || '.functions.yml', 'function_removed', 'f' || (k - 1), null, 'f' || (k - 1) || ' goes', 1.0 from p where form = 1 and k - 1 not in (select k from p where form = 0)
union all select 'r/' || k || '.functions.yml', case when z % 2 = 0 then 'function_disabled' else 'function_removed' end, 'h' || k, null, 'h' || k || ' goes', 1.0 from p where form = 1
union all select 'r/' || k || '.rewriters.yml', 'variable_access_replaced', 'node.p' || k, 'N::get' || z || '()', '$node->p' || k || ' → $node->get' || z || '()', 0.7 from p where form = 2""",
)
def _imported_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.import_rule_files(snapshots.spread(snapshots.over_part(spark, sf_dir, _RULES)))
    return found.select("file_path", "change_type", "old_fqn", "new_fqn", "migration_hint", "confidence")
