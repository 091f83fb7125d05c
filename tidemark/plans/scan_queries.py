"""Queries of the scan: declarations and places of PHP texts, matches with places, and what is made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import collector, edits, extract, merge, relations
from tidemark.plans.registry import query
from tidemark.sources import snapshots

# Statements of the project's files with the places of their names: the SQL builds the texts and never parses them.
_STATEMENTS = r"""
with raw as (
  select l_orderkey, l_linenumber, l_partkey as part, l_suppkey % 8 as form, (l_quantity % 6)::int as n, 'f_' || l_partkey as f,
    array_to_string(['$a', '[1, 2]', '''x, (y''', 'g(3, $b)', '$c'][1:(l_quantity % 6)::int], ', ') as args from lineitem),
made as (
  select *, case form when 0 then f || '(' || args || ');' when 1 then '$o->' || f || '(' || args || ');' when 2 then '// ' || f || '(1, 2);' when 3 then '$s = ''' || f || ''';'
    when 4 then 'C::' || f || '(' || args || ');' when 5 then '$o->' || f || ' = 1;' when 6 then '$x = new \Lib\N' || part || '\' || f || '();'
    else '$h = "see ' || f || '(2)"; /* ' || f || '() */' end as s from raw),
placed as (select *, 6 + coalesce(sum(strlen(s) + 1) over (partition by l_orderkey order by l_linenumber, s rows between unbounded preceding and 1 preceding), 0) as begins from made),
changes as (select p_partkey as part, p_partkey % 7 as change, p_size % 3 as old_count, p_size % 5 as new_count from part),
met as (select p.*, c.change, old_count, new_count from placed p join changes c using (part)),
hits as (
  select *, case form when 0 then 0 when 3 then 6 when 4 then 3 when 6 then 9 else 4 end as inside, f as source, case when form in (0, 1, 4) then n end as arguments
  from met where (change in (0, 6) and form = 0) or (change = 1 and form = 1) or (change = 3 and form = 3) or (change = 5 and form in (0, 1, 4, 5))
  union all select *, 9, '\Lib\N' || part || '\' || f, null from met where change = 4 and form = 6
  union all select *, strlen(f), '(' || args || ')', n from met where change = 2 and form = 0
    and case when new_count > old_count then n < new_count when new_count < old_count then n > new_count else true end)
"""


@query(
    "match_places",
    _STATEMENTS
    + """select distinct 'src/o' || l_orderkey || '.php' as file_path, part as change_id, (begins + inside)::bigint as byte_start, (begins + inside + strlen(source))::bigint as byte_end, source as matched_source, arguments::int as arguments,
  case when change in (0, 1, 3, 5) then 'template' else 'manual' end as fix_method from hits""",
)
def _match_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collector.collect(snapshots.project_files(spark, sf_dir), snapshots.project_changes(spark, sf_dir))
    return found.select("file_path", "change_id", "byte_start", "byte_end", "matched_source", "arguments", "fix_method")


@query(
    "scan_and_apply",
    _STATEMENTS
    + """, edited as (select l_orderkey, l_linenumber, s, change,
    case change when 0 then case when form = 0 then 'g' end when 1 then case when form = 1 then 'm' end when 3 then case when form = 3 then 's' end when 5 then case when form in (0, 1, 4, 5) then 'k' end end as letter, f from met),
whole as (select l_orderkey, count(letter) as applied, '<?php' || chr(10) || string_agg(case when letter is null then s else replace(s, f, letter || f[2:]) end, chr(10) order by l_linenumber, s) as text from edited group by 1)
select 'src/o' || l_orderkey || '.php' as file_path, applied, 0::bigint as failed, sha256(text) as new_hash from whole where applied > 0""",
)
def _scan_and_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files scanned, matches with a template applied at their places: counts and the hash of each rewritten text."""
    project = snapshots.project_files(spark, sf_dir)
    found = collector.collect(project, snapshots.project_changes(spark, sf_dir)).where("fix_method = 'template'")
    done = edits.apply_edits(project, found)
    one = lambda status: F.count_if(F.col("status") == status).alias(status)
    return done.groupBy("file_path").agg(one("applied"), one("failed"), F.sha2(F.max("new_text"), 256).alias("new_hash"))


query(
    "scan_targets",
    """select p_partkey as change_id, ['call', 'method_call', 'arguments', 'string', 'class', 'name', 'call'][p_partkey % 7 + 1] as kind,
  case when p_partkey % 7 = 4 then 'Lib\\N' || p_partkey || '\\' else '' end || 'f_' || p_partkey as literal, case when p_partkey % 7 = 2 then p_size % 3 end::int as old_count, case when p_partkey % 7 = 2 then p_size % 5 end::int as new_count from part""",
)(lambda spark, sf_dir: collector.targets(snapshots.project_changes(spark, sf_dir)).select("change_id", "kind", "literal", "old_count", "new_count"))

_DECLARED = r"""
with p as (select p_partkey as k, 'Lib\B' || p_size as ns, 'C' || p_partkey as c, p_partkey % 2 = 0 as subscriber, p_partkey % 3 = 0 as old_class, p_partkey % 4 = 0 as old_function from part),
d as (
  select k, 'class' as symbol_type, ns || '\' || c as fqn, 'Base' as parent_symbol, null as visibility, null as is_static, old_class as deprecated, null as metadata from p
  union all select k, 'plugin_definition', 'b_' || k, 'Base', null, null, old_class, '{"plugin_type": "Block", "plugin_id": "b_' || k || '"}' from p
  union all select k, 'event_subscriber', ns || '\' || c, 'Base', null, null, old_class, '{"events": ["ev.' || k || '", "on", "Lib\\Events::SAVE"]}' from p where subscriber
  union all select k, 'constant', ns || '\' || c || '::' || x, ns || '\' || c, null, null, false, null from p, (values ('LIMIT'), ('OTHER')) v(x)
  union all select k, 'method', ns || '\' || c || '::make' || k, ns || '\' || c, 'protected', 1, false, null from p
  union all select k, 'method', 'inner', null, 'private', 0, false, null from p
  union all select k, 'method', ns || '\' || c || '::getSubscribedEvents', ns || '\' || c, 'public', 1, false, null from p
  union all select k, 'class', ns || '\D' || k || 'Events', null, null, null, false, null from p
  union all select k, 'plugin_definition', 'a_' || k, null, null, null, false, '{"plugin_type": "Action", "plugin_id": "a_' || k || '"}' from p
  union all select k, 'event', ns || '\D' || k || 'Events::SAVE', ns || '\D' || k || 'Events', null, null, false, null from p
  union all select k, 'function', ns || '\fn_' || k, null, null, null, old_function, case when old_function then '{"replacement_hint": "other()"}' end from p
  union all select k, 'interface', ns || '\I' || k, null, null, null, false, null from p)
select 'src/c' || k || '.module' as file_path, symbol_type, fqn, parent_symbol, visibility, is_static::int as is_static, deprecated::int as is_deprecated,
  case when deprecated then case when symbol_type = 'function' then '8.1.0' else '9.2.0' end end as deprecation_version,
  case when deprecated then case when symbol_type = 'function' then '9.0.0' else '10.0.0' end end as removal_version, metadata as metadata_json from d
"""


@query("php_declarations", _DECLARED)
def _php_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.symbols(snapshots.class_files(spark, sf_dir))
    return found.select("file_path", "symbol_type", "fqn", "parent_symbol", "visibility", "is_static", "is_deprecated", "deprecation_version", "removal_version", "metadata_json")




@query(
    "php_signatures",
    """with t as (select p_partkey as k, 11 + (case when p_partkey % 3 = 0 then 1 else 0 end) as line from part)
select 'src/c' || k || '.module' as file_path, 'make' || k as name, line::int as line_start, (line + 5)::int as line_end, '$a,$b,$rest' as names, '?int,array,' as types, ',[1, "x, )"],' as defaults, '?self' as return_type from t""",
)
def _php_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters, return types and lines of the made methods."""
    found = extract.symbols(snapshots.class_files(spark, sf_dir)).where("symbol_type = 'method' and visibility = 'protected'")
    shape = F.from_json("signature_json", "struct<params:array<struct<name:string,type:string,default:string>>,return_type:string>")
    joined = lambda c: F.array_join(F.transform(shape["params"][c], lambda x: F.coalesce(x, F.lit(""))), ",").alias(f"{c}s")
    return found.select("file_path", "name", "line_start", "line_end", joined("name"), joined("type"), joined("default"), shape["return_type"].alias("return_type"))


@query(
    "manifest_symbols",
    r"""with p as (select p_partkey as k, p_size as z, p_partkey % 5 as form from part),
d as (
  select k, 'm' || k || '/m' || k || '.info.yml' as file_path, case when k % 2 = 0 then 'theme_info' else 'module_info' end as symbol_type, 'm' || k as fqn, 1 as line_start, 9 as line_end,
    json_object('x', list_sort(['views' || z % 3, 'block', 'b' || z % 4, 'own' || z % 2])) as told from p where form = 0
  union all select k, 'm' || k || '.services.yml', 'service', 's.' || k, 3, 6, json_object('x', 'App\C' || z) from p where form = 1
  union all select k, 'm' || k || '.services.yml', 'event_subscriber', 's.' || k, 3, 6, json_object('x', 'App\C' || z) from p where form = 1 and k % 2 = 0
  union all select k, 'm' || k || '.routing.yml', 'route', 'r.' || k, 1, 5, json_object('x', 'App\C' || z || '::show') from p where form = 2
  union all select k, 'm' || k || '.links.task.yml', 'link_task', 'l.' || k, 1, 4, json_object('x', list_sort(list_distinct(['r' || z % 7, 'r' || z % 5]))) from p where form = 3
  union all select k, 'm' || k || '.links.task.yml', 'link_task', 'l2.' || k, 4, 4, json_object('x', []) from p where form = 3
  union all select k, 'lib/m' || k || '.libraries.yml', 'library', 'm' || k || '/lib', 1, 5, json_object('x', ['c.css', 'lib/js/a' || z % 9 || '.js']) from p where form = 4)
select file_path, symbol_type, fqn, line_start, line_end, json_extract_string(told, '$.x') as told from d""",
)
def _manifest_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of made manifests with their lines and what their kind tells: extensions, classes, controllers, routes or assets."""
    found = extract.symbols(snapshots.manifest_files(spark, sf_dir))
    paths = {"event_subscriber": "class", "service": "class", "route": "controller", "link_task": "route_refs", "library": "asset_paths"}
    told = F.get_json_object("metadata_json", "$.mentioned_extensions")
    for kind, path in paths.items():
        told = F.when(F.col("symbol_type") == kind, F.get_json_object("metadata_json", f"$.{path}")).otherwise(told)
    return found.select("file_path", "symbol_type", "fqn", "line_start", "line_end", told.alias("told"))


@query(
    "status_counts",
    """select 'symbols' as relation, count(*) as n, null::bigint as active from part union all select 'changes', count(*), null from orders union all select 'matches', count(*), null from lineitem
union all select 'projects', count(*), null from customer union all select 'jobs', count(*), count(*) filter (event_type in ('click', 'view')) from events""",
)
def _status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all relations, and how many jobs are queued or running."""
    tables = {name: snapshots.read(spark, sf_dir, table) for name, table in (("symbols", "part"), ("changes", "orders"), ("matches", "lineitem"), ("projects", "customer"), ("jobs", "events"))}
    return relations.status_counts(tables, {"jobs": F.col("event_type").isin("click", "view")})


query(
    "symbols_by_type_and_language",
    f"with o as ({snapshots.TYPED[0]}) select language, symbol_type, count(*) as n from o group by 1, 2 union all select language, null, count(*) from o group by 1 union all select null, null, count(*) from o",
)(lambda spark, sf_dir: relations.type_totals(snapshots.typed(spark, sf_dir)[0]))
query("repeated_keys", "select user_id, event_type, count(*) as n, max(event_id) as last_id from events group by 1, 2 having count(*) > 1")(
    lambda spark, sf_dir: merge.repeated(snapshots.read(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id")
)
