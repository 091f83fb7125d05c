"""Queries of texts: scripts, style sheets, templates, library uses, ranges of lines, and edits with all their outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import collector, edits, extract, reports
from tidemark.plans.registry import query
from tidemark.sources import files, snapshots

# Four texts for each part; what Spark and DuckDB both read.
_TEXTS = """select p_partkey as k, concat('s', p_partkey, '.js') as file_path, 'javascript' as language, concat('function f', p_partkey, '(a) {
}
class C', p_partkey, ' {
  go', p_size, '(x) {
  }
}
const v', p_size, ' = 1;') as text from part
union all select p_partkey, concat('s', p_partkey, '.html.twig'), 'twig', concat('{# {% include "no" %} #}
{% include "inc', p_partkey, '.html" %}
{{ var', p_size, '|raw }}{{ attach_library("m', p_size, '/l', p_partkey, '") }}
{{ component("t:c', p_size, '") }}') from part
union all select p_partkey, concat('s', p_partkey, '.yml'), 'yaml', concat('name: é
libraries:
  - m', p_size, '/l', p_partkey, '
  - plain
') from part
union all select p_partkey, concat('s', p_partkey, '.module'), 'php', concat('<?php
// $x["library"][] = "no/no";
$b["é"]["library"][] = "m', p_size, '/l', p_partkey, '";') from part"""


@query(
    "script_and_template_symbols",
    """with p as (select p_partkey as k, p_size as z from part)
select 's' || k || '.js' as file_path, 'function' as symbol_type, 'f' || k as fqn, 1 as line_start from p union all select 's' || k || '.js', 'class', 'C' || k, 3 from p
union all select 's' || k || '.js', 'method', 'go' || z, 4 from p union all select 's' || k || '.js', 'variable', 'v' || z, 7 from p
union all select 's' || k || '.html.twig', 'twig_include', 'inc' || k || '.html', 2 from p union all select 's' || k || '.html.twig', 'twig_variable', 'var' || z, 3 from p
union all select 's' || k || '.html.twig', 'twig_filter', 'raw', 3 from p union all select 's' || k || '.html.twig', 'twig_variable', 'anonymous', l from p, (values (3), (4)) t(l)
union all select 's' || k || '.html.twig', 'twig_function', 'attach_library', 3 from p union all select 's' || k || '.html.twig', 'sdc_function', 't:c' || z, 4 from p""",
)
def _script_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = snapshots.over_part(spark, sf_dir, _TEXTS).where("language in ('javascript', 'twig')")
    return extract.symbols(texts).select("file_path", "symbol_type", "fqn", "line_start")


@query(
    "library_uses",
    """with p as (select p_partkey as k, 'm' || p_size || '/l' || p_partkey as fqn, p_partkey::varchar as t, p_size::varchar as z from part)
select 's' || k || '.html.twig' as file_path, fqn, (25 + strlen('{% include "inc' || t || '.html" %}') + 1 + strlen('{{ var' || z || '|raw }}') + 19)::bigint as byte_start, 3::bigint as line_start from p
union all select 's' || k || '.yml', fqn, (9 + 11 + 4)::bigint, 3 from p union all select 's' || k || '.module', fqn, (6 + strlen('// $x["library"][] = "no/no";') + 1 + strlen('$b["é"]["library"][] = "'))::bigint, 3 from p""",
)
def _library_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.library_usage(snapshots.spread(snapshots.over_part(spark, sf_dir, _TEXTS)))


_STYLES = """select concat('c', p_partkey, '.css') as file_path, concat('.a', p_partkey, ', #b', p_size, ' { color: #fff; margin: .5em }
/* .no', p_partkey, '
*/
.c', p_size, ' > .d {
  width: 1px;
}
.e{}') as text from part"""
query(
    "style_selectors",
    """with p as (select p_partkey as k, p_size as z from part) select 'c' || k || '.css' as file_path, s as fqn, l as line_start from p, lateral (values ('.a' || k, 1), ('#b' || z, 1), ('.c' || z, 4), ('.d', 4), ('.e', 7)) t(s, l)""",
)(lambda spark, sf_dir: extract.css_selectors(snapshots.over_part(spark, sf_dir, _STYLES)).select("file_path", "fqn", "line_start"))

query(
    "line_ranges",
    "select doc_id::varchar as file_path, i::int as line, t as text from (select doc_id, unnest(string_split(text, chr(10))) as t, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents) where i between 2 - 1 and 3 + 1",
)(lambda spark, sf_dir: files.line_range(snapshots.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), "text"), F.lit(2), F.lit(3), 1))

# A call with two arguments for each part, and edits that meet every outcome.
_CALLS = """select p_partkey as k, concat('p', p_partkey) as file_path, concat('é = f(', p_size, ', [1, g(2)], "a, b"); aaa bbb') as text, p_size as z from part"""
_CHAIN = '{"type":"method_chain","object":"$o","chain":["set","save"],"args_map":{"set":[2,0],"save":[1]}}'


def _edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each text: a call made a chain, an overlap with it, a piece that stands once, one that changes nothing, and one without a rule."""
    texts = snapshots.over_part(spark, sf_dir, _CALLS)
    call = F.concat(F.lit("f("), "z", F.lit(', [1, g(2)], "a, b")'))
    rename = '{{"type":"string_replace","old":"{}","new":"{}"}}'
    one = lambda at, end, source, template: F.struct(at.cast("long").alias("byte_start"), end.cast("long").alias("byte_end"), source.alias("matched_source"), F.lit(template).alias("fix_template"))
    start, size = F.lit(5), F.length(call)
    every = F.array(
        one(start, start + size, call, _CHAIN),
        one(start - 1, start + 2, F.lit(" f("), rename.format(" f(", "x")),
        one(F.lit(-1), F.lit(-1), F.lit("aaa"), rename.format("aaa", "A")),
        one(F.lit(-1), F.lit(-1), F.lit("bbb"), rename.format("q", "r")),
        one(F.lit(-1), F.lit(-1), F.lit("b"), "{}"),
    )
    found = texts.select("file_path", "k", F.posexplode(every).alias("n", "m")).select("file_path", (F.col("k") * 10 + F.col("n")).cast("long").alias("id"), "m.*")
    return edits.apply_edits(texts.select("file_path", "text"), found)


@query(
    "edit_outcomes",
    """with p as (select p_partkey as k, p_size as z from part),
o as (select k, unnest([0, 1, 2, 3, 4]) as n from p)
select 'p' || k as file_path, k * 10 + n as match_id, ['applied', 'failed', 'applied', 'skipped', 'failed'][n + 1] as status, n = 1 as conflict,
  case when n = 0 then sha256('é = $o->set("a, b", ' || z || ')->save([1, g(2)]); A bbb') end as new_hash from o join p using (k)""",
)
def _edit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each edit's outcome, with the hash of the rewritten text on the row that has it."""
    return _edited(spark, sf_dir).select("file_path", "match_id", "status", "conflict", F.sha2("new_text", 256).alias("new_hash"))


query("edit_statistics", "select count(*) * 5 as total, count(*) * 2 as applied, count(*) as skipped, count(*) * 2 as failed, count(*) as conflicts, count(*) as files_changed from part")(
    lambda spark, sf_dir: edits.edit_totals(_edited(spark, sf_dir))
)

# Every change type with every symbol type that there are rows for.
_CHANGE_TYPES = (
    "signature_changed service_removed service_renamed service_class_changed service_changed route_removed route_renamed route_changed permission_removed permission_renamed config_key_removed "
    "config_key_renamed config_key_changed library_removed library_changed library_css_removed library_js_removed library_dependency_removed library_deprecated hook_to_attribute event_removed "
    "inheritance_impact module_info_changed theme_base_changed config_object_changed recipe_install_changed link_menu_changed deprecated_added global_replaced constant_replaced "
    "variable_access_replaced sdc_include_removed sdc_function_removed function_call_rewrite function_removed class_renamed misc_changed"
).split()
_SYMBOL_TYPES = "function hook method class interface trait constant plugin_definition service library route permission config_export module_info recipe_manifest component twig_include event_subscriber variable".split()
_PICKED = "select p_partkey as id, element_at(split('{0}', ' '), cast(p_partkey % {1} + 1 as int)) as change_type, element_at(split('{2}', ' '), cast(p_partkey div {1} % {3} + 1 as int)) as symbol_type from part"
_KIND = """case when change_type = 'signature_changed' then case when symbol_type in ('function', 'hook', 'method') then 'arguments' end
  when change_type in ('hook_to_attribute') then 'hook' when change_type = 'event_removed' then 'event' when change_type = 'inheritance_impact' then 'override'
  when change_type = 'global_replaced' then 'global' when change_type = 'constant_replaced' then 'name' when change_type = 'variable_access_replaced' then 'property'
  when starts_with(change_type, 'sdc_') then 'component' when change_type = 'function_call_rewrite' then 'call' when change_type = 'misc_changed' then null
  when change_type in ('function_removed', 'class_renamed', 'module_info_changed', 'theme_base_changed', 'config_object_changed', 'recipe_install_changed', 'link_menu_changed', 'deprecated_added') then
    case when symbol_type in ('function', 'hook') then 'call' when symbol_type = 'method' then 'method_call' when symbol_type in ('class', 'interface', 'trait', 'constant', 'plugin_definition') then 'class'
      when symbol_type in ('component', 'twig_include') then 'component' when symbol_type = 'event_subscriber' then 'event' when symbol_type = 'variable' then null else 'string' end
  else 'string' end"""


@query(
    "target_kinds",
    f"with c as (select p_partkey as id, string_split('{' '.join(_CHANGE_TYPES)}', ' ')[p_partkey % {len(_CHANGE_TYPES)} + 1] as change_type, string_split('{' '.join(_SYMBOL_TYPES)}', ' ')[p_partkey // {len(_CHANGE_TYPES)} % {len(_SYMBOL_TYPES)} + 1] as symbol_type from part) select id, {_KIND} as kind from c",
)
def _target_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each change type looks for, symbol type by symbol type."""
    rows = snapshots.over_part(spark, sf_dir, _PICKED.format(" ".join(_CHANGE_TYPES), len(_CHANGE_TYPES), " ".join(_SYMBOL_TYPES), len(_SYMBOL_TYPES)))
    return rows.select("id", collector.target_kind(F.col("change_type"), F.col("symbol_type")).alias("kind"))


_ENTRIES = "service route permission config_schema module_info theme_info profile_info theme_engine_info link_menu link_task link_action link_contextual config_export recipe_manifest function class".split()
query(
    "entry_removal_types",
    f"""with s as (select p_partkey as id, string_split('{' '.join(_ENTRIES)}', ' ')[p_partkey % {len(_ENTRIES)} + 1] as t from part)
select id, case when t in ('function', 'class') then null when t = 'config_schema' then 'config_key_removed' when t = 'config_export' then 'config_object_removed' when t = 'recipe_manifest' then 'recipe_removed' else t || '_removed' end as change_type from s""",
)(
    lambda spark, sf_dir: snapshots.over_part(spark, sf_dir, f"select p_partkey as id, element_at(split('{' '.join(_ENTRIES)}', ' '), cast(p_partkey % {len(_ENTRIES)} + 1 as int)) as t from part").select("id", reports.removal_type(F.col("t")).alias("change_type"))
)
