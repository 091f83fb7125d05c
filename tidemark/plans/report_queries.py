"""Queries of the report joins, of text templates and of keyed writes, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import edits, extract, matches, merge, relations, reports
from tidemark.plans.registry import M, V, _versions, query
from tidemark.sources import files, snapshots
from tidemark.streaming import logs

read = snapshots.read


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.matches(spark, sf_dir)


# Symbols: with their files, filtered, by type, as sets.
_FILES = "f as (select row_number() over (order by file_path) as id, file_path from (select distinct file_path from n))"


def _with_files(old: DataFrame, new: DataFrame) -> DataFrame:
    paths = new.select("file_path", F.xxhash64("file_path").alias("id")).distinct()
    return reports.symbols_with_files(new.select(F.col("id"), "fqn", F.xxhash64("file_path").alias("file_id")), paths).select("id", "fqn", "file_path")


query("symbols_with_files", V.rstrip() + f", {_FILES} select n.id, n.fqn, f.file_path from n join f using (file_path)")(_versions(_with_files))
query("filtered_symbols", V + "select id, fqn from n where symbol_type = 'Brand#23' and (fqn ilike '%an%' or name ilike '%an%')")(_versions(lambda o, n: reports.filtered(n, symbol_type="Brand#23", language="", text="an").select("id", "fqn")))
query("types_by_language", V + "select language, array_to_string(list_sort(list(distinct symbol_type)), ',') as types from n group by 1")(_versions(lambda o, n: reports.types_by_language(n).select("language", F.array_join("types", ",").alias("types"))))
query("names_gone", V + "select fqn from o except select fqn from n")(_versions(lambda o, n: o.select("fqn").exceptAll(n.select("fqn")).distinct()))
query("removal_types", V + "select id, case symbol_type when 'Brand#12' then 'service_removed' when 'Brand#23' then 'config_object_removed' when 'Brand#34' then 'link_task_removed' end as change_type from o where not exists (select 1 from n where n.fqn = o.fqn)")(
    _versions(lambda o, n: o.join(n.select("fqn"), "fqn", "left_anti").select("id", reports.removal_type(F.when(F.col("symbol_type") == "Brand#12", "service").when(F.col("symbol_type") == "Brand#23", "config_export").when(F.col("symbol_type") == "Brand#34", "link_task")).alias("change_type")))
)

# Services, routes and methods made of parts: every third part is a class, every third a method of one, the rest name them.
_CODE = """with k as (select p_partkey as id, 'C' || (p_partkey % 40) as c, 'C' || (p_partkey % 40) || '::m' || (p_partkey % 5) as cm, p_partkey % 6 as kind from part),
t as (select id, case kind when 0 then c when 1 then cm end as fqn, kind from k where kind < 2),
q as (select id, case when kind in (2, 3) then c when kind = 4 then cm end as target, case when kind in (2, 3) then 'service_class' when kind = 4 then 'controller_route' end as relation_type from k where kind between 2 and 4)
"""


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").selectExpr("p_partkey as id", "concat('C', p_partkey % 40) as c", "concat('C', p_partkey % 40, '::m', p_partkey % 5) as cm", "p_partkey % 6 as kind")
    return part.selectExpr(
        "id", "1 as version_id", "case kind when 0 then c when 1 then cm else concat('e', id) end as fqn", "case kind when 0 then c when 1 then cm else concat('e', id) end as name",
        "case kind when 0 then 'class' when 1 then 'method' when 4 then 'route' when 5 then 'library' else 'service' end as symbol_type", "cast(null as string) as parent_symbol",
        "case when kind in (2, 3) then concat('{\"class\":\"\\\\\\\\', c, '\"}') when kind = 4 then concat('{\"controller\":\"', cm, '\"}') end as metadata_json",
        "case when kind in (2, 3) then concat('{\"class\":\"', c, '\"}') end as signature_json",
    )


query("symbol_relations", _CODE + """select q.id as from_symbol_id, coalesce(min(m.id), min(c.id)) as to_symbol_id, relation_type from q
left join t m on m.kind = 1 and m.fqn = q.target left join t c on c.kind = 0 and c.fqn = string_split(q.target, '::')[1] group by q.id, relation_type having coalesce(min(m.id), min(c.id)) is not null""")(
    lambda spark, sf_dir: relations.relations(_code(spark, sf_dir)).select("from_symbol_id", "to_symbol_id", "relation_type")
)
query("symbol_mentions", _CODE + "select id from k where kind in (0, 2, 3) and c ilike '%C7%' or kind = 1 and cm ilike '%C7%'")(
    lambda spark, sf_dir: relations.search(_code(spark, sf_dir), "C7").select("id")
)
query("asset_links", "select 'l' || p_partkey as fqn, s_suppkey as asset_id, 'css_asset_symbol' as relationship from part join supplier on s_suppkey = p_partkey % 100 union all select 'l' || p_partkey, s_suppkey, 'javascript_asset_symbol' from part join supplier on s_suppkey = p_partkey % 7")(
    lambda spark, sf_dir: relations.asset_links(
        read(spark, sf_dir, "part").selectExpr("concat('l', p_partkey) as fqn", "concat('{\"css_assets\":[\"f', p_partkey % 100, '\"],\"javascript_assets\":[\"f', p_partkey % 7, '\"]}') as metadata_json"),
        read(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "concat('f', s_suppkey) as file_path"),
    ).select("fqn", "asset_id", "relationship")
)
query("opportunities", V + "select file_path, name as matched_source, 'procedural_to_attribute' as change_type, 'info' as severity from n where symbol_type = 'Brand#12' and contains(name, ' ')")(
    _versions(lambda o, n: relations.opportunities(n.where("symbol_type = 'Brand#12'").withColumns({"symbol_type": F.lit("function"), "line_start": F.lit(1), "name": F.regexp_replace("name", " ", "_")}), hook_files=(".php",)).select("file_path", F.regexp_replace("matched_source", "_", " ").alias("matched_source"), "change_type", "severity"))
)

# Changes: by version pair, with symbols, by extension; libraries.
_CHANGES = "ch as (select o_orderkey as id, (o_orderkey % 25)::int as f, (o_custkey % 25)::int as t, o_custkey % 3 as query_version, o_orderkey % 50 as old_key from orders)"


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr("o_orderkey as id", "cast(o_orderkey % 25 as int) as from_version_id", "cast(o_custkey % 25 as int) as to_version_id", "case when o_custkey % 3 > 0 then o_custkey % 3 end as query_version", "concat('old', o_orderkey % 50) as old_fqn", "concat('new', o_orderkey % 50) as new_fqn", "o_custkey as old_symbol_id", "case when o_custkey % 4 > 0 then o_orderkey end as new_symbol_id")


query("version_pairs", f"with {_CHANGES} select a.n_name as from_tag, b.n_name as to_tag, count(*) as n from ch join nation a on a.n_nationkey = f join nation b on b.n_nationkey = t group by 1, 2")(
    lambda spark, sf_dir: reports.version_pairs(_changes(spark, sf_dir), read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("tag")))
)
query("changes_with_symbols", """select o_orderkey as id, a.p_brand as old_type, b.p_brand as new_type from orders left join part a on a.p_partkey = o_custkey left join part b on o_custkey % 4 > 0 and b.p_partkey = o_orderkey""")(
    lambda spark, sf_dir: reports.with_symbols(_changes(spark, sf_dir), read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("file_path"), F.col("p_brand").alias("symbol_type"))).select("id", "old_type", "new_type")
)
query("changes_by_extension", M + "select 'e' || s_suppkey as machine_name, count(*) as n from m join supplier on contains(lower(file_path), 'e' || s_suppkey) group by 1")(
    lambda spark, sf_dir: reports.changes_by_extension(_matches(spark, sf_dir), read(spark, sf_dir, "supplier").select(F.concat(F.lit("e"), "s_suppkey").alias("machine_name")))
)
_LIBRARIES = """with a as (select p_partkey as k, p_partkey % 5 as c, p_partkey % 7 = 0 as d from part where p_partkey % 11 <> 0),
b as (select p_partkey as k, (p_partkey + case when p_partkey % 4 = 0 then 1 else 0 end) % 5 as c, p_partkey % 3 = 0 as d from part where p_partkey % 13 <> 0)
"""


def _libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    of = lambda rows, shift, dep: rows.selectExpr("concat('l', p_partkey) as fqn", f"array(concat('c', ({shift}) % 5), 'base') as css", "cast(null as array<string>) as js", "array('jquery') as dependencies", f"int(p_partkey % {dep} = 0) as is_deprecated")
    return reports.library_changes(of(part.where("p_partkey % 11 <> 0"), "p_partkey", 7), of(part.where("p_partkey % 13 <> 0"), "p_partkey + case when p_partkey % 4 = 0 then 1 else 0 end", 3))


query("library_changes", _LIBRARIES + """select 'l' || k as fqn, 'library_removed' as change_type, 'breaking' as severity, null::varchar as item from a where k not in (select k from b)
union all select 'l' || k, 'library_added', 'modernization', null from b where k not in (select k from a)
union all select 'l' || k, 'library_deprecated', 'deprecation', null from a join b using (k) where b.d and not a.d
union all select 'l' || k, 'library_css_removed', 'breaking', 'c' || a.c from a join b using (k) where a.c <> b.c""")(_libraries)

# Matches: rows, details, facets, runs, scopes.
_RUNS = "r as (select distinct l_orderkey % 5 as id, l_orderkey % 5 // 2 as project_id from lineitem)"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 5 as id", "cast(l_orderkey % 5 div 2 as int) as project_id").distinct()


query("match_details", M.rstrip() + f", {_RUNS}, {_CHANGES} select m.id, r_name as project, 'old' || ch.old_key as old_fqn from m join r on r.id = m.scan_run_id join region on r_regionkey = r.project_id left join ch on ch.id = m.change_id")(
    lambda spark, sf_dir: reports.match_details(_matches(spark, sf_dir), _changes(spark, sf_dir), _runs(spark, sf_dir), read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))).select("id", "project", "old_fqn")
)
query("latest_run", "select o_custkey, max(o_orderkey) as id from orders where o_orderstatus = 'F' group by 1")(
    lambda spark, sf_dir: reports.latest_run(read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), ["o_custkey"], "F").select("o_custkey", "id")
)
query("faceted_matches", M + "select id from m where (contains(severity, 'break') or contains(severity, 'info')) and fix_method <> 'template' and (contains(change_type, 'removed') or contains(change_type, 'renamed')) and regexp_matches(file_path, 'modules/g./.*')")(
    lambda spark, sf_dir: reports.faceted(_matches(spark, sf_dir), severity=["break", "info"], categories=["Removals", "Modernization"], fixability=["manual"], change_type=["removed", "renamed"], path="modules/g?/*").select("id")
)
query("stale_matches", M.rstrip() + f", {_CHANGES} select m.scan_run_id, count(*) as n from m join ch on ch.id = m.change_id where ch.query_version <> 2 group by 1")(
    lambda spark, sf_dir: reports.stale(_matches(spark, sf_dir), _changes(spark, sf_dir), 2).groupBy("scan_run_id").agg(F.count("*").alias("n"))
)
query("match_rows", M + "select m.id, case when p_size % 2 = 0 then 'template' else 'manual' end as fix_method, 'pending' as status from m left join part on p_partkey = change_id")(
    lambda spark, sf_dir: reports.match_rows(_matches(spark, sf_dir).select("id", "change_id"), read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 2 == 0, "{}").otherwise("").alias("fix_template"))).select("id", "fix_method", "status")
)
query("backfilled_scopes", M + "select id, case when id % 3 = 0 then 'kept' when id % 4 > 0 then 'run:' || scan_run_id else 'project:' || change_id end as scope_key, case when id % 2 = 0 then -1 else 7 end as byte_start from m")(
    lambda spark, sf_dir: reports.backfilled(_matches(spark, sf_dir).selectExpr("id", "case when id % 4 > 0 then scan_run_id end as scan_run_id", "change_id as project_id", "case when id % 3 = 0 then 'kept' when id % 2 = 0 then '' end as scope_key", "case when id % 2 = 1 then 7 end as byte_start", "cast(null as int) as byte_end")).select("id", "scope_key", "byte_start")
)
query("ordered_matches", M + "select id, file_path from m where status = 'pending' and fix_method = 'template' order by file_path, id limit 500")(
    lambda spark, sf_dir: _matches(spark, sf_dir).where("status = 'pending' and fix_method = 'template'").select("id", "file_path").orderBy("file_path", "id").limit(500)
)
query("recent_jobs", "select event_id, event_type from events order by event_id desc limit 20")(lambda spark, sf_dir: reports.recent(read(spark, sf_dir, "events"), 20, "event_id").select("event_id", "event_type"))
query("attached_calls", """select c.event_id as call_id, max(s.event_id) as symbol_id from (select * from events where event_id % 3 = 0) c
left join (select * from events where event_id % 3 <> 0) s on s.user_id = c.user_id and s.event_id <= c.event_id group by 1""")(
    lambda spark, sf_dir: reports.attached(*(read(spark, sf_dir, "events").where(w).select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("file_path"), F.col("event_id").alias("line_start")) for w in ("event_id % 3 = 0", "event_id % 3 <> 0")))
)
query("library_matches", M + "select m.id, p_partkey as change_id from m join part on 'l' || (m.change_id % 97) = 'l' || p_partkey where p_partkey % 2 = 0")(
    lambda spark, sf_dir: reports.library_matches(
        _matches(spark, sf_dir).select("id", F.expr("concat('l', change_id % 97)").alias("fqn")),
        read(spark, sf_dir, "part").selectExpr("p_partkey as id", "concat('l', p_partkey) as old_fqn", "case when p_partkey % 2 = 0 then 'library_removed' else 'service_removed' end as change_type"),
    ).select("id", "change_id")
)
query("project_extensions", """select 's' || s_suppkey as machine_name, case when s_suppkey % 3 = 0 then 'recipe' when s_suppkey % 3 = 1 then 'module' else 'theme' end as extension_type,
  case when s_suppkey % 3 = 0 then 'a,b' else 's' || (s_suppkey // 2) end as dependencies from supplier""")(
    lambda spark, sf_dir: reports.project_extensions(
        read(spark, sf_dir, "supplier").selectExpr(
            "s_suppkey as id", "concat('s', s_suppkey) as fqn", "concat('x/', s_suppkey, '.info.yml') as file_path", "case s_suppkey % 3 when 0 then 'recipe_manifest' when 1 then 'module_info' else 'theme_info' end as symbol_type",
            "case when s_suppkey % 3 = 0 then '{\"install\":[\"a\"],\"recipes\":[\"b\",\"a\"]}' else concat('{\"dependencies\":[\"s', s_suppkey div 2, '\"]}') end as signature_json",
        )
    ).select("machine_name", "extension_type", F.array_join("dependencies", ",").alias("dependencies"))
)
query("unseen_files", "select doc_id::varchar as file_path from documents d where not exists (select 1 from documents e where e.doc_id = d.doc_id and e.doc_id % 3 = 0 and e.doc_id % 2 = 0)")(
    lambda spark, sf_dir: files.unseen(*(read(spark, sf_dir, "documents").where(w).select(F.col("doc_id").cast("string").alias("file_path"), F.sha2(F.concat("text", F.lit(x)), 256).alias("file_hash")) for w, x in (("true", ""), ("doc_id % 6 = 0", "")))).select("file_path")
)

# Texts: which changed names occur in which documents, templates, whole-block diffs.
query("text_matches", """with w as (select distinct doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) as word, lang from documents), c as (select item_id, regexp_extract(text, '[A-Za-z_][A-Za-z0-9_]*') as word from benchmark)
select doc_id::varchar as file_path, item_id as change_id from w join c using (word) where lang = 'en'""")(
    lambda spark, sf_dir: matches.text_matches(
        read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.col("lang").alias("language"), "text"),
        read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("en").alias("language"), F.regexp_extract("text", "[A-Za-z_][A-Za-z0-9_]*", 0).alias("old_fqn")),
    ).select("file_path", "change_id")
)
query("getter_template", r"select p_partkey, regexp_replace(replace('$x->' || p_brand || ' $x->abc $x->' || p_name, '#', ''), '->abc\b', '->getAbc()', 'g') as rewritten from part")(
    lambda spark, sf_dir: read(spark, sf_dir, "part").select("p_partkey", edits.use_getter(F.replace(F.concat(F.lit("$x->"), "p_brand", F.lit(" $x->abc $x->"), "p_name"), F.lit("#"), F.lit("")), "abc", "getAbc").alias("rewritten"))
)
query("global_template", "select p_partkey, '$user = X::u(); ' || p_name || ' X::u();' as rewritten from part")(
    lambda spark, sf_dir: read(spark, sf_dir, "part").select("p_partkey", edits.replace_global(F.concat(F.lit("global  $user ; "), "p_name", F.lit(" $GLOBALS['user'];")), "user", "X::u()").alias("rewritten"))
)
query("rename_template", "select doc_id, sha256(replace(text, 'an', 'AN')) as rewritten from documents")(lambda spark, sf_dir: read(spark, sf_dir, "documents").select("doc_id", F.sha2(edits.replace_text(F.col("text"), F.lit("an"), F.lit("AN")), 256).alias("rewritten")))
query("block_diffs", r"select p_partkey, '--- a/' || p_brand || chr(10) || '+++ b/' || p_brand || chr(10) || '@@ -3,2 +3,1 @@' || chr(10) || '-' || p_name || chr(10) || '-' || p_type || chr(10) || '+' || p_name || chr(10) as diff from part")(
    lambda spark, sf_dir: read(spark, sf_dir, "part").select("p_partkey", edits.block_diff(F.concat("p_name", F.lit("\n"), "p_type"), F.col("p_name"), F.col("p_brand"), F.lit(3)).alias("diff"))
)
query("docblock_deprecations", "select p_partkey, p_size || '.1.0' as version, (p_size + 1) || '.0.0' as removal_version, p_name as message from part where p_partkey % 2 = 0")(
    lambda spark, sf_dir: read(spark, sf_dir, "part")
    .select("p_partkey", extract.deprecation(F.expr("if(p_partkey % 2 = 0, concat('/** @deprecated in core:', p_size, '.1.0 and is removed from core:', p_size + 1, '.0.0. Use ', p_name, ' instead. */'), p_name)"), "core").alias("d"))
    .where("d is not null").select("p_partkey", "d.version", "d.removal_version", "d.message")
)

# Keyed writes and streams.
query("null_safe_upsert", "select event_id, case when event_id % 5 > 0 then user_id end as k, case when event_id % 2 = 0 then 'new' else 'old' end as v from events where event_id % 2 = 0 or event_id % 3 = 0")(
    lambda spark, sf_dir: merge.upsert(
        read(spark, sf_dir, "events").where("event_id % 3 = 0").selectExpr("event_id", "case when event_id % 5 > 0 then user_id end as k", "'old' as v"),
        read(spark, sf_dir, "events").where("event_id % 2 = 0").selectExpr("event_id", "case when event_id % 5 > 0 then user_id end as k", "'new' as v"), ["event_id", "k"],
    )
)
query("merged_duplicates", "select max(c_custkey) as id, c_nationkey from customer group by 2")(
    lambda spark, sf_dir: merge.merge_duplicates(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey"), read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id")), "c_nationkey", "customer_id", ["customer_id"])[0]
)
query("merged_children", "with k as (select c_custkey, max(c_custkey) over (partition by c_nationkey) as keep from customer) select keep as customer_id, max(o_orderkey) as id from orders join k on c_custkey = o_custkey group by 1")(
    lambda spark, sf_dir: merge.merge_duplicates(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey"), read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id")), "c_nationkey", "customer_id", ["customer_id"])[1].select("customer_id", "id")
)
query("stream_once", "select user_id, event_id % 50 as seq, count(*) as n from (select distinct user_id, event_id % 50 as event_id from events) group by 1, 2")(
    lambda spark, sf_dir: logs.drained(logs.once(logs.stream(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 50).alias("seq")), "user_id", "seq"), "once").groupBy("user_id", "seq").agg(F.count("*").alias("n"))
)
