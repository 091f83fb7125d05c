"""Registered queries over the given tables, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import jsonpath
from tidemark.functions.classify import category, language, namespace_moved, risk, severity_score
from tidemark.operators import diff, edits, extract, matches, merge, planning, relations, rename, reports, similar
from tidemark.operators.lineage import blocked, meet
from tidemark.sources import files, snapshots
from tidemark.streaming import logs

read = snapshots.read

_SNAPSHOT = """
select p_partkey + {shift} as id, {v} as version_id, 'l' || (p_partkey % 3) as language, p_brand as symbol_type,
  p_name || '#' || p_partkey as fqn, p_name as name, p_type as namespace, 'modules/m' || (p_partkey % 7) || '/src/f' || (p_partkey % 11) || '.php' as file_path,
  '{{"params":[' || array_to_string(list_transform(range({n}), lambda x: '{{"name":"$p"}}'), ',') || '],"return_type":"' || p_brand || '"}}' as signature_json,
  case when {deprecated} then 1 else 0 end as is_deprecated, p_name || ' ' || p_type as source_text
from part where p_partkey % 10 <> {gone}
"""
_V1 = _SNAPSHOT.format(v=1, shift=0, n="p_size % 4", deprecated="p_partkey % 17 = 0", gone=0)
_V2 = _SNAPSHOT.format(v=2, shift=1000000, n="p_size % 4 + case when p_partkey % 10 = 2 then 1 else 0 end", deprecated="p_partkey % 13 = 0 or p_partkey % 17 = 0", gone=1)
V = f"with o as (select *, sha256(signature_json) as signature_hash from ({_V1})), n as (select *, sha256(signature_json) as signature_hash from ({_V2}))\n"

_M = snapshots.MATCHES_SQL.replace("concat(case", "(case").replace("else 'src' end, '/g', l_suppkey % 3, '/e', l_suppkey, '/f', l_partkey % 50, '.php')", "else 'src' end || '/g' || (l_suppkey % 3) || '/e' || l_suppkey || '/f' || (l_partkey % 50) || '.php')")
M = f"with m as ({_M})\n"
CATEGORY = """case when contains(change_type, 'removed') then 'Removals'
  when contains(change_type, 'deprecated') or contains(change_type, 'renamed') or contains(change_type, 'to_attribute') or contains(change_type, 'rewrite') then 'Modernization'
  when contains(change_type, 'signature') or contains(change_type, 'parameter') or contains(change_type, 'return_type') or change_type = 'inheritance_impact' then 'Signatures'
  when contains(change_type, 'css') or contains(change_type, 'library') or contains(change_type, 'sdc') or contains(change_type, 'twig') then 'Frontend' else 'Other' end"""
GROUP = "case when len(string_split(file_path, '/')) >= 3 and string_split(file_path, '/')[1] in ('modules', 'themes', 'profiles') then array_to_string(string_split(file_path, '/')[1:3], '/') else string_split(file_path, '/')[1] end"
SCORE = "case severity when 'breaking' then 10 when 'warning' then 3 when 'deprecation' then 3 else 1 end"
_REMOVED = "select {c} from o where not exists (select 1 from n where n.fqn = o.fqn and n.symbol_type = o.symbol_type)"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _versions(f):
    return lambda spark, sf_dir: f(*snapshots.both(spark, sf_dir))


# Diffs of two snapshots.
query("removed", V + _REMOVED.format(c="id, fqn, symbol_type, file_path"))(_versions(lambda o, n: diff.removed(o, n).select("id", "fqn", "symbol_type", "file_path")))
query("added", V + "select id, fqn, symbol_type from n where not exists (select 1 from o where n.fqn = o.fqn and n.symbol_type = o.symbol_type)")(_versions(lambda o, n: diff.added(o, n).select("id", "fqn", "symbol_type")))
query("removed_under_prefix", V + _REMOVED.format(c="id, fqn, file_path") + " and file_path ilike 'modules/m3%'")(_versions(lambda o, n: diff.removed(o, n, prefix="modules/m3").select("id", "fqn", "file_path")))
query("changed_signatures", V + "select fqn, symbol_type, o.id as old_id, n.id as new_id, o.signature_json as old_signature_json, n.signature_json as new_signature_json from o join n using (fqn, symbol_type) where o.signature_hash <> n.signature_hash")(
    _versions(lambda o, n: diff.changed_signatures(o, n).select("fqn", "symbol_type", "old_id", "new_id", "old_signature_json", "new_signature_json"))
)
query("parameters_increased", V + "select fqn, symbol_type, json_array_length(o.signature_json, '$.params')::int as old_count, json_array_length(n.signature_json, '$.params')::int as new_count from o join n using (fqn, symbol_type) where json_array_length(n.signature_json, '$.params') > json_array_length(o.signature_json, '$.params')")(
    _versions(lambda o, n: diff.parameter_counts(o, n).select("fqn", "symbol_type", "old_count", "new_count"))
)
query("newly_deprecated", V + "select fqn, symbol_type, o.id as old_id, n.id as new_id from o join n using (fqn, symbol_type) where o.is_deprecated = 0 and n.is_deprecated = 1")(_versions(lambda o, n: diff.newly_deprecated(o, n).select("fqn", "symbol_type", "old_id", "new_id")))
query("deprecated_then_removed", V + _REMOVED.format(c="id, fqn") + " and o.is_deprecated = 1")(_versions(lambda o, n: diff.deprecated_then_removed(o, n).select("id", "fqn")))
query("modernised", V + "select o.id, o.name as fqn, max(n.id) as new_id from o join n on n.name = o.name where o.symbol_type = 'Brand#12' and n.symbol_type = 'Brand#23' group by 1, 2")(
    _versions(lambda o, n: diff.modernised(o.withColumn("fqn", F.col("name")), n.withColumn("fqn", F.col("name")), "Brand#12", "Brand#23").select("id", "fqn", "new_id"))
)
# Each stream by itself, over the two versions.
_ALL = """, c as (
  select fqn, symbol_type, o.id as old_id, null as new_id, case when o.is_deprecated = 1 then 'deprecated_removed' else 'symbol_removed' end as change_type from o where not exists (select 1 from n where n.fqn = o.fqn and n.symbol_type = o.symbol_type)
  union all select fqn, symbol_type, null, n.id, 'symbol_added' from n where not exists (select 1 from o where n.fqn = o.fqn and n.symbol_type = o.symbol_type)
  union all select fqn, symbol_type, o.id, n.id, 'signature_changed' from o join n using (fqn, symbol_type) where o.signature_hash <> n.signature_hash
  union all select fqn, symbol_type, o.id, n.id, 'deprecated_added' from o join n using (fqn, symbol_type) where o.is_deprecated = 0 and n.is_deprecated = 1)
"""
query("all_changes", V.rstrip() + _ALL + "select fqn, symbol_type, change_type, old_id, new_id from c where change_type is not null")(_versions(diff.all_changes))
query("diff_summary", V.rstrip() + _ALL + f"select change_type, {CATEGORY} as category, count(*) as n from c where change_type is not null group by 1, 2")(
    _versions(lambda o, n: diff.all_changes(o, n).groupBy("change_type", category(F.col("change_type")).alias("category")).agg(F.count("*").alias("n")))
)
query("signature_changes", V + """, p as (select fqn, symbol_type, o.signature_json as a, n.signature_json as b, json_array_length(o.signature_json, '$.params') as x, json_array_length(n.signature_json, '$.params') as y from o join n using (fqn, symbol_type) where o.signature_hash <> n.signature_hash)
select fqn, symbol_type, unnest(range(x::bigint, y::bigint))::int as position, 'parameter_added' as type from p where y > x union all select fqn, symbol_type, unnest(range(y::bigint, x::bigint))::int, 'parameter_removed' from p where x > y""")(
    _versions(lambda o, n: diff.changed_signatures(o, n).select("fqn", "symbol_type", F.explode(diff.signature_changes(F.col("old_signature_json"), F.col("new_signature_json"))).alias("x")).select("fqn", "symbol_type", "x.position", "x.type"))
)
query("changed_keys", V + "select fqn, case when json_extract(o.signature_json, '$.params') <> json_extract(n.signature_json, '$.params') then 'params' else '' end as keys from o join n using (fqn, symbol_type) where o.signature_hash <> n.signature_hash")(
    _versions(lambda o, n: diff.changed_signatures(o, n).select("fqn", F.array_join(diff.changed_keys(F.col("old_signature_json"), F.col("new_signature_json")), ",").alias("keys")))
)
query("namespace_moves", V + r"select distinct o.language || '\' || o.name as old_name, n.language || '\' || n.name as new_name from o join n using (name, symbol_type) where o.language <> n.language")(_versions(lambda o, n: _moves(o, n)))


def _moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """Names that stay while the language that qualifies them changes; distinct names meet, not their symbols."""
    a, b = (v.select("name", "symbol_type", F.concat("language", F.lit("\\"), "name").alias(f"{side}_name")).distinct() for v, side in ((old, "old"), (new, "new")))
    return a.join(b, ["name", "symbol_type"]).where(namespace_moved(F.col("old_name"), F.col("new_name"))).select("old_name", "new_name").distinct()


_SCORE = "round(case when o.name = n.name then 1.0 else 1 - levenshtein(o.name, n.name)::double / greatest(strlen(o.name), strlen(n.name)) end, 6)"


@query("similar_names", V + f"select o.id as old_id, n.id as new_id, {_SCORE} as score from o join n using (symbol_type) where {_SCORE} > 0.7")
def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every old symbol against every new one of its type: distinct names meet by shared pieces, symbols by their names."""
    old, new = (v.select("symbol_type", "id", "name") for v in snapshots.both(spark, sf_dir))
    names = similar.similar_pairs(old, new, ["symbol_type"], 0.7)
    o, n = (v.select("symbol_type", F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name")) for v, side in ((old, "left"), (new, "right")))
    met = blocked(meet(o, names, ["symbol_type", "left_name"]), n, ["symbol_type", "right_name"], "left_id", "right_id")
    return met.select(F.col("left_id").alias("old_id"), F.col("right_id").alias("new_id"), F.round("score", 6).alias("score"))


_GONE = """, r as (select * replace (case when id % 5 = 0 then fqn || 's' else fqn end as fqn, case when id % 5 = 0 then name || 's' else name end as name, case when id % 5 = 0 then name || 's ' || namespace else source_text end as source_text) from n),
a as (select * from o where not exists (select 1 from r where r.fqn = o.fqn and r.symbol_type = o.symbol_type)),
b as (select * from r where not exists (select 1 from o where r.fqn = o.fqn and r.symbol_type = o.symbol_type)),
p as (select a.id as old_id, b.id as new_id, a.fqn as old_fqn, b.fqn as new_fqn, a.namespace = b.namespace as same,
    case when a.name = b.name then 1.0 when greatest(strlen(a.name), strlen(b.name)) < 4 then 0.0 else 1 - levenshtein(a.name, b.name)::double / greatest(strlen(a.name), strlen(b.name)) end as s,
    replace(a.source_text, a.name, '__RENAMED__') as x, replace(b.source_text, b.name, '__RENAMED__') as y
  from a join b using (language, symbol_type, signature_json)),
q as (select old_id, new_id, old_fqn, new_fqn, least(1.0, 0.5 + 0.3 * s + case when s > 0.5 then case when same then 0.1 else 0.0 end
    + 0.1 * case when x = y then 1.0 else 1 - levenshtein(x, y)::double / greatest(strlen(x), strlen(y)) end else 0.0 end) as score from p)
"""


def _renamed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What is removed and added between the snapshots, where every fifth symbol of the second has another name."""
    old, new = snapshots.both(spark, sf_dir)
    other = lambda c, text: F.when(F.col("id") % 5 == 0, text).otherwise(F.col(c))
    named = {"fqn": other("fqn", F.concat("fqn", F.lit("s"))), "name": other("name", F.concat("name", F.lit("s"))), "source_text": other("source_text", F.concat("name", F.lit("s "), "namespace"))}
    new = new.withColumns(named)
    return diff.removed(old, new), diff.added(old, new)


query("rename_scores", V.rstrip() + _GONE + "select old_id, new_id, round(score, 6) as score from q where score >= 0.7")(
    lambda spark, sf_dir: rename.candidates(*_renamed(spark, sf_dir)).select("old_id", "new_id", F.round("score", 6).alias("score"))
)
query("rename_assignment")(lambda spark, sf_dir: rename.renames(*_renamed(spark, sf_dir)))

# Matches: joins, overlays, counts and comparisons.
def _matches(f):
    return lambda spark, sf_dir: f(snapshots.matches(spark, sf_dir))


query("match_summary", M + f"select severity, change_type, fix_method, {CATEGORY} as category, count(*) as n, sum({SCORE})::bigint as score from m group by 1, 2, 3, 4")(
    _matches(lambda m: m.groupBy("severity", "change_type", "fix_method", category(F.col("change_type")).alias("category")).agg(F.count("*").alias("n"), F.sum(severity_score(F.col("severity"))).cast("long").alias("score")))
)
query("run_summary", M + "select scan_run_id, count(*) as total, count(*) filter (fix_method = 'template') as auto_fixable, sum(" + SCORE + ")::bigint as score, count(*) filter (severity = 'breaking') as breaking from m group by 1")(
    _matches(lambda m: matches.summary(m, ["scan_run_id"]).select("scan_run_id", "total", F.col("auto_fixable").cast("long").alias("auto_fixable"), F.col("score").cast("long").alias("score"), F.coalesce(F.try_element_at("by_severity", F.lit("breaking")), F.lit(0)).alias("breaking")))
)
query("matches_by_path_group", M + f", g as (select {GROUP} as extension, coalesce(severity, 'unknown') as severity, {CATEGORY} as category, count(*) as n from m group by 1, 2, 3) select *, (sum(n) over (partition by extension))::bigint as extension_total from g")(_matches(matches.by_path_group))
query("matches_by_category", M + f"select {CATEGORY} as category, count(*) as n from m group by 1")(_matches(lambda m: m.groupBy(category(F.col("change_type")).alias("category")).agg(F.count("*").alias("n"))))
query("matches_by_status", M + "select scan_run_id, status, count(*) as n from m group by 1, 2")(_matches(lambda m: m.groupBy("scan_run_id", "status").agg(F.count("*").alias("n"))))
query("change_risk", M + "select distinct change_type, case when suffix(change_type, '_removed') or change_type = 'signature_changed' or suffix(change_type, '_renamed') then 'breaking' when contains(change_type, 'deprecated') then 'deprecation' else 'unknown' end as severity, case when suffix(change_type, '_removed') then 0.95 when change_type = 'signature_changed' or suffix(change_type, '_renamed') or contains(change_type, 'deprecated') then 0.9 else 0.5 end::double as confidence from m")(
    _matches(lambda m: m.select("change_type").distinct().select("change_type", risk(F.col("change_type")).alias("r")).select("change_type", "r.severity", "r.confidence"))
)
_RUNS = M + """, b as (select change_id, file_path, arg_max(severity, id) as severity from m where scan_run_id = 1 and change_id > 0 and file_path <> '' group by 1, 2),
h as (select change_id, file_path, arg_max(severity, id) as severity from m where scan_run_id = 2 and change_id > 0 and file_path <> '' group by 1, 2),
d as (select coalesce(b.change_id, h.change_id) as change_id, coalesce(b.file_path, h.file_path) as file_path, case when b.change_id is null then 'introduced' when h.change_id is null then 'resolved' else 'persisting' end as delta, coalesce(h.severity, b.severity) as severity from b full outer join h on b.change_id = h.change_id and b.file_path = h.file_path)
"""
_compared = _matches(lambda m: matches.compare_runs(m.where("scan_run_id = 1"), m.where("scan_run_id = 2")))
query("run_comparison", _RUNS + "select change_id, file_path, delta, severity from d")(_compared)
query("run_comparison_summary", _RUNS + "select delta, severity, count(*) as n from d group by 1, 2")(lambda spark, sf_dir: _compared(spark, sf_dir).groupBy("delta", "severity").agg(F.count("*").alias("n")))
query("argument_count_filter", "select l_linenumber, count(*) as n from lineitem where case when l_orderkey % 7 > l_partkey % 7 then l_linenumber < l_orderkey % 7 when l_orderkey % 7 < l_partkey % 7 then l_linenumber > l_orderkey % 7 else true end group by 1")(
    lambda spark, sf_dir: read(spark, sf_dir, "lineitem").where(matches.passes_argument_count(F.col("l_linenumber"), F.col("l_partkey") % 7, F.col("l_orderkey") % 7)).groupBy("l_linenumber").agg(F.count("*").alias("n"))
)
query("severity_pivot", "select o_orderpriority, sum(case when o_orderstatus = 'F' then 1 else 0 end)::bigint as f, sum(case when o_orderstatus = 'O' then 1 else 0 end)::bigint as o, sum(case when o_orderstatus = 'P' then 1 else 0 end)::bigint as p from orders group by 1")(
    lambda spark, sf_dir: read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(*(F.sum(F.when(F.col("o_orderstatus") == s, 1).otherwise(0)).alias(s.lower()) for s in "FOP"))
)


def _overlaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = snapshots.both(spark, sf_dir)
    changes = diff.all_changes(old, new).where("old_id is not null").select(F.col("old_id").alias("id"), F.col("change_type"), F.lit("info").alias("severity"), F.col("fqn").alias("old_fqn"), F.lit("hint").alias("migration_hint"), F.col("fqn").alias("new_fqn"), F.lit(None).cast("string").alias("fix_template"), F.lit(None).cast("string").alias("diff_json"))
    m = snapshots.matches(spark, sf_dir).withColumns({"severity": F.when(F.col("severity") != "info", F.col("severity")), "old_fqn": F.lit(None).cast("string"), "migration_hint": F.lit(None).cast("string")})
    return matches.overlay(m, changes).select("id", "change_type", "severity", "old_fqn", "migration_hint")


query("match_overlay", V.rstrip() + _ALL.rstrip() + f", m as ({_M}) select m.id, m.change_type, coalesce(case when m.severity <> 'info' then m.severity end, case when c.old_id is not null then 'info' end) as severity, c.fqn as old_fqn, case when c.old_id is not null then 'hint' end as migration_hint from m left join (select * from c where change_type is not null and old_id is not null) c on c.old_id = m.change_id")(_overlaid)


def _upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_nationkey") * 10 + F.col("n_regionkey")).alias("weight"))
    changes = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 25).alias("from_version_id"), (F.col("o_custkey") % 25).alias("to_version_id"))
    return matches.upgrade_path(changes, versions, 3, 17).select("id", "from_version_id", "to_version_id")


query("upgrade_path", """with v as (select n_nationkey as id, n_nationkey * 10 + n_regionkey as weight from nation)
select distinct o_orderkey as id, o_orderkey % 25 as from_version_id, o_custkey % 25 as to_version_id from orders join v f on f.id = o_orderkey % 25 join v t on t.id = o_custkey % 25
where f.weight >= (select weight from v where id = 3) and t.weight <= (select weight from v where id = 17) and f.weight < t.weight""")(_upgrade)
query("nearest_version", "select n_nationkey::bigint as id, n_nationkey * 10 + n_regionkey as weight from nation order by abs(n_nationkey * 10 + n_regionkey - 87), 1 limit 1")(
    lambda spark, sf_dir: matches.nearest_version(read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_nationkey") * 10 + F.col("n_regionkey")).alias("weight")), 87)
)
query("containment_join", M + "select file_path, machine_name from (select distinct file_path from m) p join (select distinct 'e' || s_suppkey as machine_name from supplier) x on contains(lower(file_path), machine_name)")(
    lambda spark, sf_dir: reports.contained(snapshots.matches(spark, sf_dir), read(spark, sf_dir, "supplier").select(F.concat(F.lit("e"), "s_suppkey").alias("machine_name")))
)

# JSON predicates, searches, pages.
query("json_scalar", "select json_extract_string(props, '$.k') as k, count(*) as n from events group by 1")(lambda spark, sf_dir: read(spark, sf_dir, "events").groupBy(jsonpath.scalar(F.col("props"), "$.k").alias("k")).agg(F.count("*").alias("n")))
query("json_membership", V + "select id from n where list_contains(cast(json_extract(signature_json, '$.params[*].name') as varchar[]), '\"$p\"')")(_versions(lambda o, n: n.where(jsonpath.holds(F.to_json(F.struct(F.from_json("signature_json", "struct<params:array<struct<name:string>>>")["params"]["name"].alias("names"))), "$.names", "$p")).select("id")))
query("symbol_search", V + "select id, fqn, symbol_type from n where (fqn ilike '%an%' or name ilike '%an%') and symbol_type = 'Brand#23' and language = 'l1'")(_versions(lambda o, n: n.where(F.col("fqn").ilike("%an%") | F.col("name").ilike("%an%")).where("symbol_type = 'Brand#23' and language = 'l1'").select("id", "fqn", "symbol_type")))
query("tuple_lookup", V + "select n.id from n join (select distinct fqn, symbol_type from o where id % 50 = 3) k using (fqn, symbol_type)")(_versions(lambda o, n: n.join(o.where("id % 50 = 3").select("fqn", "symbol_type"), ["fqn", "symbol_type"], "left_semi").select("id")))
query("symbol_page", V + "select id, fqn from n order by fqn, id limit 50 offset 100")(_versions(lambda o, n: n.select("id", "fqn").orderBy("fqn", "id").offset(100).limit(50)))
query("symbols_by_type", V + "select language, symbol_type, count(*) as n, count(distinct file_path) as files from n group by 1, 2")(_versions(lambda o, n: n.groupBy("language", "symbol_type").agg(F.count("*").alias("n"), F.count_distinct("file_path").alias("files"))))
query("file_languages", "select ending, case ending when 'a.libraries.yml' then 'libraries' when 'B.TWIG' then 'twig' when 'c.module' then 'php' when 'd.yaml' then 'yaml' when 'e.js' then 'javascript' when 'f.css' then 'css' end as language, count(*) as n from (select ['a.libraries.yml', 'B.TWIG', 'c.module', 'd.yaml', 'e.js', 'f.css', 'g.txt'][1 + p_partkey % 7] as ending from part) group by 1, 2")(
    lambda spark, sf_dir: read(spark, sf_dir, "part").select(F.element_at(F.array(*(F.lit(x) for x in ("a.libraries.yml", "B.TWIG", "c.module", "d.yaml", "e.js", "f.css", "g.txt"))), (F.col("p_partkey") % 7 + 1).cast("int")).alias("ending")).groupBy("ending", language(F.concat(F.lit("x/y/"), F.col("ending"))).alias("language")).agg(F.count("*").alias("n"))
)
query("base_versions", "select r, case when r like 'v%' then r[2:] when r like '^%' then r[2:] || '.0.0' when r like '~%' then r[2:] || '.0' when r like '>%' then r[2:] end as base, count(*) as n from (select [ 'v' || p_size || '.1.2', '^' || p_size, '~' || p_size || '.3', '>' || p_size || '.4.5', 'dev' ][1 + p_partkey % 5] as r from part) group by 1, 2")(
    lambda spark, sf_dir: read(spark, sf_dir, "part").select(F.expr("element_at(array(concat('v', p_size, '.1.2'), concat('^', p_size), concat('~', p_size, '.3'), concat('>', p_size, '.4.5'), 'dev'), cast(p_partkey % 5 + 1 as int))").alias("r")).groupBy("r", files.base_version(F.col("r")).alias("base")).agg(F.count("*").alias("n"))
)

# Keyed writes.
query("keep_last", "select event_id, event_type, user_id from events qualify row_number() over (partition by event_type, user_id order by event_id desc) = 1")(lambda spark, sf_dir: merge.keep_last(read(spark, sf_dir, "events"), ["event_type", "user_id"], "event_id").select("event_id", "event_type", "user_id"))


def _customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return c.where("c_custkey % 3 <> 0"), c.where("c_custkey % 2 = 0").withColumn("c_name", F.concat("c_name", F.lit("!")))


query("upsert", "select c_custkey, c_name || '!' as c_name, c_nationkey from customer where c_custkey % 2 = 0 union all select c_custkey, c_name, c_nationkey from customer where c_custkey % 3 <> 0 and c_custkey % 2 <> 0")(lambda spark, sf_dir: merge.upsert(*_customers(spark, sf_dir), ["c_custkey"]))
query("replace_partitions", "with t as (select * from customer where c_custkey % 3 <> 0), r as (select * from customer where c_nationkey < 5) select c_custkey, c_nationkey from r union all select c_custkey, c_nationkey from t where c_nationkey not in (select c_nationkey from r)")(
    lambda spark, sf_dir: merge.replace_partitions(_customers(spark, sf_dir)[0], read(spark, sf_dir, "customer").where("c_nationkey < 5").select("c_custkey", "c_name", "c_nationkey"), ["c_nationkey"]).select("c_custkey", "c_nationkey")
)
query("partial_update", "select c_custkey, case when c_custkey % 4 = 0 then 'new' else c_name end as c_name, c_nationkey from customer")(
    lambda spark, sf_dir: merge.partial_update(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), read(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "new").alias("c_name")), ["c_custkey"])
)
query("append_sequence", "with l as (select user_id, max(event_id % 10) as b from events where event_id % 2 = 0 group by 1) select event_id, e.user_id, coalesce(b, 0) + row_number() over (partition by e.user_id order by event_id) as seq from events e left join l on l.user_id = e.user_id where event_id % 2 = 1")(
    lambda spark, sf_dir: merge.append_sequence(read(spark, sf_dir, "events").where("event_id % 2 = 0").select("user_id", (F.col("event_id") % 10).alias("seq")), read(spark, sf_dir, "events").where("event_id % 2 = 1").select("event_id", "user_id"), "user_id", "event_id").select("event_id", "user_id", "seq")
)
query("exclusive_default", "select s_suppkey, s_nationkey, case when s_suppkey = max(case when s_suppkey % 2 = 0 then s_suppkey end) over (partition by s_nationkey) then 1 else 0 end as is_default from supplier")(
    lambda spark, sf_dir: merge.exclusive_flag(read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 2 == 0, 1).otherwise(0).alias("is_default")), ["s_nationkey"], "is_default", "s_suppkey")
)
query("cascade_delete", "select l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus <> 'F')")(lambda spark, sf_dir: merge.cascade(read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders").where("o_orderstatus <> 'F'"), "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber"))
query("cascade_clear", "select c_custkey, case when c_nationkey < 10 then c_nationkey end as c_nationkey from customer")(lambda spark, sf_dir: merge.cascade(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), read(spark, sf_dir, "nation").where("n_nationkey < 10"), "c_nationkey", "n_nationkey", clear=True).select("c_custkey", "c_nationkey"))
query("claim_next", "select o_orderkey as id, case when o_orderkey = (select min(o_orderkey) from orders where o_orderstatus = 'O') then 'running' when o_orderstatus = 'O' then 'queued' else 'completed' end as status from orders")(
    lambda spark, sf_dir: merge.claim_next(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "queued").otherwise("completed").alias("status"), F.lit(0).alias("attempts"))).select("id", "status")
)

# Dependencies. Every part depends on those of a half and a third of its number.
_EDGES = "e as (select distinct p_partkey as node, p_partkey // k as reached from part, (values (2), (3)) t(k) where p_partkey // k > 0)"
_EDGES_SQL = f"with recursive {_EDGES}"
_CLOSURE = f"{_EDGES_SQL}, c as (select node, reached from e union select c.node, e.reached from c join e on e.node = c.reached)\n"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.explode(F.array(F.lit(2), F.lit(3))).alias("k")
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), k).select("node", F.floor(F.col("node") / F.col("k")).alias("reached")).where("reached > 0").distinct()


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_size").alias("score"))


query("dependency_closure", _CLOSURE + "select node, count(distinct reached) as n from c group by 1")(lambda spark, sf_dir: planning.closure(_edges(spark, sf_dir)).groupBy("node").agg(F.count("*").alias("n")))
_LEVELS = """, comp as (select p_partkey as node, {comp} as component from part),
g as (select distinct a.component as c, b.component as d from e join comp a on a.node = e.node join comp b on b.node = e.reached where a.component <> b.component),
r as (select distinct component as c, 0 as depth from comp union select g.c, depth + 1 from r join g on g.d = r.c),
l as (select c, max(depth) as level from r group by 1), x as (select node, count(*) as direct from e where reached in (select p_partkey from part) group by 1)
select comp.node, component, level, coalesce(direct, 0) as direct from comp join l on l.c = component left join x on x.node = comp.node"""
query("upgrade_plan", _EDGES_SQL + _LEVELS.format(comp="p_partkey"))(lambda spark, sf_dir: planning.plan_order(_nodes(spark, sf_dir).select("node"), _edges(spark, sf_dir)))
# Every fortieth part and the next one depend on each other.
_RING = "select p_partkey as node, p_partkey + 1 as reached from part where p_partkey % 40 = 20 union all select p_partkey, p_partkey - 1 from part where p_partkey % 40 = 21"
_PAIRS = "case when p_partkey % 40 = 21 and p_partkey - 1 in (select p_partkey from part) then p_partkey - 1 else p_partkey end"
query("plan_with_cycles", _EDGES_SQL.replace("select distinct", f"select * from ({_RING}) union select distinct") + _LEVELS.format(comp=_PAIRS))(
    lambda spark, sf_dir: planning.plan_order(_nodes(spark, sf_dir).select("node"), _edges(spark, sf_dir).unionByName(snapshots.over_part(spark, sf_dir, _RING)))
)
query("hotspots", _CLOSURE + """select p.p_partkey as node, p.p_size::int as score, coalesce(sum(d.p_size), 0)::bigint as dependency_score, (p.p_size + coalesce(sum(d.p_size), 0))::bigint as hotspot
from part p left join (select distinct node, reached from c where node <> reached) c on c.node = p.p_partkey left join part d on d.p_partkey = c.reached group by 1, 2, p.p_size""")(
    lambda spark, sf_dir: planning.hotspots(_nodes(spark, sf_dir), _edges(spark, sf_dir))
)

# Relations between entries. Suppliers stand for extensions that depend on a half and a third of their number.
def _extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.filter(F.array(F.floor(F.col("s_suppkey") / 2), F.floor(F.col("s_suppkey") / 3)), lambda x: x > 0)
    return read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("machine_name"), F.transform(names, lambda x: F.concat(F.lit("s"), x)).alias("dependencies"), F.concat(F.lit("modules/c/s"), "s_suppkey", F.lit("/x.info.yml")).alias("file_path"))


_X = "with x as (select 's' || s_suppkey as machine_name, unnest([s_suppkey // 2, s_suppkey // 3]) as d from supplier), y as (select machine_name, 's' || d as dep from x where d > 0)\n"
query("dependents", _X + "select dep as machine_name, machine_name as dependent from y")(lambda spark, sf_dir: relations.dependents(_extensions(spark, sf_dir)))
query("dependency_impact", _X.rstrip() + ", o as (select 's' || l_suppkey as machine_name, count(*) as n from lineitem group by 1), i as (select q.machine_name, sum(o.n)::bigint as n from (select distinct * from y) q join o on o.machine_name = q.dep group by 1) select 's' || s_suppkey as machine_name, coalesce(o.n, 0) as direct_changes, coalesce(i.n, 0) as dependency_changes, coalesce(o.n, 0) + coalesce(i.n, 0) as total from supplier s left join o on o.machine_name = 's' || s_suppkey left join i on i.machine_name = 's' || s_suppkey")(
    lambda spark, sf_dir: relations.dependency_impact(_extensions(spark, sf_dir), read(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("machine_name")))
)
query("match_groups", "select 's' || s_suppkey as machine_name, case when s_suppkey % 2 = 0 then 'modules/c/s' || s_suppkey when s_suppkey % 3 = 0 then 'themes/z/s' || s_suppkey end as extension from supplier")(
    lambda spark, sf_dir: relations.match_group(_extensions(spark, sf_dir), read(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0 or s_suppkey % 3 = 0").select(F.concat(F.expr("if(s_suppkey % 2 = 0, 'modules/c/s', 'themes/z/s')"), "s_suppkey").alias("extension"), F.lit(1).alias("count")))
)
query("table_counts", "select 'part' as relation, count(*) as n from part union all select 'events', count(*) from events")(lambda spark, sf_dir: relations.table_counts({t: read(spark, sf_dir, t) for t in ("part", "events")}))
query("file_owners", "select 'm/' || (p_partkey % 5) || '/src/' || p_partkey as file_path, case when p_partkey % 5 < 3 then 'o' || (p_partkey % 5) else 'root' end as owner from part")(
    lambda spark, sf_dir: relations.owner_of(
        read(spark, sf_dir, "part").select(F.expr("concat('m/', p_partkey % 5, '/src/', p_partkey)").alias("file_path")),
        read(spark, sf_dir, "part").where("p_partkey < 5").select(F.expr("if(p_partkey % 5 < 3, concat('m/', p_partkey % 5), 'm')").alias("folder"), F.expr("if(p_partkey % 5 < 3, concat('o', p_partkey % 5), 'root')").alias("owner")).unionByName(read(spark, sf_dir, "part").where("p_partkey = 5").select(F.lit("m/0").alias("folder"), F.lit("o0").alias("owner"))),
    )
)
query("fix_templates", V + """select fqn, '{"type":"parameter_insert","function":"' || fqn || '","position":' || json_array_length(o.signature_json, '$.params') || ',"value":"NULL"}' as template from o join n using (fqn, symbol_type) where o.signature_hash <> n.signature_hash and json_array_length(n.signature_json, '$.params') = json_array_length(o.signature_json, '$.params') + 1""")(
    _versions(lambda o, n: diff.changed_signatures(o, n).select("fqn", relations.fix_template(F.lit("signature_changed"), F.col("fqn"), F.col("fqn"), diff.signature_changes(F.col("old_signature_json"), F.col("new_signature_json"))).alias("template")).where("template is not null"))
)
query("scan_patterns", M + "select distinct change_type, case change_type when 'function_removed' then 'call' when 'signature_changed' then 'call' when 'service_renamed' then 'string' when 'library_deprecated' then 'string' end as match_kind from m")(
    _matches(lambda m: m.select("change_type").distinct().select("change_type", relations.pattern(F.col("change_type"), F.lit("x"))["match_kind"].alias("match_kind")))
)

# Texts: extraction and rewriting.
query("page_links", "select page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as href from pages")(lambda spark, sf_dir: extract.links(read(spark, sf_dir, "pages")))
query("pages_by_host", "select regexp_extract(url, '://([^/]+)', 1) as host, count(*) as n from pages group by 1")(lambda spark, sf_dir: read(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "://([^/]+)", 1).alias("host")).agg(F.count("*").alias("n")))
query("word_rewrite", r"select doc_id, sha256(regexp_replace(text, '\bthe\b', 'THE', 'g')) as new_hash, strlen(text)::int as n_bytes, length(text)::int as n_points from documents")(
    lambda spark, sf_dir: read(spark, sf_dir, "documents").select("doc_id", F.sha2(edits.replace_word(F.col("text"), "the", "THE"), 256).alias("new_hash"), F.octet_length("text").alias("n_bytes"), F.length("text").alias("n_points"))
)
query("rewrite_first_call", "select p_partkey, case when instr(p_name, ' ') > 0 then p_name[1:instr(p_name, ' ') - 1] || '->' || p_name[instr(p_name, ' ') + 1:] else p_name end as rewritten from part")(lambda spark, sf_dir: read(spark, sf_dir, "part").select("p_partkey", edits.rewrite_call(F.col("p_name"), F.lit(" "), F.lit("->")).alias("rewritten")))
query("insert_argument", "select p_partkey, 'f(' || p_size || ', NULL, ' || p_brand || ')' as rewritten from part")(lambda spark, sf_dir: read(spark, sf_dir, "part").select("p_partkey", edits.insert_argument(F.concat(F.lit("f("), F.col("p_size").cast("string"), F.lit(","), F.col("p_brand"), F.lit(")")), F.lit(1), F.lit("NULL")).alias("rewritten")))
query("line_range", "select doc_id::varchar as file_path, i as line, string_split(text, chr(10))[i] as text from documents, unnest(range(1, 7)) t(i) where i <= len(string_split(text, chr(10)))")(
    lambda spark, sf_dir: files.line_range(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), "text"), F.lit(2), F.lit(3)).select("file_path", F.col("line").cast("long").alias("line"), "text")
)


def _word_edits(docs: DataFrame) -> DataFrame:
    """Edits of the first word and the one after it, by their places in bytes; a document of one word has one."""
    head = F.regexp_extract("text", r"^(\s*)(\S+)(\s*)(\S*)", 0)
    part = lambda k: F.regexp_extract("text", r"^(\s*)(\S+)(\s*)(\S*)", k)
    first, second = F.octet_length(part(1)), F.octet_length(head) - F.octet_length(part(4))
    words = F.array(F.struct(part(2).alias("word"), first.alias("at")), F.struct(part(4).alias("word"), second.alias("at")))
    found = docs.select("file_path", F.posexplode(words).alias("k", "w")).where("w.word <> ''")
    template = F.to_json(F.struct(F.lit("string_replace").alias("type"), F.col("w.word").alias("old"), F.lit("X").alias("new")))
    return found.select("file_path", F.xxhash64("file_path", "k").alias("id"), F.col("w.at").alias("byte_start"), (F.col("w.at") + F.octet_length("w.word")).alias("byte_end"), F.col("w.word").alias("matched_source"), template.alias("fix_template"))


@query("apply_edits")
def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two edits a document, by their places: every first word and the one after it."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), "text")
    return edits.apply_edits(docs, _word_edits(docs))


_HEAD = r"'^([\t\n\x0B\f\r ]*)([^\t\n\x0B\f\r ]+)([\t\n\x0B\f\r ]*)([^\t\n\x0B\f\r ]*)'"


@query("applied_edits", f"""with h as (select doc_id, text, regexp_extract(text, {_HEAD}, 0) as w, regexp_extract(text, {_HEAD}, 1) as a, regexp_extract(text, {_HEAD}, 2) as b, regexp_extract(text, {_HEAD}, 3) as c, regexp_extract(text, {_HEAD}, 4) as d from documents)
select doc_id::varchar as file_path, ((b <> 'X')::int + (d <> '' and d <> 'X')::int)::bigint as applied, ((b = 'X')::int + (d = 'X')::int)::bigint as skipped,
  sha256(a || 'X' || c || case when d = '' then '' else 'X' end || substring(text, length(w) + 1)) as new_hash from h where b <> ''""")
def _applied_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same edits, counted by file, with a hash of each rewritten text."""
    one = lambda status: F.count_if(F.col("status") == status).alias(status)
    return _applied(spark, sf_dir).groupBy("file_path").agg(one("applied"), one("skipped"), F.sha2(F.max("new_text"), 256).alias("new_hash"))


# Streams.
query("stream_tail", "select event_id, event_type from events where event_id > 500")(lambda spark, sf_dir: logs.drained(logs.tail(logs.stream(spark, sf_dir, "events"), "event_id", 500).select("event_id", "event_type"), "tail"))
query("stream_progress", "select event_type, max(event_id) as last_seq, count(*) as n from events group by 1")(lambda spark, sf_dir: logs.drained_totals(logs.progress(logs.stream(spark, sf_dir, "events"), "event_type", "event_id"), "progress"))
query("stream_last_state", "select user_id, arg_max(event_type, event_id) as state, max(event_id) as last_seq from events group by 1")(lambda spark, sf_dir: logs.drained_totals(logs.last_state(logs.stream(spark, sf_dir, "events"), "user_id", "event_id", "event_type"), "states"))
query("stream_changed_only", "select user_id, event_id, event_type from events qualify event_type is distinct from lag(event_type) over (partition by user_id order by event_id)")(
    lambda spark, sf_dir: logs.drained(logs.changed_only(logs.stream(spark, sf_dir, "events"), "user_id", "event_id", "event_type"), "changed")
)


from tidemark.plans import change_queries, link_queries, project_queries, report_queries, scan_queries, stream_queries, table_queries, text_queries  # noqa: E402, F401  (register their queries above)
