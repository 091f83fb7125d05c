"""What changed between two snapshots of one relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import jsonpath

KEY = ("fqn", "symbol_type")


def _prefix(prefix: str | None) -> Column:
    return F.lit(True) if prefix is None else F.lower("file_path").startswith(prefix.lower())


def removed(old: DataFrame, new: DataFrame, key=KEY, prefix: str | None = None) -> DataFrame:
    """Rows of ``old`` whose key is not in ``new``, under a path prefix if given. Null keys never meet."""
    return old.where(_prefix(prefix)).join(new.select(*key), list(key), "left_anti")


def added(old: DataFrame, new: DataFrame, key=KEY, prefix: str | None = None) -> DataFrame:
    return removed(new, old, key, prefix)


def paired(old: DataFrame, new: DataFrame, key=KEY) -> DataFrame:
    """Rows of both snapshots side by side as old_* and new_*; key columns once."""
    rest = [c for c in old.columns if c not in key]
    left = old.select(*key, *(F.col(c).alias(f"old_{c}") for c in rest))
    right = new.select(*key, *(F.col(c).alias(f"new_{c}") for c in rest))
    return left.join(right, list(key))


def changed_signatures(old: DataFrame, new: DataFrame, key=KEY) -> DataFrame:
    """Pairs of one key whose signature hashes differ; a null hash is no change."""
    return paired(old, new, key).where("old_signature_hash != new_signature_hash")


def parameter_counts(old: DataFrame, new: DataFrame, direction: str = "increased", key=KEY) -> DataFrame:
    """Pairs whose number of parameters went up or down, with both counts; the largest step first."""
    both = paired(old, new, key)
    both = both.withColumns({f"{v}_count": F.coalesce(jsonpath.length(F.col(f"{v}_signature_json"), "$.params"), F.lit(0)) for v in ("old", "new")})
    step = F.col("new_count") - F.col("old_count")
    return both.where(step > 0 if direction == "increased" else step < 0).orderBy(F.abs(step).desc(), *key)


def newly_deprecated(old: DataFrame, new: DataFrame, key=KEY) -> DataFrame:
    return paired(old, new, key).where("old_is_deprecated = 0 and new_is_deprecated = 1")


def deprecated_then_removed(old: DataFrame, new: DataFrame, key=KEY) -> DataFrame:
    return removed(old.where("is_deprecated = 1"), new, key)


def modernised(old: DataFrame, new: DataFrame, old_type: str, new_type: str) -> DataFrame:
    """Entries of one type that reappear under the same name as another; per name the last one counts."""
    last = new.where(F.col("symbol_type") == new_type).groupBy("fqn").agg(F.max("id").alias("new_id"))
    return old.where(F.col("symbol_type") == old_type).join(last, "fqn")


def all_changes(old: DataFrame, new: DataFrame, key=KEY) -> DataFrame:
    """(key, change_type, old_id, new_id) of every key that differs, from one full outer join.

    What is in both versions can change its signature and become deprecated: that is two rows.
    """
    left = old.select(*key, F.col("id").alias("old_id"), F.col("signature_hash").alias("oh"), F.col("is_deprecated").alias("od"))
    right = new.select(*key, F.col("id").alias("new_id"), F.col("signature_hash").alias("nh"), F.col("is_deprecated").alias("nd"))
    gone = F.when(F.col("od") == 1, "deprecated_removed").otherwise("symbol_removed")
    kinds = (
        F.when(F.col("new_id").isNull(), gone).when(F.col("old_id").isNull(), "symbol_added").when(F.col("oh") != F.col("nh"), "signature_changed"),
        F.when((F.col("od") == 0) & (F.col("nd") == 1), "deprecated_added"),
    )
    both = left.join(right, list(key), "full_outer")
    return both.select(*key, F.explode(F.array_compact(F.array(*kinds))).alias("change_type"), "old_id", "new_id")


_SIGNATURE = "struct<params:array<struct<name:string,type:string,default:string>>,return_type:string>"


def signature_changes(old_json: Column, new_json: Column) -> Column:
    """Differences of two signatures, parameter by position, then the return type, as an array.

    Each has type, position, old and new (names or types); absent signatures have no parameters.
    """
    a, b = (F.from_json(x, _SIGNATURE) for x in (old_json, new_json))
    p, q = (F.coalesce(x["params"], F.array().cast("array<struct<name:string,type:string,default:string>>")) for x in (a, b))

    def step(kind: str, at: Column, old: Column, new: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), at.cast("int").alias("position"), old.cast("string").alias("old"), new.cast("string").alias("new"))

    def at(i: Column) -> Column:
        x, y = F.get(p, i), F.get(q, i)
        both = x.isNotNull() & y.isNotNull()
        found = F.array(
            F.when(x.isNull() & y.isNotNull(), step("parameter_added", i, F.lit(None), y["name"])),
            F.when(x.isNotNull() & y.isNull(), step("parameter_removed", i, x["name"], F.lit(None))),
            F.when(both & ~x["type"].eqNullSafe(y["type"]), step("parameter_type_changed", i, x["type"], y["type"])),
            F.when(both & ~F.coalesce(x["name"], F.lit("")).eqNullSafe(F.coalesce(y["name"], F.lit(""))), step("parameter_renamed", i, x["name"], y["name"])),
        )
        return F.array_compact(found)

    most = F.greatest(F.size(p), F.size(q))
    by_place = F.when(most > 0, F.flatten(F.transform(F.sequence(F.lit(0), most - 1), at)))
    returns = F.array_compact(F.array(F.when(~a["return_type"].eqNullSafe(b["return_type"]), step("return_type_changed", F.lit(None), a["return_type"], b["return_type"]))))
    return F.concat(F.coalesce(by_place, F.array().cast("array<struct<type:string,position:int,old:string,new:string>>")), returns)


def changed_keys(old_json: Column, new_json: Column) -> Column:
    """Top-level keys whose values differ between two JSON objects, sorted."""
    a, b = (F.coalesce(F.from_json(x, "map<string,string>"), F.create_map().cast("map<string,string>")) for x in (old_json, new_json))
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    return F.array_sort(F.filter(keys, lambda k: ~F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k))))


def dropped_items(old: DataFrame, new: DataFrame, key: str, lists: dict[str, str]) -> DataFrame:
    """(key, change_type, item): what array columns of ``old`` lost in ``new``; ``lists`` maps column to change type."""
    right = new.select(key, *(F.col(c).alias(f"new_{c}") for c in lists))
    both = old.select(key, *lists).join(right, key)
    none = F.array().cast("array<string>")
    lost = F.concat(*(F.transform(F.array_except(F.col(c), F.coalesce(F.col(f"new_{c}"), none)), _tagged(kind)) for c, kind in lists.items()))
    return both.select(key, F.explode(lost).alias("x")).select(key, "x.change_type", "x.item")


def _tagged(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("change_type"), x.alias("item"))
