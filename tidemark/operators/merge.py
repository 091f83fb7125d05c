"""Keyed writes as whole-relation rewrites: upserts, replacements, sequences and cascades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.lineage import checkpointed


def _same(left: DataFrame, right: DataFrame, key: list[str], null_safe: bool) -> Column:
    pairs = [left[k].eqNullSafe(right[k]) if null_safe else left[k] == right[k] for k in key]
    return reduce(lambda a, b: a & b, pairs)


def keep_last(df: DataFrame, key: list[str], order: str = "id") -> DataFrame:
    """One row a key, the one of the greatest ``order`` (nulls last); null keys are equal to each other.

    An aggregate that combines where rows are read, so a hot key's rows don't meet.
    """
    last = df.groupBy(*(F.col(k).alias(f"_key{n}") for n, k in enumerate(key))).agg(F.max_by(F.struct(*df.columns), F.struct(F.col(order).isNotNull(), order)).alias("row"))
    return last.select("row.*")


def repeated(df: DataFrame, key: list[str], order: str = "id") -> DataFrame:
    """Keys that more than one row has, with how many and the greatest ``order`` of them."""
    return df.groupBy(*key).agg(F.count("*").alias("n"), F.max(order).alias("last_id")).where("n > 1")


def upsert(target: DataFrame, rows: DataFrame, key: list[str], null_safe: bool = True) -> DataFrame:
    """``rows`` in place of the target's rows of the same key. Keys in ``rows`` are unique (see keep_last)."""
    kept = target.join(rows, _same(target, rows, key, null_safe), "left_anti")
    return kept.unionByName(rows, allowMissingColumns=True)


def replace_partitions(target: DataFrame, rows: DataFrame, partition: list[str], touched: DataFrame | None = None) -> DataFrame:
    """``rows`` in place of whole partitions: those in ``touched`` (by default those that rows have)."""
    gone = (rows if touched is None else touched).select(*partition).distinct()
    return target.join(gone, partition, "left_anti").unionByName(rows, allowMissingColumns=True)


def partial_update(target: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """Target rows with the columns of ``updates`` that are not null put in place of their own."""
    changed = [c for c in updates.columns if c not in key]
    new = updates.select(*key, *(F.col(c).alias(f"_new_{c}") for c in changed))
    out = target.join(new, key, "left")
    return out.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in changed else F.col(c) for c in target.columns))


def append_sequence(log: DataFrame, rows: DataFrame, group: str, order: str, seq: str = "seq") -> DataFrame:
    """``rows`` numbered on from their group's greatest number in ``log``; a null group is one too.

    Rows are sorted by ranges of group and order, so a hot group is spread over many. A row's
    number is its place in the range, less that of its group's first row there, after what
    earlier ranges have of the group; of that one count a range and group is joined.
    """
    keys = [F.col(group).asc_nulls_first(), F.col(order).asc_nulls_first()]
    placed = rows.drop(seq).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = checkpointed(placed).withColumn("_range", F.shiftright("_at", 33))
    counts = placed.groupBy(F.col(group).alias("_group"), "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumnRenamed("_range", "_of")
    base = log.groupBy(F.col(group).alias("_logged")).agg(F.max(seq).alias("_base"))
    starts = counts.join(base, F.col("_group").eqNullSafe(F.col("_logged")), "left").select("_group", "_of", (F.coalesce("_base", F.lit(0)) + F.col("_before") - F.col("_first") + 1).alias("_shift"))
    out = placed.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")))
    return out.withColumn(seq, F.col("_at") + F.col("_shift")).drop("_at", "_range", "_group", "_of", "_shift")


def exclusive_flag(df: DataFrame, group: list[str], flag: str, order: str = "id") -> DataFrame:
    """The flag stays on the last row of a group that has it, and is cleared on others."""
    last = F.max(F.when(F.col(flag) == 1, F.col(order))).over(Window.partitionBy(*group))
    return df.withColumn("_last", last).withColumn(flag, F.when(F.col(order).eqNullSafe(F.col("_last")), 1).otherwise(0)).drop("_last")


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str, clear: bool = False) -> DataFrame:
    """Children of parents that are gone are deleted, or lose their reference where ``clear``."""
    live = parents.select(F.col(parent_key).alias("_live")).distinct()
    if not clear:
        return children.join(live, children[child_key] == live["_live"], "left_semi")
    return children.join(live, children[child_key] == live["_live"], "left").withColumn(child_key, F.col("_live")).drop("_live")


def merge_duplicates(parents: DataFrame, children: DataFrame, natural: str, reference: str, identity: list[str]) -> tuple[DataFrame, DataFrame]:
    """Parents of one natural key become the one of greatest id; children follow, colliding ones (null-safe) as one."""
    keep = parents.withColumn("_keep", F.max("id").over(Window.partitionBy(natural)))
    moved = children.join(keep.select(F.col("id").alias(reference), "_keep"), reference, "left").withColumn(reference, F.coalesce("_keep", reference)).drop("_keep")
    return keep.where("id = _keep").drop("_keep"), keep_last(moved, identity)


def claim_next(jobs: DataFrame) -> DataFrame:
    """The jobs table with the oldest queued job set to running and its attempts counted."""
    oldest = jobs.where("status = 'queued'").orderBy("id").limit(1).select(F.col("id").alias("_id"))
    out = jobs.join(F.broadcast(oldest), jobs["id"] == F.col("_id"), "left")
    taken = F.col("_id").isNotNull()
    return out.withColumns({"status": F.when(taken, "running").otherwise(F.col("status")), "attempts": F.col("attempts") + taken.cast("int")}).drop("_id")
