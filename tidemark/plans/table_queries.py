"""Queries of keyed tables: what a series of writes leaves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.lineage import shared_folder
from tidemark.plans.registry import query
from tidemark.sources import snapshots
from tidemark.sources.keyed import KeyedTable, with_change_defaults


@query(
    "keyed_table",
    """with a as (select o_orderkey as k, o_orderstatus as status, o_totalprice as price from orders where o_orderkey % 3 <> 0),
b as (select k, case when k % 2 = 0 then 'X' else status end as status, price from a union all select o_orderkey, 'X', o_totalprice from orders where o_orderkey % 6 = 0),
c as (select k, status, case when k % 5 = 0 then -1.0 else price end as price from b)
select k, status, price from c where k % 7 <> 0""",
)
def _keyed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders created, upserted, updated in part and deleted by key, bucket by bucket."""
    orders = snapshots.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    table = KeyedTable.create(spark, f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}", orders.schema, ["k"], 8)
    table = table.upsert(orders.where("k % 3 <> 0"))
    table = table.upsert(orders.where("k % 2 = 0").withColumn("status", F.lit("X")))
    table = table.update(orders.where("k % 5 = 0").select("k", F.lit(-1.0).alias("price")))
    return table.delete(orders.where("k % 7 = 0").select("k")).read()


query(
    "change_defaults",
    """select p_partkey as id, case when p_partkey % 3 = 0 then 'info' when change_type = 'function_removed' then 'breaking' when change_type = 'signature_changed' then 'breaking' when change_type = 'library_deprecated' then 'deprecation' else 'unknown' end as severity,
  case when p_partkey % 4 = 0 then 0.25 when change_type = 'function_removed' then 0.95 when change_type = 'misc' then 0.5 else 0.9 end::double as confidence
from (select p_partkey, case p_partkey % 5 when 0 then 'function_removed' when 1 then 'signature_changed' when 2 then 'library_deprecated' else 'misc' end as change_type from part)""",
)(
    lambda spark, sf_dir: with_change_defaults(
        snapshots.read(spark, sf_dir, "part").selectExpr(
            "p_partkey as id", "case p_partkey % 5 when 0 then 'function_removed' when 1 then 'signature_changed' when 2 then 'library_deprecated' else 'misc' end as change_type",
            "case when p_partkey % 3 = 0 then 'info' end as severity", "case when p_partkey % 4 = 0 then 0.25D end as confidence",
        )
    ).select("id", "severity", "confidence")
)
