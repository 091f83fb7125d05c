"""Queries of streams with state: tasks and their statuses, and a queue's work."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.lineage import shared_folder
from tidemark.plans.registry import query
from tidemark.streaming import logs, tasks

_KIND = "case (event_id * 7 + user_id) % 6 when 0 then 'submit' when 1 then 'start' when 2 then 'progress' when 3 then 'complete' when 4 then 'fail' else 'cancel' end"


@query(
    "task_states",
    f"""with e as (select user_id as task_id, event_id as seq, {_KIND} as kind, event_id % 100 as pct from events),
s as (select task_id, min(seq) as first from e where kind = 'submit' group by 1),
k as (select e.* from e join s using (task_id) where seq >= first),
m as (select *, row_number() over (partition by task_id order by seq) as nth from k where kind in ('start', 'complete', 'fail', 'cancel')),
f as (select task_id, arg_max(kind, seq) as kind from m where kind <> 'cancel' or nth = 1 group by 1),
p as (select task_id, arg_max(case when kind = 'complete' then 100 else pct end, seq) as progress from k where kind in ('progress', 'complete') group by 1)
select k.task_id, max(seq) as seq, case any_value(f.kind) when 'start' then 'running' when 'complete' then 'completed' when 'fail' then 'failed' when 'cancel' then 'cancelled' else 'pending' end as status,
  coalesce(any_value(p.progress), 0)::int as progress from k left join f using (task_id) left join p using (task_id) group by 1""",
)
def _task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last status of every task that events submit."""
    events = logs.stream(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.expr(_KIND).alias("kind"), (F.col("event_id") % 100).alias("pct"))
    told = logs.drained(tasks.task_states(events), "tasks")
    return told.groupBy("task_id").agg(F.max("seq").alias("seq"), F.max_by("status", "seq").alias("status"), F.max_by("progress", "seq").alias("progress"))


@query(
    "queue_work",
    """select case when event_type in (select min(event_type) from events) then 'first' else 'other' end as kind, count(*) as n, sum(event_id)::bigint as total from events group by 1""",
)
def _queue_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of two kinds, each handled by its own function, batch by batch."""
    rows = logs.stream(spark, sf_dir, "events")
    least = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.min("event_type").alias("t")).first().t
    jobs = rows.select("event_id", F.when(F.col("event_type") == least, "first").otherwise("other").alias("kind"))
    counted = lambda batch: batch.agg(F.count("*").alias("n"), F.coalesce(F.sum("event_id"), F.lit(0)).alias("total"))
    out = f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"
    logs.work(jobs, {"first": counted, "other": counted}, out)
    done = [spark.read.schema("n long, total long").parquet(f"{out}/{kind}").withColumn("kind", F.lit(kind)) for kind in ("first", "other")]
    return done[0].unionByName(done[1]).groupBy("kind").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0")
