"""Job and log streams: tails, progress, last states, and snapshots without repeats."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.lineage import shared_folder


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's file as a stream; new files of that name below the folder would follow."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{sf_dir}/{name}.parquet*")


def drained(rows: DataFrame, name: str, place: str | None = None) -> DataFrame:
    """All that an append stream gives for what is there now, exactly once, as a table.

    With a ``place`` of the caller's, a later call goes on from where the last one ended, also
    after a driver is lost; without one the stream starts anew.
    """
    spark = rows.sparkSession
    out = place or _place(spark, name)
    query = rows.writeStream.format("parquet").option("checkpointLocation", out + "-offsets").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


def drained_totals(totals: DataFrame, name: str, place: str | None = None) -> DataFrame:
    """The last full result of a streaming aggregation; a batch that runs again replaces its own result.

    ``place`` as for ``drained``.
    """
    spark = totals.sparkSession
    out = place or _place(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:08d}")

    query = totals.writeStream.outputMode("complete").option("checkpointLocation", out + "-offsets").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    found = spark.read.parquet(out)
    return found.where(F.col("batch") == found.agg(F.max("batch").alias("m")).first().m).drop("batch")


def tail(rows: DataFrame, seq: str, after: int) -> DataFrame:
    """Rows that follow a sequence number; works on streams and tables alike."""
    return rows.where(F.col(seq) > after)


def once(rows: DataFrame, group: str, seq: str, at: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Rows without those of a group and number that came before; works on streams and tables alike.

    A stream that names its time column keeps numbers for ``lateness`` only; without one it keeps
    all there have been.
    """
    if at and rows.isStreaming:
        return rows.withWatermark(at, lateness).dropDuplicatesWithinWatermark([group, seq])
    return rows.dropDuplicates([group, seq])


def progress(rows: DataFrame, group: str, seq: str) -> DataFrame:
    """Per group its greatest sequence number and how many rows it has."""
    return rows.groupBy(group).agg(F.max(seq).alias("last_seq"), F.count("*").alias("n"))


def last_state(rows: DataFrame, group: str, seq: str, state: str) -> DataFrame:
    return rows.groupBy(group).agg(F.max_by(state, seq).alias("state"), F.max(seq).alias("last_seq"))


def changed_only(rows: DataFrame, group: str, seq: str, value: str) -> DataFrame:
    """Of a stream, the rows whose value differs from the group's last one; state is one value a group.

    A repeated null is no change. Of one micro-batch a group's three columns are ordered in
    memory, so a hot group is bounded by the size of micro-batches (maxFilesPerTrigger).
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # A group can come in many Arrow batches; only all of them together are in order.
        group_rows = pd.concat(list(batches)).sort_values(seq, kind="stable")
        values = group_rows[value].astype(object).where(group_rows[value].notna(), None).tolist()
        known = state.exists
        last = state.get[0] if known else None
        keep = []
        for v in values:
            keep.append(not known or v != last)
            known, last = True, v
        state.update((last,))
        yield group_rows.loc[keep, [group, seq, value]]

    out = ", ".join(f"{c} {kinds[c]}" for c in (group, seq, value))
    return rows.select(group, seq, value).groupBy(group).applyInPandasWithState(step, out, f"value {kinds[value]}", "append", GroupStateTimeout.NoTimeout)


def work(jobs: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]], out: str) -> None:
    """Queue worker: each micro-batch of jobs goes to the handler of its kind, whose result is kept under ``out``."""

    def handle(batch: DataFrame, number: int) -> None:
        for kind, handler in handlers.items():
            handler(batch.where(F.col("kind") == kind)).write.mode("overwrite").parquet(f"{out}/{kind}/batch={number:08d}")

    jobs.writeStream.option("checkpointLocation", out + "-offsets").trigger(availableNow=True).foreachBatch(handle).start().awaitTermination()
