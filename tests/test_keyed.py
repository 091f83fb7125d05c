"""Keyed tables: what a write touches, what it leaves when it fails, and what two writers do."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources.keyed import ConflictError, KeyedTable, with_change_defaults

SCHEMA = "k long, g string, v string, n int"


def rows(table):
    return sorted([tuple(r) for r in table.read().collect()], key=str)


@pytest.fixture
def table(spark, tmp_path):
    start = spark.createDataFrame([(k, "a", f"v{k}", k) for k in range(50)] + [(None, None, "null", -1)], SCHEMA)
    return KeyedTable.create(spark, f"{tmp_path}/t", start.schema, ["k", "g"], 16).upsert(start)


def test_writes_touch_their_buckets_alone(spark, table):
    before = dict(table.folders)
    new = spark.createDataFrame([(3, "a", "x", 1), (3, "a", "y", 2), (None, None, "again", 0)], SCHEMA)
    after = table.upsert(new, order="n")
    changed = {b for b in after.folders if after.folders[b] != before.get(b)}
    assert len(changed) <= 2 and all(after.folders[b] == before[b] for b in before if b not in changed)
    want = sorted([(k, "a", f"v{k}", k) for k in range(50) if k != 3] + [(3, "a", "y", 2), (None, None, "again", 0)], key=str)
    assert rows(after) == want == rows(KeyedTable(spark, table.path))
    assert rows(table) != want  # who has read an earlier manifest still sees that
    assert after.drop_unused() == 0 or rows(after) == want


def test_each_kind_of_write(spark, table):
    table = table.insert_new(spark.createDataFrame([(3, "a", "no", 0), (99, "b", "yes", 0)], SCHEMA), "n")
    table = table.update(spark.createDataFrame([(4, "a", None, 44), (77, "z", "no", 1)], SCHEMA))
    table = table.delete(spark.createDataFrame([(5, "a"), (None, None), (1000, "q")], "k long, g string"))
    found = {(r[0], r[1]): r for r in rows(table)}
    assert found[3, "a"][2] == "v3" and found[99, "b"][2] == "yes" and found[4, "a"][2:] == ("v4", 44) and (77, "z") not in found
    assert (5, "a") not in found and (None, None) not in found and len(found) == 50
    assert table.upsert(spark.createDataFrame([], SCHEMA)) is table
    gone = table.delete(table.read().select("k", "g"))
    assert rows(gone) == [] and rows(gone.upsert(spark.createDataFrame([(1, "a", "v", 1)], SCHEMA))) == [(1, "a", "v", 1)]


def test_a_failed_write_leaves_the_table(spark, table):
    before = rows(table)
    bad = spark.createDataFrame([(3, "a", "x", 1)], SCHEMA).withColumn("v", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        table.upsert(bad)
    again = KeyedTable(spark, table.path)
    assert rows(again) == before and again.number == table.number
    again.drop_unused()
    assert rows(again) == before
    with pytest.raises(ValueError):
        table.write(spark.createDataFrame([(3, "a", "x", 1)], SCHEMA), lambda old, new: spark.createDataFrame([(k, "moved", "x", 1) for k in range(40)], SCHEMA))
    assert rows(KeyedTable(spark, table.path)) == before


def test_of_two_writers_one_fails(spark, table):
    other = KeyedTable(spark, table.path)
    table.upsert(spark.createDataFrame([(3, "a", "first", 1)], SCHEMA))
    with pytest.raises(ConflictError):
        other.upsert(spark.createDataFrame([(4, "a", "second", 1)], SCHEMA))
    found = {r[0]: r[2] for r in rows(KeyedTable(spark, table.path))}
    assert found[3] == "first" and found[4] == "v4"
    with pytest.raises(ConflictError):
        KeyedTable.create(spark, table.path, table.schema, ["k"])
    with pytest.raises(FileNotFoundError):
        KeyedTable(spark, f"{table.path}/nothing")


def test_defaults_of_changes(spark):
    frame = spark.createDataFrame([("function_removed", None, None), ("signature_changed", "", 0.1), ("misc", "info", None)], "change_type string, severity string, confidence double")
    assert sorted(tuple(r) for r in with_change_defaults(frame).collect()) == [("function_removed", "breaking", 0.95), ("misc", "info", 0.5), ("signature_changed", "breaking", 0.1)]
    assert [tuple(r) for r in with_change_defaults(frame.select("change_type").limit(1)).collect()] == [("function_removed", "breaking", 0.95)]
