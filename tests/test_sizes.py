"""Plans of what is larger than its files tell, and joins of few keys with many rows."""

import math
import re

import pytest

from tests.test_growth import moved
from tidemark.operators import references
from tidemark.operators.lineage import blocked
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_a_search_sends_no_references_through_the_driver(spark):
    joins = re.findall(r"BroadcastHashJoin .*", plan(registry.QUERIES["semantic_search"](spark, SF)))
    assert all("LeftSemi, BuildRight" in x for x in joins)


def test_links_are_given_once_where_they_are_made(spark):
    """A pair that shares two keys comes once, and no pass over all pairs stands behind the joins."""
    rows = [(1, 1, "libraries", "library", "l", "x", None, '{"asset_paths":["a.js","b.js"]}')]
    rows += [(1, 2, "javascript", "function", f"f{p}", p, None, None) for p in ("a.js", "b.js")] + [(1, 3, "css", "selector", "s", "a.js", None, None)]
    frame = spark.createDataFrame(rows, "version_id int, id long, language string, symbol_type string, fqn string, file_path string, signature_json string, metadata_json string")
    found = references.links(frame)
    want = [(1, 1, "css_asset_symbol", 3), (1, 1, "javascript_asset_symbol", 2), (1, 2, "declared_by_library", 1), (1, 3, "declared_by_library", 1)]
    assert sorted(map(tuple, found.collect())) == want
    assert re.match(r"(AdaptiveSparkPlan.*\n\+- (== Final Plan ==\n)?\s*)?Union|AdaptiveSparkPlan[^\n]*\n\+- [^\n]*\n\s+(\w+QueryStage[^\n]*\n\s+\+- )?Union", plan(references.links(frame)))


def test_blocks_keep_their_tasks(spark):
    a, b = (spark.range(9000).selectExpr(f"id as {c}", "concat('k', id % 2) as k") for c in "xy")
    met = blocked(a, b, ["k"], "x", "y")
    assert met.rdd.getNumPartitions() == 16 * spark.sparkContext.defaultParallelism
    assert met.count() == 2 * 4500**2


def test_blocks_send_rows_no_more_often_than_tasks_need(spark):
    """A row was sent once for each block of the other side, however many those were."""
    a, b = (spark.range(9000).selectExpr(f"id as {c}", "'k' as k") for c in "xy")
    n, rows = moved(spark, lambda: blocked(a, b, ["k"], "x", "y", block=100).count())
    assert n == 9000**2 and rows < 18000 * (math.isqrt(16 * spark.sparkContext.defaultParallelism) + 4)


@pytest.mark.parametrize("name", ["structured_renames", "similar_names", "rename_scores"])
def test_pairs_are_made_in_many_tasks(spark, name):
    assert registry.QUERIES[name](spark, SF).rdd.getNumPartitions() >= 16 * spark.sparkContext.defaultParallelism
