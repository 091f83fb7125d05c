"""Dependency closures and upgrade plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tidemark.operators.lineage import checkpointed, meet


#: Elements of its dependencies' sets up to which a node's own set is made in one row.
SET = 10_000


def closure(edges: DataFrame, most: int = 64, largest: int = SET) -> DataFrame:
    """(node, reached) of every node that a path of one or more edges leads to.

    A node's set is made once, of those of its dependencies: nodes that nothing depends on are
    taken off in rounds (``_ranked``), and in the opposite order each edge takes the set at its
    end to its start. So a pair moves as often as its node has edges, not once for each node
    between. Nodes on cycles or long chains, those with more than ``largest`` elements to unite,
    and all that depend on them go by pairs (``_doubled``).
    """
    sets, pairs = _reached(edges, most, largest)
    done = sets.select("node", F.explode("far").alias("reached"))
    return done if pairs is None else done.unionByName(pairs)


def _reached(edges: DataFrame, most: int, largest: int) -> tuple[DataFrame, DataFrame | None]:
    """(node, far) of nodes whose set is made in one row, and (node, reached) of the others if there are any."""
    edges = checkpointed(edges.select("node", "reached").distinct())
    ranks, left = _ranked(edges)
    none = F.lit(None).cast(ArrayType(edges.schema["reached"].dataType))
    sets = left.select("node").distinct().withColumn("far", none)
    for rank in reversed(ranks):
        sets = sets.unionByName(checkpointed(_united(rank, sets, largest)))
    done = sets.where("far is not null")
    open_ = sets.where("far is null").select("node")
    if open_.isEmpty():
        return done, None
    own = checkpointed(meet(edges, open_, "node", "left_semi"))
    known = done.select(F.col("node").alias("reached"), "far")
    beyond = meet(own, known, "reached").select("node", F.explode("far").alias("reached"))
    return done, _doubled(own.unionByName(beyond), most)


def _ranked(edges: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Edges by the round in which nothing enters their start any more, and those that are left.

    Each round moves what is left and takes off an eighth of it at least; at less (cycles, long
    chains) it stops, so all rounds together move no more than eight times the edges.
    """
    ranks, n = [], edges.count()
    while n:
        entered = edges.select(F.col("reached").alias("node")).distinct().withColumn("entered", F.lit(True))
        marked = checkpointed(meet(edges, entered, "node", "left"))
        inner = marked.where("entered").select("node", "reached")
        kept = inner.count()
        if (n - kept) * 8 < n:
            break
        ranks.append(marked.where("entered is null").select("node", "reached"))
        edges, n = inner, kept
    return ranks, edges


def _united(rank: DataFrame, sets: DataFrame, largest: int) -> DataFrame:
    """(node, far) of the starts of edges: all ends and what these reach; null if a set isn't known or they are too many."""
    known = sets.select(F.col("node").alias("reached"), "far", F.lit(True).alias("known"))
    met = meet(rank, known, "reached", "left")
    far = F.when(F.col("known").isNull(), F.array().cast(sets.schema["far"].dataType)).otherwise(F.col("far"))
    all_ = Window.partitionBy("node")
    met = met.select("node", F.concat(F.array("reached"), far).alias("far"))
    fits = F.bool_and(F.col("far").isNotNull()).over(all_) & (F.sum(F.size("far")).over(all_) <= largest)
    met = met.select("node", fits.alias("fits"), "far")
    united = F.array_distinct(F.flatten(F.collect_list(F.when(F.col("fits"), F.col("far")))))
    return met.groupBy("node").agg(F.when(F.bool_and("fits"), united).alias("far"))


def _doubled(edges: DataFrame, most: int) -> DataFrame:
    """The closure by pairs.

    A round joins the pairs that were new in the last one with all pairs (so paths double
    while they grow), and only pairs not met before go on; cycles end. Rounds are
    checkpointed.
    """
    found = checkpointed(edges.select("node", "reached").distinct())
    fresh = found
    for _ in range(most):
        ahead = found.select(F.col("node").alias("reached"), F.col("reached").alias("further"))
        longer = meet(fresh, ahead, "reached").select("node", F.col("further").alias("reached"))
        fresh = checkpointed(meet(longer.distinct(), found, ["node", "reached"], "left_anti"))
        if fresh.isEmpty():
            return found
        found = checkpointed(found.unionByName(fresh))
    raise ValueError("paths are longer than 2 ** most")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node of those that a node reaches and is reached by, itself if there is none.

    Nodes that depend on each other are made one first (``_merged``), which is all there is to do for
    cycles of two. Then nodes that no edge enters are taken off in rounds, and what is left goes to
    ``_cycles``.
    """
    merged, of = _merged(checkpointed(_inside(nodes, edges).where("node <> reached")))
    return _components(nodes, [*of, *_cycles(_ranked(merged)[1])])


def _components(nodes: DataFrame, of: list[DataFrame]) -> DataFrame:
    """Nodes with their components, by one renaming (node, component) after the other."""
    out = nodes.select("node").distinct().withColumn("component", F.col("node"))
    for names in of:
        out = _renamed(out, "component", names)
    return out


def _renamed(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """``rows`` with the component of the node in ``column`` in its stead, where ``names`` has one."""
    whole = names.select(F.col("node").alias(column), F.col("component").alias("whole"))
    return meet(rows, whole, column, "left").withColumn(column, F.coalesce("whole", column)).select(*rows.columns)


def _contracted(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct edges between different components."""
    return checkpointed(_renamed(_renamed(edges, "node", names), "reached", names).where("node <> reached").distinct())


def _merged(edges: DataFrame, most: int = 4) -> tuple[DataFrame, list[DataFrame]]:
    """Distinct ``edges`` after nodes that depend on each other were made one, the least of them, and the renamings.

    That can bring others to depend on each other, which a later round makes one; those that ``most``
    rounds leave are on cycles still and are found as such.
    """
    of: list[DataFrame] = []
    for _ in range(most):
        both = edges.groupBy(F.least("node", "reached").alias("low"), F.greatest("node", "reached").alias("high")).agg(F.count("*").alias("n"))
        pairs = checkpointed(both.where("n = 2").select("low", "high"))
        if pairs.isEmpty():
            break
        of.append(_groups(pairs))
        edges = _contracted(edges, of[-1])
    return edges, of


def _groups(pairs: DataFrame) -> DataFrame:
    """(node, component) of every node of ``pairs`` (low, high): the least of those that pairs connect it with.

    A round maps each node to its least smaller neighbour and on to that one's, and keeps the pairs of
    different images. The image of what hangs together does so too, and its least node stays.
    """
    of = checkpointed(pairs.select(F.explode(F.array("low", "high")).alias("node")).distinct().withColumn("component", F.col("node")))
    while not pairs.isEmpty():
        least = checkpointed(pairs.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("component")))
        image = checkpointed(_renamed(least, "component", least))
        of = checkpointed(_renamed(of, "component", image))
        ends = _renamed(_renamed(pairs, "low", image), "high", image).where("low <> high")
        pairs = checkpointed(ends.select(F.least("low", "high").alias("low"), F.greatest("low", "high").alias("high")).distinct())
    return of


def _cycles(open_: DataFrame) -> list[DataFrame]:
    """[(node, component)] of the nodes on cycles of distinct edges; nothing if there are none.

    Nodes that no edge enters or none leaves are taken off in rounds. Of the rest each round settles
    at least one component of every group that hangs together: the greatest node that reaches a node
    is carried forward as its label until nothing changes, and what reaches a label's own node inside
    that label is its component.
    """
    settled = None
    while True:
        open_ = _trimmed(open_)
        if open_.isEmpty():
            break
        label = _spread(open_, open_.select("node").distinct().withColumn("label", F.col("node")))
        same = meet(meet(open_, label, "node"), label.select(F.col("node").alias("reached"), F.col("label").alias("other")), "reached").where("label = other").select("node", "reached", "label")
        found = _reaching(checkpointed(same), label.where("node = label"))
        settled = found if settled is None else checkpointed(settled.unionByName(found))
        gone = found.select("node")
        open_ = checkpointed(meet(meet(open_, gone, "node", "left_anti"), gone.withColumnRenamed("node", "reached"), "reached", "left_anti").select("node", "reached"))
    if settled is None:
        return []
    least = settled.groupBy("label").agg(F.min("node").alias("component"))
    return [checkpointed(meet(settled, least, "label").select("node", "component"))]


def _inside(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct edges between given nodes."""
    ends = nodes.select("node").distinct()
    return meet(meet(edges.select("node", "reached").distinct(), ends, "node", "left_semi"), ends.withColumnRenamed("node", "reached"), "reached", "left_semi").select("node", "reached")


def _trimmed(open_: DataFrame) -> DataFrame:
    """Edges whose start is entered and whose end is left by other edges, in rounds."""
    while True:
        kept = meet(open_, open_.select(F.col("reached").alias("node")).distinct(), "node", "left_semi")
        kept = meet(kept, open_.select(F.col("node").alias("reached")).distinct(), "reached", "left_semi")
        kept = checkpointed(kept.select("node", "reached"))
        if kept.count() == open_.count():
            return kept
        open_ = kept


def _spread(edges: DataFrame, label: DataFrame) -> DataFrame:
    """Each node's greatest label among itself and all that reach it."""
    label = checkpointed(label)
    while True:
        told = meet(edges, label, "node").groupBy(F.col("reached").alias("node")).agg(F.max("label").alias("told"))
        new = meet(label, told, "node", "left").select("node", F.greatest("label", F.coalesce("told", "label")).alias("label"), (F.col("told") > F.col("label")).alias("up"))
        new = checkpointed(new)
        label = new.select("node", "label")
        if new.where("up").isEmpty():
            return label


def _reaching(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, label) of all that reach their label's root by edges inside the label."""
    found = fresh = checkpointed(roots.select("node", "label"))
    while True:
        before = meet(edges, fresh.select(F.col("node").alias("reached"), "label"), ["reached", "label"]).select("node", "label").distinct()
        fresh = checkpointed(meet(before, found, ["node", "label"], "left_anti"))
        if fresh.isEmpty():
            return found
        found = checkpointed(found.unionByName(fresh))


def plan_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with ``component``, ``level`` and ``direct``: dependencies come first, a cycle is one step.

    The level is the longest path of dependencies between components, so every node stands
    behind all it depends on, but for those of its own cycle; these go by ``direct``, the number
    of dependencies. Components that nothing depends on are taken off in rounds (``_ranked``), once
    for finding cycles and levels, and in the opposite order each is one level above what it depends
    on; long chains are left to ``_levels``. No pair of nodes that an edge doesn't have is made.
    Edges to other nodes, and repeated ones, don't count.
    """
    inside = checkpointed(_inside(nodes, edges))
    merged, of = _merged(checkpointed(inside.where("node <> reached")))
    ranks, left = _ranked(merged)
    longer = _cycles(left)
    for names in longer:
        more, left = _ranked(_contracted(left, names))
        ranks = [_renamed(rank, "reached", names) for rank in ranks] + more
    of = checkpointed(_components(nodes, [*of, *longer]))
    known = _levels(left)
    for rank in reversed(ranks):
        below = known.select(F.col("node").alias("reached"), "level")
        met = meet(rank, below, "reached", "left").groupBy("node").agg(F.max(F.coalesce("level", F.lit(0)) + 1).alias("level"))
        known = known.unionByName(checkpointed(met))
    direct = inside.groupBy("node").agg(F.count("*").alias("direct"))
    out = meet(meet(nodes, of, "node", "left"), known.withColumnRenamed("node", "component"), "component", "left")
    return meet(out, direct, "node", "left").fillna(0, ["level", "direct"]).select(*nodes.columns, "component", "level", "direct")


def _levels(edges: DataFrame) -> DataFrame:
    """(node, level) of all ends of edges without cycles: those without an open dependency are taken off, a job a level."""
    waiting = edges
    open_ = edges.select("node").union(edges.select("reached")).distinct()
    known, level = open_.where("false").withColumn("level", F.lit(0)), 0
    while True:
        ready = checkpointed(meet(open_, waiting.select("node").distinct(), "node", "left_anti").withColumn("level", F.lit(level)))
        if ready.isEmpty():
            return known
        known = known.unionByName(ready)
        open_ = checkpointed(meet(open_, ready.select("node"), "node", "left_anti"))
        waiting = checkpointed(meet(waiting, ready.select(F.col("node").alias("reached")), "reached", "left_anti").select("node", "reached"))
        level += 1


def hotspots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node its own score, the scores of all it depends on, and their sum; the hottest first.

    The members of a cycle depend on the same nodes, so only components are followed: pairs are
    of components, and a cycle of any size is one.
    """
    own = nodes.select("node", "score")
    of = checkpointed(components(nodes, edges))
    scored = meet(own, of, "node")
    totals = checkpointed(scored.groupBy("component").agg(F.sum("score").alias("total")))
    # A component's name ends in its total, so that what it is worth goes with it and sums need no pairs.
    named = F.concat_ws(" ", F.col("component").cast("string"), F.coalesce(F.col("total").cast("string"), F.lit("-")))
    start = meet(of, totals, "component").select("node", named.alias("start"))
    end = start.select(F.col("node").alias("reached"), F.col("start").alias("end"))
    between = meet(meet(edges, start, "node"), end, "reached").where("start <> end").select(F.col("start").alias("node"), F.col("end").alias("reached"))
    kind = totals.schema["total"].dataType
    worth = lambda x: F.coalesce(F.substring_index(x, " ", -1).try_cast(kind), F.lit(0).cast(kind))
    sets, pairs = _reached(between, 64, SET)
    far = sets.select("node", F.aggregate("far", F.lit(0).cast(kind), lambda s, x: (s + worth(x)).cast(kind)).alias("beyond"))
    if pairs is not None:
        far = far.unionByName(pairs.groupBy("node").agg(F.sum(worth(F.col("reached"))).cast(kind).alias("beyond")))
    out = meet(meet(scored, totals, "component").withColumn("name", named), far.withColumnRenamed("node", "name"), "name", "left")
    out = out.withColumn("dependency_score", F.col("total") - F.col("score") + F.coalesce("beyond", F.lit(0)))
    out = out.select("node", "score", "dependency_score").withColumn("hotspot", F.col("score") + F.col("dependency_score"))
    return out.orderBy(F.desc("hotspot"), F.desc("score"), "node")


def project_nodes(extensions: DataFrame, groups: DataFrame) -> DataFrame:
    """What a report shows of each extension of a project.

    ``extensions`` has machine_name, label, extension_type, file_path and dependencies; ``groups``
    the matches by path: extension (a path), count and score. An extension has the group of its
    folder, or else the largest of its name's folder. Dependencies on others than the project's
    extensions are left out. Columns: machine_name, label, type, path, dependencies, dependents,
    match_count, score, transitive_dependencies, impact (extension, match_count and score of each,
    the highest score first), dependency_match_count, dependency_score, hotspot_score.

    Lists hold what one extension depends on, or what depends on it, which a row has to show.
    """
    from tidemark.operators.relations import match_group

    of = match_group(extensions, groups).withColumnRenamed("extension", "group_path")
    told = groups.select(F.col("extension").alias("group_path"), F.col("count").alias("match_count"), "score")
    folder = F.when(F.col("file_path").contains("/"), F.regexp_replace("file_path", "/[^/]*$", "")).otherwise(F.col("machine_name"))
    nodes = extensions.join(of, "machine_name", "left").join(told, "group_path", "left").fillna(0, ["match_count", "score"])
    nodes = nodes.select("machine_name", F.coalesce("label", "machine_name").alias("label"), F.col("extension_type").alias("type"), F.coalesce("group_path", folder).alias("path"), F.col("match_count").cast("long"), F.col("score").cast("long"))
    nodes = checkpointed(nodes)
    names = nodes.select(F.col("machine_name").alias("node"))
    edges = checkpointed(_inside(names, extensions.select(F.col("machine_name").alias("node"), F.explode("dependencies").alias("reached"))))
    listed = lambda by, what, name: edges.groupBy(F.col(by).alias("machine_name")).agg(F.array_sort(F.collect_list(what)).alias(name))
    far = closure(edges).where("node <> reached").join(nodes.select(F.col("machine_name").alias("reached"), F.col("match_count").alias("n"), F.col("score").alias("s")), "reached")
    impact = far.groupBy(F.col("node").alias("machine_name")).agg(
        F.array_sort(F.collect_list("reached")).alias("transitive_dependencies"),
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("rank"), F.col("reached").alias("extension"), F.col("n").alias("match_count"), F.col("s").alias("score")))), lambda x: F.struct(x["extension"], x["match_count"], x["score"])).alias("impact"),
        F.sum("n").alias("dependency_match_count"),
        F.sum("s").alias("dependency_score"),
    )
    out = nodes.join(listed("node", "reached", "dependencies"), "machine_name", "left").join(listed("reached", "node", "dependents"), "machine_name", "left").join(impact, "machine_name", "left")
    out = out.fillna(0, ["dependency_match_count", "dependency_score"]).withColumn("hotspot_score", F.col("score") + F.col("dependency_score"))
    none = F.array().cast("array<string>")
    lists = {c: F.coalesce(c, none) for c in ("dependencies", "dependents", "transitive_dependencies")}
    return out.withColumns(lists | {"impact": F.coalesce("impact", F.array().cast("array<struct<extension:string,match_count:bigint,score:bigint>>"))})
