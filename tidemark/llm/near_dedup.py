"""Op5: near-duplicate groups by min-max hashing, with links confirmed on full shingle sets.

Each permutation of the shingle hashes gives two signature values, its minimum and its
maximum, so ``BANDS * BAND_ROWS`` values take half as many hash evaluations. Texts with
the same shingle set are one class and only its least doc_id goes on. Classes that share
a band fall into one bucket, and buckets that share a class into one candidate group.
Within a group all links are found and confirmed on full sets, block against block: blocks
follow the sizes of sets, and two blocks meet only if their members share a bucket and if
their sizes allow a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import byte_view, mix64, shingle_hashes, staged, steps, table, texts
from tidemark.llm.graph import components

#: Two sets of similarity 0.85 share no band with a probability of 2e-7; sets below 0.4 seldom share one.
BANDS, BAND_ROWS = 26, 5


def sets_of(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per step of rows: first row, last row, sorted distinct shingle hashes, and their rows."""
    data, offsets = byte_view(column)
    for a, b in steps(offsets):
        hashes, rows, _ = shingle_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
        ends = np.cumsum(np.bincount(rows, minlength=b - a))
        for s, e in zip(ends - np.diff(ends, prepend=0), ends, strict=True):
            hashes[s:e].sort()
        keep = np.ones(len(hashes), bool)
        keep[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
        yield a, b, hashes[keep], rows[keep]


def band_keys(hashes: np.ndarray, starts: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """bands x len(starts) keys: the first half from minima, the second from maxima."""
    half = bands // 2
    multipliers = mix64(np.arange(101, 101 + half * rows, dtype=np.uint64)) | np.uint64(1)
    keys = np.empty((2 * half, len(starts)), np.uint64)
    keys[:] = mix64(np.arange(7, 7 + 2 * half, dtype=np.uint64))[:, None]
    permuted = np.empty_like(hashes)
    for k, by in enumerate(multipliers):
        np.multiply(hashes, by, out=permuted)
        for at, reduce in ((k // rows, np.minimum), (half + k // rows, np.maximum)):
            keys[at] = mix64(keys[at] * np.uint64(0x9E3779B97F4A7C15) + reduce.reduceat(permuted, starts))
    return keys


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, bands): set size, a 128-bit mark of the set, band keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, hashes, rows in sets_of(batch.column(1), size):
                counts = np.bincount(rows, minlength=b - a)
                some = np.flatnonzero(counts)
                marks = np.zeros((2, b - a), np.uint64)
                lists = [None] * (b - a)
                if len(some):
                    starts = (np.cumsum(counts) - counts)[some]
                    marks[0, some] = np.add.reduceat(mix64(hashes), starts)
                    marks[1, some] = np.bitwise_xor.reduceat(mix64(hashes + np.uint64(0x51)), starts)
                    for r, key in zip(some, band_keys(hashes, starts).T.view(np.int64), strict=True):
                        lists[r] = key
                columns = [batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), *(pa.array(m.view(np.int64)) for m in marks), pa.array(lists, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "f1", "f2", "bands"])

    return texts(docs).mapInArrow(sign, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>")


def linked_in_groups(members: DataFrame, size: int, percent: int) -> DataFrame:
    """Edges (a, b) that join what is linked in every pair of blocks of (root, i, j, own, id, text).

    ``own`` is the member's own block, i or j. Where i = j every two sets meet, else those
    of i meet those of j alone. Full sets are met by products of their set-by-shingle
    matrix, in column chunks of bounded size; links go out as a spanning forest, so a pair
    of blocks gives fewer rows than it has members.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, held, sides = None, [], [], []
        out: list[tuple[int, int]] = []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            owns, names = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for a, b, hashes, rows in sets_of(batch.column(5), size):
                ends = np.cumsum(np.bincount(rows, minlength=b - a))
                for r, s, e in zip(range(a, b), [0, *ends[:-1]], ends, strict=True):
                    if keys[r] != block:
                        out += forest(ids, held, percent, sides)
                        block, ids, held, sides = keys[r], [], [], []
                    ids.append(names[r])
                    sides.append(owns[r] == keys[r][1])
                    held.append(hashes[s:e].copy())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])
            out = []
        out += forest(ids, held, percent, sides)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    ordered = members.select("root", "i", "j", "own", "id", "text").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return ordered.mapInArrow(link, "a long, b long")


def forest(ids: list[int], held: list[np.ndarray], percent: int, sides: list[bool] | None = None, cells: int = 2_000_000) -> list[tuple[int, int]]:
    """Edges of a spanning forest of all links among the sets, or of those between the two sides."""
    n = len(ids)
    if n < 2:
        return []
    left = np.arange(n) if sides is None or all(sides) else np.flatnonzero(sides)
    right = left if len(left) == n else np.flatnonzero(~np.array(sides))
    if not len(left) or not len(right):
        return []
    counts = np.array([len(x) for x in held])
    every, row = np.concatenate(held), np.repeat(np.arange(n), counts)
    _, column, times = np.unique(every, return_inverse=True, return_counts=True)
    common = times > 1
    rank = np.cumsum(common) - 1
    shared = common[column]
    row, column = row[shared], rank[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    width = max(1, cells // n)
    for first in range(0, int(common.sum()), width):
        lo, hi = np.searchsorted(column, [first, first + width])
        part = np.zeros((n, width), np.float32)
        part[row[lo:hi], column[lo:hi] - first] = 1
        both += part[left] @ part[right].T
    both = both.astype(np.int64)
    union = counts[left][:, None] + counts[right][None, :] - both
    linked = (both > 0) & (100 * both >= percent * union)
    a, b = np.nonzero(np.triu(linked, 1) if left is right else linked)
    parent = list(range(n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    edges = []
    for x, y in zip(left[a].tolist(), right[b].tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            parent[q] = p
            edges.append((ids[x], ids[y]))
    return edges


#: Members and shingles of one block of a candidate group.
BLOCK_MEMBERS, BLOCK_SHINGLES = 256, 250_000


def blocks(members: DataFrame) -> DataFrame:
    """(root, id, n_shingles) with ``block``: a group's members by set size, in runs of bounded size.

    Members are counted by group and size; a running sum over a group's sizes, which are
    far fewer than its members, tells where each size starts; those of one size are dealt
    by hash over the blocks that their count needs.
    """
    by_size = members.groupBy("root", "n_shingles").agg(F.count("*").alias("n"))
    share = F.greatest(F.col("n") / BLOCK_MEMBERS, F.col("n") * F.col("n_shingles") / BLOCK_SHINGLES)
    so_far = Window.partitionBy("root").orderBy("n_shingles").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_size = by_size.withColumn("share", share).withColumn("end", F.sum("share").over(so_far))
    start = F.floor(F.col("end") - F.col("share") + 1e-9)
    by_size = by_size.select("root", "n_shingles", start.cast("int").alias("first"), F.greatest(F.lit(1), F.ceil(F.col("end") - 1e-9).cast("int") - start.cast("int")).alias("over"))
    dealt = F.col("first") + F.pmod(F.xxhash64("id"), F.col("over")).cast("int")
    return members.join(by_size, ["root", "n_shingles"]).select("root", "id", "n_shingles", dealt.alias("block"))


def block_pairs(placed: DataFrame, banded: DataFrame, percent: int) -> DataFrame:
    """(root, own, i, j): for each block the pairs i <= j of blocks that it has to meet in.

    A pair of blocks counts if some bucket has members in both, and if the largest set of
    one and the smallest of the other could be linked. Only groups of several blocks look
    at buckets: a bucket gives its distinct blocks, not its members.
    """
    ranges = placed.groupBy("root", "block").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    alone = ranges.select("root", F.col("block").alias("i"), F.col("block").alias("j"))
    wide = ranges.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    met = placed.join(wide, "root", "left_semi").select("root", "id", "block").join(banded.select("id", "key"), "id")
    met = met.groupBy("root", "key").agg(F.sort_array(F.collect_set("block")).alias("blocks")).where("size(blocks) > 1").select("root", "blocks").distinct()
    met = met.select("root", "blocks", F.explode("blocks").alias("i")).select("root", "i", F.explode(F.filter("blocks", lambda b: b > F.col("i"))).alias("j")).distinct()
    lower = ranges.select("root", F.col("block").alias("i"), F.col("least").alias("i_least"), F.col("most").alias("i_most"))
    upper = ranges.select("root", F.col("block").alias("j"), F.col("least").alias("j_least"), F.col("most").alias("j_most"))
    near = (100 * F.col("i_most") >= percent * F.col("j_least")) & (100 * F.col("j_most") >= percent * F.col("i_least"))
    pairs = alone.unionByName(met.join(lower, ["root", "i"]).join(upper, ["root", "j"]).where(near).select("root", "i", "j"))
    return pairs.select("root", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("own"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Words are runs without white space, A-Z lower-cased; a set holds the distinct
    ``size``-word shingles, or the whole of a shorter text. Documents link where
    100 * intersection >= percent * union; a component's document of least id is kept.
    Null and wordless texts link with nothing. Rows of one doc_id count as one document;
    a row without doc_id has no component and is kept. An empty table gives no rows.

    Shuffled are signatures, band keys of classes, and the texts of classes that share a
    bucket. Buckets that overlap form a candidate group; its members are dealt into blocks
    of bounded size, and two blocks that may hold a link meet in a task of their own, so
    no task holds a group and no pair of documents is a row.
    """
    signed = staged(signatures(docs, size), "signatures")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    mark = ["n_shingles", "f1", "f2"]
    classes = staged(some.groupBy(*mark).agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")), "classes")
    banded = staged(classes.select("id", "n_shingles", F.explode("bands").alias("key")), "bands")
    shared = banded.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("members")).where("members > 1").select("key", "hub")
    stars = banded.join(shared, "key").where(F.col("hub") != F.col("id")).select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    groups = components(stars).select(F.col("node").alias("id"), F.col("component").alias("root"))
    placed = staged(blocks(groups.join(classes.select("id", "n_shingles"), "id")), "blocks")
    meetings = block_pairs(placed, banded, percent)
    members = placed.select("root", "id", F.col("block").alias("own")).join(meetings, ["root", "own"])
    members = texts(docs).join(members.withColumnRenamed("id", "doc_id"), "doc_id").withColumnRenamed("doc_id", "id")
    group = components(linked_in_groups(members, size, percent))

    grouped = classes.join(group.withColumnRenamed("node", "id"), "id", "left").select(*mark, F.coalesce("component", "id").alias("component_id"))
    found = signed.select("doc_id", *mark).join(grouped, mark, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


OP5_SQL = r"""
with recursive d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
w as (select doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d),
s as (select doc_id, case when len(ws) >= 3 then list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as sh from w),
n as (select doc_id, len(sh)::bigint as n_shingles from s),
e as (select doc_id, unnest(sh) as g from s),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n_shingles + b.n_shingles - c)),
r as (select x as a, y as b from l union all select y, x from l),
c as (select a as node, b as reached from r union select c.node, r.b from c join r on r.a = c.reached),
m as (select node, min(reached) as least from c group by 1)
select n.doc_id, n_shingles, least(n.doc_id, coalesce(least, n.doc_id)) as component_id, n.doc_id = least(n.doc_id, coalesce(least, n.doc_id)) as kept
from n left join m on m.node = n.doc_id
"""
