"""Op2: best-fit packing by a configuration linear program over the length histogram.

The number of sequences is decided on the histogram of piece lengths, which has at most
``capacity`` entries however large the corpus is. A configuration is a multiset of
lengths that fits into one sequence. Multiplicative weights solve the covering program

    minimise sum(x_p)  such that  sum_p a[l, p] x_p >= n[l] for every length l

with one knapsack dynamic program a round as its pricing oracle: it finds the heaviest
configuration that the pieces still there can make, a ``STEPS``-th of the sequences still
to fill take it, and the weight of each length in it is multiplied by exp(-RATE * the
share of its demand that this covers). The amount of each step is rounded down to whole
sequences, to one at least and never beyond the pieces that there are; what rounding
strands is demand of the rounds that follow, so that the program goes on till every piece
is in a sequence. Any weights, divided by the value of their heaviest configuration, are a
solution of the dual program: the best of them bounds from below what any packing needs.

Pieces then get their place from their rank among pieces of the same length, which
per-partition counts and prefix sums give without a sort of the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged, table, texts
from tidemark.llm.tokens import END_ID, encoder

#: One in so many of the sequences still to fill goes to a round's configuration; how sharply
#: covered demand lowers a weight; how much more than its size a long piece weighs at first
#: (full configurations of long pieces go first, short pieces fill what they leave).
STEPS, RATE, BEND = 100, 0.5, 0.5

#: Rounds between two dual bounds.
BOUND_EVERY = 100

Configuration = tuple[int, list[tuple[int, int]]]  # times, [(length, pieces of it)]


def price(weights: np.ndarray, lengths: list[int], counts: list[int], capacity: int) -> tuple[float, dict[int, int]]:
    """Value and pieces (by index of their length) of the heaviest configuration of the pieces there are.

    A bounded knapsack: copies of a length go in as bundles of 1, 2, 4, ... of it, and the
    program runs over the room, a vector at a time.
    """
    bundles = []
    for k, (x, n) in enumerate(zip(lengths, counts, strict=True)):
        n, size = min(n, capacity // x), 1
        while n > 0:
            bundles.append((k, min(size, n)))
            n -= size
            size *= 2
    best, took = np.zeros(capacity + 1), np.zeros((len(bundles), capacity + 1), bool)
    for i, (k, n) in enumerate(bundles):
        room = n * lengths[k]
        with_it, so_far = best[: capacity + 1 - room] + n * weights[k], best[room:]
        np.greater(with_it, so_far, out=took[i, room:])
        np.maximum(with_it, so_far, out=so_far)
    config: dict[int, int] = {}
    room = capacity
    for i in range(len(bundles) - 1, -1, -1):
        if took[i, room]:
            k, n = bundles[i]
            config[k] = config.get(k, 0) + n
            room -= n * lengths[k]
    return float(best[capacity]), config


def solved(histogram: dict[int, int], capacity: int, steps: int = STEPS) -> tuple[list[Configuration], int]:
    """Whole configurations that hold each piece of the histogram just once, and the dual bound."""
    lengths = sorted(x for x, n in histogram.items() if n > 0)
    demand = np.array([histogram[x] for x in lengths], np.int64)
    size, left = np.array(lengths, np.int64), demand.copy()
    weights = size * (1 + BEND * size / capacity)
    bound = int(-(-(size * demand).sum() // capacity))  # the sizes themselves are a dual solution
    times_of: dict[tuple[tuple[int, int], ...], int] = {}
    rounds = 0
    while left.any():
        if rounds % BOUND_EVERY == 0:
            value, _ = price(weights, lengths, demand.tolist(), capacity)
            bound = max(bound, int(np.ceil((weights * demand).sum() / value - 1e-6)))
        rounds += 1
        live = np.flatnonzero(left)
        _, found = price(weights[live], size[live].tolist(), left[live].tolist(), capacity)
        config = {int(live[k]): n for k, n in found.items()}
        amount = float((size * left).sum()) / capacity / steps
        times = min(max(1, int(amount)), *(int(left[k]) // n for k, n in config.items()))
        for k, n in config.items():
            left[k] -= times * n
            weights[k] *= np.exp(-RATE * times * n / demand[k])
        key = tuple(sorted((lengths[k], n) for k, n in config.items()))
        times_of[key] = times_of.get(key, 0) + times
    return [(times, list(config)) for config, times in times_of.items()], bound


def configurations(histogram: dict[int, int], capacity: int, steps: int = STEPS) -> list[Configuration]:
    """Whole configurations that hold each piece of the histogram just once, in few sequences."""
    return solved(histogram, capacity, steps)[0]


def pieces(docs: DataFrame, capacity: int, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """The pieces of every document, each with its rank among its task's pieces of that length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, ranks).ids, END_ID.to_bytes(4, "little")
        chunk, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "place"]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                n = len(ids) // 4
                first = n % capacity or capacity
                for k, start in enumerate([0, *range(first, n, capacity)]):
                    length = first if not k else capacity
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    for to, x in zip(rows, (doc, k, start, length, crc, chunk, seen[length]), strict=True):
                        to.append(x)
                    seen[length] += 1
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names)

    return texts(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, chunk long, place long")


def pack(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, ranks: str | None = None, steps: int = STEPS) -> DataFrame:
    """Place every document's ids, ended by id 2, in sequences of at most ``capacity`` ids.

    A document longer than a sequence is cut into pieces of ``capacity`` ids, the first of
    which may be shorter. Returns doc_id, piece, start, length, ids_crc32, sequence_id
    and offset per piece. A null or empty text is the end id alone; repeated rows and a
    null doc_id are packed like others; an empty table gives no rows.

    To the driver goes the histogram: at most ``capacity`` rows. The plan that tasks
    get back holds the program's configurations, some thousand at most: each round either
    uses a length up or takes a ``steps``-th of what is left.
    """
    cut = staged(pieces(docs, capacity, tokenizer, ranks), "pieces")
    counts = cut.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = staged(counts.select("chunk", "length", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    segments = plan(configurations(histogram, capacity, steps), histogram)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy() for k in (3, 5))
            sequence, offset = placed(segments, length, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = cut.join(counts.select("chunk", "length", "before"), ["chunk", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def plan(made: list[Configuration], histogram: dict[int, int]) -> dict[str, np.ndarray]:
    """Runs of consecutive ranks of a length that share a configuration, as sorted arrays.

    Ranks are shifted by the number of shorter pieces, so one search finds a piece's run.
    """
    shift, total = {}, 0
    for x in sorted(histogram):
        shift[x], total = total, total + histogram[x]
    used, sequence = dict(shift), 0
    rows = []
    for times, config in made:
        offset = 0
        for x, n in config:
            rows.append((used[x], n, sequence, offset))
            used[x] += times * n
            offset += n * x
        sequence += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 4).T
    known = np.array(sorted(shift.items()), np.int64).reshape(-1, 2).T
    return dict(zip(("first", "each", "sequence", "offset"), columns, strict=True)) | {"lengths": known[0], "shift": known[1]}


def placed(segments: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rank = rank + segments["shift"][np.searchsorted(segments["lengths"], length)]
    run = np.searchsorted(segments["first"], rank, "right") - 1
    within = rank - segments["first"][run]
    each = segments["each"][run]
    return segments["sequence"][run] + within // each, segments["offset"][run] + within % each * length


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
