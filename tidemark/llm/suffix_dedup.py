"""Op1: removal of repeated substrings by a distributed merge sort of suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts elsewhere. Sorting
every suffix would move each text hundreds of times over, so suffixes are sampled by
their content: every window of ``LENGTH`` bytes has one anchor, the least hash among its
first ``REACH`` 16-byte grams, and equal windows have the anchor at the same place. Only
suffixes that start at anchors are sorted, and of these only anchors whose next
``LENGTH - REACH + 1`` bytes occur twice at all.

* Each task sorts the suffixes of its anchors in runs of bounded size. Equal suffixes
  with equal left contexts within a run settle each other there and go on as one.
* A run is cut into buckets by the bytes that all of an anchor's windows share, and each
  part travels front-coded: common prefix with the entry before, and the rest.
* A bucket's runs are combined by a loser tree. A node remembers the common prefix of its
  loser with the last winner, so known prefixes are never compared again, and the common
  prefixes come out with the merged order: neighbours that share the bytes of a bucket's
  key are a group. In a group, left and right extension decide which windows repeat.

Key bytes that very many places share, with other bytes around them, would make a group
too large for a task. Windows of such anchors travel one by one as digests through the
same runs and merges; equal digests are equal windows, so there are no groups to hold.

Which windows repeat is judged on the input, so the order of work has no say in it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import byte_view, mix64, powers, prefix_hash, range_hash, staged, steps, table, texts

#: Bytes of a repeated string; grams among which a window's anchor is chosen; bytes of a gram.
LENGTH, REACH, GRAM = 400, 300, 16

#: Bytes of suffixes and left contexts that a task sorts at once.
RUN_BYTES = 48_000_000

#: Occurrences of an anchor's key bytes up to which its suffixes meet in one task. Beyond, its
#: windows go by their own digests, of which a run sends each but once.
HOT = 20_000

#: Marks an entry that stands for one whole window: its string is the window's digest.
WHOLE = 65_535

_PLACE_BITS = 28


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    n = len(x)
    if n < width:
        return x[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, place, least and most distance from its windows' starts, and key hash of each anchor."""
    lengths = np.diff(offsets)
    if not (lengths >= LENGTH).any():
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    prefix = prefix_hash(data)
    grams = (prefix[GRAM:] - prefix[:-GRAM]) * powers(len(prefix), inverse=True)[: len(prefix) - GRAM]
    grams = mix64(grams) >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)
    grams |= np.arange(len(grams), dtype=np.uint64) & np.uint64((1 << _PLACE_BITS) - 1)
    least = sliding_least(grams, REACH)
    starts = np.concatenate([np.arange(a, b - LENGTH + 1) for a, b in zip(offsets, offsets[1:], strict=False) if b - a >= LENGTH])
    chosen = (least[starts] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    chosen += (starts >> _PLACE_BITS) << _PLACE_BITS
    chosen += np.where(chosen < starts, 1 << _PLACE_BITS, 0)
    new = np.ones(len(chosen), bool)
    new[1:] = chosen[1:] != chosen[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(chosen)) - 1
    at = chosen[first]
    row = np.searchsorted(offsets, at, "right") - 1
    return row, at - offsets[row], at - starts[last], at - starts[first], range_hash(prefix, at, at + LENGTH - REACH + 1)


def all_anchors(docs: DataFrame) -> DataFrame:
    """(k1, k2, at, near, far, key): an anchor at ``at`` serves windows that start near to far bytes before."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", "at", "near", "far", "key"]
        for batch in batches:
            data, offsets = byte_view(batch.column(3))
            k1, k2 = (batch.column(k).to_numpy() for k in (0, 1))
            parts = []
            for a, b in steps(offsets, 300_000):
                row, at, near, far, key = anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                parts.append((k1[a + row], k2[a + row], at.astype(np.int32), near.astype(np.int16), far.astype(np.int16), key.view(np.int64)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names)

    return docs.mapInArrow(find, "k1 long, k2 long, at int, near short, far short, key long")


class Suffix(NamedTuple):
    """A suffix from an anchor with its left context; ``k1`` to ``at`` are its place."""

    right: bytes
    left: bytes
    near: int
    settled: bool  # an equal entry exists, so its windows all repeat
    k1: int
    k2: int
    at: int


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    while n - known > 8:
        half = (known + n) // 2
        if a[known:half] == b[known:half]:
            known = half
        else:
            n = half
    while a[known] == b[known]:
        known += 1
    return known


def front_coded(run: list[Suffix]) -> bytes:
    """A sorted run as bytes: per entry the prefix it shares with the one before, and the rest."""
    n, before = len(run), b""
    shared = np.empty(n, np.uint16)
    rest = []
    for k, x in enumerate(run):
        shared[k] = h = common(before, x.right)
        rest.append(x.right[h:])
        before = x.right
    columns = [
        np.array([n], np.int64),
        shared,
        np.array([len(x) for x in rest], np.uint16),
        np.array([len(x.left) for x in run], np.uint16),
        np.array([x.near for x in run], np.uint16),
        np.array([x.settled for x in run], np.uint8),
        np.array([(x.k1, x.k2, x.at) for x in run], np.int64).reshape(-1, 3),
    ]
    return zstandard.compress(b"".join([*(c.tobytes() for c in columns), *rest, *(x.left for x in run)]), 3)


def decoded(block: bytes) -> Iterator[tuple[int, Suffix]]:
    """(prefix shared with the entry before, entry) of a front-coded run, in order."""
    raw = zstandard.decompress(block)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    place, columns = 8, []
    for kind, width in ((np.uint16, 1), (np.uint16, 1), (np.uint16, 1), (np.uint16, 1), (np.uint8, 1), (np.int64, 3)):
        columns.append(np.frombuffer(raw, kind, n * width, place).tolist())
        place += n * width * np.dtype(kind).itemsize
    shared, rests, lefts, near, settled, places = columns
    left_at, right = place + sum(rests), b""
    for k in range(n):
        right = right[: shared[k]] + raw[place : place + rests[k]]
        yield shared[k], Suffix(right, raw[left_at : left_at + lefts[k]], near[k], bool(settled[k]), *places[3 * k : 3 * k + 3])
        place += rests[k]
        left_at += lefts[k]


def merged(runs: list[Iterator[tuple[int, Suffix]]]) -> Iterator[tuple[int, Suffix]]:
    """(prefix shared with the entry before, entry) in the order of all runs together.

    A loser tree over the runs' heads. ``known[r]`` is the common prefix of run r's head
    with the last entry given out: of two heads the one that shares more comes first,
    and only heads that share equally much are compared, from there on.
    """
    width = 1
    while width < len(runs):
        width *= 2
    heads: list[Suffix | None] = [None] * width
    known = [0] * width
    for r, run in enumerate(runs):
        got = next(run, None)
        heads[r] = got[1] if got else None

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's common prefix becomes that with the winner."""
        if heads[a] is None:
            return b, a
        if heads[b] is None:
            return a, b
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = heads[a].right, heads[b].right
        h = common(x, y, known[a])
        first = h == len(x) or (h < len(y) and x[h] < y[h])
        win, lose = (a, b) if first else (b, a)
        known[lose] = h
        return win, lose

    losers = [0] * width
    level = list(range(width))
    node = width
    while len(level) > 1:
        node //= 2
        nextlevel = []
        for k in range(0, len(level), 2):
            win, lose = play(level[k], level[k + 1])
            losers[node + k // 2] = lose
            nextlevel.append(win)
        level = nextlevel
    win = level[0]
    while heads[win] is not None:
        yield known[win], heads[win]
        got = next(runs[win], None)
        known[win], heads[win] = got or (0, None)
        node = (win + width) // 2
        while node:
            win, losers[node] = play(win, losers[node])
            node //= 2


Interval = tuple[int, int, int, int]  # k1, k2, first byte, byte after the last


def repeats(group: list[Suffix]) -> Iterator[Interval]:
    """What the repeated windows cover around each anchor of a group with the same key bytes."""
    same: dict[tuple[bytes, bytes, int], list[Suffix]] = defaultdict(list)
    for x in group:
        same[x.right, x.left, x.near].append(x)
    alone = []
    for entries in same.values():
        if len(entries) > 1 or entries[0].settled:
            for x in entries:
                if not x.settled:
                    yield x.k1, x.k2, x.at - len(x.left), x.at + len(x.right)
        else:
            alone.append(entries[0])
    if not alone or len(same) < 2:
        return
    others = [entries[0] for entries in same.values()]
    found = _by_extension(alone, others) if len(alone) * len(others) <= 64 else _by_windows(others)
    for x, least, most in found:
        if not x.settled and len(same[x.right, x.left, x.near]) == 1:
            yield x.k1, x.k2, x.at - most, x.at - least + LENGTH


def _by_extension(alone: list[Suffix], others: list[Suffix]) -> Iterator[tuple[Suffix, int, int]]:
    """Least and most distance of a repeated window, from pairwise left and right extensions."""
    backward = {id(x): x.left[::-1] for x in others}
    for x in alone:
        least, most = LENGTH, -1
        for y in others:
            if y is not x:
                low = max(LENGTH - common(x.right, y.right), x.near, y.near)
                high = min(common(backward[id(x)], backward[id(y)]), len(x.left), len(y.left))
                if low <= high:
                    least, most = min(least, low), max(most, high)
        if most >= 0:
            yield x, least, most


def _by_windows(others: list[Suffix]) -> Iterator[tuple[Suffix, int, int]]:
    """The same from rolling window hashes, a distance at a time: memory of the texts alone."""
    n = len(others)
    text = np.zeros((n, REACH + LENGTH), np.uint8)
    for k, x in enumerate(others):
        both = x.left + x.right
        text[k, REACH - len(x.left) : REACH + len(x.right)] = np.frombuffer(both, np.uint8)
    near, far = np.array([x.near for x in others]), np.array([len(x.left) for x in others])
    codes, scale = mix64(np.arange(1, 257, dtype=np.uint64)), powers(REACH + LENGTH)
    text = np.ascontiguousarray(text.T)
    window = np.zeros(n, np.uint64)
    for c in range(LENGTH):
        window += codes[text[c]] * scale[c]
    least, most = np.full(n, LENGTH), np.full(n, -1)
    for distance in range(REACH, -1, -1):  # the window starts so far before the anchor
        begin = REACH - distance
        valid = np.flatnonzero((near <= distance) & (distance <= far))
        if len(valid) > 1:
            values = window[valid]
            order = np.argsort(values, kind="stable")
            ranked = values[order]
            equal = np.zeros(len(order), bool)
            equal[1:] = ranked[1:] == ranked[:-1]
            equal[:-1] |= equal[1:]
            hit = valid[order[equal]]
            most[hit] = np.maximum(most[hit], distance)
            least[hit] = distance
        if distance:
            window += codes[text[begin + LENGTH]] * scale[begin + LENGTH] - codes[text[begin]] * scale[begin]
    for k in np.flatnonzero(most >= 0):
        yield others[k], int(least[k]), int(most[k])


def _settled_run(run: list[Suffix]) -> tuple[list[Suffix], list[Interval]]:
    """The run sorted with equal entries as one, and what those cover."""
    run.sort()
    out, intervals, k = [], [], 0
    while k < len(run):
        x, m = run[k], k + 1
        while m < len(run) and run[m].right == x.right and run[m].left == x.left and run[m].near == x.near:
            m += 1
        if m - k > 1:
            intervals += [(y.k1, y.k2, y.at - len(y.left), y.at + len(y.right)) for y in run[k:m]]
            x = x._replace(settled=True, k1=0, k2=0, at=0)
        out.append(x)
        k = m
    return out, intervals


def _settled_windows(run: list[Suffix]) -> tuple[list[Suffix], list[Interval]]:
    """The windows of a run's hot anchors as entries, one a window, and what those cover that occur twice."""
    out, intervals = _settled_run(run)
    seen: dict[bytes, Suffix | None] = {}
    for x in out:
        both, far = x.left + x.right, len(x.left)
        for distance in range(x.near, far + 1):
            begin = far - distance
            digest = hashlib.blake2b(both[begin : begin + LENGTH], digest_size=16).digest()
            entry = Suffix(digest, b"", WHOLE, x.settled, x.k1, x.k2, x.at - distance)
            before = seen.get(digest)
            if before is None:
                seen[digest] = entry
                continue
            for y in (before, entry):
                if not y.settled:
                    intervals.append((y.k1, y.k2, y.at, y.at + LENGTH))
            seen[digest] = before._replace(settled=True, k1=0, k2=0, at=0)
    return sorted(seen.values()), intervals


_BLOCKS = "bucket int, block binary, k1 long, k2 long, low int, high int"


def _rows(blocks: list[tuple[int, bytes]], intervals: list[Interval], buckets: int) -> pa.RecordBatch:
    """Blocks with their buckets, and united settled intervals dealt over all buckets, as one batch."""
    intervals = by_text(intervals)
    n, m = len(blocks), len(intervals)
    columns = list(zip(*intervals, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays(
        [
            pa.array([*(b for b, _ in blocks), *(k % buckets for k in range(m))], pa.int32()),
            pa.array([*(x for _, x in blocks), *[None] * m], pa.binary()),
            *(pa.array([*[None] * n, *c], t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)),
        ],
        ["bucket", "block", "k1", "k2", "low", "high"],
    )


def by_text(intervals: list[Interval]) -> list[Interval]:
    """The same bytes of each text in as few intervals as can be."""
    out: list[Interval] = []
    for k1, k2, low, high in sorted(intervals):
        if out and out[-1][:2] == (k1, k2) and low <= out[-1][3]:
            out[-1] = (k1, k2, out[-1][2], max(high, out[-1][3]))
        else:
            out.append((k1, k2, low, high))
    return out


def sorted_runs(whole: DataFrame, buckets: int) -> DataFrame:
    """Front-coded sorted runs by bucket, and the intervals that runs have settled themselves."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[list[Suffix]] = [[] for _ in range(buckets)]
        wide: list[Suffix] = []
        size = 0

        def flush() -> pa.RecordBatch:
            blocks, intervals = [], []
            for bucket, part in enumerate(run):
                if part:
                    out, more = _settled_run(part)
                    blocks.append((bucket, front_coded(out)))
                    intervals += more
                    run[bucket] = []
            if wide:
                out, more = _settled_windows(wide)
                intervals += more
                wide.clear()
                dealt: list[list[Suffix]] = [[] for _ in range(buckets)]
                for x in out:
                    dealt[int.from_bytes(x.right[:4], "little") % buckets].append(x)
                blocks += [(bucket, front_coded(part)) for bucket, part in enumerate(dealt) if part]
            return _rows(blocks, intervals, buckets)

        for batch in batches:
            for k1, k2, text, places in zip(*(batch.column(k).to_pylist() for k in (0, 1)), batch.column(2), batch.column(3), strict=True):
                data = text.as_buffer().to_pybytes()
                for at, near, far, hot in zip(*(x.to_pylist() for x in places.values.flatten()), strict=True):
                    right = data[at : at - near + LENGTH]
                    key = zlib.crc32(right[: LENGTH - REACH + 1])
                    x = Suffix(right, data[at - far : at], near, False, k1, k2, at)
                    (wide if hot else run[key % buckets]).append(x)
                    size += len(right) + far + 200 * (1 + hot * (far - near))
                if size >= RUN_BYTES:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    return whole.mapInArrow(make, _BLOCKS)


def merged_runs(blocks: DataFrame) -> DataFrame:
    """(k1, k2, low, high) of all intervals: those settled before, and those of merged buckets."""

    def intervals(parts: list[bytes]) -> Iterator[Interval]:
        group: list[Suffix] = []
        window: Suffix | None = None
        for shared, x in merged([decoded(p) for p in parts]):
            if x.near == WHOLE:
                if window is not None and window.right == x.right:
                    for y in (window, x):
                        if not y.settled:
                            yield y.k1, y.k2, y.at, y.at + LENGTH
                    window = x._replace(settled=True)
                else:
                    window = x
                continue
            if shared < LENGTH - REACH + 1 and group:
                if len(group) > 1:
                    yield from repeats(group)
                group = []
            group.append(x)
        if len(group) > 1:
            yield from repeats(group)

    def batch(found: list[Interval]) -> pa.RecordBatch:
        kinds, found = (pa.int64(), pa.int64(), pa.int32(), pa.int32()), by_text(found)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(kinds)], ["k1", "k2", "low", "high"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[bytes]] = defaultdict(list)
        for x in batches:
            blocks = x.column(1)
            for bucket, block in zip(x.column(0).to_pylist(), blocks.to_pylist(), strict=True):
                if block is not None:
                    parts[bucket].append(block)
            yield x.filter(blocks.is_null()).select(["k1", "k2", "low", "high"])
        for bucket in sorted(parts):
            found: list[Interval] = []
            for interval in intervals(parts.pop(bucket)):
                found.append(interval)
                if len(found) >= 50_000:
                    yield batch(found)
                    found = []
            yield batch(found)

    return blocks.mapInArrow(merge, "k1 long, k2 long, low int, high int")


def united(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that the spans cover."""
    return [x[2:] for x in by_text([(0, 0, x["low"], x["high"]) for x in spans])]


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (array of start and end) per row.

    Every text is taken whole as UTF-8 bytes (null: empty); texts below ``LENGTH`` bytes
    keep all. Repeated rows repeat each other's bytes; a null doc_id is a row like others;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    keyed = texts(docs).select(F.coalesce("doc_id", F.lit(-(2**63))).alias("k1"), F.xxhash64("text").alias("k2"), "doc_id", "text")
    found = staged(all_anchors(keyed), "anchors")
    # Staged, so that the join reads two plain shuffles, of which Spark splits a hot key's part.
    twice = staged(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", (F.col("n") > hot).alias("hot")), "keys-twice")
    places = found.join(twice, "key").groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "near", "far", "hot")).alias("places"))
    whole = keyed.join(places, ["k1", "k2"]).select("k1", "k2", "text", "places")
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cover = merged_runs(sorted_runs(whole, buckets).repartition("bucket"))
    spans = cover.groupBy("k1", "k2").agg(F.collect_list(F.struct("low", "high")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc, text, pairs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = text.as_buffer().to_pybytes()
                runs = united(pairs.as_py() or [])
                digest, at = hashlib.sha256(), 0
                for a, b in runs:
                    digest.update(data[at:a])
                    at = b
                digest.update(data[at:])
                values = (doc, len(data), sum(b - a for a, b in runs), len(runs), digest.hexdigest(), [{"start": a, "end": b} for a, b in runs])
                for to, x in zip(rows, values, strict=True):
                    to.append(x)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names)

    together = keyed.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return together.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("removed")


OP1_SQL = r"""
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
l as (select r, doc_id, h, (length(h) // 2)::bigint as n from d),
b as (select r, n, k, substring(h, 2000 * k + 1, 2800) as part from (select r, n, h, unnest(range(0, (n + 999) // 1000)) as k from l where n >= 400)),
w as (select r, 1000 * k + i as pos, hash(substring(part, 2 * i + 1, 800)) as a from (select r, k, part, unnest(range(0, least(1000, n - 399 - 1000 * k))) as i from b)),
t as (select a from w group by a having count(*) > 1),
g as (select r, pos from w semi join t using (a)),
s as (select r, pos, coalesce(pos > lag(pos) over (partition by r order by pos) + 400, true) as new from g),
i as (select r, pos, sum(new::int) over (partition by r order by pos) as span from s),
u as (select r, span, min(pos) as low, max(pos) + 400 as high from i group by 1, 2),
k as (select r, low, high, coalesce(lag(high) over (partition by r order by low), 0) as before from u),
x as (select r, sum(high - low)::bigint as n_removed, count(*)::bigint as n_spans, max(high) as last,
    string_agg(substring(h, 2 * before + 1, 2 * (low - before)), '' order by low) as head from k join l using (r) group by r)
select doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(case when x.r is null then h else head || substring(h, 2 * last + 1) end)) as kept_sha256
from l left join x using (r)
"""
