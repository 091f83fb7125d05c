"""op13: importance resampling of documents towards a target corpus.

Features are hashed word n-grams. Texts stay in Arrow: ``ascii_lower``,
``split_pattern_regex``, ``list_flatten`` and ``dictionary_encode`` turn a batch into word
indices; shifted indices form n-grams; a CRC is computed once for each distinct pair of a
shorter n-gram and its next word; gains are taken by bucket and reduced over the segments
of documents. Only bucket counts, and then five numbers a document, leave a task.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import byte_view, staged, steps, table, texts

BUCKETS = 10_000
SIZE = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10

_BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def hashed_features(column: pa.Array, size: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of each feature, and the words of each row; features ordered by n, then row."""
    parts = pc.split_pattern_regex(pc.ascii_lower(column), pattern=_BETWEEN_WORDS)
    words, rows = pc.list_flatten(parts), pc.list_parent_indices(parts)
    real = pc.not_equal(words, "")
    words, row = words.filter(real), rows.filter(real).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    spelled = [x.encode() for x in coded.dictionary.to_pylist()]
    counts = np.bincount(row, minlength=len(column)).astype(np.int64)
    crc = np.array([zlib.crc32(x) for x in spelled], np.int64)
    gram, found = index, [(crc[index] % buckets, row)] if len(index) else []
    for n in range(2, size + 1):
        if len(index) < n:
            break
        pairs, gram = np.unique(gram[: len(index) - n + 1] * len(spelled) + index[n - 1 :], return_inverse=True)
        crc = np.array([zlib.crc32(b" " + spelled[p % len(spelled)], int(crc[p // len(spelled)])) for p in pairs.tolist()], np.int64)
        inside = row[: len(gram)] == row[n - 1 :]
        found.append(((crc[gram] % buckets)[inside], row[: len(gram)][inside]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), counts
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), counts


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for first, last in steps(byte_view(batch.column(1))[1]):
        yield batch.slice(first, last - first)


def bucket_counts(docs: DataFrame, size: int = SIZE, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all features of ``docs``; a task sends at most one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in _slices(batch):
                total += np.bincount(hashed_features(part.column(1), size, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    return texts(docs).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, size: int = SIZE, buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln) of the smoothed target share over the smoothed source share, by bucket.

    The driver holds two vectors of ``buckets`` counts, whatever the corpus.
    """
    sums = []
    for frame in (documents, target):
        row = np.zeros(buckets, np.int64)
        for r in bucket_counts(frame, size, buckets).collect():
            row[r.bucket] = r.n
        sums.append(row.tolist())
    source, wanted = sums
    all_source, all_wanted = float(sum(source) + buckets), float(sum(wanted) + buckets)
    return [math.floor(1000 * math.log((t + 1.0) * all_source / ((s + 1.0) * all_wanted))) for s, t in zip(source, wanted, strict=True)]


def weights(docs: DataFrame, gain: list[int], size: int = SIZE) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document, weight the sum of its features' gains."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket = np.array(gain, np.int64)
        for batch in batches:
            for part in _slices(batch):
                bucket, row, words = hashed_features(part.column(1), size, len(gain))
                order = np.argsort(row, kind="stable")
                sums = np.concatenate([[0], np.cumsum(by_bucket.take(bucket[order]))])
                ends = np.searchsorted(row[order], np.arange(len(part) + 1))
                values = [part.column(0), pa.array(words), pa.array(np.diff(ends)), pa.array(np.diff(sums[ends]))]
                yield pa.RecordBatch.from_arrays(values, ["doc_id", "n_words", "n_features", "weight"])

    return texts(docs).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id, seed: int):
    """A document's own Gumbel noise in thousandths, from a hash of its id alone."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("long")


def ranked(scored: DataFrame, order: list, name: str) -> DataFrame:
    """``scored`` with ``place`` 1, 2, 3, ... in the given order, by ranges of it.

    Ranges are sorted apart; a row's place is its range's offset and its position there. Only
    one count a range meets in one task.
    """
    ranges = scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranges = staged(ranges, name).withColumn("range_no", F.shiftright("at", 33))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy("range_no").count().select("range_no", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    place = F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranges.join(offsets, "range_no").withColumn("place", place).drop("at", "range_no", "offset")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, size: int = SIZE, buckets: int = BUCKETS, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every document with n_features, weight, score, and its rank if it is drawn.

    Drawn are floor(percent * N / 100) documents of highest weight plus Gumbel noise, N those
    with at least ``least`` words: that is sampling without replacement in proportion to
    exp(weight / 1000). Ties go to the smaller doc_id, rows without one last; repeated rows are
    documents of their own. A null or empty text has no feature and weight 0. Empty tables give
    no row; an empty target gives gains of the smoothing alone. Other columns are not read.
    """
    gain = gains(docs, target, size, buckets)
    scored = weights(docs, gain, size).withColumns({"score": F.col("weight") + gumbel(F.col("doc_id"), seed), "enough": F.col("n_words") >= least})
    scored = staged(scored.drop("n_words"), "importance")
    drawn = percent * scored.where("enough").count() // 100
    order = [F.col("enough").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    rank = F.when(F.col("enough") & (F.col("place") <= drawn), F.col("place").cast("long")).alias("rank")
    return ranked(scored, order, "drawn").select("doc_id", "n_features", "weight", "score", rank)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = table(spark, sf_dir, "benchmark").select(F.lit(0).alias("doc_id"), "text")
    return resample(table(spark, sf_dir, "documents"), benchmark)


#: The table of CRC-32 (polynomial 0xEDB88320) from its rule, as a DuckDB list.
CRC_TABLE = "list_transform(range(256), lambda i: list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end))"


def crc_sql(text: str, crc_table: str) -> str:
    """CRC-32 of a string's UTF-8 bytes in DuckDB."""
    digits = f"hex(encode({text}))"
    byte = f"(instr('0123456789ABCDEF', {digits}[2 * k + 1]) * 16 + instr('0123456789ABCDEF', {digits}[2 * k + 2]) - 17)::bigint"
    bytes_ = f"list_transform(range(strlen({text})), lambda k: {byte})"
    return f"xor(list_reduce([4294967295::bigint] || {bytes_}, lambda c, b: xor(c // 256, {crc_table}[(xor(c % 256, b) + 1)::bigint])), 4294967295)"


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP13_SQL = f"""
with crc as (select {CRC_TABLE} as t),
d as (select doc_id, unnest({_WORDS}) as word from documents),
q as (select unnest({_WORDS}) as word from benchmark),
v as (select word, {crc_sql("word", "t")} % 10000 as bucket from (select distinct word from (select word from d union all select word from q)), crc),
s as (select bucket, count(*) as n from d join v using (word) group by 1),
w as (select bucket, count(*) as n from q join v using (word) group by 1),
totals as (select (select coalesce(sum(n), 0) from s)::double as s_all, (select coalesce(sum(n), 0) from w)::double as t_all),
g as (select bucket, floor(1000 * ln((coalesce(w.n, 0)::double + 1) * (s_all + 10000) / ((s.n::double + 1) * (t_all + 10000))))::bigint as gain from s left join w using (bucket), totals),
f as (select doc_id, count(*) as n_features, sum(gain)::bigint as weight from d join v using (word) join g using (bucket) group by 1),
e as (select doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
  (('0x' || sha256('2024:' || doc_id)[1:8])::bigint::double + 0.5) / 4294967296 as share from documents left join f using (doc_id)),
x as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln(share)))::bigint as score from e),
r as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place, (count(*) filter (n_features >= 20) over ()) * 10 // 100 as drawn from x)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= drawn then place end as rank from r
"""
