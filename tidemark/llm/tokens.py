"""Token ids of texts, and op6: the exact histogram of encoded lengths.

``Encoder`` gives the ids of the byte-level BPE vocabulary that the ``tokenizers`` file
describes. Byte-level BPE never merges across the pieces of its splitting pattern, so a
text's ids are those of its pieces in turn. Texts of plain characters are split by the
pattern and looked up piece by piece (``tiktoken`` merges a piece not seen before, from
the same vocabulary); every other text, where Unicode versions or added tokens could
matter, goes to ``tokenizers`` itself. Tests hold both ways against each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import table, texts

END_ID = 2
#: Pieces that a worker remembers; beyond, a piece is merged each time it is met.
REMEMBERED = 150_000

# Latin letters up to U+024F, whose classes no Unicode version has changed.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_PIECES = re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
_UNUSUAL = re.compile(rf"[^\t\n\r !-~{_LETTERS}]|<\|")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, tokenizer: str | None = None, ranks: str | None = None):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            merge_ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.merge = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merge_ranks, special_tokens={})._core_bpe.encode_single_piece
        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        got = self.known.get(piece)
        if got is None:
            got = pack_ids(self.merge(piece.encode()))
            if len(self.known) < REMEMBERED and len(piece) < 64:
                self.known[piece] = got
        return got

    def ids(self, text: str) -> bytes:
        if _UNUSUAL.search(text):
            return pack_ids(self.library.encode(text, add_special_tokens=False).ids)
        pieces = _PIECES.findall(text)
        try:
            return b"".join([self.known[x] for x in pieces])
        except KeyError:
            return b"".join([self._piece(x) for x in pieces])


def pack_ids(ids: list[int]) -> bytes:
    import struct

    return struct.pack(f"<{len(ids)}I", *ids)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(tokenizer: str | None = None, ranks: str | None = None) -> Encoder:
    """One encoder a worker process; its remembered pieces serve all its tasks."""
    key = (tokenizer, ranks)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def encoded_lengths(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """(doc_id, n_ids) of every document; a null text is empty and has no ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks).ids
        for batch in batches:
            lengths = [len(encode(x.as_py())) // 4 for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64())], ["doc_id", "n_ids"])

    return texts(docs).mapInArrow(count, "doc_id long, n_ids long")


#: Lengths that share a block of the two-level suffix sums.
BLOCK = 64


def length_histogram(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per encoded length, with sums that answer questions about every context limit.

    Columns: ``length``; ``n_docs`` of just that length and their ``n_tokens``;
    ``docs_longer`` and ``tokens_longer`` of longer documents; ``docs_up_to`` and
    ``tokens_up_to``; ``truncated_tokens``, the corpus's tokens if each document is cut
    at ``length``; ``quantile``, the share of documents of at most ``length``.
    For a limit between two rows use ``truncated_total``.

    Only the histogram is shuffled (documents are pre-aggregated where they are read).
    Suffix sums take two levels, sums of blocks of lengths and sums within a block, so
    that no window holds more than a block. Null texts count as empty (length 0), repeated
    rows count each, an empty table has no rows.
    """
    histogram = encoded_lengths(docs, tokenizer, ranks).groupBy(F.col("n_ids").alias("length")).agg(F.count("*").alias("n_docs"))
    histogram = histogram.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / BLOCK))
    return suffix_sums(histogram)


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """From (length, n_docs, n_tokens, block) rows to the columns of ``length_histogram``."""
    from tidemark.llm.common import staged

    histogram = staged(histogram, "lengths")
    blocks = histogram.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in "dt"),
        *(F.sum(c).over(everything).alias(f"{c}_all") for c in "dt"),
    )
    within = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    longer = [(F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"{c[2]}_after")).alias(n) for c, n in (("n_docs", "docs_longer"), ("n_tokens", "tokens_longer"))]
    rows = histogram.join(blocks, "block").select("length", "n_docs", "n_tokens", *longer, "d_all", "t_all")
    return rows.select(
        "length",
        "n_docs",
        "n_tokens",
        "docs_longer",
        "tokens_longer",
        (F.col("d_all") - F.col("docs_longer")).alias("docs_up_to"),
        (F.col("t_all") - F.col("tokens_longer")).alias("tokens_up_to"),
        (F.col("t_all") - F.col("tokens_longer") + F.col("length") * F.col("docs_longer")).alias("truncated_tokens"),
        ((F.col("d_all") - F.col("docs_longer")) / F.col("d_all")).alias("quantile"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """Tokens of the corpus when every document is cut at ``limit`` ids, for any limit."""
    row = histogram.agg(F.sum(F.least(F.col("length"), F.lit(limit)) * F.col("n_docs")).alias("n")).first()
    return row.n or 0


def length_quantile(histogram: DataFrame, share: float) -> int | None:
    """The least encoded length that at least ``share`` of the documents don't exceed."""
    return histogram.where(F.col("quantile") >= share).agg(F.min("length").alias("length")).first().length


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(table(spark, sf_dir, "documents"))
