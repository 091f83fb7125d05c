"""Similarity joins of names that look at likely pairs alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.similarity import similarity


def similar_pairs(left: DataFrame, right: DataFrame, block: list[str], over: float) -> DataFrame:
    """(block, left_name, right_name, score) of all distinct names of one block with a similarity over ``over``.

    Both sides have the block's columns and ``name``. The similarity is 1 - distance / longer
    length over bytes, and names below four bytes are alike only if equal (``similarity``).

    No block is compared all against all. A similarity bounds the edits by the longer name's
    length; that name is cut into one piece more than there may be edits, so that one piece
    stands unchanged in the shorter name, at a place that the edits before and behind it bound.
    Names meet by (block, longer length, piece, its text), an equi-join with as many keys as
    there are such places, and only names that share one are measured. Every pair is found:
    each side is the longer one once. Equal names meet by themselves. Null and empty names, and
    null blocks, meet nothing.
    """
    if not 0.5 <= over < 1:
        raise ValueError("pieces need a bound between 0.5 and 1")
    a, b = (df.where("name <> ''").select(*block, F.decode(F.encode("name", "UTF-8"), "ISO-8859-1").alias("bytes"), "name").distinct() for df in (left, right))
    equal = a.join(b.select(*block, "name"), [*block, "name"]).select(*block, F.col("name").alias("left_name"), F.col("name").alias("right_name"), F.lit(1.0).alias("score"))
    longer_right = _met(a, b, block, over, strict=False).select(*block, F.col("short").alias("left_name"), F.col("long").alias("right_name"))
    longer_left = _met(b, a, block, over, strict=True).select(*block, F.col("long").alias("left_name"), F.col("short").alias("right_name"))
    likely = longer_right.unionByName(longer_left).distinct().where("left_name <> right_name")
    scored = likely.withColumn("score", similarity(F.col("left_name"), F.col("right_name"))).where(F.col("score") > over)
    return equal.unionByName(scored)


def _edits(size: Column, over: float) -> Column:
    """The most edits between names of which the longer has ``size`` bytes; a rounding error may add one."""
    return F.floor((1 - over) * size + 1e-9).cast("int")


def _piece(size: Column, edits: Column, k: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of piece ``k`` of edits + 1 pieces; the last ones take what is left over."""
    base, rest = F.floor(size / (edits + 1)).cast("int"), F.pmod(size, edits + 1).cast("int")
    plain = edits + 1 - rest
    return k * base + F.greatest(k - plain, F.lit(0)), base + F.when(k >= plain, 1).otherwise(0)


def _met(shorter: DataFrame, longer: DataFrame, block: list[str], over: float, strict: bool) -> DataFrame:
    """Pairs that share a piece of the longer name; ``strict``: of names that differ in length."""
    size = F.length("bytes")
    edits = _edits(size, over)

    def cut(k: Column) -> Column:
        start, length = _piece(size, edits, k)
        return F.struct(size.alias("size"), k.alias("k"), F.substr("bytes", start + 1, length).alias("piece"))

    pieces = longer.where(size >= 4).select(*block, F.col("name").alias("long"), F.explode(F.transform(F.sequence(F.lit(0), edits), cut)).alias("x"))

    def places(long: Column) -> Column:
        most, less = _edits(long, over), size - long

        def at(k: Column) -> Column:
            start, length = _piece(long, most, k)
            first = F.greatest(start - k, start + less - (most - k), F.lit(0))
            last = F.least(start + k, start + less + (most - k), size - length)
            texts = F.transform(F.sequence(first, last), lambda p: F.struct(long.alias("size"), k.alias("k"), F.substr("bytes", p + 1, length).alias("piece")))
            return F.when(first <= last, texts).otherwise(F.array().cast("array<struct<size:int,k:int,piece:string>>"))

        return F.flatten(F.transform(F.sequence(F.lit(0), most), at))

    lengths = F.sequence(size + (1 if strict else 0), F.greatest(F.floor(size / over + 1e-9).cast("int"), size + (1 if strict else 0)))
    looked = shorter.select(*block, F.col("name").alias("short"), F.explode(F.array_distinct(F.flatten(F.transform(lengths, places)))).alias("x"))
    keys = ["x.size", "x.k", "x.piece"]
    met = looked.select(*block, "short", *keys).join(pieces.select(*block, "long", *keys), [*block, "size", "k", "piece"])
    return met.select(*block, "short", "long").distinct()
