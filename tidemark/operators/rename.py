"""Renames: blocked similarity joins and a one-to-one assignment."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from heapq import heappop, heapreplace

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.similarity import similarity, text_similarity
from tidemark.operators.lineage import blocked, checkpointed, meet

#: Score from which a pair counts as a rename.
ACCEPT = 0.70

#: Tasks that one signature's names are dealt over.
SALTS = 16


def candidates(gone: DataFrame, fresh: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Scored pairs of removed and added symbols of one language and type that can be renames.

    The score is 0.5 for equal signatures, 0.3 of the name similarity, and for likely pairs
    0.1 for the same namespace and 0.1 of the source similarity; at most 1, and 0 if
    nothing was renamed. From 0.7 on it therefore needs an equal signature (that is not
    empty) and, at the least, names that are half alike: pairs without are never looked
    at, and none that reaches ``accept`` (0.65 or more) is lost.

    Distinct names of a signature meet first, by lengths that allow such a similarity, dealt
    over ``SALTS`` tasks if a signature is common. Symbols of equal name, namespace and source
    are one variant: each pair of variants is scored once, and symbols meet by the variants
    that agree.
    """
    variants, agreed = _agreed(gone, fresh, accept)
    block, keep = BLOCK, KEEP
    asking = meet(variants["old"], agreed, [*block, "old_variant"]).drop("old_variant")
    pairs = blocked(asking, variants["new"], [*block, "new_variant"], "old_id", "new_id").drop("new_variant").where("old_fqn is null or new_fqn is null or old_fqn <> new_fqn")
    sides = [F.col(c).alias(f"{side}_{c}") for side in ("old", "new") for c in block]
    return pairs.select(*sides, *(f"{side}_{c}" for side in ("old", "new") for c in keep if c not in block), "score")


#: What symbols need to share, and what pairs of them are given out with.
BLOCK = ["language", "symbol_type", "signature_json"]
KEEP = ["id", "language", "symbol_type", "fqn", "name", "namespace", "signature_json", "source_text"]


def _agreed(gone: DataFrame, fresh: DataFrame, accept: float, apart: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """Both sides' symbols with their variants, and the pairs of variants that reach ``accept``.

    ``apart``: symbols whose fqn the other side has are told apart by it, so that all pairs of agreed variants are candidates.
    """
    if accept < 0.65:
        raise ValueError("pairs below 0.65 are not looked for")
    block, keep = BLOCK, KEEP
    a, b = (df.where("signature_json <> ''").select(*block, *(F.col(c).alias(f"{side}_{c}") for c in keep if c not in block)) for df, side in ((gone, "old"), (fresh, "new")))
    names = a.select(*block, "old_name").distinct().withColumn("salt", F.pmod(F.xxhash64("old_name"), F.lit(SALTS)).cast("int"))
    others = b.select(*block, "new_name").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    size = lambda side: F.octet_length(f"{side}_name")
    near = 2 * F.least(size("old"), size("new")) > F.greatest(size("old"), size("new"))
    alike = names.join(others, [*block, "salt"]).where(near).where(similarity(F.col("old_name"), F.col("new_name")) > 0.5).drop("salt")
    told = ["name", "namespace", "source_text"]
    variants = {}
    for df, side in ((a, "old"), (b, "new")):
        own = [F.coalesce(F.col(f"{side}_{c}"), F.lit("")) for c in told] + [F.col(f"{side}_{c}").isNull() for c in told]
        df = df.withColumn(f"{side}_shared", F.lit(None).cast("string"))
        if apart:
            shared = meet(a.select(*block, F.col("old_fqn").alias("fqn")).distinct(), b.select(*block, F.col("new_fqn").alias("fqn")).distinct(), [*block, "fqn"])
            shared = shared.select(*block, F.col("fqn").alias(f"{side}_fqn"), F.col("fqn").alias("shared"))
            df = meet(df, shared, [*block, f"{side}_fqn"], "left").withColumn(f"{side}_shared", F.col("shared")).drop("shared")
            own += [F.coalesce(f"{side}_shared", F.lit("")), F.col(f"{side}_shared").isNull()]
        variants[side] = df.withColumn(f"{side}_variant", F.sha2(F.to_json(F.array(*(x.cast("string") for x in own))), 256))
    each = {side: df.select(*block, *(f"{side}_{c}" for c in (*told, "variant", "shared"))).distinct() for side, df in variants.items()}
    agreed = meet(meet(each["old"], alike, [*block, "old_name"]), each["new"], [*block, "new_name"]).where("old_shared is null or new_shared is null or old_shared <> new_shared")
    agreed = agreed.withColumns({f"{side}_signature_json": F.col("signature_json") for side in ("old", "new")})
    agreed = checkpointed(agreed.withColumn("score", _variant_score()).where(F.col("score") >= accept).select(*block, "old_variant", "new_variant", "score"))
    return {side: df.drop(f"{side}_shared") for side, df in variants.items()}, agreed


def score():
    return F.when(F.col("old_fqn") == F.col("new_fqn"), 0.0).otherwise(_variant_score())


def _variant_score():
    names = similarity(F.col("old_name"), F.col("new_name"))
    equal = F.coalesce((F.col("old_signature_json") == F.col("new_signature_json")) & (F.col("old_signature_json") != ""), F.lit(False))
    base = F.when(equal, 0.5).otherwise(0.0) + 0.3 * names
    same = F.when(F.col("old_namespace").eqNullSafe(F.col("new_namespace")), 0.1).otherwise(0.0)
    plain = lambda side: F.regexp_replace(F.replace(F.col(f"{side}_source_text"), F.col(f"{side}_name"), F.lit("__RENAMED__")), r"\s+", " ")
    long = F.greatest(F.octet_length("old_source_text"), F.octet_length("new_source_text")) > 1000
    source = F.when(long, 0.1).otherwise(text_similarity(plain("old"), plain("new")))
    more = F.when((base > 0.4) & (names > 0.5), same + 0.1 * F.coalesce(source, F.lit(0.0))).otherwise(0.0)
    return F.least(F.lit(1.0), base + more)


def assign(pairs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Renames from scored pairs: each removed symbol in the order of ids takes its best free partner.

    In each round every free removed symbol asks its best partner that doesn't hold an
    earlier one, and each added symbol keeps the least id that asked; who is left or put
    out asks on in the next round. That ends in the walk's result, as all added symbols
    prefer the lesser id. The k-th of symbols with equal lists of partners starts at its
    k-th partner, since those before it take as many, none worse.
    """
    likely = pairs.where(F.col("score") >= accept).select("old_id", "new_id", "old_fqn", "new_fqn", "score")
    best = Window.partitionBy("old_id").orderBy(F.desc("score"), "new_id")
    asked = checkpointed(likely.withColumn("place", F.row_number().over(best)))
    marks = [F.bit_xor(F.xxhash64("new_id", "score")).alias("mark"), F.bit_xor(F.xxhash64("score", "new_id")).alias("other")]
    alike = Window.partitionBy("mark", "other").orderBy("old_id")
    first = asked.groupBy("old_id").agg(*marks).select("old_id", F.row_number().over(alike).alias("first"))
    asked = checkpointed(asked.join(first, "old_id").where("place >= first").drop("first"))
    held = asked.select("new_id", F.col("old_id").alias("holder")).limit(0)
    while True:
        open_ = asked.join(held.select(F.col("holder").alias("old_id")), "old_id", "left_anti").join(held, "new_id", "left").where("holder is null or holder > old_id")
        wish = open_.groupBy("old_id").agg(F.min_by("new_id", "place").alias("new_id")).select("new_id", F.col("old_id").alias("holder"))
        wish = checkpointed(wish)
        if wish.isEmpty():
            break
        held = checkpointed(held.unionByName(wish).groupBy("new_id").agg(F.min("holder").alias("holder")))
    return asked.join(held.withColumnRenamed("holder", "old_id"), ["old_id", "new_id"]).select("old_id", "new_id", "old_fqn", "new_fqn", "score")


def renames(gone: DataFrame, fresh: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``assign`` of ``candidates``, without the pairs of symbols between them.

    Symbols of a variant have the same partners, and those of a variant are taken in the order of
    ids. So a walk needs the pairs of variants, and of symbols their variants and ids alone. The
    walk of one block goes through one task in order, since each symbol takes what those before it
    left; that holds the ids of the block's added symbols.
    """
    # Both sides are read many times below.
    variants, agreed = _agreed(*(checkpointed(df.select(*KEEP)) for df in (gone, fresh)), accept, apart=True)
    text = lambda *c: F.sha2(F.to_json(F.array(*c)), 256).alias("block")
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    rows = agreed.select(text(*BLOCK), F.lit(0).alias("kind"), F.col("old_variant").alias("old"), F.col("new_variant").alias("new"), none("id", "long"), "score")
    for kind, side in ((1, "new"), (2, "old")):
        wanted = agreed.select(*BLOCK, f"{side}_variant").distinct()
        mine = meet(variants[side].where(f"{side}_id is not null"), wanted, [*BLOCK, f"{side}_variant"], "left_semi")
        names = [F.col(f"{side}_variant").alias(c) if c == side else none(c, "string") for c in ("old", "new")]
        rows = rows.unionByName(mine.select(text(*BLOCK), F.lit(kind).alias("kind"), *names, F.col(f"{side}_id").cast("long").alias("id"), none("score", "double")))
    tasks = 16 * gone.sparkSession.sparkContext.defaultParallelism
    found = rows.repartition(tasks, "block").sortWithinPartitions("block", "kind", "id").mapInArrow(_walked, "old_id long, new_id long, score double")
    for side in ("old", "new"):
        found = meet(found, variants[side].select(f"{side}_id", f"{side}_fqn"), f"{side}_id")
    return found.select("old_id", "new_id", "old_fqn", "new_fqn", "score")


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Renames of blocks whose rows come as pairs of variants, added symbols and removed symbols by their ids."""
    block = None
    for batch in batches:
        found = []
        for of, kind, old, new, id_, score in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if of != block:
                # By variant: partners by their scores, ids that are free, and how many are taken.
                block, partners, wishes, free, taken = of, {}, {}, {}, {}
            if kind == 0:
                partners.setdefault(old, {}).setdefault(score, []).append(new)
            elif kind == 1:
                free.setdefault(new, array("q")).append(id_)
                taken[new] = 0
            else:
                if old not in wishes:
                    # The worst score first, so that what is used up goes from the end; of one score the least id that was free.
                    wishes[old] = [(s, sorted((free[n][taken[n]], n) for n in some if n in free and taken[n] < len(free[n]))) for s, some in sorted(partners.pop(old).items())]
                best = _best(wishes[old], free, taken)
                if best:
                    found.append((id_, *best))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["old_id", "new_id", "score"])


def _best(wishes: list[tuple[float, list]], free: dict, taken: dict) -> tuple[int, float] | None:
    """The partner that a symbol takes, and the score: of the highest that has one free, the least id."""
    while wishes:
        score, heap = wishes[-1]
        while heap:
            first, name = heap[0]
            at = taken[name]
            if at == len(free[name]):
                heappop(heap)
            elif free[name][at] != first:
                heapreplace(heap, (free[name][at], name))
            else:
                taken[name] += 1
                return first, score
        wishes.pop()
    return None
