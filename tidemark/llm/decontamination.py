"""Op10: benchmark decontamination by pigeonhole edit matching.

A text within ``budget`` edits of a test item holds at least one of ``budget + 1`` pieces
of the item unchanged. One automaton finds all pieces of all items in a document; each
hit places the whole item in the document within the budget, and Myers' bit-parallel
distance (bits of a Python integer, one step a character) verifies that stretch.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import staged, table, texts

#: Edits allowed for each character of an item, and the shortest item (in characters) that has
#: edits; shorter items are looked for whole, between word boundaries.
EDITS_PER_CHARACTER, SHORTEST_ITEM = 0.05, 40

#: Items, and their characters, that one pass over the documents looks for; more take more passes.
ITEMS_A_PASS, CHARACTERS_A_PASS = 20_000, 8_000_000


def normalised(text: str) -> str:
    """Lower case, with single spaces between words and none around."""
    return " ".join(text.lower().split())


def pieces(item: str, rate: float = EDITS_PER_CHARACTER) -> tuple[int, list[tuple[int, str]]]:
    """The item's error budget, and its budget + 1 pieces with their places.

    An item of under ``SHORTEST_ITEM`` has no budget. With one edit in 20 characters a
    piece has 13 characters or more.
    """
    budget = 0 if len(item) < SHORTEST_ITEM else int(rate * len(item))
    edges = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return budget, [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


class Myers:
    """Least edit distance of a pattern to any substring of a text, and where that ends."""

    def __init__(self, pattern: str):
        self.length = len(pattern)
        self.masks: dict[str, int] = defaultdict(int)
        for k, c in enumerate(pattern):
            self.masks[c] |= 1 << k
        self.masks = dict(self.masks)

    def best(self, text: str) -> tuple[int, int]:
        full, top = (1 << self.length) - 1, 1 << (self.length - 1)
        up, down, score = full, 0, self.length
        least, at = score, 0
        get = self.masks.get
        for k, c in enumerate(text):
            eq = get(c, 0)
            diagonal = (((eq & up) + up) ^ up) | eq | down
            plus, minus = (down | ~(diagonal | up)) & full, up & diagonal
            score += bool(plus & top) - bool(minus & top)
            # A zero first row: a match may start anywhere in the text.
            plus, minus = (plus << 1) & full, (minus << 1) & full
            up, down = (minus | ~(diagonal | plus)) & full, plus & diagonal
            if score < least:
                least, at = score, k + 1
        return least, at


def _bounded(text: str, begin: int, end: int) -> bool:
    """Whether no word of the text goes on beyond either end."""
    word = lambda c: c.isalnum() or c == "_"
    return not (begin and word(text[begin - 1]) and word(text[begin])) and not (end < len(text) and word(text[end]) and word(text[end - 1]))


class Matcher:
    """Finds the items of one pass in normalised texts; an item is its place in ``items``, whatever ids repeat."""

    def __init__(self, items: list[str], rate: float):
        import ahocorasick

        self.rate, self.items, self.myers = rate, items, {}
        self.budgets: list[int] = []
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item, text in enumerate(items):
            budget, parts = pieces(text, rate)
            self.budgets.append(budget)
            for at, part in parts:
                places[part].append((item, at))
        self.machine = ahocorasick.Automaton()
        for part, uses in places.items():
            self.machine.add_word(part, (len(part), uses))
        self.any = bool(places)
        if self.any:
            self.machine.make_automaton()

    def hits(self, text: str) -> dict[int, tuple[int, int]]:
        """Per item within its budget: the least distance, and the end of that match."""
        if not self.any:
            return {}
        windows: dict[int, list[list[int]]] = defaultdict(list)
        found = {}
        for end, (size, uses) in self.machine.iter(text):
            for item, at in uses:
                if not self.budgets[item]:
                    if item not in found and _bounded(text, end + 1 - size, end + 1):
                        found[item] = (0, end + 1)
                    continue
                budget = self.budgets[item]
                begin = end + 1 - size - at
                low, high = max(0, begin - budget), begin + len(self.items[item]) + budget
                kept = windows[item]
                if kept and low <= kept[-1][1]:
                    kept[-1][1] = max(kept[-1][1], high)
                    kept[-1][0] = min(kept[-1][0], low)
                else:
                    kept.append([low, high])
        for item, kept in windows.items():
            best = None
            for low, high in kept:
                part = text[low:high]
                exact = part.find(self.items[item])
                if exact >= 0:
                    best = (0, low + exact + len(self.items[item]))
                    break
                if item not in self.myers:
                    self.myers[item] = Myers(self.items[item])
                distance, at = self.myers[item].best(part)
                if distance <= self.budgets[item] and (best is None or distance < best[0]):
                    best = (distance, low + at)
            if best:
                found[item] = best
        return found


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = EDITS_PER_CHARACTER, items_a_pass: int = ITEMS_A_PASS, characters_a_pass: int = CHARACTERS_A_PASS) -> DataFrame:
    """(doc_id, item_id, distance, budget, match_end) of every item within its budget.

    ``benchmark`` has item_id and text. Texts and items are lower-cased and their white
    space made single spaces; ``match_end`` counts code points of that normal form. Items
    of under 40 characters have no budget and match whole words alone; null ones and those of
    white space are not looked for. Every row is an item: of several rows of one id, null included, the best
    match counts, with that row's budget. Null and empty documents
    hold nothing; rows of one doc_id are searched each and give their best match; empty
    tables give no rows. One pass over the documents for each ``items_a_pass`` items or
    ``characters_a_pass`` characters of them, without a shuffle of texts; the driver holds
    one pass at a time, and hits are reduced to one a pair.
    """
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    docs, found, block, size = texts(docs), None, [], 0

    def joined(one: DataFrame) -> DataFrame:
        return one if found is None else found.unionByName(one)

    for r in items.toLocalIterator():
        text = normalised(r.text)
        if not text:
            continue
        if block and (len(block) >= items_a_pass or size + len(text) > characters_a_pass):
            found, block, size = joined(staged(_search(docs, block, rate), "hits")), [], 0
        block.append((r.item_id, text))
        size += len(text)
    found = joined(_search(docs, block, rate))
    best = F.min(F.struct("distance", "match_end", "budget")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.distance", "m.budget", "m.match_end")


def _search(docs: DataFrame, items: list[tuple[int, str]], rate: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher([text for _, text in shared.value], rate)
        ids = [item for item, _ in shared.value]
        names = ["doc_id", "item_id", "distance", "budget", "match_end"]
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for item, (distance, end) in matcher.hits(normalised(text.as_py())).items():
                    for to, x in zip(rows, (doc, ids[item], distance, matcher.budgets[item], end), strict=True):
                        to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names)

    return docs.mapInArrow(search, "doc_id long, item_id long, distance long, budget long, match_end long")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
