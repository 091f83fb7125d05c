"""Op4: quality rules as a short-circuit cascade, with DataFrame functions only.

Every rule is a condition that rejects a text, over measures of the text. On a sample of
texts each rule is run alone, with the measures that it needs, often enough to be timed:
that is its cost, and the share of the sample that it rejects is its selectivity. Rules are
then tried in order of rejections per cost, and a text that one rule rejects is not tried
against the rest (the branches of one CASE, each with its own measures inside). The order
changes how long it takes, never the verdict.

``verdicts`` measures nothing but what the cascade reaches. ``quality`` returns the
measures of every text too; those are no cost of a rule then, and the order is found
without them.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import staged, table, texts

#: Rows that costs and selectivities are estimated on, about; times that each rule is run on them.
SAMPLE_ROWS, REPEATS = 500, 8

_GAPS = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """A rule rejects a text where ``test`` holds, a condition on ``text`` and the measures that it needs."""

    name: str
    needs: tuple[str, ...]
    test: Callable[[dict[str, Column]], Column]
    sql: str  # the same for DuckDB
    reads: bool = False  # whether the test itself goes through the text


def _kept(kind: str) -> Column:
    """How many characters of a class the text has."""
    return F.length(F.regexp_replace("text", f"[^{kind}]+", ""))


RULES = (
    Rule("symbols", ("n_symbols", "n_words"), lambda m: 10 * m["n_symbols"] > m["n_words"], "10 * n_symbols > n_words"),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda m: (m["n_lines"] >= 4) & (10 * m["n_dup_lines"] > 3 * m["n_lines"]), "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines"),
    Rule("repeated_windows", ("n_repeat_words", "n_words"), lambda m: 10 * m["n_repeat_words"] > 4 * m["n_words"], "10 * n_repeat_words > 4 * n_words"),
    Rule("word_length", ("word_chars", "n_words"), lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"]), "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("shouting", ("word_chars",), lambda m: 2 * _kept("A-Z") > m["word_chars"], "2 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > word_chars", True),
    Rule("exclaiming", ("n_words",), lambda m: 10 * _kept("!") > 3 * m["n_words"], "10 * length(regexp_replace(text, '[^!]+', '', 'g')) > 3 * n_words", True),
)

#: The base rules of the contract come first: where they fail there is no verdict to find.
BASE = Rule("base", ("n_words", "n_repeat_words"), lambda m: (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"]), "n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice.

    The windows (as three word hashes of 64 bits, with their place) are sorted, so equal
    ones are neighbours; no window leaves its row.
    """
    n = F.size(words)

    def windows(h: Column) -> Column:
        size = n - 2
        return F.sort_array(F.arrays_zip(F.slice(h, 1, size).alias("a"), F.slice(h, 2, size).alias("b"), F.slice(h, 3, size).alias("c"), F.sequence(F.lit(0), size - 1).alias("p")))

    def repeated(s: Column) -> Column:
        same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
        met = F.filter(s, lambda x, i: F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)))
        return F.sort_array(F.transform(met, lambda x: x["p"]))

    def covered(places: Column) -> Column:
        gaps = F.aggregate(F.transform(places, lambda p, i: F.least(F.lit(3), p - F.coalesce(F.get(places, i - 1), F.lit(-3)))), F.lit(0), lambda a, b: a + b)
        return F.when(F.size(places) == 0, F.lit(0)).otherwise(gaps)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(n < 4, F.lit(0)).otherwise(let(hashes, lambda h: let(windows(h), lambda s: let(repeated(s), covered))))


#: Measures by what they are taken from: a text's words, its lines that hold a word, or itself.
_MEASURES = {
    "of_words": {"n_words": F.size, "word_chars": lambda w: F.length(F.array_join(w, "")), "n_repeat_words": lambda w: _repeat_words(w)},
    "of_lines": {"n_lines": F.size, "n_dup_lines": lambda x: F.size(x) - F.size(F.array_distinct(x))},
    "of_text": {"n_symbols": lambda t: F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", ""))},
}
def _words() -> Column:
    return F.array_remove(F.split("text", _GAPS), "")


def _lines() -> Column:
    return F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


_PLACE = {n: source for source, known in _MEASURES.items() for n in known}


def measures(needs: Iterable[str], words: Column | None = None) -> Column:
    """A struct that holds a struct for each source of the measures needed; a source is cut once a row."""

    def of(source: str, names: list[str]) -> Column:
        cut = {"of_words": lambda: _words() if words is None else words, "of_lines": _lines, "of_text": lambda: F.col("text")}[source]()
        return let(cut, lambda x: F.struct(*(_MEASURES[source][n](x).cast("long").alias(n) for n in names)))

    wanted = {source: [n for n in known if n in set(needs)] for source, known in _MEASURES.items()}
    return F.struct(*(of(source, names).alias(source) for source, names in wanted.items() if names))


def fields(needs: Iterable[str], struct: Column) -> dict[str, Column]:
    return {n: struct[_PLACE[n]][n] for n in needs}


def measured(docs: DataFrame, needs: Iterable[str] = tuple(_PLACE)) -> DataFrame:
    """doc_id, text, and the measures; null texts have none of anything."""
    got = texts(docs).select("doc_id", "text", measures(needs).alias("m")).select("doc_id", "text", "m.*")
    return got.select("doc_id", "text", *(F.col(f"{_PLACE[n]}.{n}").alias(n) for n in needs))


def condition(rule: Rule, known: dict[str, Column], words: Column | None = None) -> Column:
    """The rule as a condition on ``text``; measures that are not known are taken inside."""
    more = [n for n in rule.needs if n not in known]
    if not more:
        return rule.test(known)
    return let(measures(more, words), lambda m: rule.test({**known, **fields(more, m)}))


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` documents from all parts of the table."""
    n = docs.count()
    return docs.sample(min(1.0, rows / max(1, n)), seed=7)


def ordered(sample: DataFrame, rules: tuple[Rule, ...] = RULES, repeats: int = REPEATS) -> list[tuple[Rule, float, float]]:
    """Rules with their seconds a row and rejected share on the sample, by rejections per second.

    ``sample`` has text and the measures that are known without a rule; what they cost is
    no cost of a rule. A rule that does more is timed: each row is taken ``repeats`` times
    in one job, after a run that compiles it, and what a job takes that only reads the
    rows is taken off.
    """
    known = {c: F.col(c) for c in sample.columns if c in _PLACE}
    words = F.col("words") if "words" in sample.columns else None
    conditions = {rule.name: condition(rule, known, words) for rule in rules}
    shares = sample.agg(F.count("*").alias("n"), *(F.count_if(c).alias(name) for name, c in conditions.items())).first()
    many = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))

    def seconds(test: Column) -> float:
        job = many.agg(F.count_if(test))
        job.first()
        began = time.perf_counter()
        job.first()
        return time.perf_counter() - began

    reading = seconds(F.length("text") < 0)
    found = []
    for rule in rules:
        free = not rule.reads and all(n in known for n in rule.needs)
        cost = 0.0 if free else seconds(conditions[rule.name]) - reading
        found.append((rule, max(cost, 1e-4) / max(1, shares.n), shares[rule.name] / max(1, shares.n)))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1]))


def cascade(order: list[Rule], known: dict[str, Column], words: Column | None = None) -> Column:
    """The name of the first rule, after the base ones, that rejects a text; null if none does."""
    out = F.when(BASE.test(known), F.lit(BASE.name))
    for rule in order:
        out = out.when(condition(rule, known, words), F.lit(rule.name))
    return out


def verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, kept and rule (null if kept) of every document, measuring only what the cascade reaches.

    The verdicts are those of ``quality``, and so is the treatment of odd rows.
    """
    sample = measured(sampled(docs), BASE.needs).withColumn("words", _words())
    order = [rule for rule, _, _ in ordered(staged(sample, "quality-sample"), rules)]

    def judged(words: Column) -> Column:
        return let(measures(BASE.needs, words), lambda m: cascade(order, fields(BASE.needs, m), words))

    return texts(docs).select("doc_id", let(_words(), judged).alias("rule")).select("doc_id", F.col("rule").isNull().alias("kept"), "rule")


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures, verdict and first failing rule of every document.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, rule (null if kept; ``base`` for the base rules). A null or empty
    text has no words and fails the base rules; repeated rows are judged each; an empty
    table gives no rows. One pass over the documents without a shuffle; as every measure
    is returned, only what rules do beyond them is short-circuited and counts as cost.
    """
    order = [rule for rule, _, _ in ordered(staged(measured(sampled(docs)), "quality-sample"), rules)]
    known = {n: F.col(n) for n in _PLACE}
    judged = measured(docs).withColumn("rule", cascade(order, known))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", BASE.test(known).alias("base_failed"), F.col("rule").isNull().alias("kept"), "rule")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).drop("rule")


_REJECTED = " or ".join(f"({r.sql})" for r in RULES)

OP4_SQL = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
s as (
  select r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from d),
w as (select r, unnest(range(1, len(ws) - 1)) as i, ws from s where len(ws) > 3),
x as (select r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g from w),
y as (select r, i, count(*) over (partition by r, g) as c from x),
z as (select r, count(distinct j) as n from (select r, unnest([i, i + 1, i + 2]) as j from y where c > 1) group by r),
m as (
  select s.doc_id, s.text, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, len(ls)::bigint as n_lines,
    (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(z.n, 0)::bigint as n_repeat_words
  from s left join z on s.r = z.r),
b as (select *, {BASE.sql} as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or {_REJECTED}) as kept
from b
"""
