"""Op9: bootstrapped contextual extraction of personal data, with DataFrame functions only.

The base patterns find seed entities. A token that looks like an identifier (it holds at
least five digits or an @) and the word before it are an instance and a lexical pattern.
Spark scores the bipartite graph of patterns and instances in rounds: a pattern is worth
the share of its instances that are trusted, smoothed by its support; an instance is
trusted if it is a seed, or if the patterns it was met with leave little doubt. Patterns
that end with a high score discover identifiers no base pattern describes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import staged, table, texts
from tidemark.llm.quality import let

# The base patterns of the contract, in the order of their kinds. Possessive
# quantifiers and the look-behind only keep Java from retrying starts inside a run that
# cannot match; what they match, leftmost and non-overlapping, is the same.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[ -][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}

_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: A run without white space; candidates of the method are those that look like identifiers.
TOKEN = r"[^\x20\x09-\x0D]++"


#: Elements that an inner loop of ``running`` appends to one array, which copies it each time.
BLOCK = 128


def running(values: str, combine: str, zero: int) -> str:
    """SQL of the running combination of an array of integers, in linear time but for a small factor.

    ``combine`` is a function of two (``greatest``, say, or ``+``). Appending to an array
    copies it, so a plain fold is quadratic: values go in blocks of ``BLOCK``, and the
    running combination of the blocks' last values is what each block goes on from.
    """

    def both(a: str, b: str) -> str:
        return f"{combine}({a}, {b})" if combine.isalpha() else f"({a} {combine} {b})"

    def fold(items: str) -> str:
        now = both("s.last", "i")
        start = f"named_struct('last', {zero}, 'got', cast(array() as array<int>))"
        return f"aggregate({items}, {start}, (s, i) -> named_struct('last', {now}, 'got', concat(s.got, array({now}))), s -> s.got)"

    cut = f"transform(sequence(0, cast((size(vs) - 1) div {BLOCK} as int)), n -> {fold(f'slice(vs, n * {BLOCK} + 1, {BLOCK})')})"
    ends = fold("transform(inside, x -> element_at(x, -1))")
    joined = f"flatten(transform(inside, (x, n) -> transform(x, v -> {both(f'coalesce(get(ends, n - 1), {zero})', 'v')})))"
    return where(vs=values, body=f"if(size(vs) > 0, {where(inside=cut, body=where(ends=ends, body=joined))}, cast(array() as array<int>))")


def where(body: str, **value: str) -> str:
    """SQL of ``body`` in which a name stands for a value that is computed once a row."""
    ((name, what),) = value.items()
    return f"element_at(transform(array({what}), {name} -> {body}), 1)"


def spans(pattern: str) -> Column:
    """All matches in ``text`` as array<struct<start, end, m, gap>>, in code points; null where there is none.

    The pieces between the matches, which split() gives, tell where each match starts;
    ``gap`` is the piece before a match.
    """
    ends = running("transform(ms, (m, k) -> length(gaps[k]) + length(m))", "+", 0)
    placed = "transform(ms, (m, k) -> named_struct('start', ends[k] - length(m), 'end', ends[k], 'm', m, 'gap', gaps[k]))"
    some = where(gaps=f"split(text, r'{pattern}', -1)", body=where(ends=ends, body=placed))
    return F.expr(where(ms=f"regexp_extract_all(text, r'({pattern})', 1)", body=f"if(size(ms) > 0, {some}, null)"))


def _luhn(match: Column) -> Column:
    digits = F.reverse(F.split(F.regexp_replace(match, "[^0-9]", ""), ""))
    worth = lambda x, i: F.when(i % 2 == 0, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))
    total = F.aggregate(F.transform(F.transform(F.filter(digits, lambda x: x != ""), lambda x: x.cast("int")), worth), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def _digits(match: Column) -> Column:
    return F.length(F.regexp_replace(match, "[^0-9]", ""))


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.when(_digits(match).between(13, 19), _luhn(match)).otherwise(F.lit(False))
    if kind == "phone":
        return _digits(match).between(9, 15)
    return F.lit(True)


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def base_spans(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with ``base``: the valid base matches by kind as listed, then start."""
    return docs.withColumn("base", F.concat(*(_kind_spans(kind, pattern) for kind, pattern in KINDS.items())))


#: What a text must hold for a kind to be searched at all: a cheap test before the search.
_NEEDS = {"email": "@", "ip": "[0-9][.][0-9]", "card": "[0-9][0-9 -]{12}", "phone": "[+][0-9]"}


def _kind_spans(kind: str, pattern: str) -> Column:
    text = F.col("text")
    may = text.contains("@") if kind == "email" else text.rlike(_NEEDS[kind])
    valid = F.filter(spans(pattern), lambda x: _valid(kind, x["m"]))
    found = F.transform(valid, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return F.coalesce(F.when(may, found), F.array().cast(_SPANS))


#: Identifier tokens with the word before: at least five digits or an @, in white space.
CANDIDATE = r"(?:(?<![^\x20\x09-\x0D]))(?=[^\x20\x09-\x0D@0-9]*+[@0-9])(?:(?=[^\x20\x09-\x0D@]*+@)|(?=(?:[^\x20\x09-\x0D0-9]*+[0-9]){5}))[^\x20\x09-\x0D]++"


_NAMED = "array<struct<begin:int,to:int,start:int,end:int,instance:string,pattern:string>>"
_TOKENS = "array<struct<start:int,end:int,instance:string,pattern:string,seed:boolean>>"


#: The last word of a piece of text that ends in white space.
_LAST_WORD = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++$"


def _candidate(token: Column, before: Column) -> Column:
    """A token without what encloses it, and its pattern from the piece of text, or the token, ``before`` it."""
    lead = F.length(token["m"]) - F.length(F.regexp_replace(token["m"], r"^[\"'(\[{*#$%&|<>]+", ""))
    bare = F.regexp_replace(F.substr(token["m"], lead + 1), r"[.,;:!?\"')\]}*#$%&|<>]+$", "")
    start = token["start"] + lead
    last = F.regexp_extract(token["gap"], _LAST_WORD, 1)
    word = F.lower(F.regexp_replace(F.when(last != "", last).otherwise(F.coalesce(before, F.lit(""))), "[0-9]+", ""))
    return F.struct(
        token["start"].alias("begin"),
        token["end"].alias("to"),
        start.alias("start"),
        (start + F.length(bare)).alias("end"),
        bare.alias("instance"),
        F.when(word == "", F.lit("^")).otherwise(word).alias("pattern"),
    )


def _seeds() -> Column:
    """``tokens`` with ``seed``: whether a span of ``base`` overlaps the token.

    Spans by their starts and tokens by their ends go in one order, a token before a span
    that starts where it ends; the greatest end of the spans up to a token then decides.
    """
    events = "array_sort(concat(transform(tokens, t -> struct(t.to as key, 0 as kind, t.begin as begin, -1 as end)), transform(base, b -> struct(b.start as key, 1 as kind, -1 as begin, b.end as end))))"
    reach = running("transform(es, e -> e.end)", "greatest", -1)
    marked = "filter(transform(es, (e, k) -> struct(e.kind as kind, reach[k] > e.begin as seed)), e -> e.kind = 0)"
    flags = where(es=events, body=where(reach=reach, body=marked))
    seeded = "transform(tokens, (t, k) -> struct(t.start as start, t.end as end, t.instance as instance, t.pattern as pattern, flags[k].seed as seed))"
    return F.expr(f"if(size(tokens) > 0, {where(flags=flags, body=seeded)}, cast(array() as {_TOKENS}))")


def with_candidates(found: DataFrame) -> DataFrame:
    """(row, doc_id, base, tokens): every identifier token with the pattern it was met with.

    ``seed`` is true where a base span overlaps the token. The pattern is the lower-cased
    whole word before the token without its digits, or ``^``. Each step is linear in the
    text, but for sorting.
    """
    named = let(spans(CANDIDATE), lambda ts: F.transform(ts, lambda t, k: _candidate(t, F.get(ts, k - 1)["m"])))
    tokens = F.filter(F.when(F.col("text").rlike("[@0-9]"), named), lambda t: F.length(t["instance"]) >= 5)
    return found.select("row", "doc_id", "base", F.coalesce(tokens, F.array().cast(_NAMED)).alias("tokens")).select("row", "doc_id", "base", _seeds().alias("tokens"))


def scored_patterns(edges: DataFrame, rounds: int = 3, support: int = 1) -> DataFrame:
    """(pattern, score) after ``rounds`` of scoring patterns by instances and back.

    ``edges`` has (pattern, instance, n, seed), one row each pair. A pattern's score is
    (trust of its occurrences) / (occurrences + support), so rare patterns stay low: with
    five seeds and one unseen instance it is 0.83 after three rounds, with four 0.796. An
    unseen instance's trust is 1 - prod(1 - score) over its patterns. Both directions are
    sums with map-side combination; the joins between them are plain equi-joins.
    """
    trust = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("trust"))
    scores = None
    for k in range(rounds):
        scores = edges.join(trust, "instance").groupBy("pattern").agg((F.sum(F.col("n") * F.col("trust")) / (F.sum("n") + support)).alias("score"))
        if k + 1 < rounds:
            linked = edges.join(scores, "pattern").groupBy("instance").agg(
                F.max(F.col("seed").cast("double")).alias("seed"), F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999999)))).alias("doubt")
            )
            trust = staged(linked.select("instance", F.greatest("seed", 1 - F.exp("doubt")).alias("trust")), f"trust-{k}")
    return scores


def find_personal_data(docs: DataFrame, threshold: float = 0.8, rounds: int = 3) -> DataFrame:
    """Base and discovered spans of every document.

    Columns: doc_id; ``base``, the base spans by kind as listed, then start; ``spans``,
    these followed by the discovered ones (kind ``context``) by start. A discovered span
    overlaps no base span. Null and empty texts have no spans; repeated
    rows of one id each get the same; an empty table gives no rows. Spans and identifier
    tokens are staged once; the text itself is never shuffled.
    """
    found = base_spans(texts(docs).withColumn("row", F.monotonically_increasing_id()))
    whole = staged(with_candidates(found), "pii-spans")
    tokens = whole.select("row", F.explode("tokens").alias("t")).select("row", "t.*")
    edges = staged(tokens.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "pii-edges")
    trusted = scored_patterns(edges, rounds).where(F.col("score") >= threshold).select("pattern")
    fresh = tokens.where(~F.col("seed")).join(trusted, "pattern").groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("more"))
    more = F.transform(F.coalesce("more", F.array().cast("array<struct<start:int,end:int>>")), lambda x: F.struct(F.lit("context").alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return whole.select("row", "doc_id", "base").join(fresh, "row", "left").select("doc_id", "base", F.concat("base", more).alias("spans"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *map(_count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
