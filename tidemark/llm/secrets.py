"""Op8: secret scans by a battery of randomness tests with length-aware discovery control.

Fixed patterns give the base spans. Beyond them, every run of 20 or more characters of an
encoding's alphabet is a candidate, and its encoding (hex, base 32, base 36, base 64) is
the smallest alphabet that holds it. A candidate counts as a secret if

* chi-squared uniformity over the encoding's alphabet is far better than that of text:
  its p-value under letters drawn as in written language says how seldom text is that even,
  the largest over the languages, so that the text may be in any of them;
* the runs test about the alphabet's middle and the lag-one serial correlation, in
  contrast, don't reject randomness at ``ACCEPT``; where they do, the p-value counts as 1.

A p-value that is raised to 1 stays a valid one, so the step-up rule of Benjamini and
Hochberg over all candidates of the corpus keeps its promise. They go into one histogram
for each band of lengths (a fixed number of cells), and the rule is applied within each
band at ``RATE``, so that many short candidates, where the test has little power, don't
loosen the bound for long ones.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, staged, table, texts

# The base patterns of the contract, and what their matches must reach.
BASE = (
    ("assign", re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")),
    ("access", re.compile(r"AKIA[A-Z0-9]+")),
    ("hex", re.compile(r"[0-9a-f]{24,}")),  # runs of at least 24 are the runs that count
)
LEAST = {"assign": 6, "access": 20, "hex": 24}

# The alphabets of encodings, smallest first, and letter shares of written languages in percent.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "hex_upper": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
LETTERS = "abcdefghijklmnopqrstuvwxyz"
LETTER_SHARES = {
    "en": (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.2, 0.8, 4.0, 2.4, 6.7, 7.5, 1.9, 0.1, 6.0, 6.3, 9.1, 2.8, 1.0, 2.4, 0.2, 2.0, 0.1),
    "de": (6.5, 1.9, 2.7, 5.1, 16.4, 1.7, 3.0, 4.6, 6.6, 0.3, 1.4, 3.4, 2.5, 9.8, 2.6, 0.7, 0.1, 7.0, 7.3, 6.2, 4.2, 0.8, 1.9, 0.1, 0.1, 1.1),
    "fr": (7.6, 0.9, 3.3, 3.7, 14.7, 1.1, 0.9, 0.7, 7.5, 0.6, 0.1, 5.5, 3.0, 7.1, 5.8, 2.5, 1.4, 6.7, 7.9, 7.2, 6.3, 1.8, 0.1, 0.4, 0.1, 0.3),
    "es": (11.5, 2.2, 4.0, 5.0, 12.2, 0.7, 1.8, 0.7, 6.2, 0.5, 0.1, 5.0, 3.2, 6.7, 8.7, 2.5, 0.9, 6.9, 8.0, 4.6, 2.9, 1.1, 0.1, 0.2, 1.0, 0.5),
}
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")

#: Share of false discoveries in a band of lengths; level of the tests that must accept; bands' least lengths; cells of -log10 p.
RATE, ACCEPT, BANDS, CELLS = 0.01, 0.01, (20, 28, 40, 64, 128), 200


def base_matches(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, end, kind, start and end of the secret itself) of base matches, by start, then kind as listed."""
    found = []
    for order, (kind, pattern) in enumerate(BASE):
        for m in pattern.finditer(text):
            a, b = m.span(m.lastindex or 0)
            if b - a >= LEAST[kind]:
                found.append((m.start(), order, m.end(), kind, a, b))
    return [(start, end, kind, a, b) for start, _, end, kind, a, b in sorted(found)]


def candidates(text: str, base: list[tuple]) -> Iterator[tuple[str, int, int, int, int]]:
    """(kind, start, end, band, cell) of tokens outside base spans; cell 0 where an accepting test fails."""
    ends, at, reach = sorted((x[0], x[1]) for x in base), 0, 0
    for m in _CANDIDATE.finditer(text):
        while at < len(ends) and ends[at][0] < m.end():
            reach = max(reach, ends[at][1])
            at += 1
        if reach > m.start():
            continue
        tested = battery(m.group())
        if tested:
            band = sum(len(m.group().rstrip("=")) >= b for b in BANDS) - 1
            p = tested[1] if min(tested[2:]) > ACCEPT else 1.0
            yield f"random_{tested[0]}", m.start(), m.end(), band, min(CELLS - 1, int(-10 * math.log10(max(p, 1e-300))))


def _text_model(alphabet: str, language: str) -> np.ndarray:
    """Shares of an alphabet's characters in text: its letters, and a hundredth of others."""
    letter = dict(zip(LETTERS, LETTER_SHARES[language], strict=True))
    both = alphabet.lower() != alphabet and alphabet.upper() != alphabet
    shares = np.array([letter.get(c.lower(), 0.0) * (0.1 if c.isupper() and both else 1.0) for c in alphabet])
    shares = shares / shares.sum() * 0.99 + 0.01 / len(alphabet)
    return shares / shares.sum()


def _moments(q: np.ndarray) -> tuple[float, float, float, float]:
    """Sums over a model's shares that the mean and spread of the statistic are made of."""
    u = 1 / len(q)
    return float((q * (1 - q)).sum()), float(((q - u) ** 2).sum()), float((q * (q - u) ** 2).sum()) - float((q * (q - u)).sum()) ** 2, float((q * q).sum())


_MODELS = {name: (chars, {c: k for k, c in enumerate(chars)}, [_moments(_text_model(chars, x)) for x in LETTER_SHARES]) for name, chars in ALPHABETS.items()}


def encoding(token: str) -> str | None:
    for name, (_, index, _) in _MODELS.items():
        if all(c in index for c in token):
            return name
    return None


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(token: str) -> tuple[str, float, float, float] | None:
    """(encoding, p of text being as even, p of the runs test, p of the serial test)."""
    body = token.rstrip("=")
    name = encoding(body)
    if name is None or len(body) < BANDS[0]:
        return None
    chars, index, models = _MODELS[name]
    x = np.array([index[c] for c in body], float)
    n, k = len(x), len(chars)
    u = 1 / k
    counts = np.bincount(x.astype(int), minlength=k)
    statistic = float(((counts - n * u) ** 2).sum() / (n * u))
    even = 0.0
    for alone, off, third, squares in models:
        mean = (n * alone + n * n * off) / (n * u)
        spread = 4 * n * k * k * third + 2 * k * k * squares
        # Sums of squares are skewed; their cube roots are close to normal (Wilson and Hilferty).
        v = spread / mean**2 / 9
        even = max(even, 0.5 * math.erfc((1 - v - (statistic / mean) ** (1 / 3)) / math.sqrt(2 * v)))
    high = x >= k / 2
    ones = int(high.sum())
    zeros = n - ones
    if min(ones, zeros) < 2:
        return name, even, 0.0, 0.0
    runs = 1 + int((high[1:] != high[:-1]).sum())
    expected = 1 + 2 * ones * zeros / n
    variance = (expected - 1) * (expected - 2) / (n - 1)
    of_runs = _two_sided((runs - expected) / math.sqrt(max(variance, 1e-9)))
    around = x - x.mean()
    energy = float((around**2).sum())
    serial = float((around[1:] * around[:-1]).sum()) / energy if energy else 1.0
    return name, even, of_runs, _two_sided((serial + 1 / n) * math.sqrt(n))


_FOUND = "row long, doc_id long, base array<struct<kind:string,start:int,end:int>>, more array<struct<kind:string,start:int,end:int,band:int,cell:int>>"


def _scan(docs: DataFrame) -> DataFrame:
    """Per row its base spans and its candidates, with band and cell of p."""
    span = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct(span)), pa.list_(pa.struct([*span, ("band", pa.int32()), ("cell", pa.int32())]))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, others = [], []
            for value in batch.column(2):
                text = value.as_py()
                base = base_matches(text)
                bases.append([{"kind": x[2], "start": x[0], "end": x[1]} for x in base])
                others.append([dict(zip(("kind", "start", "end", "band", "cell"), x, strict=True)) for x in candidates(text, base)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bases, kinds[2]), pa.array(others, kinds[3])], ["row", "doc_id", "base", "more"])

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(scan, _FOUND)


def _cells(found: DataFrame) -> list[tuple[int, int, int]]:
    return [tuple(r) for r in found.select(F.explode("more").alias("x")).groupBy("x.band", "x.cell").agg(F.count("*")).collect()]


def thresholds(cells: list[tuple[int, int, int]], rate: float = RATE) -> dict[int, int]:
    """Per band the least cell that the step-up rule still takes, from (band, cell, n) counts."""
    least: dict[int, int] = {}
    for band in {x[0] for x in cells}:
        above, total = 0, sum(n for b, _, n in cells if b == band)
        for _, cell, n in sorted((x for x in cells if x[0] == band), key=lambda x: -x[1]):
            above += n
            if 10 ** (-cell / 10) <= rate * above / total:
                least[band] = cell
    return least


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, ``base`` and ``spans`` (arrays of kind, start, end in code points) of every row.

    Base spans come by start, then kind as listed; discovered ones (``random_...``) follow
    in the order of starts and overlap no base span. Null and empty texts have none;
    repeated rows get the same each; an empty table gives no rows. Texts are read once
    and never shuffled; to the driver goes one count for each band and cell.
    """
    found = staged(_scan(texts(docs)), "secret-spans")
    least = thresholds(_cells(found), rate)
    taken = F.filter("more", lambda x: _any([(x["band"] == b) & (x["cell"] >= c) for b, c in least.items()]))
    extra = F.transform(taken, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    order = lambda x: F.struct(x["start"].alias("a"), F.coalesce(F.array_position(F.array(*(F.lit(k) for k, _ in BASE)), x["kind"]), F.lit(9)).alias("o"), x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    ranked = F.transform(F.sort_array(F.transform(F.concat("base", extra), order)), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return found.select("doc_id", "base", ranked.alias("spans"))


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The documents with the text of each secret replaced by ``mask``; other columns stay.

    A null text stays null. Base spans (of the key word's assignment, its value alone) and
    random tokens that the battery finds are masked. ``n_chars``, if there, is counted anew.
    """
    least = thresholds(_cells(_scan(texts(docs))))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            out = [None if v is None else masked(v, least, mask) for v in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    small_batches(docs.sparkSession)
    done = docs.mapInArrow(clean, docs.schema)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def masked(text: str, least: dict[int, int], mask: str) -> str:
    """``text`` with its secrets masked, given the least cell of each band."""
    base = base_matches(text)
    spans = [x[3:] for x in base] + [x[1:3] for x in candidates(text, base) if x[4] >= least.get(x[3], CELLS)]
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(_count(k) for k, _ in BASE), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
