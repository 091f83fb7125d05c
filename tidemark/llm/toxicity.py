"""Op3: a toxicity classifier that is regularised by counterfactuals.

A logistic model over the words that a text holds, and over the word beginnings that it
holds often for its length (languages inflect and compound their insults), is fitted on a bounded sample of
labelled documents. For every sampled document that names a group, copies are made in
which each identity term is swapped for others of its kind and language, or left out, and
the squared change of the score's logit is part of the loss: naming one group rather than
another, or any at all, must not move the score, whatever company such terms keep in the
labels. The bias is then set so that the score at which a document counts as toxic is where
models fitted on one half of the sample tell the other half's classes apart best.

Spark joins the sample, counts words by class and makes the feature lists; the fit itself
is on at most 2 * ``SAMPLE`` short lists of at most ``WORDS`` features. Every text is scored
whole where it is read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Container, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, staged, table, texts

#: Most labelled documents of each class that the model is fitted on, chosen by a hash of
#: doc_id; most words it uses; least documents of the sample a word is in.
SAMPLE, WORDS, LEAST = 6_000, 1_500, 4

#: Lengths of word beginnings; one counts as often from two words, and from one in so many, on.
BEGINNINGS, OFTEN = (4, 5, 6, 7), 128

#: Weight of the counterfactual penalty, of the squared weights (against the whole loss of all
#: documents), and rounds of the fit.
SWAP, RIDGE, ROUNDS = 5.0, 1.0, 400

#: The score from which a document counts as toxic; documents of a class that a half of the
#: sample holds at least where the bias is set by halves.
TOXIC, FEW = 0.7, 10

# Terms that name groups, by kind and language; swaps stay within both.
IDENTITY = {
    ("gender", "en"): "woman women man men girl girls boy boys female male transgender".split(),
    ("gender", "de"): "frau frauen mann männer mädchen junge jungen weiblich männlich".split(),
    ("gender", "fr"): "femme femmes homme hommes fille filles garçon garçons".split(),
    ("gender", "es"): "mujer mujeres hombre hombres niña niñas niño niños".split(),
    ("religion", "en"): "muslim muslims jew jews jewish christian christians catholic catholics hindu hindus buddhist atheist".split(),
    ("religion", "de"): "muslime muslimin jude juden christen katholiken protestanten hindus atheisten".split(),
    ("religion", "fr"): "musulmans musulmane juif juifs chrétien chrétiens catholique catholiques athées".split(),
    ("religion", "es"): "musulmanes musulmana judío judíos cristiano cristianos católico católicos ateos".split(),
    ("origin", "en"): "black white asian asians african africans european latino mexican arab immigrant immigrants refugees foreigners".split(),
    ("origin", "de"): "schwarze weiße asiaten afrikaner europäer araber türken ausländer flüchtlinge einwanderer".split(),
    ("origin", "fr"): "noir noirs blanc blancs asiatiques africains arabes étrangers réfugiés immigrés".split(),
    ("origin", "es"): "negro negros blanco blancos asiáticos africanos árabes extranjeros refugiados inmigrantes".split(),
    ("orientation", "en"): "gay lesbian bisexual straight queer heterosexual homosexual".split(),
    ("orientation", "de"): "schwule lesben bisexuelle heterosexuelle homosexuelle".split(),
    ("orientation", "fr"): "lesbiennes bisexuels hétérosexuels homosexuels".split(),
    ("orientation", "es"): "lesbianas bisexuales heterosexuales homosexuales".split(),
    ("ability", "en"): "disabled blind deaf autistic elderly old young".split(),
    ("ability", "de"): "behinderte blinde gehörlose autisten alte junge".split(),
    ("ability", "fr"): "handicapés aveugles sourds autistes vieux jeunes".split(),
    ("ability", "es"): "discapacitados ciegos sordos autistas ancianos jóvenes".split(),
}
KIND = {w: kind for kind, terms in reversed(IDENTITY.items()) for w in terms}

#: Copies of a document that names a group, besides the one that names none.
COPIES = 4

_WORD = re.compile(r"\w+")


def words_of(text: str, wanted: Container[str] | None = None) -> set[str]:
    """The text's words, and its frequent word beginnings, marked by ``~``; of ``wanted`` alone if given.

    Identity terms give no beginnings: the copies swap words, and a beginning would stay in them.
    """
    counts = Counter(_WORD.findall(text.lower()))
    found, starts = set(), Counter()
    for word, n in counts.items():
        if wanted is None or word in wanted:
            found.add(word)
        if word in KIND:
            continue
        for size in BEGINNINGS:
            if len(word) >= size:
                start = word[:size] + "~"
                if wanted is None or start in wanted:
                    starts[start] += n
    if starts:
        least = max(2, counts.total() / OFTEN)
        found.update(x for x, n in starts.items() if n >= least)
    return found


def swapped(words: set[str]) -> list[set[str]]:
    """The words without identity terms, and with each turned into others of its kind; none if there are none."""
    named = {w for w in words if w in KIND}
    if not named:
        return []
    copies = [words - named]
    for k in range(1, COPIES + 1):
        turned = set()
        for w in named:
            terms = [x for x in IDENTITY[KIND[w]] if KIND[x] == KIND[w]]
            turned.add(terms[(terms.index(w) + -(-k * (len(terms) - 1) // COPIES)) % len(terms)])
        copies.append((words - named) | turned)
    return copies


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]

    def score(self, text: str) -> float:
        if not text:
            return _sigmoid(self.bias)
        return _sigmoid(self.bias + sum(self.weights[w] for w in words_of(text, self.weights)))


def _sigmoid(z: float) -> float:
    return 1 / (1 + float(np.exp(-np.clip(z, -40, 40))))


def held_out(doc_id: str) -> Column:
    """True where a row's label must not be learned from; a null doc_id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """(text, toxic, words) of the sample, and how many usable labels each class has."""
    usable = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("toxic in (0, 1)").where(~held_out("doc_id"))
    usable = usable.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    total = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = usable.where("toxic = 1").orderBy(*order).limit(sample).unionByName(usable.where("toxic = 0").orderBy(*order).limit(sample))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [sorted(words_of(x.as_py())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.string())), batch.column(2)], ["toxic", "words", "mark"])

    # At most 2 * sample labels are broadcast. Equal texts count once, by the label that most of them have.
    found = texts(docs).join(F.broadcast(chosen), "doc_id").select("toxic", "text", F.xxhash64("text").alias("mark"))
    found = found.mapInArrow(split, "toxic int, words array<string>, mark long").groupBy("mark").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"), F.first("words").alias("words"))
    return staged(found.where("2 * bad <> n").select((2 * F.col("bad") > F.col("n")).cast("int").alias("toxic"), "words", "mark"), "toxicity-sample"), total


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, n_words: int = WORDS, least: int = LEAST, swap: float = SWAP) -> Model:
    """Fit on usable labels (doc_id, toxic); without both classes the score is a constant."""
    found, total = sampled(docs, labels, sample)
    size = {r.toxic: r.n for r in found.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = size.get(1, 0), size.get(0, 0)
    if not bad or not good:
        return Model(float(np.log((total.get(1, 0) + 1) / (total.get(0, 0) + 9))), {})
    counts = found.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    expected = (F.col("bad") + F.col("good")) * (bad / (bad + good))
    z = F.abs(F.col("bad") - expected) / F.sqrt(expected * (good / (bad + good)))
    terms = [r.word for r in counts.where(F.col("bad") + F.col("good") >= least).orderBy(z.desc(), "word").limit(n_words).collect()]
    terms = sorted({*terms, *KIND})
    index = {w: k for k, w in enumerate(terms)}
    held = F.array_intersect("words", F.array(*(F.lit(w) for w in terms)))
    rows = found.select("toxic", held.alias("words"), "mark").orderBy("mark").collect()
    x, y = _matrix([set(r.words) for r in rows], index), np.array([r.toxic for r in rows], float)
    # What swapping changes is identity terms alone, so copies are kept as differences over those columns.
    named = np.array([index[w] for w in sorted(KIND)])
    place = {w: k for k, w in enumerate(sorted(KIND))}
    copies = [(k, c) for k, r in enumerate(rows) for c in swapped(set(r.words))]
    change = x[[k for k, _ in copies]][:, named] - _matrix([c for _, c in copies], place)
    of = np.array([k for k, _ in copies], int)
    weight = np.where(y == 1, total[1] / bad, total[0] / good)
    weight = weight / weight.mean()

    def part(keep: np.ndarray) -> tuple[float, np.ndarray]:
        return _descend(x[keep], y[keep], weight[keep], change[keep[of]], named, swap)

    everything = np.ones(len(y), bool)
    bias, w = part(everything)
    half = np.arange(len(y)) % 2 == 0
    if min(y[half].sum(), y[~half].sum(), (1 - y[half]).sum(), (1 - y[~half]).sum()) >= FEW:
        logits = np.zeros(len(y))
        for keep in (half, ~half):
            b, v = part(keep)
            logits[~keep] = x[~keep] @ v.astype(np.float32) + b
        bias += float(np.log(TOXIC / (1 - TOXIC))) - best_cut(logits, y, weight)
    return Model(bias, {t: float(v) for t, v in zip(terms, w, strict=True) if abs(v) > 1e-4})


def best_cut(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The logit from which on counting as toxic gives the best F1, midway to the next one below."""
    order = np.argsort(-logits, kind="stable")
    hit = np.cumsum((weight * y)[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + (weight * y).sum())
    last = np.append(logits[order][1:] != logits[order][:-1], True)  # a cut falls between different logits
    k = int(np.argmax(np.where(last, f1, -1)))
    below = logits[order][k + 1] if k + 1 < len(order) else logits[order][k] - 1
    return float((logits[order][k] + below) / 2)


def _matrix(lists: list[set[str]], index: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(lists), len(index)), np.float32)
    for k, words in enumerate(lists):
        for word in words:
            if word in index:
                out[k, index[word]] = 1
    return out


def _descend(x: np.ndarray, y: np.ndarray, weight: np.ndarray, change: np.ndarray, named: np.ndarray, swap: float) -> tuple[float, np.ndarray]:
    """Adam on the weighted logistic loss plus the counterfactual and ridge penalties.

    ``change`` holds what swaps change, over the columns ``named``.
    """
    n, w, bias = len(y), np.zeros(x.shape[1]), 0.0
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, ROUNDS + 1):
        small = w.astype(np.float32)
        p = 1 / (1 + np.exp(-np.clip(x @ small + bias, -40, 40)))
        miss = (weight * (p - y) / n).astype(np.float32)
        gradient = np.append(x.T @ miss + RIDGE / n * w, miss.sum())
        if len(change):
            gradient[named] += 2 * swap * (change.T @ (change @ small[named])) / len(change)
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - float(move[-1])
    return bias, w


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; null and empty texts get the score of no words."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return texts(docs).mapInArrow(score, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, least: float = TOXIC) -> DataFrame:
    """The rows, with all their columns, whose text scores below ``least``."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_ = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([model.score(x or "") < least for x in texts_], pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, least: float = TOXIC) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Labels are learned from rows whose crc32(doc_id as text) mod 3 is not 1 alone; null
    labels are passed over, a repeated one counts once, and a doc_id whose labels disagree
    counts not at all; nor do equal texts that half of their labels call toxic. Repeated documents are scored
    each; a null doc_id is held out; empty documents give no rows.
    """
    found = scored(docs, fit(docs, labels))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
