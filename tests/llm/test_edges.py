"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import NASTY, docs, odd
from tidemark.llm import decontamination, html_text, near_dedup, packing, pii, quality, secrets, suffix_dedup, tokens, toxicity

BENCHMARK = [(1, "the quick brown fox jumps over the lazy dog near the river bank"), (2, None), (3, "short")]


def run(spark, name, frame):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 1), (4, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame(BENCHMARK, "item_id long, text string")
    return {
        "suffix": lambda: suffix_dedup.remove_repeats(frame),
        "pack": lambda: packing.pack(frame, 64),
        "toxicity": lambda: toxicity.toxicity(frame, labels),
        "quality": lambda: quality.quality(frame),
        "near": lambda: near_dedup.near_duplicates(frame),
        "lengths": lambda: tokens.length_histogram(frame),
        "secrets": lambda: secrets.find_secrets(frame),
        "redact": lambda: secrets.redact(frame),
        "pii": lambda: pii.find_personal_data(frame),
        "decontamination": lambda: decontamination.contaminated(frame, benchmark),
    }[name]()


PER_ROW = ["suffix", "toxicity", "quality", "near", "secrets", "redact", "pii"]


@pytest.mark.parametrize("name", [*PER_ROW, "pack", "lengths", "decontamination"])
def test_nasty_rows(spark, name):
    rows = run(spark, name, odd(spark, NASTY)).collect()
    if name in PER_ROW:
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in NASTY)
    if name == "pack":
        assert {(r.doc_id, r.piece) for r in rows} >= {(1, 0), (2, 0), (None, 0)}
    if name == "lengths":
        assert sum(r.n_docs for r in rows) == len(NASTY)


@pytest.mark.parametrize("name", [*PER_ROW, "pack", "lengths", "decontamination"])
def test_empty_table(spark, name):
    assert run(spark, name, docs(spark, [])).count() == 0


def test_pages_edges(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p>Hi"), (3, "u", "<p>Hi"), (None, "u", "&lt;b&gt;")], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    rows = html_text.extract(pages).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in rows) == [("1", "", 0), ("2", "", 0), ("3", "Hi", 2), ("3", "Hi", 2), ("None", "<b>", 3)]
    assert html_text.extract(pages.limit(0)).count() == 0
