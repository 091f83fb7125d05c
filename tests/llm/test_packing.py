import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.helpers import docs
from tidemark.llm import packing, tokens

TEXTS = ["", "Hello, world!", "it's we're <|endoftext|> x", "tabs\tand\n\nlines  \n", "Ünïcode ß ñ 世界 \U0001f600 ٣٤", "a" * 3000, "word " * 900, "1234567 12.5% ...!!", "\x1c\x1d odd   spaces   end "]


def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_the_library():
    lib, own, rng = library(), tokens.Encoder(), random.Random(2)
    cases = TEXTS + ["".join(rng.choices("abcDEÉñß'sstre 0123.,;!?\n\t  -", k=200)) for _ in range(300)]
    for text in cases:
        assert own.ids(text) == np.array(lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_pack_is_an_exact_round_trip(spark):
    lib, capacity = library(), 64
    rows = packing.pack(docs(spark, list(enumerate(TEXTS))), capacity).collect()
    by_doc, sequences = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, text in enumerate(TEXTS):
        ids = np.array([*lib.encode(text, add_special_tokens=False).ids, tokens.END_ID], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == capacity or k == 0
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity


def best_fit(histogram, capacity):
    """Sequences of best fit decreasing, a piece at a time: the fullest open sequence that has room takes it."""
    open_ = [0] * (capacity + 1)  # sequences by their room
    made = 0
    for x in sorted(histogram, reverse=True):
        for _ in range(histogram[x]):
            room = next((r for r in range(x, capacity + 1) if open_[r]), None)
            if room is None:
                made, room = made + 1, capacity
            else:
                open_[room] -= 1
            open_[room - x] += 1
    return made


def counted(lengths):
    histogram = {}
    for x in lengths:
        histogram[x] = histogram.get(x, 0) + 1
    return histogram


def holds_each_piece_once(made, histogram, capacity):
    used = {}
    for times, config in made:
        assert times > 0 and sum(x * n for x, n in config) <= capacity
        for x, n in config:
            used[x] = used.get(x, 0) + times * n
    return used == histogram


def test_the_program_packs_every_piece_and_is_no_worse_than_best_fit():
    rng = random.Random(4)
    for lengths in ([350, 400, 300, 511, 600, 424], range(1, 1025), [1024], [700], [513, 511, 1], range(200, 420)):
        histogram = counted(rng.choices(list(lengths), k=3000))
        made, bound = packing.solved(histogram, 1024)
        assert holds_each_piece_once(made, histogram, 1024)
        assert bound <= sum(t for t, _ in made) <= best_fit(histogram, 1024)
    assert packing.solved({}, 1024) == ([], 0)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_the_program_on_the_given_documents(spark, sf):
    """The shipped plan, for the table and for a hundred of it, against best fit and the dual bound."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    lengths = [r.n_ids + 1 for r in tokens.encoded_lengths(docs).collect()]
    histogram = counted([n % 1024 or 1024 for n in lengths] + [1024 for n in lengths for _ in range((n - 1) // 1024)])
    for times in (1, 100) if sf == "sf0.01" else (1,):
        many = {x: n * times for x, n in histogram.items()}
        made, bound = packing.solved(many, 1024)
        assert holds_each_piece_once(made, many, 1024)
        assert bound <= sum(t for t, _ in made) <= min(best_fit(many, 1024), bound * 1.005 + 2)


def test_the_knapsack_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 30), 4))
        counts, weights = [rng.randint(1, 4) for _ in lengths], np.array([rng.random() for _ in lengths])
        value, config = packing.price(weights, lengths, counts, 40)
        every = [[]]
        for n in counts:
            every = [[*x, k] for x in every for k in range(n + 1)]
        best = max(sum(w * k for w, k in zip(weights, x)) for x in every if sum(a * k for a, k in zip(lengths, x)) <= 40)
        assert abs(value - best) < 1e-9 and all(n <= counts[k] for k, n in config.items())
        assert abs(sum(weights[k] * n for k, n in config.items()) - value) < 1e-9 and sum(lengths[k] * n for k, n in config.items()) <= 40


def test_length_histogram_answers_every_limit(spark):
    texts = [t for t in TEXTS for _ in range(3)]
    lib = library()
    lengths = [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]
    found = tokens.length_histogram(docs(spark, list(enumerate(texts)))).cache()
    for r in found.collect():
        assert r.n_docs == lengths.count(r.length)
        assert r.docs_longer == sum(x > r.length for x in lengths) and r.tokens_longer == sum(x for x in lengths if x > r.length)
        assert r.docs_up_to == len(lengths) - r.docs_longer and r.tokens_up_to == sum(lengths) - r.tokens_longer
        assert r.truncated_tokens == sum(min(x, r.length) for x in lengths)
        assert abs(r.quantile - r.docs_up_to / len(lengths)) < 1e-12
    assert tokens.truncated_total(found, 50) == sum(min(x, 50) for x in lengths)
    assert tokens.length_quantile(found, 0.5) == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
