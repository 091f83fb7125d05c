"""op11, op12 and op13 against plain Python, and on odd rows."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import NASTY, docs, odd
from tidemark.llm import bpe, conversations, importance

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """Least (cost, audit) of all edit sequences, by a shortest-path search over (row, state), and its lines."""
    follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, k, state, lines = heapq.heappop(queue)
        if (k, state) in done:
            continue
        done.add((k, state))
        if k == len(rows) and state in ("", "a"):
            return cost, audit, "\n".join(lines)
        steps = []
        for role in ("user", "assistant"):
            if role[0] in follow[state]:
                steps.append((5, "I", k, role[0], (f"{role}:",)))
        if k < len(rows):
            role, text, fault = rows[k]
            more = 5 if fault == "truncated" else 0
            steps.append((2, "D", k + 1, state, ()))
            if fault not in ("blank", "duplicate"):
                if role[:1] in follow[state]:
                    steps.append((more, "K", k + 1, follow[state][role[:1]], (f"{role}:{text}",)))
                steps += [(1 + more, "R", k + 1, r[0], (f"{r}:{text}",)) for r in ("user", "assistant") if r[0] in follow[state]]
        for more, letter, at, to, new in steps:
            heapq.heappush(queue, (cost + more, audit + letter, at, to, lines + new))
    raise AssertionError


def plain_report(table):
    groups = defaultdict(list)
    for conv, turn, role, text in table:
        kept = groups[conv]
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(code, text)
        kept += [(turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    out = []
    for conv, rows in groups.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, judged = set(), []
        for _, role, text in rows:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = {t for t, _, _ in rows if t is not None}
        faults = Counter(f for _, _, f in judged)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
        cost, audit, text = cheapest(judged)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def report(spark, table, chunk_rows):
    frame = spark.createDataFrame(table, SCHEMA).withColumns({c: F.lit(7) for c in ("chunk", "copies", "entry", "g", "f", "at", "same")})
    rows = conversations.repair_report(frame, chunk_rows).collect()
    return sorted([tuple(r) for r in rows], key=str)


@pytest.mark.parametrize("chunk_rows", [4096, 3])
def test_repair_equals_a_shortest_path_search(spark, chunk_rows):
    draw = random.Random(5)
    roles, endings = ["system", "user", "assistant", "user", "assistant", "tool", "", None], [".", "!", "", " \n", "?", ". "]
    table = [(c, draw.choice([*range(9), None]), draw.choice(roles), draw.choice([f"text {draw.randrange(4)}{draw.choice(endings)}", "", " \t", None])) for c in range(60) for _ in range(draw.randrange(1, 9))]
    table += [(None, t, "user", "orphan.") for t in range(4)] + [(1000, t, ("user", "assistant")[t % 3 % 2], f"part {t % 17}." if t % 5 else "cut") for t in range(150)]
    table += [(1001, None, "user", None)] * 20 + [(1002, 5, "user", "again and again.")] * 30 + [(1003, t, "user", "x") for t in range(40)]
    assert report(spark, table, chunk_rows) == plain_report(table)


def test_repair_of_an_empty_table(spark):
    assert report(spark, [], 10) == []


def test_fix_up_passes_reach_what_one_chunk_gives(spark):
    table = [(7, t, "user" if t % 2 else "assistant", "cut") for t in range(300)] + [(8, t, "assistant", "Whole.") for t in range(300)]
    assert report(spark, table, 4) == report(spark, table, 4096)


def test_passes_grow_with_the_logarithm_of_the_chunks(spark, monkeypatch):
    """A long conversation whose rows must all go but the first hands the end's vector through every chunk."""
    passes, rerun = [], conversations._rerun
    monkeypatch.setattr(conversations, "_rerun", lambda *a: passes.append(1) or rerun(*a))
    monkeypatch.setattr(conversations, "WIDER", 4)
    table = [(7, 0, "user", "First.")] + [(7, t, "user", " ") for t in range(1, 400)] + [(7, 400, "assistant", "Last.")]
    assert report(spark, table, 3) == plain_report(table)
    assert len(passes) <= 6


def test_codec_equals_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    draw = random.Random(3)
    letters = list("aaabbcéÉİıſĸŉǅßΣςσAZ '’s  \t\n\x0b\x1c\x85\xa012½²ªº«»–…€́‍世界🙂") + ["<|endoftext|>", "<|startoftext|>", "'ll", "'S", "<|"]
    table = [(k, "".join(draw.choice(letters) for _ in range(draw.randrange(40)))) for k in range(400)]
    table += [*NASTY, (900, "a" * 5000), (901, "ab" * 50000), (902, "haha" * 3000), (903, "word " * 40000)]
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, text in table:
        ids = own.encode(text or "", add_special_tokens=False).ids
        decoded = own.decode(ids, skip_special_tokens=False)
        want.append(str((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())))
    assert sorted(str(tuple(r)) for r in bpe.digests(odd(spark, table)).collect()) == sorted(want)
    ids = {r.doc_id: (r.ids, r.decoded) for r in bpe.encoded(docs(spark, table[:50])).collect()}
    assert all(ids[i][0] == own.encode(t, add_special_tokens=False).ids for i, t in table[:50])


def test_codec_equals_the_library_on_the_given_documents(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in frame.collect()}
    for r in bpe.op12_bpe_codec(spark, "/root/testdata/sf0.001").collect():
        ids = own.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_codec_on_an_empty_table_and_with_few_remembered_pieces(spark, monkeypatch):
    assert bpe.digests(docs(spark, [])).count() == 0
    codec = bpe.Codec()
    want = list(codec.encode(["some words of a text", "and more words"]))
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    assert [x for t in ("some words of a text", "and more words") for x in codec.encode([t])] == want


def test_a_vocabulary_whose_merges_look_back_is_refused():
    words = {c: k for k, c in enumerate(["a", "b", "c", "a.", "b.", "c.", "ab", "abc.", "ab."])}
    with pytest.raises(ValueError):
        bpe.Merges(words, [("ab", "c."), ("a", "b")], ".", ["a", "b", "c"])


def plain_resample(table, target, percent, size, buckets, least, seed):
    def grams(text):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
        return len(words), [zlib.crc32(b" ".join(words[k : k + n])) % buckets for n in range(1, size + 1) for k in range(len(words) - n + 1)]

    source, wanted = Counter(b for _, t in table for b in grams(t)[1]), Counter(b for t in target for b in grams(t)[1])
    s_all, t_all = sum(source.values()) + buckets, sum(wanted.values()) + buckets
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * t / ((source[b] + 1) * w))) for b in range(buckets) for t, w in [(s_all, t_all)]]
    rows = []
    for i, text in table:
        words, found = grams(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words >= least])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(str(tuple(r[:5])) for r in rows)


@pytest.mark.parametrize("size", [1, 3])
def test_resampling_equals_plain_counts(spark, size):
    draw = random.Random(8)
    words = ["red", "Fox", "über", "x9", "the", "a", "--", "naïve", "世界", "\x00"]
    table = [(k % 190, " ".join(draw.choice(words) for _ in range(draw.randrange(12)))) for k in range(200)] + NASTY
    target = ["the red fox", None, "", "a naïve fox x9 the"]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "doc_id long, text string")
    got = importance.resample(odd(spark, table), bench, 30, size, 997, 4, 11).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_resample(table, target, 30, size, 997, 4, 11)


def test_resampling_of_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(docs(spark, []), empty).count() == 0
    assert [r["rank"] for r in importance.resample(docs(spark, [(1, "one two")]), empty, 100, least=1).collect()] == [1]
