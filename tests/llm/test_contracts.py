"""op8 and op9 as registered, on the given documents, against plain Python."""

import hashlib
import re
from collections import defaultdict

import pytest

from tests.llm.helpers import docs
from tidemark.llm import pii, queries

SF = "/root/testdata/sf0.001"

PERSONAL = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
SECRETS = {"assign": r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def personal_base(text):
    return [(kind, m.start(), m.end()) for kind, p in PERSONAL.items() for m in re.finditer(p, text) if valid(kind, m.group())]


def personal_tokens(text, base):
    """(start, end, instance, pattern, seed) of identifier tokens, token by token."""
    out, before = [], ""
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        t = m.group()
        if "@" in t or sum(c in "0123456789" for c in t) >= 5:
            lead = len(t) - len(re.sub(r"^[\"'(\[{*#$%&|<>]+", "", t))
            bare = re.sub(r"[.,;:!?\"')\]}*#$%&|<>]+$", "", t[lead:])
            seed = any(a < m.end() and b > m.start() for _, a, b in base)
            if len(bare) >= 5:
                out.append((m.start() + lead, m.start() + lead + len(bare), bare, re.sub("[0-9]+", "", before).lower() or "^", seed))
        before = t
    return out


def trusted_patterns(tokens, rounds=3):
    edges = defaultdict(lambda: [0, False])
    for _, _, instance, pattern, seed in tokens:
        e = edges[pattern, instance]
        e[0], e[1] = e[0] + 1, e[1] or seed
    seeds = defaultdict(bool)
    for (_, i), (_, s) in edges.items():
        seeds[i] |= s
    trust = {i: float(s) for i, s in seeds.items()}
    for _ in range(rounds):
        top, all_ = defaultdict(float), defaultdict(int)
        for (p, i), (n, _) in edges.items():
            top[p] += n * trust[i]
            all_[p] += n
        score = {p: top[p] / (all_[p] + 1) for p in all_}
        doubt = defaultdict(lambda: 1.0)
        for p, i in edges:
            doubt[i] *= 1 - min(score[p], 0.999999)
        trust = {i: max(float(seeds[i]), 1 - doubt[i]) for i in doubt}
    return {p for p, s in score.items() if s >= 0.8}


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_personal_data_as_registered(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    base = {d: personal_base(t) for d, t in texts.items()}
    tokens = {d: personal_tokens(t, base[d]) for d, t in texts.items()}
    trusted = trusted_patterns([x for ts in tokens.values() for x in ts])
    join = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    rows = queries.QUERIES["op9_personal_data"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        b = base[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in b) for x in PERSONAL]
        assert r.base_sha256 == hashlib.sha256(join(b).encode()).hexdigest()
        more = sorted({("context", s, e) for s, e, _, p, seed in tokens[r.doc_id] if p in trusted and not seed}, key=lambda x: x[1:])
        assert r.spans == join(b + more)


def test_secrets_as_registered(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    least = {"assign": 6, "access": 20, "hex": 24}
    for r in queries.QUERIES["op8_secret_scan"](spark, SF).collect():
        base = sorted((m.start(), o, m.end(), k) for o, (k, p) in enumerate(SECRETS.items()) for m in re.finditer(p, texts[r.doc_id]) if len(m.group(2 if k == "assign" else 0)) >= least[k])
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[3] == k for x in base) for k in SECRETS]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and (r.spans == text or set(text.split(",")) - {""} < set(r.spans.split(",")))


def test_personal_data_is_linear_in_long_texts(spark):
    import time

    def run(n):
        text = " ".join(f"{k * 7919 % 900000 + 100000}" for k in range(n)) + " 1.2.3.4"
        began = time.perf_counter()
        row = pii.with_candidates(pii.base_spans(docs(spark, [(1, text)]).selectExpr("doc_id", "text", "1L as row"))).first()
        assert [(x.kind, x.start, x.end) for x in row.base] == personal_base(text)
        assert [(x.start, x.end, x.instance, x.pattern, x.seed) for x in row.tokens] == personal_tokens(text, personal_base(text))[: len(row.tokens)]
        return time.perf_counter() - began

    run(10)
    few, many = run(4000), run(32000)
    assert many < 8 * few + 10  # the squared cost of before took minutes


def test_overlaps_decide_seeds(spark):
    texts = ["+49 30 1234567 8 x@y.de,1.2.3.4 4111 1111 1111 1111 id12345", "12345 12345 12345", "a@b.c" * 3, None, "", "  99999", "(12345) \"x@y.zz\"; tel 12345"]
    found = pii.with_candidates(pii.base_spans(pii.texts(docs(spark, list(enumerate(texts)))).selectExpr("doc_id as row", "doc_id", "text"))).collect()
    for r in found:
        t = texts[r.doc_id] or ""
        assert [(x.start, x.end, x.instance, x.pattern, x.seed) for x in r.tokens] == personal_tokens(t, personal_base(t))
