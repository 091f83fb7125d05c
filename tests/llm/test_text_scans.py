import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import docs
from tidemark.llm import decontamination, html_text, pii, quality, secrets, toxicity


def noise(rng, alphabet, n):
    return "".join(rng.choices(alphabet, k=n))


def test_personal_data_base_spans(spark):
    rng = random.Random(3)
    bits = ["a.b@c.de", "x@y", "q@w.e.r_t@u.io", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (487) 555-7209", "+49 30 1234567.", "+5", "12345678901234567890", "é世", "\U0001f600", " ", "\n"]
    texts = ["".join(rng.choices([*bits, *"0123456789.-+@ ab"], k=40)) for _ in range(150)] + [None, "", "a" * 3000, "1." * 2000, "+1" * 2000, "9" * 4000]
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(m):
        d = [int(c) for c in re.sub("[^0-9]", "", m)]
        return 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(reversed(d))) % 10 == 0

    valid = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": luhn, "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15}
    rows = {r.doc_id: r for r in pii.find_personal_data(docs(spark, list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        want = [(kind, m.start(), m.end()) for kind, p in kinds.items() for m in re.finditer(p, t or "") if valid[kind](m.group())]
        assert [(x.kind, x.start, x.end) for x in rows[k].base] == want, t
        assert [(x.kind, x.start, x.end) for x in rows[k].spans][: len(want)] == want


def test_bootstrapping_discovers_unseen_identifiers(spark):
    texts = [f"words here reach: user{k}@mail.example.com and more" for k in range(40)]
    texts += ["some text reach: user#99887766 then", "the year 19998888 is plain"]
    rows = {r.doc_id: r for r in pii.find_personal_data(docs(spark, list(enumerate(texts)))).collect()}
    assert [x.kind for x in rows[40].spans] == ["context"] and not rows[41].spans
    x = rows[40].spans[0]
    assert texts[40][x.start : x.end] == "user#99887766"


def test_bootstrapping_needs_some_five_seeds(spark):
    texts = []
    for n, word in ((3, "three"), (5, "five"), (10, "ten"), (19, "nineteen")):
        texts += [f"words here {word}: user{k}@mail.example.com and more" for k in range(n)] + [f"some text {word}: {word}#99887766 then"]
    texts += [f"the mixed: m{k}@mail.example.com and" for k in range(5)] + [f"the mixed: {k}9998877 and" for k in range(8)]
    rows = pii.find_personal_data(docs(spark, list(enumerate(texts)))).collect()
    found = [texts[r.doc_id][x.start : x.end] for r in rows for x in r.spans if x.kind == "context"]
    assert sorted(found) == ["five#99887766", "nineteen#99887766", "ten#99887766"]


def test_quality_measures_and_order(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["a", "b", "cc#", "d\n", "e"], k=rng.randint(0, 120))) for _ in range(60)] + [None, "", "x\nx\nx\n \n"]
    rows = {r.doc_id: r for r in quality.quality(docs(spark, list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = rows[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and (not r.base_failed or not r.kept)
    frame = docs(spark, list(enumerate(texts)))
    for sample in (quality.measured(frame, quality.BASE.needs), quality.measured(frame)):
        found = quality.ordered(sample)
        worth = [share / cost for _, cost, share in found]
        assert worth == sorted(worth, reverse=True) and {r for r, _, _ in found} == set(quality.RULES)
    verdicts = [{r.doc_id: r.kept for r in f(frame, rules).collect()} for f in (quality.quality, quality.verdicts) for rules in (quality.RULES, quality.RULES[::-1])]
    assert all(v == verdicts[0] for v in verdicts)


def test_quality_costs_are_of_the_rules_themselves(spark):
    """Repeated windows cost far more than a pattern, and the cheap rule that rejects as much goes first."""
    frame = docs(spark, [(k, " ".join(f"w{(k * j) % 97}" for j in range(400)) + " AA" * 900) for k in range(300)])
    sample = quality.staged(quality.measured(frame, ["n_words"]), "few")
    found = {r.name: (cost, share) for r, cost, share in quality.ordered(sample, repeats=20)}
    assert found["repeated_windows"][0] > 1.5 * found["shouting"][0] and found["shouting"][1] == 1
    order = [r.name for r, _, _ in quality.ordered(sample, repeats=20)]
    assert order.index("shouting") < order.index("repeated_windows")


def test_quality_samples_before_it_measures(spark):
    few = quality.sampled(docs(spark, [(k, f"text {k}") for k in range(5000)]))
    assert 300 < few.count() < 800
    plan = quality.measured(few)._jdf.queryExecution().executedPlan().toString().split("\n")
    assert next(k for k, x in enumerate(plan) if "Sample" in x) > next(k for k, x in enumerate(plan) if "n_repeat_words" in x)  # the sample is below
    plan = quality.verdicts(docs(spark, [(1, "a b c")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_secret_base_spans_and_redaction(spark):
    rng = random.Random(8)
    random_key = noise(rng, secrets.ALPHABETS["base64"], 64)
    texts = [
        'password = "hunter22" and API_KEY:abc', "AKIA" + "Z" * 16 + " AKIAshort", "0" * 23 + "g" + "ab12" * 8, 'toKen="' + "a1" * 20 + '"',
        "ſecret=longenough secret=longenough", f"key {random_key} end", "antidisestablishmentarianismantidis words", None, "",
    ]
    patterns = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+"))]
    rows = {r.doc_id: r for r in secrets.find_secrets(docs(spark, list(enumerate(texts)))).collect()}
    for k, t in enumerate(texts):
        want = sorted((m.start(), o, m.end(), kind) for o, (kind, p) in enumerate(patterns) for m in p.finditer(t or "") if len(m.group(2 if kind == "assign" else 0)) >= secrets.LEAST[kind])
        assert [(x.start, x.end, x.kind) for x in rows[k].base] == [(a, b, kind) for a, _, b, kind in want]
        assert {(x.kind, x.start, x.end) for x in rows[k].base} <= {(x.kind, x.start, x.end) for x in rows[k].spans}
    assert [x.kind for x in rows[5].spans] == ["random_base64"] and not rows[6].spans
    clean = {r.doc_id: r for r in secrets.redact(docs(spark, list(enumerate(texts)))).collect()}
    assert clean[0].text == 'password = "[SECRET]" and API_KEY:abc' and clean[5].text == "key [SECRET] end"
    assert clean[6].text == texts[6] and clean[7].text is None and clean[0].n_chars == len(clean[0].text)


def test_battery_tells_random_from_text():
    rng = random.Random(1)
    randoms = [secrets.battery(noise(rng, secrets.ALPHABETS["hex"], 40)) for _ in range(200)]
    assert sum(min(x[2:]) > secrets.ACCEPT for x in randoms) > 180 and sorted(x[1] for x in randoms)[180] < 1e-6
    words = [secrets.battery("".join(rng.choices(["the", "tion", "and", "ing", "ent"], k=12))) for _ in range(200)]
    assert sorted(x[1] for x in words)[5] > 1e-3


def test_planted_keys_are_found_among_joined_words():
    """Recall by encoding and band of lengths, and false discoveries among words of four languages joined as names."""
    from collections import Counter

    rng = random.Random(7)
    prose = "the of and that with from which water people house nicht einer durch schreiben gegen wissen zwischen dans avec cette pourquoi maison toujours para como desde ciudad siempre nuestro".split()
    joins = (lambda w: "".join(w), lambda w: "".join(x.capitalize() for x in w), lambda w: "_".join(w), lambda w: "".join(w).upper(), lambda w: "-".join(w))
    items = [(None, x) for _ in range(1500) if len(x := rng.choice(joins)([rng.choice(prose) for _ in range(rng.randint(4, 14))])) >= 20]
    items += [(name, noise(rng, secrets.ALPHABETS[name], n)) for name in ("hex_upper", "base32", "base36", "base64") for n in (24, 32, 48, 72, 100, 160) for _ in range(25)]
    rows = [(name, x[3], x[4]) for name, token in items for x in secrets.candidates(token, secrets.base_matches(token))]
    least = secrets.thresholds([(b, c, n) for (b, c), n in Counter((b, c) for _, b, c in rows).items()])
    found, all_ = Counter(), Counter()
    for name, band, cell in rows:
        all_[name, band] += 1
        found[name, band] += cell >= least.get(band, secrets.CELLS)
    share = lambda names, bands: sum(found[n, b] for n in names for b in bands) / sum(all_[n, b] for n in names for b in bands)
    assert share(["hex_upper"], range(5)) > 0.9 and share(["base32", "base36", "base64"], (3, 4)) > 0.9
    assert share(["base36", "base64"], [2]) > 0.75 and share(["base32"], [2]) > 0.3
    false = sum(found[None, b] for b in range(5))
    assert false <= 0.02 * sum(found.values())


def test_many_spans_and_candidates_take_linear_time():
    import time

    text = " ".join(f"secret={k:08d} {'ab' * 11}{k % 10}zq" for k in range(20000))
    began = time.perf_counter()
    base = secrets.base_matches(text)
    assert len(base) == 20000 and len(list(secrets.candidates(text, base))) == 20000
    assert time.perf_counter() - began < 20
    tie = "secret=" + "ab12" * 8  # an assignment and a hexadecimal run that overlap: both stay
    assert [x[2] for x in secrets.base_matches(tie)] == ["assign", "hex"] and not list(secrets.candidates(tie, secrets.base_matches(tie)))


def edit_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_against_the_table():
    rng = random.Random(2)
    for _ in range(400):
        p, t = noise(rng, "abc", rng.randint(1, 70)), noise(rng, "abc", rng.randint(0, 90))
        assert decontamination.Myers(p).best(t)[0] == edit_distance(p, t)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(7)
    word = lambda: noise(rng, "abcdefgh", rng.randint(2, 7))
    items = [" ".join(word() for _ in range(rng.randint(10, 40))) for _ in range(12)]
    texts = [None, ""]
    for k in range(60):
        item, edits = list(rng.choice(items)), rng.choice([0, 0, 1, 2, 5, 9, 30])
        for _ in range(edits):
            item[rng.randrange(len(item))] = rng.choice("xyz \n")
        texts.append(" ".join([word() for _ in range(20)]) + " " + "".join(item).upper() + "  " + word())
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontamination.contaminated(docs(spark, list(enumerate(texts))), benchmark).collect()}
    want = {}
    for i, t in enumerate(texts):
        for j, item in enumerate(items):
            p = decontamination.normalised(item)
            d = edit_distance(p, decontamination.normalised(t or ""))
            if d <= decontamination.pieces(p)[0]:
                want[i, j] = d
    assert got == want and len(want) > 20
    two_passes = decontamination.contaminated(docs(spark, list(enumerate(texts))), benchmark, items_a_pass=5)
    assert {(r.doc_id, r.item_id): r.distance for r in two_passes.collect()} == want


def test_short_items_are_found_whole(spark):
    items = ["What is the capital of  France?", "2+2", "Yes", "naïve", " ", None, "What is the capital of France and of all its provinces today?"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = ["Q: what is the\ncapital of FRANCE? A: Paris", "what is the capital of franced?", "is 12+2 or 2+23; 2+2", "eyes yesterday", "Oh yes!", "naïvely", "x naïve", "", None]
    want = {(0, 0), (2, 1), (4, 2), (6, 3)}
    for a_pass in ({}, {"characters_a_pass": 30}, {"items_a_pass": 2}):
        rows = decontamination.contaminated(docs(spark, list(enumerate(texts))), benchmark, **a_pass).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want and all(r.distance == r.budget == 0 for r in rows)
    assert {(r.doc_id, r.item_id): r.match_end for r in rows}[0, 0] == len("q: what is the capital of france?")


def test_items_of_one_id_are_all_looked_for(spark):
    items = [(1, "the quick brown fox jumps over the lazy dog near the river"), (1, "a wholly other question about the mountains of the north"), (None, "what follows has no identifier, and is looked for all the same"), (None, "this one has none either but says something else again"), (1, "short")]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(3))
    texts = [(k, f"before {t} after") for k, (_, t) in enumerate(items)] + [(9, "nothing"), (10, f"{items[0][1]} {items[1][1][:-1]}")]
    for a_pass in ({}, {"items_a_pass": 1}):
        found = {(r.doc_id, r.item_id): (r.distance, r.budget) for r in decontamination.contaminated(docs(spark, texts), benchmark, **a_pass).collect()}
        assert found == {(0, 1): (0, 2), (1, 1): (0, 2), (2, None): (0, 3), (3, None): (0, 2), (4, 1): (0, 0), (10, 1): (0, 2)}


PAGE = """<html><head><title>T</title><script>var a = "<p>x</p>";</script><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies on this site for many good reasons.</p></div>
<div id="content"><h2>Title</h2><p>First  <b>bold</b> &amp; more&nbsp;text.</p><div class="ad">Buy now!</div><p>Short.</p><ul><li>one<li>two</ul>
<p>Last paragraph <!-- hidden --> here.</p></div><form><input name=q><label>Search</label></form><section class="comments"><p>First comment!</p></section>
<aside><p>Related things to read next.</p></aside><footer>&copy; someone</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title\nFirst bold & more text.\nShort.\none\ntwo\nLast paragraph here."
    assert html_text.main_text("<nav>Menu<article><p>Text that matters.") == "Text that matters."
    assert html_text.main_text("plain & simple") == "plain & simple"
    assert html_text.regions([0, 5, 0, 0, 0, 9, 9, 0, 9, 0, 0, 0]) == [(1, 2), (5, 9)]


def test_main_text_is_whole_around_notices_and_wrappers():
    story = ["A title of the story", "The lead of the story tells what has happened.", "Its body goes on, sentence after sentence, and says much more. " * 3]
    title, lead, body = story[0], story[1], story[2].strip()
    page = f"<body><div><ul><li><a href=/>Home</a><li><a href=/a>About us all</a></ul></div><h1>{title}</h1><p>{lead}</p><div class='ad'><p>Buy</p></div><p>{body}</p><div class=links><a href=/x>One</a></div></body>"
    assert html_text.main_text(page).split("\n") == [title, lead, body]
    inner = f"<h1>{title}</h1><p>{lead}</p>"
    for tag in ("div class='layout has-sidebar'", "div class='content no-comments'", "div class='post sidebar-open'"):
        assert html_text.main_text(f"<div {tag[4:]}>{inner}<p>{body}</p></div>").split("\n") == [title, lead, body]
    for wrapper in ("div class=widget", "div class=overlay", "aside"):
        assert html_text.main_text(f"<{wrapper}><p>Notice</p><article>{inner}</article><p>Notice</p></{wrapper.split()[0]}>").split("\n") == [title, lead]
    teaser = f"<div class=related><article><p>Another story.</p></article></div>"
    assert html_text.main_text(f"<main>{inner}</main>{teaser}").split("\n") == [title, lead]
    assert html_text.main_text(f"<article>{inner}{teaser}<p>{body}</p></article>").split("\n")[:2] == [title, lead]
    for name in ("cookie-notice", "ad ad-slot-2", "site-header", "main_nav", "sidebar"):
        assert html_text.boilerplate(name)
    for name in ("has-sidebar", "content", "main", "post", "with-comments layout", "loading", "", "page-1"):
        assert not html_text.boilerplate(name)


def test_main_text_of_hard_pages():
    body = "The body of the story goes on, sentence after sentence, and says much more than a menu does. " * 3
    m = html_text.main_text
    assert m("<p>text <span class='ad'>BUY NOW</span> end</p>") == "text end"
    assert m("<p>text <span hidden>secret</span> <b>bold</b> end</p><p>more<i style='display: none'>x</i></p>") == "text bold end\nmore"
    assert m(f"<body><nav><a href=/>Home</a></nav><div class='post tags'><h1>Title</h1><p>{body}</p></div><div class=ad>Buy</div></body>") == f"Title\n{body.strip()}"
    assert m(f"<div><h1>Title</h1><p>{body}</p><p>Short.</p></div><div>All rights reserved</div>") == f"Title\n{body.strip()}\nShort."
    skipped = "<div class=ad><p>Buy</p></div><aside>x</aside><form><p>Name</p></form>" * 3
    assert m(f"<div id=c><p>{body}</p>{skipped}<p>The end.</p></div><div>Imprint</div>") == f"{body.strip()}\nThe end."
    assert m(f"<form id=aspnet><div><p>{body}</p></div><label>Search</label></form>") == body.strip()
    assert m(f"<div><p>{body}</p></div><section class=comments>{'<p>I think that this is wrong, all of it.</p>' * 40}</section>") == body.strip()
    assert m("<ul><li><a href=/>One</a><li><a href=/>Two</a></ul>") == "One\nTwo"  # nothing but links: all of it
    deep = "<div>" * 3000 + f"<p>{body}</p>" + "</div>" * 3000 + "</nosuch>" * 3000
    assert m(deep) == body.strip()


def labelled_page(rng):
    """A page without a telling name or tag, and its article's blocks."""
    word = lambda: noise(rng, "abcdefghilmnoprstu", rng.randint(2, 9))
    text = lambda n: " ".join(word() for _ in range(n)).capitalize()
    links = lambda n: "".join(f"<li><a href='/{k}'>{text(rng.randint(1, 3))}</a></li>" for k in range(n))
    blocks = [("h1", text(rng.randint(3, 8)))]
    for _ in range(rng.randint(3, 12)):
        kind = rng.choices(["p", "h2", "ul"], [8, 1, 1])[0]
        if kind == "ul":
            blocks += [("li", text(rng.randint(3, 12))) for _ in range(rng.randint(2, 4))]
        else:
            blocks.append((kind, text(rng.randint(2, 5) if kind == "h2" or rng.random() < 0.2 else rng.randint(20, 90)) + "."))
    blocks.append(("p", text(rng.randint(25, 60)) + "."))
    inner = "".join(f"<{k}>{t}</{k}>" for k, t in blocks)
    top = f"<div><div>{text(2)}</div><ul>{links(rng.randint(3, 9))}</ul></div>"
    side = f"<div><ul>{links(rng.randint(3, 8))}</ul><div>{text(rng.randint(3, 9))}</div></div>"
    foot = f"<div><div>{text(rng.randint(3, 8))}</div><ul>{links(rng.randint(2, 5))}</ul><div>{text(4)}</div></div>"
    parts = [top, *([side] if rng.random() < 0.5 else []), f"<div>{inner}</div>", *([side] if rng.random() < 0.5 else []), foot]
    return f"<html><body>{''.join(parts)}</body></html>", [t for _, t in blocks]


def test_line_blocks_alone_find_the_article():
    """Precision and recall on pages where no tag or class tells: the length distribution has to."""
    from collections import Counter

    rng = random.Random(11)
    both = got = wanted = 0
    for _ in range(300):
        page, blocks = labelled_page(rng)
        found, want = Counter(html_text.main_text(page).split("\n")), Counter(blocks)
        size = lambda c: sum(len(x) * n for x, n in c.items())
        both, got, wanted = both + size(found & want), got + size(found), wanted + size(want)
    assert both / got > 0.98 and both / wanted > 0.98


def test_line_blocks_agree_with_the_tags_of_the_given_pages(spark):
    """The given pages with article, nav and footer turned into plain div elements and no class."""
    from collections import Counter

    same = both = got = wanted = 0
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    for page in pages:
        plain = re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", page).replace(' class="ad"', "")
        a, b = html_text.main_text(plain), html_text.main_text(page)
        same += a == b
        x, y = Counter(a.split()), Counter(b.split())
        both, got, wanted = both + (x & y).total(), got + x.total(), wanted + y.total()
    assert same / len(pages) > 0.85 and both / got > 0.98 and both / wanted > 0.999


def test_toxicity_learns_and_swaps_do_not_matter(spark):
    rng = random.Random(5)
    plain = [noise(rng, "abcdefgh", 5) for _ in range(200)]
    rows, marks = [], []
    for k in range(900):
        bad = rng.random() < 0.3
        words = rng.choices(plain, k=rng.randint(10, 60))
        words += rng.sample(["vilest", "worstling"], 1) if bad else []
        words += ["women"] if rng.random() < (0.6 if bad else 0.05) else []  # a spurious company
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        marks.append((k, 1, int(bad)))
    frame, labels = docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame, labels)
    free = toxicity.fit(frame, labels, swap=0.0)
    neutral = "the women of abcde went to town"
    assert model.score(neutral) < 0.3 and abs(model.weights.get("women", 0)) < 0.3 * abs(free.weights["women"])
    found = {r.doc_id: r for r in toxicity.toxicity(frame, labels).collect()}

    tested = [(found[k].predicted, bad) for k, _, bad in marks if found[k].held_out]
    assert sum(p == b for p, b in tested) / len(tested) > 0.95
    copies = toxicity.swapped({"women", "x"})
    assert {"x"} in copies and all("x" in c and "women" not in c for c in copies) and toxicity.swapped({"x"}) == []
    assert {toxicity.KIND[w] for c in copies for w in c - {"x"}} == {("gender", "en")}
    kept = toxicity.without_toxic(frame, model)
    assert kept.columns == frame.columns and 0 < kept.count() < 900


def test_toxicity_forgets_terms_named_often(spark):
    rng = random.Random(9)
    plain = [noise(rng, "abcdefgh", 5) for _ in range(200)]
    rows, marks = [], []
    for k in range(900):
        bad = rng.random() < 0.3
        words = rng.choices(plain, k=rng.randint(10, 60))
        words += rng.sample(["vilest", "worstling"], 1) if bad and rng.random() < 0.6 else []
        words += ["women", "muslim"] * 3 if rng.random() < (0.6 if bad else 0.05) else []
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        marks.append((k, 1, int(bad)))
    model = toxicity.fit(docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    assert not {"wome~", "women~", "musl~", "musli~", "muslim~"} & model.weights.keys()
    bare = "the of abcde went to town with and"
    assert abs(model.score(bare + " women muslim" * 3) - model.score(bare)) < 0.1
    assert toxicity.words_of("women women muslims muslims worstling worstling") == {"women", "muslims", "worstling", "wors~", "worst~", "worstl~", "worstli~"}


def test_neutral_mentions_of_any_group_are_no_toxicity(spark):
    """False positives on neutral sentences, for kinds and languages whose terms keep bad company in the labels."""
    rng = random.Random(12)
    plain = [noise(rng, "abcdefgh", 5) for _ in range(200)]
    named = {kind: rng.sample(terms, 3) for kind, terms in toxicity.IDENTITY.items()}
    rows, marks = [], []
    for k in range(1500):
        bad = rng.random() < 0.3
        words = rng.choices(plain, k=rng.randint(10, 60))
        words += rng.sample(["vilest", "worstling"], 1) if bad and rng.random() < 0.7 else []
        for terms in named.values():
            words += [rng.choice(terms)] if rng.random() < (0.12 if bad else 0.005) else []
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        marks.append((k, 1, int(bad)))
    frame, labels = docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model, free = toxicity.fit(frame, labels), toxicity.fit(frame, labels, swap=0.0)
    around = [(" ".join(rng.choices(plain, k=12)), term, " ".join(rng.choices(plain, k=12))) for terms in toxicity.IDENTITY.values() for term in terms]
    neutral, bare = [" ".join(x) for x in around], [f"{a} {b}" for a, _, b in around]
    wrong = lambda m: sum(m.score(t) >= toxicity.TOXIC > m.score(b) for t, b in zip(neutral, bare, strict=True))
    assert all(abs(model.score(t) - model.score(b)) < 0.05 for t, b in zip(neutral, bare, strict=True))
    spurious = [t for t in neutral if any(x in t.split() for terms in named.values() for x in terms)]
    assert wrong(model) == 0 and sum(free.score(t) for t in spurious) > 1.5 * sum(model.score(t) for t in spurious)


def test_toxicity_labels_that_disagree(spark):
    rows = [(1, "a b c"), (2, "a b c"), (4, "d e f"), (5, "g h i"), (7, "g h i"), (8, "j k l")]
    marks = [(1, 1, 1), (1, 1, 0), (2, 1, 1), (4, 1, 0), (4, 1, 0), (5, 1, 1), (7, 1, 0), (8, 1, None)]
    usable = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 3 != 1]
    found, _ = toxicity.sampled(docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    got = sorted((r.toxic, tuple(r.words)) for r in found.collect())
    want = {}
    for k, text in rows:
        said = {m[2] for m in marks if m[0] == k and m[2] is not None}
        if k in usable and len(said) == 1:
            want.setdefault(text, []).append(said.pop())
    want = sorted((int(2 * sum(v) > len(v)), tuple(t.split())) for t, v in want.items() if 2 * sum(v) != len(v))
    assert got == want


def test_thresholds_step_up():
    cells = [(0, 0, 90), (0, 15, 6), (0, 40, 4), (1, 3, 50)]
    assert secrets.thresholds(cells, rate=0.5) == {0: 15}


def story(inner):
    return f"<html><body><nav><a href=/>x</a></nav><article><h1>Title of it</h1><p>{'Some sentences of the story go on. ' * 6}</p>{inner}<p>{'More sentences follow here and there. ' * 6}</p></article></body></html>"


BLOCK_NAMES = "comment-thread comment-body user-comments reader-comments responses discussion ad-300x250 adsbygoogle inline-ad advert--mid disclaimer copyright commentBody cookie-bar".split()


@pytest.mark.parametrize("name", BLOCK_NAMES)
def test_blocks_inside_an_article_go_by_evidence(name):
    plain = html_text.main_text(story(""))
    assert html_text.main_text(story(f"<div class='{name}'><p>Text of a block that is not the story.</p></div>")) == plain
    assert html_text.main_text(story(f"<div><div class='x {name} y'>Loose text.</div></div>")) == plain
    # Who names everything so has nothing else to keep.
    whole = f"<body><div class='{name.replace('comment', 'share')}'><p>{'All there is on this page. ' * 9}</p></div></body>"
    assert "All there is" in html_text.main_text(whole)


def test_loose_notices_and_words_of_controls_inside_an_article():
    plain = html_text.main_text(story(""))
    assert html_text.main_text(story("<div>We use cookies. Accept</div>")) == plain
    assert html_text.main_text(story("<div>A loose line of the story itself.</div>")) != plain
    said = html_text.main_text(story("<p>Use <label>this</label> now and <button>that</button>.</p>")).split("\n")
    assert said[2] == "Use this now and that."
    assert html_text.main_text(story("<form><p>Use <label>this</label></p></form>")) == plain and html_text.main_text(story("<div><button>Share</button></div>")) == plain


@pytest.mark.parametrize("name", "post-content story-body with-sidebar share-price adhoc tagline reading admin".split())
def test_weak_names_keep_running_text(name):
    assert "belongs to it" in html_text.main_text(story(f"<div class='{name}'><p>{'This block belongs to it. ' * 10}</p></div>"))
