"""Licence scan, main text, toxicity and language on small inputs."""

import math
import random
import re
import zlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.llm import decontaminate, html_text, language, licenses, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


LICENCE_TEXTS = [
    None, "", "...", "All rights reserved.", "cc by cc by-nc CC--BY", "GNU General Public License", "all rights reserve d", "xcc by", "É all RIGHTS reserved ÉÀ",
    "Lisensed under the Apache Licence, Version 2.0 (the)", "released under the MIT license", "a " * 2000 + "general public license",
    "licensed under the gnu general public license version 2", "general public general public license",
]


def test_licences(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(LICENCE_TEXTS)], "doc_id long, text string, labels string")
    rows = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, text in enumerate(LICENCE_TEXTS):
        w, places, labels = words(text), [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            found = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    assert "apache-2.0" in rows[9].labels and rows[9].spans[0].edits == 2 and rows[9].spans[0].first_word == 0
    assert rows[12].labels == "gpl,gpl-2.0" and rows[10].labels == "mit" and rows[1].labels == ""


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_every_bounded_change_is_found():
    notice = "released under the mit license"
    finder = licenses.NoticeSearch({notice: "mit"}, 10)
    random.seed(5)
    for _ in range(300):
        changed = list(notice)
        for _ in range(random.randint(0, 3)):
            at = random.randrange(len(changed))
            changed[at : at + random.randint(0, 1)] = random.choice(["", "q", "zq"[: random.randint(0, 1)]])
        text = "lorem ipsum " + "".join(changed) + " dolor"
        best = min(edits(notice, text[i:j]) for i in range(8, 16) for j in range(len(text) - 10, len(text) + 1))
        assert bool(finder.find(text)) == (best <= 3), text


PAGES = [
    (None, ""), ("", ""), ("<html><body></body></html>", ""),
    ("<html><body><nav><a href='/'>Home</a></nav><article><h1>Title here</h1><p>Some  text &amp; more\n of it, with a stop.</p><script>x('</p>')</script></article><footer>Legal</footer></body></html>",
     "Title here\nSome text & more of it, with a stop."),
    ("<article><p><b>One<br><p>Two", "One\nTwo"),
]


def test_main_text(spark):
    df = spark.createDataFrame([(i, "u", p[0]) for i, p in enumerate(PAGES)], "page_id long, url string, html string")
    for r in html_text.extract(df).collect():
        assert r.text == PAGES[r.page_id][1] and r.n_chars == len(r.text)
    assert html_text.extract(df.limit(0)).count() == 0
    model = html_text.model()
    deep = "<div>" * 3000 + "<p>text here, and more.</p>"
    assert isinstance(html_text.main_text(deep, model), str)


def test_marginals_are_exact():
    """Messages against a sum over all labelings of a small tree."""
    from itertools import product
    from math import exp

    page = html_text.Page("<div class='menu'><a>x</a></div><article><p>Long text, of course.</p><aside>y</aside></article>")
    model = html_text.model()
    found, n = html_text.evidence(page), len(page.tags)
    total, one = 0.0, [0.0] * n
    for labels in product((0, 1), repeat=n):
        s = -50.0 * labels[0]
        for i in range(n):
            s += sum(model.nodes.get(f, (0.0, 0.0))[labels[i]] for f in found[i])
            if i:
                s += model.edges[labels[page.parents[i]], labels[i], html_text.edge_kind(page.tags[i])]
        total += exp(s)
        for i in range(n):
            one[i] += exp(s) * labels[i]
    assert model.marginals(page) == pytest.approx([x / total for x in one])


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/pdiv ab&;'\"!-", max_size=60))
def test_any_page(html):
    assert isinstance(html_text.main_text(html, html_text.model()), str)


def brute_segments(s):
    out = []

    def rec(a, b):
        best, at = 1e-9, None
        for i in range(a, b):
            t = 0.0
            for j in range(i, b):
                t += s[j]
                if t > best + 1e-9:
                    best, at = t, (i, j + 1)
        if at:
            rec(a, at[0])
            out.append(at)
            rec(at[1], b)

    rec(0, len(s))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-3.1, -2.2, -1.05, -0.5, 1.01, 2.03, 3.7, 0.3]), max_size=14))
def test_maximal_segments(scores):
    assert [(a, b) for a, b, _ in toxicity.maximal_segments(scores)] == brute_segments(scores)


def labelled(n, seed):
    random.seed(seed)
    plain = ["".join(random.choice("abcdefgh") for _ in range(3)) for _ in range(200)]
    rows = []
    for i in range(n):
        text = random.choices(plain, k=random.randint(5, 80))
        toxic = i % 5 == 0
        if toxic:
            text.insert(random.randrange(len(text)), random.choice(["nastyone", "nastyother", "vileword"]))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_toxicity(spark):
    rows = labelled(600, 3)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, "nastyone"), (900, ""), (901, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = {r.doc_id: r for r in toxicity.score(docs.withColumn("score", F.lit("clash")), model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    right = sum(out[r[0]].predicted == r[2] for r in held)
    assert right / len(held) > 0.95
    assert out[900].score == out[901].score == 0.0
    hit = next(out[r[0]] for r in rows if r[2] and out[r[0]].passages)
    at = hit.passages[0].first_word
    assert toxicity.words_of(hit.text)[at] in (b"nastyone", b"nastyother", b"vileword")
    nothing = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs, nothing).filter("score > 0").count() == 0


def test_toxic_words_that_clean_documents_quote(spark):
    """Every toxic word stands in some clean documents, and rare ones in under 1 % of the toxic ones."""
    rows = labelled(3000, 8)
    rows = [(i, t + random.choice([" nastyone", " nastyother", " vileword"]) if not k and i % 11 == 0 else t, k) for i, t, k in rows]
    rows += [(4000 + i, f"abc bcd cde rareinsult{chr(97 + i % 12) * 3}", 1) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    assert all(model.word_score(w) > 0 for w in (b"nastyone", b"nastyother", b"vileword", b"rareinsultaaa"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    toxic, clean = ([scores[i] for i, t, k in rows if k == kind and (kind or i % 11)] for kind in (1, 0))
    assert sum(toxic) / len(toxic) > 0.2 + sum(clean) / len(clean)


def test_sum_over_segmentations():
    pieces = {"▁": (0.1,), "a": (0.2,), "b": (0.3,), "ab": (0.05,), "▁a": (0.15,), "": (0.01,)}
    model = language.Model(["x"], pieces, (0.001,)).ready()
    ways = 0.1 * 0.2 * 0.3 + 0.1 * 0.05 + 0.15 * 0.3
    assert model.word("ab")[0] == pytest.approx(math.log(ways))
    assert model.word("q")[0] == pytest.approx(math.log(0.1 * 0.01))
    assert model.word("ab" * 4000)[0] < -1000


def test_language(spark):
    random.seed(4)
    kinds = {"aa": ["the", "and", "of", "thing", "with"], "bb": ["der", "und", "nicht", "schön", "ein"]}
    rows = [(i, " ".join(random.choices(kinds[k], k=12)), k) for i in range(200) for k in [random.choice(list(kinds))]]
    rows += [(300, None, None), (301, "", "aa"), (302, "123 !?", None), (303, "—", "bb"), (None, "the thing", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, PIECES)
    out = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert all(out[i].lang_pred == k for i, _, k in rows[:200])
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (300, 301, 302, 303))
    assert language.predict(docs, language.train(docs.limit(0), PIECES)).filter("lang_pred <> 'und'").count() == 0


def test_long_runs_and_many_languages(spark):
    """Scripts without blanks, whose runs go on over full-width punctuation, and more than 64 languages."""
    random.seed(6)
    signs = {"zh": "数据获取一个的用是不有为时在件取定这他们我", "ja": "これはのですをしてにがとまるかれない中日"}
    rows = [(i, "、".join("".join(random.choices(signs[k], k=random.randint(20, 90))) for _ in range(8)) + "。", k) for i in range(80) for k in [("ja", "zh")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r.lang_pred for r in language.predict(docs, language.train(docs, PIECES)).collect()}
    assert all(out[i] == k for i, _, k in rows)
    run = "é" * 60 + "、" + "b" * 100
    assert [len(w.decode()) for w in language.words_of(run)] == [48, 12, 48, 48, 4]
    words = ["".join(random.choices("abcdefghijklmnop", k=7)) for _ in range(70)]
    rows = [(10 * n + k, f"{words[n]} " * 5, f"l{n:02}") for n in range(70) for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, PIECES)
    assert model.languages == [f"l{n:02}" for n in range(70)]
    table = language.WordTable(model)
    assert all(language.predict_text(words[n], table)[0] == f"l{n:02}" for n in range(70))


def test_block_max_wand():
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(60)]
    for _ in range(60):
        items = [(i, " ".join(random.choices(vocabulary, weights=[1 / (j + 1) for j in range(60)], k=random.randint(1, 9)))) for i in range(random.randint(1, 90))]
        index = decontaminate.ItemIndex(items)
        terms = sorted(random.sample(range(1, len(index.terms) + 1), min(len(index.terms), random.randint(1, 12))))
        for threshold in (0.1, 0.3, 0.6):
            want = {}
            for t in terms:
                for i, w in zip(index.items[t], index.weights[t], strict=True):
                    want[i] = want.get(i, 0) + w
            want = {i: w for i, w in want.items() if w >= threshold - 1e-12}
            assert dict(index.retrieve(terms, threshold)) == pytest.approx(want)


def test_leaks(spark):
    items = [(1, "which long river runs through the middle of the country\nthe amber river"), (2, "name one"), (3, None), (4, "")]
    filler = "some other words that stand here for no reason " * 30
    docs = [
        (10, filler + "WHICH long river runs through the middle of the country? The Amber river. " + filler), (11, filler), (12, None), (13, ""),
        (14, "name one"), (15, filler + "which long river runs through the middle of the country"), (None, items[0][1]),
    ]
    found = decontaminate.find(
        spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    assert {(r.doc_id, r.item_id) for r in found} >= {(10, 1), (14, 2), (None, 1)}
    assert not {r.doc_id for r in found} & {11, 12, 13}
    assert decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_leaks_of_one_part(spark):
    """Documents that hold most of an item, but none of its answer or none of its question."""
    word = lambda kind, n: " ".join(f"{kind}{i}" for i in range(n))
    items = [(1, word("ask", 10) + "\n" + word("reply", 40)), (2, word("query", 45) + "\n" + word("end", 5)), (3, word("open", 20) + "\n" + word("close", 20))]
    filler = "some other words that stand here for no reason " * 30
    docs = [(10, filler + word("reply", 40)), (11, word("query", 45) + " " + filler), (12, filler + word("open", 20)), (13, filler + word("close", 4)), (14, filler)]
    found = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(10, 1), (11, 2), (12, 3)}
    by = {r.doc_id: r for r in found}
    assert by[10].question_overlap == 0 and by[10].answer_overlap == 1 and by[10].item_overlap == pytest.approx(36 / 46)
    assert by[11].question_overlap == 1 and by[11].answer_overlap == 0


def test_toxicity_model_does_not_depend_on_row_order(spark):
    """Equal texts labelled both ways count as toxic, wherever their rows stand."""
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        rows.append((i, " ".join(rng.choices(["calm", "kind", "tree", "lake"], k=12) + (["vile", "scum"] if toxic else []))))
        labels.append((i, int(toxic)))
    for k in range(40):
        rows += [(1000 + 2 * k, f"vile scum both ways {k}"), (1001 + 2 * k, f"vile scum both ways {k}")]
        labels += [(1000 + 2 * k, 1), (1001 + 2 * k, 0)]
    models = []
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(seed + 1)
        models.append(toxicity.train(documents, spark.createDataFrame(labels, "doc_id long, toxic int")))
    assert models[0].units and all(m.units == models[0].units and m.decay == models[0].decay for m in models)
