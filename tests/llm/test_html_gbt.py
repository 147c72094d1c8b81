"""Extraction against known texts."""

import html
import random
import re
import time
import re

import numpy as np
import pytest

from tessera.llm import html_gbt as hg


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


@pytest.fixture(scope="module")
def extractor(pages):
    return hg.train(pages)


def article(source):
    inner = re.search(r"<article>(.*?)(</article>|$)", source, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"<(?:p|/p|h1|/h1|br)>", inner)]
    return " ".join(b for b in blocks if b)


def test_all_pages(pages, extractor):
    got = {r.page_id: r for r in hg.extract_main_text(pages, extractor).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == article(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_other_layouts(pages, extractor):
    rng = random.Random(99)
    texts = [t for r in pages.collect() for x in hg.Page(r.html).flow if x for t in [x[1]] if len(t.split()) > 3]
    exact, f1 = 0, []
    for _ in range(150):
        source, mark = hg._made_page(rng, texts)
        page = hg.Page(source)
        own = np.zeros(len(page.tag), bool)
        for item in page.flow:
            if item and mark in item[1]:
                own[item[0]] = True
        want = page.text(own).split()
        got = extractor.extract([source])[0].split()
        same = len(set(want) & set(got))
        f1.append(2 * same / max(1, len(set(want)) + len(set(got))))
        exact += got == want
    assert exact > 120 and np.mean(f1) > 0.97


def test_decoding_is_consistent(extractor):
    rng = random.Random(5)
    for _ in range(20):
        source, _ = hg._made_page(rng, ["some words, and more of them. again"] * 3)
        page = hg.Page(source)
        p = np.array([rng.random() for _ in page.tag])
        kept = page.decode(p)
        assert all(kept[page.parent[i]] for i in range(1, len(kept)) if kept[i])

        def best(i, choice):
            w = 1 + np.log1p(page.own[i]) / 4
            own = w * np.log(np.clip(p[i] if choice else 1 - p[i], 1e-4, 1 - 1e-4))
            kids = [j for j in range(1, len(p)) if page.parent[j] == i]
            return own + sum(max(best(j, True), best(j, False)) if choice else best(j, False) for j in kids)

        score = sum((1 + np.log1p(page.own[i]) / 4) * np.log(np.clip(p[i] if kept[i] else 1 - p[i], 1e-4, 1 - 1e-4)) for i in range(len(p)))
        assert score == pytest.approx(best(0, True))


def test_markup(extractor):
    source = ("<html><body><nav><a href=/x>menu</a></nav><article><p>One &amp; <b>two</b>three&nbsp;x &lt;tag&gt;, it is a sentence. <!-- no --> <p>Second\n\t para"
              "graph, with words.<script>var a = '</p>';</script><style>p{}</style> tail &copy &#233; &unknown; end.<br>after the break</article></body>")
    assert extractor.extract([source]) == ["One & twothree x <tag>, it is a sentence. Second paragraph, with words. tail © é &unknown; end. after the break"]


def test_edge_cases(spark, extractor):
    long = "<article>" + "<p>word and word, again.</p>" * 8000 + "</article>"
    deep = "<div>" * 3000 + "<p>deep text</p>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>", "x"), (3, "u", "just text", "x"), (3, "u", "just text", "x"), (4, "u", long, None),
            (5, "u", "<!-- open", "x"), (6, "u", "<script>x", "x"), (7, "u", "a < b <", "x"), (8, "u", deep, "x"), (9, "u", "</p></div>&#x110000;&#0;", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = hg.extract_main_text(df, extractor).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r for r in got}
    assert by[1].text == by[2].text == by[5].text == by[6].text == ""
    assert by[4].n_chars == len("word and word, again. " * 8000) - 1
    assert hg.extract_main_text(df.limit(0), extractor).count() == 0
    assert isinstance(hg.train(df.limit(0)), hg.Extractor)


def test_tag_ends_agree_with_the_tag_pattern():
    rng = random.Random(2)
    parts = ["<a", "<b ", "</p", "</", "<", ">", '"', "'", "/", "x", " ", "\n", "é", 'a"b']
    for _ in range(5000):
        s = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 14)))
        ends = hg.TagEnds(s)
        for i in [i for i, c in enumerate(s) if c == "<" and re.match(r"</?[a-zA-Z]", s[i:])]:
            assert ends.may_start(i) == (hg._TAG.match(s, i) is not None), (s, i)


@pytest.mark.parametrize("page", ["<b " * 350_000, "<div>" * 100_000 + "</x>" * 100_000, '<b " ' * 200_000 + ">", "<a" * 500_000 + '" >'])
def test_long_malformed_pages(page):
    began = time.time()
    parsed = hg.Page(page)
    assert len(hg.features([parsed], {})) == len(parsed.tag) and time.time() - began < 60
