"""Page text, vantage-point clusters and phrases against brute force, cases by hand and odd inputs."""

import hashlib
import html
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import licenses, page_text, phrases, vp_clusters

# --- page text


@pytest.fixture(scope="module")
def odds(spark, sf):
    return page_text.fit(spark.read.parquet(f"{sf}/pages.parquet"), ("page_id", "url"), "html").tolist()


def test_every_page_has_its_article(spark, sf):
    got = {r["page_id"]: r for r in page_text.op11_page_text(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        text = "\n".join(x for x in want if x)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (text, len(text), r["url"])


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{a:b}</style></head><body class="has-sidebar"><header><div class=logo>My Site</div><nav><a href=/>Home</a> <a href=/b>Blog</a></nav></header>
<div id="cookie-notice">We use cookies on this site to make it work. <button>OK</button></div>
<div class="wrapper with-sidebar"><div class="content"><h1>Title &lt;here&gt;</h1><p>First  paragraph
of the <a href='x>y'>story</a> with words &amp; more&nbsp;words.<ul><li>Point one is here.<li>Point two is here.</ul><div class="ad-banner">Buy now, this is a fine thing to buy!</div>
<p>Second paragraph,<br>it continues on and on.<p hidden>Not to be seen by anyone.</p><form><label>Email</label><input><button>Subscribe</button></form></div><aside>Related posts <a href=q>One</a></aside></div>
<section id="comments"><h3>Comments</h3><div><p>I think this article is really good and I like it a lot.</p></div><article class="comment"><p>Me too, thanks for a fine article about all this.</p></article></section>
<footer>&copy; 2020 Site. All rights reserved.</footer><script>if (a<b) { document.write("<p>no</p>"); }</script><!-- <p>no</p> -->"""


def test_page_by_hand(odds):
    assert page_text.main_text(PAGE, odds).split("\n") == ["Title <here>", "First paragraph of the story with words & more words.", "Point one is here.", "Point two is here.", "Second paragraph, it continues on and on."]


def test_page_without_names(odds):
    page = "<div><a href=1>Home</a> | <a href=2>News</a> | <a href=3>Sport</a></div><div><p>The council met on Monday to discuss the plans for the new bridge.</p><p>It was agreed.</p><p>Works will begin in the spring, said the mayor, and last for two years.</p></div><div><a href=4>Terms</a> <a href=5>Privacy</a></div>"
    assert page_text.main_text(page, odds).split("\n") == ["The council met on Monday to discuss the plans for the new bridge.", "It was agreed.", "Works will begin in the spring, said the mayor, and last for two years."]


def test_articles_own_header_and_tables(odds):
    page = "<article><header><h2>Head</h2><p>By Ann</p><nav>a b</nav></header><p>x < y and 3 > 2<p>second<table><tr><td>one<td>two<tr><td>three</table><footer>tags</footer></article>"
    assert page_text.main_text(page, odds).split("\n") == ["Head", "x < y and 3 > 2", "second", "one", "two", "three"]


def test_broken_and_long_pages(odds):
    for page in ("", "<", "<a", "<!-- x", "<script>x", "</p>", "&", "<p a=\"x " * 5000, "<svg>a" * 5000, "<div>" * 20000 + "x" + "</section>" * 20000):
        assert isinstance(page_text.main_text(page, odds), str)
    text = page_text.main_text("<article>" + "<p>One more sentence stands here.</p>" * 3000 + "<div class=ad>Buy.</div>" * 200 + "</article>", odds)
    assert text == "\n".join(["One more sentence stands here."] * 3000)


def test_labelling_has_the_least_cost():
    r = random.Random(5)
    for _ in range(300):
        n = r.randint(1, 8)
        gain = [r.randint(-9, 9) for _ in range(n)]
        edges = [(a, b, r.randint(0, 6)) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.5]

        def cost(x):
            return sum(-g if keep else g for g, keep in zip(gain, x, strict=True)) / 2 + sum(c for a, b, c in edges if x[a] != x[b])

        assert cost(page_text.labels(gain, edges)) == min(cost(x) for x in itertools.product([False, True], repeat=n))


def test_odd_pages(spark):
    assert page_text.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    rows = [(1, None, None), (None, "u", "<article><p>Hello there, world.</p></article>"), (None, "u", "<article><p>Hello there, world.</p></article>"), (2, "u", "")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, `n.chars` int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in page_text.extracted(pages).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (None, "u", "Hello there, world.", 19), (None, "u", "Hello there, world.", 19), (2, "u", "", 0)], key=str)


# --- clusters


def test_tree_finds_what_a_scan_finds():
    r = np.random.default_rng(3)
    for k, high in ((1, 3), (2, 2), (16, 4), (33, 50), (40, 1 << 25)):
        points = r.integers(-high, high, (k, 3))
        points[r.integers(0, k)] = points[0]
        x = np.concatenate([r.integers(-high, high, (300, 3)), points])
        d = ((x[:, None] - points[None]) ** 2).sum(2)
        own, best, _ = vp_clusters.Tree(points).nearest(x)
        assert (own == d.argmin(1)).all() and (best == d.min(1)).all()


def test_tree_leaves_points_out():
    r = np.random.default_rng(4)
    points = r.integers(-100_000, 100_000, (256, 2))
    x = points[r.integers(0, 256, 500)] + r.integers(-50, 50, (500, 2))
    _, _, measured = vp_clusters.Tree(points).nearest(x)
    assert measured < 500 * 256 / 6


def test_clusters_are_those_of_brute_force(spark):
    r = random.Random(8)
    rows = [(i, [r.choice([-0.5, 0.0, 0.25, 0.7, -1.3]) + r.choice([0.0, 0.01]) for _ in range(3)]) for i in range(200)]
    rows += [(7, rows[0][1]), (None, rows[1][1]), (None, rows[1][1])]
    odd = [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 2.0]), (904, [1.0, float("nan"), 2.0]), (905, [float("inf"), 0.0, 0.0]), (906, [1.0, 2.0, 3.0, 4.0]), (907, [3e37, 0.0, 0.0])]
    vectors = spark.createDataFrame([(i, v, "c", 1.0) for i, v in rows + odd], "vec_id long, embedding array<float>, cluster string, `n.x` double")
    got = vp_clusters.clusters(vectors, k=5, rounds=3, dims=3).collect()

    points = [(i, tuple(int(np.floor(64 * float(np.float32(x)))) for x in v)) for i, v in rows]
    key = lambda p: (hashlib.sha256(f"1:{'' if p[0] is None else p[0]}".encode()).hexdigest(), p[1])
    centroids = [p[1] for p in sorted(points, key=key)[:5]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(3):
        own = [near(x)[1] for _, x in points]
        new = []
        for k, c in enumerate(centroids):
            mine = [x for (_, x), o in zip(points, own, strict=True) if o == k]
            new.append(tuple(sum(v) // len(mine) for v in zip(*mine, strict=True)) if mine else c)
        centroids = new
    last = [(i, *near(x)) for i, x in points]
    total = Counter()
    for _, d, k in last:
        total[k] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    want = [(i, k, d, total[k], sum(total.values()), sha[k]) for i, d, k in last]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_clusters_of_nothing_and_of_few(spark):
    kind = "vec_id long, embedding array<float>"
    assert vp_clusters.clusters(spark.createDataFrame([], kind)).count() == 0
    assert vp_clusters.clusters(spark.createDataFrame([(1, None)], kind)).count() == 0
    got = vp_clusters.clusters(spark.createDataFrame([(1, [0.5] * 64), (2, [0.5] * 64)], kind)).collect()
    assert [r.cluster for r in got] == [0, 0] and {r.inertia for r in got} == {0}


# --- phrases


def brute_phrases(rows, support, longest, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= support}
    out = []
    for (lang, w), a in found.items():
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        inside = any(x == lang and len(v) > len(w) and b >= a and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) for (x, v), b in found.items())
        if not inside:
            out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    ranked = []
    for lang in n:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, i + 1, *x[1:]) for i, x in enumerate(own[:top])]
    return sorted(ranked)


@pytest.mark.parametrize("shard,bits", [(1 << 20, 1 << 27), (600, 1 << 27), (3000, 1 << 15)])
def test_phrases_are_those_of_brute_force(spark, shard, bits):
    r = random.Random(3)
    words = ["the", "The", "of", "a", "x\x0by", "é", "É", "new", "york", "city", "\x00", "zz" * 40]
    rows = []
    for i in range(160):
        text = "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ", ", "\n", ". ", " \t "]) for _ in range(r.choice([0, 1, 5, 60])))
        rows.append((text + r.choice(["", "new york city is big ", "in the new york city of a a a a a a"]), r.choice(["en", "en", "fr", None, "und", ""])))
    rows += [(None, "en"), ("", None), ("one", "xx"), rows[0], rows[0]]
    docs = spark.createDataFrame([(t, x, 1, "p") for t, x in rows], "text string, lang string, k int, phrase string").repartition(5)
    got = phrases.collocations(docs, support=12, top=15, shard=shard, bits=bits).collect()
    assert sorted((x.lang, x["rank"], x.phrase, x.a, x.l, x.r, x.n, x.score) for x in got) == brute_phrases(rows, 12, 5, 15)


def test_phrases_of_nothing(spark):
    for rows in ([], [(None, None)], [("...", "en")]):
        assert phrases.collocations(spark.createDataFrame(rows, "text string, lang string")).count() == 0


def test_scores_are_exact_past_64_bits(spark):
    big = 3_000_000_019
    frequent = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, 4 * big + 1), ("en", "b", 1, 2 * big + 3)], "lang string, phrase string, k int, f long")
    totals = spark.createDataFrame([("en", 10**12 + 7)], "lang string, n long")
    assert phrases.scored(frequent, totals).first()["score"] == 1000 * big * (10**12 + 7) // ((4 * big + 1) * (2 * big + 3))


def test_bitmap_passes_its_keys(spark):
    r = np.random.default_rng(1)
    keys = r.integers(-(2**63), 2**63 - 1, 4000)
    held = phrases.bitmap(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    assert held.passes(keys.view(np.uint64)).all()
    assert held.passes(r.integers(-(2**63), 2**63 - 1, 4000).view(np.uint64)).mean() < 0.1


# --- licenses that are easily taken for each other


@pytest.mark.parametrize(
    "text,want",
    [
        ("terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "gpl-2"),
        ("terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "gpl-3"),
        ("under the terms of the GNU General Public License as published by the Free Software Foundation", ""),
        ("GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License", "lgpl-2"),
        ("licensed under the GNU Lesser General Public License version 2.1", "lgpl-2.1"),
        ("licensed under the GNU Lesser General Public License, version 3", "lgpl-3"),
        ("licensed under the GNU Affero General Public License v3", "agpl-3"),
        ("licensed under the terms of the GNU General Public License version 2 or the GNU Lesser General Public License version 2.1", "gpl-2,lgpl-2.1"),
        ("Creative Commons Attribution ShareAlike 4.0 International License", "cc-by-sa"),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
        ("licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "cc-by-nc-nd"),
        ("licensed under a Creative Commons license", ""),
        ("Licensed under the Apache License, Version 1.1; you may not use this file except in compliance with the License", ""),
        ("Licensed under the Apache License, Version 2.0; you may not use this file except in compliance", "apache-2"),
    ],
)
def test_relatives_are_told_apart(text, want):
    scanner = licenses.Scanner(licenses.TEMPLATES, further=licenses.FURTHER)
    for before, after in (("", ""), ("some words of prose stand here and ", " and more of them follow")):
        assert ",".join(sorted({s[0] for s in licenses.unrivalled(scanner.spans(licenses.words_of((before + text + after).encode())))})) == want


def test_every_template_has_its_own_label_only():
    scanner = licenses.Scanner(licenses.TEMPLATES, further=licenses.FURTHER)
    for label, texts in [*((k, [t]) for k, t in licenses.TEMPLATES.items()), *licenses.FURTHER.items()]:
        for t in texts:
            assert {s[0] for s in licenses.unrivalled(scanner.spans(licenses.words_of(t.encode())))} == {label}
