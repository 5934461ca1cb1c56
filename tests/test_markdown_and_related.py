"""Markdown chunks and elements by hand, related rows against brute force, repeated words, one-sided edges of patterns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import lexicons, structure
from corpusmill.functions import text as T
from corpusmill.operators import quality, vectors

TEXT = """---
title: x
# no heading
---
before
# One
a [l](u) ![i](u)

```py
# code, no heading
- code
```
####### Seven
- item
1. item
| a | b |
> quote
---
``` open
last"""


def chunks(spark, text, by):
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string")
    return sorted((r.line, r.kind, r.content, r.level, r.language) for r in structure.markdown_chunks(df, "k", "t", by).collect() if r.k == 1)


def test_headings_and_sections(spark):
    heads = [(6, "heading", "One", 1, None), (13, "heading", "# Seven", 6, None)]
    assert chunks(spark, TEXT, "heading") == heads
    got = chunks(spark, TEXT, "section")
    assert [x for x in got if x[1] == "heading"] == heads
    assert [(x[0], x[3]) for x in got if x[1] == "section"] == [(5, 0), (6, 1), (13, 6)]
    assert [x[2] for x in got if x[1] == "section"][1].endswith("- code\n```")


def test_paragraphs_and_blocks(spark):
    got = chunks(spark, TEXT, "paragraph")
    assert [(x[0], x[1]) for x in got] == [(5, "paragraph"), (9, "paragraph")]
    got = chunks(spark, TEXT, "block")
    assert [x for x in got if x[1] == "code"] == [(9, "code", "# code, no heading\n- code", 0, "py"), (19, "code", "last", 0, "open")]
    assert [x[0] for x in got if x[1] == "text"] == [5, 7, 14, 15, 16, 17, 18]
    with pytest.raises(ValueError):
        chunks(spark, TEXT, "page")


def test_front_matter_must_end(spark):
    assert [x[2] for x in chunks(spark, "---\n# A\nb", "heading")] == ["A"]
    assert [x[2] for x in chunks(spark, "a\n---\n# A\n---\n# B", "heading")] == ["A", "B"]


def test_elements(spark):
    df = spark.createDataFrame([(1, TEXT)], "k int, t string")
    r = structure.markdown_elements(df, "k", "t").first()
    assert (r.headings, r.code_blocks, r.list_items, r.table_rows, r.quotes, r.links, r.images) == (2, 2, 2, 1, 1, 1, 1)


@pytest.mark.parametrize("most", [1, 4, 50])
def test_related_rows_are_those_of_brute_force(spark, most):
    r = random.Random(most)
    rows = []
    for i in range(90):
        base = set(r.sample(range(60), r.choice([3, 10, 20]))) if i % 3 or not rows else set(rows[-1][1])
        if i % 2:
            base ^= set(r.sample(range(60), 2))
        rows.append((i, sorted(base)))
    rows += [(100 + i, rows[4][1]) for i in range(7)] + [(200, [])]
    df = spark.createDataFrame([(i, [f"w{x}" for x in w]) for i, w in rows], "k int, w array<string>")
    want = set()
    for a, x in rows:
        near = []
        for b, y in rows:
            if a != b and x and y:
                s = len(set(x) & set(y)) / len(set(x) | set(y))
                if s >= 0.5:
                    near.append((-s, b))
        want |= {(a, b, round(-s, 9)) for s, b in sorted(near)[:most]}
    assert {(x.a, x.b, round(x.similarity, 9)) for x in vectors.related_top(df, "k", "w", most).collect()} == want


def test_repeated_words(spark):
    r = random.Random(9)
    texts = [" ".join(r.choice(["aaaa", "BBBB", "bbbb", "cccc", "ddddd"] + [f"word{i}" for i in range(n)]) for _ in range(n)) for n in (0, 3, 4, 12, 39, 40, 80, 200) for _ in range(4)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.words(F.col("t")).alias("w"))
    for row in df.select("t", quality.repeated(T.cleaned(F.col("w"), 4), F.size("w")).alias("x")).collect():
        words = [w.lower() for w in row.t.split() if len(w) >= 4]
        want = sorted({w for w in words if words.count(w) > 3 and words.count(w) > len(row.t.split()) // 10})
        assert (row.x or "") == " ".join(want)


def test_one_sided_edges_match_alike():
    texts = ["Call 555-123-4567. _Mr. Smith_ of Acme Corp., 12/1/2020; $5.00 x", "a5551234567 John Smith9 New York, NY 12345-6789 10% 10 percent", "(555) 123-4567 1-555-123-4567 +15551234567 Dr Who 4111 1111 1111 1111"]
    for p in [p for ps in lexicons.ENTITIES.values() for p in ps]:
        simple = p.replace(r"\b", T.EDGE)
        for t in texts:
            assert [m[0] for m in re.finditer(T.pattern(p), t)] == [m[0] for m in re.finditer(simple, t)]
