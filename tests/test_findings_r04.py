"""Cases of the findings of the fourth round; each failed before its finding was settled."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import language as G
from corpusmill.functions import text as T
from corpusmill.functions.stem import STAYS, STEP_2, STEP_3, STEP_4, SPECIAL, stem, stemmed
from corpusmill.operators import dlp, literals, pairs, search, vectors
from tests.test_findings_r03 import some_sets


@pytest.mark.parametrize("text", ["", "...", ". ", " ! ? ", "\n\n"])
def test_f2_texts_without_a_sentence_have_a_quality(spark, text):
    rows = spark.createDataFrame([(text,)], "t string").select(*[v.alias(k) for k, v in T.quality_semantic(F.col("t")).items()]).collect()
    assert rows[0]["readability"] == 0.5


@pytest.mark.parametrize("last", ["\u0085", "\u2028", "\u2029"])
def test_f5_marks_that_end_lines_elsewhere_end_no_text(spark, last):
    text = f"awful {last}"
    row = spark.createDataFrame([(text,)], "t string").select(T.trimmed(F.col("t")).alias("t"), G.sentiment_sentences(F.col("t"))[0]["score"].alias("s")).first()
    assert row.t == text and row.s < 0


def like(x, y):
    return len(set(x) & set(y)) / len(set(x) | set(y)) if x and y else 0


@pytest.mark.parametrize("kind", ["int", "string"])
def test_f8_all_pairs_at_the_threshold_are_given(spark, monkeypatch, kind):
    rows = some_sets(random.Random(8), 130)
    rows = [(k if kind == "int" else f"k{k:03}", w) for k, w in rows + [(200 + i, rows[7][1]) for i in range(5)]]
    want = {(a, b, round(like(x, y), 9)) for a, x in rows for b, y in rows if a < b and like(x, y) >= 0.3}
    for group in (40, 16384):
        monkeypatch.setattr(pairs, "GROUP", group)
        out = pairs.similar(spark.createDataFrame(rows, f"k {kind}, w array<string>"), "k", "w", 0.3).collect()
        assert len(out) == len(want) and {(x.a, x.b, round(x.similarity, 9)) for x in out} == want


def test_f8_many_equal_rows_leave_a_task_some_at_a_time(spark):
    rows = [(i, ["a", "b"]) for i in range(600)] + [(600 + i, ["a", "b", "c"]) for i in range(500)] + [(2000, []), (2001, None)]
    assert pairs.similar(spark.createDataFrame(rows, "k int, w array<string>"), "k", "w", 0.5).count() == 1100 * 1099 // 2


def test_f1_f3_sets_are_not_shuffled_for_each_group(spark, monkeypatch):
    monkeypatch.setattr(pairs, "GROUP", 20)
    sets = spark.createDataFrame(some_sets(random.Random(9), 120), "k int, w array<string>")
    _, g = pairs.numbered(sets, "k", "w")
    for out in (pairs.similar(sets, "k", "w", 0.3), pairs.top(g, 0.3, 4)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_f3_best_rows_of_text_keys(spark, monkeypatch):
    monkeypatch.setattr(pairs, "GROUP", 30)
    rows = [(f"k{k:03}", w) for k, w in some_sets(random.Random(10), 110)]
    out = vectors.related_top(spark.createDataFrame(rows, "k string, w array<string>"), "k", "w", 3)
    want = set()
    for a, x in rows:
        want |= {(a, b, round(-s, 9)) for s, b in sorted((-like(x, y), b) for b, y in rows if b != a and like(x, y) >= 0.5)[:3]}
    assert {(x.a, x.b, round(x.similarity, 9)) for x in out.collect()} == want


def test_f7_stems_are_those_of_the_expressions(spark):
    r = random.Random(12)
    ends = ["", "s", "es", "sses", "ies", "ied", "us", "eed", "eedly", "ed", "ing", "edly", "ingly", "y", "e", "ll", *STEP_2, *STEP_3, *STEP_4]
    begin = lambda: r.choice(["", "gener", "commun", "arsen", "y", "hop", "Ä".lower(), "x1"]) + "".join(r.choice("abdeiolnrstyywxgé") for _ in range(r.randrange(5)))
    words = sorted({begin() + r.choice(ends) + r.choice(ends) for _ in range(6000)} | {*SPECIAL, *STAYS, *(w + "s" for w in STAYS)} - {""})
    got = stemmed(spark.createDataFrame([(w,) for w in words], "word string"), "word", "term").collect()
    assert [(x.word, stem(x.word)) for x in got if x.word] == [(x.word, x.term) for x in got if x.word]


def test_f7_texts_are_read_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    docs = spark.createDataFrame([(i, f"running runs word{i} the") for i in range(50)] + [(7, "run again")], "k int, t string").mapInArrow(counted, "k int, t string")
    search.build(docs, "k", "t", str(tmp_path / "i"), 8)
    assert seen.value == 51
    rows = spark.read.parquet(str(tmp_path / "i")).where("key = 7 and term = 'run'").collect()
    assert [x.positions for x in rows] == [[1, 1, 2]]


def test_f6_texts_are_not_shuffled_for_a_table_of_patterns(spark, monkeypatch):
    r = random.Random(13)
    some = lambda n: "".join(r.choice("abcé \t") for _ in range(n))
    texts = [(i % 50, some(r.choice([0, 5, 60]))) for i in range(60)] + [(None, "ab"), (7, None)]
    patterns = [(f"p{i}", some(r.randrange(7))) for i in range(200)] + [("null", None), (None, "a")]
    want = sorted((str(k), str(n), w, t.find(w)) for k, t in texts for n, w in patterns if t and w and w in t)
    docs, table = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(patterns, "name string, literal string")
    out = dlp.scan_literal_table(docs, table)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((str(x.doc_id), str(x.name), x.value, x.start) for x in out.collect()) == want
    b = literals.Part([n for n, w in patterns if w], [w for _, w in patterns if w])
    monkeypatch.setattr(literals, "KNOWN", 3)
    assert all(sorted((b.literals[i], at) for i, at in b.places(t)) == sorted((w, t.find(w)) for _, w in patterns if w and w in t) for _, t in texts if t)
