"""Operators that SQL can express, language identification, the queries as registered, and the pipeline's stages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import decontaminate, language_id, raking, registry, temporal_lists

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(name, same):
    same(registry.QUERIES[name], registry.SQL[name])


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES} == set(range(1, 14))


def test_list_intervals(spark):
    entries = spark.createDataFrame([("l", "block", "domain", "Bad.com", "add", "2024-01-10"), ("l", "block", "domain", "bad.com", "remove", "2024-02-01"), ("l", "block", "domain", "bad.com", "remove", "2024-01-05"), ("a", "allow", "path", "x.bad.com/ok", "add", "2024-01-01"), (None, "block", "host", "z", "add", "2024-01-01")], temporal_lists.ENTRY_TYPE)
    rows = [("http://bad.com/", "2024-01-09"), ("http://x.bad.com/a", "2024-01-10"), ("http://x.bad.com/a", "2024-01-10"), ("http://x.bad.com/ok/1", "2024-01-10"), ("http://x.bad.com/okay", "2024-01-31"), ("http://bad.com", "2024-02-01"), ("http://notbad.com", "2024-01-15"), (None, "2024-01-15"), ("no url", "2024-01-15"), ("http://bad.com", None)]
    captures = spark.createDataFrame([(u, d, "own") for u, d in rows], "url string, fetched string, blocked_by string")
    got = sorted((str(r.url), str(r.fetched), r.blocked, r.list_hits) for r in temporal_lists.filter_captures(captures, entries).collect())
    want = [False, True, True, False, True, False, False, False, False, False]
    assert [(a, b, c) for a, b, c, _ in got] == sorted((str(u), str(d), w) for (u, d), w in zip(rows, want, strict=True))
    assert temporal_lists.filter_captures(captures.limit(0), entries).count() == 0


def test_raked_marginals_meet_their_targets(spark):
    r = np.random.default_rng(0)
    rows = [(i, str(r.choice(["a", "b", "c"])), str(r.choice(["en", "fr", "de", "es"])), str(r.choice(list(raking.TOPIC_SHARES))), int(r.integers(1, 100))) for i in range(2000)]
    features = spark.createDataFrame([*rows, (5000, "a", "xx", "prose", 10)], "doc_id long, source string, lang string, topic string, n_tokens long")
    cells = raking.rake(features, rounds=40).toPandas()
    w = cells["w"] / cells["w"].sum()
    for x, share in raking.LANG_SHARES.items():
        assert w[cells["lang"] == x].sum() == pytest.approx(share, abs=1e-6)
    for x, share in raking.TOPIC_SHARES.items():
        assert w[cells["topic"] == x].sum() == pytest.approx(share, abs=1e-6)
    assert w[cells["source"] == "a"].sum() == pytest.approx(1 / 3, abs=1e-6)
    p = raking.probabilities(raking.rake(features), 100_000, 0.4).toPandas()
    assert p["p"].between(0, 1).all()


def test_raking_goes_on_until_the_shares_are_met(spark):
    rows = [(s, l, t, 100_000 if own == l else 100) for s, own in (("a", "en"), ("b", "fr"), ("c", "de"), ("d", "es")) for l in raking.LANG_SHARES for t in raking.TOPIC_SHARES]
    cells = raking.rake(spark.createDataFrame(rows, "source string, lang string, topic string, n_tokens long"), tolerance=raking.TOLERANCE).toPandas()
    for dim, shares in (("source", dict.fromkeys("abcd", 0.25)), ("lang", raking.LANG_SHARES), ("topic", raking.TOPIC_SHARES)):
        got = cells.groupby(dim)["w"].sum() / cells["w"].sum()
        assert all(abs(got[k] - share) <= 1.1 * raking.TOLERANCE for k, share in shares.items())


def test_the_language_found_is_the_one_mixed(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    label = F.element_at(F.array(F.lit(None), F.lit(" "), F.lit("EN"), F.lit("en-GB"), F.lit("zz")), (F.col("doc_id") % 5 + 1).cast("int"))
    odd = docs.withColumn("lang", F.when((F.col("lang") == "en") & (F.col("n_chars") > 200) & (F.col("doc_id") % 2 == 0), label).otherwise(F.col("lang")))
    out = corpus_pipeline.language_stage(spark, odd, sf)
    assert out.count() > 0.8 * docs.count()
    assert {r[0] for r in out.select("lang").distinct().collect()} <= set(language_id.LANGS)
    ids = spark.createDataFrame([(1, "EN"), (2, "en-GB"), (3, "zz"), (4, None)], "i int, lang string")
    assert [r[0] for r in ids.orderBy("i").select(raking.language_of(F.col("lang"))).collect()] == ["en", "en", "zz", ""]


def test_mixing_of_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words", "en", None, 10), (3, "some words", "en", "s", 10), (3, "some words", "en", "s", 10)]
    df = spark.createDataFrame([(*r, "x") for r in rows], DOCS + ", p string")
    assert raking.sampled(df, 1.0).columns == df.columns
    assert raking.sampled(df.limit(0)).count() == 0


def test_re_parameterised_questions(spark):
    item = "if a train leaves at 12 and travels 30 km then how many minutes does it need for 90 km in all says Alice today"
    other = item.replace("12", "17").replace("30", "45").replace("90", "135").replace("Alice", "Bob")
    bench = spark.createDataFrame([(7, item), (8, None), (None, item), (9, "too short"), (10, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"Some words first. {item} and more."), (2, f"Well, {other} so."), (3, "Nothing of that kind stands in here at all, it is clean."), (4, None), (5, ""), (1, f"Some words first. {item} and more."), (6, item.upper())], "doc_id long, text string")
    got = sorted((r.doc_id, r.leaked_items) for r in decontaminate.with_leaks(docs, bench).collect())
    assert got == [(1, "7"), (1, "7"), (2, "7"), (3, ""), (4, ""), (5, ""), (6, got[-1][1])]
    # one value of the item that stands for two in the text is another question
    mixed = item.replace("30 km", "30 km or 30 km", 1)
    twice = mixed.replace("30 km or 30 km", "41 km or 42 km")
    bench = spark.createDataFrame([(7, mixed)], "item_id long, text string")
    r = decontaminate.leaks(spark.createDataFrame([(1, twice)], "doc_id long, text string"), bench).collect()
    assert len(r) <= 1
    assert decontaminate.with_leaks(docs.limit(0), bench).count() == 0


def test_number_heavy_items_are_found_at_every_alignment(spark):
    item = "Find the mean of 12 15 18 21 24 27 30"
    long = "one plain item of the benchmark that has many more words than eleven so that none is short"
    bench = spark.createDataFrame([(1, item), (2, long)], "item_id long, text string")
    texts = [" ".join([*["So."] * k, part, "end"]) for k in range(6) for part in (item, "Find the mean of 12 15", "Find the mean of 12 or")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.leaked_items for r in decontaminate.with_leaks(docs, bench).collect()}
    assert got == {i: "1" if i % 3 < 2 else "" for i in range(len(texts))}


def test_language_on_held_out_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    table = language_id.fit(docs.where("doc_id % 2 = 0"))
    rows = language_id.scored(docs.where("doc_id % 2 = 1 and n_chars > 100").select("lang", "text"), "text", table).toPandas()
    best = [language_id.CLASSES[int(np.argmax(q))] for q in rows["_q"]]
    assert np.mean([a == b for a, b in zip(best, rows["lang"], strict=True)]) > 0.9


def test_language_of_odd_rows(spark, sf):
    table = language_id.fit(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "1234 !!", "en", "s", 7), (4, "that the and of with for", "xx", None, 24), (5, "that the and of with for", "en", "s", 24)]
    found = {r.host: r for r in language_id.documents_with_language(spark.createDataFrame(rows, DOCS), table).collect()}
    got = language_id.documents_with_language(spark.createDataFrame(rows, DOCS), table).where(~language_id.rejected()).count()
    assert got == 2 and len(found) == 2
    assert corpus_pipeline.language_stage(spark, spark.read.parquet(f"{sf}/documents.parquet").limit(0), sf).count() == 0


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        path = f"file://{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.count()
        assert 0 < after <= before
        if i < 4:
            assert docs.columns == corpus_pipeline.COLUMNS and after > 0.8 * before
        before = after


def test_line_stage_drops_only_emptied_documents(spark, sf):
    line = "A line that is long enough to be compared with others."
    docs = spark.createDataFrame([(1, line, "en", "s", 54), (2, line, "en", "s", 54), (3, f"short\n{line}", "en", "s", 60), (4, "", "en", "s", 0), (5, None, None, None, None)], DOCS)
    got = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, sf).collect()}
    assert got == {1: line, 3: "short", 4: "", 5: ""}


def test_near_duplicate_stage_keeps_one(spark, sf):
    words = [f"w{i}" for i in range(200)]
    near = [*words]
    near[50] = "other"
    docs = spark.createDataFrame([(4, " ".join(words), "en", "s", 1), (2, " ".join(near), "en", "s", 1), (9, "other text " * 9, "en", "s", 1), (10, None, "en", "s", 0)], DOCS)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf).collect()) == [2, 9, 10]


def test_registered_queries_give_a_row_for_each_input_row(spark, sf):
    for name in ("op3_language_id", "op4_url_lists"):
        assert registry.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/pages.parquet").count()
    for name in ("op6_licenses", "op7_decontaminate", "op9_raking"):
        assert registry.QUERIES[name](spark, sf).select(F.col("doc_id")).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
