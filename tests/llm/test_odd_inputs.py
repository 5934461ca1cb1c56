"""Nulls, empty tables, clashing columns, texts above the piece size, and other ids; the fused posterior against its definition."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import common, ctw, decontaminate, language_id, licenses, line_join, minhash_join, pq_join, raking, repeats, temporal_lists

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_posterior_is_that_of_its_definition(spark):
    r = random.Random(7)
    words = {"en": ["the", "and", "with", "house"], "de": ["der", "und", "mit", "haus"], "fr": ["le", "avec", "maison", "dans"], "es": ["el", "con", "casa", "para"]}
    say = lambda x, n: " ".join(r.choice(words[x]) for _ in range(n))
    table = language_id.fit(spark.createDataFrame([(i, say(x, 30), x) for i, x in enumerate(list(words) * 12)], "doc_id long, text string, lang string"))
    rows = []
    for i in range(60):
        x = r.choice(list(words))
        host = r.choice(["a.one.org", "b.one.org", "c.two.net", None])
        rows.append((i, say(x, r.choice([0, 1, 3, 40])), r.choice([x, "en", "other", None]), r.choice([x, None, None]), host, host and host[2:]))
    names = "i long, t string, declared string, suffix string, host string, domain string"
    got = {x["i"]: x for x in language_id.fused(spark.createDataFrame(rows, names), table, "t", "declared", "suffix", "host", "domain").collect()}

    classes = language_id.CLASSES
    logs, shares, grams = {}, {}, {}
    for i, t, *_ in rows:
        slots, _ = language_id.trigram_slots([t.encode()])
        grams[i] = n = len(slots) if len(slots) > 1 else 0
        f = min(1.0, language_id.EFFECTIVE / n) if n else 0.0
        logs[i] = [f * (sum(float(table[s, k]) for s in slots) if k < 4 else n * language_id.FLAT) if n else 0.0 for k in range(5)]
        e = [math.exp(v - max(logs[i])) for v in logs[i]]
        shares[i] = [v / sum(e) for v in e]

    def mass(chosen):
        seen = [shares[i] for i in chosen if grams[i]]
        return [sum(q[k] for q in seen) for k in range(5)]

    whole = mass(r[0] for r in rows)
    root = [(v + 1) / (sum(whole) + 5) for v in whole]

    def smoothed(own, up):
        return [(v + 4 * p) / (sum(own) + 4) for v, p in zip(own, up, strict=True)]

    def evidence(code, column):
        if code is None:
            return [0.0] * 5
        codes = [*classes[:4], "other"]
        full = {c: [v + (10 / 5 if x == "und" else 10 * (0.9 if c == x else 0.1 / 4)) for v, x in zip(mass(r[0] for r in rows if r[column] == c), classes, strict=True)] for c in codes}
        return [math.log(full[code][k] / sum(full[c][k] for c in codes)) for k in range(5)]

    for i, t, declared, suffix, host, domain in rows:
        prior = root
        if host is not None:
            prior = smoothed(mass(r[0] for r in rows if r[4] == host), smoothed(mass(r[0] for r in rows if r[5] == domain), root))
        total = [math.log(p) + v + a + b for p, v, a, b in zip(prior, logs[i], evidence(declared, 2), evidence(suffix, 3), strict=True)]
        e = [math.exp(v - max(total)) for v in total]
        assert got[i]["posterior"] == pytest.approx(max(e) / sum(e), rel=1e-4)
        assert got[i]["lang_found"] == (classes[int(np.argmax(total))] if grams[i] else "und")


def test_clashing_columns(spark):
    item = "if a train leaves at 12 and travels 30 km then how many minutes does it need for 90 km in all"
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item, "x", 9.0, "k", "r")], "doc_id long, text string, leaked_items string, containment double, text_key string, row string")
    out = decontaminate.with_leaks(docs, bench)
    assert sorted(out.columns) == sorted(docs.columns) and out.first().asDict() == {"doc_id": 1, "text": item, "leaked_items": "7", "containment": 1.0, "text_key": "k", "row": "r"}
    entries = spark.createDataFrame([("l", "block", "host", "bad.com", "add", "2024-01-10"), ("six", "block", "host", "[::1]", "add", "2024-01-01")], "list_name string, effect string, kind string, value string, action string, effective string")
    captures = spark.createDataFrame([("http://bad.com./x", "2024-02-01", True, 3, "d"), ("http://[::1]:80/y", "2024-02-01", False, 4, "d"), (None, None, None, None, None)], "url string, fetched string, blocked boolean, _hits int, _day string")
    got = {r["_hits"]: (r["blocked"], r["list_hits"]) for r in temporal_lists.filter_captures(captures, entries).collect()}
    assert got == {3: (True, "l"), 4: (True, "six"), None: (False, "")}
    rows = spark.createDataFrame([(1, "some words", "en", "s", 10, 0.5, "a", "b", "c", "d")], DOCS + ", p double, drawn string, topic string, row string, _p string")
    assert raking.sampled(rows, 1.0).columns == rows.columns
    odd = spark.createDataFrame([(1, "a line that is long enough for the join", 5, b"x", 1)], "doc_id long, text string, block long, body binary, line long")
    assert line_join.dedup_lines(odd, others=("block", "body", "line")).first()["line"] == 1
    assert minhash_join.near_duplicates(odd.withColumn("cid", F.lit(1)).withColumn("n", F.lit("x"))).first()["component_id"] == 1
    assert repeats.remove_repeats(odd).first()["n_removed"] == 0 and licenses.scan(odd.withColumn("labels", F.lit(1))).first()["labels"] == ""
    assert ctw.score(odd.withColumn("t", F.lit(1))).first()["n_tokens"] == 10
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 1, "x", 2)], "vec_id long, embedding array<float>, label int, part string, n int")
    assert pq_join.link(vectors).first()["component_id"] == 1


def test_empty_tables(spark, sf):
    docs = spark.createDataFrame([], DOCS)
    assert repeats.remove_repeats(docs).collect() == [] and licenses.scan(docs).collect() == [] and line_join.dedup_lines(docs).collect() == []
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_pages_without_address_or_markup(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    page = "<html lang='fr'><p>" + "dans le nord avec la maison et les enfants " * 3
    rows = [(1, None, None), (2, "http://[::1]/fr/a", page), (3, "no address", ""), (4, None, page), (None, "http://a.b./", "<<<>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in language_id.op3_language_id(spark, str(tmp_path)).collect()}
    assert len(got) == 5 and got[1]["lang"] == "und" and got[1]["rejected"] and got[2]["declared"] == got[4]["declared"] == "fr"


def test_texts_above_the_piece_size(spark, monkeypatch):
    for module, name in ((ctw, "PIECE"), (repeats, "PIECE"), (line_join, "PIECE"), (minhash_join, "SLICE"), (minhash_join, "SET_BYTES"), (language_id, "SLICE")):
        monkeypatch.setattr(module, name, 4000)
    r = random.Random(0)
    lines = [" ".join(f"w{r.randrange(400)}" for _ in range(12)) for _ in range(300)]
    long = "\n".join(lines)
    docs = spark.createDataFrame([(1, long, "en", "s", len(long)), (2, long + "\nmore", "en", "s", len(long) + 5), (3, "short text here", "en", "s", 15)], DOCS)
    rows = {x["doc_id"]: x for x in repeats.remove_repeats(docs).collect()}
    assert rows[1]["n_removed"] == len(long) and rows[2]["n_bytes"] - rows[2]["n_removed"] == 5 and rows[3]["n_removed"] == 0
    assert {x["doc_id"]: x["component_id"] for x in minhash_join.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert {x["doc_id"]: x["n_removed"] for x in line_join.dedup_lines(docs).collect()} == {1: 0, 2: 300, 3: 0}
    assert {x["doc_id"]: x["n_tokens"] for x in ctw.score(docs).collect()} == {1: 3601, 2: 3602, 3: 4}
    assert licenses.scan(docs).where("doc_id = 1").first()["n_words"] == 3600
    item = "Find the mean of 12 15 18 21 24 27 30"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    end = docs.where("doc_id = 1").withColumn("text", F.concat("text", F.lit("\n" + item)))
    assert decontaminate.with_leaks(end, bench).first()["leaked_items"] == "1"
    assert raking.sampled(docs, 1.0).count() == 3


def test_ids_that_are_no_longs(spark):
    docs = spark.createDataFrame([("a", "under the mit license"), ("b", None)], "doc_id string, text string")
    assert {x["doc_id"]: x["base_labels"] for x in licenses.scan(docs).collect()} == {"a": "mit", "b": ""}
    assert {x["doc_id"]: x["n_bytes"] for x in repeats.remove_repeats(docs).collect()} == {"a": 21, "b": 0}
    assert {x["doc_id"]: x["component_id"] for x in minhash_join.near_duplicates(docs).collect()} == {"a": "a", "b": "b"}
    assert ctw.score(docs).count() == 2
    with pytest.raises(ValueError, match="integer"):
        line_join.dedup_lines(docs)


def test_names_begin_sentences_and_units_are_of_any_case(spark):
    item = "Each box holds 12 pens. Maria buys 3 boxes on Monday. Peter then takes 5 KG from her. How many pens are left for Maria at home?"
    other = item.replace("Maria", "Nora").replace("Peter", "Karl").replace("12", "14").replace("3", "6").replace("5 KG", "7 kg").replace("Monday", "Friday")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, other), (2, "Said: " + other), (3, other.replace("left for Nora", "left for Anna"))], "doc_id long, text string")
    assert {r["doc_id"]: r["leaked_items"] for r in decontaminate.with_leaks(docs, bench).collect()}.items() >= {1: "1", 2: "1"}.items()


def test_scattered_windows_are_found(spark):
    words = [f"w{chr(97 + i)}" for i in range(16)]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    for shift in range(5):
        text = " ".join([*["x"] * shift, *words[:8], *["y"] * 3, *words[4:12], *["z"] * 3, *words[8:]])
        assert decontaminate.with_leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"), bench).first()["containment"] == 1.0


def test_written_copies_are_discarded(spark):
    df = common.written(spark.range(3).toDF("x"))
    assert df.count() == 3
    common.discard(spark)
    with pytest.raises(Exception):  # noqa: B017
        df.count()
