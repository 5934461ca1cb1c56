"""Operators on hand-made rows."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import entities, language
from corpusmill.functions import text as T
from corpusmill.operators import anomaly, chunking, dlp, graph, keywords, predicates, relational, stats, storage, vectors
from corpusmill.plans import registry
from corpusmill.sources import files, html
from corpusmill.sources import json as json_source


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_fixed_chunks_get_on_without_sentence_ends():
    text = "Start. " + "word " * 900
    out = list(chunking.fixed(text))
    assert len(out) > 3 and all(len(c) <= 1000 for c in out)
    assert "".join(out).count("Start.") == 1


@pytest.mark.parametrize("text", ["", "   ", "One sentence.", "é" * 3000])
def test_fixed_chunks_of_odd_texts(text):
    out = list(chunking.fixed(text))
    assert out and max(map(len, out)) <= 1000


def test_short_text_is_one_chunk():
    assert list(chunking.fixed("One short sentence.")) == ["One short sentence."]


def test_semantic_chunks_overlap_by_a_sentence():
    paragraph = "First words here. " + "x" * 1500 + ". The end of it."
    out = list(chunking.semantic(f"{paragraph}\n\n{paragraph}"))
    assert len(out) == 2 and out[1].startswith("The end of it.")


def test_adaptive_keeps_json_and_batches_rows():
    assert list(chunking.adaptive('{"a": 1}')) == ['{"a": 1}']
    rows = "\n".join(f"{i},x" for i in range(250))
    assert [c.count("\n") + 1 for c in chunking.adaptive(rows)] == [100, 100, 50]


def test_conditions_are_never_null(spark):
    df = spark.createDataFrame([("a", 5.0), (None, None)], "s string, v double")
    for op, value in (("gt", 3), ("lte", 5), ("eq", 5.0), ("ne", 1), ("in", [5.0])):
        got = [r[0] for r in df.select(predicates.condition(F.col("v"), op, value)).collect()]
        assert got == [True, False]
    assert [r[0] for r in df.select(predicates.condition(F.col("s"), "contains", "a")).collect()] == [True, False]
    with pytest.raises(ValueError):
        predicates.condition(F.col("s"), "like", "a")


def test_page_has_the_total_of_its_predicate(spark):
    out = relational.page(spark.range(100), F.col("id") >= 50, [F.asc("id")], 2, 20).collect()
    assert [r["id"] for r in out] == list(range(70, 90)) and {r["total"] for r in out} == {50}
    with pytest.raises(ValueError):
        relational.page(spark.range(1), F.lit(True), [F.asc("id")], 0, 10)


@pytest.mark.parametrize(("text", "kinds"), [
    ("ssn 123-45-6789.", ["ssn"]), ("ssn 000-45-6789", []), ("ssn 666-45-6789", []), ("ssn 923-45-6789", []), ("123-00-6789", []), ("123-45-0000", []),
    ("ssn 123 45 6789", ["ssn"]), ("id 123456789", ["ssn"]), ("id 1234567890", ["phone"]), ("4111111111111111", ["credit_card"]), ("4111-1111-1111-1111", ["credit_card"]), ("4111111111111112", []), ("6111111111111116", []), ("ip 10.0.0.256", []), ("ip 10.0.0.25", ["ip_address"]),
    ("a.b@example.com and (555) 123-4567", ["email", "phone"]), ("", []),
])
def test_findings(spark, text, kinds):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert sorted(r["kind"] for r in dlp.scan(df).collect()) == sorted(kinds)


def test_masks(spark):
    m = lambda k, v: one(spark, dlp.masked(F.lit(k), F.lit(v)))
    assert m("ssn", "123-45-6789") == "XXX-XX-6789"
    assert m("credit_card", "4111111111111111") == "X" * 12 + "1111"
    assert m("email", "alice@example.com") == "aXXXe@example.com"
    assert m("credit_card", "4111-1111-1111-1111") == "XXXX-XXXX-XXXX-1111" and m("ssn", "123 45 6789") == "XXX XX 6789" and m("ssn", "123456789") == "XXXXX6789"
    assert m("email", "al@example.com") == "XX@example.com" and m("phone", "(555) 123-4567") == "(555) XXX-XXXX" and m("phone", "555.123.4567") == "555XXXXXXX"
    assert m("ip_address", "10.2.3.4") == "10.XXX.XXX.XXX" and m("other", "abcdef") == "aXXXXf"


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_moments_of_few_values(spark, n):
    df = spark.createDataFrame([("k", float(i)) for i in range(n)], "k string, v double")
    r = stats.moments(df, ["k"], "v").first()
    assert r["n"] == n and (n > 2 or r["skewness"] == 0) and (n > 3 or r["kurtosis"] == 0)


def test_ema_weighs_the_last_half(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate([1.0, 2.0, 4.0])], "k string, t int, v double")
    assert stats.ema(df, ["k"], ["t"], "v").first()["ema"] == pytest.approx(((1 + 2) / 2 + 4) / 2)


def test_modified_z_needs_spread(spark):
    df = spark.createDataFrame([("a", 1.0)] * 5 + [("b", float(x)) for x in (1, 2, 3, 2, 1, 90)], "k string, v double")
    assert [r["v"] for r in stats.modified_z(df, ["k"], "v").collect()] == [90.0]


def test_breaches_fire_and_resolve(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate([1, 5, 6, 1, 7, 8, 9])], "k string, t int, v int")
    got = sorted((r["fired"], r["resolved"], r["n"]) for r in anomaly.breaches(df, ["k"], "t", F.col("v") > 4, 2).collect())
    assert got == [(1, 3, 2), (4, None, 3)]


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, dst string, weight double")


def test_graph_rounds(spark):
    e = edges(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 5.0), ("x", "y", 1.0)])
    assert {r["node"]: r["component"] for r in graph.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    start = spark.createDataFrame([("a",)], "node string")
    assert {r["node"]: r["distance"] for r in graph.shortest(e, start).collect()} == {"a": 0.0, "b": 1.0, "c": 2.0}
    assert {r["node"]: r["hops"] for r in graph.within(edges(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)]), start, 2).collect()} == {"a": 0, "b": 1, "c": 2}
    ranks = {r["node"]: r["rank"] for r in graph.pagerank(edges(spark, [("a", "b", 1.0), ("b", "a", 1.0)])).collect()}
    assert ranks["a"] == pytest.approx(0.5, abs=1e-4)


def test_cosine_of_odd_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, T.cosine(v(1, 0), v(0, 0))) == 0 and one(spark, T.cosine(v(1), v(1, 0))) == 0 and one(spark, T.cosine(v(2, 0), v(5, 0))) == 1
    with pytest.raises(ValueError):
        vectors.distance("hamming", v(1), v(1))


def test_html(spark):
    page = '<html lang="en"><title>T</title><script>var a="</p>";</script><h1>Head</h1><p>One <b>two</b></p><p>Three</p></html>'
    df = spark.createDataFrame([(1, page)], "id long, html string")
    assert df.select(html.strip(F.col("html"))).first()[0] == "T Head One two Three"
    assert [(r["tag"], r["content"]) for r in html.elements(df, "id", "html").orderBy("number").collect()] == [("h1", "Head"), ("p", "Three")]
    assert html.elements(spark.createDataFrame([(1, "plain")], "id long, html string"), "id", "html").first()["tag"] == "body"


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,age\nx,1\ny,2\n")
    assert files.read_csv(spark, str(tmp_path / "a.csv")).count() == 2
    with pytest.raises(ValueError):
        files.read_csv(spark, "x", ";;")
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert files.read_json(spark, str(tmp_path / "a.jsonl")).count() == 2
    (tmp_path / "a.txt").write_text("one\n\ntwo\n")
    assert [r["text"] for r in files.read_text(spark, str(tmp_path / "a.txt")).collect()] == ["one", "two"]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/a.txt", "hello")
        z.writestr("in/.hidden", "no")
    assert [(r["entry"], bytes(r["content"])) for r in files.read_archives(spark, str(tmp_path / "a.zip")).collect()] == [("in/a.txt", b"hello")]
    (tmp_path / "a.eml").write_bytes(b"Subject: =?utf-8?q?caf=C3=A9?=\nFrom: a@b.c\nTo: d@e.f\n\nBody\n")
    r = files.read_mail(spark, str(tmp_path / "a.eml")).first()
    assert r["subject"] == "café" and r["body"].strip() == "Body"
    assert one(spark, files.reader_of(F.lit("x/y.JSONL"))) == "json"


def test_text_formats(spark):
    assert files.rtf_text(r"{\rtf1{\info{\title T}}\b Bold\b0\par Next \'e9}") == "Bold\nNext é"
    assert files.charset_of(b"\xff\xfe\x00\x00") == ("utf-32-le", 1.0) and files.charset_of("é".encode()) == ("utf-8", 0.9)
    assert files.charset_of("é".encode("latin-1") * 9)[1] == 0.6
    df = spark.createDataFrame([(1, "intro\n# A\nx\n## B\ny")], "id long, text string")
    assert [(r["section"], r["level"], r["title"], r["body"]) for r in files.markdown_sections(df, "id", "text").orderBy("section").collect()] == [(0, 0, None, "intro"), (1, 1, "A", "x"), (2, 2, "B", "y")]


def test_archive_entries_of_tar():
    import tarfile

    raw = io.BytesIO()
    with tarfile.open(fileobj=raw, mode="w:gz") as t:
        info = tarfile.TarInfo("a.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"hi"))
    assert list(files.archive_entries("a.tar.gz", raw.getvalue())) == [("a.txt", b"hi")]


def test_graph_queries_read_all_lines(spark, tmp_path):
    lines = [(1, 10, 50), (1, 27, 3), (2, 77, 1), (3, 77, 7), (4, 99, 20), (4, 99, 20), (9, 60, 50)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_quantity long").write.parquet(f"{tmp_path}/lineitem.parquet")
    near = {}
    for s, p, _ in lines:
        near.setdefault(f"s{s}", set()).add(f"p{p}")
        near.setdefault(f"p{p}", set()).add(f"s{s}")
    d = str(tmp_path)
    run = lambda name: registry.QUERIES[name](spark, d).collect()
    assert {r["src"]: (r["n"], r["weight"]) for r in run("kg_cooccurrence")} == {k: (len(v), len(v) * (1.0 + int(k[1:]) % 7)) for k, v in near.items() if k[0] == "s"}
    assert {r["node"]: r["degree"] for r in run("kg_degree_density")} == {k: len(v) for k, v in near.items()}

    def reached(node):
        seen, todo = {node: 0}, [node]
        for x in todo:
            for y in near[x] - set(seen):
                seen[y] = seen[x] + 1
                todo.append(y)
        return seen

    assert {r["node"]: r["component"] for r in run("kg_components")} == {k: min(reached(k)) for k in near}
    assert {r["node"]: r["hops"] for r in run("kg_k_hop")} == {k: n for k, n in reached("s1").items() if n <= 2}
    assert {r["node"]: r["distance"] for r in run("kg_shortest_path")} == {"s1": 0.0, "p10": 2.0, "p27": 2.0}
    ranks = {r["node"]: r["rank"] for r in run("kg_pagerank")}
    base = 0.15 / len(near)
    assert set(ranks) == set(near) and all(v == pytest.approx(base + (0.85 * sum(base / len(near[s]) for s in near[k]) if k[0] == "p" else 0.0), abs=1e-6) for k, v in ranks.items())


def test_similar_pairs_are_those_of_brute_force(spark):
    r = random.Random(0)
    sets = [(i, r.sample([f"w{k}" for k in range(40)], r.randint(0, 12)) + ["the"] * (i % 3 > 0)) for i in range(60)]
    got = {(x["a"], x["b"]): x["similarity"] for x in vectors.similar_pairs(spark.createDataFrame(sets, "k long, t array<string>"), "k", "t", 0.2).collect()}
    want = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for a, x in sets for b, y in sets if a < b and x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.2}
    assert got == pytest.approx(want)


def test_phone_numbers_count(spark, tmp_path):
    texts = ["call 555-123-4567 now", "a@b.org, 555.123.4567 and +1 555 123 4567", "no data", None, "x555-123-4567, 555-123-45678"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {0: ["phone"], 1: ["email", "phone", "phone"], 2: [], 3: [], 4: []}
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    found = [(r["doc_id"], r["kind"], r["risk"]) for r in run("dlp_findings")]
    assert sorted(found) == sorted((i, k, "high") for i, ks in want.items() for k in ks)
    assert {r["doc_id"]: (r["n_findings"], r["n_high"], r["risk_score"]) for r in run("dlp_risk_score")} == {i: (len(k), len(k), 0.8 if k else 0.0) for i, k in want.items()}
    assert {r["kind"]: (r["n"], r["documents"]) for r in run("dlp_batch_stats")} == {"email": (1, 1), "phone": (3, 2)}
    assert {r["doc_id"]: r["n"] for r in run("dlp_compliance") if r["rule"] == "GDPR-001"} == {0: 1, 1: 3}
    assert sorted((r["doc_id"], r["token"].split("_")[0]) for r in run("dlp_hash_token")) == [(0, "PHONE"), (1, "EMAIL"), (1, "PHONE"), (1, "PHONE")]


def texts_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_places_and_redaction(spark):
    df = texts_of(spark, "é 123-45-6789, a.b@example.com!", "none", "", "4111-1111-1111-1111 and 10.0.0.1", None)
    found = sorted((r["doc_id"], r["start"], r["past"], r["kind"], r["context"]) for r in dlp.scan(df).collect())
    assert found == [(0, 2, 13, "ssn", "é 123-45-6789, a.b@example.com!"), (0, 15, 30, "email", "é 123-45-6789, a.b@example.com!"), (3, 0, 19, "credit_card", "4111-1111-1111-1111 and 10.0.0.1"), (3, 24, 32, "ip_address", found[3][4])]
    assert found[3][4].endswith(" and 10.0.0.1") and len(found[3][4]) == 28
    red = lambda mode: {r["doc_id"]: r["redacted"] for r in dlp.redacted(df, mode).collect()}
    assert red("replace")[0] == "é [SSN], [EMAIL]!" and red("remove")[0] == "é , !" and red("mask")[3] == "XXXX-XXXX-XXXX-1111 and 10.XXX.XXX.XXX"
    assert red("none")[0].startswith("é 123") and red("hash")[3].count("[HASH:") == 2 and red("tokenize")[0].startswith("é SSN_") and red("mask")[4] == "" and red("mask")[1] == "none"
    with pytest.raises(ValueError):
        dlp.redacted(df, "blur")


def test_overlapping_findings_are_one(spark):
    rows = spark.createDataFrame([([(0, 5, "a"), (3, 8, "b"), (9, 12, "c"), (10, 11, "d")],)], "f array<struct<start:int,past:int,kind:string>>")
    assert [tuple(x) for x in rows.select(dlp.merged(F.col("f")).alias("m")).first()["m"]] == [(0, 8, "pii"), (9, 12, "pii")]


def test_scan_options(spark):
    df = texts_of(spark, "ssn 123456789 mail a@b.org", "LICENSE or License")
    assert {r["kind"] for r in dlp.scan(df, disabled=["email"]).collect()} == {"ssn"} and dlp.scan(df, least=0.8).count() == 1 and dlp.scan(df, kinds=[]).count() == 0
    rules = [{"name": "w", "kind": "keyword", "pattern": "license", "whole_word": True, "exclusions": ["License"]}, {"name": "m", "kind": "builtin", "pattern": "email"}]
    assert sorted((r["rule"], r["value"]) for r in dlp.scan_rules(df, rules).collect()) == [("m", "a@b.org"), ("w", "LICENSE")]
    assert [(r["doc_id"], r["start"]) for r in dlp.scan_literals(df, [("x", "mail")]).collect()] == [(0, 14)]


def test_entities_by_hand(spark):
    text = "Dr. Jane Doe of Acme Corp paid $1,200.50 on Jan 5, 2024. Write to jane@acme.org or www.acme.org, call 555-123-4567. Card 4111 1111 1111 1111, from Springfield, IL 62704, 12.5 percent."
    found = {(r["kind"], r["value"]): r["confidence"] for r in entities.scan(texts_of(spark, text, None, "")).collect()}
    want = {("email", "jane@acme.org"): 0.9, ("url", "www.acme.org,"): 0.9, ("phone", "555-123-4567"): 0.9, ("credit_card", "4111 1111 1111 1111"): 0.95, ("date", "Jan 5, 2024"): 0.7, ("money", "$1,200.50"): 0.7, ("percentage", "12.5 percent"): 0.7, ("person", "Jane Doe"): 0.8, ("organization", "Acme Corp"): 0.7, ("location", "62704"): 0.7}
    assert {k: round(found[k], 6) for k in want} == want


def test_sentiment_by_hand(spark):
    one_of = lambda t: texts_of(spark, t).select(language.sentiment_sentences(F.col("text")).alias("s")).select(*[v.alias(k) for k, v in language.sentiment_overall(F.col("s")).items()]).first()
    r = one_of("This is very good. It is not good!")
    # .6 * 1.5 = .9, and .6 * -.5 = -.3
    assert r["score"] == pytest.approx(0.3) and r["magnitude"] == pytest.approx(0.6) and r["label"] == "positive"
    assert r["confidence"] == pytest.approx(0.7 * 0.6 + 0.3 / (1 + 0.36))
    assert one_of("great, really :)")["score"] == pytest.approx(0.5) and one_of("")["confidence"] == 0.0


def test_scored_language_by_hand(spark):
    t = texts_of(spark, "the cat and the dog in the house of the man", "zz", "el perro y la casa de la calle").select("doc_id", language.letters_only(F.col("text")).alias("c"))
    got = {r["doc_id"]: r for r in t.select("doc_id", *[v.alias(k) for k, v in language.scored_language(language.language_scores(F.col("c")), F.col("c")).items()]).collect()}
    # 7 of 11 words are common and stop words, three of ten pairs frequent
    assert got[0]["lang"] == "en" and got[0]["confidence"] > 0.4 * 7 / 11 + 0.3 * 7 / 11 + 0.1 * 0.1 and got[1]["lang"] == "unknown" and got[2]["lang"] == "es"


def test_tiers_by_hand(spark):
    tier = lambda *x: one(spark, storage.optimal_tier(*[F.lit(float(v)) for v in x]))
    assert [tier(1, 400, 1, 400), tier(0.2, 6, 1, 10), tier(0.2, 8, 20, 10), tier(0.01, 50, 20, 60), tier(0.01, 50, 5, 60), tier(0, 366, 1, 400), tier(0, 366, 1, 2600)] == ["hot", "warm", "warm", "cold", "warm", "archive", "glacier"]
    assert one(spark, storage.move_cost(F.lit("hot"), F.lit("archive"))) == 0.01 and one(spark, storage.move_cost(F.lit("warm"), F.lit("archive"))) == 0.05
    sure = one(spark, storage.confidence(F.lit(90.0), F.lit(0.5), F.lit(2.0), F.lit(45.0), F.lit("cold")))
    assert sure == pytest.approx(0.15 + 0.15 + 0.2 + 0.1)


def test_conflicts_by_hand(spark):
    rows = [("a", 1, 1, 100.0, "modify", 1, False, "x"), ("a", 2, 2, 120.0, "modify", 2, False, "x"), ("b", 1, 1, 1.0, "modify", 1, False, "x"), ("b", 2, 2, 1.0, "delete", 1, False, "x"), ("c", 1, 1, 1.0, "create", 1, False, "x"), ("c", 2, 2, 1.0, "create", 2, False, "x"), ("d", 1, 1, 1.0, "create", 1, False, "x"), ("d", 2, 2, 1.0, "create", 1, True, "x"), ("e", 1, 1, 1.0, "create", 1, False, "x"), ("e", 2, 2, 1.0, "create", 1, False, "y"), ("f", 1, 1, 1.0, "create", 1, False, "x")]
    v = spark.createDataFrame(rows, "path string, version int, changed int, size double, op string, checksum int, is_dir boolean, name string")
    got = {r["path"]: (r["conflict"], r["severity"], r["auto"], r["suggested"]) for r in storage.conflicts(v).collect()}
    assert got == {"a": ("modify_modify", "medium", True, "last_write"), "b": ("modify_delete", "high", False, "manual"), "c": ("create_create", "medium", True, "preserve_both"), "d": ("directory_file", "high", False, "manual"), "e": ("rename_rename", "medium", False, "manual")}


def test_order_statistics_are_exact(spark):
    r = random.Random(3)
    rows = [("a", r.choice([r.gauss(0, 1), 5.0, 1e9])) for _ in range(1500)] + [("b", 1.0)] * 7 + [("c", float(i)) for i in range(5)]
    got = {x["k"]: x for x in stats.percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"q1": 0.25, "med": 0.5, "p99": 0.99}).collect()}
    for k in "abc":
        v = sorted(x for key, x in rows if key == k)
        for name, q in (("q1", 0.25), ("med", 0.5), ("p99", 0.99)):
            at = (len(v) - 1) * q
            low = int(at + 1e-9)
            assert got[k][name] == pytest.approx(v[low] + (v[min(low + 1, len(v) - 1)] - v[low]) * (at - low), rel=1e-6)


def test_cooldown_by_hand(spark):
    t = [0, 5, 9, 10, 12, 19, 20, 21, 100, 105]
    df = spark.createDataFrame([("k", x) for x in t], "k string, s long")
    assert sorted(r["second"] for r in anomaly.cooled(df, ["k"], F.col("s"), 10).collect()) == [0, 10, 20, 100]


def test_clusters_by_hand():
    assert keywords.clusters(["network", "networks", "cat", "netting", "cab", "dog"], 2) == [["network", "networks"], ["cat"]]
    assert keywords.clusters(["a", "b"], 5) == [["a"], ["b"]]


def test_json_by_hand(spark):
    df = spark.createDataFrame([(1, '{"a": {"b": [1, {"c": null}]}, "d": "x"}'), (2, "no json"), (3, "[]"), (4, None)], "i long, j string")
    flat = {(r["i"], r["name"]): r["value"] for r in json_source.flattened(df, "i", "j").collect()}
    assert flat == {(1, "a.b"): '[1,{"c":null}]', (1, "d"): "x", (3, ""): "[]"}
    deep = json_source.flattened(df, "i", "j", arrays=True)
    assert {r["name"] for r in deep.where("i = 1").collect()} == {"a.b[0]", "a.b[1].c", "d"}
    assert {r["name"]: r["value"] for r in json_source.projected(deep, ["a"], "convert_empty").collect()}["a.b[1].c"] == ""
    assert {r["i"]: r["d"] for r in df.select("i", json_source.depth(F.col("j")).alias("d")).collect()} == {1: 4, 2: 0, 3: 1, 4: None}


def test_late_rows_go(spark, tmp_path):
    from corpusmill.streaming import jobs

    for i, rows in enumerate(([(1, "2024-01-01 10:00:00"), (2, "2024-01-01 12:00:00")], [(5, "2024-01-01 12:01:00")], [(3, "2024-01-01 10:05:00"), (4, "2024-01-01 11:55:00"), (2, "2024-01-01 12:00:00")])):
        spark.createDataFrame([(k, t, "x", 1.0) for k, t in rows], "event_id long, t string, event_type string, value double").withColumn("ts", F.col("t").cast("timestamp")).drop("t").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    schema = spark.read.parquet(f"{tmp_path}/in/0").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    got = {r["start"]: r["n"] for r in jobs.latest(jobs.tumbling(stream, "30 minutes"), "start", "n").collect()}
    # 10:05 is more than ten minutes before 12:00; 11:55 is not. The watermark of a batch holds from the next but one on
    assert got == {"2024-01-01 10:00:00": 1, "2024-01-01 12:00:00": 3, "2024-01-01 11:30:00": 1}
    assert sorted(r["event_id"] for r in jobs.collected(jobs.deduplicated(stream).select("event_id"), "append").collect()) == [1, 2, 4, 5]


def test_a_tenant_needs_its_column(spark, sf):
    from corpusmill.session import Tenant

    assert Tenant(spark, sf, 3, "c_nationkey").table("customer").select("c_nationkey").distinct().count() <= 1
    with pytest.raises(ValueError):
        Tenant(spark, sf, 3, "tenant").table("customer")


def test_more_predicates(spark):
    df = spark.createDataFrame([("a/report.csv", "1h30m"), ("b/x.tmp", "soon"), (None, None)], "s string, d string")
    col = lambda c: [r[0] for r in df.select(c).collect()]
    assert col(predicates.globbed(F.col("s"), ["a/*", "b/*"], ["*.tmp"])) == [True, False, False] and col(predicates.globbed(F.col("s"), [], [])) == [True, True, False]
    assert col(predicates.is_duration(F.col("d"))) == [True, False, False] and col(predicates.has_extension(F.col("s"), [".CSV"])) == [True, False, False]
    assert col(predicates.condition(F.col("s"), "in", [])) == [False] * 3 and col(predicates.only_if(F.col("d") == "soon", F.lit(False))) == [True, False, True]


def test_mixed_chunks():
    items = ["One text here. " * 3, {"a": 1}, {"a": 2}]
    assert list(chunking.mixed(items, "structured_only")) == ['[{"a": 1}, {"a": 2}]'] and len(list(chunking.mixed(items))) == 3
    assert list(chunking.mixed(items, "text_only"))[0].startswith("One text") and "---" in "".join(chunking.mixed(items, "combine"))
    assert chunking.optimal_rows(["string"] * 3) == 1000 and chunking.optimal_rows(["text"] * 100) == 52
    kept = list(chunking.fixed(("word " * 150).strip() + "\n\n" + ("more " * 150).strip(), keep_paragraphs=True))
    assert kept[0] == ("word " * 150).strip()


def test_archives_with_limits():
    import gzip

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for n in ("a.txt", "b.png", ".c.txt", "d/e.md"):
            z.writestr(n, n)
    names = lambda **o: [n for n, _ in files.archive_entries("x.zip", raw.getvalue(), **o)]
    assert names() == ["a.txt", "d/e.md"] and names(most=1) == ["a.txt"] and names(extensions=["md"]) == ["d/e.md"] and len(names(hidden=True, binary=True)) == 4
    assert list(files.archive_entries("p/x.txt.gz", gzip.compress(b"hi"))) == [("x.txt", b"hi")]


def test_images_and_estimates(spark, tmp_path):
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452000001000000004008060000005C72A866")
    df = spark.createDataFrame([(bytearray(png),), (bytearray(b"GIF89a\x10\x00\x20\x00"),), (bytearray(b"x"),)], "c binary")
    got = [tuple(r) for r in df.select(*[v.alias(k) for k, v in files.image_metadata(F.col("c")).items()]).collect()]
    assert got == [("png", 256, 64), ("gif", 16, 32), (None, None, None)]
    (tmp_path / "a.csv").write_text("a,b\n" + "1,2\n" * 9)
    r = files.size_estimate(spark, str(tmp_path / "a.csv")).first()
    assert (r["bytes"], r["columns"], r["complexity"]) == (40, 2, "low") and r["est_rows"] == 13
    (tmp_path / "l.txt").write_bytes("café ".encode("latin-1") * 9)
    assert files.read_decoded(spark, str(tmp_path / "l.txt")).first()["text"].startswith("café")


def test_vectors_are_put_in_once(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<double>")
    path = f"file://{tmp_path}/vectors"
    assert [vectors.inserted(spark, v, path, "vec_id"), vectors.inserted(spark, v, path, "vec_id")] == [2, 0]
    assert spark.read.parquet(path).count() == 2
    e = {r["doc_id"]: r["embedding"] for r in vectors.embedded(texts_of(spark, "a b a", "", None), "doc_id", "text", 8).collect()}
    assert sum(x * x for x in e[0]) == pytest.approx(1.0) and e[1] is None and e[2] is None
