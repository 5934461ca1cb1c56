"""What the findings of round 3 are about: plans that don't carry words or texts about, and thresholds that rounding must not move."""

import datetime as dt
import math
import random
from decimal import Decimal

import duckdb
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from corpusmill.functions import entities, language
from corpusmill.functions import text as T
from corpusmill.operators import chunking, dlp, graph, keywords, pairs, quality, search, stats, vectors
from corpusmill.plans import registry
from corpusmill.streaming import jobs, stateful


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sentences_of_a_text_meet_without_a_shuffle(spark):
    rng = random.Random(5)
    texts = [". ".join(" ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(rng.randrange(3, 9))) for _ in range(rng.randrange(12))) + "." for _ in range(60)] + [""]
    out = quality.scores(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t")
    assert not any(x in plan(out) for x in ("Join", "Aggregate"))

    def brute(t):
        sets = [set(s.split()) for s in t.split(".") if len(s.encode()) > 10]
        pairs = [(a, b) for i, a in enumerate(sets) for b in sets[:i]]
        return sum(bool(a) and len(a & b) / len(a | b) > 0.8 for a, b in pairs) / len(pairs) if pairs else 0.0

    got = {x.k: x.redundancy for x in out.collect()}
    assert all(abs(got[i] - brute(t)) < 1e-12 for i, t in enumerate(texts)) and max(got.values()) > 0


def test_a_table_of_patterns_carries_a_text_once(spark):
    docs = spark.createDataFrame([(1, "the other thing\tis Here and here"), (2, "a b"), (2, "\t "), (None, "thin")], "doc_id long, text string")
    patterns = spark.createDataFrame([("the",), ("her",), ("here",), (" ",), ("g\tis",), ("thin",), ("thin",), ("Z",)], "literal string").withColumn("name", F.col("literal"))
    found = dlp.scan_literal_table(docs, patterns)
    # patterns are gathered before they meet the texts
    assert plan(dlp.candidates(docs, patterns)).count("collect_list") == 2
    want = [(d, p, t.find(p)) for d, t in ((1, "the other thing\tis Here and here"), (2, "a b"), (2, "\t "), (None, "thin")) for p in ("the", "her", "here", " ", "g\tis", "thin", "thin", "Z") if p in t]
    assert sorted((str(x.doc_id), x.name, x.start) for x in found.collect()) == sorted((str(d), p, s) for d, p, s in want)


def test_variances_and_roundings_are_those_of_sql(spark):
    con = duckdb.connect()
    rng = random.Random(7)
    lists = [[rng.randrange(1, 40) for _ in range(rng.randrange(1, 30))] for _ in range(400)] + [[x, x + 4] * n for x in range(9) for n in range(1, 20)] + [[]]
    df = spark.createDataFrame([(x,) for x in lists], "s array<int>")
    want = [con.execute("select var_pop(x) from (select unnest($1::int[]) as x)", [x]).fetchone()[0] for x in lists]
    assert [r.v for r in df.select(T.variance_of(F.col("s")).alias("v")).collect()] == want
    v = [k / n for n in (64, 128, 320, 640) for k in range(n)]
    got = spark.createDataFrame([(x,) for x in v], "x double").select(T.half_up(F.col("x"), 6).alias("y")).collect()
    assert [r.y for r in got] == [x[0] for x in con.execute("select round(x, 6) from (select unnest($1::double[]) as x)", [v]).fetchall()]


def test_sentiment_weights_are_decimals(spark):
    words = [w for w, v in language.L.SENTIMENT.items() if v in (0.7, 0.9)][:1] * 3
    strong = [w for w, v in language.L.INTENSIFIERS.items() if v in (1.1, 1.3, 1.7)]
    texts = [f"{a} {b} {words[0]}" for a in strong for b in strong]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(language.sentiment_sentences(F.col("t"))[0]["magnitude"].alias("v")).collect()
    d = lambda x: Decimal(str(x))
    want = [float(min(Decimal(1), d(language.L.SENTIMENT[words[0]]) * d(language.L.INTENSIFIERS[b]) * d("0.8") * d(language.L.INTENSIFIERS[a]))) for a in strong for b in strong]
    assert [r.v for r in got] == want


def test_cuts_of_a_sketch_are_read_once(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "cast(id as double) as v")
    out = stats.percentiles(df, ["k"], "v", {"p": 0.5})
    assert "percentile_approx" not in plan(out) and sorted(r.p for r in out.collect()) == [499.0, 499.5, 500.0]


def test_automated_index_multiplies_exactly(spark):
    m = {k: F.lit(float(v)) for k, v in {"words": 320, "sentences": 20, "syllables": 400, "hard": 10, "letters": 1500, "characters": 1525}.items()}
    got = spark.range(1).select(*[T.readability({k: F.lit(float(c)) if k == "characters" else v for k, v in m.items()})["ari"].alias(f"a{c}") for c in range(1500, 1600)]).first()
    assert list(got) == [float(Decimal("4.71") * c) / 320.0 + 0.5 * 320.0 / 20.0 - 21.43 for c in range(1500, 1600)]


def test_chunks_are_handed_on_before_a_batch_is_done(spark, monkeypatch):
    docs = spark.createDataFrame([(i, None if i == 3 else f"Sentence {i} of many words. " * (i * 20)) for i in range(60)], "doc_id long, text string").repartition(2)
    want = sorted((i, n, c) for i, t in docs.collect() if t is not None for n, c in enumerate(chunking.fixed(t, overlap=0)))
    assert chunking.HELD <= 1 << 20
    for held in (1, 2500, chunking.HELD):
        monkeypatch.setattr(chunking, "HELD", held)
        out = chunking.chunked(docs, "doc_id", "text", "sentence")
        assert sorted((x.doc_id, x.number, x.content) for x in out.collect()) == want


def some_sets(rng, n):
    sets = [sorted(rng.sample(range(70), rng.choice([0, 1, 3, 10, 25]))) for _ in range(n)]
    return [(i, [f"w{x}" for x in (sets[i - 1] if i % 9 == 0 else s)]) for i, s in enumerate(sets)]


def test_links_are_counted_without_their_pairs(spark, monkeypatch):
    rows = some_sets(random.Random(3), 140)
    for group in (50, 16384):
        monkeypatch.setattr(pairs, "GROUP", group)
        out = pairs.linked(spark.createDataFrame(rows, "k int, w array<string>"), "k", "w", 0.5)
        got = {x.k: (x.class_id, x.n_links, x.component_id) for x in out.collect()}
        like = lambda x, y: bool(x and y) and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.5
        near = {a: [b for b, y in rows if b != a and like(x, y)] for a, x in rows}

        def least(a):
            seen, todo = {a}, [a]
            while todo:
                new = set(near[todo.pop()]) - seen
                seen |= new
                todo += new
            return min(seen)

        assert got == {a: (min([b for b, y in rows if x and x == y] or [a]), len(near[a]), least(a)) for a, x in rows}


def test_best_rows_come_without_a_join_of_candidates(spark, monkeypatch):
    monkeypatch.setattr(pairs, "GROUP", 40)
    rows = some_sets(random.Random(4), 120)
    out = vectors.related_top(spark.createDataFrame(rows, "k int, w array<string>"), "k", "w", 3)
    assert "array_intersect" not in plan(out)
    want = set()
    for a, x in rows:
        near = sorted((-len(set(x) & set(y)) / len(set(x) | set(y)), b) for b, y in rows if b != a and x and y)
        want |= {(a, b, round(-s, 9)) for s, b in [z for z in near if z[0] <= -0.5][:3]}
    assert {(x.a, x.b, round(x.similarity, 9)) for x in out.collect()} == want


def test_squares_of_counts_are_those_of_brute_force(monkeypatch):
    rows = [(k, x) for k, w in some_sets(random.Random(6), 150) if (x := [int(v[1:]) for v in w])]
    table = pa.table({"key": [k for k, _ in rows], "n": [len(x) for _, x in rows], "copies": [1] * len(rows), "s": [x for _, x in rows]})
    want = {(a, b) for a, x in rows for b, y in rows if a < b and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.3}
    for dense, square, held in ((1, 7, 9), (12, 16, 50), (1 << 30, 2048, 1 << 20), (1 << 30, 31, 1)):
        monkeypatch.setattr(pairs, "DENSE", dense)
        monkeypatch.setattr(pairs, "SQUARE", square)
        monkeypatch.setattr(pairs, "HELD", held)
        g = pairs.Group(table)
        got = [tuple(sorted((g.keys[int(p)].as_py(), g.keys[int(q)].as_py()))) for i, j, _ in pairs.links(g, g, True, 0.3) for p, q in zip(i, j, strict=True)]
        assert len(got) == len(want) and set(got) == want


def test_phrases_and_summaries_are_made_in_their_row(spark):
    df = spark.createDataFrame([(1, "Red fox runs. The red fox sleeps now! Short. A blue whale sings of the red fox."), (2, ""), (3, "one two three, one two three")], "k int, t string")
    p, s = keywords.phrases(df, "k", "t", 3), keywords.summaries(df, "k", "t", 0.3)
    assert not any(x in plan(d) for d in (p, s) for x in ("Join", "Aggregate", "Window"))
    assert [(x.k, x.phrase, x.n) for x in p.collect()] == [(1, "fox", 3), (1, "red", 3), (1, "red fox", 3), (3, "one", 2), (3, "one two", 2), (3, "three", 2)]
    assert {x.k: (x.n_sentences, x.kept, x.summary) for x in s.collect()} == {1: (3, 1, "Red fox runs"), 3: (1, 1, "one two three, one two three")}


def test_postings_are_shuffled_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "Licenses of the license, licensed"), (2, None), (1, "license"), (3, "the of")], "k int, t string")
    assert not any(x in plan(search.places(df, "k", "t")) for x in ("Join", "Aggregate", "Repartition"))
    search.build(df, "k", "t", str(tmp_path / "i"))
    rows = spark.read.parquet(str(tmp_path / "i")).collect()
    assert [(x.key, x.term, x.positions) for x in rows] == [(1, "licens", [1, 1, 4, 5])]


def test_topics_of_a_text_are_gathered_in_its_row(spark):
    df = spark.createDataFrame([(1, "Software and hardware\nSoftware networks. The networks of HARDWARE, software!"), (2, None), (3, "cat")], "k int, t string")
    out = keywords.topics(df, "k", "t")
    assert not any(x in plan(out) for x in ("Join", "Aggregate", "Window"))
    # hardware 2, software 3, each 8 bytes: the mean of 2 * 1.8 and 3 * 1.8
    assert [(x.k, x.topic, x.words, x.relevance) for x in out.collect()] == [(1, "Technology", "hardware software", 0.362372)]
    rng = random.Random(8)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(120)]

    def steps(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row = row, [i, *[0] * len(b)]
            for j, y in enumerate(b, 1):
                row[j] = min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y))
        return row[-1]

    near = lambda a, b: a in b or b in a or min(len(a), len(b)) > 4 and (a[:4] == b[:4] or a[-4:] == b[-4:] or steps(a, b) <= 2)
    assert all(keywords._alike(a, b) == near(a, b) for a in words for b in words)


def test_keywords_of_a_text_are_counted_in_its_row(spark):
    df = spark.createDataFrame([(1, "  Storage engines\t\n" + "x" * 120 + " Storage of engines. Köln, the köln! aaa aaa"), (2, None), (3, "")], "k int, t string")
    out = keywords.keywords(df, "k", "t", 9)
    assert not any(x in plan(out) for x in ("Join", "Aggregate", "Window"))
    # the run of x is too long, köln has five bytes and ends a sentence; aaa counts among all eight words, but is of one letter
    want = [("engines", 2, 2 / 8 * math.log(2.8)), ("storage", 2, 2 / 8 * math.log(2.8)), ("köln", 2, 2 / 8 * math.log(2.3))]
    assert [(x.keyword, x.frequency, round(x.score, 9), x["rank"]) for x in out.collect()] == [(w, n, round(s, 9), i) for i, (w, n, s) in enumerate(want, 1)]


ODD = ["of the of the of the", "", "in in the the in the", "que la que la que el", "à la à la für die für die", "Ñandú el de la de la", "the"]


def test_languages_are_counted_as_patterns_would(spark):
    df = spark.createDataFrame([(t,) for t in ODD], "t string").select(language.letters_only(F.col("t")).alias("c"))
    assert "regexp_count" not in plan(df.select(language.language_scores(F.col("c"))))
    L = language.L.LANGUAGE
    want = {f"{k}_{x}": F.regexp_count(F.concat(F.lit(" "), "c", F.lit(" ")), F.lit(f" (?=(?:{'|'.join(y[k])}) )")) for x, y in L.items() for k in ("common", "stop", "pairs") if y[k]}
    want |= {"n": F.regexp_count("c", F.lit("[^ ]+")), "letters": F.length(F.replace("c", F.lit(" "), F.lit("")))}
    r = df.select(language.language_counts(F.col("c").cast("binary")).alias("got"), F.struct(*[v.alias(k) for k, v in want.items()]).alias("want")).collect()
    assert all(x.got[k] == x.want[k] for x in r for k in want) and sum(x.want["pairs_en"] for x in r) == 5


def test_content_words_are_counted_in_one_pass(spark):
    df = spark.createDataFrame([(1, "The ÄPFEL, äpfel; good-good data_set NASA! theoretically\ttheory\u00a0of", "en"), (2, "", "xx"), (3, "el agua para agua", "es")], "k int, t string, lang string")
    out = df.select("k", language.content_counts(F.col("t").cast("binary"), F.lower("t").cast("binary"), "lang").alias("c"))
    got = {x.k: x.c.asDict() for x in out.collect()}
    assert got[1] == {"words": 8, "distinct": 6, "once": 5, "content": 7, "technical": 6, "abstract": 1, "good": 2, "bad": 0, "own": 0, "facts": 1}
    assert got[3]["words"] == 4 and (got[3]["distinct"], got[3]["once"], got[3]["content"]) == (1, 0, 2) and not any(got[2].values())


def test_kinds_of_words_are_counted_without_sorting(spark):
    df = spark.createDataFrame([("One, one. two ... ,,, (two)", 4, 2), ("", 0, 0), ("a", 1, 1)], "t string, d int, o int")
    out = df.select("d", "o", language.kinds_of_words(F.lower("t").cast("binary")).alias("k"))
    assert all((x.d, x.o) == (x.k.distinct, x.k.once) for x in out.collect()) and "array_sort" not in plan(out)


def test_vocabulary_is_counted_in_its_row(spark, tmp_path):
    spark.createDataFrame([(1, "(Cat) cat 'cat' [CAT] the The the the ... wonderful!"), (2, None), (3, "...")], "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = registry.QUERIES["vocabulary_stats"](spark, str(tmp_path))
    assert not any(x in plan(out) for x in ("Join", "Aggregate"))
    assert {x.doc_id: tuple(x)[1:] for x in out.collect()} == {1: (10, 3, 1, 1, 1, "3:8,9:1"), 3: (1, 0, 0, 0, 0, "")}


def test_syllables_of_the_model_are_counted_once_a_word(spark):
    df = spark.createDataFrame([(1, "The 123 naïve queue, 'A' rhythm? Elaborated!! be"), (2, "")], "k int, t string")
    out = df.select("k", T.model_counts(F.col("t").cast("binary"), F.lower("t").cast("binary")).alias("c"))
    # the 1 (0 less, at least 1), 123 0, nave 1, queue 3, a 1, rhythm 1, elaborated 5, be 1
    assert [(x.k, *x.c) for x in out.collect()] == [(1, 8, 2, 31, 13, 2), (2, 0, 1, 0, 0, 0)]
    assert "transform" not in plan(out)


def test_weights_of_sentiment_are_added_in_order(spark):
    rng = random.Random(11)
    good, bad = language.L.POSITIVE, language.L.NEGATIVE
    texts = [" ".join(rng.choice([*good, *bad, "x", "neutral", "Ärger"]) + rng.choice(["", "!", "\t"]) for _ in range(rng.randrange(60))) for _ in range(40)]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.weighed(F.lower("t").cast("binary")).alias("w"))
    for x in out.collect():
        words = [w for w in ("".join(c for c in w if c.isascii() and (c.isalnum() or c == "_")) for w in x.t.lower().split()) if len(w) >= 2]
        want = [0.0, 0.0]
        for w in words:
            want = [want[0] + good.get(w, 0.0), want[1] + bad.get(w, 0.0)]
        assert (x.w.n, [x.w.good, x.w.bad]) == (len(words), want)
    assert "aggregate" not in plan(spark.createDataFrame([("a",)], "t string").select(T.sentiment_ratio(F.col("t"))))


class Handle:
    """State of one bucket, and the timers that are set."""

    def __init__(self):
        self.timers, self.rows = [], []

    def getListState(self, name, schema):
        return self

    def registerTimer(self, at):
        self.timers.append(at)

    def appendList(self, rows):
        self.rows += rows

    def get(self):
        return iter(self.rows)

    def clear(self):
        self.rows = []


def test_retries_set_one_timer_for_all_that_wait():
    class Until:
        def getCurrentWatermarkInMs(self):
            return 1500

    handle, p = Handle(), stateful.Retries(["user_id"], lambda body, attempt: "no", 3, 1000)
    p.init(handle)
    f = pd.DataFrame({"of": [{"user_id": 2**53 + 1}] * 30 + [{"user_id": None}] * 30, "at": range(60), "body": ["x"] * 60})
    assert list(p.handleInputRows((7,), iter([f, f.assign(at=f["at"] + 900)]), Until())) == []
    assert handle.timers == [1000] and len(handle.rows) == 2  # not one each
    handle.timers.clear()
    assert list(p.handleExpiredTimer((7,), Until(), None)) == [] and handle.timers == [1900] and len(p.read()) == 120
    assert {r[0] for r in p.read()} == {(2**53 + 1,), (None,)}
    assert list(p.handleExpiredTimer((7,), Until(), None)) == [] and handle.timers == [1900]  # a second timer of the batch has nothing left


def test_sessions_are_built_in_windows(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    late = lambda ms, us=0: at + dt.timedelta(milliseconds=ms, microseconds=us)
    # 1: 999 ms after the millisecond of the row before, though 1000 ms less 1 us after it; 2: just a second, so the next session; null keys are one user
    rows = [(1, at, "b", float("nan")), (1, late(999, 999), "a", 4.0), (2, at, "", 1.0), (2, late(1000), None, None), (None, at, "x", 2.0), (None, late(1), "x", 4.0), (3, late(10_000_000), "z", 0.0)]
    spark.createDataFrame(rows, "user_id long, ts timestamp, kind string, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp, kind string, value double").parquet(str(tmp_path / "in"))
    out = stateful.sessions(stream, ["user_id"], "ts", "kind", "value", 1000)
    assert "TransformWithState" not in out._jdf.queryExecution().analyzed().toString()
    zero = spark.sql("select unix_millis(timestamp'2024-01-01 00:00:00')").first()[0]
    got = sorted((x.user_id or 0, x.start - zero, x.last - zero, x.requests, x.kinds, x["mean"]) for x in jobs.collected(out, "append").collect())
    assert got == [(0, 0, 1, 2, "x", 3.0), (1, 0, 999, 2, "a,b", 4.0), (2, 0, 0, 1, "", 1.0), (2, 1000, 1000, 1, "", None)]


def test_alerts_of_many_keys_share_calls(spark, tmp_path):
    at, big = dt.datetime(2024, 1, 1), 2**53 + 1
    rows = [(k, at, 50.0) for k in (None, big, *range(40))] + [(big, at + dt.timedelta(hours=1), 0.0), (5, at + dt.timedelta(days=1), 0.0)]
    spark.createDataFrame(rows, "user_id long, ts timestamp, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp, value double").parquet(str(tmp_path / "in"))
    out = stateful.alerts(stream, ["user_id"], "ts", F.col("value") > 20, 60_000, 0)
    assert "xxhash64" in out._jdf.queryExecution().analyzed().toString()  # grouped by a hash of the keys, not by each
    with stateful.rocksdb(spark):
        got = [(x.user_id, x.event) for x in jobs.collected(out, "append").collect()]
    assert sorted(got, key=str) == sorted([(k, "fired") for k in (None, big, *range(40))] + [(big, "resolved")], key=str)


def test_components_shrink_from_round_to_round(spark, monkeypatch):
    rng, n = random.Random(3), 300
    pairs_ = [(f"n{i}", f"n{i + 1}") for i in range(n)] + [(f"m{rng.randrange(50)}", f"m{rng.randrange(50)}") for _ in range(40)] + [("z", "z"), ("é", "n7"), ("n7", "é")]
    rng.shuffle(pairs_)
    near = {}
    for a, b in pairs_:
        near.setdefault(a, {a}).add(b)
        near.setdefault(b, {b}).add(a)

    def reached(v):
        seen, todo = {v}, [v]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        return min(seen, key=lambda x: x.encode())

    sizes, settled = [], graph.settled

    def counted(df):
        out = settled(df)
        if df.columns == ["a", "b"]:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "settled", counted)
    df = spark.createDataFrame(pairs_, "src string, dst string")
    # the first salt gives some nodes one number, so that another is taken
    number = graph.number
    monkeypatch.setattr(graph, "number", lambda node, salt: F.length(node).cast("long") if salt == 0 else number(node, salt))
    got = {x.node: x.component for x in graph.components(df).collect()}
    assert got == {v: reached(v) for v in near}
    # a chain of 300 took a round for every doubling with all edges in each; now edges go
    assert sizes[-1] == 0 and sum(sizes) < 4 * len(pairs_)


def test_rounds_of_shortest_paths_do_not_shuffle_edges(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(f"a{rng.randrange(30)}", f"b{rng.randrange(30)}", float(rng.randrange(6))) for _ in range(70)] + [("far", "away", 1.0)]
    want, moved = {"a1": 0.0}, True
    while moved:
        moved = False
        for a, b, w in edges + [(b, a, w) for a, b, w in edges]:
            if a in want and want[a] + w < want.get(b, math.inf):
                want[b], moved = want[a] + w, True
    steps, settled = [], graph.settled

    def kept(df):
        if "distance" in df.columns and "Join" in plan(df):
            df.collect()
            steps.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return settled(df)

    monkeypatch.setattr(graph, "settled", kept)
    start = spark.createDataFrame([("a1",), ("alone",)], "node string")
    got = {x.node: x.distance for x in graph.shortest(spark.createDataFrame(edges, "src string, dst string, weight double"), start).collect()}
    assert got == {**want, "alone": 0.0}
    assert steps
    for p in steps:  # what is shuffled is distances and what joins them, never the edges themselves
        lines = p.splitlines()
        at = next(i for i, x in enumerate(lines) if "InMemoryTableScan" in x and "weight" in x)
        join = max(i for i in range(at) if "Join" in lines[i])
        assert not any("Exchange" in x and "Broadcast" not in x and len(x) - len(x.lstrip(" :+-")) < len(lines[at]) - len(lines[at].lstrip(" :+-")) for x in lines[join + 1 : at])


def test_texts_are_lowered_once_and_phrases_found_by_a_word(spark):
    texts = ["TOP  secret", "a ts.", "its", "Classification:topsecret", "RESTRICTED x", "trade\nSECRET", "trade secre", "Internal\tONLY", "internal", "İnternal use", "patient information: confidential financial", "", "defense of intelligence", "4111 1111-1111 1111 a@b.co 123-45-6789 555.123.4567", "@ 4111 1-2 123"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert plan(df.select(entities.class_scores(F.col("t")).alias("c"))).count("lower(") == 1
    forms = [p for _, ps, _ in entities.L.SENSITIVITY_LEVELS.values() for p, _ in ps]
    got = df.select(F.array(*[entities.phrase(F.col("t"), F.lower("t"), p) for p in forms]), F.array(*[F.col("t").rlike(T.pattern(p)) for p in forms])).collect()
    assert all(x[0] == x[1] for x in got) and sum(map(sum, (x[0] for x in got))) == 9
    found = [x[0] for x in df.select(entities.rule_findings(F.col("t"))).collect()]
    assert found == [[]] * 13 + [["ssn", "credit_card", "email", "phone"], []]
