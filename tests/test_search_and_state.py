"""The stemmer and the index, streams with timers, running averages in parts, sketches, pruned vectors, tables of patterns, features by language."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.stem import stemmed
from corpusmill.functions import language
from corpusmill.functions import text as T
from corpusmill.operators import dlp, search, stats, vector_index, vectors
from corpusmill.streaming import jobs, stateful

#: Pairs of the stemmer's published vocabulary.
STEMS = (
    "consign consign consigned consign consignment consign consistency consist consistently consist consolation consol consolatory consolatori console consol consolidate consolid consonant conson conspicuous conspicu "
    "conspiracy conspiraci conspirator conspir constable constabl constancy constanc knack knack knaves knave knavish knavish kneaded knead knees knee knightly knight knitting knit knowingly know knowledge knowledg "
    "generate generat general general generic generic happy happi running run hopping hop hoping hope skies sky dying die cry cri by by say say cities citi relational relat conditional condit agreed agre feed feed "
    "plastered plaster sing sing motoring motor conflated conflat troubled troubl sized size ties tie gas gas gaps gap this this caresses caress ponies poni inning inning proceeding proceed hopefulness hope "
    "electricity electr adjustable adjust adoption adopt controlling control roll roll youth youth flying fli analogy analog possibly possibl licenses licens licensed licens documentation document university univers"
).split()


def test_stems(spark):
    want = dict(zip(STEMS[::2], STEMS[1::2], strict=True))
    got = {r.word: r.term for r in stemmed(spark.createDataFrame([(w, 1) for w in want], "word string, k int"), "word", "term").collect()}
    assert got == want


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}/words"
    texts = ["The licensed software", "Licenses, of SOFTWARE!", "a license", None, "", "software and the license; Äpfel 3d", "the of and"] + [f"word{i} license" for i in range(300)]
    search.build(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text", path, buckets=16)
    return path


def test_matching(spark, index):
    of = lambda q: sorted(r.key for r in search.matching(spark, index, q, 16).collect())
    assert of("licensing the software") == [0, 1, 5]
    assert of("äpfel 3D") == [5]
    assert of("of the") == [] and of("unheard license") == [] and of("") == []
    assert len(of("license")) == 304
    asked = spark.createDataFrame([("a", "licensing the software"), ("b", "word7"), ("c", "of the"), ("d", None)], "q string, t string")
    assert sorted(tuple(r) for r in search.matching_all(spark, index, asked, "q", "t", 16).collect()) == [("a", 0), ("a", 1), ("a", 5), ("b", 14)]
    assert sorted(tuple(r) for r in search.phrase(spark, index, "licenses of software", 16).collect()) == [(1, 1)]
    assert [r.key for r in search.phrase(spark, index, "software licensed", 16).collect()] == []


def test_index_is_read_in_part(spark, index):
    plan = search.matching(spark, index, "word7 license", 16)._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(term" in plan


BASE = dt.datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(u, BASE + dt.timedelta(seconds=t), k, v) for u, t, k, v in rows], "user_id long, ts timestamp, kind string, value double")


def stream_of(spark, path, parts):
    """The parts as files of a stream that takes one file a batch."""
    for i, rows in enumerate(parts):
        events(spark, rows).coalesce(1).write.parquet(f"{path}/part={i}")
    return spark.readStream.schema(events(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")


def test_alerts_fire_by_a_timer_and_equal_the_batch_form(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.randrange(4), r.randrange(40_000), "x", r.choice([1.0, 30.0, 30.0, None])) for _ in range(400)]
    rows += [(9, 100, "x", 50.0), (8, 100, "x", 50.0), (8, 1300, "x", 50.0), (8, 1301, "x", 0.0), (0, 60_000, "x", 1.0)]
    rows.sort(key=lambda x: x[1] + r.randrange(500))  # out of order within the lateness
    parts = [rows[i : i + 60] for i in range(0, len(rows), 60)]
    breach = F.col("value") > 20
    with stateful.rocksdb(spark):
        got = jobs.collected(stateful.alerts(stream_of(spark, f"file://{tmp_path}/a", parts), ["user_id"], "ts", breach, 1200_000, 3600_000), "append").collect()
    until = int((BASE.replace(tzinfo=dt.timezone.utc).timestamp() + 60_000 - 600) * 1000)
    want = stateful.fold_alerts(events(spark, rows), ["user_id"], "ts", breach, 1200_000, 3600_000, until).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    at = lambda s: int((BASE.replace(tzinfo=dt.timezone.utc).timestamp() + s) * 1000)
    # one value over the limit and nothing after it: only a timer can fire
    assert [(x.event, x["at"]) for x in got if x.user_id == 9] == [("fired", at(1300))]
    assert [(x.event, x["at"]) for x in got if x.user_id == 8] == [("fired", at(1300)), ("resolved", at(1301))]


def test_alerts_go_on_after_a_restart(spark, tmp_path):
    parts = [[(1, 0, "x", 50.0)], [(1, 2000, "x", 50.0)], [(1, 9000, "x", 0.0)], [(1, 20_000, "x", 0.0)]]
    src, out = f"file://{tmp_path}/r", f"file://{tmp_path}/out"

    def run():
        stream = spark.readStream.schema(events(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/part=*")
        found = stateful.alerts(stream, ["user_id"], "ts", F.col("value") > 20, 5000_000, 0)
        with stateful.rocksdb(spark):
            save = lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")
            found.writeStream.outputMode("append").option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()

    for i, rows in enumerate(parts):
        events(spark, rows).coalesce(1).write.parquet(f"{src}/part={i}")
        run()
    got = spark.read.parquet(out).orderBy("at").collect()
    zero = int(BASE.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert [(x.event, x["at"] - zero) for x in got] == [("fired", 5000_000), ("resolved", 9000_000)]


def test_sessions_expire(spark, tmp_path):
    rows = [(1, 0, "a", 1.0), (1, 500, "b", None), (1, 400, "a", 3.0), (1, 5000, "c", 1.0), (2, 100, None, None), (3, 20_000, "z", 1.0)]
    with stateful.rocksdb(spark):
        got = jobs.collected(stateful.sessions(stream_of(spark, f"file://{tmp_path}/s", [rows[:3], rows[3:]]), ["user_id"], "ts", "kind", "value", 1000_000), "append").collect()
    zero = int(BASE.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    have = sorted((x.user_id, (x.start - zero) // 1000, (x.last - zero) // 1000, x.requests, x.kinds, x["mean"]) for x in got)
    assert [x[:5] for x in have] == [(1, 0, 500, 3, "a,b"), (1, 5000, 5000, 1, "c"), (2, 100, 100, 1, "")]
    assert have[0][5] == 2.0 and have[2][5] is None or have[2][5] != have[2][5]


@pytest.mark.parametrize("fan", [2, 3, 32])
def test_running_average_of_a_hot_key(spark, fan):
    r = random.Random(2)
    rows = [("hot" if r.random() < 0.7 else f"k{r.randrange(5)}", i, r.choice([None, r.uniform(-5, 5)])) for i in range(3000)] + [("one", 5, 2.5), ("none", 1, None)]
    want = {}
    for k, _, v in rows:
        if v is not None:
            want[k] = v if k not in want else 0.7 * want[k] + 0.3 * v
    df = spark.createDataFrame(r.sample(rows, len(rows)), "k string, t long, v double")
    out = stats.ema(df, ["k"], ["t"], "v", F.floor(F.col("t") / 17) - 3, alpha=0.3, fan=fan)
    windows = re.findall(r"windowspecdefinition\(([^)]*)", out._jdf.queryExecution().optimizedPlan().toString())
    assert windows and all("_part" in w for w in windows)
    got = {x.k: x.ema for x in out.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert stats.ema(df.limit(0), ["k"], ["t"], "v", F.col("t")).count() == 0


def test_retries_until_done_or_dead(spark, tmp_path):
    rows = [(1, 0, "ok", None), (1, 10, "twice", None), (2, 20, "never", None), (2, 30, "once", None)]
    ticks = [[(9, t, "ok", None)] for t in (1500, 3000, 5000, 8000)]
    fails = {"ok": 0, "once": 1, "twice": 2, "never": 99}
    handler = lambda body, attempt: f"error {attempt}" if attempt <= fails[body] else None
    src, out = f"file://{tmp_path}/r", f"file://{tmp_path}/out"
    for i, part in enumerate([rows, *ticks]):
        events(spark, part).coalesce(1).write.parquet(f"{src}/part={i}")
        # a run a file: each goes on from the checkpoint of the one before
        stream = spark.readStream.schema(events(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/part=*")
        with stateful.rocksdb(spark):
            save = lambda b, n: b.write.mode("overwrite").parquet(f"{out}/batch={n}")
            q = stateful.retried(stream, ["user_id"], "ts", "kind", handler, 3, 600_000)
            q.writeStream.outputMode("append").option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
    got = sorted((r.body, r.event, r.tries, r.error) for r in spark.read.parquet(out).collect() if r.user_id != 9)
    assert got == [("never", "dead", 3, "error 3"), ("ok", "completed", 1, None), ("once", "completed", 2, None), ("twice", "completed", 3, None)]


def test_sketches_roll_up(spark):
    r = random.Random(3)
    rows = [(i % 2, BASE + dt.timedelta(minutes=i % 5000), r.gauss(0, 1) if i % 50 else None) for i in range(60_000)]
    df = spark.createDataFrame(rows, "k int, ts timestamp, v double")
    days = stats.sketch_quantiles(stats.rolled_up(stats.rolled_up(stats.sketched(df, ["k"], "ts", "v"), ["k"], "day"), ["k"], "month"), {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()
    assert len(days) == 2
    for d in days:
        own = sorted(v for k, _, v in rows if k == d.k and v is not None)
        assert d.n == len(own) and d.least == own[0] and d.most == own[-1] and d.total == pytest.approx(sum(own))
        for name, q in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99)):
            assert abs(sum(v <= d[name] for v in own) / len(own) - q) < 0.012


def planted(r, n):
    at = [[r.gauss(0, 10) for _ in range(6)] for _ in range(20)]
    return [(i, [c + r.gauss(0, 0.3) for c in r.choice(at)], i % 3) for i in range(n)]


@pytest.mark.parametrize("metric", ["cosine", "euclidean", "dot_product"])
def test_pruned_search_equals_the_scan(spark, tmp_path, metric):
    r = random.Random(5)
    rows = planted(r, 1500)
    rows += [(2000, None, 0), (2001, [1.0], 0), (2002, [0.0] * 6, 0), (2003, [None] * 6, 1), (2004, rows[3][1], 0), (2005, rows[3][1], 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    path = f"file://{tmp_path}/v"
    vector_index.build(v, path, metric, 6, cells=30)
    total = v.count()
    for i, where in ((3, None), (70, F.col("label") == 1), (5, F.col("vec_id") < 3)):
        q = rows[i][1]
        found, cells = vector_index.search(spark, path, q, 10, metric, where=where)
        want = vectors.top(v.where(F.size("embedding") == 6).where("not exists(embedding, x -> x is null)"), vectors.literal(q), 10, metric, where=where)
        assert [(a.vec_id, round(a.score, 9)) for a in found.collect()] == [(a.vec_id, round(a.score, 9)) for a in want.collect()]
        read = spark.read.parquet(path).where(F.col("cell").isin(cells)).count()
        if where is None:
            assert read < total / 2
            assert "PartitionFilters: [cell" in found._jdf.queryExecution().toString()


def test_a_table_of_ten_thousand_patterns(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcdeXY.é") for _ in range(r.randint(1, 9))) for _ in range(10_000)]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 3, 12])))) for i in range(40)] + [(None, "abc"), (None, "abc"), (7, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    patterns = [(f"p{i}", w) for i, w in enumerate(words)] + [("null", None), ("empty", "")]
    few, many = (dlp.scan_literal_table(df, spark.createDataFrame(p, "name string, literal string")) for p in (patterns[:3], patterns))
    size = lambda x: x._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert size(few) <= size(many) + 40 and size(many) <= size(few) + 40
    want = sorted((str(i), n, (t or "").find(w)) for i, t in docs for n, w in patterns if w and w in (t or ""))
    assert sorted((str(x.doc_id), x.name, x.start) for x in many.collect()) == want


def test_keyword_rules_as_a_table(spark):
    df = spark.createDataFrame([(1, "The Key (key) keyed. a+b A+B License"), (2, None)], "doc_id long, text string")
    rules = [("w", "high", "keyword", "key", True, False, None), ("part", None, "keyword", "key", False, True, None), ("sum", "low", "keyword", "a+b", False, False, ["A+B"]), ("none", "low", "keyword", "zzzz", False, False, None)]
    got = sorted(tuple(x) for x in dlp.scan_keyword_table(df, spark.createDataFrame(rules, dlp.RULE)).collect())
    assert got == [(1, "part", "medium", "key"), (1, "part", "medium", "key"), (1, "sum", "low", "a+b"), (1, "w", "high", "Key"), (1, "w", "high", "key")]


def test_features_by_language(spark):
    rows = [("en", "Orange people make simple table. Rhythm!"), ("es", "El agua que corre es de la cocina y no es la mía."), ("fr", "Le chat mange une pomme rouge dans la cuisine.")]
    t = spark.createDataFrame(rows, "lang string, text string")
    got = {r.lang: (r.y, r.h) for r in t.select("lang", *[c.alias(n) for c, n in zip(T.syllable_counts(F.col("text"), F.col("lang")), "yh", strict=True)]).collect()}
    # orange 2 (or-ang, silent e), people 1 (eo, silent e), make 1, simple 1, table. 2 (the mark ends the word), Rhythm! 1
    assert got["en"] == (8.0, 0.0)
    # single vowels: El 1 agua 3 que 2 corre 2 es 1 de 1 la 1 cocina 3 y 1 no 1 es 1 la 1 mía. 1
    assert got["es"] == (19.0, 2.0)
    # Le 1 chat 1 mange 2 une 2 pomme 2 rouge 3 dans 1 la 1 cuisine. 4
    assert got["fr"] == (17.0, 2.0)
    same = t.select("text", T.syllable_counts(F.col("text"), F.lit("en"))[0].alias("y"), F.aggregate(F.transform(T.words(F.col("text")), T.syllables), F.lit(0).cast("long"), lambda s, v: s + v).alias("z")).collect()
    assert all(r.y == r.z for r in same)
    stops = {r.lang: r.s for r in t.select("lang", language.stop_words(F.col("lang")).alias("s")).collect()}
    assert "el" in stops["es"] and "avec" in stops["fr"] and "they" in stops["en"]
