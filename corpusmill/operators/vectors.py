"""Ranking by vectors: exact top-k, best of a group, hybrid scores. A query vector is a literal; the scan is one projection and a top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.text import cosine, dot, jaccard, norm
from corpusmill.operators import pairs


def distance(metric: str, a: Column, b: Column) -> Column:
    """A score of which more is nearer."""
    if metric == "cosine":
        return cosine(a, b)
    if metric == "dot_product":
        return dot(a, b)
    if metric == "euclidean":
        return -F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, v: s + v * v))
    raise ValueError(f"unknown metric {metric}")


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def top(vectors: DataFrame, query: Column, k: int, metric: str = "cosine", least: float | None = None, key: str = "vec_id", column: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k nearest rows; filters hold before the ranking, ties go to the lower key."""
    df = vectors if where is None else vectors.where(where)
    df = df.withColumn("score", distance(metric, F.col(column), query))
    if least is not None:
        df = df.where(F.col("score") >= least)
    return df.orderBy(F.desc("score"), key).limit(k)


def best_of_group(scored: DataFrame, group: str, key: str) -> DataFrame:
    return scored.groupBy(group).agg(F.max_by(key, F.struct("score", -F.col(key))).alias(key), F.max("score").alias("score"))


def hybrid(similarity: Column, keywords: Column, popularity: Column, age_days: Column, boost: Column | None = None) -> Column:
    """Weighted sum of similarity, keyword share, popularity and freshness, times a boost that is 1 if unset."""
    return (0.6 * similarity + 0.2 * keywords + 0.1 * popularity + 0.1 * F.exp(-age_days / 30)) * (F.lit(1.0) if boost is None else F.coalesce(boost, F.lit(1.0)))


def page(ranked: DataFrame, offset: int, limit: int) -> DataFrame:
    """Hits with rank and whether more follow; the ranking is at most offset + limit + 1 rows."""
    few = ranked.orderBy(F.desc("score"), ranked.columns[0]).limit(offset + limit + 1)
    r = few.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), ranked.columns[0])))
    more = F.broadcast(r.agg((F.max("rank") > offset + limit).alias("has_more")))  # one row
    return r.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit)).crossJoin(more)


def similar_pairs(sets: DataFrame, key: str, words: str, least: float) -> DataFrame:
    """(a, b, similarity): pairs of rows whose arrays of distinct words have a Jaccard similarity of `least` or more.

    Words go by rising frequency. Such a pair shares `least` of the larger set's words, so their prefixes, of all but that many
    words and one, meet; a common word stands in few prefixes."""
    w = sets.select(F.col(key).alias("key"), F.size(words).alias("n"), F.explode(words).alias("w"))
    often = w.groupBy("w").agg(F.count(F.lit(1)).alias("often"))
    o = w.join(often, "w").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("often", "w"))).alias("o"))
    o = o.withColumn("w", F.explode(F.slice("o.w", F.lit(1), F.col("n") - F.ceil(least * F.col("n") - 1e-9).cast("int") + 1))).select("key", "n", "w")
    a, b = o.select(F.col("key").alias("a"), F.col("n").alias("na"), "w"), o.select(F.col("key").alias("b"), F.col("n").alias("nb"), "w")
    near = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= least * F.greatest("na", "nb") - 1e-9)
    near = a.join(b, "w").where(near).select("a", "b").distinct()
    full = sets.select(F.col(key).alias("k"), F.col(words).alias("t"))
    met = near.join(full.select(F.col("k").alias("a"), F.col("t").alias("ta")), "a").join(full.select(F.col("k").alias("b"), F.col("t").alias("tb")), "b")
    both = F.size(F.array_intersect("ta", "tb"))
    return met.withColumn("similarity", both / (F.size("ta") + F.size("tb") - both)).where(F.col("similarity") >= least).select("a", "b", "similarity")


def related_top(sets: DataFrame, key: str, words: str, most: int = 50, least: float = 0.5) -> DataFrame:
    """(a, b, similarity): for each row its `most` likest others by the Jaccard similarity of their arrays of distinct words, of those at `least` or above; ties go to the lower key.

    Equal sets are one, with its first keys. Pairs of sets are counted in squares, of which a row hands on its best only, so what is written is linear in the rows."""
    ids, g = pairs.numbered(sets, key, words)
    first = ids.withColumn("i", F.row_number().over(W.partitionBy("key").orderBy("doc"))).where(F.col("i") <= most + 1).groupBy("key").agg(F.array_sort(F.collect_list("doc")).alias("docs"))
    # no more sets than rows are asked for can hold the best of them
    rows = pairs.top(g, least, most + 1).unionByName(g.select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("similarity")))
    cand = rows.join(first.withColumnRenamed("key", "b"), "b").select("a", "similarity", F.explode("docs").alias("doc"))
    best = cand.withColumn("i", F.row_number().over(W.partitionBy("a").orderBy(F.desc("similarity"), "doc"))).where(F.col("i") <= most + 1)
    lists = best.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("i", "doc", "similarity"))).alias("l"))
    out = ids.join(lists.withColumnRenamed("a", "key"), "key").select(F.col("doc").alias("a"), F.slice(F.filter("l", lambda x: x["doc"] != F.col("doc")), 1, most).alias("l"))
    return out.select("a", F.explode("l").alias("x")).select("a", F.col("x.doc").alias("b"), "x.similarity")


def multi_search(datasets: dict[str, tuple[DataFrame, str]], query: Column, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(dataset, id, score): the k nearest over several datasets, each with its metric; each gives its own k first."""
    parts = [top(v, query, k, metric, key=key, column=column).select(F.lit(name).alias("dataset"), F.col(key).alias("id"), "score") for name, (v, metric) in datasets.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc(F.round("score", 6)), "dataset", "id").limit(k)


def dataset_stats(vectors: DataFrame, group: str, column: str) -> DataFrame:
    return vectors.where(F.col(column).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(F.size(column)).alias("dims"), F.avg(norm(F.col(column))).alias("mean_norm"))


def upserted(vectors: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    return vectors.join(changes, key, "left_anti").unionByName(changes.select(vectors.columns))


def deleted(vectors: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return vectors.join(ids, key, "left_anti")


def embedded(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(key, embedding): signed counts of hashed words over `width` dimensions, of unit length; null for a text without words."""
    t = T.words(F.lower(F.coalesce(F.col(text), F.lit(""))))
    h = F.transform(t, lambda w: F.xxhash64(w))
    rows = docs.select(key, F.posexplode_outer(h).alias("i", "h")).select(key, F.pmod("h", F.lit(width)).cast("int").alias("at"), F.when(F.col("h") < 0, -1.0).otherwise(1.0).alias("v"))
    cells = rows.groupBy(key, "at").agg(F.sum("v").alias("v"))
    g = cells.groupBy(key).agg(F.map_from_entries(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "v")))).alias("m"), F.sqrt(F.sum(F.when(F.col("at").isNotNull(), F.col("v") * F.col("v")))).alias("n"))
    return g.select(key, F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("n"))).alias("embedding"))


def inserted(spark, vectors: DataFrame, path: str, key: str) -> int:
    """Appends the vectors whose key the Parquet dataset at `path` does not have yet; how many there were."""
    try:
        there = spark.read.parquet(path).select(key)
        vectors = vectors.join(there, key, "left_anti")
    except Exception as e:  # noqa: BLE001  a dataset that is not there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    before = vectors.count()
    vectors.write.mode("append").parquet(path)
    return before


def clusters(vectors: DataFrame, group: str, column: str) -> DataFrame:
    """(group, n, norm): size of each cluster and the length of its mean vector."""
    n = vectors.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    m = vectors.select(group, F.posexplode(column).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy(group).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return n.join(m, group, "left")


#: Weights of the evidences of a relationship.
EVIDENCE = {"content": 0.4, "metadata": 0.2, "time": 0.1, "author": 0.15, "tags": 0.15}


def related(pairs: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(a, b, strength, confidence, kind) of pairs (a, b, similarity) whose rows have title (array of words), kind, lang, day, author and tags.

    Each evidence above a tenth adds its weight; confidence is their share of five. Over .9 is a duplicate, over .7 similar, else related."""
    a, b = (rows.select(*[F.col(c).alias(x if c == key else f"{c}_{x}") for c in rows.columns]) for x in "ab")
    j = pairs.join(a, "a").join(b, "b")
    same = lambda c: F.coalesce(F.col(f"{c}_a") == F.col(f"{c}_b"), F.lit(False)).cast("double")
    parts = {
        "content": F.col("similarity"),
        "metadata": (jaccard(F.col("title_a"), F.col("title_b")) + same("kind") + 0.5 * same("lang")) / 3,
        "time": F.exp(-F.abs(F.col("day_a") - F.col("day_b")) / 30),
        "author": same("author"),
        "tags": jaccard(F.col("tags_a"), F.col("tags_b")),
    }
    j = j.select("a", "b", *[F.coalesce(v, F.lit(0.0)).alias(k) for k, v in parts.items()])
    strength = sum((F.when(F.col(k) > 0.1, F.col(k) * w).otherwise(0.0) for k, w in EVIDENCE.items()), F.lit(0.0))
    sure = sum(((F.col(k) > 0.1).cast("int") for k in EVIDENCE), F.lit(0)) / 5
    return j.select("a", "b", strength.alias("strength"), sure.alias("confidence")).withColumn("kind", F.when(F.col("strength") > 0.9, "duplicate").when(F.col("strength") > 0.7, "similar").otherwise("related"))


def extremes(pairs: DataFrame, most: int) -> DataFrame:
    """(a, b, side, k): the strongest and the weakest pairs, each side a top-k before it is numbered."""
    out = None
    for side, order in (("strongest", F.desc(F.round("strength", 6))), ("weakest", F.asc(F.round("strength", 6)))):
        few = pairs.orderBy(order, "a", "b").limit(most)
        part = few.select("a", "b", F.lit(side).alias("side"), F.row_number().over(W.orderBy(order, "a", "b")).alias("k"))
        out = part if out is None else out.unionByName(part)
    return out
