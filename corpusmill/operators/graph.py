"""Graphs as node and edge tables: degree, density, components, k-hop, shortest paths, PageRank. Rounds end their lineage with a checkpoint."""

from __future__ import annotations

import random

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import cosine


def settled(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return df.checkpoint()


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """Degree of each node and its share of the other nodes."""
    d = undirected(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    n = F.broadcast(d.agg(F.count(F.lit(1)).alias("nodes")))  # one row
    return d.crossJoin(n).select("node", "degree", (F.col("degree") / F.greatest(F.col("nodes") - 1, F.lit(1))).alias("centrality"))


def numbered(nodes: DataFrame) -> tuple[DataFrame, int]:
    """(node, id) of distinct nodes and the salt of number(): 64-bit hashes, salted anew until no two nodes share one."""
    salt = 0
    while True:
        n = settled(nodes.distinct().select("node", number("node", salt).alias("id")))
        if n.groupBy("id").count().where("count > 1").isEmpty():
            return n, salt
        salt += 1


def number(node: str, salt: int) -> Column:
    return F.xxhash64(F.lit(salt), F.col(node))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, edges in both directions.

    In each round all nodes are drawn together with their neighbour (or themselves) that comes first in an order of the round, and
    edges within what has been drawn together go; so what is joined shrinks from round to round."""
    e = edges.select("src", "dst").where("src is not null and dst is not null")
    nodes, salt = numbered(e.select(F.explode(F.array("src", "dst")).alias("node")))
    e = settled(e.select(number("src", salt).alias("a"), number("dst", salt).alias("b")).where("a <> b"))
    drawn = []
    while not e.isEmpty():
        mask = F.lit(random.Random(len(drawn)).getrandbits(63))
        near = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min(F.col("b").bitwiseXOR(mask)).alias("m"))
        to = settled(near.select(F.col("a").alias("id"), F.least("m", F.col("a").bitwiseXOR(mask)).bitwiseXOR(mask).alias("to")))
        drawn.append(to)
        x = e.join(to.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("id").alias("b"), F.col("to").alias("y")), "b").where("x <> y")
        e = settled(x.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    roots = nodes.select("id", F.col("id").alias("root")) if not drawn else drawn.pop().withColumnRenamed("to", "root")
    for to in reversed(drawn):
        roots = to.join(roots.withColumnRenamed("id", "to"), "to", "left").select("id", F.coalesce("root", "to").alias("root"))
    labels = settled(nodes.join(roots, "id", "left").select("node", F.coalesce("root", "id").alias("root")))
    return settled(labels.join(labels.groupBy("root").agg(F.min("node").alias("component")), "root").select("node", "component"))


def within(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(node, hops): nodes within some hops of the start nodes, with the least number."""
    e = settled(undirected(edges))
    seen = start.select("node", F.lit(0).alias("hops"))
    for k in range(1, hops + 1):
        new = e.join(seen.where(F.col("hops") == k - 1).select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        seen = settled(seen.unionByName(new.join(seen, "node", "left_anti").select("node", F.lit(k).alias("hops"))))
    return seen


def shortest(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, distance) by non-negative edge weights, relaxed until nothing gets nearer. Edges are dealt out by their start once, as numbers; a round moves distances only."""
    spark = edges.sparkSession
    e = edges.select("src", "dst", "weight").where("src is not null and dst is not null")
    nodes, salt = numbered(e.select(F.explode(F.array("src", "dst")).alias("node")).unionByName(start.select("node")))
    w = e.select(number("src", salt).alias("a"), number("dst", salt).alias("b"), "weight")
    w = w.unionByName(w.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    w = w.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "a").persist(StorageLevel.DISK_ONLY)
    w.count()
    far = settled(start.select(number("node", salt).alias("a"), F.lit(0.0).alias("distance"), F.lit(True).alias("new")))
    while not far.where("new").isEmpty():
        step = w.join(far.where("new").select("a", "distance"), "a").select(F.col("b").alias("a"), (F.col("distance") + F.col("weight")).alias("try"))
        best = far.select("a", "distance", F.lit(None).cast("double").alias("try")).unionByName(step.select("a", F.lit(None).cast("double").alias("distance"), "try"))
        g = best.groupBy("a").agg(F.min("distance").alias("old"), F.min("try").alias("try"))
        far = settled(g.select("a", F.least("old", "try").alias("distance"), F.coalesce(F.col("try") < F.col("old"), F.col("old").isNull()).alias("new")))
    w.unpersist()
    return nodes.join(far.withColumnRenamed("a", "id"), "id").select("node", "distance")


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank): directed, the mass of nodes without out-edges is not passed on."""
    e = edges.select("src", "dst").distinct()
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("out"))
    e = settled(e.join(out, "src"))
    nodes = settled(e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct())
    n = nodes.count()
    ranks = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for _ in range(rounds if n else 0):
        got = e.join(ranks.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        new = settled(ranks.join(got, "node", "left").select("node", F.col("rank").alias("old"), (F.lit((1 - damping) / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")))
        moved = new.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0]
        ranks = new.select("node", "rank")
        if moved < tolerance:
            break
    return ranks


def cooccurrences(mentions: DataFrame, key: str, name: str) -> DataFrame:
    """(src, dst, weight): names that stand under one key, src before dst, with how many keys bring them together."""
    m = mentions.select(key, name).distinct()
    a, b = m.withColumnRenamed(name, "src"), m.withColumnRenamed(name, "dst")
    return a.join(b, key).where("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def merged_nodes(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes (label, confidence, weight) of equal keys and labels, in any case, as one: confidence is their mean, weights add up."""
    return nodes.groupBy(*keys, F.lower("label").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"), F.sum("weight").alias("weight"))


def communities(edges: DataFrame, least: int = 3) -> DataFrame:
    """(component, size, edges, density, score) of components of `least` nodes or more; score is density times size."""
    e = settled(edges.select("src", "dst").distinct())
    labels = components(e)
    size = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    inside = e.join(labels.withColumnRenamed("node", "src"), "src").groupBy("component").agg(F.count(F.lit(1)).alias("edges"))
    density = F.col("edges") / (F.col("size") * (F.col("size") - 1) / 2)
    return size.join(inside, "component").where(F.col("size") >= least).select("component", "size", "edges", density.alias("density"), (density * F.col("size")).alias("score"))


def modularity(edges: DataFrame, least: int = 3) -> DataFrame:
    """One row (communities, modularity): over communities, the share of edges inside less the square of their share of degrees."""
    e = settled(edges.select("src", "dst").distinct())
    labels = components(e)
    degree = undirected(e).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    g = labels.join(degree, "node").groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("degree").alias("degrees"))
    inside = e.join(labels.withColumnRenamed("node", "src"), "src").groupBy("component").agg(F.count(F.lit(1)).alias("edges"))
    m = F.broadcast(e.agg(F.count(F.lit(1)).alias("m")))  # one row
    part = F.col("edges") / F.col("m") - F.pow(F.col("degrees") / (2 * F.col("m")), 2)
    return g.join(inside, "component").where(F.col("size") >= least).crossJoin(m).agg(F.count(F.lit(1)).alias("communities"), F.sum(part).alias("modularity"))


def nodes_of(nodes: DataFrame, kind: str | None = None, label: str | None = None) -> DataFrame:
    """Nodes of a type and of a label, in any case; None is any."""
    out = nodes if kind is None else nodes.where(F.col("kind") == kind)
    return out if label is None else out.where(F.lower("label") == label.lower())


def similar_nodes(nodes: DataFrame, key: str, vector: str, where: Column, least: float) -> DataFrame:
    """(key, score) of the nodes that hold `where` with a cosine of `least` or more to the vector of the node of the least key that has one."""
    q = F.broadcast(nodes.where(F.col(vector).isNotNull()).agg(F.min_by(vector, key).alias("_q")))  # one row
    s = nodes.where(where).crossJoin(q).select(key, cosine(F.col(vector), F.col("_q")).alias("score"))
    return s.where(F.col("score") >= least)
