"""Graph queries: suppliers and parts that an order line brings together, all lines and parts. Where SQL would need endless recursion there is none; tests hold those against brute force."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions.entities import scan
from corpusmill.operators import graph as G
from corpusmill.plans.classify import ENTITIES
from corpusmill.plans.registry import query
from corpusmill.session import table

_E = "e as materialized (select distinct 's' || l_suppkey as src, 'p' || l_partkey as dst, 1.0 + (l_suppkey % 7) as weight from lineitem where l_suppkey is not null and l_partkey is not null)"
_U = "u as materialized (select src, dst, weight from e union select dst, src, weight from e)"


def edges(spark, d):
    """A supplier and a part for each pair that stands in an order line."""
    li = table(spark, d, "lineitem").where("l_suppkey is not null and l_partkey is not null").select("l_suppkey", "l_partkey").distinct()
    return li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), (1.0 + F.col("l_suppkey") % 7).alias("weight"))


def first_supplier(spark):
    return spark.createDataFrame([("s1",)], "node string")


@query(f"with {_E} select src, count(*) as n, sum(weight)::double as weight from e group by 1")
def kg_cooccurrence(spark, d):
    return edges(spark, d).groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


@query(f"with {_E}, {_U}, g as (select src as node, count(distinct dst) as degree from u group by 1) select node, degree, round(degree / (count(*) over () - 1), 6) as centrality from g")
def kg_degree_density(spark, d):
    return G.degrees(edges(spark, d)).withColumn("centrality", F.round("centrality", 6))


@query()
def kg_components(spark, d):
    return G.components(edges(spark, d))


@query(f"with {_E}, {_U}, a as (select 's1' as node, 0 as hops), b as (select distinct dst as node, 1 as hops from u where src = 's1'), c as (select distinct u.dst as node, 2 as hops from u join b on u.src = b.node) select node, min(hops)::int as hops from (select * from a union all select * from b union all select * from c) group by 1")
def kg_k_hop(spark, d):
    return G.within(edges(spark, d), first_supplier(spark), 2)


@query()
def kg_shortest_path(spark, d):
    return G.shortest(edges(spark, d), first_supplier(spark))


@query(f"""with {_E}, o as (select src, count(*) as out from e group by 1), n as (select count(*) as n from (select src from e union select dst from e)),
s as (select src as node, 0.15 / n as rank from o, n), p as (select dst as node, any_value(0.15 / n) + 0.85 * sum(s.rank / o.out) as rank from e join o on e.src = o.src join s on s.node = e.src, n group by 1)
select node, round(rank, 9) as rank from s union all select node, round(rank, 9) from p""")
def kg_pagerank(spark, d):
    """Edges go from suppliers to parts, so ranks settle in two rounds; the SQL has them in closed form."""
    return G.pagerank(edges(spark, d)).withColumn("rank", F.round("rank", 9))


@query(f"""with {ENTITIES}, w as materialized (select doc_id, kind || ':' || lower(value) as w from e union select doc_id, 'source:' || source from documents where source is not null)
select a.w as src, b.w as dst, count(*)::double as weight from w a join w b on a.doc_id = b.doc_id and a.w < b.w group by 1, 2""")
def kg_entity_cooccurrence(spark, d):
    """Entities and sources that stand in one document, with how many documents bring them together."""
    docs = table(spark, d, "documents")
    e = scan(docs).select("doc_id", F.concat_ws(":", "kind", F.lower("value")).alias("w"))
    s = docs.where("source is not null").select("doc_id", F.concat(F.lit("source:"), "source").alias("w"))
    return G.cooccurrences(e.unionByName(s), "doc_id", "w")


@query("""select kind, lower(label) as label, count(*) as n, round(avg(confidence), 6) as confidence, sum(weight)::double as weight from (select 'type' as kind, p_type as label, p_size / 50 as confidence, 1.0 as weight from part union all select 'brand', upper(p_brand), p_size / 50, 2.0 from part) group by 1, 2""")
def kg_node_upsert(spark, d):
    p = table(spark, d, "part")
    n = p.select(F.lit("type").alias("kind"), F.col("p_type").alias("label"), (F.col("p_size") / 50).alias("confidence"), F.lit(1.0).alias("weight"))
    n = n.unionByName(p.select(F.lit("brand").alias("kind"), F.upper("p_brand").alias("label"), (F.col("p_size") / 50).alias("confidence"), F.lit(2.0).alias("weight")))
    return G.merged_nodes(n, ["kind"]).withColumn("confidence", F.round("confidence", 6))


_C = "c as materialized (select distinct 'n' || c_nationkey as src, 'm' || c_mktsegment as dst from customer union select distinct 'r' || n_regionkey, 't' || n_nationkey from nation)"


def small_edges(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("src"), F.concat(F.lit("m"), "c_mktsegment").alias("dst"))
    return c.unionByName(table(spark, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("src"), F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("dst"))).distinct()


@query(f"""with recursive {_C}, u as (select src, dst from c union select dst, src from c), r as (select distinct src as node, src as root from u union select u.dst, r.root from r join u on u.src = r.node), k as (select node, min(root) as component from r group by 1),
g as (select component, count(*) as size from k group by 1), i as (select k.component, count(*) as edges from c join k on c.src = k.node group by 1)
select g.component, size, edges, round(edges / (size * (size - 1) / 2), 6) as density, round(edges / (size * (size - 1) / 2) * size, 6) as score from g join i on g.component = i.component where size >= 3""")
def kg_communities(spark, d):
    """Components of three nodes or more, over regions with their nations and nations with their segments."""
    return G.communities(small_edges(spark, d)).withColumns({c: F.round(c, 6) for c in ("density", "score")})


@query(f"""with recursive {_C}, u as (select src, dst from c union select dst, src from c), r as (select distinct src as node, src as root from u union select u.dst, r.root from r join u on u.src = r.node), k as (select node, min(root) as component from r group by 1),
g as (select component, count(*) as size, sum(degree) as degrees from k join (select src as node, count(*) as degree from u group by 1) using (node) group by 1), i as (select k.component, count(*) as edges from c join k on c.src = k.node group by 1), m as (select count(*) as m from c)
select count(*) as communities, round(sum(edges / m - power(degrees / (2 * m), 2)), 6) as modularity from g join i using (component), m where size >= 3""")
def kg_modularity(spark, d):
    return G.modularity(small_edges(spark, d)).withColumn("modularity", F.round("modularity", 6))


@query("""with q as (select embedding::double[] as q from embeddings where vec_id = (select min(vec_id) from embeddings where embedding is not null)) select vec_id, round(list_cosine_similarity(embedding::double[], q), 6) as score from embeddings, q where label = 0 and list_cosine_similarity(embedding::double[], q) >= 0.2""")
def kg_similar_nodes(spark, d):
    """Nodes of one type whose vector is near that of a node, the one of the least id."""
    v = table(spark, d, "embeddings")
    return G.similar_nodes(v, "vec_id", "embedding", F.col("label") == 0, 0.2).withColumn("score", F.round("score", 6))


_ROUNDS = 10
_RANKS = ", ".join(f"r{i + 1} as materialized (select n.node, 0.15 / (select count(*) from n) + 0.85 * coalesce(sum(r.rank / o.out), 0) as rank from n left join e on e.dst = n.node left join o on o.src = e.src left join r{i} r on r.node = e.src group by 1)" for i in range(_ROUNDS))


@query(f"""with e as materialized (select distinct src, dst from (select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as dst from lineitem) where dst is not null and src <> dst),
n as materialized (select src as node from e union select dst from e), o as materialized (select src, count(*) as out from e group by 1), r0 as (select node, 1.0::double / (select count(*) from n) as rank from n), {_RANKS}
select node, round(rank, 12) as rank from r{_ROUNDS}""")
def kg_pagerank_rounds(spark, d):
    """Ranks of parts after ten rounds, each part with an edge to the one that follows it in an order: a graph with many cycles."""
    after = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(after).alias("dst")).where("dst is not null and src <> dst")
    return G.pagerank(e, rounds=_ROUNDS, tolerance=0.0).withColumn("rank", F.round("rank", 12))
