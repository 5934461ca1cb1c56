"""Relational queries: lists, predicates, joins, chunks of rows, ranking, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import predicates as P
from corpusmill.operators import relational as R
from corpusmill.plans.registry import query
from corpusmill.session import table


@query("""select o_orderkey, o_orderstatus, o_totalprice, count(*) over () as total from orders
where o_orderstatus = 'F' and o_orderpriority = '1-URGENT' order by o_totalprice desc, o_orderkey limit 50 offset 50""")
def list_filter_page(spark, d):
    o = table(spark, d, "orders")
    where = P.equals({"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})
    return R.page(o, where, [F.desc("o_totalprice"), F.asc("o_orderkey")], 2, 50).select("o_orderkey", "o_orderstatus", "o_totalprice", "total")


@query("select p_partkey, p_brand, p_size from part where p_size in (1, 5, 9) and p_brand in (select distinct p_brand from part order by 1 limit 3)")
def in_list_filter(spark, d):
    p = table(spark, d, "part")
    brands = p.select("p_brand").distinct().orderBy("p_brand").limit(3)
    return p.where(P.condition(F.col("p_size"), "in", [1, 5, 9])).join(brands, "p_brand", "left_semi").select("p_partkey", "p_brand", "p_size")


@query("""select doc_id from documents where list_has_all(regexp_split_to_array(lower(text), '[^a-z0-9]+'), ['license', 'under'])""")
def fulltext_and(spark, d):
    return table(spark, d, "documents").where(R.matches_text(F.col("text"), "under the license")).select("doc_id")


@query("""select doc_id, lang, source from documents where list_has_all([lang, source], ['en', 'src3'])""")
def containment_all(spark, d):
    return table(spark, d, "documents").where(R.has_all(F.array("lang", "source"), ["en", "src3"])).select("doc_id", "lang", "source")


@query("""select l_orderkey, l_linenumber from lineitem where l_quantity >= 45 and l_discount > 0.05 and l_returnflag in ('A', 'R') and l_linestatus <> 'O' and l_shipdate >= timestamp '1994-01-01'""")
def operator_predicates(spark, d):
    where = P.all_of([("l_quantity", "gte", 45), ("l_discount", "gt", 0.05), ("l_returnflag", "in", ["A", "R"]), ("l_linestatus", "ne", "O")])
    return table(spark, d, "lineitem").where(where & (F.col("l_shipdate") >= F.lit("1994-01-01").cast("timestamp"))).select("l_orderkey", "l_linenumber")


POLICIES = [("small", True, [], 1, 10), ("type-a", True, ["PROMO"], 5, 30), ("large", True, [], 40, None), ("off", False, [], 1, None)]


@query("""with pol(policy, active, types, min_size, max_size) as (values ('small', true, '', 1, 10), ('type-a', true, 'PROMO', 5, 30), ('large', true, '', 40, null), ('off', false, '', 1, null))
select p_partkey, policy from part p join pol on active and (types = '' or types = string_split(p_type, ' ')[1]) and p_size >= min_size and (max_size is null or p_size <= max_size)""")
def policy_theta_join(spark, d):
    policies = spark.createDataFrame(POLICIES, "policy string, active boolean, types array<string>, min_size int, max_size int")
    items = table(spark, d, "part").select("p_partkey", F.split("p_type", " ")[0].alias("kind"), F.col("p_size").alias("size"))
    return R.theta_policies(items, policies).select("p_partkey", "policy")


@query("""select p_partkey, case when p_size > 40 and p_retailprice > 1500 then 'archive' when p_size > 40 then 'compress' when contains(p_type, 'STEEL') then 'keep' else 'none' end as rule from part""")
def first_match_rule(spark, d):
    rules = [("archive", [("p_size", "gt", 40), ("p_retailprice", "gt", 1500)]), ("compress", [("p_size", "gt", 40)]), ("keep", [("p_type", "contains", "STEEL")])]
    return table(spark, d, "part").select("p_partkey", P.first_match(rules, "none").alias("rule"))


@query("select case when n_chars * 10000 < 10485760 then 'tier1' when n_chars * 10000 < 1073741824 then 'tier2' else 'tier3' end as tier, count(*) as n, sum(n_chars)::bigint as chars from documents group by 1")
def size_tier_case(spark, d):
    return table(spark, d, "documents").groupBy(R.size_tier(F.col("n_chars") * 10000).alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("select event_id from events where not (ts < timestamp '2024-01-31' - interval 7 day and event_type in ('click', 'view'))")
def retention_filter(spark, d):
    old = (F.col("ts") < F.lit("2024-01-24").cast("timestamp")) & F.col("event_type").isin("click", "view")
    return table(spark, d, "events").where(~old).select("event_id")


@query("""select page_id, regexp_full_match(url, 'https?://[^\\s/?#]+\\.[^\\s/?#]+([/?#]\\S*)?') as url_ok, length(url) between 10 and 40 as length_ok from pages""")
def field_validators(spark, d):
    return table(spark, d, "pages").select("page_id", P.is_url(F.col("url")).alias("url_ok"), P.length_between(F.col("url"), 10, 40).alias("length_ok"))


@query("""with c as (select c_nationkey as k, count(*) as customers, sum(c_acctbal) as balance from customer group by 1),
s as (select s_nationkey as k, count(*) as suppliers from supplier group by 1),
o as (select c_nationkey as k, count(*) as orders, sum(o_totalprice) as spent from orders join customer on o_custkey = c_custkey group by 1)
select n_name, r_name, coalesce(customers, 0) as customers, round(coalesce(balance, 0), 2) as balance, coalesce(suppliers, 0) as suppliers, coalesce(orders, 0) as orders, round(coalesce(spent, 0), 2) as spent
from nation join region on n_regionkey = r_regionkey left join c on n_nationkey = c.k left join s on n_nationkey = s.k left join o on n_nationkey = o.k""")
def tenant_usage(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name", F.col("n_nationkey").alias("k"))
    c = table(spark, d, "customer")
    spent = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s")).join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("k"), "n", "s")
    out = R.rollup_once(n, "k", {
        "customers": (c.withColumnRenamed("c_nationkey", "k"), [F.count(F.lit(1)).alias("customers"), F.sum("c_acctbal").alias("balance")]),
        "suppliers": (table(spark, d, "supplier").withColumnRenamed("s_nationkey", "k"), [F.count(F.lit(1)).alias("suppliers")]),
        "orders": (spent, [F.sum("n").alias("orders"), F.sum("s").alias("spent")]),
    })
    zero = lambda c_: F.coalesce(c_, F.lit(0))
    return out.select("n_name", "r_name", zero("customers").alias("customers"), F.round(F.coalesce("balance", F.lit(0.0)), 2).alias("balance"), zero("suppliers").alias("suppliers"), zero("orders").alias("orders"), F.round(F.coalesce("spent", F.lit(0.0)), 2).alias("spent"))


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def exists_semi(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 300000")
    return table(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def skip_existing_anti(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@query("select a.conv_id, a.turn, a.role, p.role as parent_role, length(p.text) as parent_chars from conversations a left join conversations p on a.conv_id = p.conv_id and p.turn = a.turn - 1")
def parent_child_self_join(spark, d):
    c = table(spark, d, "conversations")
    p = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("parent_role"), F.length("text").alias("parent_chars"))
    return c.join(p, ["conv_id", "turn"], "left").select("conv_id", "turn", "role", "parent_role", "parent_chars")


@query("""with ch as (select c_custkey + (case when c_custkey % 20 = 0 then 1000000 else 0 end) as c_custkey, c_acctbal + 100 as c_acctbal from customer where c_custkey % 10 = 0)
select c_custkey, round(c_acctbal, 2) as c_acctbal from (select c_custkey, c_acctbal from customer where c_custkey not in (select c_custkey from ch) union all select c_custkey, c_acctbal from ch)""")
def upsert_merge(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    moved = F.col("c_custkey") + F.when(F.col("c_custkey") % 20 == 0, 1000000).otherwise(0)
    changes = c.where("c_custkey % 10 = 0").select(moved.alias("c_custkey"), (F.col("c_acctbal") + 100).alias("c_acctbal"))
    return R.upsert(c, changes, ["c_custkey"]).select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


@query("""with b as (select event_type, avg(value) as m, stddev_samp(value) as s, count(*) as n from events group by 1)
select event_id, round((value - m) / s, 6) as z from events join b using (event_type) where n >= 30 and s > 0 and abs((value - m) / s) > 2.5""")
def baseline_broadcast_join(spark, d):
    e = table(spark, d, "events")
    b = e.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count(F.lit(1)).alias("n"))
    z = (F.col("value") - F.col("m")) / F.col("s")
    return e.join(b, "event_type").where("n >= 30 and s > 0").where(F.abs(z) > 2.5).select("event_id", F.round(z, 6).alias("z"))


@query("""with r as (select *, (row_number() over (partition by o_orderstatus order by o_orderkey) - 1) // 100 as chunk from orders)
select o_orderstatus || ':row:' || chunk as chunk_id, count(*) as n_rows, min(o_orderkey) as first_key, max(o_orderkey) as last_key, round(sum(o_totalprice), 2) as total from r group by o_orderstatus, chunk""")
def chunk_rows(spark, d):
    from corpusmill.operators.chunking import row_chunks

    o = table(spark, d, "orders")
    r = row_chunks(o, "o_orderstatus", ["o_orderkey"], 100)
    return r.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select doc_id, sha256(coalesce(text, '')) as content_hash from documents")
def content_hash_sha256(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))


@query("select o_custkey, o_orderkey, rank from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 3")
def rank_topk(spark, d):
    return R.ranked(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("select o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) as o_orderkey, max(o_totalprice) as best from orders group by 1")
def best_per_group(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"), F.max("o_totalprice").alias("best"))


@query("select min(doc_id) as doc_id, sha256(lower(trim(text))) as h from documents group by 2")
def first_seen_dedupe(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2(F.lower(F.trim("text")), 256).alias("h")).agg(F.min("doc_id").alias("doc_id"))


@query("""select doc_id, earlier, case when earlier > 5 then 'high' when earlier > 2 then 'medium' else 'low' end as severity
from (select doc_id, row_number() over (partition by md5(lower(trim(text))) order by doc_id) - 1 as earlier from documents) where earlier > 0""")
def exact_duplicates(spark, d):
    from corpusmill.operators.anomaly import exact_copies

    return exact_copies(table(spark, d, "documents"), "doc_id", "text")


@query("select o_orderkey, o_orderpriority, row_number() over (order by o_orderpriority, o_totalprice * 0.00001 + 0.1 * date_diff('hour', o_orderdate, timestamp '2024-01-31') desc, o_orderkey) as pos from orders qualify pos <= 100")
def priority_queue_order(spark, d):
    weight = F.col("o_totalprice") * 0.00001 + 0.1 * F.expr("timestampdiff(HOUR, date_trunc('hour', o_orderdate), timestamp '2024-01-31')")
    top = table(spark, d, "orders").orderBy("o_orderpriority", weight.desc(), "o_orderkey").limit(100)
    return top.select("o_orderkey", "o_orderpriority", F.row_number().over(R.W.orderBy("o_orderpriority", weight.desc(), "o_orderkey")).alias("pos"))


@query("""select 'short' as finding, doc_id from documents where length(text) < 20 union all select 'long', doc_id from documents where length(text) > 15000 union all select 'toxic', doc_id from labels where toxic = 1""")
def union_outputs(spark, d):
    t = table(spark, d, "documents")
    tag = lambda n, df: df.select(F.lit(n).alias("finding"), "doc_id")
    return tag("short", t.where("length(text) < 20")).unionByName(tag("long", t.where("length(text) > 15000"))).unionByName(tag("toxic", table(spark, d, "labels").where("toxic = 1")))


@query("""with m as (select c_custkey, c_acctbal, case when c_acctbal < 0 then 'low' else 'ok' end as s from customer)
select coalesce(s, 'all') as state, count(*) as n, round(avg(c_acctbal), 6) as mean from m group by grouping sets ((s), ())""")
def usage_rollup(spark, d):
    m = table(spark, d, "customer").withColumn("s", F.when(F.col("c_acctbal") < 0, "low").otherwise("ok"))
    return m.rollup("s").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 6).alias("mean")).select(F.coalesce("s", F.lit("all")).alias("state"), "n", "mean")


@query("select source, lang, count(*) as n from documents group by 1, 2")
def facet_counts(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("select b::double as bound, count(*) filter (l_quantity <= b) as n, round(sum(l_quantity) filter (l_quantity <= b), 2) as total from lineitem, (values (5), (10), (25), (50)) t(b) group by 1")
def histogram_cumulative(spark, d):
    from corpusmill.operators.stats import cumulative_histogram

    return cumulative_histogram(table(spark, d, "lineitem"), F.col("l_quantity"), [5.0, 10.0, 25.0, 50.0])


@query("""with t as (select conv_id, role, text from conversations), m as (select conv_id, role, count(*) as n, row_number() over (partition by conv_id order by count(*) desc, role) as rn from t group by 1, 2)
select c.conv_id, round(avg(length(text)), 6) as mean_chars, m.role as mode_role, sum(length(text))::bigint as chars from conversations c join m on c.conv_id = m.conv_id and rn = 1 group by 1, 3""")
def doc_summary_mode(spark, d):
    c = table(spark, d, "conversations")
    mode = c.groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n")).groupBy("conv_id").agg(F.min_by("role", F.struct(-F.col("n"), "role")).alias("mode_role"))
    return c.groupBy("conv_id").agg(F.round(F.avg(F.length("text")), 6).alias("mean_chars"), F.sum(F.length("text")).cast("long").alias("chars")).join(mode, "conv_id")


@query("select n_name, regr_count(o_totalprice, 1) as n, approx.e > 0 as counted from (select n_name, o_totalprice from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey) x, (select 1 as e) approx group by n_name, approx.e")
def foreign_key_lookup(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count("o_totalprice").alias("n")).withColumn("counted", F.lit(True))
