"""Storage tiers, costs and sync conflicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import storage as S
from corpusmill.plans.registry import query
from corpusmill.session import table

# files: events of one user and type; each user's "now" is some months after January 2024
_USE = """u as (select user_id, event_type, count(*) as accesses, min(ts) as first, max(ts) as last, sum(value) * 1e9 as bytes, any_value(timestamp '2024-01-31' + to_days((user_id % 40 * 75)::int)) as now, any_value(case user_id % 3 when 0 then 'hot' when 1 then 'warm' else 'cold' end) as tier from events where value is not null group by 1, 2),
w as (select *, bytes / 1073741824 as gb, epoch_us(now) / 86400000000 - epoch_us(first) / 86400000000 as age_days, epoch_us(now) / 86400000000 - epoch_us(last) / 86400000000 as idle_days from u), p as (select *, accesses / greatest(1, age_days) as per_day from w)"""
_TIER = "case when per_day >= 1 then 'hot' when per_day >= 0.2 and idle_days < 7 then 'warm' when per_day >= 0.03 and idle_days < 30 then 'warm' when idle_days < 90 and gb < 10 then 'warm' when idle_days < 365 then 'cold' when age_days > 7 * 365 then 'glacier' else 'archive' end"
_CASE = lambda t, c: f"case {c} " + " ".join(f"when '{k}' then {v}" for k, v in t.items()) + " end"
_MOVE = "case tier || '>' || target " + " ".join(f"when '{a}>{b}' then {v}" for (a, b), v in S.MOVES.items()) + f" else {S.OTHER_MOVE} end"
_COST = f"""{_USE}, t as (select *, {_TIER} as target from p), a as (select *, gb * {_CASE(S.PRICES, 'tier')} as cost_now, gb * {_CASE(S.PRICES, 'target')} as storage, gb * {_MOVE} as move, gb * {_CASE(S.RETRIEVAL, 'target')} * per_day * 30 as retrieval from t),
c as (select *, cost_now - storage as gross, cost_now - storage - retrieval as saving, case when cost_now - storage > 0 then ceil(round(move / (cost_now - storage), 9))::int else 999 end as payback, (cost_now - storage - retrieval) * 12 / nullif(move, 0) * 100 as roi from a)"""
_SURE = f"""{_COST}, d as (select user_id, event_type, count(*) as days, avg(n) as mean, stddev_pop(n) as deviation from (select user_id, event_type, ts::date as day, count(*) as n from events where value is not null group by 1, 2, 3) group by 1, 2),
s as (select c.*, least(1, least(age_days / 180, 1) * 0.3 + 0.3 * case when days < 7 then 0.5 else greatest(0, 1 - deviation / mean) end + least(gb, 1) * 0.2 + 0.2 * case target when 'warm' then greatest(0, 1 - idle_days / 30) when 'cold' then least(idle_days / 90, 1) when 'archive' then least(idle_days / 365, 1) when 'glacier' then least(idle_days / 730, 1) else 0 end) as confidence from c join d using (user_id, event_type))"""
_WORTH = "target <> tier and gross > 0 and saving >= 1 and confidence >= 0.6 and payback <= 12"


def usage(spark, d):
    e = table(spark, d, "events").where("value is not null")
    now = F.lit("2024-01-31").cast("timestamp") + F.make_dt_interval(days=(F.col("user_id") % 40 * 75).cast("int"))
    u = e.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("accesses"), F.min("ts").alias("first"), F.max("ts").alias("last"), (F.sum("value") * 1e9).alias("bytes"))
    tier = F.when(F.col("user_id") % 3 == 0, "hot").when(F.col("user_id") % 3 == 1, "warm").otherwise("cold")
    return S.with_use(u.withColumns({"now": now, "tier": tier, **{c: F.col(c).cast("timestamp") for c in ("first", "last")}}))


def analysed(spark, d):
    c = S.costs(usage(spark, d))
    n = table(spark, d, "events").where("value is not null").groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    s = n.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("days"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("deviation"))
    even = S.consistency(F.col("days"), F.col("mean"), F.col("deviation"))
    return c.join(s, ["user_id", "event_type"]).withColumn("confidence", S.confidence(F.col("age_days"), even, F.col("gb"), F.col("idle_days"), F.col("target")))


@query(f"with {_USE} select user_id, event_type, {_TIER} as tier from p")
def optimal_tier(spark, d):
    return usage(spark, d).select("user_id", "event_type", S.optimal_tier(F.col("per_day"), F.col("idle_days"), F.col("gb"), F.col("age_days")).alias("tier"))


@query(f"with {_COST} select user_id, event_type, tier, target, round(cost_now, 6) as cost_now, round(storage, 6) as storage, round(move, 6) as move, round(saving, 6) as saving, payback, round(roi, 4) as roi from c where target <> tier")
def tier_cost_savings(spark, d):
    c = S.costs(usage(spark, d)).where("target <> tier")
    return c.select("user_id", "event_type", "tier", "target", *[F.round(x, 6).alias(x) for x in ("cost_now", "storage", "move", "saving")], "payback", F.round("roi", 4).alias("roi"))


@query(f"with {_SURE} select user_id, event_type, round(confidence, 6) as confidence from s")
def tier_confidence(spark, d):
    return analysed(spark, d).select("user_id", "event_type", F.round("confidence", 6).alias("confidence"))


@query(f"with {_SURE} select user_id || ':' || event_type as file, tier, target, round(saving * confidence, 6) as impact from s where {_WORTH} order by round(saving * confidence, 6) desc, 1 limit 100")
def tier_recommendations(spark, d):
    a = analysed(spark, d).withColumn("file", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    return S.top_recommended(a, "file").select("file", "tier", "target", F.round("impact", 6).alias("impact"))


@query(f"with {_SURE} select user_id % 10 as tenant, count(*) as files, count(*) filter ({_WORTH}) as recommendations, round(greatest(0, least(100, 100 - 2 * count(*) filter ({_WORTH}) - 50 * greatest(0, avg(case when tier = 'hot' then 1.0 else 0.0 end) - 0.3))), 6) as score from s group by 1")
def tier_tenant_score(spark, d):
    a = analysed(spark, d).withColumn("tenant", F.col("user_id") % 10)
    return S.tenant_score(a, "tenant").withColumn("score", F.round("score", 6))


# versions of a path: orders of one customer in one status
_V = "v as (select o_custkey as path, o_orderkey as version, o_orderdate as changed, o_totalprice as size, case when o_orderstatus = 'P' then 'delete' when o_orderpriority = '1-URGENT' then 'create' else 'modify' end as op, o_orderkey % 5 as checksum, o_orderkey % 7 = 0 as is_dir, 'f' || (o_orderkey % 3) as name from orders)"


def versions(spark, d):
    op = F.when(F.col("o_orderstatus") == "P", "delete").when(F.col("o_orderpriority") == "1-URGENT", "create").otherwise("modify")
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("path"), k.alias("version"), F.col("o_orderdate").alias("changed"), F.col("o_totalprice").alias("size"), op.alias("op"), (k % 5).alias("checksum"), (k % 7 == 0).alias("is_dir"), F.concat(F.lit("f"), (k % 3).cast("string")).alias("name"))


# paths finer than customers, so that every kind of conflict is there
_FINE = f"{_V}, y as (select path || '/' || version % 4 as path, version, changed, size, op, checksum, is_dir, name from v)"
_KIND = "case when m > 1 then 'modify_modify' when m > 0 and x > 0 then 'modify_delete' when c > 1 and contents > 1 then 'create_create' when sorts > 1 then 'directory_file' when names > 1 then 'rename_rename' else 'modify_modify' end"


@query(f"""with {_FINE}, g as (select path, count(*) as n, count(*) filter (op = 'modify') as m, count(*) filter (op = 'delete') as x, count(*) filter (op = 'create') as c, arg_min(size, (changed, version)) as base, min(size) as low, max(size) as high, count(distinct checksum) as contents, count(distinct is_dir) as sorts, count(distinct name) as names from y group by 1 having count(*) > 1),
k as (select *, {_KIND} as conflict from g)
select path, conflict, case when conflict in ('modify_delete', 'directory_file') then 'high' when conflict = 'modify_modify' then case when greatest(high - base, base - low) > 0.1 * base then 'medium' else 'low' end else 'medium' end as severity, conflict in ('modify_modify', 'create_create') as auto,
case conflict when 'modify_modify' then 'last_write' when 'create_create' then 'preserve_both' else 'manual' end as suggested from k""")
def conflict_type(spark, d):
    v = versions(spark, d)
    return S.conflicts(v.withColumn("path", F.concat_ws("/", F.col("path").cast("string"), (F.col("version") % 4).cast("string"))))


@query(f"with {_V} select path, arg_max(version, (changed, version)) as version from v group by 1")
def conflict_last_write(spark, d):
    return S.resolved(versions(spark, d), "last_write")


@query(f"with {_V} select path, arg_min(version, (changed, version)) as version from v group by 1")
def conflict_first_write(spark, d):
    return S.resolved(versions(spark, d), "first_write")


@query(f"with {_V} select path, arg_min(version, (case op when 'create' then 0 when 'modify' then 1 else 2 end, version)) as version from v group by 1")
def conflict_source_priority(spark, d):
    return S.resolved(versions(spark, d), "source_priority", ["create", "modify", "delete"])


@query(f"with {_V} select path, arg_max(version, (size, version)) as version from v group by 1")
def conflict_largest(spark, d):
    return S.resolved(versions(spark, d), "largest")


@query(f"with {_V} select path, version from v")
def conflict_preserve_both(spark, d):
    return S.resolved(versions(spark, d), "preserve_both")
