"""Queries of schedules, subscriptions, limits, progress, access and lifecycle, and of text structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import lexicons as L
from corpusmill.functions import structure as T
from corpusmill.functions import text as X
from corpusmill.operators import operations as O
from corpusmill.plans.registry import query
from corpusmill.plans.storage import _V, versions
from corpusmill.session import table

NOW = "2024-01-20 12:30:00"


def now():
    return F.lit(NOW).cast("timestamp")


_L = "string_split(text, chr(10))"
_BLANK = "regexp_matches({0}, '^[ \\t\\r]*$')"
_TRIM = "regexp_replace(x, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g')"
_FULL = f"list_transform(list_filter({_L}, lambda x: not {_BLANK.format('x')}), lambda x: {_TRIM})"


@query(f"""with p as (select doc_id, list_max(list_transform({_L}, lambda x: strlen(x))) as longest_line, list_sum(list_transform({_L}, lambda x: strlen(x))) / len({_L}) as mean_line, len(list_filter({_L}, lambda x: {_BLANK.format('x')})) / len({_L}) as empty_share,
len(list_filter(regexp_split_to_array(text, '\\n(?:[ \\t\\r]*\\n)+'), lambda x: not regexp_matches(x, '^[ \\t\\r\\n]*$'))) as paragraphs,
len(list_filter({_FULL}, lambda x: starts_with(x, '#') or (strlen(x) between 6 and 59 and not regexp_matches(x, '\\p{{Ll}}')))) > 0 as has_headers, len(list_filter({_FULL}, lambda x: regexp_matches(x, '^([-*+] |[0-9]\\. )'))) > 0 as has_lists,
len(list_filter({_L}, lambda x: regexp_matches(x, '^    [ ]*[^ \\t\\r]|^[ \\t]*(```|~~~)'))) > 0 as has_code from documents)
select doc_id, longest_line, round(mean_line, 6) as mean_line, round(empty_share, 6) as empty_share, paragraphs, has_headers, has_lists, has_code, case when has_headers and has_lists then 'structured_text' when has_code then 'code_or_markdown' when empty_share < 0.1 and mean_line > 60 then 'continuous_text' else 'plain_text' end as format from p""")
def text_structure(spark, d):
    p = T.profile(F.col("text"))
    return table(spark, d, "documents").select("doc_id", *[(F.round(v, 6) if k in ("mean_line", "empty_share") else v).alias(k) for k, v in p.items()])


_S = "list_filter(list_transform(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda x: trim(x)), lambda x: regexp_matches(x, '[^ \\t\\r\\n.!?]'))"


_MANY = " + ".join(f"((length(lower(text)) - length(replace(lower(text), ' {c} ', ''))) / {len(c) + 2})::int" for c in L.CONJUNCTIONS)


@query(f"""select doc_id, len(list_filter({_S}, lambda x: ends_with(x, '?'))) as questions, len(list_filter({_S}, lambda x: ends_with(x, '!'))) as exclamations, len(list_filter({_S}, lambda x: not ends_with(x, '?') and not ends_with(x, '!'))) as statements,
len(list_filter({_S}, lambda x: regexp_matches(lower(x), '(was|were|is|are|been|being).*ed'))) as passive, round(coalesce(len(regexp_extract_all(text, '\\p{{P}}')) / nullif(strlen(text), 0), 0), 6) as punctuation,
round(coalesce(({_MANY}) / nullif(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0), 0), 6) as conjunctions,
case when regexp_matches(text, '\\p{{Lu}}') and regexp_matches(text, '\\p{{Ll}}') then 'mixed_case' when regexp_matches(text, '\\p{{Lu}}') then 'uppercase' when regexp_matches(text, '\\p{{Ll}}') then 'lowercase' else 'no_letters' end as capitals from documents""")
def syntax_profile(spark, d):
    s = T.syntax(F.col("text"))
    return table(spark, d, "documents").select("doc_id", *[(F.round(v, 6) if k in ("punctuation", "conjunctions") else v).alias(k) for k, v in s.items()])


@query("""with l as (select doc_id, i, (string_split(text, chr(10)))[i] as line from (select doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)),
s as (select *, sum(case when starts_with(line, '#') then 1 else 0 end) over (partition by doc_id order by i)::bigint as section from l)
select doc_id, section, max(line) filter (starts_with(line, '#')) as heading, count(*) as n_lines from s group by 1, 2""")
def markdown_sections(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return T.sections(lines, "doc_id", "i", "line")


_Q = "len(list_distinct(t)) / greatest(len(t), 1)"


@query(f"""with c as (select doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: w <> '') as t, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) / greatest(1, len(regexp_extract_all(text, '[.!?]+'))) as per from documents),
s as (select doc_id, 0.25 * (case when trim(text) = '' then 0.0 when regexp_matches(trim(text), '[.!?]$') then 1.0 else 0.8 end) + 0.25 * (case when per between 10 and 25 then 0.9 when per between 5 and 35 then 0.7 else 0.5 end) + 0.2 * {_Q} + 0.15 * (case when per <= 20 then 0.8 when per <= 30 then 0.6 else 0.5 end) as score from c)
select doc_id, round(score, 6) as score, case when round(score, 6) >= 0.8 then 'high' when round(score, 6) < 0.5 then 'low' else 'medium' end as band from s""")
def weighted_quality(spark, d):
    tokens = X.plain_tokens(F.col("text"))
    t = table(spark, d, "documents").select("doc_id", "text", tokens.alias("t"))
    parts = X.quality(F.col("text")) | {"uniqueness": F.size(F.array_distinct("t")) / F.greatest(F.size("t"), F.lit(1))}
    s = t.select("doc_id", F.round(O.weighted_quality(parts), 6).alias("score"))
    return s.select("doc_id", "score", O.quality_band(F.col("score")).alias("band"))


#: Subscriptions of the query: (sub_id, active, expires, connector, source, kinds).
SUBSCRIPTIONS = [
    (1, True, None, None, None, ["error", "signup"]),
    (2, True, "2024-01-10", "c1", None, ["purchase"]),
    (3, True, "2024-02-01", "c2", None, ["purchase", "purchase"]),
    (4, False, None, None, None, ["error"]),
    (5, True, None, "c0", 7, ["click", "view"]),
]
_SUBS = ", ".join(f"({a}, {str(b).lower()}, {'null' if e is None else repr(e)}::timestamp, {'null' if c is None else repr(c)}, {'null' if s is None else s}, {k})" for a, b, e, c, s, k in SUBSCRIPTIONS)


@query(f"""with s(sub_id, active, expires, connector, source, kinds) as (values {_SUBS})
select e.event_id, s.sub_id from events e join s on list_contains(s.kinds, e.event_type) where s.active and (s.expires is null or s.expires >= timestamp '{NOW}')
and (s.connector is null or s.connector = 'c' || (e.user_id % 3)::varchar) and (s.source is null or s.source = e.user_id % 10)""")
def webhook_matches(spark, d):
    subs = spark.createDataFrame(SUBSCRIPTIONS, "sub_id int, active boolean, expires string, connector string, source long, kinds array<string>").withColumn("expires", F.col("expires").cast("timestamp"))
    e = table(spark, d, "events").select("event_id", "event_type", F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("connector"), (F.col("user_id") % 10).alias("source"))
    return O.matching_subscriptions(e, subs, now()).select("event_id", "sub_id")


@query(f"""with l as (select user_id, max(ts) as last, (user_id % 5) * 3600 as secs from events group by 1)
select user_id, case when secs > 0 then case when last + to_seconds(secs) < timestamp '{NOW}' then timestamp '{NOW}' + to_seconds(secs) else last + to_seconds(secs) end end as next_run from l""")
def schedule_interval(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return u.select("user_id", O.next_interval_run(F.col("last"), (F.col("user_id") % 5) * 3600, now()).alias("next_run"))


@query(f"""with u as (select distinct user_id from events), c as (select user_id, unnest(range(7)) as i from u), t as (select user_id, timestamp '2024-01-20 00:00:00' + to_days(i::int) + to_minutes((user_id % 24) * 60) as t from c)
select user_id, min(t) filter (t > timestamp '{NOW}' and dayofweek(t) + 1 in (user_id % 7 + 1, (user_id + 3) % 7 + 1)) as next_run from t group by 1""")
def schedule_weekly(spark, d):
    u = table(spark, d, "events").select("user_id").distinct()
    days = F.array((F.col("user_id") % 7 + 1).cast("int"), ((F.col("user_id") + 3) % 7 + 1).cast("int"))
    return u.select("user_id", O.next_weekly_run(now(), days, ((F.col("user_id") % 24) * 60).cast("int")).alias("next_run"))


@query("""with n as (select user_id, date_trunc('hour', ts) as start, count(*) as n from events group by 1, 2)
select user_id, strftime(start, '%Y-%m-%d %H:%M:%S') as start, n, greatest(0, n - 1 - 1) as rejected from n""")
def rate_limit_windows(spark, d):
    return O.rate_limited(table(spark, d, "events"), "user_id", "ts", 1, 1).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("""select o_custkey, count(*) as total, count(*) filter (o_orderstatus = 'F') as completed, count(*) filter (o_orderstatus = 'P') as failed, round(count(*) filter (o_orderstatus in ('F', 'P')) / count(*), 6) as progress from orders group by 1""")
def session_progress(spark, d):
    return O.progress(table(spark, d, "orders"), "o_custkey", "o_orderstatus", ["F"], ["P"]).withColumn("progress", F.round("progress", 6))


@query("""with g as (select user_id, date_trunc('day', ts) as day, count(*) as n, count(*) filter (event_type = 'purchase') as d, count(*) filter (event_type = 'signup') as s from events where event_type in ('view', 'purchase', 'signup') group by 1, 2),
k as (select user_id::varchar || '@' || strftime(day, '%Y-%m-%d') as session, * from g)
select session, 'download' as finding, round(d / n, 6) as ratio from k where d / n > 0.8 and n > 5 union all select session, 'share', round(s / n, 6) from k where s / n > 0.5 and n > 3""")
def access_method_ratio(spark, d):
    e = table(spark, d, "events").withColumn("session", F.concat(F.col("user_id").cast("string"), F.lit("@"), F.date_format("ts", "yyyy-MM-dd")))
    return O.access_anomalies(e, "session", "event_type", "view", "purchase", "signup").withColumn("ratio", F.round("ratio", 6))


@query("""with f as (select p_partkey, p_size as age, case p_partkey % 3 when 0 then 'GLACIER' when 1 then 'STANDARD' end as class, p_partkey % 2 = 0 as packed, case when p_size > 40 then 'delete' when p_size > 20 then 'archive' when p_retailprice > 1000 then 'compress' else 'keep' end as wanted from part)
select p_partkey, wanted, case when wanted = 'archive' and class not in ('GLACIER', 'DEEP_ARCHIVE') then wanted when wanted = 'delete' and age > 45 then wanted when wanted = 'compress' and not packed then wanted else 'none' end as action from f""")
def lifecycle_actions(spark, d):
    k = F.col("p_partkey")
    wanted = F.when(F.col("p_size") > 40, "delete").when(F.col("p_size") > 20, "archive").when(F.col("p_retailprice") > 1000, "compress").otherwise("keep")
    p = table(spark, d, "part").select("p_partkey", wanted.alias("wanted"), F.col("p_size").alias("age"), F.when(k % 3 == 0, "GLACIER").when(k % 3 == 1, "STANDARD").alias("class"), (k % 2 == 0).alias("packed"))
    return p.select("p_partkey", "wanted", O.lifecycle_action(F.col("wanted"), F.col("class"), F.col("age"), 45, F.col("packed")).alias("action"))


@query(f"""with {_V}, f as (select path, arg_min(size, (changed, version)) as base from v group by 1)
select path, bool_or(abs(size - base) > 0.1 * base) as significant from v join f using (path) group by 1""")
def conflict_size_change(spark, d):
    return O.size_change(versions(spark, d))


@query("""with e as (select l_suppkey as src, -l_partkey as dst, l_discount as weight from lineitem), n as (select count(distinct n) as nodes from (select src as n from e union all select dst from e))
select count(*) as edges, round(avg(weight), 5) as mean, min(weight) as least, max(weight) as most, round(stddev_pop(weight), 6) as deviation, any_value(nodes) as nodes, round(count(*) / (any_value(nodes) * (any_value(nodes) - 1) / 2), 9) as density from e, n""")
def relationship_metrics(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (-F.col("l_partkey")).alias("dst"), F.col("l_discount").alias("weight"))
    return O.edge_metrics(e).withColumns({"mean": F.round("mean", 5), "deviation": F.round("deviation", 6), "density": F.round("density", 9)})


@query("""select strftime(ts, '%Y-%m-%d') as day, count(*) as n, count(*) filter (event_type = 'error') as errors, count(*) filter (event_type = 'purchase') as purchases, round(avg(value), 6) as mean, count(distinct user_id) as users from events group by 1""")
def analysis_daily(spark, d):
    n = lambda k: F.sum(F.when(F.col("event_type") == k, 1).otherwise(0))
    e = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return e.agg(F.count(F.lit(1)).alias("n"), n("error").alias("errors"), n("purchase").alias("purchases"), F.round(F.avg("value"), 6).alias("mean"), F.countDistinct("user_id").alias("users"))


@query(f"""select user_id, case when run > timestamp '{NOW}' then run end as next_run from (select user_id, min(ts) + to_days((user_id % 30)::int) as run from events group by user_id)""")
def schedule_once(spark, d):
    u = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("run"))
    run = F.col("run") + F.make_dt_interval(days=(F.col("user_id") % 30).cast("int"))
    return u.select("user_id", O.next_single_run(run, now()).alias("next_run"))


@query(f"""with u as (select distinct user_id, case user_id % 4 when 0 then -1 else user_id % 28 + 1 end as day from events), m as (select *, date_trunc('month', timestamp '{NOW}') as m from u),
t as (select user_id, case when day = -1 then m + interval 1 month - interval 1 day else m + to_days((day - 1)::int) end + to_minutes(user_id % 24 * 60) as a, case when day = -1 then m + interval 2 month - interval 1 day else m + interval 1 month + to_days((day - 1)::int) end + to_minutes(user_id % 24 * 60) as b from m)
select user_id, case when a > timestamp '{NOW}' then a else b end as next_run from t""")
def schedule_monthly(spark, d):
    u = table(spark, d, "events").select("user_id").distinct()
    day = F.when(F.col("user_id") % 4 == 0, -1).otherwise(F.col("user_id") % 28 + 1)
    return u.select("user_id", O.next_monthly_run(now(), day.cast("int"), ((F.col("user_id") % 24) * 60).cast("int")).alias("next_run"))


@query("""select o_custkey, count(*) as files, sum(o_totalprice) as bytes, round(case when count(*) > 4 then floor(sum(o_totalprice) / 1048576) * (count(*) / 4) * 0.8 else floor(sum(o_totalprice) / 1048576) end, 6) as seconds, round(count(*) * 250 / 1000 * case when count(*) > 4 then count(*) / 4 * 0.8 else 1 end, 6) as by_history from orders group by 1""")
def session_time_estimate(spark, d):
    """Seconds at a MB a second, and at 250 ms a file as measured, with four files at a time."""
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("files"), F.sum("o_totalprice").alias("bytes"))
    est = lambda ms: F.round(O.estimated_seconds(F.col("files"), F.col("bytes"), ms, 4), 6)
    return g.withColumns({"seconds": est(None), "by_history": est(F.lit(250.0))})


@query("""with u as (select c_nationkey as tenant, count(*) as files, sum(c_acctbal) as bytes from customer group by 1) select tenant, files, round(bytes, 2) as bytes, (tenant % 3 > 0 and files > 20 * (tenant % 3)) or bytes > 200000 as exceeded from u""")
def quota_check(spark, d):
    """Tenants beyond their quota of files (0: no limit) or of bytes."""
    u = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("tenant")).agg(F.count(F.lit(1)).alias("files"), F.sum("c_acctbal").alias("bytes"))
    return u.select("tenant", "files", F.round("bytes", 2).alias("bytes"), (O.beyond(F.col("files"), 20 * (F.col("tenant") % 3)) | O.beyond(F.col("bytes"), F.lit(200000))).alias("exceeded"))


@query("""with m as (select event_type, date_trunc('hour', ts) as hour, count(*) as n, count(*) filter (value > 20) as bad from events group by 1, 2) select event_type, strftime(hour, '%Y-%m-%d %H:%M:%S') as hour, round(100.0 * bad / n, 6) as error_rate, case when 100.0 * bad / n >= 50 then 'critical' else 'high' end as severity from m where 100.0 * bad / n >= 20""")
def sync_error_spike(spark, d):
    out = O.error_spikes(table(spark, d, "events"), "event_type", "ts", F.col("value") > 20, 20.0)
    return out.withColumns({"hour": F.date_format("hour", "yyyy-MM-dd HH:mm:ss"), "error_rate": F.round("error_rate", 6)})


@query("""with s as (select o_custkey, count(*) as total, count(*) filter (o_orderstatus in ('F', 'P')) as done, (epoch(max(o_orderdate)) - epoch(min(o_orderdate)))::double as elapsed from orders group by 1) select o_custkey, round(done / total, 6) as progress, round(case when done > 0 then elapsed / (done / total) - elapsed end, 3) as eta_seconds from s""")
def session_eta(spark, d):
    o = table(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return O.remaining(o, "o_custkey", F.col("o_orderstatus").isin("F", "P"), "o_orderdate").select("o_custkey", F.round("progress", 6).alias("progress"), F.round("eta_seconds", 3).alias("eta_seconds"))


@query("""select p_partkey, case when regexp_matches(p_name, '^[a-m]') and not regexp_matches(p_name, 'e') then true else false end as chosen from part""")
def glob_filter(spark, d):
    """Names that a glob of the include list matches and none of the exclude list does."""
    from corpusmill.operators.predicates import globbed

    return table(spark, d, "part").select("p_partkey", globbed(F.col("p_name"), ["[a-m]*"], ["*e*"]).alias("chosen"))


@query("""with f as (select l_orderkey, l_linenumber, joined as tags from (select l_orderkey, l_linenumber, l_returnflag || ',' || l_linestatus as joined from lineitem)) select l_orderkey, l_linenumber from f where starts_with(tags, 'A') and ends_with(tags, 'F') and list_contains(string_split(tags, ','), 'F')""")
def lifecycle_conditions(spark, d):
    """Rules over names and tags: starts_with, ends_with and has_tag."""
    from corpusmill.operators.predicates import all_of, condition

    tags = F.concat_ws(",", "l_returnflag", "l_linestatus")
    f = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", tags.alias("name"), F.split(tags, ",").alias("tags"))
    return f.where(all_of([("name", "starts_with", "A"), ("name", "ends_with", "F")]) & condition(F.col("tags"), "has_tag", "F")).select("l_orderkey", "l_linenumber")
