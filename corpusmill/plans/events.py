"""Statistics, windows and streams over `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions.text import half_up
from corpusmill.operators import stats as S
from corpusmill.plans.registry import query
from corpusmill.session import table
from corpusmill.streaming import jobs

ROUND = "round({0}, 6) as {0}"


def rounded(df, *columns):
    kinds = dict(df.dtypes)
    return df.withColumns({c: half_up(F.col(c), 6) if kinds[c] == "double" else F.round(c, 6) for c in columns})


_SERIES = """select date_trunc('{w}', ts)::varchar as start, event_type, count(value) as n, round(sum(value), 6) as total, round(avg(value), 6) as mean, min(value) as least, max(value) as most, round(coalesce(stddev_samp(value), 0), 6) as deviation,
round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99 from events group by 1, 2"""


def _series(spark, d, window):
    out = S.series(table(spark, d, "events"), ["event_type"], "ts", "value", window)
    return rounded(out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")), "total", "mean", "deviation", "p50", "p90", "p95", "p99")


@query(_SERIES.format(w="hour"))
def timeseries_hourly(spark, d):
    return _series(spark, d, "1 hour")


@query(_SERIES.format(w="day").replace("date_trunc('day', ts)::varchar", "strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S')"))
def timeseries_daily_percentiles(spark, d):
    return _series(spark, d, "1 day")


@query("""select event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(value) as n, round(sum(value), 4) as total, min(value) as least, max(value) as most, true as p50_within, true as p95_within from events where value is not null and ts is not null group by 1, 2""")
def timeseries_sketches(spark, d):
    """Days rolled up from the sketches of hours, and whether the ranks of their median and 95th percentile are within 1.5 % of the rows and one row."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    days = S.sketch_quantiles(S.rolled_up(S.sketched(e, ["event_type"], "ts", "value"), ["event_type"], "day"), {"p50": 0.5, "p95": 0.95})
    j = e.where("value is not null and ts is not null").withColumn("start", F.date_trunc("day", "ts")).join(days, ["event_type", "start"])
    first = lambda c: F.first(c).alias(c)
    g = j.groupBy("event_type", "start").agg(*map(first, ("n", "total", "least", "most")), *[F.sum((F.col("value") < F.col(p)).cast("int")).alias(f"{p}_lo") for p in ("p50", "p95")], *[F.sum((F.col("value") <= F.col(p)).cast("int")).alias(f"{p}_hi") for p in ("p50", "p95")])
    within = lambda p, q: (F.col(f"{p}_lo") <= (q + 0.015) * F.col("n") + 1) & (F.col(f"{p}_hi") >= (q - 0.015) * F.col("n") - 1)
    return g.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "n", F.round("total", 4).alias("total"), "least", "most", within("p50", 0.5).alias("p50_within"), within("p95", 0.95).alias("p95_within"))



_Q = ", ".join(f"round(quantile_cont(value, {q}), 6) as {k}" for k, q in S.SHARES.items())


@query(f"""select event_type, count(value) as n, round(avg(value), 6) as mean, round(var_samp(value), 6) as variance, round(max(value) - min(value), 6) as spread, {_Q},
round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) as iqr, round(skewness(value), 6) as skewness, round(kurtosis(value), 6) as kurtosis from events group by 1""")
def stat_moments(spark, d):
    return rounded(S.moments(table(spark, d, "events"), ["event_type"], "value"), "mean", "variance", "spread", *S.SHARES, "iqr", "skewness", "kurtosis")


@query("""with f as (select *, epoch_us(ts) / 1e6 - min(epoch_us(ts)) over (partition by event_type) / 1e6 as x from events),
g as (select event_type, regr_slope(value, x) as slope, regr_intercept(value, x) as intercept, coalesce(regr_r2(value, x), 1) as r2, arg_min(value, (ts, value)) as a, arg_max(value, (ts, value)) as b from f group by 1)
select event_type, round(slope * 1e6, 4) as slope, round(intercept, 6) as intercept, round(r2, 6) as r2, case when slope > 0.001 then 'increasing' when slope < -0.001 then 'decreasing' else 'stable' end as direction,
case when r2 >= 0.8 then 'strong' when r2 >= 0.5 then 'moderate' when r2 >= 0.2 then 'weak' else 'very_weak' end as strength, round(case when a <> 0 then (b - a) / a * 100 else 0 end, 6) as change_percent from g""")
def trend_regression(spark, d):
    out = S.trend(table(spark, d, "events"), ["event_type"], "ts", "value")
    return rounded(out.withColumn("slope", F.round(F.col("slope") * 1e6, 4)), "intercept", "r2", "change_percent")


@query("""with r as (select event_type, value, lag(value) over w as b, row_number() over w as i, count(*) over (partition by event_type) as n from events window w as (partition by event_type order by ts, event_id)),
m as (select event_type, any_value(n) as n, max(value) filter (i = n) as z, max(value) filter (i = n - greatest(floor(n * 0.1), 2) + 1) as a from r group by 1)
select r.event_type, round(coalesce(stddev_pop(case when b is null then null when b = 0 then 0 else value / b - 1 end), 0), 4) as volatility, round(any_value(case when m.n >= 10 and a <> 0 then (z - a) / a * 100 else 0 end), 4) as momentum from r join m on r.event_type = m.event_type group by 1""")
def trend_volatility_momentum(spark, d):
    v = S.volatility(table(spark, d, "events"), ["event_type"], ["ts", "event_id"], "value", F.to_date("ts"))
    return v.withColumns({c: F.round(c, 4) for c in ("volatility", "momentum")})


@query("""with v as (select user_id, list(value order by ts, event_id) as v from events where value is not null group by 1) select user_id, round(list_reduce(v, lambda a, x: (a + x) / 2), 6) as ema from v""")
def ema_running(spark, d):
    return rounded(S.ema(table(spark, d, "events").where("value is not null"), ["user_id"], ["ts", "event_id"], "value", F.datediff("ts", F.lit("1970-01-01"))), "ema")


@query("select user_id, arg_max(value, (ts, event_id)) as latest from events group by 1")
def latest_sample(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("latest"))


@query("select user_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as hour, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def session_hour_bucket(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("select event_id, requests from (select event_id, count(*) over (partition by event_type order by floor(epoch(ts)) range between 300 preceding and current row) as requests from events) where requests > 2")
def burst_5min(spark, d):
    from corpusmill.operators.anomaly import bursts

    return bursts(table(spark, d, "events"), ["event_type"], "ts", 300, 2).select("event_id", "requests")


@query("""with b as (select event_type, avg(value) as m, stddev_samp(value) as s, count(value) as n from events group by 1), z as (select event_id, (value - m) / s as z, n from events join b using (event_type) where n >= 30 and s > 0)
select event_id, round(z, 6) as z, case when abs(z) >= 4 then 'critical' when abs(z) >= 3 then 'high' else 'medium' end as severity, round(abs(z) / 5, 6) as score,
round(greatest(0.1, least(0.95, least(abs(z) / 5, 0.9) * (0.5 + 0.5 * least(n / 100, 1.0)))), 6) as confidence from z where abs(z) > 2.5""")
def zscore_outliers(spark, d):
    return rounded(S.z_outliers(table(spark, d, "events"), ["event_type"], "value").select("event_id", "z", "severity", "score", "confidence"), "z", "score", "confidence")


@query("""with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events),
q as (select event_type, max(value) filter (i = n // 4) as q1, max(value) filter (i = 3 * n // 4) as q3 from r where n >= 4 group by 1)
select event_id, value from events join q using (event_type) where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)""")
def iqr_index_outliers(spark, d):
    return S.iqr_outliers(table(spark, d, "events"), ["event_type"], "value").select("event_id", "value")


@query("""with m as (select event_type, median(value) as med from events group by 1 having count(value) >= 3), a as (select event_type, median(abs(value - med)) as mad from events join m using (event_type) group by 1)
select event_id, round(0.6745 * (value - med) / mad, 6) as modified_z from events join m using (event_type) join a using (event_type) where mad > 0 and abs(0.6745 * (value - med) / mad) > 3.5""")
def modified_zscore(spark, d):
    return rounded(S.modified_z(table(spark, d, "events"), ["event_type"], "value").select("event_id", "modified_z"), "modified_z")


_PERIOD = "with c as (select {p} as part, count(*) as n from events group by 1), m as (select avg(n) as m from c) select part, n, round(abs(n - m) / m, 6) as deviation, abs(n - m) / m > {o} as anomalous from c, m"


@query(_PERIOD.format(p="hour(ts)", o=0.5))
def hourly_deviation(spark, d):
    return rounded(S.period_deviation(table(spark, d, "events"), F.hour("ts"), "ts", 0.5), "deviation")


@query(_PERIOD.format(p="dayofweek(ts) + 1", o=0.6))
def weekday_deviation(spark, d):
    return rounded(S.period_deviation(table(spark, d, "events"), F.dayofweek("ts"), "ts", 0.6), "deviation")


@query("select user_id, n, hits, round(hits / n, 6) as ratio from (select user_id, count(*) as n, count(*) filter (event_type = 'view') as hits from events group by 1) where n > 5 and hits / n > 0.25")
def ratio_anomaly(spark, d):
    from corpusmill.operators.anomaly import ratios

    return rounded(ratios(table(spark, d, "events"), ["user_id"], F.col("event_type") == "view", 5, 0.25), "ratio")


@query("""with m as (select event_type, date_trunc('minute', ts) as minute, count(*) as n from events group by 1, 2), b as (select event_type, avg(n) as usual from m group by 1)
select event_type, strftime(minute, '%Y-%m-%d %H:%M:%S') as minute, n, round(n / usual, 6) as factor from m join b using (event_type) where n / usual > 1.5""")
def velocity(spark, d):
    from corpusmill.operators.anomaly import velocity as detect

    return rounded(detect(table(spark, d, "events"), ["event_type"], "ts", 1.5).select("event_type", F.date_format("minute", "yyyy-MM-dd HH:mm:ss").alias("minute"), "n", "factor"), "factor")


@query("""with u as (select user_id, hour(ts) as h, count(*) as n from events group by 1, 2), t as (select user_id, arg_max(h, (n, -h)) as usual from u group by 1)
select event_id, least(abs(hour(ts) - usual), 24 - abs(hour(ts) - usual)) as hours_off from events join t using (user_id) where least(abs(hour(ts) - usual), 24 - abs(hour(ts) - usual)) > 10 or dayofweek(ts) in (0, 6)""")
def off_hours(spark, d):
    from corpusmill.operators.anomaly import hours_apart

    e = table(spark, d, "events")
    u = e.groupBy("user_id", F.hour("ts").alias("h")).agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.max_by("h", F.struct("n", -F.col("h"))).alias("usual"))
    off = hours_apart(F.hour("ts"), F.col("usual"))
    return e.join(u, "user_id").where((off > 10) | F.dayofweek("ts").isin(1, 7)).select("event_id", off.alias("hours_off"))


@query("select event_id, event_type || ':' || (case when value > 100 then 'critical' else 'high' end) as alert from events where (event_type = 'error' and value > 20) or (event_type = 'purchase' and value > 100)")
def alert_rules(spark, d):
    from corpusmill.operators.predicates import all_of

    rules = [("error", 20), ("purchase", 100)]
    hit = all_of([("event_type", "eq", rules[0][0]), ("value", "gt", rules[0][1])]) | all_of([("event_type", "eq", rules[1][0]), ("value", "gt", rules[1][1])])
    return table(spark, d, "events").where(hit).select("event_id", F.concat("event_type", F.lit(":"), F.when(F.col("value") > 100, "critical").otherwise("high")).alias("alert"))


@query("""with h as (select event_type, date_trunc('hour', ts) as hour, avg(value) as v from events group by 1, 2), r as (select *, sum(case when v > 20 then 0 else 1 end) over w as run, lead(hour) over w as nxt from h window w as (partition by event_type order by hour))
select event_type, strftime(min(hour), '%Y-%m-%d %H:%M:%S') as fired, case when bool_or(nxt is null) then null else strftime(max(nxt), '%Y-%m-%d %H:%M:%S') end as resolved, count(*) as n from r where v > 20 group by event_type, run having count(*) >= 2""")
def alert_fire_resolve(spark, d):
    from corpusmill.operators.anomaly import breaches

    h = table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.avg("value").alias("v"))
    out = breaches(h, ["event_type"], "hour", F.col("v") > 20, 2)
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("fired", "resolved")})


@query("""with s as (select event_type, list_sort(list(distinct floor(epoch(ts))::bigint)) as s from events where value > 20 group by 1),
k as (select event_type, list_reduce(s, lambda a, x: case when x - a[-1] >= 7200 then list_append(a, x) else a end, [s[1]]) as k from s)
select event_type, unnest(k) as second from k""")
def alert_cooldown(spark, d):
    """Alerts of a rule that fire: after one, none for two hours."""
    from corpusmill.operators.anomaly import cooled

    e = table(spark, d, "events").where("value > 20")
    return cooled(e, ["event_type"], F.unix_seconds(F.col("ts").cast("timestamp")), 7200).select("event_type", "second")


@query("""with r as (select event_id, user_id || ':' || event_type as k, floor(epoch(ts))::bigint as s from events), g as (select k, list_sort(list(distinct s)) as s from r group by 1),
f as (select k, unnest(list_reduce(s, lambda a, x: case when x - a[-1] >= 86400 then list_append(a, x) else a end, [s[1]])) as second from g) select split_part(k, ':', 1)::bigint as user_id, split_part(k, ':', 2) as event_type, second from f""")
def alert_dedup(spark, d):
    """Alerts of one subject and rule, once a day's window."""
    from corpusmill.operators.anomaly import cooled

    return cooled(table(spark, d, "events"), ["user_id", "event_type"], F.unix_seconds(F.col("ts").cast("timestamp")), 86400)


@query("""with p as (select *, json_extract_string(props, '$.k')::int % 10 as place, user_id::varchar || '@' || strftime(ts, '%Y-%m-%d') as session from events),
s as (select session, count(distinct place) as n from p group by 1), f as (select user_id, place, min(ts) as t from p group by 1, 2), r as (select *, row_number() over (partition by user_id order by t, place) - 1 as known from f)
select session as subject, 'many_locations' as finding, 'high' as severity, n::bigint as n from s where n > 3
union all select user_id || '/' || place, 'new_location', case when known > 3 then 'high' else 'medium' end, known::bigint from r where known > 0""")
def location_anomalies(spark, d):
    from corpusmill.operators.anomaly import new_places, sessions_of_many_places

    e = table(spark, d, "events").withColumns({"place": F.get_json_object("props", "$.k").cast("int") % 10, "session": F.concat(F.col("user_id").cast("string"), F.lit("@"), F.date_format("ts", "yyyy-MM-dd"))})
    many = sessions_of_many_places(e, "session", "place", 3).select(F.col("session").alias("subject"), F.lit("many_locations").alias("finding"), F.lit("high").alias("severity"), "n")
    new = new_places(e, "user_id", "place", "ts").select(F.concat_ws("/", F.col("user_id").cast("string"), F.col("place").cast("string")).alias("subject"), F.lit("new_location").alias("finding"), "severity", F.col("known").alias("n"))
    return many.unionByName(new)


@query("""with s as (select user_id::varchar || '@' || strftime(ts, '%Y-%m-%d') as session, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as seconds from events group by 1) select session, round(seconds, 3) as seconds, case when seconds > 10800 then 'medium' else 'low' end as severity, round(least(seconds / 86400, 1), 6) as score from s where seconds > 5400""")
def long_sessions(spark, d):
    """Sessions over three times half an hour; over six times they weigh more."""
    from corpusmill.operators.anomaly import long_sessions as detect

    e = table(spark, d, "events").withColumns({"session": F.concat(F.col("user_id").cast("string"), F.lit("@"), F.date_format("ts", "yyyy-MM-dd")), "ts": F.col("ts").cast("timestamp")})
    out = detect(e, "session", "ts")
    return out.select("session", F.round("seconds", 3).alias("seconds"), "severity", F.round("score", 6).alias("score"))


@query("""with h as (select user_id, hour(ts) as h, count(*) as n from events group by 1, 2), d as (select user_id, count(*) / count(distinct ts::date) as daily, count(distinct event_type) as kinds, count(*) as n from events group by 1)
select d.user_id, n, round(daily, 6) as daily, kinds, (select string_agg(h::varchar, ',' order by h) from h where h.user_id = d.user_id and h.n >= 0.05 * d.n) as hours from d""")
def user_profiles(spark, d):
    """What is usual for a user: events a day, kinds, and the hours with a twentieth of the events or more."""
    from corpusmill.operators.anomaly import profiles

    return profiles(table(spark, d, "events"), "user_id", "event_type", "ts").withColumn("daily", F.round("daily", 6))


@query("select user_id, count(*) as n, round(avg(value), 6) as mean from events group by 1")
def stream_user_profile(spark, d):
    """The running profile of each user, state carried from batch to batch."""
    return jobs.latest(jobs.running_profiles(jobs.read_events(spark, d)), "user_id", "n").withColumn("mean", F.round("mean", 6))


@query("select event_id, json_extract_string(props, '$.k')::int as k from events")
def json_props_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def stream_tumbling(spark, d):
    return jobs.collected(jobs.tumbling(jobs.read_events(spark, d), "1 day"), "complete")


@query("""select strftime(w, '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total
from (select *, unnest([date_trunc('day', ts), date_trunc('day', ts) + interval 12 hour, date_trunc('day', ts) - interval 12 hour]) as w from events) where w <= ts and ts < w + interval 1 day group by 1, 2""")
def stream_sliding(spark, d):
    return jobs.collected(jobs.tumbling(jobs.read_events(spark, d), "1 day", "12 hours"), "complete")


@query("""with g as (select *, case when ts - lag(ts) over w >= interval 6 hour or lag(ts) over w is null then 1 else 0 end as fresh from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as k from g) select user_id, strftime(date_trunc('second', min(ts)), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from s group by user_id, k""")
def stream_session(spark, d):
    return jobs.collected(jobs.sessions(jobs.read_events(spark, d), "6 hours"), "complete")


@query("select event_id, event_type from events")
def stream_dedupe_watermark(spark, d):
    return jobs.collected(jobs.deduplicated(jobs.read_events(spark, d)).select("event_id", "event_type"), "append")


@query("select case when json_extract_string(props, '$.k')::int >= 90 then 'dead' else 'good' end as sink, count(*) as n from events group by 1")
def stream_dlq_split(spark, d):
    good, dead = jobs.split_dead_letters(jobs.read_events(spark, d), F.get_json_object("props", "$.k").cast("int") >= 90, "event_type")
    return good.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit("good").alias("sink"), "n").unionByName(dead.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit("dead").alias("sink"), "n"))


@query("""select event_type as topic, user_id::varchar as key, count(*) as n, count(*) filter (value is null or json_extract_string(props, '$.k')::int >= 90) as high from events where event_type in ('purchase', 'signup') group by 1, 2""")
def stream_dispatch(spark, d):
    """Envelopes written as JSON, decoded, dispatched by type and made records of a topic with key and priority."""
    wire = jobs.encoded(jobs.read_events(spark, d), "event_type", "user_id", F.when(F.col("value").isNull() | (F.get_json_object("props", "$.k").cast("int") >= 90), "high").otherwise("normal"))
    back = jobs.decode(wire.select(F.col("value").cast("string").alias("value")), jobs.ENVELOPE)
    out = jobs.collected(jobs.dispatched(back, ["purchase", "signup"]), "append")
    return out.groupBy("topic", "key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("priority") == "high", 1).otherwise(0)).alias("high"))


@query("""select 's3://b' || (user_id % 3) || '/' || event_id as url, 's3-b' || (user_id % 3) as source_id, event_type as event_name from events where event_type in ('click', 'purchase') and user_id % 2 = 0
union all select 'file:///' || event_id, 'filesystem', event_type from events where event_type in ('click', 'purchase') and user_id % 2 = 1""")
def stream_cdc_discovery(spark, d):
    """Changes of an object store and a file system as one stream of discovered files."""
    e = jobs.read_events(spark, d).where(F.col("event_type").isin("click", "purchase"))
    k = F.col("event_id").cast("string")
    s3 = jobs.discovered_s3(e.where("user_id % 2 = 0").select(F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string")).alias("bucket"), k.alias("object"), F.col("ts").alias("changed"), F.col("event_type").alias("event_name")))
    fs = jobs.discovered_files(e.where("user_id % 2 = 1").select(F.concat(F.lit("/"), k).alias("path"), F.col("ts").alias("changed"), F.col("event_type").alias("event_name")))
    return jobs.collected(s3.unionByName(fs), "append").select("url", "source_id", "event_name")


@query("""select case when json_extract_string(props, '$.k')::int >= 95 then 'file.failed' else 'file.completed' end as event, count(*) as n from events group by 1""")
def stream_process_files(spark, d):
    """Discovered files processed: each becomes a completed or a failed event with its error, after three tries."""
    e = jobs.read_events(spark, d).select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    done = jobs.collected(jobs.processed(e, F.when(F.col("k") >= 95, F.lit("unreadable")), 3), "append")
    return done.groupBy("event").agg(F.count(F.lit(1)).alias("n"))


@query("select event_type, count(*) as n from events where ts > (select max(ts) from events) - interval 7 day group by 1")
def window_retention(spark, d):
    """Points of the last week before the newest one; older ones go, and with them kinds that have none."""
    e = table(spark, d, "events")
    return jobs.retained(e, "ts", 7 * 86400).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
