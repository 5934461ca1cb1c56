"""Streams over `events` with keyed state and timers, and the batch form of their alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.plans.registry import query
from corpusmill.session import table
from corpusmill.streaming import jobs, stateful

HOUR, LATE = 3_600_000, 600_000
#: What the watermark has passed when the stream ends.
_UNTIL = f"(select max(epoch_us(ts) // 1000) - {LATE} from events)"

_ALERTS = f"""with k as (select user_id, epoch_us(ts) // 1000 as m, coalesce(value > 20, false) as b from events where ts is not null and epoch_us(ts) // 1000 <= {_UNTIL}),
c as (select user_id, m, b from (select *, lag(b, 1, false) over (partition by user_id order by m, b) as was from k) where b <> was),
r as (select user_id, m, lead(m) over (partition by user_id order by m, b) as ends, b from c),
l as (select user_id, u, list(struct_pack(s := m, e := ends) order by m) as l from r, (select {_UNTIL} as u) where b group by 1, 2),
f as (select user_id, list_reduce(l, lambda a, x: case when t(a, x) <= u and (x.e is null or t(a, x) < x.e) then struct_pack(fired := t(a, x), o := a.o || [struct_pack(event := 'fired', ms := t(a, x))] || case when x.e is null then [] else [struct_pack(event := 'resolved', ms := x.e)] end) else a end,
  struct_pack(fired := null::bigint, o := []::struct(event varchar, ms bigint)[])) as a from l)
select user_id, o.event, o.ms as "at" from (select user_id, unnest(a.o) as o from f)""".replace("t(a, x)", f"greatest(x.s + {HOUR}, coalesce(a.fired + {24 * HOUR}, x.s))")


@query(_ALERTS)
def stream_alerts(spark, d):
    """Users whose values stay over 20 for an hour: fired then, resolved by the next lower value, not again within a day."""
    with stateful.rocksdb(spark):
        return jobs.collected(stateful.alerts(jobs.read_events(spark, d), ["user_id"], "ts", F.col("value") > 20, HOUR, 24 * HOUR), "append")


@query(_ALERTS)
def alerts_lasting(spark, d):
    """As stream_alerts, from the table."""
    e = table(spark, d, "events")
    until = e.agg(F.max(F.unix_millis(F.col("ts").cast("timestamp")))).first()[0]
    return stateful.fold_alerts(e, ["user_id"], "ts", F.col("value") > 20, HOUR, 24 * HOUR, (until or 0) - LATE)


@query(f"""with k as (select user_id, epoch_us(ts) // 1000 as m, event_type, value from events where ts is not null and epoch_us(ts) // 1000 <= {_UNTIL}),
g as (select *, sum(case when m - was < {6 * HOUR} then 0 else 1 end) over (partition by user_id order by m rows unbounded preceding) as run from (select *, lag(m) over (partition by user_id order by m) as was from k))
select user_id, min(m) as start, max(m) as last, count(*) as requests, string_agg(distinct event_type, ',' order by event_type) as kinds, round(avg(value), 6) as mean from g group by user_id, run having max(m) + {6 * HOUR} <= {_UNTIL}""")
def stream_user_sessions(spark, d):
    """What each user did until six hours passed without an event, written when the session expires."""
    with stateful.rocksdb(spark):
        return jobs.collected(stateful.sessions(jobs.read_events(spark, d), ["user_id"], "ts", "event_type", "value", 6 * HOUR), "append").withColumn("mean", F.round("mean", 6))


@query(f"""with k as (select event_id, epoch_us(ts) // 1000 as m, json_extract_string(props, '$.k')::int % 5 as fails from events where ts is not null), r as (select event_id, m, least(fails + 1, 3) as tries, fails >= 3 as dead from k)
select event_id, case when dead then 'dead' else 'completed' end as event, tries::int as tries, case when dead then 'attempt 3 of k' end as error from r where tries = 1 or m + (tries - 1) * {HOUR} <= {_UNTIL}""")
def stream_retries(spark, d):
    """Events tried again an hour after each failure, three times at most, then dead with the last error: one with k fails its first k % 5 attempts."""

    def flaky(body: str, attempt: int) -> str | None:
        import json

        return f"attempt {attempt} of k" if attempt <= json.loads(body)["k"] % 5 else None

    with stateful.rocksdb(spark):
        e = jobs.read_events(spark, d).withColumn("body", F.to_json(F.struct("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))))
        out = jobs.collected(stateful.retried(e, ["user_id"], "ts", "body", flaky, 3, HOUR), "append")
    return out.select(F.get_json_object("body", "$.event_id").cast("long").alias("event_id"), "event", "tries", "error")
