"""Schedules, subscriptions, limits, progress, access patterns and lifecycle actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of a chunk's quality.
QUALITY_WEIGHTS = {"completeness": 0.25, "coherence": 0.25, "uniqueness": 0.20, "readability": 0.15, "language_conf": 0.10, "complexity": 0.05}


def weighted_quality(parts: dict[str, Column]) -> Column:
    """Weighted sum of the parts of QUALITY_WEIGHTS; a missing part counts as 0."""
    total = F.lit(0.0)
    for name, weight in QUALITY_WEIGHTS.items():
        if name in parts:
            total = total + F.coalesce(parts[name], F.lit(0.0)) * weight
    return total


def quality_band(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score < 0.5, "low").otherwise("medium")


def matching_subscriptions(events: DataFrame, subscriptions: DataFrame, now: Column) -> DataFrame:
    """events x subscriptions (sub_id, active, expires, connector, source, kinds) that are active, not expired, and want the event.

    A null connector or source is any. Events need event_type, connector and source; the table of subscriptions is what tenants
    registered, and is exploded by event type so that events meet it in an equi-join."""
    s = subscriptions.where(F.col("active") & (F.col("expires").isNull() | (F.col("expires") >= now)))
    s = s.select("sub_id", F.col("connector").alias("_connector"), F.col("source").alias("_source"), F.explode(F.array_distinct("kinds")).alias("event_type"))
    fits = (F.col("_connector").isNull() | (F.col("_connector") == F.col("connector"))) & (F.col("_source").isNull() | (F.col("_source") == F.col("source")))
    return events.join(s, "event_type").where(fits).drop("_connector", "_source")


def next_interval_run(last: Column, seconds: Column, now: Column) -> Column:
    """last + interval, or now + interval where that has passed; null for intervals that are not positive."""
    step = F.make_dt_interval(secs=seconds)
    return F.when(seconds > 0, F.when(last + step < now, now + step).otherwise(last + step))


def next_weekly_run(now: Column, days: Column, minutes: Column) -> Column:
    """The next time after now on one of the week days (1 Sunday to 7 Saturday) at so many minutes after midnight, within a week; else null."""
    midnight = F.date_trunc("day", now)
    at = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: midnight + F.make_dt_interval(days=i, mins=minutes))
    return F.array_min(F.filter(at, lambda t: F.array_contains(days, F.dayofweek(t)) & (t > now)))


def rate_limited(events: DataFrame, key: str, ts: str, limit: int, burst: int, window: str = "hour") -> DataFrame:
    """(key, start, n, rejected) of each fixed window: what goes beyond limit + burst is rejected."""
    n = events.groupBy(key, F.date_trunc(window, ts).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rejected", F.greatest(F.lit(0).cast("long"), F.col("n") - limit - burst))


def progress(rows: DataFrame, key: str, status: str, done: list[str], failed: list[str]) -> DataFrame:
    """(key, total, completed, failed, progress) by status; progress counts both ends."""
    tally = lambda v: F.sum(F.when(F.col(status).isin(v), 1).otherwise(0))
    g = rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"), tally(done).alias("completed"), tally(failed).alias("failed"))
    return g.withColumn("progress", (F.col("completed") + F.col("failed")) / F.col("total"))


def access_anomalies(events: DataFrame, key: str, kind: str, views: str, downloads: str, shares: str) -> DataFrame:
    """(key, finding, ratio) of keys that mostly download (over .8 of more than 5) or share (over .5 of more than 3)."""
    n = lambda v: F.sum(F.when(F.col(kind) == v, 1).otherwise(0))
    g = events.where(F.col(kind).isin(views, downloads, shares)).groupBy(key).agg(F.count(F.lit(1)).alias("n"), n(downloads).alias("d"), n(shares).alias("s"))
    rows = F.array_compact(F.array(
        F.when((F.col("d") / F.col("n") > 0.8) & (F.col("n") > 5), F.struct(F.lit("download").alias("finding"), (F.col("d") / F.col("n")).alias("ratio"))),
        F.when((F.col("s") / F.col("n") > 0.5) & (F.col("n") > 3), F.struct(F.lit("share").alias("finding"), (F.col("s") / F.col("n")).alias("ratio"))),
    ))
    return g.select(key, F.explode(rows).alias("r")).select(key, "r.*")


def lifecycle_action(wanted: Column, storage_class: Column, age: Column, least_age: int, compressed: Column) -> Column:
    """The wanted action where its guard allows it, else 'none': no second archive, no delete before `least_age`, no second compression."""
    allowed = F.when(wanted == "archive", ~storage_class.isin("GLACIER", "DEEP_ARCHIVE")).when(wanted == "delete", age > least_age).when(wanted == "compress", ~compressed).otherwise(False)
    return F.when(F.coalesce(allowed, F.lit(False)), wanted).otherwise("none")


def size_change(versions: DataFrame) -> DataFrame:
    """(path, significant): whether a version's size is over a tenth off the first one's; first by (changed, version)."""
    first = versions.groupBy("path").agg(F.min_by("size", F.struct("changed", "version")).alias("base"))
    off = F.abs(F.col("size") - F.col("base")) > 0.1 * F.col("base")
    return versions.join(first, "path").groupBy("path").agg(F.bool_or(off).alias("significant"))


def edge_metrics(edges: DataFrame) -> DataFrame:
    """One row over edges (src, dst, weight): count, mean, extremes, population deviation, and density among the nodes they touch."""
    nodes = edges.select(F.col("src").alias("n")).unionByName(edges.select(F.col("dst").alias("n"))).agg(F.countDistinct("n").alias("nodes"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.avg("weight").alias("mean"), F.min("weight").alias("least"), F.max("weight").alias("most"), F.stddev_pop("weight").alias("deviation"))
    return e.crossJoin(nodes).withColumn("density", F.try_divide(F.col("edges").cast("double"), F.col("nodes") * (F.col("nodes") - 1) / 2))


def next_single_run(run: Column, now: Column) -> Column:
    """A run set once, while it is ahead."""
    return F.when(run > now, run)


def next_monthly_run(now: Column, day: Column, minutes: Column) -> Column:
    """The next time after now on a day of the month (-1: the last one) at so many minutes after midnight. Days beyond a month's end run over into the next."""

    def at(months: int) -> Column:
        first = F.add_months(F.trunc(F.to_date(now), "month"), months)
        on = F.when(day == -1, F.last_day(first)).otherwise(F.date_add(first, day - 1))
        return on.cast("timestamp") + F.make_dt_interval(mins=minutes)

    return F.when(at(0) > now, at(0)).otherwise(at(1))


def estimated_seconds(files: Column, size: Column, ms_a_file: Column | None, at_once: int) -> Column:
    """By the measured time of a file, else at a MB a second; more files than run at once take .8 of their share longer."""
    base = F.floor(size / (1 << 20)).cast("double") if ms_a_file is None else files * ms_a_file / 1000
    return base * F.when(files > at_once, files / at_once * 0.8).otherwise(1.0)


def beyond(used: Column, limit: Column) -> Column:
    """Whether a use is over its limit; 0 is no limit."""
    return (limit > 0) & (used > limit)


def error_spikes(events: DataFrame, key: str, ts: str, bad: Column, least: float) -> DataFrame:
    """(key, hour, error_rate, severity) of hours whose percentage of errors is `least` or more; critical from 50 on."""
    g = events.groupBy(key, F.date_trunc("hour", ts).alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(bad, 1).otherwise(0)).alias("bad"))
    rate = 100.0 * F.col("bad") / F.col("n")
    return g.where(rate >= least).select(key, "hour", rate.alias("error_rate"), F.when(rate >= 50, "critical").otherwise("high").alias("severity"))


def remaining(rows: DataFrame, key: str, done: Column, ts: str) -> DataFrame:
    """(key, progress, eta_seconds): share done, and the time left at the pace so far; null where nothing is done."""
    g = rows.groupBy(key).agg(F.avg(F.when(done, 1.0).otherwise(0.0)).alias("progress"), ((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1e6).alias("elapsed"))
    return g.select(key, "progress", F.when(F.col("progress") > 0, F.col("elapsed") / F.col("progress") - F.col("elapsed")).alias("eta_seconds"))
