"""Time series aggregates, moments, trends, outliers and baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.operators.graph import settled

PERCENTS = [50, 90, 95, 99]


CUTS = 256


def order_statistics(df: DataFrame, keys: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """(keys, n, one column a place): the exact values at some indices of each ordered group, each given as an expression of `n`; nulls take no part.

    Values are counted first. Cuts of a quantile sketch part a group into ranges of some 1/256 of its rows; running counts over the ranges tell in which
    of them an index falls, and only those are ordered, each by itself. No task orders a group."""
    v = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    g = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(value, [i / CUTS for i in range(1, CUTS)], 2000).alias("_cuts"))
    # a sketch depends on the order in which its parts arrive, so all that uses the cuts must read the same ones
    g = settled(g)
    b = v.join(g, keys).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    up = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    ranges = b.groupBy(*keys, "_b").agg(F.sum("_c").alias("_of")).withColumn("_before", F.coalesce(F.sum("_of").over(up), F.lit(0)))
    asked = g.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("name"), i.cast("long").alias("at")) for k, i in places.items()])).alias("_p")).select(*keys, "_p.*")
    here = ranges.join(asked, keys).where((F.col("at") >= F.col("_before")) & (F.col("at") < F.col("_before") + F.col("_of")))
    run = W.partitionBy(*keys, "_b", "name").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    found = b.join(here.drop("_of"), [*keys, "_b"]).withColumn("_to", F.col("_before") + F.sum("_c").over(run))
    found = found.where((F.col("at") < F.col("_to")) & (F.col("at") >= F.col("_to") - F.col("_c")))
    return found.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("name") == k, F.col("_v"))).alias(k) for k in places])


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, n, one column a share): interpolated percentiles from the two values around each."""
    at = {k: (F.col("n") - 1) * q for k, q in shares.items()}
    o = order_statistics(df, keys, value, {f"{k}_{side}": f(F.round(i, 9)) for k, i in at.items() for side, f in (("low", F.floor), ("high", F.ceil))})
    part = lambda k: F.round(at[k], 9) - F.floor(F.round(at[k], 9))
    return o.select(*keys, "n", *[(F.col(f"{k}_low") + (F.col(f"{k}_high") - F.col(f"{k}_low")) * part(k)).alias(k) for k in shares])


def numbered(df: DataFrame, keys: list[str], order: list[str], part: Column) -> DataFrame:
    """df with _i, each row's place from 0 in its ordered group, and _n, the group's size. `part` follows the order and cuts a group into parts: rows are
    numbered within one and offset by the counts of those before."""
    d = df.withColumn("_part", part)
    sums = d.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_c"))
    w = W.partitionBy(*keys).orderBy("_part")
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "_n": F.sum("_c").over(W.partitionBy(*keys))}).drop("_c")
    own = F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order)) - 1
    return d.withColumn("_own", own).join(sums, [*keys, "_part"]).withColumn("_i", F.col("_own") + F.col("_before")).drop("_own", "_before")


def series(df: DataFrame, keys: list[str], ts: str, value: str, window: str) -> DataFrame:
    """Count, sum, mean, extremes, sample deviation (0 for one row) and interpolated percentiles of each key and window."""
    v = F.col(value)
    p = [F.percentile(v, F.lit(q / 100)).alias(f"p{q}") for q in PERCENTS]
    g = df.groupBy(F.window(ts, window).start.alias("start"), *keys)
    return g.agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("deviation"), *p)


SHARES = {"p1": 0.01, "p5": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, variance, range, percentiles, interquartile range, and sample skewness and excess kurtosis with bias correction (0 where not defined).

    Values are shifted by each group's mean before powers are summed, so that sums of powers lose no digits."""
    v = F.col(value).cast("double")
    full = df.where(v.isNotNull()).select(*keys, v.alias("_x"))
    base = full.groupBy(*keys).agg(F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("sd"), F.min("_x").alias("least"), F.max("_x").alias("most"))
    z = (F.col("_x") - F.col("mean")) / F.col("sd")
    sums = full.join(base.select(*keys, "mean", "sd"), keys).groupBy(*keys).agg(F.sum(F.when(F.col("sd") > 0, F.pow(z, 3))).alias("z3"), F.sum(F.when(F.col("sd") > 0, F.pow(z, 4))).alias("z4"))
    out = base.join(sums, keys).join(percentiles(full, keys, "_x", SHARES), keys)
    n = F.col("n").cast("double")
    skew = F.when((F.col("n") > 2) & (F.col("sd") > 0), n / ((n - 1) * (n - 2)) * F.col("z3")).otherwise(0.0)
    kurt = F.when((F.col("n") > 3) & (F.col("sd") > 0), n * (n + 1) / ((n - 1) * (n - 2) * (n - 3)) * F.col("z4") - 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))).otherwise(0.0)
    return out.select(*keys, "n", "mean", F.coalesce(F.col("sd") * F.col("sd"), F.lit(0.0)).alias("variance"), (F.col("most") - F.col("least")).alias("spread"), *SHARES, (F.col("p75") - F.col("p25")).alias("iqr"), skew.alias("skewness"), kurt.alias("kurtosis"))


def trend(df: DataFrame, keys: list[str], ts: str, value: str, level: float = 0.001) -> DataFrame:
    """Least-squares line of value over seconds since the first, its fit, direction and strength, and the change against the first value."""
    first = df.groupBy(*keys).agg(F.min(ts).alias("_t0"), F.min_by(value, F.struct(ts, value)).alias("first_value"), F.max_by(value, F.struct(ts, value)).alias("last_value"))
    x = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_t0").cast("timestamp"))) / 1e6
    g = df.join(first, keys).withColumn("_x", x).groupBy(*keys).agg(F.regr_slope(value, "_x").alias("slope"), F.regr_intercept(value, "_x").alias("intercept"), F.regr_r2(value, "_x").alias("r2"), F.first("first_value").alias("a"), F.first("last_value").alias("b"))
    r2 = F.coalesce("r2", F.lit(1.0))
    way = F.when(F.col("slope") > level, "increasing").when(F.col("slope") < -level, "decreasing").otherwise("stable")
    how = F.when(r2 >= 0.8, "strong").when(r2 >= 0.5, "moderate").when(r2 >= 0.2, "weak").otherwise("very_weak")
    return g.select(*keys, "slope", "intercept", r2.alias("r2"), way.alias("direction"), how.alias("strength"), F.when(F.col("a") != 0, (F.col("b") - F.col("a")) / F.col("a") * 100).otherwise(0.0).alias("change_percent"))


def volatility(df: DataFrame, keys: list[str], order: list[str], value: str, part: Column) -> DataFrame:
    """(keys, volatility, momentum): population deviation of the returns against the row before, 0 where that is 0; change in percent over the last
    tenth of ten rows or more, two at the least. Parts of a group are ordered each by itself; the first row of one meets the last of the part before."""
    d = df.withColumn("_part", part)
    w = W.partitionBy(*keys, "_part").orderBy(*order)
    ends = d.groupBy(*keys, "_part").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    ends = ends.withColumn("_last", F.lag("_last").over(W.partitionBy(*keys).orderBy("_part")))
    r = d.withColumns({"_lag": F.lag(value).over(w), "_k": F.row_number().over(w)}).join(ends, [*keys, "_part"])
    before = F.when(F.col("_k") == 1, F.col("_last")).otherwise(F.col("_lag"))
    r = r.select(*keys, F.when(before.isNull(), None).when(before == 0, 0.0).otherwise(F.col(value) / before - 1).alias("_r"))
    v = r.groupBy(*keys).agg(F.coalesce(F.stddev_pop("_r"), F.lit(0.0)).alias("volatility"))
    recent = F.greatest(F.floor(F.col("_n") * 0.1), F.lit(2))
    i = numbered(df, keys, order, part).where((F.col("_i") == F.col("_n") - 1) | (F.col("_i") == F.col("_n") - recent))
    m = i.groupBy(*keys, "_n").agg(F.min_by(value, "_i").alias("_a"), F.max_by(value, "_i").alias("_z"))
    m = m.select(*keys, F.when((F.col("_n") >= 10) & (F.col("_a") != 0), (F.col("_z") - F.col("_a")) / F.col("_a") * 100).otherwise(0.0).alias("momentum"))
    return v.join(m, keys)


def iqr_outliers(df: DataFrame, keys: list[str], value: str, times: float = 1.5) -> DataFrame:
    """Rows outside the quartiles by `times` their distance. Quartiles are the values at index floor(n/4) and floor(3n/4), from groups of 4 or more."""
    q = order_statistics(df, keys, value, {"q1": F.floor(F.col("n") / 4), "q3": F.floor(3 * F.col("n") / 4)}).where("n >= 4")
    j = df.join(q, keys)
    return j.where((F.col(value) < F.col("q1") - times * (F.col("q3") - F.col("q1"))) | (F.col(value) > F.col("q3") + times * (F.col("q3") - F.col("q1"))))


def modified_z(df: DataFrame, keys: list[str], value: str, over: float = 3.5) -> DataFrame:
    """Rows whose 0.6745 (x - median) / MAD is beyond `over`; groups of 3 or more with a MAD above 0."""
    med = percentiles(df, keys, value, {"median": 0.5}).where("n >= 3").drop("n")
    j = df.join(med, keys).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    mad = percentiles(j, keys, "_d", {"mad": 0.5}).where("mad > 0").drop("n")
    z = 0.6745 * (F.col(value) - F.col("median")) / F.col("mad")
    return j.join(mad, keys).withColumn("modified_z", z).where(F.abs("modified_z") > over).drop("_d")


def z_outliers(df: DataFrame, keys: list[str], value: str, over: float = 2.5, least: int = 30) -> DataFrame:
    """Rows beyond `over` deviations of their group's baseline, with severity, score and confidence; baselines of `least` rows or more."""
    b = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n")).where((F.col("n") >= least) & (F.col("sd") > 0))
    z = (F.col(value) - F.col("mean")) / F.col("sd")
    a = F.abs("z")
    return df.join(b, keys).withColumn("z", z).where(a > over).withColumns({
        "severity": F.when(a >= 4, "critical").when(a >= 3, "high").otherwise("medium"),
        "score": a / 5,
        "confidence": F.greatest(F.lit(0.1), F.least(F.lit(0.95), F.least(a / 5, F.lit(0.9)) * (0.5 + 0.5 * F.least(F.col("n") / 100, F.lit(1.0))))),
    })


def period_deviation(df: DataFrame, part: Column, ts: str, over: float) -> DataFrame:
    """Counts by a part of the time (hour, weekday), and those off their mean by more than `over` of it."""
    c = df.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    m = F.broadcast(c.agg(F.avg("n").alias("mean")))  # one row
    off = F.abs(F.col("n") - F.col("mean")) / F.col("mean")
    return c.crossJoin(m).select("part", "n", off.alias("deviation"), (off > over).alias("anomalous"))


def cumulative_histogram(df: DataFrame, value: Column, bounds: list[float]) -> DataFrame:
    """For each bound the count and sum of values up to it."""
    aggs = [a for i, b in enumerate(bounds) for a in (F.sum(F.when(value <= b, 1).otherwise(0)).alias(f"n{i}"), F.sum(F.when(value <= b, value)).alias(f"t{i}"))]
    rows = F.explode(F.array(*[F.struct(F.lit(float(b)).alias("bound"), F.col(f"n{i}").alias("n"), F.round(f"t{i}", 2).alias("total")) for i, b in enumerate(bounds)])).alias("r")
    return df.agg(*aggs).select(rows).select("r.*")


def ema(df: DataFrame, keys: list[str], order: list[str], value: str, part: Column | None = None, alpha: float = 0.5, fan: int = 32) -> DataFrame:
    """Exponential running average at the end of each ordered group: old and new weigh 1 - alpha and alpha, from the first value on; null values take no part.

    `part` is an integer that grows with the order; without it a group is one part. The rows of a part are one map x -> a x + b of the average before them; maps of neighbouring parts
    are composed, `fan` at a time, until one is left, and that takes the group's first value. So no task has more than a part or `fan` maps of a group."""
    part = F.lit(0) if part is None else part
    back = F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*[F.desc(c) for c in order])) - 1
    r = df.where(F.col(value).isNotNull()).withColumn("_part", part.cast("long")).withColumn("_back", back)
    weight = F.pow(F.lit(1 - alpha), F.col("_back"))
    m = r.groupBy(*keys, "_part").agg(F.pow(F.lit(1 - alpha), F.count(F.lit(1))).alias("a"), F.sum(weight * alpha * F.col(value)).alias("b"), F.max_by(value, "_back").cast("double").alias("v"))
    ends = df.agg(F.min(part.cast("long")).alias("lo"), F.max(part.cast("long")).alias("hi")).first()  # one row
    lo, hi = ends["lo"] or 0, ends["hi"] or 0
    then = lambda s, x: F.struct((x["a"] * s["a"]).alias("a"), (x["a"] * s["b"] + x["b"]).alias("b"))
    none = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    while hi > lo:
        up = F.floor((F.col("_part") - lo) / fan).cast("long").alias("_part")
        m = m.groupBy(*keys, up).agg(F.array_sort(F.collect_list(F.struct("_part", "a", "b"))).alias("l"), F.min_by("v", "_part").alias("v"))
        m = m.withColumn("l", F.aggregate("l", none, then)).select(*keys, "_part", "l.a", "l.b", "v")
        lo, hi = 0, (hi - lo) // fan
    return m.select(*keys, (F.col("a") * F.col("v") + F.col("b")).alias("ema"))


def sketched(df: DataFrame, keys: list[str], ts: str, value: str, unit: str = "hour", k: int = 800) -> DataFrame:
    """(keys, start, n, total, least, most, sketch) of the values of each unit of time: a KLL sketch of bounded size beside the exact sums.

    Its ranks are off by some 2.3 / k^0.9 of the rows, .6 % at 800, with 99 % confidence, however many rows there are. Nulls and rows without a time take no part."""
    v = df.where(F.col(value).isNotNull() & F.col(ts).isNotNull()).select(*keys, F.date_trunc(unit, ts).alias("start"), F.col(value).cast("double").alias("_v"))
    return v.groupBy(*keys, "start").agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("total"), F.min("_v").alias("least"), F.max("_v").alias("most"), F.kll_sketch_agg_double("_v", k).alias("sketch"))


def rolled_up(sketches: DataFrame, keys: list[str], unit: str, k: int = 800) -> DataFrame:
    """Sketches of a longer unit from those of a shorter one; no value is read again."""
    return sketches.groupBy(*keys, F.date_trunc(unit, "start").alias("start")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch", k).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, shares: dict[str, float]) -> DataFrame:
    """The sketch read at some shares of the rows, a column each."""
    return sketches.withColumns({name: F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))) for name, q in shares.items()}).drop("sketch")
