"""Tiers, costs, recommendations and scores; sync conflicts and their resolution. "Now" is a column, never the clock."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Price and price of retrieval of a GB and month, and of moving a GB between tiers (others .01).
PRICES = {"hot": 0.023, "warm": 0.0125, "cold": 0.004, "archive": 0.00099, "glacier": 0.0004}
RETRIEVAL = {"hot": 0.0, "warm": 0.01, "cold": 0.02, "archive": 0.03, "glacier": 0.05}
MOVES = {("hot", "warm"): 0.0, ("hot", "cold"): 0.01, ("warm", "cold"): 0.0, ("warm", "archive"): 0.05, ("cold", "archive"): 0.02, ("cold", "glacier"): 0.05, ("archive", "glacier"): 0.03}
OTHER_MOVE = 0.01


def optimal_tier(per_day: Column, idle_days: Column, gb: Column, age_days: Column) -> Column:
    """By accesses a day, days since the last one, size and age; the first that holds."""
    return (
        F.when(per_day >= 1, "hot")
        .when((per_day >= 0.2) & (idle_days < 7), "warm")
        .when((per_day >= 0.03) & (idle_days < 30), "warm")
        .when((idle_days < 90) & (gb < 10), "warm")
        .when(idle_days < 365, "cold")
        .when(age_days > 7 * 365, "glacier")
        .otherwise("archive")
    )


def _price(table: dict[str, float], tier: Column) -> Column:
    return reduce(lambda out, kv: out.when(tier == kv[0], kv[1]), table.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)


def move_cost(now: Column, to: Column) -> Column:
    """Of a GB from tier to tier."""
    return reduce(lambda out, kv: out.when((now == kv[0][0]) & (to == kv[0][1]), kv[1]), MOVES.items(), F.when(F.lit(False), 0.0)).otherwise(OTHER_MOVE)


def supported_move(now: Column, to: Column) -> Column:
    """Whether both are tiers and differ."""
    return now.isin(list(PRICES)) & to.isin(list(PRICES)) & (now != to)


def with_use(files: DataFrame) -> DataFrame:
    """files (accesses, first, last, bytes, now) with gb, age_days, idle_days and per_day; ages count as a day at the least for the rate."""
    days = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) / 86_400_000_000
    out = files.withColumns({"gb": F.col("bytes") / float(1 << 30), "age_days": days(F.col("now"), F.col("first")), "idle_days": days(F.col("now"), F.col("last"))})
    return out.withColumn("per_day", F.col("accesses") / F.greatest(F.lit(1.0), F.col("age_days")))


def costs(files: DataFrame) -> DataFrame:
    """with_use() rows (tier) with `target`, the cost now and then, of the move, monthly saving less retrieval, months to pay back (999: never) and yearly return in percent (null for a free move)."""
    f = files.withColumn("target", optimal_tier(F.col("per_day"), F.col("idle_days"), F.col("gb"), F.col("age_days")))
    f = f.withColumns({"cost_now": F.col("gb") * _price(PRICES, F.col("tier")), "storage": F.col("gb") * _price(PRICES, F.col("target")), "move": F.col("gb") * move_cost(F.col("tier"), F.col("target"))})
    f = f.withColumns({"gross": F.col("cost_now") - F.col("storage"), "retrieval": F.col("gb") * _price(RETRIEVAL, F.col("target")) * F.col("per_day") * 30})
    f = f.withColumns({"saving": F.col("gross") - F.col("retrieval"), "payback": F.when(F.col("gross") > 0, F.ceil(F.round(F.col("move") / F.col("gross"), 9)).cast("int")).otherwise(999)})
    return f.withColumn("roi", F.try_divide(F.col("saving") * 12, F.col("move")) * 100)


def consistency(days: Column, mean: Column, deviation: Column) -> Column:
    """1 less the spread of daily accesses against their mean; .5 for less than seven days."""
    return F.when(days < 7, 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(deviation, mean), F.lit(0.0))))


def confidence(age_days: Column, even: Column, gb: Column, idle_days: Column, target: Column) -> Column:
    """.3 history up to six months + .3 evenness + .2 size up to a GB + .2 how well the idle time fits the target."""
    fit = F.when(target == "warm", F.greatest(F.lit(0.0), 1 - idle_days / 30))
    for tier, days in (("cold", 90), ("archive", 365), ("glacier", 730)):
        fit = fit.when(target == tier, F.least(idle_days / days, F.lit(1.0)))
    return F.least(F.lit(1.0), F.least(age_days / 180, F.lit(1.0)) * 0.3 + even * 0.3 + F.least(gb, F.lit(1.0)) * 0.2 + fit.otherwise(0.0) * 0.2)


def recommended(files: DataFrame) -> DataFrame:
    """costs() rows with `confidence` that are worth a move: another tier, a saving of 1 or more, at .6 or more, paid back within a year."""
    return files.where((F.col("target") != F.col("tier")) & (F.col("gross") > 0) & (F.col("saving") >= 1) & (F.col("confidence") >= 0.6) & (F.col("payback") <= 12))


def top_recommended(files: DataFrame, key: str, most: int = 100) -> DataFrame:
    """The `most` recommendations of most saving times confidence: a report, so the limit is the feature."""
    return recommended(files).withColumn("impact", F.col("saving") * F.col("confidence")).orderBy(F.desc(F.round("impact", 6)), key).limit(most)


def tenant_score(files: DataFrame, tenant: str) -> DataFrame:
    """(tenant, files, recommendations, score): 100 less 2 a recommendation, and 50 times the share of hot files beyond .3; 0 to 100."""
    worth = (F.col("target") != F.col("tier")) & (F.col("gross") > 0) & (F.col("saving") >= 1) & (F.col("confidence") >= 0.6) & (F.col("payback") <= 12)
    g = files.groupBy(tenant).agg(F.count(F.lit(1)).alias("files"), F.sum(F.when(worth, 1).otherwise(0)).alias("recommendations"), F.avg(F.when(F.col("tier") == "hot", 1.0).otherwise(0.0)).alias("hot"))
    score = 100 - 2 * F.col("recommendations") - F.greatest(F.lit(0.0), F.col("hot") - 0.3) * 50
    return g.select(tenant, "files", "recommendations", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).alias("score"))


#: Whether a conflict resolves by itself, and how.
SUGGESTED = {"modify_modify": "last_write", "modify_delete": "manual", "create_create": "preserve_both", "directory_file": "manual", "rename_rename": "manual"}
AUTO = ["modify_modify", "create_create"]


def conflicts(versions: DataFrame) -> DataFrame:
    """(path, conflict, severity, auto, suggested) of paths with more than one version (version, changed, size, op, and if there are: checksum, is_dir, name).

    The first kind that holds: two modified, modified and deleted, two created of different content, file and folder, two names, else two modified.
    Severity is high for a deletion or a folder; two modified are of medium one if a size is over a tenth off the first version's, else low; others medium."""
    has = lambda c: c in versions.columns
    n = lambda op: F.sum(F.when(F.col("op") == op, 1).otherwise(0))
    first = F.min_by("size", F.struct("changed", "version"))
    g = versions.groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), n("modify").alias("m"), n("delete").alias("x"), n("create").alias("c"), first.alias("base"), F.min("size").alias("low"), F.max("size").alias("high"),
        (F.countDistinct("checksum") if has("checksum") else F.lit(2)).alias("contents"), (F.countDistinct("is_dir") if has("is_dir") else F.lit(1)).alias("sorts"), (F.countDistinct("name") if has("name") else F.lit(1)).alias("names"),
    ).where("n > 1")
    kind = F.when(F.col("m") > 1, "modify_modify").when((F.col("m") > 0) & (F.col("x") > 0), "modify_delete").when((F.col("c") > 1) & (F.col("contents") > 1), "create_create").when(F.col("sorts") > 1, "directory_file").when(F.col("names") > 1, "rename_rename").otherwise("modify_modify")
    changed = F.greatest(F.col("high") - F.col("base"), F.col("base") - F.col("low")) > 0.1 * F.col("base")
    severity = F.when(kind.isin("modify_delete", "directory_file"), "high").when(kind == "modify_modify", F.when(changed, "medium").otherwise("low")).otherwise("medium")
    suggested = reduce(lambda out, kv: out.when(kind == kv[0], kv[1]), SUGGESTED.items(), F.when(F.lit(False), "")).otherwise("manual")
    return g.select("path", kind.alias("conflict"), severity.alias("severity"), kind.isin(AUTO).alias("auto"), suggested.alias("suggested"))


def resolved(versions: DataFrame, strategy: str, priority: list[str] | None = None) -> DataFrame:
    """(path, version) that a strategy keeps; ties go by version. preserve_both keeps all, skip and manual keep none, merge keeps the first version."""
    if strategy == "preserve_both":
        return versions.select("path", "version")
    if strategy in ("skip", "manual"):
        return versions.select("path", "version").limit(0)
    if strategy == "source_priority":
        rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("op")), F.lit(len(priority) + 1))
        return versions.groupBy("path").agg(F.min_by("version", F.struct(rank, "version")).alias("version"))
    by = {"last_write": (F.max_by, "changed"), "first_write": (F.min_by, "changed"), "merge": (F.min_by, "changed"), "largest": (F.max_by, "size")}[strategy]
    return versions.groupBy("path").agg(by[0]("version", F.struct(by[1], "version")).alias("version"))
