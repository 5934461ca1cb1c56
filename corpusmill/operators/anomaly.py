"""Behavioural, content and security detectors, alert rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def exact_copies(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Texts that stood before, trimmed and lower-cased, with the number of earlier copies and a severity.

    The number of copies before each is a rank among equal hashes; a hash that many rows share is ranked by (hash, bucket of id)
    and bucket totals, so that no task ranks them all."""
    h = F.md5(F.lower(F.trim(F.col(text))))
    rows = docs.select(F.col(key), h.alias("h"), F.floor(F.col(key) / 1000).alias("b"))
    own = rows.withColumn("k", F.row_number().over(W.partitionBy("h", "b").orderBy(key)) - 1)
    sums = rows.groupBy("h", "b").agg(F.count(F.lit(1)).alias("n"))
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("h").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    earlier = F.col("k") + F.col("before")
    out = own.join(sums, ["h", "b"]).select(key, earlier.alias("earlier")).where("earlier > 0")
    return out.withColumn("severity", F.when(F.col("earlier") > 5, "high").when(F.col("earlier") > 2, "medium").otherwise("low"))


def ratios(df: DataFrame, keys: list[str], event: Column, least: int, over: float) -> DataFrame:
    """Groups whose share of an event is beyond `over`, of more than `least` rows."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(event, 1).otherwise(0)).alias("hits"))
    return g.withColumn("ratio", F.col("hits") / F.col("n")).where((F.col("n") > least) & (F.col("ratio") > over))


def bursts(df: DataFrame, keys: list[str], ts: str, seconds: int = 300, most: int = 20) -> DataFrame:
    """Rows with more than `most` rows of their key in the trailing `seconds`.

    Rows meet within spans of that length: each stands in its own span and, as one of the past, in the next, so that a busy key is many groups."""
    d = df.withColumn("_s", F.unix_seconds(F.col(ts).cast("timestamp"))).withColumn("_span", F.floor(F.col("_s") / seconds))
    both = d.withColumn("_own", F.lit(True)).unionByName(d.withColumn("_own", F.lit(False)).withColumn("_span", F.col("_span") + 1))
    w = W.partitionBy(*keys, "_span").orderBy("_s").rangeBetween(-seconds, 0)
    return both.withColumn("requests", F.count(F.lit(1)).over(w)).where(F.col("_own") & (F.col("requests") > most)).drop("_s", "_span", "_own")


def velocity(df: DataFrame, keys: list[str], ts: str, over: float = 2.0) -> DataFrame:
    """Key and minute counts against the key's mean minute; those beyond `over` times it."""
    m = df.groupBy(*keys, F.date_trunc("minute", ts).alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    b = m.groupBy(*keys).agg(F.avg("n").alias("usual"))
    return m.join(b, keys).withColumn("factor", F.col("n") / F.col("usual")).where(F.col("factor") > over)


def hours_apart(a: Column, b: Column) -> Column:
    """Distance of two hours on the clock."""
    d = F.abs(a - b)
    return F.least(d, 24 - d)


def char_profile(text: Column) -> dict[str, Column]:
    """Shares of characters outside printable ASCII and of digits; 0 for empty text."""
    n = F.length(text)
    share = lambda pattern: F.when(n > 0, F.regexp_count(text, F.lit(pattern)) / n).otherwise(0.0)
    return {"special": share(r"[^ -~]"), "digits": share(r"[0-9]")}


#: Signatures of shell, command and SQL attacks.
SIGNATURES = {
    "powershell": r"(?i)powershell\.exe|pwsh\.exe|-encodedcommand|invoke-expression|iex\s",
    "cmd": r"(?i)(\|\s*)(whoami|netstat|ipconfig|ifconfig|ps\s|ls\s|cat\s|wget\s|curl\s)",
    "sql_injection": r"(?i)(union\s+select|or\s+1\s*=\s*1|drop\s+table|insert\s+into|update\s+.*\s+set)",
}
#: Marks of scripts that hide what they do; .2 each.
OBFUSCATION = [r"eval\s*\(", r"document\.write\s*\(", "fromCharCode", r"unescape\s*\(", r"decodeURIComponent\s*\(", r"String\.fromCharCode", r"\\x[0-9a-fA-F]{2}", r"\\u[0-9a-fA-F]{4}"]
#: Endings of files that warrant a look, and those that run.
SUSPICIOUS = [".exe", ".bat", ".cmd", ".sh", ".ps1", ".vbs", ".js", ".jar"]


def signatures(text: Column) -> Column:
    """Names of the signatures that a text holds, sorted and comma-joined."""
    return F.array_join(F.array_compact(F.array(*[F.when(text.rlike(p), n) for n, p in sorted(SIGNATURES.items())])), ",")


def density(text: Column, pattern: str) -> Column:
    """Share of characters in matches of a pattern."""
    n = F.length(text)
    return F.when(n > 0, (n - F.length(F.regexp_replace(text, pattern, ""))) / n).otherwise(0.0)


def breaches(df: DataFrame, keys: list[str], ts: str, breach: Column, least: int) -> DataFrame:
    """Runs of `least` or more rows in breach: when they fire and resolve (null while open), and their length."""
    w = W.partitionBy(*keys).orderBy(ts)
    r = df.withColumn("_b", breach).withColumn("_run", F.sum(F.when(~F.col("_b"), 1).otherwise(0)).over(w))
    r = r.withColumn("_next", F.lead(ts).over(w))
    g = r.where("_b").groupBy(*keys, "_run").agg(F.min(ts).alias("fired"), F.max("_next").alias("resolved"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("_next").isNull(), 1).otherwise(0)).alias("open"))
    return g.where(F.col("n") >= least).select(*keys, "fired", F.when(F.col("open") == 1, None).otherwise(F.col("resolved")).alias("resolved"), "n")


def obfuscation(text: Column) -> Column:
    """.2 for each mark of OBFUSCATION that a text holds."""
    return F.round(sum((F.when(text.rlike(p), 0.2).otherwise(0.0) for p in OBFUSCATION), F.lit(0.0)), 6)


def security_findings(rows: DataFrame, key: str, name: str, text: str, entropy: Column | None = None, hashes: DataFrame | None = None) -> DataFrame:
    """(key, finding, severity, score): dense base64 or hex, obfuscated scripts, signatures, suspicious file names, and known bad contents.

    hashes: (md5, threat, severity), what threat intelligence lists; it meets the rows in a join on the MD5 of the text."""
    t, n = F.coalesce(F.col(text), F.lit("")), F.lower(F.coalesce(F.col(name), F.lit("")))
    b64, hexes, odd = density(t, "[A-Za-z0-9+/]{20,}={0,2}"), density(t, "[0-9a-fA-F]{32,}"), obfuscation(t)
    one = lambda hit, f, sev, score: F.when(hit, F.struct(F.lit(f).alias("finding"), sev.alias("severity"), score.cast("double").alias("score")))
    grade = lambda v, cuts: F.when(v > cuts[1], "high").when(v > cuts[0], "medium").otherwise("low")
    found = [
        one(b64 > 0.3, "base64", grade(b64, (0.6, 0.8)), b64),
        one(hexes > 0.4, "hex", F.lit("low"), hexes),
        one(odd > 0.4, "obfuscation", F.when(odd > 0.8, "high").otherwise("medium"), odd),
        *[one(t.rlike(p), f"signature:{k}", F.lit("medium" if k == "powershell" else "high"), F.lit(0.9)) for k, p in SIGNATURES.items()],
        one(n.rlike("(" + "|".join(s.replace(".", r"\.") for s in SUSPICIOUS) + ")$"), "file_type", F.lit("high"), F.lit(0.9)),
    ]
    if entropy is not None:
        found.append(one(entropy > 7.5, "entropy", F.when(entropy > 7.8, "high").otherwise("medium"), (entropy - 6) / 2))
    out = rows.select(key, F.explode(F.array_compact(F.array(*found))).alias("f")).select(key, "f.*")
    if hashes is not None:
        bad = rows.select(key, F.md5(t).alias("md5")).join(hashes, "md5")
        out = out.unionByName(bad.select(key, F.concat(F.lit("hash:"), F.col("threat")).alias("finding"), F.when(F.col("severity") == "critical", "critical").otherwise("high").alias("severity"), F.lit(0.95).alias("score")))
    return out


def deviations(df: DataFrame, keys: list[str], value: str, over: float = 2.5, least: int = 30) -> DataFrame:
    """Rows whose value is off their group's mean by more than `over` deviations, from groups of `least` rows."""
    b = df.groupBy(*keys).agg(F.avg(value).alias("usual"), F.stddev_samp(value).alias("spread"), F.count(value).alias("rows")).where((F.col("rows") >= least) & (F.col("spread") > 0))
    return df.join(b, keys).withColumn("z", (F.col(value) - F.col("usual")) / F.col("spread")).where(F.abs("z") > over)


def fan_out(findings: list[DataFrame], thresholds: DataFrame) -> DataFrame:
    """All detectors' (detector, subject, severity, score) with a score that their detector's threshold (detector, least) admits; detectors without one pass."""
    out = findings[0]
    for f in findings[1:]:
        out = out.unionByName(f)
    return out.join(thresholds, "detector", "left").where(F.col("score") >= F.coalesce("least", F.lit(0.0))).drop("least")


def cooled(df: DataFrame, keys: list[str], second: Column, cooldown: int) -> DataFrame:
    """(keys, second): when a rule fires: not within `cooldown` seconds of its last firing.

    After a pause of the cooldown the next one fires whatever came before, so runs between pauses are groups of their own; in one, distinct
    seconds are folded in order."""
    t = df.select(*keys, second.alias("_s")).distinct()
    pause = F.coalesce(F.col("_s") - F.lag("_s").over(W.partitionBy(*keys).orderBy("_s")) >= cooldown, F.lit(True))
    r = t.withColumn("_run", pause.cast("int")).withColumn("_run", F.sum("_run").over(W.partitionBy(*keys).orderBy("_s")))
    none = F.array().cast("array<long>")
    fold = F.aggregate(F.array_sort(F.collect_list("_s")), none, lambda a, x: F.when(x - F.coalesce(F.try_element_at(a, F.lit(-1)), x - cooldown) >= cooldown, F.concat(a, F.array(x))).otherwise(a))
    return r.groupBy(*keys, "_run").agg(fold.alias("_k")).select(*keys, F.explode("_k").alias("second"))


def sessions_of_many_places(df: DataFrame, session: str, place: str, most: int) -> DataFrame:
    return df.groupBy(session).agg(F.countDistinct(place).alias("n")).where(F.col("n") > most)


def new_places(df: DataFrame, user: str, place: str, ts: str) -> DataFrame:
    """(user, place, known, severity): places a user shows after others, with how many were known; beyond three it weighs more."""
    f = df.groupBy(user, place).agg(F.min(ts).alias("_t"))
    r = f.withColumn("known", (F.row_number().over(W.partitionBy(user).orderBy("_t", place)) - 1).cast("long"))
    return r.where("known > 0").select(user, place, "known", F.when(F.col("known") > 3, "high").otherwise("medium").alias("severity"))


def long_sessions(df: DataFrame, session: str, ts: str, timeout: int = 1800) -> DataFrame:
    """(session, seconds, severity, score) of sessions over three times the timeout."""
    g = df.groupBy(session).agg(((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1e6).alias("seconds")).where(F.col("seconds") > 3 * timeout)
    return g.select(session, "seconds", F.when(F.col("seconds") > 6 * timeout, "medium").otherwise("low").alias("severity"), F.least(F.col("seconds") / 86400, F.lit(1.0)).alias("score"))


def profiles(df: DataFrame, user: str, kind: str, ts: str, share: float = 0.05) -> DataFrame:
    """(user, n, daily, kinds, hours): events, events a day with any, distinct kinds, and the hours that have `share` of the events or more."""
    g = df.groupBy(user).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) / F.countDistinct(F.to_date(ts))).alias("daily"), F.countDistinct(kind).alias("kinds"))
    h = df.groupBy(user, F.hour(ts).alias("h")).agg(F.count(F.lit(1)).alias("c")).join(g.select(user, "n"), user).where(F.col("c") >= share * F.col("n"))
    hours = h.groupBy(user).agg(F.array_join(F.transform(F.array_sort(F.collect_list("h")), lambda x: x.cast("string")), ",").alias("hours"))
    return g.join(hours, user, "left")


def large_files(df: DataFrame, key: str, size: str, mb: int = 100) -> DataFrame:
    """(key, size_mb, score) of files over `mb` MB; ten times that scores 1."""
    m = F.col(size) / (1 << 20)
    return df.where(m > mb).select(key, m.alias("size_mb"), F.least(m / (mb * 10), F.lit(1.0)).alias("score"))
