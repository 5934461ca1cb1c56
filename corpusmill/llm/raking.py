"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import ASCII_SPACE, written
from corpusmill.llm.language_id import LANGS, code

DIMS = ["source", "lang", "topic"]
ROUNDS, FILLS = 12, 6
#: But for the query that has SQL, fitting goes on after ROUNDS until no share is further than this from its target. Targets that the cells cannot meet end it after MOST_ROUNDS, with a warning.
TOLERANCE, MOST_ROUNDS = 1e-4, 200


def topic_of(text: Column) -> Column:
    """A coarse topic by surface marks: legal, table, code, noise or prose."""
    has = lambda s: F.contains(text, F.lit(s))
    return F.when(has("icense"), "legal").when(has(" | "), "table").when(has("{") | has("();"), "code").when(has("###") | has("$$$"), "noise").otherwise("prose")


def tokens_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{ASCII_SPACE}]+")).cast("long")


def rake(features: DataFrame, goals: DataFrame | None = None, langs: dict[str, float] | None = None, topics: dict[str, float] | None = None, rounds: int = ROUNDS, tolerance: float | None = None) -> DataFrame:
    """(source, lang, topic, tokens, w): token sums of the cells with a target, and their weights after fitting the marginals in turn, `rounds` times
    and then until they are within `tolerance`, if there is one.

    A source is one row with a column for each pair of language and topic targets, as many as the targets name. Sources stay a
    DataFrame of any length: their factor is arithmetic within the row. A round is one grouped sum of those columns over all
    sources; only the sums of the pairs reach the driver, which holds the language and topic factors. goals: (source, share), equal
    shares by default; shares are scaled to the categories that have tokens. Categories without a target have no cell."""
    langs, topics = langs or LANG_SHARES, topics or TOPIC_SHARES
    pairs = [(x, y) for x in langs for y in topics]
    v = [f"v{i}" for i in range(len(pairs))]
    table = features.groupBy("source").agg(*[F.coalesce(F.sum(F.when((F.col("lang") == x) & (F.col("topic") == y), F.col("n_tokens"))), F.lit(0)).cast("double").alias(c) for c, (x, y) in zip(v, pairs, strict=True)])
    table = table.where(reduce(lambda a, b: a + b, map(F.col, v)) > 0)
    table = table.join(goals.select("source", F.col("share").cast("double")), "source") if goals is not None else table.withColumn("share", F.lit(1.0))
    table = written(table)
    first = table.agg(F.sum("share").alias("share"), *[F.sum(c).alias(c) for c in v]).first()
    mass = {p: first[c] or 0.0 for c, p in zip(v, pairs, strict=True)}

    def goal(shares: dict[str, float], at: int) -> dict[str, float]:
        there = {k: s for k, s in shares.items() if sum(m for p, m in mass.items() if p[at] == k) > 0}
        return {k: there.get(k, 0.0) / (sum(there.values()) or 1.0) for k in shares}

    lang_goal, topic_goal = goal(langs, 0), goal(topics, 1)
    b, c = dict.fromkeys(langs, 1.0), dict.fromkeys(topics, 1.0)

    def with_factor() -> DataFrame:
        """table with a, each source's factor. The pairs' factors come as one row, so that each round runs the same compiled code."""
        one = table.sparkSession.createDataFrame([([b[x] * c[y] for x, y in pairs], before, float(first["share"] or 1.0))], "f array<double>, g array<double>, shares double")
        own, had = (reduce(lambda x, y: x + y, [F.col(k) * F.col(f)[i] for i, k in enumerate(v)]) for f in "fg")
        goal = F.col("share") / F.col("shares")
        out = table.crossJoin(F.broadcast(one)).withColumns({"own": own, "had": had})
        # how far the last round left the source's share from its target
        out = out.withColumn("off", F.when(F.col("had") > 0, F.abs(F.col("own") / F.col("had") - 1) * goal).otherwise(0.0))
        return out.withColumn("a", F.when(F.col("own") > 0, goal / F.col("own")).otherwise(0.0)).drop("own", "had", "shares", "f", "g")

    raked, before, n, off = table.withColumn("a", F.lit(0.0)), [1.0] * len(pairs), 0, 0.0
    while first["share"] and rounds and (tolerance is not None or n < rounds):
        new = with_factor()
        r = new.agg(F.max("off").alias("off"), *[F.sum(F.col("a") * F.col(k)).alias(k) for k in v]).first()
        off = max(off, r["off"])
        if n >= rounds and off <= tolerance:
            break
        if n >= max(rounds, MOST_ROUNDS):
            warnings.warn(f"a share is {off:.2g} from its target after {n} rounds", stacklevel=2)
            break
        raked, before = new, [b[x] * c[y] for x, y in pairs]
        m = {p: r[k] for k, p in zip(v, pairs, strict=True)}
        for x in langs:
            now = sum(m[x, y] * c[y] for y in topics)
            b[x] = lang_goal[x] / now if now else 0.0
        for y in topics:
            now = sum(m[x, y] * b[x] for x in langs)
            c[y] = topic_goal[y] / now if now else 0.0
        off = max(abs(sum(m[x, y] * b[x] * c[y] for y in topics) - lang_goal[x]) for x in langs)
        n += 1
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("lang"), F.lit(y).alias("topic"), F.col(k).cast("long").alias("tokens"), (F.col(k) * F.col("a") * (b[x] * c[y])).alias("w")) for k, (x, y) in zip(v, pairs, strict=True)])).alias("r")
    return raked.select("source", rows).select("source", "r.*").where("tokens > 0")


def probabilities(cells: DataFrame, all_tokens: int, fraction: float, fills: int = FILLS) -> DataFrame:
    """cells with ratio (fitted share over present share) and p: min(1, c * ratio), c set so that the expected tokens kept are
    `fraction` of all; cells that reach 1 are set aside and c is set anew, `fills` times."""
    total = cells.agg(F.sum("w").alias("w")).first()["w"] or 1.0
    cells = written(cells.withColumn("ratio", F.col("w") * float(all_tokens) / (F.col("tokens") * total)))
    c = float(fraction)
    for _ in range(fills):
        full = F.col("c") * F.col("ratio") >= 1
        s = cells.crossJoin(F.broadcast(cells.sparkSession.createDataFrame([(c,)], "c double"))).agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("over"), F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("ratio"))).alias("under")).first()
        if s["under"]:
            c = max(c, (fraction * all_tokens - s["over"]) / s["under"])
    return cells.withColumn("p", F.least(F.lit(1.0), F.lit(c) * F.col("ratio")))


def draw(id_col: Column) -> Column:
    """A number in [0, 1) fixed by the id: the first 52 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") / float(16**13)


#: Target shares of the query: languages and topics; sources get equal shares.
LANG_SHARES = {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}
TOPIC_SHARES = {"prose": 0.7, "table": 0.1, "code": 0.05, "noise": 0.05, "legal": 0.1}
FRACTION = 0.5


def language_of(lang: Column) -> Column:
    """The code of a listed language, so en for EN and en-GB; others as they are, without a target share."""
    return F.when(code(lang).isin(LANGS), code(lang)).otherwise(F.coalesce(lang, F.lit("")))


def categories(docs: DataFrame) -> list[Column]:
    return [F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), language_of(F.col("lang").cast("string")).alias("lang"), topic_of(F.coalesce(F.col("text"), F.lit(""))).alias("topic")]


def mix(docs: DataFrame, fraction: float = FRACTION, tolerance: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(features, cells): features (doc_id, source, lang, topic, n_tokens) of all docs, written once, and the raked cells with p.

    Null categories count as '' and null texts as empty. A category without a target share is sampled with p = 0.
    Empty docs give an empty result."""
    features = written(docs.select("doc_id", *categories(docs), tokens_of(F.coalesce(F.col("text"), F.lit(""))).alias("n_tokens")))
    all_tokens = features.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    return features, probabilities(rake(features, tolerance=tolerance), all_tokens, fraction)


def sampled(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """The rows of docs drawn by the calibrated probabilities, all columns as they are."""
    _, cells = mix(docs, fraction, TOLERANCE)
    s, l, t = categories(docs)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), s, l, t, draw(F.col("doc_id")).alias("drawn"))
    return keyed.join(cells.select(*DIMS, "p"), DIMS).where("drawn < p").select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op9_raking(spark, sf_dir: str, tolerance: float | None = None) -> DataFrame:
    """Every document with its cell's fitted ratio and probability and whether it is drawn."""
    features, cells = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), tolerance=tolerance)
    out = features.join(cells.select(*DIMS, "ratio", "p"), DIMS, "left").withColumns({"ratio": F.coalesce("ratio", F.lit(0.0)), "p": F.coalesce("p", F.lit(0.0))})
    return out.select("doc_id", *DIMS, "n_tokens", F.round("ratio", 6).alias("ratio"), F.round("p", 6).alias("probability"), (draw(F.col("doc_id")) < F.col("p")).alias("kept"))


def op9_raking_converged(spark, sf_dir: str) -> DataFrame:
    """As op9_raking, raked until the targets are met."""
    return op9_raking(spark, sf_dir, TOLERANCE)


def sql_steps(docs: str, columns: str, prefix: str = "", rounds: int = ROUNDS, fills: int = FILLS, fraction: float = FRACTION) -> list[str]:
    """DuckDB CTEs from a relation `docs` to `{prefix}p` (the dims, ratio, p) and `{prefix}f` (columns and the dims)."""
    topic = "case when contains(coalesce(text, ''), 'icense') then 'legal' when contains(coalesce(text, ''), ' | ') then 'table' when contains(coalesce(text, ''), '{') or contains(coalesce(text, ''), '();') then 'code' when contains(coalesce(text, ''), '###') or contains(coalesce(text, ''), '$$$') then 'noise' else 'prose' end"
    x = prefix
    out = [
        f"{x}f as materialized (select {columns}, coalesce(source, '') as c_source, coalesce(lang, '') as c_lang, {topic} as c_topic, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens from {docs})",
        f"{x}w0 as materialized (select c_source, c_lang, c_topic, sum(n_tokens)::bigint as tokens, sum(n_tokens)::double as w from {x}f group by all)",
    ]
    values = lambda s: ", ".join(f"('{k}', {v})" for k, v in s.items())
    out += [
        f"{x}g_source as materialized (select c_source, 1.0::double / count(*) over () as goal from {x}w0 group by 1 having sum(w) > 0)",
        *[f"{x}g_{d} as materialized (select m.c_{d}, s.share::double / sum(s.share::double) over () as goal from (select c_{d} from {x}w0 group by 1 having sum(w) > 0) m join (values {values(v)}) s(k, share) on m.c_{d} = s.k)" for d, v in (("lang", LANG_SHARES), ("topic", TOPIC_SHARES))],
    ]
    n = 0
    for _ in range(rounds):
        for d in DIMS:
            out.append(f"{x}w{n + 1} as materialized (select a.c_source, a.c_lang, a.c_topic, a.tokens, a.w * coalesce(case when m.m > 0 then g.goal / m.m end, 0.0) as w from {x}w{n} a join (select c_{d}, sum(w) as m from {x}w{n} group by 1) m on a.c_{d} = m.c_{d} left join {x}g_{d} g on a.c_{d} = g.c_{d})")
            n += 1
    out.append(f"{x}c0 as materialized (select *, coalesce(w * sum(tokens) over () / nullif(tokens * sum(w) over (), 0), 0.0) as ratio, (sum(tokens) over ())::double as all_tokens, {fraction}::double as c from {x}w{n})")
    for i in range(fills):
        out.append(f"{x}c{i + 1} as materialized (select a.* replace (case when s.under > 0 then greatest(a.c, coalesce(({fraction} * a.all_tokens - s.over) / nullif(s.under, 0), a.c)) else a.c end as c) from {x}c{i} a, (select sum(case when c * ratio >= 1 then tokens else 0 end) as over, sum(case when c * ratio >= 1 then 0 else tokens * ratio end) as under from {x}c{i}) s)")
    return [*out, f"{x}p as materialized (select c_source, c_lang, c_topic, ratio, least(1.0, c * ratio) as p from {x}c{fills})"]


SQL_DRAW = "(('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint::double / 4503599627370496.0)"


def op9_sql() -> str:
    return f"with {', '.join(sql_steps('documents', 'doc_id'))} select doc_id, c_source as source, c_lang as lang, c_topic as topic, n_tokens, round(ratio, 6) as ratio, round(p, 6) as probability, {SQL_DRAW} < p as kept from f join p using (c_source, c_lang, c_topic)"
