"""Lists, pages, joins, upserts and roll-ups of the relational interface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def page(df: DataFrame, where: Column, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of the rows that hold, with the total of the same predicate. size is at most 1000, pages count from 1."""
    if number < 1 or not 1 <= size <= 1000:
        raise ValueError("page counts from 1, its size is 1 to 1000")
    hits = df.where(where)
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    return hits.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))


def has_all(tags: Column, wanted: list[str]) -> Column:
    """Containment: every wanted element is in the array."""
    return F.size(F.array_except(F.array(*[F.lit(x) for x in wanted]), tags)) == 0


#: Words that full-text matching ignores.
STOP = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "with"]


def matches_text(text: Column, query: str) -> Column:
    """All words of the query that are no stop words occur in the text, as whole lower-cased words, not stemmed."""
    words = [w for w in query.lower().split() if w not in STOP]
    tokens = F.split(F.lower(text), "[^a-z0-9]+")
    out = F.lit(True)
    for w in words:
        out = out & F.array_contains(tokens, w)
    return out


def theta_policies(items: DataFrame, policies: DataFrame) -> DataFrame:
    """Items with each active policy whose type list (empty: any) and size range admit them. Policies are few and go in one broadcast by Spark's own size check."""
    on = policies["active"] & ((F.size(policies["types"]) == 0) | F.array_contains(policies["types"], items["kind"])) & (items["size"] >= policies["min_size"]) & (policies["max_size"].isNull() | (items["size"] <= policies["max_size"]))
    return items.join(policies, on)


def size_tier(size: Column) -> Column:
    return F.when(size < 10 * 1024 * 1024, "tier1").when(size < 1024**3, "tier2").otherwise("tier3")


def upsert(target: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of target replaced by changes of equal key; other changes are added."""
    return target.join(changes, key, "left_anti").unionByName(changes.select(target.columns))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ranked(df: DataFrame, keys: list[str], order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each group with their rank."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def rollup_once(parent: DataFrame, key: str, children: dict[str, tuple[DataFrame, list[Column]]]) -> DataFrame:
    """parent with sums of each child, each child grouped before its join so that no join multiplies rows."""
    out = parent
    for child, sums in children.values():
        out = out.join(child.groupBy(key).agg(*sums), key, "left")
    return out
