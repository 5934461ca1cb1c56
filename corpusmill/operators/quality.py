"""Quality of texts and of batches of rows."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T


def _alike(sets: dict[tuple, int], least: float) -> int:
    """Pairs of rows of different sets that are more than `least` alike. Sets, sorted, with counts, meet by a prefix of their rarest words."""
    often = Counter(w for s in sets for w in s)
    met: dict[bytes, list[tuple[frozenset, int]]] = {}
    pairs = 0
    for s in sorted(filter(None, sets), key=len):
        own, n = frozenset(s), sets[s]
        seen = {}
        for w in sorted(s, key=lambda w: (often[w], w))[: len(s) - math.ceil(least * len(s) - 1e-9) + 1]:
            for other in met.setdefault(w, []):
                if len(other[0]) >= least * len(s) - 1e-9:
                    seen[other[0]] = other[1]
            met[w].append((own, n))
        for other, m in seen.items():
            both = len(own & other)
            if both / (len(own) + len(other) - both) > least:
                pairs += n * m
    return pairs


def redundancy(sentences: Column, least: float = 0.8) -> Column:
    """Share of the pairs of a text's sentences whose word sets are more than `least` alike; sentences come in lower case.

    Only sentences of one text meet, so nothing is shuffled. Sentences of equal sets are one with a count."""

    @F.pandas_udf("double")
    def share(texts: pd.Series) -> pd.Series:
        out = []
        for x in texts:
            # words of bytes are cut at ASCII white space
            sets = Counter(tuple(sorted(set(s.encode().split()))) for s in x)
            m = sets.total()
            same = sum(n * (n - 1) // 2 for s, n in sets.items() if s)
            out.append((same + _alike(sets, least)) / (m * (m - 1) / 2) if m > 1 else 0.0)
        return pd.Series(out, dtype="float64")

    return share(sentences)


def repeated(words: Column, n: Column) -> Column:
    """Words that stand more than three times and more often than a tenth of n, in order and joined; null if there are none.

    In order, such a word fills a run of as many places, so it stands at one of the places that far apart: there are ten at most to count."""

    def of(x: Column) -> Column:
        s, step = x["s"], x["step"]
        at = F.filter(F.array_distinct(F.transform(F.sequence(step, F.size(s), step), lambda i: F.get(s, i - 1))), lambda c: F.size(F.filter(s, lambda y: y == c)) >= step)
        return F.when((F.size(s) >= step) & (F.size(at) > 0), F.array_join(at, " "))

    step = F.greatest(F.lit(4), (F.floor(n / 10) + 1).cast("int"))
    return T.let(F.struct(F.array_sort(words).alias("s"), step.alias("step")), lambda x: F.when(F.size(x["s"]) >= x["step"], of(x)))


def scores(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, coherence, clarity, completeness, informativeness, redundancy, structure, overall, issues); 0 for empty texts. Keys must be distinct and not null."""
    t = F.col(text)
    s = F.split(t, "[.!?]+")
    long = F.transform(F.filter(s, lambda x: F.octet_length(x) > 10), F.lower)
    base = docs.where(F.col(key).isNotNull()).select(key, t.alias("t"), T.words(t).alias("w"), s.alias("s"), redundancy(long).alias("redundancy"))
    t = F.col("t")
    # what is no ASCII letter, digit or underscore goes from the whole text at once
    plain = F.filter(F.split(F.lower(F.regexp_replace(t, r"[^0-9A-Za-z_\x20\x09-\x0D]+", "")), T.SPACE), lambda w: F.length(w) >= 3)
    base = base.select("*", F.transform("s", T.count_words).alias("sizes"), plain.alias("plain"))
    base = base.select("*", F.filter("sizes", lambda n: n > 0).alias("full"))
    sizes, full = F.col("sizes"), F.col("full")
    spread = F.sqrt(T.variance_of(full)) / T.mean_of(full)
    # four syllables take seven letters
    hard = F.size(F.filter("w", lambda x: (F.octet_length(x) > 12) | ((F.octet_length(x) > 6) & F.lower(x).rlike(T.FOUR))))
    some = lambda p, v: F.when(p, v).otherwise(0.0)
    n = F.size("w")
    parts = base.select(
        key, "t", "s", "redundancy", n.alias("n"), repeated(F.filter("plain", lambda w: F.length(w) >= 4), n).alias("repeated"),
        F.when(F.size("s") < 2, 1.0).when(F.size(full) == 0, 0.0).otherwise(1 - F.least(spread / 2, F.lit(1.0))).alias("coherence"),
        F.when(n > 0, 1 - F.least(hard / n * 2, F.lit(1.0))).otherwise(0.0).alias("clarity"),
        (some(F.octet_length(t) > 100, 0.3) + some(F.octet_length(t) > 500, 0.2) + some(F.contains(t, F.lit(".")), 0.2) + some(t.rlike("[0-9]"), 0.1) + some(t.rlike("[A-Z][a-z]+"), 0.2)).alias("completeness"),
        F.when(n > 0, F.least(F.size(F.array_distinct("plain")) / n * 2, F.lit(1.0))).otherwise(0.0).alias("informativeness"),
        (some(t.rlike("^[A-Z]"), 0.2) + some(T.trimmed(t).rlike("[.!?]$"), 0.2) + some(F.contains(t, F.lit("\n\n")), 0.3) + 0.3 * F.size(F.filter(sizes, lambda x: x.between(5, 30))) / F.size("s")).alias("structure"),
    )
    names = ("coherence", "clarity", "completeness", "informativeness", "redundancy", "structure")
    overall = (F.col("coherence") + F.col("clarity") + F.col("completeness") + F.col("informativeness") + 1 - F.col("redundancy") + F.col("structure")) / 6
    issues = F.array_join(F.array(F.when(F.octet_length("t") < 50, "too short"), F.when((F.size("s") == 1) & (F.col("n") > 50), "single long sentence"), F.concat(F.lit("repeats "), F.col("repeated")), F.when(~F.col("t").rlike("[.!?]"), "no punctuation")), "; ")
    blank = F.col("t") == ""
    return parts.select(key, *[F.when(blank, 0.0).otherwise(F.col(c)).alias(c) for c in names], F.when(blank, 0.0).otherwise(overall).alias("overall"), F.when(blank, "").otherwise(issues).alias("issues"))


def structured(rows: DataFrame, batch: str, cells: list[str], order: str) -> DataFrame:
    """(batch, completeness, coherence, uniqueness) of batches of rows of text cells.

    completeness: cells that are not empty; coherence: 1 less a tenth for each cell whose kind (null, number, text) is not that of the batch's first
    row, 0 at the least; uniqueness: distinct rows a row."""
    kind = lambda c: F.when(F.col(c).isNull(), "null").when(F.col(c).try_cast("double").isNotNull(), "number").otherwise("text")
    first = rows.groupBy(batch).agg(F.min_by(F.array(*[kind(c) for c in cells]), order).alias("first"))
    j = rows.join(first, batch)
    filled = sum((F.coalesce(F.col(c) != "", F.lit(False)).cast("int") for c in cells), F.lit(0))
    odd = sum(((kind(c) != F.col("first")[i]).cast("int") for i, c in enumerate(cells)), F.lit(0))
    g = j.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), F.sum(filled).alias("filled"), F.sum(odd).alias("odd"), F.countDistinct(F.xxhash64(*cells)).alias("distinct"))
    return g.select(batch, (F.col("filled") / (F.col("n") * len(cells))).alias("completeness"), F.greatest(F.lit(0.0), 1 - 0.1 * F.col("odd")).alias("coherence"), F.when(F.col("n") > 1, F.col("distinct") / F.col("n")).otherwise(1.0).alias("uniqueness"))
