"""Language identification by Bayesian evidence fusion: text likelihoods, declared language, address suffix, host priors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import lean, texts_of, written

LANGS = ["de", "en", "es", "fr"]
#: Flat log-probability of a trigram under 'und', the class of texts in none of LANGS.
FLAT = math.log(1 / 4096)
SLOTS = 1 << 16
#: At most this many labelled documents of each language fit the text model; the bound of its sample.
SAMPLE_PER_LANG = 300
#: A text's log-likelihood counts as that of at most so many independent trigrams.
EFFECTIVE = 40.0
SLICE = 1 << 20

_KEEP = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def trigram_slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all letter trigrams of the texts, and where each text's begin: bytes other than letters count as one space."""
    kept = [b" " + b" ".join(t.translate(_KEEP).split()) + b" " for t in texts]
    sizes = np.array([len(k) for k in kept], np.int64)
    a = np.frombuffer(b"".join(kept), np.uint8).astype(np.uint32)
    h = (a[:-2] * np.uint32(0x9E3779B1) ^ a[1:-1] * np.uint32(0x85EBCA77) ^ a[2:] * np.uint32(0xC2B2AE3D)) if len(a) > 2 else np.zeros(0, np.uint32)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes, out=starts[1:])
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16), starts


def fit(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> np.ndarray:
    """Log-probabilities (SLOTS, langs): smoothed trigram counts of a bounded sample of whole labelled texts, at most
    `per_lang` a language, the first by a hash of their id. The sample's slots are counted on Spark; the table is of fixed size."""
    ids = labelled.where(F.col(lang).isin(LANGS) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(lang).alias("l"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    parts = [ids.where(F.col("l") == x).orderBy("h", "i").limit(per_lang).select("i") for x in LANGS]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    rows = labelled.select(F.col(id_col).alias("i"), F.col(lang).alias("l"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(chosen.distinct()), "i").select("l", "t")

    def count(batches):
        tally = np.zeros((len(LANGS), SLOTS), np.int64)
        for b in batches:
            for x, t in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                if x in LANGS:
                    tally[LANGS.index(x)] += np.bincount(trigram_slots([t])[0], minlength=SLOTS)
        i, s = np.nonzero(tally)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(s), pa.array(tally[i, s])], ["i", "s", "n"])

    counts = rows.mapInArrow(lean(count), "i long, s long, n long").groupBy("i", "s").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((SLOTS, len(LANGS)), 0.05)
    table[counts["s"].to_numpy(), counts["i"].to_numpy()] += counts["n"].to_numpy()
    return np.log(table / table.sum(0)).astype(np.float32)


def flat_posterior(logs: list[float]) -> list[float]:
    e = [math.exp(v - max(logs)) for v in logs]
    return [v / sum(e) for v in e]


def scored(rows: DataFrame, text: str, table: np.ndarray) -> DataFrame:
    """rows, the text column dropped, with n_grams, loglik: tempered log-likelihoods of LANGS and then of 'und', and q: their posterior under a flat prior."""
    model = rows.sparkSession.sparkContext.broadcast(table)
    at = rows.columns.index(text)
    kept = [c for c in rows.columns if c != text]
    others = [i for i, c in enumerate(rows.columns) if c != text]

    def score(batches):
        for b in batches:
            texts, lls, ns = texts_of(b.column(at)), [], []
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) < SLICE):
                    size += len(texts[hi])
                    hi += 1
                slots, starts = trigram_slots(texts[lo:hi])
                for k in range(hi - lo):
                    own = slots[starts[k] : max(starts[k + 1] - 2, starts[k])]
                    n = len(own) if len(own) > 1 else 0
                    ll = [0.0] * (len(LANGS) + 1)
                    if n:
                        ll = [*model.value[own].sum(0, dtype=np.float64), n * FLAT]
                    f = min(1.0, EFFECTIVE / n) if n else 0.0
                    lls.append([float(v) * f for v in ll])
                    ns.append(n)
                lo = hi
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in others), pa.array(ns, pa.int64()), pa.array(lls, pa.list_(pa.float64())), pa.array([flat_posterior(x) for x in lls], pa.list_(pa.float64()))], [*kept, "n_grams", "loglik", "_q"])

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != text)
    return rows.mapInArrow(lean(score), f"{fields}, n_grams long, loglik array<double>, _q array<double>")


CLASSES = [*LANGS, "und"]


def code(c: Column) -> Column:
    """The primary subtag if it is one of LANGS, 'other' if it is another, null if there is none."""
    p = F.lower(F.regexp_extract(c, r"^\s*([A-Za-z]{2,3})\b", 1))
    return F.when(p.isin(LANGS), p).when(p != "", "other")


def fused(rows: DataFrame, table: np.ndarray, text: str, declared: str, suffix: str, host: str, domain: str, strength: float = 4.0, trust: float = 0.9) -> DataFrame:
    """rows without text, with text_lang, lang and posterior. lang is 'und' where the text has no trigram of letters.

    Posterior in logs: host prior + tempered text likelihood + declared code + address suffix. P(code | language) and the priors are grouped sums of
    text-only posteriors over all rows; a host's prior is smoothed towards its domain's and that towards the whole corpus's,
    `strength` pseudo-counts each, so hosts seen once lean on their domain. Nulls in declared, suffix, host or domain count as no evidence. `trust` sets
    the pseudo-counts of the code tables: that share on the diagonal. The code tables have at most 6 x 5 cells and are collected; hosts stay a DataFrame."""
    s = written(scored(rows, text, table))
    k = range(len(CLASSES))
    sums = [F.sum(F.when(F.col("n_grams") > 0, F.col("_q")[i]).otherwise(0.0)).alias(f"n{i}") for i in k]

    def evidence(column: str) -> list[Column]:
        seen = {r[0]: [r[f"n{i}"] or 0.0 for i in k] for r in s.where(F.col(column).isNotNull()).groupBy(column).agg(*sums).collect()}
        codes = [*LANGS, "other"]
        base = {c: [10.0 * (trust if c == x else (1 - trust) / (len(codes) - 1)) if x != "und" else 10.0 / len(codes) for x in CLASSES] for c in codes}
        full = {c: [base[c][i] + seen.get(c, [0.0] * len(CLASSES))[i] for i in k] for c in codes}
        total = [sum(full[c][i] for c in codes) for i in k]
        rows_ = F.create_map(*[x for c in codes for x in (F.lit(c), F.array(*[F.lit(math.log(full[c][i] / total[i])) for i in k]))])
        found = F.try_element_at(rows_, F.coalesce(F.col(column), F.lit("none")))
        return [F.coalesce(found[i], F.lit(0.0)) for i in k]

    whole = s.agg(*sums).first()
    mass = sum(whole[f"n{i}"] or 0.0 for i in k)
    root = [((whole[f"n{i}"] or 0.0) + 1.0) / (mass + len(CLASSES)) for i in k]
    d = s.where(F.col(domain).isNotNull()).groupBy(F.col(domain).alias("_d")).agg(*sums)
    dn = sum((F.col(f"n{i}") for i in k), F.lit(0.0))
    d = d.select("_d", F.array(*[(F.col(f"n{i}") + strength * root[i]) / (dn + strength) for i in k]).alias("_dp"))
    h = s.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("_h"), F.col(domain).alias("_d")).agg(*sums)
    h = h.join(d, "_d", "left").withColumn("_dp", F.coalesce("_dp", F.array(*[F.lit(x) for x in root])))
    h = h.select("_h", F.col("_d").alias("_d2"), F.array(*[F.log((F.col(f"n{i}") + strength * F.col("_dp")[i]) / (dn + strength)) for i in k]).alias("_prior"))
    j = s.join(h, (s[host] == h["_h"]) & s[domain].eqNullSafe(h["_d2"]), "left")
    codes, suffixes = evidence(declared), evidence(suffix)
    kept = [c for c in rows.columns if c != text]
    j = j.select(*[s[c] for c in kept], "n_grams", "_q", *[(F.coalesce(F.col("_prior")[i], F.lit(math.log(root[i]))) + F.col("loglik")[i] + codes[i] + suffixes[i]).alias(f"_l{i}") for i in k])
    top, most = F.greatest(*[F.col(f"_l{i}") for i in k]), F.array_max("_q")
    j = j.withColumns({"_top": top, "_most": most})

    def first(equal) -> Column:
        out = F.when(F.col("n_grams") <= 0, "und")
        for i, c in enumerate(CLASSES):
            out = out.when(equal(i), c)
        return out

    share = F.lit(1.0) / sum((F.exp(F.col(f"_l{i}") - F.col("_top")) for i in k), F.lit(0.0))
    return j.select(*[F.col(c) for c in kept], "n_grams", first(lambda i: F.col("_q")[i] == F.col("_most")).alias("text_lang"), first(lambda i: F.col(f"_l{i}") == F.col("_top")).alias("lang_found"), share.alias("posterior"))


def domain_of(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)


#: Below this posterior a document is rejected as of no sure language.
SURE = 0.5


def rejected() -> Column:
    return (F.col("lang_found") == "und") | (F.col("posterior") < SURE)


def row_key() -> Column:
    """64 bits of what a document's verdict depends on."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "lang", "source")])


def documents_with_language(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(row_key, declared, host, lang_found, posterior, ...) of documents: `lang` is the declaration, `source` the host."""
    rows = docs.select(row_key().alias("row_key"), code(F.col("lang").cast("string")).alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").cast("string").alias("host"), F.lit("").alias("domain"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    return fused(rows, table, "_text", "declared", "suffix", "host", "domain")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every page: its tags are stripped, `<html lang>` is the declaration, a /xx/ path part the address suffix."""
    table = fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    html, url = F.coalesce(F.col("html"), F.lit("")), F.col("url")
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/:?#]*)", 1))
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        "page_id",
        host.alias("host"),
        F.coalesce(domain_of(host), F.lit("")).alias("domain"),
        code(F.regexp_extract(html, r"(?is)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1)).alias("declared"),
        code(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*/([A-Za-z]{2})(?:/|$)", 1)).alias("suffix"),
        plain.alias("_text"),
    )
    out = fused(rows, table, "_text", "declared", "suffix", "host", "domain")
    return out.select("page_id", "host", "declared", "suffix", "n_grams", "text_lang", F.col("lang_found").alias("lang"), F.round("posterior", 6).alias("posterior"), rejected().alias("rejected"))
