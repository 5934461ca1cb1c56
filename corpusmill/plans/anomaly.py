"""Content and security queries over `documents`."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import lexicons as L
from corpusmill.functions import text as T
from corpusmill.operators import anomaly as A
from corpusmill.plans.registry import query
from corpusmill.plans.text import CLEAN, TEXT, TRIM, WORDS, docs, total
from corpusmill.session import table


@query("""select doc_id, round(case when length(text) > 0 then len(regexp_extract_all(text, '[^ -~]')) / length(text) else 0 end, 6) as special, round(case when length(text) > 0 then len(regexp_extract_all(text, '[0-9]')) / length(text) else 0 end, 6) as digits,
case when length(text) > 0 and len(regexp_extract_all(text, '[^ -~]')) / length(text) > 0.1 then 'special' when length(text) > 100 and len(regexp_extract_all(text, '[0-9]')) / length(text) > 0.7 then 'digits' end as finding from documents""")
def char_profile(spark, d):
    c = A.char_profile(F.col("text"))
    odd = F.when(c["special"] > 0.1, "special").when((c["digits"] > 0.7) & (F.length("text") > 100), "digits")
    return table(spark, d, "documents").select("doc_id", *[F.round(v, 6).alias(k) for k, v in c.items()], odd.alias("finding"))


@query("""select doc_id, round((length(text) - length(regexp_replace(text, '[A-Za-z0-9+/]{20,}', '', 'g'))) / length(text), 6) as base64, round((length(text) - length(regexp_replace(text, '[0-9a-f]{16,}', '', 'g'))) / length(text), 6) as hex from documents where length(text) > 0""")
def base64_hex_density(spark, d):
    t = table(spark, d, "documents").where("length(text) > 0")
    return t.select("doc_id", F.round(A.density(F.col("text"), "[A-Za-z0-9+/]{20,}"), 6).alias("base64"), F.round(A.density(F.col("text"), "[0-9a-f]{16,}"), 6).alias("hex"))


_SIG = ", ".join(f"case when regexp_matches(coalesce(html, ''), '{p}') then '{k}' end" for k, p in sorted(A.SIGNATURES.items()))


@query(f"select page_id, array_to_string(list_filter([{_SIG}], lambda x: x is not null), ',') as signatures from pages")
def signature_scan(spark, d):
    return table(spark, d, "pages").select("page_id", A.signatures(F.coalesce("html", F.lit(""))).alias("signatures"))


@query("""select doc_id, case when length(trim(text)) = 0 then 'blank' when strlen(text) < 10 then 'short' when strlen(text) > 10000000 then 'long' end as finding from documents where length(trim(text)) = 0 or strlen(text) < 10 or strlen(text) > 10000000""")
def content_length_anomaly(spark, d):
    """Blank texts, those below 10 bytes and those above 10 million."""
    n = F.octet_length("text")
    kind = F.when(F.length(F.trim("text")) == 0, "blank").when(n < 10, "short").when(n > 10_000_000, "long")
    return table(spark, d, "documents").select("doc_id", kind.alias("finding")).where("finding is not null")


_T = "coalesce(html, '')"
_OBF = " + ".join(f"case when regexp_matches({_T}, '{p}') then 0.2 else 0 end" for p in A.OBFUSCATION)
_B64, _HEX = "[A-Za-z0-9+/]{20,}={0,2}", "[0-9a-fA-F]{32,}"
_DENSE = lambda p: f"coalesce((length({_T}) - length(regexp_replace({_T}, '{p}', '', 'g'))) / nullif(length({_T}), 0), 0)"
_SECURITY = f"""s as (select page_id, {_DENSE(_B64)} as b64, {_DENSE(_HEX)} as hex, round({_OBF}, 6) as odd, {_T} as t, lower(coalesce(url, '')) as n from pages),
f as (select page_id, 'base64' as finding, case when b64 > 0.8 then 'high' when b64 > 0.6 then 'medium' else 'low' end as severity, b64::double as score from s where b64 > 0.3 union all select page_id, 'hex', 'low', hex from s where hex > 0.4
union all select page_id, 'obfuscation', case when odd > 0.8 then 'high' else 'medium' end, odd from s where odd > 0.4 {' '.join(f"union all select page_id, 'signature:{k}', '{'medium' if k == 'powershell' else 'high'}', 0.9 from s where regexp_matches(t, '{p}')" for k, p in A.SIGNATURES.items())}
union all select page_id, 'file_type', 'high', 0.9 from s where regexp_matches(n, '({'|'.join(x.replace('.', chr(92) + '.') for x in A.SUSPICIOUS)})$')
union all select page_id, 'hash:known', 'critical', 0.95 from s where page_id % 50 = 0)"""


@query(f"with {_SECURITY} select page_id, finding, severity, round(score, 6) as score from f")
def security_findings(spark, d):
    """All pages; every fiftieth page's content stands for a listed hash."""
    p = table(spark, d, "pages")
    listed = p.where("page_id % 50 = 0").select("page_id", F.md5(F.coalesce("html", F.lit(""))).alias("md5"))
    once = listed.groupBy("md5").agg(F.min("page_id").alias("id"))
    f = A.security_findings(p, "page_id", "url", "html", hashes=once.select("md5", F.lit("known").alias("threat"), F.lit("critical").alias("severity")))
    return f.withColumn("score", F.round("score", 6))


@query("""with b as (select source, avg(n_chars) as m, stddev_samp(n_chars) as s, count(n_chars) as n from documents group by 1) select doc_id, round((n_chars - m) / s, 6) as z from documents d join b on d.source = b.source where b.n >= 30 and s > 0 and abs((n_chars - m) / s) > 2.5""")
def length_deviation(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return A.deviations(docs, ["source"], "n_chars").select("doc_id", F.round("z", 6).alias("z"))


@query(f"""with t as (select doc_id, source, {CLEAN(WORDS(f'lower({TEXT})'), 2)} as t from documents), n as (select doc_id, source, round(coalesce(({total('t', L.POSITIVE)} - {total('t', L.NEGATIVE)}) / nullif(len(t), 0), 0), 9) as net from t),
b as (select source, avg(net) as m, stddev_samp(net) as s, count(*) as n from n group by 1) select doc_id, round((net - m) / s, 4) as z from n join b using (source) where n >= 30 and s > 0 and abs((net - m) / s) > 2.5""")
def sentiment_deviation(spark, d):
    n = docs(spark, d).select("doc_id", "source", F.round(T.sentiment_ratio(F.col("text"))["net"], 9).alias("net")).where("source is not null")
    return A.deviations(n, ["source"], "net").select("doc_id", F.round("z", 4).alias("z"))


@query(f"""with c as (select doc_id, source, {TEXT} as text from documents), q as (select doc_id, source, round((case when regexp_matches({TRIM('text')}, '[.!?:]$') then 1.0 else 0.7 end + case when len({WORDS('text')}) > 0 then len(list_distinct(list_transform({WORDS('text')}, lambda x: lower(x)))) / nullif(len({WORDS('text')}), 0) else 0.7 end) / 2, 9) as q from c),
b as (select source, avg(q) as m, stddev_samp(q) as s, count(*) as n from q group by 1) select doc_id, round((q - m) / s, 4) as z from q join b using (source) where n >= 30 and s > 0 and abs((q - m) / s) > 2.5""")
def quality_deviation(spark, d):
    """Texts whose mean of completeness and uniqueness is far from their source's."""
    q = T.quality_semantic(F.col("text"))
    n = docs(spark, d).select("doc_id", "source", F.round((q["completeness"] + q["uniqueness"]) / 2, 9).alias("q")).where("source is not null")
    return A.deviations(n, ["source"], "q").select("doc_id", F.round("z", 4).alias("z"))


@query("""with b as (select event_type, avg(value) as m, stddev_samp(value) as s from events group by 1 having count(value) >= 30), z as (select 'z' as detector, 'e' || event_id as subject, abs(value - m) / s / 5 as score from events join b using (event_type) where abs(value - m) / s > 2.5),
l as (select 'length', 'd' || doc_id, 1.0 from documents where strlen(text) < 10) select detector, subject, round(score, 6) as score from (select * from z union all select * from l) where detector <> 'z' or score >= 0.7""")
def detector_fan_out(spark, d):
    """Two detectors' findings in one table, each above its threshold."""
    from corpusmill.operators.stats import z_outliers

    z = z_outliers(table(spark, d, "events"), ["event_type"], "value").select(F.lit("z").alias("detector"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("subject"), "score")
    short = table(spark, d, "documents").where(F.octet_length("text") < 10).select(F.lit("length").alias("detector"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("subject"), F.lit(1.0).alias("score"))
    return A.fan_out([z, short], spark.createDataFrame([("z", 0.7)], "detector string, least double")).withColumn("score", F.round("score", 6))


@query("select p_partkey, round(p_size * 10485760 / 1048576, 6) as size_mb, round(least(p_size * 10 / 1000, 1), 6) as score from part where p_size * 10 > 100")
def large_file_access(spark, d):
    f = table(spark, d, "part").withColumn("bytes", F.col("p_size").cast("long") * 10485760)
    return A.large_files(f, "p_partkey", "bytes").withColumns({c: F.round(c, 6) for c in ("size_mb", "score")})


@query("""with n as (select source, lang, count(*) as n from documents group by 1, 2), s as (select source, sum(n) as t from n group by 1), g as (select lang, sum(n) / (select count(*) from documents) as share from n group by 1)
select n.source, n.lang, round(n.n / s.t, 6) as share, round(abs(n.n / s.t - g.share), 6) as deviation from n join s using (source) join g using (lang) where abs(n.n / s.t - g.share) > 0.1""")
def language_deviation(spark, d):
    n = table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    s = n.groupBy("source").agg(F.sum("n").alias("t"))
    whole = F.broadcast(n.agg(F.sum("n").alias("all")))  # one row
    g = n.groupBy("lang").agg(F.sum("n").alias("l")).crossJoin(whole).select("lang", (F.col("l") / F.col("all")).alias("usual"))
    share = F.col("n") / F.col("t")
    off = F.abs(share - F.col("usual"))
    return n.join(s, "source").join(g, "lang").where(off > 0.1).select("source", "lang", F.round(share, 6).alias("share"), F.round(off, 6).alias("deviation"))
