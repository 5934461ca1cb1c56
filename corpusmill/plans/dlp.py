"""Queries of personal data over `documents`, every type of dlp.TYPES."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.operators import dlp as D
from corpusmill.plans.classify import LUHN
from corpusmill.plans.registry import query
from corpusmill.plans.text import TEXT, docs
from corpusmill.session import table

_D = "regexp_replace(v, '[- ]', '', 'g')"
_VALID = {
    "email": "true",
    "phone": "true",
    "ip_address": "list_max(list_transform(string_split(v, '.'), lambda x: x::int)) <= 255",
    "ssn": f"{_D}[1:3] not in ('000', '666') and {_D}[1:3] < '900' and {_D}[4:5] <> '00' and {_D}[6:9] <> '0000'",
    "credit_card": LUHN(_D),
}
_SURE = {"email": "0.9", "ip_address": "0.8", "ssn": "case when regexp_matches(v, '[- ]') then 0.9 else 0.7 end", "credit_card": "case when regexp_matches(v, '[- ]') then 0.9 else 0.8 end", "phone": "case when contains(v, '(') and contains(v, ')') then 0.9 when regexp_matches(v, '[-.]') then 0.8 else 0.7 end"}
_LEN = lambda x: f"coalesce(list_sum(list_transform({x}, lambda z: length(z))), 0)"
_PLACED = lambda source, key: " union all ".join(
    f"select {key}, '{k}' as kind, v as value, ({_SURE[k]})::double as confidence, {base}::double as base, start::int as start, (start + length(v))::int as past from (select {key}, m[i] as v, {_LEN('s[1:i]')} + {_LEN('m[1:i - 1]')} as start from (select {key}, m, s, unnest(range(1, len(m) + 1)) as i from (select {key}, regexp_extract_all(text, '{p}') as m, regexp_split_to_array(text, '{p}') as s from {source}))) where {_VALID[k]}"
    for k, (p, base) in D.TYPES.items()
)
_RISK = "case when round((base + confidence) / 2, 6) >= 0.8 then 'critical' when round((base + confidence) / 2, 6) >= 0.6 then 'high' when round((base + confidence) / 2, 6) >= 0.4 then 'medium' else 'low' end"
#: CTEs x (doc_id, text) and f (doc_id, kind, value, confidence, base, start, past, risk).
FOUND = f"x as (select doc_id, {TEXT} as text from documents), f as materialized (select *, {_RISK} as risk from ({_PLACED('x', 'doc_id')}))"


@query(f"with {FOUND} select f.doc_id, kind, value, confidence, start, past, substring(text, greatest(0, start - 20) + 1, past + 20 - greatest(0, start - 20)) as context, risk from f join x on f.doc_id = x.doc_id")
def dlp_findings(spark, d):
    return D.scan(docs(spark, d)).withColumn("risk", D.risk(F.col("kind"), F.col("confidence")))


@query(f"""with {FOUND} select d.doc_id, count(kind) as n_findings, count(*) filter (risk in ('critical', 'high')) as n_high,
round(coalesce(avg(case risk when 'critical' then 1.0 when 'high' then 0.8 when 'medium' then 0.5 when 'low' then 0.2 end), 0), 6) as risk_score from documents d left join f on d.doc_id = f.doc_id group by 1""")
def dlp_risk_score(spark, d):
    return D.scores(docs(spark, d)).withColumn("risk_score", F.round("risk_score", 6))


@query(f"with {FOUND} select doc_id, value, confidence from f where kind = 'ssn'")
def dlp_ssn_valid(spark, d):
    return D.scan(docs(spark, d), kinds=["ssn"]).select("doc_id", "value", "confidence")


_NUMBER = "'no ' || lpad((o_custkey * 7 % 1000)::varchar, 3, '0') || sep || lpad((o_orderkey % 100)::varchar, 2, '0') || sep || lpad((o_orderkey * 13 % 10000)::varchar, 4, '0') || '.'"


@query(f"""with n as (select o_orderkey, case o_orderkey % 3 when 0 then '-' when 1 then ' ' else '' end as sep, o_custkey from orders), x as (select o_orderkey as doc_id, {_NUMBER} as text from n)
select doc_id, v as value, ({_SURE['ssn']})::double as confidence from (select doc_id, unnest(regexp_extract_all(text, '{D.TYPES['ssn'][0]}')) as v from x) where {_VALID['ssn']}""")
def dlp_ssn_numbers(spark, d):
    """Numbers of orders written as social security numbers, in three ways, those of invalid areas, groups and serials among them."""
    sep = F.when(F.col("o_orderkey") % 3 == 0, "-").when(F.col("o_orderkey") % 3 == 1, " ").otherwise("")
    part = lambda c, n: F.lpad((c % 10**n).cast("string"), n, "0")
    text = F.concat(F.lit("no "), part(F.col("o_custkey") * 7, 3), sep, part(F.col("o_orderkey"), 2), sep, part(F.col("o_orderkey") * 13, 4), F.lit("."))
    return D.scan(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text")), kinds=["ssn"]).select("doc_id", "value", "confidence")


@query(f"with {FOUND} select doc_id, value from f where kind = 'credit_card'")
def dlp_card_luhn(spark, d):
    return D.scan(docs(spark, d), kinds=["credit_card"]).select("doc_id", "value")


@query(f"with {FOUND} select kind, risk, count(*) as n, count(distinct doc_id) as documents from f group by 1, 2")
def dlp_batch_stats(spark, d):
    f = D.scan(docs(spark, d))
    return f.groupBy("kind", D.risk(F.col("kind"), F.col("confidence")).alias("risk")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"))


_RULES = "rules(regulation, rule, severity, kind) as (values " + ", ".join(f"('{a}', '{b}', '{s}', '{k}')" for a, b, ks, s, _ in D.RULES for k in ks) + ")"
_BROKEN = f"{FOUND}, {_RULES}, b as (select doc_id, regulation, rule, severity, count(*) as n from f join rules using (kind) where rule <> 'GDPR-001' or risk <> 'low' group by 1, 2, 3, 4)"


@query(f"with {_BROKEN} select *, case rule {' '.join(f'''when '{r[1]}' then '{'; '.join(r[4])}' ''' for r in D.RULES)} end as actions from b")
def dlp_compliance(spark, d):
    return D.compliance(spark, D.scan(docs(spark, d))).withColumn("actions", D.actions(F.col("rule")))


@query(f"with {_BROKEN} select doc_id, rule, n from b where regulation = 'PCI-DSS'")
def dlp_compliance_by_regulation(spark, d):
    """Rules of one regulation, enabled by its name."""
    return D.compliance(spark, D.scan(docs(spark, d)), regulations=["PCI-DSS"]).select("doc_id", "rule", "n")


@query(f"with {_BROKEN}, r as (select distinct regulation from rules) select r.regulation, count(distinct doc_id) as documents, count(doc_id) = 0 as compliant, coalesce(sum(n), 0)::bigint as violations from r left join b on r.regulation = b.regulation group by 1")
def dlp_regulation_status(spark, d):
    """Compliant where no document breaks a rule of the regulation."""
    b = D.compliance(spark, D.scan(docs(spark, d)))
    r = spark.createDataFrame([(x,) for x in sorted({r[0] for r in D.RULES})], "regulation string")
    return r.join(b, "regulation", "left").groupBy("regulation").agg(F.countDistinct("doc_id").alias("documents"), (F.count("doc_id") == 0).alias("compliant"), F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))


_TOKEN = "case kind when 'ssn' then 'SSN' when 'credit_card' then 'CC' when 'email' then 'EMAIL' when 'phone' then 'PHONE' else 'PII' end || '_' || sha256({0})[1:8]"


@query(f"with {FOUND} select doc_id, {_TOKEN.format('value')} as token, count(*) as n from f group by 1, 2")
def dlp_hash_token(spark, d):
    return D.scan(docs(spark, d)).groupBy("doc_id", D.tokenised(F.col("kind"), F.col("value")).alias("token")).agg(F.count(F.lit(1)).alias("n"))


_SEP = "case when contains(v, '-') then '-' when contains(v, ' ') then ' ' else '' end"
_AREA = "regexp_replace(v, '[()\\-. ]', '', 'g')[1:3]"
_U = "split_part(v, '@', 1)"
_RUN = f"repeat('X', length({_D}) - 4) || right({_D}, 4)"
_FOURS = f"list_transform(range(0, (length({_D}) + 3) // 4), lambda j: ({_RUN})[j * 4 + 1:j * 4 + 4])"
_MASK = f"""case kind when 'ssn' then 'XXX' || {_SEP} || 'XX' || {_SEP} || right({_D}, 4)
when 'credit_card' then case {_SEP} when '-' then array_to_string({_FOURS}, '-') when ' ' then array_to_string({_FOURS}, ' ') else {_RUN} end
when 'email' then case when length({_U}) <= 2 then repeat('X', length({_U})) else {_U}[1] || repeat('X', length({_U}) - 2) || {_U}[-1] end || '@' || split_part(v, '@', 2)
when 'phone' then case when contains(v, '(') and contains(v, ')') then '(' || {_AREA} || ') XXX-XXXX' when contains(v, '-') then {_AREA} || '-XXX-XXXX' else {_AREA} || 'XXXXXXX' end
when 'ip_address' then split_part(v, '.', 1) || '.XXX.XXX.XXX' else case when length(v) <= 4 then repeat('X', length(v)) else v[1] || repeat('X', length(v) - 2) || v[-1] end end"""
_INSTEAD = {"mask": _MASK, "replace": "'[' || upper(kind) || ']'", "hash": "'[HASH:' || sha256(v)[1:16] || ']'", "remove": "''", "tokenize": _TOKEN.format("v")}


def _redaction(mode: str) -> str:
    return f"""with {FOUND}, o as (select *, max(past) over (partition by doc_id order by start, past, kind rows between unbounded preceding and 1 preceding) as before from f),
c as (select *, sum(case when before is null or start >= before then 1 else 0 end) over (partition by doc_id order by start, past, kind) as c from o),
g as (select doc_id, c, min(start) as start, max(past) as past, case when count(*) = 1 then any_value(kind) else 'pii' end as kind from c group by 1, 2),
v as (select g.*, text, coalesce(lag(past) over (partition by g.doc_id order by start), 0) as gap, substring(text, (start + 1)::bigint, (past - start)::bigint) as v from g join x on g.doc_id = x.doc_id),
r as (select doc_id, string_agg(substring(text, (gap + 1)::bigint, (start - gap)::bigint) || ({_INSTEAD[mode]}), '' order by start) || substring(any_value(text), (max(past) + 1)::bigint) as redacted, count(*) as n from v group by 1)
select x.doc_id, coalesce(redacted, text) as redacted, coalesce(n, 0) as n from x left join r on x.doc_id = r.doc_id"""


@query(_redaction("mask"))
def dlp_redact_mask(spark, d):
    return D.redacted(docs(spark, d), "mask")


@query(_redaction("replace"))
def dlp_redact_replace(spark, d):
    return D.redacted(docs(spark, d), "replace")


@query(_redaction("hash"))
def dlp_redact_hash(spark, d):
    return D.redacted(docs(spark, d), "hash")


@query(_redaction("remove"))
def dlp_redact_remove(spark, d):
    return D.redacted(docs(spark, d), "remove")


@query(_redaction("tokenize"))
def dlp_redact_tokenize(spark, d):
    return D.redacted(docs(spark, d), "tokenize")


@query(f"with {FOUND}, v as (select distinct doc_id, kind, value as v from f) select distinct doc_id, v as value, {_MASK} as replacement from v")
def dlp_redaction_map(spark, d):
    return D.redaction_map(docs(spark, d), "mask")


@query(f"""with {FOUND}, a as (select doc_id, avg(case risk when 'critical' then 1.0 when 'high' then 0.8 when 'medium' then 0.5 else 0.2 end) as score, bool_or(risk in ('high', 'critical')) as high, bool_or(kind = 'credit_card') as card, bool_or(kind = 'ssn') as ssn, bool_or(kind in ({', '.join(f"'{k}'" for k in sorted({k for r in D.RULES for k in r[2]}))})) as ruled from f group by 1)
select x.doc_id, array_to_string(list_filter([case when round(score, 6) >= 0.8 then 'high risk content: consider additional security measures' end, case when high then 'apply strong access controls' end, case when card then 'card data: ensure PCI DSS compliance' end, case when ssn then 'ssn: implement strong encryption and access controls' end, case when ruled then 'not compliant: review required actions' end], lambda v: v is not null), '; ') as advice from x left join a on x.doc_id = a.doc_id""")
def dlp_recommendations(spark, d):
    return D.recommendations(docs(spark, d)).withColumn("advice", F.array_join("advice", "; "))


_META = "m as (select page_id || ':url' as k, coalesce(url, '') as text from pages union all select page_id || ':html' as k, coalesce(html, '') as text from pages)"


@query(f"with {_META} select split_part(k, ':', 1)::bigint as page_id, kind, value, confidence, 'metadata:' || split_part(k, ':', 2) as context from ({_PLACED('m', 'k')})")
def dlp_metadata_scan(spark, d):
    return D.scan_metadata(table(spark, d, "pages"), "page_id", ["url", "html"])


_CUSTOM = [("license", "icense"), ("secret", "password")]


@query(" union all ".join(f"select doc_id, '{n}' as name, '{p}' as value, 0.7::double as confidence, strpos({TEXT}, '{p}') - 1 as start from documents where contains({TEXT}, '{p}')" for n, p in _CUSTOM))
def dlp_custom_patterns(spark, d):
    return D.scan_literals(docs(spark, d), _CUSTOM)


_WORDS = "select distinct w as name, w as literal from (select unnest(regexp_split_to_array(coalesce(text, ''), '[^A-Za-z]+')) as w from benchmark) where length(w) >= 3"


@query(f"with p as ({_WORDS}) select doc_id, name, literal as value, 0.7::double as confidence, strpos({TEXT}, literal) - 1 as start from documents join p on contains({TEXT}, literal)")
def dlp_pattern_table(spark, d):
    """All words of the benchmark as custom patterns, wherever they stand in a document."""
    words = table(spark, d, "benchmark").select(F.explode(F.split(F.coalesce("text", F.lit("")), "[^A-Za-z]+")).alias("name")).where(F.length("name") >= 3).distinct()
    return D.scan_literal_table(docs(spark, d), words.withColumn("literal", F.col("name")))


#: Policy rules of the query.
POLICY = [
    {"name": "license-word", "kind": "keyword", "pattern": "license", "whole_word": True, "severity": "low", "exclusions": ["License"]},
    {"name": "key", "kind": "regex", "pattern": "[A-Z]{4}[0-9]{4,}", "case_sensitive": True, "severity": "high"},
    {"name": "mail", "kind": "builtin", "pattern": "email"},
]


@query(f"""select doc_id, 'license-word' as rule, 'low' as severity, v as value from (select doc_id, unnest(regexp_extract_all({TEXT}, '(?i)\\b(?:license)\\b')) as v from documents) where v <> 'License'
union all select doc_id, 'key', 'high', unnest(regexp_extract_all({TEXT}, '[A-Z]{{4}}[0-9]{{4,}}')) from documents union all select doc_id, 'mail', 'medium', unnest(regexp_extract_all({TEXT}, '(?i){D.TYPES["email"][0]}')) from documents""")
def dlp_policy_rules(spark, d):
    return D.scan_rules(docs(spark, d), POLICY)


_SECRET = " union all ".join(f"select doc_id, '{k}' as kind, '{s}' as severity, len(regexp_extract_all({TEXT}, '{p}')) as n from documents" for k, (p, s) in D.SECRETS.items())


@query(f"select doc_id, kind, severity, n, least(n / 5, 1)::double as score from ({_SECRET}) where n > 0")
def secrets_scan(spark, d):
    return D.secrets(docs(spark, d))


@query(f"""with {FOUND}, v as (select doc_id, kind, value as v from f) select doc_id, kind, case when kind in ('credit_card', 'ssn', 'phone') then case when length(v) > 4 then v[1:2] || repeat('*', length(v) - 4) || right(v, 2) else repeat('*', length(v)) end
when kind = 'email' then case when length({_U}) > 2 then {_U}[1] || repeat('*', length({_U}) - 2) || {_U}[-1] else repeat('*', length({_U})) end || '@' || split_part(v, '@', 2) else v end as shown from v""")
def dlp_sanitised(spark, d):
    return D.scan(docs(spark, d)).select("doc_id", "kind", D.sanitised(F.col("kind"), F.col("value")).alias("shown"))
