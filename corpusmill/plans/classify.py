"""Entities, sensitivity, compliance, classes of data and kinds of content over `documents` and `pages`."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import content as C
from corpusmill.functions import entities as E
from corpusmill.functions import lexicons as L
from corpusmill.functions import text as T
from corpusmill.plans.registry import query
from corpusmill.plans.text import LIST, TEXT, docs, quoted
from corpusmill.session import table

_DIGITS = "regexp_replace(value, '[^0-9]', '', 'g')"
LUHN = lambda v: f"list_sum(list_transform(range(1, length({v}) + 1), lambda i: case when i % 2 = 1 then (reverse({v})[i])::int when (reverse({v})[i])::int > 4 then (reverse({v})[i])::int * 2 - 9 else (reverse({v})[i])::int * 2 end)) % 10 = 0"
_VALUES = " union ".join(f"select doc_id, text, '{k}' as kind, unnest(regexp_extract_all(text, '{quoted(p)}')) as value from x" for k, ps in L.ENTITIES.items() for p in ps)
_NEAR = " ".join(f"when kind = '{k}' then regexp_matches(lower(text), '{'|'.join(ws)}')" for k, ws in L.ENTITY_CONTEXT.items())
_BASE = f"case when kind = 'email' then 0.9 when kind = 'url' then case when regexp_matches(value, '^(http|www)') then 0.9 else 0.7 end when kind = 'phone' and length({_DIGITS}) >= 10 then 0.8 when kind = 'credit_card' and {LUHN(_DIGITS)} then 0.95 when kind = 'ssn' and length({_DIGITS}) = 9 then 0.9 else 0.7 end"
#: (doc_id, kind, value, confidence, start) of all entities, as CTEs x and e.
ENTITIES = f"x as (select doc_id, {TEXT} as text from documents), e as materialized (select doc_id, kind, value, least(1, {_BASE} + case when case {_NEAR} else false end then 0.1 else 0 end) as confidence, strpos(text, value) as start from ({_VALUES}))"


@query(f"with {ENTITIES} select doc_id, kind, value, round(confidence, 6) as confidence, start from e")
def entities(spark, d):
    return E.scan(docs(spark, d)).withColumn("confidence", F.round("confidence", 6))


@query(" union all ".join(f"select doc_id, '{k}' as kind, unnest(regexp_extract_all({TEXT}, '{quoted(p)}')) as value from documents" for k, p in L.MODEL_ENTITIES.items()))
def entities_model(spark, d):
    return docs(spark, d).select("doc_id", F.explode(E.model_entities(F.col("text"))).alias("e")).select("doc_id", "e.*")


_D = _DIGITS
_FORM = f"case when length({_D}) = 10 then '(' || {_D}[1:3] || ') ' || {_D}[4:6] || '-' || {_D}[7:10] when length({_D}) = 11 then {_D}[1] || ' (' || {_D}[2:4] || ') ' || {_D}[5:7] || '-' || {_D}[8:11] else value end"


@query(f"""with {ENTITIES} select doc_id, kind, value, case when kind = 'email' then split_part(value, '@', 1) end as user, case when kind = 'email' then split_part(value, '@', 2) when kind = 'url' then regexp_extract(value, '^(?:https?://|ftp://)?(?:www\\.)?([^/]*)', 1) end as domain,
case when kind = 'url' then case when starts_with(value, 'https://') then 'https' when starts_with(value, 'http://') then 'http' when starts_with(value, 'ftp://') then 'ftp' else 'unknown' end end as protocol, case when kind = 'phone' then {_FORM} end as formatted,
case when kind = 'credit_card' then case {_D}[1] when '4' then 'Visa' when '5' then 'MasterCard' when '2' then 'MasterCard' when '3' then 'American Express' when '6' then 'Discover' else 'Unknown' end end as brand,
case when kind = 'credit_card' then '****-****-****-' || right({_D}, 4) when kind = 'ssn' then '***-**-' || right({_D}, 4) end as masked from e where kind in ('email', 'url', 'phone', 'credit_card', 'ssn')""")
def entity_enrich(spark, d):
    e = E.scan(docs(spark, d)).where(F.col("kind").isin("email", "url", "phone", "credit_card", "ssn"))
    return e.select("doc_id", "kind", "value", *[v.alias(k) for k, v in E.enriched(F.col("kind"), F.col("value")).items()])


_HAS = lambda terms: " + ".join(f"contains(lower(text), '{x}')::int" for x in terms)


@query(f"""with {ENTITIES}, k as (select doc_id, count(*) filter (kind in ('ssn', 'credit_card', 'phone')) as a, count(*) filter (kind in ('person', 'email')) as b from e group by 1),
s as (select x.doc_id, round(0.3 * ({_HAS(L.SENSITIVE)}) + 0.4 * coalesce(a, 0) + 0.2 * coalesce(b, 0), 6) as score from x left join k on x.doc_id = k.doc_id)
select doc_id, score, case when score >= 0.8 then 'restricted' when score >= 0.6 then 'confidential' when score >= 0.3 then 'internal' else 'public' end as level from s""")
def sensitivity_level(spark, d):
    t = docs(spark, d).select("doc_id", "text", E.entities(F.col("text")).alias("e"))
    score, level = E.sensitivity(F.col("text"), F.col("e"))
    return t.select("doc_id", score.alias("score"), level.alias("level"))


@query(f"""with {ENTITIES}, k as (select doc_id, bool_or(kind in ('person', 'email', 'phone')) as p, bool_or(kind = 'credit_card') as c from e group by 1)
select x.doc_id, array_to_string(list_filter([case when p then 'GDPR' end, case when {_HAS(L.HEALTH)} > 0 then 'HIPAA' end, case when c then 'PCI' end], lambda v: v is not null), ',') as flags from x left join k on x.doc_id = k.doc_id""")
def compliance_flags(spark, d):
    t = docs(spark, d).select("doc_id", "text", E.entities(F.col("text")).alias("e"))
    return t.select("doc_id", E.compliance(F.col("text"), F.col("e")).alias("flags"))


_CLASS = " union all ".join(f"select doc_id, '{k}' as kind, '{risk}' as risk, round(0.3 * ({' + '.join(f'''regexp_matches(text, '{quoted(p)}')::int''' for p in ps)}) + 0.2 * ({_HAS(ks)}) + 0.1 * ({_HAS(cs)}), 6) as sure from x" for k, (ps, ks, cs, risk) in L.DATA_CLASSES.items())
_CLASSES = f"x as (select doc_id, {TEXT} as text from documents), c as materialized (select doc_id, kind, risk, least(sure, 1) as confidence from ({_CLASS}) where sure > 0.3)"


@query(f"with x as (select doc_id, {TEXT} as text from documents) select doc_id, kind, least(sure, 1)::double as confidence, risk, sure > 0.3 as kept from ({_CLASS}) where sure > 0")
def data_class(spark, d):
    """Classes of data with any mark in a text, and whether they count."""
    c = docs(spark, d).select("doc_id", F.explode(E.class_scores(F.col("text"))).alias("c")).select("doc_id", "c.*").where("confidence > 0")
    return c.withColumn("kept", F.col("confidence") > 0.3)


_PII = " union all ".join(f"select doc_id, '{k}' as kind, unnest(regexp_extract_all(text, '{quoted(p)}')) as value from x" for k, p in L.RULE_PII.items())
_LEVEL = ", ".join(
    f"round(high + {' + '.join(f'''case when regexp_matches(text, '{quoted(p)}') then {w} else 0 end''' for p, w in ps) or '0'} + case when n >= {least} then 0.45 * {' + '.join(f'n_{r}' for r in risky if r in L.RULE_PII) or '0'} * 1 + case when {' and '.join((f'n_{r} > 0' if r in L.RULE_PII else 'false') for r in req) or 'true'} then {bonus} else 0 end else 0 end, 6) as s_{k}".replace("0.45 * n_ssn + n_credit_card * 1", "0.45 * (n_ssn + n_credit_card)")
    for k, (_, ps, (least, req, bonus, risky)) in L.SENSITIVITY_LEVELS.items()
)
_RULES = f"""{_CLASSES}, p as ({_PII}), g as (select doc_id, count(*) as n, {', '.join(f"count(*) filter (kind = '{k}') as n_{k}" for k in L.RULE_PII)} from p group by 1),
h as (select doc_id, sum(0.3 * confidence) as high from c where risk = 'high' group by 1),
y as (select x.doc_id, text, coalesce(n, 0) as n, {', '.join(f'coalesce(n_{k}, 0) as n_{k}' for k in L.RULE_PII)}, coalesce(high, 0) as high from x left join g on x.doc_id = g.doc_id left join h on x.doc_id = h.doc_id)"""


@query(f"""with {_RULES}, s as (select doc_id, {_LEVEL} from y)
select doc_id, case {' '.join(f"when s_{k} >= {t} then '{k}'" for k, (t, *_) in L.SENSITIVITY_LEVELS.items())} end as level, case {' '.join(f"when s_{k} >= {t} then s_{k}" for k, (t, *_) in L.SENSITIVITY_LEVELS.items())} end as score,
case {' '.join(f"when s_{k} >= {t} then {f'round(least(1, s_{k} / {t}), 6)' if t else '1'}" for k, (t, *_) in L.SENSITIVITY_LEVELS.items())} end::double as confidence from s""")
def sensitivity_rules(spark, d):
    t = docs(spark, d).select("doc_id", "text", F.lower("text").alias("low"), E.rule_findings(F.col("text")).alias("f"), E.data_classes(F.col("text")).alias("c"))
    t = t.select("doc_id", *[v.alias(k) for k, v in E.rule_scores(F.col("text"), F.col("f"), F.col("c"), F.col("low")).items()])
    level, score, sure = E.rule_level({k: F.col(k) for k in L.SENSITIVITY_LEVELS})
    return t.select("doc_id", level.alias("level"), score.alias("score"), F.round(sure, 6).alias("confidence"))


_FRAME = ", ".join(f"case when {_HAS(ps)} > 0 or {' or '.join([f'n_{t} > 0' for t in ts if t in L.RULE_PII] + [f'list_contains(coalesce(kinds, []), {chr(39)}{k}{chr(39)})' for k in ks])} then '{name}' end" for name, (ps, ts, ks) in L.FRAMEWORKS.items())


@query(f"with {_RULES}, k as (select doc_id, list(kind) as kinds from c group by 1) select y.doc_id, array_to_string(list_filter([{_FRAME}], lambda v: v is not null), ',') as frameworks from y left join k on y.doc_id = k.doc_id")
def compliance_frameworks(spark, d):
    t = docs(spark, d).select("doc_id", "text", E.rule_findings(F.col("text")).alias("f"), E.data_classes(F.col("text")).alias("c"))
    return t.select("doc_id", E.frameworks(F.col("text"), F.col("f"), F.col("c")).alias("frameworks"))


@query(f"""with {ENTITIES}, k as (select doc_id, avg(confidence) as c from e group by 1), l as (select doc_id, {TEXT} as text from documents)
select l.doc_id, round(coalesce((select avg(v) from (select unnest([k.c, case when regexp_matches(text, '[A-Za-z]') then 0.5 end]) as v) where v > 0), 0), 6) as confidence from l left join k on l.doc_id = k.doc_id""")
def overall_confidence(spark, d):
    """Mean of the entities' confidence and of .5 for a text with letters, those that are there."""
    t = docs(spark, d).select("doc_id", "text", F.transform(E.entities(F.col("text")), lambda e: e["confidence"]).alias("c"))
    own = F.when(F.size("c") > 0, T.mean_of(F.col("c")))
    return t.select("doc_id", F.round(E.overall_confidence(own, F.when(F.col("text").rlike("[A-Za-z]"), 0.5)), 6).alias("confidence"))


_EXT = "lower(regexp_extract(name, '([^.]*)$', 1))"
_KIND = lambda table_, column: " ".join(f"when list_contains({LIST(exts)}, {column}) then '{kind}'" for kind, exts in table_.items())
_FILES = f"f as (select page_id, case page_id % 6 when 0 then 'text/html' when 1 then 'application/pdf' when 2 then 'image/png' when 3 then 'text/csv' when 4 then null else '' end as mime, case page_id % 7 when 0 then 'a.csv' when 1 then 'b.tar.GZ' when 2 then 'c.py' when 3 then 'd.docx' when 4 then 'e.MP4' when 5 then 'f' else 'g.log' end as name, coalesce(html, '') as content from pages)"


@query(f"""with {_FILES} select page_id,
case {' '.join(f"when regexp_matches(coalesce(mime, ''), '{p}') then '{k}'" for p, k in C.MIME_CONTENT)} {_KIND(C.EXTENSION_CONTENT, _EXT)}
 {' '.join(f"when {' or '.join(' and '.join(f'contains(lower(content), {chr(39)}{w}{chr(39)})' for w in ws) for ws in alternatives)} then '{k}'" for k, alternatives in C.SNIFF)} else 'document' end as content_type,
case {_KIND(C.MIME_DOCUMENT, "coalesce(mime, '')")} {_KIND(C.EXTENSION_DOCUMENT, _EXT)} else 'text' end as document_type from f""")
def content_type_file(spark, d):
    k = F.col("page_id")
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % n + 1).cast("int"))
    f = table(spark, d, "pages").select(k, pick(["text/html", "application/pdf", "image/png", "text/csv", None, ""], 6).alias("mime"), pick(["a.csv", "b.tar.GZ", "c.py", "d.docx", "e.MP4", "f", "g.log"], 7).alias("name"), F.coalesce("html", F.lit("")).alias("content"))
    return f.select("page_id", C.content_type(F.col("mime"), F.col("name"), F.col("content")).alias("content_type"), C.document_type(F.col("mime"), F.col("name")).alias("document_type"))
