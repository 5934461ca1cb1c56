"""Personal data: findings with places, risk, redaction, compliance. Patterns are for ASCII; offsets are characters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.entities import luhn
from corpusmill.functions.text import SPACE, let, pattern
from corpusmill.operators import literals

#: Pattern and base risk of each type. Cards stand in one run of digits or, beyond the reference, in groups.
TYPES = {
    "email": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0.4),
    "ip_address": (r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", 0.3),
    "phone": (r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b", 0.5),
    "ssn": (r"\b[0-9]{3}[- ]?[0-9]{2}[- ]?[0-9]{4}\b", 0.9),
    "credit_card": (r"\b(?:(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3[0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})(?:[- ]?[0-9]{4})*|(?:4[0-9]{3}|5[1-5][0-9]{2}|6(?:011|5[0-9]{2}))(?:[- ][0-9]{4}){3}|3[47][0-9]{2}[- ][0-9]{6}[- ][0-9]{5})\b", 0.9),
}
#: What a text must hold for a type to be there, cheap to test.
_NEEDS = {"email": "@", "ip_address": r"[0-9]\.[0-9]", "phone": "[0-9]{4}", "ssn": "[0-9]{4}", "credit_card": "[0-9]{4}"}
#: Base risk of types that other scanners bring.
OTHER_RISKS = {"passport": 0.8, "bank_account": 0.8, "drivers_license": 0.7, "date_of_birth": 0.7, "address": 0.6, "name": 0.5}
#: Fixed values: (regulation, rule, types, severity, actions); GDPR-001 leaves out what is of low risk.
RULES = [
    ("GDPR", "GDPR-001", ["email", "name", "address", "phone"], "high", ["Implement data protection measures", "Document legal basis for processing"]),
    ("GDPR", "GDPR-002", ["date_of_birth", "ssn"], "critical", ["Implement data protection measures", "Document legal basis for processing"]),
    ("HIPAA", "HIPAA-001", ["ssn", "date_of_birth", "name", "email"], "critical", ["Apply HIPAA safeguards", "Implement access controls"]),
    ("PCI-DSS", "PCI-001", ["credit_card"], "critical", ["Encrypt cardholder data", "Implement PCI DSS controls"]),
    ("CCPA", "CCPA-001", ["email", "name", "address", "ssn", "ip_address"], "high", ["Enable consumer rights mechanisms", "Implement data deletion capabilities"]),
]
TOKENS = {"ssn": "SSN", "credit_card": "CC", "email": "EMAIL", "phone": "PHONE"}
MODES = ("none", "mask", "replace", "hash", "remove", "tokenize")


def valid(kind: str, value: Column) -> Column:
    d = F.regexp_replace(value, "[- ]", "")
    if kind == "ssn":
        area = F.substring(d, 1, 3)
        return ~area.isin("000", "666") & (area < "900") & (F.substring(d, 4, 2) != "00") & (F.substring(d, 6, 4) != "0000")
    if kind == "credit_card":
        return luhn(d)
    if kind == "ip_address":
        return F.forall(F.split(value, r"\."), lambda x: x.cast("int") <= 255)
    return F.lit(True)


def confidence(kind: str, value: Column) -> Column:
    """By the way a value is written: separators make it surer."""
    if kind == "ssn":
        return F.when(value.rlike("[- ]"), 0.9).otherwise(0.7)
    if kind == "credit_card":
        return F.when(value.rlike("[- ]"), 0.9).otherwise(0.8)
    if kind == "phone":
        return F.when(value.rlike(r"\(") & value.rlike(r"\)"), 0.9).when(value.rlike("[-.]"), 0.8).otherwise(0.7)
    return F.lit(0.9 if kind == "email" else 0.8)


def enabled(kinds: list[str] | None, disabled: list[str] | None) -> list[str]:
    """Types that a scan looks for: those listed, all by default, without the disabled ones."""
    return [k for k in TYPES if (kinds is None or k in kinds) and k not in (disabled or [])]


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text", kinds: list[str] | None = None, disabled: list[str] | None = None, least: float = 0.7) -> DataFrame:
    """docs' key and text with `findings`, an array of (start, past, kind, value, confidence) ordered by place: from 0, `past` the end; null text has none.

    A place is the length of what stands before it: the pieces between a type's matches and the matches themselves."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    chosen = enabled(kinds, disabled)
    none = F.array().cast("array<string>")
    rows = docs.select(key, t.alias("t"))
    for k in chosen:
        p = pattern(TYPES[k][0])
        there = F.col("t").rlike(_NEEDS[k])
        rows = rows.withColumns({f"m_{k}": F.when(there, F.regexp_extract_all("t", F.lit(p), F.lit(0))).otherwise(none), f"s_{k}": F.when(there, F.split("t", p)).otherwise(none)})

    def of(k: str) -> Column:
        m, s = F.col(f"m_{k}"), F.col(f"s_{k}")
        length = lambda part: F.aggregate(part, F.lit(0), lambda n, x: n + F.length(x))
        at = lambda i: length(F.slice(s, F.lit(1), i + 1)) + length(F.slice(m, F.lit(1), i))
        placed = F.transform(m, lambda v, i: F.struct(at(i).alias("start"), (at(i) + F.length(v)).alias("past"), F.lit(k).alias("kind"), v.alias("value"), confidence(k, v).alias("confidence")))
        return F.filter(placed, lambda f: valid(k, f["value"]) & (f["confidence"] >= least))

    empty = F.array().cast("array<struct<start:int,past:int,kind:string,value:string,confidence:double>>")
    return rows.select(key, F.col("t").alias(text), F.array_sort(F.concat(*[of(k) for k in chosen]) if chosen else empty).alias("findings"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, kind, value, confidence, start, past, context): one row a finding, with 20 characters on either side."""
    f = findings(docs, key, text, **options).select(key, F.col(text).alias("t"), F.explode("findings").alias("f"))
    low = F.greatest(F.lit(0), F.col("f.start") - 20)
    return f.select(key, "f.kind", "f.value", "f.confidence", "f.start", "f.past", F.substring("t", low + 1, F.col("f.past") + 20 - low).alias("context"))


def scan_metadata(rows: DataFrame, key: str, fields: list[str], **options) -> DataFrame:
    """Findings in metadata fields: as scan(), the context names the field."""
    cells = rows.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("v")) for c in fields])).alias("c"))
    cells = cells.select(F.struct(key, "c.field").alias("_k"), F.col("c.v").alias("_v"))
    out = scan(cells, "_k", "_v", **options)
    return out.select(F.col(f"_k.{key}").alias(key), "kind", "value", "confidence", F.concat(F.lit("metadata:"), F.col("_k.field")).alias("context"))


def scan_literals(docs: DataFrame, patterns: list[tuple[str, str]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, name, value, confidence, start) of custom patterns (name, literal): the first place of each in a text, at .7."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = F.array_compact(F.array(*[F.when(F.contains(t, F.lit(p)), F.struct(F.lit(n).alias("name"), F.lit(p).alias("value"), F.lit(0.7).alias("confidence"), (F.position(F.lit(p), t) - 1).alias("start"))) for n, p in patterns]))
    return docs.select(key, F.explode(found).alias("f")).select(key, "f.*")


def folded(c: Column) -> Column:
    """A-Z in lower case: of one length with the text, whatever its other letters."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Characters of a gram; shorter patterns are their own gram.
GRAM = 4
#: A run of what is no white space.
RUN = r"[^\x20\x09-\x0D]+"


def candidates(docs: DataFrame, patterns: DataFrame, key: str = "doc_id", text: str = "text", literal: str = "literal") -> DataFrame:
    """(_key, _text, _p): rows whose text may hold patterns, with those as an array of structs (_low, the columns of patterns), for any number of patterns.

    Texts and patterns are runs of white space and of other characters. A pattern stands in a text only if its longest run stands in one of the text's,
    so runs are looked up once for all texts: by the gram of a pattern's run that stands in the fewest, and only what that finds is held against the run.
    How many patterns there are changes the size of a join, not the plan. A text travels once, whatever it holds.
    Patterns that are null or empty match nothing; equal ones match each; repeated keys and null keys are rows of their own."""
    taken = list(patterns.columns)
    runs = lambda t, blank: F.regexp_extract_all(t, F.lit(RUN + (f"|{SPACE}" if blank else "")), F.lit(0))
    longest = lambda t: F.array_max(F.transform(runs(t, True), lambda r: F.struct((~r.rlike(SPACE)).alias("full"), F.length(r).alias("n"), r.alias("r"))))
    p = patterns.where(F.length(literal) > 0).withColumn("_low", folded(F.col(literal)))
    a = p.select("_low", longest(F.col("_low")).alias("a")).distinct().select("_low", F.col("a.full").alias("_full"), F.col("a.r").alias("_run"), F.least("a.n", F.lit(GRAM)).alias("_size"))
    kinds = a.select("_size", "_full").distinct().collect()  # twice GRAM at most
    sizes = sorted({r["_size"] for r in kinds})
    cut = lambda t, n: F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    none = F.array().cast("array<string>")
    grams = lambda t: F.array_distinct(F.concat(none, *[cut(t, n) for n in sizes]))
    own = reduce(lambda out, n: out.when(F.col("_size") == n, cut(F.col("_run"), n)), sizes, F.when(F.lit(False), none))
    low = a.select("_run", F.explode(F.array_distinct(own)).alias("_gram")).distinct()
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    blank = not all(r["_full"] for r in kinds)
    there = docs.select(F.col(key).alias("_k"), F.explode(F.array_distinct(runs(folded(t), blank))).alias("_in"))
    words = there.select("_in").distinct()
    cells = words.select("_in", F.explode(grams(F.col("_in"))).alias("_gram"))
    often = cells.join(low.select("_gram").distinct(), "_gram", "left_semi").groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    # a gram that no run has rules the pattern out
    rare = low.join(often, "_gram", "left").groupBy("_run").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("g"))).alias("m")).where("m.n > 0").select("_run", F.col("m.g").alias("_gram"))
    held = cells.join(rare, "_gram").where(F.contains("_in", F.col("_run"))).select("_in", "_run").join(a.select("_run", "_low"), "_run").groupBy("_in").agg(F.collect_list("_low").alias("_lows"))
    met = there.join(held, "_in").select("_k", F.explode("_lows").alias("_low")).distinct()
    met = met.join(p, "_low").groupBy("_k").agg(F.collect_list(F.struct("_low", *taken)).alias("_p"))
    return docs.select(F.col(key).alias("_key"), t.alias("_text")).join(met, F.col("_key").eqNullSafe(F.col("_k"))).select("_key", "_text", "_p")


def match_table(docs: DataFrame, patterns: DataFrame, key: str = "doc_id", text: str = "text", literal: str = "literal") -> DataFrame:
    """(_key, _text, the columns of patterns): rows whose text holds the literal of a pattern, A-Z as a-z; candidates() held against the text."""
    found = let(folded(F.col("_text")), lambda t: F.filter("_p", lambda x: F.contains(t, x["_low"])))
    return candidates(docs, patterns, key, text, literal).select("_key", "_text", F.explode(found).alias("_f")).select("_key", "_text", *[f"_f.{c}" for c in patterns.columns])


def scan_literal_table(docs: DataFrame, patterns: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As scan_literals(), with the patterns as a table (name, literal) of any length."""
    found = literals.first_places(docs, patterns, key, text)
    return found.select(key, "name", "value", F.lit(0.7).alias("confidence"), "start")


RULE = "name string, severity string, kind string, pattern string, whole_word boolean, case_sensitive boolean, exclusions array<string>"


def _quoted(c: Column) -> Column:
    return F.regexp_replace(c, r"([^0-9A-Za-z\x80-\x{10FFFF} ])", r"\\$1")


def scan_keyword_table(docs: DataFrame, rules: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, rule, severity, value) of keyword rules, a table as RULE: every place where a keyword stands, as it is written there."""
    found = match_table(docs, rules.select("name", F.coalesce("severity", F.lit("medium")).alias("severity"), F.col("pattern").alias("literal"), F.coalesce("whole_word", F.lit(False)).alias("whole"), F.coalesce("case_sensitive", F.lit(False)).alias("exact"), "exclusions"), key, text)
    core = F.concat(F.lit("(?:"), _quoted(F.col("literal")), F.lit(")"))
    edge = F.lit(pattern(r"\b"))
    p = F.concat(F.when(F.col("exact"), "").otherwise("(?i)"), F.when(F.col("whole"), F.concat(edge, core, edge)).otherwise(core))
    values = found.select(F.col("_key").alias(key), F.col("name").alias("rule"), "severity", "exclusions", F.explode(F.regexp_extract_all("_text", p, F.lit(0))).alias("value"))
    return values.where(~F.coalesce(F.array_contains("exclusions", F.col("value")), F.lit(False))).drop("exclusions")


def _not_in(values: list[str]):
    return lambda v: ~v.isin(values)


def _finding(rule: str, severity: str):
    return lambda v: F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), v.alias("value"))


def scan_rules(docs: DataFrame, rules: list[dict], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, rule, severity, value) of policy rules: `kind` regex, keyword or builtin, `pattern`, and whole_word, case_sensitive, exclusions (values that don't count).

    Patterns are looked for in one pass over the texts, keywords go as a table."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found, words = [], []
    for r in rules:
        if r["kind"] == "keyword":
            words.append((r["name"], r.get("severity", "medium"), "keyword", r["pattern"], bool(r.get("whole_word")), bool(r.get("case_sensitive")), r.get("exclusions")))
            continue
        p = TYPES[r["pattern"]][0] if r["kind"] == "builtin" else r["pattern"]
        p = ("" if r.get("case_sensitive") else "(?i)") + (pattern(rf"\b(?:{p})\b") if r.get("whole_word") else pattern(p))
        values = F.regexp_extract_all(t, F.lit(p), F.lit(0))
        if r.get("exclusions"):
            values = F.filter(values, _not_in(r["exclusions"]))
        found.append(F.transform(values, _finding(r["name"], r.get("severity", "medium"))))
    out = []
    if found:
        out.append(docs.select(key, F.explode(F.concat(*found)).alias("f")).select(key, "f.*"))
    if words or not out:
        out.append(scan_keyword_table(docs, docs.sparkSession.createDataFrame(words, RULE), key, text))
    return reduce(DataFrame.unionByName, out)


def risk(kind: Column, confidence: Column) -> Column:
    """critical, high, medium or low by the mean of the type's base risk and the confidence."""
    base = reduce(lambda out, kv: out.when(kind == kv[0], kv[1]), {**{k: v[1] for k, v in TYPES.items()}, **OTHER_RISKS}.items(), F.when(F.lit(False), 0.0)).otherwise(0.5)
    r = F.round((base + confidence) / 2, 6)
    return F.when(r >= 0.8, "critical").when(r >= 0.6, "high").when(r >= 0.4, "medium").otherwise("low")


def weight(level: Column) -> Column:
    return F.when(level == "critical", 1.0).when(level == "high", 0.8).when(level == "medium", 0.5).otherwise(0.2)


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row the number of findings, of critical or high ones, and the mean weight (0 for none), in one projection."""
    rows = findings(docs, key, text).select(key, F.transform("findings", lambda x: risk(x["kind"], x["confidence"])).alias("levels"))
    total = F.aggregate("levels", F.lit(0.0), lambda s, x: s + weight(x))
    return rows.select(key, F.size("levels").alias("n_findings"), F.size(F.filter("levels", lambda x: x.isin("critical", "high"))).alias("n_high"), F.when(F.size("levels") > 0, total / F.size("levels")).otherwise(0.0).alias("risk_score"))


def generic_mask(v: Column) -> Column:
    n = F.length(v)
    return F.when(n <= 4, F.repeat(F.lit("X"), n)).otherwise(F.concat(F.substring(v, 1, 1), F.repeat(F.lit("X"), n - 2), F.right(v, F.lit(1))))


def masked(kind: Column, value: Column) -> Column:
    """Last four digits of ssn and card, ends of a mail user, area code, first octet; separators stay."""
    d = F.regexp_replace(value, "[- ]", "")
    sep = F.when(F.contains(value, F.lit("-")), "-").when(F.contains(value, F.lit(" ")), " ").otherwise("")
    ssn = F.concat(F.lit("XXX"), sep, F.lit("XX"), sep, F.right(d, F.lit(4)))
    run = F.concat(F.repeat(F.lit("X"), F.length(d) - 4), F.right(d, F.lit(4)))
    card = F.when(sep == "", run).otherwise(F.regexp_replace(run, "(.{4})(?=.)", F.concat(F.lit("$1"), sep)))
    user, host = F.split(value, "@")[0], F.split(value, "@")[1]
    mail = F.concat(F.when(F.length(user) <= 2, F.repeat(F.lit("X"), F.length(user))).otherwise(F.concat(F.substring(user, 1, 1), F.repeat(F.lit("X"), F.length(user) - 2), F.right(user, F.lit(1)))), F.lit("@"), host)
    area = F.substring(F.regexp_replace(value, r"[()\-. ]", ""), 1, 3)
    phone = F.when(value.rlike(r"\(") & value.rlike(r"\)"), F.concat(F.lit("("), area, F.lit(") XXX-XXXX"))).when(F.contains(value, F.lit("-")), F.concat(area, F.lit("-XXX-XXXX"))).otherwise(F.concat(area, F.lit("XXXXXXX")))
    ip = F.concat(F.split(value, r"\.")[0], F.lit(".XXX.XXX.XXX"))
    return F.when(kind == "ssn", ssn).when(kind == "credit_card", card).when(kind == "email", mail).when(kind == "phone", phone).when(kind == "ip_address", ip).otherwise(generic_mask(value))


def tokenised(kind: Column, value: Column) -> Column:
    name = reduce(lambda out, kv: out.when(kind == kv[0], kv[1]), TOKENS.items(), F.when(F.lit(False), "")).otherwise("PII")
    return F.concat(name, F.lit("_"), F.substring(F.sha2(value, 256), 1, 8))


def replacement(mode: str, kind: Column, value: Column) -> Column:
    """What stands in place of a value; `pii` is the kind of findings that overlap."""
    if mode not in MODES:
        raise ValueError(f"unknown redaction mode {mode}")
    return {
        "none": value,
        "mask": masked(kind, value),
        "replace": F.concat(F.lit("["), F.upper(kind), F.lit("]")),
        "hash": F.concat(F.lit("[HASH:"), F.substring(F.sha2(value, 256), 1, 16), F.lit("]")),
        "remove": F.lit(""),
        "tokenize": tokenised(kind, value),
    }[mode]


def merged(found: Column) -> Column:
    """Findings ordered by place with those that overlap made one, of kind `pii`: array of (start, past, kind)."""
    start = F.array().cast("array<struct<start:int,past:int,kind:string>>")

    def step(done, f):
        last = F.try_element_at(done, F.lit(-1))
        one = F.struct(f["start"].alias("start"), f["past"].alias("past"), f["kind"].alias("kind"))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["past"], f["past"]).alias("past"), F.lit("pii").alias("kind"))
        return F.when(F.coalesce(f["start"] < last["past"], F.lit(False)), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(one)))

    return F.aggregate(found, start, step)


def redacted(docs: DataFrame, mode: str, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, redacted, n): each text with its findings replaced, those that overlap as one, and how many places were."""
    f = findings(docs, key, text, **options).select(key, F.col(text).alias("t"), merged(F.col("findings")).alias("f"))
    t = F.col("t")
    instead = lambda x: let(F.substring(t, x["start"] + 1, x["past"] - x["start"]), lambda v: replacement(mode, x["kind"], v))
    step = lambda acc, x: F.struct(F.concat(acc["out"], F.substring(t, acc["at"] + 1, x["start"] - acc["at"]), instead(x)).alias("out"), x["past"].alias("at"))
    end = F.aggregate("f", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step)
    done = f.select(key, t, F.size("f").alias("n"), end.alias("e"))
    return done.select(key, F.when(F.col("n") == 0, t).otherwise(F.concat("e.out", F.substring(t, F.col("e.at") + 1, F.length(t)))).alias("redacted"), "n")


def redaction_map(docs: DataFrame, mode: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, value, replacement): each value of a text once."""
    return scan(docs, key, text).select(key, "value", replacement(mode, F.col("kind"), F.col("value")).alias("replacement")).distinct()


def compliance(spark, found: DataFrame, key: str = "doc_id", regulations: list[str] | None = None) -> DataFrame:
    """(key, regulation, rule, severity, n): rules of the regulations (all by default) that a document's findings break. The rule table is a literal of few rows."""
    rules = spark.createDataFrame([(a, b, s, k) for a, b, ks, s, _ in RULES for k in ks if regulations is None or a in regulations], "regulation string, rule string, severity string, kind string")
    hit = found.join(rules, "kind").where((F.col("rule") != "GDPR-001") | (risk(F.col("kind"), F.col("confidence")) != "low"))
    return hit.groupBy(key, "regulation", "rule", "severity").agg(F.count(F.lit(1)).alias("n"))


def actions(rule: Column) -> Column:
    """What a broken rule asks for, joined by semicolons."""
    return reduce(lambda out, r: out.when(rule == r[1], "; ".join(r[4])), RULES, F.when(F.lit(False), "")).otherwise("")


def recommendations(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, advice): an array by risk score, high-risk findings, cards, ssn and whether a rule is broken."""
    f = findings(docs, key, text).select(key, F.transform("findings", lambda x: x["kind"]).alias("k"), F.transform("findings", lambda x: risk(x["kind"], x["confidence"])).alias("l"))
    score = F.when(F.size("l") > 0, F.aggregate("l", F.lit(0.0), lambda s, x: s + weight(x)) / F.size("l")).otherwise(0.0)
    ruled = F.array(*[F.lit(x) for x in sorted({k for r in RULES for k in r[2] if k in TYPES})])
    has = lambda k: F.array_contains("k", k)
    advice = F.array_compact(F.array(
        F.when(F.round(score, 6) >= 0.8, "high risk content: consider additional security measures"),
        F.when(F.exists("l", lambda x: x.isin("high", "critical")), "apply strong access controls"),
        F.when(has("credit_card"), "card data: ensure PCI DSS compliance"),
        F.when(has("ssn"), "ssn: implement strong encryption and access controls"),
        F.when(F.arrays_overlap("k", ruled), "not compliant: review required actions"),
    ))
    return f.select(key, advice.alias("advice"))


#: What leaks credentials and numbers, with the severity of each.
SECRETS = {
    "password": (r"(?i)(?:password|pwd|pass)\s*[:=]\s*\S+", "high"),
    "api_key": (r"(?i)(?:api[_-]?key|token)\s*[:=]\s*\S+", "critical"),
    "secret_key": (r"(?i)(?:secret|private[_-]?key)\s*[:=]\s*\S+", "critical"),
    "credit_card": (r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "high"),
    "ssn": (r"\b\d{3}-\d{2}-\d{4}\b", "critical"),
}


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, severity, n, score): matches of each pattern of SECRETS in a text; the score is a fifth a match, 1 at most."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), F.size(F.regexp_extract_all(t, F.lit(pattern(p)), F.lit(0))).alias("n")) for k, (p, s) in SECRETS.items()])
    return docs.select(key, F.explode(rows).alias("r")).select(key, "r.*").where("n > 0").withColumn("score", F.least(F.col("n") / 5, F.lit(1.0)))


def sanitised(kind: Column, value: Column) -> Column:
    """A value fit for a log: two characters at either end, of a mail user the first and last."""
    user, host, n = F.split(value, "@")[0], F.split(value, "@")[1], F.length(value)
    mail = F.concat(F.when(F.length(user) > 2, F.concat(F.substring(user, 1, 1), F.repeat(F.lit("*"), F.length(user) - 2), F.right(user, F.lit(1)))).otherwise(F.repeat(F.lit("*"), F.length(user))), F.lit("@"), host)
    ends = F.when(n > 4, F.concat(F.substring(value, 1, 2), F.repeat(F.lit("*"), n - 4), F.right(value, F.lit(2)))).otherwise(F.repeat(F.lit("*"), n))
    return F.when(kind.isin("credit_card", "ssn", "phone"), ends).when(kind == "email", mail).otherwise(value)
