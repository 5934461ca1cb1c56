"""Entities of texts and what hangs on them: kinds by patterns, enrichment, sensitivity, compliance, classes of data."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import lexicons as L
from corpusmill.functions import text as T

#: What a text must hold for a kind to be there, cheap to test.
_NEEDS = {"email": "@", "url": r"://|www\.", "phone": "[0-9]{4}", "credit_card": "[0-9]{4}", "ssn": "[0-9]{4}", "ip_address": r"[0-9]\.[0-9]", "date": "[0-9]", "money": "[0-9]", "percentage": "[0-9]", "location": r"[0-9]{5}|,\s*[A-Z]{2}"}

_RULE_NEEDS = {"ssn": "[0-9]-[0-9]", "credit_card": "4[0-9]{3}", "email": "@", "phone": "[0-9]{3}"}


def luhn(digits: Column) -> Column:
    """Whether the digits of a number pass the Luhn sum."""
    d = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda x: x != ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)))
    return F.aggregate(d, F.lit(0), lambda a, b: a + b) % 10 == 0


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def values_of(text: Column, kind: str) -> Column:
    """Distinct values of a kind, in the order of its patterns and then of the text."""
    found = F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(T.pattern(p)), F.lit(0)) for p in L.ENTITIES[kind]]))
    return F.when(text.rlike(_NEEDS[kind]), found).otherwise(F.array().cast("array<string>")) if kind in _NEEDS else found


def confidence(kind: str, value: Column, near: Column) -> Column:
    """.7, more for well-formed values of a kind, and .1 more where a word of its context stands anywhere in the text."""
    base = {"email": F.lit(0.9), "url": F.when(value.rlike("^(http|www)"), 0.9).otherwise(0.7), "phone": F.when(F.length(digits_of(value)) >= 10, 0.8).otherwise(0.7), "credit_card": F.when(luhn(digits_of(value)), 0.95).otherwise(0.7), "ssn": F.when(F.length(digits_of(value)) == 9, 0.9).otherwise(0.7)}.get(kind, F.lit(0.7))
    return F.least(F.lit(1.0), base + near)


def entities(text: Column) -> Column:
    """Array of (kind, value, confidence, start): the twelve kinds, each value of a kind once, at its first place in the text (from 1)."""

    def of(kind: str) -> Column:
        row = lambda v, near: F.struct(F.lit(kind).alias("kind"), v.alias("value"), confidence(kind, v, near).alias("confidence"), F.position(v, text).alias("start"))
        context = L.ENTITY_CONTEXT.get(kind)
        near = F.when(text.rlike("(?i)" + "|".join(context)), 0.1).otherwise(0.0) if context else F.lit(0.0)
        return T.let(near, lambda n: F.transform(values_of(text, kind), lambda v: row(v, n)))

    return F.concat(*[of(k) for k in L.ENTITIES])


def model_entities(text: Column) -> Column:
    """Array of (kind, value): the seven kinds of the model's list, every match."""

    def of(kind: str, p: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(T.pattern(p)), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    return F.concat(*[of(k, p) for k, p in L.MODEL_ENTITIES.items()])


def enriched(kind: Column, value: Column) -> dict[str, Column]:
    """Parts and forms of a value by its kind: user and domain, protocol, phone format, card brand, mask; null where a kind has none."""
    d = digits_of(value)
    part = lambda a, n: F.substring(d, a, n)
    phone = F.when(F.length(d) == 10, F.concat(F.lit("("), part(1, 3), F.lit(") "), part(4, 3), F.lit("-"), part(7, 4))).when(F.length(d) == 11, F.concat(part(1, 1), F.lit(" ("), part(2, 3), F.lit(") "), part(5, 3), F.lit("-"), part(8, 4))).otherwise(value)
    host = F.regexp_extract(value, r"^(?:https?://|ftp://)?(?:www\.)?([^/]*)", 1)
    first = F.substring(d, 1, 1)
    brand = F.when(first == "4", "Visa").when(first.isin("5", "2"), "MasterCard").when(first == "3", "American Express").when(first == "6", "Discover").otherwise("Unknown")
    return {
        "user": F.when(kind == "email", F.split(value, "@")[0]),
        "domain": F.when(kind == "email", F.split(value, "@")[1]).when(kind == "url", host),
        "protocol": F.when(kind == "url", F.when(value.rlike("^https://"), "https").when(value.rlike("^http://"), "http").when(value.rlike("^ftp://"), "ftp").otherwise("unknown")),
        "formatted": F.when(kind == "phone", phone),
        "brand": F.when(kind == "credit_card", brand),
        "masked": F.when(kind == "credit_card", F.concat(F.lit("****-****-****-"), F.right(d, F.lit(4)))).when(kind == "ssn", F.concat(F.lit("***-**-"), F.right(d, F.lit(4)))),
    }


def kinds(found: Column, *names: str) -> Column:
    """How many of the entities are of the kinds named."""
    return F.size(F.filter(found, lambda e: e["kind"].isin(*names)))


def sensitivity(text: Column, found: Column) -> tuple[Column, Column]:
    """Score and level: .3 a phrase, .4 a number of a person or card or phone, .2 a person or mail address."""
    score = 0.3 * T.how_many(F.lower(text), L.SENSITIVE) + 0.4 * kinds(found, "ssn", "credit_card", "phone") + 0.2 * kinds(found, "person", "email")
    score = F.round(score, 6)
    return score, F.when(score >= 0.8, "restricted").when(score >= 0.6, "confidential").when(score >= 0.3, "internal").otherwise("public")


def compliance(text: Column, found: Column) -> Column:
    """GDPR for persons, mail and phone, HIPAA for terms of health, PCI for cards, comma-joined."""
    return F.array_join(F.array(F.when(kinds(found, "person", "email", "phone") > 0, "GDPR"), F.when(T.how_many(F.lower(text), L.HEALTH) > 0, "HIPAA"), F.when(kinds(found, "credit_card") > 0, "PCI")), ",")


def rule_findings(text: Column) -> Column:
    """Array of the types of personal data that the rule engine finds, one for each match."""

    def of(kind: str, p: str) -> Column:
        found = F.array_repeat(F.lit(kind), F.size(F.regexp_extract_all(text, F.lit(T.pattern(p)), F.lit(0))))
        return F.when(text.rlike(_RULE_NEEDS[kind]), found).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(k, p) for k, p in L.RULE_PII.items()])


def class_scores(text: Column) -> Column:
    """Array of (kind, confidence, risk) of each class of data: .3 a pattern, .2 a keyword, .1 a word of the context, 1 at most."""

    def rows(low: Column) -> Column:
        out = []
        for kind, (patterns, keywords, context, risk) in L.DATA_CLASSES.items():
            hit = reduce(lambda a, b: a + b, [text.rlike(p).cast("int") for p in patterns])
            sure = F.round(0.3 * hit + 0.2 * T.how_many(low, keywords) + 0.1 * T.how_many(low, context), 6)
            out.append(F.struct(F.lit(kind).alias("kind"), F.least(sure, F.lit(1.0)).alias("confidence"), F.lit(risk).alias("risk")))
        return F.array(*out)

    return T.let(F.lower(text), rows)


def data_classes(text: Column) -> Column:
    """Those of class_scores() above .3."""
    return F.filter(class_scores(text), lambda r: r["confidence"] > 0.3)


def phrase(text: Column, low: Column, p: str) -> Column:
    """Whether the text holds one of the pattern's phrases: those of which the lower-cased text holds the longest word are sought."""
    assert (m := re.fullmatch(r"\(\?i\)\(([^()]*)\)", p)), p
    words = [max(re.findall("[a-z]+", re.sub(r"\\.", " ", x)), key=len) for x in m[1].split("|")]
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) & text.rlike(T.pattern(f"(?i){x}")) for w, x in zip(words, m[1].split("|"), strict=True)])


def rule_scores(text: Column, found: Column, classes: Column, low: Column | None = None) -> dict[str, Column]:
    """Score of each sensitivity level: its patterns, what the personal data adds, and .3 of the confidence of each class of high risk."""
    low = F.lower(text) if low is None else low
    high = F.aggregate(F.filter(classes, lambda c: c["risk"] == "high"), F.lit(0.0), lambda s, c: s + 0.3 * c["confidence"])
    out = {}
    for level, (_, patterns, (least, required, bonus, risky)) in L.SENSITIVITY_LEVELS.items():
        score = high
        for p, weight in patterns:
            score = score + F.when(phrase(text, low, p), weight).otherwise(0.0)
        there = reduce(lambda a, b: a & b, [F.array_contains(found, r) for r in required], F.lit(True))
        half = 0.45 * F.size(F.filter(found, lambda k: k.isin(risky))) if risky else F.lit(0.0)
        out[level] = score + F.when(F.size(found) >= least, half + F.when(there, bonus).otherwise(0.0)).otherwise(0.0)
    return out


def rule_level(scores: dict[str, Column]) -> tuple[Column, Column, Column]:
    """Level, its score and confidence: the highest level whose score meets its threshold."""
    level, score, sure = None, None, None
    for name, (threshold, *_) in L.SENSITIVITY_LEVELS.items():
        s = F.round(scores[name], 6)
        hit, c = s >= threshold, F.least(F.lit(1.0), s / threshold) if threshold else F.lit(1.0)
        level, score, sure = (F.when(hit, v) if out is None else out.when(hit, v) for out, v in ((level, F.lit(name)), (score, s), (sure, c)))
    return level, score, sure


def frameworks(text: Column, found: Column, classes: Column) -> Column:
    """Frameworks that a phrase, a type of personal data or a class of data brings about, comma-joined."""
    low, own = F.lower(text), F.transform(classes, lambda c: c["kind"])
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    return F.array_join(F.array(*[F.when((T.how_many(low, phrases) > 0) | F.arrays_overlap(found, lit(types)) | F.arrays_overlap(own, lit(kinds_)), name) for name, (phrases, types, kinds_) in L.FRAMEWORKS.items()]), ",")


def overall_confidence(*parts: Column) -> Column:
    """Mean of the parts that are above 0; 0 for none."""
    there = F.filter(F.array(*parts), lambda p: F.coalesce(p > 0, F.lit(False)))
    return F.when(F.size(there) > 0, T.mean_of(there)).otherwise(0.0)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, value, confidence, start) of all entities above .5."""
    return docs.select(key, F.explode(entities(F.coalesce(F.col(text).cast("string"), F.lit("")))).alias("e")).select(key, "e.*").where("confidence > 0.5")
