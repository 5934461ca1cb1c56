"""Text measures as Columns. Words are runs of anything but ASCII white space; lengths in bytes where the word lists of the rules count so."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from corpusmill.functions import lexicons as L

SPACE = r"[\x20\x09-\x0D]+"
#: An edge between a word character and another, by ASCII; the engine's own knows all letters.
EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


_BEGINS = re.compile(r"\[A-Z\]|\[a-z\]|\[0-9\]|\\d|[A-Za-z0-9]|\(\?:[A-Za-z]+(?:\|[A-Za-z]+)*\)")
_ENDS = re.compile(r"(?:\[A-Z\]|\[a-z\]|\[0-9\]|\\d)(?:\+|\{[1-9][0-9]*(?:,[0-9]*)?\})?$|(?<!\\)[A-Za-z0-9]$")


def pattern(p: str) -> str:
    """A pattern of the lexicons for the engine's regular expressions: an edge next to what is surely a word character looks to its other side only."""
    parts = p.split(r"\b")
    out = parts[0]
    for left, right in zip(parts[:-1], parts[1:], strict=True):
        edge = "(?<![0-9A-Za-z_])" if _BEGINS.match(right) else "(?![0-9A-Za-z_])" if _ENDS.search(left) else EDGE
        out += edge + right
    return out


def let(value: Column, f) -> Column:
    """f(value), with the value computed once however often f uses it: inside lambdas the engine shares no subexpressions."""
    return F.transform(F.array(value), f)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Pieces between runs of . ! ? and white space, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(text, r"[.!?]+\s+"), trimmed), lambda s: s != "")


def trimmed(text: Column) -> Column:
    # \z: the engine's $ stands before a last U+0085 or U+2028 too
    return F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def count_sentences(text: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"[.!?]+")))


def count_of(text: Column, part: str) -> Column:
    """Occurrences of a string that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def hits(tokens: Column, lexicon: list[str]) -> Column:
    """How many tokens are in a lexicon; repeated ones count each."""
    return F.size(F.filter(tokens, lambda w: w.isin(lexicon)))


def how_many(text: Column, terms: list[str]) -> Column:
    """How many of the terms a lower-cased text holds."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(t)).cast("int") for t in terms])


def total_of(tokens: Column, weights: dict[str, float]) -> Column:
    """Sum of the weights of the tokens."""
    groups: dict[float, list[str]] = {}
    for w, v in weights.items():
        groups.setdefault(v, []).append(w)
    weight = lambda w: reduce(lambda out, kv: out.when(w.isin(kv[1]), kv[0]), groups.items(), F.when(F.lit(False), 0.0)).otherwise(0.0)
    return F.aggregate(tokens, F.lit(0.0), lambda s, w: s + weight(w))


def plain_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "")


def cleaned(tokens: Column, least: int) -> Column:
    """Tokens without what is no ASCII letter, digit or underscore, of `least` characters or more."""
    return F.filter(F.transform(tokens, lambda w: F.regexp_replace(w, "[^0-9A-Za-z_]", "")), lambda w: F.length(w) >= least)


def stripped(tokens: Column, marks: str = ".,!?;:") -> Column:
    """Lower-cased tokens without the marks at their ends."""
    m = "".join(f"\\{c}" for c in marks)
    return F.transform(tokens, lambda w: F.lower(F.regexp_replace(w, f"^[{m}]+|[{m}]+$", "")))


def sorted_counts(tokens: Column) -> tuple[Column, Column]:
    """How many distinct tokens there are, and how many stand once."""
    at = lambda s: F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
    once = lambda s: F.size(F.filter(at(s), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)) & ~F.get(s, i).eqNullSafe(F.get(s, i + 1))))
    return F.size(F.array_distinct(tokens)), let(F.array_sort(tokens), once)


def mean_of(values: Column) -> Column:
    return let(values, lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double")) / F.size(x))


def variance_of(values: Column) -> Column:
    """Population variance, by Welford's running mean: the sums that SQL engines keep, so that a value at a threshold falls to the same side."""

    def step(s: Column, v: Column) -> Column:
        x = v.cast("double")
        up = lambda n, m: F.struct(n.alias("n"), m.alias("m"), (s["d"] + (x - m) * (x - s["m"])).alias("d"))
        return let(s["n"] + 1, lambda n: let(s["m"] + (x - s["m"]) / n, lambda m: up(n, m)))

    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("d"))
    return F.aggregate(values, none, step, lambda s: F.when(s["n"] > 0, s["d"] / s["n"]))


def half_up(v: Column, digits: int) -> Column:
    """A double rounded as SQL engines do, through its product with a power of ten; round() goes by its shortest decimal, which differs where that ends in 5."""
    return F.round(v.cast("double") * 10.0**digits) / 10.0**digits


def simple_language(text: Column) -> Column:
    """(lang, confidence): by script for Chinese, Arabic and Cyrillic, else with most words in its list; English at .5 where none has any, '' for no text."""
    scripts = [("zh", r"\p{IsHan}", 0.9), ("ar", r"\p{IsArabic}", 0.9), ("ru", r"\p{IsCyrillic}", 0.8)]

    def chosen(counts: Column) -> Column:
        top = F.array_max(counts)
        lang, sure = F.when(text == "", ""), F.when(text == "", 0.0)
        for name, script, confidence in scripts:
            lang, sure = lang.when(text.rlike(script), name), sure.when(text.rlike(script), confidence)
        for i, name in enumerate(L.SIMPLE_LANGUAGE):
            lang = lang.when((counts[i] == top) & (top > 0), name)
        return F.struct(lang.otherwise("en").alias("lang"), sure.when(top > 0, F.least(top / 10, F.lit(1.0))).otherwise(0.5).alias("confidence"))

    return let(words(F.lower(text)), lambda t: let(F.array(*[hits(t, v) for v in L.SIMPLE_LANGUAGE.values()]), chosen))


def sentiment_ratio(text: Column) -> Column:
    """(net, label, score, subjectivity): net weight of positive over negative words a word, its label at a tenth, the score, and subjectivity."""

    def of(x: Column) -> Column:
        n, good, bad = x["n"], x["good"], x["bad"]
        net = good - bad
        label = F.when(net > 0.1, "positive").when(net < -0.1, "negative").otherwise("neutral")
        score = F.when(n == 0, 0.5).when(F.abs(net) > 0.1, F.least(0.5 + F.abs(net), F.lit(1.0))).otherwise(1 - F.abs(net))
        return F.struct(net.alias("net"), label.alias("label"), score.alias("score"), F.least((good + bad) * 2, F.lit(1.0)).alias("subjectivity"))

    def sums(x: Column) -> Column:
        share = lambda k: F.when(x["n"] > 0, x[k] / x["n"]).otherwise(0.0)
        return F.struct(x["n"].alias("n"), share("good").alias("good"), share("bad").alias("bad"))

    return let(weighed(F.lower(text).cast("binary")), lambda x: let(sums(x), of))


_NO_WORD = bytes(c for c in range(256) if not re.match(rb"[0-9A-Za-z_]", bytes([c])))
_NO_LETTER = bytes(c for c in range(256) if not re.match(rb"[A-Za-z]", bytes([c])))
_WEIGHTS = [{w.encode(): v for w, v in x.items()} for x in (L.POSITIVE, L.NEGATIVE)]
_STOPS = re.compile(rb"[.!?]+")


@F.pandas_udf(StructType().add("n", LongType()).add("good", DoubleType()).add("bad", DoubleType()))
def weighed(low: pd.Series) -> pd.DataFrame:
    """Of a lower-cased text (bytes): its words of two characters or more, as cleaned() has them, and the weights of positive and negative ones, added up in order."""
    rows = []
    for t in low:
        words, sums = t.split(), []
        plain = {w: w.translate(None, _NO_WORD) for w in set(words)}
        for weights in _WEIGHTS:
            known, total = {w: weights[x] for w, x in plain.items() if len(x) >= 2 and x in weights}, 0.0
            # not by sum(), which compensates for rounding
            for w in filter(known.__contains__, words) if known else ():
                total += known[w]
            sums.append(total)
        rows.append((sum(len(plain[w]) >= 2 for w in words), *sums))
    return pd.DataFrame(rows, columns=["n", "good", "bad"])


def emotions(text: Column) -> Column:
    """A field for each emotion: weights of its words, ten times a word, at most 1."""
    one = lambda x, w: F.when(x["n"] > 0, F.least(total_of(x["c"], w) / x["n"] * 10, F.lit(1.0))).otherwise(0.0)
    both = lambda t: F.struct(F.size(t).alias("n"), cleaned(t, 2).alias("c"))
    return let(words(F.lower(text)), lambda t: let(both(t), lambda x: F.struct(*[one(x, w).alias(k) for k, w in L.EMOTIONS.items()])))


def topic_scores(text: Column) -> Column:
    """Array of (topic, score): share of a topic's words present times hits over the root of the number of words; topics with a word present."""

    def of(x: Column) -> Column:
        found = {k: F.size(F.array_intersect(x["there"], F.array(*[F.lit(w) for w in v]))) for k, v in L.TOPICS.items()}
        return F.filter(F.array(*[F.struct(F.lit(k).alias("topic"), (v / 10 * (v / x["n"])).alias("score")) for k, v in found.items()]), lambda r: r["score"] > 0)

    both = lambda t: F.struct(F.array_distinct(cleaned(t, 3)).alias("there"), F.sqrt(F.greatest(F.size(t), F.lit(1))).alias("n"))
    return let(words(F.lower(text)), lambda t: let(both(t), of))


def syllables(word: Column) -> Column:
    """Vowel groups of a word, less a silent e, 1 at the least."""
    w = F.lower(word)
    n = F.regexp_count(w, F.lit("[aeiouy]+"))
    return F.greatest(F.lit(1), n - F.when(w.endswith("e") & (n > 1), 1).otherwise(0))


_V, _S = "aeiouy", r"\x20\x09-\x0D"
#: Counts of words by their vowel groups, each a pattern over a whole lower-cased text: a word's start, its letters, its end.
_START, _END = f"(?<![^{_S}])", f"(?![^{_S}])"
_GROUP, _GAP = f"[{_V}]++", f"[^{_V}{_S}]++"
_NO_GROUP = f"{_START}[^{_V}{_S}]++{_END}"
_LAST_E = f"[{_V}][^{_V}{_S}]++[{_V}]*e{_END}"
_THREE = f"{_START}[^{_V}{_S}]*+{_GROUP}{_GAP}{_GROUP}{_GAP}[{_V}]"
_THREE_E = f"{_START}[^{_V}{_S}]*+{_GROUP}{_GAP}{_GROUP}{_GAP}[{_V}]*e{_END}"
_NO_VOWEL = f"{_START}[^aeiou{_S}]++{_END}"
_THREE_VOWELS = f"{_START}(?:[^aeiou{_S}]*+[aeiou]){{3}}"


def syllable_counts(text: Column, lang: Column) -> tuple[Column, Column]:
    """Syllables of all words of a text, and how many words have three or more.

    Spanish and French words have as many as single vowels, those of all other languages as syllables() says; each word has one at the
    least. They are counted by patterns over the whole text: vowel groups, less one for words of two groups or more that end in e,
    and one for each word without any."""
    low = F.lower(text)
    count = lambda p: F.regexp_count(low, F.lit(p))
    single = lang.isin("es", "fr")
    total = F.when(single, count("[aeiou]") + count(_NO_VOWEL)).otherwise(count(f"[{_V}]+") - count(_LAST_E) + count(_NO_GROUP))
    hard = F.when(single, count(_THREE_VOWELS)).otherwise(count(_THREE) - count(_THREE_E))
    return total.cast("double"), hard.cast("double")


#: Of a lower-cased word: four syllables or more, as syllables() counts them.
FOUR = f"^[^{_V}]*+(?:{_GROUP}[^{_V}]++){{3}}{_GROUP}(?:[^{_V}]|(?<!e)$)"


@F.pandas_udf(reduce(lambda t, k: t.add(k, LongType()), ["words", "sentences", "letters", "syllables", "hard"], StructType()))
def model_counts(text: pd.Series, low: pd.Series) -> pd.DataFrame:
    """Of a text and the text in lower case (bytes): words, sentences, ASCII letters, syllables, words of three or more.

    Syllables are the vowels of a word's letters, less one for a last e, 1 at the least; 0 for a word without letters."""
    rows = []
    for t, l in zip(text, low, strict=True):
        n = syllables = hard = 0
        for w, k in Counter(l.split()).items():
            x = w.translate(None, _NO_LETTER)
            y = max(1, len(x) - len(x.translate(None, b"aeiouy")) - x.endswith(b"e")) if x else 0
            n, syllables, hard = n + k, syllables + k * y, hard + k * (y >= 3)
        rows.append((n, max(1, len(_STOPS.findall(t))), len(t.translate(None, _NO_LETTER)), syllables, hard))
    return pd.DataFrame(rows, columns=["words", "sentences", "letters", "syllables", "hard"])


def grades(w: Column, s: Column, y: Column, hard: Column) -> dict[str, Column]:
    """Grade, ease and fog from words, sentences, syllables and hard words."""
    return {"kincaid": 0.39 * (w / s) + 11.8 * (y / w) - 15.59, "flesch": 206.835 - 1.015 * (w / s) - 84.6 * (y / w), "fog": 0.4 * (w / s + 100 * hard / w)}


def measures(text: Column, lang: Column) -> dict[str, Column]:
    """What scores are made of, each count once: a projection of its own, as expressions under a condition share nothing."""
    syllables, hard = syllable_counts(text, lang)
    out = {"words": count_words(text), "sentences": F.size(sentences(text)), "syllables": syllables, "hard": hard, "letters": F.regexp_count(text, F.lit(r"\p{L}")), "characters": F.octet_length(F.replace(text, F.lit(" "), F.lit("")))}
    return {k: v.cast("double") for k, v in out.items()}


def readability(m: dict[str, Column]) -> dict[str, Column]:
    """Of a text's measures(): Flesch-Kincaid, Flesch ease, Fog, SMOG (0 below 30 sentences), Coleman-Liau, automated index; 0 for a text without words."""
    w, s, hard = m["words"], m["sentences"], m["hard"]
    out = grades(w, s, m["syllables"], hard)
    out["smog"] = F.when(s >= 30, 1.043 * F.sqrt(hard * 30 / s) + 3.1291).otherwise(0.0)
    out["coleman_liau"] = 0.0588 * (m["letters"] / w * 100) - 0.296 * (s / w * 100) - 15.8
    # 4.71 as hundredths, so that the product is exact
    out["ari"] = m["characters"] * 471 / 100 / w + 0.5 * w / s - 21.43
    return {k: F.when((w > 0) & (s > 0), v).otherwise(0.0) for k, v in out.items()}


def readability_model(m: dict[str, Column]) -> dict[str, Column]:
    """The model's form, of model_counts(): vowels for syllables, its own Coleman-Liau, seconds at 200 words a minute."""
    w, s, letters, syllables, hard = (m[k].cast("double") for k in ("words", "sentences", "letters", "syllables", "hard"))
    out = grades(w, s, syllables, hard)
    out["smog"] = 1.043 * F.sqrt(hard * 30 / s) + 3.1291
    out["coleman_liau"] = 0.0588 * (letters / w) * 100 / (w / s) - 0.296 * s * 100 / w - 15.8
    return {**{k: F.when(w > 0, v).otherwise(0.0) for k, v in out.items()}, "reading_seconds": F.floor(w / 200 * 60).cast("int")}


def level(kincaid: Column) -> Column:
    return F.when(kincaid < 6, "elementary").when(kincaid < 9, "middle").when(kincaid < 13, "high").otherwise("college")


def reading_level(r: dict[str, Column]) -> Column:
    """Five levels by the mean of the scores of readability()."""
    mean = (r["kincaid"] + r["fog"] + r["coleman_liau"] + r["ari"]) / 4
    return F.when(mean <= 6, "Elementary").when(mean <= 8, "Middle School").when(mean <= 12, "High School").when(mean <= 16, "College").otherwise("Graduate")


def complexity_level(r: dict[str, Column]) -> Column:
    """Four levels by the same mean."""
    mean = (r["kincaid"] + r["fog"] + r["coleman_liau"] + r["ari"]) / 4
    return F.when(mean <= 6, "elementary").when(mean <= 9, "intermediate").when(mean <= 13, "advanced").otherwise("expert")


def content_type(text: Column) -> Column:
    """faq, technical, marketing or general: by question marks a byte, numbers a word, exclamation marks a byte."""
    size, n = F.octet_length(text), count_words(text)
    share = lambda p, of: F.coalesce(F.try_divide(F.regexp_count(text, F.lit(p)).cast("double"), of.cast("double")), F.lit(0.0))
    return F.when(share(r"\?", size) > 0.05, "faq").when(share("[0-9]+", n) > 0.1, "technical").when(share("!", size) > 0.02, "marketing").otherwise("general")


def quality(text: Column) -> dict[str, Column]:
    """Completeness, coherence and readability of a chunk by its last mark and words a sentence."""
    per = count_words(text) / count_sentences(text)
    return {
        "completeness": F.when(F.trim(text) == "", 0.0).when(F.trim(text).rlike(r"[.!?]$"), 1.0).otherwise(0.8),
        "coherence": F.when(per.between(10, 25), 0.9).when(per.between(5, 35), 0.7).otherwise(0.5),
        "readability": F.when(per <= 20, 0.8).when(per <= 30, 0.6).otherwise(0.5),
    }


def quality_semantic(text: Column) -> dict[str, Column]:
    """The semantic chunker's form: last mark, paragraphs and spread of sentence lengths, words a sentence, distinct words."""
    parts = F.filter(F.split(text, "[.!?]"), lambda s: s != "")
    sizes = F.transform(parts, lambda s: count_words(s))
    spread, n, w = variance_of(sizes), F.size(parts), words(text)
    flow = (n < 2) | ((spread > 4) & (spread < 100))
    # no quotient that fails: it is used twice, so the engine computes it before it looks at n
    per = F.try_divide(F.size(w).cast("double"), n.cast("double"))
    return {
        "completeness": F.when(trimmed(text).rlike("[.!?:]$"), 1.0).otherwise(0.7),
        "coherence": F.when(F.contains(text, F.lit("\n\n")), 0.8).otherwise(0.5) + F.when(flow, 0.1).otherwise(0.0),
        "readability": F.when((F.size(w) > 0) & (n > 0) & per.between(8, 22), 0.8).otherwise(0.5),
        "uniqueness": F.when(F.size(w) > 0, F.size(F.array_distinct(F.transform(w, F.lower))) / F.size(w)).otherwise(0.7),
    }


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def length_ratio(a: Column, b: Column) -> Column:
    """The shorter length over the longer one; 1 for two empty strings."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 1.0).otherwise(F.least(F.length(a), F.length(b)) / most)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the Levenshtein distance over the longer length."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / most)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a length differs or a vector is zero."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (n == 0), 0.0).otherwise(dot(a, b) / n)
