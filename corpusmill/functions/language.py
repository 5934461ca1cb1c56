"""Scored language detection, sentence-level sentiment, and linguistic and semantic features, as Columns."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from corpusmill.functions import lexicons as L
from corpusmill.functions import text as T


def letters_only(text: Column) -> Column:
    """Lower case, what is no letter as a space, one space between words."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


_LETTERS = sorted({c for y in L.LANGUAGE.values() for c in y["letters"]})
_TERMS = [(f"{k}_{lang}", [w.encode() for w in dict.fromkeys(y[k])]) for lang, y in L.LANGUAGE.items() for k in ("common", "stop") if y[k]]
#: With their spaces doubled, so that pairs which share a word are told apart.
_PAIRS = [(f"pairs_{lang}", [b" " + w.encode().replace(b" ", b"  ") + b" " for w in dict.fromkeys(y["pairs"])]) for lang, y in L.LANGUAGE.items() if y["pairs"]]


def _longs(names: list[str]) -> StructType:
    return reduce(lambda t, n: t.add(n, LongType()), names, StructType())


@F.pandas_udf(_longs(["n", "letters", *[f"c_{c}" for c in _LETTERS], *[n for n, _ in _TERMS + _PAIRS]]))
def language_counts(clean: pd.Series) -> pd.DataFrame:
    """Of the UTF-8 bytes of texts of letters only: words, letters, each of the letters whose share tells, and how often the words and pairs of each language stand."""
    rows = []
    for t in clean:
        words, wide = Counter(t.split(b" ")) if t else {}, b"  " + t.replace(b" ", b"  ") + b"  "
        of = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
        row = [sum(words.values()), of[:32].sum() + of[33:128].sum() + of[192:].sum(), *[of[ord(c)] for c in _LETTERS]]
        row += [sum(words.get(w, 0) for w in ws) for _, ws in _TERMS]
        rows.append(row + [sum(map(wide.count, ws)) for _, ws in _PAIRS])
    return pd.DataFrame(rows, columns=["n", "letters", *[f"c_{c}" for c in _LETTERS], *[n for n, _ in _TERMS + _PAIRS]], dtype="int64")


def language_scores(clean: Column) -> Column:
    """Array of (score, lang) of a text of letters only: .4 common words + .3 stop words + .2 letter shares + .1 word pairs.

    What is counted is counted once over the whole text, by language_counts()."""

    def of(x: Column) -> Column:
        rows, n = [], x["n"]
        for lang, y in L.LANGUAGE.items():
            alike = reduce(lambda a, b: a + b, [1 - F.abs(x[f"c_{c}"] / x["letters"].cast("double") - f) for c, f in y["letters"].items()]) / len(y["letters"])
            common, stop = (F.when(n > 0, v / n).otherwise(0.0) for v in (x[f"common_{lang}"], x[f"common_{lang}"] + x[f"stop_{lang}"]))
            paired = F.when(n > 1, x[f"pairs_{lang}"] / (n - 1)).otherwise(0.0) if y["pairs"] else F.lit(0.0)
            score = 0.4 * common + 0.3 * stop + 0.2 * F.when(x["letters"] > 0, alike).otherwise(0.0) + 0.1 * paired
            rows.append(F.struct(score.alias("score"), F.lit(lang).alias("lang")))
        return F.array(*rows)

    return T.let(language_counts(clean.cast("binary")), of)


def scored_language(scores: Column, clean: Column) -> dict[str, Column]:
    """lang, confidence and candidates from language_scores(): unknown below .3 or for less than ten bytes; candidates are above .1, the best first."""
    enough = F.octet_length(clean) >= 10
    best = F.aggregate(scores, F.struct(F.lit(0.0).alias("score"), F.lit("unknown").alias("lang")), lambda a, b: F.when(b["score"] > a["score"], b).otherwise(a))
    sure = enough & (best["score"] >= 0.3)
    # the best first; of equal scores, as rounded, the language that comes first by name
    order = F.array_sort(F.transform(F.filter(scores, lambda s: s["score"] > 0.1), lambda s: F.struct((-F.round(s["score"], 6)).alias("k"), s["lang"].alias("lang"))))
    names = F.array_join(F.transform(order, lambda s: s["lang"]), ",")
    return {"lang": F.when(sure, best["lang"]).otherwise("unknown"), "confidence": F.when(sure, best["score"]).otherwise(0.0), "candidates": F.when(enough, names).otherwise("")}


def _case(word: Column, weights: dict[str, float], default: float) -> Column:
    groups: dict[float, list[str]] = {}
    for w, v in weights.items():
        groups.setdefault(v, []).append(w)
    return reduce(lambda out, kv: out.when(word.isin(kv[1]), kv[0]), groups.items(), F.when(F.lit(False), default)).otherwise(default)


def _sentence_score(s: Column) -> Column:
    """(score, magnitude) of a sentence: mean of its scored words, intensified by the two words before and flipped by a negator in the three before."""
    marks = [(F.contains(s, F.lit(e)).cast("int"), v) for e, v in L.EMOTICONS.items()]
    n = reduce(lambda a, b: a + b, [m for m, _ in marks])
    # weights are decimals: sums in hundredths and products at eight digits are exact
    face = F.when(n > 0, F.round(reduce(lambda a, b: a + b, [m * v for m, v in marks]) * 100) / (n * 100)).otherwise(0.0)

    def scores(w: Column) -> Column:
        at = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))
        before = lambda i, k: F.coalesce(F.get(w, i - k), F.lit(""))

        def of(i: Column) -> Column:
            own = _case(F.get(w, i), L.SENTIMENT, 0.0)
            strong = _case(before(i, 1), L.INTENSIFIERS, 1.0) * F.when(before(i, 2).isin(list(L.INTENSIFIERS)), _case(before(i, 2), L.INTENSIFIERS, 1.0) * 0.8).otherwise(1.0)
            negated = reduce(lambda a, b: a | b, [before(i, k).isin(L.NEGATORS) for k in (1, 2, 3)])
            return F.when(F.get(w, i).isin(list(L.SENTIMENT)), F.round(own * strong * F.when(negated, -0.5).otherwise(1.0), 8)).otherwise(0.0)

        return F.filter(F.concat(F.transform(at, of), F.array(face)), lambda v: v != 0)

    def summed(scored: Column) -> Column:
        mean = lambda f: F.when(F.size(scored) > 0, F.aggregate(scored, F.lit(0.0), lambda a, v: a + f(v)) / F.size(scored)).otherwise(0.0)
        return F.struct(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), mean(lambda v: v))).alias("score"), F.least(F.lit(1.0), mean(F.abs)).alias("magnitude"))

    return T.let(T.words(s), lambda w: T.let(scores(w), summed))


def sentiment_sentences(text: Column) -> Column:
    """Array of (score, magnitude), one for each sentence of a text; the whole text where no sentence stands."""
    clean = T.trimmed(F.regexp_replace(F.lower(text), T.SPACE, " "))
    s = F.filter(F.transform(F.split(clean, r"[.!?]+\s*"), T.trimmed), lambda x: x != "")
    s = F.when((F.size(s) == 0) & (clean != ""), F.array(clean)).otherwise(s)
    return F.transform(s, _sentence_score)


def sentiment_overall(s: Column) -> dict[str, Column]:
    """score, magnitude, label and confidence over the sentences: .7 of the magnitude and .3 of how alike they are."""
    scores, sizes = F.transform(s, lambda x: x["score"]), F.transform(s, lambda x: x["magnitude"])
    n = F.size(s)
    score, magnitude = (F.when(n > 0, T.mean_of(x)).otherwise(0.0) for x in (scores, sizes))
    alike = F.when(n <= 1, 1.0).otherwise(1 / (1 + T.variance_of(scores)))
    label = F.when(score > 0.1, "positive").when(score < -0.1, "negative").otherwise("neutral")
    return {"score": score, "magnitude": magnitude, "label": label, "confidence": F.when(n > 0, F.least(F.lit(1.0), magnitude * 0.7 + alike * 0.3)).otherwise(0.0)}


def linguistic(text: Column, m: dict[str, Column]) -> dict[str, Column]:
    """Of a text, its measures() and, among them, the fields of kinds_of_words(): lengths, diversity, words that stand once, hard words, formality and abstractness; 0 for a text without words."""
    n, s, syllables, hard = m["words"], m["sentences"], m["syllables"], m["hard"]
    distinct, once = m["distinct"], m["once"]
    low = F.lower(text)
    formal, informal = T.how_many(low, L.FORMAL), T.how_many(low, L.INFORMAL)
    out = {
        "sentence_bytes": F.octet_length(text) / s,
        "sentence_words": n / s,
        "word_syllables": syllables / n,
        "type_token": distinct / n,
        "hapax": once.cast("double"),
        "hard_percent": hard / n * 100,
        "formality": F.when(formal + informal == 0, 0.5).otherwise(F.try_divide(formal.cast("double"), formal + informal)),
        "abstractness": T.how_many(low, L.ABSTRACT) / n,
    }
    return {k: F.when((n > 0) & (s > 0), v).otherwise(0.0) for k, v in out.items()}


def stop_words(lang: Column) -> Column:
    """The analyser's stop words of a language; English ones for all that have none of their own."""
    own = lambda words: F.array(*[F.lit(w) for w in words])
    return reduce(lambda out, kv: out.when(lang == kv[0], own(kv[1])), [kv for kv in L.ANALYSER_STOPS.items() if kv[0] != "en"], F.when(F.lit(False), own([""]))).otherwise(own(L.ANALYSER_STOPS["en"]))


def _spoken(low: bytes, marks: bytes) -> Counter:
    """How often the words of a lower-cased text stand, without the marks at their ends. Bytes split at ASCII white space."""
    out = Counter()
    for w, n in Counter(low.split()).items():
        out[w.strip(marks)] += n
    return out


_MARKS, _ALL_MARKS = b".,!?;:", b".,!?;:\"'()[]{}"
_STOPS = {lang: frozenset(w.encode() for w in words) for lang, words in L.ANALYSER_STOPS.items()}
_CAPITALS = re.compile(rb"[A-Z]{2}")


@F.pandas_udf(_longs(["distinct", "once"]))
def kinds_of_words(low: pd.Series) -> pd.DataFrame:
    """How many distinct words a lower-cased text (bytes) has, and how many stand once."""
    found = [_spoken(t, _MARKS).values() for t in low]
    return pd.DataFrame([(len(c), sum(n == 1 for n in c)) for c in found], columns=["distinct", "once"], dtype="int64")


_TONES = {k: [w.encode() for w in v] for k, v in {"good": L.TONE_GOOD, "bad": L.TONE_BAD, "own": L.SUBJECTIVE, "facts": L.OBJECTIVE}.items()}
_CONTENT = ["words", "distinct", "once", "content", "technical", "abstract", *_TONES]


@F.pandas_udf(_longs(_CONTENT))
def content_counts(text: pd.Series, low: pd.Series, lang: pd.Series) -> pd.DataFrame:
    """Of a text and the text in lower case (bytes) and its language: words; distinct content words of four bytes or more and those that stand once; content
    words of three or more; technical terms; kinds of abstract words; and how often words of each tone stand."""
    abstract, rows = [w.encode() for w in L.ABSTRACT], []
    for t, l, name in zip(text, low, lang, strict=True):
        stops = _STOPS.get(name, _STOPS["en"])
        w = Counter(t.split())
        c = {x: n for x, n in _spoken(l, _MARKS).items() if len(x) >= 3 and x not in stops}
        four = [n for x, n in c.items() if len(x) >= 4]
        technical = sum(n for x, n in w.items() if len(x.strip(_MARKS)) > 8 or b"_" in x or _CAPITALS.search(x))
        rows.append([w.total(), len(four), four.count(1), sum(c.values()), technical, sum(x in l for x in abstract), *[sum(map(l.count, v)) for v in _TONES.values()]])
    return pd.DataFrame(rows, columns=_CONTENT, dtype="int64")


def semantic(c: dict[str, Column]) -> dict[str, Column]:
    """Of content_counts(): repeated content words, content density, abstract words and technical terms a hundred words, tone, subjectivity; 0 where there are no words."""
    n, distinct, good, bad, own, facts = (c[k] for k in ("words", "distinct", "good", "bad", "own", "facts"))
    zero = lambda v: F.when(n > 0, v).otherwise(0.0)
    return {
        "repeated": F.when(distinct > 0, (distinct - c["once"]) / distinct).otherwise(0.0),
        "density": zero(c["content"] / n),
        "complexity": zero((c["abstract"] + F.least(c["technical"], F.lit(10))) / n * 100),
        "tone": F.when(good > bad, "positive").when(bad > good, "negative").otherwise("neutral"),
        "subjectivity": F.when(own + facts == 0, 0.5).otherwise(F.try_divide(own.cast("double"), own + facts)),
    }


_VOCABULARY = ["words", "distinct_words", "common", "rare", "long_words"]


@F.pandas_udf(_longs(_VOCABULARY).add("lengths", StringType()))
def vocabulary(low: pd.Series, lang: pd.Series) -> pd.DataFrame:
    """Of a lower-cased text (bytes) and its language: words, distinct ones, common, rare and long ones, and a histogram of lengths in bytes as size:count."""
    rows = []
    for t, name in zip(low, lang, strict=True):
        c = _spoken(t, _ALL_MARKS)
        total = c.total()
        c.pop(b"", None)
        stops, bars = _STOPS.get(name, _STOPS["en"]), Counter()
        for w, n in c.items():
            bars[len(w)] += n
        common = sum(n > 3 and w not in stops for w, n in c.items())
        rare = sum(n == 1 and len(w) > 6 for w, n in c.items())
        rows.append((total, len(c), common, rare, sum(len(w) > 8 for w in c), ",".join(f"{k}:{n}" for k, n in sorted(bars.items()))))
    return pd.DataFrame(rows, columns=[*_VOCABULARY, "lengths"])
