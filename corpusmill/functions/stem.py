"""The Snowball stemmer of English (Porter2) as column expressions: each step is one CASE over the word as the step before left it.

The expressions are of a dialect that Spark and other SQL engines share, so that a check can run the same rules elsewhere.
Letters beyond a-z count as consonants; words hold no apostrophes, as texts are cut at them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The rules of the published algorithm.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
STAYS = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
DOUBLES = ["bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"]
STEP_2 = {"ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less", "tional": "tion", "alism": "al", "aliti": "al", "ation": "ate", "entli": "ent", "fulli": "ful", "iviti": "ive", "ousli": "ous", "abli": "able", "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble", "ogi": "og", "li": ""}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]
#: Words that full-text search passes over in English.
STOP = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those "
    "am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

_VOWEL, _REGION = "[aeiouy]", "^[^aeiouy]*[aeiouy]+[^aeiouy]"
_SHORT = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


def _less(n: int) -> str:
    return f"substr(w, 1, length(w) - {n})"


def _has(value: str, pattern: str) -> str:
    return f"regexp_extract({value}, '{pattern}', 0) <> ''"


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _suffixes(rules: dict[str, str], region: str, also: dict[str, str]) -> str:
    """A CASE that takes the longest of the suffixes and, where it begins within the region and `also` holds, puts its replacement for it."""
    out = "case"
    for s, to in sorted(rules.items(), key=lambda kv: -len(kv[0])):
        where = f"length(w) - {len(s)} >= {region}" + (f" and {also[s]}" if s in also else "")
        out += f" when right(w, {len(s)}) = '{s}' then case when {where} then {_less(len(s))} || '{to}' else w end"
    return out + " else w end"


def _before(n: int, letters: str) -> str:
    """The letter before the last n is one of these."""
    return f"substr(w, length(w) - {n}, 1) in ({_quoted(letters)})"


def _steps() -> list[tuple[str, str]]:
    """(column, expression) in order: `w` is the word as it stands, `r1` and `r2` where its regions begin, `cut` whether step 1b took a suffix off."""
    marked = "w"
    for v in "aeiouy":
        marked = f"replace({marked}, '{v}y', '{v}Y')"
    region = lambda of, start: f"case when {_has(of, _REGION)} then {start} + length(regexp_extract({of}, '{_REGION}', 0)) else length(w) end"
    gone = "".join(f" when right(w, {len(s)}) = '{s}' and {_has(_less(len(s)), _VOWEL)} then {_less(len(s))}" for s in ("ingly", "edly"))
    gone_too = "".join(f" when right(w, {len(s)}) = '{s}' and {_has(_less(len(s)), _VOWEL)} then {_less(len(s))}" for s in ("ing", "ed"))
    eed = f" when right(w, 3) = 'eed' then case when length(w) - 3 >= r1 then {_less(1)} else w end"
    return [
        ("w", f"case when left(w, 1) = 'y' then 'Y' || substr({marked}, 2) else {marked} end"),
        ("r1", f"case when left(w, 5) in ('gener', 'arsen') then 5 when left(w, 6) = 'commun' then 6 else {region('w', '0')} end"),
        ("r2", region("substr(w, r1 + 1)", "r1")),
        ("w", f"case when right(w, 4) = 'sses' then {_less(2)} when right(w, 3) in ('ied', 'ies') then case when length(w) > 4 then {_less(2)} else {_less(1)} end when right(w, 2) in ('us', 'ss') then w when right(w, 1) = 's' and {_has(_less(2), _VOWEL)} then {_less(1)} else w end"),
        ("stays", f"w in ({_quoted(STAYS)})"),
        ("had", "w"),
        ("w", f"case when right(w, 5) = 'eedly' then case when length(w) - 5 >= r1 then {_less(3)} else w end{gone}{eed}{gone_too} else w end"),
        ("cut", "length(had) > length(w) and right(had, 3) <> 'eed' and right(had, 5) <> 'eedly'"),
        ("w", f"case when not cut then w when right(w, 2) in ('at', 'bl', 'iz') then w || 'e' when right(w, 2) in ({_quoted(DOUBLES)}) then {_less(1)} when r1 >= length(w) and {_has('w', _SHORT)} then w || 'e' else w end"),
        ("w", f"case when right(w, 1) in ('y', 'Y') and length(w) > 2 and not {_before(1, 'aeiouy')} then {_less(1)} || 'i' else w end"),
        ("w", _suffixes(STEP_2, "r1", {"ogi": _before(3, "l"), "li": _before(2, "cdeghkmnrt")})),
        ("w", _suffixes(STEP_3, "r1", {"ative": "length(w) - 5 >= r2"})),
        ("w", _suffixes(dict.fromkeys(STEP_4, ""), "r2", {"ion": _before(3, "st")})),
        ("w", f"case when right(w, 1) = 'e' and (length(w) - 1 >= r2 or length(w) - 1 >= r1 and not {_has(_less(1), _SHORT)}) then {_less(1)} when right(w, 2) = 'll' and length(w) - 1 >= r2 then {_less(1)} else w end"),
    ]


def _last(word: str) -> str:
    special = " ".join(f"when {word} = '{a}' then '{b}'" for a, b in SPECIAL.items())
    return f"case {special} when length({word}) <= 2 then {word} when stays then had else replace(w, 'Y', 'y') end"


def stemmed(df: DataFrame, word: str, out: str) -> DataFrame:
    """df with the stem of a column of lower-cased words; the stem of null is null.

    The value of each step goes through explode_outer() of one element: projections that follow each other would be merged, and
    their constraints inferred, with every step written out as often as later ones name it."""
    kept = [f"`{c}`" for c in df.columns]
    have, df = ["w"], df.selectExpr(*kept, f"`{word}` as w")
    for name, e in _steps():
        have = [x for x in have if x != name]
        df = df.selectExpr(*kept, *have, f"explode_outer(array({e})) as {name}")
        have.append(name)
    return df.selectExpr(*kept, f"{_last(f'`{word}`')} as `{out}`")


_RE_REGION, _RE_VOWEL, _RE_SHORT = re.compile(_REGION), re.compile(_VOWEL), re.compile(_SHORT[:-1] + r"\Z")
_LONGEST_2, _LONGEST_3 = (sorted(x.items(), key=lambda kv: -len(kv[0])) for x in (STEP_2, STEP_3))
_LONGEST_4 = sorted(STEP_4, key=lambda s: -len(s))


def stem(word: str) -> str:
    """The stem of a lower-cased word by the same steps, for code that has the words at hand."""
    if word in SPECIAL:
        return SPECIAL[word]
    if len(word) <= 2:
        return word
    w = word
    for v in "aeiouy":
        w = w.replace(f"{v}y", f"{v}Y")
    if w[0] == "y":
        w = "Y" + w[1:]
    region = lambda x, start: start + m.end() if (m := _RE_REGION.match(x)) else len(w)
    r1 = 5 if w[:5] in ("gener", "arsen") else 6 if w[:6] == "commun" else region(w, 0)
    r2 = region(w[r1:], r1)
    has = lambda x: _RE_VOWEL.search(x) is not None
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif not w.endswith(("us", "ss")) and w.endswith("s") and has(w[:-2]):
        w = w[:-1]
    if w in STAYS:
        return w
    # 1b
    had = w
    if w.endswith("eedly"):
        w = w[:-3] if len(w) - 5 >= r1 else w
    else:
        for s in ("ingly", "edly", "eed", "ing", "ed"):
            if s == "eed" and w.endswith(s):
                w = w[:-1] if len(w) - 3 >= r1 else w
                break
            if s != "eed" and w.endswith(s) and has(w[: -len(s)]):
                w = w[: -len(s)]
                break
    if len(had) > len(w) and not had.endswith(("eed", "eedly")):
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in DOUBLES:
            w = w[:-1]
        elif r1 >= len(w) and _RE_SHORT.search(w):
            w += "e"
    # 1c
    if w[-1:] in ("y", "Y") and len(w) > 2 and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    for rules, within in ((_LONGEST_2, {"ogi": lambda: w[-4:-3] == "l", "li": lambda: w[-3:-2] in tuple("cdeghkmnrt")}), (_LONGEST_3, {"ative": lambda: len(w) - 5 >= r2})):
        for s, to in rules:
            if w.endswith(s):
                if len(w) - len(s) >= r1 and (s not in within or within[s]()):
                    w = w[: -len(s)] + to
                break
    for s in _LONGEST_4:
        if w.endswith(s):
            if len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: -len(s)]
            break
    # 5
    n = len(w) - 1
    if w.endswith("e") and (n >= r2 or n >= r1 and not _RE_SHORT.search(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and n >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


def stem_sql(relation: str, word: str, out: str) -> str:
    """A query over a relation with the same steps: all its columns and the stem."""
    q = f"select *, {word} as w from {relation}"
    have = {"w"}
    for name, e in _steps():
        q = f"select * replace ({e} as {name}) from ({q})" if name in have else f"select *, {e} as {name} from ({q})"
        have.add(name)
    return f"select * exclude ({', '.join(sorted(have))}), {_last(word)} as {out} from ({q})"
