"""Text queries over `documents` and `pages`."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusmill.functions import entities as E
from corpusmill.functions import language as G
from corpusmill.functions import lexicons as L
from corpusmill.functions import text as T
from corpusmill.operators import chunking
from corpusmill.operators import keywords as K
from corpusmill.operators import quality as Q
from corpusmill.plans.registry import query
from corpusmill.session import table
from corpusmill.sources import html

TEXT = "coalesce(text, '')"
SPACE = "[\\x20\\x09-\\x0D]+"
LIST = lambda v: "[" + ", ".join(f"'{quoted(x)}'" for x in v) + "]"
WORDS = lambda t: f"list_filter(regexp_split_to_array({t}, '{SPACE}'), lambda w: w <> '')"
CLEAN = lambda t, least: f"list_filter(list_transform({t}, lambda w: regexp_replace(w, '[^0-9A-Za-z_]', '', 'g')), lambda w: length(w) >= {least})"
TRIM = lambda t: f"regexp_replace({t}, '^{SPACE}|{SPACE}$', '', 'g')"
STRIPPED = lambda t, marks: f"list_transform({t}, lambda w: lower(trim(w, '{marks}')))"


def quoted(x: str) -> str:
    return x.replace("'", "''")


def case(column: str, weights: dict[str, float], default: float = 0.0) -> str:
    """A CASE of the weights of a word."""
    return "case " + " ".join(f"when list_contains({LIST([w for w in weights if weights[w] == v])}, {column}) then {v}" for v in dict.fromkeys(weights.values())) + f" else {default} end"


def total(tokens: str, weights: dict[str, float]) -> str:
    return f"coalesce(list_sum(list_transform({tokens}, lambda w: {case('w', weights)})), 0)"


def docs(spark, d):
    """`documents`, null texts as empty."""
    return table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))


def rounded(columns: dict, digits: int = 6) -> list:
    """Named columns, numbers rounded."""
    return [v.alias(k) if isinstance(v, str) else (T.half_up(v, digits) if k not in ("label", "tone", "lang", "candidates", "reading_seconds") else v).alias(k) for k, v in columns.items()]


def fields(rows, digits: int = 6):
    """doc_id and the fields of r, numbers rounded."""
    return rows.select("doc_id", *[(T.half_up(F.col(f"r.{f.name}"), digits) if f.dataType.typeName() == "double" else F.col(f"r.{f.name}")).alias(f.name) for f in rows.schema["r"].dataType.fields])


_counts = ", ".join(f"len(list_filter(t, lambda w: list_contains({LIST(v)}, w))) as n_{k}" for k, v in L.SIMPLE_LANGUAGE.items())
_names = [f"n_{k}" for k in L.SIMPLE_LANGUAGE]


@query(f"""with t as (select doc_id, {TEXT} as text, {WORDS(f'lower({TEXT})')} as t from documents), c as (select doc_id, text, {_counts} from t), m as (select *, greatest({', '.join(_names)}) as top from c)
select doc_id, case when text = '' then '' when regexp_matches(text, '\\p{{Han}}') then 'zh' when regexp_matches(text, '\\p{{Arabic}}') then 'ar' when regexp_matches(text, '\\p{{Cyrillic}}') then 'ru' {' '.join(f"when n_{k} = top and top > 0 then '{k}'" for k in L.SIMPLE_LANGUAGE)} else 'en' end as lang,
case when text = '' then 0.0 when regexp_matches(text, '\\p{{Han}}|\\p{{Arabic}}') then 0.9 when regexp_matches(text, '\\p{{Cyrillic}}') then 0.8 when top > 0 then least(top / 10, 1.0) else 0.5 end as confidence from m""")
def lang_simple(spark, d):
    return docs(spark, d).select("doc_id", T.simple_language(F.col("text")).alias("l")).select("doc_id", "l.*")


_ONLY = TRIM(f"regexp_replace(regexp_replace(lower({TEXT}), '[^\\p{{L}}\\x20\\x09-\\x0D]', ' ', 'g'), '{SPACE}', ' ', 'g')")
_SHARE = lambda v: f"coalesce(len(list_filter(t, lambda w: list_contains({LIST(v)}, w))) / nullif(len(t), 0), 0)"
_SCORES = ", ".join(
    f"0.4 * {_SHARE(x['common'])} + 0.3 * {_SHARE(x['common'] + x['stop'])} + 0.2 * coalesce(({' + '.join(f'1 - abs((length(c) - length(replace(c, {chr(39)}{ch}{chr(39)}, {chr(39) * 2}))) / nullif(l, 0) - {f})' for ch, f in x['letters'].items())}) / {len(x['letters'])}, 0)"
    + (f" + 0.1 * coalesce(len(list_filter(p, lambda w: list_contains({LIST(x['pairs'])}, w))) / nullif(len(p), 0), 0)" if x["pairs"] else "")
    + f" as s_{k}"
    for k, x in L.LANGUAGE.items()
)


#: (doc_id, lang): the language found, as lang_scored says.
_FOUND = f"""with c as (select doc_id, {_ONLY} as c from documents), t as (select doc_id, c, list_filter(string_split(c, ' '), lambda w: w <> '') as t, length(replace(c, ' ', '')) as l from c),
p as (select *, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) as p from t), s as (select doc_id, c, {_SCORES} from p), m as (select *, greatest({', '.join(f's_{k}' for k in L.LANGUAGE)}) as best from s)
select doc_id, case when strlen(c) < 10 or best < 0.3 then 'unknown' {' '.join(f"when s_{k} = best then '{k}'" for k in L.LANGUAGE)} end as lang from m"""


def with_language(spark, d):
    """doc_id, text and the language found in it."""
    t = docs(spark, d).select("doc_id", "text", G.letters_only(F.col("text")).alias("c"))
    s = t.select("doc_id", "text", "c", G.language_scores(F.col("c")).alias("s"))
    return s.select("doc_id", "text", G.scored_language(F.col("s"), F.col("c"))["lang"].alias("lang"))


@query(f"""with c as (select doc_id, {_ONLY} as c from documents), t as (select doc_id, c, list_filter(string_split(c, ' '), lambda w: w <> '') as t, length(replace(c, ' ', '')) as l from c),
p as (select *, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) as p from t), s as (select doc_id, c, {_SCORES} from p), m as (select *, greatest({', '.join(f's_{k}' for k in L.LANGUAGE)}) as best from s)
select doc_id, case when strlen(c) < 10 or best < 0.3 then 'unknown' {' '.join(f"when s_{k} = best then '{k}'" for k in L.LANGUAGE)} end as lang, case when strlen(c) < 10 or best < 0.3 then 0 else round(best, 6) end as confidence,
case when strlen(c) < 10 then '' else coalesce((select string_agg(lang, ',' order by score desc, lang) from (values {', '.join(f"('{k}', round(s_{k}, 6), s_{k})" for k in L.LANGUAGE)}) v(lang, score, raw) where raw > 0.1), '') end as candidates from m""")
def lang_scored(spark, d):
    t = docs(spark, d).select("doc_id", G.letters_only(F.col("text")).alias("c"))
    s = t.select("doc_id", "c", G.language_scores(F.col("c")).alias("s"))
    return s.select("doc_id", *rounded(G.scored_language(F.col("s"), F.col("c"))))


@query(f"""with t as (select doc_id, {CLEAN(WORDS(f'lower({TEXT})'), 2)} as t from documents), n as (select doc_id, len(t) as n, {total('t', L.POSITIVE)} / nullif(len(t), 0) as g, {total('t', L.NEGATIVE)} / nullif(len(t), 0) as b from t),
s as (select doc_id, n, coalesce(g, 0) as g, coalesce(b, 0) as b, coalesce(g, 0) - coalesce(b, 0) as net from n)
select doc_id, round(net, 6) as net, case when net > 0.1 then 'positive' when net < -0.1 then 'negative' else 'neutral' end as label, round(case when n = 0 then 0.5 when abs(net) > 0.1 then least(0.5 + abs(net), 1) else 1 - abs(net) end, 6) as score, round(least((g + b) * 2, 1), 6) as subjectivity from s""")
def sentiment_ratio(spark, d):
    return fields(docs(spark, d).select("doc_id", T.sentiment_ratio(F.col("text")).alias("r")))


_IN = lambda i: f"coalesce(w[{i}], '')"
_STRONG = f"({case(_IN('i - 1'), L.INTENSIFIERS, 1.0)}) * case when list_contains({LIST(L.INTENSIFIERS)}, {_IN('i - 2')}) then 0.8 * ({case(_IN('i - 2'), L.INTENSIFIERS, 1.0)}) else 1.0 end * case when {' or '.join(f'list_contains({LIST(L.NEGATORS)}, {_IN(chr(105) + f" - {k}")})' for k in (1, 2, 3))} then -0.5 else 1.0 end"
_FACES = " union all ".join(f"select '{quoted(e)}' as e, {v} as v" for e, v in L.EMOTICONS.items())


@query(f"""with c as (select doc_id, {TRIM(f"regexp_replace(lower({TEXT}), '{SPACE}', ' ', 'g')")} as c from documents),
p as (select doc_id, list_filter(list_transform(regexp_split_to_array(c, '[.!?]+[\\x20\\x09-\\x0D]*'), lambda x: {TRIM('x')}), lambda x: x <> '') as p, c from c),
s as (select doc_id, i, (case when len(p) = 0 then [c] else p end)[i] as s from p, lateral (select unnest(range(1, (case when len(p) = 0 and c <> '' then 1 else len(p) end) + 1)) as i)),
faces as ({_FACES}), f as (select doc_id, i, avg(v) as v from s join faces on contains(s, e) group by 1, 2),
w as (select doc_id, i, {WORDS('s')} as w from s), k as (select doc_id, i as sentence, w, unnest(range(1, len(w) + 1)) as i from w),
v as (select doc_id, sentence, ({case('w[i]', L.SENTIMENT)}) * {_STRONG} as v from k union all select doc_id, i, v from f),
m as (select doc_id, sentence, greatest(-1, least(1, avg(v))) as score, least(1, avg(abs(v))) as magnitude from v where v <> 0 group by 1, 2),
o as (select s.doc_id, count(*) as n, avg(coalesce(score, 0)) as score, avg(coalesce(magnitude, 0)) as magnitude, var_pop(coalesce(score, 0)) as spread from s left join m on s.doc_id = m.doc_id and s.i = m.sentence group by 1)
select d.doc_id, coalesce(round(score, 6), 0) as score, coalesce(round(magnitude, 6), 0) as magnitude, case when score > 0.1 then 'positive' when score < -0.1 then 'negative' else 'neutral' end as label,
coalesce(round(least(1, magnitude * 0.7 + 0.3 * case when n <= 1 then 1 else 1 / (1 + spread) end), 6), 0) as confidence from documents d left join o on d.doc_id = o.doc_id""")
def sentiment_lexicon(spark, d):
    s = docs(spark, d).select("doc_id", G.sentiment_sentences(F.col("text")).alias("s"))
    return s.select("doc_id", *rounded(G.sentiment_overall(F.col("s"))))


_emotion = ", ".join(f"coalesce(round(least(1.0, {total('c', v)} / nullif(len(t), 0) * 10), 6), 0) as {k}" for k, v in L.EMOTIONS.items())


@query(f"with t as (select doc_id, {WORDS(f'lower({TEXT})')} as t from documents), c as (select doc_id, t, {CLEAN('t', 2)} as c from t) select doc_id, {_emotion} from c")
def emotion(spark, d):
    return fields(docs(spark, d).select("doc_id", T.emotions(F.col("text")).alias("r")))


_topic = " union all ".join(f"select doc_id, '{k}' as topic, len(list_intersect(c, {LIST(v)})) as k, n from c" for k, v in L.TOPICS.items())


@query(f"""with t as (select doc_id, {WORDS(f'lower({TEXT})')} as t from documents), c as (select doc_id, list_distinct({CLEAN('t', 3)}) as c, sqrt(greatest(len(t), 1)) as n from t),
s as (select doc_id, topic, k / 10 * (k / n) as score, k from ({_topic})) select doc_id, topic, round(least(score, 1), 6) as probability, score > 0.1 as kept from s where k > 0""")
def topics_dictionary(spark, d):
    r = docs(spark, d).select("doc_id", F.explode(T.topic_scores(F.col("text"))).alias("r"))
    return r.select("doc_id", "r.topic", F.round(F.least("r.score", F.lit(1.0)), 6).alias("probability"), (F.col("r.score") > 0.1).alias("kept"))


# sums over words; `y` a list of syllables
_SYL = "list_transform({w}, lambda x: greatest(1, len(regexp_extract_all(lower(x), '[aeiouy]+')) - case when ends_with(lower(x), 'e') and len(regexp_extract_all(lower(x), '[aeiouy]+')) > 1 then 1 else 0 end))"
_VOW = "list_transform(list_transform({w}, lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')), lambda x: case when x = '' then 0 when len(regexp_extract_all(x, '[aeiouy]')) - case when ends_with(x, 'e') then 1 else 0 end = 0 then 1 else len(regexp_extract_all(x, '[aeiouy]')) - case when ends_with(x, 'e') then 1 else 0 end end)"
_BY_LANG = f"case when lang in ('es', 'fr') then list_transform(t, lambda x: greatest(1, len(regexp_extract_all(lower(x), '[aeiou]')))) else {_SYL.format(w='t')} end"
SENTENCES = f"list_filter(list_transform(regexp_split_to_array(text, '[.!?]+[\\x20\\x09-\\x0D]+'), lambda x: {TRIM('x')}), lambda x: x <> '')"
_GRADES = "0.39 * (w / s) + 11.8 * (y / w) - 15.59 as kincaid, 206.835 - 1.015 * (w / s) - 84.6 * (y / w) as flesch, 0.4 * (w / s + 100 * h / w) as fog"
_ZERO = lambda names: ", ".join(f"coalesce(round({n}, 6), 0) as {n}" for n in names)


@query(f"""with found as materialized ({_FOUND}), t as (select doc_id, {TEXT} as text, found.lang from documents join found using (doc_id)), a as (select doc_id, text, lang, {WORDS('text')} as t, {SENTENCES} as p from t), b as (select doc_id, text, len(t) as n, len(p) as m, {_BY_LANG} as l from a),
c as (select doc_id, text, nullif(n, 0)::double as w, nullif(m, 0)::double as s, coalesce(list_sum(l), 0)::double as y, len(list_filter(l, lambda x: x >= 3))::double as h from b),
g as (select *, {_GRADES}, case when s >= 30 then 1.043 * sqrt(h * 30 / s) + 3.1291 else 0 end as smog, 0.0588 * (len(regexp_extract_all(text, '\\p{{L}}')) / w * 100) - 0.296 * (s / w * 100) - 15.8 as coleman_liau, 4.71 * strlen(replace(text, ' ', '')) / w + 0.5 * w / s - 21.43 as ari from c)
select doc_id, {_ZERO(['kincaid', 'flesch', 'fog', 'smog', 'coleman_liau', 'ari'])}, case when coalesce(kincaid, 0) < 6 then 'elementary' when kincaid < 9 then 'middle' when kincaid < 13 then 'high' else 'college' end as level,
case when mean <= 6 then 'Elementary' when mean <= 8 then 'Middle School' when mean <= 12 then 'High School' when mean <= 16 then 'College' else 'Graduate' end as reading_level, case when mean <= 6 then 'elementary' when mean <= 9 then 'intermediate' when mean <= 13 then 'advanced' else 'expert' end as complexity
from (select *, coalesce((kincaid + fog + coleman_liau + ari) / 4, 0) as mean from g)""")
def readability_linguistic(spark, d):
    """Scores and levels, syllables counted by the language found."""
    m = T.measures(F.col("text"), F.col("lang"))
    r = T.readability({k: F.col(k) for k in m})
    return with_language(spark, d).select("doc_id", *[v.alias(k) for k, v in m.items()]).select("doc_id", *rounded(r), T.level(r["kincaid"]).alias("level"), T.reading_level(r).alias("reading_level"), T.complexity_level(r).alias("complexity"))


@query(f"""with t as (select doc_id, {TEXT} as text from documents), a as (select doc_id, text, {WORDS('text')} as t from t), b as (select doc_id, text, len(t) as n, {_VOW.format(w='t')} as l from a),
c as (select doc_id, text, n, nullif(n, 0)::double as w, greatest(1, len(regexp_extract_all(text, '[.!?]+')))::double as s, coalesce(list_sum(l), 0)::double as y, len(list_filter(l, lambda x: x >= 3))::double as h from b),
g as (select *, {_GRADES}, 1.043 * sqrt(h * 30 / s) + 3.1291 + 0 * w as smog, 0.0588 * (len(regexp_extract_all(text, '[a-zA-Z]')) / w) * 100 / (w / s) - 0.296 * s * 100 / w - 15.8 as coleman_liau from c)
select doc_id, {', '.join(f'coalesce(round({k}, 4), 0) as {k}' for k in ['kincaid', 'flesch', 'fog', 'smog', 'coleman_liau'])}, floor(n / 200 * 60)::int as reading_seconds from g""")
def readability_ml(spark, d):
    t = docs(spark, d).select("doc_id", T.model_counts(F.col("text").cast("binary"), F.lower("text").cast("binary")).alias("c")).select("doc_id", "c.*")
    return t.select("doc_id", *rounded(T.readability_model({k: F.col(k) for k in t.columns}), 4))


_HAS = lambda terms: " + ".join(f"contains(lower(text), '{x}')::int" for x in terms)
_MANY = lambda terms: " + ".join(f"((length(lower(text)) - length(replace(lower(text), '{x}', ''))) / {len(x)})::int" for x in terms)


@query(f"""with found as materialized ({_FOUND}), t as (select doc_id, {TEXT} as text, found.lang from documents join found using (doc_id)), a as (select doc_id, text, lang, {WORDS('text')} as t, {SENTENCES} as p from t), b as (select doc_id, text, t, len(t)::double as n, len(p)::double as s, {_BY_LANG} as l from a),
u as (select doc_id, unnest({STRIPPED('t', '.,!?;:')}) as w from b), c as (select doc_id, w, count(*) as k from u group by 1, 2), v as (select doc_id, count(*) as types, count(*) filter (k = 1) as once from c group by 1),
m as (select b.doc_id, case when n > 0 and s > 0 then 1 end as ok, strlen(text) / s as sentence_bytes, n / s as sentence_words, list_sum(l) / n as word_syllables, types / n as type_token, once::double as hapax, len(list_filter(l, lambda x: x >= 3)) / n * 100 as hard_percent,
coalesce(({_HAS(L.FORMAL)}) / nullif({_HAS(L.FORMAL)} + {_HAS(L.INFORMAL)}, 0), 0.5) as formality, ({_HAS(L.ABSTRACT)}) / n as abstractness from b left join v on b.doc_id = v.doc_id)
select doc_id, {', '.join(f'coalesce(round(ok * {k}, 6), 0) as {k}' for k in ['sentence_bytes', 'sentence_words', 'word_syllables', 'type_token', 'hapax', 'hard_percent', 'formality', 'abstractness'])} from m""")
def linguistic_features(spark, d):
    m = T.measures(F.col("text"), F.col("lang"))
    r = G.linguistic(F.col("text"), {k: F.col(k) for k in (*m, "distinct", "once")})
    t = with_language(spark, d).withColumn("k", G.kinds_of_words(F.lower("text").cast("binary")))
    return t.select("doc_id", "text", "k.*", *[v.alias(k) for k, v in m.items()]).select("doc_id", *rounded(r))


_STOPS = f"case lang when 'es' then {LIST(L.ANALYSER_STOPS['es'])} when 'fr' then {LIST(L.ANALYSER_STOPS['fr'])} else {LIST(L.ANALYSER_STOPS['en'])} end"
_CONTENT = lambda least: f"list_filter(c, lambda w: not list_contains({_STOPS}, w) and strlen(w) >= {least})"


@query(f"""with found as materialized ({_FOUND}), t as (select doc_id, {TEXT} as text, found.lang from documents join found using (doc_id)), a as (select doc_id, text, lang, {WORDS('text')} as t from t), b as (select *, {STRIPPED('t', '.,!?;:')} as c, nullif(len(t), 0)::double as n from a),
u as (select doc_id, unnest({_CONTENT(4)}) as w from b), k as (select doc_id, w, count(*) as k from u group by 1, 2), r as (select doc_id, count(*) filter (k > 1) / count(*) as repeated from k group by 1),
m as (select b.doc_id, repeated, len({_CONTENT(3)}) / n as density, ({_HAS(L.ABSTRACT)} + least(10, len(list_filter(t, lambda w: strlen(trim(w, '.,!?;:')) > 8 or contains(w, '_') or regexp_matches(w, '[A-Z]{{2,}}'))))) / n * 100 as complexity,
{_MANY(L.TONE_GOOD)} as good, {_MANY(L.TONE_BAD)} as bad, {_MANY(L.SUBJECTIVE)} as own, {_MANY(L.OBJECTIVE)} as facts from b left join r on b.doc_id = r.doc_id)
select doc_id, coalesce(round(repeated, 6), 0) as repeated, coalesce(round(density, 6), 0) as density, coalesce(round(complexity, 6), 0) as complexity, case when good > bad then 'positive' when bad > good then 'negative' else 'neutral' end as tone, round(coalesce(own / nullif(own + facts, 0), 0.5), 6) as subjectivity from m""")
def semantic_features(spark, d):
    counts = G.content_counts(F.col("text").cast("binary"), F.lower("text").cast("binary"), "lang")
    t = with_language(spark, d).select("doc_id", counts.alias("c")).select("doc_id", "c.*")
    return t.select("doc_id", *rounded(G.semantic({k: F.col(k) for k in t.columns})))


_MARKS = ".,!?;:\"''()[]{}"


@query(f"""with found as materialized ({_FOUND}), w as (select doc_id, unnest({STRIPPED(WORDS(TEXT), _MARKS)}) as w from documents), c as (select doc_id, w, lang, count(*) as n from w join found using (doc_id) group by 1, 2, 3),
h as (select doc_id, string_agg(size || ':' || n, ',' order by size) as lengths from (select doc_id, strlen(w) as size, sum(n)::bigint as n from c where w <> '' group by 1, 2) group by 1),
g as (select doc_id, sum(n)::bigint as words, count(*) filter (w <> '') as distinct_words, count(*) filter (n > 3 and w <> '' and not list_contains({_STOPS}, w)) as common, count(*) filter (n = 1 and strlen(w) > 6) as rare, count(*) filter (strlen(w) > 8) as long_words from c group by 1)
select g.*, coalesce(lengths, '') as lengths from g left join h on g.doc_id = h.doc_id""".replace("select g.*, coalesce", "select g.doc_id, words, distinct_words, common, rare, long_words, coalesce"))
def vocabulary_stats(spark, d):
    """Words, distinct ones, common, rare and long ones, and a histogram of lengths in bytes as size:count."""
    t = with_language(spark, d).select("doc_id", G.vocabulary(F.lower("text").cast("binary"), "lang").alias("v"))
    return t.select("doc_id", "v.*").where("words > 0")


_KW = "list_filter(string_split(c, ' '), lambda w: strlen(w) between 3 and 50 and not list_contains({0}, w))".format(LIST(dict.fromkeys(L.KEYWORD_STOP)))
_TITLE = f"flatten(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda l: {TRIM('l')}), lambda l: strlen(l) between 1 and 99), lambda l: {WORDS('lower(l)')}))"
_ENDS = f"flatten(list_transform(list_filter(list_transform(regexp_split_to_array(lower(text), '[.!?]+'), lambda s: {WORDS('s')}), lambda x: len(x) > 0), lambda x: [x[1], x[-1]]))"


@query(f"""with t as (select doc_id, {TEXT} as text, {_ONLY} as c from documents), k as (select doc_id, unnest({_KW}) as w from t), n as (select doc_id, w, count(*) as n from k group by 1, 2),
a as (select distinct doc_id, unnest({_TITLE}) as w from t), b as (select distinct doc_id, unnest({_ENDS}) as w from t),
s as (select n.doc_id, n.w, n.n, n.n / sum(n.n) over (partition by n.doc_id) * ln(1 + greatest(0.1, 1 + case when strlen(n.w) > 8 then 0.5 when strlen(n.w) > 6 then 0.3 when strlen(n.w) > 4 then 0.1 else 0 end + case when a.w is not null then 0.3 else 0 end + case when b.w is not null then 0.2 else 0 end - case when list_contains({LIST(dict.fromkeys(L.KEYWORD_COMMON))}, n.w) then 0.3 else 0 end)) as score
  from n left join a on a.doc_id = n.doc_id and a.w = n.w left join b on b.doc_id = n.doc_id and b.w = n.w),
r as (select *, row_number() over (partition by doc_id order by round(score, 9) desc, w) as rank, max(score) over (partition by doc_id) as top from s where score >= 0.01 and replace(w, w[1], '') <> '')
select doc_id, w as keyword, n as frequency, round(score, 6) as score, round(score / top, 6) as relevance, rank from r where rank <= 10""")
def keywords_tfidf(spark, d):
    return K.keywords(docs(spark, d), "doc_id", "text", 10).select("doc_id", "keyword", "frequency", F.round("score", 6).alias("score"), F.round("relevance", 6).alias("relevance"), "rank")


@query()
def topics_cluster(spark, d):
    """Seeded and clustered topics from each document's 50 best keywords."""
    return K.topics(docs(spark, d), "doc_id", "text")


_PAIR = f"length(c[i]) > 2 and length(c[i + 1]) > 2 and not list_contains({LIST(L.PHRASE_STOP)}, c[i]) and not list_contains({LIST(L.PHRASE_STOP)}, c[i + 1])"


@query(f"""with t as (select doc_id, list_transform({WORDS(f'lower({TEXT})')}, lambda w: regexp_replace(w, '[^0-9A-Za-z_]', '', 'g')) as c from documents), i as (select doc_id, c, len(c) as words, unnest(range(1, len(c) + 1)) as i from t),
p as (select doc_id, words, c[i] as phrase from i where length(c[i]) > 2 and not list_contains({LIST(L.PHRASE_STOP)}, c[i]) union all select doc_id, words, c[i] || ' ' || c[i + 1] from i where i < words and {_PAIR}),
n as (select doc_id, words, phrase, count(*) as n from p group by all having count(*) >= 2), s as (select *, round(n * ln(words / n), 6) as score from n)
select doc_id, phrase, n, score, regexp_matches(phrase, '(tion|sion|ness|ment|ity)$') as is_noun from s qualify row_number() over (partition by doc_id order by score desc, phrase) <= 20""")
def key_phrases(spark, d):
    return K.phrases(docs(spark, d), "doc_id", "text", 20)


_BODY = f"""t as (select doc_id, {TEXT} as text from documents), f as (select doc_id, w, count(*) as f from (select doc_id, unnest({CLEAN(WORDS('lower(text)'), 3)}) as w from t) group by 1, 2),
p as (select doc_id, text, list_filter({SENTENCES}, lambda x: strlen(x) > 10) as p from t), s as (select doc_id, text, len(p) as n, i, p[i] as s from p, lateral (select unnest(range(1, len(p) + 1)) as i)),
w as (select doc_id, i, len({WORDS('s')}) as m, unnest({CLEAN(WORDS('lower(s)'), 3)}) as w from s), c as (select w.doc_id, w.i, sum(f.f) / any_value(w.m) as score from w join f on w.doc_id = f.doc_id and w.w = f.w group by 1, 2),
r as (select s.*, round(coalesce(score, 0) * case when s.i = 1 or s.i = n then 1.2 else 1.0 end, 9) as score from s left join c on s.doc_id = c.doc_id and s.i = c.i),
k as (select *, row_number() over (partition by doc_id order by score desc, i) as k from r)"""


@query(f"""with {_BODY}, g as (select doc_id, any_value(n) as n, any_value(strlen(text)) as bytes, count(*) as kept, string_agg(s, ' ' order by i) as summary from k where n = 1 or k <= greatest(1, floor(n * 0.3)) group by 1)
select doc_id, n as n_sentences, kept, summary, round(case when n = 1 then 0 else 1 - strlen(summary) / bytes end, 6) as compression from g""")
def summary_extractive(spark, d):
    """The best third of each document's sentences by the mean frequency of their words, first and last favoured, in order."""
    return K.summaries(docs(spark, d), "doc_id", "text", 0.3).withColumn("compression", F.round("compression", 6))


@query(f"""with c as (select doc_id, strlen({TEXT}) as b, len(regexp_extract_all({TEXT}, '[^\\x20\\x09-\\x0D]+')) as n, len(regexp_extract_all({TEXT}, '\\?')) as q, len(regexp_extract_all({TEXT}, '[0-9]+')) as k, len(regexp_extract_all({TEXT}, '!')) as e from documents)
select doc_id, case when q / nullif(b, 0) > 0.05 then 'faq' when k / nullif(n, 0) > 0.1 then 'technical' when e / nullif(b, 0) > 0.02 then 'marketing' else 'general' end as content_type from c""")
def content_type_text(spark, d):
    return docs(spark, d).select("doc_id", T.content_type(F.col("text")).alias("content_type"))


_PARTS = "list_filter(regexp_split_to_array(text, '[.!?]'), lambda x: x <> '')"


@query(f"""with t as (select doc_id, {TEXT} as text from documents), a as (select doc_id, text, {WORDS('text')} as w, list_transform({_PARTS}, lambda x: len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+'))) as s from t),
b as (select *, (select var_pop(x) from (select unnest(s) as x)) as spread from a)
select doc_id, case when regexp_matches({TRIM('text')}, '[.!?:]$') then 1.0 else 0.7 end as completeness, round(case when contains(text, chr(10) || chr(10)) then 0.8 else 0.5 end + case when len(s) < 2 or (spread > 4 and spread < 100) then 0.1 else 0 end, 6) as coherence,
case when len(w) > 0 and len(s) > 0 and len(w) / nullif(len(s), 0) between 8 and 22 then 0.8 else 0.5 end as readability, round(case when len(w) > 0 then len(list_distinct(list_transform(w, lambda x: lower(x)))) / nullif(len(w), 0) else 0.7 end, 6) as uniqueness from b""")
def chunk_quality_semantic(spark, d):
    return docs(spark, d).select("doc_id", *rounded(T.quality_semantic(F.col("text"))))


@query(f"""with t as (select doc_id, {TEXT} as text, {WORDS(TEXT)} as w, regexp_split_to_array({TEXT}, '[.!?]+') as s from documents),
u as (select doc_id, i, s[i] as s, {WORDS('lower(s[i])')} as w from t, lateral (select unnest(range(1, len(s) + 1)) as i)),
co as (select doc_id, stddev_pop(len(w)) / avg(len(w)) as cv from u where len(w) > 0 group by 1),
l as (select doc_id, list_sort(list_distinct(w)) as w, count(*) as n from u where strlen(s) > 10 group by 1, 2),
same as (select doc_id, sum(n) as m, sum(case when len(w) > 0 then n * (n - 1) / 2 else 0 end) as k from l group by 1),
cross_ as (select a.doc_id, sum(a.n * b.n) as k from l a join l b on a.doc_id = b.doc_id and a.w < b.w and len(a.w) >= 0.8 * len(b.w) and len(b.w) >= 0.8 * len(a.w) where len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) > 0.8 group by 1),
red as (select s.doc_id, case when m > 1 then (s.k + coalesce(c.k, 0)) / (m * (m - 1) / 2) else 0 end as redundancy from same s left join cross_ c on s.doc_id = c.doc_id),
st as (select doc_id, avg(case when len(w) between 5 and 30 then 1 else 0 end) as fit from u group by 1),
m as (select t.doc_id, text, len(s) as pieces, len(t.w) as n, case when len(s) < 2 then 1.0 else coalesce(1 - least(cv / 2, 1), 0) end as coherence,
  case when len(t.w) > 0 then 1 - least(2 * len(list_filter(t.w, lambda x: strlen(x) > 12 or greatest(1, len(regexp_extract_all(lower(x), '[aeiouy]+')) - case when ends_with(lower(x), 'e') and len(regexp_extract_all(lower(x), '[aeiouy]+')) > 1 then 1 else 0 end) > 3)) / nullif(len(t.w), 0), 1) else 0 end as clarity,
  case when strlen(text) > 100 then 0.3 else 0 end + case when strlen(text) > 500 then 0.2 else 0 end + case when contains(text, '.') then 0.2 else 0 end + case when regexp_matches(text, '[0-9]') then 0.1 else 0 end + case when regexp_matches(text, '[A-Z][a-z]+') then 0.2 else 0 end as completeness,
  coalesce(least(2 * len(list_distinct(list_transform({CLEAN('t.w', 3)}, lambda x: lower(x)))) / nullif(len(t.w), 0), 1), 0) as informativeness, coalesce(redundancy, 0) as redundancy,
  case when regexp_matches(text, '^[A-Z]') then 0.2 else 0 end + case when regexp_matches({TRIM('text')}, '[.!?]$') then 0.2 else 0 end + case when contains(text, chr(10) || chr(10)) then 0.3 else 0 end + 0.3 * fit as structure
  from t left join co using (doc_id) left join red using (doc_id) left join st using (doc_id)),
rep as (select doc_id, string_agg(w, ' ' order by w) as repeated from (select doc_id, lower(w) as w, count(*) as k, any_value(n) as n from (select doc_id, len(w) as n, unnest({CLEAN('w', 4)}) as w from t) group by 1, 2) where k > n // 10 and k > 3 group by 1)
select m.doc_id, {', '.join(f"round(case when text = '' then 0 else {k} end, 6) as {k}" for k in ['coherence', 'clarity', 'completeness', 'informativeness', 'redundancy', 'structure'])},
round(case when text = '' then 0 else (coherence + clarity + completeness + informativeness + 1 - redundancy + structure) / 6 end, 6) as overall,
case when text = '' then '' else array_to_string(list_filter([case when strlen(text) < 50 then 'too short' end, case when pieces = 1 and n > 50 then 'single long sentence' end, case when repeated is not null then 'repeats ' || repeated end, case when not regexp_matches(text, '[.!?]') then 'no punctuation' end], lambda x: x is not null), '; ') end as issues
from m left join rep on m.doc_id = rep.doc_id""")
def quality_scores(spark, d):
    q = Q.scores(docs(spark, d), "doc_id", "text")
    return q.withColumns({c: T.half_up(F.col(c), 6) for c in q.columns if c not in ("doc_id", "issues")})


@query("""with c as (select doc_id, text, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) / greatest(1, len(regexp_extract_all(text, '[.!?]+'))) as per from documents)
select doc_id, case when trim(text) = '' then 0.0 when regexp_matches(trim(text), '[.!?]$') then 1.0 else 0.8 end as completeness, case when per between 10 and 25 then 0.9 when per between 5 and 35 then 0.7 else 0.5 end as coherence, case when per <= 20 then 0.8 when per <= 30 then 0.6 else 0.5 end as readability from c""")
def chunk_quality_fixed(spark, d):
    return docs(spark, d).select("doc_id", *[v.cast("double").alias(k) for k, v in T.quality(F.col("text")).items()])


@query("""with ch as (select doc_id, unnest(regexp_split_to_array(text, '')) as c from documents), n as (select doc_id, c, count(*) as n from ch where c <> '' group by 1, 2)
select doc_id, round(-sum(n / t * log2(n / t)), 6) as bits from (select *, sum(n) over (partition by doc_id) as t from n) group by 1""")
def entropy(spark, d):
    c = docs(spark, d).select("doc_id", F.explode(F.split("text", "")).alias("c")).where("c <> ''").groupBy("doc_id", "c").agg(F.count(F.lit(1)).alias("n"))
    # sum over n/t * log2(n/t) from two sums, so that the total needs no second pass
    g = c.groupBy("doc_id").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2(F.col("n").cast("double"))).alias("s"))
    return g.select("doc_id", F.round(F.log2(F.col("t").cast("double")) - F.col("s") / F.col("t"), 6).alias("bits"))


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as l from documents)
select doc_id, case when trim(l) = '' then 'empty' when starts_with(l, '#') or (upper(l) = l and regexp_matches(l, '[A-Z]') and length(l) between 6 and 59) then 'header' when regexp_matches(l, '^([-*+] |[0-9]+\\. )') then 'list_item' when starts_with(l, '    ') or starts_with(l, '```') then 'code' else 'paragraph' end as kind, count(*) as n from l group by 1, 2""")
def line_classify(spark, d):
    return chunking.lines(docs(spark, d)).groupBy("doc_id", chunking.line_kind(F.col("line")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_META = ", ".join(f"regexp_extract(html, '<meta (?:name|property)=\"{n}\" content=\"([^\"]*)\"', 1) as {n.replace(':', '_')}" for n in ("description", "keywords", "author", "viewport", "og:title", "og:description"))


@query(f"""select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, regexp_extract(html, '<meta charset="([^"]*)"', 1) as charset, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) as lang, {_META} from pages""")
def html_metadata(spark, d):
    return table(spark, d, "pages").select("page_id", *[v.alias(k) for k, v in html.metadata(F.col("html")).items()])


@query("""select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>', ' ', 'g'), '(?s)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')) as plain from pages""")
def html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", html.strip(F.col("html")).alias("plain"))


@query("""select page_id, len(regexp_extract_all(html, '<h[1-6][^>]*>')) as headings, len(regexp_extract_all(html, '<p[^>]*>')) as paragraphs, len(regexp_extract_all(html, '<a[^>]*>')) as links, len(regexp_extract_all(html, '<img[^>]*>')) as images, regexp_matches(html, '<table') as has_table, regexp_matches(html, '<form') as has_form from pages""")
def html_structure_counts(spark, d):
    return table(spark, d, "pages").select("page_id", *[v.alias(k) for k, v in html.structure(F.col("html")).items()])


@query("""with p as (select page_id, coalesce(html, '') as html from pages), m as (select page_id, html, regexp_extract_all(html, '(?s)<((?:h[1-6]|p)[^>]*>[^<]+)</', 1) as m from p),
e as (select page_id, i - 1 as number, (case when len(m) > 0 then m else ['body>' || trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>', ' ', 'g'), '(?s)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'))] end)[i] as m from m, lateral (select unnest(range(1, greatest(len(m), 1) + 1)) as i))
select page_id, number, regexp_extract(m, '^([a-z0-9]+)', 1) as tag, trim(regexp_replace(m, '(?s)^[^>]*>', '')) as content from e""")
def html_elements(spark, d):
    return html.elements(table(spark, d, "pages").withColumn("html", F.coalesce("html", F.lit(""))), "page_id", "html")


@query()
def chunk_fixed_size(spark, d):
    return chunking.chunked(docs(spark, d), "doc_id", "text", "fixed")


@query()
def chunk_sentence(spark, d):
    return chunking.chunked(docs(spark, d), "doc_id", "text", "sentence")


@query()
def chunk_semantic(spark, d):
    return chunking.chunked(docs(spark, d), "doc_id", "text", "semantic")


@query()
def chunk_adaptive(spark, d):
    return chunking.chunked(docs(spark, d), "doc_id", "text", "adaptive")


@query("""with c as (select o_orderstatus::varchar as v, 'o_orderstatus' as col from orders union all select o_orderpriority::varchar, 'o_orderpriority' from orders union all select o_custkey::varchar, 'o_custkey' from orders)
select col as name, count(*) filter (trim(v) <> '') as filled, count(distinct v) as distinct_values, round(100.0 * count(*) filter (v is null or trim(v) = '') / count(*), 6) as null_percent,
case when count(*) filter (try_cast(v as bigint) is not null) >= 0.8 * count(*) filter (trim(v) <> '') then 'integer' when count(*) filter (try_cast(v as double) is not null) >= 0.8 * count(*) filter (trim(v) <> '') then 'float' else 'string' end as kind from c group by 1""")
def column_profile(spark, d):
    from corpusmill.sources.files import profile

    return profile(table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_custkey")).drop("top")


@query("""with c as (select unnest([struct_pack(name := 'l_returnflag', v := l_returnflag::varchar), struct_pack(name := 'l_linestatus', v := l_linestatus::varchar), struct_pack(name := 'l_linenumber', v := l_linenumber::varchar), struct_pack(name := 'l_suppkey', v := l_suppkey::varchar), struct_pack(name := 'l_partkey', v := l_partkey::varchar)], recursive := true) from lineitem),
n as (select name, v, count(*) as n from c where trim(v) <> '' group by 1, 2), r as (select *, row_number() over (partition by name order by n desc, v) as k from n) select name, string_agg(v, '|' order by k) as top from r where k <= 5 group by 1""")
def column_top_values(spark, d):
    """The five most frequent values of columns, with their order."""
    from corpusmill.sources.files import profile

    return profile(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey", "l_partkey")).select("name", "top")


_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_CELLS = " union all ".join(f"select '{c}' as name, {c}::varchar as v from customer" for c in _COLS)


@query(f"""with c as materialized ({_CELLS}) select name, count(*) filter (trim(v) <> '') as filled, count(distinct v) as distinct_values, round(100.0 * count(*) filter (v is null or trim(v) = '') / count(*), 6) as null_percent,
case when count(*) filter (try_cast(v as bigint) is not null and not contains(v, '.')) >= 0.8 * count(*) filter (trim(v) <> '') then 'integer' when count(*) filter (try_cast(v as double) is not null) >= 0.8 * count(*) filter (trim(v) <> '') then 'float' else 'string' end as kind from c group by 1""")
def csv_type_inference(spark, d):
    """`customer` written as CSV, read as text and its columns profiled."""
    from corpusmill.sources.files import profile, read_csv
    from corpusmill.streaming.jobs import shared

    path = f"{shared(spark)}/csv-{uuid.uuid4().hex}"
    table(spark, d, "customer").write.csv(path, header=True)
    return profile(read_csv(spark, path)).drop("top")


@query("""with f as (select o_custkey as k, o_orderkey as id, o_orderstatus as s, o_totalprice as p, row_number() over (partition by o_custkey order by o_orderkey) - 1 as i from orders where o_orderkey is not null)
select k || ':row:' || i // 5 as chunk_id, count(*) as n, '[' || string_agg('{"o_orderkey":' || id || ',"o_orderstatus":"' || s || '"}', ',' order by i) || ']' as data from f group by 1""")
def chunk_row_records(spark, d):
    """Orders of each customer in batches of five, as JSON records."""
    return chunking.row_batches(table(spark, d, "orders"), "o_custkey", ["o_orderkey"], 5, ["o_orderkey", "o_orderstatus"]).select("chunk_id", "n", "data")


@query("""with f as (select o_custkey as k, o_orderkey as id, o_orderstatus as s, row_number() over (partition by o_custkey order by o_orderkey) - 1 as i, max(strlen(o_orderkey::varchar) + strlen(o_orderstatus) + 43) over (partition by o_custkey) as w from orders)
select k || ':row:' || i // greatest(1, least(5, 150 // w)) as chunk_id, count(*) as n, sum(strlen(id::varchar) + strlen(s) + 43)::bigint as bytes, '{"headers":["o_orderkey","o_orderstatus"],"rows":[' || string_agg('["' || id || '","' || s || '"]', ',' order by i) || ']}' as data from f group by 1""")
def chunk_row_table(spark, d):
    """As tables, of 150 bytes at the most."""
    return chunking.row_batches(table(spark, d, "orders"), "o_custkey", ["o_orderkey"], 5, ["o_orderkey", "o_orderstatus"], "table", 150)


@query("""with c as (select c_nationkey, c_custkey, c_name, case when c_custkey % 10 = 0 then '' else c_mktsegment end as seg, case when c_custkey % 7 = 0 then 'x' else c_acctbal::varchar end as bal from customer),
f as (select c_nationkey, arg_min(case when try_cast(bal as double) is not null then 'number' else 'text' end, c_custkey) as b, arg_min(case when try_cast(c_name as double) is not null then 'number' else 'text' end, c_custkey) as n, arg_min(case when try_cast(seg as double) is not null then 'number' else 'text' end, c_custkey) as s from c group by 1)
select c.c_nationkey, round(sum((c_name <> '')::int + (seg <> '')::int + (bal <> '')::int) / (3 * count(*)), 6) as completeness,
round(greatest(0, 1 - 0.1 * sum((case when try_cast(bal as double) is not null then 'number' else 'text' end <> b)::int + (case when try_cast(c_name as double) is not null then 'number' else 'text' end <> n)::int + (case when try_cast(seg as double) is not null then 'number' else 'text' end <> s)::int)), 6) as coherence, case when count(*) > 1 then round(count(distinct c_name || '|' || seg || '|' || bal) / count(*), 6) else 1 end::double as uniqueness from c join f on c.c_nationkey = f.c_nationkey group by 1""")
def chunk_quality_structured(spark, d):
    """Quality of each nation's customers as one batch of rows."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select("c_nationkey", k, "c_name", F.when(k % 10 == 0, "").otherwise(F.col("c_mktsegment")).alias("seg"), F.when(k % 7 == 0, "x").otherwise(F.col("c_acctbal").cast("string")).alias("bal"))
    return Q.structured(c, "c_nationkey", ["c_name", "seg", "bal"], "c_custkey").withColumns({x: F.round(x, 6) for x in ("completeness", "coherence", "uniqueness")})


@query("select doc_id from (select doc_id, case when trim(text) = '' then 0.0 when regexp_matches(trim(text), '[.!?]$') then 1.0 else 0.8 end as c from documents) where c >= 0.3")
def quality_filter(spark, d):
    """Texts whose completeness is .3 or more."""
    return docs(spark, d).where(T.quality(F.col("text"))["completeness"] >= 0.3).select("doc_id")


@query("""select extension, case when extension in ('txt', 'text', 'md', 'markdown', 'log') then 'semantic_text' when extension in ('csv', 'tsv') then 'row_based_structured' else 'adaptive_hybrid' end as strategy from (select distinct (['txt', 'md', 'csv', 'json', 'bin'])[(doc_id % 5 + 1)::int] as extension from documents)""")
def strategy_choice(spark, d):
    from corpusmill.functions.content import strategy_of_file

    names = F.array(*[F.lit(x) for x in ("txt", "md", "csv", "json", "bin")])
    e = docs(spark, d).select(F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int")).alias("extension")).distinct()
    return e.select("extension", strategy_of_file(F.col("extension")).alias("strategy"))


@query("""with o as (select o_orderkey, o_custkey, o_orderstatus, o_orderpriority from orders) select o_orderkey, 'id' as name, o_orderkey::varchar as value from o union all select o_orderkey, 'who.customer', o_custkey::varchar from o union all select o_orderkey, 'who.state.status', o_orderstatus from o union all select o_orderkey, 'tags[0]', o_orderpriority from o union all select o_orderkey, 'tags[1]', o_orderstatus from o""")
def json_flatten(spark, d):
    """Nested JSON of orders with one row a leaf; the key `hidden` is skipped."""
    from corpusmill.sources import json as J

    return J.flattened(nested_orders(spark, d), "o_orderkey", "j", arrays=True, skip=["hidden"])


def nested_orders(spark, d):
    inner = F.struct(F.col("o_custkey").alias("customer"), F.struct(F.col("o_orderstatus").alias("status")).alias("state"))
    return table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("id"), inner.alias("who"), F.array("o_orderpriority", "o_orderstatus").alias("tags"), F.struct(F.lit(1).alias("x")).alias("hidden"))).alias("j"))


@query("select o_orderkey, 3::int as depth from orders")
def json_depth(spark, d):
    from corpusmill.sources import json as J

    return nested_orders(spark, d).select("o_orderkey", J.depth(F.col("j")).alias("depth"))


@query("select o_orderkey, 'who.customer' as name, o_custkey::varchar as value from orders union all select o_orderkey, 'who.state.status', o_orderstatus from orders")
def json_projection(spark, d):
    from corpusmill.sources import json as J

    return J.projected(J.flattened(nested_orders(spark, d), "o_orderkey", "j"), ["who"], "convert_empty")


_BLOCKS = " + ".join(f"len(regexp_extract_all(coalesce(html, ''), '<{b}[^>]*>'))" for b in html.BLOCKS)


@query(f"select page_id, {_BLOCKS} as n from pages")
def html_element_count(spark, d):
    return table(spark, d, "pages").select("page_id", html.blocks(F.coalesce("html", F.lit(""))).alias("n"))
