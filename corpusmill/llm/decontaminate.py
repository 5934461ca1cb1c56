"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question with other parameters has the same template. Five-word template
windows of the texts meet those of the benchmark in a hash join; of candidates all windows are compared, and the values that
stand in the same slots must map one benchmark value to one value of the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import written

WINDOW = 5
#: A text leaks an item that has two thirds of its windows in it, wherever they stand; so texts are probed at every word.
SHARE, CONSISTENT = 2 / 3, 0.8
UNITS = "km|kg|cm|mm|ml|mg|lb|oz|usd|eur|dollars|euros|metres|meters|miles|hours|minutes|seconds|days|weeks|years|percent"
#: Function and question words, which are no names where they begin a sentence.
PLAIN = "A|About|After|All|Also|An|And|Any|Are|As|At|Based|Because|Before|Both|But|By|Calculate|Can|Choose|Compute|Consider|Could|Describe|Determine|Did|Do|Does|During|Each|Every|Explain|Find|First|For|From|Given|Had|Has|Have|He|Her|His|How|However|If|In|Into|Is|It|Its|Let|Many|More|Most|My|No|Not|Now|Of|On|One|Or|Our|Over|She|Should|Show|Since|So|Solve|Some|Suppose|Than|That|The|Their|Then|There|These|They|This|Those|Through|To|Under|Until|Was|We|Were|What|When|Where|Which|While|Who|Whose|Why|Will|With|Without|Would|Write|You|Your"
WORD_NAME = "[A-Z][a-z][A-Za-z]*"
NAME = rf"(?=[A-Z])(?<![A-Za-z0-9_])(?!(?:{PLAIN})(?![A-Za-z]))({WORD_NAME})"
UNIT = rf"(?i)([0-9]) ?({UNITS})\b"
NUMBER = r"([0-9]+(?:[.,:/][0-9]+)*)"
PUNCTUATION = ".,;:!?\"'()[]{}*%$&"
#: Windows of this many benchmark entries are broadcast, some 32 MB; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def marked(text: Column) -> Column:
    """Words with one space between; in place of a number, name or unit a mark and its value: #n, #p, #u.

    A name is a capitalised word but those of PLAIN, wherever it stands; a unit follows a number, in any case."""
    s = F.translate(F.coalesce(text.cast("string"), F.lit("")), "#", "")
    s = F.regexp_replace(s, NAME, "#p$1")
    s = F.regexp_replace(s, UNIT, "$1 #u$2")
    s = F.regexp_replace(s, NUMBER, "#n$1")
    s = F.translate(F.lower(s), PUNCTUATION, "")
    return F.trim(F.regexp_replace(s, r"[\x20\x09-\x0D]+", " "))


def template(words: Column) -> Column:
    return F.regexp_replace(words, r"#([nup])[^ ]*", "#$1")


def windows(source: DataFrame, key: str, words: str) -> DataFrame:
    """(key, at, window, slots): every WINDOW-word template window of marked words, and the values in its placeholders.

    Windows are cut before they become rows, so that no row carries its whole text."""
    rows = source.select(key, F.split(F.col(words), " ").alias("w"))
    starts = F.when(F.size("w") >= WINDOW, F.sequence(F.lit(1), F.size("w") - WINDOW + 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.select(key, F.transform(starts, lambda i: F.array_join(F.slice("w", i, WINDOW), " ")).alias("all"))
    rows = rows.select(key, F.posexplode("all").alias("at", "m"))
    return rows.select(key, "at", template(F.col("m")).alias("window"), F.regexp_extract_all("m", F.lit(r"#[nup]([^ ]*)"), F.lit(1)).alias("slots"))


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(text_key, leaked_items, containment): distinct texts (by their 64-bit hash) that hold benchmark items.

    containment: the largest share of an item's distinct windows found. Items of fewer than WINDOW words and windows with fewer than two plain words take no part;
    texts and items that are null or empty match nothing. The verdict depends on the text alone, so repeated rows and copies share it."""
    bench = windows(benchmark.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), marked(F.col(item_text)).alias("m")), "item", "m")
    plain = F.size(F.filter(F.split("window", " "), lambda x: ~x.contains("#")))
    bench = bench.where(plain >= 2)
    small = bench.count() <= BROADCAST_ROWS
    held = lambda df: F.broadcast(df) if small else df
    keyed = docs.select(F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text_key"), F.col(text).alias("t"))
    line = F.concat(template(marked(F.col("t"))), F.lit(" "))
    probes = keyed.select("text_key", line.alias("l"))
    # the lookahead reads WINDOW words, of which one is consumed
    cut = F.regexp_extract_all("l", F.lit(rf"(?=((?:[^ ]++ ){{{WINDOW}}}))[^ ]++ "), F.lit(1))
    met = probes.select("text_key", F.explode(cut).alias("window")).select("text_key", F.xxhash64("window").alias("h"))
    met = met.join(held(bench.select(F.xxhash64(F.concat("window", F.lit(" "))).alias("h")).distinct()), "h", "left_semi").select("text_key").distinct()
    met = written(met)
    texts = keyed.join(met, "text_key", "left_semi").groupBy("text_key").agg(F.any_value("t").alias("t"))
    there = windows(texts.select("text_key", marked(F.col("t")).alias("m")), "text_key", "m")
    b = bench.select("item", F.col("at").alias("b_at"), "window", F.col("slots").alias("b_slots"))
    same = written(there.join(held(b), "window"))
    # one alignment of an item in a text: windows at one distance
    whole = bench.groupBy("item").agg(F.countDistinct("window").alias("n_windows"))
    found = same.groupBy("text_key", "item").agg(F.countDistinct("window").alias("n_found"))
    pairs = same.select("text_key", "item", (F.col("at") - F.col("b_at")).alias("shift"), F.explode(F.arrays_zip("b_slots", "slots")).alias("z")).select("text_key", "item", "shift", "z.b_slots", "z.slots").distinct()
    slots = pairs.groupBy("text_key", "item", "shift", "b_slots").agg(F.count(F.lit(1)).alias("n")).groupBy("text_key", "item").agg((F.count(F.lit(1)) / F.sum("n")).alias("consistency"))
    hits = found.join(whole, "item").join(slots, ["text_key", "item"], "left").withColumn("containment", F.col("n_found") / F.col("n_windows"))
    hits = hits.where((F.col("containment") >= SHARE) & (F.coalesce("consistency", F.lit(1.0)) >= CONSISTENT))
    return hits.groupBy("text_key").agg(F.array_join(F.transform(F.array_sort(F.collect_set("item")), lambda x: x.cast("string")), ",").alias("leaked_items"), F.max("containment").alias("containment"))


def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """docs, each row once, with leaked_items ('' for none) and containment (0 for none) of its text, in place of columns so named."""
    found = leaks(docs, benchmark, text)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text_key"))
    out = keyed.join(found, "text_key", "left")
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("leaked_items", "containment")]
    return out.select(*kept, F.coalesce("leaked_items", F.lit("")).alias("leaked_items"), F.coalesce("containment", F.lit(0.0)).alias("containment"))


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every document and the benchmark items it leaks."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "leaked_items", F.round("containment", 6).alias("containment"), (F.col("leaked_items") != "").alias("leaked"))


def sql_steps(docs: str, prefix: str = "") -> list[str]:
    """DuckDB CTEs up to {prefix}leak (text, leaked_items, containment), over all windows of all texts of the relation `docs`."""
    x = prefix
    quote = lambda s: s.replace("'", "''")
    # without look-around: all capitalised words are marked, then those of PLAIN freed
    name, plain = rf"(^|[^A-Za-z0-9_])({WORD_NAME})", rf"#p({PLAIN})([^A-Za-z]|$)"
    mark = "coalesce(text, '')"
    mark = f"translate({mark}, '#', '')"
    mark = f"regexp_replace({mark}, '{name}', '\\1#p\\2', 'g')"
    mark = f"regexp_replace({mark}, '{plain}', '\\1\\2', 'g')"
    mark = f"regexp_replace({mark}, '{UNIT}', '\\1 #u\\2', 'g')"
    mark = f"regexp_replace({mark}, '{NUMBER}', '#n\\1', 'g')"
    mark = f"translate(lower({mark}), '{quote(PUNCTUATION)}', '')"
    mark = f"trim(regexp_replace({mark}, '[\\x20\\x09-\\x0D]+', ' ', 'g'))"

    def cuts(source: str, key: str) -> str:
        return f"""select {key}, i - 1 as at, regexp_replace(m, '#([nup])[^ ]*', '#\\1', 'g') as win, regexp_extract_all(m, '#[nup]([^ ]*)', 1) as slots
          from (select {key}, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as m from (select {key}, w, unnest(range(1, len(w) - {WINDOW - 2})) as i from (select {key}, string_split({mark}, ' ') as w from {source})))"""

    return [
        f"{x}b as materialized (select * from ({cuts('benchmark', 'item_id')}) where len(list_filter(string_split(win, ' '), lambda z: not contains(z, '#'))) >= 2)",
        f"{x}t as (select distinct coalesce(text, '') as text from {docs})",
        f"{x}d as ({cuts(x + 't', 'text')})",
        f"{x}same as materialized (select d.text, b.item_id, d.at - b.at as shift, d.win, b.slots as b_slots, d.slots as d_slots from {x}d d join {x}b b on d.win = b.win)",
        f"{x}whole as (select item_id, count(distinct win) as n_windows from {x}b group by 1)",
        f"{x}found as (select text, item_id, count(distinct win) as n_found from {x}same group by 1, 2)",
        f"{x}pairs as (select distinct text, item_id, shift, b_slots[k] as u, d_slots[k] as v from (select *, unnest(range(1, len(b_slots) + 1)) as k from {x}same))",
        f"{x}slots as (select text, item_id, count(*)::double / sum(n) as consistency from (select text, item_id, shift, u, count(*) as n from {x}pairs group by 1, 2, 3, 4) group by 1, 2)",
        f"""{x}leak as materialized (select text, array_to_string(list_sort(list(distinct item_id)), ',') as leaked_items, max(containment) as containment
          from (select f.text, f.item_id, f.n_found::double / w.n_windows as containment, coalesce(s.consistency, 1.0) as consistency
                from {x}found f join {x}whole w using (item_id) left join {x}slots s using (text, item_id))
          where containment >= {SHARE!r} and consistency >= {CONSISTENT} group by 1)""",
    ]


def op7_sql() -> str:
    return f"with {', '.join(sql_steps('documents'))} select doc_id, coalesce(l.leaked_items, '') as leaked_items, round(coalesce(l.containment, 0.0), 6) as containment, l.leaked_items is not null as leaked from documents d left join leak l on coalesce(d.text, '') = l.text"
