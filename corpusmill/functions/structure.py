"""Structure and syntax of texts as Columns: lines, paragraphs, sections, sentence types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import lexicons as L
from corpusmill.functions.text import count_of, count_words

BLANK = r"^[ \t\r]*$"


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[ \t\r]+|[ \t\r]+$", "")


def is_header(t: Column) -> Column:
    """Of a trimmed line: a hash in front, or 6 to 59 bytes without a lower-case letter."""
    return t.rlike("^#") | (F.octet_length(t).between(6, 59) & ~t.rlike(r"\p{Ll}"))


def profile(text: Column) -> dict[str, Column]:
    """Line lengths in bytes, share of empty lines, paragraphs (runs of lines that are not blank), marks of structure, and the format they tell."""
    lines = F.split(text, "\n")
    sizes = F.transform(lines, lambda x: F.octet_length(x))
    full = F.transform(F.filter(lines, lambda x: ~x.rlike(BLANK)), trimmed)
    mean = F.aggregate(sizes, F.lit(0).cast("long"), lambda s, x: s + x) / F.size(lines)
    empty = F.size(F.filter(lines, lambda x: x.rlike(BLANK))) / F.size(lines)
    headers = F.exists(full, is_header)
    lists = F.exists(full, lambda x: x.rlike(r"^([-*+] |[0-9]\. )"))
    code = F.exists(lines, lambda x: x.rlike(r"^    [ ]*[^ \t\r]|^[ \t]*(```|~~~)"))
    kind = F.when(headers & lists, "structured_text").when(code, "code_or_markdown").when((empty < 0.1) & (mean > 60), "continuous_text").otherwise("plain_text")
    paragraphs = F.size(F.filter(F.split(text, r"\n(?:[ \t\r]*\n)+"), lambda x: ~x.rlike(r"^[ \t\r\n]*$")))
    return {"longest_line": F.array_max(sizes), "mean_line": mean, "empty_share": empty, "paragraphs": paragraphs, "has_headers": headers, "has_lists": lists, "has_code": code, "format": kind}


def syntax(text: Column) -> dict[str, Column]:
    """Sentences by their end, a run of . ! or ?, and those in the passive; punctuation a byte, conjunctions a word, and the case of the letters."""
    s = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]*"), F.lit(0)), lambda x: F.trim(x)), lambda x: x.rlike(r"[^ \t\r\n.!?]"))
    n = lambda p: F.size(F.filter(s, lambda x: x.rlike(p)))
    low = F.lower(text)
    joins = reduce(lambda a, b: a + b, [count_of(low, f" {c} ") for c in L.CONJUNCTIONS])
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    upper, lower = text.rlike(r"\p{Lu}"), text.rlike(r"\p{Ll}")
    case = F.when(upper & lower, "mixed_case").when(upper, "uppercase").when(lower, "lowercase").otherwise("no_letters")
    passive = F.size(F.filter(s, lambda x: F.lower(x).rlike("(was|were|is|are|been|being).*ed")))
    return {"questions": n(r"\?$"), "exclamations": n("!$"), "statements": n("[^?!]$"), "passive": passive, "punctuation": share(F.regexp_count(text, F.lit(r"\p{P}")), F.octet_length(text)), "conjunctions": share(joins, count_words(text)), "capitals": case}


def sections(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """(key, section, heading, n_lines) from a row for each line: a section begins at each line with a hash; section 0 is what stands before."""
    w = W.partitionBy(key).orderBy(order)
    head = F.col(line).rlike("^#")
    rows = lines.withColumn("section", F.sum(F.when(head, 1).otherwise(0)).over(w))
    return rows.groupBy(key, "section").agg(F.max(F.when(head, F.col(line))).alias("heading"), F.count(F.lit(1)).alias("n_lines"))


def markdown_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, i, line, fences, code, heading) of the lines after the front matter, `i` from 0 in the whole text: how many code fences there were up to a line, its own included, whether it is one or
    stands in code, and whether it is a heading: a hash within code is none. An unclosed fence goes on to the end. Null texts have no lines."""
    rows = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("i", "line"))
    w = W.partitionBy(key).orderBy("i")
    mark = F.rtrim("line") == "---"
    # the second --- ends the front matter that the first line begins
    rows = rows.withColumns({"_marks": F.sum(F.when(mark, 1).otherwise(0)).over(w), "_front": F.first(mark).over(w), "_all": F.sum(F.when(mark, 1).otherwise(0)).over(W.partitionBy(key))})
    body = rows.where(~(F.col("_front") & (F.col("_all") > 1) & ((F.col("_marks") < 2) | (F.col("_marks") == 2) & mark)))
    fence = F.startswith("line", F.lit("```"))
    body = body.withColumn("fences", F.sum(F.when(fence, 1).otherwise(0)).over(w))
    body = body.withColumn("code", fence | (F.col("fences") % 2 == 1))
    return body.select(key, "i", "line", "fences", "code", (F.startswith("line", F.lit("#")) & ~F.col("code")).alias("heading"))


def heading_level(line: Column) -> Column:
    return F.least(F.length(F.regexp_extract(line, "^#*", 0)), F.lit(6))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def heading_text(line: Column) -> Column:
    return stripped(F.regexp_replace(line, "^#{1,6}", ""))


def _joined(rows: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(rows), lambda x: x["line"]), "\n")


def markdown_chunks(docs: DataFrame, key: str, text: str, by: str) -> DataFrame:
    """(key, kind, content, level, language, line) of a text in Markdown, `line` from 1.

    by heading: its headings; by section: headings, and what stands between them; by paragraph: what blank lines separate, a heading if it begins with one; by block:
    code with its language, headings, and every other line that is not blank. Lines stay within their text, so a window or list holds one text."""
    lines = markdown_lines(docs, key, text)
    none = F.lit(None).cast("string")
    heads = lines.where("heading").select(key, F.lit("heading").alias("kind"), heading_text(F.col("line")).alias("content"), heading_level(F.col("line")).alias("level"), none.alias("language"), (F.col("i") + 1).alias("line"))
    if by == "heading":
        return heads
    w = W.partitionBy(key).orderBy("i")
    if by == "section":
        rows = lines.withColumn("s", F.sum(F.when(F.col("heading"), 1).otherwise(0)).over(w))
        g = rows.groupBy(key, "s").agg(stripped(_joined(F.collect_list(F.when(~F.col("heading"), F.struct("i", "line"))))).alias("content"), F.max(F.when(F.col("heading"), heading_level(F.col("line")))).alias("level"), F.min("i").alias("i"))
        return heads.unionByName(g.where(F.col("content") != "").select(key, F.lit("section").alias("kind"), "content", F.coalesce("level", F.lit(0)).alias("level"), none.alias("language"), (F.col("i") + 1).alias("line")))
    blank = stripped(F.col("line")) == ""
    if by == "paragraph":
        rows = lines.withColumn("s", F.sum(F.when(blank, 1).otherwise(0)).over(w)).where(~blank)
        g = rows.groupBy(key, "s").agg(stripped(_joined(F.collect_list(F.struct("i", "line")))).alias("content"), F.min_by("heading", "i").alias("h"), F.min("i").alias("i"))
        return g.select(key, F.when(F.col("h"), "heading").otherwise("paragraph").alias("kind"), "content", F.lit(0).alias("level"), none.alias("language"), (F.col("i") + 1).alias("line"))
    if by != "block":
        raise ValueError(f"unknown chunks {by}")
    fence = F.startswith("line", F.lit("```"))
    code = lines.where("code").withColumn("s", F.floor((F.col("fences") + 1) / 2))
    g = code.groupBy(key, "s").agg(_joined(F.collect_list(F.when(~fence, F.struct("i", "line")))).alias("content"), F.min_by("line", "i").alias("open"), F.min("i").alias("i"), F.count(F.lit(1)).alias("n"))
    g = g.where("n > 1")  # a last fence with nothing after it opens no block
    g = g.select(key, F.lit("code").alias("kind"), "content", F.lit(0).alias("level"), stripped(F.substring("open", 4, 1 << 20)).alias("language"), (F.col("i") + 1).alias("line"))
    plain = lines.where(~F.col("code") & ~F.col("heading") & ~blank).select(key, F.lit("text").alias("kind"), F.col("line").alias("content"), F.lit(0).alias("level"), none.alias("language"), (F.col("i") + 1).alias("line"))
    return heads.unionByName(g).unionByName(plain)


#: Elements of a line of Markdown outside code.
ELEMENTS = {"list_items": r"^[\x20\x09]*(?:[-*+]|[0-9]+[.)])[\x20\x09]", "table_rows": r"^[\x20\x09]*\|.*\|[\x20\x09]*$", "quotes": "^>", "links": r"(?<!!)\[[^\]]*\]\([^)]*\)", "images": r"!\[[^\]]*\]\([^)]*\)"}


def markdown_elements(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, headings, code_blocks, and a count for each of ELEMENTS) of texts in Markdown; those without a line after the front matter are left out."""
    lines = markdown_lines(docs, key, text)
    count = lambda p: F.sum(F.when(F.col("code"), 0).otherwise(F.regexp_count("line", F.lit(p)))).alias
    tally = [count(p)(name) for name, p in ELEMENTS.items()]
    return lines.groupBy(key).agg(F.sum(F.col("heading").cast("int")).alias("headings"), F.ceil(F.max("fences") / 2).alias("code_blocks"), *tally)
