"""HTML pages: metadata, plain text, structure and elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metadata(html: Column) -> dict[str, Column]:
    """Title, language, character set and the named meta tags; '' where a page has none."""
    meta = lambda name: F.regexp_extract(html, rf'<meta (?:name|property)="{name}" content="([^"]*)"', 1)
    return {
        "title": F.regexp_extract(html, "<title>([^<]*)</title>", 1),
        "charset": F.regexp_extract(html, '<meta charset="([^"]*)"', 1),
        "lang": F.regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1),
        **{n.replace(":", "_"): meta(n) for n in ("description", "keywords", "author", "viewport", "og:title", "og:description")},
    }


def strip(html: Column) -> Column:
    """Text without scripts, styles and tags, white space collapsed; entities stay."""
    for pattern in (r"(?s)<script[^>]*>.*?</script>", r"(?s)<style[^>]*>.*?</style>", r"<[^>]*>"):
        html = F.regexp_replace(html, pattern, " ")
    return F.trim(F.regexp_replace(html, r"[ \t\n\r\f]+", " "))


def structure(html: Column) -> dict[str, Column]:
    n = lambda p: F.regexp_count(html, F.lit(p))
    return {"headings": n("<h[1-6][^>]*>"), "paragraphs": n("<p[^>]*>"), "links": n("<a[^>]*>"), "images": n("<img[^>]*>"), "has_table": html.rlike("<table"), "has_form": html.rlike("<form")}


def elements(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, number, tag, content): headings and paragraphs without child tags, in document order; one `body` where a page has none."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?s)<((?:h[1-6]|p)[^>]*>[^<]+)</"), F.lit(1))
    rows = pages.select(key, F.when(F.size(found) > 0, found).otherwise(F.array(F.concat(F.lit("body>"), strip(F.col(html))))).alias("e"))
    out = rows.select(key, F.posexplode("e").alias("number", "m"))
    return out.select(key, "number", F.regexp_extract("m", "^([a-z0-9]+)", 1).alias("tag"), F.trim(F.regexp_replace("m", "(?s)^[^>]*>", "")).alias("content"))


#: Block tags, matched by their beginning as they stand.
BLOCKS = ["p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "section", "article"]


def blocks(html: Column) -> Column:
    """How many block elements begin in a page; `<p` counts `<pre>` too, and so on."""
    return sum((F.regexp_count(html, F.lit(f"<{b}[^>]*>")) for b in BLOCKS), F.lit(0))
