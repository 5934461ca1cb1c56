"""Chunkers: generators that carry state along a text run as Arrow batches; row batches and line kinds are plain expressions."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BREAK = re.compile(r"[.!?](?=\s)")


def fixed(text: str, size: int = 1000, overlap: int = 100, least: int = 50, keep_paragraphs: bool = False):
    """Windows of `size` characters with `overlap`, ended after the last sentence in them where that gets on. Runs of white space count as one space.

    keep_paragraphs: blank lines stay, and a window ends at the last of them, if that is past its middle."""
    text = "\n\n".join(" ".join(p.split()) for p in paragraphs(text)) if keep_paragraphs else " ".join(text.split())
    if len(text) <= size:
        yield text
        return
    start, last = 0, 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            stops = [m.end() for m in BREAK.finditer(text, start, end)]
            # a break that does not pass the end before would give the same chunk for ever
            if stops and stops[-1] > max(start + least, last):
                end = stops[-1]
            if keep_paragraphs and (blank := text.rfind("\n\n", start, end)) > max(start + size // 2, last):
                end = blank
        piece = text[start:end].strip()
        if len(piece) >= least:
            yield piece
        if end == len(text):
            return
        last, start = end, max(end - overlap, start + 1)


def paragraphs(text: str) -> list[str]:
    return [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]


def last_sentence(text: str) -> str:
    s = [x.strip() for x in re.findall(r"[^.!?]+[.!?]*", text) if x.strip()]
    return s[-1] if len(s) > 1 else text


def semantic(text: str, most: int = 2000, least: int = 100, overlap: bool = True):
    """Paragraphs packed up to `most` characters; a tail below `least` goes. Each chunk begins with the last sentence of the one before."""
    packed, now = [], ""
    for p in paragraphs(text):
        if now and len(now) + 2 + len(p) > most and len(now) >= least:
            packed.append(now)
            now = p
        else:
            now = f"{now}\n\n{p}" if now else p
    if len(now) >= least:
        packed.append(now)
    before = None
    for c in packed:
        yield f"{last_sentence(before)} {c}" if overlap and before is not None else c
        before = c


def scores(text: str) -> tuple[float, float, float]:
    """Completeness, coherence and readability of a chunk."""
    n = max(1, len([s for s in re.split("[.!?]", text) if s.strip()]))
    per = len(text.split()) / n
    return (1.0 if text.rstrip()[-1:] in ".!?" and text.strip() else 0.8 if text.strip() else 0.0), (0.9 if 10 <= per <= 25 else 0.7 if 5 <= per <= 35 else 0.5), (0.8 if per <= 20 else 0.6 if per <= 30 else 0.5)


def adaptive(text: str, most: int = 1000, least: float = 0.5):
    """JSON stays one chunk, lines of comma-separated cells go in batches of 100, prose in paragraphs packed to `most` if its mean score is `least` or more."""
    t = text.strip()
    if t[:1] in ("{", "["):
        try:
            json.loads(t)
            yield t
            return
        except ValueError:
            pass
    rows = t.split("\n")
    if len(rows) > 2 and rows[0].count(",") and len({r.count(",") for r in rows}) == 1:
        for i in range(0, len(rows), 100):
            yield "\n".join(rows[i : i + 100])
        return
    for c in semantic(text, most, 1, False):
        if sum(scores(c)) / 3 >= least:
            yield c


def mixed(items: list, mode: str = "separate"):
    """Chunks of a list of texts and records: each by its kind, all as one text, the texts alone, or the records alone in batches of 100."""
    records, texts = [x for x in items if isinstance(x, dict)], [x for x in items if isinstance(x, str)]
    if mode == "separate":
        for x in items:
            yield from adaptive(x) if isinstance(x, str) else [json.dumps(x, ensure_ascii=False)]
    elif mode == "combine":
        yield from adaptive("\n---\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in items))
    elif mode == "text_only":
        yield from adaptive("\n\n".join(texts)) if texts else []
    elif mode == "structured_only":
        yield from (json.dumps(records[i : i + 100], ensure_ascii=False) for i in range(0, len(records), 100))
    else:
        raise ValueError(f"unknown mode {mode}")


def of_items(text: str, mode: str = "separate"):
    """mixed() over a JSON array; other texts as adaptive() has them."""
    try:
        items = json.loads(text)
    except ValueError:
        items = None
    yield from mixed(items, mode) if isinstance(items, list) else adaptive(text)


CHUNKERS = {"fixed": fixed, "paragraphs": lambda t: fixed(t, keep_paragraphs=True), "mixed": of_items, "combined": lambda t: of_items(t, "combine"), "sentence": lambda t: fixed(t, overlap=0), "semantic": semantic, "adaptive": adaptive}
NAMES = {"fixed": "chunk", "paragraphs": "chunk", "mixed": "adaptive:mixed", "combined": "adaptive:mixed", "sentence": "chunk", "semantic": "semantic", "adaptive": "adaptive:text"}


#: Characters of chunks that a Python worker holds before it hands them on.
HELD = 1 << 20


def chunked(docs: DataFrame, key: str, text: str, how: str) -> DataFrame:
    """(key, number, chunk_id, content, completeness, coherence, readability): one row a chunk of the whole text; null text has none."""
    chunker, name = CHUNKERS[how], NAMES[how]
    fields = f"{key} {dict(docs.dtypes)[key]}, number int, chunk_id string, content string, completeness double, coherence double, readability double"

    names = ["number", "chunk_id", "content", "completeness", "coherence", "readability"]
    kinds = [pa.int32(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]

    def rows(batches):
        for b in batches:
            schema = pa.schema([(key, b.schema.field(0).type), *zip(names, kinds, strict=True)])
            made = lambda out, s=schema: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), s, strict=True)], schema=s)
            out, held = [], 0
            for k, t in zip(b.column(0), b.column(1), strict=True):
                k, t = k.as_py(), t.as_py()
                for i, c in enumerate(chunker(t) if t is not None else ()):
                    out.append((k, i, f"{k}:{name}:{i}", c, *scores(c)))
                    held += len(c)
                    if held >= HELD:
                        yield made(out)
                        out, held = [], 0
            if out:
                yield made(out)

    return docs.select(key, text).mapInArrow(rows, fields)


def row_chunks(df: DataFrame, group: str, order: list[str], size: int) -> DataFrame:
    """Rows numbered into batches of `size` within a group: chunk_id is `{group}:row:{n}`.

    Ranks come from ranges of the order: rows are numbered within a range, and ranges are offset by the counts before them, so that no task
    sorts a whole group."""
    parts = df.withColumn("_range", F.floor(F.col(order[0]) / 4096))
    w = W.partitionBy(group, "_range").orderBy(*order)
    sums = parts.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_c"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_c").over(W.partitionBy(group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    n = F.floor((F.row_number().over(w) - 1 + F.col("_before")) / size)
    return parts.join(sums, [group, "_range"]).withColumn("chunk_id", F.concat(F.col(group).cast("string"), F.lit(":row:"), n.cast("string"))).drop("_range", "_before")


def row_batches(df: DataFrame, group: str, order: list[str], size: int, cells: list[str], how: str = "records", most: int = 10 << 20) -> DataFrame:
    """(chunk_id, n, bytes, data): batches of `size` rows of a group, or fewer, as records (JSON objects), as a table (headers and rows) or as json text.

    Where a group's largest batch would be over `most` bytes, its batches are as much smaller: a batch of k rows takes k times the group's largest row at the
    most, so the size follows from that, without trying sizes one by one."""
    cell = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cells]
    row = sum((F.octet_length(v) + len(c) + 10 for c, v in zip(cells, cell, strict=True)), F.lit(0))
    widest = df.groupBy(group).agg(F.max(row).alias("_w"))
    fit = widest.select(group, F.greatest(F.lit(1), F.least(F.lit(size), F.floor(most / F.col("_w")).cast("int"))).alias("_fit"))
    body = F.to_json(F.struct(*cells)) if how in ("records", "json") else F.to_json(F.array(*cell))
    one = row_chunks(df, group, order, 1).withColumn("_i", F.regexp_extract("chunk_id", r"([0-9]+)$", 1).cast("long"))
    n = F.floor(F.col("_i") / F.col("_fit"))
    g = one.join(fit, group).select(F.concat(F.col(group).cast("string"), F.lit(":row:"), n.cast("string")).alias("chunk_id"), "_i", body.alias("_b"), row.alias("_r"))
    g = g.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.sum("_r").alias("bytes"), F.transform(F.array_sort(F.collect_list(F.struct("_i", "_b"))), lambda x: x["_b"]).alias("_rows"))
    joined = F.concat(F.lit("["), F.array_join("_rows", ","), F.lit("]"))
    data = F.concat(F.lit('{"headers":' + json.dumps(cells, separators=(",", ":")) + ',"rows":'), joined, F.lit("}")) if how == "table" else joined
    return g.select("chunk_id", "n", "bytes", data.alias("data"))


#: Bytes that a field of a kind is reckoned at.
FIELD_BYTES = {"string": 50, "text": 200, "integer": 10, "float": 15, "boolean": 5, "date": 20, "datetime": 20}


def optimal_rows(kinds: list[str]) -> int:
    """Rows of a chunk of some 1 MiB, 10 to 1000, by the kinds of the fields."""
    width = sum(FIELD_BYTES.get(k, 30) for k in kinds) if kinds else 100
    return max(10, min(1000, (1 << 20) // width))


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("number", "line"))


def line_kind(line: Column) -> Column:
    """empty, header, list_item, code or paragraph; the first that holds."""
    header = line.startswith("#") | ((F.upper(line) == line) & line.rlike("[A-Z]") & F.length(line).between(6, 59))
    return F.when(F.trim(line) == "", "empty").when(header, "header").when(line.rlike(r"^([-*+] |[0-9]+\. )"), "list_item").when(line.startswith("    ") | line.startswith("```"), "code").otherwise("paragraph")
