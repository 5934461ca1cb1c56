"""Files as tables: CSV, JSON, text, Markdown, XML, archives, mail; profiles of columns."""

from __future__ import annotations

import email
import gzip
import io
import re
import tarfile
import zipfile
from email import policy
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The reader of each file extension.
READERS = {"csv": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "txt": "text", "text": "text", "log": "text", "html": "html", "htm": "html", "xml": "xml", "md": "markdown", "markdown": "markdown", "rtf": "rtf", "eml": "email", "zip": "zip", "gz": "archive", "tgz": "archive", "tar": "archive", "png": "image", "gif": "image", "bmp": "image", "jpg": "image", "jpeg": "image"}


def reader_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return reduce(lambda out, kv: out.when(ext == kv[0], kv[1]), READERS.items(), F.when(F.lit(False), ""))


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True) -> DataFrame:
    if len(delimiter) != 1:
        raise ValueError("the delimiter is one character")
    return spark.read.csv(path, sep=delimiter, header=header, ignoreLeadingWhiteSpace=True)


def read_json(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    return spark.read.json(path, multiLine=not lines)


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def read_text(spark: SparkSession, path: str, by: str = "line", skip_empty: bool = True, size: int = 1000) -> DataFrame:
    """(path, number, text) by line, by paragraph or by `size` characters, trimmed."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    pieces = F.regexp_extract_all("value", F.lit(rf"(?s).{{1,{size}}}"), F.lit(0)) if by == "size" else F.split("value", "\n" if by == "line" else r"\n\s*\n")
    parts = whole.select("path", F.posexplode(pieces).alias("number", "text")).withColumn("text", F.trim("text"))
    return parts.where("text <> ''") if skip_empty else parts


def json_format(text: Column) -> Column:
    """array, lines or single."""
    t = F.trim(text)
    return F.when(t.startswith("["), "array").when(t.rlike(r"(?s)^\{.*\}\s*\n\s*\{.*\}$"), "lines").otherwise("single")


def markdown_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, level, title, body): text before the first heading is section 0."""
    lines = docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("i", "line"))
    heading = F.regexp_extract("line", r"^(#{1,6})\s", 1)
    lines = lines.withColumn("h", F.length(heading)).withColumn("section", F.sum(F.when(F.col("h") > 0, 1).otherwise(0)).over(W.partitionBy(key).orderBy("i")))
    g = lines.groupBy(key, "section").agg(F.max("h").alias("level"), F.max(F.when(F.col("h") > 0, F.regexp_replace("line", r"^#+\s+", ""))).alias("title"), F.array_sort(F.collect_list(F.when(F.col("h") == 0, F.struct("i", "line")))).alias("b"))
    return g.select(key, "section", "level", "title", F.trim(F.array_join(F.transform("b", lambda x: x["line"]), "\n")).alias("body"))


def rtf_text(raw: str) -> str:
    """Plain text of an RTF document: header groups dropped, paragraph marks as line feeds."""
    raw = re.sub(r"\{\\(?:info|fonttbl|stylesheet|colortbl)(?:[^{}]|\{[^{}]*\})*\}", "", raw)
    raw = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), raw)
    raw = re.sub(r"\\(?:par|line)(?![a-z])\s?", "\n", raw)
    return re.sub(r"[{}]", "", re.sub(r"\\[a-z]+-?\d* ?", "", raw)).strip()


def mail_row(raw: bytes) -> tuple:
    """(subject, sender, recipients, date, body, attachments) of a message, headers and bodies decoded."""
    m = email.message_from_bytes(raw, policy=policy.default)
    body = m.get_body(("plain", "html"))
    return str(m["subject"] or ""), str(m["from"] or ""), str(m["to"] or ""), str(m["date"] or ""), body.get_content() if body else "", [a.get_filename() or "" for a in m.iter_attachments()]


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    """One row for each .eml file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(batches):
        for b in batches:
            out = [mail_row(c) for c in b["content"]]
            yield b[["path"]].assign(**{n: [r[i] for r in out] for i, n in enumerate(("subject", "sender", "recipients", "date", "body", "attachments"))})

    return files.mapInPandas(rows, "path string, subject string, sender string, recipients string, date string, body string, attachments array<string>")


#: Endings of files that hold no text.
BINARY = ["exe", "dll", "so", "bin", "jpg", "jpeg", "png", "gif", "bmp", "ico", "mp3", "mp4", "avi", "mov", "zip", "gz", "tar", "class", "jar", "woff", "ttf"]
LARGE = 100 * 1024 * 1024


def archive_entries(name: str, data: bytes, extensions: list[str] | None = None, most: int | None = None, hidden: bool = False, binary: bool = False):
    """(entry, bytes) of a zip, tar, tar.gz or gzip file, one at a time. Folders, hidden entries and those of BINARY endings are left out unless asked
    for; `extensions` and `most` narrow them. An entry above 100 MB has a marker for its content. A gzip of anything but a tar is one entry."""

    def wanted(entry: str) -> bool:
        base = entry.rsplit("/", 1)[-1]
        ext = base.rsplit(".", 1)[-1].lower() if "." in base else ""
        return (hidden or not base.startswith(".")) and (binary or ext not in BINARY) and (extensions is None or ext in extensions)

    def content(size: int, read) -> bytes:
        return b"[content too large]" if size > LARGE else read()

    def all_entries():
        if data[:2] == b"PK":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                yield from ((i.filename, content(i.file_size, lambda i=i: z.read(i))) for i in z.infolist() if not i.is_dir() and wanted(i.filename))
            return
        try:
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                yield from ((m.name, content(m.size, lambda m=m: t.extractfile(m).read())) for m in t if m.isfile() and wanted(m.name))
        except tarfile.ReadError:
            if data[:2] == b"\x1f\x8b":
                with gzip.GzipFile(fileobj=io.BytesIO(data)) as g:
                    body = g.read(LARGE + 1)
                yield name.rsplit("/", 1)[-1].removesuffix(".gz"), content(len(body), lambda: body)

    yield from islice(all_entries(), most)


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    """(path, entry, content): an archive's files, one row each, written out entry by entry; options as archive_entries() has them."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(batches):
        import pandas as pd

        for b in batches:
            for p, c in zip(b["path"], b["content"], strict=True):
                for entry, data in archive_entries(p, c, **options):
                    yield pd.DataFrame({"path": [p], "entry": [entry], "content": [data]})

    return files.mapInPandas(rows, "path string, entry string, content binary")


def compression_of(name: Column, content: Column) -> Column:
    """zip, tar.gz, gzip, tar or none, by the name and the first bytes."""
    low, mark = F.lower(name), F.hex(F.substring(content, 1, 4))
    return F.when(low.rlike(r"\.(tar\.gz|tgz)$"), "tar.gz").when(mark.startswith("504B"), "zip").when(mark.startswith("1F8B"), "gzip").when(low.rlike(r"\.tar$"), "tar").otherwise("none")


def read_decoded(spark: SparkSession, path: str) -> DataFrame:
    """(path, charset, confidence, text) of text files, each in the character set that it tells or seems to have."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(batches):
        for b in batches:
            found = [charset_of(c) for c in b["content"]]
            yield b[["path"]].assign(charset=[n for n, _ in found], confidence=[c for _, c in found], text=[decoded(c, n) for c, (n, _) in zip(b["content"], found, strict=True)])

    return files.mapInPandas(rows, "path string, charset string, confidence double, text string")


def decoded(data: bytes, charset: str) -> str:
    try:
        return data.decode("utf-8-sig" if charset == "utf-8" else charset, "replace").lstrip("\ufeff")
    except LookupError:
        return data.decode("utf-8", "replace")


def read_rtf(spark: SparkSession, path: str) -> DataFrame:
    """(path, number, text): paragraphs of RTF files."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")

    def rows(batches):
        for b in batches:
            yield b[["path"]].assign(text=[rtf_text(v) for v in b["value"]])

    plain = files.mapInPandas(rows, "path string, text string")
    return plain.select("path", F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("number", "text"))


def image_metadata(content: Column) -> dict[str, Column]:
    """format, width and height from the first bytes of a PNG, GIF or BMP; null for others. Reads no pixels."""
    h = F.hex(F.substring(content, 1, 32))
    number = lambda at, size: F.conv(F.substring(h, 2 * at + 1, 2 * size), 16, 10).cast("int")
    turned = lambda at: F.conv(F.concat(F.substring(h, 2 * at + 3, 2), F.substring(h, 2 * at + 1, 2)), 16, 10).cast("int")
    kind = F.when(h.startswith("89504E47"), "png").when(h.startswith("474946"), "gif").when(h.startswith("424D"), "bmp").when(h.startswith("FFD8"), "jpeg")
    return {"format": kind, "width": F.when(kind == "png", number(16, 4)).when(kind == "gif", turned(6)).when(kind == "bmp", turned(18)), "height": F.when(kind == "png", number(20, 4)).when(kind == "gif", turned(8)).when(kind == "bmp", turned(22))}


def size_estimate(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(path, bytes, est_rows, columns, complexity) of CSV files: rows by the mean line of the first 4 KiB; medium beyond 50 MB or 50 columns, high beyond 500 MB or 200."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.substring("content", 1, 4096).cast("string").alias("head"))
    lines, width = F.split("head", "\n"), F.octet_length("head")
    each = F.when(F.size(lines) > 1, F.greatest(F.floor(width / F.size(lines)), F.lit(1))).otherwise(100)
    columns = F.size(F.split(lines[0], delimiter))
    mb = 1024 * 1024
    how = F.when((F.col("length") > 500 * mb) | (columns > 200), "high").when((F.col("length") > 50 * mb) | (columns > 50), "medium").otherwise("low")
    return files.select("path", F.col("length").alias("bytes"), F.floor(F.col("length") / each).alias("est_rows"), columns.alias("columns"), how.alias("complexity"))


def charset_of(data: bytes) -> tuple[str, float]:
    """Character set and confidence: mark, valid UTF-8, declaration, else a single-byte set."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return name, 1.0
    try:
        data.decode()
        return "utf-8", 0.9
    except UnicodeDecodeError:
        pass
    if m := re.search(rb"(?:charset|encoding)=[\"']?([\w-]+)", data[:2048]):
        return m[1].decode().lower(), 0.8
    return ("cp1252", 0.6) if sum(0x80 <= b < 0xA0 for b in data) > len(data) / 100 else ("latin-1", 0.6)


def profile(df: DataFrame) -> DataFrame:
    """For each column: filled rows, distinct values, null share, the kind by the 80 % rule, and the five most frequent values."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("v")) for c in df.columns])).alias("c")).select("c.*")
    counts = cells.groupBy("name", "v").agg(F.count(F.lit(1)).alias("n"))
    full = F.coalesce(F.trim("v") != "", F.lit(False))
    tally = lambda p: F.sum(F.when(p, F.col("n")).otherwise(0))
    g = counts.groupBy("name").agg(tally(full).alias("filled"), F.count("v").alias("distinct_values"), F.sum("n").alias("rows"), tally(F.col("v").try_cast("long").isNotNull()).alias("ints"), tally(F.col("v").try_cast("double").isNotNull()).alias("numbers"))
    top = counts.where(full).withColumn("k", F.row_number().over(W.partitionBy("name").orderBy(F.desc("n"), "v"))).where("k <= 5").groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]), "|").alias("top"))
    kind = F.when(F.col("ints") >= 0.8 * F.col("filled"), "integer").when(F.col("numbers") >= 0.8 * F.col("filled"), "float").otherwise("string")
    return g.join(top, "name", "left").select("name", "filled", "distinct_values", F.round(100.0 * (F.col("rows") - F.col("filled")) / F.col("rows"), 6).alias("null_percent"), kind.alias("kind"), "top")
