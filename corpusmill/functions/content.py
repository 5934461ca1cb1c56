"""Kinds of files by MIME type, extension and content, in that order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of MIME types, extensions, and marks of contents (each row of marks must stand whole) with the kind they tell.
MIME_CONTENT = [("^text/", "document"), ("spreadsheet|excel", "spreadsheet"), ("presentation|powerpoint", "presentation"), ("^image/", "image"), ("^video/", "video"), ("^audio/", "audio"), ("pdf", "document")]
EXTENSION_CONTENT = {
    "document": ["txt", "md", "html", "xml", "rtf", "pdf", "doc", "docx"],
    "spreadsheet": ["xls", "xlsx", "csv"],
    "presentation": ["ppt", "pptx"],
    "image": ["jpg", "jpeg", "png", "gif", "bmp", "svg"],
    "video": ["mp4", "avi", "mov", "wmv", "flv"],
    "audio": ["mp3", "wav", "flac", "aac"],
    "code": ["js", "py", "java", "cpp", "c", "go", "rb"],
    "log": ["log"],
    "database": ["sql", "db"],
}
SNIFF = [("code", [["function"], ["class "], ["import "], ["#include"]]), ("email", [["from:", "to:", "subject:"]]), ("log", [["[info]"], ["[error]"], ["timestamp"]]), ("web", [["<html"], ["<body"], ["<!doctype"]])]
MIME_DOCUMENT = {
    "pdf": ["application/pdf"],
    "word": ["application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"],
    "text": ["text/plain"],
    "markdown": ["text/markdown"],
    "html": ["text/html"],
    "xml": ["application/xml", "text/xml"],
    "json": ["application/json"],
    "csv": ["text/csv"],
    "excel": ["application/vnd.ms-excel", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"],
    "powerpoint": ["application/vnd.ms-powerpoint", "application/vnd.openxmlformats-officedocument.presentationml.presentation"],
}
EXTENSION_DOCUMENT = {"pdf": ["pdf"], "word": ["doc", "docx"], "text": ["txt"], "markdown": ["md"], "html": ["html", "htm"], "xml": ["xml"], "json": ["json"], "csv": ["csv"], "excel": ["xls", "xlsx"], "powerpoint": ["ppt", "pptx"], "rtf": ["rtf"]}
#: The chunking strategy of each kind of data and of file.
STRATEGY_OF_DATA = {"semantic_text": ["unstructured", "text"], "row_based_structured": ["structured", "csv", "table"]}
STRATEGY_OF_FILE = {"semantic_text": ["txt", "text", "md", "markdown", "log"], "row_based_structured": ["csv", "tsv"]}


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"([^.]*)$", 1))


def _listed(column: Column, table: dict[str, list[str]], out):
    for kind, values in table.items():
        out = F.when(column.isin(values), kind) if out is None else out.when(column.isin(values), kind)
    return out


def content_type(mime: Column, name: Column, content: Column) -> Column:
    out = None
    for p, kind in MIME_CONTENT:
        hit = F.coalesce(mime, F.lit("")).rlike(p)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    out, low = _listed(extension(name), EXTENSION_CONTENT, out), F.lower(content)
    for kind, alternatives in SNIFF:
        for marks in alternatives:
            hit = F.lit(True)
            for m in marks:
                hit = hit & F.contains(low, F.lit(m))
            out = out.when(hit, kind)
    return out.otherwise("document")


def document_type(mime: Column, name: Column) -> Column:
    return _listed(extension(name), EXTENSION_DOCUMENT, _listed(F.coalesce(mime, F.lit("")), MIME_DOCUMENT, None)).otherwise("text")


def strategy_of_data(kind: Column) -> Column:
    return _listed(kind, STRATEGY_OF_DATA, None).otherwise("adaptive_hybrid")


def strategy_of_file(ext: Column) -> Column:
    return _listed(ext, STRATEGY_OF_FILE, None).otherwise("adaptive_hybrid")
