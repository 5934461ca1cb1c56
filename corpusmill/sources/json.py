"""JSON texts as rows: flattened keys, nesting depth, chosen keys, null policy. Parsing is Spark's; a helper walks one document."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _walk(value, name: str, depth: int, arrays: bool, skip: set[str], most: int):
    if depth < most and isinstance(value, dict):
        for k, v in value.items():
            if k not in skip:
                yield from _walk(v, f"{name}.{k}" if name else k, depth + 1, arrays, skip, most)
    elif depth < most and arrays and isinstance(value, list):
        for i, v in enumerate(value):
            yield from _walk(v, f"{name}[{i}]", depth + 1, arrays, skip, most)
    else:
        yield name, value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def flattened(docs: DataFrame, key: str, text: str, arrays: bool = False, skip: list[str] | None = None, depth: int = 10) -> DataFrame:
    """(key, name, value): a row for each leaf of each document, names joined by dots, elements of arrays as name[i] if `arrays`, else arrays as JSON.

    What lies deeper than `depth` stays JSON; keys of `skip` go with all below them. Texts that are no JSON have no rows; JSON null is the value null in text."""
    left, types = set(skip or []), dict(docs.dtypes)

    def rows(batches):
        for b in batches:
            out = []
            for k, t in zip(b[key], b[text], strict=True):
                try:
                    out += [(k, n, v) for n, v in _walk(json.loads(t), "", 0, arrays, left, depth)]
                except (ValueError, TypeError, RecursionError):
                    continue
            yield pd.DataFrame(out, columns=[key, "name", "value"])

    return docs.select(key, text).mapInPandas(rows, f"{key} {types[key]}, name string, value string")


def depth(text: Column) -> Column:
    """How deep objects and arrays of a JSON text nest, 0 for a scalar: the most open brackets at once, strings left out."""
    bare = F.regexp_replace(text, r'"(?:[^"\\\\]|\\\\.)*"', "")
    marks = F.regexp_extract_all(bare, F.lit(r"[\[{\]}]"), F.lit(0))
    step = lambda s, m: F.struct((s["now"] + F.when(m.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"] + F.when(m.isin("[", "{"), 1).otherwise(-1)).alias("most"))
    return F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step)["most"]


def projected(flat: DataFrame, extract: list[str] | None = None, nulls: str = "keep") -> DataFrame:
    """Rows of flattened() whose top key is in `extract` (all by default); nulls: keep (null), convert_empty ('') or skip (the rows go)."""
    if nulls not in ("keep", "convert_empty", "skip"):
        raise ValueError(f"unknown null policy {nulls}")
    top = F.regexp_extract("name", r"^([^.\[]*)", 1)
    out = flat.where(top.isin(extract)) if extract else flat
    if nulls == "skip":
        return out.where("value <> 'null'")
    return out.withColumn("value", F.when(F.col("value") == "null", F.lit("" if nulls == "convert_empty" else None)).otherwise(F.col("value")))
