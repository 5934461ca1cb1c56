"""Places of literals, a table of any size, in texts: patterns are stored once and read by the tasks, texts stay in their rows."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.pairs import stored_files
from corpusmill.streaming.jobs import shared

#: Bytes of a gram; shorter runs are their own gram.
GRAM = 4
#: Patterns that a task holds at a time, runs of texts that it keeps what they hold of, rows that it hands on at a time.
HELD, KNOWN, HANDED = 1 << 17, 1 << 18, 1 << 16


class Part:
    """Some patterns, found by the longest of their runs of what is no white space: by the gram of it that the fewest share."""

    def __init__(self, names: list, literals: list[str]):
        self.names, self.literals = names, literals
        runs = [max(x.encode().split(), key=len, default=b"") for x in literals]
        grams = [{r[i : i + GRAM] for i in range(max(1, len(r) - GRAM + 1))} for r in runs]
        often = Counter(g for s in grams for g in s)
        by: dict[bytes, dict[bytes, list[int]]] = {}
        #: Of white space only: held against each text.
        self.blank = [i for i, r in enumerate(runs) if not r]
        for i, (r, s) in enumerate(zip(runs, grams, strict=True)):
            if r:
                by.setdefault(min(s, key=lambda g: (often[g], g)), {}).setdefault(r, []).append(i)
        self.by = by
        self.sizes = sorted({len(g) for g in by})
        self.known: dict[bytes, tuple[int, ...]] = {}

    def of(self, run: bytes) -> tuple[int, ...]:
        """The patterns whose longest run stands in a run of a text."""
        found = self.known.get(run)
        if found is None:
            grams = {run[i : i + n] for n in self.sizes for i in range(len(run) - n + 1)}
            found = tuple(i for g in grams if g in self.by for r, own in self.by[g].items() if r in run for i in own)
            if len(self.known) >= KNOWN:
                self.known = {}
            self.known[run] = found
        return found

    def places(self, text: str) -> Iterator[tuple[int, int]]:
        """(pattern, place of it): the first place of each pattern in a text, in characters."""
        met = set(self.blank)
        for run in set(text.encode().split()):
            met.update(self.of(run))
        for i in met:
            at = text.find(self.literals[i])
            if at >= 0:
                yield i, at


def parts(path: str) -> Iterator[Part]:
    fs, files = stored_files(path)
    for f in files:
        with fs.open_input_file(f) as source:
            for b in pq.ParquetFile(source).iter_batches(HELD, columns=["name", "literal"]):
                yield Part(b["name"].to_pylist(), b["literal"].to_pylist())


def first_places(docs: DataFrame, patterns: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, value, start) of patterns (name, literal), the first place of each in a text; null and empty ones match nothing, equal ones match each.

    Nothing of the texts is shuffled. Patterns beyond HELD are gone through a part at a time for each batch of texts."""
    path = f"{shared(docs.sparkSession)}/literals-{uuid.uuid4().hex}"
    patterns.where(F.length("literal") > 0).select(F.col("name").cast("string").alias("name"), "literal").coalesce(1).write.parquet(path)
    kind = dict(docs.dtypes)[key]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few = list(islice(parts(path), 2))
        one = few if len(few) < 2 else None
        del few
        for b in batches:
            some = parts(path) if one is None else one
            texts = b["text"].to_pylist()
            for p in some:
                row, names, values, starts = [], [], [], []
                for k, t in enumerate(texts):
                    for i, at in p.places(t):
                        row.append(k)
                        names.append(p.names[i])
                        values.append(p.literals[i])
                        starts.append(at)
                    if len(row) >= HANDED or (k == len(texts) - 1 and row):
                        yield pa.RecordBatch.from_arrays([b["key"].take(pa.array(row)), pa.array(names, pa.string()), pa.array(values, pa.string()), pa.array(starts, pa.int32())], names=["key", "name", "value", "start"])
                        row, names, values, starts = [], [], [], []

    t = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return t.mapInArrow(scan, f"key {kind}, name string, value string, start int").withColumnRenamed("key", key)
