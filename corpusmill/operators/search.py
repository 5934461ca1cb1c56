"""Full-text search over an inverted index: postings of stemmed words, in folders by a hash of the word, that a query joins.

A query reads the folders of its words, and in them the row groups that may hold them; texts are read once, when the index is built."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.stem import STOP, stem

BUCKETS = 64


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


#: Words that a task keeps the stems of.
KNOWN = 1 << 19


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, term, at) of batches of (key, words): where the words of a stem stand in a text; stop words counted but left out."""
    numbers: dict[str, int] = {}
    stems: list[str] = []
    known: dict[str, int] = dict.fromkeys(STOP, -1)
    for b in batches:
        if len(known) > KNOWN:
            numbers, stems, known = {}, [], dict.fromkeys(STOP, -1)
        lists = b["words"]
        flat = lists.flatten().dictionary_encode()
        of = []
        for w in flat.dictionary.to_pylist():
            n = known.get(w)
            if n is None:
                s = stem(w)
                n = numbers.get(s)
                if n is None:
                    n = numbers[s] = len(stems)
                    stems.append(s)
                known[w] = n
            of.append(n)
        term = np.array(of, np.int64)[flat.indices.to_numpy()]
        size = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(size)), size)
        at = np.arange(len(term)) - np.repeat(np.cumsum(size) - size, size) + 1
        own = np.flatnonzero(term >= 0)
        order = own[np.lexsort((term[own], row[own]))]
        row, term, at = row[order], term[order], at[order].astype(np.int32)
        begins = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])))) if len(row) else np.array([], np.int64)
        kept, place = np.unique(term[begins], return_inverse=True)
        names = pa.array([stems[n] for n in kept.tolist()], pa.string())
        lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(row)).astype(np.int32)), pa.array(at))
        yield pa.RecordBatch.from_arrays([b["key"].take(pa.array(row[begins])), names.take(pa.array(place)), lists], names=["key", "term", "at"])


def places(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, at): where the words of a stem stand in a row's text.

    A task stems each distinct word once; nothing is shuffled."""
    t = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where(F.col("text").isNotNull())
    kind = dict(t.dtypes)["key"]
    return t.select("key", tokens(F.col("text")).alias("words")).mapInArrow(_placed, f"key {kind}, term string, at array<int>")


def _together(placed: DataFrame, *by: str) -> DataFrame:
    return placed.groupBy(*by).agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("positions"))


def terms(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, positions): where the stems of a text's words stand, from 1, stop words counted but left out. Null texts have none."""
    return _together(places(rows, key, text), "key", "term")


def build(rows: DataFrame, key: str, text: str, path: str, buckets: int = BUCKETS, files: int = 16) -> None:
    """Writes the index of a column of texts. A bucket is dealt to so many parts by the hash of the key, so that a word of all rows is split like any others.

    Places travel once, to their part, and are put together there; texts are read and stemmed once."""
    p = places(rows, key, text).withColumn("bucket", bucket(F.col("term"), buckets)).withColumn("part", bucket(F.col("key"), files))
    p = p.repartition("bucket", "part")
    _together(p, "bucket", "part", "term", "key").select("key", "term", "positions", "bucket").sortWithinPartitions("bucket", "term", "key").write.mode("overwrite").partitionBy("bucket").parquet(path)


def stems_of(spark: SparkSession, query: str) -> list[str]:
    """The distinct stems of a query's words but for stop words."""
    return sorted(r["term"] for r in terms(spark.createDataFrame([(0, query)], "k int, q string"), "k", "q").select("term").collect())


def matching(spark: SparkSession, path: str, query: str, buckets: int = BUCKETS) -> DataFrame:
    """(key): the rows that hold all words of a query, by their stems; none for a query of stop words only."""
    wanted = stems_of(spark, query)
    p = spark.read.parquet(path)
    if not wanted:
        return p.select("key").limit(0)
    at = [r["b"] for r in spark.createDataFrame([(w,) for w in wanted], "w string").select(bucket(F.col("w"), buckets).alias("b")).distinct().collect()]
    hits = p.where(F.col("bucket").isin(at) & F.col("term").isin(wanted))
    return hits.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("key")


def matching_all(spark: SparkSession, path: str, queries: DataFrame, key: str, text: str, buckets: int = BUCKETS) -> DataFrame:
    """(query, key) for each row of `queries` (key, text): as matching(), for any number of queries in one join with the postings."""
    asked = terms(queries, key, text).select(F.col("key").alias("query"), "term", bucket(F.col("term"), buckets).alias("bucket"))
    number = asked.groupBy("query").agg(F.count(F.lit(1)).alias("wanted"))
    hits = spark.read.parquet(path).join(asked, ["bucket", "term"]).groupBy("query", "key").agg(F.count(F.lit(1)).alias("n"))
    return hits.join(number, "query").where(F.col("n") == F.col("wanted")).select("query", "key")


def phrase(spark: SparkSession, path: str, query: str, buckets: int = BUCKETS) -> DataFrame:
    """(key, position): where the words of a query stand in the same order and at the same distances, stop words counted."""
    own = terms(spark.createDataFrame([(0, query)], "k int, q string"), "k", "q").select("term", F.explode("positions").alias("offset"))
    wanted = own.collect()  # the words of one query
    if not wanted:
        return spark.read.parquet(path).select("key", F.lit(0).alias("position")).limit(0)
    names = sorted({r["term"] for r in wanted})
    at = [r["b"] for r in spark.createDataFrame([(w,) for w in names], "w string").select(bucket(F.col("w"), buckets).alias("b")).distinct().collect()]
    first = min(r["offset"] for r in wanted)
    hits = spark.read.parquet(path).where(F.col("bucket").isin(at) & F.col("term").isin(names)).select("key", "term", F.explode("positions").alias("p"))
    placed = hits.join(F.broadcast(own), "term").select("key", (F.col("p") - F.col("offset") + first).alias("position"))
    return placed.groupBy("key", "position").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("key", "position")
