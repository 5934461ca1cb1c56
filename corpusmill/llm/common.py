"""Shared plumbing of the pipeline operators: packed rows, text blocks, written tables, components."""

from __future__ import annotations

import ctypes
import inspect
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII whitespace as the word contracts name it; bytes.split() without arguments splits on the same six bytes.
ASCII_SPACE = r"\x20\x09-\x0D"
U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees. The session's spark.checkpoint.dir; a folder under the warehouse where it is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def written_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/written-{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: survives lost executors, and later jobs prune columns.

    The copies of an application stand in one folder; discard() deletes it once the results are stored."""
    path = f"{written_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Deletes what written() has left in the shared folder. Results that are not stored yet can no longer be computed."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(written_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Returns freed memory to the system: a Python worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(f):
    """f, a function of one group, of two, or of an iterator of batches, with give_back() at its end."""

    def batches(x):
        yield from f(x)
        give_back()

    def group(x):
        out = f(x)
        give_back()
        return out

    def groups(x, y):
        out = f(x, y)
        give_back()
        return out

    return batches if inspect.isgeneratorfunction(f) else group if len(inspect.signature(f).parameters) == 1 else groups


def pieces(docs: DataFrame, text: str, piece_bytes: int) -> int:
    """Number of pieces of about piece_bytes of text: follows the whole input, at least 1."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return max(1, -(-((total["b"] or 0) + 64 * total["n"]) // piece_bytes))


def blocks(docs: DataFrame, id_col: str, text: str, count: int, others: tuple[str, ...] = ()) -> DataFrame:
    """(block, body): rows dealt to `count` blocks by a hash of id and text; null text becomes empty.

    What a task reads for one block goes as one compressed Arrow table of doc_id, text and the columns `others`; see opened()."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.pmod(F.xxhash64(F.col(id_col).cast("string"), t), F.lit(count)).cast("int"), F.col(f"`{id_col}`").alias("doc_id"), t.alias("text"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(others)])
    return rows.mapInArrow(lean(_packed_blocks), "block int, body binary")


def _packed_blocks(batches):
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for b in batches:
        block = b.column(0).to_numpy(zero_copy_only=False)
        order = np.argsort(block, kind="stable")
        cuts = [*np.flatnonzero(np.diff(block[order], prepend=-1)), len(block)]
        body = b.select(b.schema.names[1:])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, body.schema, options=options) as out:
                out.write_batch(body.take(pa.array(order[lo:hi])))
            yield pa.RecordBatch.from_arrays([pa.array([block[order[lo]]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "body"])


def opened(group: pa.Table) -> pa.Table:
    """doc_id and text of a block's rows, in the same order each time: the parts of a shuffle may come in any."""
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in sorted(group.column("body").to_pylist())])


def squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def spread(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def squeeze_sorted(a: np.ndarray) -> bytes:
    """Ascending uint64 keys, as compressed differences; bytes of the same weight stand together."""
    d = np.diff(a, prepend=U64(0)) if len(a) else a
    return squeeze(np.ascontiguousarray(d).view(np.uint8).reshape(-1, 8).T)


def spread_sorted(b: bytes) -> np.ndarray:
    d = np.ascontiguousarray(spread(b, np.uint8).reshape(8, -1).T)
    return np.cumsum(d.view(U64).ravel(), dtype=U64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): spreads keys evenly over buckets."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


def bucket_of(h: np.ndarray, count: int) -> np.ndarray:
    """Bucket of each mixed hash, by its high bits."""
    return ((h >> U64(32)) * U64(count) >> U64(32)).astype(np.int64)


def texts_of(column) -> list[bytes]:
    """UTF-8 bytes of each value of an Arrow string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            return [b for c in column.chunks for b in texts_of(c)]
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
BASE, BASE_INVERSE = U64(0x9E3779B97F4A7C15), U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(n: int, base: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(max(n, 1), base, U64)
        out[0] = 1
        return np.multiply.accumulate(out)


CHUNK = 1 << 14
POWERS, INVERSES = powers(CHUNK + 1, BASE), powers(CHUNK, BASE_INVERSE)


class InversePowers:
    """Powers of BASE_INVERSE by position, as products from two small tables."""

    def __init__(self, n: int):
        self.steps = powers(n // CHUNK + 1, U64(pow(int(BASE_INVERSE), CHUNK, 1 << 64)))

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        out = np.take(INVERSES, at & (CHUNK - 1))
        out *= np.take(self.steps, at // CHUNK)
        return out


def prefix_hash(a: np.ndarray) -> tuple[np.ndarray, InversePowers]:
    """Prefix sums of a polynomial over the bytes, and the inverse powers that make spans comparable. Chunks stay in the processor's cache."""
    sums = np.empty(len(a) + 1, U64)
    sums[0] = 0
    with np.errstate(over="ignore"):
        step = U64(1)
        for lo in range(0, len(a), CHUNK):
            x = np.take(BYTE_CODES, a[lo : lo + CHUNK])
            x *= POWERS[: len(x)]
            x *= step
            x[0] += sums[lo]
            np.cumsum(x, dtype=U64, out=sums[lo + 1 : lo + 1 + len(x)])
            step = step * POWERS[CHUNK]
    return sums, InversePowers(len(a) + 1)


def span_hash(sums: np.ndarray, inverse: InversePowers, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end)."""
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U64))


def components(edges: DataFrame) -> DataFrame:
    """(node, component_id) for each node of undirected edges (a, b); component_id is the least node reachable.

    Each round every node takes the least label among its neighbours and then its label's label, as grouped minima;
    rounds end when no label changes. Labels are cut from their lineage each round, in as many parts as their number asks for."""
    both = cut(edges.where("a <> b").select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    parts = 1 + both.count() // 200_000
    both = both.coalesce(parts)
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    labels = cut(labels.coalesce(parts))
    if both.isEmpty():
        return labels.select("node", F.col("label").alias("component_id"))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = labels.join(near, "node").join(hop, "label", "left").select("node", F.least("label", "m", "up").alias("new"), "label")
        new = cut(new.coalesce(parts))
        changed = new.where("new <> label").limit(1).count()
        labels = new.select("node", F.col("new").alias("label"))
        if not changed:
            return labels.select("node", F.col("label").alias("component_id"))


class Words:
    """64-bit hashes of the words of some texts, lower-cased A-Z, cut at ASCII whitespace; counts and starts by text."""

    def __init__(self, texts: list[bytes]):
        forms = [b" ".join(t.lower().split()) + b"\n" for t in texts]
        sizes = np.array([len(f) for f in forms], np.int64)
        a = np.frombuffer(b"".join(forms), np.uint8)
        space = (a == 32) | (a == 10)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
        first, past = edge[::2], edge[1::2]
        self.hashes = span_hash(*prefix_hash(a), first, past)
        self.doc = np.searchsorted(np.cumsum(sizes) - sizes, first, "right") - 1
        self.counts = np.bincount(self.doc, minlength=len(texts))
        self.starts = np.cumsum(self.counts) - self.counts

    def shingles(self, n: int) -> list[np.ndarray]:
        """Each text's distinct n-word shingles, ascending; texts of fewer words have the whole sequence as one, texts without words none."""
        h = self.hashes
        with np.errstate(over="ignore"):
            roll = np.zeros(max(len(h) - n + 1, 0), U64)
            for j in range(n):
                roll += h[j : len(h) - n + 1 + j] * powers(n, U64(0xD1342543DE82EF95))[j] if len(roll) else roll
            roll = mix(roll)
            out = []
            for s, c in zip(self.starts, self.counts, strict=True):
                if c >= n:
                    out.append(np.unique(roll[s : s + c - n + 1]))
                elif c:
                    out.append(mix((h[s : s + c] * powers(int(c), U64(0xD1342543DE82EF95))).sum(dtype=U64, keepdims=True) + U64(c)))
                else:
                    out.append(np.zeros(0, U64))
        return out


def sliced(texts: list[bytes], size: int):
    """Ranges of texts of about `size` bytes."""
    lo = 0
    while lo < len(texts):
        hi, n = lo, 0
        while hi < len(texts) and (hi == lo or n + len(texts[hi]) <= size):
            n += len(texts[hi]) + 8
            hi += 1
        yield lo, hi
        lo = hi


def packed(rows: list[tuple], types: list, names: list[str]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def by_bucket(keys: np.ndarray, count: int):
    """(bucket, indices in ascending order of key) for each bucket that has keys."""
    order = np.argsort(keys, kind="stable")
    b = bucket_of(keys[order], count)
    cuts = np.flatnonzero(np.concatenate(([True], np.diff(b) != 0))) if len(b) else []
    for i, at in enumerate(cuts):
        yield int(b[at]), order[at : cuts[i + 1] if i + 1 < len(cuts) else len(b)]
