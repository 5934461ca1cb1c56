"""LM scoring by context-tree weighting over bytes.

Each byte is eight binary decisions; each decision has a tree over the bytes before it, to a depth. A node's Krichevsky-Trofimov
estimate is weighed against its children's, depth by depth, by the block probabilities of the training counts. The counts of
(context, byte) of full depth hold all of this: shallower ones are their sums.

The model is as large as the corpus makes it and never leaves the cluster: training tasks send sorted counts to buckets, whose sums
are dealt by the last three context bytes, where subtrees are weighed. Nodes of depth 2 are weighed in groups by their last byte; only
those of depth 1, at most 256 x 255 of them, meet on the driver. To score, blocks of texts ask buckets for the distinct keys they hold and get their values back."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import U64, blocks, bucket_of, lean, mix, opened, pieces, prefix_hash, sliced, span_hash, spread, spread_sorted, squeeze, squeeze_sorted, texts_of, written

DEPTH, TOP = 5, 2
PIECE = 5 << 20
END = mix(np.array([0x656E64], U64))[0]
HALF = math.lgamma(0.5)


def canonical(text: bytes) -> bytes:
    """The scored form: lower-cased words with one space between, then the end as a line feed."""
    return b" ".join(text.lower().split()) + b"\n"


class Piece:
    """Positions and words of some texts: keys holds (context, byte) of each byte, newest byte lowest; doc texts start in `padding`."""

    def __init__(self, texts: list[bytes], depth: int = DEPTH):
        forms = [canonical(t) for t in texts]
        pad = b"\n" * depth
        a = np.frombuffer(pad + pad.join(forms), np.uint8)
        self.sizes = np.array([len(f) for f in forms], np.int64)
        starts = np.cumsum(self.sizes + depth) - self.sizes
        wide = a.astype(U64)
        keys = wide[depth:].copy()
        for j in range(1, depth + 1):
            keys |= wide[depth - j : len(a) - j] << U64(8 * j)
        scored = np.ones(len(keys), bool)
        if len(forms) > 1:
            scored[(starts[1:, None] - 2 * depth + np.arange(depth)).ravel()] = False
        self.keys = keys[scored]
        del wide, keys, scored
        space = (a == 32) | (a == 10)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
        first, past = edge[::2], edge[1::2]
        self.words = span_hash(*prefix_hash(a), first, past)
        self.word_doc = np.searchsorted(starts, first, "right") - 1

    @property
    def byte_doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)


def summed(keys: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    if counts is None:
        u, n = np.unique(keys, return_counts=True)
        return u, n.astype(np.int64)
    order = np.argsort(keys)
    k = keys[order]
    at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
    return k[at], np.add.reduceat(counts[order], at) if len(k) else np.zeros(0, np.int64)


def inverse_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and where each key stands among them."""
    order = np.argsort(keys)
    k = keys[order]
    new = np.ones(len(k), bool)
    np.not_equal(k[1:], k[:-1], out=new[1:])
    at = np.empty(len(k), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - 1
    return k[new], at


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)) if parts else (np.zeros(0, U64), np.zeros(0, np.int64))


def dealt(keys: np.ndarray, hashes: np.ndarray, count: int):
    """(bucket, mask of its keys) for each bucket that gets any; the keys of a mask stay in order."""
    b = bucket_of(hashes, count)
    order = np.argsort(b, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], np.diff(b[order]) != 0))) if len(b) else []
    for i, at in enumerate(cuts):
        to = cuts[i + 1] if i + 1 < len(cuts) else len(b)
        yield int(b[order[at]]), order[at:to]


def batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


KEYED = ([pa.int32(), pa.binary(), pa.binary()], ["bucket", "keys", "counts"])


def count_keys(texts: DataFrame, buckets: int) -> DataFrame:
    """(bucket, keys, counts) from (train, text): what each task has counted. Keys seen only in held-out texts count 0. Buckets from `buckets` on hold words."""

    def run(batches):
        kept: list = [[], []]
        for b in batches:
            train, t = b.column(0).to_numpy(zero_copy_only=False), texts_of(b.column(1))
            for lo, hi in sliced(t, PIECE):
                for flag in (True, False):
                    own = [t[i] for i in range(lo, hi) if bool(train[i]) is flag]
                    if own:
                        p = Piece(own)
                        words = np.append(p.words, np.full(len(own), END))
                        for kind, keys in ((0, p.keys), (1, words)):
                            if flag or kind == 0:
                                k, n = summed(keys, None)
                                kept[kind].append((k, n if flag else n * 0))
                for kind in (0, 1):
                    if len(kept[kind]) > 3:
                        kept[kind] = [merge(kept[kind])]
        for kind in (0, 1):
            keys, counts = merge(kept[kind])
            for b_, at in dealt(keys, mix(keys), buckets):
                yield batch([(b_ + kind * buckets, squeeze_sorted(keys[at]), squeeze(counts[at]))], *KEYED)

    return texts.mapInArrow(lean(run), "bucket int, keys binary, counts binary")


def sum_keys(counted: DataFrame, buckets: int) -> DataFrame:
    """Sums of each bucket: words as they are, with how many and how much, and (context, byte) dealt anew by three context bytes."""

    def run(table):
        bucket = table.column("bucket")[0].as_py()
        keys, counts = merge([(spread_sorted(k), spread(c, np.int64)) for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True)])
        if bucket >= buckets:
            rows = [(bucket, squeeze_sorted(keys), squeeze(counts), len(keys), int(counts.sum()))]
        else:
            rows = [(b, squeeze_sorted(keys[at]), squeeze(counts[at]), 0, 0) for b, at in dealt(keys, mix((keys >> U64(8)) & U64(0xFFFFFF)), buckets)]
        return pa.Table.from_batches([batch(rows, [*KEYED[0], pa.int64(), pa.int64()], [*KEYED[1], "distinct_keys", "total"])])

    return counted.groupBy("bucket").applyInArrow(lean(run), "bucket int, keys binary, counts binary, distinct_keys long, total long")


def lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x >= 0.5: Stirling's series after eight steps up."""
    x = np.asarray(x, np.float64)
    low = np.zeros_like(x)
    for i in range(8):
        low += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


#: Most counts are small: their logarithms of the gamma function are looked up.
SMALL = 1 << 12
HALVES, WHOLES = lgamma(np.arange(SMALL) + 0.5), lgamma(np.arange(2 * SMALL) + 1.0)


def kt_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log-probability that the KT estimator gives to n0 zeros and n1 ones."""
    big = np.flatnonzero((n0 >= SMALL) | (n1 >= SMALL))
    a, b = n0.astype(np.int64), n1.astype(np.int64)
    a[big] = b[big] = 0
    out = HALVES[a] + HALVES[b] - WHOLES[a + b] - 2 * HALF
    x, y = n0[big], n1[big]
    out[big] = lgamma(x + 0.5) + lgamma(y + 0.5) - lgamma(x + y + 1.0) - 2 * HALF
    return out


class Level:
    """Nodes of one depth: key is context << 8 | decision. at: where each node of the depth below, or each decision, has its node."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.keys, self.at = np.unique(keys, return_inverse=True)
        add = lambda w: np.bincount(self.at, weights=w, minlength=len(self.keys))
        self.n0, self.n1 = add(n0), add(n1)
        own = kt_block(self.n0, self.n1)
        if below is None:
            self.log_w, self.beta = own, None
        else:
            children = add(below)
            self.log_w = np.logaddexp(own, children) - math.log(2)
            self.beta = np.exp(np.clip(own - children, -60, 60))

    def one(self) -> np.ndarray:
        """KT probability that the decision is 1."""
        return (self.n1 + 0.5) / (self.n0 + self.n1 + 1.0)

    def up(self, depth: int) -> np.ndarray:
        """Keys of the parents of nodes of this depth."""
        return ((self.keys >> U64(8)) & U64((1 << 8 * (depth - 1)) - 1)) << U64(8) | (self.keys & U64(0xFF))


def decisions(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decision nodes 1..255 and bits, (keys, 8) each, of the newest byte."""
    byte = (keys & U64(0xFF)).astype(np.int64)[:, None]
    k = np.arange(8)
    return (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1


def subtrees(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, dict[int, Level]]:
    """Bits (keys, 8), and the levels DEPTH to TOP + 1 over the given keys."""
    nodes, bits = decisions(keys)
    full = ((keys >> U64(8))[:, None] << U64(8) | nodes.astype(U64)).ravel()
    n = np.repeat(counts.astype(np.float64), 8)
    levels = {DEPTH: Level(full, n * (bits.ravel() == 0), n * (bits.ravel() == 1), None)}
    for d in range(DEPTH - 1, TOP, -1):
        lower = levels[d + 1]
        levels[d] = Level(lower.up(d + 1), lower.n0, lower.n1, lower.log_w)
    return bits, levels


def log_probabilities(keys: np.ndarray, counts: np.ndarray, top: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 P(byte | context) of each key. top: keys of depth TOP, and there the mixture's constant (for 1) and the share of what lies below."""
    bits, levels = subtrees(keys, counts)
    at = levels[DEPTH].at
    one = levels[DEPTH].one()[at]
    for d in range(DEPTH - 1, TOP, -1):
        at = levels[d].at[at]
        w = levels[d].beta[at] / (1 + levels[d].beta[at])
        one = w * levels[d].one()[at] + (1 - w) * one
    up = levels[TOP + 1].up(TOP + 1)[at]
    i = np.searchsorted(top[0], up)
    one = top[1][i] + top[2][i] * one
    p = np.where(bits.ravel() == 1, one, 1 - one)
    return np.log10(p).reshape(-1, 8).sum(1)


def mixed(levels: list[Level]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mixture over some levels, the deepest first, as a constant and a share of what lies below for each node of the deepest."""
    at = np.arange(len(levels[0].keys))
    const, share = np.zeros(len(at)), np.ones(len(at))
    for i, level in enumerate(levels):
        at = at if i == 0 else level.at[at]
        w = level.beta[at] / (1 + level.beta[at])
        const, share = w * level.one()[at] + (1 - w) * const, (1 - w) * share
    return levels[0].keys, const, share


NODES = ("n0", "n1", "below")


def level_of(table: pa.Table) -> Level:
    column = lambda c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False)
    return Level(column("node").astype(U64), *map(column, NODES))


def opened_counts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return merge([(spread_sorted(k), spread(c, np.int64)) for k, c in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True)])


def top_nodes(model: DataFrame) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bucket, node, n0, n1, below) of the depth-TOP nodes each bucket has keys under, summed over all buckets; the mixture of the depths above."""

    def parts(table):
        level = subtrees(*opened_counts(table))[1][TOP + 1]
        u, at = np.unique(level.up(TOP + 1), return_inverse=True)
        add = lambda w: np.bincount(at, weights=w, minlength=len(u))
        return pa.table({"bucket": np.full(len(u), table.column("bucket")[0].as_py(), np.int32), "node": u.astype(np.int64), "n0": add(level.n0), "n1": add(level.n1), "below": add(level.log_w)})

    def above(table):
        level = level_of(table)
        up = Level(level.up(TOP), level.n0, level.n1, level.log_w)
        return pa.table({"node": up.keys.astype(np.int64), "n0": up.n0, "n1": up.n1, "below": np.bincount(up.at, weights=level.log_w, minlength=len(up.keys))})

    sums = [F.sum(c).alias(c) for c in NODES]
    own = written(model.groupBy("bucket").applyInArrow(lean(parts), "bucket int, node long, n0 double, n1 double, below double"))
    whole = own.groupBy("node").agg(*sums)
    # a context of TOP bytes by its newest one, below 256 x 255 nodes a group and 255 that leave it
    got = whole.groupBy(F.shiftright("node", 8).bitwiseAND(0xFF).alias("last")).applyInArrow(lean(above), "node long, n0 double, n1 double, below double").groupBy("node").agg(*sums).toPandas()
    one = Level(*(got[c].to_numpy().astype(t) for c, t in (("node", U64), ("n0", float), ("n1", float), ("below", float))))
    root = Level(one.up(1), one.n0, one.n1, one.log_w)
    return own.select("bucket", "node").join(whole, "node"), mixed([one, root])


def values(model: DataFrame, buckets: int, nodes: DataFrame, above) -> DataFrame:
    """(bucket, keys, vals): log-probabilities of all (context, byte), dealt by the key."""
    shared = model.sparkSession.sparkContext.broadcast(above)

    def run(table, own):
        if not table.num_rows:
            return pa.Table.from_batches([batch([], KEYED[0], ["bucket", "keys", "vals"])])
        keys, counts = opened_counts(table)
        upper, const, share = shared.value
        node, own_const, own_share = mixed([level_of(own)])
        i = np.searchsorted(upper, node & U64(0xFFFF))
        top = node, const[i] + share[i] * own_const, share[i] * own_share
        lp = log_probabilities(keys, counts, top).astype(np.float32)
        return pa.Table.from_batches([batch([(b, squeeze_sorted(keys[at]), squeeze(lp[at])) for b, at in dealt(keys, mix(keys), buckets)], KEYED[0], ["bucket", "keys", "vals"])])

    return model.groupBy("bucket").cogroup(nodes.groupBy("bucket")).applyInArrow(lean(run), "bucket int, keys binary, vals binary")


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", modulus: int = 7, held: int = 2) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte.

    Held out are rows with crc32(id as text) mod `modulus` equal to `held`; a null id counts as the empty text. The model and the
    base learn from the others. score is the log10 probability of the text's canonical form, one space between words and the end included;
    null text scores as empty. bits_per_byte divides its code length by the bytes of that form. Repeated rows are scored and counted each."""
    held_out = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(modulus)) == held
    buckets = pieces(docs, text, PIECE)
    model = written(sum_keys(count_keys(docs.select((~held_out).alias("train"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")), buckets), buckets))
    size = model.where(F.col("bucket") >= buckets).agg(F.sum("distinct_keys").alias("v"), F.sum("total").alias("n")).first()
    v, n = size["v"] or 0, size["n"] or 0
    trees = model.where(F.col("bucket") < buckets)
    known = values(trees, buckets, *top_nodes(trees)).unionByName(model.where(F.col("bucket") >= buckets).select("bucket", "keys", F.col("counts").alias("vals")))
    parts = blocks(docs, id_col, text, buckets)

    def asked(table):
        t, rows = texts_of(opened(table).column("text")), []
        block = table.column("block")[0].as_py()
        for k, (lo, hi) in enumerate(sliced(t, 2 * PIECE)):
            p = Piece(t[lo:hi])
            for kind, keys in ((0, np.unique(p.keys)), (1, np.unique(np.append(p.words, END)))):
                rows += [(b + kind * buckets, block, k, squeeze_sorted(keys[at])) for b, at in dealt(keys, mix(keys), buckets)]
        return pa.Table.from_batches([batch(rows, [pa.int32(), pa.int32(), pa.int32(), pa.binary()], ["bucket", "block", "slice", "keys"])])

    def answered(left, right):
        bucket = left.column("bucket")[0].as_py() if left.num_rows else 0
        kind = np.float32 if bucket < buckets else np.int64
        ks = [spread_sorted(k) for k in right.column("keys").to_pylist()]
        vs = [spread(x, kind) for x in right.column("vals").to_pylist()]
        keys, vals = (np.concatenate(ks), np.concatenate(vs)) if ks else (np.zeros(0, U64), np.zeros(0, kind))
        order = np.argsort(keys)
        keys, vals = keys[order], vals[order]
        rows = []
        for block, k, q in zip(left.column("block").to_pylist(), left.column("slice").to_pylist(), left.column("keys").to_pylist(), strict=True):
            q = spread_sorted(q)
            at = np.minimum(np.searchsorted(keys, q), max(len(keys) - 1, 0))
            got = np.where(keys[at] == q, vals[at], 0).astype(kind) if len(keys) else np.zeros(len(q), kind)
            rows.append((block, k, bucket, squeeze(got)))
        return pa.Table.from_batches([batch(rows, [pa.int32(), pa.int32(), pa.int32(), pa.binary()], ["block", "slice", "bucket", "vals"])])

    names = ["doc_id", "n_tokens", "n_known", "base_score", "score", "n_bytes"]

    def scored(left, right):
        out = []
        answers = {(k, b): x for k, b, x in zip(right.column("slice").to_pylist(), right.column("bucket").to_pylist(), right.column("vals").to_pylist(), strict=True)}
        left = opened(left)
        t, ids = texts_of(left.column("text")), left.column("doc_id")
        for k, (lo, hi) in enumerate(sliced(t, 2 * PIECE)):
            p = Piece(t[lo:hi])
            m = hi - lo
            keys, at = inverse_of(p.keys)
            vals = np.zeros(len(keys), np.float32)
            for b, own in dealt(keys, mix(keys), buckets):
                vals[own] = spread(answers[k, b], np.float32)
            total = np.bincount(p.byte_doc, weights=vals[at], minlength=m)
            del keys, vals, at
            words, at = inverse_of(np.append(p.words, END))
            counts = np.zeros(len(words), np.int64)
            for b, own in dealt(words, mix(words), buckets):
                counts[own] = spread(answers[k, b + buckets], np.int64)
            each, end = counts[at[:-1]], counts[at[-1]]
            logs = lambda c: np.log10((c + 1.0) / (n + 1.0 * (v + 1)))
            base = np.bincount(p.word_doc, weights=logs(each), minlength=m) + logs(end)
            out.append([np.bincount(p.word_doc, minlength=m) + 1, np.bincount(p.word_doc, weights=each > 0, minlength=m).astype(np.int64) + int(end > 0), base, total, p.sizes])
        return pa.table([ids, *(pa.array(np.concatenate([o[i] for o in out])) for i in range(5))], names)

    ask = parts.groupBy("block").applyInArrow(lean(asked), "bucket int, block int, slice int, keys binary")
    reply = ask.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(lean(answered), "block int, slice int, bucket int, vals binary")
    result = parts.groupBy("block").cogroup(reply.groupBy("block")).applyInArrow(lean(scored), f"doc_id {dict(docs.dtypes)[id_col]}, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    held_again = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(modulus)) == held
    return result.select("doc_id", held_again.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"))


def op1_ctw(spark, sf_dir: str) -> DataFrame:
    """Scores of all `documents`, learned from those whose crc32(doc_id) mod 7 is not 2."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
