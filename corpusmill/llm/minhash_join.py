"""MinHash near-duplicates by an inverted join over signature coordinates.

Texts with equal shingle sets are one class. Each class is posted under its (coordinate, value) pairs; pairs that one class alone has can't collide
and are dropped, and so is a class with fewer shared pairs than `matches`. Of the others only a prefix is posted on: the rarest shared
pairs, as many as two classes need so that `matches` collisions force a common one. The same holds of shingles: only those that two
posted classes have can be in an intersection, so classes with too few of them for any partner in their lists go.

Lists are merged with skips. In each the members first meet one lead, the one with the most common values; a list of m copies makes m
pairs, and most members find their component. Those that the lead does not join are listed again by a few coordinates, each list with a lead of
its own: families of near copies under a foreign lead join there. Members of one component are passed over from then on. Two others
of a list can share, in the lead's set, no more than either has there, and outside it just what both have; pairs that this bound lets
through collide in `matches` coordinates or go, and what remains is confirmed on the full sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import U64, Words, by_bucket, components, lean, mix, packed, sliced, spread, spread_sorted, squeeze, squeeze_sorted, texts_of, written

COORDINATES, SHINGLE, SLICE, BLOCK, SET_BYTES = 64, 5, 1 << 20, 20_000, 8 << 20
#: Coordinates by which the members that a lead has not joined are listed once more.
SPLITS = 6
_DRAWN = mix(np.arange(1, 2 * COORDINATES + 1, dtype=U64) * U64(0xA0761D6478BD642F))
FACTORS, ADDENDS = _DRAWN[:COORDINATES] | U64(1), _DRAWN[COORDINATES:]


def least_matches(percent: int) -> int:
    """Collisions that a pair at the threshold misses with a probability of some 1e-5: 4.5 standard deviations below the mean."""
    j = percent / 100
    return max(1, math.floor(COORDINATES * j - 4.5 * math.sqrt(COORDINATES * j * (1 - j))))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, COORDINATES) 32-bit minima; sets must not be empty."""
    x = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), COORDINATES), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(COORDINATES):
            out[:, i] = np.minimum.reduceat(((x * FACTORS[i] + ADDENDS[i]) >> U64(32)).astype(np.uint32), starts)
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two longs."""
    if not len(s):
        return 0, 0
    with np.errstate(over="ignore"):
        both = np.array([s.sum(dtype=U64) + U64(len(s)), np.bitwise_xor.reduce(mix(s))], U64)
    a = mix(both)
    return int(a[:1].view(np.int64)[0]), int(a[1:].view(np.int64)[0])


def rows_of(docs: DataFrame, id_col: str, text: str, size: int, with_set: bool) -> DataFrame:
    """(doc_id, text_key, n, cid, check) and the signature or the set, as bytes, of each row."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(t).alias("text_key"), t.alias("t"))

    def run(batches):
        for b in batches:
            texts = texts_of(b.column(2))
            for lo, hi in sliced(texts, SLICE):
                sets = Words(texts[lo:hi]).shingles(size)
                keys = [set_key(s) for s in sets]
                if with_set:
                    body = [s.tobytes() for s in sets]
                else:
                    full = [s for s in sets if len(s)]
                    sig = iter(signatures(full)) if full else iter(())
                    body = [next(sig).tobytes() if len(s) else b"" for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(body, pa.binary())], ["doc_id", "text_key", "n", "cid", "check", "body"])

    return rows.mapInArrow(lean(run), f"doc_id {dict(rows.dtypes)['doc_id']}, text_key long, n long, cid long, check long, body binary")


def postings(classes: DataFrame, matches: int, blocks: int) -> DataFrame:
    """(key, cid, weight) of the prefix of each class that can reach `matches` collisions; weight: the classes under all its keys, summed."""

    def keys_of(group):
        sig = np.frombuffer(b"".join(group.column("body").to_pylist()), np.uint32).reshape(-1, COORDINATES)
        return mix(sig.astype(U64) | (np.arange(COORDINATES, dtype=U64) << U64(32)))

    def ask(group):
        block = group.column("block")[0].as_py()
        flat = keys_of(group).ravel()
        return packed([(b, block, squeeze_sorted(flat[at])) for b, at in by_bucket(flat, blocks)], [pa.int32(), pa.int32(), pa.binary()], ["bucket", "block", "keys"])

    def count(sent):
        bucket = sent.column("bucket")[0].as_py()
        keys = [spread_sorted(k) for k in sent.column("keys").to_pylist()]
        _, at, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        parts = np.split(n[at].astype(np.uint32), np.cumsum([len(k) for k in keys])[:-1])
        return packed([(b, bucket, squeeze(p)) for b, p in zip(sent.column("block").to_pylist(), parts, strict=True) if (p > 1).any()], [pa.int32(), pa.int32(), pa.binary()], ["block", "bucket", "sizes"])

    def prefix(group, replies):
        keys = keys_of(group)
        flat, sizes = keys.ravel(), np.ones(keys.size, np.uint32)
        told = dict(zip(replies.column("bucket").to_pylist(), replies.column("sizes").to_pylist(), strict=True))
        for b, at in by_bucket(flat, blocks):
            if b in told:
                sizes[at] = spread(told[b], np.uint32)
        sizes = sizes.reshape(keys.shape)
        order = np.lexsort((keys, sizes), axis=1)[:, : COORDINATES - matches + 1]
        chosen = np.zeros(keys.shape, bool)
        np.put_along_axis(chosen, order, True, 1)
        chosen &= (sizes > 1) & ((sizes > 1).sum(1) >= matches)[:, None]
        r, _ = np.nonzero(chosen)
        cids = group.column("cid").combine_chunks().to_numpy(zero_copy_only=False)
        return pa.table({"key": keys[chosen].view(np.int64), "cid": cids[r], "weight": sizes.sum(1, dtype=np.int64)[r]})

    g = classes.groupBy("block")
    sizes = g.applyInArrow(lean(ask), "bucket int, block int, keys binary").groupBy("bucket").applyInArrow(lean(count), "block int, bucket int, sizes binary")
    return g.cogroup(sizes.groupBy("block")).applyInArrow(lean(prefix), "key long, cid long, weight long")


def shared_sets(sets: DataFrame, percent: int) -> DataFrame:
    """(cid, n, s, body) from (cid, n, body): body without the shingles that no other set has, s of n; sets go that could reach `percent` with none."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    count = max(1, -(-8 * total // SET_BYTES))
    g = sets.withColumn("block", F.pmod("cid", F.lit(count)).cast("int")).groupBy("block")

    def distinct(group):
        flat = np.frombuffer(b"".join(group.column("body").to_pylist()), U64)
        return flat, *np.unique(flat, return_inverse=True, return_counts=True)

    def ask(group):
        block = group.column("block")[0].as_py()
        _, keys, _, n = distinct(group)
        return packed([(b, block, squeeze_sorted(keys[at]), squeeze(np.packbits(n[at] > 1))) for b, at in by_bucket(keys, count)], [pa.int32(), pa.int32(), pa.binary(), pa.binary()], ["bucket", "block", "keys", "twice"])

    def tell(sent):
        bucket = sent.column("bucket")[0].as_py()
        keys = [spread_sorted(k) for k in sent.column("keys").to_pylist()]
        twice = [np.unpackbits(spread(x, np.uint8), count=len(k)) for x, k in zip(sent.column("twice").to_pylist(), keys, strict=True)]
        _, at, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        parts = np.split((n[at] > 1) | (np.concatenate(twice) > 0), np.cumsum([len(k) for k in keys])[:-1])
        return packed([(b, bucket, squeeze(np.packbits(p))) for b, p in zip(sent.column("block").to_pylist(), parts, strict=True)], [pa.int32(), pa.int32(), pa.binary()], ["block", "bucket", "marks"])

    def keep(group, replies):
        flat, keys, at, _ = distinct(group)
        told = dict(zip(replies.column("bucket").to_pylist(), replies.column("marks").to_pylist(), strict=True))
        shared = np.zeros(len(keys), bool)
        for b, x in by_bucket(keys, count):
            shared[x] = np.unpackbits(spread(told[b], np.uint8), count=len(x)).astype(bool)
        own, rows, lo = shared[at], [], 0
        for cid, n in zip(group.column("cid").to_pylist(), group.column("n").to_pylist(), strict=True):
            body = flat[lo : lo + n][own[lo : lo + n]]
            lo += n
            if 100 * len(body) >= percent * n:
                rows.append((cid, n, len(body), body.tobytes()))
        return packed(rows, [pa.int64(), pa.int64(), pa.int64(), pa.binary()], ["cid", "n", "s", "body"])

    marks = g.applyInArrow(lean(ask), "bucket int, block int, keys binary, twice binary").groupBy("bucket").applyInArrow(lean(tell), "block int, bucket int, marks binary")
    return g.cogroup(marks.groupBy("block")).applyInArrow(lean(keep), "cid long, n long, s long, body binary")


def compared(pairs: DataFrame, bodies: DataFrame, kind, same, with_rest: bool = False) -> DataFrame:
    """pairs (a, b, n_a, n_b) with score: same(body of a, body of b); rest: what b has and a has not. Bodies meet by joins on cid."""
    j = pairs.join(bodies.select(F.col("cid").alias("b"), F.col("body").alias("body_b")), "b").join(bodies.select(F.col("cid").alias("a"), F.col("body").alias("body_a")), "a")

    def run(batches):
        for x in batches:
            both = [(np.frombuffer(p, kind), np.frombuffer(q, kind)) for p, q in zip(x.column(4).to_pylist(), x.column(5).to_pylist(), strict=True)]
            out = [*(x.column(i) for i in range(4)), pa.array([int(same(p, q)) for p, q in both], pa.int64())]
            if with_rest:
                out.append(pa.array([np.setdiff1d(q, p, assume_unique=True).view(np.int64) for p, q in both], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(out, ["a", "b", "n_a", "n_b", "score", "rest"][: len(out)])

    return j.select("a", "b", "n_a", "n_b", "body_a", "body_b").mapInArrow(lean(run), "a long, b long, n_a long, n_b long, score long" + ", rest array<long>" * with_rest)


def common(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


def met_by_lead(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(a, b, n_a, n_b): under each of the keys one row of (cid, n) leads, the last by `order`, and the others meet it; each pair once."""
    leads = rows.groupBy(*keys).agg(F.max_by(F.struct("cid", "n"), F.struct(*order, "cid")).alias("_lead"))
    met = rows.join(leads, keys).where("_lead.cid <> cid")
    return met.select(F.col("_lead.cid").alias("a"), F.col("cid").alias("b"), F.col("_lead.n").alias("n_a"), F.col("n").alias("n_b")).distinct()


def sublists(members: DataFrame, sigs: DataFrame) -> DataFrame:
    """Members (lead, cid, n) that their lead does not join, under the lead and each of the first SPLITS coordinates of their signatures: pairs with the
    largest of each list. So a family of near copies whose list is led by another text finds its component by a few pairs a member."""
    values = F.array(*[F.hex(F.substring("body", 4 * i + 1, 4)) for i in range(SPLITS)])
    own = members.join(sigs.select("cid", values.alias("_v")), "cid").select("lead", "cid", "n", F.posexplode("_v").alias("i", "v"))
    return met_by_lead(own, ["lead", "i", "v"], ["n"])


def links_of(posted: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int, matches: int) -> DataFrame:
    """(a, b) linked classes that join all linked ones of (key, cid, weight); sigs: (cid, body), sets: (cid, n, s, body) of shared shingles."""
    # what a pair of n and m shingles has in common at the least
    enough = lambda have, n, m: (100 + percent) * have >= percent * (n + m)
    linked = enough(F.col("score"), F.col("n_a"), F.col("n_b"))
    here = posted.join(sets.select("cid", "n", "s"), "cid")
    lists = here.groupBy("key").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1")
    here = here.join(lists, "key").where(enough(F.col("s"), F.col("n"), F.greatest("least", F.ceil(F.col("n") * percent / 100))))
    met = written(compared(met_by_lead(here, ["key"], ["weight"]), sets, U64, common, True))
    apart = met.where(~linked).select(F.col("a").alias("lead"), F.col("b").alias("cid"), F.col("n_b").alias("n"))
    around = compared(sublists(apart, sigs), sets, U64, common).where(linked).select("a", "b")
    first = written(met.where(linked).select("a", "b").unionByName(around))
    labels = components(first).select(F.col("node").alias("cid"), F.col("component_id").alias("label"))
    members = met.select(F.col("a").alias("lead"), F.col("b").alias("cid"), F.col("score").alias("inside"), F.col("n_b").alias("n"), "rest")
    members = members.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    main = met.select(F.col("a").alias("lead")).distinct().join(labels, F.col("lead") == F.col("cid"), "left").select("lead", F.coalesce("label", "lead").alias("main"))
    members = written(members.join(main, "lead").select("lead", "cid", "label", "main", "n", "inside", "rest"))
    x = members.where("label <> main")
    y = members.select("lead", *[F.col(c).alias(f"_{c}") for c in ("cid", "label", "n", "inside", "rest")])
    other = (F.col("label") != F.col("_label")) & ((F.col("_label") == F.col("main")) | (F.col("cid") < F.col("_cid")))
    # two bounds, the cheap one first: how much of what stands outside the lead either has, and how much of it both have
    inside, needed = F.least("inside", "_inside"), lambda have: enough(have, F.col("n"), F.col("_n"))
    bound = needed(inside + F.least(F.size("rest"), F.size("_rest"))) & needed(inside + F.size(F.array_intersect("rest", "_rest")))
    lower = F.col("cid") < F.col("_cid")
    sizes = [F.when(lower, F.col(u)).otherwise(F.col(v)).alias(w) for u, v, w in (("n", "_n", "n_a"), ("_n", "n", "n_b"))]
    pairs = x.join(y, (x["lead"] == y["lead"]) & other & bound).select(F.least("cid", "_cid").alias("a"), F.greatest("cid", "_cid").alias("b"), *sizes).distinct()
    close = compared(pairs, sigs, np.uint32, lambda p, q: (p == q).sum()).where(F.col("score") >= matches).drop("score")
    second = compared(close, sets, U64, common).where(linked).select("a", "b")
    return first.unionByName(second)


def near_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key) for each row of docs.

    Linked are texts with 100 * |A n B| >= percent * |A u B| over their shingle sets, as confirmed on the full sets;
    component_id is the least id reachable. Texts without words (null and blank ones too) have an empty set and link with nothing; equal
    texts of any number are one class. Rows with a null id take part; their class's id is its least id that is not null. kept:
    doc_id = component_id, so repeated rows of one id are kept alike."""
    matches = least_matches(percent)
    rows = written(rows_of(docs, id_col, text, shingle, False))
    many = rows.count()
    blocks = max(1, -(-many // BLOCK))
    full = rows.where("n > 0")
    classes = full.groupBy("cid", "check").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.any_value("body").alias("body"), F.min("doc_id").alias("least_id"))
    classes = written(classes.select("cid", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_key").alias("rep_key"), "least_id", "body", F.pmod("cid", F.lit(blocks)).cast("int").alias("block")))
    posted = written(postings(classes, matches, blocks))
    candidates = posted.select("cid").distinct()
    reps = classes.join(candidates, "cid", "left_semi").select("rep_id", "rep_key")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    chosen = docs.select(F.col(id_col).alias("doc_id"), t.alias("t")).withColumn("k", F.xxhash64("t"))
    chosen = chosen.join(reps, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("k") == F.col("rep_key")), "left_semi")
    sets = written(rows_of(chosen, "doc_id", "t", shingle, True).dropDuplicates(["cid"]).select("cid", "n", "body"))
    sets = written(shared_sets(sets, percent))
    sigs = classes.join(sets.select("cid"), "cid", "left_semi").select("cid", "body")
    labels = components(links_of(posted, sigs, sets, percent, matches)).select(F.col("node").alias("cid"), F.col("component_id").alias("label"))
    ids = classes.select("cid", "least_id").join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    least = ids.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = ids.join(least, "label").select("cid", "component_id")
    out = rows.join(named, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "text_key")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op8_minhash(spark, sf_dir: str) -> DataFrame:
    """Components of all `documents` linked at a similarity of 0.85, and which one each keeps."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 85).drop("text_key")
