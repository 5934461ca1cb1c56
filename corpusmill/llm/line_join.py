"""Line dedup by a segment-partition edit join.

Distinct lines are cut into `edits` + 1 segments. Two lines within `edits` edits of each other have a segment of one as a substring of the
other, at a place that lengths bound. So each line is indexed by its segments and probes, for its own and the shorter lengths, the
substrings that can be such a segment; a banded bit-parallel edit distance verifies the pairs that meet. Keys are hashes of (length,
segment, content), sent packed by block to buckets; only keys under which an index entry and a probe of different lines meet come back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import BYTE_CODES, U64, blocks, by_bucket, lean, mix, opened, packed, pieces, prefix_hash, span_hash, spread, spread_sorted, squeeze, squeeze_sorted, texts_of, written

EDITS, SHORTEST, PIECE = 2, 24, 5 << 20
#: Lists of up to so many lines are compared pairwise; in longer ones each line meets the earliest first.
SMALL = 16
#: Bytes fall into CLASSES classes in even groups, one more group than the classes that `edits` edits can touch.
GROUP = 8


def edit_distance_within(a: bytes, b: bytes, most: int) -> bool:
    """Whether the edit distance of two byte strings is at most `most`: one bit vector for each number of edits, over a band of 2 * most + 1 diagonals."""
    if abs(len(a) - len(b)) > most:
        return False
    lo, n = 0, min(len(a), len(b))
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[len(a) - 1 - hi] == b[len(b) - 1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return max(len(a), len(b)) <= most
    masks: dict[int, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    # bit r of rows[e]: the first j - most + r bytes of a and the first j of b are at most e edits apart
    full = (1 << (2 * most + 1)) - 1
    rows = [((1 << (e + 1)) - 1) << most & full for e in range(most + 1)]
    for j, c in enumerate(b):
        mask = masks.get(c, 0)
        same = (mask >> (j - most) if j >= most else mask << (most - j)) & full
        before, rows[0] = rows[0], rows[0] & same
        for e in range(1, most + 1):
            now = (rows[e] & same | before | before >> 1 | rows[e - 1] << 1) & full
            before, rows[e] = rows[e], now
        if not rows[most]:
            return False
    return bool(rows[most] >> (len(a) - len(b) + most) & 1)


class Lines:
    """The lines of some texts: spans in their bytes, hashes, numbers within the text."""

    def __init__(self, texts: list[bytes], shortest: int):
        self.bytes = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        starts = np.cumsum(sizes) - sizes
        self.past = np.flatnonzero(self.bytes == 10)
        self.first = np.concatenate(([0], self.past[:-1] + 1))
        self.doc = np.searchsorted(starts, self.first, "right") - 1
        self.number = np.arange(len(self.first)) - np.searchsorted(self.first, starts)[self.doc]
        self.sums, self.inverse = prefix_hash(self.bytes)
        self.hash = span_hash(self.sums, self.inverse, self.first, self.past)
        self.long = np.flatnonzero(self.past - self.first >= shortest)


def segments(length: np.ndarray, parts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment k of `parts` even ones; the last ones take the rest of the division."""
    base, rest = length // parts, length % parts
    return base * k + np.maximum(0, k - (parts - rest)), base + (k >= parts - rest)


def probes(length: np.ndarray, edits: int):
    """(segment, shorter length, start, size) arrays to probe: starts that the multi-match rule leaves for each length and segment."""
    for less in range(edits + 1):
        other = length - less
        for k in range(edits + 1):
            start, size = segments(other, edits + 1, k)
            for shift in range(-edits, edits + less + 1):
                # from the left at most k edits before the segment, from the right at most edits - k after it
                if abs(shift) <= k and abs(shift - less) <= edits - k:
                    s = start + shift
                    ok = (s >= 0) & (s + size <= length)
                    yield k, other, np.where(ok, s, 0), np.where(ok, size, 0), ok


def line_keys(t: Lines, own: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, lines, roles): role 0 an index entry, 1 a probe, of lines `own`."""
    first, length = t.first[own], t.past[own] - t.first[own]
    keys, lines, roles = [], [], []
    with np.errstate(over="ignore"):
        for k in range(edits + 1):
            s, n = segments(length, edits + 1, k)
            keys.append(mix(span_hash(t.sums, t.inverse, first + s, first + s + n) + length.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(k)))
            lines.append(own)
            roles.append(np.zeros(len(own), np.uint8))
        for k, other, s, n, ok in probes(length, edits):
            h = mix(span_hash(t.sums, t.inverse, first + s, first + s + n) + other.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(k))
            keys.append(h[ok])
            lines.append(own[ok])
            roles.append(np.ones(int(ok.sum()), np.uint8))
    return np.concatenate(keys), np.concatenate(lines), np.concatenate(roles)


PAIRS = ([pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()], ["bucket", "block", "keys", "docs", "numbers"])
LAST = np.iinfo(np.int64).max


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", edits: int = EDITS, shortest: int = SHORTEST, others: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_text) and the columns `others`: a row for each row of docs; kept_text joins the lines left with line feeds.

    A line of `shortest` bytes or more goes when an earlier line, of any text, is within `edits` edits of it (equal ones
    too): earlier by (id, line number), ids as longs and null ids last, rows of equal id by a hash of their text. It does not
    matter whether the earlier line goes itself. Edits are of UTF-8 bytes. Shorter lines stay, null text is empty, one empty line.

    Copies of a line are one entry from the first shuffle on. Under keys that many lines share each line first meets the earliest line; only those
    that this does not remove meet the others, so copies with slips do not become all pairs."""
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} must be an integer: it says which line is the earlier one")
    count = pieces(docs, text, PIECE)
    classes = GROUP * (2 * edits + 1)
    of_class = (BYTE_CODES % U64(classes)).astype(np.int64)
    parts = blocks(docs, id_col, text, count, others)
    types, more = dict(docs.dtypes), len(others)

    def lines_of(group):
        group = opened(group)
        texts = texts_of(group.column("text"))
        ids = np.array([LAST if i is None else i for i in group.column("doc_id").cast(pa.int64()).to_pylist()], np.int64)
        t = Lines(texts, shortest)
        # rows of one id are set apart by their text
        return t, ids[t.doc], t.number, texts, group

    def firsts(t, ids, numbers):
        """Each distinct line's earliest place in this block: hashes ascending, and line indices."""
        order = t.long[np.lexsort((numbers[t.long], ids[t.long], t.hash[t.long]))]
        h = t.hash[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        return h[new], order[new]

    def announce(group):
        t, ids, numbers, _, _ = lines_of(group)
        h, at = firsts(t, ids, numbers)
        block = group.column("block")[0].as_py()
        return packed([(b, block, squeeze_sorted(h[x]), squeeze(ids[at[x]]), squeeze(numbers[at[x]])) for b, x in by_bucket(h, count)], *PAIRS)

    def elect(sent):
        """Marks the block that has a line's earliest place; of equal places the lowest block's."""
        bucket, at = sent.column("bucket")[0].as_py(), sent.column("block").to_pylist()
        keys = [spread_sorted(k) for k in sent.column("keys").to_pylist()]
        k, d, n = np.concatenate(keys), *(np.concatenate([spread(x, np.int64) for x in sent.column(c).to_pylist()]) for c in ("docs", "numbers"))
        owner = np.repeat(at, [len(x) for x in keys])
        order = np.lexsort((owner, n, d, k))
        won = np.zeros(len(k), bool)
        won[order] = np.diff(k[order], prepend=U64(0) if len(k) and k[order[0]] else U64(1)) != 0
        return packed([(b, bucket, squeeze(np.packbits(x))) for b, x in zip(at, np.split(won, np.cumsum([len(x) for x in keys])[:-1]), strict=True)], [pa.int32(), pa.int32(), pa.binary()], ["block", "bucket", "marks"])

    def owned(t, ids, numbers, replies):
        h, at = firsts(t, ids, numbers)
        told = dict(zip(replies.column("bucket").to_pylist(), replies.column("marks").to_pylist(), strict=True))
        won = np.zeros(len(h), bool)
        for b, x in by_bucket(h, count):
            won[x] = np.unpackbits(spread(told[b], np.uint8), count=len(x)).astype(bool)
        return at[won]

    def post(group, replies):
        t, ids, numbers, _, _ = lines_of(group)
        keys, lines, roles = line_keys(t, owned(t, ids, numbers, replies), edits)
        block = group.column("block")[0].as_py()
        return packed([(b, block, squeeze_sorted(keys[x]), squeeze(lines[x].astype(np.int32)), squeeze(roles[x])) for b, x in by_bucket(keys, count)], *PAIRS)

    def meet(sent):
        """Marks the entries of keys that hold an index entry and a probe of different lines."""
        bucket, at = sent.column("bucket")[0].as_py(), sent.column("block").to_pylist()
        keys = [spread_sorted(k) for k in sent.column("keys").to_pylist()]
        k = np.concatenate(keys)
        line = np.concatenate([spread(x, np.int32) for x in sent.column("docs").to_pylist()]).astype(np.int64) + (np.repeat(at, [len(x) for x in keys]).astype(np.int64) << 32)
        role = np.concatenate([spread(x, np.uint8) for x in sent.column("numbers").to_pylist()])
        order = np.argsort(k, kind="stable")
        ks = k[order]
        cut_ = np.flatnonzero(np.diff(ks, prepend=ks[0] ^ U64(1)) != 0)
        ls, rs = line[order], role[order]
        many = np.minimum.reduceat(ls, cut_) != np.maximum.reduceat(ls, cut_)
        many &= (np.minimum.reduceat(rs, cut_) == 0) & (np.maximum.reduceat(rs, cut_) == 1)
        hit = np.zeros(len(k), bool)
        hit[order] = np.repeat(many, np.diff(np.append(cut_, len(ks))))
        return packed([(b, bucket, squeeze(np.packbits(x))) for b, x in zip(at, np.split(hit, np.cumsum([len(x) for x in keys])[:-1]), strict=True) if x.any()], [pa.int32(), pa.int32(), pa.binary()], ["block", "bucket", "marks"])

    def entries(group, replies):
        """Rows (key, role, line, place) of the shared keys, and once for each of their lines its bytes."""
        t, ids, numbers, _, _ = lines_of(group)
        rounds = np.array(replies.column("round").to_pylist(), np.int64)
        first, second = (replies.take(pa.array(np.flatnonzero(rounds == r))) for r in (1, 2))
        keys, lines, roles = line_keys(t, owned(t, ids, numbers, first), edits)
        told = dict(zip(second.column("bucket").to_pylist(), second.column("marks").to_pylist(), strict=True))
        chosen = [x[np.unpackbits(spread(told[b], np.uint8), count=len(x)).astype(bool)] for b, x in by_bucket(keys, count) if b in told]
        x = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
        own = np.unique(lines[x])
        at = np.concatenate((lines[x], own)).astype(np.int64)
        n, m = len(x), len(own)
        return pa.table({
            "key": pa.array(np.concatenate((keys[x].view(np.int64), np.zeros(m, np.int64))), mask=np.arange(n + m) >= n),
            "role": np.concatenate((roles[x].astype(np.int32), np.zeros(m, np.int32))),
            "line": t.hash[at].view(np.int64),
            "doc": ids[at],
            "number": numbers[at].astype(np.int64),
            "block": np.full(n + m, group.column("block")[0].as_py(), np.int32),
            "bag": pa.array([*[None] * n, *(np.bincount(of_class[t.bytes[t.first[i] : t.past[i]]], minlength=classes) for i in own)], pa.list_(pa.int32())),
            "body": pa.array([*[None] * n, *(t.bytes[t.first[i] : t.past[i]].tobytes() for i in own)], pa.binary()),
        })

    g = parts.groupBy("block")
    sent = "bucket int, block int, keys binary, docs binary, numbers binary"
    reply = "block int, bucket int, marks binary"
    winners = g.applyInArrow(lean(announce), sent).groupBy("bucket").applyInArrow(lean(elect), reply)
    met = g.cogroup(winners.groupBy("block")).applyInArrow(lean(post), sent).groupBy("bucket").applyInArrow(lean(meet), reply)
    both = winners.selectExpr("*", "1 as round").unionByName(met.selectExpr("*", "2 as round"))
    found = written(g.cogroup(both.groupBy("block")).applyInArrow(lean(entries), "key long, role int, line long, doc long, number long, block int, bag array<int>, body binary"))
    near = near_lines(found, edits)

    def rebuilt(group, replies):
        t, ids, numbers, texts, whole = lines_of(group)
        rounds = np.array(replies.column("round").to_pylist(), np.int64)
        first, second = (replies.take(pa.array(np.flatnonzero(rounds == r))) for r in (1, 2))
        stays = np.ones(len(t.first), bool)
        stays[t.long] = False
        stays[owned(t, ids, numbers, first)] = True
        gone = np.array(second.column("line").to_pylist(), np.int64)
        if len(gone):
            stays[t.long[np.isin(t.hash[t.long].view(np.int64), gone)]] = False
        ends = np.searchsorted(t.doc, np.arange(len(texts) + 1))
        rows = []
        for i, text_ in enumerate(texts):
            s = stays[ends[i] : ends[i + 1]]
            kept = text_ if s.all() else b"\n".join(x for x, y in zip(text_.split(b"\n"), s, strict=True) if y)
            rows.append((len(s), int((~s).sum()), kept.decode()))
        made = [pa.array([r[i] for r in rows], x) for i, x in enumerate((pa.int64(), pa.int64(), pa.string()))]
        return pa.Table.from_arrays([whole.column("doc_id"), *made, *(whole.column(f"_{i}") for i in range(more))], ["doc_id", "n_lines", "n_removed", "kept_text", *(f"_{i}" for i in range(more))])

    told = winners.selectExpr("*", "cast(null as long) as line", "1 as round").unionByName(near.selectExpr("block", "cast(null as int) as bucket", "cast(null as binary) as marks", "line", "2 as round"))
    fields = "".join(f", _{i} {types[c]}" for i, c in enumerate(others))
    out = g.cogroup(told.groupBy("block")).applyInArrow(lean(rebuilt), f"doc_id {types[id_col]}, n_lines long, n_removed long, kept_text string{fields}")
    return out.select("doc_id", "n_lines", "n_removed", "kept_text", *[F.col(f"_{i}").alias(c) for i, c in enumerate(others)])


def near_lines(found: DataFrame, edits: int) -> DataFrame:
    """(block, line) of the distinct lines that an earlier distinct line is within `edits` edits of."""
    bodies = found.where("key is null").select("line", "body", "block", F.struct("doc", "number", "line").alias("place"))
    entries = found.where("key is not null").select("key", "role", "line", F.struct("doc", "number", "line").alias("place"))
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("place").alias("least"))
    sized = entries.join(sizes, "key")
    small = sized.where(F.col("size") <= SMALL)
    a, b = small.where("role = 0").select("key", F.col("line").alias("x"), F.col("place").alias("px")), small.where("role = 1").select("key", F.col("line").alias("y"), F.col("place").alias("py"))
    pairs = a.join(b, "key").where("x <> y").select(F.when(F.col("px") < F.col("py"), F.col("x")).otherwise(F.col("y")).alias("early"), F.when(F.col("px") < F.col("py"), F.col("y")).otherwise(F.col("x")).alias("late"))
    large = sized.where(F.col("size") > SMALL)
    lead = large.where(F.col("place") > F.col("least")).select(F.col("least.line").alias("early"), F.col("line").alias("late"))
    first = written(verified(pairs.unionByName(lead).where("early <> late").distinct(), bodies, edits).distinct())
    # What the earliest line of a long list has not removed meets earlier lines of the list. An edit changes the counts of at
    # most two byte classes, so of 2 * edits + 1 groups of classes one keeps all its counts: lines meet by list and such a group.
    bags = found.where("key is null").select("line", "bag")
    grouped = large.join(bags, "line").select("*", F.explode(F.sequence(F.lit(0), F.lit(2 * edits))).alias("g")).withColumn("key2", F.xxhash64("key", "g", F.slice("bag", F.col("g") * GROUP + 1, F.lit(GROUP))))
    open_ = grouped.join(first.select(F.col("late").alias("line")), "line", "left_anti").where(F.col("place") > F.col("least"))
    others = grouped.select("key2", F.col("line").alias("early"), F.col("place").alias("pe"), F.col("role").alias("re"), F.col("bag").alias("be"))
    apart = F.aggregate(F.zip_with("bag", "be", lambda x, y: F.abs(x - y)), F.lit(0), lambda u, v: u + v)
    rest = open_.join(others, "key2").where((F.col("pe") < F.col("place")) & (F.col("re") != F.col("role")) & (F.col("early") != F.col("line")) & (apart <= 2 * edits)).select("early", F.col("line").alias("late")).distinct()
    second = verified(rest, bodies, edits)
    return first.select("late").unionByName(second.select("late")).distinct().join(bodies.select(F.col("line").alias("late"), "block"), "late").select("block", F.col("late").alias("line"))


def verified(pairs: DataFrame, bodies: DataFrame, edits: int) -> DataFrame:
    j = pairs.join(bodies.select(F.col("line").alias("early"), F.col("body").alias("u")), "early").join(bodies.select(F.col("line").alias("late"), F.col("body").alias("v")), "late")

    def run(batches):
        for x in batches:
            keep = [i for i, (p, q) in enumerate(zip(x.column(1).to_pylist(), x.column(2).to_pylist(), strict=True)) if edit_distance_within(p, q, edits)]
            yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(keep, pa.int64()))], ["late"])

    return j.select("late", "u", "v").mapInArrow(lean(run), "late long")


def op10_lines(spark, sf_dir: str) -> DataFrame:
    """Lines removed in every document, and the SHA-256 of the text left."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
