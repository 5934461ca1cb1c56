"""Removal of long repeated byte strings by difference-cover suffix samples, one bucket of suffixes at a time.

Only suffixes cut at WIDTH bytes matter here, and only whether two are equal. Positions of a text in a difference cover modulo
PERIOD are its sample: for any two positions some shift below PERIOD takes both into the sample. A sample suffix is ranked by its first
WIDTH - PERIOD + 1 bytes; so if two suffixes agree on WIDTH bytes, shifted copies of them share a sample rank. A suffix none of
whose shifts has a rank that occurs twice cannot tie with another for WIDTH bytes and never leaves its task. The others
are sent by a fingerprint of their WIDTH bytes to buckets, and each bucket is sorted by itself; what ties there is repeated.

In between, sample suffixes of a rank that occurs twice are compared on WIDTH + PERIOD - 1 bytes. All suffixes within a string that
ties at this length are repeated, and but for the earliest such place they need not be sent: the earliest one sends them, or an
earlier one still. So copies of a passage cost the passage once, and their ends."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import U64, blocks, by_bucket, lean, mix, opened, packed, pieces, prefix_hash, span_hash, spread, spread_sorted, squeeze, squeeze_sorted, texts_of

WIDTH = 200
PIECE = 4 << 20


def difference_cover(period: int) -> np.ndarray:
    """Residues of which every residue modulo `period` is a difference: greedy over the differences not yet covered."""
    chosen, covered = [0], np.zeros(period, bool)
    covered[0] = True
    while not covered.all():
        base = np.array(chosen)
        gains = []
        for c in range(period):
            d = np.concatenate((c - base, base - c)) % period
            gains.append(len(np.unique(d[~covered[d]])))
        c = int(np.argmax(gains))
        d = np.concatenate((c - base, base - c)) % period
        covered[d] = True
        chosen.append(c)
    return np.array(sorted(set(chosen)))


PERIOD = 121
COVER = difference_cover(PERIOD)


class Texts:
    """Texts of a block one after another, with hashes of any span."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.sums, self.inverse = prefix_hash(self.bytes)

    def left(self, at: np.ndarray) -> np.ndarray:
        """Bytes from each position to the end of its text."""
        return (self.starts + self.sizes)[np.searchsorted(self.starts, at, "right") - 1] - at

    def places(self, width: int, pattern: np.ndarray | None = None) -> np.ndarray:
        """Mask of the positions with `width` bytes left, in each text those of the repeating pattern."""
        mask = np.zeros(len(self.bytes), bool)
        most = int(self.sizes.max(initial=0))
        tile = np.ones(most, bool) if pattern is None else np.tile(pattern, most // len(pattern) + 1)
        for lo, n in zip(self.starts.tolist(), (self.sizes - width + 1).tolist(), strict=True):
            if n > 0:
                mask[lo : lo + n] = tile[:n]
        return mask

    def sample(self, width: int, period: int, cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sample positions with a whole seed of width - period + 1 bytes, and the seeds' hashes."""
        inside = np.zeros(period, bool)
        inside[cover] = True
        seed = width - period + 1
        at = np.flatnonzero(self.places(seed, inside))
        return at, span_hash(self.sums, self.inverse, at, at + seed)

    def suffixes(self, hot: np.ndarray, others: np.ndarray, width: int, period: int) -> np.ndarray:
        """Positions with `width` bytes left, not in the mask `others`, that have a position of `hot` at a shift below `period`."""
        edge = np.zeros(len(self.bytes) + 1, np.int32)
        edge[0] = np.count_nonzero(hot < period)
        edge[hot[hot >= period] - period + 1] += 1
        edge[hot + 1] -= 1
        near = np.cumsum(edge[:-1], dtype=np.int32) > 0
        return np.flatnonzero(near & ~others & self.places(width))

    def fingerprints(self, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """64 bits that order a suffix within its bucket, and 24 of its first half, that must agree too."""
        first = span_hash(self.sums, self.inverse, at, at + width)
        half = span_hash(self.sums, self.inverse, at, at + width // 2)
        return first, (half >> U64(40)).astype(np.uint32)


def squeeze_checks(c: np.ndarray) -> bytes:
    return squeeze(np.ascontiguousarray(c, np.uint32).view(np.uint8).reshape(-1, 4).T)


def spread_checks(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(spread(b, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


SENT = ([pa.int32(), pa.int32(), pa.binary(), pa.binary()], ["bucket", "block", "keys", "checks"])


def ties(sent):
    """(block, bucket, marks): for the keys that a block sent, in its order, whether another place has the key, and whether this place is the earliest."""
    bucket = sent.column("bucket")[0].as_py()
    by_block = np.argsort(sent.column("block").to_numpy(), kind="stable")
    sent = sent.take(pa.array(by_block))
    keys = [spread_sorted(k) for k in sent.column("keys").to_pylist()]
    checks = [spread_checks(c) for c in sent.column("checks").to_pylist()]
    k, c = np.concatenate(keys), np.concatenate(checks)
    order = np.lexsort((c, k)) if c.any() else np.argsort(k, kind="stable")
    ks, cs = k[order], c[order]
    same = (ks[1:] == ks[:-1]) & (cs[1:] == cs[:-1])
    before, after = np.concatenate(([False], same)), np.concatenate((same, [False]))
    tied, first = np.zeros(len(k), bool), np.zeros(len(k), bool)
    tied[order], first[order] = before | after, ~before
    cuts = np.cumsum([len(x) for x in keys])[:-1]
    return packed([(b, bucket, squeeze(np.packbits(np.concatenate((x, y))))) for b, x, y in zip(sent.column("block").to_pylist(), np.split(tied, cuts), np.split(first, cuts), strict=True) if x.any()], [pa.int32(), pa.int32(), pa.binary()], ["block", "bucket", "marks"])


def marked(keys: np.ndarray, count: int, replies, round_: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the keys a block sent in a round are tied, and which stand at the earliest place, from the replies to it."""
    tied, first = np.zeros(len(keys), bool), np.ones(len(keys), bool)
    rounds = replies.column("round").to_pylist()
    marks = {b: m for r, b, m in zip(rounds, replies.column("bucket").to_pylist(), replies.column("marks").to_pylist(), strict=True) if r == round_}
    for b, at in by_bucket(keys, count):
        if b in marks:
            got = np.unpackbits(spread(marks[b], np.uint8), count=2 * len(at)).astype(bool)
            tied[at], first[at] = got[: len(at)], got[len(at) :]
    return tied, first


def covered(size: int, at: np.ndarray, width: int) -> np.ndarray:
    """Whether each of `size` positions lies within `width` positions from one of `at`, which has each once."""
    edge = np.zeros(size + 1, np.int32)
    edge[at] += 1
    edge[at + width] -= 1
    return np.cumsum(edge[:-1], dtype=np.int32) > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, period: int = PERIOD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text): a row for each row of docs.

    Every byte goes that lies in a string of `width` bytes which starts at another place too, in the same text or another; matches
    lie within one text and are judged on the input. Texts are whole UTF-8 bytes, null counts as empty; texts below `width` bytes stay
    whole. Repeated rows are different places, so rows with equal texts of `width` bytes or more lose all. kept_text is null where
    the bytes left are no UTF-8, which can be as matches are of bytes; kept_sha256 is of the bytes.

    Memory: a block of texts of about PIECE bytes (and one text more), or a bucket, whose number grows with the input. A rank that occurs in a third of
    all texts has a row's worth of bytes from each block, and is sorted as any other."""
    cover = COVER if period == PERIOD else difference_cover(period)
    count = pieces(docs, text, PIECE)
    # A rank of more bits than positions need only takes room; one that two seeds share by chance only makes candidates.
    longer = width + period - 1
    low = U64(max(0, 24 - int(count).bit_length()))
    parts = blocks(docs, id_col, text, count)

    def ranks(group):
        block = group.column("block")[0].as_py()
        _, h = Texts(texts_of(opened(group).column("text"))).sample(width, period, cover)
        h = h >> low << low
        return packed([(b, block, squeeze_sorted(h[at]), squeeze_checks(np.zeros(len(at)))) for b, at in by_bucket(h, count)], *SENT)

    def hot_strings(t: Texts, replies):
        """Sample positions of a tied rank: all, and those with a long string, with its fingerprint."""
        at, h = t.sample(width, period, cover)
        hot = at[marked(h >> low << low, count, replies, 1)[0]]
        whole = hot[t.left(hot) >= longer]
        return hot, whole, *t.fingerprints(whole, longer)

    def strings(group, replies):
        if not group.num_rows:
            return packed([], *SENT)
        block = group.column("block")[0].as_py()
        _, _, h, c = hot_strings(Texts(texts_of(opened(group).column("text"))), replies)
        return packed([(b, block, squeeze_sorted(h[x]), squeeze_checks(c[x])) for b, x in by_bucket(h, count)], *SENT)

    def candidates(t: Texts, replies):
        """Suffixes to send, their fingerprints, and the positions of long strings that are tied."""
        hot, whole, h, _ = hot_strings(t, replies)
        tied, first = marked(h, count, replies, 2)
        others = covered(len(t.bytes), whole[tied & ~first], period)
        at = t.suffixes(hot, others, width, period)
        return at, *t.fingerprints(at, width), whole[tied]

    def suffixes(group, replies):
        if not group.num_rows:
            return packed([], *SENT)
        block = group.column("block")[0].as_py()
        at, h, c, _ = candidates(Texts(texts_of(opened(group).column("text"))), replies)
        return packed([(b, block, squeeze_sorted(h[x]), squeeze_checks(c[x])) for b, x in by_bucket(h, count)], *SENT)

    def kept(group, replies):
        group = opened(group)
        texts, ids = texts_of(group.column("text")), group.column("doc_id")
        t = Texts(texts)
        at, h, _, long_ = candidates(t, replies)
        at = at[marked(h, count, replies, 3)[0]]
        gone = covered(len(t.bytes), at, width) | covered(len(t.bytes), long_, longer)
        rows = []
        for i, (lo, n) in enumerate(zip(t.starts, t.sizes, strict=True)):
            g = gone[lo : lo + n]
            left = texts[i] if not g.any() else t.bytes[lo : lo + n][~g].tobytes()
            try:
                as_text = left.decode()
            except UnicodeDecodeError:
                as_text = None
            rows.append((n, int(g.sum()), int((np.diff(np.concatenate(([0], g.view(np.int8)))) == 1).sum()), hashlib.sha256(left).hexdigest(), as_text))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.Table.from_arrays([ids, *(pa.array([r[i] for r in rows], x) for i, x in enumerate(types))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    sent = "bucket int, block int, keys binary, checks binary"
    texts = parts.groupBy("block")

    def resolved(asked: DataFrame, round_: int) -> DataFrame:
        return asked.groupBy("bucket").applyInArrow(lean(ties), "block int, bucket int, marks binary").withColumn("round", F.lit(round_))

    told = resolved(texts.applyInArrow(lean(ranks), sent), 1)
    told = told.unionByName(resolved(texts.cogroup(told.groupBy("block")).applyInArrow(lean(strings), sent), 2))
    told = told.unionByName(resolved(texts.cogroup(told.groupBy("block")).applyInArrow(lean(suffixes), sent), 3))
    return texts.cogroup(told.groupBy("block")).applyInArrow(lean(kept), f"doc_id {dict(docs.dtypes)[id_col]}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def op5_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")
