"""Phrase collocations by partitioned mining (SON): shards are mined whole at a support lowered in proportion, then all candidates are counted.

A shard is a run of texts of one task, SHARD bytes and a SHARE of all at most, so that small inputs are mined in as many shards, at
the same lowered support, as large ones until SHARD bounds it. A phrase of f >= support places in all has at least
ceil(support * shard words / all words) places in some shard, so mining every shard at that count finds it. What shards find is
united into a bitmap of hashed phrases, and a second pass counts by their text all phrases that the bitmap passes: its bits are
shared, so it may pass more, never less, and counts at or over the support are exact. Words come first, then pairs of frequent
words, then phrases of three and more words, all of whose pairs are frequent. The bitmaps have BITS bits at most, the only thing
broadcast; where there are more candidates than bits, more is counted, with the same result."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import U64, cut, lean, mix, prefix_hash, span_hash, texts_of, written

SUPPORT, LONGEST, TOP = 100, 5, 2000
SHARD, SHARE = 32 << 20, 1 / 25
#: Into how many parts the totals of a language are repeated, so that the phrases of one language meet them in as many tasks.
SPREAD = 16
#: Bytes of text hashed at a time.
HASHED = 4 << 20
BITS = 1 << 27
#: Bits a row of the bitmap; Spark's bitmap functions deal in buckets of so many.
BUCKET = 32768

_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
#: A-Z lower-cased, tabs as spaces, everything that ends a piece as a line feed.
_FORM = bytes(10 if c in _ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


class Shard:
    """Words of some texts of one language, in order: hashes, pieces, and places in the normal form `body`."""

    def __init__(self, lang: str, texts: list[bytes]):
        self.lang = lang
        a = np.frombuffer(b"\n".join(t.translate(_FORM) for t in texts) + b"\n", np.uint8)
        # one space between words, so that a phrase is a slice
        space = a == 32
        if len(a):
            a = a[~(space & np.append(space[1:] | (a[1:] == 10), False))]
        self.body = a.tobytes()
        gap = (a == 32) | (a == 10)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).view(np.int8)))
        self.first, self.past = edge[::2].astype(np.int32), edge[1::2].astype(np.int32)
        self.piece = np.searchsorted(np.flatnonzero(a == 10), self.first).astype(np.int32)
        self.words = np.empty(len(self.first), U64)
        lo = 0
        while lo < len(self.first):
            hi = max(int(np.searchsorted(self.past, self.first[lo] + HASHED, "right")), lo + 1)
            start = int(self.first[lo])
            self.words[lo:hi] = span_hash(*prefix_hash(a[start : self.past[hi - 1]]), self.first[lo:hi] - start, self.past[lo:hi] - start)
            lo = hi
        self.seed = mix(np.array([len(lang)], U64) + span_hash(*prefix_hash(np.frombuffer(lang.encode(), np.uint8)), np.array([0]), np.array([len(lang.encode())])))[0] if lang else U64(1)

    def keys(self, at: np.ndarray, k: int) -> np.ndarray:
        """64-bit keys of the phrases of k words that begin at the words `at`; they differ by language and length."""
        with np.errstate(over="ignore"):
            h = np.full(len(at), self.seed + U64(k), U64)
            for j in range(k):
                h = mix(h * U64(0xD1342543DE82EF95) + self.words[at + j])
        return h

    def windows(self, k: int) -> np.ndarray:
        """Where k words stand in one piece."""
        n = len(self.words) - k + 1
        return np.flatnonzero(self.piece[:n] == self.piece[k - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def text(self, at: int, k: int) -> bytes:
        return self.body[self.first[at] : self.past[at + k - 1]]


def shards(batches, size: int):
    """(lang, texts) of each language of each run of about `size` bytes."""
    held, n = {}, 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
            held.setdefault(lang, []).append(text)
            n += len(text) + 8
            if n >= size:
                yield held
                held, n = {}, 0
    if n:
        yield held


def tallied(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, an index of each, and counts."""
    order = np.argsort(keys)
    k = keys[order]
    at = np.flatnonzero(np.concatenate((np.ones(min(1, len(k)), bool), k[1:] != k[:-1])))
    return k[at], order[at], np.diff(np.append(at, len(k)))


class Bitmap:
    """Which keys may be in a set. A key's bit is its top bits; `None` bits pass every key."""

    def __init__(self, bits: np.ndarray | None, size: int):
        self.bits, self.shift = bits, U64(64 - (size.bit_length() - 1))

    def passes(self, keys: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(keys), bool)
        at = keys >> self.shift
        return (self.bits[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1


def bitmap(keys: DataFrame, most: int = BITS) -> Bitmap:
    """The set of a column `key`, in a power of two of bits, sixteen a key while that is no more than `most`; at most `most` / 8 bytes reach the driver."""
    n = keys.count()
    size = BUCKET
    while size < min(most, 16 * n):
        size *= 2
    bit = F.shiftrightunsigned("key", 64 - (size.bit_length() - 1)) + 1  # bucket numbers begin at 1 for positive values
    parts = keys.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("m")).collect()
    out = np.zeros(size // 8, np.uint8)
    for r in parts:
        lo = (r["b"] - 1) * BUCKET // 8
        out[lo : lo + len(r["m"])] = np.frombuffer(r["m"], np.uint8)
    return Bitmap(out, size)


def allowed(s: Shard, k: int, words, pairs) -> np.ndarray:
    """Windows of k words whose words and pairs are frequent, as far as the bitmaps tell."""
    at = s.windows(k)
    if len(at) and words is not None:
        ok = words.passes(s.keys(np.arange(len(s.words)), 1))
        for j in range(k):
            at = at[ok[at + j]]
    if len(at) and pairs is not None:
        two = s.windows(2)
        ok = np.zeros(len(s.words), bool)
        ok[two[pairs.passes(s.keys(two, 2))]] = True
        for j in range(k - 1):
            at = at[ok[at + j]]
    return at


def mined(docs: DataFrame, lengths: list[int], all_words: int, support: int, words, pairs, size: int) -> DataFrame:
    """Keys of the phrases that some shard has at its lowered support."""
    held = docs.sparkSession.sparkContext.broadcast((words, pairs))

    def mine(batches):
        for texts in shards(batches, size):
            own = [Shard(lang, t) for lang, t in texts.items()]
            least = max(1, -(-support * sum(len(s.words) for s in own) // max(all_words, 1)))
            for s in own:
                for k in lengths:
                    keys, _, n = tallied(s.keys(allowed(s, k, *held.value), k))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[n >= least].view(np.int64))], ["key"])

    return docs.mapInArrow(lean(mine), "key long").distinct()


def counted(docs: DataFrame, lengths: list[int], candidates, words, pairs, size: int) -> DataFrame:
    """(lang, phrase, k, key, f) of all phrases of these lengths that the bitmaps pass."""
    held = docs.sparkSession.sparkContext.broadcast((candidates, words, pairs))

    def count(batches):
        found, words, pairs = held.value
        for texts in shards(batches, size):
            for lang, t in texts.items():
                s = Shard(lang, t)
                for k in lengths:
                    at = allowed(s, k, words, pairs)
                    keys = s.keys(at, k)
                    if found is not None:
                        good = found.passes(keys)
                        at, keys = at[good], keys[good]
                    keys, where, n = tallied(keys)
                    for lo in range(0, len(keys), 50_000):
                        part = slice(lo, lo + 50_000)
                        phrases = pa.array([s.text(int(i), k) for i in at[where[part]]], pa.binary()).cast(pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), phrases, pa.array(np.full(len(phrases), k, np.int32)), pa.array(keys[part].view(np.int64)), pa.array(n[part])], ["lang", "phrase", "k", "key", "c"])

    rows = docs.mapInArrow(lean(count), "lang string, phrase string, k int, key long, c long")
    return rows.groupBy("lang", "phrase").agg(F.first("k").alias("k"), F.first("key").alias("key"), F.sum("c").alias("f"))


def scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, n, score) of frequent phrases of two words and more, by the cut of the lowest score."""
    words = F.split("phrase", " ")
    cuts = frequent.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"), words.alias("w"))
    cuts = cuts.select("lang", "phrase", "k", "a", "at", F.array_join(F.slice("w", F.lit(1), F.col("at")), " ").alias("first"), F.array_join(F.slice("w", F.col("at") + 1, F.col("k") - F.col("at")), " ").alias("rest"))
    of = lambda part, name: frequent.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    cuts = cuts.join(of("first", "l"), ["lang", "first"]).join(of("rest", "r"), ["lang", "rest"])
    # all phrases of a language meet one total, which is repeated
    salted = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    cuts = cuts.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD)).cast("int")).join(salted, ["lang", "salt"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"up": (wide("a") * 1000).cast("decimal(19,0)") * wide("n"), "down": wide("l") * wide("r")}).withColumn("score", F.expr("up div down"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "at", "k", "a", "l", "r", "n")).alias("m"))
    return best.select("lang", "phrase", *[F.col(f"m.{c}") for c in ("k", "a", "l", "r", "n", "score")])


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", support: int = SUPPORT, longest: int = LONGEST, top: int | None = TOP, shard: int = SHARD, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first `top` phrases; all of them if None.

    Null texts are empty, null languages `und`. Texts without words give nothing, an empty table an empty result; repeated rows
    count each, other columns are ignored, whatever their names. A phrase that some longer candidate contains is within
    one that is longer by a word, too: places cannot grow with the phrase, so it suffices to hold each phrase against the first
    and last words of the candidates of one word more."""
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    single = written(counted(rows, [1], None, None, None, shard))
    totals = cut(single.groupBy("lang").agg(F.sum("f").alias("n")))
    size = single.agg(F.sum("f").alias("n"), F.sum(F.col("f") * (F.octet_length("phrase") + 1)).alias("bytes")).first()
    all_words, shard = size["n"] or 0, max(1, min(shard, int(SHARE * (size["bytes"] or 0))))
    levels = [single.where(F.col("f") >= support)]
    frequent = bitmap(levels[0].select("key"), bits)
    pairs = None
    for lengths in ([2], list(range(3, longest + 1))):
        if lengths and longest >= lengths[0]:
            found = bitmap(written(mined(rows, lengths, all_words, support, frequent, pairs, shard)), bits)
            levels.append(written(counted(rows, lengths, found, frequent, pairs, shard).where(F.col("f") >= support)))
            pairs = bitmap(levels[1].select("key"), bits)
    every = reduce(DataFrame.unionByName, levels)
    words = F.split("phrase", " ")
    inner = F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("k") - 1), " "))).alias("phrase")
    within = every.where("k > 2").select("lang", inner, F.col("f").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    out = scored(every, totals).join(within, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 100 * a")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    out = out if top is None else out.where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    """The strongest phrases of each language of all documents; see collocations()."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_sql(support: int = SUPPORT, longest: int = LONGEST, top: int = TOP) -> str:
    grams = " union all ".join(f"select lang, {k} as k, array_to_string(w[i:i + {k - 1}], ' ') as phrase from (select lang, w, unnest(range(1, len(w) - {k - 2})) as i from pieces where len(w) >= {k})" for k in range(1, longest + 1))
    return f"""with pieces as materialized (
  select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w
  from (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents)),
grams as ({grams}),
f as materialized (select lang, k, phrase, count(*)::hugeint as f from grams group by all having k = 1 or count(*) >= {support}),
n as (select lang, sum(f)::hugeint as n from f where k = 1 group by 1),
cuts as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w, unnest(range(1, k)) as part from f where k > 1),
scores as (
  select c.lang, c.phrase, c.k, c.a, c.part, l.f as l, r.f as r, n.n, (1000 * c.a * n.n) // (l.f * r.f) as score
  from cuts c join f l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:c.part], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(c.w[c.part + 1:], ' ') join n on n.lang = c.lang),
best as (select * from scores qualify row_number() over (partition by lang, phrase order by score, part) = 1),
longer as (
  select distinct lang, array_to_string(w[i:i + m - 1], ' ') as phrase, f from (
    select lang, f, k, string_split(phrase, ' ') as w, m, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from f where k > 2))),
kept as (select * from best b where not exists (select 1 from longer x where x.lang = b.lang and x.phrase = b.phrase and 100 * x.f >= 100 * b.a)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked where rank <= {top}"""
