"""Embedding near-dedup with a product-quantised inverted index.

Coarse centroids and residual codebooks are fitted on a bounded sample; every vector is indexed. A query probes each list that can
hold a vector within the link radius: a vector nearer to its own centroid than to another lies on its side of the bisector, so a list
whose bisector is farther from the query than the radius holds none. Lists of a label meet in groups, so a query travels once for a group however many of its lists it probes. In a list, asymmetric table-lookup distances to the codes,
less the stored coding error of each entry, bound true distances from below; what passes is reranked by exact cosine in
double precision. So no link is lost, whatever the codebooks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import components, lean, written

#: Fitting sample: at most so many distinct vectors, the first by a hash.
SAMPLE, SUBSPACES, CODES, ROUNDS = 8192, 8, 64, 6
#: Vectors of a label that a task indexes, and queries that it asks them.
BASE, QUERIES = 8000, 8000


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmin((c**2).sum(1)[None] - 2 * x @ c.T, axis=1)
        n = np.bincount(own, minlength=k)
        for d in range(x.shape[1]):
            s = np.bincount(own, weights=x[:, d], minlength=k)
            c[:, d] = np.where(n > 0, s / np.maximum(n, 1), c[:, d])
    return c


class Index:
    def __init__(self, sample: np.ndarray, lists: int):
        width = sample.shape[1]
        self.cuts = np.linspace(0, width, min(SUBSPACES, width) + 1).astype(int)
        self.centroids = kmeans(sample, min(lists, len(sample)))
        own, _ = self.nearest(sample)
        rest = sample - self.centroids[own]
        self.books = [kmeans(rest[:, a:b], min(CODES, len(sample))) for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]
        self.between = np.sqrt(np.maximum(self.squared(self.centroids, self.centroids), 0))

    @staticmethod
    def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (x**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * x @ c.T

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.squared(x, self.centroids)
        return np.argmin(d, axis=1), d

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and coding error of each vector, and its squared distances to all centroids."""
        own, d = self.nearest(x)
        rest = x - self.centroids[own]
        codes = np.stack([np.argmin((b**2).sum(1)[None] - 2 * rest[:, lo:hi] @ b.T, axis=1) for b, lo, hi in zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True)], axis=1)
        back = self.centroids[own] + np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)
        return own, codes.astype(np.uint8), np.sqrt(((x - back) ** 2).sum(1)), d

    def probes(self, own: np.ndarray, d: np.ndarray, radius: float) -> list[np.ndarray]:
        """Lists that can hold a vector within `radius`: those whose bisector with the own centroid is no farther."""
        gap = (d - d[np.arange(len(d)), own][:, None]) / np.maximum(2 * self.between[own], 1e-12)
        gap[np.arange(len(d)), own] = 0
        return [np.flatnonzero(g <= radius + 1e-6) for g in gap]

    def lookup(self, list_: int, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to the coded entries of a list."""
        rest = x - self.centroids[list_]
        out = np.zeros((len(x), len(codes)))
        for m, (b, lo, hi) in enumerate(zip(self.books, self.cuts[:-1], self.cuts[1:], strict=True)):
            out += self.squared(rest[:, lo:hi], b)[:, codes[:, m]]
        return np.sqrt(np.maximum(out, 0))


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v**2).sum(1, keepdims=True))


def unit_vectors(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return unit(out)


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few edges that join what the edges (a, b) join: each a to its first b, and each other b of an a to that first b."""
    first = np.concatenate(([True], a[1:] != a[:-1])) if len(a) else np.zeros(0, bool)
    lead = b[first][np.cumsum(first) - 1] if len(a) else b
    e = np.unique(np.stack([np.concatenate((a[first], b)), np.concatenate((b[first], lead))], 1), axis=0)
    return e[:, 0], e[:, 1]


def link(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each row of vectors.

    Linked are rows of equal, not null labels with cosine >= `least`. Vectors that are null, empty, zero or hold null, NaN or infinite parts, or
    whose dimension differs, link with nothing. Equal vectors of a label are one class with a count, however many: their
    links are counted, not listed. Component ids are least ids; null ids come last."""
    usable = F.col(label).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(usable, F.xxhash64(F.col(label).cast("string"), v)).alias("cid"), F.when(usable, F.concat_ws(":", F.col(label).cast("string"), F.size(vector).cast("string"))).alias("part"), F.when(usable, v).alias("v"))
    classes = written(rows.where("cid is not null").groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least_id"), F.any_value("part").alias("part"), F.any_value("v").alias("v")))
    shape = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    if not shape["n"]:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width, radius = shape["width"], float(np.sqrt(2 - 2 * least))
    sample = classes.select("v", "cid").orderBy(F.xxhash64("cid", F.lit(1)), "cid").limit(SAMPLE).select("v").toArrow()
    fitted = Index(unit_vectors(sample.column("v"), width), int(max(1, min(1024, shape["n"] ** 0.5))))
    lists, model = len(fitted.centroids), classes.sparkSession.sparkContext.broadcast(fitted)

    # float vectors travel as they are, others as doubles; both are normalised in double precision where they meet
    exact32 = dict(vectors.dtypes)[vector] == "array<float>"

    def index(batches):
        """Each vector's list, code and coding error, and the groups of lists it probes. Groups have as many lists as hold some BASE vectors of its label."""
        for b in batches:
            own, codes, err, d = model.value.encode(unit_vectors(b.column(3), width))
            per = np.clip(lists * BASE // b.column(4).to_numpy(), 1, lists)
            probes = [[{"grp": int(g), "lists": p[p // k == g].astype(np.int32).tobytes()} for g in np.unique(p // k)] for p, k in zip(model.value.probes(own, d, radius), per, strict=True)]
            x = [np.array(v, np.float64).tobytes() for v in b.column(3).to_pylist()]
            if exact32:
                x = [np.frombuffer(v).astype(np.float32).tobytes() for v in x]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(x, pa.binary()), pa.array(own.astype(np.int32)), pa.array((own // per).astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err), pa.array(probes, pa.list_(pa.struct([("grp", pa.int32()), ("lists", pa.binary())])))], ["cid", "n", "part", "x", "list", "grp", "code", "err", "probes"])

    many = classes.groupBy("part").agg(F.count(F.lit(1)).alias("of_part"))
    indexed = written(classes.join(many, "part").select("cid", "n", "part", "v", "of_part").mapInArrow(lean(index), "cid long, n long, part string, x binary, list int, grp int, code binary, err double, probes array<struct<grp:int,lists:binary>>"))
    entries = indexed.select("part", "grp", "list", "cid", "n", "x", "code", "err")
    asked = indexed.select("part", F.explode("probes").alias("p"), "cid", "x").select("part", "p.grp", "p.lists", "cid", "x")
    sizes = entries.groupBy("part", "grp").agg(F.ceil(F.count(F.lit(1)) / BASE).cast("int").alias("nb")).join(asked.groupBy("part", "grp").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("nq")), ["part", "grp"])
    # large groups and their queries are cut into pieces, and each piece of one meets each of the other
    e = entries.join(sizes, ["part", "grp"]).withColumn("pb", F.pmod("cid", F.col("nb")).cast("int")).withColumn("pq", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    q = asked.join(sizes, ["part", "grp"]).withColumn("pq", F.pmod("cid", F.col("nq")).cast("int")).withColumn("pb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))

    def search(base, queries):
        empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        if not base.num_rows or not queries.num_rows:
            return empty
        m, kind = model.value, np.float32 if exact32 else np.float64

        def units(t):
            v = np.zeros((t.num_rows, width))
            for i, r in enumerate(t.column("x").to_pylist()):
                r = np.frombuffer(r, kind)
                v[i, : len(r)] = r
            return unit(v)

        x, y = units(base), units(queries)
        codes = np.frombuffer(b"".join(base.column("code").to_pylist()), np.uint8).reshape(base.num_rows, -1)
        err, own_list = base.column("err").to_numpy(), base.column("list").to_numpy()
        ids, counts, own = base.column("cid").to_numpy(), base.column("n").to_numpy(), queries.column("cid").to_numpy()
        probes = [np.frombuffer(p, np.int32) for p in queries.column("lists").to_pylist()]
        who, which = np.repeat(np.arange(len(probes)), [len(p) for p in probes]), np.concatenate(probes)
        out = []
        for list_ in np.unique(own_list):
            here, asking = np.flatnonzero(own_list == list_), who[which == list_]
            for lo in range(0, len(asking), 256):
                part = asking[lo : lo + 256]
                i, j = np.nonzero(m.lookup(list_, y[part], codes[here]) <= radius + err[here][None] + 1e-6)
                i, j = part[i], here[j]
                exact = np.concatenate([np.einsum("ij,ij->i", y[i[k : k + 65536]], x[j[k : k + 65536]]) for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
                good = (exact >= least) & (own[i] != ids[j])
                out.append((i[good], j[good]))
        i, j = (np.concatenate([o[k] for o in out]) for k in (0, 1))
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        links = np.bincount(i, weights=counts[j], minlength=len(own)).astype(np.int64)
        hit = np.flatnonzero(links)
        a, b = spanning(own[i], ids[j])
        return pa.table({"a": np.concatenate((own[hit], a)), "b": np.concatenate((own[hit], b)), "n": np.concatenate((links[hit], np.zeros(len(a), np.int64)))})

    keys = ["part", "grp", "pb", "pq"]
    found = written(e.select(*keys, "list", "cid", "n", "x", "code", "err").groupBy(*keys).cogroup(q.select(*[F.col(k).alias(k) for k in (*keys, "lists", "cid", "x")]).groupBy(*keys)).applyInArrow(lean(search), "a long, b long, n long"))
    degree = found.groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("links"))
    joined = components(found.where("a <> b").select("a", "b").distinct())
    named = classes.select("cid", "n", "least_id").join(joined.select(F.col("node").alias("cid"), "component_id"), "cid", "left").withColumn("g", F.coalesce("component_id", "cid")).drop("component_id")
    named = named.join(named.groupBy("g").agg(F.min("least_id").alias("component_id")), "g").join(degree, "cid", "left")
    told = named.select("cid", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "cid").join(told, "cid", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_pq(spark, sf_dir: str) -> DataFrame:
    """Links and components of all `embeddings` at a cosine of 0.98 within equal labels."""
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
