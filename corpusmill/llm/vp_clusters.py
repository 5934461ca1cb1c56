"""Centroid clustering: exact integer k-means whose assignments search a vantage-point tree over the centroids.

Each round the driver builds a tree over the k centroids, k a parameter, and broadcasts it. A vector takes open nodes best bound
first and stops when no open bound is within its best distance; bounds are loosened by the rounding of the square roots and the
radius counts as inside, so ties reach the leaf and the smaller number wins. Batches of vectors walk in step: at each step every
vector visits the node that is best for it, and vectors at one node are measured together. Sums of a round are added up in the
tasks, then by cluster on Spark; k rows reach the driver, which takes exact floors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import lean, written

DIMS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Coordinates are below 2^26: squared distances of 64 of them, and the sum over 2^24 vectors at that distance, fit into 64 bits.
LIMIT = 1 << 26
#: Below this, sums of 64 squared differences are exact in doubles.
EXACT_FLOAT = 1 << 22
#: Vectors that walk the tree in step.
STEP = 4096


class Tree:
    """Vantage-point tree over integer points. Node i holds point number `point[i]`; its children's points lie within [low, high] of it."""

    def __init__(self, points: np.ndarray):
        self.points = np.asarray(points, np.int64).reshape(len(points), -1)
        self.point: list[int] = []
        self.children: list[list[tuple[int, float, float]]] = []
        if len(self.points):
            self._build(list(range(len(self.points))))

    def _build(self, numbers: list[int]) -> int:
        node, vantage = len(self.point), numbers[0]
        self.point.append(vantage)
        self.children.append([])
        rest = np.array(numbers[1:], np.int64)
        if len(rest):
            d = np.sqrt(squared(self.points[rest], self.points[vantage]).astype(np.float64))
            order = np.argsort(d, kind="stable")
            for half in (order[: (len(order) + 1) // 2], order[(len(order) + 1) // 2 :]):
                if len(half):
                    child = self._build([int(x) for x in rest[half]])
                    self.children[node].append((child, float(d[half[0]]), float(d[half[-1]])))
        return node

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest point and squared distance of each row of x; and how many distances were computed."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        own = np.full(len(x), len(self.points), np.int64)
        bound = np.full((len(x), len(self.point)), np.inf)
        bound[:, 0] = 0.0
        rows, measured = np.arange(len(x)), 0
        while len(rows):
            at = np.argmin(bound[rows], axis=1)
            near = bound[rows, at] <= np.sqrt(best[rows].astype(np.float64))
            rows, at = rows[near], at[near]
            bound[rows, at] = np.inf
            for node in np.unique(at):
                here = rows[at == node]
                d = squared(x[here], self.points[self.point[node]])
                measured += len(here)
                better = (d < best[here]) | ((d == best[here]) & (self.point[node] < own[here]))
                best[here[better]], own[here[better]] = d[better], self.point[node]
                root = np.sqrt(d.astype(np.float64))
                for child, low, high in self.children[node]:
                    # as far as a square root and a difference can be off
                    slack = 1e-12 * (root + high) + 1e-9
                    bound[here, child] = np.maximum(np.maximum(root - high, low - root) - slack, 0.0)
        return own, best, measured


def squared(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to an integer point."""
    d = x - point
    if d.size and max(int(d.max()), -int(d.min())) < EXACT_FLOAT:
        f = d.astype(np.float64)
        return np.einsum("ij,ij->i", f, f).astype(np.int64)
    return (d * d).sum(axis=1, dtype=np.int64)


def integers(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the vectors that are kept, and their components as floor(scale * x)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dims)
    flat = column.take(pa.array(rows)).flatten()
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    with np.errstate(over="ignore"):
        x = np.floor(x * float(scale))
    good = (np.isfinite(x) & (np.abs(x) < LIMIT)).all(axis=1) if len(x) else np.zeros(0, bool)
    return rows[good], x[good].astype(np.int64)


def kept_vectors(vectors: DataFrame, id_col: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(id, x array<int>): the vectors that take part."""
    kind = dict(vectors.select(F.col(f"`{id_col}`").alias("id")).dtypes)["id"]

    def cast(batches):
        for b in batches:
            rows, x = integers(b.column(1), dims, scale)
            at = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(dims))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32).ravel()))], ["id", "x"])

    return vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector}`").alias("x")).mapInArrow(lean(cast), f"id {kind}, x array<int>")


def rows_of(b: pa.RecordBatch, dims: int) -> np.ndarray:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def assigned(points: DataFrame, centroids: list[list[int]], dims: int) -> DataFrame:
    """(id, cluster, distance) of each point."""
    tree = points.sparkSession.sparkContext.broadcast(Tree(centroids))
    kind = dict(points.dtypes)["id"]

    def search(batches):
        for b in batches:
            for lo in range(0, b.num_rows, STEP):
                part = b.slice(lo, STEP)
                own, d, _ = tree.value.nearest(rows_of(part, dims))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(own.astype(np.int32)), pa.array(d)], ["id", "cluster", "distance"])

    return points.mapInArrow(lean(search), f"id {kind}, cluster int, distance long")


def moved(points: DataFrame, centroids: list[list[int]], dims: int) -> list[list[int]]:
    """The centroids after a round: exact floors of the means of their points, as they were where they have none."""
    tree = points.sparkSession.sparkContext.broadcast(Tree(centroids))

    def add_up(batches):
        n, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, STEP):
                x = rows_of(b.slice(lo, STEP), dims)
                own, _, _ = tree.value.nearest(x)
                n += np.bincount(own, minlength=len(n))
                np.add.at(sums, own, x)
        at = np.repeat(np.flatnonzero(n), dims)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.tile(np.arange(dims), len(at) // dims)), pa.array(n[at]), pa.array(sums[n > 0].ravel())], ["cluster", "i", "n", "s"])

    parts = points.mapInArrow(lean(add_up), "cluster long, i long, n long, s long")
    out = [list(c) for c in centroids]
    for r in parts.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # at most k * dims rows
        out[r["cluster"]][r["i"]] = int(r["s"]) // int(r["n"])
    return out


def first_centroids(points: DataFrame, k: int) -> list[list[int]]:
    """The k points with the least hash of their id, repeated ids by their components."""
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [list(r["x"]) for r in points.select(key.alias("h"), "x").orderBy("h", "x").limit(k).collect()]


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row for each vector that is kept.

    Kept are vectors of exactly `dims` components, none null or non-finite; components whose integers reach 2^26 would pass 64 bits
    in the distances, and set their vector aside as well. Repeated rows count each; null ids hash as the empty text. Fewer vectors
    than k give as many centroids; an empty table gives an empty result. Other columns are ignored, whatever their names."""
    points = written(kept_vectors(vectors, id_col, vector, dims, scale))
    centroids = first_centroids(points, k)
    for _ in range(rounds if centroids else 0):
        centroids = moved(points, centroids, dims)
    spark = points.sparkSession
    found = written(assigned(points, centroids, dims)) if centroids else points.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most k rows
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, s, sum(sums.values()), hashes[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_vp_clusters(spark, sf_dir: str) -> DataFrame:
    """Every kept vector with its cluster after three rounds; see clusters()."""
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_sql(k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> str:
    steps = [
        f"p as materialized (select vec_id, x from (select vec_id, list_transform(embedding, lambda e: floor({scale} * e::double)::bigint) as x from embeddings where len(embedding) = {dims} and list_aggregate(list_transform(embedding, lambda e: case when e is null or not isfinite(e) then 1 else 0 end), 'sum') = 0))",
        f"c0 as materialized (select (row_number() over (order by sha256('1:' || vec_id), x) - 1)::int as cluster, x from p qualify cluster < {k})",
    ]

    def nearest(i: int) -> str:
        return f"a{i} as materialized (select vec_id, pt, (m).c as cluster, (m).d as distance from (select p.vec_id, p.x as pt, min(struct_pack(d := list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, c := c.cluster)) as m from p, c{i} c group by all))"

    for i in range(rounds):
        steps += [
            nearest(i),
            f"s{i} as materialized (select cluster, i, sum(pt[i])::hugeint as s, count(*)::hugeint as n from a{i}, (select unnest(range(1, {dims + 1})) as i) group by all)",
            f"c{i + 1} as materialized (select c.cluster, coalesce(m.x, c.x) as x from c{i} c left join (select cluster, list(((s - ((s % n) + n) % n) // n)::bigint order by i) as x from s{i} group by all) m on m.cluster = c.cluster)",
        ]
    steps.append(nearest(rounds))
    return f"with {', '.join(steps)} select vec_id, a.cluster, distance, (sum(distance) over (partition by a.cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia, sha256(array_to_string(c.x, ',')) as centroid_sha256 from a{rounds} a join c{rounds} c on c.cluster = a.cluster"
