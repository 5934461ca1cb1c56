"""Exact nearest vectors from a table in coarse cells: cells that can't hold one of them are not read.

Cells are folders of a Parquet table, each around a centre and with the largest distance of its vectors from it. By the triangle
inequality a vector of a cell is no nearer to a query than the centre less that radius. Cells with the best bounds are read until
they hold k rows, then those whose bound could still beat the k-th score, so results equal those of a scan."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import vectors as V

#: Centres come from a sample of at most so many vectors, the first by a hash of the key; rows are all dealt to cells.
SAMPLE, CELLS, ROUNDS = 8192, 64, 5
#: What sums of doubles can be off by, relatively: bounds are loosened by it.
SLACK = 1e-9


def centres(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds from evenly spread starts; fewer than `cells` where the sample is smaller."""
    c = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmin((c**2).sum(1)[None] - 2 * sample @ c.T, axis=1)
        for i in range(len(c)):
            if (own == i).any():
                c[i] = sample[own == i].mean(0)
    return c


def _space(metric: str, v: Column) -> Column:
    """The vector in the space whose distances bound the metric: of unit length for cosine, as it is for the others."""
    d = F.transform(v, lambda x: x.cast("double"))
    n = V.norm(v)
    return F.when(n > 0, F.transform(d, lambda x: x / n)) if metric == "cosine" else d


def build(vectors: DataFrame, path: str, metric: str, dims: int, key: str = "vec_id", column: str = "embedding", cells: int = CELLS) -> None:
    """Writes the table (all columns, `cell`) and beside it `{path}-cells` (cell, n, radius, centre).

    Vectors that are null, of another length than `dims`, hold a null or, for cosine, are zero go to cell -1, which each search reads."""
    good = F.coalesce((F.size(column) == dims) & ~F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double"))), F.lit(False))
    rows = vectors.withColumn("_x", F.when(good, _space(metric, F.col(column))))
    few = rows.where("_x is not null").select("_x", F.xxhash64(F.col(key).cast("string")).alias("_h")).orderBy("_h").limit(SAMPLE).toPandas()
    sample = np.stack(few["_x"].to_list()) if len(few) else np.zeros((0, dims))
    c = centres(sample, cells) if len(sample) else sample

    @F.pandas_udf("struct<cell int, off double>")
    def nearest(x: pd.Series) -> pd.DataFrame:
        there = x.notna().to_numpy()
        cell, off = np.full(len(x), -1, np.int32), np.zeros(len(x))
        if there.any() and len(c):
            m = np.stack(x[there].to_list()).astype(float)
            own = np.argmin((c**2).sum(1)[None] - 2 * m @ c.T, axis=1)
            cell[there], off[there] = own, np.sqrt(((m - c[own]) ** 2).sum(1))
        return pd.DataFrame({"cell": cell, "off": off})

    dealt = rows.withColumn("_c", nearest("_x")).drop("_x").select("*", F.col("_c.cell").alias("cell"), F.col("_c.off").alias("off")).drop("_c")
    # a cell of very many vectors is written by several tasks
    dealt.repartition("cell", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(8))).write.mode("overwrite").partitionBy("cell").parquet(path)
    spark = vectors.sparkSession
    stats = spark.read.parquet(path).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("radius"))
    at = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(c)] + [(-1, [])], "cell int, centre array<double>")
    stats.join(at, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}-cells")


def bound(metric: str, q: np.ndarray, centre: np.ndarray, radius: float) -> float:
    """No vector of the cell has a better score."""
    if metric == "dot_product":
        best = float(q @ centre) + float(np.linalg.norm(q)) * radius
        return best + SLACK * (1 + abs(best))
    if metric == "cosine":
        n = float(np.linalg.norm(q))
        near = max(0.0, float(np.linalg.norm(q / n - centre)) - radius) if n else 0.0
        return 1 - near * near / 2 + SLACK
    near = max(0.0, float(np.linalg.norm(q - centre)) - radius)
    return -near + SLACK * (1 + near)


def search(spark: SparkSession, path: str, query: list[float], k: int, metric: str, key: str = "vec_id", column: str = "embedding", where: Column | None = None) -> tuple[DataFrame, list[int]]:
    """The k nearest rows as vectors.top() gives them, and the cells that were read. The cells' facts, as many rows as the build was asked for, are on the driver."""
    cells = spark.read.parquet(f"{path}-cells").collect()
    q = np.asarray(query, float)
    best = {r["cell"]: math.inf if r["cell"] < 0 else bound(metric, q, np.asarray(r["centre"]), r["radius"]) for r in cells}
    order = sorted(cells, key=lambda r: (-best[r["cell"]], r["cell"]))
    table, lit = spark.read.parquet(path).drop("off"), V.literal(list(query))
    top = lambda at: V.top(table.where(F.col("cell").isin(at)), lit, k, metric, key=key, column=column, where=where)
    read, n = [], 0
    for r in order:
        if n >= k and r["cell"] >= 0:
            break
        read.append(r["cell"])
        n += r["n"]
    while True:
        # a filter can leave fewer than k rows: then all that is left may hold one
        scores = [-math.inf if r["score"] is None else r["score"] for r in top(read).select("score").collect()]
        least = -math.inf if len(scores) < k else min(scores)
        more = [r["cell"] for r in order if r["cell"] not in read and best[r["cell"]] >= least]
        if not more:
            return top(read).drop("cell"), read
        if len(scores) < k:
            more = more[: max(1, len(read))]
        read += more
