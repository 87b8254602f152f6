"""Approximate nearest neighbours by low-dimensional stable projections and a kd-tree.

Unit vectors are projected on DIMENSIONS Gaussian directions. The squared projected distance of two
vectors, over their squared distance, has a chi-square distribution with DIMENSIONS degrees of freedom.
A search takes projected neighbours in the order of a kd-tree's boxes, verifies each by its true
cosine, and stops when even the nearest box that is left lies so far that, if it held a vector nearer
than the k-th found, its projection would have come before with probability SURE: the chi-square test.
So each true neighbour is missed with probability 1 - SURE at most.

The tree has two levels. Its top, fitted on a bounded sample, deals all vectors to cells; every row is
indexed, and a cell that holds more than CELL_ROWS rows is dealt to several shards by a hash. Inside a
shard the tree goes on to leaves. A query is searched in its own cell first; the distance found there
says which other cells the test cannot rule out, and only there it goes. Queries that meet in one shard
are handled in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from palisade.llm.common import identified, save, scanned, tidy

DIMENSIONS, SURE, SEED = 12, 0.98, 11
#: Rows of a shard, queries of a block, rows of a leaf, rows that the top of the tree is fitted on.
CELL_ROWS, QUERY_ROWS, LEAF, SAMPLE = 4_096, 20_000, 64, 16_384
MOST_CELLS = 4_096
FOUND = "quid binary, query_id long, vec_id long, score double"


def chi_square_quantile(p: float, m: int) -> float:
    """The x below which a chi-square variable with an even number m of degrees of freedom stays with
    probability p."""
    cdf = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
    lo, hi = 0.0, 1e3
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def directions(dim: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([SEED, dim])).standard_normal((dim, DIMENSIONS))


def units(vectors: np.ndarray) -> np.ndarray:
    big = np.abs(vectors).max(1, keepdims=True)
    scaled = vectors / big
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def split_tree(points: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """The top of a kd-tree as (axes, cuts) in heap order; leaves is a power of two. A part without
    points repeats a cut, so its second half stays empty."""
    axes, cuts = np.zeros(leaves, np.int32), np.zeros(leaves)
    parts = {1: points}
    for node in range(1, leaves):
        own = parts.pop(node)
        if len(own):
            axes[node] = int((own.max(0) - own.min(0)).argmax())
            cuts[node] = np.median(own[:, axes[node]])
        right = own[:, axes[node]] > cuts[node]
        parts[2 * node], parts[2 * node + 1] = own[~right], own[right]
    return axes, cuts


def cells_of(points: np.ndarray, axes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    node = np.ones(len(points), np.int64)
    while len(axes) > 1 and node.size and node[0] < len(axes):
        node = 2 * node + (points[np.arange(len(points)), axes[node]] > cuts[node])
    return node - (len(axes) if len(axes) > 1 else 1)


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for j in range(points.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, j] - points[:, j, None], points[:, j, None] - high[None, :, j]), 0)
        out += gap * gap
    return out


def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, vec_id, vector array<double>) to uid, vec_id, dim and the vector's bytes, without vectors
    that take no part."""
    for b in batches:
        keep, data, dims = [], [], []
        for v in b.column(2):
            v = None if not v.is_valid or v.values.null_count else np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
            ok = v is not None and len(v) > 0 and bool(np.isfinite(v).all()) and bool(v.any())
            keep.append(ok)
            if ok:
                data.append(v.tobytes())
                dims.append(len(v))
        kept = b.filter(pa.array(keep, pa.bool_()))
        yield pa.record_batch([kept.column(0), kept.column(1), pa.array(dims, pa.int32()), pa.array(data, pa.binary())], names=["uid", "vec_id", "dim", "vector"])


def matrix(vectors, dim: int) -> np.ndarray:
    """Vectors from their bytes; shorter ones end in zeros."""
    vectors = list(vectors)
    if all(len(v) == 8 * dim for v in vectors):
        return np.frombuffer(b"".join(vectors), np.float64).reshape(-1, dim)
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v) // 8] = np.frombuffer(v, np.float64)
    return out


def placed(dim: int, axes: np.ndarray, cuts: np.ndarray):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project = directions(dim)
        for b in batches:
            points = units(matrix(b.column(3).to_pylist(), dim)) @ project if len(b) else np.zeros((0, DIMENSIONS))
            cell = cells_of(points, axes, cuts)
            yield pa.record_batch([b.column(0), b.column(1), b.column(3), pa.array(cell.astype(np.int32)), pa.array(list(points), pa.list_(pa.float64()))], names=["uid", "vec_id", "vector", "cell", "point"])

    return f


def search(dim: int, k: int, quantile: float):
    """A shard's rows and the queries that visit it, to the k nearest of each query."""

    def f(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: tuple[list, ...] = ([], [], [], [])
        if len(rows) and len(queries):
            # of rows with one vector only the k + 1 smallest ids can be among the nearest of a query
            rows = rows.sort_values("vec_id", kind="stable", na_position="last")
            rows = rows[rows.groupby("vector").cumcount() <= k]
            vectors, points = matrix(rows["vector"], dim), np.stack(rows["point"].to_numpy())
            unit, ids, uids = units(vectors), rows["vec_id"].to_numpy(), rows["uid"].to_numpy()
            leaves = max(1, 1 << (len(rows) // LEAF).bit_length())
            leaf = cells_of(points, *split_tree(points, leaves)) if leaves > 1 else np.zeros(len(rows), np.int64)
            order = np.argsort(leaf, kind="stable")
            starts = np.concatenate([[0], np.flatnonzero(np.diff(leaf[order])) + 1, [len(order)]])
            unit, points, ids, uids = unit[order], points[order], ids[order], uids[order]
            low = np.minimum.reduceat(points, starts[:-1])
            high = np.maximum.reduceat(points, starts[:-1])
            at, of = np.stack(queries["point"].to_numpy()), units(matrix(queries["vector"], dim))
            far = box_distances(at, low, high)
            bounds = queries["bound"].to_numpy()
            for i, (quid, qid) in enumerate(zip(queries["uid"], queries["vec_id"], strict=True)):
                best: list[tuple[float, float, int]] = []
                bound = bounds[i]  # the cosine of the k-th found so far
                for box in np.argsort(far[i], kind="stable"):
                    limit = quantile * max(0.0, 2 - 2 * bound) + 1e-9
                    if far[i, box] > limit:
                        break
                    a, z = starts[box], starts[box + 1]
                    near = points[a:z] - at[i]
                    near = np.flatnonzero((near * near).sum(1) <= limit) + a
                    if not len(near):
                        continue
                    scores = (unit[near] * of[i]).sum(1)
                    for j in np.flatnonzero(scores >= bound):
                        n = near[j]
                        if uids[n] != quid:
                            best.append((-scores[j], math.inf if ids[n] is None or ids[n] != ids[n] else ids[n], n))
                    best.sort()
                    del best[k:]
                    if len(best) == k:
                        bound = max(bound, -best[-1][0])
                for score, _, n in best:
                    for column, value in zip(out, (quid, qid, ids[n], -score), strict=True):
                        column.append(value)
        return pd.DataFrame({"quid": pd.Series(out[0], dtype=object), "query_id": pd.array(out[1], "Int64"), "vec_id": pd.array([None if x != x else x for x in out[2]], "Int64"), "score": pd.Series(out[3], dtype="float64")})

    return f


@tidy
def neighbours(spark: SparkSession, table: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine of each row of table (vec_id, embedding)
    whose vec_id is divisible by `every`, among all other rows; ties to the smaller vec_id.

    Vectors that are null, empty, zero or hold null or non-finite components take no part. Where
    lengths differ, shorter vectors count as ending in zeros. A query has fewer results only if there
    are fewer rows; a repeated query row has results of its own, and its copies are candidates. Null
    ids are no queries, and come last among ties.
    """
    table = scanned(spark, table)
    rows = identified(table, [table["vec_id"].cast("long").alias("vec_id"), table["embedding"].cast("array<double>").alias("vector")])
    rows = save(spark, rows.mapInArrow(usable, "uid binary, vec_id long, dim int, vector binary"), "vectors")
    total, dim = rows.agg(F.count(F.lit(1)), F.max("dim")).first()
    result = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], result)
    quantile = chi_square_quantile(SURE, DIMENSIONS)
    cells = 1
    while cells < MOST_CELLS and cells * CELL_ROWS < total:
        cells *= 2
    sample = rows.sample(fraction=min(1.0, SAMPLE / total), seed=SEED).select("vector").limit(2 * SAMPLE).collect()
    seen = units(matrix([r["vector"] for r in sample], dim)) @ directions(dim) if sample else np.zeros((0, DIMENSIONS))
    axes, cuts = split_tree(seen, cells) if cells > 1 else (np.zeros(1, np.int32), np.zeros(1))
    index = save(spark, rows.mapInArrow(placed(dim, axes, cuts), "uid binary, vec_id long, vector binary, cell int, point array<double>"), "index")

    # a row for each cell: its box, and into how many shards it is dealt
    ends = [f(F.col("point")[j]).alias(f"{f.__name__}{j}") for f in (F.min, F.max) for j in range(DIMENSIONS)]
    boxes = index.groupBy("cell").agg(F.count(F.lit(1)).alias("held"), *ends).orderBy("cell").collect()
    low, high = (np.array([[r[f"{f}{j}"] for j in range(DIMENSIONS)] for r in boxes]) for f in ("min", "max"))
    names = np.array([r["cell"] for r in boxes])
    shards = spark.createDataFrame([(r["cell"], -(-r["held"] // CELL_ROWS)) for r in boxes], "cell int, shards int")

    def visited(queries: DataFrame) -> DataFrame:
        """The k nearest in the cells that queries (cell, uid, vec_id, vector, point, bound) go to."""
        blocks = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("blocks"))
        deal = F.broadcast(shards.join(blocks, "cell"))  # a row for each cell: MOST_CELLS at most
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = index.join(deal, "cell").withColumn("shard", F.pmod(F.hash("uid"), F.col("shards"))).withColumn("block", spread("blocks"))
        right = queries.join(deal, "cell").withColumn("block", F.pmod(F.hash("uid"), F.col("blocks"))).withColumn("shard", spread("shards"))
        keys = ["cell", "shard", "block"]
        left = left.select(*keys, "uid", "vec_id", "vector", "point", F.lit(0.0).alias("bound"), F.lit(False).alias("asks"))
        right = right.select(*keys, "uid", "vec_id", "vector", "point", "bound", F.lit(True).alias("asks"))
        f = search(dim, k, quantile)
        return left.unionByName(right).groupBy(*keys).applyInPandas(lambda x: f(x[~x["asks"]], x[x["asks"]]), FOUND)

    queries = index.filter(F.col("vec_id") % every == 0)
    near = save(spark, visited(queries.withColumn("bound", F.lit(-math.inf))), "near")
    kth = near.groupBy("quid").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
    bound = F.coalesce(F.get("scores", F.lit(k - 1)), F.lit(-math.inf))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.array(b.column(3).to_pylist()).reshape(-1, DIMENSIONS)
            bounds = b.column(5).to_numpy(zero_copy_only=False)
            go = box_distances(at, low, high) <= quantile * np.maximum(0, 2 - 2 * bounds)[:, None] + 1e-9
            go &= names[None, :] != b.column(4).to_numpy()[:, None]
            i, j = np.nonzero(go)
            picked = b.take(pa.array(i))
            yield pa.record_batch([picked.column(0), picked.column(1), picked.column(2), picked.column(3), pa.array(names[j].astype(np.int32)), picked.column(5)], names=["uid", "vec_id", "vector", "point", "cell", "bound"])

    asked = queries.join(kth.withColumnRenamed("quid", "uid"), "uid", "left").select("uid", "vec_id", "vector", "point", "cell", bound.alias("bound"))
    away = save(spark, asked.mapInArrow(route, "uid binary, vec_id long, vector binary, point array<double>, cell int, bound double"), "visits")
    found = near.unionByName(visited(away))
    best = W.partitionBy("quid").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
