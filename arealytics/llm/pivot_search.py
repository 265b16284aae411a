"""Exact top-k by integer inner product over a pivot-distance index.

Every vector belongs to its nearest pivot and is keyed by (pivot, distance). Rings of similar distance are cut into blocks of bounded size; a
block knows its distance range and its longest vector. For a query at distance d from the pivot the triangle inequality bounds the inner
product with anything in the block, so blocks are read from the most promising on, and a query stops once its k-th score beats the bounds of
the rest. Three rounds: the 2 best blocks, the next 8, then every block whose bound still reaches the k-th score.

Defined results: vectors that are NULL or hold NULL or non-finite components, and rows without an id, take no part; shorter vectors count as
ending in zeros; an empty table gives no rows; of query rows that repeat an id the smallest vector asks; rows with the query's id are never its
candidates; extra columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .common import best, written

BLOCK_ROWS, QUERY_ROWS, ROUNDS = 512, 2048, (2, 8)


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def scaled(vectors: DataFrame, vec_id: str, vector: str, factor: int) -> DataFrame:
    """(vec_id, ints): every component x as floor(factor * x)."""
    return (vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
            .select("vec_id", F.transform("v", lambda x: F.floor(x.cast("double") * factor).cast("long")).alias("ints")))


def matrix(rows, width: int, dtype=np.int64) -> np.ndarray:
    """Rows as a matrix, cut or filled with zeros to the width."""
    out = np.zeros((len(rows), width), dtype=dtype)
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return out


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows: doubles carry them while no partial sum can pass 2**53, else 64-bit integers."""
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(1, left.shape[1])
    if most < 2 ** 53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left @ right.T


def build(points: DataFrame, pivots: int = 32) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """The index rows (vec_id, ints, block), the block table, and the pivots (a bounded sample by hash: at most `pivots` vectors)."""
    chosen = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).select("ints").collect()
    width = max((len(r[0]) for r in chosen), default=0)
    centres = matrix([r[0] for r in chosen], width).astype(np.float64)

    @pandas_udf(T.StructType([T.StructField("pivot", T.IntegerType()), T.StructField("distance", T.DoubleType()), T.StructField("length", T.DoubleType())]))
    def placed(ints: pd.Series) -> pd.DataFrame:
        out = []
        for at in range(0, len(ints), 4096):
            rows = list(ints.iloc[at:at + 4096])
            wide = max([centres.shape[1], *map(len, rows)])
            v = matrix(rows, wide).astype(np.float64)
            c = np.zeros((len(centres), wide))
            c[:, :centres.shape[1]] = centres
            squares = (v * v).sum(1)
            apart = np.maximum(squares[:, None] + (c * c).sum(1)[None, :] - 2 * (v @ c.T), 0)
            near = apart.argmin(1)
            out.append(pd.DataFrame({"pivot": near.astype(np.int32), "distance": np.sqrt(((v - c[near]) ** 2).sum(1)), "length": np.sqrt(squares)}))
        return pd.concat(out) if out else pd.DataFrame({"pivot": [], "distance": [], "length": []})

    if not chosen:
        return points.limit(0).selectExpr("vec_id", "ints", "0L AS block"), points.limit(0).selectExpr("0L AS block", "0 AS pivot", "0D AS low", "0D AS high", "0D AS longest", "0L AS n"), centres
    keyed = written(points.withColumn("p", placed("ints")).select("vec_id", "ints", "p.*"))
    # One row per pivot: as many rings of equal width as its rows need.
    cells = F.broadcast(keyed.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("rings"), F.max("distance").alias("far")))
    ring = F.when(F.col("far") > 0, F.least(F.floor(F.col("distance") / F.col("far") * F.col("rings")), F.col("rings") - 1)).otherwise(F.lit(0)).cast("long")
    keyed = keyed.join(cells, "pivot").withColumn("ring", ring)
    # A ring that still has more rows than a block holds is dealt over several blocks by hash.
    parts = keyed.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / (2 * BLOCK_ROWS)).alias("parts"))
    keyed = keyed.join(parts, ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    keyed = keyed.withColumn("block", F.xxhash64("pivot", "ring", "part"))
    rows = written(keyed.select("vec_id", "ints", "block", "pivot", "distance", "length"))
    blocks = rows.groupBy("block").agg(F.min("pivot").alias("pivot"), F.min("distance").alias("low"), F.max("distance").alias("high"), F.max("length").alias("longest"), F.count("*").alias("n"))
    return rows.select("vec_id", "ints", "block"), written(blocks), centres


def _bounds(queries: DataFrame, blocks: DataFrame, centres: np.ndarray) -> DataFrame:
    """(query_id, block, most): an upper bound of the inner product of the query with any vector of the block; one equi-join on the pivot."""
    kind = T.ArrayType(T.StructType([T.StructField("pivot", T.IntegerType()), T.StructField("apart", T.DoubleType()), T.StructField("dot", T.DoubleType())]))

    @pandas_udf(kind)
    def to_pivots(ints: pd.Series) -> pd.Series:
        out = []
        for row in ints:
            wide = max(len(row), centres.shape[1])
            q, c = matrix([row], wide).astype(np.float64)[0], np.zeros((len(centres), wide))
            c[:, :centres.shape[1]] = centres
            out.append([{"pivot": i, "apart": float(a), "dot": float(d)} for i, (a, d) in enumerate(zip(np.sqrt(((c - q) ** 2).sum(1)), c @ q))])
        return pd.Series(out, dtype=object)

    own = F.sqrt(F.aggregate("ints", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    q = queries.select("query_id", own.alias("own"), F.explode(to_pivots("ints")).alias("p")).select("query_id", "own", "p.*")
    gap = F.greatest(F.lit(0.0), F.col("apart") - F.col("high"), F.col("low") - F.col("apart"))
    by_gap = (F.col("own") * F.col("own") + F.col("longest") * F.col("longest") - gap * gap) / 2
    by_radius = F.col("dot") + F.col("own") * F.col("high")
    most = F.least(by_gap, by_radius, F.col("own") * F.col("longest"))
    return q.join(blocks, "pivot").select("query_id", "block", (most + F.abs(most) * 1e-9 + 1).alias("most"))


def _scores(pairs: DataFrame, queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of every (query, block) pair. A block that many queries visit is read by several groups of them."""
    chunks = pairs.groupBy("block").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("chunks"))
    asked = (pairs.join(queries, "query_id").join(chunks, "block")
             .select("block", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int").alias("chunk"), "query_id", F.col("ints").alias("q")))
    read = rows.join(chunks, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "vec_id", "ints")

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
        if not len(left) or not len(right):
            return empty
        right = right.sort_values("vec_id", kind="stable")
        ids, out = right.vec_id.to_numpy(), []
        wide = max(max(map(len, right.ints)), max(map(len, left.q)))
        v = matrix(list(right.ints), wide)
        for at in range(0, len(left), 256):
            part = left.iloc[at:at + 256]
            got = products(matrix(list(part.q), wide), v)
            for query, line in zip(part.query_id.to_numpy(), got):
                other = np.flatnonzero(ids != query)
                line = line[other]
                first = np.argsort(-line, kind="stable")[:k]  # ids ascend, so ties go to the smaller id
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[other[first]], "score": line[first]}))
        return pd.concat(out) if out else empty

    return asked.groupBy("block", "chunk").cogroup(read.groupBy("block", "chunk")).applyInPandas(score, "query_id long, vec_id long, score long")


def search(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10, every: int = 100, factor: int = 1024, pivots: int = 32) -> DataFrame:
    """(query_id, rank, vec_id, score): for every id divisible by `every` the k highest integer inner products with all other rows; exact."""
    points = written(scaled(vectors, vec_id, vector, factor))
    queries = written(points.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("ints").alias("ints")))
    rows, blocks, centres = build(points, pivots)
    bounds = best(_bounds(queries, blocks, centres), "query_id", "most", "block", 2 ** 31 - 1)
    bounds = written(bounds)
    found, start = None, 0
    for size in (*ROUNDS, 2 ** 31):
        pairs = bounds.where((F.col("rank") > start) & (F.col("rank") <= start + size))
        if found is not None:
            kth = found.groupBy("query_id").agg(F.count("*").alias("had"), F.min("score").alias("least"))
            pairs = pairs.join(kth, "query_id", "left").where(F.col("had").isNull() | (F.col("had") < k) | (F.col("most") >= F.col("least")))
        got = _scores(written(pairs.select("query_id", "block")), queries, rows, k)
        got = got if found is None else got.unionByName(found.select("query_id", "vec_id", "score"))
        found, start = written(best(got, "query_id", "score", "vec_id", k)), start + size
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
