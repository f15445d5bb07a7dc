"""Exact top-k by inner product: tiled matrix products, partial selection per tile, tree merge of the lists."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, ship
from .common import table

ITEM_ROWS, QUERY_ROWS = 8192, 2048  # most rows of a shard and of a query tile: a few MB each
FAN_IN = 16
EXACT = float(1 << 53)


def exact_scores(queries: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Integer inner products of integer-valued matrices; floating point only while it is exact."""
    bound = np.abs(queries).max(initial=0) * np.abs(items).max(initial=0) * queries.shape[1]
    if bound < EXACT:
        return (queries @ items.T).astype(np.int64)
    as_int = np.vectorize(int, otypes=[object])
    limit = np.iinfo(np.int64)
    return np.clip(as_int(queries) @ as_int(items).T, limit.min, limit.max).astype(np.int64)


def tile_lists(k: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def best(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        queries, items = rows[rows["asks"]], rows[~rows["asks"]]
        out = {"query_id": [], "version": [], "vec_id": [], "score": []}
        if len(queries) and len(items):
            items = items.sort_values("vec_id", kind="stable")
            ids = items["vec_id"].to_numpy()
            shard, asked = np.stack(items["x"].to_numpy()).astype(float), np.stack(queries["x"].to_numpy()).astype(float)
            for at in range(0, len(queries), 256):
                block = queries.iloc[at:at + 256]
                scores = exact_scores(asked[at:at + 256], shard)
                for score, q, version in zip(scores, block["vec_id"].to_numpy(), block["version"].to_numpy()):
                    pick = np.arange(len(ids))
                    if len(ids) > k + 64:  # all that reach the k-th best of the others, ties included
                        own = int((ids == q).sum())
                        floor = np.partition(score, len(score) - k - own)[len(score) - k - own]
                        pick = np.flatnonzero(score >= floor)
                    pick = pick[ids[pick] != q]
                    pick = pick[np.argsort(-score[pick].astype(object) if abs(score[pick]).max(initial=0) > 1 << 62 else -score[pick], kind="stable")][:k]
                    out["query_id"].append(np.full(len(pick), q))
                    out["version"].append(np.full(len(pick), version))
                    out["vec_id"].append(ids[pick])
                    out["score"].append(score[pick])
        lists = pd.DataFrame({c: np.concatenate(v) if v else np.empty(0, np.int64) for c, v in out.items()})
        return lists.assign(node=np.int64(key[1]))
    return best


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, scale: float | None = None, item_rows: int = ITEM_ROWS,
               query_rows: int = QUERY_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """The k best candidates of every query: (query_id, rank, vec_id, score), ties to the smaller vec_id.

    vectors(vec_id, embedding): with `scale` each component x becomes floor(scale * x) first; without it the
    components must hold whole numbers.  Scores are exact integers (saturated at the range of long).  Rows with a null
    id, a null or empty vector, or null or non-finite components take no part.  Identical rows count once; an id that
    comes with several vectors is a candidate with each and, as a query, gets one list per vector.  Candidates are all
    rows but those of the query's own id; vectors of different lengths are not compared.  Other columns are ignored.

    Queries and items are dealt by hash into tiles of bounded size; each (query tile, shard) pair is one group: one
    matrix product, and at most k rows per query leave it.  The lists merge in a tree of `fan_in` shards per node.
    """
    spark = vectors.sparkSession
    ship(spark)
    scaled = lambda x: x.cast("double") * F.lit(float(scale or 1))
    component = lambda x: F.when(F.abs(scaled(x)) < F.lit(EXACT), F.floor(scaled(x)).cast("double")).otherwise(scaled(x))  # noqa: E731  (larger doubles are whole)
    fit = vectors.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).filter(
        ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))))
    rows = fit.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("asked")).distinct()
    rows = materialize(rows.select(
        "vec_id", F.xxhash64("embedding").alias("version"), F.size("embedding").alias("dim"), F.coalesce("asked", F.lit(False)).alias("asked"),
        F.transform("embedding", component).alias("x")), "topk_rows")
    total = rows.agg(F.count("*"), F.count(F.when(F.col("asked"), 1))).first()
    shards, tiles = -(-total[0] // item_rows) or 1, -(-total[1] // query_rows) or 1
    spread = lambda n: F.pmod(F.xxhash64("vec_id", "version"), F.lit(n)).cast("int")
    items = rows.select("dim", spread(shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), "vec_id", "version", "x", F.lit(False).alias("asks"))
    asked = rows.filter("asked").select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), spread(tiles).alias("tile"), "vec_id", "version", "x", F.lit(True).alias("asks"))
    lists = items.unionByName(asked).groupBy("dim", "shard", "tile").applyInPandas(
        tile_lists(k), "query_id long, version long, vec_id long, score long, node long")
    nodes = shards
    while True:
        nodes = -(-nodes // fan_in)
        lists = lists.withColumn("node", (F.col("node") / fan_in).cast("long"))
        order = Window.partitionBy("query_id", "version", "node").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        if nodes <= 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_topk(vectors, F.col("vec_id") % 50 == 0, k=5, scale=256.0)


ORACLE = """
WITH fit AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM fit q JOIN fit c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
