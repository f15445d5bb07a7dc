"""Approximate nearest neighbours by a hash-prefix forest: sorted arrays of hash strings per tree, longest-prefix descent, synchronous ascent."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, ship
from .common import table

SHARD_ROWS, TILE_ROWS = 8192, 1024  # most vectors of a shard of the index and queries of a tile, on average: a few MB each
TREES, BITS = 64, 24                # hash strings per vector and their length
SHARE = 0.5                         # part of a shard that a query gathers before it stops ascending
FAN_IN = 64                         # lists of a query that meet in one group
SLACK = 1e-9                        # relative: products this near the k-th best are computed again, row by row


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay."""
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(top > 0, top, 1.0)
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size > 0, size, 1.0)


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors of length one with one more component, so that the angle to a query orders them by inner product."""
    x = x / longest
    return np.concatenate([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1, keepdims=True)))], axis=1)


def hash_strings(x: np.ndarray, trees: int, bits: int, seed: int) -> np.ndarray:
    """Per tree and row a string of sign bits against seeded random directions, first bit highest: trees x rows."""
    rng = np.random.default_rng([seed, x.shape[1]])
    place = (np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64))
    out = np.empty((trees, len(x)), np.uint64)
    for tree in range(trees):
        out[tree] = ((x @ rng.standard_normal((x.shape[1], bits)) > 0) * place).sum(axis=1, dtype=np.uint64)
    return out


def indexed(trees: int, bits: int, seed: int, longest: dict[int, float]) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """One row per shard: ids, vectors, and per tree the sorted hash strings with the rows they belong to.

    Only the smallest id of a vector stands in the trees; `starts` leads from it to its other ids."""
    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["version", "nth"], kind="stable")
        starts = np.flatnonzero(rows["nth"].to_numpy() == 1)
        vectors = np.stack(rows["embedding"].iloc[starts].to_numpy()).astype(float)
        strings = hash_strings(lifted(vectors, longest[int(key[0])]), trees, bits, seed)
        order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        return pd.DataFrame({
            "dim": [key[0]], "shard": [key[1]], "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "starts": [starts.astype(np.int32).tobytes()],
            "vectors": [vectors.tobytes()], "strings": [np.take_along_axis(strings, order, axis=1).tobytes()], "order": [order.tobytes()]})
    return build


def gathered(strings: np.ndarray, order: np.ndarray, asked: np.ndarray, bits: int, wanted: int) -> list[np.ndarray]:
    """Per query the distinct rows met when all trees ascend level by level until at least `wanted` are found.

    Rows that share the first j bits with a query are one run of a tree's sorted strings: two binary searches.  The
    queries start at the longest prefix that could be enough (runs of all trees together) and go up one bit at a time."""
    trees, rows = strings.shape
    low, high = np.empty((2, bits + 1, trees, asked.shape[1]), np.int64)
    for level in range(bits + 1):
        rest = np.uint64((1 << (bits - level)) - 1)
        for tree in range(trees):
            first = asked[tree] & ~rest
            low[level, tree] = np.searchsorted(strings[tree], first)
            high[level, tree] = np.searchsorted(strings[tree], first | rest, side="right")
    enough = (high - low).sum(axis=1) >= wanted
    out = []
    for q in range(asked.shape[1]):
        level = bits - int(np.argmax(enough[::-1, q]))
        seen = np.zeros(rows, bool)
        while True:
            for tree in range(trees):
                seen[order[tree, low[level, tree, q]:high[level, tree, q]]] = True
            if level == 0 or int(seen.sum()) >= wanted:
                break
            level -= 1
        out.append(np.flatnonzero(seen))
    return out


def best_of(query: np.ndarray, vectors: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that can be among the k best by inner product, and their products: equal vectors get equal ones."""
    score = vectors[rows] @ query
    if len(rows) > k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        rows = rows[score >= floor - SLACK * max(1.0, np.abs(score).max())]
    return rows, (vectors[rows] * query).sum(axis=1)


def searched(k: int, trees: int, bits: int, seed: int, share: float) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def search(key: tuple, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [np.empty(0, np.int64)], "version": [np.empty(0, np.int64)], "vec_id": [np.empty(0, np.int64)], "score": [np.empty(0)]}
        if len(index) and len(queries):
            one = index.iloc[0]
            ids, starts = np.frombuffer(one["ids"], np.int64), np.frombuffer(one["starts"], np.int32)
            vectors = np.frombuffer(one["vectors"]).reshape(len(starts), -1)
            strings, order = np.frombuffer(one["strings"], np.uint64).reshape(trees, -1), np.frombuffer(one["order"], np.int32).reshape(trees, -1)
            ends = np.append(starts[1:], len(ids))
            wanted = min(len(starts), max(k + 1, int(np.ceil(share * len(starts)))))
            for at in range(0, len(queries), 128):
                part = queries.iloc[at:at + 128]
                x = np.stack(part["embedding"].to_numpy()).astype(float)
                asked = hash_strings(np.concatenate([unit_rows(x), np.zeros((len(x), 1))], axis=1), trees, bits, seed)
                for query, q, version, rows in zip(x, part["vec_id"].to_numpy(), part["version"].to_numpy(), gathered(strings, order, asked, bits, wanted)):
                    rows, score = best_of(query, vectors, rows, k + 1)
                    found = np.concatenate([ids[starts[r]:ends[r]] for r in rows])
                    score = np.repeat(score, ends[rows] - starts[rows])
                    found, score = found[found != q], score[found != q]
                    pick = np.lexsort((found, -score))[:k]
                    for name, values in (("query_id", np.full(len(pick), q)), ("version", np.full(len(pick), version)), ("vec_id", found[pick]), ("score", score[pick])):
                        out[name].append(values)
        return pd.DataFrame({c: np.concatenate(v) for c, v in out.items()}).assign(node=np.int64(key[1]))
    return search


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, trees: int = TREES, bits: int = BITS, share: float = SHARE,
            shard_rows: int = SHARD_ROWS, tile_rows: int = TILE_ROWS, fan_in: int = FAN_IN, seed: int = 42) -> DataFrame:
    """The k nearest found for every query: (query_id, rank, vec_id, score), score the inner product in doubles, ties to the smaller vec_id.

    vectors(vec_id, embedding).  Rows with a null id, a null, empty or zero vector, or null or non-finite components
    take no part.  Candidates are all rows but those of the query's own id; vectors of different lengths are not
    compared.  Identical rows count once; an id that comes with several vectors is a candidate with each and, as a query,
    gets one list per vector.  Other columns are ignored; an empty table gives no rows.

    The index covers every row: vectors are dealt by hash into shards of bounded size; a shard keeps, per tree, its hash strings
    in a sorted array.  A query descends to its longest common prefixes, then all trees ascend together until `share`
    of the shard's vectors are found; these are compared exactly.  Inner products are turned into angles by one more
    component.  Of equal vectors the trees hold one, and the shard keeps their k + 1 smallest ids, which are all that
    a list can show, so a vector that fills a third of the table is neither a full bucket nor a large group.

    A larger `share` or more trees raise recall and work; data without clusters need a large share (README has
    measured recalls).  A group is one shard's index and one tile of queries, and hands on k rows per query;
    lists merge in a tree of `fan_in` shards per node.
    """
    spark = vectors.sparkSession
    ship(spark)
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    fit = vectors.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.exists("embedding", lambda c: c != 0) & ~bad)
    rows = fit.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda c: c.cast("double") + F.lit(0.0)).alias("embedding"),
                      F.coalesce(is_query, F.lit(False)).alias("asked")).distinct()
    rows = materialize(rows.withColumn("version", F.xxhash64("embedding")).withColumn("dim", F.size("embedding")), "forest_rows")
    size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, c: s + c * c))
    facts = rows.groupBy("dim").agg(F.max(size).alias("longest"), F.count("*").alias("rows"), F.count(F.when(F.col("asked"), 1)).alias("asked")).collect()
    longest = {r["dim"]: r["longest"] for r in facts}
    shards = max([1, *(-(-r["rows"] // shard_rows) for r in facts)])
    tiles = max([1, *(-(-r["asked"] // tile_rows) for r in facts)])
    copies = Window.partitionBy("dim", "version", "embedding").orderBy("vec_id")
    kept = rows.withColumn("nth", F.row_number().over(copies)).filter(F.col("nth") <= k + 1).withColumn("shard", F.pmod("version", F.lit(shards)).cast("int"))
    index = materialize(kept.groupBy("dim", "shard").applyInPandas(
        indexed(trees, bits, seed, longest), "dim int, shard int, ids binary, starts binary, vectors binary, strings binary, order binary"), "forest_index")
    tile = F.pmod(F.xxhash64("vec_id", "version"), F.lit(tiles)).cast("int")
    queries = rows.filter("asked").select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), tile.alias("tile"), "vec_id", "version", "embedding")
    tiled = index.withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    lists = tiled.groupBy("dim", "shard", "tile").cogroup(queries.groupBy("dim", "shard", "tile")).applyInPandas(
        searched(k, trees, bits, seed, share), "query_id long, version long, vec_id long, score double, node long")
    nodes = shards
    while True:
        nodes = -(-nodes // fan_in)
        lists = lists.withColumn("node", F.floor(F.col("node") / fan_in))
        order = Window.partitionBy("query_id", "version", "node").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        if nodes <= 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, k=20)
