"""Embedding near-dedup: spherical k-means cells, blocked cosine products within cells, one vector per group kept."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, ship
from .common import components, forest, table

SAMPLE = 20_000  # most vectors that the centroids are fitted on
BLOCK = 4096     # most rows of a block of a cell, on average
MOST_CELLS = 4096


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision; scaling by the largest component first avoids overflow."""
    rows = np.asarray(rows, float)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def spherical_kmeans(rows: np.ndarray, cells: int, rounds: int = 10, seed: int = 42) -> np.ndarray:
    """Unit centroids; an empty cell keeps its last centroid."""
    cells = min(cells, len(rows))
    centers = rows[np.random.default_rng(seed).choice(len(rows), cells, replace=False)]
    for _ in range(rounds):
        home = np.concatenate([(rows[i:i + 4096] @ centers.T).argmax(axis=1) for i in range(0, len(rows), 4096)])
        sums = np.zeros_like(centers)
        np.add.at(sums, home, rows)
        size = np.linalg.norm(sums, axis=1)
        centers = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centers)
    return centers


def fitted_cells(rows: np.ndarray, cells: int, reach: float) -> np.ndarray:
    """Centroids of `cells` cells.  Of centroids nearer to each other than two linked vectors may be, twice the reach, the first
    stays: between the others nearly every vector would be in both cells, so a clump of near copies is not cut."""
    centers = spherical_kmeans(rows, cells)
    kept: list[int] = []
    for i, c in enumerate(centers):
        if not kept or (2 - 2 * centers[kept] @ c).min() > (2 * reach) ** 2:
            kept.append(i)
    return centers[kept]


def cells_of(centers: np.ndarray, reach: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """For each vector: its home cell and the cells whose border with the home cell is at most `reach` away."""
    gaps = np.sqrt(np.maximum(2 - 2 * centers @ centers.T, 0))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at:at + 1024]
                near = unit(np.stack(part["embedding"].to_numpy())) @ centers.T
                home = near.argmax(axis=1)
                top = near[np.arange(len(near)), home]
                border = (top[:, None] - near) <= reach * gaps[home] + 1e-9
                border[np.arange(len(near)), home] = False
                yield part.assign(home=home.astype(np.int32), others=[np.flatnonzero(b).astype(np.int32) for b in border])
    return assign


def block_links(threshold: float) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Links of a block of vectors at home in a cell with another such block, itself or a block of visitors: per vector the
    weight of its partners, and a spanning star of the links.

    Two vectors that visit each other meet in both home cells; they count in the smaller.
    """
    def sides(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
        return (rows["rep"].to_numpy(), rows["copies"].to_numpy(), unit(np.stack(rows["embedding"].to_numpy())))

    def visits(others: np.ndarray, homes: np.ndarray) -> np.ndarray:
        """Whether each row is also sent to each of the given cells."""
        width = max([int(homes.max(initial=0)), *(int(o[-1]) for o in others if len(o))]) + 1
        sent = np.zeros((len(others), width), bool)
        for i, o in enumerate(others):
            sent[i, o] = True
        return sent[:, homes]

    def links(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cell, one, two = key[1], key[2], key[3]
        a, b = rows[rows["block"] == one], rows[rows["block"] == two]
        out = pd.DataFrame({"rep": np.empty(0, np.int64), "links": np.empty(0, np.int64), "root": np.empty(0, np.int64)})
        if not len(a) or not len(b):
            return out
        ra, na, xa = sides(a)
        rb, nb, xb = (ra, na, xa) if one == two else sides(b)
        slack = 1e-5 + 2e-7 * xa.shape[1]  # single precision finds the rows to compare, double precision decides
        fa, fb = xa.astype(np.float32), xb.astype(np.float32).T
        close = np.concatenate([fa[i:i + 512] @ fb >= threshold - slack for i in range(0, len(fa), 512)])
        if one == two:
            np.fill_diagonal(close, False)
        i, j = close.any(axis=1), close.any(axis=0)
        ra, na, xa, rb, nb, xb = ra[i], na[i], xa[i], rb[j], nb[j], xb[j]
        linked = (xa @ xb.T >= threshold) & (ra[:, None] != rb[None, :])
        homes = b["home"].to_numpy()[j]
        if len(ra) and (homes != cell).any():
            linked &= ~((homes[None, :] < cell) & visits(a["others"].to_numpy()[i], homes))
        ids, roots = forest(linked, ra, rb)
        if not len(ids):
            return out
        weight = pd.Series(linked @ nb, index=ra)
        if one != two:
            weight = pd.concat([weight, pd.Series(linked.T @ na, index=rb)])
        # within one block a group can come twice, once from either side, with the same members
        return pd.DataFrame({"rep": ids, "links": weight.groupby(level=0).sum().reindex(ids, fill_value=0).to_numpy(), "root": roots}).drop_duplicates("rep")
    return links


def in_cells(reps: DataFrame, threshold: float, sample: int = SAMPLE, cells: int | None = None) -> DataFrame | None:
    """reps(embedding, rep, copies, dim) with `home`, the cell of the nearest centroid, and `others`, the cells that a vector
    visits; None without rows.  Centroids are fitted per vector length, for as many cells as the root of the number of vectors, unless `cells` is given."""
    found = None
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) / 2
    for dim, count in [(r[0], r[1]) for r in reps.groupBy("dim").count().collect()]:
        own = reps.filter(F.col("dim") == dim)
        drawn = own.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(sample).toPandas()
        rows = unit(np.stack(drawn["embedding"].to_numpy()))
        centers = fitted_cells(rows, cells or min(MOST_CELLS, max(2, round(math.sqrt(count)))), reach)
        homes = own.mapInPandas(cells_of(centers, reach), "embedding array<float>, rep long, copies long, dim int, home int, others array<int>")
        found = homes if found is None else found.unionByName(homes)
    return found


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, sample: int = SAMPLE, block: int = BLOCK,
                    cells: int | None = None) -> DataFrame:
    """Per vec_id: n_links (other vectors with cosine >= threshold), component_id (smallest vec_id reachable), kept.

    vectors(vec_id, embedding).  Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing; vectors of different lengths do not link.  Rows of one vec_id are one vector (the smallest in array
    order); a null vec_id gives one row without links and a null component.  Other columns are ignored.

    The centroids are fitted on at most `sample` distinct vectors (those with the smallest hashes); every vector is
    assigned.  Two unit vectors with cosine c lie sqrt(2 - 2c) apart, so of two linked vectors with different homes at
    least one lies within half of that of the plane between the two centroids: sending each vector also to the cells
    whose border is that near finds every link (recall 1; tests compare with brute force).  In a cell the vectors at home
    meet each other and the visitors; visitors do not meet.  Exact copies are one weighted vector.  Both sorts are cut into
    blocks of bounded size and every pair of blocks is one group, which emits at most one row per vector.
    """
    spark = vectors.sparkSession
    ship(spark)
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    some = F.exists("embedding", lambda x: x != 0)
    every = materialize(vectors.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("embedding")), "near_rows")
    fit = every.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad & some)
    reps = materialize(fit.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("embedding")), "near_reps")
    found = in_cells(reps, threshold, sample, cells)
    if found is None:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    placed = materialize(found, "near_cells")
    sent = placed.select("*", F.posexplode(F.concat(F.array("home"), "others")).alias("nth", "cell")).withColumn("visitor", F.col("nth") > 0)
    blocks = lambda rows: F.ceil(F.count_if(rows) / block).cast("int")
    sizes = sent.groupBy("dim", "cell").agg(blocks(~F.col("visitor")).alias("own"), blocks(F.col("visitor")).alias("guests")).filter("own > 0")
    # blocks 0 to own - 1 are at home, those from own on visit; a visitor meets the blocks at home, these meet all
    dealt = sent.join(F.broadcast(sizes), ["dim", "cell"]).withColumn(  # one row per cell: MOST_CELLS per length
        "block", F.when(F.col("visitor"), F.col("own") + F.pmod(F.xxhash64("rep"), F.greatest("guests", F.lit(1)))).otherwise(F.pmod(F.xxhash64("rep"), "own")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("visitor"), F.col("own")).otherwise(F.col("own") + F.col("guests")) - 1))).select(
        "dim", "cell", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "rep", "copies", "home",
        F.when(~F.col("visitor"), F.col("others")).alias("others"), "embedding")
    links = materialize(paired.groupBy("dim", "cell", "one", "two").applyInPandas(block_links(threshold), "rep long, links long, root long"), "near_links")
    groups = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")), "near_components")
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    known = (reps.join(counts, "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
             .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    linked = fit.join(known, "embedding").select("vec_id", "n_links", "component_id")
    alone = every.filter(~F.coalesce(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad & some, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


ORACLE = """
WITH RECURSIVE fit AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT r.a AS vec_id, (SELECT count(*) FROM links l WHERE l.a = r.a) AS n_links, min(r.b) AS component_id, min(r.b) = r.a AS kept
FROM reach r GROUP BY r.a
"""
