"""Helpers shared by the training-data operators: connected components, link forests, tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, **own: Column) -> DataFrame:
    """Each row of docs as one struct `row`, beside own columns, which so cannot clash with the input's names."""
    return docs.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in own.items()])


def free_name(taken: list[str], name: str) -> str:
    """`name`, longer where it is taken."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (id, component), component the smallest id reachable.

    Only ids that occur in an edge to another id are returned; edges with a null end are ignored.
    Rounds of large-star and small-star steps; every round is a few grouped minima and joins on the
    edge table, which is written to the shared folder and never held in one place.  A node with very
    many neighbours only makes one side of a join skewed, which adaptive execution splits.
    """
    step = materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    while True:
        state = step.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(state) == seen:
            return step.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
                step.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        seen = tuple(state)
        low = step.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        jumped = step.join(low, "b", "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        lower = jumped.groupBy("a").agg(F.min("b").alias("m"))
        pairs = jumped.join(lower, "a").select(F.explode(F.array(
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        step = materialize(pairs.select("e.a", "e.b").filter("a <> b").distinct(), name)


def forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of a bipartite link matrix: (id, smallest id of its part of the block).

    Keeps connectivity with at most one row per id, however dense the block is.
    """
    rows, cols = linked.any(axis=1), linked.any(axis=0)
    ids, roots = [], []
    for i in np.flatnonzero(rows):
        if not rows[i]:
            continue
        mine, theirs = np.zeros(len(rows), bool), np.zeros(len(cols), bool)
        grow = np.array([i])
        mine[i] = True
        while True:
            new = linked[grow].any(axis=0) & ~theirs
            theirs |= new
            reach = np.flatnonzero(new)
            if not len(reach):
                break
            back = linked[:, reach].any(axis=1) & ~mine
            mine |= back
            grow = np.flatnonzero(back)
            if not len(grow):
                break
        rows &= ~mine
        member = np.unique(np.concatenate([left[mine], right[theirs]]))
        ids.append(member)
        roots.append(np.full(len(member), member[0]))
    if not ids:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(ids), np.concatenate(roots)
