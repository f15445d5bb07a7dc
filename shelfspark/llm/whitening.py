"""Embedding whitening from a weighted multiplicity covariance: each distinct vector is fitted and whitened once, then joined back."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, ship
from .common import table

ROWS = 4096              # rows of a matrix product
FAN_IN = 256             # partial sums that meet in one group
HOT_SHARES = 1024        # a vector with more than this part of all rows is joined in shares
LARGEST = float(1 << 53)  # whole numbers beyond it do not fit a double
ZERO = 1e-12             # eigenvalues below this part of the largest are none: the data does not vary there


class Fit(NamedTuple):
    """Of one vector length: total weight, exact weighted sums, eigenvalues with variance (falling), their unit vectors, trace."""
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float


def whole(values: np.ndarray, factor: int, minus: list[int]) -> np.ndarray:
    """values * factor - minus, exactly: 64-bit integers where they suffice, else Python's."""
    bound = max(int(np.abs(values).max(initial=0)), 1) * factor + max((abs(v) for v in minus), default=0)
    if bound < 1 << 62:
        return values * np.int64(factor) - np.array(minus, np.int64)
    return values.astype(object) * factor - np.array(minus, object)


def sums_of(column: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A task's weighted sums per (length, dimension) of whole or real vectors, whole ones exactly."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for batch in batches:
            for dim, rows in batch.groupby("dim"):
                for at in range(0, len(rows), ROWS):
                    part = rows.iloc[at:at + ROWS]
                    x, w = np.stack(part[column].to_numpy()), part["weight"].to_numpy()
                    if x.dtype.kind == "i" and max(int(np.abs(x).max(initial=0)), 1) * int(w.sum()) >= 1 << 62:
                        x = x.astype(object)
                    total = (x * w[:, None]).sum(axis=0)
                    own = held.setdefault(int(dim), [0, [0] * len(total)])
                    own[0] += int(w.sum())
                    own[1] = [a + b for a, b in zip(own[1], total.tolist())]
        for dim, (n, total) in held.items():
            yield pd.DataFrame({"dim": dim, "pos": range(len(total)), "n": n, "total": [Decimal(v) if isinstance(v, int) else v for v in total]})
    return add


def products_of(column: str, means: dict[int, tuple[int, list]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A task's weighted products of centred vectors: one row per (length, matrix row)."""
    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, rows in batch.groupby("dim"):
                for at in range(0, len(rows), ROWS):
                    part = rows.iloc[at:at + ROWS]
                    z = centred(np.stack(part[column].to_numpy()), *means[int(dim)])
                    held[int(dim)] = held.get(int(dim), 0.0) + (z * part["weight"].to_numpy(float)[:, None]).T @ z
        part = TaskContext.get().partitionId()
        for dim, matrix in held.items():
            yield pd.DataFrame({"dim": dim, "row": range(len(matrix)), "part": part, "products": list(matrix)})
    return add


def centred(x: np.ndarray, n: int, sums: list) -> np.ndarray:
    """x - sums / n; of whole numbers the difference is exact before it is divided."""
    if x.dtype.kind == "i":
        return whole(x, n, sums).astype(float) / n
    return x - np.array(sums, float) / n


def added(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("part")
    return pd.DataFrame({"dim": [key[0]], "row": [key[1]], "part": [key[2]], "products": [np.stack(rows["products"].to_numpy()).sum(axis=0)]})


def weighted_covariance(rows: DataFrame, column: str) -> dict[int, tuple[int, list, np.ndarray]]:
    """Per vector length of rows(dim, weight, `column`): total weight, weighted sums and covariance (divisor: total weight).

    Vectors are centred before they are multiplied.  A task hands on d rows of d numbers per length d; they are summed
    in groups of bounded size, and the driver gets one matrix per length.
    """
    exact = dict(rows.dtypes)[column] == "array<bigint>"
    sums = rows.mapInPandas(sums_of(column), f"dim int, pos int, n long, total {'decimal(38,0)' if exact else 'double'}")
    found = sums.groupBy("dim", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toPandas().sort_values(["dim", "pos"])
    means = {int(dim): (int(own["n"].iloc[0]), [int(v) if exact else float(v) for v in own["total"]]) for dim, own in found.groupby("dim")}
    schema = "dim int, row int, part int, products array<double>"
    parts = rows.mapInPandas(products_of(column, means), schema)
    for fan in (FAN_IN, FAN_IN * FAN_IN):
        parts = parts.withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy("dim", "row", "part").applyInPandas(added, schema)
    lines = parts.toPandas().sort_values(["dim", "row", "part"])
    out = {}
    for dim, (n, total) in means.items():
        matrix = np.zeros((dim, dim))
        for row, values in zip(*(lines.loc[lines["dim"] == dim, c] for c in ("row", "products"))):
            matrix[row] += values
        out[dim] = n, total, (matrix + matrix.T) / (2 * n)
    return out


def principal(n: int, sums: list[int], covariance: np.ndarray, most: int) -> Fit:
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    some = int((values > ZERO * max(values[0], 0.0)).sum()) if len(values) else 0
    return Fit(n, sums, values[:some], vectors[:, :some], float(np.trace(covariance)), 0.0)


def whitener(fits: dict[int, Fit], most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def whiten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, rows in batch.groupby("dim"):
                fit = fits[int(dim)]
                x = np.stack(rows["x"].to_numpy())
                z = whole(x, fit.n, fit.sums)
                if z.dtype != object and dim * max(int(np.abs(z).max(initial=0)), 1) ** 2 >= 1 << 63:
                    z = z.astype(object)
                far = [v if v < 1 << 63 else None for v in (z * z).sum(axis=1).tolist()]
                shown = np.zeros((len(x), min(most, int(dim))))
                shown[:, :len(fit.values)] = (z.astype(float) / fit.n) @ (fit.vectors / np.sqrt(fit.values))
                yield rows.assign(deviation=pd.array(far, "Int64"), whitened=list(shown))
    return whiten


def whiten(vectors: DataFrame, scale: float = 64.0, most: int = 16, weights: str = "one") -> DataFrame:
    """Per row and component: (vec_id, component, n, deviation, whitened, explained, identity_error).

    vectors(vec_id, embedding); other columns are ignored.  Components c become whole numbers x = floor(scale * c) (at
    most 2^53 either way); a constant added to all x changes no result.  Rows with a null vector, null or non-finite
    components are dropped; a null vec_id and repeated rows stay, one result each.  Vectors of different lengths are fitted apart;
    empty ones have no components.  An empty table gives no rows.

    Identical x vectors are grouped; the fit weighs each group by one (`weights="one"`) or by its rows ("counts").  n is
    the total weight, S the weighted sums, both exact; the covariance has divisor n and is taken of centred vectors.
    Components are its unit eigenvectors by falling eigenvalue, up to `most`.  deviation is the exact sum of (n * x - S)^2, null
    where it exceeds a long.  whitened is (x - S / n) on the component over the root of its eigenvalue; along a component without
    variance every x - S / n is zero, and whitened and explained are 0.  identity_error is measured on the stored
    results: the largest entry of their covariance minus the identity, over components with variance.

    Each distinct vector is whitened once and joined back on x.  A vector with more than 1/1024 of the rows is joined
    in shares: at most 1,024 vectors can have that many, so their table is small whatever the input.
    """
    spark = vectors.sparkSession
    ship(spark)
    cell = lambda c: F.least(F.greatest(F.floor(c.cast("double") * F.lit(float(scale))), F.lit(-int(LARGEST))), F.lit(int(LARGEST))).cast("long")
    fit = vectors.filter(F.col("embedding").isNotNull() & ~F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))))
    rows = fit.filter(F.size("embedding") > 0).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", cell).alias("x"))
    distinct = materialize(rows.groupBy("x").agg(F.count("*").alias("copies")).withColumn("dim", F.size("x"))
                           .withColumn("weight", F.col("copies") if weights == "counts" else F.lit(1).cast("long")), "white_distinct")
    fits = {dim: principal(*found, most) for dim, found in weighted_covariance(distinct, "x").items()}
    white = materialize(distinct.mapInPandas(
        whitener(fits, most), "x array<long>, copies long, dim int, weight long, deviation long, whitened array<double>"), "white_vectors")
    for dim, fitted in fits.items():
        own = white.filter(F.col("dim") == dim).select(F.size("whitened").alias("dim"), "weight", "whitened")
        some, [(_, _, covariance)] = len(fitted.values), weighted_covariance(own, "whitened").values()
        fits[dim] = fitted._replace(error=float(np.abs(covariance[:some, :some] - np.eye(some)).max(initial=0.0)))
    facts = spark.createDataFrame([
        (dim, f.n, [float(v / f.trace) for v in f.values] + [0.0] * (min(most, dim) - len(f.values)), f.error) for dim, f in fits.items()],
        "dim int, n long, shares array<double>, identity_error double")
    share = max(1, (distinct.agg(F.sum("copies")).first()[0] or 0) // HOT_SHARES)
    shares = F.ceil(F.col("copies") / share).cast("int")
    hot = F.broadcast(distinct.filter(F.col("copies") > share).select("x", shares.alias("shares")))  # at most HOT_SHARES rows
    # drawn, not hashed from vec_id, as a hot row may repeat; stable in a retry, as rows come in the order of the scan
    dealt = rows.join(hot, "x", "left").select("vec_id", "x", F.coalesce((F.rand(7) * F.col("shares")).cast("int"), F.lit(0)).alias("share"))
    spread = white.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1)))
    joined = dealt.join(spread, ["x", "share"]).join(F.broadcast(facts), "dim")  # a row per vector length
    return joined.select("vec_id", "n", "deviation", "identity_error", "shares", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.col("shares")[F.col("at")].alias("explained"), "identity_error")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed 1,000,000 that the contract adds to x cancels in every column: n, deviation and the centred values do not see it."""
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), scale=64.0, most=16)
