"""Deterministic samples: the order is a seeded hash, so results do not depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R

BUCKET_BITS = 12  # 4096 hash buckets at each of two levels: the histograms are small whatever the table size


def seeded(key: str, seed: int) -> Column:
    """60 bits of the MD5 of seed and key: the same order on every engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")


def flag_smallest(df: DataFrame, key: str, seed: int, how_many: Column, flag: str = "selected") -> DataFrame:
    """Flag exactly `how_many` rows with the smallest (hash, key); no global sort.  Null keys come last.

    A histogram of the top hash bits tells which bucket holds the cut, one of the next bits which part of that
    bucket; only the rows of that part, one in 16 million, are ranked.  `how_many` may use the column `total`.
    """
    h = df.withColumn("_h", F.coalesce(seeded(key, seed), F.lit((1 << 60) - 1))).withColumn(
        "_b", F.shiftright("_h", 60 - BUCKET_BITS).cast("int")).withColumn(
        "_c", F.shiftright("_h", 60 - 2 * BUCKET_BITS).bitwiseAND((1 << BUCKET_BITS) - 1).cast("int"))

    def cut(rows: DataFrame, column: str, want: int) -> tuple[int, int]:
        """The bucket in which the want-th row lies, and how many of its rows are wanted."""
        for bucket, n in sorted(tuple(r) for r in rows.groupBy(column).count().collect()):  # at most 4096 rows
            if want <= n:
                return bucket, want
            want -= n
        return 1 << BUCKET_BITS, 0
    want = h.agg(F.count(F.lit(1)).alias("total")).select(how_many.cast("bigint")).first()[0]
    bucket, want = cut(h, "_b", want)
    inside = F.col("_b") == bucket
    part, want = cut(h.filter(inside), "_c", want)
    last = inside & (F.col("_c") == part)
    sure = h.filter(~last).withColumn(flag, (F.col("_b") < bucket) | inside & (F.col("_c") < part))
    ranked = h.filter(last).withColumn("_i", F.row_number().over(Window.partitionBy("_b", "_c").orderBy("_h", key))).withColumn(flag, F.col("_i") <= want)
    return sure.unionByName(ranked.drop("_i")).drop("_h", "_b", "_c")


def fixed_sample(df: DataFrame, n: int = R.SAMPLE_SIZE, key: str = "item_id", seed: int = R.SEED) -> DataFrame:
    """A uniform sample of exactly n rows (all rows when there are fewer)."""
    return flag_smallest(df, key, seed, F.lit(n)).filter("selected").drop("selected")


def holdout_split(df: DataFrame, fraction: float = R.HOLDOUT_FRACTION, key: str = "item_id",
                  seed: int = R.SEED) -> DataFrame:
    """Flag floor(rows x fraction) rows as held out."""
    return flag_smallest(df, key, seed + 1, F.floor(F.col("total") * fraction), "held_out")


def stratified_sample(df: DataFrame, quota: dict[str, int] | None = None, by: str = "slot",
                      key: str = "item_id", seed: int = R.SEED) -> DataFrame:
    """Up to quota[stratum] rows per stratum."""
    quota = quota or R.AUDIT_QUOTA
    table = F.create_map(*[x for k, v in quota.items() for x in (F.lit(k), F.lit(v))])
    w = Window.partitionBy(by).orderBy(seeded(key, seed), key)
    ranked = df.filter(F.col(by).isin(list(quota))).withColumn("_i", F.row_number().over(w))
    # the constant bound lets every task drop rows before the shuffle
    return ranked.filter(F.col("_i") <= max(quota.values())).filter(
        F.col("_i") <= F.try_element_at(table, F.col(by))).drop("_i")


def random_rows(df: DataFrame, n: int, where: Column | None = None, key: str = "item_id",
                seed: int = R.SEED) -> DataFrame:
    """n random rows that meet a predicate."""
    return fixed_sample(df.filter(where) if where is not None else df, n, key, seed)
