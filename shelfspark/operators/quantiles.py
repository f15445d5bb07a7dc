"""Exact percentiles that never gather a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

CELLS = 256  # ranges of the pool


def exact_percentiles(df: DataFrame, groups: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per group with linearly interpolated percentiles named by `probs`, and `n`; null values do not count.

    Equal values are counted before anything moves.  The counted values are dealt into ranges of (group, value) and written
    once; sums per group and range tell which ranges hold the two ranks that each percentile needs, and only those are
    read again and sorted.  A group of any size spreads over the ranges, and the result equals the textbook definition.
    """
    spark = df.sparkSession
    group = F.struct(*groups) if groups else F.struct(F.lit(True).alias("all"))  # a struct, so null groups join and no name clashes
    counted = df.select(group.alias("g"), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL").groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(counted.repartitionByRange(ranges, "g", "v").withColumn("part", F.spark_partition_id()), "percentile_ranges")

    def ends(p: float) -> tuple[Column, Column, Column]:
        at = (F.col("n") - 1) * F.lit(float(p))
        return at, F.floor(at).cast("long"), F.ceil(at).cast("long")

    def held(ranks: Column, start: Column, end: Column) -> Column:
        return F.filter(ranks, lambda i: (i >= start) & (i < end))
    per_group = Window.partitionBy("g")
    before = F.coalesce(F.sum("m").over(per_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spread = dealt.groupBy("part", "g").agg(F.sum("c").alias("m")).withColumn("before", before).withColumn("n", F.sum("m").over(per_group))
    wanted = F.array_distinct(F.array(*[end for p in probs.values() for end in ends(p)[1:]]))
    located = spread.withColumn("ranks", held(wanted, F.col("before"), F.col("before") + F.col("m"))).filter(F.size("ranks") > 0).drop("m")
    upto = Window.partitionBy("part", "g").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = dealt.join(located, ["part", "g"]).withColumn("end", F.col("before") + F.sum("c").over(upto))
    picked = inside.select("g", "n", "v", F.explode(held(F.col("ranks"), F.col("end") - F.col("c"), F.col("end"))).alias("rank"))
    found = picked.groupBy("g", "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))  # two entries per percentile

    def percentile(p: float) -> Column:
        at, low, high = ends(p)
        below = F.element_at("at", low)
        return below + (F.element_at("at", high) - below) * (at - low)
    return found.select(*([F.col("g")[c].alias(c) for c in groups]), "n", *[percentile(p).alias(name) for name, p in probs.items()])


def count_at_least(probes: DataFrame, pool: DataFrame, score: str, out: str = "n_at_least") -> DataFrame:
    """For every probe row, how many pool rows score at least as much.

    A nested-loop join would emit every pair.  Instead the pool is counted per distinct score,
    cut into ranges by quantiles, and each probe adds the counts of the higher ranges to a
    running count inside its own range.
    """
    counted = pool.groupBy(F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_c"))
    marks = F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)])
    edges = counted.agg(F.array_distinct(F.percentile_approx("_s", marks, 4 * CELLS)).alias("e")).select("e").scalar()
    edges = F.coalesce(edges, F.array().cast("array<double>"))

    def with_cell(df: DataFrame) -> DataFrame:
        return df.withColumn("_e", edges).withColumn(
            "_cell", F.size(F.filter("_e", lambda e: e < F.col("_s")))).drop("_e")

    placed = with_cell(counted)
    totals = placed.groupBy("_cell").agg(F.sum("_c").alias("_m"))  # at most CELLS rows
    slots = probes.sparkSession.range(CELLS + 1).select(F.col("id").cast("int").alias("_cell"))
    above = Window.orderBy(F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    higher = slots.join(totals, "_cell", "left").select(
        "_cell", F.coalesce(F.sum(F.coalesce("_m", F.lit(0))).over(above), F.lit(0)).alias("_higher"))
    events = placed.select("_cell", "_s", "_c", F.lit(None).cast("bigint").alias("_k")).unionByName(
        with_cell(probes.select(F.col(score).alias("_s")).distinct()).select(
            "_cell", "_s", F.lit(0).cast("bigint").alias("_c"), F.lit(1).cast("bigint").alias("_k")))
    w = Window.partitionBy("_cell").orderBy(F.col("_s").desc())  # range frame: ties count
    running = events.withColumn("_in", F.sum("_c").over(w)).filter("_k = 1")
    answer = running.join(F.broadcast(higher), "_cell").select(
        F.col("_s").alias(score), (F.col("_higher") + F.col("_in")).alias(out))
    return probes.join(answer, score, "left")
