"""Operational metrics of a request log: batch figures and streaming windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import rules as R
from ..functions.exprs import tidy
from ..plans.reports import pct


def latest_requests(log: DataFrame, *, endpoint: str = "endpoint", at: str = "ts", tie: str = "request_id", window: int = R.METRICS_WINDOW) -> DataFrame:
    """The last `window` requests per endpoint.  The rank filter keeps that many rows per endpoint in every task before the
    shuffle, so a hot endpoint is cut down where its rows lie."""
    w = Window.partitionBy(endpoint).orderBy(F.col(at).desc(), F.col(tie).desc())
    return log.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= window).drop("_i")


def rolling_metrics(log: DataFrame, *, endpoint: str = "endpoint", at: str = "ts", latency: str = "latency_ms",
                    tie: str = "request_id", window: int = R.METRICS_WINDOW) -> DataFrame:
    """p50 / p95 / p99 / mean of the last `window` requests per endpoint; the exact percentile only ever sees that many values."""
    return latest_requests(log, endpoint=endpoint, at=at, tie=tie, window=window).groupBy(endpoint).agg(
        F.count(F.lit(1)).alias("n"),
        *[tidy(F.percentile(latency, F.lit(p)), 2).alias(name) for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))],
        F.round(F.avg(latency), 6).alias("mean"))


def advance_metrics(batch: DataFrame, batch_id: int, folder: str, *, endpoint: str = "endpoint", at: str = "ts", latency: str = "latency_ms",
                    tie: str = "request_id", window: int = R.METRICS_WINDOW) -> None:
    """Take one micro-batch into the last requests kept in `folder`, and write the figures after it.

    The last requests of old and new rows together are the last of all, in whatever order rows arrive, so `window` rows per
    endpoint are all the state there is.  Two slots take turns: a batch reads the one before and overwrites the other,
    so a batch that is repeated after a failure starts from the same rows and gives the same figures.
    """
    names = {"endpoint": endpoint, "at": at, "tie": tie}
    rows = batch.select(endpoint, at, tie, latency)
    schema = rows.schema
    if batch_id:
        rows = rows.unionByName(batch.sparkSession.read.schema(schema).parquet(f"{folder}/slot-{(batch_id - 1) % 2}"))
    slot = f"{folder}/slot-{batch_id % 2}"
    latest_requests(rows, window=window, **names).write.mode("overwrite").parquet(slot)
    figures = rolling_metrics(batch.sparkSession.read.schema(schema).parquet(slot), latency=latency, window=window, **names)
    figures.write.mode("overwrite").parquet(f"{folder}/figures/batch_id={batch_id}")


def last_requests_stream(log: DataFrame, folder: str, **names) -> StreamingQuery:
    """`rolling_metrics` of a stream that drains what waits and may be started again: figures after every micro-batch.

    `folder` is a shared one and belongs to this stream; it holds its checkpoint too.  Options as for `advance_metrics`.
    """
    return log.writeStream.foreachBatch(lambda batch, batch_id: advance_metrics(batch, batch_id, folder, **names)).option(
        "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def current_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The figures after the last micro-batch."""
    figures = spark.read.parquet(f"{folder}/figures")
    last = figures.select(F.max("batch_id").alias("last")).scalar()
    return figures.filter(F.col("batch_id") == last).drop("batch_id")


def rolling_metrics_stream(log: DataFrame, *, endpoint: str = "endpoint", at: str = "ts", latency: str = "latency_ms",
                           length: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """The same figures per sliding event-time window, in append mode behind a watermark."""
    timed = log.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, length, slide), endpoint).agg(
        F.count(F.lit(1)).alias("n"),
        *[tidy(F.percentile(latency, F.lit(p)), 2).alias(name) for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


def ops_counters(log: DataFrame, by: tuple[str, ...] = ("endpoint", "status")) -> DataFrame:
    """Requests per endpoint and status; works on batches and on streams (update mode)."""
    return log.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def warning_counts(log: DataFrame) -> DataFrame:
    return log.select(F.explode("warnings").alias("warning")).groupBy("warning").agg(F.count(F.lit(1)).alias("n"))


def ingest_rejects(results: DataFrame) -> DataFrame:
    return results.filter(F.col("status") == "rejected").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def ops_rates(log: DataFrame, by: str = "endpoint") -> DataFrame:
    """Fallback, zero-result, low-confidence and filter rates, and mean latency."""
    n = F.count(F.lit(1))
    return log.groupBy(by).agg(
        n.alias("n"), pct(F.count_if("used_fallback"), n).alias("fallback_pct"),
        pct(F.count_if(F.col("result_count") == 0), n).alias("zero_result_pct"),
        pct(F.count_if("low_confidence"), n).alias("low_confidence_pct"),
        pct(F.sum("filtered_count"), F.sum("pool_size")).alias("filter_pct"),
        F.round(F.avg("latency_ms"), 6).alias("mean_latency"))
