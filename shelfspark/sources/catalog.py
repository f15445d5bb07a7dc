"""Readers and writers: raw feeds, the catalog, quarantine, reports, audit files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


RAW_SCHEMA = (
    "main_category STRING, title STRING, average_rating DOUBLE, rating_number BIGINT, "
    "features ARRAY<STRING>, description STRING, price STRING, "
    "images ARRAY<STRUCT<thumb: STRING, large: STRING, variant: STRING, hi_res: STRING>>, "
    "videos ARRAY<STRING>, store STRING, categories ARRAY<STRING>, details MAP<STRING, STRING>, "
    "parent_asin STRING, asin STRING, bought_together STRING")
REVIEW_SCHEMA = "parent_asin STRING, text STRING, rating DOUBLE, helpful_vote BIGINT"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Raw records with a line state: `ok`, `blank` or `invalid_json`.

    Lines are read as text first, so blank and broken lines stay countable; nothing is dropped.
    """
    schema = RAW_SCHEMA + ", _corrupt_record STRING"
    lines = spark.read.text(path).withColumn("value", F.trim("value"))
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    state = (F.when(F.col("value") == "", "blank")
             .when(F.col("r._corrupt_record").isNotNull() | F.col("r").isNull(), "invalid_json").otherwise("ok"))
    rows = lines.withColumn("r", parsed).select("r.*", state.alias("line_state")).drop("_corrupt_record")
    return rows.withColumn("item_id", F.coalesce("parent_asin", "asin")).drop("parent_asin", "asin")


def read_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("line_state").agg(F.count(F.lit(1)).alias("n"))


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Reviews; malformed lines are ignored."""
    return spark.read.schema(REVIEW_SCHEMA).option("mode", "DROPMALFORMED").json(path).filter(
        "parent_asin is not null").withColumnRenamed("parent_asin", "item_id")


def write_catalog(products: DataFrame, path: str) -> None:
    """Create or replace the catalog: plain Parquet partitioned by slot, sorted by price inside files."""
    products.repartition("slot", "item_id").sortWithinPartitions("slot", "price").write.mode("overwrite").partitionBy("slot").parquet(path)


def scan_active(items: DataFrame) -> DataFrame:
    return items.filter(~F.col("is_deleted"))


# ------------------------------------------------------------------ quarantine
def latest_quarantine(records: DataFrame, item: str = "item_id", at: str = "created_at") -> DataFrame:
    """Last record per id (insert or replace); combines map-side, so hot ids cost nothing."""
    rest = [c for c in records.columns if c != item]
    last = records.groupBy(item).agg(F.max_by(F.struct(*rest), F.struct(at, F.to_json(F.struct(*rest)))).alias("_r"))
    return last.select(item, "_r.*")


def write_quarantine(records: DataFrame, table: str, log: str) -> None:
    """Append to the log, rewrite the latest-per-id table from the log, partitioned by status."""
    records.write.mode("append").json(log)
    history = records.sparkSession.read.schema(records.schema).json(log)
    latest_quarantine(history).write.mode("overwrite").partitionBy("status").parquet(table)


def count_quarantine(records: DataFrame, status: str | None = None) -> DataFrame:
    rows = records.filter(F.col("status") == status) if status else records
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------- files and logs
def write_holdout(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_report(parts: dict[str, DataFrame], path: str) -> None:
    """The parts of a report as JSON lines, each row with the name of its part; no part meets in one row or task."""
    report = None
    for name, df in parts.items():
        rows = df.select(F.lit(name).alias("part"), "*")
        report = rows if report is None else report.unionByName(rows, allowMissingColumns=True)
    report.write.mode("overwrite").json(path)


AUDIT_FIELDS = ["item_id", "title", "derived_slot", "derived_gender", "derived_age_group", "accessory_type",
                "true_slot", "true_gender", "true_age_group"]


def write_audit_csv(products: DataFrame, path: str) -> None:
    """Derived labels next to blank true labels, for people to fill."""
    blank = F.lit("")
    products.select(
        "item_id", "title", F.col("slot").alias("derived_slot"), F.col("gender").alias("derived_gender"),
        F.col("age_group").alias("derived_age_group"), F.coalesce("accessory_type", blank).alias("accessory_type"),
        blank.alias("true_slot"), blank.alias("true_gender"), blank.alias("true_age_group"),
    ).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_audit_csv(spark: SparkSession, path: str) -> DataFrame:
    ddl = ", ".join(f"{c} STRING" for c in AUDIT_FIELDS)
    return spark.read.schema(ddl).option("header", True).option("escape", '"').csv(path)


GRADE_FIELDS = "query STRING, rank INT, item_id STRING, title STRING, grade STRING"


def write_spotcheck_csv(results: DataFrame, path: str, force: bool = False) -> bool:
    """Top ranks with a blank grade.  Graded rows are never overwritten unless forced."""
    try:
        old = read_spotcheck_csv(results.sparkSession, path)
        graded = not old.filter(F.trim(F.coalesce("grade", F.lit(""))) != "").isEmpty()
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        graded = False
    if graded and not force:
        return False
    results.select("query", "rank", "item_id", "title", F.lit("").alias("grade")).write.mode("overwrite").option(
        "header", True).option("escape", '"').csv(path)
    return True


def read_spotcheck_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GRADE_FIELDS).option("header", True).option("escape", '"').csv(path)


def append_parse_log(parses: DataFrame, path: str, model: str, now: Column | None = None) -> None:
    """Append (query, model, ts, parse) records."""
    body = F.struct(*[c for c in parses.columns if c != "query"])
    parses.select("query", F.lit(model).alias("model"), (now if now is not None else F.current_timestamp()).alias("ts"),
                  F.to_json(body).alias("parse")).write.mode("append").json(path)


def latest_parse_per_query(log: DataFrame, model: str | None = None, query: str = "query", at: str = "ts",
                           tie: str | None = None) -> DataFrame:
    """Last parse of every query, optionally of one model; the winner is found map-side."""
    rows = log.filter(F.col("model") == model) if model else log
    rest = [c for c in rows.columns if c != query]
    order = F.struct(at, tie) if tie else F.col(at)
    return rows.groupBy(query).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(query, "_r.*")


