"""Readers and writers: rows made from the given tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...session import scratch_path
from ...sources import catalog as C
from ...sources import tables as T
from .base import query, sql

_BLANK, _BROKEN = "seq % 31 = 4", "seq % 37 = 5"


@query("read_catalog", sql(f"""SELECT CASE WHEN NOT ({_BLANK} OR {_BROKEN}) THEN item_id END AS item_id, CASE WHEN NOT ({_BLANK} OR {_BROKEN}) THEN title END AS title,
  CASE WHEN {_BLANK} THEN 'blank' WHEN {_BROKEN} THEN 'invalid_json' ELSE 'ok' END AS line_state FROM feed""", "feed"))
def read_catalog(spark, sf):
    """The feed as JSON lines, some of them blank or broken."""
    path = scratch_path(spark, "raw")
    good = F.to_json(F.struct("title", F.col("price").cast("string").alias("price"), "store", F.col("item_id").alias("parent_asin"), "features"))
    T.feed(spark, sf).select(F.when(F.expr(_BLANK), "  ").when(F.expr(_BROKEN), '{"title": ').otherwise(good).alias("value")).write.text(path)
    return C.read_catalog(spark, path).select("item_id", "title", "line_state")


@query("read_reviews", sql(f"SELECT item_id, text, helpful_vote FROM revs WHERE NOT ({_BROKEN}) AND NOT ({_BLANK})", "revs"))
def read_reviews(spark, sf):
    """Reviews as JSON lines; broken lines and lines without a product are ignored."""
    path = scratch_path(spark, "reviews")
    good = F.to_json(F.struct(F.when(~F.expr(_BLANK), F.col("item_id")).alias("parent_asin"), "text", "helpful_vote"))
    T.reviews(spark, sf).select(F.when(F.expr(_BROKEN), '{"text": "').otherwise(good).alias("value")).write.text(path)
    return C.read_reviews(spark, path).select("item_id", "text", "helpful_vote")


@query("write_catalog", sql("SELECT item_id, title, slot, price, is_deleted FROM items", "items"))
def write_catalog(spark, sf):
    path = scratch_path(spark, "store")
    C.write_catalog(T.items(spark, sf).select("item_id", "title", "slot", "price", "is_deleted"), path)
    return spark.read.parquet(path).select("item_id", "title", "slot", "price", "is_deleted")


@query("write_holdout", sql("SELECT item_id, title, slot, seq FROM items", "items"))
def write_holdout(spark, sf):
    path = scratch_path(spark, "holdout")
    C.write_holdout(T.items(spark, sf).select("item_id", "title", "slot", "seq"), path)
    return spark.read.schema("item_id string, title string, slot string, seq bigint").json(path)


@query("write_report", sql("""SELECT 'slots' AS part, slot AS name, count(*) AS n FROM items GROUP BY slot
  UNION ALL SELECT 'genders', gender, count(*) FROM items GROUP BY gender""", "items"))
def write_report(spark, sf):
    path = scratch_path(spark, "report")
    items = T.items(spark, sf)
    C.write_report({part: items.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")) for part, c in (("slots", "slot"), ("genders", "gender"))}, path)
    return spark.read.schema("part string, name string, n bigint").json(path)


@query("audit_csv_io", sql("""SELECT item_id, coalesce(title, '') AS title, slot AS derived_slot, gender AS derived_gender, age_group AS derived_age_group,
  coalesce(accessory_type, '') AS accessory_type, '' AS true_slot, '' AS true_gender, '' AS true_age_group FROM items""", "items"))
def audit_csv_io(spark, sf):
    path = scratch_path(spark, "audit")
    C.write_audit_csv(T.items(spark, sf), path)
    return C.read_audit_csv(spark, path).select(*[F.coalesce(c, F.lit("")).alias(c) for c in C.AUDIT_FIELDS])


@query("spotcheck_csv_io", sql("""SELECT gender || ' ' || slot AS query, seq::INTEGER AS rank, item_id, coalesce(title, '') AS title,
  CASE WHEN seq % 3 = 0 THEN 'relevant' ELSE '' END AS grade FROM items""", "items"))
def spotcheck_csv_io(spark, sf):
    """Written without grades, graded by hand for every third row, and safe from a second write."""
    path = scratch_path(spark, "spotcheck")
    rows = T.items(spark, sf).select(F.concat_ws(" ", "gender", "slot").alias("query"), F.col("seq").cast("int").alias("rank"), "item_id", "title")
    C.write_spotcheck_csv(rows, path + "/blank")
    graded = C.read_spotcheck_csv(spark, path + "/blank").withColumn("grade", F.when(F.col("rank") % 3 == 0, "relevant").otherwise(""))
    graded.write.option("header", True).option("escape", '"').csv(path + "/graded")
    C.write_spotcheck_csv(rows, path + "/graded")
    return C.read_spotcheck_csv(spark, path + "/graded").withColumns({c: F.coalesce(c, F.lit("")) for c in ("title", "grade")})


@query("append_parse_log", sql("SELECT DISTINCT query, 'rules-b' AS model, gender, max_price FROM parsed", "parsed"))
def append_parse_log(spark, sf):
    """Two models log every query; the later record counts."""
    path = scratch_path(spark, "parses")
    parses = T.queries(spark, sf).select("query", "gender", "max_price").distinct()
    for day, model in ((1, "rules-a"), (2, "rules-b")):
        C.append_parse_log(parses, path, model, F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp"))
    log = spark.read.schema("query string, model string, ts timestamp, parse string").json(path)
    return C.latest_parse_per_query(log).select("query", "model", F.get_json_object("parse", "$.gender").alias("gender"),
                                                F.get_json_object("parse", "$.max_price").cast("double").alias("max_price"))
