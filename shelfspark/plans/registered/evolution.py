"""Catalog change: upsert, delete, triage, integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import encoders
from ...operators import evolution as V
from ...session import scratch_path
from ...sources import tables as T
from ...streaming import ingest as I
from ...streaming import metrics as M
from ...streaming.ingest import first_per_id
from .base import cte, item_ctes, query, sql, sql_tokens
from .catalog import triaged

cte("upd", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY seq) AS r FROM batch WHERE item_id <> '') WHERE r = 1""", "batch")


def catalog(spark, sf):
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return T.feed(spark, sf).select("item_id", "title", "price", "version", stamp.alias("created_at"), stamp.alias("updated_at"), "is_deleted")


def first_updates(spark, sf):
    return first_per_id(T.update_batch(spark, sf).filter("item_id <> ''"))


@query("upsert_catalog", sql("""SELECT item_id, CASE WHEN u.seq IS NOT NULL THEN u.title ELSE f.title END AS title, CASE WHEN u.seq IS NOT NULL THEN u.price ELSE f.price END AS price,
  CASE WHEN u.seq IS NOT NULL THEN coalesce(f.version + 1, 1) ELSE f.version END AS version, f.item_id IS NULL AS is_new, CASE WHEN u.seq IS NOT NULL THEN false ELSE f.is_deleted END AS is_deleted
  FROM (SELECT item_id, title, price, version, is_deleted FROM feed) f FULL OUTER JOIN upd u USING (item_id)""", "feed", "upd"))
def upsert_catalog(spark, sf):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    out = V.upsert_catalog(catalog(spark, sf), first_updates(spark, sf).select("item_id", "title", "price"), now)
    return out.select("item_id", "title", "price", "version", (F.col("created_at") == now).alias("is_new"), "is_deleted")


def delete_list(spark, sf):
    return T.table(spark, sf, "customer").select(F.concat(F.lit("P"), F.lpad((F.col("c_custkey") * 3).cast("string"), 8, "0")).alias("item_id"))


cte("dels", "SELECT DISTINCT printf('P%08d', c_custkey * 3) AS item_id FROM customer")


@query("soft_delete", sql("""SELECT d.item_id, CASE WHEN f.item_id IS NULL THEN 'not_found' WHEN f.is_deleted THEN 'already_deleted' ELSE 'deleted' END AS status
  FROM dels d LEFT JOIN feed f USING (item_id)""", "dels", "feed"))
def soft_delete(spark, sf):
    return V.delete_statuses(catalog(spark, sf), delete_list(spark, sf))


@query("soft_delete_rows", sql("SELECT item_id, is_deleted OR item_id IN (SELECT item_id FROM dels) AS is_deleted FROM feed", "dels", "feed"))
def soft_delete_rows(spark, sf):
    return V.soft_delete(catalog(spark, sf), delete_list(spark, sf)).select("item_id", "is_deleted")


@query("apply_triage", sql("""SELECT f.item_id, CASE WHEN t.status = 'accepted' THEN t.clean_title ELSE f.title END AS title, CASE WHEN t.status = 'accepted' THEN t.tslot ELSE f.slot END AS slot,
  CASE WHEN t.status = 'accepted' THEN t.acc ELSE f.accessory_type END AS accessory_type, CASE WHEN t.status = 'accepted' THEN t.tq ELSE 0.0 END::DOUBLE AS quality_qc, t.status <> 'accepted' AS is_deleted
  FROM items f JOIN triaged t USING (item_id)""", "items", "triaged"))
def apply_triage(spark, sf):
    stored = T.items(spark, sf).select("item_id", "title", "slot", "accessory_type", F.lit(0.0).alias("quality_qc"), "is_deleted")
    return V.apply_triage(stored, triaged(spark, sf))


@query("index_integrity", sql("""SELECT count(a) AS n_active, count(b) AS n_indexed, count(*) FILTER (b IS NULL) AS missing_in_index, count(*) FILTER (a IS NULL) AS orphans_in_index,
  count(*) FILTER (a IS NULL OR b IS NULL) = 0 AS consistent FROM (SELECT item_id, 1 AS a FROM feed WHERE NOT is_deleted) FULL OUTER JOIN
  (SELECT DISTINCT item_id, 1 AS b FROM revs WHERE item_id IN (SELECT item_id FROM feed)) USING (item_id)""", "feed", "revs"))
def index_integrity(spark, sf):
    indexed = T.reviews(spark, sf).select("item_id").join(T.feed(spark, sf).select("item_id"), "item_id", "left_semi")
    return V.index_integrity(catalog(spark, sf).filter("not is_deleted"), indexed)


@query("ingest_rejects", sql("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN item_id IS NULL THEN 'no_parent_asin' WHEN rn > 1 THEN 'duplicate_in_batch'
  WHEN title IS NULL THEN 'no_title' WHEN length(title) < 15 THEN 'short_title' WHEN regexp_matches(title, '\\b(?:plush|toys?)\\b', 'i') THEN 'non_fashion_keyword'
  WHEN price IS NULL THEN 'no_price' WHEN price <= 0 THEN 'invalid_price' END AS reason FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY seq) AS rn FROM
  (SELECT seq, nullif(item_id, '') AS item_id, title, price FROM batch))) WHERE reason IS NOT NULL GROUP BY reason""", "batch"))
def ingest_rejects(spark, sf):
    from ...operators.validate import validate_batch

    return M.ingest_rejects(validate_batch(T.update_batch(spark, sf), T.feed(spark, sf).select("item_id", "version")))


# ------------------------------------------------------------ the feed as a stream of three batches
cte("sbatch", r"""SELECT *, seq % 3 AS b FROM (SELECT *, row_number() OVER (PARTITION BY seq % 3, item_id ORDER BY seq) AS rn FROM batch WHERE item_id <> '') WHERE rn = 1
  AND title IS NOT NULL AND length(title) >= 15 AND NOT regexp_matches(title, '\b(?:plush|toys?)\b', 'i') AND price > 0""", "batch")
cte("slast", "SELECT item_id, arg_max(seq, b) AS seq, arg_max(title, b) AS title, arg_max(price, b) AS price, count(*) AS n FROM sbatch GROUP BY item_id", "sbatch")
cte("sfeed", """SELECT coalesce(l.seq, f.seq) AS seq, item_id, CASE WHEN l.n > 0 THEN l.title ELSE f.title END AS title, CASE WHEN l.n > 0 THEN NULL ELSE f.store END AS store,
  CASE WHEN l.n > 0 THEN round(l.price, 2) ELSE f.price END AS price, CASE WHEN l.n > 0 THEN NULL ELSE f.average_rating END AS average_rating,
  CASE WHEN l.n > 0 THEN NULL ELSE f.rating_number END AS rating_number, CASE WHEN l.n > 0 THEN '' ELSE f.feature_text END AS feature_text,
  CASE WHEN l.n > 0 THEN NULL ELSE f.description END AS description, CASE WHEN l.n > 0 THEN NULL ELSE f.department END AS department,
  CASE WHEN l.n > 0 THEN false ELSE f.is_deleted END AS is_deleted, coalesce(f.version, 0) + coalesce(l.n, 0) AS version FROM feed f FULL OUTER JOIN slast l USING (item_id)""", "feed", "slast")
item_ctes("s", "sfeed")
cte("stok", f"SELECT item_id, {sql_tokens('search_text')} AS tk FROM sitems WHERE NOT is_deleted", "sitems")


def streamed(spark, sf):
    """The catalog after the update feed came in as three files, each drained by the stream."""
    root = scratch_path(spark, "live")
    store = I.LiveCatalog(spark, f"{root}/catalog", I.bucket_count(T.items(spark, sf).count()), lambda rows: encoders.hash_encoder(rows.select("item_id", "search_text")))
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp")
    start = T.items(spark, sf).withColumn("image_url", F.lit(None).cast("string"))
    store.create(start.select(*I.CATALOG_COLUMNS, F.col("version").cast("long").alias("version"), stamp.alias("created_at"), stamp.alias("updated_at"), "is_deleted"))
    feed = T.update_batch(spark, sf).withColumns({c: F.lit(None).cast(kind) for c, kind in (
        ("store", "string"), ("average_rating", "double"), ("rating_number", "bigint"), ("features", "array<string>"), ("description", "string"))})
    for part in range(3):
        feed.filter(F.col("seq") % 3 == part).write.mode("append").parquet(f"{root}/feed")
        waiting = spark.readStream.schema(feed.schema).parquet(f"{root}/feed")
        I.stream_ingest(waiting, store, f"{root}/checkpoint").awaitTermination()
    return store


def live(spark, sf):
    """One streamed catalog for the queries below: name -> table."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _LIVE:
        _LIVE[key] = streamed(spark, sf)
    return _LIVE[key]


_LIVE: dict[tuple, I.LiveCatalog] = {}


@query("stream_ingest", sql("""SELECT item_id, title, slot, round(price, 2) AS price, version, is_deleted, search_text, len(tk) AS doc_len, len(list_distinct(tk)) AS n_tokens
  FROM sitems LEFT JOIN stok USING (item_id)""", "sitems", "stok"))
def stream_ingest(spark, sf):
    """Products, and what the postings and lengths say about each."""
    store = live(spark, sf)
    tokens = store.read("postings").groupBy("item_id").agg(F.count("*").alias("n_tokens"))
    lengths = store.read("lengths").select("item_id", F.col("doc_len").cast("bigint").alias("doc_len"))
    return store.read("catalog").select("item_id", "title", "slot", "price", "version", "is_deleted", "search_text").join(lengths, "item_id", "left").join(tokens, "item_id", "left")


@query("stream_frequencies", sql("SELECT token, count(*) AS df FROM (SELECT DISTINCT item_id, unnest(tk) AS token FROM stok) GROUP BY token", "stok"))
def stream_frequencies(spark, sf):
    """Document frequencies, kept by differences alone."""
    return live(spark, sf).index().frequencies.select("token", F.col("df").cast("bigint").alias("df"))
