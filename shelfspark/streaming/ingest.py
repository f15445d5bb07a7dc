"""Update feeds: a catalog with its search index in plain bucketed Parquet, moved batch by batch, and its Structured Streaming form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructType

from ..operators.dedup import flag_first
from ..operators.evolution import upsert_catalog
from ..operators.retrieval import KeywordIndex, build_postings, document_lengths, live_items
from ..operators.triage import transform_catalog
from ..operators.validate import validate_batch
from ..plans.reports import global_mean_rating

CATALOG_COLUMNS = ["item_id", "title", "store", "price", "average_rating", "rating_number", "quality_bayes",
                   "image_url", "gender", "age_group", "slot", "accessory_type", "colors", "seasons", "occasions",
                   "features", "description", "review_snippets", "search_text"]
KEYS = {"catalog": "item_id", "postings": "item_id", "lengths": "item_id", "vectors": "item_id", "frequencies": "token"}
BUCKETS = 64
BUCKET_ROWS = 20_000  # products of a bucket, which one task writes

Encode = Callable[[DataFrame], DataFrame]


def bucket_count(products: int, least: int = 8) -> int:
    """Buckets for so many products: with a fixed number a task's share grows with the catalog, whatever the machines."""
    return max(least, -(-products // BUCKET_ROWS))


class LiveCatalog:
    """Folders <root>/<table>/bucket=<n>: plain Parquet, dealt by the hash of the table's key.

    catalog: products; postings(item_id, doc_len, token, tf), lengths(item_id, doc_len), vectors(item_id, vec): of
    the live products; frequencies(token, df).  A batch reads and rewrites only the buckets its ids and tokens fall
    into.  It first stages its results and its new buckets under <root>/staged/batch=<id>, notes that, and then
    overwrites those buckets: a job that dies half way stages again or overwrites again from what is staged, and a batch that is
    noted as published changes nothing.  Every staged bucket also holds a row with a null key, so that one that
    becomes empty is overwritten like the others; `read` leaves that row out.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, encode: Encode | None = None):
        self.spark, self.root, self.buckets, self.encode = spark, root.rstrip("/"), buckets, encode
        self.schemas: dict[str, StructType] = {}  # a table keeps its first one

    def path(self, table: str, batch_id: int | None = None) -> str:
        return f"{self.root}/{table}" if batch_id is None else f"{self.root}/staged/batch={batch_id}/{table}"

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    @property
    def tables(self) -> list[str]:
        return [t for t in KEYS if t != "vectors" or self.encode]

    def read(self, table: str, touched: list[int] | None = None) -> DataFrame:
        if table not in self.schemas:
            self.schemas[table] = self.spark.read.parquet(self.path(table)).schema
        rows = self.spark.read.schema(self.schemas[table]).parquet(self.path(table)).filter(F.col(KEYS[table]).isNotNull())
        return (rows if touched is None else rows.filter(F.col("bucket").isin(touched))).drop("bucket")

    def index(self) -> KeywordIndex:
        return KeywordIndex(self.read("postings"), self.read("lengths"), self.read("frequencies").filter("df > 0"))

    def bucketed(self, rows: DataFrame, table: str) -> DataFrame:
        return rows.withColumn("bucket", self.bucket(KEYS[table]))

    def dealt(self, rows: DataFrame, table: str) -> DataFrame:
        """Rows with their bucket, a file per bucket."""
        return self.bucketed(rows, table).repartition("bucket")

    def create(self, products: DataFrame) -> None:
        """The first state, from products with merge columns."""
        self.dealt(products, "catalog").write.partitionBy("bucket").parquet(self.path("catalog"))
        live = live_items(self.read("catalog"))
        self.dealt(build_postings(live), "postings").write.partitionBy("bucket").parquet(self.path("postings"))
        self.dealt(document_lengths(live), "lengths").write.partitionBy("bucket").parquet(self.path("lengths"))
        counts = self.read("postings").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        self.dealt(counts, "frequencies").write.partitionBy("bucket").parquet(self.path("frequencies"))
        if self.encode:
            self.dealt(self.encode(live), "vectors").write.partitionBy("bucket").parquet(self.path("vectors"))

    # ------------------------------------------------------------------ a batch
    def noted(self, batch_id: int) -> set[str]:
        try:
            log = self.spark.read.schema("batch_id BIGINT, step STRING").json(self.path("steps"))
            return {r["step"] for r in log.filter(F.col("batch_id") == batch_id).select("step").distinct().collect()}
        except AnalysisException as exc:  # the folder appears with the first note
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            return set()

    def note(self, batch_id: int, step: str) -> None:
        self.spark.createDataFrame([(batch_id, step)], "batch_id BIGINT, step STRING").coalesce(1).write.mode("append").json(self.path("steps"))

    def stage(self, batch: DataFrame, batch_id: int, now: Column | None = None) -> None:
        """Results, products and new buckets of a batch, from the tables as they are."""
        touched = self.buckets_of(batch.filter(F.col("item_id").isNotNull()).select(F.trim("item_id").alias("item_id")), "item_id")
        catalog = self.read("catalog", touched)
        results = self.kept(validate_batch(batch, catalog), "results", batch_id)
        products = self.kept(products_of(batch, results, global_mean_rating(self.read("catalog")).select("global_mean").scalar()), "products", batch_id)
        self.keep("catalog", upsert_catalog(catalog, products, now if now is not None else F.current_timestamp()), touched, batch_id)
        ids = products.select("item_id")
        before, after = self.read("postings", touched), self.kept(build_postings(products), "new_postings", batch_id)
        self.keep("postings", before.join(ids, "item_id", "left_anti").unionByName(after), touched, batch_id)
        self.keep("lengths", self.read("lengths", touched).join(ids, "item_id", "left_anti").unionByName(document_lengths(products)), touched, batch_id)
        gone = before.join(ids, "item_id", "left_semi").select("token", F.lit(-1).alias("by"))
        moves = self.kept(gone.unionByName(after.select("token", F.lit(1).alias("by"))).groupBy("token").agg(F.sum("by").alias("by")).filter("by <> 0"), "moves", batch_id)
        moved = self.buckets_of(moves, "token")
        counts = self.read("frequencies", moved).join(moves, "token", "full_outer").select("token", (F.coalesce("df", F.lit(0)) + F.coalesce("by", F.lit(0))).alias("df"))
        self.keep("frequencies", counts, moved, batch_id)
        if self.encode:
            self.keep("vectors", self.read("vectors", touched).join(ids, "item_id", "left_anti").unionByName(self.encode(products)), touched, batch_id)
        self.note(batch_id, "staged")

    def publish(self, batch_id: int) -> None:
        """Staged files hold a bucket each, so they are copied as they lie."""
        for table in self.tables:
            self.spark.read.schema(self.read(table).schema.add("bucket", IntegerType())).parquet(self.path(table, batch_id)).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path(table))
        self.note(batch_id, "published")

    def buckets_of(self, rows: DataFrame, key: str) -> list[int]:
        """The buckets that hold a row: at most their number."""
        return sorted(r[0] for r in rows.select(self.bucket(key)).distinct().collect())

    def kept(self, rows: DataFrame, name: str, batch_id: int) -> DataFrame:
        rows.write.mode("overwrite").parquet(self.path(name, batch_id))
        return self.spark.read.schema(rows.schema).parquet(self.path(name, batch_id))

    def keep(self, table: str, rows: DataFrame, touched: list[int], batch_id: int) -> None:
        marks = self.spark.createDataFrame([(b,) for b in touched], "bucket int")
        self.bucketed(rows, table).unionByName(marks, allowMissingColumns=True).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self.path(table, batch_id))


def products_of(batch: DataFrame, results: DataFrame, global_mean) -> DataFrame:
    """Transformed products of the accepted records, one row per id, without merge columns."""
    ok = batch.join(results.filter("status <> 'rejected'").select("seq"), "seq", "left_semi")
    return transform_catalog(ok, global_mean).select(*CATALOG_COLUMNS)


def ingest_batch(store: LiveCatalog, batch: DataFrame, batch_id: int, now: Column | None = None) -> DataFrame:
    """validate -> transform -> upsert products, postings, lengths, frequencies, vectors; returns the per-record results.

    batch: RAW columns plus seq.  A batch id that was published changes nothing; one that was only staged is published.
    """
    steps = store.noted(batch_id)
    if "published" not in steps:
        if "staged" not in steps:
            store.stage(batch, batch_id, now)
        store.publish(batch_id)
    return store.spark.read.parquet(store.path("results", batch_id))


def stream_ingest(feed: DataFrame, store: LiveCatalog, checkpoint: str) -> StreamingQuery:
    """Drain the files that wait in the feed batch by batch, safe to restart."""

    def step(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            ingest_batch(store, batch, batch_id)

    return feed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_per_id(feed: DataFrame) -> DataFrame:
    """First record per id of a feed that carries `seq`."""
    return flag_first(feed, ["item_id"], ["seq"], unique=["seq"], flag="_f").filter("_f").drop("_f")
