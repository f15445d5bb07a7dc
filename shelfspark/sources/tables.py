"""Adapters: the given star-schema tables seen as a catalog feed, a query log and a text corpus.

The texts below run unchanged on Spark and on the checking engine, so both sides start from the
same rows.  Every adapter reads its whole table and grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import strings
from ..functions.intent import parse_queries
from ..operators.dedup import for_all_askers, same_text, spread
from ..operators.encoders import hash_encoder
from ..operators.triage import transform_catalog
from ..session import materialize

AUDIENCES = ["Women's ", "Men's ", "Unisex ", "Girls' ", "Boys' ", "Toddler ", "Womens ", "",
             "Men&#39;s &amp; Women&#39;s "]
GARMENTS = [
    "Linen Sundress with Daisies", "Trail Runners", "Oxford Dress Shirt", "Straight Denim Jeans", "Canvas Tote Bag",
    "Quilted Winter Coat", "Long Tunic over Leggings", "Flannel Shorts Pajamas", "Beaded Costume Jewelry Ring",
    "Ribbed Dress Socks", "Striped Short Sleeve Polo Shirt", "Modal Boxer Briefs", "Pirate Costume for Halloween",
    "Cork Thong Sandals", "Seamless Workout Leggings", "Chiffon Scarf", "Quartz Dress Watch", "Cable Knit Beanie",
    "Satin Evening Gown", "Velvet Blazer 42 Regular", "Charms for Clogs", "Decals for Truck Bumper",
    "CPR Face Shield", "Birthday Sash and Crown", "Ceramic Mug", "Plush Bear", "Phone Case with Stand",
    "Silver Stud Earrings", "Mirrored Sunglasses", "Braided Belt", "Fleece Gloves", "Steel Ear Gauges and Plugs",
    "Knotted Headband", "Hockey Jersey", "Quick Dry Swim Trunks", "Wide Leg Romper", "Tie Dye Sweatshirt", "Article 7731",
    "Enamel Lapel Pin", "Zip Wristlet",
]
ENDINGS = [" (Navy, L)", " (Flower Mix Pink, Size 6-8)", " - White", " Pack of 2", " [Green] Small", " 3 Pairs", "",
           " for Kids 5-6 Years", " ★ Best Choice", " cityReady Cut"]
FEATURES = ["Pure linen", "Light fabric for the beach", "Lined with fleece", "Wash by hand", "Running and athletic fit",
            "Suit for formal evenings", "parkFriendly ➤ wear"]
DESCRIPTIONS = ["", "A thong sandal for warm summer evenings.", "Blue denim jeans with five pockets.",
                "Small accessory for every travel bag.", "Party piece   with  charger in the box", "Fine"]
QUERIES = [
    "green linen dress under $45", "women's trail running shoes below 90 dollars", "nice clothes for a dinner with friends",
    "men's brown canvas tote bag", "steel bracket", "kids pirate costume", "quilted coat over $30",
    "long tunic over leggings", "outfit for 7 year old girl", "modal boxer briefs", "silver earrings between 10 and 25 dollars",
    "adidas gear under 900 rupees", "oxford dress shirt for men", "cosy fleece clothing", "truck bumper decals",
    "cpr face shield", "gym outfit for men", "warm socks and gloves", "under armour sweatshirt less than 55 USD",
    "striped swim trunks", "botas de invierno para mujer por menos de 70 dólares",
    "robe d'hiver pour une fête à moins de 65 dollars", "पुरुषों के लिए 40 डॉलर से कम के जूते",
    "60 டாலருக்கு குறைவான பெண்களுக்கான உடை", "qqzv wwkx", "blue ring", "copper kettle", "what to wear at a wedding",
    "white sweater for women under $35", "black belt for men", "purple romper", "hat and scarf for winter", "boys hockey jersey below 40 dollars",
    "formal gown", "casual shorts over $15", "bufanda roja por menos de 20 dólares", "chaussures de sport pour homme",
]


def pick(values: list[str], index: str) -> str:
    """SQL that picks values[index mod n] in both dialects."""
    text = "|".join(values).replace("'", "''")
    return f"split_part('{text}', '|', CAST(1 + ({index}) % {len(values)} AS INT))"


FEED_SQL = f"""
SELECT p.p_partkey AS seq, concat('P', lpad(CAST(p.p_partkey AS STRING), 8, '0')) AS item_id,
  CASE WHEN p.p_partkey % 37 = 0 THEN NULL WHEN p.p_partkey % 41 = 0 THEN '  ' WHEN p.p_partkey % 43 = 0 THEN 'Hat'
    WHEN p.p_partkey % 47 = 0 THEN '--- 12 ??'
    ELSE concat({pick(AUDIENCES, 'p.p_partkey + p.p_size')}, p.p_name, ' ',
                {pick(GARMENTS, 'p.p_partkey * 7 + p.p_size')}, {pick(ENDINGS, 'p.p_partkey * 3 + p.p_size * 5')}) END AS title,
  CASE WHEN p.p_partkey % 17 = 0 THEN NULL WHEN p.p_partkey % 19 = 0 THEN 'Nike'
    WHEN p.p_partkey % 23 = 0 THEN 'Under Armour Outlet' ELSE p.p_brand END AS store,
  CASE WHEN p.p_partkey % 13 = 0 THEN NULL WHEN p.p_partkey % 53 = 0 THEN CAST(0 AS DOUBLE)
    WHEN p.p_partkey % 59 = 0 THEN CAST(50000 AS DOUBLE) WHEN p.p_partkey % 61 = 0 THEN CAST(0.05 AS DOUBLE)
    ELSE CAST(round((p.p_retailprice - 899.5) / 2, 2) AS DOUBLE) END AS price,
  r.rating AS average_rating, r.votes AS rating_number,
  CASE WHEN p.p_partkey % 5 = 0 THEN '' ELSE concat({pick(FEATURES, 'p.p_size')}, ';', {pick(FEATURES, 'p.p_partkey + 2')}) END AS feature_text,
  {pick(DESCRIPTIONS, 'p.p_partkey + p.p_size * 2')} AS description,
  CASE p.p_partkey % 7 WHEN 0 THEN 'womens' WHEN 1 THEN 'mens' WHEN 2 THEN 'unisex-adult' ELSE NULL END AS department,
  p.p_partkey % 29 = 0 AS is_deleted, 1 + p.p_partkey % 3 AS version
FROM {{part}} p LEFT JOIN (
  SELECT l_partkey, avg(l_quantity) / 10 AS rating, count(*) AS votes FROM {{lineitem}} GROUP BY l_partkey
) r ON p.p_partkey = r.l_partkey
"""
QUERY_SQL = f"""
SELECT concat('Q', lpad(CAST(s_suppkey AS STRING), 6, '0')) AS query_id, s_suppkey,
  {pick(QUERIES, 's_suppkey')} AS query FROM {{supplier}}
"""
BATCH_SQL = f"""
SELECT o_orderkey AS seq,
  CASE WHEN o_orderkey % 97 = 0 THEN '' ELSE concat('P', lpad(CAST(o_custkey * 2 AS STRING), 8, '0')) END AS item_id,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN 'Short tee'
    ELSE concat(o_orderpriority, ' ', {pick(GARMENTS, 'o_orderkey + o_custkey')}, ' edition') END AS title,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN CAST(0 AS DOUBLE) ELSE o_totalprice END AS price
FROM {{orders}}
"""
REVIEW_SQL = """
SELECT o_orderkey AS seq, concat('P', lpad(CAST(o_custkey AS STRING), 8, '0')) AS item_id,
  concat('Order ', CAST(o_orderkey AS STRING), ' priority ', o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN ''
    ELSE ', arrived well packed and fits as the listing said it would' END) AS text,
  CAST(floor(o_totalprice / 50000) AS BIGINT) AS helpful_vote
FROM {orders}
"""
LOG_SQL = """
SELECT event_id, concat('R', lpad(CAST(event_id AS STRING), 8, '0')) AS request_id, ts, event_type AS endpoint,
  value AS latency_ms, CASE WHEN user_id % 11 = 0 THEN 500 ELSE 200 END AS status, user_id % 4 = 0 AS used_fallback,
  user_id % 6 AS result_count, value < 5 AS low_confidence, user_id % 9 AS filtered_count, 10 + user_id % 9 AS pool_size,
  concat('  ', event_type, ' ', CAST(user_id % 10 AS STRING), '?') AS query
FROM {events}
"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def run(spark: SparkSession, sf: str, sql: str, **dealt: DataFrame) -> DataFrame:
    """Run a portable text over the given tables; `dealt` names tables that were dealt to tasks beforehand."""
    names = ["part", "lineitem", "supplier", "orders", "events", "documents", "embeddings", "benchmark"]
    used = {n: dealt[n] if n in dealt else table(spark, sf, n) for n in names if "{" + n + "}" in sql}
    return spark.sql(sql, **used)


_KEPT: dict[tuple, DataFrame] = {}


def kept(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """Share an intermediate table between the queries of one session."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _KEPT:
        _KEPT[key] = materialize(build(), name)
    return _KEPT[key]


def feed(spark: SparkSession, sf: str, **dealt: DataFrame) -> DataFrame:
    """Raw catalog records."""
    raw = run(spark, sf, FEED_SQL, **dealt)
    return raw.withColumns({
        "features": F.filter(F.split("feature_text", ";"), lambda s: s != ""),
        "details": F.when(F.col("department").isNotNull(), F.create_map(F.lit("Department"), F.col("department"))),
    }).drop("feature_text", "department")


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Products: the transformed feed with its stored version and deletion flags."""

    def build() -> DataFrame:
        # dealt by key before the join with its ratings: the narrow rows move, not the texts that the feed makes of them
        part = table(spark, sf, "part").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
        raw = feed(spark, sf, part=part).withColumnsRenamed({"is_deleted": "_d", "version": "_v"})
        return transform_catalog(raw, dealt=True).withColumns({"is_deleted": F.col("_d"), "version": F.col("_v")}).drop("_d", "_v")

    return kept(spark, sf, "items", build)


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed query log."""
    return kept(spark, sf, "queries", lambda: parse_queries(spread(run(spark, sf, QUERY_SQL))))


def askers(spark: SparkSession, sf: str) -> DataFrame:
    """(asker, query_id): a query log repeats its texts, so one query of each text asks for all of them."""
    return kept(spark, sf, "askers", lambda: same_text(queries(spark, sf)))


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed queries, one of each text; a parse depends on nothing but the text."""
    return kept(spark, sf, "asked", lambda: queries(spark, sf).join(askers(spark, sf).select(F.col("asker").alias("query_id")).distinct(), "query_id", "left_semi"))


def answered(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    """Rows of the queries in `asked` as rows of the whole log."""
    return for_all_askers(rows, askers(spark, sf))


def lifted(vec: str) -> F.Column:
    """Unit vector one dimension up: inner products become (1 + cosine) / 2."""
    half = 0.5 ** 0.5
    return F.concat(F.transform(vec, lambda x: x.cast("double") * half), F.array(F.lit(half)))


def text_vectors(texts: DataFrame, keys: str | list[str], text: str) -> DataFrame:
    """(keys, vec): the hash encoder's vectors, lifted; items and queries go through the same encoder."""
    return hash_encoder(texts, item=keys, text=text).withColumn("vec", lifted("vec"))


def item_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, is_deleted, vec): vectors of the search texts; the flag lies beside the vector, so that no vector moves to meet it."""
    return kept(spark, sf, "item_vectors", lambda: text_vectors(items(spark, sf).select("item_id", "is_deleted", "search_text"), ["item_id", "is_deleted"], "search_text"))


def query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """For each query in `asked`: one vector for the raw text, one more where the normalised text differs."""
    q = asked(spark, sf).select("query_id", "query", "normalized_query_en")
    raw = q.select("query_id", F.lit("raw").alias("variant"), F.col("query").alias("text"))
    other = q.filter("lower(trim(query)) <> lower(trim(normalized_query_en))").select("query_id", F.lit("normalized").alias("variant"), F.col("normalized_query_en").alias("text"))
    return text_vectors(raw.unionByName(other), ["query_id", "variant"], "text")


def request_log(spark: SparkSession, sf: str) -> DataFrame:
    log = run(spark, sf, LOG_SQL)
    return log.withColumn("warnings", F.when(F.col("low_confidence"), strings(["low_confidence_results"]))
                          .otherwise(strings([])))


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, REVIEW_SQL)


def update_batch(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, sf, BATCH_SQL)
