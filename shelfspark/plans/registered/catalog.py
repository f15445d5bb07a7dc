"""Validation, attribute derivation, quality and triage, scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import attributes as A
from ...functions import rules as R
from ...operators import dedup, joins, sampling, triage, validate
from ...sources import catalog as C
from ...sources import tables as T
from .base import (cte, has_any, join_list, lit, list_all, plain, query, rx, sql, sql_acc, sql_age,
                   sql_clean, sql_gender, sql_slot, sql_word_count, COLOR_RULES)


def joined(col: str) -> F.Column:
    return F.array_join(F.coalesce(F.col(col), F.array().cast("array<string>")), ",")


# ---------------------------------------------------------------- scans and lookups
@query("scan_active", sql("SELECT item_id, slot, price FROM items WHERE NOT is_deleted", "items"))
def scan_active(spark, sf):
    return C.scan_active(T.items(spark, sf)).select("item_id", "slot", "price")


@query("lookup_ids", sql("""SELECT item_id, title FROM items WHERE NOT is_deleted
  AND seq IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)""", "items"))
def lookup_ids(spark, sf):
    wanted = T.table(spark, sf, "lineitem").filter("l_quantity >= 49").select(F.col("l_partkey").alias("seq")).distinct()
    return joins.lookup_ids(T.items(spark, sf), wanted, "seq").select("item_id", "title")


@query("write_quarantine", sql("""SELECT item_id, status, n_seen FROM (
  SELECT printf('P%08d', o_custkey) AS item_id, o_orderstatus AS status, count(*) OVER (PARTITION BY o_custkey) AS n_seen,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1"""))
def write_quarantine(spark, sf):
    """Insert-or-replace over an event history: the latest status per id."""
    o = T.table(spark, sf, "orders")
    rec = o.select(F.concat(F.lit("P"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")).alias("item_id"),
                   F.col("o_orderstatus").alias("status"), F.struct("o_orderdate", "o_orderkey").alias("created_at"))
    seen = rec.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_seen"))
    return C.latest_quarantine(rec).join(seen, "item_id").select("item_id", "status", "n_seen")


# -------------------------------------------------------------------- validation
_drop = f"""CASE WHEN title IS NULL OR trim(title) = '' THEN 'no_title' WHEN length(trim(title)) < 15 THEN 'short_title'
  WHEN {rx('title', R.NON_FASHION)} THEN 'non_fashion_keyword' WHEN price IS NULL THEN 'no_price'
  WHEN price <= 0 THEN 'invalid_price' END"""
cte("validated", f"SELECT *, {_drop} AS drop_reason FROM feed", "feed")


@query("validate_records", sql("SELECT item_id, coalesce(drop_reason, 'kept') AS state FROM validated", "validated"))
def validate_records(spark, sf):
    return validate.validate_records(T.feed(spark, sf)).select("item_id", F.coalesce("drop_reason", F.lit("kept")).alias("state"))


cte("batch", plain(T.BATCH_SQL))


@query("validate_batch", sql(f"""
SELECT b.seq, coalesce(b.item_id, 'unknown') AS item_id,
  CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN i.item_id IS NULL THEN 'created' ELSE 'updated' END AS status,
  coalesce(reason, '') AS reason, CASE WHEN reason IS NOT NULL THEN 0 ELSE coalesce(i.version + 1, 1) END::BIGINT AS version
FROM (SELECT seq, item_id, CASE WHEN item_id IS NULL THEN 'no_parent_asin' WHEN rn > 1 THEN 'duplicate_in_batch' ELSE {_drop} END AS reason
  FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY seq) AS rn FROM (
    SELECT seq, nullif(item_id, '') AS item_id, title, price FROM batch))) b LEFT JOIN feed i ON b.item_id = i.item_id""", "batch", "feed"))
def validate_batch(spark, sf):
    return validate.validate_batch(T.update_batch(spark, sf), T.feed(spark, sf).select("item_id", "version"))


@query("price_check", sql("""SELECT item_id, CASE WHEN price > 0 THEN round(price, 2) END AS clean_price, CASE WHEN price IS NULL THEN 'missing_price'
  WHEN price <= 0 THEN 'zero_or_negative_price' WHEN price < 0.2 OR price > 10000 THEN 'price_outlier' ELSE 'ok' END AS state FROM feed""", "feed"))
def price_check(spark, sf):
    c = validate.price_check(F.col("price"))
    return T.feed(spark, sf).select("item_id", c["price"].alias("clean_price"), F.coalesce(c["reason"], F.lit("ok")).alias("state"))


def sql_relevance(title: str) -> str:
    body = f"lower({title} || ' ' || coalesce(store, '') || ' ' || array_to_string(feats, ' ') || ' ' || coalesce(description, ''))"
    found = f"regexp_extract({body}, {lit(R.STRONG_NON_FASHION)}, 0)"
    return f"CASE WHEN NOT {rx(title, R.FASHION_OVERRIDE)} AND {found} <> '' THEN 'non_fashion: ' || {found} END"


@query("relevance_check", sql(f"SELECT item_id, coalesce({sql_relevance('t')}, 'wearable') AS relevance FROM rec", "rec"))
def relevance_check(spark, sf):
    n = triage.normalize_record(T.feed(spark, sf))
    return n.select("item_id", F.coalesce(validate.relevance_check(
        F.col("title"), F.col("store"), F.col("features"), F.col("description")), F.lit("wearable")).alias("relevance"))


# -------------------------------------------------------------------- attributes
def _attr(name: str, column: str, text: str):
    @query(name, sql(text, "items"))
    def run(spark, sf):
        c = F.col(column)
        kind = dict(T.items(spark, sf).dtypes)[column]
        return T.items(spark, sf).select("item_id", (joined(column) if kind.startswith("array") else c).alias("value"))
    return run


_attr("derive_gender", "gender", "SELECT item_id, gender AS value FROM items")
_attr("derive_age_group", "age_group", "SELECT item_id, age_group AS value FROM items")
_attr("derive_slot", "slot", "SELECT item_id, slot AS value FROM items")
_attr("derive_accessory_type", "accessory_type", "SELECT item_id, accessory_type AS value FROM items")
_attr("derive_colors", "colors", f"SELECT item_id, {join_list('colors')} AS value FROM items")
_attr("derive_seasons", "seasons", f"SELECT item_id, {join_list('seasons')} AS value FROM items")
_attr("derive_occasions", "occasions", f"SELECT item_id, {join_list('occasions')} AS value FROM items")
_attr("bayesian_quality", "quality_bayes", "SELECT item_id, quality_bayes AS value FROM items")


_rule_no = "CASE " + " ".join(f"WHEN {rx('t', p)} THEN {i}" for i, (_s, p) in enumerate(R.SLOT_RULES, 1)) + " ELSE 0 END"


@query("slot_trace", sql(f"SELECT item_id, coalesce({sql_slot('t')}, 'unknown') AS slot, {_rule_no} AS rule FROM rec", "rec"))
def slot_trace(spark, sf):
    return T.items(spark, sf).withColumn("_s", A.slot_trace(F.col("title"))).select("item_id", "_s.slot", "_s.rule")


@query("transform_catalog", sql(f"""SELECT item_id, title, store, round(price, 2) AS price, gender, age_group, slot, accessory_type,
  {join_list('colors')} AS colors, {join_list('seasons')} AS seasons, {join_list('occasions')} AS occasions, quality_bayes,
  search_text FROM (SELECT * REPLACE (nullif(trim(store), '') AS store) FROM items)""", "items"))
def transform_catalog(spark, sf):
    return T.items(spark, sf).select("item_id", "title", "store", "price", "gender", "age_group", "slot", "accessory_type",
                                     joined("colors").alias("colors"), joined("seasons").alias("seasons"),
                                     joined("occasions").alias("occasions"), "quality_bayes", "search_text")


# ------------------------------------------------------------------------ triage
def _sec(ret) -> str:
    return "CASE " + " ".join(f"WHEN {rx('ct', p)} THEN {ret(s)}" for s, _k, p in R.SECONDARY_SLOT_RULES)


_primary = f"coalesce({sql_slot('ct')}, {sql_slot(chr(34) + 'ft' + chr(34))}, {sql_slot('description')})"
cte("tri0", f"""
SELECT *, array_to_string(feats, ' ') AS ft, {sql_clean("replace(replace(title, '&#39;', chr(39)), '&amp;', '&')")} AS ct FROM rec""", "rec")
cte("tri1", f"""
SELECT *, {_primary} AS prim, {sql_gender('department', 'ct')} AS gender, {sql_age('ct')} AS age_group, {list_all('ct', COLOR_RULES)} AS colors,
  CASE WHEN title IS NULL OR trim(title) = '' THEN 'missing_title'
    WHEN ct = '' OR regexp_full_match(ct, '(?:[^\\pL\\pN]|[0-9])*') OR {sql_word_count('ct')} < 2 THEN 'meaningless_title'
    WHEN length(ct) < 10 THEN 'short_title' END AS rt,
  CASE WHEN price IS NULL THEN 'missing_price' WHEN price <= 0 THEN 'zero_or_negative_price'
    WHEN price < 0.2 OR price > 10000 THEN 'price_outlier' END AS rp,
  {sql_relevance('ct')} AS rr0 FROM tri0""", "tri0")
cte("tri2", f"""
SELECT *, CASE WHEN rt IS NULL THEN rr0 END AS rr, coalesce(prim, {_sec(lit)} END, 'unknown') AS cslot,
  CASE WHEN prim = 'accessory' THEN {sql_acc('ct')} WHEN prim IS NOT NULL THEN NULL
    ELSE {_sec(lambda s: sql_acc('ct') if s == 'accessory' else 'NULL')} END END AS acc,
  CASE WHEN prim IS NOT NULL OR {_sec(lambda s: '1')} END = 1 THEN 'high' ELSE 'low' END AS conf,
  CASE WHEN length(ct) >= 20 AND {sql_word_count('ct')} >= 4 THEN 0.25 WHEN {sql_word_count('ct')} >= 3 THEN 0.18 ELSE 0.10 END::DOUBLE AS p1,
  CASE WHEN price > 0 THEN 0.15 ELSE 0 END::DOUBLE AS p2,
  (CASE WHEN coalesce(trim(store), '') <> '' AND lower(store) <> 'unknown' THEN 0.05 ELSE 0 END + CASE WHEN len(feats) > 0 THEN 0.05 ELSE 0 END
   + CASE WHEN length(trim(coalesce(description, ''))) >= 15 THEN 0.05 ELSE 0 END + CASE WHEN len(colors) > 0 THEN 0.05 ELSE 0 END)::DOUBLE AS p4,
  CASE WHEN average_rating > 0 THEN 0.15 ELSE 0.05 END::DOUBLE AS p5 FROM tri1""", "tri1")
cte("tri3", """
SELECT *, CASE WHEN cslot <> 'unknown' AND conf = 'high' THEN 0.25 ELSE 0 END::DOUBLE AS p3, rt IS NOT NULL OR rp IS NOT NULL OR rr IS NOT NULL AS bad FROM tri2""", "tri2")
cte("tri4", "SELECT *, round(least(greatest(p1 + p2 + p3 + p4 + p5, 0), 1), 3) AS qs FROM tri3", "tri3")
cte("triaged", """
SELECT *, CASE WHEN bad THEN 'rejected' WHEN cslot = 'unknown' OR qs < 0.35 THEN 'quarantined' ELSE 'accepted' END AS status,
  CASE WHEN bad THEN list_filter([rt, rp, rr], lambda x: x IS NOT NULL) WHEN cslot = 'unknown' THEN ['unknown_slot']
    WHEN qs < 0.35 THEN ['low_quality_score'] ELSE [] END AS reasons,
  CASE WHEN bad THEN 'unknown' ELSE cslot END AS tslot, CASE WHEN bad THEN 'low' ELSE conf END AS tconf, CASE WHEN bad THEN 0.0 ELSE qs END::DOUBLE AS tq,
  CASE WHEN rt IN ('missing_title', 'meaningless_title') THEN t ELSE ct END AS clean_title FROM tri4""", "tri4")


def triaged(spark, sf):
    def build():
        n = triage.normalize_record(T.feed(spark, sf)).withColumn("stored_slot", A.derive_slot(
            F.col("title"), F.col("features"), F.col("description")))
        return triage.triage(n)
    return T.kept(spark, sf, "triaged", build)


@query("count_quarantine", sql("SELECT status, count(*) AS n FROM triaged WHERE status <> 'accepted' GROUP BY status", "triaged"))
def count_quarantine(spark, sf):
    return C.count_quarantine(triaged(spark, sf).filter("status <> 'accepted'"))


@query("slot_confidence", sql("SELECT item_id, cslot AS slot, conf AS confidence, acc AS accessory_type FROM tri2", "tri2"))
def slot_confidence(spark, sf):
    from ...functions.text import clean_text, html_unescape

    n = triage.normalize_record(T.feed(spark, sf)).withColumn("_c", clean_text(html_unescape(F.col("title"))))
    return n.withColumn("_s", A.slot_confidence(F.col("_c"), F.col("features"), F.col("description"))).select("item_id", "_s.*")


@query("quality_explain", sql("""SELECT item_id, p1 AS title_part, p2 AS price_part, p3 AS slot_part, round(p4, 2) AS meta_part,
  p5 AS rating_part, qs AS score FROM tri4""", "tri4"))
def quality_explain(spark, sf):
    from ...functions.text import clean_text, html_unescape

    n = triage.normalize_record(T.feed(spark, sf)).withColumn("_c", clean_text(html_unescape(F.col("title"))))
    n = n.withColumn("_s", A.slot_confidence(F.col("_c"), F.col("features"), F.col("description")))
    q = A.quality_explain(F.col("_c"), F.col("price"), F.col("_s.slot"), F.col("_s.confidence"), F.col("store"), F.col("features"),
                          F.col("description"), A.derive_colors(F.col("_c")), F.col("average_rating"))
    return n.withColumn("_q", q).select("item_id", "_q.*")


@query("triage", sql(f"""SELECT item_id, status, {join_list('reasons', ';')} AS reasons, tslot AS slot, tconf AS confidence, tq AS quality_qc,
  clean_title FROM triaged""", "triaged"))
def run_triage(spark, sf):
    return triaged(spark, sf).select("item_id", "status", F.array_join("reasons", ";").alias("reasons"), "slot", "confidence",
                                     "quality_qc", "clean_title")


@query("dup_id", """SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1 AS duplicate_id FROM events""")
def dup_id(spark, sf):
    e = T.table(spark, sf, "events").select("event_id", "ts", "user_id")
    out = dedup.flag_first(e, ["user_id"], ["ts", "event_id"], unique=["event_id"])
    return out.select("event_id", (~F.col("is_first")).alias("duplicate_id"))


@query("dup_signature", """SELECT p_partkey, row_number() OVER (PARTITION BY p_brand, lower(p_name), round(p_retailprice, -2) ORDER BY p_partkey) > 1
  AND p_size > 5 AS dropped FROM (SELECT * FROM part WHERE p_size > 5) UNION ALL SELECT p_partkey, false FROM part WHERE p_size <= 5""")
def dup_signature(spark, sf):
    p = T.table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("store"), F.col("p_name").alias("clean_title"),
                                          F.round("p_retailprice", -2).alias("price"), F.when(F.col("p_size") > 5, "accepted").otherwise("rejected").alias("status"))
    return dedup.dup_signature(p, seq="p_partkey").select("p_partkey", F.col("duplicate_product").alias("dropped"))


@query("triage_catalog", sql("""SELECT item_id, CASE WHEN status = 'accepted' AND row_number() OVER (PARTITION BY status,
  coalesce(nullif(trim(store), ''), 'unknown'), lower(clean_title), price ORDER BY seq) > 1 THEN 'rejected' ELSE status END AS status FROM triaged""", "triaged"))
def triage_catalog(spark, sf):
    return triage.triage_catalog(triage.normalize_record(T.feed(spark, sf))).select("item_id", "status")


_low = "lower(coalesce(title, ''))"
SQL_EFF_SLOTS = f"""CASE WHEN {rx('title', R.PAJAMA_SHORTS)} OR (contains({_low}, 'short') AND {has_any(_low, R.LOUNGE_WORDS)})
  THEN CASE WHEN slot IN ('bottom', 'full_body') THEN (CASE slot WHEN 'bottom' THEN ['bottom', 'full_body'] ELSE ['full_body', 'bottom'] END) ELSE [slot, 'bottom', 'full_body'] END
  WHEN {rx('title', R.COSTUME_JEWELRY)} OR (contains({_low}, 'pendant') AND contains({_low}, 'costume')) THEN ['accessory']
  WHEN {rx('title', R.SHOE_ACCESSORY)} THEN ['accessory'] WHEN {rx('title', R.JACKET_SIZING)} THEN ['top'] ELSE [slot] END"""
SQL_EFF_AGE = f"""CASE WHEN {rx('title', R.CPR)} OR {rx('title', R.SASH)} OR ({has_any(_low, ['shoe charm', 'clog pin'])} AND NOT {rx('title', R.CHARM_AGE_WORDS)})
  THEN 'adult' ELSE age_group END"""
cte("eff", f"SELECT *, {SQL_EFF_SLOTS} AS eslots, {SQL_EFF_AGE} AS eage FROM items", "items")


@query("effective_slots", sql(f"SELECT item_id, {join_list('eslots')} AS slots FROM eff", "eff"))
def effective_slots(spark, sf):
    return T.items(spark, sf).select("item_id", F.array_join(A.effective_slots(F.col("title"), F.col("slot")), ",").alias("slots"))


@query("effective_age", sql("SELECT item_id, eage AS age FROM eff", "eff"))
def effective_age(spark, sf):
    return T.items(spark, sf).select("item_id", A.effective_age(F.col("title"), F.col("age_group")).alias("age"))


@query("read_time_slot_fix", sql(f"""SELECT item_id, CASE WHEN stored = 'bottom' AND {sql_slot('title')} = 'top' THEN 'top' ELSE stored END AS slot
  FROM (SELECT *, CASE WHEN seq % 2 = 0 THEN 'bottom' ELSE slot END AS stored FROM items)""", "items"))
def read_time_slot_fix(spark, sf):
    stored = F.when(F.col("seq") % 2 == 0, "bottom").otherwise(F.col("slot"))
    return T.items(spark, sf).select("item_id", A.read_time_slot_fix(F.col("title"), stored).alias("slot"))


# ------------------------------------------------------------------ build-time joins
cte("revs", plain(T.REVIEW_SQL))
cte("snips", """SELECT item_id, array_to_string(list(substr(t, 1, 150) ORDER BY rn), ' | ') AS snippets FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY helpful_vote DESC, seq) AS rn FROM (SELECT *, trim(text) AS t FROM revs)
  WHERE length(t) >= 40 AND item_id IN (SELECT item_id FROM feed)) WHERE rn <= 2 GROUP BY item_id""", "revs", "feed")


@query("best_reviews", sql("SELECT item_id, snippets FROM snips", "snips"))
def best_reviews(spark, sf):
    best = joins.best_reviews(T.reviews(spark, sf), T.feed(spark, sf))
    return best.select("item_id", F.array_join("review_snippets", " | ").alias("snippets"))


@query("attach_reviews", sql("SELECT f.item_id, coalesce(s.snippets, '') AS snippets FROM feed f LEFT JOIN snips s USING (item_id)", "feed", "snips"))
def attach_reviews(spark, sf):
    best = joins.best_reviews(T.reviews(spark, sf), T.feed(spark, sf))
    return joins.attach_reviews(T.feed(spark, sf), best).select("item_id", F.array_join("review_snippets", " | ").alias("snippets"))


# ------------------------------------------------------------------------ sampling
def sql_seeded(key: str, seed: int) -> str:
    return f"('0x' || substr(md5('{seed}:' || {key}::VARCHAR), 1, 15))::BIGINT"


@query("fixed_sample", f"""SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (ORDER BY {sql_seeded('p_partkey', R.SEED)}, p_partkey) AS r FROM part) WHERE r <= 500""")
def fixed_sample(spark, sf):
    return sampling.fixed_sample(T.table(spark, sf, "part"), 500, "p_partkey").select("p_partkey", "p_name")


@query("holdout_split", f"""SELECT o_orderkey, row_number() OVER (ORDER BY {sql_seeded('o_orderkey', R.SEED + 1)}, o_orderkey) <= floor(count(*) OVER () * {R.HOLDOUT_FRACTION}::DOUBLE) AS held_out FROM orders""")
def holdout_split(spark, sf):
    return sampling.holdout_split(T.table(spark, sf, "orders"), key="o_orderkey").select("o_orderkey", "held_out")


_quota = "CASE slot " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.AUDIT_QUOTA.items()) + " ELSE 0 END"


@query("stratified_sample", sql(f"""SELECT item_id, slot FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY {sql_seeded('item_id', R.SEED)}, item_id) AS r FROM items) WHERE r <= {_quota}""", "items"))
def stratified_sample(spark, sf):
    return sampling.stratified_sample(T.items(spark, sf)).select("item_id", "slot")


@query("random_rows", sql(f"""SELECT item_id, title FROM (SELECT *, row_number() OVER (ORDER BY {sql_seeded('item_id', R.SEED)}, item_id) AS r FROM items WHERE slot = 'unknown') WHERE r <= 30""", "items"))
def random_rows(spark, sf):
    return sampling.random_rows(T.items(spark, sf), 30, F.col("slot") == "unknown").select("item_id", "title")
