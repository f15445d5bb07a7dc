"""Counting reports, audits and operational metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import rules as R
from ...plans import evaluation as E
from ...plans import reports as P
from ...session import scratch_path
from ...sources import tables as T
from ...streaming import metrics as M
from ...streaming import repeats
from .base import case_first, cte, lit, plain, query, sql
from .catalog import triaged

cte("log", plain(T.LOG_SQL))


def pct(part: str, whole: str, d: int = 2) -> str:
    return f"round(coalesce(({part}) * 100.0::DOUBLE / nullif({whole}, 0), 0.0), {d})"


@query("global_mean_rating", sql("SELECT round(coalesce(avg(average_rating) FILTER (average_rating > 0), 4.2), 6) AS global_mean FROM feed", "feed"))
def global_mean_rating(spark, sf):
    return P.global_mean_rating(T.feed(spark, sf))


@query("count_active", sql("SELECT count(*) AS n_active FROM feed WHERE NOT is_deleted", "feed"))
def count_active(spark, sf):
    return P.count_active(T.feed(spark, sf))


@query("drop_report", sql(f"SELECT coalesce(drop_reason, 'kept') AS reason, count(*) AS n, {pct('count(*)', '(SELECT count(*) FROM validated)')} AS pct FROM validated GROUP BY ALL", "validated"))
def drop_report(spark, sf):
    from ...operators.validate import validate_records
    return P.drop_report(validate_records(T.feed(spark, sf)))


@query("coverage_report", sql(" UNION ALL ".join(
    f"SELECT '{c}' AS attribute, {c} AS value, count(*) AS n, {pct('count(*)', '(SELECT count(*) FROM items)')} AS pct FROM items GROUP BY {c}" for c in ("slot", "gender", "age_group")), "items"))
def coverage_report(spark, sf):
    return P.coverage_report(T.items(spark, sf))


_m = {"empty_description": "trim(coalesce(description, '')) = ''", "empty_features": "len(feats) = 0", "no_extracted_color": "len(colors) = 0", "with_review_snippets": "false"}


@query("completeness_report", sql(" UNION ALL ".join(
    f"SELECT '{k}' AS measure, count(*) FILTER ({v}) AS n, {pct(f'count(*) FILTER ({v})', 'count(*)')} AS pct FROM items" for k, v in _m.items()), "items"))
def completeness_report(spark, sf):
    return P.completeness_report(T.items(spark, sf))


_sw = ", ".join(lit(w) for w in R.TITLE_STOPWORDS)


@query("top_words", sql(f"""SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(title), '\\b[a-z]{{3,}}\\b')) AS word FROM items
  WHERE slot = 'unknown' AND (SELECT avg((slot = 'unknown')::INT) FROM items) > 0.05) WHERE word NOT IN ({_sw}) GROUP BY word ORDER BY n DESC, word LIMIT 20""", "items"))
def top_words(spark, sf):
    return P.top_words(T.items(spark, sf), threshold=0.05)


@query("triage_report", sql("""SELECT 'status' AS section, status AS value, count(*) AS n FROM triaged GROUP BY ALL UNION ALL
  SELECT 'slot_all', coalesce(sl, 'unknown'), count(*) FROM (SELECT t.*, i.slot AS sl FROM triaged t JOIN items i USING (item_id)) GROUP BY ALL UNION ALL
  SELECT 'slot_accepted', tslot, count(*) FROM triaged WHERE status = 'accepted' GROUP BY ALL UNION ALL
  SELECT 'gender_accepted', gender, count(*) FROM triaged WHERE status = 'accepted' GROUP BY ALL""", "triaged", "items"))
def triage_report(spark, sf):
    return P.triage_report(triaged(spark, sf))


@query("reason_counts", sql("SELECT status, trim(split_part(reason, ':', 1)) AS reason, count(*) AS n FROM (SELECT status, unnest(reasons) AS reason FROM triaged) GROUP BY ALL", "triaged"))
def reason_counts(spark, sf):
    return P.reason_counts(triaged(spark, sf))


@query("quality_histogram", sql("SELECT printf('%.1f-%.1f', floor(tq * 10) / 10, (floor(tq * 10) + 1) / 10) AS bucket, count(*) AS n FROM triaged GROUP BY ALL", "triaged"))
def quality_histogram(spark, sf):
    return P.quality_histogram(triaged(spark, sf))


@query("confidence_distribution", sql(f"SELECT tconf AS confidence, count(*) AS n, {pct('count(*)', '(SELECT count(*) FROM triaged)')} AS pct FROM triaged GROUP BY ALL", "triaged"))
def confidence_distribution(spark, sf):
    return P.confidence_distribution(triaged(spark, sf))


# ---------------------------------------------------------------- audits: an annotator's labels
cte("audit", """SELECT item_id, title, slot AS derived_slot, gender AS derived_gender, age_group AS derived_age_group,
  CASE WHEN seq % 9 = 0 THEN 'unknown' WHEN seq % 14 = 0 THEN '' WHEN seq % 33 = 0 THEN 'hat' ELSE slot END AS true_slot,
  CASE WHEN seq % 8 = 0 THEN 'unisex' WHEN seq % 25 = 0 THEN '' ELSE gender END AS true_gender,
  CASE WHEN seq % 12 = 0 THEN 'kids' ELSE age_group END AS true_age_group FROM items""", "items")


def audit(spark, sf):
    n = F.col("seq")
    return T.items(spark, sf).select(
        "item_id", "title", F.col("slot").alias("derived_slot"), F.col("gender").alias("derived_gender"), F.col("age_group").alias("derived_age_group"),
        F.when(n % 9 == 0, "unknown").when(n % 14 == 0, "").when(n % 33 == 0, "hat").otherwise(F.col("slot")).alias("true_slot"),
        F.when(n % 8 == 0, "unisex").when(n % 25 == 0, "").otherwise(F.col("gender")).alias("true_gender"),
        F.when(n % 12 == 0, "kids").otherwise(F.col("age_group")).alias("true_age_group"))


cte("apairs", " UNION ALL ".join(f"SELECT item_id, '{a}' AS attribute, derived_{a} AS derived, true_{a} AS true_value FROM audit" for a in P.ATTRIBUTES), "audit")


@query("confusion_matrix", sql("SELECT attribute, derived, true_value, count(*) AS n FROM apairs GROUP BY ALL", "apairs"))
def confusion_matrix(spark, sf):
    return P.confusion_matrix(audit(spark, sf))


@query("class_precision", sql(f"""SELECT CASE WHEN grouping(attribute) = 1 THEN 'all' ELSE attribute END AS attribute, CASE WHEN grouping(derived) = 1 THEN 'all' ELSE derived END AS derived, count(*) AS n,
  count(*) FILTER (derived = true_value) AS correct, {pct('count(*) FILTER (derived = true_value)', 'count(*)', 1)} AS precision_pct FROM apairs GROUP BY GROUPING SETS ((attribute, derived), (attribute), ())""", "apairs"))
def class_precision(spark, sf):
    return P.class_precision(audit(spark, sf))


@query("misclassified", sql("SELECT item_id, attribute, derived, true_value FROM apairs WHERE derived <> true_value", "apairs"))
def misclassified(spark, sf):
    return P.misclassified(audit(spark, sf)).select("item_id", "attribute", "derived", "true_value")


def _ann(field: str, ok: list[str]) -> str:
    vals = ", ".join(lit(v) for v in ok)
    return f"SELECT '{field}' AS field, count(*) FILTER ({field} <> '') AS n, {pct(f'count(*) FILTER ({field} <> {lit(str())})', 'count(*)', 1)} AS pct, count(*) FILTER ({field} <> '' AND {field} NOT IN ({vals})) AS invalid FROM audit"


_allf = "true_slot <> '' AND true_gender <> '' AND true_age_group <> ''"


@query("annotation_status", sql(" UNION ALL ".join([_ann("true_slot", R.SLOTS), _ann("true_gender", R.GENDERS), _ann("true_age_group", R.AGE_GROUPS),
       f"SELECT 'all', count(*) FILTER ({_allf}), {pct(f'count(*) FILTER ({_allf})', 'count(*)', 1)}, 0::BIGINT FROM audit"]), "audit"))
def annotation_status(spark, sf):
    return P.annotation_status(audit(spark, sf))


_second = case_first("title", [(s, p) for s, _k, p in R.SECONDARY_SLOT_RULES])


@query("unknown_recovery", sql(f"""SELECT new_slot, n, pct FROM (SELECT new_slot, count(*) AS n, {pct('count(*)', "(SELECT count(*) FROM items WHERE slot = 'unknown')")} AS pct
  FROM (SELECT coalesce({_second}, 'unknown') AS new_slot FROM items WHERE slot = 'unknown') GROUP BY ALL) WHERE new_slot <> 'unknown'""", "items"))
def unknown_recovery(spark, sf):
    return P.unknown_recovery(T.items(spark, sf))


@query("grade_precision", """SELECT query, count(*) FILTER (g = 'relevant') AS relevant, count(*) FILTER (g = 'borderline') AS borderline, count(*) FILTER (g = 'irrelevant') AS irrelevant,
  round(count(*) FILTER (g = 'relevant') / 5.0::DOUBLE, 6) AS strict_p5, round(count(*) FILTER (g IN ('relevant', 'borderline')) / 5.0::DOUBLE, 6) AS lenient_p5
  FROM (SELECT source || '/' || lang AS query, CASE quality + toxic WHEN 0 THEN 'irrelevant' WHEN 1 THEN 'relevant' ELSE 'borderline' END AS g FROM labels JOIN documents USING (doc_id)) GROUP BY query""")
def grade_precision(spark, sf):
    g = F.col("quality") + F.col("toxic")
    rows = T.table(spark, sf, "labels").join(T.table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id").select(
        F.concat_ws("/", "source", "lang").alias("query"), F.when(g == 0, " Irrelevant").when(g == 1, "relevant ").otherwise("BORDERLINE").alias("grade"))
    return P.grade_precision(rows)


@query("field_accuracy", sql("""SELECT field, count(*) FILTER (ok) AS correct, count(*) AS total, """ + pct("count(*) FILTER (ok)", "count(*)", 1) + """ AS pct FROM (
  SELECT unnest(['is_fashion_query', 'language', 'gender', 'age_group', 'max_price', 'min_price', 'slots']) AS field,
    unnest([true, language = 'en', gender IS NOT DISTINCT FROM CASE WHEN s_suppkey % 3 = 0 THEN 'men' ELSE gender END, age_group = 'adult', max_price IS NOT DISTINCT FROM 50.0,
      min_price IS NULL, slots = ['top'] OR (s_suppkey % 2 = 1 AND len(slots) = 0)]) AS ok FROM parsed) GROUP BY field""", "parsed"))
def field_accuracy(spark, sf):
    q = T.queries(spark, sf)
    n = F.col("s_suppkey")
    expected = q.select("query_id", F.lit(True).alias("is_fashion_query"), F.lit("en").alias("language"),
                        F.when(n % 3 == 0, "men").otherwise(F.col("gender")).alias("gender"), F.lit("adult").alias("age_group"), F.lit(50.0).alias("max_price"),
                        F.lit(None).cast("double").alias("min_price"),
                        F.when((n % 2 == 1) & (F.size("slots") == 0), F.array().cast("array<string>")).otherwise(F.array(F.lit("top"))).alias("slots"))
    return P.field_accuracy(q, expected)


# ----------------------------------------------------------------- request log
@query("latency_percentiles", """SELECT event_type AS endpoint, count(*) AS n, CAST(round(CAST(quantile_cont(value, 0.5) AS DECIMAL(18, 10)), 2) AS DOUBLE) AS p50, CAST(round(CAST(quantile_cont(value, 0.95) AS DECIMAL(18, 10)), 2) AS DOUBLE) AS p95,
  CAST(round(CAST(quantile_cont(value, 0.99) AS DECIMAL(18, 10)), 2) AS DOUBLE) AS p99 FROM events GROUP BY ALL""")
def latency_percentiles(spark, sf):
    return E.latency_percentiles(T.request_log(spark, sf))


ROLLING = sql("""SELECT endpoint, count(*) AS n, CAST(round(CAST(quantile_cont(latency_ms, 0.5) AS DECIMAL(18, 10)), 2) AS DOUBLE) AS p50, CAST(round(CAST(quantile_cont(latency_ms, 0.95) AS DECIMAL(18, 10)), 2) AS DOUBLE) AS p95,
  CAST(round(CAST(quantile_cont(latency_ms, 0.99) AS DECIMAL(18, 10)), 2) AS DOUBLE) AS p99, round(avg(latency_ms), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY ts DESC, request_id DESC) AS r FROM log)
  WHERE r <= 1000 GROUP BY endpoint""", "log")


@query("rolling_metrics", ROLLING)
def rolling_metrics(spark, sf):
    return M.rolling_metrics(T.request_log(spark, sf))


@query("rolling_metrics_stream", ROLLING)
def rolling_metrics_stream(spark, sf):
    """The log arrives in three parts, each with rows of all times."""
    log = T.request_log(spark, sf).select("endpoint", "ts", "request_id", "latency_ms")
    root = scratch_path(spark, "rolling")
    for part in range(3):
        log.filter(F.pmod(F.xxhash64("request_id"), F.lit(3)) == part).write.mode("append").parquet(f"{root}/log")
        M.last_requests_stream(spark.readStream.schema(log.schema).parquet(f"{root}/log"), f"{root}/state").awaitTermination()
    return M.current_metrics(spark, f"{root}/state")


@query("ops_counters", sql("SELECT endpoint, status, count(*) AS n FROM log GROUP BY ALL", "log"))
def ops_counters(spark, sf):
    return M.ops_counters(T.request_log(spark, sf))


@query("warning_counts", sql("SELECT 'low_confidence_results' AS warning, count(*) AS n FROM log WHERE low_confidence", "log"))
def warning_counts(spark, sf):
    return M.warning_counts(T.request_log(spark, sf))


@query("ops_rates", sql(f"""SELECT endpoint, count(*) AS n, {pct('count(*) FILTER (used_fallback)', 'count(*)')} AS fallback_pct, {pct('count(*) FILTER (result_count = 0)', 'count(*)')} AS zero_result_pct,
  {pct('count(*) FILTER (low_confidence)', 'count(*)')} AS low_confidence_pct, {pct('sum(filtered_count)', 'sum(pool_size)')} AS filter_pct, round(avg(latency_ms), 6) AS mean_latency FROM log GROUP BY endpoint""", "log"))
def ops_rates(spark, sf):
    return M.ops_rates(T.request_log(spark, sf))


@query("repeat_within_ttl", """WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, lower(event_type) || ' ' || (user_id % 10)::VARCHAR AS k, epoch_us(ts) AS t FROM events),
m(k, start) AS (SELECT k, min(t) FROM e GROUP BY k UNION ALL SELECT m.k, min(e.t) FROM m JOIN e ON e.k = m.k AND e.t > m.start + 3600000000 GROUP BY m.k)
SELECT e.event_id, e.k AS query_key, f.event_id IS NULL AS repeat FROM e LEFT JOIN (
  SELECT min(e.event_id) AS event_id FROM m JOIN e ON e.k = m.k AND e.t = m.start GROUP BY e.k, m.start) f ON f.event_id = e.event_id""")
def repeat_within_ttl(spark, sf):
    from ...functions.text import query_key

    log = T.request_log(spark, sf).select("event_id", "ts", query_key(F.col("query")).alias("query_key"))
    return repeats.repeat_within_ttl(log)


