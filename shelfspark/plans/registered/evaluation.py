"""Offline evaluation of the search results and of the corpus retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.text import clean_text
from ...operators import joins as J
from ...operators import ranking as K
from ...operators import retrieval as V
from ...plans import evaluation as E
from ...sources import tables as T
from .base import cte, lit, query, sql, sql_clean, sql_tokens
from .ranking import payload, scored, widened
from .reports import pct
from .retrieval import _stop, catalog_index, hash_ctes, sql_bm25, sql_top

# relevance pattern of each query: its words, any of them (as its author would write it)
_pat = "array_to_string(list_filter(regexp_extract_all(lower(query), '[a-z]+'), lambda w: length(w) > 3), '|')"
cte("evalq", f"SELECT query_id, language, gender AS q_gender, age_group AS q_age_group, max_price, min_price, CASE WHEN len(slots) > 0 THEN slots[1] END AS q_slot, coalesce(nullif({_pat}, ''), 'zz') AS pattern FROM parsed", "parsed")
cte("evalr", "SELECT w.query_id, w.rank, w.item_id, w.title, w.price, w.store, w.slot, w.gender, w.age_group, w.sim, q.* EXCLUDE (query_id), regexp_matches(w.title, pattern, 'i') AS rel FROM wide w JOIN evalq q USING (query_id) WHERE rank <= 10", "wide", "evalq")


def eval_queries(spark, sf):
    words = F.filter(F.regexp_extract_all(F.lower("query"), F.lit("([a-z]+)"), F.lit(1)), lambda w: F.length(w) > 3)
    return T.queries(spark, sf).select(
        "query_id", F.col("language").alias("q_language"), F.col("gender").alias("q_gender"), F.col("age_group").alias("q_age_group"),
        F.col("max_price").alias("q_max_price"), F.col("min_price").alias("q_min_price"), F.get("slots", F.lit(0)).alias("q_slot"),
        F.lit(True).alias("q_is_fashion_query"),
        F.when(F.size(words) > 0, F.array_join(words, "|")).otherwise("zz").alias("relevance_regex"))


def results(spark, sf):
    r = widened(spark, sf).filter("rank <= 10").select("query_id", "rank", "item_id", "title", "price", "store", "slot", "gender", "age_group", "sim")
    return T.kept(spark, sf, "results", lambda: T.answered(spark, sf, r).join(eval_queries(spark, sf), "query_id"))


_perq = "SELECT p.query_id, {} FROM parsed p LEFT JOIN (SELECT query_id, count(*) FILTER (rel AND rank <= 5) AS n5, min(rank) FILTER (rel) AS fr FROM evalr GROUP BY query_id) e USING (query_id)"


@query("precision_at_k", sql(_perq.format("round(coalesce(n5, 0) / 5.0::DOUBLE, 6) AS precision"), "parsed", "evalr"))
def precision_at_k(spark, sf):
    return E.precision_at_k(eval_queries(spark, sf), results(spark, sf), E.is_relevant())


@query("recall_at_k", sql(_perq.format("CASE WHEN coalesce(n5, 0) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS recall"), "parsed", "evalr"))
def recall_at_k(spark, sf):
    return E.recall_at_k(eval_queries(spark, sf), results(spark, sf), E.is_relevant())


@query("mrr_at_k", sql(_perq.format("round(coalesce(1.0::DOUBLE / fr, 0.0), 6) AS rr"), "parsed", "evalr"))
def mrr_at_k(spark, sf):
    return E.mrr_at_k(eval_queries(spark, sf), results(spark, sf), E.is_relevant())


# constraints stricter than the search used, so violations occur
_cv = """SELECT *, CASE WHEN price > 20 THEN 1 ELSE 0 END + CASE WHEN price < 5 THEN 1 ELSE 0 END AS vp,
  CASE WHEN gender NOT IN ('women', 'unisex') THEN 1 ELSE 0 END AS vg, CASE WHEN q_age_group = 'kids' AND age_group <> 'kids' THEN 1 ELSE 0 END AS va,
  CASE WHEN coalesce(q_slot, 'top') <> slot THEN 1 ELSE 0 END AS vs FROM evalr WHERE rank <= 5"""


@query("constraint_violations", sql(f"""SELECT sum(vp)::BIGINT AS price_violations, sum(vg)::BIGINT AS gender_violations, sum(va)::BIGINT AS age_violations, sum(vs)::BIGINT AS slot_violations,
  sum(vp + vg + va + vs)::BIGINT AS total_violations, count(*) FILTER (vp + vg + va + vs > 0 AND language = 'en') AS english_violations,
  count(*) FILTER (vp + vg + va + vs > 0 AND language <> 'en') AS degraded_violations FROM ({_cv})""", "evalr"))
def constraint_violations(spark, sf):
    strict = results(spark, sf).withColumns({"q_max_price": F.lit(20.0), "q_min_price": F.lit(5.0), "q_gender": F.lit("women"),
                                             "q_slot": F.coalesce("q_slot", F.lit("top"))})
    return E.constraint_violations(strict)


@query("leakage", sql("""SELECT count(*) FILTER (q_age_group <> 'kids' AND age_group = 'kids') AS kids_leakage,
  count(*) FILTER (coalesce(q_slot, '') <> 'innerwear' AND slot = 'innerwear') AS innerwear_leakage FROM evalr WHERE rank <= 5""", "evalr"))
def leakage(spark, sf):
    return E.leakage(results(spark, sf))


@query("dup_rate", sql(f"""SELECT sum(n)::BIGINT AS n_rows, sum(n - d)::BIGINT AS n_dup, {pct('sum(n - d)', 'sum(n)')} AS dup_pct FROM (
  SELECT query_id, count(*) AS n, count(DISTINCT coalesce(store, 'None') || '::' || lower(title)) AS d FROM evalr WHERE rank <= 5 GROUP BY query_id)""", "evalr"))
def dup_rate(spark, sf):
    return E.dup_rate(results(spark, sf))


@query("result_rates", sql("""SELECT p.query_id, coalesce(nt, 0) AS n_top, coalesce(nt, 0) = 0 AS zero_result, coalesce(bs < 0.6191, false) AS low_confidence, coalesce(nr, 0) = 0 AS no_relevant
  FROM parsed p LEFT JOIN (SELECT query_id, count(*) FILTER (rank <= 5) AS nt, max(sim) AS bs, count(*) FILTER (rank <= 5 AND rel) AS nr FROM evalr GROUP BY query_id) USING (query_id)""", "parsed", "evalr"))
def result_rates(spark, sf):
    return E.result_rates(eval_queries(spark, sf), results(spark, sf), E.is_relevant())


@query("language_success", sql(f"SELECT language, count(*) AS total, count(*) FILTER (warnings = '') AS success, {pct(f'count(*) FILTER (warnings = {chr(39)*2})', 'count(*)')} AS success_pct FROM parsed GROUP BY language", "parsed"))
def language_success(spark, sf):
    return E.language_success(T.queries(spark, sf), F.size("warnings") == 0)


cte("bev", """SELECT query_id, any_value(max_price) AS max_price, bool_or(ids IS NOT NULL) AS made, coalesce(any_value(n_items), 0) AS n_items, any_value(total) AS total,
  count(DISTINCT i.age_group) AS ages, count(DISTINCT i.gender) FILTER (i.gender NOT IN ('unisex', 'unknown')) AS genders, count(*) FILTER (i.slot = 'innerwear') AS inner_items
  FROM (SELECT p.query_id, p.max_price, b.ids, n_items, total, unnest(CASE WHEN b.ids IS NULL THEN [''] ELSE string_split(b.ids, '+') END) AS one FROM parsed p LEFT JOIN bchosen b USING (query_id)) c
  LEFT JOIN items i ON i.item_id = c.one GROUP BY query_id""", "parsed", "bchosen", "items")
_within = "(made AND (max_price IS NULL OR round(total, 2) <= max_price)) OR (NOT made AND max_price <= 15)"


@query("bundle_eval", sql(f"""SELECT count(*) AS n_queries, count(*) FILTER (made) AS n_composed, {pct('count(*) FILTER (made AND n_items >= 3)', 'count(*)')} AS completeness_pct,
  {pct(f'count(*) FILTER ({_within})', 'count(*)')} AS budget_pct, {pct('count(*) FILTER (made AND ages <= 1)', 'count(*) FILTER (made)')} AS age_pct,
  {pct('count(*) FILTER (made AND genders <= 1)', 'count(*) FILTER (made)')} AS gender_pct, sum(inner_items)::BIGINT AS innerwear_items FROM bev""", "bev"))
def bundle_eval(spark, sf):
    return E.bundle_eval(T.queries(spark, sf), payload(spark, sf))


cte("abl", """SELECT * FROM (SELECT query_id, level, variant, item_id, score, row_number() OVER (PARTITION BY query_id, level, variant ORDER BY score DESC, fused DESC, item_id) AS rank FROM (
  SELECT query_id, level, item_id, fused, variant, CAST(round(CAST(score + w * f_quality AS DECIMAL(18, 10)), 6) AS DOUBLE) AS score FROM kept1,
    (SELECT unnest(['q0.05', 'q0.00']) AS variant, unnest([0.05, 0.0])::DOUBLE AS w))) WHERE rank <= 5""", "kept1")


def ablation(spark, sf):
    kept = K.collapse_duplicates(scored(spark, sf).filter("passes"))
    base = kept.withColumn("score_no_quality", F.col("score"))
    return E.weight_ablation(base, {"quality": F.col("f_quality")}, [0.05, 0.0])


@query("weight_ablation", sql("SELECT query_id, level, variant, item_id, score, rank FROM abl", "abl"))
def weight_ablation(spark, sf):
    return T.answered(spark, sf, ablation(spark, sf).select("query_id", "level", "variant", "item_id", "score", F.col("rank").cast("bigint").alias("rank")))


@query("ablation_diff", sql("""SELECT query_id, level, a.l <> b.l AS changed FROM (SELECT query_id, level, array_to_string(list(item_id ORDER BY rank), ',') AS l FROM abl WHERE variant = 'q0.05' GROUP BY ALL) a
  JOIN (SELECT query_id, level, array_to_string(list(item_id ORDER BY rank), ',') AS l FROM abl WHERE variant = 'q0.00' GROUP BY ALL) b USING (query_id, level)""", "abl"))
def ablation_diff(spark, sf):
    a = ablation(spark, sf)
    return T.answered(spark, sf, J.ablation_diff(a.filter("variant = 'q0.05'"), a.filter("variant = 'q0.00'")).select("query_id", "level", "changed"))


@query("pool_sweep", sql("""SELECT query_id, level, count(*) AS retrieved, count(*) FILTER (passes) AS survivors,
  round(coalesce(count(*) FILTER (passes AND i <= 10 AND (len(q_slots) = 0 OR slot = q_slots[1]))::DOUBLE / nullif(count(*) FILTER (passes AND i <= 10), 0), 0.0), 6) AS slot_precision
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, level ORDER BY passes DESC, fused DESC, item_id) AS i FROM scored) GROUP BY ALL""", "scored"))
def pool_sweep(spark, sf):
    return T.answered(spark, sf, E.pool_sweep(scored(spark, sf)))


# calibration: best similarity per query; a query counts as irrelevant when nothing it names was found
cte("calib", """SELECT query_id, CASE WHEN bool_or(rel) THEN 'relevant' ELSE 'irrelevant' END AS grp, round(max(sim), 6) AS best_sim FROM evalr GROUP BY query_id""", "evalr")


def calibration(spark, sf):
    r = results(spark, sf).withColumn("_rel", E.is_relevant())
    return r.groupBy("query_id").agg(
        F.when(F.bool_or("_rel"), "relevant").otherwise("irrelevant").alias("grp"),
        F.round(F.max("sim"), 6).alias("best_sim"))


@query("similarity_calibration", sql("""SELECT grp, count(*) AS n, round(min(best_sim), 6) AS min_sim, CAST(round(CAST(quantile_cont(best_sim, 0.05) AS DECIMAL(18, 10)), 6) AS DOUBLE) AS p5, CAST(round(CAST(quantile_cont(best_sim, 0.5) AS DECIMAL(18, 10)), 6) AS DOUBLE) AS median, round(max(best_sim), 6) AS max_sim,
  (SELECT CAST(round(CAST(quantile_cont(best_sim, 0.05) AS DECIMAL(18, 10)), 4) AS DOUBLE) FROM calib WHERE grp = 'relevant') AS threshold,
  coalesce((SELECT min(best_sim) FROM calib WHERE grp = 'relevant') > (SELECT max(best_sim) FROM calib WHERE grp = 'irrelevant'), false) AS separable FROM calib GROUP BY grp""", "calib"))
def similarity_calibration(spark, sf):
    return E.similarity_calibration(calibration(spark, sf))


@query("unflagged_share", sql(f"""SELECT count(*) AS n, count(*) FILTER (best_sim >= t) AS unflagged, {pct('count(*) FILTER (best_sim >= t)', 'count(*)')} AS unflagged_pct
  FROM calib, (SELECT CAST(round(CAST(quantile_cont(best_sim, 0.05) AS DECIMAL(18, 10)), 4) AS DOUBLE) AS t FROM calib WHERE grp = 'relevant') WHERE grp = 'irrelevant'""", "calib"))
def unflagged_share(spark, sf):
    c = calibration(spark, sf)
    t = E.similarity_calibration(c).agg(F.max("threshold")).scalar()
    return E.unflagged_share(c, t)


@query("overlap_pairs", "SELECT e.event_id, (SELECT count(*) FROM events i WHERE i.event_type = 'error' AND i.value >= e.value) AS n_overlaps FROM events e WHERE e.event_type = 'purchase'")
def overlap_pairs(spark, sf):
    """Scores of two event groups stand in for relevant and irrelevant similarities."""
    e = T.table(spark, sf, "events").select("event_id", "event_type", F.col("value").alias("score"))
    return J.overlap_pairs(e.filter("event_type = 'purchase'"), e.filter("event_type = 'error'")).select("event_id", "n_overlaps")


# result lists per (source, language): a source is an intent, its longest documents the results
cte("lists", """SELECT source, lang, list(doc_id ORDER BY rank) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS rank FROM
  (SELECT doc_id % 40 AS doc_id, source, lang, max(n_chars) AS n_chars FROM documents GROUP BY ALL)) WHERE rank <= 5 GROUP BY ALL""")


def lists(spark, sf):
    d = T.table(spark, sf, "documents").groupBy((F.col("doc_id") % 40).alias("item_id"), F.col("source").alias("intent_id"), F.col("lang").alias("language")).agg(
        F.max("n_chars").alias("score"))
    from pyspark.sql import Window

    w = Window.partitionBy("intent_id", "language").orderBy(F.col("score").desc(), "item_id")
    return J.result_sets(d.withColumn("rank", F.row_number().over(w)))


_lp = "SELECT a.source AS intent_id, a.lang AS lang_a, b.lang AS lang_b, a.ids AS x, b.ids AS y FROM lists a JOIN lists b ON a.source = b.source AND a.lang < b.lang"


@query("language_pairs", sql(f"SELECT intent_id, lang_a, lang_b, len(list_intersect(x, y)) AS shared FROM ({_lp})", "lists"))
def language_pairs(spark, sf):
    p = J.language_pairs(lists(spark, sf))
    return p.select("intent_id", "lang_a", "lang_b", F.size(F.array_intersect("ids_a", "ids_b")).cast("bigint").alias("shared"))


@query("topk_jaccard", sql(f"SELECT intent_id, round(avg(j), 6) AS mean_jaccard FROM (SELECT intent_id, round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 6) AS j FROM ({_lp})) GROUP BY intent_id", "lists"))
def topk_jaccard(spark, sf):
    j = J.topk_jaccard(J.language_pairs(lists(spark, sf)))
    return j.groupBy("intent_id").agg(F.round(F.avg("jaccard"), 6).alias("mean_jaccard"))


cte("spec", "SELECT query_id, CASE WHEN len(slots) > 0 THEN slots[1] END AS want_slot, gender AS want_gender, max_price AS budget FROM parsed", "parsed")
cte("specr", """SELECT query_id, 'after' AS variant, rank, title, slot, gender, price FROM wide WHERE rank <= 10 UNION ALL
  SELECT query_id, 'before_' || level, rank, title, slot, gender, price FROM (SELECT query_id, level, title, slot, gender, price, row_number() OVER (PARTITION BY query_id, level ORDER BY fused DESC, item_id) AS rank
  FROM cj) WHERE rank <= 10""", "wide", "cj")
_ok = "((want_slot IS NULL OR slot = want_slot) AND (want_gender IS NULL OR gender IN (want_gender, 'unisex')) AND (budget IS NULL OR coalesce(price, 0) <= budget) AND NOT regexp_matches(lower(title), 'costume|halloween|cosplay'))::INT"


@query("spec_relevance", sql(f"SELECT query_id, variant, " + ", ".join(f"round(avg({_ok}) FILTER (rank <= {k}), 6) AS rel_{k}" for k in (1, 5, 10)) + " FROM specr JOIN spec USING (query_id) GROUP BY ALL", "specr", "spec"))
def spec_relevance(spark, sf):
    from .ranking import cands_frame

    cols = ["query_id", "rank", "title", "slot", "gender", "price"]
    before = cands_frame(spark, sf).withColumn("score", F.col("fused"))
    before = T.answered(spark, sf, K.ranked(before, ("query_id", "level")).filter("rank <= 10").select(*cols, F.concat(F.lit("before_"), F.col("level").cast("string")).alias("variant")))
    after = results(spark, sf).select(*cols, F.lit("after").alias("variant"))
    specs = T.queries(spark, sf).select("query_id", F.get("slots", F.lit(0)).alias("want_slot"), F.col("gender").alias("want_gender"), F.col("max_price").alias("budget"))
    return J.spec_relevance(after.unionByName(before), specs)


# each live item's title asks the hybrid search at depth 10
cte("own", f"SELECT item_id AS query_id, 'raw' AS variant, {sql_clean('title')} AS text FROM alive", "alive")
hash_ctes("ownvec", "own", "query_id, variant", sql_tokens("text"))
cte("owntok", f"""SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest({sql_tokens('text')}) AS token FROM own) WHERE length(token) >= 3 AND token NOT IN ({_stop}) GROUP BY ALL""", "own")
cte("ownkeep", """SELECT t.* FROM owntok t WHERE query_id IN (SELECT query_id FROM owntok LEFT JOIN cidf USING (token) GROUP BY query_id
  HAVING sum(CASE WHEN df IS NOT NULL THEN qtf ELSE 0 END) / sum(qtf) >= 0.5)""", "owntok", "cidf")
cte("ownbm", sql_bm25("ownkeep", "cpost", "cidf", "cstat"), "ownkeep", "cpost", "cidf", "cstat")
cte("ownkw", sql_top("ownbm", 10), "ownbm")
cte("owndense", """SELECT query_id, item_id, rank FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM (
  SELECT query_id, item_id, round(list_inner_product(q.v, i.v), 6) AS score FROM ownvec q, ivec i)) WHERE rank <= 10""", "ownvec", "ivec")
cte("ownrank", """SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, item_id) AS rank FROM (
  SELECT query_id, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused FROM (SELECT query_id, item_id, rank FROM ownkw UNION ALL SELECT * FROM owndense) GROUP BY ALL)""", "ownkw", "owndense")


@query("self_retrieval", sql("""SELECT o.query_id, coalesce(rank, 0) AS found_rank, CASE WHEN rank = 1 THEN 'hit' WHEN rank > 1 THEN 'near_duplicate_title_or_size_variant' ELSE 'uncommon_tokens_or_vocabulary_mismatch' END AS cause
  FROM own o LEFT JOIN (SELECT * FROM ownrank WHERE query_id = item_id AND rank <= 10) USING (query_id)""", "own", "ownrank"))
def self_retrieval(spark, sf):
    """Every live item's cleaned title as a text query of the hybrid search."""
    return E.self_retrieval(*own_text_search(spark, sf)).select("query_id", F.col("found_rank").cast("bigint").alias("found_rank"), "cause")


def own_text_search(spark, sf, depth=10):
    """(targets, ranked results) of the hybrid search by the items' own titles."""
    live = V.live_items(T.items(spark, sf))
    own = T.kept(spark, sf, "own_titles", lambda: live.select(F.col("item_id").alias("query_id"), "item_id", clean_text(F.col("title")).alias("query")))
    vec = T.kept(spark, sf, "own_vectors", lambda: T.text_vectors(own, "query_id", "query")).withColumn("variant", F.lit("raw"))
    found = V.hybrid_candidates(own.select("query_id", "query", F.lit(None).cast("string").alias("normalized")), T.items(spark, sf).select("item_id", "search_text", "is_deleted"),
                                [depth], index=catalog_index(spark, sf), vectors=T.item_vectors(spark, sf), query_vectors=vec)
    return own.select("query_id", "item_id"), V.top_per_query(found, depth, score="fused")


# fixed values: gate names and what they require (gate, metric, comparison, required)
GATES = [("Zero Constraint Violations", "total_violations", "=", 0.0), ("Zero Kids Leakage", "kids_leakage", "=", 0.0), ("Zero Innerwear Leakage", "innerwear_leakage", "=", 0.0),
         ("Outfit Age Coherence", "age_pct", "=", 100.0), ("Outfit Gender Coherence", "gender_pct", "=", 100.0), ("Outfit Budget Compliance", "budget_pct", "=", 100.0),
         ("Zero English Violations", "english_violations", "=", 0.0), ("Degraded-Mode Violations (Non-Eng)", "degraded_violations", None, None),
         ("Outfits Composed", "n_composed", ">=", 1.0), ("Duplicate Rate", "dup_pct", "<=", 5.0), ("Query Coverage", "n_queries", None, None)]
_own = """SELECT *, coalesce(price > max_price, false)::INT + coalesce(price < min_price, false)::INT AS vp, coalesce(q_gender IN ('men', 'women') AND gender NOT IN (q_gender, 'unisex'), false)::INT AS vg,
  (coalesce(q_age_group = 'kids', false) AND age_group <> 'kids')::INT AS va, coalesce(q_slot <> slot, false)::INT AS vs FROM evalr WHERE rank <= 5"""
_values = ", ".join("(" + ", ".join("NULL" if v is None else lit(v) if isinstance(v, str) else str(v) for v in g) + ")" for g in GATES)


@query("gate_table", sql(f"""WITH v AS ({_own}), m AS (
  SELECT 'total_violations' AS metric, coalesce(sum(vp + vg + va + vs), 0)::DOUBLE AS measured FROM v
  UNION ALL SELECT 'english_violations', count(*) FILTER (vp + vg + va + vs > 0 AND language = 'en') FROM v UNION ALL SELECT 'degraded_violations', count(*) FILTER (vp + vg + va + vs > 0 AND language <> 'en') FROM v
  UNION ALL SELECT 'kids_leakage', count(*) FILTER (q_age_group IS DISTINCT FROM 'kids' AND age_group = 'kids') FROM v UNION ALL SELECT 'innerwear_leakage', count(*) FILTER (q_slot IS DISTINCT FROM 'innerwear' AND slot = 'innerwear') FROM v
  UNION ALL SELECT 'age_pct', {pct('count(*) FILTER (made AND ages <= 1)', 'count(*) FILTER (made)')} FROM bev UNION ALL SELECT 'gender_pct', {pct('count(*) FILTER (made AND genders <= 1)', 'count(*) FILTER (made)')} FROM bev
  UNION ALL SELECT 'budget_pct', {pct(f'count(*) FILTER ({_within})', 'count(*)')} FROM bev UNION ALL SELECT 'n_composed', count(*) FILTER (made) FROM bev UNION ALL SELECT 'n_queries', count(*) FROM bev
  UNION ALL SELECT 'dup_pct', {pct('sum(n - d)', 'sum(n)')} FROM (SELECT query_id, count(*) AS n, count(DISTINCT coalesce(store, 'None') || '::' || lower(title)) AS d FROM v GROUP BY query_id))
  SELECT gate, measured, required::DOUBLE AS required, CASE WHEN comparison IS NULL THEN 'INFO' WHEN (comparison = '=' AND measured = required) OR (comparison = '<=' AND measured <= required)
    OR (comparison = '>=' AND measured >= required) THEN 'PASS' ELSE 'FAIL' END AS status FROM (VALUES {_values}) g(gate, metric, comparison, required) LEFT JOIN m USING (metric)""", "evalr", "bev"))
def gate_table(spark, sf):
    r = results(spark, sf)
    gates = spark.createDataFrame(GATES, "gate string, metric string, comparison string, required double")
    return E.gate_table([E.constraint_violations(r), E.leakage(r), E.dup_rate(r).select("dup_pct"), E.bundle_eval(T.queries(spark, sf), payload(spark, sf))], gates)
