"""Filters, features, reranking, widening, results and bundles over the fused candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions import rules as R
from ...functions.text import explain_item as explain
from ...operators import bundles as B
from ...operators import ranking as K
from ...operators import retrieval as V
from ...operators.dedup import dealt
from ...operators.joins import met
from ...sources import tables as T
from ...functions.exprs import tidy as exprs_tidy
from .base import cte, has_any, lit, query, rx, sql, tidy, words_rx
from .intent import SQL_ARCHETYPE, guard
from .retrieval import candidates
from .text import sql_dedup

# ------------------------------------------------------------ candidate frame
cte("bounds", "SELECT coalesce(min(quality_bayes), 0.0) AS lo, CASE WHEN min(quality_bayes) IS NULL THEN 5.0 WHEN min(quality_bayes) = max(quality_bayes) THEN min(quality_bayes) + 1 ELSE max(quality_bayes) END AS hi FROM items WHERE NOT is_deleted", "items")
_QCOLS = "query AS q_query, norm AS q_norm, gender AS q_gender, age_group AS q_age, min_price AS q_min, max_price AS q_max, brand AS q_brand, colors AS q_colors, slots AS q_slots, season AS q_season, occasion AS q_occasion, xslot, xgender, warnings AS q_warnings, language AS q_lang"
cte("pq", f"SELECT query_id, {_QCOLS} FROM parsed", "parsed")
_KEEP = "i.item_id, i.title, i.store, i.price, i.gender, i.age_group, i.slot, i.accessory_type, i.colors, i.seasons, i.occasions, i.quality_bayes, i.search_text, i.eslots, i.eage"


def sql_joined(name: str, cands: str) -> None:
    cte(name, f"""SELECT c.query_id, c.level, c.fused, c.sim, CASE WHEN mx > 0 THEN mx ELSE 1 END AS max_fused, {_KEEP}, pq.* EXCLUDE (query_id)
  FROM (SELECT *, max(fused) OVER (PARTITION BY query_id, level) AS mx FROM {cands}) c JOIN eff i USING (item_id) JOIN pq USING (query_id)
  WHERE NOT i.is_deleted""", cands, "eff", "pq")


sql_joined("cj", "cands")
sql_joined("bj", "bcands")

_P = "(q_min IS NULL OR coalesce(price >= q_min, false)) AND (q_max IS NULL OR coalesce(price <= q_max, false))"
_G = "(q_gender IS NULL OR NOT xgender OR gender = 'unisex' OR (q_gender IN ('men', 'women') AND gender = q_gender))"
_A = "eage = q_age"
_S = "(len(q_slots) = 0 OR NOT xslot OR len(list_intersect(eslots, q_slots)) > 0)"
_asked = "(q_query || ' ' || q_norm)"
_I = f"(slot <> 'innerwear' OR list_contains(q_slots, 'innerwear') OR {rx(_asked, words_rx(R.INNERWEAR_KEYWORDS))})"
_meta = "(title || ' ' || search_text)"
_E = (f"CASE WHEN slot <> 'unknown' THEN NOT {rx('title', R.CPR)} OR {rx(_asked, R.CPR_QUERY)} "
      f"ELSE NOT {rx(_meta, R.PERIPHERAL_ITEM)} OR {rx(_asked, R.PERIPHERAL_QUERY)} END")


def found_items(items: DataFrame, found: DataFrame) -> DataFrame:
    """Items that a list may name: of the catalog, only these texts move to meet their candidates."""
    return met(items, "item_id", found.select("item_id")).filter("met").drop("met")


def cands_frame(spark, sf, levels=None, name="cands") -> DataFrame:
    """Candidates joined to live items and their query, with the pool maximum taken before the join."""
    def build():
        stored = candidates(spark, sf, levels, name)
        c = K.normalize_fused(stored).select("query_id", "level", "item_id", "fused", "sim", "max_fused", "norm_fused")
        items = T.items(spark, sf).drop("seq", "features", "description", "review_snippets", "image_url", "average_rating", "rating_number", "version")
        return K.candidate_join(dealt(c, "item_id"), found_items(items, stored), T.asked(spark, sf))
    return T.kept(spark, sf, name + "_joined", build)


@query("candidate_join", sql("SELECT query_id, level, item_id, title, fused, sim FROM cj", "cj"))
def candidate_join(spark, sf):
    return T.answered(spark, sf, cands_frame(spark, sf).select("query_id", "level", "item_id", "title", "fused", "sim"))


def _flag(name: str, sql_expr: str, column):
    @query(name, sql(f"SELECT query_id, level, item_id, {sql_expr} AS ok FROM cj", "cj"))
    def run(spark, sf):
        return T.answered(spark, sf, cands_frame(spark, sf).select("query_id", "level", "item_id", column().alias("ok")))
    return run


_flag("filter_price", _P, K.filter_price)
_flag("filter_gender", _G, K.filter_gender)
_flag("filter_age", _A, K.filter_age)
_flag("filter_slot", _S, K.filter_slot)
_flag("innerwear_policy", _I, K.innerwear_ok)
_flag("eligibility_guard", _E, K.eligible)


@query("strict_filters", sql(f"SELECT query_id, level, count_if({_P} AND {_G} AND {_A} AND {_S}) ::BIGINT AS survivors, count_if(NOT ({_P} AND {_G} AND {_A} AND {_S}))::BIGINT AS excluded FROM cj GROUP BY ALL", "cj"))
def strict_filters(spark, sf):
    return T.answered(spark, sf, K.strict_filters(cands_frame(spark, sf)).groupBy("query_id", "level").agg(
        F.count_if("passes").alias("survivors"), F.count_if(~F.col("passes")).alias("excluded")))


@query("normalize_fused", sql("SELECT query_id, level, item_id, round(fused / max_fused, 6) AS share FROM cj", "cj"))
def normalize_fused(spark, sf):
    return T.answered(spark, sf, cands_frame(spark, sf).select("query_id", "level", "item_id", F.round("norm_fused", 6).alias("share")))


@query("quality_bounds", sql("SELECT lo AS min_q, hi AS max_q FROM bounds", "bounds"))
def quality_bounds(spark, sf):
    return K.quality_bounds(T.items(spark, sf))


_b = "lower(trim(q_brand))"


def _has_word(text: str) -> str:
    return f"regexp_matches({text}, '\\b' || regexp_escape({_b}) || '\\b')"


_store, _title = "lower(trim(coalesce(store, '')))", "lower(trim(title))"


def sql_boost(qn: str, w: str = "0.05") -> str:
    return f"""({w} * ({qn}) + CASE WHEN list_contains(seasons, q_season) THEN 0.05 ELSE 0 END + CASE WHEN list_contains(occasions, q_occasion) THEN 0.05 ELSE 0 END
  + CASE WHEN len(list_intersect(colors, q_colors)) > 0 THEN 0.03 ELSE 0 END
  + CASE WHEN coalesce({_b}, '') = '' THEN 0 WHEN starts_with({_store}, {_b}) OR starts_with({_title}, {_b}) THEN 0.05
    WHEN {_has_word(_store)} OR {_has_word(_title)} THEN 0.04 ELSE 0 END)::DOUBLE"""


_QN = "(quality_bayes - lo) / greatest(hi - lo, 1e-6)"


@query("soft_boost", sql(f"SELECT query_id, level, item_id, round({sql_boost(_QN)}, 6) AS boost FROM cj, bounds", "cj", "bounds"))
def soft_boost(spark, sf):
    b = K.quality_bounds(T.items(spark, sf))
    lo, hi = b.select("min_q").scalar(), b.select("max_q").scalar()
    qn = (F.col("quality_bayes") - lo) / F.greatest(hi - lo, F.lit(1e-6))
    return T.answered(spark, sf, cands_frame(spark, sf).select("query_id", "level", "item_id", F.round(K.soft_boost(qn), 6).alias("boost")))


# -------------------------------------------------------------------- features
_ql, _tl = "lower(q_query)", "lower(title)"
_pq = f"trim(regexp_replace({_ql}, {lit(R.BUDGET_PHRASE)}, '', 'g'))"
_words = f"list_filter(regexp_extract_all({_pq}, '[\\pL\\pN_]+'), lambda w: length(w) > 2)"
cte("qphrase", f"SELECT query_id, {_pq} AS pq, {_words} AS ws FROM pq", "pq")
_color_case = "CASE c " + " ".join(
    "WHEN {n} THEN CASE WHEN len(list_intersect(colors, {f})) > 0 THEN 1.0 WHEN {t} THEN 0.95 WHEN len(list_intersect(colors, {o})) > 0 THEN 0.05 ELSE 0.1 END".format(
        n=lit(n), f=f, t=rx("title", words_rx(f)), o=sorted({x for m, g in R.COLOR_FAMILIES.items() if m != n for x in g}))
    for n, f in R.COLOR_FAMILIES.items())
_all_fam = sorted({x for g in R.COLOR_FAMILIES.values() for x in g})
_color_case += f" ELSE CASE WHEN list_contains(colors, c) THEN 1.0 WHEN regexp_matches({_tl}, '\\b' || c || '\\b') THEN 0.95 WHEN len(list_intersect(colors, {_all_fam})) > 0 THEN 0.05 ELSE 0.1 END END"
_cs = f"list_transform(q_colors, lambda c: ({_color_case})::DOUBLE)"
SQL_FEATURES = {
    "semantic": "greatest(0, least(1, (sim - 0.20) / 0.65))",
    "lexical": "fused / max_fused",
    "phrase": f"""CASE WHEN pq <> '' AND contains({_tl}, pq) THEN 1.0 WHEN len(ws) >= 2 THEN least(0.8,
      len(list_filter(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]), lambda p: contains({_tl}, p)))::DOUBLE / (len(ws) - 1) * 0.8)
      WHEN len(ws) = 1 AND contains({_tl}, ws[1]) THEN 0.5 ELSE 0 END""",
    "slot": f"""CASE WHEN len(q_slots) > 0 THEN CASE WHEN list_contains(q_slots, slot) THEN 1.0 ELSE 0.1 END
      WHEN {has_any(_ql, ['outfit', 'suit', 'attire'])} THEN CASE WHEN slot IN ('top', 'bottom', 'full_body') THEN 1.0 WHEN slot = 'accessory' THEN 0.1 ELSE 0.5 END
      WHEN (contains({_ql}, 'dress') AND slot = 'full_body') OR ({has_any(_ql, ['shoes', 'footwear', 'boots'])} AND slot = 'footwear')
        OR ({has_any(_ql, ['jacket', 'coat', 'blazer'])} AND slot = 'top') THEN 1.0 ELSE 0.5 END""",
    "color": f"CASE WHEN len(q_colors) = 0 THEN 1.0 ELSE coalesce(list_filter({_cs}, lambda s: s > 0.5)[1], CASE WHEN list_contains({_cs}, 0.05) THEN 0.05 ELSE 0.1 END) END",
    "demographic": "CASE WHEN q_gender IS NULL OR gender = q_gender THEN 1.0 WHEN gender = 'unisex' THEN 0.8 WHEN gender = 'unknown' THEN 0.5 ELSE 0 END",
    "occasion": f"""CASE WHEN q_occasion IS NULL THEN CASE WHEN {has_any(_ql, R.DRESSY_QUERY)} AND {has_any(_tl, R.DRESSY_TITLE)} THEN 1.0 ELSE 0.5 END
      WHEN list_contains(occasions, q_occasion) OR contains({_tl}, q_occasion) THEN 1.0
      {' '.join(f"WHEN q_occasion = '{n}' AND {has_any(_tl, w)} THEN {s}" for n, w, s in R.OCCASION_CUES)} ELSE 0.2 END""",
    "quality": "greatest(0, least(1, (CASE WHEN coalesce(quality_bayes, 0) = 0 THEN 4.0 ELSE quality_bayes END) / 5.0))",
    "price": "CASE WHEN coalesce(q_max, 0) = 0 OR coalesce(price, 0) = 0 THEN 1.0 WHEN price / q_max <= 1 THEN greatest(0, 0.7 + 0.3 * (1 - price / q_max)) ELSE 0 END",
    "costume": f"CASE WHEN NOT {has_any(_ql, R.COSTUME_QUERY_WORDS)} AND {rx('title', R.COSTUME)} THEN 0.35 ELSE 0 END",
}
for _n, _fn in [("semantic", K.feat_semantic), ("lexical", K.feat_lexical), ("phrase", K.feat_phrase), ("slot", K.feat_slot), ("color", K.feat_color),
                ("demographic", K.feat_demographic), ("occasion", K.feat_occasion), ("quality", K.feat_quality), ("price", K.feat_price), ("costume", K.feat_costume)]:
    def _make(name=_n, fn=_fn):
        @query("feat_" + name, sql(f"SELECT query_id, level, item_id, {tidy(SQL_FEATURES[name], 6)} AS f FROM cj JOIN qphrase USING (query_id)", "cj", "qphrase"))
        def run(spark, sf):
            return T.answered(spark, sf, cands_frame(spark, sf).select("query_id", "level", "item_id", exprs_tidy(fn(), 6).alias("f")))
    _make()


def sql_score(lexical: str, feats: dict[str, str]) -> str:
    by = {n: "(" + " + ".join(f"{w}::DOUBLE * ({lexical if f == 'lexical' else feats[f]})::DOUBLE" for f, w in zip(R.FEATURES, ws, strict=True)) + ")" for n, ws in R.ARCHETYPE_WEIGHTS.items()}
    return tidy("greatest(0, least(1, (CASE archetype " + " ".join(f"WHEN '{n}' THEN {e}" for n, e in by.items()) + f" END) - ({feats['costume']})))", 6)


cte("qarch", f"SELECT query_id, {SQL_ARCHETYPE} AS archetype FROM parsed", "parsed")
_fcols = ", ".join(f"({e})::DOUBLE AS f_{n}" for n, e in SQL_FEATURES.items())
_fnames = {n: f"f_{n}" for n in SQL_FEATURES}
cte("scored0", f"""SELECT *, {_fcols}, {_P} AND {_G} AND {_A} AND {_S} AND {_I} AND {_E} AS passes, fused / max_fused + {sql_boost(_QN)} AS pool_score
  FROM cj JOIN qphrase USING (query_id) JOIN qarch USING (query_id), bounds""", "cj", "qphrase", "qarch", "bounds")
cte("scored", f"SELECT *, {sql_score('f_lexical', _fnames)} AS score, {sql_score('pool_score / max_fused', _fnames)} AS served_score, {sql_dedup()} AS dkey FROM scored0", "scored0")


def scored(spark, sf, as_served=False) -> DataFrame:
    def build():
        c = cands_frame(spark, sf)
        out = K.score_pools(c, K.quality_bounds(T.items(spark, sf)), as_served=as_served)
        return out.select("query_id", "level", "item_id", "fused", "sim", "passes", "score", "pool_score", "archetype", "f_quality", "title", "price",
                          "store", "slot", "gender", "age_group", "colors", "seasons", "occasions", "q_query", "q_brand", "q_colors", "q_season",
                          "q_occasion", "q_slots", "q_gender", "q_age_group", "q_min_price", "q_max_price", "q_language")
    return T.kept(spark, sf, f"scored{as_served}", build)


_ORD = "score DESC, fused DESC, item_id"


@query("rerank", sql(f"SELECT query_id, level, item_id, score, row_number() OVER (PARTITION BY query_id, level ORDER BY {_ORD}) AS rank FROM scored WHERE passes", "scored"))
def rerank(spark, sf):
    out = K.ranked(scored(spark, sf).filter("passes"), ("query_id", "level"))
    return T.answered(spark, sf, out.select("query_id", "level", "item_id", "score", F.col("rank").cast("bigint").alias("rank")))


@query("rerank_as_served", sql("SELECT query_id, level, item_id, served_score AS score FROM scored WHERE passes", "scored"))
def rerank_as_served(spark, sf):
    """The ranking as the served code computes it, where the lexical feature saturates."""
    return T.answered(spark, sf, scored(spark, sf, True).filter("passes").select("query_id", "level", "item_id", "score"))


cte("kept1", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, level, dkey ORDER BY {_ORD}) AS copy FROM scored WHERE passes) WHERE copy = 1""", "scored")


@query("collapse_duplicates", sql("SELECT query_id, level, item_id FROM kept1", "kept1"))
def collapse_duplicates(spark, sf):
    return T.answered(spark, sf, K.collapse_duplicates(scored(spark, sf).filter("passes")).select("query_id", "level", "item_id"))


cte("external", f"SELECT *, row_number() OVER (PARTITION BY query_id, level ORDER BY {_ORD}) AS rank, (length(title) % 7 + 0.5 * coalesce(price, 0))::DOUBLE AS ext FROM kept1", "kept1")


@query("blend_scores", sql("""SELECT query_id, level, item_id, CAST(round(CAST(CASE WHEN rank <= 20 THEN 0.65 * score + 0.35 * (ext - xlo) / greatest(xhi - xlo, 1e-6) ELSE score END AS DECIMAL(18, 10)), 6) AS DOUBLE) AS blended
  FROM (SELECT *, min(CASE WHEN rank <= 20 THEN ext END) OVER (PARTITION BY query_id, level) AS xlo, max(CASE WHEN rank <= 20 THEN ext END) OVER (PARTITION BY query_id, level) AS xhi FROM external)""", "external"))
def blend_scores(spark, sf):
    rows = K.collapse_duplicates(scored(spark, sf).filter("passes"))
    ext = rows.withColumn("external", F.length("title") % 7 + 0.5 * F.coalesce("price", F.lit(0.0)))
    keys = ("query_id", "level")
    return T.answered(spark, sf, K.blend_scores(K.ranked(ext, keys), keys=keys).select("query_id", "level", "item_id", "blended"))


cte("pools", "SELECT query_id, level, count(*) AS pool_size, count_if(NOT passes)::BIGINT AS excluded FROM scored GROUP BY ALL", "scored")
cte("psize", "SELECT query_id, level, count(*) AS kept FROM kept1 GROUP BY ALL", "kept1")
cte("chosen", """SELECT query_id, coalesce(min(CASE WHEN kept >= 10 THEN level END), max(level)) AS level FROM pools LEFT JOIN psize USING (query_id, level) GROUP BY query_id""", "pools", "psize")
cte("wide", f"""SELECT k.*, p.pool_size, p.excluded, p.pool_size - p.excluded - s.kept AS collapsed, row_number() OVER (PARTITION BY query_id ORDER BY {_ORD}) AS rank
  FROM kept1 k JOIN chosen USING (query_id, level) JOIN pools p USING (query_id, level) JOIN psize s USING (query_id, level)""", "kept1", "chosen", "pools", "psize")


def widened(spark, sf, as_served=False) -> DataFrame:
    return T.kept(spark, sf, f"wide{as_served}", lambda: K.progressive_widening(scored(spark, sf, as_served)))


@query("progressive_widening", sql("SELECT query_id, level, item_id, score, rank, pool_size, excluded, collapsed FROM wide", "wide"))
def progressive_widening(spark, sf):
    return T.answered(spark, sf, widened(spark, sf).select("query_id", "level", "item_id", "score", F.col("rank").cast("bigint").alias("rank"), "pool_size", "excluded", "collapsed"))


def sql_reason(role: str = "NULL", colors: str = "colors", q_colors: str = "q_colors") -> str:
    shared = f"list_filter({q_colors}, lambda c: list_contains({colors}, c))"
    facts = f"""concat_ws(' | ', CASE WHEN {role} IS NOT NULL THEN 'Chosen as ' || {role} END,
      CASE WHEN contains(lower(store), lower(q_brand)) THEN 'Matches brand ' || store WHEN contains(lower(title), lower(q_brand)) THEN 'Features brand ' || q_brand END,
      CASE WHEN len({shared}) > 0 THEN 'Matching color: ' || array_to_string({shared}, ', ') END,
      CASE WHEN list_contains(seasons, q_season) THEN 'Suited for ' || q_season END, CASE WHEN list_contains(occasions, q_occasion) THEN 'Ideal for ' || q_occasion END)"""
    word = f"list_filter(regexp_extract_all({_ql}, '[\\pL\\pN_]{{4,}}'), lambda w: contains({_tl}, w))[1]"
    return f"CASE WHEN {facts} <> '' THEN {facts} WHEN {word} IS NOT NULL THEN 'Matched keyword: ' || {word} ELSE 'High semantic relevance to query' END"


cte("top10", f"SELECT query_id, rank, item_id, title, price, store, slot, gender, age_group, {tidy('score', 4)} AS score, {tidy('sim', 4)} AS similarity, {sql_reason()} AS reason FROM wide WHERE rank <= 10", "wide")


@query("topk_results", sql("SELECT * FROM top10", "top10"))
def topk_results(spark, sf):
    return T.answered(spark, sf, K.topk_results(widened(spark, sf)).withColumn("rank", F.col("rank").cast("bigint")))


@query("explain_item", sql(f"SELECT query_id, item_id, {sql_reason('slot')} AS reason FROM wide", "wide"))
def explain_item(spark, sf):
    r = explain(F.col("title"), F.col("store"), F.col("colors"), F.col("seasons"), F.col("occasions"), F.col("q_query"), F.col("q_brand"),
                F.col("q_colors"), F.col("q_season"), F.col("q_occasion"), F.col("slot"))
    return T.answered(spark, sf, widened(spark, sf).select("query_id", "item_id", r.alias("reason")))


@query("low_confidence", sql("SELECT query_id, max(sim) AS best_sim, max(sim) < 0.6191 AS low_confidence FROM wide WHERE rank <= 10 GROUP BY query_id", "wide"))
def low_confidence(spark, sf):
    return T.answered(spark, sf, K.low_confidence(widened(spark, sf).filter("rank <= 10")))


# every fifth query comes parsed from outside, some of those with the verdict that they are about something else
_OUTSIDE, _OTHER = "s_suppkey % 5 = 0", "s_suppkey % 15 = 0"


def sql_meta(policy: str) -> str:
    refused = "degraded" if policy == "refuse" else "false"
    return f"""SELECT query_id, '{policy}' AS policy, CASE WHEN searched THEN coalesce(wx, cx, 0) ELSE 0 END::BIGINT AS excluded, CASE WHEN searched THEN coalesce(wc, cc, 0) ELSE 0 END::BIGINT AS collapsed,
  CASE WHEN searched THEN coalesce(wp, cp, 0) ELSE 0 END::BIGINT AS pool_size, n AS n_results, low AS low_confidence, used_fallback,
  array_to_string(list_distinct_kept, ',') AS warnings,
  CASE WHEN refused THEN 'llm_unavailable_for_non_english_query' WHEN NOT fashion THEN 'not_a_fashion_query'
    WHEN n = 0 AND (NOT searched OR coalesce(wx, cx, 0) = 0) THEN 'no_good_match' END AS message,
  CASE WHEN n = 0 AND NOT refused THEN {lit('|'.join(R.SUGGESTED_QUERIES))} ELSE '' END AS suggested
FROM (SELECT *, list_filter(list_concat(own, [
    CASE WHEN degraded AND NOT list_contains(own, 'filters_not_applied_without_llm') THEN 'filters_not_applied_without_llm' END,
    CASE WHEN searched AND skip THEN 'keyword_search_skipped' END, CASE WHEN searched AND low AND used_fallback THEN 'low_confidence_results' END]), lambda x: x IS NOT NULL) AS list_distinct_kept
  FROM (SELECT *, CASE WHEN degraded AND (searched OR refused) THEN true ELSE searched AND coalesce(best_sim < 0.6191, false) END AS low,
      CASE WHEN searched THEN coalesce(n_results, 0) ELSE 0 END::BIGINT AS n
    FROM (SELECT *, {refused} AS refused, NOT {refused} AND fashion AS searched FROM meta0)))"""


cte("meta0", f"""SELECT p.query_id, NOT ({_OUTSIDE}) AS used_fallback, NOT ({_OTHER}) AS fashion, g.skip_keyword AS skip, g2.skip_keyword AND NOT ({_OUTSIDE}) AS degraded,
    list_filter(string_split(p.warnings, ','), lambda x: x <> '') AS own, w.n_results, w.best_sim, w.excluded AS wx, w.collapsed AS wc, w.pool_size AS wp,
    c.excluded AS cx, c.pool_size - c.excluded - coalesce(c.kept, 0) AS cc, c.pool_size AS cp
  FROM parsed p LEFT JOIN (SELECT query_id, any_value(excluded) AS excluded, any_value(pool_size) AS pool_size, any_value(collapsed) AS collapsed,
    count_if(rank <= 10)::BIGINT AS n_results, max(CASE WHEN rank <= 10 THEN sim END) AS best_sim FROM wide GROUP BY query_id) w USING (query_id)
  LEFT JOIN (SELECT * FROM pools JOIN chosen USING (query_id, level) LEFT JOIN psize USING (query_id, level)) c USING (query_id)
  JOIN guard_raw g2 USING (query_id) JOIN guard g USING (query_id)""", "parsed", "wide", "pools", "chosen", "psize", "guard_raw", "guard")


@query("search_meta", sql(sql_meta("warn") + " UNION ALL " + sql_meta("refuse"), "meta0"))
def search_meta(spark, sf):
    """All columns, under both policies."""
    pools = T.answered(spark, sf, K.pool_counts(scored(spark, sf)))
    top = T.answered(spark, sf, widened(spark, sf).filter("rank <= 10").select("query_id", "rank", "sim"))
    g = guard(spark, sf).join(guard(spark, sf, "query").select("query_id", F.col("skip_keyword").alias("degraded")), "query_id")
    q = T.queries(spark, sf).withColumn("used_fallback", ~F.expr(_OUTSIDE)).withColumn("is_fashion_query", ~F.expr(_OTHER))
    out = None
    for policy in ("warn", "refuse"):
        part = K.search_meta(q, top, pools, g, policy=policy).select(
            "query_id", F.lit(policy).alias("policy"), *[F.col(c).cast("long").alias(c) for c in ("excluded", "collapsed", "pool_size", "n_results")], "low_confidence", "used_fallback",
            F.array_join("warnings", ",").alias("warnings"), "message", F.array_join("suggested_queries", "|").alias("suggested"))
        out = part if out is None else out.unionByName(part)
    return out


@query("facet_slots", sql("SELECT query_id, slot, count(*) AS n FROM top10 WHERE slot NOT IN ('', 'unknown') GROUP BY ALL", "top10"))
def facet_slots(spark, sf):
    return T.answered(spark, sf, K.facet_slots(K.topk_results(widened(spark, sf))))


@query("result_sort", sql("""SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY price ASC NULLS LAST, item_id) AS by_price_asc,
  row_number() OVER (PARTITION BY query_id ORDER BY price DESC NULLS LAST, item_id) AS by_price_desc,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS by_relevance FROM top10""", "top10"))
def result_sort(spark, sf):
    out = K.topk_results(widened(spark, sf)).select("query_id", "item_id", "price", "score", "slot")
    for mode in ("price_asc", "price_desc", "relevance"):
        out = K.result_sort(out, mode).withColumn(f"by_{mode}", F.col("position").cast("bigint")).drop("position")
    return T.answered(spark, sf, out.drop("price", "score", "slot"))


@query("batch_filter_rank", sql(f"""SELECT query_id, level, item_id, score, row_number() OVER (PARTITION BY query_id, level ORDER BY {_ORD}) AS rank FROM (
  SELECT query_id, level, item_id, fused, {tidy(f"fused / mf + {sql_boost('0.0')}", 6)} AS score FROM (SELECT *, max(fused) OVER (PARTITION BY query_id, level) AS mf FROM cj)
  WHERE {_P} AND {_G} AND {_A} AND {_S})""", "cj"))
def batch_filter_rank(spark, sf):
    return T.answered(spark, sf, K.batch_filter_rank(cands_frame(spark, sf)).select("query_id", "level", "item_id", "score", F.col("rank").cast("bigint").alias("rank")))


@query("missing_ids", sql("SELECT DISTINCT item_id FROM cands WHERE level = 1000 AND item_id NOT IN (SELECT item_id FROM cands WHERE level = 50)", "cands"))
def missing_ids(spark, sf):
    c = candidates(spark, sf)
    return B.missing_ids(c.filter("level = 1000"), c.filter("level = 50").select("item_id").distinct())


# --------------------------------------------------------------------- bundles
_restrict = "CASE accessory_type " + " ".join(f"WHEN '{n}' THEN {rx(_asked, p)}" for n, p in R.RESTRICTED_ACCESSORIES) + " ELSE true END"
_bfeat = {n: e for n, e in SQL_FEATURES.items()} | {"slot": "1.0"}
cte("bs0", f"""SELECT *, slot AS pool_slot, {', '.join(f'({e})::DOUBLE AS f_{n}' for n, e in _bfeat.items())},
  CASE WHEN q_min IS NOT NULL OR q_max IS NOT NULL THEN 'BUDGET_EXPLICIT' ELSE 'EXPLICIT_PRODUCT' END AS archetype
  FROM bj JOIN qphrase USING (query_id) WHERE slot IN ('full_body', 'top', 'bottom', 'footwear', 'accessory') AND {_P} AND {_G} AND {_A}
  AND (NOT xslot OR list_contains(eslots, slot)) AND (price IS NULL OR price >= 2) AND sim >= 0.35 AND (slot <> 'accessory' OR {_restrict})""", "bj", "qphrase")
cte("bs", f"SELECT *, {sql_score('f_lexical', _fnames)} AS score, {sql_dedup()} AS dkey FROM bs0", "bs0")
cte("bpool", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, level, pool_slot ORDER BY {_ORD}) AS pool_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, level, pool_slot, dkey ORDER BY {_ORD}) AS copy FROM bs) WHERE copy = 1) WHERE pool_rank <= 8""", "bs")
_so = "list_position(['full_body', 'top', 'bottom', 'footwear', 'accessory'], pool_slot)"
cte("btarget", f"""SELECT query_id, level, coalesce(any_value(q_gender), arg_max(gender, key) FILTER (gender IN ('men', 'women')), 'unisex') AS target
  FROM (SELECT *, {{'a': score, 'b': -{_so}, 'c': -pool_rank}} AS key FROM bpool) GROUP BY ALL""", "bpool")
cte("bcoh", "SELECT p.*, t.target FROM bpool p JOIN btarget t USING (query_id, level) WHERE age_group = q_age AND (gender = 'unisex' OR (target IN ('men', 'women') AND gender = target))", "bpool", "btarget")


def pools(spark, sf) -> DataFrame:
    def build():
        p = B.slot_pools(cands_frame(spark, sf, R.BUNDLE_DEPTHS, "bcands"), K.quality_bounds(T.items(spark, sf)))
        return p.select("query_id", "level", "pool_slot", "pool_rank", "item_id", "title", "store", "price", "slot", "gender", "age_group", "score", "sim",
                        "colors", "seasons", "occasions", "q_gender", "q_age_group", "q_max_price")
    return T.kept(spark, sf, "pools", build)


@query("accessory_allowed", sql(f"SELECT query_id, level, item_id, {_restrict} AS allowed FROM cj", "cj"))
def accessory_allowed(spark, sf):
    asked = F.concat_ws(" ", "q_query", "q_normalized_query_en")
    return T.answered(spark, sf, cands_frame(spark, sf).select("query_id", "level", "item_id", B.accessory_allowed(F.col("accessory_type"), asked).alias("allowed")))


@query("bundle_floors", sql("SELECT query_id, level, item_id, (price IS NULL OR price >= 2) AND sim >= 0.35 AS ok FROM cj", "cj"))
def bundle_floors(spark, sf):
    return T.answered(spark, sf, cands_frame(spark, sf).select("query_id", "level", "item_id", B.bundle_floors().alias("ok")))


@query("slot_pools", sql("SELECT query_id, level, pool_slot, item_id, score, pool_rank FROM bpool", "bpool"))
def slot_pools(spark, sf):
    return T.answered(spark, sf, pools(spark, sf).select("query_id", "level", "pool_slot", "item_id", "score", F.col("pool_rank").cast("bigint").alias("pool_rank")))


@query("target_gender", sql("SELECT query_id, level, target FROM btarget", "btarget"))
def target_gender(spark, sf):
    return T.answered(spark, sf, B.target_gender(pools(spark, sf)))


def coherent(spark, sf) -> DataFrame:
    return T.kept(spark, sf, "coherent", lambda: B.coherence_filter(pools(spark, sf), B.target_gender(pools(spark, sf))))


@query("coherence_filter", sql("SELECT query_id, level, item_id FROM bcoh", "bcoh"))
def coherence_filter(spark, sf):
    return T.answered(spark, sf, coherent(spark, sf).select("query_id", "level", "item_id"))


# combinations, in the checking engine by plain joins
cte("bi", """SELECT query_id, level, pool_slot, item_id, price, gender, age_group, score, pool_rank, q_max AS budget,
  {'id': item_id, 'title': lower(title), 'occ': occasions, 'sea': seasons, 'score': score, 'pr': pool_rank, 'price': price} AS it,
  CASE WHEN gender NOT IN ('unisex', 'unknown') THEN gender END AS g, coalesce(price, 0) AS p FROM bcoh""", "bcoh")
cte("bpair", """SELECT DISTINCT a.query_id, a.item_id AS a, b.item_id AS b, round(list_inner_product(x.v, y.v), 6) AS s FROM
  (SELECT DISTINCT query_id, item_id, pool_slot FROM bi) a JOIN (SELECT DISTINCT query_id, item_id, pool_slot FROM bi) b ON a.query_id = b.query_id AND a.pool_slot <> b.pool_slot
  JOIN ivec x ON x.item_id = a.item_id JOIN ivec y ON y.item_id = b.item_id""", "bi", "ivec")


def sql_combo(name: str, slots: list[str]) -> None:
    al = "abcd"[:len(slots)]
    frm = "bi a" + "".join(f" JOIN bi {x} ON {x}.query_id = a.query_id AND {x}.level = a.level" for x in al[1:])
    where = " AND ".join(f"{x}.pool_slot = '{s}'" for x, s in zip(al, slots, strict=True))
    gs = ", ".join(f"{x}.g" for x in al)
    prs = [(x, y) for i, x in enumerate(al) for y in al[i + 1:]]
    frm += "".join(f" JOIN bpair p{x}{y} ON p{x}{y}.query_id = a.query_id AND p{x}{y}.a = {x}.item_id AND p{x}{y}.b = {y}.item_id" for x, y in prs)
    cte(name, f"""SELECT a.query_id, a.level, [{', '.join(f'{x}.it' for x in al)}] AS items, {' + '.join(f'{x}.p' for x in al)} AS total,
    ({' + '.join(f'p{x}{y}.s' for x, y in prs)}) / {len(prs)} AS coh FROM {frm} WHERE {where}
    AND len(list_distinct(list_filter([{gs}], lambda x: x IS NOT NULL))) <= 1 AND {' AND '.join(f'{x}.age_group = a.age_group' for x in al)}
    AND (a.budget IS NULL OR {' + '.join(f'{x}.p' for x in al)} <= a.budget)""", "bi", "bpair")


_subsets = []
for _t, (_name, _full) in enumerate(R.BUNDLE_TEMPLATES, 1):
    for _s, _sl in enumerate([_full, [x for x in _full if x != "accessory"], [x for x in _full if x not in ("accessory", "footwear")]], 1):
        if len(_sl) >= 2:
            _subsets.append((_t, _name, _s, _sl))
for _t, _name, _s, _sl in _subsets:
    sql_combo(f"combo{_t}{_s}", _sl)
cte("combos", " UNION ALL ".join(f"SELECT *, '{n}' AS template, {t} AS template_rank, {s} AS subset_rank, {len(sl)} AS n_items FROM combo{t}{s}" for t, n, s, sl in _subsets),
    *[f"combo{t}{s}" for t, _n, s, _sl in _subsets])


def _sq_shared(tag: str) -> str:
    tags = f"flatten(list_transform(items, lambda i: i.{tag}))"
    return f"len(list_filter(list_distinct({tags}), lambda t: len(list_filter({tags}, lambda u: u = t)) >= 2))"


def _sq_has(cues: list[str], tag: str | None) -> str:
    test = has_any("i.title", cues) + (f" OR list_contains(i.occ, '{tag}')" if tag else "")
    return f"list_bool_or(list_transform(items, lambda i: {test}))"


_formal, _ath, _nov = _sq_has(R.FORMAL_CUES, "formal"), _sq_has(R.ATHLETIC_CUES, "workout"), _sq_has(R.NOVELTY_CUES, None)
cte("cs0", f"""SELECT *, {tidy('coh', 6)} AS cohesion, (0.25 * {_sq_shared('occ')} + 0.15 * {_sq_shared('sea')})::DOUBLE AS agree,
  (CASE WHEN {_formal} AND {_ath} THEN 0.5 ELSE 0 END + CASE WHEN {_formal} AND {_nov} THEN 0.7 ELSE 0 END)::DOUBLE AS conflict,
  list_sum(list_transform(items, lambda i: i.score)) / n_items AS mean FROM combos""", "combos")
cte("cs1", f"SELECT *, {tidy('cohesion + agree - conflict', 4)} AS compat FROM cs0", "cs0")
cte("cscore", f"SELECT *, {tidy('mean + 0.15 * compat', 6)} AS bscore, list_transform(items, lambda i: i.pr) AS prs, array_to_string(list_transform(items, lambda i: i.id), '+') AS ids FROM cs1", "cs1")
cte("tbest", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, level, template_rank ORDER BY subset_rank, bscore DESC, prs) AS r FROM cscore) WHERE r = 1""", "cscore")
cte("bchosen", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_items DESC, bscore DESC, level, template_rank) AS r2 FROM tbest
  LEFT JOIN (SELECT query_id, min(level) AS stop FROM tbest WHERE subset_rank = 1 GROUP BY query_id) USING (query_id) WHERE stop IS NULL OR level <= stop) WHERE r2 = 1""", "tbest")


def combos(spark, sf) -> DataFrame:
    return T.kept(spark, sf, "combos", lambda: B.bundle_score(B.bundle_combos(coherent(spark, sf), V.live_items(T.item_vectors(spark, sf)))))


def ids() -> F.Column:
    return F.array_join(F.transform("items", lambda i: i["item_id"]), "+")


def _combo_query(name: str, text: str, *cols):
    @query(name, sql(text, "cscore"))
    def run(spark, sf):
        return T.answered(spark, sf, combos(spark, sf).select("query_id", "level", "template", "n_items", ids().alias("ids"), *[c() if callable(c) else c for c in cols]))
    return run


_base = "query_id, level, template, n_items, ids"
_combo_query("bundle_combos", f"SELECT {_base}, round(total, 2) AS total_price FROM cscore", lambda: F.round("total_price", 2).alias("total_price"))
_combo_query("pair_cohesion", f"SELECT {_base}, cohesion FROM cscore", "cohesion")
_combo_query("style_agreement", f"SELECT {_base}, agree AS agreement FROM cscore", lambda: B.style_agreement().alias("agreement"))
_combo_query("style_conflict", f"SELECT {_base}, conflict FROM cscore", lambda: B.style_conflict().alias("conflict"))
_combo_query("bundle_score", f"SELECT {_base}, compat, bscore AS score FROM cscore", "compat", lambda: F.col("bundle_score").alias("score"))


@query("bundle_templates", sql("SELECT query_id, level, template, subset_rank, ids, bscore AS score FROM tbest", "tbest"))
def bundle_templates(spark, sf):
    return T.answered(spark, sf, B.bundle_templates(combos(spark, sf)).select("query_id", "level", "template", "subset_rank", ids().alias("ids"), F.col("bundle_score").alias("score")))


def chosen(spark, sf) -> DataFrame:
    return T.kept(spark, sf, "chosen", lambda: B.bundle_depths(B.bundle_templates(combos(spark, sf))))


@query("bundle_depths", sql("SELECT query_id, level, template, ids, bscore AS score FROM bchosen", "bchosen"))
def bundle_depths(spark, sf):
    return T.answered(spark, sf, chosen(spark, sf).select("query_id", "level", "template", ids().alias("ids"), F.col("bundle_score").alias("score")))


def payload(spark, sf) -> DataFrame:
    return B.bundle_payload(T.queries(spark, sf), T.answered(spark, sf, chosen(spark, sf)))


@query("bundle_payload", sql(f"""SELECT p.query_id, coalesce(CASE WHEN {_OTHER} THEN NULL ELSE ids END, '') AS ids, CASE WHEN NOT ({_OTHER}) THEN round(total, 2) END AS total_price,
  NOT ({_OTHER}) AND coalesce(subset_rank = 1, false) AS complete, CASE WHEN NOT ({_OTHER}) THEN template END AS template,
  CASE WHEN {_OTHER} OR ids IS NULL THEN '' ELSE array_to_string(list_slice(CASE template {' '.join(f"WHEN '{n}' THEN {s}" for n, s in R.BUNDLE_TEMPLATES)} END, n_items + 1, 9), ',') END AS missing_slots,
  CASE WHEN {_OTHER} OR ids IS NULL THEN '' ELSE array_to_string(list_transform(list_zip(items, CASE template {' '.join(f"WHEN '{n}' THEN {s}" for n, s in R.BUNDLE_TEMPLATES)} END[1:n_items]),
    lambda z: z[1].id || ':' || z[2] || ':' || coalesce(printf('%.2f', z[1].price), '')), '|') END AS items,
  CASE WHEN {_OTHER} THEN 'not_a_fashion_query' WHEN ids IS NOT NULL THEN NULL WHEN max_price IS NOT NULL THEN 'no_outfit_within_budget' ELSE 'insufficient_items_for_outfit' END AS message
  FROM parsed p LEFT JOIN bchosen b USING (query_id)""", "parsed", "bchosen"))
def bundle_payload(spark, sf):
    rows = B.bundle_payload(T.queries(spark, sf).withColumn("is_fashion_query", ~F.expr(_OTHER)), T.answered(spark, sf, chosen(spark, sf)))
    shown = F.array_join(F.transform("items", lambda i: F.concat(i["item_id"], F.lit(":"), i["slot"], F.lit(":"), F.when(i["price"].isNotNull(), F.format_string("%.2f", i["price"])).otherwise(""))), "|")
    return rows.select("query_id", F.coalesce(ids(), F.lit("")).alias("ids"), "total_price", F.coalesce("complete", F.lit(False)).alias("complete"), "template",
                       F.coalesce(F.array_join("missing_slots", ","), F.lit("")).alias("missing_slots"), F.coalesce(shown, F.lit("")).alias("items"), "message")
