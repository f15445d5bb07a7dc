"""Filters, boosts, features, reranking, near-duplicate collapse and progressive widening.

The operators work on a candidate frame: one row per (query_id, level, item_id) with `fused`
and `sim`, the item's columns under their own names and the query's columns prefixed `q_`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import attributes as A
from ..functions import intent as I
from ..functions import rules as R
from ..functions.exprs import (any_word, clamp, contains_any, contains_word, matches, strings, strip, tidy)
from ..functions.text import dedup_key, explain_item

QUERY_COLUMNS = ["query", "normalized_query_en", "language", "gender", "age_group", "min_price",
                 "max_price", "brand", "colors", "slots", "season", "occasion", "is_explicit_slot",
                 "is_explicit_gender", "warnings", "is_fashion_query"]


def candidate_join(candidates: DataFrame, items: DataFrame, queries: DataFrame | None = None,
                   item: str = "item_id", query: str = "query_id") -> DataFrame:
    """Attach live item columns (deleted items drop out) and, if given, prefixed query columns."""
    live = items.filter(~F.coalesce(F.col("is_deleted"), F.lit(False))) if "is_deleted" in items.columns else items
    out = candidates.join(live, item)
    if queries is not None:
        present = [c for c in QUERY_COLUMNS if c in queries.columns]
        out = out.join(queries.select(query, *[F.col(c).alias("q_" + c) for c in present]), query)
    return out


# -------------------------------------------------------------------- filters
def filter_price() -> Column:
    """Within the query's bounds; an item without a price never meets a bound."""
    p = F.col("price")
    low, high = F.col("q_min_price"), F.col("q_max_price")
    return (low.isNull() | F.coalesce(p >= low, F.lit(False))) & (
        high.isNull() | F.coalesce(p <= high, F.lit(False)))


def filter_gender(include_unknown: bool = False) -> Column:
    g, want = F.lower(F.coalesce("gender", F.lit("unknown"))), F.col("q_gender")
    ok = F.when(want.isin("men", "women"), (g == want) | (g == "unisex")).otherwise(g == "unisex")
    if include_unknown:
        ok = ok | (g == "unknown")
    return want.isNull() | ~F.coalesce("q_is_explicit_gender", F.lit(True)) | ok


def filter_age() -> Column:
    want = F.lower(F.coalesce("q_age_group", F.lit("")))
    return (want == "") | (A.effective_age(F.col("title"), F.col("age_group")) == want)


def filter_slot() -> Column:
    want = F.transform(F.coalesce("q_slots", strings([])), F.lower)
    free = (F.size(want) == 0) | ~F.coalesce("q_is_explicit_slot", F.lit(True))
    return free | F.arrays_overlap(A.effective_slots(F.col("title"), F.col("slot")), want)


def strict_filters(cands: DataFrame, include_unknown: bool = False, flag: str = "passes") -> DataFrame:
    """Flag candidates that meet every hard constraint; nothing is removed, so counts stay exact."""
    alive = ~F.coalesce(F.col("is_deleted"), F.lit(False)) if "is_deleted" in cands.columns else F.lit(True)
    return cands.withColumn(flag, alive & filter_price() & filter_gender(include_unknown)
                            & filter_age() & filter_slot())


def innerwear_ok() -> Column:
    """Innerwear only when the query asks for it."""
    asked = I.innerwear_requested(F.col("q_query"), F.col("q_normalized_query_en"), F.col("q_slots"))
    return (F.lower(F.coalesce("slot", F.lit(""))) != "innerwear") | asked


def eligible() -> Column:
    """Peripheral goods stay out of results unless the query names them."""
    slot = F.lower(F.coalesce("slot", F.lit("unknown")))
    asked = F.concat_ws(" ", "q_query", "q_normalized_query_en")
    meta = F.concat_ws(" ", "title", "search_text")
    return F.when(slot != "unknown", ~matches(F.col("title"), R.CPR) | matches(asked, R.CPR_QUERY)).otherwise(
        ~matches(meta, R.PERIPHERAL_ITEM) | matches(asked, R.PERIPHERAL_QUERY))


# --------------------------------------------------------------------- scoring
def quality_bounds(items: DataFrame, quality: str = "quality_bayes") -> DataFrame:
    """One row (min_q, max_q) over live items; equal bounds are widened, none gives (0, 5)."""
    live = items.filter(~F.coalesce(F.col("is_deleted"), F.lit(False))) if "is_deleted" in items.columns else items
    b = live.agg(F.min(quality).alias("lo"), F.max(quality).alias("hi"))
    return b.select(
        F.coalesce("lo", F.lit(0.0)).alias("min_q"),
        F.when(F.col("lo").isNull(), 5.0).when(F.col("lo") == F.col("hi"), F.col("lo") + 1.0)
        .otherwise(F.col("hi")).alias("max_q"))


def normalize_fused(cands: DataFrame, keys: tuple[str, ...] = ("query_id", "level")) -> DataFrame:
    """max_fused per pool and fused / max_fused.  A pool holds at most three lists of its depth."""
    top = F.max("fused").over(Window.partitionBy(*keys))
    safe = F.when(top > 0, top).otherwise(1.0)
    return cands.withColumn("max_fused", safe).withColumn("norm_fused", F.col("fused") / F.col("max_fused"))


def with_pool_maximum(cands: DataFrame, keys: tuple[str, ...] = ("query_id", "level")) -> DataFrame:
    """Keep a pool maximum taken before items were joined; take it here otherwise."""
    return cands if "max_fused" in cands.columns else normalize_fused(cands, keys)


def soft_boost(quality_norm: Column | float = 0.0, quality_weight: Column | float = R.BOOST["quality"]) -> Column:
    """Additive boost: quality, season, occasion, colour, brand."""
    qn = quality_norm if isinstance(quality_norm, Column) else F.lit(float(quality_norm))
    qw = quality_weight if isinstance(quality_weight, Column) else F.lit(float(quality_weight))
    lowered = {c: F.transform(F.coalesce(c, strings([])), F.lower) for c in ("seasons", "occasions", "colors")}

    def gain(cond: Column, value: float) -> Column:
        return F.when(F.coalesce(cond, F.lit(False)), F.lit(value)).otherwise(F.lit(0.0))

    brand = strip(F.lower(F.col("q_brand")))
    store, title = strip(F.lower(F.coalesce("store", F.lit("")))), strip(F.lower(F.col("title")))
    starts = F.startswith(store, brand) | F.startswith(title, brand)
    inside = contains_word(store, brand) | contains_word(title, brand)
    brand_gain = (
        F.when(F.coalesce(brand, F.lit("")) == "", 0.0)
        .when(starts, R.BOOST["brand"]).when(inside, R.BOOST["brand"] * R.BOOST["brand_inside"]).otherwise(0.0)
    )
    return (
        F.when(qw > 0, qw * qn).otherwise(0.0)
        + gain(F.array_contains(lowered["seasons"], F.lower("q_season")), R.BOOST["season"])
        + gain(F.array_contains(lowered["occasions"], F.lower("q_occasion")), R.BOOST["occasion"])
        + gain(F.arrays_overlap(lowered["colors"], F.transform("q_colors", F.lower)), R.BOOST["color"])
        + brand_gain
    )


# -------------------------------------------------------------------- features
def feat_semantic() -> Column:
    return clamp((F.col("sim") - 0.20) / 0.65)


def feat_lexical(fused: str = "fused") -> Column:
    return F.when(F.col("max_fused") > 0, F.col(fused) / F.col("max_fused")).otherwise(0.0)


def feat_phrase() -> Column:
    """Whole query in the title 1.0; else share of its word pairs x 0.8; one word 0.5."""
    title = F.lower("title")
    text = strip(F.regexp_replace(F.lower("q_query"), "(?U)" + R.BUDGET_PHRASE, ""))
    words = F.filter(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: F.length(w) > 2)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
                       F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
                       lambda a, b: F.concat_ws(" ", a, b))
    found = F.size(F.filter(pairs, lambda p: F.contains(title, p)))
    single = F.get(words, F.lit(0))
    return (
        F.when((text != "") & F.contains(title, text), 1.0)
        .when(F.size(words) >= 2, F.least(F.lit(0.8), found / F.greatest(F.size(pairs), F.lit(1)) * 0.8))
        .when((F.size(words) == 1) & F.contains(title, single), 0.5).otherwise(0.0)
    )


def feat_slot() -> Column:
    """Requested slot 1.0 / 0.1; without one, words of the query hint at slots."""
    slot, q = F.lower(F.coalesce("slot", F.lit(""))), F.lower("q_query")
    asked = F.transform(F.coalesce("q_slots", strings([])), F.lower)
    ensemble = contains_any(q, ["outfit", "suit", "attire"])
    hinted = (
        (F.contains(q, F.lit("dress")) & (slot == "full_body"))
        | (contains_any(q, ["shoes", "footwear", "boots"]) & (slot == "footwear"))
        | (contains_any(q, ["jacket", "coat", "blazer"]) & (slot == "top"))
    )
    return (
        F.when(F.size(asked) > 0, F.when(F.array_contains(asked, slot), 1.0).otherwise(0.1))
        .when(ensemble, F.when(slot.isin("top", "bottom", "full_body"), 1.0)
              .when(slot == "accessory", 0.1).otherwise(0.5))
        .when(hinted, 1.0).otherwise(0.5)
    )


def _color_score(color: Column, title: Column, item_colors: Column) -> Column:
    """Score of one requested colour: family on the item, family in the title, clash, neither."""
    out = None
    for name, family in R.COLOR_FAMILIES.items():
        others = sorted({c for n, f in R.COLOR_FAMILIES.items() if n != name for c in f})
        score = (
            F.when(F.arrays_overlap(item_colors, strings(family)), 1.0)
            .when(matches(title, any_word(family)), 0.95)
            .when(F.arrays_overlap(item_colors, strings(others)), 0.05).otherwise(0.1))
        out = F.when(color == name, score) if out is None else out.when(color == name, score)
    everything = sorted({c for f in R.COLOR_FAMILIES.values() for c in f})
    return out.otherwise(
        F.when(F.array_contains(item_colors, color), 1.0).when(contains_word(title, color), 0.95)
        .when(F.arrays_overlap(item_colors, strings(everything)), 0.05).otherwise(0.1))


def feat_color() -> Column:
    """The first requested colour that fits decides; otherwise the last clash seen stays."""
    item_colors = F.transform(F.coalesce("colors", strings([])), F.lower)
    asked = F.transform(F.coalesce("q_colors", strings([])), F.lower)
    scores = F.transform(asked, lambda c: _color_score(c, F.lower(F.col("title")), item_colors))
    fit = F.get(F.filter(scores, lambda s: s > 0.5), F.lit(0))
    clash = F.exists(scores, lambda s: s == 0.05)
    return F.when(F.size(asked) == 0, 1.0).otherwise(
        F.coalesce(fit, F.when(clash, 0.05).otherwise(0.1)))


def feat_demographic() -> Column:
    g, want = F.lower(F.coalesce("gender", F.lit("unknown"))), F.lower("q_gender")
    return (F.when(F.coalesce(want, F.lit("")) == "", 1.0).when(g == want, 1.0)
            .when(g == "unisex", 0.8).when(g == "unknown", 0.5).otherwise(0.0))


def feat_occasion() -> Column:
    title, q = F.lower("title"), F.lower("q_query")
    want = F.lower("q_occasion")
    tags = F.transform(F.coalesce("occasions", strings([])), F.lower)
    cues = {name: (contains_any(title, words), score) for name, words, score in R.OCCASION_CUES}
    out = F.when(F.coalesce(want, F.lit("")) == "", F.when(
        contains_any(q, R.DRESSY_QUERY) & contains_any(title, R.DRESSY_TITLE), 1.0).otherwise(0.5))
    out = out.when(F.array_contains(tags, want) | F.contains(title, want), 1.0)
    for name, (hit, score) in cues.items():
        out = out.when((want == name) & hit, score)
    return out.otherwise(0.2)


def feat_quality(quality: str = "quality_bayes") -> Column:
    q = F.col(quality)
    return clamp(F.when(q.isNull() | (q == 0), 4.0).otherwise(q) / 5.0)


def feat_price() -> Column:
    ratio = F.col("price") / F.col("q_max_price")
    known = (F.coalesce("q_max_price", F.lit(0.0)) != 0) & (F.coalesce("price", F.lit(0.0)) != 0)
    return F.when(~known, 1.0).when(ratio <= 1.0, F.greatest(F.lit(0.0), 0.7 + 0.3 * (1.0 - ratio))).otherwise(0.0)


def feat_costume() -> Column:
    wanted = contains_any(F.lower("q_query"), R.COSTUME_QUERY_WORDS)
    return F.when(~wanted & matches(F.col("title"), R.COSTUME), R.COSTUME_PENALTY).otherwise(0.0)


def archetype() -> Column:
    return I.query_archetype(F.col("q_query"), F.coalesce("q_slots", strings([])),
                             F.coalesce("q_colors", strings([])), F.col("q_min_price"),
                             F.col("q_max_price"), F.col("q_occasion"))


def feature_columns(fused: str = "fused", quality: str = "quality_bayes") -> dict[str, Column]:
    return {
        "semantic": feat_semantic(), "lexical": feat_lexical(fused), "phrase": feat_phrase(),
        "slot": feat_slot(), "color": feat_color(), "demographic": feat_demographic(),
        "occasion": feat_occasion(), "quality": feat_quality(quality), "price": feat_price(),
    }


def rerank(cands: DataFrame, *, keys: tuple[str, ...] = ("query_id", "level"), fused: str = "fused",
           quality: str = "quality_bayes", rank: bool = True, only: str | None = None) -> DataFrame:
    """Weighted feature score in [0, 1] per archetype and the position it gives.

    `only` names a flag: rows without it get null features and no feature is computed for them.

    `fused` names the column fed to the lexical feature: the fused score (default), or the
    boosted pool score to reproduce how the served ranking saturates that feature.
    """
    feats = {**feature_columns(fused, quality), "costume": feat_costume()}
    out = cands.withColumns({f"f_{n}": F.when(F.col(only), c) if only else c for n, c in feats.items()})
    out = out.withColumn("archetype", archetype())
    total = None
    for name, weights in R.ARCHETYPE_WEIGHTS.items():
        s = sum((F.col(f"f_{n}") * w for n, w in zip(R.FEATURES, weights, strict=True)), F.lit(0.0))
        hit = F.col("archetype") == name
        total = F.when(hit, s) if total is None else total.when(hit, s)
    out = out.withColumn("score", tidy(clamp(total - F.col("f_costume")), 6))
    return ranked(out, keys) if rank else out


def ranked(cands: DataFrame, keys: tuple[str, ...], name: str = "rank") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("fused").desc(), F.col("item_id"))
    return cands.withColumn(name, F.row_number().over(w))


def blend_scores(scored: DataFrame, external: str = "external", top_n: int = R.BLEND_TOP_N,
                 weight: float = R.BLEND_WEIGHT, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Blend an outside score, min-max scaled over the best top_n of a query; the tail stays."""
    head = F.col("rank") <= top_n
    w = Window.partitionBy(*keys)
    low, high = (f(F.when(head, F.col(external))).over(w) for f in (F.min, F.max))
    scaled = (F.col(external) - low) / F.greatest(high - low, F.lit(1e-6))
    return scored.withColumn("blended", tidy(
        F.when(head, (1 - weight) * F.col("score") + weight * scaled).otherwise(F.col("score")), 6))


def collapse_duplicates(cands: DataFrame, keys: tuple[str, ...] = ("query_id", "level")) -> DataFrame:
    """Keep the best row per near-duplicate key of a pool."""
    out = cands.withColumn("dedup_key", dedup_key(F.col("title"), F.col("store")))
    w = Window.partitionBy(*keys, "dedup_key").orderBy(
        F.col("score").desc(), F.col("fused").desc(), F.col("item_id"))
    return out.withColumn("_copy", F.row_number().over(w)).filter("_copy = 1").drop("_copy")


def batch_filter_rank(cands: DataFrame, include_unknown: bool = False) -> DataFrame:
    """Simple ranking without reranking: hard filters, fused share plus boost."""
    flagged = normalize_fused(strict_filters(cands, include_unknown))
    kept = flagged.filter("passes").withColumn("score", tidy(F.col("norm_fused") + soft_boost(), 6))
    return ranked(kept, ("query_id", "level"))


# -------------------------------------------------------------------- full search
def score_pools(cands: DataFrame, bounds: DataFrame, *, as_served: bool = False,
                quality_weight: Column | float = R.BOOST["quality"],
                keys: tuple[str, ...] = ("query_id", "level")) -> DataFrame:
    """Flag every candidate and score it: passes, pool_score (fused share + boost), score."""
    lo, hi = bounds.select("min_q").scalar(), bounds.select("max_q").scalar()
    flagged = strict_filters(with_pool_maximum(cands, keys), flag="_strict").withColumn(
        "passes", F.col("_strict") & innerwear_ok() & eligible()).drop("_strict")
    q_norm = (F.col("quality_bayes") - lo) / F.greatest(hi - lo, F.lit(1e-6))
    boosted = flagged.withColumn("pool_score", F.col("norm_fused") + soft_boost(q_norm, quality_weight))
    return rerank(boosted, keys=keys, fused="pool_score" if as_served else "fused", rank=False, only="passes")


def pool_counts(scored: DataFrame, top_k: int = 10, kept: DataFrame | None = None) -> DataFrame:
    """The pool that answers each query, with its counts: the shallowest that fills top_k after
    collapse, else the deepest.  (query_id, level, pool_size, excluded, kept, collapsed)"""
    kept = collapse_duplicates(scored.filter("passes")) if kept is None else kept
    pools = scored.groupBy("query_id", "level").agg(
        F.count(F.lit(1)).alias("pool_size"), F.count_if(~F.col("passes")).alias("excluded"))
    sizes = kept.groupBy("query_id", "level").agg(F.count(F.lit(1)).alias("kept"))
    per = pools.join(sizes, ["query_id", "level"], "left").withColumn("kept", F.coalesce("kept", F.lit(0))).withColumn(
        "collapsed", F.col("pool_size") - F.col("excluded") - F.col("kept"))
    fills = F.col("kept") >= top_k
    # false sorts before true: pools that fill top_k first, shallowest of those, else the deepest
    best = F.min_by(F.struct("level", "pool_size", "excluded", "kept", "collapsed"),
                    F.struct(~fills, F.when(fills, F.col("level")).otherwise(-F.col("level"))))
    return per.groupBy("query_id").agg(best.alias("_p")).select("query_id", "_p.*")


def progressive_widening(scored: DataFrame, top_k: int = 10) -> DataFrame:
    """Survivors of the answering pool in rank order, with that pool's counts."""
    kept = collapse_duplicates(scored.filter("passes"))
    pools = pool_counts(scored, top_k, kept)
    return ranked(kept.join(pools, ["query_id", "level"]), ("query_id",))


def topk_results(ranked_rows: DataFrame, top_k: int = 10) -> DataFrame:
    """The served rows: score and similarity to 4 decimals, with the reason."""
    reason = explain_item(F.col("title"), F.col("store"), F.col("colors"), F.col("seasons"),
                          F.col("occasions"), F.col("q_query"), F.col("q_brand"), F.col("q_colors"),
                          F.col("q_season"), F.col("q_occasion"))
    return ranked_rows.filter(F.col("rank") <= top_k).select(
        "query_id", "rank", "item_id", "title", "price", "store", "slot", "gender", "age_group",
        tidy(F.col("score"), 4).alias("score"), tidy(F.col("sim"), 4).alias("similarity"), reason.alias("reason"))


def low_confidence(results: DataFrame, threshold: float = R.LOW_CONFIDENCE, sim: str = "sim") -> DataFrame:
    """(query_id, best_sim, low_confidence) over returned rows."""
    return results.groupBy("query_id").agg(F.max(sim).alias("best_sim")).withColumn(
        "low_confidence", F.col("best_sim") < threshold)


def search_meta(queries: DataFrame, ranked_rows: DataFrame, pools: DataFrame, guard: DataFrame,
                top_k: int = 10, policy: str = "warn") -> DataFrame:
    """One row per query: counts of the chosen pool, flags, warnings, message, suggestions.

    queries: used_fallback says that rules parsed the query (default: they did), is_fashion_query that it is about the
    catalog at all (default: it is).  guard: degraded marks queries whose raw words the catalog does not know.  A
    degraded query under the fallback gets a warning, or with policy "refuse" no results.  Low confidence is only warned
    of under the fallback.
    """
    best = ranked_rows.groupBy("query_id").agg(
        F.count_if(F.col("rank") <= top_k).alias("n_results"),
        F.max(F.when(F.col("rank") <= top_k, F.col("sim"))).alias("best_sim"))
    for name in ("used_fallback", "is_fashion_query"):
        queries = queries.withColumn(name, F.coalesce(F.col(name), F.lit(True)) if name in queries.columns else F.lit(True))
    out = queries.join(pools, "query_id", "left").join(best, "query_id", "left").join(
        guard.select("query_id", "skip_keyword", "degraded"), "query_id", "left")
    degraded = F.coalesce("degraded", F.lit(False)) & F.col("used_fallback")
    refused = degraded & F.lit(policy == "refuse")
    searched = ~refused & F.col("is_fashion_query")

    def found(name: str) -> Column:
        return F.when(searched, F.coalesce(name, F.lit(0))).otherwise(0).alias(name)
    n = found("n_results")
    low = F.when(degraded & (searched | refused), True).otherwise(searched & F.coalesce(F.col("best_sim") < R.LOW_CONFIDENCE, F.lit(False)))
    added = F.array_compact(F.array(
        F.when(degraded, F.lit("filters_not_applied_without_llm")),
        F.when(searched & F.coalesce("skip_keyword", F.lit(False)), F.lit("keyword_search_skipped")),
        F.when(searched & low & F.col("used_fallback"), F.lit("low_confidence_results"))))
    return out.select(
        "query_id", found("excluded"), found("collapsed"), found("pool_size"), n, low.alias("low_confidence"), "used_fallback",
        F.array_distinct(F.concat(F.coalesce("warnings", strings([])), added)).alias("warnings"),
        F.when(refused, "llm_unavailable_for_non_english_query").when(~F.col("is_fashion_query"), "not_a_fashion_query")
        .when((n == 0) & (found("excluded") == 0), "no_good_match").alias("message"),
        F.when((n == 0) & ~refused, strings(R.SUGGESTED_QUERIES)).otherwise(strings([])).alias("suggested_queries"))


def facet_slots(results: DataFrame) -> DataFrame:
    """Known slots among each query's results, with counts."""
    return results.filter(F.col("slot").isNotNull() & ~F.col("slot").isin("", "unknown")).groupBy(
        "query_id", "slot").agg(F.count(F.lit(1)).alias("n"))


def result_sort(results: DataFrame, mode: str = "relevance", slot: str | None = None) -> DataFrame:
    """Position of each result under a sort mode; a missing price comes last in both directions."""
    rows = results.filter(F.col("slot") == slot) if slot else results
    order = {
        "relevance": [F.col("score").desc()],
        "price_asc": [F.col("price").asc_nulls_last()],
        "price_desc": [F.col("price").desc_nulls_last()],
    }[mode]
    w = Window.partitionBy("query_id").orderBy(*order, F.col("item_id"))
    return rows.withColumn("position", F.row_number().over(w))

