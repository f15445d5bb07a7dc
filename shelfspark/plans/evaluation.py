"""Offline evaluation over result tables (query_id, rank, item columns) and query tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import strings, tidy, unicode_regex
from ..operators.quantiles import exact_percentiles
from ..operators.ranking import low_confidence, ranked
from ..session import materialize
from .reports import pct


def is_relevant(title: str = "title", pattern: str = "relevance_regex") -> Column:
    """The query's own pattern occurs in the title."""
    return F.coalesce(F.rlike(F.col(title), F.concat(F.lit(unicode_regex("")), F.col(pattern))), F.lit(False))


def per_query(queries: DataFrame, results: DataFrame, relevant: Column, depth: int) -> DataFrame:
    """Every query with its relevant count in the top `depth` and its first relevant rank."""
    hits = results.withColumn("_rel", relevant).groupBy("query_id").agg(
        F.count_if(F.col("_rel") & (F.col("rank") <= depth)).alias("n_rel"),
        F.min(F.when(F.col("_rel"), F.col("rank"))).alias("first_rel"))
    return queries.select("query_id").join(hits, "query_id", "left").withColumn("n_rel", F.coalesce("n_rel", F.lit(0)))


def precision_at_k(queries: DataFrame, results: DataFrame, relevant: Column, k: int = 5) -> DataFrame:
    return per_query(queries, results, relevant, k).select("query_id", F.round(F.col("n_rel") / k, 6).alias("precision"))


def recall_at_k(queries: DataFrame, results: DataFrame, relevant: Column, k: int = 5) -> DataFrame:
    return per_query(queries, results, relevant, k).select(
        "query_id", F.when(F.col("n_rel") > 0, 1.0).otherwise(0.0).alias("recall"))


def mrr_at_k(queries: DataFrame, results: DataFrame, relevant: Column, k: int = 10) -> DataFrame:
    return per_query(queries, results, relevant, k).select(
        "query_id", F.round(F.when(F.col("first_rel") <= k, 1.0 / F.col("first_rel")).otherwise(0.0), 6).alias("rr"))


def _violations() -> dict[str, Column]:
    p = F.col("price")
    gender = F.col("q_gender").isin("men", "women") & ~((F.col("gender") == F.col("q_gender")) | (F.col("gender") == "unisex"))
    kids = F.coalesce(F.col("q_age_group") == "kids", F.lit(False))
    return {
        "price": F.coalesce(p > F.col("q_max_price"), F.lit(False)).cast("int")
        + F.coalesce(p < F.col("q_min_price"), F.lit(False)).cast("int"),
        "gender": F.coalesce(gender, F.lit(False)).cast("int"),
        "age": (kids & (F.col("age_group") != "kids")).cast("int"),
        "slot": F.coalesce((F.col("q_slot") != "") & (F.col("slot") != F.col("q_slot")), F.lit(False)).cast("int"),
    }


def constraint_violations(rows: DataFrame, k: int = 5) -> DataFrame:
    """One row of counts over top-k rows joined to their query's constraints."""
    v = _violations()
    top = rows.filter((F.col("rank") <= k) & F.coalesce("q_is_fashion_query", F.lit(True))).withColumns(
        {f"_{n}": c for n, c in v.items()})
    bad = sum((F.col(f"_{n}") for n in v), F.lit(0)) > 0
    total = {n: F.coalesce(F.sum(f"_{n}"), F.lit(0)).cast("bigint") for n in v}
    return top.agg(
        *[c.alias(f"{n}_violations") for n, c in total.items()],
        F.coalesce(F.sum(sum((F.col(f"_{n}") for n in v), F.lit(0))), F.lit(0)).cast("bigint").alias("total_violations"),
        F.count_if(bad & (F.col("q_language") == "en")).alias("english_violations"),
        F.count_if(bad & (F.col("q_language") != "en")).alias("degraded_violations"))


def leakage(rows: DataFrame, k: int = 5) -> DataFrame:
    """Kids and innerwear items returned to queries that did not ask for them."""
    top = rows.filter((F.col("rank") <= k) & F.coalesce("q_is_fashion_query", F.lit(True)))
    return top.agg(
        F.count_if(~F.col("q_age_group").eqNullSafe("kids") & (F.col("age_group") == "kids")).alias("kids_leakage"),
        F.count_if(~F.col("q_slot").eqNullSafe("innerwear") & (F.col("slot") == "innerwear")).alias("innerwear_leakage"))


def dup_rate(rows: DataFrame, k: int = 5) -> DataFrame:
    """Share of top-k rows that repeat an earlier brand::title of the same query."""
    key = F.concat_ws("::", F.coalesce("store", F.lit("None")), F.lower("title"))
    per = rows.filter(F.col("rank") <= k).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.size(F.collect_set(key)).alias("d"))  # at most k keys
    row = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - F.col("d")), F.lit(0)).alias("n_dup"))
    return row.select("n_rows", "n_dup", pct(F.col("n_dup"), F.greatest("n_rows", F.lit(1))).alias("dup_pct"))


def result_rates(queries: DataFrame, results: DataFrame, relevant: Column, k: int = 5) -> DataFrame:
    """Per query: no result, low confidence, nothing relevant."""
    top = results.filter(F.col("rank") <= k)
    conf = low_confidence(results)
    rel = top.withColumn("_rel", relevant).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_top"), F.count_if("_rel").alias("n_rel"))
    out = queries.select("query_id").join(rel, "query_id", "left").join(conf, "query_id", "left")
    return out.select(
        "query_id", F.coalesce("n_top", F.lit(0)).alias("n_top"),
        (F.coalesce("n_top", F.lit(0)) == 0).alias("zero_result"),
        F.coalesce("low_confidence", F.lit(False)).alias("low_confidence"),
        (F.coalesce("n_rel", F.lit(0)) == 0).alias("no_relevant"))


def rate_summary(rates: DataFrame) -> DataFrame:
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return rates.agg(pct(F.count_if("zero_result"), n).alias("zero_result_pct"),
                     pct(F.count_if("low_confidence"), n).alias("low_confidence_pct"),
                     F.count_if("no_relevant").alias("n_no_relevant"))


def latency_percentiles(log: DataFrame, by: str = "endpoint", value: str = "latency_ms", digits: int = 2) -> DataFrame:
    out = exact_percentiles(log, [by], value, {"p50": 0.50, "p95": 0.95, "p99": 0.99})
    return out.select(by, "n", *[tidy(F.col(c), digits).alias(c) for c in ("p50", "p95", "p99")])


def language_success(rows: DataFrame, ok: Column, by: str = "language") -> DataFrame:
    good = F.count_if(ok)
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("total"), good.alias("success"),
                                pct(good, F.count(F.lit(1))).alias("success_pct"))


def bundle_eval(queries: DataFrame, bundles: DataFrame, small_budget: float = 15.0) -> DataFrame:
    """One row of shares over all bundle queries; bundles: query_id, items, total_price, message."""
    rows = queries.select("query_id", "max_price").join(bundles, "query_id", "left")
    made = F.col("items").isNotNull()
    n_items = F.coalesce(F.size("items"), F.lit(0))

    def coherent(field: str, neutral: list[str]) -> Column:
        values = F.array_compact(F.transform("items", lambda i: i[field]))
        return made & (F.size(F.array_distinct(F.array_except(values, strings(neutral)))) <= 1)

    refused = ~made & (F.col("max_price") <= small_budget) & (F.col("message") == "no_outfit_within_budget")
    within = (made & (F.col("max_price").isNull() | (F.col("total_price") <= F.col("max_price")))) | F.coalesce(refused, F.lit(False))
    inner = F.sum(F.when(made, F.size(F.filter("items", lambda i: i["slot"] == "innerwear"))).otherwise(0))
    total, composed = F.count(F.lit(1)), F.count_if(made)
    return rows.agg(
        total.alias("n_queries"), composed.alias("n_composed"),
        pct(F.count_if(made & (n_items >= 3)), total).alias("completeness_pct"),
        pct(F.count_if(F.coalesce(within, F.lit(False))), total).alias("budget_pct"),
        pct(F.count_if(coherent("age_group", [])), composed).alias("age_pct"),
        pct(F.count_if(coherent("gender", ["unisex", "unknown"])), composed).alias("gender_pct"),
        F.coalesce(inner, F.lit(0)).cast("bigint").alias("innerwear_items"))


def weight_ablation(scored: DataFrame, features: dict[str, Column], weights: list[float], top_k: int = 5, keys: tuple[str, ...] = ("query_id", "level")) -> DataFrame:
    """Top-k under every quality weight in one job: each candidate row carries every variant."""
    variants = F.array(*[F.struct(F.lit(f"q{w:.2f}").alias("variant"), F.lit(float(w)).alias("w")) for w in weights])
    rows = scored.withColumn("_v", F.explode(variants)).withColumn("variant", F.col("_v.variant")).withColumn(
        "score", F.round(F.col("score_no_quality") + F.col("_v.w") * features["quality"], 6)).drop("_v")
    return ranked(rows, (*keys, "variant")).filter(F.col("rank") <= top_k)


def pool_sweep(scored: DataFrame, k: int = 10) -> DataFrame:
    """Per (query, level): retrieved, survivors and slot precision of the first k survivors."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id", "level").orderBy(F.col("passes").desc(), F.col("fused").desc(), F.col("item_id"))
    rows = scored.withColumn("_i", F.row_number().over(w))
    head = F.col("passes") & (F.col("_i") <= k)
    want = F.get("q_slots", F.lit(0))
    fit = head & (want.isNull() | (F.col("slot") == want))
    return rows.groupBy("query_id", "level").agg(
        F.count(F.lit(1)).alias("retrieved"), F.count_if("passes").alias("survivors"),
        F.round(F.coalesce(F.try_divide(F.count_if(fit), F.count_if(head)), F.lit(0.0)), 6).alias("slot_precision"))


def similarity_calibration(scores: DataFrame, group: str = "grp", score: str = "best_sim") -> DataFrame:
    """min / p5 / median / max per group, threshold = p5 of the relevant group, separable flag."""
    rows = materialize(exact_percentiles(scores, [group], score, {"lo": 0.0, "p5": 0.05, "median": 0.50, "hi": 1.0}), "calibration")
    rel = F.col(group) == "relevant"
    ends = rows.agg(F.struct(F.max(F.when(rel, F.col("p5"))).alias("p5"), F.max(F.when(rel, F.col("lo"))).alias("lo"),
                             F.max(F.when(~rel, F.col("hi"))).alias("hi")).alias("ends")).scalar()
    return rows.withColumn("_ends", ends).select(
        group, "n", *[tidy(F.col(c), 6).alias(a) for c, a in (("lo", "min_sim"), ("p5", "p5"), ("median", "median"), ("hi", "max_sim"))],
        tidy(F.col("_ends.p5"), 4).alias("threshold"), F.coalesce(F.col("_ends.lo") > F.col("_ends.hi"), F.lit(False)).alias("separable"))


def unflagged_share(scores: DataFrame, threshold: Column, group: str = "grp", score: str = "best_sim") -> DataFrame:
    """Irrelevant queries the threshold would not flag."""
    bad = scores.filter(F.col(group) == "irrelevant")
    over = F.count_if(F.col(score) >= threshold)
    return bad.agg(F.count(F.lit(1)).alias("n"), over.alias("unflagged"), pct(over, F.count(F.lit(1))).alias("unflagged_pct"))


def self_retrieval(targets: DataFrame, results: DataFrame) -> DataFrame:
    """targets: query_id, item_id.  Rank of each item for its own text and the cause of a miss."""
    found = results.select("query_id", "item_id", "rank").filter("rank <= 10")
    rank = F.coalesce("rank", F.lit(0))
    return targets.join(found, ["query_id", "item_id"], "left").select(
        "query_id", "item_id", rank.alias("found_rank"),
        F.when(rank == 1, "hit").when(rank > 1, "near_duplicate_title_or_size_variant")
        .otherwise("uncommon_tokens_or_vocabulary_mismatch").alias("cause"))


def gate_table(metrics: list[DataFrame], gates: DataFrame) -> DataFrame:
    """(gate, measured, required, status): one-row metric frames unpivoted and joined to a table of thresholds.

    gates(gate, metric, comparison, required): `=`, `<=` or `>=` against required gives PASS or FAIL, no comparison INFO.
    A gate whose metric was not measured, or is null, fails.
    """
    lines = None
    for row in metrics:
        part = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("measured")) for c in row.columns])).alias("m")).select("m.*")
        lines = part if lines is None else lines.unionByName(part)
    asked = F.col("comparison")
    met = (F.when(asked == "=", F.col("measured") == F.col("required")).when(asked == "<=", F.col("measured") <= F.col("required"))
           .when(asked == ">=", F.col("measured") >= F.col("required")))
    status = F.when(asked.isNull(), "INFO").when(F.coalesce(met, F.lit(False)), "PASS").otherwise("FAIL")
    return gates.join(lines, "metric", "left").select("gate", "measured", "required", status.alias("status"))
