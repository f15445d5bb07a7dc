"""Joins of the catalog build and of the offline comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import contains_any, strings
from ..functions.rules import COSTUME_QUERY_WORDS
from .quantiles import count_at_least

SNIPPET_MIN, SNIPPET_MAX, SNIPPETS = 40, 150, 2  # fixed values: review snippet limits
FILTER_BITS = 1 << 24  # of the table of key slots that is broadcast: at most FILTER_BITS / 64 rows, about 4 MB of values


def met(rows: DataFrame, key: str, keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """rows with `met`: false only where `key` is not among the one column of `keys`, so most others need not move for a join.

    Keys are hashed to `bits` slots; the slots in use go out as 64-bit masks, a table of bounded size whatever the number
    of keys.  With more keys than slots nearly every row is met and the join does the work, with the same result.
    """
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    slots = keys.select(at(keys.columns[0]).alias("slot"))
    masks = slots.groupBy(F.floor(F.col("slot") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))).alias("mask"))
    held = rows.withColumn("word", F.floor(at(key) / 64)).join(F.broadcast(masks), "word", "left")
    return held.withColumn("met", F.coalesce(F.getbit("mask", (at(key) % 64).cast("int")) == 1, F.lit(False))).drop("word", "mask")


def lookup_ids(items: DataFrame, ids: DataFrame, item: str = "item_id", with_deleted: bool = False) -> DataFrame:
    """Rows of the wanted ids; live rows only unless asked otherwise."""
    rows = items if with_deleted else items.filter(~F.col("is_deleted"))
    return rows.join(ids.select(item), item, "left_semi")


def best_reviews(reviews: DataFrame, catalog: DataFrame, *, item: str = "item_id", text: str = "text",
                 votes: str = "helpful_vote", tie: str = "seq") -> DataFrame:
    """Two most helpful snippets per product as one array column `review_snippets`."""
    r = reviews.withColumn("_t", F.trim(F.col(text))).filter(F.length("_t") >= SNIPPET_MIN).join(
        catalog.select(item), item, "left_semi")
    w = Window.partitionBy(item).orderBy(F.coalesce(F.col(votes), F.lit(0)).desc(), F.col(tie))
    best = r.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= SNIPPETS)
    pairs = F.array_sort(F.collect_list(F.struct("_n", F.substring("_t", 1, SNIPPET_MAX).alias("t"))))
    return best.groupBy(item).agg(F.transform(pairs, lambda p: p["t"]).alias("review_snippets"))


def attach_reviews(records: DataFrame, snippets: DataFrame, item: str = "item_id") -> DataFrame:
    out = records.join(snippets, item, "left")
    return out.withColumn("review_snippets", F.coalesce("review_snippets", strings([])))


def overlap_pairs(relevant: DataFrame, irrelevant: DataFrame, score: str = "score") -> DataFrame:
    """Per relevant query, how many irrelevant queries score at least as high (pairs are counted,
    not produced)."""
    return count_at_least(relevant, irrelevant, score, "n_overlaps").withColumn(
        "n_overlaps", F.coalesce("n_overlaps", F.lit(0)))


def result_sets(results: DataFrame, k: int = 5, by: tuple[str, ...] = ("intent_id", "language")) -> DataFrame:
    """One ordered array of top-k item ids per list."""
    top = results.filter(F.col("rank") <= k)
    pairs = F.array_sort(F.collect_list(F.struct("rank", "item_id")))
    return top.groupBy(*by).agg(F.transform(pairs, lambda p: p["item_id"]).alias("ids"))


def language_pairs(sets: DataFrame, intent: str = "intent_id", language: str = "language") -> DataFrame:
    """Each two language versions of an intent side by side; a language set is a closed list."""
    other = sets.select(intent, F.col(language).alias("lang_b"), F.col("ids").alias("ids_b"))
    return sets.select(intent, F.col(language).alias("lang_a"), F.col("ids").alias("ids_a")).join(
        other, intent).filter("lang_a < lang_b")


def topk_jaccard(pairs: DataFrame) -> DataFrame:
    union = F.size(F.array_union("ids_a", "ids_b"))
    shared = F.size(F.array_intersect("ids_a", "ids_b"))
    return pairs.filter(union > 0).withColumn("jaccard", F.round(shared / union, 6))


def ablation_diff(a: DataFrame, b: DataFrame, k: int = 5, keys: tuple[str, ...] = ("query_id", "level")) -> DataFrame:
    """Queries and pool depths, and whether their ordered top-k differs between two configurations."""
    left = result_sets(a, k, keys).withColumnRenamed("ids", "ids_a")
    right = result_sets(b, k, keys).withColumnRenamed("ids", "ids_b")
    joined = left.join(right, list(keys), "full_outer")
    return joined.withColumn("changed", ~F.col("ids_a").eqNullSafe(F.col("ids_b")))


def spec_relevant(title: Column, slot: Column, gender: Column, price: Column, want_slot: Column,
                  want_gender: Column, budget: Column) -> Column:
    """Meets the expected slot, gender and budget and is no costume."""
    return (
        (want_slot.isNull() | (F.lower(slot) == want_slot))
        & (want_gender.isNull() | F.lower(gender).isin("unisex") | (F.lower(gender) == want_gender))
        & (budget.isNull() | (F.coalesce(price, F.lit(0.0)) <= budget))
        & ~contains_any(F.lower(title), COSTUME_QUERY_WORDS[:3])
    )


def spec_relevance(results: DataFrame, specs: DataFrame) -> DataFrame:
    """rel@1, rel@5, rel@10 per (query, variant); specs: query_id, want_slot, want_gender, budget."""
    rows = results.join(specs, "query_id").withColumn("_ok", spec_relevant(
        F.col("title"), F.col("slot"), F.col("gender"), F.col("price"), F.col("want_slot"),
        F.col("want_gender"), F.col("budget")).cast("int"))

    def share(k: int) -> Column:
        return F.round(F.avg(F.when(F.col("rank") <= k, F.coalesce("_ok", F.lit(0)))), 6)

    return rows.groupBy("query_id", "variant").agg(
        share(1).alias("rel_1"), share(5).alias("rel_5"), share(10).alias("rel_10"))
