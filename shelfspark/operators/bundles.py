"""Budgeted multi-item bundles: slot pools, coherence, pruned theta joins, best bundle per query.

A pool holds at most eight items per (query, depth, slot), so every join below meets at most
8^4 rows per key; that bound is the feature itself, not a cap on candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.exprs import contains_any, matches, strings, tidy
from ..functions.text import explain_item
from . import ranking as K
from .dedup import spread
from .retrieval import dot

POOL_KEYS = ("query_id", "level", "pool_slot")
CARRIED = ["item_id", "title", "store", "price", "slot", "gender", "age_group", "score", "sim",
           "colors", "seasons", "occasions", "pool_rank"]


def accessory_allowed(kind: Column, query_text: Column) -> Column:
    """Socks, gloves, body jewelry and hair goods only when the query asks for them."""
    k, out = F.lower(kind), None
    for name, pattern in R.RESTRICTED_ACCESSORIES:
        asked = matches(query_text, pattern)
        out = F.when(k == name, asked) if out is None else out.when(k == name, asked)
    return F.coalesce(out.otherwise(True), F.lit(True))


def bundle_floors() -> Column:
    """Not absurdly cheap (a missing price passes) and similar enough to the query."""
    return (F.col("price").isNull() | (F.col("price") >= R.BUNDLE_MIN_PRICE)) & (F.col("sim") >= R.BUNDLE_MIN_SIM)


def slot_pools(cands: DataFrame, bounds: DataFrame, *, as_served: bool = False,
               size: int = R.BUNDLE_POOL) -> DataFrame:
    """Best `size` items per (query, level, slot): strict match, floors, accessory rule, rerank,
    collapse.  Adds pool_slot and pool_rank."""
    forced = K.with_pool_maximum(cands).filter(F.col("slot").isin(R.BUNDLE_SLOTS)).withColumns({
        "pool_slot": F.lower("slot"), "q_slots": F.array(F.lower("slot")),
    })
    # the forced slot counts as explicit unless the parse said otherwise
    ok = K.strict_filters(forced, flag="_ok").filter("_ok").filter(bundle_floors())
    asked = F.concat_ws(" ", "q_query", "q_normalized_query_en")
    ok = ok.filter((F.col("pool_slot") != "accessory") | accessory_allowed(F.col("accessory_type"), asked))
    lo, hi = bounds.select("min_q").scalar(), bounds.select("max_q").scalar()
    q_norm = (F.col("quality_bayes") - lo) / F.greatest(hi - lo, F.lit(1e-6))
    scored = K.rerank(ok.drop("_ok").withColumn("pool_score", F.col("norm_fused") + K.soft_boost(q_norm)),
                      fused="pool_score" if as_served else "fused", rank=False)
    unique = K.collapse_duplicates(scored, POOL_KEYS)
    return K.ranked(unique, POOL_KEYS, "pool_rank").filter(F.col("pool_rank") <= size)


def target_gender(pools: DataFrame) -> DataFrame:
    """(query, level, target): the query's gender, else that of the best men/women candidate."""
    order = F.array_position(strings(R.BUNDLE_SLOTS), F.col("pool_slot"))
    gendered = F.lower("gender").isin("men", "women")
    best = F.max_by(F.when(gendered, F.lower("gender")),
                    F.when(gendered, F.struct(F.col("score"), -order, -F.col("pool_rank"))))
    return pools.groupBy("query_id", "level").agg(
        F.coalesce(F.lower(F.first("q_gender", ignorenulls=True)), best, F.lit("unisex")).alias("target"))


def coherence_filter(pools: DataFrame, targets: DataFrame) -> DataFrame:
    """Age equal to the query's; gender compatible with the target."""
    age = F.lower(F.coalesce("age_group", F.lit("adult"))) == F.lower(F.coalesce("q_age_group", F.lit("adult")))
    g = F.lower(F.coalesce("gender", F.lit("unknown")))
    fits = (g == "unisex") | (F.col("target").isin("men", "women") & (g == F.col("target")))
    return pools.join(targets, ["query_id", "level"]).filter(age & fits)


def pool_pairs(pools: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine of every two pooled items of a (query, depth) from different slots, each pair once (a < b)."""
    members = pools.select("query_id", "level", "item_id", "pool_slot").distinct().join(
        vectors.select("item_id", "vec"), "item_id")
    a, b = (members.select("query_id", "level", F.col("item_id").alias(n), F.col("pool_slot").alias("s" + n), F.col("vec").alias("v" + n)) for n in "ab")
    return a.join(b, ["query_id", "level"]).filter("a < b and sa <> sb").select(
        "query_id", "level", "a", "b", F.round(dot(F.col("va"), F.col("vb")), 6).alias("pair_sim"))


def _attach_pairs(pools: DataFrame, vectors: DataFrame) -> DataFrame:
    """Each pooled item carries the similarities to its possible partners of the same depth (at most 32)."""
    both = F.array(F.struct(F.col("a").alias("item_id"), F.col("b").alias("to")), F.struct(F.col("b").alias("item_id"), F.col("a").alias("to")))
    maps = pool_pairs(pools, vectors).select("query_id", "level", F.explode(both).alias("e"), "pair_sim").groupBy(
        "query_id", "level", F.col("e.item_id").alias("item_id")).agg(F.map_from_entries(F.collect_list(F.struct("e.to", "pair_sim"))).alias("sims"))
    return pools.join(maps, ["query_id", "level", "item_id"], "left")


def bundle_combos(coherent: DataFrame, vectors: DataFrame) -> DataFrame:
    """All admissible combinations per template and slot subset.

    One shuffle brings the pools of a (query, depth) together (at most 40 items); the
    combinations then unfold inside the row, slot by slot, and the running price, gender and
    age prune after every slot.  A template's shorter subsets are prefixes of it, so each template
    unfolds once: at every slot a row may also stop.  Columns: query_id, level, template, template_rank,
    subset_rank, n_items, items, total_price, pair_sum, n_pairs.
    """
    neutral = F.col("gender").isin("unisex", "unknown")
    entry = F.struct(
        F.struct(*[F.col(c) for c in CARRIED]).alias("it"), F.coalesce("price", F.lit(0.0)).alias("p"),
        F.when(~neutral, F.col("gender")).alias("g"), F.col("age_group").alias("ag"), F.col("sims").alias("sims"))
    # few rows unfold into many, so they are dealt to all tasks whatever their size
    grouped = spread(_attach_pairs(coherent, vectors).groupBy("query_id", "level").agg(
        F.max("q_max_price").alias("budget"),
        *[F.collect_list(F.when(F.col("pool_slot") == s, entry)).alias(s) for s in R.BUNDLE_SLOTS]))

    def within(df: DataFrame) -> DataFrame:
        return df.filter(F.col("budget").isNull() | (F.col("total_price") <= F.col("budget")))

    def start(slots: list[str]) -> DataFrame:
        opened = grouped.select("query_id", "level", "budget", *slots[1:], F.explode(slots[0]).alias("e"))
        return within(opened.select(
            "query_id", "level", "budget", *slots[1:], F.array("e.it").alias("items"), F.col("e.p").alias("total_price"),
            F.col("e.g").alias("g"), F.col("e.ag").alias("ag"), F.lit(0.0).alias("pair_sum"), F.lit(0).alias("n_pairs")))

    def extend(left: DataFrame, slot: str, later: list[str], may_stop: bool) -> DataFrame:
        """Rows that go on with an item of the slot and, where a subset ends before it, the rows as they are (no item)."""
        kept = [c for c in left.columns if c not in R.BUNDLE_SLOTS]
        go_on = F.when(F.col("open"), F.col(slot)).otherwise(F.slice(slot, 1, 0))
        stop = F.slice(F.array(F.get(F.col(slot), F.lit(-1))), 1, F.when(~F.col("open") | F.lit(may_stop), 1).otherwise(0))
        met = left.select(*kept, *later, F.explode(F.concat(stop, go_on)).alias("e")).filter(F.col("e").isNull() | (
            F.coalesce(F.col("g") == F.col("e.g"), F.lit(True)) & F.coalesce(F.col("ag") == F.col("e.ag"), F.lit(True))))
        added = F.col("e").isNotNull()
        seen = F.array_compact(F.transform("items", lambda i: F.try_element_at(F.col("e.sims"), i["item_id"])))
        return within(met.select(
            "query_id", "level", "budget", *later, added.alias("open"), F.when(added, F.concat("items", F.array("e.it"))).otherwise(F.col("items")).alias("items"),
            (F.col("total_price") + F.coalesce("e.p", F.lit(0.0))).alias("total_price"), F.coalesce("g", "e.g").alias("g"),
            F.coalesce("ag", "e.ag").alias("ag"),
            F.when(added, F.col("pair_sum") + F.aggregate(seen, F.lit(0.0), lambda acc, v: acc + v)).otherwise(F.col("pair_sum")).alias("pair_sum"),
            F.when(added, F.col("n_pairs") + F.size(seen)).otherwise(F.col("n_pairs")).alias("n_pairs")))

    out = None
    for t_rank, (name, full) in enumerate(R.BUNDLE_TEMPLATES, start=1):
        # subsets drop the accessory, then the footwear; a bundle has at least two items
        shortest = max(2, len(full) - 2)
        partial = start(full).withColumn("open", F.lit(True))
        for i, slot in enumerate(full[1:], start=1):
            partial = extend(partial, slot, full[i + 1:], may_stop=i >= shortest)
        tagged = partial.select(
            "query_id", "level", F.lit(name).alias("template"), F.lit(t_rank).alias("template_rank"),
            (F.lit(len(full) + 1) - F.size("items")).alias("subset_rank"), F.size("items").alias("n_items"), "items",
            "total_price", "pair_sum", "n_pairs")
        out = tagged if out is None else out.unionByName(tagged)
    return out


def pair_cohesion() -> Column:
    """Mean pairwise cosine inside a combination (0 without vectors)."""
    return F.when(F.col("n_pairs") > 0, F.col("pair_sum") / F.col("n_pairs")).otherwise(0.0)


def style_agreement() -> Column:
    """0.25 per occasion and 0.15 per season shared by at least two items."""

    def shared(tag: str) -> Column:
        tags = F.flatten(F.transform("items", lambda i: F.transform(F.coalesce(i[tag], strings([])), F.lower)))
        return F.size(F.filter(F.array_distinct(tags), lambda t: F.size(F.filter(tags, lambda u: u == t)) >= 2))

    return 0.25 * shared("occasions") + 0.15 * shared("seasons")


def style_conflict() -> Column:
    """0.5 for formal with athletic, 0.7 for formal with novelty."""

    def has(cues: list[str], tag: str | None) -> Column:
        def test(i: Column) -> Column:
            hit = contains_any(F.lower(F.coalesce(i["title"], F.lit(""))), cues)
            return hit | F.array_contains(F.transform(F.coalesce(i["occasions"], strings([])), F.lower), tag) if tag else hit
        return F.exists("items", test)

    formal, athletic, novelty = has(R.FORMAL_CUES, "formal"), has(R.ATHLETIC_CUES, "workout"), has(R.NOVELTY_CUES, None)
    return F.when(formal & athletic, 0.5).otherwise(0.0) + F.when(formal & novelty, 0.7).otherwise(0.0)


def bundle_score(combos: DataFrame) -> DataFrame:
    """compat = cohesion + agreement - conflict (4 decimals); score = mean item score + 0.15 compat."""
    mean = F.aggregate(F.transform("items", lambda i: i["score"]), F.lit(0.0), lambda a, v: a + v) / F.size("items")
    return (
        combos.withColumn("cohesion", tidy(pair_cohesion(), 6))
        .withColumn("compat", tidy(F.col("cohesion") + style_agreement() - style_conflict(), 4))
        .withColumn("bundle_score", tidy(mean + R.COMPAT_WEIGHT * F.col("compat"), 6))
    )


def bundle_templates(scored: DataFrame) -> DataFrame:
    """Best combination of the largest feasible subset, per (query, depth, template)."""
    ranks = F.transform("items", lambda i: i["pool_rank"])
    w = Window.partitionBy("query_id", "level", "template_rank").orderBy(
        F.col("subset_rank"), F.col("bundle_score").desc(), ranks)
    return scored.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def bundle_depths(best: DataFrame) -> DataFrame:
    """One bundle per query: stop at the first depth with a full template; most items, then best
    score; the earliest depth and first template win ties."""
    stop = best.filter("subset_rank = 1").groupBy("query_id").agg(F.min("level").alias("_stop"))
    seen = best.join(stop, "query_id", "left").filter("_stop is null or level <= _stop")
    w = Window.partitionBy("query_id").orderBy(
        F.col("n_items").desc(), F.col("bundle_score").desc(), F.col("level"), F.col("template_rank"))
    return seen.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_stop")


def bundle_payload(queries: DataFrame, chosen: DataFrame) -> DataFrame:
    """A row for every query: items with roles and reasons, total, completeness, or a message.

    A query that is not about the catalog (is_fashion_query, default: it is) gets no bundle.
    """
    asked = F.coalesce("is_fashion_query", F.lit(True)) if "is_fashion_query" in queries.columns else F.lit(True)
    chosen = queries.filter(asked).select("query_id").join(chosen, "query_id")
    slots_of = F.create_map(*[x for name, slots in R.BUNDLE_TEMPLATES for x in (F.lit(name), strings(slots))])
    out = queries.join(chosen, "query_id", "left")
    roles = F.transform("items", lambda i: F.lower(i["slot"]))
    missing = F.array_except(F.element_at(slots_of, F.col("template")), roles)
    found = F.col("items").isNotNull()
    rows = F.transform("items", lambda i: F.struct(
        i["item_id"].alias("item_id"), i["title"].alias("title"), i["price"].alias("price"),
        i["store"].alias("store"), i["slot"].alias("slot"), i["gender"].alias("gender"),
        i["age_group"].alias("age_group"), F.round(i["score"], 4).alias("score"),
        F.round(i["sim"], 4).alias("similarity"),
        explain_item(i["title"], i["store"], i["colors"], i["seasons"], i["occasions"], F.col("query"),
                     F.col("brand"), F.col("colors"), F.col("season"), F.col("occasion"), F.lower(i["slot"])).alias("reason")))
    return out.select(
        "query_id", rows.alias("items"), F.round("total_price", 2).alias("total_price"),
        F.when(found, F.size(missing) == 0).alias("complete"), missing.alias("missing_slots"), "template",
        F.when(~asked, "not_a_fashion_query").when(found, F.lit(None).cast("string")).when(F.col("max_price").isNotNull(), "no_outfit_within_budget")
        .otherwise("insufficient_items_for_outfit").alias("message"))


def missing_ids(candidates: DataFrame, fetched: DataFrame, item: str = "item_id") -> DataFrame:
    """Candidate ids not fetched yet."""
    return candidates.select(item).distinct().join(fetched.select(item), item, "left_anti")


def compose(cands: DataFrame, bounds: DataFrame, vectors: DataFrame, *, as_served: bool = False) -> DataFrame:
    """Candidates at all depths -> the chosen bundle per query."""
    pools = slot_pools(cands, bounds, as_served=as_served)
    coherent = coherence_filter(pools, target_gender(pools))
    return bundle_depths(bundle_templates(bundle_score(bundle_combos(coherent, vectors))))
