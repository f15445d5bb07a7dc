"""Catalog change as DataFrame -> DataFrame steps; the versioned store writes their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_hash

MERGE_COLUMNS = ("version", "created_at", "updated_at", "is_deleted")


def upsert_catalog(catalog: DataFrame, feed: DataFrame, now: Column, item: str = "item_id") -> DataFrame:
    """New ids start at version 1; known ids take the feed's values, version + 1, keep their
    creation time and come back if they were deleted.  `feed` has one row per id."""
    data = [c for c in catalog.columns if c not in (item, *MERGE_COLUMNS)]
    new = feed.select(F.col(item), *[F.col(c).alias(f"n_{c}") for c in data], F.lit(True).alias("_new"))
    both = catalog.withColumn("_old", F.lit(True)).join(new, item, "full_outer")
    fresh = F.col("_new").isNotNull()
    return both.select(
        item, *[F.when(fresh, F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in data],
        F.when(fresh, F.coalesce(F.col("version") + 1, F.lit(1))).otherwise(F.col("version")).cast("bigint").alias("version"),
        F.when(F.col("_old").isNull(), now).otherwise(F.col("created_at")).alias("created_at"),
        F.when(fresh, now).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(fresh, F.lit(False)).otherwise(F.col("is_deleted")).alias("is_deleted"))


def soft_delete(catalog: DataFrame, ids: DataFrame, item: str = "item_id") -> DataFrame:
    """Mark the listed ids deleted; other rows pass through."""
    wanted = ids.select(item).distinct().withColumn("_del", F.lit(True))
    return catalog.join(wanted, item, "left").withColumn(
        "is_deleted", F.col("is_deleted") | F.coalesce("_del", F.lit(False))).drop("_del")


def delete_statuses(catalog: DataFrame, ids: DataFrame, item: str = "item_id") -> DataFrame:
    """(item, status): deleted, already_deleted or not_found."""
    state = catalog.select(item, F.col("is_deleted").alias("_gone"))
    return ids.select(item).distinct().join(state, item, "left").select(
        item, F.when(F.col("_gone").isNull(), "not_found").when(F.col("_gone"), "already_deleted")
        .otherwise("deleted").alias("status"))


def apply_triage(catalog: DataFrame, triaged: DataFrame, item: str = "item_id") -> DataFrame:
    """Rejected and quarantined rows go inactive; accepted rows take the cleaned values and come back."""
    t = triaged.select(item, F.col("status").alias("_st"), F.col("clean_title").alias("_t"), F.col("slot").alias("_s"),
                       F.col("accessory_type").alias("_a"), F.col("quality_qc").alias("_q"))
    ok, known = F.col("_st") == "accepted", F.col("_st").isNotNull()
    out = catalog.join(t, item, "left")

    def take(new: str, old: str) -> Column:
        return F.when(ok, F.col(new)).otherwise(F.col(old)).alias(old)

    fixed = {"title": take("_t", "title"), "slot": take("_s", "slot"), "accessory_type": take("_a", "accessory_type"),
             "quality_qc": take("_q", "quality_qc"),
             "is_deleted": F.when(known, ~ok).otherwise(F.col("is_deleted")).alias("is_deleted")}
    return out.select(*[fixed.get(c, F.col(c)) for c in catalog.columns])


def stale_embeddings(items: DataFrame, stored: DataFrame, model: str, item: str = "item_id",
                     text: str = "search_text") -> DataFrame:
    """(item, text, text_hash, stale): stale when there is no vector, the text or the model changed."""
    s = stored.select(item, F.col("text_hash").alias("_h"), F.col("model_name").alias("_m"))
    fresh = items.select(item, text, text_hash(F.col(text)).alias("text_hash"))
    same = (F.col("_h") == F.col("text_hash")) & (F.col("_m") == model)
    return fresh.join(s, item, "left").withColumn("stale", ~F.coalesce(same, F.lit(False))).drop("_h", "_m")


def refresh_embeddings(items: DataFrame, stored: DataFrame, encode, model: str) -> DataFrame:
    """Keep vectors that are current, encode only the stale texts."""
    checked = stale_embeddings(items, stored, model)
    kept = checked.filter("not stale").select("item_id", "text_hash").join(
        stored.select("item_id", "model_name", "vec"), "item_id")
    new = encode(checked.filter("stale").select("item_id", "text_hash", "search_text"))
    return kept.select("item_id", "text_hash", "model_name", "vec").unionByName(
        new.select("item_id", "text_hash", F.lit(model).alias("model_name"), "vec"))


def index_integrity(active: DataFrame, indexed: DataFrame, item: str = "item_id") -> DataFrame:
    """One row: live ids, indexed ids, orphans on either side, consistent flag."""
    a = active.select(item).distinct().withColumn("_a", F.lit(1))
    b = indexed.select(item).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, item, "full_outer")
    return both.agg(
        F.count("_a").alias("n_active"), F.count("_b").alias("n_indexed"),
        F.count_if(F.col("_b").isNull()).alias("missing_in_index"),
        F.count_if(F.col("_a").isNull()).alias("orphans_in_index")).withColumn(
        "consistent", (F.col("missing_in_index") == 0) & (F.col("orphans_in_index") == 0))


def require_integrity(active: DataFrame, indexed: DataFrame) -> None:
    """Stop a job whose index and catalog disagree."""
    row = index_integrity(active, indexed).first()
    if not row["consistent"]:
        raise ValueError(f"index and catalog differ: {row.asDict()}")
