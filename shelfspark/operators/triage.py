"""Quality triage and the raw record -> product transformation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import attributes as A
from ..functions import rules as R
from ..functions import text as X
from ..functions.exprs import blank, strings, strip
from ..session import materialize
from .dedup import dup_id, dup_signature, spread
from .validate import price_check, relevance_check


def normalize_record(raw: DataFrame) -> DataFrame:
    """Trim, null out blanks, round the price, read list-or-string descriptions, drop empty features."""
    d = F.col("description")
    kind = raw.schema["description"].dataType.typeName() if "description" in raw.columns else None
    if kind == "array":
        text = F.array_join(F.filter(d, lambda s: F.coalesce(s, F.lit("")) != ""), " ")
        described = F.when(d.isNull(), None).otherwise(text)
    elif kind == "string":
        parsed = F.from_json(F.when(F.ltrim(d).startswith("["), d), "array<string>")
        items = F.filter(parsed, lambda s: F.coalesce(s, F.lit("")) != "")
        described = F.when(parsed.isNotNull(), F.array_join(items, " ")).otherwise(F.nullif(d, F.lit("")))
    else:
        described = F.lit(None).cast("string")
    features = F.col("features") if "features" in raw.columns else F.lit(None).cast("array<string>")
    return raw.withColumns({
        "item_id": strip(F.col("item_id").cast("string")),
        "title": strip(F.coalesce("title", F.lit(""))),
        "store": F.when(~blank(F.col("store")), strip(F.col("store"))),
        "price": F.round(F.col("price").try_cast("double"), 2),
        "features": F.filter(F.coalesce(features, strings([])), lambda s: F.coalesce(s, F.lit("")) != ""),
        "description": described,
    })


def derive_attributes(records: DataFrame, reviews: str = "review_snippets", global_mean: Column | float =
                      R.GLOBAL_MEAN_RATING) -> DataFrame:
    """Attribute columns of normalised records; one narrow projection per dependency level."""
    snippets = F.coalesce(F.col(reviews), strings([])) if reviews in records.columns else strings([])
    department = F.try_element_at(F.col("details"), F.lit("Department")) if "details" in records.columns \
        else F.lit(None).cast("string")
    title = F.col("title")
    context = F.concat_ws(" ", title, F.array_join("features", " "), F.col("description"),
                          F.array_join(F.col(reviews), " "))
    return (
        records.withColumn(reviews, snippets)
        .withColumns({
            "gender": A.derive_gender(department, title), "age_group": A.derive_age_group(title),
            "slot": A.derive_slot(title, F.col("features"), F.col("description")),
            "colors": A.derive_colors(title), "_context": context,
            "quality_bayes": A.bayesian_quality(F.col("average_rating"), F.col("rating_number"), global_mean),
        })
        .withColumns({
            "accessory_type": A.derive_accessory_type(title, F.col("slot")),
            "seasons": A.derive_seasons(F.col("_context")), "occasions": A.derive_occasions(F.col("_context")),
            "search_text": X.search_text(title, F.col("store"), F.col("gender"), F.col("age_group"), F.col("slot"),
                                         F.col("features"), F.col("description"), F.col(reviews)),
        })
        .drop("_context")
    )


def transform_catalog(raw: DataFrame, global_mean: Column | float = R.GLOBAL_MEAN_RATING, dealt: bool = False) -> DataFrame:
    """Raw records -> products: normalise, derive, pick the image, start at version 1.

    `dealt` says that the records lie in even parts already."""
    # the rules take about 0.16 ms a record in one task, so even parts are worth the move
    out = derive_attributes(normalize_record(raw if dealt else spread(raw)), global_mean=global_mean)
    image = X.main_image(F.col("images")) if "images" in raw.columns else F.lit(None).cast("string")
    return out.withColumns({"image_url": image, "version": F.lit(1).cast("bigint"), "is_deleted": F.lit(False)}).drop(
        "images", "details", "videos", "categories", "main_category", "bought_together")


def triage(records: DataFrame, decode_html: bool = True) -> DataFrame:
    """status accepted / quarantined / rejected with reasons, score parts and derived attributes."""
    raw = X.html_unescape(F.col("title")) if decode_html else F.col("title")
    store, features, description = F.col("store"), F.col("features"), F.col("description")
    department = F.try_element_at(F.col("details"), F.lit("Department")) if "details" in records.columns \
        else F.lit(None).cast("string")
    checked = (
        records.withColumn("clean_title", X.clean_text(raw))
        .withColumn("_t", X.title_check(F.col("title"), F.col("clean_title")))
        .withColumn("_p", price_check(F.col("price")))
        .withColumn("_r", F.when(F.col("_t").isNull(), relevance_check(
            F.col("clean_title"), store, features, description)))
        .withColumn("_s", A.slot_confidence(F.col("clean_title"), features, description))
    )
    title = F.col("clean_title")
    kept = checked.withColumns({
        "price": F.col("_p.price"),
        "_hard": F.array_compact(F.array("_t", "_p.reason", "_r")),
        "gender": A.derive_gender(department, title), "age_group": A.derive_age_group(title),
        "colors": A.derive_colors(title),
    })
    scored = kept.withColumn("_q", A.quality_explain(
        title, F.col("price"), F.col("_s.slot"), F.col("_s.confidence"), store, features, description,
        F.col("colors"), F.col("average_rating")))
    rejected = F.size("_hard") > 0
    unknown = (F.col("_s.slot") == "unknown") | (F.col("_s.confidence") == "low")
    weak = F.col("_q.score") < R.QC_MIN_SCORE
    status = F.when(rejected, "rejected").when(unknown | weak, "quarantined").otherwise("accepted")
    context = F.concat_ws(" ", title, F.array_join("features", " "), F.coalesce(description, F.lit("")))
    failed_title = F.when(F.col("_t").isin("missing_title", "meaningless_title"), F.col("title")).otherwise(title)
    return scored.withColumns({
        "status": status,
        "reasons": F.when(rejected, F.col("_hard")).when(unknown, strings(["unknown_slot"]))
        .when(weak, strings(["low_quality_score"])).otherwise(strings([])),
        "slot": F.when(rejected, "unknown").otherwise(F.col("_s.slot")),
        "accessory_type": F.when(~rejected, F.col("_s.accessory_type")),
        "confidence": F.when(rejected, "low").otherwise(F.col("_s.confidence")),
        "quality_qc": F.when(rejected, 0.0).otherwise(F.col("_q.score")),
        "seasons": A.derive_seasons(context), "occasions": A.derive_occasions(context),
        "search_text": F.when(status == "accepted", X.qc_search_text(
            title, store, F.col("gender"), F.col("age_group"), F.col("_s.slot"), features)),
        "clean_title": failed_title,
    }).drop("_t", "_p", "_r", "_s", "_hard", "_q")


def triage_catalog(records: DataFrame, decode_html: bool = True) -> DataFrame:
    """Triage plus duplicate rejection: repeated ids first, then repeated accepted signatures.

    Triaged records are written once; duplicates are found on their narrow columns, and only their flags are joined back.
    """
    done = materialize(triage(spread(records), decode_html), "triaged")
    marked = dup_id(done.select("item_id", "seq", "status", "store", "clean_title", "price")).withColumn(
        "status", F.when(F.col("duplicate_id"), "rejected").otherwise(F.col("status")))
    repeats = dup_signature(marked).filter("duplicate_id OR duplicate_product").select(
        "seq", F.when(F.col("duplicate_id"), "duplicate_id").otherwise("duplicate_product").alias("_repeat"))
    repeated = F.col("_repeat").isNotNull()
    return done.join(repeats, "seq", "left").withColumns({
        "status": F.when(repeated, "rejected").otherwise(F.col("status")),
        "reasons": F.when(repeated, F.array("_repeat")).otherwise(F.col("reasons")),
    }).drop("_repeat")
