"""Counting reports over the catalog, its triage and its audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import attributes as A
from ..functions import rules as R
from ..functions.exprs import blank, matches, strings


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0)), digits)


def global_mean_rating(items: DataFrame, rating: str = "average_rating", default: float = R.GLOBAL_MEAN_RATING) -> DataFrame:
    """Mean of the positive ratings, one row."""
    return items.agg(F.round(F.coalesce(F.avg(F.when(F.col(rating) > 0, F.col(rating))), F.lit(default)), 6)
                     .alias("global_mean"))


def count_active(items: DataFrame) -> DataFrame:
    return items.agg(F.count_if(~F.coalesce(F.col("is_deleted"), F.lit(False))).alias("n_active"))


def counts_with_share(df: DataFrame, by: str, whole: Column | None = None) -> DataFrame:
    """count and percentage per value; the total is one window over the few grouped rows."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    total = whole if whole is not None else F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("pct", pct(F.col("n"), total))


def drop_report(validated: DataFrame) -> DataFrame:
    """Rows and share per drop reason; kept rows count under `kept`."""
    return counts_with_share(validated.withColumn("reason", F.coalesce("drop_reason", F.lit("kept"))).select("reason"), "reason")


def coverage_report(products: DataFrame, columns: tuple[str, ...] = ("slot", "gender", "age_group")) -> DataFrame:
    """count and share per value of each attribute, from one pass (grouping sets)."""
    grouped = products.groupingSets([[F.col(c)] for c in columns], *[F.col(c) for c in columns]).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id(*[F.col(c) for c in columns]).alias("_g"))
    attribute, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        only = (1 << len(columns)) - 1 - (1 << (len(columns) - 1 - i))
        attribute = F.when(F.col("_g") == only, c).otherwise(attribute)
        value = F.when(F.col("_g") == only, F.col(c)).otherwise(value)
    out = grouped.select(attribute.alias("attribute"), value.alias("value"), "n")
    return out.withColumn("pct", pct(F.col("n"), F.sum("n").over(Window.partitionBy("attribute"))))


def completeness_report(products: DataFrame) -> DataFrame:
    """Empty descriptions, features and colours, and products with reviews: one scan, one row each."""

    def empty(c: str) -> Column:
        return F.size(F.coalesce(c, strings([]))) == 0

    tests = {
        "empty_description": blank(F.col("description")), "empty_features": empty("features"),
        "no_extracted_color": empty("colors"), "with_review_snippets": ~empty("review_snippets"),
    }
    row = products.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(t).alias(k) for k, t in tests.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("n")) for k in tests])
    return row.select("total", F.explode(pairs).alias("m")).select(
        "m.measure", "m.n", pct(F.col("m.n"), F.col("total")).alias("pct"))


def top_words(products: DataFrame, n: int = 20, threshold: float = 0.30) -> DataFrame:
    """Most frequent words of unknown-slot titles; empty unless over `threshold` are unknown."""
    share = products.agg(F.avg((F.col("slot") == "unknown").cast("double")).alias("s")).select("s").scalar()
    words = F.regexp_extract_all(F.lower("title"), F.lit(r"(?U)\b([a-z]{3,})\b"), F.lit(1))
    counts = (
        products.filter(F.col("slot") == "unknown").filter(share > threshold)
        .select(F.explode(words).alias("word")).filter(~F.col("word").isin(R.TITLE_STOPWORDS))
        .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.orderBy(F.col("n").desc(), "word").limit(n)


def triage_report(triaged: DataFrame) -> DataFrame:
    """(section, value, n): totals, slots before triage, accepted slots and genders; one pass."""
    accepted = F.col("status") == "accepted"
    cells = F.array_compact(F.array(
        F.struct(F.lit("status").alias("section"), F.col("status").alias("value")),
        F.struct(F.lit("slot_all").alias("section"), F.col("stored_slot").alias("value")),
        F.when(accepted, F.struct(F.lit("slot_accepted").alias("section"), F.col("slot").alias("value"))),
        F.when(accepted, F.struct(F.lit("gender_accepted").alias("section"), F.col("gender").alias("value"))),
    ))
    return triaged.select(F.explode(cells).alias("c")).groupBy("c.section", "c.value").agg(F.count(F.lit(1)).alias("n"))


def reason_counts(triaged: DataFrame) -> DataFrame:
    """Rows per status and reason; text after a colon is detail."""
    reason = F.trim(F.split_part(F.col("reason"), F.lit(":"), F.lit(1)))
    return triaged.select("status", F.explode("reasons").alias("reason")).groupBy(
        "status", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def quality_histogram(triaged: DataFrame, score: str = "quality_qc") -> DataFrame:
    """0.1-wide buckets of the completeness score."""
    low = F.floor(F.col(score) * 10).cast("bigint")
    label = F.concat((low / 10).cast("decimal(4,1)").cast("string"), F.lit("-"),
                     ((low + 1) / 10).cast("decimal(4,1)").cast("string"))
    return triaged.groupBy(label.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def confidence_distribution(triaged: DataFrame) -> DataFrame:
    return counts_with_share(triaged.select("confidence"), "confidence")


# ------------------------------------------------------------------------ audits
ATTRIBUTES = ("slot", "gender", "age_group")


def audit_pairs(audit: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """(all other columns, attribute, derived, true_value): one row per record and audited attribute."""
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.trim(f"derived_{a}").alias("derived"), F.trim(f"true_{a}").alias("true_value")) for a in attributes])
    rest = [c for c in audit.columns if c not in {f"{side}_{a}" for a in attributes for side in ("derived", "true")}]
    return audit.select(*rest, F.explode(pairs).alias("_p")).select(*rest, "_p.*")


def confusion_matrix(audit: DataFrame) -> DataFrame:
    """Counts per (attribute, derived, true value); pairs that do not occur have no row."""
    return audit_pairs(audit).groupBy("attribute", "derived", "true_value").agg(F.count(F.lit(1)).alias("n"))


def class_precision(audit: DataFrame) -> DataFrame:
    """Rows, correct rows and precision per derived class, per attribute (derived `all`) and overall (both `all`), in one pass."""
    pairs = audit_pairs(audit)
    right = F.count_if(F.col("derived") == F.col("true_value"))
    sets = pairs.groupingSets([["attribute", "derived"], ["attribute"], []], "attribute", "derived").agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"), right.alias("correct"), pct(right, F.count(F.lit(1)), 1).alias("precision_pct"))
    return sets.select(F.when(F.col("_g") == 3, "all").otherwise(F.col("attribute")).alias("attribute"),
                       F.when(F.col("_g") > 0, "all").otherwise(F.col("derived")).alias("derived"), "n", "correct", "precision_pct")


def misclassified(audit: DataFrame) -> DataFrame:
    return audit_pairs(audit).filter(F.col("derived") != F.col("true_value"))


def annotation_status(audit: DataFrame, allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """Per label field: filled rows, share, invalid labels; plus a row for fully labelled records."""
    allowed = allowed or {"true_slot": R.SLOTS, "true_gender": R.GENDERS, "true_age_group": R.AGE_GROUPS}
    label = {f: F.lower(F.trim(F.coalesce(f, F.lit("")))) for f in allowed}
    filled = {f: label[f] != "" for f in allowed}
    everything = F.lit(True)
    for f in allowed:
        everything = everything & filled[f]
    row = audit.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(everything).alias("all_n"),
        *[F.count_if(filled[f]).alias(f"{f}_n") for f in allowed],
        *[F.count_if(filled[f] & ~label[f].isin(vals)).alias(f"{f}_bad") for f, vals in allowed.items()])
    lines = [F.struct(F.lit(f).alias("field"), F.col(f"{f}_n").alias("n"), F.col(f"{f}_bad").alias("invalid")) for f in allowed]
    lines.append(F.struct(F.lit("all").alias("field"), F.col("all_n").alias("n"), F.lit(0).cast("bigint").alias("invalid")))
    return row.select("total", F.explode(F.array(*lines)).alias("l")).select(
        "l.field", "l.n", pct(F.col("l.n"), F.col("total"), 1).alias("pct"), "l.invalid")


def invalid_labels(audit: DataFrame, field: str, allowed: list[str]) -> DataFrame:
    label = F.lower(F.trim(F.coalesce(field, F.lit(""))))
    return audit.filter((label != "") & ~label.isin(allowed))


def unknown_recovery(products: DataFrame) -> DataFrame:
    """Unknown-slot rows a second pass over the title would classify: (new_slot, n, pct)."""
    title = F.col("title")
    second = A.slot_of(title)
    for slot, _kind, pattern in R.SECONDARY_SLOT_RULES:
        second = F.coalesce(second, F.when(matches(title, pattern), slot))
    unknown = products.filter(F.col("slot") == "unknown").select(
        F.coalesce(second, F.lit("unknown")).alias("new_slot"))
    return counts_with_share(unknown, "new_slot").filter(F.col("new_slot") != "unknown")


def grade_precision(grades: DataFrame, k: int = 5) -> DataFrame:
    """Strict and lenient P@5 per query from human grades."""
    g = F.lower(F.trim("grade"))
    rel, border, bad = (F.count_if(g == v) for v in ("relevant", "borderline", "irrelevant"))
    return grades.groupBy(F.trim("query").alias("query")).agg(
        rel.alias("relevant"), border.alias("borderline"), bad.alias("irrelevant"),
        F.round(rel / k, 6).alias("strict_p5"), F.round((rel + border) / k, 6).alias("lenient_p5"))


PARSE_FIELDS = ["is_fashion_query", "language", "gender", "age_group", "max_price", "min_price", "slots"]


def field_accuracy(parsed: DataFrame, expected: DataFrame, key: str = "query_id") -> DataFrame:
    """(field, correct, total, pct); arrays compare as sets."""

    def same(f: str) -> Column:
        got, want = F.col(f"p_{f}"), F.col(f"e_{f}")
        if f == "slots":
            got, want = (F.array_sort(F.array_distinct(F.coalesce(c, strings([])))) for c in (got, want))
        return got.eqNullSafe(want)

    joined = parsed.select(key, *[F.col(f).alias(f"p_{f}") for f in PARSE_FIELDS]).join(
        expected.select(key, *[F.col(f).alias(f"e_{f}") for f in PARSE_FIELDS]), key)
    row = joined.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(same(f)).alias(f) for f in PARSE_FIELDS])
    lines = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("correct")) for f in PARSE_FIELDS])
    return row.select("total", F.explode(lines).alias("l")).select(
        "l.field", "l.correct", "total", pct(F.col("l.correct"), F.col("total"), 1).alias("pct"))
