"""Record validation with reason codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.exprs import blank, matches, strings, strip, unicode_regex
from .dedup import flag_first


def drop_reason(title: Column, price: Column, require_price: bool = True,
                min_title_length: int = R.MIN_TITLE_LENGTH) -> Column:
    """First failing rule of a raw record, or null when it is kept."""
    clean = strip(title)
    out = (
        F.when(blank(title), "no_title")
        .when(F.length(clean) < min_title_length, "short_title")
        .when(matches(clean, R.NON_FASHION), "non_fashion_keyword")
    )
    if require_price:
        number = price.try_cast("double")
        out = out.when(price.isNull(), "no_price").when(number.isNull() | (number <= 0), "invalid_price")
    return out


def validate_records(records: DataFrame, title: str = "title", price: str = "price",
                     require_price: bool = True) -> DataFrame:
    return records.withColumn("drop_reason", drop_reason(F.col(title), F.col(price), require_price))


def validate_batch(batch: DataFrame, catalog: DataFrame, *, item: str = "item_id", seq: str = "seq",
                   title: str = "title", price: str = "price") -> DataFrame:
    """Result of each record of an update batch, keyed by its input position.

    status created / updated / rejected, with reason and resulting version.  The first record
    of an id wins; later ones are duplicates whatever their content.
    """
    named = batch.withColumn(item, F.nullif(strip(F.col(item).cast("string")), F.lit("")))
    flagged = flag_first(named, [item], [seq], unique=[seq], flag="_first")
    reason = (
        F.when(F.col(item).isNull(), "no_parent_asin")
        .when(~F.col("_first"), "duplicate_in_batch")
        .otherwise(drop_reason(F.col(title), F.col(price)))
    )
    known = catalog.select(item, F.col("version").alias("_version"))
    out = flagged.withColumn("reason", reason).join(known, item, "left")
    ok = F.col("reason").isNull()
    return out.select(
        seq, F.coalesce(item, F.lit("unknown")).alias(item),
        F.when(~ok, "rejected").when(F.col("_version").isNull(), "created").otherwise("updated").alias("status"),
        F.coalesce("reason", F.lit("")).alias("reason"),
        F.when(ok, F.coalesce(F.col("_version") + 1, F.lit(1))).otherwise(0).cast("bigint").alias("version"))


def price_check(price: Column, low: float = R.QC_PRICE_MIN, high: float = R.QC_PRICE_MAX) -> Column:
    """struct(price, reason): missing, unreadable, not positive, outside the plausible range."""
    number = price.try_cast("double")
    reason = (
        F.when(price.isNull(), "missing_price").when(number.isNull(), "invalid_price_format")
        .when(number <= 0, "zero_or_negative_price").when((number < low) | (number > high), "price_outlier")
    )
    return F.struct(F.when(number > 0, F.round(number, 2)).alias("price"), reason.alias("reason"))


def relevance_check(title: Column, store: Column, features: Column, description: Column) -> Column:
    """Null for wearable goods, else `non_fashion: <words that gave it away>`."""
    text = F.lower(F.concat_ws(" ", title, F.coalesce(store, F.lit("")),
                               F.array_join(F.coalesce(features, strings([])), " "),
                               F.coalesce(description, F.lit(""))))
    found = F.regexp_extract(text, unicode_regex(R.STRONG_NON_FASHION), 0)
    protected = matches(title, R.FASHION_OVERRIDE)
    return F.when(~protected & (found != ""), F.concat(F.lit("non_fashion: "), found))
