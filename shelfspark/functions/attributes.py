"""Attributes derived from a product record, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .exprs import (all_matches, blank, clamp, contains_any, first_match, matches, strings,
                    unicode_regex, word_rules)
from .text import word_count


def derive_gender(department: Column, title: Column) -> Column:
    """Audience: the department decides when it names one, else the title."""
    dept = F.lower(F.trim(F.coalesce(department, F.lit(""))))
    d_men, d_women = matches(dept, R.DEPT_MEN), matches(dept, R.DEPT_WOMEN)
    t_men, t_women = matches(title, R.TITLE_MEN), matches(title, R.TITLE_WOMEN)
    return (
        F.when(F.contains(dept, F.lit("unisex")) | (d_men & d_women), "unisex")
        .when(d_women, "women").when(d_men, "men")
        .when(matches(title, R.TITLE_UNISEX) | (t_men & t_women), "unisex")
        .when(t_women, "women").when(t_men, "men")
        .otherwise("unknown")
    )


def derive_age_group(title: Column) -> Column:
    return (
        F.when(matches(title, R.STRONG_KIDS), "kids")
        .when(matches(title, R.WATCH_BAND), "adult")
        .when(matches(title, R.SHARED_MARKETING) | matches(title, R.ADULT), "adult")
        .when(matches(title, R.GENERAL_KIDS), "kids")
        .otherwise("adult")
    )


def slot_of(text: Column) -> Column:
    """First slot rule that fires on one text, or null."""
    return first_match(text, R.SLOT_RULES)


def derive_slot(title: Column, features: Column, description: Column) -> Column:
    """Slot from the title, else from the joined features, else from the description."""
    joined = F.array_join(F.coalesce(features, strings([])), " ")
    return F.coalesce(slot_of(title), slot_of(joined), slot_of(description), F.lit("unknown"))


def slot_trace(text: Column) -> Column:
    """Which rule fired and on which words: struct(slot, rule, keyword)."""
    out = None
    for number, (slot, pattern) in enumerate(R.SLOT_RULES, start=1):
        fired = F.struct(
            F.lit(slot).alias("slot"), F.lit(number).alias("rule"),
            F.regexp_extract(text, unicode_regex(pattern), 0).alias("keyword"))
        hit = matches(text, pattern)
        out = F.when(hit, fired) if out is None else out.when(hit, fired)
    return out.otherwise(F.struct(F.lit("unknown").alias("slot"), F.lit(0).alias("rule"),
                                  F.lit("").alias("keyword")))


def accessory_type_of(title: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) != "",
                  first_match(title, R.ACCESSORY_RULES, F.lit("other")))


def derive_accessory_type(title: Column, slot: Column) -> Column:
    return F.when(slot == "accessory", accessory_type_of(title))


def derive_colors(title: Column) -> Column:
    """Canonical names of synonyms first, then the vocabulary in its own order."""
    synonyms = [(to, rf"\b{word}\b") for word, to in R.COLOR_SYNONYMS.items()]
    return all_matches(title, synonyms + word_rules(R.COLOR_VOCABULARY))


def derive_seasons(text: Column) -> Column:
    return all_matches(text, R.SEASON_RULES)


def derive_occasions(text: Column) -> Column:
    return all_matches(text, R.OCCASION_RULES)


def bayesian_quality(average_rating: Column, rating_number: Column,
                     global_mean: Column | float = R.GLOBAL_MEAN_RATING,
                     m: float = R.BAYES_M) -> Column:
    """Rating pulled toward the global mean by its number of votes, 4 decimals."""
    mean = global_mean if isinstance(global_mean, Column) else F.lit(float(global_mean))
    votes = F.coalesce(rating_number.cast("double"), F.lit(0.0))
    rating = F.when(average_rating > 0, average_rating.cast("double")).otherwise(mean)
    weighted = votes / (votes + m) * rating + F.lit(m) / (votes + m) * mean
    # the inner rounding settles ties on decimal digits, not on binary noise
    return F.round(F.round(F.when(votes > 0, weighted).otherwise(mean), 10), 4)


def slot_confidence(title: Column, features: Column, description: Column) -> Column:
    """struct(slot, confidence, accessory_type): primary rules, then secondary title rules."""
    primary = derive_slot(title, features, description)

    def pack(slot: Column, confidence: str, kind: Column) -> Column:
        return F.struct(slot.alias("slot"), F.lit(confidence).alias("confidence"),
                        kind.cast("string").alias("accessory_type"))

    out = F.when(primary != "unknown", pack(primary, "high", derive_accessory_type(title, primary)))
    for slot, _fallback, pattern in R.SECONDARY_SLOT_RULES:
        kind = accessory_type_of(title) if slot == "accessory" else F.lit(None)
        out = out.when(matches(title, pattern), pack(F.lit(slot), "high", kind))
    return out.otherwise(pack(F.lit("unknown"), "low", F.lit(None)))


def quality_explain(title: Column, price: Column, slot: Column, confidence: Column, store: Column,
                    features: Column, description: Column, colors: Column,
                    average_rating: Column) -> Column:
    """struct of the five parts of the completeness score and their rounded total."""
    words = word_count(title)
    known = slot != "unknown"
    five = F.lit(0.05)
    meta = (
        F.when(~blank(store) & (F.lower(store) != "unknown"), five).otherwise(0.0)
        + F.when(F.size(F.coalesce(features, strings([]))) > 0, five).otherwise(0.0)
        + F.when(F.length(F.trim(F.coalesce(description, F.lit("")))) >= 15, five).otherwise(0.0)
        + F.when(F.size(F.coalesce(colors, strings([]))) > 0, five).otherwise(0.0)
    )
    parts = {
        "title_part": F.when((F.length(title) >= 20) & (words >= 4), 0.25)
        .when(words >= 3, 0.18).otherwise(0.10),
        "price_part": F.when(price > 0, 0.15).otherwise(0.0),
        "slot_part": F.when(known & (confidence == "high"), 0.25)
        .when(known & (confidence == "medium"), 0.15).otherwise(0.0),
        "meta_part": meta,
        "rating_part": F.when(average_rating > 0, 0.15).otherwise(0.05),
    }
    total = sum(parts.values(), F.lit(0.0))
    return F.struct(*[F.round(v, 2).alias(k) for k, v in parts.items()],
                    F.round(clamp(total), 3).alias("score"))


def effective_slots(title: Column, slot: Column) -> Column:
    """Slots an item counts for when it is filtered (multi-slot garments, misread titles)."""
    raw = F.lower(F.coalesce(slot, F.lit("unknown")))
    low = F.lower(F.coalesce(title, F.lit("")))
    lounge = F.contains(low, F.lit("short")) & contains_any(low, R.LOUNGE_WORDS)
    pendant = F.contains(low, F.lit("pendant")) & F.contains(low, F.lit("costume"))
    return (
        F.when(matches(title, R.PAJAMA_SHORTS) | lounge,
               F.array_distinct(F.array(raw, F.lit("bottom"), F.lit("full_body"))))
        .when(matches(title, R.COSTUME_JEWELRY) | pendant, F.array(F.lit("accessory")))
        .when(matches(title, R.SHOE_ACCESSORY), F.array(F.lit("accessory")))
        .when(matches(title, R.JACKET_SIZING), F.array(F.lit("top")))
        .otherwise(F.array(raw))
    )


def effective_age(title: Column, age_group: Column) -> Column:
    """Age group an item counts for when it is filtered."""
    low = F.lower(F.coalesce(title, F.lit("")))
    charm = contains_any(low, ["shoe charm", "clog pin"]) & ~matches(title, R.CHARM_AGE_WORDS)
    adult = matches(title, R.CPR) | matches(title, R.SASH) | charm
    return F.when(adult, "adult").otherwise(F.lower(F.coalesce(age_group, F.lit("adult"))))


def read_time_slot_fix(title: Column, slot: Column) -> Column:
    """Stored bottoms whose title now reads as a top are served as tops."""
    return F.when((slot == "bottom") & (slot_of(title) == "top"), "top").otherwise(slot)
