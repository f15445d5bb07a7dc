"""Query understanding: constraints read from query text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules as R
from .exprs import (all_matches, any_word, contains_any, first_match, matches, strings, strip,
                    unicode_regex, word_rules)

PARSE_SCHEMA = (
    "is_fashion_query BOOLEAN, normalized_query_en STRING, language STRING, gender STRING, "
    "age_group STRING, min_price DOUBLE, max_price DOUBLE, brand STRING, colors ARRAY<STRING>, "
    "slots ARRAY<STRING>, season STRING, occasion STRING, warnings ARRAY<STRING>, "
    "is_explicit_slot BOOLEAN, is_explicit_gender BOOLEAN, confidence MAP<STRING,DOUBLE>"
)


def detect_language(query: Column) -> Column:
    """Script ranges decide Tamil and Hindi; marker words decide French, then Spanish."""
    out = None
    for lang, pattern in R.SCRIPT_RANGES:
        hit = F.coalesce(query.rlike(pattern), F.lit(False))
        out = F.when(hit, lang) if out is None else out.when(hit, lang)
    for lang, pattern in R.LANGUAGE_MARKERS:
        out = out.when(matches(query, pattern), lang)
    return out.otherwise("en")


def _amount(query: Column, pattern: str, groups: int = 1) -> Column:
    found = [F.nullif(F.regexp_extract(query, unicode_regex(pattern), g), F.lit(""))
             for g in range(1, groups + 1)]
    return F.coalesce(*found).try_cast("double")


def query_price(query: Column) -> Column:
    """struct(min_price, max_price, warnings): foreign currencies give a warning, no bounds."""
    foreign = matches(query, R.NON_USD)
    return F.struct(
        F.when(~foreign, _amount(query, R.MIN_PRICE, 2)).alias("min_price"),
        F.when(~foreign, _amount(query, R.MAX_PRICE, 2)).alias("max_price"),
        F.when(foreign, strings(["price_currency_not_supported"])).otherwise(strings([]))
        .alias("warnings"),
    )


def query_gender(query: Column) -> Column:
    male = matches(query, R.Q_MEN) | matches(query, R.Q_BOYS)
    female = matches(query, R.Q_WOMEN) | matches(query, R.Q_GIRLS)
    return F.when(male & female, "unisex").when(female, "women").when(male, "men")


def query_age(query: Column) -> Column:
    return F.when(matches(query, R.Q_KIDS), "kids").otherwise("adult")


def query_slots(query: Column) -> Column:
    """At most one slot: the first rule that fires."""
    slot = first_match(query, R.QUERY_SLOT_RULES)
    return F.when(slot.isNull(), strings([])).otherwise(F.array(slot))


def query_brand(query: Column) -> Column:
    return first_match(query, R.BRAND_RULES)


def query_colors(query: Column) -> Column:
    return all_matches(query, word_rules(R.QUERY_COLORS))


def query_season(query: Column) -> Column:
    return first_match(query, R.QUERY_SEASON_RULES)


def query_occasion(query: Column) -> Column:
    return first_match(query, R.QUERY_OCCASION_RULES)


def query_confidence(slots: Column, gender: Column, season: Column, occasion: Column,
                     min_price: Column, max_price: Column) -> Column:
    """Confidence per constraint of a rule-based parse."""

    def level(present: Column, value: float) -> Column:
        return F.when(present, F.lit(value)).otherwise(F.lit(0.0))

    return F.create_map(
        F.lit("slot"), level(F.size(slots) > 0, 1.0),
        F.lit("gender"), level(gender.isNotNull(), 1.0),
        F.lit("occasion"), level(occasion.isNotNull(), 0.9),
        F.lit("season"), level(season.isNotNull(), 0.9),
        F.lit("price"), level(min_price.isNotNull() | max_price.isNotNull(), 1.0),
    )


def normalize_multilingual(query: Column, lang: str) -> Column:
    """Constraints and a canonical English text from one language's lexicon (a struct)."""
    low = F.lower(query)

    slot_hits = [(slot, term, matches(query, pattern)) for slot, pattern, term in R.SLOT_LEXICON[lang]]
    slots = F.array_distinct(F.array_compact(F.array(
        *[F.when(hit, F.lit(slot)) for slot, _, hit in slot_hits])))
    terms, taken = [], {}
    for slot, term, hit in slot_hits:  # only the first rule of a slot lends its English term
        terms.append(F.when(hit & ~taken.get(slot, F.lit(False)), F.lit(term)))
        taken[slot] = taken.get(slot, F.lit(False)) | hit

    audience = {g: matches(query, pattern) for g, pattern in R.GENDER_LEXICON[lang]}
    girl, boy = contains_any(low, R.GIRL_WORDS), contains_any(low, R.BOY_WORDS)
    # the lexicon lists men, women, kids in that order and a later hit overrides an earlier one
    gender = (
        F.when(audience["kids"] & girl, "women").when(audience["kids"] & boy, "men")
        .when(audience["women"], "women").when(audience["men"], "men")
    )
    people = [
        F.when(audience["men"], F.lit("men's")), F.when(audience["women"], F.lit("women's")),
        F.when(audience["kids"], F.when(girl, F.lit("girls")).when(boy, F.lit("boys"))
               .otherwise(F.lit("kids"))),
    ]

    price = F.coalesce(*[_amount(query, p) for p in R.PRICE_LEXICON[lang]])
    concepts = [(term, matches(query, pattern)) for pattern, term in R.CONCEPT_LEXICON[lang]]

    def last_of(allowed: list[str]) -> Column:
        out = F.lit(None).cast("string")
        for term, hit in concepts:
            if term in allowed:
                out = F.when(hit, term).otherwise(out)
        return out

    colors = F.array_compact(F.array(
        F.lit(None).cast("string"),
        *[F.when(hit, F.lit(term)) for term, hit in concepts if term in R.CONCEPT_COLORS]))
    whole = price == F.floor(price)
    budget = F.when(price.isNotNull(), F.concat(
        F.lit("under "), F.when(whole, price.cast("bigint").cast("string"))
        .otherwise(price.cast("string"))))
    parts = F.array_distinct(F.array_compact(F.array(
        *people, *[F.when(hit, F.lit(term)) for term, hit in concepts], *terms, budget)))
    sure = (F.size(slots) > 0) | gender.isNotNull() | price.isNotNull()
    return F.struct(
        F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(query).alias("normalized_query_en"),
        gender.alias("gender"),
        F.when(audience["kids"], "kids").otherwise("adult").alias("age_group"),
        F.lit(None).cast("double").alias("min_price"), price.alias("max_price"),
        colors.alias("colors"), slots.alias("slots"),
        last_of(R.CONCEPT_SEASONS).alias("season"), last_of(R.CONCEPT_OCCASIONS).alias("occasion"),
        F.when(sure, strings([])).otherwise(strings(["filters_not_applied_without_llm"]))
        .alias("warnings"),
    )


def parse_queries(queries: DataFrame, text: str = "query") -> DataFrame:
    """Add every constraint column to a query table; narrow, no shuffle.

    English goes through the English rules, the other languages through their lexicon.
    """
    q = F.col(text)
    english = F.struct(
        q.alias("normalized_query_en"), query_gender(q).alias("gender"), query_age(q).alias("age_group"),
        query_price(q)["min_price"].alias("min_price"), query_price(q)["max_price"].alias("max_price"),
        query_colors(q).alias("colors"), query_slots(q).alias("slots"),
        query_season(q).alias("season"), query_occasion(q).alias("occasion"),
        query_price(q)["warnings"].alias("warnings"),
    )
    parsed = F.when(F.col("language") == "en", english)
    for lang in R.SLOT_LEXICON:
        parsed = parsed.when(F.col("language") == lang, normalize_multilingual(q, lang))
    out = queries.withColumn("language", detect_language(q)).withColumn("_p", parsed)
    flat = out.select("*", "_p.*").drop("_p")
    is_en = F.col("language") == "en"
    return (
        flat.withColumn("brand", F.when(is_en, query_brand(q)))
        .withColumn("is_fashion_query", F.lit(True))
        .withColumn("is_explicit_slot", F.when(is_en, F.size("slots") > 0).otherwise(True))
        .withColumn("is_explicit_gender", F.when(is_en, F.col("gender").isNotNull()).otherwise(True))
        .withColumn("confidence", F.when(is_en, query_confidence(
            F.col("slots"), F.col("gender"), F.col("season"), F.col("occasion"),
            F.col("min_price"), F.col("max_price"))).otherwise(
                F.create_map().cast("map<string,double>")))
    )


def imported_confidence(query: Column, season: Column, occasion: Column) -> Column:
    """Explicit flags and confidences of a parse that came from outside (a struct)."""
    low = F.lower(query)
    verbless = F.regexp_replace(low, r"\b(?:how\s+to\s+dress|to\s+dress)\b", "")
    garment = matches(verbless, any_word(R.GARMENT_WORDS))
    person = matches(low, any_word(R.GENDER_WORDS))
    return F.struct(
        garment.alias("is_explicit_slot"), person.alias("is_explicit_gender"),
        F.create_map(
            F.lit("slot"), F.when(garment, 1.0).otherwise(0.7),
            F.lit("gender"), F.when(person, 1.0).otherwise(0.6),
            F.lit("occasion"), F.when(F.coalesce(occasion, F.lit("")) != "", 0.8).otherwise(1.0),
            F.lit("season"), F.when(F.coalesce(season, F.lit("")) != "", 0.8).otherwise(1.0),
        ).alias("confidence"),
    )


def validate_parse_json(raw: Column) -> Column:
    """struct(parse, error): strip code fences, read the JSON, check enums and prices."""
    text = strip(raw)
    text = F.regexp_replace(text, r"\A```[^\n]*\n?", "")
    text = strip(F.regexp_replace(text, r"(?s)\n?[ \t]*```[ \t]*\z", ""))
    body = F.from_json(text, PARSE_SCHEMA, {"mode": "PERMISSIVE"})
    is_json = F.coalesce(F.get_json_object(text, "$").isNotNull() & text.startswith("{"), F.lit(False))
    low_slots = F.transform(F.coalesce(body["slots"], strings([])), F.lower)
    known_slots = strings([s for s in R.SLOTS if s != "unknown"])
    error = (
        F.when(~is_json, "invalid_json")
        .when(body["normalized_query_en"].isNull(), "missing_text")
        .when(~F.coalesce(body["gender"].isin("men", "women", "unisex"), F.lit(True)), "invalid_gender")
        .when(~F.coalesce(body["age_group"].isin(*R.AGE_GROUPS), F.lit(True)), "invalid_age_group")
        .when(F.coalesce(F.least(body["min_price"], body["max_price"]) <= 0, F.lit(False)),
              "price_not_positive")
        .when(F.size(F.array_except(low_slots, known_slots)) > 0, "invalid_slot")
        .when(F.coalesce(body["min_price"] > body["max_price"], F.lit(False)), "min_above_max")
    )
    return F.struct(F.when(error.isNull(), body).alias("parse"), error.alias("error"))


def needs_interpretation(query: Column, slots: Column, min_price: Column, max_price: Column,
                         brand: Column) -> Column:
    """Would the rules leave too much of the query unread?"""
    low = strip(F.lower(query))
    explicit = (F.size(slots) > 0) | max_price.isNotNull() | min_price.isNotNull() | brand.isNotNull()
    words = F.size(F.filter(F.split(low, r"(?U)\s+"), lambda w: w != ""))
    return F.when(contains_any(low, R.AMBIGUOUS_PHRASES), True).when(explicit, False).otherwise(words >= 4)


def query_archetype(query: Column, slots: Column, colors: Column, min_price: Column,
                    max_price: Column, occasion: Column) -> Column:
    """Which weight set ranks the query."""
    has_slot, has_color = F.size(slots) > 0, F.size(colors) > 0
    has_price = max_price.isNotNull() | min_price.isNotNull()
    style = contains_any(F.lower(query), R.DISCOVERY_WORDS) | occasion.isNotNull()
    return (
        F.when(has_price & (has_slot | has_color), "BUDGET_EXPLICIT")
        .when(has_slot, "EXPLICIT_PRODUCT").when(style, "DISCOVERY_STYLE").otherwise("STANDARD")
    )


def innerwear_requested(query: Column, normalized: Column, slots: Column) -> Column:
    text = F.lower(F.concat_ws(" ", query, normalized))
    return F.array_contains(F.transform(slots, F.lower), "innerwear") | matches(
        text, any_word(R.INNERWEAR_KEYWORDS))
