"""Text cleaning and text keys as native column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import rules as R
from .exprs import blank, strings, unicode_regex

# letters, digits and underscore in any script: what the tokens of a search text are made of
WORD = r"[\p{L}\p{N}_]+"


def clean_text(col: Column) -> Column:
    """Drop decorative symbols, split run-together sentences, collapse whitespace."""
    out = F.regexp_replace(F.coalesce(col, F.lit("")), R.DECORATIVE, " ")
    out = F.regexp_replace(out, R.RUN_TOGETHER, "$1. $2")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def strip_size_tokens(col: Column) -> Column:
    """Remove size tokens, then repair the commas and brackets they leave behind."""
    out = F.regexp_replace(F.coalesce(col, F.lit("")), unicode_regex(R.SIZE_TOKENS), "")
    repairs = [
        (r",\s*\)", ")"), (r"\(\s*,", "("), (r",\s*\]", "]"), (r"\[\s*,", "["),
        (r"\(\s*[,;\s]*\)", ""), (r"\[\s*[,;\s]*\]", ""), (r"\s*,\s*,+", ","), (r"\s+", " "),
    ]
    for pattern, replacement in repairs:
        out = F.regexp_replace(out, pattern, replacement)
    return F.trim(out)


def main_image(images: Column) -> Column:
    """Display image: the MAIN variant first, else the first image that has any address."""

    def address(img: Column) -> Column:
        return F.coalesce(*[F.nullif(img[f], F.lit("")) for f in ("large", "hi_res", "thumb")])

    mains = F.filter(images, lambda i: (i["variant"] == "MAIN") & address(i).isNotNull())
    usable = F.filter(images, lambda i: address(i).isNotNull())
    return F.coalesce(address(F.get(mains, F.lit(0))), address(F.get(usable, F.lit(0))))


def end_sentence(col: Column) -> Column:
    """Trim and close the fragment with a full stop unless it already ends a sentence."""
    text = F.trim(col)
    closed = text.endswith(".") | text.endswith("!") | text.endswith("?") | (text == "")
    return F.when(closed, text).otherwise(F.concat(text, F.lit(".")))


def _sentences(items: Column) -> Column:
    cleaned = F.filter(F.transform(items, clean_text), lambda s: s != "")
    return F.array_join(F.transform(cleaned, end_sentence), " ")


def search_text(title: Column, store: Column, gender: Column, age_group: Column, slot: Column,
                features: Column, description: Column, reviews: Column) -> Column:
    """The text that is indexed: title, brand, audience, type, features, description, reviews."""
    brand = F.when(F.coalesce(store, F.lit("")) == "", F.lit("Unknown")).otherwise(clean_text(store))
    described = F.trim(F.substring(clean_text(description), 1, 400))
    review_text = _sentences(F.coalesce(reviews, strings([])))
    parts = [
        end_sentence(clean_text(strip_size_tokens(title))),
        F.concat(F.lit("Brand: "), brand, F.lit(".")),
        F.concat(F.lit("For: "), gender, F.lit(", "), age_group, F.lit(".")),
        F.concat(F.lit("Type: "), slot, F.lit(".")),
        _sentences(F.slice(F.coalesce(features, strings([])), 1, 3)),
        end_sentence(described),
        F.when(review_text != "", F.concat(F.lit("Reviews: "), review_text)),
    ]
    joined = F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])
    return F.trim(F.regexp_replace(F.regexp_replace(joined, r"\.+", "."), r"(?U)\s+", " "))


def qc_search_text(title: Column, store: Column, gender: Column, age_group: Column, slot: Column,
                   features: Column) -> Column:
    """Shorter search text written for accepted records."""
    brand = F.when(F.coalesce(store, F.lit("")) == "", F.lit("Unknown")).otherwise(store)
    three = F.array_join(F.slice(F.coalesce(features, strings([])), 1, 3), " ")
    return F.concat(title, F.lit(". Brand: "), brand, F.lit(". For: "), gender, F.lit(", "),
                    age_group, F.lit(". Type: "), slot, F.lit(". "), three, F.lit("."))


@F.pandas_udf(T.StringType())
def _unescape(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import html

    for texts in batches:
        yield texts.map(html.unescape, na_action="ignore")


def html_unescape(col: Column) -> Column:
    """Decode HTML entities.  Only texts that hold an ampersand carry content to Python."""
    decoded = _unescape(F.when(F.contains(col, F.lit("&")), col))
    return F.when(F.contains(col, F.lit("&")), decoded).otherwise(col)


def word_count(col: Column) -> Column:
    """Number of useful words: two or more ASCII letters or digits."""
    return F.size(F.regexp_extract_all(col, F.lit(r"(?U)(\b[a-zA-Z0-9]{2,}\b)"), F.lit(1)))


def title_check(raw_title: Column, cleaned: Column, min_length: int = R.QC_MIN_TITLE_LENGTH) -> Column:
    """First title problem, or null when the title is usable."""
    no_letters = cleaned.rlike(r"^(?:[^\p{L}\p{N}]|[0-9])*$")
    return (
        F.when(blank(raw_title), "missing_title")
        .when((cleaned == "") | no_letters | (word_count(cleaned) < 2), "meaningless_title")
        .when(F.length(cleaned) < min_length, "short_title")
    )


def tokenize(col: Column) -> Column:
    """Lower-case tokens of any script."""
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def query_key(col: Column) -> Column:
    """Key under which repeats of a query meet: lower case, single spaces, no edge punctuation."""
    collapsed = F.regexp_replace(F.lower(F.trim(col)), r"(?U)\s+", " ")
    return F.regexp_replace(collapsed, r"""^[ \t\n\r.?!,"';:()\[\]{}]+|[ \t\n\r.?!,"';:()\[\]{}]+$""", "")


def text_hash(col: Column) -> Column:
    return F.sha2(col, 256)


def dedup_key(title: Column, store: Column) -> Column:
    """Near-duplicate key: brand, title without sizes / brackets / synonym colours, pack phrases."""
    text = F.lower(title)
    text = F.regexp_replace(text, r"\([^)]*\)", " ")
    text = F.regexp_replace(text, r"\[[^]]*\]", " ")
    packs = F.regexp_extract_all(text, F.lit(f"(?U)({R.PACK_PHRASE})"), F.lit(1))
    base = F.regexp_replace(text, "(?U)" + R.DEDUP_SIZES, " ")
    for word in R.COLOR_SYNONYMS:
        base = F.regexp_replace(base, rf"(?U)\b{word}\b", " ")
    words = F.filter(F.regexp_extract_all(base, F.lit(f"({WORD})"), F.lit(1)),
                     lambda w: F.length(w) > 1)
    brand = F.lower(F.trim(F.coalesce(store, F.lit(""))))
    return F.concat_ws("::", brand, F.array_join(words, " "), F.array_join(packs, " "))


def explain_item(title: Column, store: Column, colors: Column, seasons: Column, occasions: Column,
                 query: Column, q_brand: Column, q_colors: Column, q_season: Column,
                 q_occasion: Column, slot_role: Column | None = None) -> Column:
    """Why an item was returned: the facts that hold, joined in a fixed order."""
    brand = F.lower(q_brand)
    shared = F.filter(q_colors, lambda c: F.array_contains(F.transform(colors, F.lower), F.lower(c)))
    facts = [
        F.when(slot_role.isNotNull(), F.concat(F.lit("Chosen as "), slot_role))
        if slot_role is not None else F.lit(None).cast("string"),
        F.when(F.contains(F.lower(store), brand), F.concat(F.lit("Matches brand "), store))
        .when(F.contains(F.lower(title), brand), F.concat(F.lit("Features brand "), q_brand)),
        F.when(F.size(shared) > 0, F.concat(F.lit("Matching color: "), F.array_join(shared, ", "))),
        F.when(F.array_contains(F.transform(seasons, F.lower), F.lower(q_season)),
               F.concat(F.lit("Suited for "), q_season)),
        F.when(F.array_contains(F.transform(occasions, F.lower), F.lower(q_occasion)),
               F.concat(F.lit("Ideal for "), q_occasion)),
    ]
    known = F.concat_ws(" | ", *facts)
    words = F.regexp_extract_all(F.lower(query), F.lit(r"([\p{L}\p{N}_]{4,})"), F.lit(1))
    keyword = F.get(F.filter(words, lambda w: F.contains(F.lower(title), w)), F.lit(0))
    return (
        F.when(known != "", known)
        .when(keyword.isNotNull(), F.concat(F.lit("Matched keyword: "), keyword))
        .otherwise(F.lit("High semantic relevance to query"))
    )


