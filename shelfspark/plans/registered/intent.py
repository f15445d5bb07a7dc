"""Query-log enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import intent as I
from ...functions import rules as R
from ...operators import retrieval as V
from ...sources import tables as T
from .base import (case_first, cte, has_any, join_list, list_all, lit, query, rx, sql, sql_tokens, urx, words_rx)

_lang = ("CASE WHEN regexp_matches(query, '[\\x{0B80}-\\x{0BFF}]') THEN 'ta' WHEN regexp_matches(query, '[\\x{0900}-\\x{097F}]') THEN 'hi' "
         + " ".join(f"WHEN {urx('lower(query)', p)} THEN '{lang}'" for lang, p in R.LANGUAGE_MARKERS) + " ELSE 'en' END")


def _num(pattern: str, groups: int = 1, flags: str = "'i'") -> str:
    parts = [f"nullif(regexp_extract(query, {lit(pattern)}, {g}, {flags}), '')" for g in range(1, groups + 1)]
    return f"TRY_CAST(coalesce({', '.join(parts)}) AS DOUBLE)"


_foreign = f"regexp_matches(query, {lit(R.NON_USD)}, 'i')"
_male, _female = f"({rx('query', R.Q_MEN)} OR {rx('query', R.Q_BOYS)})", f"({rx('query', R.Q_WOMEN)} OR {rx('query', R.Q_GIRLS)})"
cte("en", f"""
SELECT *, {_lang} AS language, CASE WHEN NOT {_foreign} THEN {_num(R.MIN_PRICE, 2)} END AS e_min,
  CASE WHEN NOT {_foreign} THEN {_num(R.MAX_PRICE, 2)} END AS e_max, CASE WHEN {_foreign} THEN 'price_currency_not_supported' ELSE '' END AS e_warn,
  CASE WHEN {_male} AND {_female} THEN 'unisex' WHEN {_female} THEN 'women' WHEN {_male} THEN 'men' END AS e_gender,
  CASE WHEN {rx('query', R.Q_KIDS)} THEN 'kids' ELSE 'adult' END AS e_age,
  {case_first('query', R.QUERY_SLOT_RULES)} AS e_slot, {case_first('query', R.BRAND_RULES)} AS e_brand,
  {list_all('query', [(c, chr(92) + 'b' + c + chr(92) + 'b') for c in R.QUERY_COLORS])} AS e_colors,
  {case_first('query', R.QUERY_SEASON_RULES)} AS e_season, {case_first('query', R.QUERY_OCCASION_RULES)} AS e_occasion FROM qlog""", "qlog")


def log(spark, sf):
    return T.run(spark, sf, T.QUERY_SQL)




@query("detect_language", sql("SELECT query_id, language FROM en", "en"))
def detect_language(spark, sf):
    return log(spark, sf).select("query_id", I.detect_language(F.col("query")).alias("language"))


@query("query_price", sql("SELECT query_id, e_min AS min_price, e_max AS max_price, e_warn AS warnings FROM en", "en"))
def query_price(spark, sf):
    p = I.query_price(F.col("query"))
    return log(spark, sf).select("query_id", p["min_price"].alias("min_price"), p["max_price"].alias("max_price"),
                                 F.array_join(p["warnings"], ",").alias("warnings"))


@query("query_demographics", sql("SELECT query_id, e_gender AS gender, e_age AS age_group FROM en", "en"))
def query_demographics(spark, sf):
    return log(spark, sf).select("query_id", I.query_gender(F.col("query")).alias("gender"), I.query_age(F.col("query")).alias("age_group"))


@query("query_slots", sql("SELECT query_id, coalesce(e_slot, '') AS slots FROM en", "en"))
def query_slots(spark, sf):
    return log(spark, sf).select("query_id", F.array_join(I.query_slots(F.col("query")), ",").alias("slots"))


@query("query_brand", sql("SELECT query_id, e_brand AS brand FROM en", "en"))
def query_brand(spark, sf):
    return log(spark, sf).select("query_id", I.query_brand(F.col("query")).alias("brand"))


@query("query_colors", sql(f"SELECT query_id, {join_list('e_colors')} AS colors FROM en", "en"))
def query_colors(spark, sf):
    return log(spark, sf).select("query_id", F.array_join(I.query_colors(F.col("query")), ",").alias("colors"))


@query("query_season_occasion", sql("SELECT query_id, e_season AS season, e_occasion AS occasion FROM en", "en"))
def query_season_occasion(spark, sf):
    return log(spark, sf).select("query_id", I.query_season(F.col("query")).alias("season"), I.query_occasion(F.col("query")).alias("occasion"))


# ----------------------------------------------------------- lexicon languages
# Indic lexicons carry look-around in one Hindi rule; its exclusions are masked first.
def _lex(col: str, pattern: str) -> str:
    if "(?<!ड्रेस" in pattern:
        masked = f"regexp_replace({col}, 'ड्रेस(\\s+बेल्ट)', 'x\\1', 'g')"
        return f"coalesce(regexp_matches({masked}, '(?:पोशाक|ड्रेस|गाउन)'), false)"
    return urx(col, pattern)


def _parse(lang: str) -> dict[str, str]:
    slot_tests = [(s, term, _lex("query", p)) for s, p, term in R.SLOT_LEXICON[lang]]
    seen: dict[str, list[str]] = {}
    slots, terms = [], []
    for s, term, hit in slot_tests:
        first = hit + "".join(f" AND NOT {h}" for h in seen.get(s, []))
        slots.append(f"CASE WHEN {first} THEN {lit(s)} END")
        terms.append(f"CASE WHEN {first} THEN {lit(term)} END")
        seen.setdefault(s, []).append(hit)
    g = {name: _lex("query", p) for name, p in R.GENDER_LEXICON[lang]}
    girl, boy = has_any("lower(query)", R.GIRL_WORDS), has_any("lower(query)", R.BOY_WORDS)
    people = [f"CASE WHEN {g['men']} THEN 'men''s' END", f"CASE WHEN {g['women']} THEN 'women''s' END",
              f"CASE WHEN {g['kids']} THEN CASE WHEN {girl} THEN 'girls' WHEN {boy} THEN 'boys' ELSE 'kids' END END"]
    concept = [(term, _lex("query", p) if p.startswith("\\b") else urx("query", p)) for p, term in R.CONCEPT_LEXICON[lang]]
    price = "coalesce(" + ", ".join(_num(p) for p in R.PRICE_LEXICON[lang]) + ")"

    def last(allowed: list[str]) -> str:
        hits = [(t, h) for t, h in concept if t in allowed][::-1]
        return "CASE " + " ".join(f"WHEN {h} THEN '{t}'" for t, h in hits) + " ELSE NULL END" if hits else "NULL"

    budget = f"'under ' || CASE WHEN {price} = floor({price}) THEN CAST(CAST({price} AS BIGINT) AS VARCHAR) ELSE CAST({price} AS VARCHAR) END"
    parts = people + [f"CASE WHEN {h} THEN '{t}' END" for t, h in concept] + terms + [budget]
    return {
        "slots": f"list_filter([{', '.join(slots)}], lambda x: x IS NOT NULL)",
        "gender": f"CASE WHEN {g['kids']} AND {girl} THEN 'women' WHEN {g['kids']} AND {boy} THEN 'men' WHEN {g['women']} THEN 'women' WHEN {g['men']} THEN 'men' END",
        "age_group": f"CASE WHEN {g['kids']} THEN 'kids' ELSE 'adult' END", "max_price": price,
        "season": last(R.CONCEPT_SEASONS), "occasion": last(R.CONCEPT_OCCASIONS),
        "colors": "list_filter([" + ", ".join(["NULL"] + [f"CASE WHEN {h} THEN '{t}' END" for t, h in concept if t in R.CONCEPT_COLORS]) + "], lambda x: x IS NOT NULL)",
        "parts": f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)",
    }


_L = {lang: _parse(lang) for lang in R.SLOT_LEXICON}


def _by(field: str, english: str) -> str:
    return "CASE language " + " ".join(f"WHEN '{lang}' THEN {p[field]}" for lang, p in _L.items()) + f" ELSE {english} END"


# order-preserving distinct: keep an element only where it first occurs
_parts = "list_filter(parts, lambda x, i: list_position(parts, x) = i)"
cte("parsed0", f"""
SELECT *, {_by('slots', "CASE WHEN e_slot IS NULL THEN [] ELSE [e_slot] END")} AS slots, {_by('gender', 'e_gender')} AS gender, {_by('age_group', 'e_age')} AS age_group,
  CASE WHEN language = 'en' THEN e_min END AS min_price, {_by('max_price', 'e_max')} AS max_price, {_by('season', 'e_season')} AS season,
  {_by('occasion', 'e_occasion')} AS occasion, {_by('colors', 'e_colors')} AS colors, {_by('parts', '[query]')} AS parts FROM en""", "en")
cte("parsed", f"""
SELECT *, CASE WHEN len(parts) > 0 THEN array_to_string({_parts}, ' ') ELSE query END AS norm,
  CASE WHEN language = 'en' THEN e_brand END AS brand,
  CASE WHEN language = 'en' THEN e_warn WHEN len(slots) = 0 AND gender IS NULL AND max_price IS NULL THEN 'filters_not_applied_without_llm' ELSE '' END AS warnings,
  language <> 'en' OR len(slots) > 0 AS xslot, language <> 'en' OR gender IS NOT NULL AS xgender FROM parsed0""", "parsed0")


@query("normalize_multilingual", sql(f"""SELECT query_id, language, norm AS normalized, {join_list('slots')} AS slots, gender, age_group, min_price, max_price,
  {join_list('colors')} AS colors, season, occasion, brand, warnings FROM parsed""", "parsed"))
def normalize_multilingual(spark, sf):
    return T.queries(spark, sf).select(
        "query_id", "language", F.col("normalized_query_en").alias("normalized"), F.array_join("slots", ",").alias("slots"), "gender",
        "age_group", "min_price", "max_price", F.array_join("colors", ",").alias("colors"), "season", "occasion", "brand",
        F.array_join("warnings", ",").alias("warnings"))


@query("query_confidence", sql("""SELECT query_id, xslot AS explicit_slot, xgender AS explicit_gender,
  CASE WHEN language = 'en' THEN CASE WHEN len(slots) > 0 THEN 1.0 ELSE 0.0 END END::DOUBLE AS c_slot,
  CASE WHEN language = 'en' THEN CASE WHEN occasion IS NOT NULL THEN 0.9 ELSE 0.0 END END::DOUBLE AS c_occasion,
  CASE WHEN language = 'en' THEN CASE WHEN gender IS NOT NULL THEN 1.0 ELSE 0.0 END END::DOUBLE AS c_gender,
  CASE WHEN language = 'en' THEN CASE WHEN season IS NOT NULL THEN 0.9 ELSE 0.0 END END::DOUBLE AS c_season,
  CASE WHEN language = 'en' THEN CASE WHEN min_price IS NOT NULL OR max_price IS NOT NULL THEN 1.0 ELSE 0.0 END END::DOUBLE AS c_price FROM parsed""", "parsed"))
def query_confidence(spark, sf):
    q = T.queries(spark, sf)
    level = {k: F.try_element_at("confidence", F.lit(k)).alias(f"c_{k}") for k in ("slot", "gender", "occasion", "season", "price")}
    return q.select("query_id", F.col("is_explicit_slot").alias("explicit_slot"), F.col("is_explicit_gender").alias("explicit_gender"), *level.values())


_verbless = "regexp_replace(lower(query), '\\b(?:how\\s+to\\s+dress|to\\s+dress)\\b', '', 'g')"


@query("imported_confidence", sql(f"""SELECT query_id, {rx(_verbless, words_rx(R.GARMENT_WORDS))} AS explicit_slot,
  CASE WHEN {rx('query', words_rx(R.GENDER_WORDS))} THEN 1.0 ELSE 0.6 END::DOUBLE AS c_gender FROM qlog""", "qlog"))
def imported_confidence(spark, sf):
    q = T.queries(spark, sf).withColumn("_c", I.imported_confidence(F.col("query"), F.col("season"), F.col("occasion")))
    return q.select("query_id", F.col("_c.is_explicit_slot").alias("explicit_slot"),
                    F.element_at(F.col("_c.confidence"), F.lit("gender")).alias("c_gender"))


@query("route_ambiguous", sql(f"""SELECT query_id, CASE WHEN {has_any('lower(trim(query))', R.AMBIGUOUS_PHRASES)} THEN true
  WHEN len(slots) > 0 OR min_price IS NOT NULL OR max_price IS NOT NULL OR brand IS NOT NULL THEN false
  ELSE len(regexp_split_to_array(trim(query), '\\s+')) >= 4 END AS needs_reading FROM parsed""", "parsed"))
def route_ambiguous(spark, sf):
    return T.queries(spark, sf).select("query_id", I.needs_interpretation(
        F.col("query"), F.col("slots"), F.col("min_price"), F.col("max_price"), F.col("brand")).alias("needs_reading"))


SQL_ARCHETYPE = f"""CASE WHEN (min_price IS NOT NULL OR max_price IS NOT NULL) AND (len(slots) > 0 OR len(colors) > 0) THEN 'BUDGET_EXPLICIT'
  WHEN len(slots) > 0 THEN 'EXPLICIT_PRODUCT' WHEN {has_any('lower(query)', R.DISCOVERY_WORDS)} OR occasion IS NOT NULL THEN 'DISCOVERY_STYLE' ELSE 'STANDARD' END"""


@query("query_archetype", sql(f"SELECT query_id, {SQL_ARCHETYPE} AS archetype FROM parsed", "parsed"))
def query_archetype(spark, sf):
    return T.queries(spark, sf).select("query_id", I.query_archetype(
        F.col("query"), F.col("slots"), F.col("colors"), F.col("min_price"), F.col("max_price"), F.col("occasion")).alias("archetype"))


_stop = ", ".join(lit(w) for w in R.MULTILINGUAL_STOPWORDS)
cte("vocab", f"SELECT DISTINCT unnest({sql_tokens('search_text')}) AS token FROM items WHERE NOT is_deleted", "items")


def sql_guard(text: str) -> str:
    return f"""SELECT p.query_id, coalesce(n, 0) AS n_tokens, coalesce(k, 0) AS n_known, coalesce(k / n, 0.0) < 0.5 AS skip_keyword FROM parsed p LEFT JOIN (
  SELECT query_id, count(*) AS n, count(v.token) AS k FROM (SELECT query_id, unnest({sql_tokens(text)}) AS token FROM parsed) t
  LEFT JOIN vocab v USING (token) WHERE length(t.token) >= 3 AND t.token NOT IN ({_stop}) GROUP BY query_id) g USING (query_id)"""


cte("guard", sql_guard("norm"), "parsed", "vocab")
cte("guard_raw", sql_guard("query"), "parsed", "vocab")


def guard(spark, sf, text: str = "normalized_query_en"):
    q = T.queries(spark, sf)
    from .retrieval import catalog_index

    return V.noise_guard(q, V.query_tokens(q, text=text), catalog_index(spark, sf).frequencies)


@query("noise_guard", sql("SELECT query_id, n_tokens, n_known, skip_keyword FROM guard", "guard"))
def noise_guard(spark, sf):
    return guard(spark, sf)


# parses as another system would deliver them: built from the log, some of them broken
RAW_PARSE_SQL = """concat(CASE WHEN s_suppkey % 3 = 0 THEN '```json' || chr(10) ELSE '' END, CASE WHEN s_suppkey % 11 = 0 THEN 'oops' ELSE '{' END,
  '"normalized_query_en":"q', CAST(s_suppkey AS STRING), '","gender":', CASE WHEN s_suppkey % 7 = 0 THEN '"robots"' ELSE '"men"' END,
  ',"max_price":', CASE WHEN s_suppkey % 5 = 0 THEN '-4' ELSE '40.0' END, ',"min_price":', CASE WHEN s_suppkey % 13 = 0 THEN '90.0' ELSE 'null' END,
  ',"slots":["', CASE WHEN s_suppkey % 17 = 0 THEN 'hat' ELSE 'Top' END, '"]}', CASE WHEN s_suppkey % 3 = 0 THEN chr(10) || '```' ELSE '' END)"""


@query("validate_parse_json", """SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN 'invalid_json' WHEN s_suppkey % 7 = 0 THEN 'invalid_gender'
  WHEN s_suppkey % 5 = 0 THEN 'price_not_positive' WHEN s_suppkey % 17 = 0 THEN 'invalid_slot' WHEN s_suppkey % 13 = 0 THEN 'min_above_max' ELSE 'ok' END AS state FROM supplier""")
def validate_parse_json(spark, sf):
    s = T.table(spark, sf, "supplier").select("s_suppkey", F.expr(RAW_PARSE_SQL).alias("raw"))
    return s.select("s_suppkey", F.coalesce(I.validate_parse_json(F.col("raw"))["error"], F.lit("ok")).alias("state"))


@query("latest_parse_per_query", """SELECT model, query, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY model, query ORDER BY ts DESC, event_id DESC) AS r
  FROM (SELECT CASE WHEN user_id % 2 = 0 THEN 'rules-a' ELSE 'rules-b' END AS model, event_type || ' ' || (user_id % 10)::VARCHAR AS query, ts, event_id FROM events)) WHERE r = 1""")
def latest_parse_per_query(spark, sf):
    from ...sources.catalog import latest_parse_per_query as latest

    e = T.table(spark, sf, "events").select(
        F.concat_ws(" ", "event_type", (F.col("user_id") % 10).cast("string")).alias("query"), "ts", "event_id",
        F.when(F.col("user_id") % 2 == 0, "rules-a").otherwise("rules-b").alias("model"))
    per = [latest(e, model=m, tie="event_id").select(F.lit(m).alias("model"), "query", "ts", "event_id") for m in ("rules-a", "rules-b")]
    return per[0].unionByName(per[1])
