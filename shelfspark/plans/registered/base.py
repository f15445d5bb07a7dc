"""Registry and the building blocks of the checking SQL.

The checking engine's regular expressions have no look-around and ASCII word boundaries, so a
rule with a look-ahead is checked in two steps: the excluded phrase is masked, then the plain
pattern is tried.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ...functions import rules as R
from ...sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return register


# ------------------------------------------------------------------- SQL pieces
def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def drop_lookahead(pattern: str) -> str:
    while "(?!" in pattern:
        start = pattern.index("(?!")
        depth, i = 0, start
        while True:
            if pattern[i] == "\\":
                i += 2
                continue
            depth += {"(": 1, ")": -1}.get(pattern[i], 0)
            i += 1
            if depth == 0:
                break
        pattern = pattern[:start] + pattern[i:]
    return pattern


MASKS = [
    ("\\bdress(?:es)?\\b(?!", r"\bdress(?:es)?(\s+(?:shirt|shirts|pants|shoes?|boots?|socks?|belts?|buckles?|watch(?:es)?|cloak\s+pin))", r"drezz\1"),
    ("\\bcostumes?\\b(?!", r"\bcostumes?(\s+(?:fashion\s+)?(?:jewelry|jewellery|ring|rings|necklace|necklaces|earrings?|bracelets?|brooch|chain|pins?|mask|accessories|accessory))", r"kostume\1"),
    ("shorts?(?!", r"\bshorts?(\s*[- ]?sleeves?)", r"shrtz\1"),
    ("thong(?!", r"\bthong(\s+sandals?)", r"thnng\1"),
    ("\\btie\\b(?!", r"\btie(\s*[- ]?dye)", r"tyy\1"),
]


def rx(col: str, pattern: str) -> str:
    """Case-insensitive match on ASCII text; null never matches."""
    for marker, phrase, masked in MASKS:
        if marker in pattern:
            col = f"regexp_replace({col}, {lit(phrase)}, {lit(masked)}, 'gi')"
    return f"coalesce(regexp_matches({col}, {lit(drop_lookahead(pattern))}, 'i'), false)"


EDGE_L, EDGE_R = r"(?:^|[^\pL\pN_])", r"(?:$|[^\pL\pN_])"


def urx(col: str, pattern: str) -> str:
    """As rx, for text in any script: word edges are spelled out."""
    p = drop_lookahead(pattern)
    if p.startswith(r"\b") and p.endswith(r"\b"):
        p = EDGE_L + p[2:-2].replace(r"\b|\b", f"{EDGE_R}|{EDGE_L}") + EDGE_R
    return f"coalesce(regexp_matches({col}, {lit(p)}, 'i'), false)"


def case_first(col: str, rules, default: str = "NULL", test=rx) -> str:
    return "CASE " + " ".join(f"WHEN {test(col, p)} THEN {lit(v)}" for v, p in rules) + f" ELSE {default} END"


def list_all(col: str, rules, test=rx) -> str:
    """Distinct labels of every matching rule, in rule order."""
    seen, parts = {}, []
    for label, pattern in rules:
        hit = test(col, pattern)
        fresh = "".join(f" AND NOT {h}" for h in seen.get(label, []))
        parts.append(f"CASE WHEN {hit}{fresh} THEN {lit(label)} END")
        seen.setdefault(label, []).append(hit)
    return f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"


def has_any(col: str, cues: list[str]) -> str:
    return "(" + " OR ".join(f"coalesce(contains({col}, {lit(c)}), false)" for c in cues) + ")"


def words_rx(words: list[str]) -> str:
    import re

    return r"\b(?:" + "|".join(re.escape(w).replace(r"\ ", " ").replace(r"\-", "-") for w in words) + r")\b"


WS = r"[\t-\r \x{85}\p{Z}]+"
SPACE = f"'{WS}'"


def sql_clean(col: str) -> str:
    s = f"regexp_replace(coalesce({col}, ''), {lit(R.DECORATIVE)}, ' ', 'g')"
    s = f"regexp_replace({s}, '([a-z0-9])([A-Z])', '\\1. \\2', 'g')"
    return f"trim(regexp_replace({s}, {SPACE}, ' ', 'g'))"


def sql_strip_sizes(col: str) -> str:
    core = R.SIZE_TOKENS.replace(r"(?<!['\w])\b", "").replace(r"\b(?!['\w])", "")
    s = f"coalesce({col}, '')"
    for _ in range(3):  # neighbours share an edge character, so one pass may miss every other token
        s = f"regexp_replace({s}, {lit(r'(^|[^' + chr(39) + r'\w])' + core + r'($|[^' + chr(39) + r'\w])')}, '\\1\\2', 'gi')"
    for pat, rep in [(r",\s*\)", ")"), (r"\(\s*,", "("), (r",\s*\]", "]"), (r"\[\s*,", "["), (r"\(\s*[,;\s]*\)", ""),
                     (r"\[\s*[,;\s]*\]", ""), (r"\s*,\s*,+", ","), (r"\s+", " ")]:
        s = f"regexp_replace({s}, {lit(pat)}, {lit(rep)}, 'g')"
    return f"trim({s})"


def sql_end(col: str) -> str:
    return f"CASE WHEN {col} = '' OR right({col}, 1) IN ('.', '!', '?') THEN {col} ELSE {col} || '.' END"


def sql_tokens(col: str) -> str:
    return f"regexp_extract_all(lower(coalesce({col}, '')), '[\\pL\\pN_]+')"


def sql_word_count(col: str) -> str:
    return f"len(regexp_extract_all({col}, '(?:^|[^\\pL\\pN_])([a-zA-Z0-9]{{2,}})\\b'))"


def sql_slot(col: str) -> str:
    return case_first(col, R.SLOT_RULES)


def sql_gender(dept: str, title: str) -> str:
    return (f"CASE WHEN contains(coalesce({dept}, ''), 'unisex') THEN 'unisex' WHEN {rx(dept, R.DEPT_MEN)} AND {rx(dept, R.DEPT_WOMEN)} THEN 'unisex' "
            f"WHEN {rx(dept, R.DEPT_WOMEN)} THEN 'women' WHEN {rx(dept, R.DEPT_MEN)} THEN 'men' "
            f"WHEN {rx(title, R.TITLE_UNISEX)} OR ({rx(title, R.TITLE_MEN)} AND {rx(title, R.TITLE_WOMEN)}) THEN 'unisex' "
            f"WHEN {rx(title, R.TITLE_WOMEN)} THEN 'women' WHEN {rx(title, R.TITLE_MEN)} THEN 'men' ELSE 'unknown' END")


def sql_age(title: str) -> str:
    return (f"CASE WHEN {rx(title, R.STRONG_KIDS)} THEN 'kids' WHEN {rx(title, R.WATCH_BAND)} THEN 'adult' "
            f"WHEN {rx(title, R.SHARED_MARKETING)} OR {rx(title, R.ADULT)} THEN 'adult' "
            f"WHEN {rx(title, R.GENERAL_KIDS)} THEN 'kids' ELSE 'adult' END")


COLOR_RULES = [(to, rf"\b{w}\b") for w, to in R.COLOR_SYNONYMS.items()] + [(c, rf"\b{c}\b") for c in R.COLOR_VOCABULARY]


def sql_bayes(rating: str, votes: str, mean: str = "4.2") -> str:
    v, r = f"coalesce({votes}, 0)::DOUBLE", f"(CASE WHEN {rating} > 0 THEN {rating} ELSE {mean} END)"
    value = f"CASE WHEN {v} > 0 THEN {v} / ({v} + 10.0) * {r} + 10.0 / ({v} + 10.0) * {mean} ELSE {mean} END"
    return f"CAST(round(CAST({value} AS DECIMAL(18, 10)), 4) AS DOUBLE)"


def tidy(expr: str, digits: int) -> str:
    return f"CAST(round(CAST(({expr})::DOUBLE AS DECIMAL(18, 10)), {digits}) AS DOUBLE)"


def sql_acc(title: str) -> str:
    return f"CASE WHEN coalesce({title}, '') <> '' THEN {case_first(title, R.ACCESSORY_RULES, lit('other'))} END"


def join_list(expr: str, sep: str = ",") -> str:
    return f"coalesce(array_to_string({expr}, {lit(sep)}), '')"


# ------------------------------------------------------------- common table texts
CTES: dict[str, tuple[str, list[str]]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (sql, list(needs))


class Text(str):
    """A checking SQL text that remembers its parts, so a checker can build shared tables once."""

    final: str
    order: list[str]


def sql(final: str, *needs: str) -> str:
    """final SELECT with the common tables it needs, in dependency order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n not in order:
            for d in CTES[n][1]:
                visit(d)
            order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return final
    out = Text("WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][0]})" for n in order) + "\n" + final)
    out.final, out.order = final, order
    return out


def plain(portable: str) -> str:
    out = portable
    for name in ("part", "lineitem", "supplier", "orders", "events", "documents", "embeddings", "benchmark"):
        out = out.replace("{" + name + "}", name)
    return out


cte("feed", plain(T.FEED_SQL))
_brand = f"CASE WHEN coalesce(store, '') = '' THEN 'Unknown' ELSE {sql_clean('store')} END"
_feat = f"list_filter(list_transform(list_slice(feats, 1, 3), lambda f: {sql_clean('f')}), lambda f: f <> '')"


def item_ctes(prefix: str, source: str) -> None:
    """{prefix}rec, {prefix}attrs, {prefix}items: the products of the raw records in `source`."""
    cte(prefix + "rec", f"SELECT *, trim(coalesce(title, '')) AS t, list_filter(string_split(feature_text, ';'), lambda x: x <> '') AS feats FROM {source}", source)
    cte(prefix + "attrs", f"""
SELECT *, {sql_gender('department', 't')} AS gender, {sql_age('t')} AS age_group,
  coalesce({sql_slot('t')}, {sql_slot("array_to_string(feats, ' ')")}, {sql_slot('description')}, 'unknown') AS slot,
  {list_all('t', COLOR_RULES)} AS colors, t || ' ' || array_to_string(feats, ' ') || ' ' || coalesce(description, '') AS ctx,
  {sql_bayes('average_rating', 'rating_number')} AS quality_bayes FROM {prefix}rec""", prefix + "rec")
    cte(prefix + "items", f"""
SELECT * EXCLUDE (title), t AS title, CASE WHEN slot = 'accessory' THEN {sql_acc('t')} END AS accessory_type,
  {list_all('ctx', R.SEASON_RULES)} AS seasons, {list_all('ctx', R.OCCASION_RULES)} AS occasions,
  trim(regexp_replace(regexp_replace(concat_ws(' ', nullif({sql_end('ct')}, ''), 'Brand: ' || {_brand} || '.',
    'For: ' || gender || ', ' || age_group || '.', 'Type: ' || slot || '.',
    nullif(array_to_string(list_transform({_feat}, lambda f: {sql_end('f')}), ' '), ''), nullif({sql_end('dd')}, '')),
    '\\.+', '.', 'g'), '\\s+', ' ', 'g')) AS search_text
FROM (SELECT *, {sql_clean(sql_strip_sizes('t'))} AS ct, trim(substr({sql_clean('description')}, 1, 400)) AS dd FROM {prefix}attrs)""", prefix + "attrs")


item_ctes("", "feed")
cte("qlog", plain(T.QUERY_SQL))
