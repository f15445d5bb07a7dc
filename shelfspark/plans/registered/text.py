"""Text projections over the corpus and the catalog feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import rules as R
from ...functions import text as X
from ...sources import tables as T
from .base import SPACE, join_list, lit, query, sql, sql_clean, sql_strip_sizes, sql_tokens, sql_word_count



@query("clean_text", f"SELECT doc_id, md5({sql_clean('text')}) AS clean_md5, length({sql_clean('text')}) AS n FROM documents")
def clean_text(spark, sf):
    d = T.table(spark, sf, "documents").withColumn("_c", X.clean_text(F.col("text")))
    return d.select("doc_id", F.md5("_c").alias("clean_md5"), F.length("_c").cast("bigint").alias("n"))


@query("strip_size_tokens", sql(f"SELECT item_id, {sql_strip_sizes('t')} AS stripped FROM rec", "rec"))
def strip_size_tokens(spark, sf):
    return T.feed(spark, sf).select("item_id", X.strip_size_tokens(F.trim(F.coalesce("title", F.lit("")))).alias("stripped"))


IMAGE_SQL = """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE url END AS large, CASE WHEN page_id % 5 = 0 THEN NULL ELSE url || '&hi' END AS hi_res,
  url || '&th' AS thumb, CASE WHEN page_id % 4 = 0 THEN 'PT01' ELSE 'MAIN' END AS variant FROM pages"""


@query("main_image", f"""SELECT page_id, CASE WHEN variant = 'MAIN' THEN coalesce(nullif(large, ''), hi_res, thumb)
  ELSE 'side.jpg' END AS image FROM ({IMAGE_SQL})""")
def main_image(spark, sf):
    p = T.table(spark, sf, "pages")
    n = F.col("page_id")
    img = F.struct(
        F.when(n % 3 == 0, "").otherwise(F.col("url")).alias("large"),
        F.when(n % 5 != 0, F.concat("url", F.lit("&hi"))).alias("hi_res"),
        F.concat("url", F.lit("&th")).alias("thumb"),
        F.when(n % 4 == 0, "PT01").otherwise("MAIN").alias("variant"))
    side = F.struct(F.lit("side.jpg").alias("large"), F.lit(None).cast("string").alias("hi_res"),
                    F.lit(None).cast("string").alias("thumb"), F.lit("PT02").alias("variant"))
    return p.select("page_id", X.main_image(F.array(side, img)).alias("image"))


@query("search_text", sql("SELECT item_id, search_text FROM items", "items"))
def search_text(spark, sf):
    return T.items(spark, sf).select("item_id", "search_text")


@query("qc_search_text", sql("""SELECT item_id, title || '. Brand: ' || coalesce(store, 'Unknown') || '. For: ' || gender || ', ' || age_group
  || '. Type: ' || slot || '. ' || array_to_string(feats[1:3], ' ') || '.' AS qc_text FROM items""", "items"))
def qc_search_text(spark, sf):
    return T.items(spark, sf).select("item_id", X.qc_search_text(
        F.col("title"), F.col("store"), F.col("gender"), F.col("age_group"), F.col("slot"), F.col("features")).alias("qc_text"))


@query("html_unescape")
def html_unescape(spark, sf):
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    return T.table(spark, sf, "pages").select("page_id", X.html_unescape(title).alias("title"))


@query("title_check", sql(f"""
SELECT item_id, CASE WHEN title IS NULL OR trim(title) = '' THEN 'missing_title'
  WHEN c = '' OR regexp_full_match(c, '(?:[^\\pL\\pN]|[0-9])*') OR {sql_word_count('c')} < 2 THEN 'meaningless_title'
  WHEN length(c) < 10 THEN 'short_title' ELSE 'ok' END AS title_state, c AS cleaned
FROM (SELECT *, {sql_clean('title')} AS c FROM feed)""", "feed"))
def title_check(spark, sf):
    f = T.feed(spark, sf).withColumn("_c", X.clean_text(F.col("title")))
    return f.select("item_id", F.coalesce(X.title_check(F.col("title"), F.col("_c")), F.lit("ok")).alias("title_state"),
                    F.col("_c").alias("cleaned"))


@query("normalize_record", sql(f"""SELECT item_id, t AS title, nullif(trim(store), '') AS store, round(price, 2) AS price,
  {join_list('feats', ';')} AS features, nullif(description, '') AS description FROM rec""", "rec"))
def normalize_record(spark, sf):
    from ...operators.triage import normalize_record as norm

    return norm(T.feed(spark, sf)).select("item_id", "title", "store", "price",
                                          F.array_join("features", ";").alias("features"), "description")


@query("tokenize", f"""SELECT doc_id, len(tk) AS n_tokens, md5(array_to_string(tk, ' ')) AS tokens_md5
  FROM (SELECT doc_id, {sql_tokens('text')} AS tk FROM documents)""")
def tokenize(spark, sf):
    d = T.table(spark, sf, "documents").withColumn("_t", X.tokenize(F.col("text")))
    return d.select("doc_id", F.size("_t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("_t", " ")).alias("tokens_md5"))


_EDGE = r"""[ \t\n\r.?!,"';:()\[\]{}]+"""


@query("query_key", f"""SELECT conv_id, turn, md5(regexp_replace(regexp_replace(k, {lit('^' + _EDGE)}, ''), {lit(_EDGE + '$')}, '')) AS key_md5
  FROM (SELECT conv_id, turn, regexp_replace(lower(trim(text)), {SPACE}, ' ', 'g') AS k FROM conversations WHERE role = 'user')""")
def query_key(spark, sf):
    turns = T.table(spark, sf, "conversations").filter("role = 'user'")
    return turns.select("conv_id", "turn", F.md5(X.query_key(F.col("text"))).alias("key_md5"))


@query("text_hash", "SELECT doc_id, sha256(text) AS text_hash FROM documents")
def text_hash(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", X.text_hash(F.col("text")).alias("text_hash"))


def sql_dedup(title: str = "title", store: str = "store") -> str:
    t = f"regexp_replace(regexp_replace(lower({title}), '\\([^)]*\\)', ' ', 'g'), '\\[[^\\]]*\\]', ' ', 'g')"
    base = f"regexp_replace({t}, {lit(R.DEDUP_SIZES)}, ' ', 'g')"
    for w in R.COLOR_SYNONYMS:
        base = f"regexp_replace({base}, {lit(chr(92) + 'b' + w + chr(92) + 'b')}, ' ', 'g')"
    words = f"list_filter(regexp_extract_all({base}, '[\\pL\\pN_]+'), lambda w: length(w) > 1)"
    packs = f"regexp_extract_all({t}, {lit(R.PACK_PHRASE)})"
    return (f"lower(trim(coalesce({store}, ''))) || '::' || coalesce(array_to_string({words}, ' '), '') || '::' || "
            f"coalesce(array_to_string({packs}, ' '), '')")


@query("dedup_key", sql(f"SELECT item_id, {sql_dedup()} AS dedup_key FROM items", "items"))
def dedup_key(spark, sf):
    return T.items(spark, sf).select("item_id", X.dedup_key(F.col("title"), F.col("store")).alias("dedup_key"))


