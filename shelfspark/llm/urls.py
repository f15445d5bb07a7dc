"""URL filter: host-suffix and path-prefix expressions, short hash prefixes, full digests, precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_DIGITS = 8  # of the hexadecimal SHA-256: 32 bits, as in public safe-browsing lists


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first '://' up to '/', '?', '#' or end, A-Z lower-cased; path from there up to
    '?' or '#'.  A null url or one without '://' has both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    before = F.regexp_extract(rest, "^([^?#]*)", 1)
    host = F.regexp_extract(before, "^([^/]*)", 1)
    return F.translate(host, UPPER, LOWER), F.substring(before, F.length(host) + 1, F.length(before))


def judge_urls(urls: DataFrame, rules: DataFrame, default: str = "allow", prefix_digits: int = PREFIX_DIGITS) -> DataFrame:
    """urls(url, ...) with columns host, path, rule, verdict added; every input row is returned once.

    rules(host, path, verdict): a rule fits its host and all subdomains, if the url's path starts with the rule's;
    the longest rule (host and path together, then the longer host, then 'block' before 'allow') wins; no rule gives
    rule null and verdict `default`.  Null rule hosts are ignored, a null rule path is empty.  Null, empty and
    malformed urls have an empty host, which no rule fits.  Repeated urls are judged once; columns of `urls` that
    are called host, path, rule or verdict are replaced.

    Each distinct url is expanded into (host suffix + path prefix) strings, only at the label counts and path
    lengths that rules have (two short lists, bounded by the longest rule).  The expressions meet the rules in an
    equi-join on the first digits of their SHA-256; the full digests then confirm the match.
    """
    rules = rules.filter(F.col("host").isNotNull()).select(
        F.col("host").alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict"))
    shapes = rules.agg(F.collect_set(F.size(F.split("r_host", r"\."))), F.collect_set(F.length("r_path"))).first()
    labels, lengths = sorted(shapes[0]), sorted(shapes[1])
    digest = F.sha2(F.concat("r_host", F.lit("\n"), "r_path"), 256)
    listed = rules.select("r_host", "r_path", "r_verdict", digest.alias("r_digest")).withColumn(
        "short", F.substring("r_digest", 1, prefix_digits))

    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = url_parts(F.col("url"))
    distinct = urls.select("url").distinct().filter(F.col("url").isNotNull()).select(host.alias("u_host"), path.alias("u_path")).distinct()
    parts = F.split("u_host", r"\.")
    hosts = F.array_distinct(F.transform(
        F.filter(F.array(*[F.lit(n) for n in labels]).cast("array<int>"), lambda n: n <= F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")))
    paths = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("u_path")),
        lambda n: F.substring(F.col("u_path"), F.lit(1), n))
    expressions = (distinct.filter("u_host <> ''").withColumn("x_host", F.explode(hosts)).withColumn("x_path", F.explode(paths))
                   .withColumn("digest", F.sha2(F.concat("x_host", F.lit("\n"), "x_path"), 256))
                   .withColumn("short", F.substring("digest", 1, prefix_digits)))
    hits = expressions.join(listed, "short").filter(F.col("digest") == F.col("r_digest"))
    order = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), F.col("r_verdict"), F.col("r_path"))
    best = hits.groupBy("u_host", "u_path").agg(
        F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), order).alias("won"))
    judged = urls.select(*kept, host.alias("host"), path.alias("path"))
    return judged.join(best, (judged["host"] == best["u_host"]) & (judged["path"] == best["u_path"]), "left").select(
        *kept, "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select(
        "page_id", "host", "path", "rule", "verdict")


ORACLE = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                          ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, host, path, arg_max(h || p, length(h || p)) FILTER (WHERE h IS NOT NULL) AS rule,
       coalesce(arg_max(v, length(h || p)) FILTER (WHERE h IS NOT NULL), 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
GROUP BY page_id, host, path
"""
