"""Secret scan: keyworded, access-key and hexadecimal secrets, and multipart credentials linked by co-occurrence.

DataFrame functions only.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import met
from ..session import materialize
from .common import packed, table

# Fixed patterns of the base kinds (kind, pattern, group whose length counts, least length), in the order of ties.
# Runs of one class match the same with the least length inside the pattern; `assign` does not, so it is filtered.
BASE = [
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
# Weak parts of a credential; none is reported alone.  Roles: id, secret, endpoint.
WEAK = [
    ("key_id", r"(?<![A-Za-z0-9])(?:A[A-Z]IA|AKID|LTAI|GOOG)[A-Za-z0-9]{8,}(?![A-Za-z0-9])", "id"),
    ("client_id", r"""(?:(?i)client_?id|account_?(?:name|id)|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{4,}""", "id"),
    ("key_material", r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/]{0,200}[0-9])(?=[A-Za-z0-9+/]{0,200}[A-Z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])", "secret"),
    ("endpoint", r"(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[A-Za-z0-9._~:@%-]+|(?i)endpoint[\x22']?\x20*[:=]\x20*[\x22']?[A-Za-z0-9./:_-]{4,}", "endpoint"),
]
KINDS = [k for k, *_ in BASE] + [k for k, *_ in WEAK]
ROLES = {"assign": "secret", "access": "id", "hex": "secret", **{k: role for k, _, role in WEAK}}
SCOPE = 200  # code points between complementary parts, at most


def running_sums(lengths: Column) -> Column:
    """Sums of all elements up to each one.  Blocks of about sqrt(n) keep the copying of growing arrays at n^1.5."""
    step = F.greatest(F.ceil(F.sqrt(F.size(lengths))).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(lengths), F.lit(1)) - 1) / step).cast("int")),
                         lambda b: F.slice(lengths, b * step + 1, step))
    empty = F.array().cast("array<long>")
    fold = lambda values, start: F.aggregate(
        values, F.struct(start.alias("at"), empty.alias("sums")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["sums"], F.array(acc["at"] + n)).alias("sums")))["sums"]
    total = lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda acc, n: acc + n)
    before = F.transform(blocks, total)
    offsets = F.concat(F.array(F.lit(0).cast("long")), fold(before, F.lit(0).cast("long")))
    return F.flatten(F.transform(blocks, lambda block, i: fold(block, F.element_at(offsets, i + 1))))


def found(text: Column, kind: str, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Spans (start, rank, end) of the leftmost non-overlapping matches whose group has at least `least` characters.

    Splitting at the pattern and extracting it see the same matches, so the lengths between and of matches give the
    positions.  Only texts with a match pay for it.
    """
    regex = F.lit(pattern)
    length = lambda s: F.length(s).cast("long")
    whole = F.regexp_extract_all(text, regex, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), length)
    both = F.zip_with(F.slice(gaps, 1, F.size(whole)), F.transform(whole, length), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    ends = running_sums(F.transform(both, lambda x: x["g"] + x["m"]))
    rank = F.lit(KINDS.index(kind))
    spans = F.zip_with(both, ends, lambda x, e: F.struct((e - x["m"]).alias("start"), rank.alias("rank"), e.alias("end")))
    if group:
        sizes = F.transform(F.regexp_extract_all(text, regex, F.lit(group)), length)
        spans = F.transform(F.filter(F.arrays_zip(spans.alias("s"), sizes.alias("n")), lambda x: x["n"] >= least), lambda x: x["s"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>"))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(
        F.element_at(names, s["rank"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, key (a hash of the text), base and linked span arrays.

    Base spans are always reported.  Weak parts (short access ids, key material, endpoints) are reported only when
    complementary parts lie near, with fewer than `scope` code points between: an id needs a secret and the other way
    round, an endpoint needs both; base spans are parts too (assign and hex are secrets, access is an id).  A weak
    match that overlaps a base span is no part.  A null text is empty; repeated rows give repeated results; other
    columns are ignored.

    The interval join: parts are dealt to (document, bin of `scope` code points).  Parts that share a bin are near; of
    the bin before only the latest end and of the bin after only the earliest start can matter, so each bin keeps two
    numbers per role and no pairs of parts are made.
    """
    text = F.coalesce("text", F.lit(""))
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
    rows = docs.select("doc_id", F.xxhash64(text).alias("key"), text.alias("text"))
    base = F.flatten(F.array(*[found(F.col("text"), *b) for b in BASE]))
    weak = F.flatten(F.array(*[found(F.col("text"), k, p) for k, p, _ in WEAK]))
    marked = materialize(rows.select("doc_id", "key", base.alias("base"), weak.alias("weak")), "secret_spans")
    roles = F.create_map(*[x for k in KINDS for x in (F.lit(KINDS.index(k)), F.lit(ROLES[k]))])
    is_base = F.col("s.rank") < len(BASE)
    one = marked.filter(F.size("weak") > 0).dropDuplicates(["doc_id", "key"])
    spans = one.select("doc_id", "key", F.explode(F.concat("base", "weak")).alias("s"))
    left = Window.partitionBy("doc_id", "key").orderBy("s.start", "s.rank", "s.end").rowsBetween(Window.unboundedPreceding, -1)
    right = Window.partitionBy("doc_id", "key").orderBy(F.desc("s.start"), F.desc("s.rank"), F.desc("s.end")).rowsBetween(Window.unboundedPreceding, -1)
    parts = (spans.withColumn("ended", F.max(F.when(is_base, F.col("s.end"))).over(left))
             .withColumn("begins", F.min(F.when(is_base, F.col("s.start"))).over(right))
             .filter(is_base | (F.coalesce("ended", F.lit(0)) <= F.col("s.start")) & (F.coalesce("begins", F.col("s.end")) >= F.col("s.end")))
             .select("doc_id", "key", "s", roles[F.col("s.rank")].alias("role"),
                     F.explode(F.sequence(F.floor(F.col("s.start") / scope), F.floor((F.col("s.end") - 1) / scope))).alias("bin")))
    ends = parts.groupBy("doc_id", "key", "role", "bin").agg(
        F.min(F.greatest(F.col("s.start"), F.col("bin") * scope)).alias("first"), F.max(F.least(F.col("s.end"), (F.col("bin") + 1) * scope)).alias("last"))
    none = F.lit(None).cast("long")
    around = ends.select(F.col("doc_id").alias("e_doc"), F.col("key").alias("e_key"), F.col("role").alias("e_role"), F.explode(F.array(
        F.struct(F.col("bin").alias("e_bin"), F.lit(True).alias("here"), none.alias("before"), none.alias("after")),
        F.struct((F.col("bin") + 1).alias("e_bin"), F.lit(False).alias("here"), F.col("last").alias("before"), none.alias("after")),
        F.struct((F.col("bin") - 1).alias("e_bin"), F.lit(False).alias("here"), none.alias("before"), F.col("first").alias("after")))).alias("e")
    ).select("e_doc", "e_key", "e_role", "e.*")
    near = parts.filter(~is_base).join(around, F.col("doc_id").eqNullSafe(F.col("e_doc")) & (F.col("key") == F.col("e_key")) & (F.col("bin") == F.col("e_bin"))).filter(
        (F.col("role") != F.col("e_role")) & (F.col("here") | F.coalesce(F.col("s.start") - F.col("before") < scope, F.col("after") - F.col("s.end") < scope)))
    linked = near.groupBy("doc_id", "key", "s", "role").agg(F.collect_set("e_role").alias("roles")).filter(
        F.when(F.col("role") == "endpoint", F.array_contains("roles", "id") & F.array_contains("roles", "secret"))
        .when(F.col("role") == "id", F.array_contains("roles", "secret")).otherwise(F.array_contains("roles", "id")))
    each = linked.groupBy("doc_id", "key").agg(F.collect_set("s").alias("linked")).select(
        F.col("doc_id").alias("l_doc"), F.col("key").alias("l_key"), "linked")
    joined = marked.join(each, F.col("doc_id").eqNullSafe(F.col("l_doc")) & (F.col("key") == F.col("l_key")), "left")
    return joined.select("doc_id", "key", "base", F.array_sort(F.coalesce("linked", empty)).alias("linked"))


def redact(docs: DataFrame, mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """docs with every reported span of `text` replaced by `mark` (overlapping spans by one mark); rows and columns stay.

    A null text stays null, an empty one empty; repeated rows are masked alike; other columns may have any name.  Spans
    are cut at code points, from whole texts.  Texts without a span do not move.
    """
    spans = scan_secrets(docs, scope)
    all_spans = F.array_sort(F.concat("base", "linked"))
    per = materialize(spans.filter(F.size("base") + F.size("linked") > 0).select(F.col("doc_id").alias("of"), "key", all_spans.alias("spans")).dropDuplicates(["of", "key"]), "secret_cuts")
    text = F.col("row.text")
    cut = F.aggregate(
        F.col("spans"), F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
            s["end"].alias("at"),
            F.when(s["start"] < acc["at"], acc["parts"]).otherwise(F.concat(
                acc["parts"], F.array(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark)))).alias("parts"))))
    clean = F.concat(F.array_join(cut["parts"], ""), F.substring(text, (cut["at"] + 1).cast("int"), F.length(text)))
    rows = met(packed(docs, id=F.col("doc_id"), key=F.xxhash64(F.coalesce("text", F.lit("")))), "key", per.select("key"))
    found = rows.filter("met").join(per, F.col("id").eqNullSafe(F.col("of")) & (rows["key"] == per["key"]), "left")
    masked = found.select(F.when(F.col("spans").isNotNull(), F.col("row").withField("text", clean)).otherwise(F.col("row")).alias("row"))
    return rows.filter("not met").select("row.*").unionByName(masked.select("row.*"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return got.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                      listed(F.concat("base", "linked")).alias("spans"))
