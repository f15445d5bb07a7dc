"""Target-distribution importance resampling: weights from an array of gains, ranks by a distributed LSD radix sort."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, ship
from .common import table

DIGIT_BITS = 11     # a pass counts 2,048 digits
BLOCK_ROWS = 16384  # rows of a block of positions: counts are at most an eighth of the rows
CHUNK = 1 << 20     # bytes of a text that are cut into words at a time
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def feature_buckets(text: str | None, n: int, buckets: int, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray]]:
    """Per chunk of a text: number of words, and the bucket of each run of 1 to n words (the checksum of the run's bytes).

    A chunk ends between words and takes over the last n - 1 words of the one before, so no run is lost or counted twice.
    """
    data = (text or "").encode().lower()  # bytes: only A-Z change
    at, tail = 0, []
    while at < len(data):
        stop = len(data) if at + chunk >= len(data) else (gap.start() if (gap := GAP.search(data, at + chunk)) else len(data))
        new = WORD.findall(data, at, stop)
        words, at = tail + new, stop
        sums, parts = list(map(zlib.crc32, words)), []
        spaced = [b" " + w for w in words[1:]]
        for length in range(1, n + 1):
            if length > 1:
                sums = list(map(zlib.crc32, spaced[length - 2:], sums))  # a checksum goes on from that of the shorter run
            parts.append(np.array(sums[max(0, len(tail) - length + 1):], np.int64))
        tail = words[max(0, len(words) - n + 1):]
        yield len(new), np.concatenate(parts) % buckets


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> np.ndarray:
    """Features per bucket over all rows of texts(text); a task hands on one row per bucket, the driver gets `buckets` numbers."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in feature_buckets(text.as_py(), n, buckets):
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "found"])

    sums = texts.mapInArrow(count, "bucket long, found long").groupBy("bucket").agg(F.sum("found").alias("found")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[sums["bucket"].to_numpy()] = sums["found"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 * ln of the smoothed target share over the smoothed source share), in doubles."""
    cells, every, wanted = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (every + cells) / ((s + 1.0) * (wanted + cells)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def drawn_noise(seed: int, doc_id: int) -> int:
    """floor(-1000 * ln(-ln u)), u from the first 8 hex digits of sha256("seed:doc_id")."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, n: int, seed: int) -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight, score) of docs(doc_id, text); a null doc_id gets no score."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = features = total = 0
                for new, found in feature_buckets(text.as_py(), n, len(gain)):
                    words, features, total = words + new, features + len(found), total + int(gain[found].sum())
                weight = total // features if features else 0
                out.append((doc_id, words, features, weight, None if doc_id is None else weight + drawn_noise(seed, doc_id)))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


def radix_positions(rows: DataFrame, keys: list[tuple[str, bool]], bits: int = DIGIT_BITS, block: int = BLOCK_ROWS) -> DataFrame:
    """Rows with `pos`, their 0-based place in the order of `keys` ((long column without nulls, ascending), most significant first).

    A least-significant-digit radix sort.  Each pass is a stable counting sort by one digit of the composite key: rows are
    counted per (digit, block of positions), prefix sums over digits and, within a digit, over blocks give where a block's
    rows of a digit begin, and the row's place among them completes its destination.  Rows alike in all keys keep their
    input order.  Totals per digit do not depend on the order: one aggregation has them for all passes, at most
    2^bits numbers each, which go through the driver.  Digits that all rows share take no pass.  `rows` must not use the
    columns pos, block, digit, place, begins, before.
    """
    state = materialize(rows.withColumn("pos", F.monotonically_increasing_id()).withColumn("block", F.shiftright("pos", 33)), "radix_rows")
    ends = state.agg(F.count("*"), *[f(k) for k, _ in keys for f in (F.min, F.max)]).first()
    passes = []
    for i, (key, up) in reversed(list(enumerate(keys))):
        low, high = (ends[1 + 2 * i], ends[2 + 2 * i]) if ends[0] else (0, 0)
        if high - low < 1 << 63:
            unsigned, width = (F.col(key) - F.lit(low) if up else F.lit(high) - F.col(key)), (high - low).bit_length()
        else:  # the sign bit turned makes the order of longs that of unsigned numbers
            unsigned, width = F.col(key).bitwiseXOR(F.lit(-1 << 63 if up else (1 << 63) - 1)), 64
        passes += [F.shiftrightunsigned(unsigned, shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("int") for shift in range(0, width, bits)]
    if not passes:
        return numbered(state)
    digits = F.explode(F.array(*[F.struct(F.lit(p).alias("pass"), d.alias("digit")) for p, d in enumerate(passes)]))
    totals = state.select(digits.alias("d")).groupBy("d.pass", "d.digit").count().toPandas().sort_values(["pass", "digit"])
    spark = rows.sparkSession
    for p, digit in enumerate(passes):
        own = totals[totals["pass"] == p]
        begins = spark.createDataFrame(list(zip(own["digit"].tolist(), (own["count"].cumsum() - own["count"]).tolist())), "digit int, begins long")
        dealt = state.withColumn("digit", digit)
        counts = dealt.groupBy("digit", "block").agg(F.count("*").alias("size"))
        before = F.sum("size").over(Window.partitionBy("digit").orderBy("block")) - F.col("size")
        offsets = counts.select("digit", "block", before.alias("before")).join(F.broadcast(begins), "digit")  # 2^bits rows at most
        place = F.row_number().over(Window.partitionBy("digit", "block").orderBy("pos")) - 1
        moved = dealt.withColumn("place", place).join(offsets, ["digit", "block"])
        state = materialize(moved.select(*rows.columns, (F.col("begins") + F.col("before") + F.col("place")).alias("pos")).withColumn(
            "block", F.floor(F.col("pos") / block)), "radix_rows")
    return state.drop("block")


def numbered(state: DataFrame) -> DataFrame:
    """Positions in input order, for rows alike in every key: block sizes and their prefix sums."""
    sizes = state.groupBy("block").agg(F.count("*").alias("size"))
    before = sizes.select("block", (F.sum("size").over(Window.orderBy("block")) - F.col("size")).alias("before"))  # a row per input split
    place = F.row_number().over(Window.partitionBy("block").orderBy("pos")) - 1
    return state.withColumn("place", place).join(before, "block").withColumn("pos", F.col("before") + F.col("place")).drop("block", "before", "place")


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, n: int = 2, buckets: int = 10_000, seed: int = 7,
                        bits: int = DIGIT_BITS, block: int = BLOCK_ROWS) -> DataFrame:
    """Every document's (doc_id, n_features, weight, score, rank): documents like the texts of `target` are drawn first.

    docs(doc_id, text), target(text); other columns are ignored.  A feature is a run of 1 to n words; its bucket's gain
    compares the target's share with that of all documents.  The weight is the floored mean of the gains over a
    document's features, the score adds seeded noise, so that the highest scores are a draw without replacement in
    proportion to exp(weight / 1000).  Of the N documents of at least `least_words` words, floor(percent * N / 100) get a
    rank from 1 on; the rank of all others is null.

    A null or empty text has no feature and weight 0.  Ties go to the smaller doc_id; rows of equal doc_id and score
    keep their input order, and each row of a repeated doc_id counts.  A null doc_id has no score, no rank and does not count in N.
    An empty table gives no rows; an empty target gives gains from the smoothing alone.  Texts of any length are cut
    into words in chunks.  Counts cover all rows; only `buckets` numbers per table reach the driver.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    gain = gains(bucket_counts(own.select("text"), n, buckets), bucket_counts(target.select("text"), n, buckets))
    rows = materialize(scored(own, gain, n, seed), "resample_scores")
    fit = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    ranked = radix_positions(rows.filter(fit).drop("n_words"), [("score", False), ("doc_id", True)], bits, block)
    quota = rows.filter(fit).count() * percent // 100
    rank = F.when(F.col("pos") < quota, F.col("pos") + 1)
    return ranked.select("doc_id", "n_features", "weight", "score", rank.alias("rank")).unionByName(
        rows.filter(~fit).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


ORACLE = r"""
WITH steps AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
texts AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS (
  SELECT side, id, row_number() OVER () AS nr,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts),
runs AS (
  SELECT side, id, nr, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words),
found AS (
  SELECT f, list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: ('0x' || h)::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) AS c FROM (SELECT DISTINCT f FROM runs), steps),
dealt AS (SELECT side, id, nr, xor(c, 4294967295) % 10000 AS bucket FROM runs JOIN found USING (f)),
cells AS (
  SELECT bucket, count(*) FILTER (side = 'd')::DOUBLE AS s, count(*) FILTER (side = 'b')::DOUBLE AS t FROM dealt GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM cells) + 10000) / ((s + 1) * ((SELECT sum(t) FROM cells) + 10000))))::BIGINT AS g FROM cells),
weights AS (
  SELECT nr, count(*) AS n_features, floor(sum(g) / count(*))::BIGINT AS weight FROM dealt JOIN gain USING (bucket) WHERE side = 'd' GROUP BY nr),
scores AS (
  SELECT id AS doc_id, nr, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('7:' || id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (nr) WHERE side = 'd')
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_words >= 20 AND row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) <= (SELECT count(*) FROM scores WHERE n_words >= 20) * 25 // 100
    THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS rank
FROM scores
"""
