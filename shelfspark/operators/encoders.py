"""Text encoders: any callable texts -> matrix, run once per task over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..session import materialize
from .dedup import split_repeated

Encoder = Callable[[list[str]], np.ndarray]


def embed_items(items: DataFrame, make_encoder: Callable[[], Encoder], *, item: str = "item_id",
                text: str = "search_text", batch: int = 64) -> DataFrame:
    """(item, vec) with unit vectors.  `make_encoder` runs once per task, so a model loads once;
    the encoder is called with at most `batch` texts."""
    kind = items.schema[item].dataType.simpleString()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for pdf in batches:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start:start + batch]
                mat = np.asarray(encoder(part[text].fillna("").tolist()), dtype=np.float64)
                norm = np.linalg.norm(mat, axis=1, keepdims=True)
                mat = (mat / np.where(norm > 0, norm, 1.0)).astype(np.float32)
                yield pd.DataFrame({item: part[item].to_numpy(), "vec": list(mat)})

    return items.select(item, text).mapInPandas(encode, f"{item} {kind}, vec array<float>")


def hash_encoder(items: DataFrame, dim: int = 64, item: str | list[str] = "item_id", text: str = "search_text") -> DataFrame:
    """(item columns, vec): deterministic bag-of-words vectors, JVM-side; the same for items and for query texts.

    A token's MD5 gives its position (first eight digits) and its sign (the ninth); counts are summed per position inside the
    row, so no token moves, and each array is built once and scaled to unit length.  Equal texts give equal vectors on every
    machine; a text without tokens has the zero vector.  Only where keys repeat are the sums of equal keys added up.
    """
    keys = [item] if isinstance(item, str) else item

    def code(digest: Column) -> Column:  # the position from 1, with the sign
        place = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int") + 1
        return F.when(F.substring(digest, 9, 1) < "8", place).otherwise(-place)
    digests = F.transform(tokenize(F.col(text)), lambda t: F.md5(t.cast("binary")))
    once = lambda c: F.explode(F.array(c))  # noqa: E731  a value made once a row, not again wherever a lambda names it
    total = lambda p: F.size(F.filter("_c", lambda c: c == p)) - F.size(F.filter("_c", lambda c: c == -p))

    def sums(rows: DataFrame) -> DataFrame:
        coded = rows.select(*keys, once(F.transform(digests, code)).alias("_c"))
        return coded.select(*keys, once(F.transform(F.array_distinct(F.transform("_c", F.abs)), lambda p: F.struct((p - 1).alias("_i"), total(p).cast("double").alias("_v")))).alias("_e"))
    single, repeated = split_repeated(items, keys)
    summed = sums(single)
    if repeated is not None:
        places = sums(repeated).select(*keys, F.explode_outer("_e").alias("_e")).groupBy(*keys, "_e._i").agg(F.sum("_e._v").alias("_v"))
        summed = summed.unionByName(places.groupBy(*keys).agg(F.collect_list(F.when(F.col("_i").isNotNull(), F.struct("_i", "_v"))).alias("_e")))  # at most dim entries
    norm = F.sqrt(F.aggregate("_e", F.lit(0.0), lambda acc, e: acc + e["_v"] * e["_v"]))
    held = summed.select(*keys, once(F.struct(F.map_from_entries("_e").alias("_m"), norm.alias("_n"))).alias("_h")).select(*keys, "_h._m", "_h._n")
    return held.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(
        F.try_element_at("_m", i) / F.nullif(F.col("_n"), F.lit(0.0)), F.lit(0.0)).cast("float")).alias("vec"))


def sparse_tfidf(items: DataFrame, dim: int = 4096, item: str = "item_id", text: str = "search_text") -> DataFrame:
    """(item, vec): the default text encoder, unit tf-idf vectors as arrays of (pos, weight) by position, without zeros.

    A token's position is that of `hash_encoder`; idf is ln((n + 1) / (df + 1)) over all n items.  Document frequencies have
    at most `dim` rows and go out as a broadcast, so the terms meet nothing but their own item.  A text without
    tokens, or with only tokens that every item has, gets the empty vector.
    """
    terms = items.select(item, F.explode_outer(tokenize(F.col(text))).alias("_t")).select(
        item, F.pmod(F.conv(F.substring(F.md5(F.col("_t").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int").alias("_pos"))
    counts = materialize(terms.groupBy(item, "_pos").agg(F.count(F.lit(1)).alias("_tf")), "term_counts")
    n = counts.select(item).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    seen = counts.filter("_pos IS NOT NULL").groupBy("_pos").agg(F.count(F.lit(1)).alias("_df")).withColumn("_idf", F.log((n + 1) / (F.col("_df") + 1)))
    weighed = counts.join(F.broadcast(seen), "_pos", "left").withColumn("_w", F.col("_tf") * F.col("_idf")).groupBy(item).agg(
        F.array_sort(F.collect_list(F.when(F.col("_w") > 0, F.struct(F.col("_pos").alias("pos"), F.col("_w").alias("weight"))))).alias("_v"),  # at most dim entries
        F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm"))
    return weighed.select(item, F.transform("_v", lambda e: F.struct(e["pos"].alias("pos"), (e["weight"] / F.col("_norm")).alias("weight"))).alias("vec"))


def sparse_dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of (pos, weight) that are sorted by position: one merge over both, without dense arrays."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0.0).alias("dot"))

    def step(s: Column, _: Column) -> Column:
        left, right = F.get(a, s["i"]), F.get(b, s["j"])
        move = left["pos"].isNotNull() & right["pos"].isNotNull()
        same = move & (left["pos"] == right["pos"])
        return F.struct((s["i"] + F.when(move & (left["pos"] <= right["pos"]), 1).otherwise(0)).alias("i"),
                        (s["j"] + F.when(move & (left["pos"] >= right["pos"]), 1).otherwise(0)).alias("j"),
                        (s["dot"] + F.when(same, left["weight"] * right["weight"]).otherwise(0.0)).alias("dot"))
    return F.aggregate(F.array_repeat(F.lit(0), F.size(a) + F.size(b)), start, step)["dot"]
