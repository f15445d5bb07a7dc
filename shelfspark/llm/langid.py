"""Language identification: normalised TF-IDF n-gram vectors against several clustered centroids per language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize, ship
from .common import free_name, table

WIDTH_BITS = 13          # 8192 hashed features
GRAMS = (1, 2, 3)        # bytes of lower-cased UTF-8, words padded with one space
PER_LANGUAGE = 500       # distinct labelled texts of a language that its centroids are fitted on, at most
CENTROIDS = 4
SLICE = 512              # texts judged at once
RANGE_BITS = 12          # hash ranges in which a language's distinct texts are counted before some are ranked
MOST_LANGUAGES = 2000    # more labels than that are not languages: an error
SLACK = 0.2              # a text is rejected below this share of the cosine that 99 of 100 sample texts reach ...
BAND_SLACK = 0.8         # ... or, in bands of length with BAND_TEXTS sample texts, below this share of theirs, but not above
FOREIGN_MARGIN = 1.15    # this much of the median cosine of texts whose own language is left out
BAND_TEXTS = 20
BANDS = 40               # a band of length holds texts with 2^band to 2^(band + 1) - 1 bytes
UNKNOWN = "und"
PIECE = 1 << 20          # bytes of a text that are counted at once

_KEEP = np.full(256, 32, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text; digits, punctuation and white space count as one space."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)
    counts = np.zeros(1 << WIDTH_BITS, np.int64)
    longest = max(GRAMS)
    for at in range(0, len(raw), PIECE):
        first = max(0, at - 4096 if at else 0)  # enough before to know what a run of spaces collapses to
        part = _KEEP[raw[first:at + PIECE]]
        keep = np.ones(len(part), bool)
        keep[1:] = (part[1:] != 32) | (part[:-1] != 32)
        own = keep.copy()
        own[:at - first] = False
        n_before = int((keep & ~own).sum())
        part = part[keep].astype(np.uint32)
        hashed = np.zeros(len(part), np.uint32)
        for n in range(1, longest + 1):  # the grams that end at each byte
            shifted = np.zeros(len(part), np.uint32)
            shifted[n - 1:] = part[:len(part) - n + 1]
            hashed = hashed + shifted * np.uint32(pow(0x01000193, n, 1 << 32))
            if n in GRAMS:
                mixed = (hashed + np.uint32(n)) * np.uint32(2654435761)
                ends = mixed[max(n - 1, n_before):]
                counts += np.bincount(ends >> np.uint32(32 - WIDTH_BITS), minlength=len(counts))
    return counts


def unit(weights: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(weights, axis=-1, keepdims=True)
    return weights / np.maximum(size, 1e-12)


def band_of(grams: int) -> int:
    return min(BANDS - 1, max(1, grams // len(GRAMS)).bit_length() - 1)


@dataclass
class Model:
    """idf per feature; unit centroids with their languages and the least cosines that they accept, by band of length."""
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    floors: np.ndarray

    def vector(self, counts: np.ndarray) -> np.ndarray:
        return unit(np.log1p(counts).astype(np.float32) * self.idf)

    def judge(self, text: str) -> tuple[str, float, bool]:
        """(language, cosine, accepted); ties go to the language that sorts first."""
        if not self.languages:
            return UNKNOWN, 0.0, False
        counts = gram_counts(text)
        cosines = self.centroids @ self.vector(counts)
        best = int(cosines.argmax())
        score = float(min(1.0, max(0.0, cosines[best])))
        return self.languages[best], score, bool(score >= self.floors[best, band_of(int(counts.sum()))])


def cluster(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from k spread-out rows (each next one is the least similar to those chosen)."""
    chosen = [int((rows @ rows.sum(axis=0)).argmax())]
    near = rows @ rows[chosen[0]]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, rows @ rows[chosen[-1]])
    centers = rows[chosen]
    for _ in range(rounds):
        home = (rows @ centers.T).argmax(axis=1)
        centers = np.stack([unit(rows[home == i].sum(axis=0)) if (home == i).any() else centers[i] for i in range(len(centers))])
    return centers


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS, slack: float = SLACK) -> Model:
    """Learns from labelled(text, lang); rows with a null are left out.

    Document frequencies come from all rows.  The centroids of a language are fitted on its `per_language` distinct texts
    with the smallest hashes, a bound that keeps the model small.  The same texts set the floors: a band of length is judged by
    the low cosines of its own texts and by those of texts whose own language is left out; a band with few
    texts takes the floor of the next shorter one that has enough, and below all these a share of the language's low cosines.
    """
    spark = labelled.sparkSession
    ship(spark)
    rows = labelled.filter("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("h"))
    # a language's texts are counted per range of hashes; only those in the ranges that reach the bound are ranked
    hashes = materialize(rows.select("lang", "h").distinct().withColumn("range", F.shiftright("h", 64 - RANGE_BITS)), "language_hashes")
    fewer = F.sum("n").over(Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    needed = hashes.groupBy("lang", "range").agg(F.count("*").alias("n")).withColumn("fewer", F.coalesce(fewer, F.lit(0))).filter(F.col("fewer") < per_language)
    order = Window.partitionBy("lang").orderBy("h")
    drawn = hashes.join(needed.select("lang", "range"), ["lang", "range"]).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language)
    last = drawn.groupBy("lang").agg(F.max("h").alias("h")).limit(MOST_LANGUAGES + 1).collect()
    if len(last) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} distinct labels")
    cut = {r["lang"]: r["h"] for r in last}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, n = np.zeros(1 << WIDTH_BITS, np.int64), 0
        for batch in batches:
            drawn = []
            for text, lang, h in zip(batch["text"], batch["lang"], batch["h"]):
                counts = gram_counts(text)
                seen += counts > 0
                n += 1
                if h <= cut[lang]:
                    at = np.flatnonzero(counts)
                    drawn.append((-2, 0, lang, h, at.astype(np.int32), counts[at].astype(np.int32)))
            if drawn:
                yield pd.DataFrame(drawn, columns=["feature", "n", "lang", "h", "at", "counts"], dtype=object)
        yield pd.DataFrame({"feature": np.append(np.arange(len(seen)), -1), "n": np.append(seen, n), "lang": None, "h": None, "at": None, "counts": None})
    counted = materialize(rows.mapInPandas(count, "feature int, n long, lang string, h long, at array<int>, counts array<int>"), "language_counts")
    found = counted.filter("feature > -2").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()  # one row per feature
    df = np.zeros((1 << WIDTH_BITS) + 1)
    df[found["feature"]] = found["n"]  # -1, the last, is the number of texts
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)
    model = Model(idf, np.zeros((0, 1 << WIDTH_BITS), np.float32), [], np.zeros((0, BANDS)))

    def group(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        some = some.drop_duplicates("h").sort_values("h")
        dense = np.zeros((len(some), 1 << WIDTH_BITS), np.float32)
        for row, at, counts in zip(dense, some["at"], some["counts"]):
            row[at] = counts
        vectors = model.vector(dense)
        centers = cluster(vectors, centroids)
        cosines = vectors @ centers.T
        home = cosines.argmax(axis=1)
        floors = [slack * float(np.quantile(cosines[home == i, i], 0.01)) if (home == i).any() else 0.0 for i in range(len(centers))]
        return pd.DataFrame({"lang": key[0], "center": list(centers), "floor": min(floors)})
    drawn_texts = counted.filter("feature = -2")
    fitted = drawn_texts.groupBy("lang").applyInPandas(group, "lang string, center array<float>, floor double").toPandas()
    if not len(fitted):
        return model
    fitted = fitted.sort_values("lang", kind="stable")
    model = Model(idf, np.stack(fitted["center"].to_numpy()).astype(np.float32), fitted["lang"].tolist(), np.repeat(fitted["floor"].to_numpy()[:, None], BANDS, axis=1))
    set_band_floors(model, drawn_texts.dropDuplicates(["lang", "h"]))
    return model


def set_band_floors(model: Model, texts: DataFrame) -> None:
    """Floors by band of length from texts(lang, at, counts), the sample of the fit."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def cosines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = np.array(shared.value.languages, dtype=object)
        for batch in batches:
            out = []
            for lang, at, counts in zip(batch["lang"], batch["at"], batch["counts"]):
                dense = np.zeros(1 << WIDTH_BITS, np.float32)
                dense[at] = counts
                near = shared.value.centroids @ shared.value.vector(dense)
                other = near[names != lang]
                out.append((lang, band_of(int(np.sum(counts))), float(near[names == lang].max()), float(other.max()) if len(other) else None))
            yield pd.DataFrame(out, columns=["lang", "band", "own", "other"])
    found = texts.select("lang", "at", "counts").mapInPandas(cosines, "lang string, band int, own double, other double")
    # one row per language and band, and one per band
    rows = found.groupingSets([["lang", "band"], ["band"]], "lang", "band").agg(
        F.count("*").alias("n"), F.percentile("own", 0.01).alias("own"), F.percentile("other", 0.5).alias("other")).collect()
    foreign = {r["band"]: r["other"] for r in rows if r["lang"] is None and r["n"] >= BAND_TEXTS and r["other"] is not None}
    own = {(r["lang"], r["band"]): r["own"] for r in rows if r["lang"] is not None and r["n"] >= BAND_TEXTS}
    for i, lang in enumerate(model.languages):
        floor = None
        for band in range(BANDS):
            if (lang, band) in own and band in foreign:
                floor = min(FOREIGN_MARGIN * foreign[band], BAND_SLACK * own[lang, band])
            if floor is not None:
                model.floors[i, band] = floor


def predict(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """The `keep` columns of docs, with the predicted language, the score (cosine, 0 to 1) and whether it is rejected under
    `names`, which must not be among those kept.

    A null text or one without a letter is `und` with score 0 and is rejected; others get the language of the
    nearest centroid and are rejected below its floor.  Whole texts are read; `text` is the only input.
    """
    spark = docs.sparkSession
    ship(spark)
    letter_name = free_name(docs.columns, "has_letter")
    shared = spark.sparkContext.broadcast(model)  # centroids of at most MOST_LANGUAGES languages
    rows = docs.select(*keep, *[c for c in ["text"] if c not in keep], F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(letter_name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            found = [shared.value.judge(t) if letter else (UNKNOWN, 0.0, False) for t, letter in zip(batch.column("text").to_pylist(), batch.column(letter_name).to_pylist())]
            new = [pa.array([f[0] for f in found], pa.string()), pa.array([float(f[1]) for f in found], pa.float64()), pa.array([not f[2] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + new, names=[*keep, *names])
    return rows.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + [f"`{n}` {t}" for n, t in zip(names, ("string", "double", "boolean"))]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang"))
    got = predict(docs.select("doc_id", "text"), model, ["doc_id"])
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
