import zlib

import numpy as np
from pyspark.sql import functions as F

from shelfspark.llm import langid


def plain_counts(text):
    raw = b" " + text.lower().encode() + b" "
    out = bytearray()
    for b in raw:
        b = b if 97 <= b < 123 or b >= 128 else 32
        if not (b == 32 and out and out[-1] == 32):
            out.append(b)
    counts = np.zeros(1 << langid.WIDTH_BITS, np.int64)
    for n in langid.GRAMS:
        for i in range(len(out) - n + 1):
            h = sum(out[i + n - k] * pow(0x01000193, k, 1 << 32) for k in range(1, n + 1)) % (1 << 32)
            counts[((h + n) * 2654435761 % (1 << 32)) >> (32 - langid.WIDTH_BITS)] += 1
    return counts


def test_counts_equal_the_plain_loop(monkeypatch):
    texts = ["", "a", "Der Öfter, 12 x!!  y", "ñ" * 40 + " a  b" * 30]
    want = [plain_counts(t) for t in texts]
    for piece in (langid.PIECE, 7, 16):
        monkeypatch.setattr(langid, "PIECE", piece)
        for t, w in zip(texts, want):
            assert (langid.gram_counts(t) == w).all()


def test_held_out_accuracy_and_contract(spark):
    from shelfspark.llm.registered import QUERIES
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op6_language_id"](spark, sf).collect()
    assert len(rows) == len(docs)
    right = []
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        if r["held_out"] and d["lang"] is not None:
            right.append(r["lang_pred"] == d["lang"])
    assert len(right) > 100 and sum(right) / len(right) > 0.97
    assert sum(r["rejected"] for r in rows) <= 2


def test_odd_rows(spark):
    text = {"en": "the quick brown fox and the lazy dog with that ", "de": "der schnelle braune fuchs und die faulen hunde mit "}
    rows = [(i, text[l][i % 7:] * (1 + i % 3), l, "x") for i in range(60) for l in ("en", "de")]
    train = spark.createDataFrame(rows + [(1, None, "en", "x"), (2, "zzz", None, "x")], "doc_id long, text string, lang string, score string")
    model = langid.fit(train)
    asked = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "123 !? \n", "a"), (4, "the dog and the fox", "a"), (4, "the dog and the fox", "b"),
                                   (None, "die hunde und der fuchs", None), (5, "the dog and the fox " * 100_000, "a"), (6, "漢字かな交じり文" * 5, "a")], "doc_id long, text string, rejected string")
    got = {(r["doc_id"]): (r["lang_pred"], r["rejected"]) for r in langid.predict(asked, model, ["doc_id"]).collect()}
    assert got[1] == got[2] == got[3] == ("und", True)
    assert got[4] == got[5] == ("en", False) and got[None] == ("de", False) and got[6][1]
    none = langid.fit(train.filter("false"))
    assert [r["lang_pred"] for r in langid.predict(asked.filter("doc_id = 4"), none, ["doc_id"]).collect()] == ["und", "und"]
    assert langid.predict(asked.filter("false"), model, ["doc_id"]).count() == 0
    many = train.withColumn("lang", F.col("doc_id").cast("string"))
    assert len(set(langid.fit(many).languages)) == 60


def test_a_language_left_out_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang is not null and text is not null")
    for left in ("es", "de"):
        model = langid.fit(docs.filter(F.col("lang") != left).select("text", "lang"))
        judged = langid.predict(docs.select("doc_id", "text", "lang"), model, ["doc_id", "text", "lang"]).collect()
        foreign = [r["rejected"] for r in judged if r["lang"] == left and len(r["text"]) >= 600]
        own = [r["rejected"] for r in judged if r["lang"] != left]
        assert len(foreign) > 30 and sum(foreign) / len(foreign) > 0.85, (left, sum(foreign), len(foreign))
        assert sum(own) <= 0.003 * len(own), (left, sum(own), len(own))


def plain_model(rows, per_language, centroids):
    """The fit in plain loops over rows(text, lang), without floors."""
    counts = [(plain_counts(t), lang) for t, lang in rows]
    df = sum((c > 0).astype(int) for c, _ in counts)
    idf = (np.log((1 + len(rows)) / (1 + df)) + 1).astype(np.float32)
    out = {}
    for lang in {lang for _, lang in rows}:
        x = np.log1p(np.unique([c for c, own in counts if own == lang], axis=0)).astype(np.float32) * idf
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        assert len(x) <= per_language and centroids == 1
        mean = x.sum(axis=0)
        out[lang] = mean / np.linalg.norm(mean)
    return idf, out


def test_predictions_equal_plain_loops(spark):
    words = {"en": "the quick brown fox and lazy dog with that house", "de": "der schnelle braune fuchs und faule hund mit haus", "fr": "le renard brun et le chien avec la maison"}
    rng = np.random.default_rng(4)
    rows = [(" ".join(rng.choice(words[lang].split(), int(rng.integers(3, 20)))), lang) for lang in words for _ in range(40)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), centroids=1)
    idf, centers = plain_model(rows, langid.PER_LANGUAGE, 1)
    asked = [(i, t) for i, (t, _) in enumerate(rows)] + [(1000, "the hund avec haus"), (1001, "und le dog")]
    got = {r["doc_id"]: r for r in langid.predict(spark.createDataFrame(asked, "doc_id long, text string"), model, ["doc_id"]).collect()}
    for i, text in asked:
        x = np.log1p(plain_counts(text)).astype(np.float32) * idf
        near = {lang: float(c @ x / np.linalg.norm(x)) for lang, c in centers.items()}
        best = max(sorted(near), key=near.get)
        assert abs(got[i]["score"] - near[best]) < 1e-4 and (got[i]["lang_pred"] == best or abs(near[got[i]["lang_pred"]] - near[best]) < 1e-5)
