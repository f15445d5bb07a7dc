import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from shelfspark.llm import resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, n):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i:i + k]).encode()) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, percent, least, buckets, n=2, seed=7):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for f in plain_features(t, n)[1]:
                out[f % buckets] += 1
        return out
    s, t = counts(x[1] for x in docs), counts(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for doc_id, text in docs:
        words, found = plain_features(text, n)
        weight = sum(gain[f % buckets] for f in found) // len(found) if found else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, words])
    fit = sorted((r for r in rows if r[4] >= least and r[0] is not None), key=lambda r: (-r[3], r[0]))
    rank = {id(r): i + 1 for i, r in enumerate(fit[:percent * len(fit) // 100])}
    return [(*r[:4], rank.get(id(r))) for r in rows]


def texts(count, seed=1):
    rng = random.Random(seed)
    pool = ["Alpha", "beta", "gämma", "3x", "日本語", "delta", "ÉPSILON", "z"]
    return [rng.choice([" ", "-", "\n"]).join(rng.choices(pool, k=rng.randint(0, 60))) for _ in range(count)]


@pytest.mark.parametrize("bits,block", [(11, 16384), (3, 7), (5, 64)])
def test_equals_plain_loop(spark, bits, block):
    docs = [(i * 37 - 4000, t) for i, t in enumerate(texts(300))]
    target = texts(40, seed=2)
    got = resampling.importance_resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in target], "text string"),
                                         bits=bits, block=block, buckets=97)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(plain(docs, target, 25, 20, 97), key=repr)


def test_odd_rows(spark):
    long = "one two " * 300_000
    docs = [(None, "a " * 30), (1, None), (2, ""), (3, "?!"), (4, long), (5, "word " * 25), (6, "word " * 25), (2 ** 62, "word " * 25), (-2 ** 62 - 5, "word " * 30)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, rank int, pos int")
    target = spark.createDataFrame([(None, 1), ("word two", 2)], "text string, score int")
    got = resampling.importance_resample(df, target, percent=100)
    want = plain(docs, [None, "word two"], 100, 20, 10_000)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert got.filter("rank is not null").count() == 5
    assert resampling.importance_resample(df.filter("false"), target).count() == 0
    assert resampling.importance_resample(df, target.filter("false")).count() == len(docs)


def test_repeated_rows_each_count(spark):
    df = spark.createDataFrame([(1, "word " * 25)] * 8, "doc_id long, text string")
    got = resampling.importance_resample(df, df.select("text"), percent=50)
    assert sorted(r.rank for r in got.collect() if r.rank) == [1, 2, 3, 4]


@pytest.mark.parametrize("chunk", [1, 5, 17, 1 << 20])
def test_chunks_lose_no_run(chunk):
    for text in texts(30, seed=3):
        for n in (1, 2, 3):
            parts = list(resampling.feature_buckets(text, n, 1 << 40, chunk))
            words, found = plain_features(text, n)
            assert sum(p[0] for p in parts) == words
            assert sorted(int(x) for p in parts for x in p[1]) == sorted(found)


def test_radix_sort_is_stable_and_takes_full_range(spark):
    rng = random.Random(5)
    keys = [rng.choice([-2 ** 63, -1, 0, 1, 2 ** 63 - 1, rng.randrange(-2 ** 63, 2 ** 63)]) for _ in range(200)]
    df = spark.createDataFrame([(k, i % 3, i) for i, k in enumerate(keys)], "a long, b long, nr long").repartition(3)
    state = resampling.radix_positions(df, [("b", False), ("a", True)], bits=9, block=16)
    rows = sorted(state.collect(), key=lambda r: r.pos)
    assert [r.pos for r in rows] == list(range(200))
    assert [(-r.b, r.a) for r in rows] == sorted((-(i % 3), k) for i, k in enumerate(keys))
    same = resampling.radix_positions(df.select("nr", F.lit(1).cast("long").alias("a")), [("a", True)])
    assert sorted(r.pos for r in same.collect()) == list(range(200))


def test_query_equals_sql(spark):
    from oracle_check import compare, connect
    from shelfspark.llm.registered import ORACLES, QUERIES
    sf = "/root/testdata/sf0.01"
    assert compare(QUERIES["op11_importance_resampling"](spark, sf), connect(sf), ORACLES["op11_importance_resampling"]) == ""
