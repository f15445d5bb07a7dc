import re
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, left, free = {}, sum(sizes.values()), set(names)
    while free:
        total = sum(w[n] for n in free)
        over = {n for n in free if left * w[n] / total > most * sizes[n]}
        if not over:
            return {**target, **{n: left * w[n] / total for n in free}}
        for n in over:
            target[n] = most * sizes[n]
        left -= sum(most * sizes[n] for n in over)
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 800, None: 50}, {"a": 10, "b": 1000, "B": 3, "é": 77, "zz": 1, "y": 0}, {"only": 5}, {"a": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.weighted_targets(df).collect()}
    want = plain_targets(sizes)
    assert set(got) == set(want) and all(abs(got[n] - want[n]) < 1e-6 for n in want)


def brute_cost(capacity, members, quota, most):
    """Most words routed, then least cost, over all whole routings."""
    arcs = [(i, j) for i, m in enumerate(members) for j in m]
    best = None
    for words in product(*(range(min(most * capacity[i], quota[j]) + 1) for i, j in arcs)):
        load, got = [0] * len(capacity), [0] * len(quota)
        for (i, j), w in zip(arcs, words):
            load[i] += w
            got[j] += w
        if any(x > most * c for x, c in zip(load, capacity)) or any(g > q for g, q in zip(got, quota)):
            continue
        cost = sum((2 * r + 1) * min(max(x - r * c, 0), c) for x, c in zip(load, capacity) for r in range(most))
        best = min(best or (1, 0), (-sum(words), cost))
    return best


@pytest.mark.parametrize("capacity,members,quota", [([2, 1, 2], [[0], [0, 1], [1]], [3, 4]), ([3, 2], [[0, 1], [1]], [2, 6]), ([1, 1, 1], [[0, 1], [1, 2], [0]], [2, 2, 3]),
                                                    ([2], [[0]], [9]), ([0, 2], [[0], [0]], [3])])
def test_flow_is_cheapest(capacity, members, quota):
    got = mixing.min_cost_routes(capacity, members, quota, 3)
    load = [sum(w for (i, _), w in got.items() if i == p) for p in range(len(capacity))]
    cost = sum((2 * r + 1) * min(max(x - r * c, 0), c) for x, c in zip(load, capacity) for r in range(3))
    assert (-sum(got.values()), cost) == brute_cost(capacity, members, quota, 3)
    assert all(sum(w for (_, j), w in got.items() if j == s) <= q for s, q in enumerate(quota))


def test_overlapping_sources(spark):
    rng = np.random.default_rng(2)
    kinds = [["a"], ["a", "b"], ["b"], ["c"], ["c", "d"], [], None]
    rows = [(i, kinds[i % len(kinds)], int(rng.integers(0, 30)), int(rng.integers(-2**62, 2**62)), "x") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, members array<string>, size long, hash long, pos string").select("doc_id", "members", "size", "hash")
    targets = spark.createDataFrame([("a", 900.0), ("b", 7000.5), ("c", 3000.0), ("d", 50.0), ("e", 10.0)], "key string, target double")
    got = mixing.mix(docs, targets).collect()
    again = mixing.mix(docs.repartition(3), targets).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == 900
    assert all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in got)
    assert not any(r["taken"] for r in got if not r["members"])
    assert abs(sum(r["taken"] for r in got if set(r["members"]) & {"a", "b"}) - 7900) <= 60
    assert abs(sum(r["taken"] for r in got if set(r["members"]) & {"c", "d"}) - 3050) <= 60


def test_hot_source_is_dealt_by_slices(spark):
    rng = np.random.default_rng(5)
    rows = [(i, ["hot"] if i % 10 else ["b"], int(rng.integers(1, 40)), int(rng.integers(-2**62, 2**62))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, members array<string>, size long, hash long")
    targets = spark.createDataFrame([("hot", 20_000.0), ("b", 5000.0)], "key string, target double")
    sent, joined = mixing.mix(docs, targets).collect(), mixing.mix(docs, targets, most_sent=0).collect()
    assert sorted(map(str, sent)) == sorted(map(str, joined))
    taken = {k: sum(r["taken"] for r in sent if r["members"] == [k]) for k in ("hot", "b")}
    assert 0.998 * 20_000 - 2 <= taken["hot"] <= 20_000 and 0.998 * 5000 - 2 <= taken["b"] <= 5000
    free = docs.selectExpr("members", "cast(pmod(hash, 4096) as int) as bucket", "1 as pos", "hash", "size", "0 as copies")
    gaps = targets.withColumn("gap", F.floor("target"))
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = mixing.fillers(free, gaps, False)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    windows = plan.rindex("Window [row_number()")  # the first of the two, nearest to the scan
    assert re.search(r"hashpartitioning\(key#\d+, slice#\d+", plan[windows:]) and not re.search(r"hashpartitioning\(key#\d+, \d+\)", plan[windows:])


def sizes_of(rows):
    return {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}


def test_odd_rows_and_documents(spark):
    rows = [(i, f"w{i} " * (1 + i % 40), f"s{i % 5}") for i in range(300)]
    rows += [(1000, None, "s1"), (1001, "", "s1"), (1002, " \n", None), (1003, "x y z", None), (1003, "x y z", None), (None, "null id here", "s2"), (1004, "z" * 50_000, "s3"),
             (1005, "w " * 2000, "s4")]
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, source string, size string").drop("size").withColumn("copies", F.lit("e"))
    mixed, targets = mixing.mix_by_source(docs.select("doc_id", "text", "source"))
    got = mixed.collect()
    assert len(got) == len(rows)
    want = {mixing_key(s): t for s, t in plain_targets({s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, x in rows if x == s) for _, _, s in rows}).items()}
    for k, t in want.items():
        taken = sum(r["taken"] for r in got if r["members"] == [k])
        assert t * 0.998 - 2 <= taken <= t
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in out.collect())
    assert words == sum(r["taken"] for r in got)
    assert mixing.mixed_documents(docs.filter("false")).count() == 0 and mixing.mix_by_source(docs.filter("false"))[0].count() == 0


def mixing_key(s):
    return "n" if s is None else "m" + s


def test_query(spark):
    from shelfspark.llm.registered import QUERIES
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    size = sizes_of(docs)
    per = {}
    for i, _, s in docs:
        per[s] = per.get(s, 0) + size[i]
    want = plain_targets(per)
    source = {i: s for i, _, s in docs}
    got = QUERIES["op3_mixing"](spark, sf).collect()
    assert len(got) == len(docs)
    taken = {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == per[s] and abs(r["target"] - want[s]) < 1e-6
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    for s in want:
        assert want[s] * 0.99 - 5 <= taken[s] <= want[s]
