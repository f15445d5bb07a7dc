import numpy as np
import pyarrow.dataset as ds
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import forest

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, asks, k):
    """Per query id the k best (vec_id, score) by inner product; rows: distinct (id, vector) of one length."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for q, v in rows:
        if asks(q):
            score = (x * np.array(v, float)).sum(axis=1)
            order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
            out[q] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def lists(df):
    out = {}
    for r in sorted(df.collect()):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / max(1, len(want[q])) for q in want])


def vectors(spark, rows, parts=5):
    return spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize("shard,tile,fan", [(8192, 1024, 64), (40, 7, 2)])
def test_everything_gathered_is_exact(spark, shard, tile, fan):
    rng = np.random.default_rng(2)
    rows = [(i, np.float32(rng.integers(-2, 3, 6) * (1 + i % 4))) for i in range(300)]
    rows = [(i, v) for i, v in rows if v.any()]
    got = lists(forest.nearest(vectors(spark, rows), F.col("vec_id") % 7 == 0, 9, trees=3, share=1.0, shard_rows=shard, tile_rows=tile, fan_in=fan))
    assert got == brute(rows, lambda i: i % 7 == 0, 9)


def test_scores_are_exact_and_recall_holds_on_clusters_at_a_small_share(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(40, 32))
    rows = [(i, np.float32((centers[i % 40] + 0.35 * rng.normal(size=32)) * rng.uniform(0.9, 1.1))) for i in range(4000)]
    want = brute(rows, lambda i: i % 50 == 0, 10)
    got = lists(forest.nearest(vectors(spark, rows), F.col("vec_id") % 50 == 0, 10, trees=32, share=0.1, shard_rows=1500))
    x = dict(rows)
    assert all(s == (x[i].astype(float) * x[q].astype(float)).sum() for q in got for i, s in got[q])
    assert recall(got, want) >= 0.9


def test_a_third_of_the_rows_is_one_vector(spark):
    rng = np.random.default_rng(6)
    hot = np.float32(rng.normal(size=16))
    rows = [(i, hot if i % 3 == 0 else np.float32(rng.normal(size=16))) for i in range(900)]
    got = lists(forest.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, 20, shard_rows=300))
    want = brute(rows, lambda i: i % 20 == 0, 20)
    assert recall(got, want) >= 0.9
    assert all(got[q] == want[q] for q in want if q % 3 == 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (0, [0.5, -0.25]), (1, [0.1, 0.2]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 0.0]), (None, [1.0, 1.0]),
            (6, [1.0, 1.0, 1.0]), (7, []), (8, [0.0, 0.0]), (10, [1e30, 0.0]), (12, [0.1, 0.2])]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], SCHEMA + ", rank int, version int")
    got = lists(forest.nearest(df, F.col("vec_id") % 2 == 0, 20))
    f = lambda a, b: sum(float(np.float32(p)) * float(np.float32(q)) for p, q in zip(a, b))
    x = {0: rows[0][1], 1: [0.1, 0.2], 10: [1e30, 0.0], 12: [0.1, 0.2]}
    assert got == {q: sorted(((i, f(x[q], x[i])) for i in x if i != q), key=lambda r: (-r[1], r[0])) for q in (0, 10, 12)}
    assert forest.nearest(df.filter("false"), F.lit(True)).count() == 0


def test_longest_prefixes_come_first_and_trees_ascend_together():
    strings = np.array([[0b0001, 0b0100, 0b0101, 0b1100], [0b0010, 0b0011, 0b1000, 0b1010]], np.uint64)
    order = np.array([[0, 1, 2, 3], [3, 2, 1, 0]], np.int32)
    asked = np.array([[0b0101], [0b1011]], np.uint64)
    assert [forest.gathered(strings, order, asked, 4, n)[0].tolist() for n in (1, 2, 3, 4)] == [[2], [0, 1, 2], [0, 1, 2], [0, 1, 2, 3]]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_recall_on_whole_table(spark, sf):
    from shelfspark.llm.registered import QUERIES
    data = ds.dataset(f"/root/testdata/{sf}/embeddings.parquet").to_table(columns=["vec_id", "embedding"]).to_pydict()
    want = brute(list(zip(data["vec_id"], data["embedding"])), lambda i: i % 20 == 0, 20)
    got = lists(QUERIES["op13_nearest_neighbours"](spark, f"/root/testdata/{sf}"))
    found = recall(got, want)
    print(sf, found)
    assert got.keys() == want.keys() and found >= 0.9
