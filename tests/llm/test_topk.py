import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import topk


def plain(rows, queries, k):
    out = []
    for q in queries:
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(rows[q], rows[c])), c) for c in rows if c != q and len(rows[c]) == len(rows[q]))
        out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("items,queries,fan", [(8192, 2048, 16), (16, 4, 2), (64, 8, 3)])
def test_equals_brute_force_with_ties(spark, items, queries, fan):
    rng = np.random.default_rng(1)
    rows = {int(i): [float(v) for v in rng.integers(-2, 3, 4)] for i in range(300)}
    df = spark.createDataFrame([(i, v) for i, v in rows.items()], "vec_id long, embedding array<double>").repartition(5)
    got = topk.exact_topk(df, F.col("vec_id") % 7 == 0, 5, item_rows=items, query_rows=queries, fan_in=fan)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, [i for i in rows if i % 7 == 0], 5)


def test_large_whole_numbers_stay_exact():
    a, b = np.array([[2.0 ** 31 + 1, 3.0]]), np.array([[2.0 ** 31 - 1, 5.0], [1.0, 1.0]])
    assert topk.exact_scores(a, b).tolist() == [[(2 ** 31 + 1) * (2 ** 31 - 1) + 15, 2 ** 31 + 4]]
    assert topk.exact_scores(np.array([[2.0 ** 60]]), np.array([[2.0 ** 60], [-2.0 ** 60]])).tolist() == [[2 ** 63 - 1, -2 ** 63]]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (0, [0.5, -0.25]), (1, [0.1, 0.2]), (2, None), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 0.0]), (None, [1.0, 1.0]), (6, [1.0, 1.0, 1.0]), (7, [])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = topk.exact_topk(df, F.col("vec_id") % 2 == 0, 5, scale=256.0).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 1, 128 * 25 + -64 * 51)]
    assert topk.exact_topk(df.filter("false"), F.lit(True)).count() == 0


def test_query_equals_sql(spark):
    from oracle_check import compare, connect
    from shelfspark.llm.registered import ORACLES, QUERIES
    sf = "/root/testdata/sf0.01"
    assert compare(QUERIES["op10_exact_topk"](spark, sf), connect(sf), ORACLES["op10_exact_topk"]) == ""
