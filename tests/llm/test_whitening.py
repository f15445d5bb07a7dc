from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from shelfspark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, scale=64.0, most=16, weights="one", offset=1_000_000):
    """(n, {(vec_id, x): deviation}, eigenvalues, trace, centred matrix per distinct x) of vectors of one length."""
    x = [tuple(int(np.floor(scale * float(c))) + offset for c in v) for _, v in rows]
    weight = {v: x.count(v) if weights == "counts" else 1 for v in x}
    n, dims = sum(weight.values()), len(x[0])
    sums = [sum(v[j] * w for v, w in weight.items()) for j in range(dims)]
    deviation = {v: sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in weight}
    centred = {v: [float(Fraction(n * a - s, n)) for a, s in zip(v, sums)] for v in weight}
    z, w = np.array(list(centred.values())), np.array([weight[v] for v in centred], float)
    cov = (z * w[:, None]).T @ z / n
    values, vectors = np.linalg.eigh(cov)
    return n, x, deviation, values[::-1][:most], vectors[:, ::-1][:, :most], np.trace(cov), centred


def check(got, rows, **how):
    n, x, deviation, values, vectors, trace, centred = plain(rows, **how)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert set(by) == {i for i, _ in rows}
    signs = None
    for (vec_id, _), key in zip(rows, x):
        own = sorted(by[vec_id], key=lambda r: r.component)[:len(values)]
        assert [r.component for r in own] == list(range(1, len(values) + 1))
        assert all(r.n == n and r.deviation == deviation[key] and r.identity_error <= 1e-4 for r in own)
        want = np.array(centred[key]) @ vectors / np.sqrt(values)
        have = np.array([r.whitened for r in own])
        if signs is None and (abs(want) > 1e-3).all():
            signs = np.sign(want * have)
        assert np.allclose(abs(want), abs(have), atol=1e-7)
        assert signs is None or np.allclose(want * signs, have, atol=1e-7)
        assert np.allclose([r.explained for r in own], values / trace, rtol=1e-6)


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_equals_plain_fit_with_copies(spark, weights):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 5)) * [9, 4, 2, 1, 0.5]
    rows = [(i, [float(np.float32(c)) for c in base[i % 60 if i % 3 else 7]]) for i in range(200)]  # a third is one vector
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = whitening.whiten(df, weights=weights).collect()
    assert len(got) == 200 * 5
    check(got, rows, weights=weights)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (2, [0.25, -1.0]), (3, [1.5, 0.0]), (4, None), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [inf, 0.0]),
            (None, [2.0, 2.0]), (8, []), (9, [0.0, 0.0]), (10, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], SCHEMA + ", x int, copies int")
    got = whitening.whiten(df).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got if r.vec_id != 10) == sorted([(i, c) for i in (0, 1, 1, 2, 3, 9) for c in (1, 2)])
    assert {r.n for r in got if r.vec_id != 10} == {5}
    alone = [r for r in got if r.vec_id == 10]  # one distinct vector of its length: no variance
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(1, 0, 0.0, 0.0, 0.0)] * 3
    assert whitening.whiten(df.filter("false")).count() == 0


def test_fewer_varying_dimensions_than_components(spark):
    rows = [(i, [float(i), 2.0 * i, 3.0]) for i in range(50)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 150 and max(r.identity_error for r in got) < 1e-9
    assert all(r.whitened == 0 and r.explained == 0 for r in got if r.component > 1)


def test_huge_values_stay_exact(spark):
    rows = [(0, [1e30, 1.0]), (1, [-1e30, 2.0]), (2, [0.0, 4.0])]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.deviation is None for r in got if r.vec_id < 2)
    assert {r.deviation for r in got if r.vec_id == 2} == {(3 * 256 - 448) ** 2}


def test_query_equals_plain_fit_on_whole_table(spark):
    from shelfspark.llm.registered import QUERIES
    sf = "/root/testdata/sf0.01"
    data = pq.read_table(f"{sf}/embeddings.parquet", columns=["vec_id", "embedding"]).to_pydict()
    got = QUERIES["op12_embedding_whitening"](spark, sf).collect()
    assert len(got) == 16 * len(data["vec_id"])
    check(got, list(zip(data["vec_id"], data["embedding"])))
