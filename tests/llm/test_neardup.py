import numpy as np
import pytest

from shelfspark.llm import neardup


def brute(ids, rows, threshold=0.95):
    x = np.array(rows, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            low = min([label[i], *(label[j] for j in np.flatnonzero(near[i]))])
            if low != label[i]:
                label[i], changed = low, True
    return {i: (int(n), c) for i, n, c in zip(ids, near.sum(axis=1), label)}


@pytest.mark.parametrize("cells,block", [(None, 4096), (6, 16), (1, 16), (12, 64)])
def test_equals_brute_force(spark, cells, block):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(150, 8))
    rows = np.concatenate([rows, rows[:60] + rng.normal(size=(60, 8)) * 0.2, rows[:5].repeat(8, axis=0) + rng.normal(size=(40, 8)) * 0.15,
                           rows[:1].repeat(30, axis=0), rows[3:4] * 2]).astype(np.float32)
    ids = [int(i) for i in rng.permutation(len(rows)) + 100]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, rows)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(df, cells=cells, block=block).collect()}
    assert got == brute(ids, rows)


def test_odd_rows(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 3), (2, [2.0, 0.0], 3), (2, [2.0, 0.0], 4), (3, None, 3), (4, [], 3), (5, [0.0, 0.0], 3), (6, [nan, 1.0], 3), (7, [None, 1.0], 3),
            (8, [float("inf"), 1.0], 3), (9, [1.0, 0.0, 0.0], 3), (None, [1.0, 0.0], 3), (10, [1e38, 0.0], 3), (11, [1e-40, 0.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()), key=str)
    want = [(1, 3, 1, True), (2, 3, 1, False), (10, 3, 1, False), (11, 3, 1, False)] + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)] + [(None, 0, None, True)]
    assert got == sorted(want, key=str)
    assert neardup.near_duplicates(df.filter("false")).count() == 0


def test_query_equals_sql(spark):
    from oracle_check import compare, connect
    from shelfspark.llm.registered import ORACLES, QUERIES
    sf = "/root/testdata/sf0.01"
    assert compare(QUERIES["op1_embedding_neardup"](spark, sf), connect(sf), ORACLES["op1_embedding_neardup"]) == ""


def compared(reps, threshold=0.95):
    """Cells, and pairs that meet as a share of all pairs."""
    rows = neardup.in_cells(reps, threshold).select("home", "others").collect()
    at_home, visitors = np.bincount([r["home"] for r in rows]), np.bincount([c for r in rows for c in r["others"]] or [0])
    visitors = np.pad(visitors, (0, max(0, len(at_home) - len(visitors))))[:len(at_home)]
    return int((at_home > 0).sum()), float((at_home * (at_home / 2 + visitors)).sum() / (len(rows) ** 2 / 2))


def test_thousands_of_vectors_use_cells(spark):
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(40, 32))
    clustered = (middles[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 32)) * 0.25).astype(np.float32)
    even = rng.normal(size=(3000, 32)).astype(np.float32)
    copies = np.concatenate([even[:2000], even[:1] + rng.normal(size=(1000, 32)) * 0.1]).astype(np.float32)  # a third is one clump
    for rows, most in ((clustered, 0.15), (even, 0.6), (copies, 0.8)):
        df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<float>")
        cells, share = compared(df.selectExpr("embedding", "vec_id as rep", "1L as copies", "size(embedding) as dim"))
        assert cells > 10 and share < most, (cells, share)
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(df, block=256).collect()}
        assert got == brute(range(len(rows)), rows)
