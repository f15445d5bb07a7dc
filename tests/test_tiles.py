"""Tiles of queries and items: every pair is scored, none of them becomes a row."""

import numpy as np
import pytest

from shelfspark.operators import retrieval as V
from shelfspark.operators import tiles


def best(scores, k, least=-np.inf):
    scores = np.round(scores, 6)
    first = [np.lexsort((np.arange(scores.shape[1]), -row))[:k] for row in scores]
    return {(q, int(i), float(scores[q, i])) for q, row in enumerate(first) for i in row if scores[q, i] > least}


def rows(found):
    return {(int(q), int(i), float(s)) for q, i, s in zip(*found)}


@pytest.mark.parametrize("queries,items,k,dim", [(30, 90, 7, 8), (600, 2100, 10, 65), (3, 3000, 1000, 16), (4, 20, 300, 4), (700, 2500, 10, 2)])
def test_nearest_with_equal_vectors_and_scores(queries, items, k, dim):
    rng = np.random.default_rng(dim)
    vectors, asking = np.round(rng.normal(size=(items, dim)), 1), np.round(rng.normal(size=(queries, dim)), 1)
    vectors[items // 2:] = vectors[rng.integers(0, items // 2, items - items // 2)]
    asking[0] = 0.0  # all items are equally near
    assert rows(tiles.nearest(asking, vectors, k)) == best(np.array([(q * vectors).sum(axis=1) for q in asking]), k)


@pytest.mark.parametrize("queries,items,k,words,least", [(30, 90, 7, 20, 0.0), (600, 2100, 10, 300, 0.0), (600, 2100, 10, 40, 0.0), (50, 2100, 10, 9000, 0.0), (5, 2100, 2500, 30, 0.0), (50, 2100, 10, 30, -0.5)])
def test_heaviest_of_common_and_rare_tokens(queries, items, k, words, least):
    rng = np.random.default_rng(words)

    def lists(n, length, low):
        return np.repeat(np.arange(n), length), (rng.random(n * length) ** 3 * words).astype(int), np.round(rng.random(n * length) * 3 + low, 2)
    asking, documents = lists(queries, 6, least), lists(items, 20, 0.0)
    w, g = np.zeros((queries, words)), np.zeros((items, words))
    np.add.at(w, asking[:2], asking[2])
    np.add.at(g, documents[:2], documents[2])
    got = rows(tiles.heaviest((asking[0], asking[1] * 7 + 3, asking[2]), (documents[0], documents[1] * 7 + 3, documents[2]), queries, items, k))
    assert {r[:2] for r in got} == {r[:2] for r in best(w @ g.T, k, 0.0)}


def test_many_queries_that_meet_most_documents_make_no_rows(spark, monkeypatch):
    """Each title of a catalog as a query: the join by tokens had nearly as many rows as there are pairs (27 million in one task of sf0.1, and not at its end)."""
    n = V.TILE_QUERIES + 90
    text = [f"blue {'linen' if i % 2 else 'wool'} dress word{i % 7} number{i}" + " dress" * (i % 3) for i in range(n)] + ["", "unheard"]
    items = spark.createDataFrame([(f"P{i:04}", t) for i, t in enumerate(text)], "item_id string, search_text string")
    asks = spark.createDataFrame([(f"P{i:04}", t if i < n else "the of") for i, t in enumerate(text)], "query_id string, query string")
    index = V.keyword_index(items, keep=lambda df, name: df.cache())
    tokens = V.query_tokens(asks)
    skip = V.noise_guard(asks, tokens, index.frequencies).filter("skip_keyword").select("query_id")
    want = V.top_per_query(V.bm25_scores(tokens.join(skip, "query_id", "left_anti"), index, V.token_stats(index)), 4).collect()

    def refuse(*_):
        raise AssertionError("joined by tokens")
    monkeypatch.setattr(V, "bm25_scores", refuse)
    monkeypatch.setattr(V, "pruned_scores", refuse)
    got = V.bm25_topk(asks, index, 4).collect()
    assert sorted((r.query_id, r["rank"], r.item_id, r.score) for r in got) == sorted((r.query_id, r["rank"], r.item_id, r.score) for r in want) and len(got) == 4 * n
