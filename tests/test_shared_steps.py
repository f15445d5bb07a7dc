"""What moves, and in how many tasks, in the steps that searches and bundles share."""

from pyspark.sql import functions as F


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_items_do_not_move_to_one_tile_of_queries(spark):
    """Every item vector was shuffled to the queries, however few these were."""
    from shelfspark.operators.retrieval import vector_topk

    items = spark.createDataFrame([(f"P{i:03}", [float(i % 7), float(i % 5), 1.0]) for i in range(200)], "item_id string, vec array<double>").repartition(3)
    asks = spark.createDataFrame([(f"Q{q}", [1.0, float(q), 0.5]) for q in range(4)], "query_id string, vec array<double>")
    out = vector_topk(asks, items, 9)
    assert "FlatMapGroupsInPandas" not in plan(out) and "MapInPandas" in plan(out)
    tiled = vector_topk(asks, items, 9, tile_queries=2, tile_items=31)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, tiled.collect()))
    assert vector_topk(asks.filter("query_id = ''"), items, 9).count() == 0
    assert vector_topk(asks, items.filter("item_id = ''"), 9).count() == 0


def test_only_repeated_keys_move(spark):
    """One repeated id sent the tokens of all texts through a shuffle."""
    from shelfspark.operators.dedup import split_repeated

    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "z"), (None, "y"), (2, "c")], "item_id int, search_text string")
    single, repeated = split_repeated(rows, ["item_id"])
    assert "Exchange hashpartitioning" not in plan(single)
    assert [r["item_id"] for r in single.collect()] == [2]
    assert sorted(r["search_text"] for r in repeated.collect()) == ["a", "b", "y", "z"]
    assert split_repeated(rows.filter("item_id = 2"), ["item_id"])[1] is None


def test_an_index_with_repeated_ids(spark):
    from shelfspark.operators.retrieval import keyword_index

    texts = spark.createDataFrame([(1, "a b"), (1, "b b"), (2, "a"), (3, "")], "item_id int, search_text string")
    index = keyword_index(texts)
    assert sorted((r["item_id"], r["token"], r["tf"], r["doc_len"]) for r in index.postings.collect()) == [(1, "a", 1, 2), (1, "b", 3, 2), (2, "a", 1, 1)]
    assert sorted(map(tuple, index.documents.collect())) == [(1, 2), (1, 2), (2, 1), (3, 0)]


def test_combinations_unfold_in_more_than_one_task(spark):
    """A few pools were grouped in one task, which then made all combinations."""
    from shelfspark.operators.bundles import bundle_combos

    none = F.array().cast("array<string>")
    slots = F.explode(F.array(F.lit("top"), F.lit("bottom"), F.lit("footwear"))).alias("pool_slot")
    pools = spark.range(12).select(F.concat(F.lit("Q"), "id").alias("query_id"), F.lit(50).alias("level"), slots).select(
        "*", F.concat("query_id", "pool_slot").alias("item_id"), F.col("pool_slot").alias("title"), F.lit("s").alias("store"), F.lit(3.0).alias("price"),
        F.col("pool_slot").alias("slot"), F.lit("women").alias("gender"), F.lit("adult").alias("age_group"), F.lit(0.5).alias("score"), F.lit(0.5).alias("sim"),
        none.alias("colors"), none.alias("seasons"), none.alias("occasions"), F.lit(1).alias("pool_rank"), F.lit(None).cast("double").alias("q_max_price"))
    vectors = pools.select("item_id", F.array(F.lit(1.0)).alias("vec"))
    combos = bundle_combos(pools, vectors).filter("template_rank = 1").withColumn("task", F.spark_partition_id())
    rows = combos.select("query_id", "n_items", "task").collect()
    assert sorted((r["query_id"], r["n_items"]) for r in rows) == sorted((f"Q{i}", n) for i in range(12) for n in (2, 3))
    assert len({r["task"] for r in rows}) > 1


def test_only_found_items_move_to_their_candidates(spark):
    """Every item of the catalog was shuffled with its texts to the few that the lists name."""
    from shelfspark.operators.dedup import dealt
    from shelfspark.plans.registered.ranking import found_items

    items = spark.range(3000).select(F.concat(F.lit("P"), "id").alias("item_id"), F.concat(F.lit("text "), "id").alias("search_text"))
    found = spark.createDataFrame([("Q1", "P7"), ("Q2", "P7"), ("Q2", "P2999"), ("Q2", "gone")], "query_id string, item_id string")
    near = found_items(items, found)
    assert near.columns == items.columns
    assert {r["item_id"] for r in near.collect()} >= {"P7", "P2999"} and near.count() < 10
    assert "Exchange hashpartitioning(item_id" not in plan(near)
    joined = dealt(found, "item_id").join(near, "item_id")
    assert sorted((r["query_id"], r["item_id"], r["search_text"]) for r in joined.collect()) == [("Q1", "P7", "text 7"), ("Q2", "P2999", "text 2999"), ("Q2", "P7", "text 7")]


def test_intermediate_tables_are_packed(spark):
    import glob

    from shelfspark.session import materialize, scratch_path

    rows = materialize(spark.range(10), "packed_rows")
    assert rows.count() == 10
    names = glob.glob(scratch_path(spark, "packed_rows").removeprefix("file:").rsplit("/", 1)[0] + "/packed_rows-*/part-*")
    assert names and all(n.endswith(".zstd.parquet") for n in names)


def test_a_rows_askers_lie_side_by_side(spark):
    """Where the askers were streamed, every written row had other values than the one before it."""
    from shelfspark.operators.dedup import for_all_askers

    rows = spark.range(40).select(F.lit("Q1").alias("query_id"), F.concat(F.lit("P"), "id").alias("item_id")).union(spark.createDataFrame([("Q2", "P1")]))
    askers = spark.range(1000).select(F.lit("Q1").alias("asker"), F.concat(F.lit("Q"), "id").alias("query_id")).union(spark.createDataFrame([("Q2", "Q2"), ("Q2", None)], "asker string, query_id string"))
    for small in (F.broadcast(rows), rows):
        got = [tuple(r) for r in for_all_askers(small, askers).collect()]
        assert sorted(got, key=str) == sorted([(f"Q{i}", f"P{j}") for i in range(1000) for j in range(40)] + [("Q2", "P1"), (None, "P1")], key=str)
        assert sum(a[1] != b[1] for a, b in zip(got, got[1:])) < 1000
