"""Queries of the same text are searched once and all answered."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_same_text_and_all_askers(spark):
    from shelfspark.operators.dedup import for_all_askers, same_text

    log = spark.createDataFrame([("b", "hat"), ("a", "hat"), ("c", None), ("d", None), ("e", "")], "query_id string, query string")
    askers = same_text(log)
    assert {tuple(r) for r in askers.collect()} == {("a", "a"), ("a", "b"), ("c", "c"), ("c", "d"), ("e", "e")}
    found = spark.createDataFrame([(1, "a"), (2, "a"), (3, "e")], "item_id int, query_id string")
    out = for_all_askers(found, askers)
    assert out.columns == ["item_id", "query_id"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "e")]


def test_a_text_is_searched_once(spark):
    """Frames of candidates grew with the log: 100 queries of 37 texts had the pools of 100."""
    from shelfspark.plans.registered.ranking import cands_frame
    from shelfspark.sources import tables as T

    log = T.queries(spark, SF)
    texts = log.select("query").distinct().count()
    frame = cands_frame(spark, SF)
    assert texts < log.count()
    assert frame.select("query_id").distinct().count() <= texts
    everyone = T.answered(spark, SF, frame.select("query_id", "item_id"))
    per = everyone.join(log, "query_id").groupBy("query", "query_id").agg(F.count(F.lit(1)).alias("n"))
    assert per.select("query", "n").distinct().count() == per.select("query").distinct().count()
    assert per.count() == log.count()
