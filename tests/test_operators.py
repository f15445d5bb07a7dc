"""Operators against hand-computed values and brute force; stores, files and streams end to end."""

import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from shelfspark.operators import dedup, encoders, joins, quantiles, sampling
from shelfspark.operators import retrieval as V
from shelfspark.operators.evolution import upsert_catalog
from shelfspark.plans import reports
from shelfspark.sources import catalog as C
from shelfspark.streaming import ingest, metrics, repeats

ROOT = Path(__file__).resolve().parents[1]


def test_rrf_by_hand(spark):
    rows = [("q", "a", "A", 1), ("q", "a", "B", 2), ("q", "a", "C", 3), ("q", "b", "B", 1), ("q", "b", "D", 2), ("q", "b", "A", 3), ("t", "a", "B", 1), ("t", "b", "A", 1)]
    df = spark.createDataFrame(rows, "query_id string, source string, item_id string, rank int")
    got = [(r.query_id, r.item_id) for r in V.rrf(df).orderBy("query_id", "rank").collect()]
    assert got == [("q", "B"), ("q", "A"), ("q", "D"), ("q", "C"), ("t", "A"), ("t", "B")]
    assert V.rrf(df.limit(0)).collect() == []


def test_levels_equal_rerunning_at_each_depth(spark):
    rng = random.Random(7)
    rows = [("q", s, i, r) for s in "ab" for r, i in enumerate(rng.sample(range(30), 20), 1)]
    df = spark.createDataFrame(rows, "query_id string, source string, item_id int, rank int")
    for level in (5, 10, 20):
        deep = {r.item_id: r.fused for r in V.fuse_levels(df, [5, 10, 20]).filter(F.col("level") == level).collect()}
        flat = {r.item_id: r.fused for r in V.rrf(df.filter(F.col("rank") <= level)).collect()}
        assert deep == flat


def test_vector_tiles_agree(spark):
    rng = np.random.default_rng(3)
    vec = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)]
    items = spark.createDataFrame(vec, "item_id int, vec array<float>")
    q = items.limit(9).select(F.col("item_id").alias("query_id"), "vec")
    a = V.vector_topk(q, items, 5)
    b = V.vector_topk(q, items, 5, tile_queries=2, tile_items=7)
    key = ["query_id", "rank"]
    assert a.orderBy(*key).collect() == b.orderBy(*key).collect() and a.count() == 45


def test_bm25_reads_the_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"the red shoe {w} number{i % 5}") for i, w in enumerate(["alpha", "beta", "gamma", "delta"] * 10)] + [(99, "")], "item_id int, search_text string")
    docs.write.parquet(str(tmp_path / "docs"))
    q = spark.createDataFrame([(1, "red alpha shoe"), (2, "number3 beta"), (3, "unheard words")], "query_id int, query string")

    def keep(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))
    index = V.keyword_index(spark.read.parquet(str(tmp_path / "docs")), keep=keep)
    assert index.stats().first().n_docs == 41
    idf, tok = V.token_stats(index), V.query_tokens(q)
    a = V.bm25_scores(tok, index, idf).orderBy("query_id", "item_id").collect()
    assert {r.item_id for r in a if r.query_id == 2} == {i for i in range(40) if i % 4 == 1 or i % 5 == 3}
    assert V.noise_guard(q, tok, idf).filter("skip_keyword").first().query_id == 3
    read = {Path(f).parent.name for f in V.bm25_topk(q, index, 5).inputFiles()}
    assert "postings" in read and "docs" not in read


def test_deleted_items_take_no_place(spark):
    vec = lambda x: [1.0, x]
    items = spark.createDataFrame([(str(i), f"red shoe {i}", i == 9) for i in range(10)], "item_id string, search_text string, is_deleted boolean")
    vectors = spark.createDataFrame([(str(i), vec(i / 10)) for i in range(10)], "item_id string, vec array<double>")
    q = spark.createDataFrame([("q", "red shoe", None)], "query_id string, query string, normalized string")
    qv = spark.createDataFrame([("q", "raw", vec(1.0))], "query_id string, variant string, vec array<double>")
    got = V.hybrid_candidates(q, items, [1, 3], vectors=vectors, query_vectors=qv)
    shallow = {r.item_id for r in got.filter("level = 1").collect()}
    assert "8" in shallow and "9" not in {r.item_id for r in got.collect()}
    alive = V.hybrid_candidates(q, items.withColumn("is_deleted", F.lit(None).cast("boolean")), [1], vectors=vectors, query_vectors=qv)
    assert "9" in {r.item_id for r in alive.collect()}


def test_package_reaches_workers_from_another_folder(tmp_path):
    import os
    import subprocess
    import sys

    code = (f"import sys; sys.path.insert(0, {str(ROOT)!r})\n"
            "from shelfspark.session import build_session\n"
            "from shelfspark.operators import retrieval as V\n"
            "s = build_session('away', 'local[1]', **{'spark.ui.enabled': 'false', 'spark.sql.shuffle.partitions': '1'})\n"
            "v = s.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], 'item_id int, vec array<double>')\n"
            "print('rows', V.vector_topk(v.withColumnRenamed('item_id', 'query_id'), v, 1).count())\n")
    env = {k: x for k, x in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows 2" in out.stdout, out.stderr[-2000:]


def test_percentiles_with_a_hot_group(spark):
    rng = random.Random(1)
    rows = [("hot", round(rng.gauss(50, 20), 3)) for _ in range(4000)] + [("flat", 7.0)] * 500 + [("one", 3.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in quantiles.exact_percentiles(df, ["g"], "v", {"p5": 0.05, "p50": 0.5, "p99": 0.99}).collect()}
    for g in ("hot", "flat", "one"):
        vals = [v for k, v in rows if k == g]
        for name, p in (("p5", 5), ("p50", 50), ("p99", 99)):
            assert abs(got[g][name] - np.percentile(vals, p)) < 1e-9
    assert quantiles.exact_percentiles(df.limit(0), ["g"], "v", {"p50": 0.5}).collect() == []
    odd = spark.createDataFrame([(None, 1.0), (None, 4.0), (None, None), ("x", None), ("y", 7.0), ("y", 7.0)], "part string, n double")
    assert {(r.part, r["count"], r.lo, r.mid, r.hi) for r in quantiles.exact_percentiles(odd, ["part"], "n", {"lo": 0.0, "mid": 0.5, "hi": 1.0}).withColumnRenamed("n", "count").collect()} \
        == {(None, 2, 1.0, 2.5, 4.0), ("y", 2, 7.0, 7.0, 7.0)}
    whole = quantiles.exact_percentiles(odd, [], "n", {"mid": 0.5}).first()
    assert (whole.n, whole.mid) == (4, 5.5)
    plan = quantiles.exact_percentiles(df, ["g"], "v", {"p50": 0.5, "p99": 0.99})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 5 and "NestedLoop" not in plan and "Cartesian" not in plan


def test_overlap_counts(spark):
    rng = random.Random(2)
    rel = [(i, round(rng.random(), 2)) for i in range(80)]
    irr = [(i, round(rng.random(), 2)) for i in range(300)]
    a, b = (spark.createDataFrame(x, "id int, score double") for x in (rel, irr))
    got = {r.id: r.n_overlaps for r in joins.overlap_pairs(a, b).collect()}
    assert got == {i: sum(t >= s for _, t in irr) for i, s in rel}
    assert joins.overlap_pairs(a, b.limit(0)).agg(F.sum("n_overlaps")).first()[0] == 0


def test_samples_are_exact_and_stable(spark):
    df = spark.range(5000).select(F.col("id").alias("item_id"), (F.col("id") % 3).cast("string").alias("slot"))
    for n in (0, 1, 777, 5000, 9000):
        got = sampling.fixed_sample(df, n)
        assert got.count() == min(n, 5000)
    one = {r.item_id for r in sampling.fixed_sample(df, 50).collect()}
    assert one == {r.item_id for r in sampling.fixed_sample(df.repartition(7), 50).collect()}
    assert sampling.holdout_split(df).filter("held_out").count() == 1000
    assert sampling.stratified_sample(df, {"0": 5, "1": 2}).groupBy("slot").count().orderBy("slot").collect() == [("0", 5), ("1", 2)]


def test_flag_first_and_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "seq int, k string")
    got = {r.seq: r.f for r in dedup.flag_first(df, ["k"], ["seq"], ["seq"], flag="f").collect()}
    assert got == {1: True, 2: False, 3: True, 4: True}


RAW = ('{"parent_asin":"A1","title":"Women\'s Summer Floral Dress","price":19.99,"store":"S","description":["Soft","dress"],"features":["x"],'
       '"details":{"Department":"womens"},"images":[{"variant":"MAIN","large":"u1"}]}\n\nnot json\n'
       '{"parent_asin":"A2","title":"Men\'s Running Shoes Black","price":"39.5","description":"Light","average_rating":4.0,"rating_number":10}\n')


def test_read_and_transform_raw_records(spark, tmp_path):
    (tmp_path / "meta.jsonl").write_text(RAW)
    rows = C.read_catalog(spark, str(tmp_path / "meta.jsonl"))
    assert {r.line_state: r.n for r in C.read_counts(rows).collect()} == {"ok": 2, "blank": 1, "invalid_json": 1}
    from shelfspark.operators.triage import transform_catalog

    p = {r.item_id: r for r in transform_catalog(rows.filter("line_state = 'ok'")).collect()}
    assert p["A1"].description == "Soft dress" and p["A1"].gender == "women" and p["A1"].image_url == "u1" and p["A1"].slot == "full_body"
    assert p["A2"].price == 39.5 and p["A2"].description == "Light" and p["A2"].quality_bayes == 4.1
    (tmp_path / "rev.jsonl").write_text('{"parent_asin":"A1","text":"ok","helpful_vote":3}\n{broken\n')
    assert C.read_reviews(spark, str(tmp_path / "rev.jsonl")).count() == 1


def test_files_and_guards(spark, tmp_path):
    grades = spark.createDataFrame([("q", 1, "A", 'say "hi", ok')], "query string, rank int, item_id string, title string")
    path = str(tmp_path / "spot")
    assert C.write_spotcheck_csv(grades, path)
    assert C.read_spotcheck_csv(spark, path).first().title == 'say "hi", ok'
    C.read_spotcheck_csv(spark, path).withColumn("grade", F.lit("relevant")).write.option("header", True).mode("overwrite").csv(str(tmp_path / "graded"))
    assert not C.write_spotcheck_csv(grades, str(tmp_path / "graded")) and C.write_spotcheck_csv(grades, str(tmp_path / "graded"), force=True)
    q = spark.createDataFrame([("A", "rejected", "2024-01-01"), ("A", "quarantined", "2024-01-02"), ("B", "rejected", "2024-01-01")], "item_id string, status string, created_at string")
    C.write_quarantine(q.limit(1), str(tmp_path / "qt"), str(tmp_path / "ql"))
    C.write_quarantine(q.filter("created_at > '2024-01-01' or item_id = 'B'"), str(tmp_path / "qt"), str(tmp_path / "ql"))
    kept = spark.read.parquet(str(tmp_path / "qt"))
    assert {(r.item_id, r.status) for r in kept.collect()} == {("A", "quarantined"), ("B", "rejected")}
    C.write_report({"counts": C.count_quarantine(kept)}, str(tmp_path / "rep"))
    row = spark.read.json(str(tmp_path / "rep")).filter("part = 'counts' and status = 'rejected'").first()
    assert row.n == 1
    C.append_parse_log(spark.createDataFrame([("red hat", "en")], "query string, language string"), str(tmp_path / "log"), "m1")
    assert C.latest_parse_per_query(spark.read.json(str(tmp_path / "log")), "m1").first().query == "red hat"


FEED = "seq bigint, item_id string, title string, price string, store string, average_rating double, rating_number bigint, features array<string>, description string"


def batch(spark, *rows):
    return spark.createDataFrame([(i, a, t, p, None, 4.0, 10, [], None) for i, (a, t, p) in enumerate(rows)], FEED)


def live_store(spark, root, buckets=8):
    """A catalog of one product."""
    from shelfspark.operators.encoders import hash_encoder
    from shelfspark.operators.triage import transform_catalog

    store = ingest.LiveCatalog(spark, root, buckets, lambda rows: hash_encoder(rows.select("item_id", "search_text")))
    start = transform_catalog(batch(spark, ("A0", "Women's Summer Floral Dress", "20"))).select(*ingest.CATALOG_COLUMNS, F.lit(1).cast("bigint").alias("version"))
    now = F.current_timestamp()
    store.create(start.withColumns({"created_at": now, "updated_at": now, "is_deleted": F.lit(False)}))
    return store


def state(store):
    return {t: sorted((tuple(r) for r in store.read(t).drop("created_at", "updated_at").collect()), key=repr) for t in store.tables}


def index_from_scratch(spark, store):
    items = V.live_items(store.read("catalog"))
    post = V.build_postings(items)
    return (sorted(map(tuple, post.collect())), sorted(map(tuple, V.document_lengths(items).collect())),
            sorted(map(tuple, post.groupBy("token").count().collect())))


ROWS = [("A1", "Men's Running Shoes Black", "30"), ("A1", "Men's Running Shoes Black", "31"), ("A0", "Women's Winter Wool Coat", "25"), ("", "Men's Running Shoes Black", "1"),
        ("A2", "Hat", "9")]


def test_ingest_stream_matches_batch_and_replays_are_free(spark, tmp_path):
    store = live_store(spark, str(tmp_path / "b"))
    res = {r.seq: (r.status, r.reason) for r in ingest.ingest_batch(store, batch(spark, *ROWS), 5).collect()}
    assert res == {0: ("created", ""), 1: ("rejected", "duplicate_in_batch"), 2: ("updated", ""), 3: ("rejected", "no_parent_asin"), 4: ("rejected", "short_title")}
    before = state(store)
    assert {r[0]: r[-2] for r in before["catalog"]} == {"A0": 2, "A1": 1}
    again = {r.seq: (r.status, r.reason) for r in ingest.ingest_batch(store, batch(spark, *ROWS), 5).collect()}
    assert again == res and state(store) == before
    index = store.index()
    assert (sorted(map(tuple, index.postings.select("item_id", "doc_len", "token", "tf").collect())), sorted(map(tuple, index.documents.collect())),
            sorted(map(tuple, index.frequencies.select("token", "df").collect()))) == index_from_scratch(spark, store)
    batch(spark, *ROWS).write.parquet(str(tmp_path / "feed"))
    other = live_store(spark, str(tmp_path / "s"))
    feed = spark.readStream.schema(FEED).parquet(str(tmp_path / "feed"))
    ingest.stream_ingest(feed, other, str(tmp_path / "ck")).awaitTermination(120)
    assert state(other) == before


def test_ingest_rewrites_only_touched_buckets_and_survives_a_stop(spark, tmp_path):
    def files(store):
        return {str(p.relative_to(store.root)) for t in store.tables for p in Path(f"{store.root}/{t}").rglob("*.parquet")}
    store = live_store(spark, str(tmp_path / "b"))
    ingest.ingest_batch(store, batch(spark, *[(f"B{i}", f"Women's Summer Dress Number{i}", "10") for i in range(12)]), 0)
    old = files(store)
    more = batch(spark, ("B3", "Men's Leather Winter Boots", "40"))
    (bucket,) = store.buckets_of(more, "item_id")
    store.stage(more, 1)
    assert files(store) == old  # stopped before it was published: nothing is seen
    ingest.ingest_batch(store, more, 1)
    new = files(store)
    for t in ("catalog", "postings", "lengths", "vectors"):
        assert {f.split("/")[1] for f in old ^ new if f.startswith(t + "/")} == {f"bucket={bucket}"}
    assert store.read("catalog").filter("item_id = 'B3'").first().version == 2
    index = store.index()
    assert sorted(map(tuple, index.frequencies.select("token", "df").collect())) == index_from_scratch(spark, store)[2]
    assert index.frequencies.filter("token = 'number3'").count() == 0


def test_upsert_restores_deleted(spark):
    cat = spark.createDataFrame([("A", "t", 3, True)], "item_id string, title string, version bigint, is_deleted boolean").withColumns(
        {"created_at": F.lit("2024-01-01").cast("timestamp"), "updated_at": F.lit("2024-01-01").cast("timestamp")})
    out = upsert_catalog(cat, spark.createDataFrame([("A", "n")], "item_id string, title string"), F.current_timestamp()).first()
    assert (out.version, out.is_deleted, out.title) == (4, False, "n") and out.created_at.year == 2024


def test_common_tokens_are_not_joined_in_full(spark):
    rng = random.Random(9)
    texts = [(i, " ".join(["shared"] * rng.randint(1, 3) * (i % 9 > 0) + ["thing"] * (i % 5 > 0) + [f"word{rng.randrange(60)}" for _ in range(rng.randint(0, 12))])) for i in range(3000)]
    docs = spark.createDataFrame(texts, "item_id int, search_text string")
    queries = spark.createDataFrame([(1, "shared word7"), (2, "shared thing word8 word9"), (3, "thing word11 shared"), (4, "word3"), (5, "shared thing")], "query_id int, query string")
    kept = {}
    index = V.keyword_index(docs, keep=lambda df, name: kept.setdefault(name, df.cache()))
    assert {r.token for r in index.blocks.select("token").distinct().collect()} == {"shared", "thing"}
    plain = V.KeywordIndex(index.postings, index.documents, index.frequencies)
    for k in (5, 40, 5000):
        a, b = (sorted(map(tuple, V.bm25_topk(queries, i, k).collect())) for i in (index, plain))
        assert a == b and len(a) > 4 * min(k, 100)
    seen = []
    hits = V.common_hits
    V.common_hits = lambda *a: seen.append(hits(*a)) or seen[-1]
    try:
        V.pruned_scores(V.query_tokens(queries.filter("query_id < 4")), index, V.token_stats(index), 5).count()
    finally:
        V.common_hits = hits
    full = index.postings.join(V.query_tokens(queries.filter("query_id < 4")), "token").filter("token in ('shared', 'thing')").count()
    assert seen[0].count() < full / 5


def ttl_by_hand(rows, ttl):
    stored, out = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        hit = k in stored and t - stored[k] <= ttl
        out[i] = hit
        if not hit:
            stored[k] = t
    return out


def test_repeats_batch_and_stream(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, "hot" if rng.random() < 0.5 else f"k{rng.randrange(4)}", rng.randrange(0, 40000)) for i in range(800)]
    df = spark.createDataFrame(rows, "event_id bigint, query_key string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    want = ttl_by_hand(rows, 3600)
    assert {r.event_id: r.repeat for r in repeats.repeat_within_ttl(df).collect()} == want
    df.write.parquet(str(tmp_path / "log"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "log"))
    q = repeats.repeat_stream(s).writeStream.format("memory").queryName("rep").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.event_id: r.repeat for r in spark.sql("select * from rep").collect()} == want


def test_repeats_of_a_hot_key_spread_over_tasks(spark):
    rng = random.Random(8)
    rows = [(i, "hot" if i % 10 else f"k{i % 7}", rng.randrange(0, 400_000)) for i in range(4000)] + [(9001, None, 5), (9002, None, 6)]
    df = spark.createDataFrame(rows, "event_id bigint, query_key string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.event_id: r.repeat for r in repeats.repeat_within_ttl(df, ttl=60).collect()}
    assert got == {**ttl_by_hand(rows[:4000], 60), 9001: False, 9002: False}
    assert not any(r.repeat for r in repeats.repeat_within_ttl(df.limit(0)).collect())
    times = df.filter("query_key is not null").select("query_key", F.unix_micros("ts").alias("t")).distinct()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        links = repeats.successors(times, "query_key", 60_000_000).filter("query_key = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(links) > 2 and max(r["count"] for r in links) < 0.5 * times.count()


def test_metric_streams(spark, tmp_path):
    df = spark.range(200).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit("search").alias("endpoint"), F.col("id").cast("double").alias("latency_ms"), F.lit(200).alias("status"))
    df.write.parquet(str(tmp_path / "log"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "log"))
    q = metrics.ops_counters(s).writeStream.format("memory").queryName("cnt").outputMode("complete").option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select n from cnt").first().n == metrics.ops_counters(df).first().n == 200
    q = metrics.rolling_metrics_stream(s).writeStream.format("memory").queryName("roll").outputMode("append").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    first = spark.sql("select * from roll where n = 60 order by window.start limit 1").first()
    assert first.p50 == np.percentile(np.arange(first.p50 - 29.5, first.p50 + 30.5), 50)


def test_last_requests_of_a_stream(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"r{i:05d}", "hot" if i % 10 else rng.choice(["rare", None]), 1_700_000_000 + rng.randrange(900), round(rng.uniform(1, 500), 2)) for i in range(6000)]
    df = spark.createDataFrame(rows, "id string, route string, at long, ms double").withColumn("at", F.timestamp_seconds("at")).withColumn("_other", F.lit(1))
    names = {"endpoint": "route", "at": "at", "latency": "ms", "tie": "id", "window": 100}
    folder, parts = str(tmp_path / "state"), df.randomSplit([1.0] * 4, 7)
    for part in parts:  # a hot endpoint, ties in time, and late rows in every file
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        metrics.last_requests_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "log")), folder, **names).awaitTermination(120)
    want = sorted(map(str, metrics.rolling_metrics(df, **names).collect()))
    assert sorted(map(str, metrics.current_metrics(spark, folder).collect())) == want and len(want) == 3
    for slot in (0, 1):
        assert spark.read.parquet(f"{folder}/slot-{slot}").groupBy("route").count().filter("count > 100").isEmpty()
    metrics.advance_metrics(parts[3], 3, folder, **names)  # the last batch once more, as after a failure
    assert sorted(map(str, metrics.current_metrics(spark, folder).collect())) == want
    plan = metrics.latest_requests(df, endpoint="route", at="at", tie="id", window=100)._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("WindowGroupLimit") > plan.rindex("Exchange")  # cut before the shuffle too
    metrics.last_requests_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "log")), folder, **names).awaitTermination(120)
    assert sorted(map(str, metrics.current_metrics(spark, folder).collect())) == want


def test_sparse_tfidf_and_merge_dot(spark):
    texts = {1: "red wool scarf red", 2: "blue wool hat", 3: "", 4: None, 5: "wool wool", 6: "red hat of wool"}
    v = encoders.sparse_tfidf(spark.createDataFrame(list(texts.items()), "id long, body string"), 4096, "id", "body")
    got = {r.id: [(e.pos, e.weight) for e in r.vec] for r in v.collect()}
    assert set(got) == set(texts) and got[3] == got[4] == []
    words = {i: (t or "").split() for i, t in texts.items()}
    vocab = sorted({w for ws in words.values() for w in ws})
    df = np.array([sum(w in ws for ws in words.values()) for w in vocab])
    dense = np.array([[ws.count(w) for w in vocab] for _, ws in sorted(words.items())]) * np.log((len(texts) + 1) / (df + 1))
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-300)
    for i, row in zip(sorted(texts), dense):
        assert [p for p, _ in got[i]] == sorted(p for p, _ in got[i])
        assert np.allclose(sorted(w for _, w in got[i]), sorted(row[row > 0]))
    a, b = v.selectExpr("id AS a", "vec AS va"), v.selectExpr("id AS b", "vec AS vb")
    pairs = a.join(b, F.col("a") <= F.col("b")).select("a", "b", encoders.sparse_dot(F.col("va"), F.col("vb")).alias("dot"))
    for r in pairs.collect():
        assert abs(r.dot - dense[r.a - 1] @ dense[r.b - 1]) < 1e-12
    assert encoders.sparse_tfidf(spark.createDataFrame([], "id long, body string"), 64, "id", "body").collect() == []


def test_reports_on_empty_input(spark):
    empty = spark.createDataFrame([], "item_id string, title string, slot string, gender string, age_group string, drop_reason string")
    assert reports.coverage_report(empty).collect() == [] and reports.drop_report(empty).collect() == [] and reports.top_words(empty).collect() == []
