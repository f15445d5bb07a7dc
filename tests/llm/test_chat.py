import hashlib

from pyspark.sql import functions as F

from shelfspark.llm import chat

NASTY = ["", None, "\\", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "\\<|\\\\[INST]", "<<SYS>> <</SYS>> <s><unk>", "é😀\n\\n" * 50, "x" * 100_000, "<"]


def brute(turns):
    body = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(body.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_round_trip_of_odd_conversations(spark):
    rows, want = [], {}
    for c, role in enumerate(["user", "assistant", None, "a\nb\\", "<|im_start|>"]):
        turns = [(role if i % 2 else "assistant", t) for i, t in enumerate(NASTY)]
        rows += [(c, i, r, t, "x") for i, (r, t) in enumerate(turns)]
        want[c] = brute(turns)
    rows += [(None, 0, "user", "hi", "x"), (9, 1, "user", "same", "x"), (9, 1, "user", "same", "x"), (9, None, "assistant", "first", "x")]
    want[None], want[9] = brute([("user", "hi")]), brute([("assistant", "first"), ("user", "same"), ("user", "same")])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, score string").repartition(5)
    pieces = chat.format_paths(chat.best_paths(chat.as_trees(df)))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(pieces).collect()}
    assert got == want
    whole = {r["tree"]: r for r in chat.conversations_of(pieces).collect()}
    for c, (_, _, n, digest) in want.items():
        text = "".join(chat.unescape(whole[c]["conversation"][s["from"]:s["to"]]) for s in whole[c]["loss"])
        assert (len(text), hashlib.sha256(text.encode()).hexdigest()) == (n, digest)
        for mark in ("</s>", "[INST]", "<s>", "<<SYS>>", "<unk>"):
            assert mark not in whole[c]["conversation"]
    assert chat.read_back(chat.format_paths(chat.best_paths(chat.as_trees(df.filter("false"))))).count() == 0


def test_best_branches_of_trees(spark):
    # tree 1: 1 -> 2 -> 4, 1 -> 3 -> (5, 6 -> 7); tree 2: a cycle and a lone node; tree 3: an orphan's parent is unknown
    rows = [(1, 1, None, 1.0), (1, 2, 1, 0.9), (1, 4, 2, 0.1), (1, 3, 1, 0.5), (1, 5, 3, 0.9), (1, 6, 3, 0.9), (1, 7, 6, 0.8),
            (2, 1, 2, 9.0), (2, 2, 1, 9.0), (2, 3, None, None), (3, 5, 77, 1.0), (3, 6, 5, None), (3, None, 5, 1.0)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, score double").withColumn("role", F.lit("user")).withColumn("text", F.lit("t"))
    got = {}
    for r in chat.best_paths(df, branches=2).orderBy("tree", "branch", "depth").collect():
        got.setdefault((r["tree"], r["branch"]), []).append(r["node"])
    assert got == {(1, 1): [1, 3, 6, 7], (1, 2): [1, 3, 5], (2, 1): [3], (3, 1): [5, 6]}


def test_long_path(spark):
    df = spark.range(500).select(F.lit(1).cast("long").alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"),
                                 F.lit("user").alias("role"), F.lit("t").alias("text"), F.lit(1.0).alias("score"))
    assert [r["depth"] for r in chat.best_paths(df).orderBy("node").collect()] == list(range(1, 501))


def test_query_equals_sql(spark):
    from oracle_check import compare, connect
    from shelfspark.llm.registered import ORACLES, QUERIES
    sf = "/root/testdata/sf0.01"
    assert compare(QUERIES["op4_chat_formatting"](spark, sf), connect(sf), ORACLES["op4_chat_formatting"]) == ""
