"""What moves in encoding texts."""


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hash_encoder_moves_no_tokens(spark):
    """Tokens were exploded and shuffled by (item, position)."""
    from shelfspark.operators.encoders import hash_encoder

    texts = spark.createDataFrame([(1, "a b a c"), (2, ""), (3, None), (4, "b")], "item_id int, search_text string")
    out = hash_encoder(texts)
    assert "Exchange" not in plan(out)
    vec = {r["item_id"]: r["vec"] for r in out.collect()}
    assert not any(vec[2] + vec[3]) and sorted(abs(round(x, 4)) for x in vec[1] if x) == [0.4082, 0.4082, 0.8165]
    twice = spark.createDataFrame([(1, "a b"), (1, "a c"), (2, ""), (4, "b")], "item_id int, search_text string")
    assert {r["item_id"]: r["vec"] for r in hash_encoder(twice).collect()} == {1: vec[1], 2: vec[2], 4: vec[4]}
