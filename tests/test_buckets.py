"""Buckets of the live catalog follow its size."""


def test_a_bucket_is_bounded():
    """Eight buckets whatever the catalog: at most eight tasks wrote each table."""
    from shelfspark.streaming import ingest as I

    assert I.bucket_count(200) == 8
    for n in (1_200_000, 7_200_000):
        assert n / I.bucket_count(n) <= I.BUCKET_ROWS
