import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfspark.llm import packing


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ODD = ["", None, " ", "a", " a", "a ", "a  b", "a \n b", "it's 's 're  \t\n x", "ünï 😀 ñandú", "x<|endoftext|>y <|endoftext|> z", "\n\n a\r\n", "a" * 3000,
       "no break  em", "word " * 9000, "1 2  3 4"]


def check(rows, docs, plain, window=1024):
    """All ids once, gapless windows, and what is padded."""
    ids = {d: plain.encode(t or "", add_special_tokens=False).ids + [0] for d, t in docs}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            own = np.array(ids[d][at:at + p["length"]], "<u4")
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids[d]) and p["ids_crc32"] == zlib.crc32(own.tobytes())
            at += p["length"]
        assert at == len(ids[d])
    padded = 0
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= window
        padded += window - at
    return padded


def test_ids_equal_the_tokenizer(plain):
    enc = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = [t or "" for t in ODD]
    for _ in range(2):
        for text, got in zip(texts, enc.batch(texts)):
            assert got.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_levels_follow_sum_of_squares():
    rng = np.random.default_rng(1)
    p = packing.Packer(64, 0, 10_000)
    for i in range(500):
        size = int(rng.integers(1, 64))
        counts = p.levels.copy()

        def after(h):
            c = counts.copy()
            c[h] -= h > 0
            if h + size < 64:
                c[h + size] += 1
            return int((c * c).sum())
        best = min(after(h) for h in range(0, 64 - size + 1) if h == 0 or counts[h])
        p.place((i, 0, size, np.zeros(size, np.uint32)))
        assert int((p.levels * p.levels).sum()) == best
    p.close()
    filled = defaultdict(int)
    for r in p.rows:
        filled[r[5]] += r[2]
    assert sum(v < 64 for v in filled.values()) <= 1


def test_odd_rows(spark, plain):
    docs = [(i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, length int")
    assert check(packing.pack_documents(df.repartition(2)).collect(), docs, plain) < 2 * 1024
    assert check(packing.pack_documents(df.coalesce(1), most_open=2).collect(), docs, plain) < 6 * 1024
    again = packing.pack_documents(df.filter("doc_id = 3").unionByName(df.filter("doc_id = 3")).selectExpr("cast(null as long) doc_id", "text")).collect()
    assert [r["doc_id"] for r in again] == [None, None]
    assert packing.pack_documents(df.filter("false")).count() == 0


def test_query(spark, plain):
    from shelfspark.llm.registered import QUERIES
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert check(QUERIES["op7_packing"](spark, sf).collect(), docs, plain) < 8 * 1024


def test_the_end_cuts_only_windows_that_do_not_fit_together():
    rng = np.random.default_rng(2)
    p = packing.Packer(256, 0, 10_000)
    for i in range(400):
        p.place((i, 0, 1, np.zeros(int(rng.integers(1, 256)), np.uint32)))
    for level, held in p.drain():
        p.put(held, level, False)
    left = sorted(level for level, _ in p.drain())
    assert len(left) < 2 or left[0] + left[1] > 256
