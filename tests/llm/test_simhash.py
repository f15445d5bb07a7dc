import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from shelfspark.llm import simhash


def plain_fingerprint(text, words=3):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    shingles = [b" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))]
    got = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(g >> b & 1 for g in got) * 2 > len(got))


def plain_groups(ids, fps, most_bits):
    label = dict(zip(ids, ids))
    fps = np.array(fps, np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= most_bits
    changed = True
    while changed:
        changed = False
        for i, row in enumerate(near):
            low = min(label[ids[j]] for j in np.flatnonzero(row))
            for j in np.flatnonzero(row):
                if label[ids[j]] != low:
                    label[ids[j]], changed = low, True
    return label


def test_fingerprint_is_the_majority_of_shingle_hashes():
    for text in ["", None, " \t\n", "One", "one two", "A b\vC d e", "é É ß x y z w", "a b c " * 50000]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("n,bits", [(1000, 3), (10 ** 6, 3), (1000, 8), (10 ** 6, 8), (10 ** 9, 8)])
def test_part_numbers_follow_the_size(n, bits):
    assert simhash.pick_parts(10 ** 12, 8) == 4 and 4 <= simhash.pick_parts(n, bits) <= max(4, bits + 1)


@pytest.mark.parametrize("parts,bucket", [(None, 2048), (4, 8), (5, 8), (6, 2048)])
def test_groups_equal_brute_force(spark, parts, bucket):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 40)
    fps = {0}
    for v in base:  # chains, stars and balls around each base, up to 5 bits off
        for _ in range(20):
            fps.add(int(v) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)))
    hot = int(base[0])
    fps |= {hot ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)}
    fps = sorted(fps)
    ids = list(range(10, 10 + len(fps)))
    df = spark.createDataFrame([(simhash.as_signed(f), i) for f, i in zip(fps, ids)], "fp long, rep long")
    from shelfspark.llm.common import components
    got = {r["id"]: r["component"] for r in components(simhash.fingerprint_links(df, 3, parts, bucket), "t").collect()}
    want = plain_groups(ids, fps, 3)
    assert {i: got.get(i, i) for i in ids} == want


def test_thresholds_sum_and_avoid_hot_parts():
    counts = np.array([[[1, 2]] * 4, [[10 ** 6, 10 ** 7], [1, 2], [1, 2], [1, 2]]], float)
    got = simhash.thresholds(counts, [16] * 4, 3)
    assert (simhash.thresholds(counts, [16] * 4, 2).sum(axis=1) == -1).all() and (simhash.thresholds(counts, [16] * 4, 8).sum(axis=1) == 5).all()
    assert (got.sum(axis=1) == 0).all() and (got[0] == 0).all() and got[1, 0] == -1


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (4, "a b c d", "x"), (4, "a b c d", "y"), (None, "A B C D", "z"), (None, "q", None),
            (5, "word " * 30000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.simhash_groups(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (None, 4), (None, None), (5, 5)], key=str)
    assert simhash.simhash_groups(docs.filter("false")).count() == 0


def test_query_equals_brute_force(spark):
    from shelfspark.llm.registered import QUERIES
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op9_simhash"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text")).orderBy("doc_id").collect()
    fps = [plain_fingerprint(r["text"]) for r in docs]
    ids = [r["doc_id"] for r in docs]
    want = plain_groups(ids, fps, 3)
    assert got == {i: (f"{f:016x}", want[i]) for i, f in zip(ids, fps)}


def test_deduplicated_keeps_one_of_each_group(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(3000)]

    def edited(parts, n):
        out = list(parts)
        for at in rng.choice(len(out), n, replace=False):
            out[at] = "changed%d" % rng.integers(1 << 40)
        return out
    rows, groups, i = [], {}, 0
    for g in range(40):
        base = list(rng.choice(words, 150 + 20 * g))
        for e in (0, 0, 1, 2, 3):
            rows.append((i, " ".join(edited(base, e)), g))
            groups.setdefault(("near", g), []).append(i)
            i += 1
        rows.append((i, " ".join(edited(base, (150 + 20 * g) // 3)), g))  # far below 0.8: stays
        groups[("far", g)] = [i]
        i += 1
    rows += [(5000, None, 1), (5001, "", 1), (5002, "short one", 1), (5002, "short one", 1), (None, "short one", 2), (None, "other text", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = simhash.deduplicated(docs)
    assert got.columns == docs.columns
    kept = [r["doc_id"] for r in got.collect()]
    want = [min(v) for v in groups.values()] + [5000, 5002, None]
    assert sorted(map(str, kept)) == sorted(map(str, want))
    assert simhash.deduplicated(docs.filter("false")).count() == 0
