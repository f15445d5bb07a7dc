"""The pipeline's near copies against plain loops: recall over block edits, texts of one hot line, the 0.8 border."""

import numpy as np

from shelfspark.llm import simhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def edits(rng, words, base, goal):
    """base with one block appended, dropped or replaced, and with single words changed: each near the similarity `goal`."""
    n, fresh = len(base), lambda k: [f"new{x}" for x in rng.integers(0, 1 << 40, k)]
    more, less, swap = round(n * (1 / goal - 1)), round(n * (1 - goal)), round(n * (1 - goal) / (1 + goal))
    at = int(rng.integers(5, n - less - 5))
    yield base + fresh(more)
    yield base[:at] + base[at + less:]
    yield base[:at] + fresh(swap) + base[at + swap:]
    out = list(base)
    for i in range(round(swap / 5)):
        out[(at + i * (n // max(1, round(swap / 5)))) % n] = fresh(1)[0]
    yield out


def test_no_pair_over_the_border_is_missed(spark):
    """One document of each pair goes exactly if the similarity is 0.8 or more, here from 0.65 to 1."""
    rng, words = np.random.default_rng(12), [f"w{i}" for i in range(20000)]
    rows, want, seen = [], set(), []
    for n in (60, 150, 400, 1500):
        for goal in (0.78, 0.79, 0.795, 0.8, 0.805, 0.81, 0.82, 0.85, 0.9, 0.95):
            for kind in range(4):
                base = list(rng.choice(words, n))
                edited = list(edits(rng, words, base, goal))[kind]
                a, b = " ".join(base), " ".join(edited)
                i = len(rows)
                rows += [(i, a), (i + 1, b)]
                seen.append(jaccard(a, b))
                want |= {i} if seen[-1] >= 0.8 else {i, i + 1}
    assert sum(s >= 0.8 for s in seen) > 80 and sum(0.77 < s < 0.8 for s in seen) > 20
    got = {r["doc_id"] for r in simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_a_shared_hot_line_makes_no_copies(spark):
    """Equal word-pair fingerprints, similarity far below 0.8: all stay."""
    rng = np.random.default_rng(5)
    line = "this one line is in every text "
    rows = [(i, line * 100 + " ".join(f"own{x}" for x in rng.integers(0, 1 << 40, 60))) for i in range(6)]
    assert len({simhash.fingerprint(t, 2) for _, t in rows}) < 6 and max(jaccard(rows[0][1], t) for _, t in rows[1:]) < 0.2
    docs = spark.createDataFrame(rows + [(7, rows[0][1].upper())], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.deduplicated(docs).collect()) == list(range(6))


def test_the_decision_is_exact():
    """Pairs one shingle over and under the border."""
    rng = np.random.default_rng(6)
    for size in (5, 90, 9000):
        pool = np.unique(rng.integers(0, 1 << 63, 2 * size, np.uint64))
        rng.shuffle(pool)
        a = np.sort(pool[:size])
        for cut in (size // 5 - 1, size // 5, size // 5 + 1):  # b is a part of a: similarity 1 - cut / size
            b = np.sort(a[cut:])
            assert simhash.jaccard_links([a, pool[size:]], [b], 0.8).tolist() == [[size - cut >= 0.8 * size], [False]]


def test_blocks_and_rows_without_id(spark):
    """A component over many blocks; null ids; a group without an id keeps one row."""
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base[:-1] + [f"end{i}"])) for i in range(30)] + [(None, " ".join(base)), (None, "x y z"), (None, "X y z"), (99, None), (98, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in simhash.deduplicated(docs).collect()) == ["0", "98", "None"]
    members = spark.createDataFrame([(i, 1, i, 296) for i in range(30)], "node long, component long, key long, n long")
    links = simhash.similar_links(members, docs.filter("doc_id < 30").selectExpr("doc_id as key", "text"), 0.8, block=4)
    from shelfspark.llm.common import components
    assert {r["component"] for r in components(links, "t").collect()} == {0} and links.count() < 30 * 9


def test_simhash_finds_candidates(spark, monkeypatch):
    """Candidates came from min-hash bands alone: without these nothing was found."""
    import numpy as np

    from shelfspark.llm import simhash as S

    words = [f"w{i}" for i in range(600)]
    texts = [" ".join(words), " ".join(words[:-1] + ["other"]), " ".join(f"x{i}" for i in range(600)), "short", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(S, "band_keys", lambda shingles: np.empty(0, np.int64))
    assert sorted(r["doc_id"] for r in S.deduplicated(docs).collect()) == [0, 2, 3, 4]
