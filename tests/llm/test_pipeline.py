"""The pipeline against plain loops, stage by stage on the given small table with planted rows."""

import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from shelfspark.llm import langid, mixing, secrets, simhash
from test_mixing import plain_targets
from test_secrets import base_spans, linked_spans

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_dedup(rows):
    """Smallest id of each group of links over all pairs: equal words, or a similarity of 0.8 of the sets of five-word shingles."""
    words = [(r["text"] or "").encode().lower().split() for r in rows]
    sets = [shingles(r["text"]) for r in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if words[i] == words[j] or small >= 0.8 * large and small and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                label[root(j)] = root(i)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i), []).append(r["doc_id"])
    return {min(g) for g in groups.values()}


def masked(text):
    if text is None:
        return None
    out, at = "", 0
    for s, _, e in sorted(base_spans(text) + linked_spans(text)):
        if e > at:
            out += text[at:s] + "[SECRET]" if s >= at else ""
            at = e
    return out + text[at:]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = " ".join(f"{w}{i}" for i, w in enumerate(["the", "thing", "and", "other"] * 40))
    planted = spark.createDataFrame([
        (90001, words, "en", "src1", 1), (90002, words.upper(), "en", "src2", 1), (90003, words.replace("other7 ", "edited "), "en", "src2", 1),
        (90004, "12345 !!! 67", "en", "src0", 1), (90005, None, None, None, None), (90006, words + " password=abcdefgh1234 and more", None, None, 3)], docs.schema)
    at, out = docs.unionByName(planted), []
    out.append(at)
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, at, SF).write.parquet(path)
        at = spark.read.parquet(path)
        out.append(at)
    return out


def test_stage_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "secrets", "mixture", "packing"]
    assert all(dict(s.dtypes) == dict(stages[0].dtypes) and s.columns == stages[0].columns for s in stages[:5])


def test_language_drops_only_what_has_no_language(stages):
    before, after = ({r["doc_id"] for r in s.collect()} for s in stages[:2])
    assert before - after == {90004, 90005}


def test_one_of_each_group_stays(stages):
    rows = stages[1].orderBy("doc_id").collect()
    kept = [r["doc_id"] for r in stages[2].collect()]
    assert len(kept) == len(set(kept)) and set(kept) == plain_dedup(rows)
    assert 90001 in kept and not {90002, 90003} & set(kept)


def test_secrets_are_masked(stages):
    before, after = ({r["doc_id"]: r for r in s.collect()} for s in stages[2:4])
    assert set(before) == set(after)
    assert all(after[i]["text"] == masked(before[i]["text"]) and after[i]["n_chars"] == len(after[i]["text"]) for i in before)


def test_mixture_meets_its_targets(stages):
    words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    sizes, taken, copies = {}, {}, {}
    for r in stages[3].collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + words(r)
    for r in stages[4].collect():
        taken[r["source"]] = taken.get(r["source"], 0) + words(r)
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert max(copies.values()) <= 3
    for s, target in plain_targets(sizes).items():
        assert target * 0.97 - 30 <= taken.get(s, 0) <= target


def test_packing_covers_all_tokens(stages):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mixed = stages[4].groupBy("doc_id").agg(F.count("*").alias("n"), F.first("text").alias("text")).collect()
    rows = stages[5].collect()
    once = {r["doc_id"]: len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in mixed}
    per = {}
    for p in rows:
        per[p["doc_id"]] = per.get(p["doc_id"], 0) + p["length"]
    assert per == {r["doc_id"]: r["n"] * once[r["doc_id"]] for r in mixed}
    by_seq = {}
    for p in rows:
        by_seq.setdefault(p["sequence_id"], []).append(p)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024


def test_run_equals_the_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).columns == stages[5].columns


CLASHING = ["row", "key", "met", "nth", "share", "copy", "bucket", "hash", "id", "word", "mask", "spans", "of", "stays", "has_letter", "lang_pred", "score", "rejected", "source_",
            "d_row", "s_doc", "m_key", "llm_lang", "copies", "rows", "least", "most"]


def clashing(docs):
    return docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})


def test_input_columns_may_have_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 60")
    odd = clashing(docs)
    model = langid.fit(docs.select("text", "lang"))
    names = ("a1", "a2", "a3")
    steps = {"dedup": simhash.deduplicated, "redact": secrets.redact, "mix": mixing.mixed_documents,
             "language": lambda d: langid.predict(d, model, d.columns, names).filter("not a3").drop(*names)}
    for name, step in steps.items():
        plain, got = step(docs), step(odd)
        assert got.columns == odd.columns, name
        assert sorted(map(tuple, got.select(*docs.columns).collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr), name
        assert all(r[c] == f"{c}{r['doc_id']}" for r in got.collect() for c in CLASHING), name


@pytest.mark.parametrize("case", ["empty", "repeated"])
def test_run_over_odd_tables(spark, tmp_path, case):
    docs = clashing(spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 40"))
    odd = spark.createDataFrame([(None, "The thing and that other thing of the day. " * 9, None, None, None), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.filter("false") if case == "empty" else docs.unionByName(docs).unionByName(docs.limit(3)).unionByName(odd, allowMissingColumns=True)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    ids = [r["doc_id"] for r in got.select("doc_id").distinct().collect()]
    assert (ids == []) if case == "empty" else len(ids) > 5


def test_keys_that_are_met_are_never_missed(spark):
    from shelfspark.llm.common import met
    rows, keys = spark.range(5000).withColumn("k", F.col("id") * 7), spark.range(0, 5000, 3).select((F.col("id") * 7).alias("x"))
    for bits in (64, 1 << 10, 1 << 24):
        got = {r["id"]: r["met"] for r in met(rows, "k", keys, bits).collect()}
        assert len(got) == 5000 and all(got[i] for i in range(0, 5000, 3))
    assert sum(got.values()) < 1700
    assert not any(r["met"] for r in met(rows, "k", keys.limit(0)).collect())


def test_few_texts_reach_a_worker_at_once(spark):
    """A worker was handed 10,000 whole texts, of which it and the executor held copies."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    sizes = lambda: spark.range(0, 4000, 1, 1).mapInPandas(lambda batches: (b.assign(id=len(b))[:1] for b in batches), "id long").agg({"id": "max"}).first()[0]
    try:
        for set_to, most in (("10000", corpus_pipeline.BATCH_ROWS), ("0", corpus_pipeline.BATCH_ROWS), ("200", 200)):
            spark.conf.set(name, set_to)
            assert corpus_pipeline.pack(spark, docs, "").count() == 1
            assert sizes() == most
    finally:
        spark.conf.set(name, before)
