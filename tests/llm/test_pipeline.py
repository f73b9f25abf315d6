"""The pipeline's stages on their own inputs, against brute force and the operators."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_joins import brute_join, brute_repeats
from wardline.llm import mixing, quality_classifier

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Documents and the result of each stage."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    odd = [(9001, None, "en", "s", None), (9002, "", None, None, 0), (None, "of the and to a", "en", "s", 15), (9004, "of the " * 2000, "en", "s", 14000)]
    docs = docs.unionByName(spark.createDataFrame([*odd, odd[1]], docs.schema)).cache()
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(stage(spark, out[-1], DIR).cache())
    return out


def rows(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_columns(steps):
    assert all(tuple(s.columns) == cp.COLUMNS for s in steps[:-1])
    assert all(s.schema["doc_id"].dataType.simpleString() == "bigint" for s in steps)
    assert all(s.schema["n_chars"].dataType.simpleString() == "bigint" for s in steps[:-1])


def test_quality_rejects(spark, steps):
    docs = steps[0]
    model = quality_classifier.train(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    differ = model.differ()
    want = [(i, t) for i, t in rows(docs) if model.probability(differ((t or "").encode())) >= 0.3]
    assert rows(steps[1]) == sorted(want, key=str) and len(want) < docs.count()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    clean = [i for i, _ in rows(docs) if labels.get(i) == 1]
    assert len({i for i, _ in rows(steps[1])} & set(clean)) > 0.97 * len(clean)


def test_one_of_each_group_stays(steps):
    import tests.llm.test_joins as tj

    given = rows(steps[1])
    sets, tj_shingles = {}, tj.shingles
    try:
        tj.shingles = lambda text: tj_shingles(text, 5)
        sets = brute_join([(i, t) for i, t in given if i is not None], percent=80)
    finally:
        tj.shingles = tj_shingles
    want = [(i, t) for i, t in given if i is None or sets[i][1] == i]
    assert rows(steps[2]) == sorted(want, key=str)


def test_repeats_go(steps):
    given = rows(steps[2])
    want = {(i, kept) for i, n, gone, kept in brute_repeats(given) if gone < n or not gone}
    got = rows(steps[3])
    assert {(i, " ".join((t or "").split())) for i, t in got} == want
    same = {i: t or "" for i, t in given}
    untouched = {i for i, n, gone, _ in brute_repeats(given) if not gone}
    assert all(t == same[i] for i, t in got if i in untouched)
    assert all(r["n_chars"] == len(r["text"]) for r in steps[3].collect())


def test_mixture_keeps_all_and_repeats_some(steps):
    given, mixed = steps[3], steps[4]
    assert {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in given.collect()}
    words = F.size(F.split(F.trim("text"), r"\s+"))
    by = {r["lang"]: r["n"] for r in mixed.groupBy("lang").agg(F.sum(words).alias("n")).collect() if r["lang"]}
    total = sum(by.values())
    assert all(abs(by[d] / total - w) < 0.12 for d, w in mixing.MIXTURE.items())


def test_packing_holds_every_row(steps):
    pieces = steps[5].collect()
    whole = {(r["doc_id"], r["copy"]): r["doc_tokens"] for r in pieces}
    held = {}
    for r in pieces:
        held[r["doc_id"], r["copy"]] = held.get((r["doc_id"], r["copy"]), 0) + r["length"]
    assert held == whole and len(whole) == steps[4].count()


def test_run_and_empty_table(spark):
    assert cp.run(spark, DIR).count() > 0
    empty = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        empty = stage(spark, empty, DIR)
        assert empty.count() == 0


def test_texts_reach_python_in_small_batches(spark):
    """Each stage bounds the bytes handed over at once, whatever the session had."""
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": pa.array([batch.num_rows], pa.int64())})

    texts = spark.range(4000, numPartitions=1).selectExpr("id as doc_id", "repeat('word ', 400) as text")
    docs = texts.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "2000L as n_chars")
    for _, stage in cp.STAGES:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, docs.limit(50), DIR)
        most = max(r["rows"] for r in texts.mapInArrow(sizes, "rows long").collect())
        assert most * 2000 < 3 << 20
