import corpus_pipeline
import pytest
from sitefacts.llm import mixing, packing, quality

from .conftest import rows_of
from .test_ngram_join import brute_force

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def small(testdata):
    return testdata.replace("sf0.001", "sf0.01")


@pytest.fixture(scope="module")
def stages(spark, small):
    """Input and output of each stage, each stage over what the one before it kept."""
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, small).cache()
        out[name], docs = (docs, kept), kept
    return out


def test_stages_keep_the_columns(stages):
    assert list(stages) == ["quality", "near_copies", "mixture", "packing"]
    assert all(stages[name][1].columns == COLUMNS for name in ("quality", "near_copies", "mixture"))


def test_rejected_documents_go(spark, stages, small):
    before, after = stages["quality"]
    model = quality.fit(before, spark.read.parquet(f"{small}/labels.parquet"))
    scores = {r.doc_id: r.score for r in quality.score(before.select("doc_id", "text"), model).collect()}
    kept = {r.doc_id for r in after.collect()}
    assert kept == {d for d, s in scores.items() if s >= 0.5} and 0 < len(kept) < len(scores)


def test_one_of_each_group_stays(stages):
    before, after = stages["near_copies"]
    groups = brute_force([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert sorted(r.doc_id for r in after.collect()) == sorted({g for g in groups.values()})


def test_documents_stay_as_often_as_the_mix_takes_them(stages):
    before, after = stages["mixture"]
    want = []
    for r in mixing.mix(before).collect():
        want += [r.doc_id] * (1 if r.size == 0 else int(r.taken / r.size + 0.5))
    assert sorted(r.doc_id for r in after.collect()) == sorted(want)


def test_all_tokens_are_packed(stages):
    before, after = stages["packing"]
    own = packing.encoder()
    tokens = sum(len(own.encode(r.text or "")) // 4 + 1 for r in before.collect())
    rows = after.collect()
    assert sum(r.length for r in rows) == tokens
    per = {}
    for r in rows:
        per[r.sequence_id] = per.get(r.sequence_id, 0) + r.length
    assert max(per.values()) <= 2048 and tokens / (2048 * len(per)) > 0.97


def test_nulls_repeats_and_no_rows(spark, small, words):
    text = words(200, 1)
    rows = [(None, text), (1, text), (1, text), (1, words(200, 2)), (2, text + " x"), (3, None), (4, ""), (5, words(30_000, 3))]
    docs = spark.createDataFrame([(d, t, "en", None, 0, 1.0, "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, component_id string")
    deduped = corpus_pipeline.one_of_each_group(spark, docs, small)
    assert [r[0] for r in rows_of(deduped, "doc_id")] == [1, 3, 4, 5, None]
    assert corpus_pipeline.good_documents(spark, docs, small).columns == docs.columns
    mixed = corpus_pipeline.mixed_documents(spark, deduped, small)
    assert {3, 4} <= {r.doc_id for r in mixed.collect()} and mixed.columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), small).count() == 0


def test_run(spark, small, stages):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert rows_of(corpus_pipeline.run(spark, small), *names) == rows_of(stages["packing"][1], *names)
