"""The pipeline and the registered queries over the smallest test tables."""

import os

import duckdb
import pytest
from sentencepiece import SentencePieceProcessor

import corpus_pipeline
from newsburst.llm import queries
from newsburst.llm.queries import model_file

from . import brute

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    return [tuple(r) for r in docs]


def run(spark, name):
    return queries.callables()[name](spark, FOLDER)


def test_op1(spark, rows):
    got = {r.doc_id: r for r in run(spark, "op1_distribution_divergence").collect()}
    for d, text in rows:
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(text)


def test_op2(spark, rows):
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(map(tuple, run(spark, "op2_suffix_decontamination").collect())) == brute.decontaminated(rows, items)


def test_op3(spark, rows):
    expected = [(d, n, gone, brute.sha(kept)) for d, n, gone, kept in brute.without_repeats(rows)]
    assert sorted(map(tuple, run(spark, "op3_debruijn_repeats").collect())) == sorted(expected)


def test_op9(spark, rows):
    assert sorted(map(tuple, run(spark, "op9_partenum_join").collect())) == sorted(brute.components(rows, 3, 90))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    duck = duckdb.connect()
    for table in ("pages", "labels", "conversations", "documents", "benchmark"):
        duck.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    answer = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in answer.description]
    found = run(spark, name).select(*columns).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(answer.fetchall(), key=repr)


def test_pipeline(spark, rows):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    names = list(steps)
    assert [n.split("_")[0] for n in names] == ["quality", "ngram", "benchmark", "pii", "sentencepiece"]

    good = steps[names[0]](spark, docs, FOLDER).cache()
    failed = {d for d, t in rows if brute.quality(t)[5]}
    ids = {r.doc_id for r in good.collect()}
    assert good.columns == columns and not ids & failed

    single = steps[names[1]](spark, good, FOLDER).cache()
    kept_rows = [(d, t) for d, t in rows if d in ids]
    first = {d for d, _, c in brute.components(kept_rows, 5, 80) if c == d}
    assert single.columns == columns and {r.doc_id for r in single.collect()} == first

    clean = steps[names[2]](spark, single, FOLDER).cache()
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    dirty = {r[0] for r in brute.decontaminated([(d, t) for d, t in rows if d in first], items) if r[5]}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == first - dirty

    private = steps[names[3]](spark, clean, FOLDER).cache()
    assert private.columns == columns and private.count() == clean.count()

    encoded = steps[names[4]](spark, private, FOLDER).collect()
    reference = SentencePieceProcessor(model_proto=model_file("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in private.collect()}
    assert {r.doc_id for r in encoded} == set(texts)
    assert all(list(r.ids) == reference.encode(texts[r.doc_id]) for r in encoded)


def test_pipeline_of_nothing(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
