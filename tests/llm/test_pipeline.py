"""The pipeline's stages against brute force, and the registry."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import corpus, rows_of, slow_lines

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def docs(spark):
    out = spark.createDataFrame(rows_of(corpus()), "doc_id long, text string, lang string, source string, n_chars long, key string, fp int, `lines` int")
    return out.withColumn("n_chars", F.length("text").cast("long")).cache()


def test_language_stage_rejects_texts_without_letters(spark, docs):
    out = {r.doc_id: r for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert set(out) == {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    assert all(r.lang in ("en", "fr") for r in out.values())


def test_line_stage(spark, docs):
    want = slow_lines([(r.doc_id, r.text) for r in docs.collect()])
    out = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert out == {i: "\n".join(x) for i, x in want.items() if "".join(x).split()}


def test_near_duplicate_stage(spark, docs):
    """Stages on word shingles link at a Jaccard similarity of 0.8; the four bits are the contract of the op6 query alone."""
    from tests.llm.test_neardup import slow_groups

    rows = sorted(docs.select("doc_id", "text").collect())
    want = slow_groups([r.text for r in rows])
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {rows[k].doc_id for k in set(want.values())}


def test_run_round_trips(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        stages = stage(spark, stages, str(tmp_path))
        assert stages.columns == corpus_pipeline.COLUMNS
    texts = {r.doc_id: r.text for r in stages.collect()}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.decoded_sha256 for r in out} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}


def test_mixing_sql(spark):
    import duckdb

    from orecart.llm import queries

    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES["op3_mixing"](spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(queries.ORACLE_SQL["op3_mixing"]).fetchall())
