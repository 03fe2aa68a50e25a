"""Each stage of the pipeline on what the one before kept, against plain versions."""

import corpus_pipeline as P
import pytest
from helpers import components, counts, edge_rows, hits, repeated

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    out = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for k, (_, stage) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], DATA).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns(inputs):
    for df in inputs[1:-1]:
        assert df.columns == inputs[0].columns


def test_quality_keeps_no_base_failure(inputs):
    kept = {i for i, _ in rows(inputs[1])}
    for i, t in rows(inputs[0]):
        n, *_, repeat = counts(t)
        if n < 50 or 100 * repeat > 50 * n:
            assert i not in kept


def test_one_of_each_group(inputs):
    want = {i for i, _, c in components(rows(inputs[1])) if i == c}
    assert {i for i, _ in rows(inputs[2])} == want


def test_passages_are_cut(inputs):
    want = {i: n - m for i, n, m, *_ in repeated(rows(inputs[2]))}
    got = {i: len((t or "").encode()) for i, t in rows(inputs[3])}
    assert got.keys() == want.keys() and all(want[i] - 12 <= got[i] <= want[i] for i in want)


def test_contaminated_go(spark, inputs):
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    want = {i for i, *_, bad in hits(rows(inputs[3]), items) if not bad}
    assert {i for i, _ in rows(inputs[4])} == want


def test_all_tokens_are_packed(inputs):
    packed = inputs[5].groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in rows(inputs[4])}
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in packed)


def test_stages_on_edge_rows_and_nothing(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for k, data in enumerate(([(i, t, None, None, None) for i, t in edge_rows()], [])):
        docs = spark.createDataFrame(data, schema)
        for name, stage in P.STAGES:
            path = str(tmp_path / f"{k}-{name}")
            stage(spark, docs, DATA).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() >= 0
