import corpus_pipeline
from reelgraph.llm import queries
from reelgraph.llm.common import stored, table

from ..conftest import DATA


def test_stages(spark):
    docs, columns, kept = table(spark, DATA, "documents"), None, {}
    for name, stage in corpus_pipeline.STAGES:
        given = docs
        docs = stored(stage(spark, docs, DATA))
        columns = columns or given.columns
        if name != "packing":
            assert docs.columns == columns
            kept[name] = {r["doc_id"] for r in docs.collect()}
            assert kept[name] <= {r["doc_id"] for r in given.collect()}
        else:
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in given.collect()}
    items = [r["text"] for r in table(spark, DATA, "benchmark").collect()]
    for r in given.collect():
        assert not any(i in r["text"] for i in items)


def test_run_on_odd_rows(spark, odd, empty, tmp_path):
    for name, rows in (("odd", odd), ("none", empty)):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        table(spark, DATA, "benchmark").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    # Language: 1, 2, 7, 8 and the row without id and text go. Near duplicates: of 3, 4 and 4 the first stays, of the
    # cat's two rows the one with an id; the two texts under 5 are no copies. All but a line of 3 repeats itself.
    rows = sorted((r["doc_id"], r["piece"], r["start"]) for r in corpus_pipeline.run(spark, f"{tmp_path}/odd").collect())
    assert rows == [(k, 0, 0) for k in (3, 5, 5, 6, 9, 10)]


def test_names():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [*(f"op{k}" for k in range(1, 14)), "pipeline"]
    assert set(queries.oracle_sql()) <= set(names)
