"""The pipeline's stages on a small slice of its real tables, and the driver contract."""

import corpus_pipeline

from tickloom.llm import secrets


def test_stages(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    columns = docs.columns
    assert len(corpus_pipeline.STAGES) == 5
    before = {r.doc_id: r.text for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, source)
        made.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in docs.collect()}
            assert 0 < len(after) <= len(before)
            if k == 3:
                assert len(after) == len(before) and not any(secrets.base_spans(t or "") for t in after.values())
            else:
                assert all(before[i] == t for i, t in after.items())
            before = after
    rows = docs.collect()
    assert {r.doc_id for r in rows} == set(before) and all(r.lossless and r.n_pieces == len(r.ids) for r in rows)


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)}
    assert set(entry.oracle_sql()) <= set(names)
