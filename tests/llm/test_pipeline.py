import __spark_entry__
import corpus_pipeline
from corpus_samples import prose


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "shard"]
    assert "pipeline" in __spark_entry__.queries() and corpus_pipeline.ORACLE_SQL is None
    names = [n.split("_")[0] for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(names) == sorted(f"op{n}" for n in range(1, 11))


def test_whole_pipeline_on_a_small_corpus(spark, make_docs, tmp_path):
    item = prose(7000, 30)
    rows = [(i, prose(i, 80)) for i in range(200)] + [(300, prose(3, 80) + " z"), (301, prose(4, 80)), (302, prose(11, 20) + " " + item)] + [(400 + i, "spam!! " * 60 + f"{i}") for i in range(60)]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 200, 2)] + [(400 + i, 0, 0) for i in range(0, 60, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r.doc_id for r in out.collect()}
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard"]
    assert not ids & {300, 301, 302} and not any(400 <= i < 460 for i in ids)
    assert len(ids) > 120


def test_pipeline_on_empty_and_odd_tables(spark, make_docs, odd_rows, tmp_path):
    from gridlode.llm.store import discard

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    make_docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    docs = make_docs([*odd_rows, (20, prose(20, 50)), (20, prose(20, 50))], extra=True)
    docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(out.columns) == {*docs.columns, "shard"}
    ids = [r.doc_id for r in out.collect()]
    assert set(ids) <= {i for i, _ in odd_rows} | {20} and ids.count(20) <= 1 and not {8, 9} <= set(ids)
    assert discard(spark) > 0 and discard(spark) == 0
