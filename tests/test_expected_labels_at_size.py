from pathlib import Path

from gridlode.plans import QUERIES


def test_lines_are_spread_before_labels_are_read(spark, tmp_path: Path):
    spark.createDataFrame([(k,) for k in range(20)], "c_custkey long").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    out = QUERIES["q119_expected_labels"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("RepartitionByExpression")  # printed from the top: the lines are made after the customers are dealt
    assert out.count() == 40
