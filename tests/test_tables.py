"""Tables of few row groups."""

from stelae.sources.tables import spread, table


def test_few_row_groups_are_dealt_and_many_left_alone(spark, tmp_path, rows):
    data = spark.range(100).selectExpr("id", "id % 3 AS k")
    data.coalesce(1).write.parquet(f"{tmp_path}/few.parquet")
    data.repartition(8).write.parquet(f"{tmp_path}/many.parquet")
    few, many = table(spark, str(tmp_path), "few"), table(spark, str(tmp_path), "many")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" in plan(spread(few)) and rows(spread(few)) == rows(few)
    assert plan(spread(many)) == plan(many) and rows(spread(many)) == rows(data)
    assert plan(spread(data)) == plan(data) and spread(few.limit(0)).count() == 0
