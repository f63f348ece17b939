from pathlib import Path

from sensorloom.session import fresh_path, keep, scratch, shared_folder


def test_scratch_tables_go_and_others_stay(spark):
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    outside = keep(spark.range(5), "outside")
    result = fresh_path(spark, "result")
    with scratch(spark):
        inside = keep(keep(spark.range(7), "one"), "two")
        assert len(set(folder.iterdir()) - before) == 3
        inside.write.parquet(result)
    assert {p.name.split("-")[0] for p in set(folder.iterdir()) - before} == {"outside", "result"}
    assert outside.count() == 5 and spark.read.parquet(result).count() == 7


def test_folders_by_column(spark):
    stored = keep(spark.range(20).selectExpr("id", "cast(id % 3 as int) as part"), "parts", partition_by=("part",))
    assert stored.columns == ["id", "part"] and stored.where("part = 1").count() == 7
    assert "PartitionFilters: [isnotnull(part" in stored.where("part = 1")._jdf.queryExecution().executedPlan().toString()
