import datetime as dt

from pyspark.sql import functions as F

from rallygrid.plans import learning
from rallygrid.session import table

SF = "/root/testdata/sf0.001"


def test_open_windows_are_counted(spark, tmp_path):
    at = lambda day: dt.datetime(2024, 5, day)
    rows = [("Hard", at(1)), ("Hard", at(20)), ("Clay", at(21)), (None, at(21))]
    source = spark.createDataFrame(rows, "surface string, loaded_at timestamp")
    source.coalesce(1).write.parquet(str(tmp_path / "ongoing_tourneys.parquet"))
    got = learning.stream_counts(spark, str(tmp_path))
    assert sorted((str(r.surface), r.n) for r in got.collect()) == [("Clay", 1), ("Hard", 1), ("Hard", 1), ("None", 1)]


def test_all_deliveries_are_counted(spark):
    want = table(spark, SF, "ongoing_tourneys").filter("loaded_at is not null").groupBy(F.window(F.col("loaded_at").cast("timestamp"), "7 days").start.alias("start"), "surface").agg(F.count("*").alias("n"))
    got = learning.stream_counts(spark, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
