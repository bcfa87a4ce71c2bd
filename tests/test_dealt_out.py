"""Tasks hold a bounded number of rows: what sorts is dealt out over as many tasks as its rows need."""

from datetime import datetime

from pyspark.sql import functions as F

from fairline.operators import history
from fairline.plans import views


def _quotes(spark):
    rows = [
        (f"e{i % 7}", "home" if i % 2 else "away", f"b{i % 3}", datetime(2024, 1, 1 + i % 4, i % 24), i, i * 100 if i % 5 else None)
        for i in range(400)
    ]
    hot = [(None, "home", "b0", datetime(2024, 1, 1 + i % 9), i, i) for i in range(50)]
    quotes = spark.createDataFrame(rows + hot, "event string, side string, book string, at timestamp_ntz, seq int, odds int")
    return quotes.withColumn("decimal_odds", F.col("odds").cast("decimal(18,8)"))


def test_number_of_tasks_follows_the_rows(spark, tmp_path):
    spark.range(1000).write.parquet(f"{tmp_path}/few.parquet")
    assert views.tasks(spark, str(tmp_path), "few") == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert views.tasks(spark, str(tmp_path), "few", rows=30) == 34


def test_dealt_out_latest_and_movement_are_the_same(spark):
    quotes, order = _quotes(spark), ["at", "seq"]
    plain = history.latest(quotes, ["event", "side", "book"], order, ["odds", "at"])
    dealt = history.latest(quotes, ["event", "side", "book"], order, ["odds", "at"], tasks=13)
    assert dealt.columns == plain.columns and sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))
    # An aggregation by the first column of the series keeps the layout: no step falls back to the fixed number.
    assert dealt.groupBy("event").agg(F.max("odds")).rdd.getNumPartitions() == 13
    moved = history.line_movement(quotes, ["side", "book"], "at", order)
    spread = history.line_movement(quotes, ["side", "book"], "at", order, tasks=13)
    assert spread.columns == moved.columns and sorted(map(str, spread.collect())) == sorted(map(str, moved.collect()))
