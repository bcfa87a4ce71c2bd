import datetime

import duckdb

from fairline.plans.catalog_identity import QUERIES


def test_season_country_tokens_reads_orders_only(spark, tmp_path):
    rows = [(key, key + 5, "O", 1.0, datetime.datetime(1996 + key % 5, 3, 1), name) for key, name in enumerate(["1-URGENT", "4-NOT SPECIFIED", "low", "2-HIGH"] * 2)]
    columns = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/orders.parquet")
    build, sql = QUERIES["season_country_tokens"]
    with duckdb.connect() as connection:
        connection.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
        expected = connection.execute(sql).fetchall()
    found = [tuple(r) for r in build(spark, str(tmp_path)).collect()]
    assert len(expected) == 8 and sorted(found) == sorted(expected)
