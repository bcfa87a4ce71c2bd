"""What is dear per row is computed once: lines and own outcomes of the nested feed, and trimming."""

from pyspark.sql import functions as F

from fairline.functions import text
from fairline.sources import nested_feed


def test_lines_and_own_outcome_are_looked_up_once(spark):
    outcomes, selection = F.col("outcomes"), F.col("selection")
    assert str(nested_feed.total_line(outcomes)).count("array_distinct(") == 1
    assert str(nested_feed.spread_line(outcomes)).count("array_distinct(") == 2
    # One look-up by source id, one by type.
    assert str(nested_feed._meant_selection(selection, outcomes, F.col("market_type"))).count("filter(") == 2


def test_strip_trims_every_space_and_only_spaces(spark):
    inner = ["a", "a b", "~", "!", "é", "aé", "éa", "\x7f", "\x1b", "İx", "𝒳"]
    ends = ["", " ", "\t\r\n", "\x0b\x0c", "\x1c\x1d\x1e\x1f", "\x85", "\xa0", " ", "　", "   "]
    values = [None, *ends, *[left + word + right for word in inner for left in ends for right in ends]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = rows.select("i", text.strip(F.col("v")).alias("s"), text.blank_to_null(F.col("v")).alias("b")).orderBy("i").collect()
    wanted = [None if v is None else v.strip() for v in values]
    assert [r["s"] for r in got] == wanted
    assert [r["b"] for r in got] == [w or None for w in wanted]
