"""Feeds of several books as one set of source records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_books(feeds: dict[str, DataFrame]) -> DataFrame:
    """Records of every book with its code; all feeds share one record schema."""
    tagged = [df.withColumn("bookmaker_code", F.lit(code)) for code, df in feeds.items()]
    return reduce(DataFrame.unionByName, tagged)
