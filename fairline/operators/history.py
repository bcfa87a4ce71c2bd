"""Append-only quote history.

Per-series order is computed in two levels: inside (series, time slice), and across the slices'
one-row summaries. A series holding a third of all quotes is then spread over its slices instead
of being sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "day"


def first_per_key(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of every key; the earliest writer wins. Aggregates map-side."""
    rest = [c for c in df.columns if c not in key]
    return (
        df.groupBy(*key)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__first"))
        .select(*key, "__first.*")
        .select(*df.columns)
    )


def append_unseen(history: DataFrame, incoming: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """Rows of ``incoming`` whose key the history lacks, one per key."""
    return first_per_key(incoming, key, order).join(history.select(*key), key, "left_anti")


def _with_slice(df: DataFrame, time: str, unit: str) -> DataFrame:
    return df.withColumn("__slice", F.date_trunc(unit, F.col(time)))


def _dealt(df: DataFrame, tasks: int | None, *key: str) -> DataFrame:
    """Rows dealt out by key over so many tasks; without a number Spark's own shuffles decide."""
    return df if tasks is None else df.repartition(tasks, *key)


def _carried(df: DataFrame, series: list[str], summary: dict[str, tuple[Column, str]]) -> DataFrame:
    """Join to each row what earlier slices of its series hold: name -> (aggregate, last|first|max|min)."""
    slices = df.groupBy(*series, "__slice").agg(*(agg.alias(name) for name, (agg, _) in summary.items()))
    before = Window.partitionBy(*series).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    pick = {
        "last": lambda c: F.last(c, ignorenulls=True).over(before),
        "first": lambda c: F.first(c, ignorenulls=True).over(before),
        "max": lambda c: F.max(c).over(before),
        "min": lambda c: F.min(c).over(before),
    }
    earlier = slices.select(*series, "__slice", *(pick[how](name).alias(name) for name, (_, how) in summary.items()))
    return df.join(earlier, [*series, "__slice"])


def change_only(
    quotes: DataFrame, series: list[str], time: str, order: list[str], unit: str = SLICE
) -> DataFrame:
    """Drop a quote that repeats the price and availability before it in its series."""
    state = F.struct("decimal_odds", "is_available")
    rows = _carried(
        _with_slice(quotes, time, unit), series, {"__carried": (F.max_by(state, F.struct(*order)), "last")}
    )
    within = Window.partitionBy(*series, "__slice").orderBy(*order)
    previous = F.coalesce(F.lag(state).over(within), F.col("__carried"))
    return (
        rows.withColumn("__previous", previous)
        .filter(F.col("__previous").isNull() | ~F.col("__previous").eqNullSafe(state))
        .select(*quotes.columns)
    )


def line_movement(
    quotes: DataFrame, series: list[str], time: str, order: list[str], unit: str = SLICE, tasks: int | None = None
) -> DataFrame:
    """Step, move since opening, running high and low of each priced quote within its series.

    ``tasks`` deals the slices out, so that neither their summaries nor their windows sort more than their share in one task.
    """
    price = F.col("decimal_odds")
    rank = F.struct(*order)
    rows = _carried(
        _dealt(_with_slice(quotes.filter(price.isNotNull()), time, unit), tasks, *series, "__slice"),
        series,
        {
            "__last": (F.max_by("decimal_odds", rank), "last"),
            "__open": (F.min_by("decimal_odds", rank), "first"),
            "__high": (F.max("decimal_odds"), "max"),
            "__low": (F.min("decimal_odds"), "min"),
        },
    )
    w = Window.partitionBy(*series, "__slice").orderBy(*order)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    out = (
        rows.withColumn("previous_odds", F.coalesce(F.lag("decimal_odds").over(w), F.col("__last")))
        .withColumn("open_odds", F.coalesce(F.col("__open"), F.first("decimal_odds").over(running)))
        .withColumn("high_odds", F.greatest(F.col("__high"), F.max("decimal_odds").over(running)))
        .withColumn("low_odds", F.least(F.col("__low"), F.min("decimal_odds").over(running)))
    )
    return (
        out.withColumn("step", (price - F.col("previous_odds")).cast("decimal(18,8)"))
        .withColumn("move", (price - F.col("open_odds")).cast("decimal(18,8)"))
        .drop("__slice", "__last", "__open", "__high", "__low")
    )


def latest(
    quotes: DataFrame, series: list[str], order: list[str], values: list[str], tasks: int | None = None, unit: str = SLICE
) -> DataFrame:
    """Latest row per series. ``max_by`` aggregates map-side, so a hot series is never sorted.

    Spark sorts for it, on both sides of a shuffle into a fixed number of partitions. With ``tasks`` the rows are dealt out over so
    many instead: by the first column of the series and time slice, so that a hot one is spread, and what is newest in its slice
    by that column alone. The result keeps that layout: aggregations by this column need no further shuffle.
    """

    def newest(df: DataFrame, key: list[str], kept: list[str]) -> DataFrame:
        return df.groupBy(*key).agg(F.max_by(F.struct(*kept), F.struct(*order)).alias("__last")).select(*key, "__last.*")

    if tasks is None:
        return newest(quotes, series, values)
    sliced = _dealt(_with_slice(quotes, order[0], unit), tasks, series[0], "__slice")
    found = newest(sliced, [*series, "__slice"], list(dict.fromkeys([*order, *values])))
    return newest(_dealt(found, tasks, series[0]), series, values)


def sessions(rows: DataFrame, series: list[str], time: str, gap_seconds: int, unit: str = SLICE) -> DataFrame:
    """Runs of rows less than a gap apart: ``session_start``, ``last_quote`` and ``n_quotes``.

    Runs are cut inside (series, time slice) first. Across slices only these runs are ordered and stitched, of which a slice has no
    more than its length divided by the gap.
    """
    apart = lambda at, before: before.isNull() | (at - before >= gap_seconds * 1_000_000)
    timed = _with_slice(rows, time, unit).withColumn("__at", F.unix_micros(F.col(time).cast("timestamp")))
    inside = Window.partitionBy(*series, "__slice").orderBy("__at")
    begun = timed.withColumn("__new", apart(F.col("__at"), F.lag("__at").over(inside)).cast("int"))
    numbered = begun.withColumn("__run", F.sum("__new").over(inside))
    runs = numbered.groupBy(*series, "__slice", "__run").agg(
        F.min(time).alias("__first"), F.max(time).alias("__last"), F.min("__at").alias("__from"), F.max("__at").alias("__to"), F.count("*").alias("__n")
    )
    across = Window.partitionBy(*series).orderBy("__from")
    stitched = runs.withColumn("__new", apart(F.col("__from"), F.lag("__to").over(across)).cast("int"))
    stitched = stitched.withColumn("__session", F.sum("__new").over(across))
    return stitched.groupBy(*series, "__session").agg(
        F.min("__first").alias("session_start"), F.max("__last").alias("last_quote"), F.sum("__n").alias("n_quotes")
    ).drop("__session")


def as_of(
    quotes: DataFrame, moment: Column, time: str, series: list[str], order: list[str], values: list[str], tasks: int | None = None
) -> DataFrame:
    """Latest row per series not after one moment; the bound reaches the scan."""
    return latest(quotes.filter(F.col(time) <= moment), series, order, values, tasks)


def as_of_join(
    probes: DataFrame,
    quotes: DataFrame,
    series: list[str],
    probe_time: str,
    order: list[str],
    values: list[str],
    unit: str = SLICE,
) -> DataFrame:
    """For every probe row the last quote of its series at or before its own time, as ``quote``.

    ``order`` starts with the quote's time. One union and one window: linear in both sides, where
    a range join would pair every probe with every earlier quote.
    """
    others = [c for c in probes.columns if c not in series]
    quote_rows = quotes.select(
        *series, F.col(order[0]).alias("__t"), F.struct(*order, *values).alias("__q")
    )
    probe_rows = probes.select(*series, F.col(probe_time).alias("__t"), F.struct(*others).alias("__p"))
    merged = _with_slice(quote_rows.unionByName(probe_rows, allowMissingColumns=True), "__t", unit)
    rows = _carried(merged, series, {"__carried": (F.max("__q"), "last")})
    # A quote at the probe's own time counts, so quotes sort before probes.
    w = (
        Window.partitionBy(*series, "__slice")
        .orderBy("__t", F.col("__p").isNotNull(), F.col("__q"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        rows.withColumn("quote", F.coalesce(F.last("__q", ignorenulls=True).over(w), F.col("__carried")))
        .filter(F.col("__p").isNotNull())
        .select(*series, "__p.*", "quote")
    )
