"""Reading, staging and row identity shared by the operators."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairline.session import shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs neither replay it nor depend on one executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/fairline-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.stage_path = path
    return staged


def release(*staged: DataFrame) -> None:
    """Delete stages whose last reader has been written itself.

    Spark deletes the shuffle files of finished jobs only once the driver's JVM has collected what refers to them, so that is asked for.
    """
    spark = staged[0].sparkSession
    for df in staged:
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stage_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    for _ in range(2):  # what the first collection finalises goes in the second
        gc.collect()
        spark._jvm.System.gc()


def whole(df: DataFrame, name: str = "row") -> Column:
    """All columns of ``df`` as one struct, so that no helper column can clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def keys(*columns) -> list[Column]:
    """A 128-bit identity of the given values as two longs ``k1`` and ``k2``; nulls count as values."""
    parts = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit(0x5BD1E995), *parts).alias("k2")]


def put(df: DataFrame, row: str, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of struct ``row`` again, some of them replaced."""
    return df.select(*[(changed[c] if c in changed else F.col(f"{row}.`{c}`")).alias(c) for c in columns])


BATCH_ROWS = 1000


def mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` in batches of BATCH_ROWS rows: texts are long, and a batch is held by the JVM and the worker at once.

    Spark has this as a setting of the session only, so it stays set there.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(function, schema)
