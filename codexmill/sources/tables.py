"""Table sources: Parquet tables of one directory, and the rows of them that hold now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One Parquet table of a data directory (a file or a folder of part files)."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer partitions than those, as small tables of long texts do.

    A table of many files is left as it is, so a large one is never shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def texts(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table whose rows take long to work through, such as texts."""
    return spread(table(spark, root, name))


def latest(df: DataFrame, keys: list[str], by: str | Column, *ties: str) -> DataFrame:
    """Per key the row with the greatest `by`; null `by` loses, ties go to the smallest `ties` columns.

    Rows with a null key are dropped. Extra columns are kept.
    """
    order = [(F.col(by) if isinstance(by, str) else by).desc_nulls_last(), *[F.col(t).asc_nulls_first() for t in ties]]
    w = Window.partitionBy(*keys).orderBy(*order)
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def latest_of(df: DataFrame, key: str, by: str, *values: str) -> DataFrame:
    """As latest(), for a few narrow columns: a hash aggregate that combines before the shuffle."""
    at = F.max(F.struct(F.col(by).isNotNull().alias("__has"), F.col(by).alias("__by"), *[F.col(v) for v in values]))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(at.alias("__m")).select(key, *[F.col(f"__m.{v}").alias(v) for v in values])
