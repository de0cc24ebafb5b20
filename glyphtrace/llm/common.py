"""What the operators share: reading tables, cutting lineage, joins whose broadcast side is checked, numbers within groups.

Cases: an empty table is written and read like any other, is small, and gives no numbers; nulls in keys are values of
their own; rows that tie get different numbers; texts of any length pass unread.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast only when it has at most this many rows, and as JSON at most this many bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a folder in the warehouse where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_cuts").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df as a table written in the shared folder: computed once, lineage ends here, lost executors don't matter."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df (a cut table) may be broadcast, by its counted rows and bytes."""
    return df.count() <= rows and (df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0) <= BROADCAST_BYTES


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (a cut table) with a broadcast hint if it is measured to be small; else as it is, for a shuffled join."""
    return F.broadcast(df) if small(df, rows) else df


def text_of(name: str = "text") -> Column:
    """The text, a null text being empty."""
    return F.coalesce(F.col(name), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many _ before it as make it none of df's columns."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null ids count as the text 'null'."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("null")), "utf-8")) % parts


def ranked(df: DataFrame, groups: list[str], order: list[str | Column]) -> DataFrame:
    """df, written, with a column slot: a row's number from 0 among the rows of its groups in the given order; ties in any order, but fixed.

    One sort by ranges over all groups, so neither a large group nor rows that tie in all keys (these also go by their
    place in the input) become one task's work. What a group has in the partitions before is summed over a table
    with one row for each partition and group. df must not have columns named slot, at__, part__, tie__ or first__.
    """
    rows = cut(df.withColumn("tie__", F.monotonically_increasing_id()))
    rows = cut(rows.orderBy(*(F.col(g).asc_nulls_first() for g in groups), *order, "tie__").drop("tie__").withColumn("at__", F.monotonically_increasing_id()))
    rows = rows.withColumn("part__", F.shiftright("at__", 33))
    parts = rows.groupBy("part__", *groups).agg(F.min("at__").alias("first__"), F.count("*").alias("n"))
    before = Window.partitionBy(*groups).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut(parts.select(F.col("part__").alias("p"), F.struct(*groups).alias("g"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first__")).alias("first__")))
    met = rows.join(sized(parts), (F.col("part__") == F.col("p")) & F.struct(*groups).eqNullSafe(F.col("g")))
    return met.withColumn("slot", F.col("at__") + F.col("first__")).drop("at__", "part__", "p", "g", "first__")
