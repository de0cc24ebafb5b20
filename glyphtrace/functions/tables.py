"""Tables that a job writes on its way."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it is counted to have at most so many rows and, as JSON, bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32_000_000


def written(df: DataFrame) -> DataFrame:
    """df as a table in the folder that executors share (spark.checkpoint.dir, else the warehouse): computed once, however often it is read."""
    conf = df.sparkSession.conf
    top = conf.get("spark.checkpoint.dir", None) or f"{conf.get('spark.sql.warehouse.dir')}/_written"
    path = f"{top.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is measured to be small; else as it is, for a shuffled join."""
    n = df.limit(rows + 1).agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if n[0] <= rows and (n[1] or 0) <= BROADCAST_BYTES else df
