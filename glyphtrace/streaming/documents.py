"""The stateless part of the pipeline over a stream of files: context, features and rules of each new text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import documents, features, lexicon


def read(spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def feature_rows(texts: DataFrame, key: str) -> DataFrame:
    """The long table of features of each row; no state, so a batch's rows depend on nothing else."""
    return features.long_table(features.with_features(lexicon.without_hits(documents.context(texts))), [key])


def write(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends each batch as Parquet; a batch that is run again replaces nothing and adds nothing."""
    out = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime="30 seconds")).start()
