"""Scoring pairs as they arrive.  Scores depend on nothing but the row, so no state and no watermark are needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kithline.plans.model import NameMatcher


def pair_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Pairs from Parquet files that are added to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def score_stream(pairs: DataFrame, matcher: NameMatcher, path: str, checkpoint: str, *, model: str = "ENS", threshold: float = 0.5, once: bool = False) -> StreamingQuery:
    """Writes the stream's rows with prob and decision as Parquet; once: ends when all that is there has been scored."""
    writer = matcher.transform(pairs, model=model, threshold=threshold).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
