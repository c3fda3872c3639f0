"""Bounded stages over arriving files.

There is no operator of time, watermark or state in this engine's domain. What a stream
needs is to run a bounded stage on each batch of new reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def each_batch(spark: SparkSession, path: str, schema: str, stage: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Applies stage to each batch of new Parquet files under path, until none is left, and
    appends the result under out, one folder a batch, written over if a batch is run again."""

    def write(df: DataFrame, batch: int) -> None:
        stage(df).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    stream = spark.readStream.schema(schema).parquet(path)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
