"""Incremental harvest: streamed comment pages, exactly-once ids, keep-first upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlens.session import shared_dir


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write a stream to Parquet until its source has no more, then stop."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def without_repeats(stream: DataFrame, key: str, at: str, delay: str = "7 days") -> DataFrame:
    """Each key once, among rows whose times differ by less than the delay; the state is bounded by the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def upsert_ignore(stream: DataFrame, key: str, path: str, checkpoint: str) -> None:
    """Append per micro-batch the rows whose key the target does not hold; one row per key within the batch.

    A batch that is run again after a failure finds its own rows in the target and adds none.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        columns = [c for c in batch.columns if c != key]
        one = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*columns)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            one = one.join(spark.read.schema(one.schema).parquet(path).select(key), key, "left_anti")
        one.write.mode("append").parquet(path)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
