"""Arriving files as a stream, for the two things that are done batch by batch: appending to a
table and encoding what is new. The stream's checkpoint is the progress; a restarted run goes on
where it stopped, and rows already written are left out by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.encoders import Encoder, encode_items


def arriving(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def append_new(stream: DataFrame, target: str, key: str, checkpoint: str, make: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Appends ``make(rows)`` of rows whose key is not in ``target`` yet; processes what is
    there and stops. A batch that is run again after a failure adds nothing twice."""

    def write(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
        new = rows.where(f"{key} IS NOT NULL").dropDuplicates([key])
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            new = new.join(spark.read.parquet(target).select(key), key, "left_anti")
        make(new).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def encode_arriving(stream: DataFrame, target: str, encoder: Encoder, checkpoint: str) -> StreamingQuery:
    """Vectors of arriving (item_id, text)."""
    return append_new(stream, target, "item_id", checkpoint, lambda df: encode_items(df, encoder))
