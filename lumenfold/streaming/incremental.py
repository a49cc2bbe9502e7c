"""Extensions on Structured Streaming: entries as they arrive, late ones and repeats included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators.structured import latest, upsert


def stream_of(spark: SparkSession, path: str, schema, *, files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def without_repeats(entries: DataFrame, keys: list[str], time: str, late: str = "60 days") -> DataFrame:
    """First arrival of each key within the watermark; state older than it is dropped."""
    return entries.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, time: str, by: str, *, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and kind; works on a stream and on a table."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), by, "events", "total")


def sessions(events: DataFrame, time: str, by: str, *, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each key, ended by a gap."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("events")).select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def upsert_into(path: str, keys: list[str], order: str):
    """``foreachBatch`` function that merges each batch into the table at ``path``, the last record of a key winning."""
    from lumenfold.sources.tables import replace

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            replace(upsert(spark.read.schema(batch.schema).parquet(path), batch, keys, order), path)
        else:
            latest(batch, keys, order).write.parquet(path)

    return merge
