"""Derived relations from a stream of spans.

``maintain`` appends each micro-batch's partial aggregates, tagged by batch id: no state is kept between batches, late spans
need no watermark, and a batch that is retried replaces its own files, so each span counts once. Views and checkpoint belong
together: a stream that starts from a new checkpoint reads all files again and needs an empty folder for its views. ``windowed_counts`` is
the stateful form for consumers that want finished windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.operators.views import VIEWS
from spanloom.sources.spans import SPAN_SCHEMA


def stream_spans(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Spans from a folder of Parquet files as they arrive."""
    reader = spark.readStream.schema(SPAN_SCHEMA)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def write_partials(spans: DataFrame, batch: int, out: str) -> None:
    """The partials of one batch for every view; writing the same batch again replaces it."""
    spans.persist()
    try:
        for name, (partials, _) in VIEWS.items():
            partials(spans).write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")
    finally:
        spans.unpersist()


def maintain(stream: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts maintaining all views below ``out``. ``once``: what is there now, then stop."""
    writer = stream.writeStream.foreachBatch(lambda df, batch: write_partials(df, batch, out)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def backfill(spans: DataFrame, out: str) -> bool:
    """Partials of spans that were there before the stream, as a batch of their own; False, and nothing is done, where ``out`` has views
    already. The stream must then begin with files that hold none of these spans."""
    spark = spans.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if any(fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{name}")) for name in VIEWS):
        return False
    write_partials(spans, -1, out)
    return True


def read_view(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The view, its partials added up."""
    return VIEWS[name][1](spark.read.parquet(f"{out}/{name}").drop("batch"))


def windowed_counts(stream: DataFrame, key: str = "service", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and key, with a watermark that bounds the state."""
    timed = stream.withColumn("ts", F.timestamp_micros(F.expr("start_ns div 1000"))).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), key).agg(F.count("*").alias("span_count")).select(F.col("window.start").alias("window_start"), key, "span_count")
