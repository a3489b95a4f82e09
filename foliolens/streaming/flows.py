"""Stateless and windowed stream flows, and the sinks that run them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import work_folder


def file_stream(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int = 1000) -> DataFrame:
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder))


def dedupe_stream(stream: DataFrame, keys: list[str], event_time: str, delay: str = "1 hour") -> DataFrame:
    """First arrival of each key among events that are at most ``delay`` apart; older state is dropped."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def keep_first(rows: DataFrame, keys: list[str], event_time: str, apart: str, order: list[str], delay: str | None = None) -> DataFrame:
    """The first row by event time (ties by ``order``) of each key and burst: rows of a key at most ``apart`` from the one before.

    Whole rows with all columns. On a stream (``delay``: how late rows may come) a burst comes out when the watermark has
    passed its end, so an early row that arrives late still counts; rows later than that are dropped. The first row is a
    minimum per session, which combines before the shuffle.
    """
    df = rows.withWatermark(event_time, delay) if delay else rows
    columns = rows.columns
    least = F.min_by(F.struct(*columns), F.struct(event_time, *order)).alias("_first")
    return df.groupBy(F.session_window(event_time, apart).alias("_span"), *[F.col(k).alias(f"_key_{k}") for k in keys]).agg(least).select("_first.*")


def finding_rates(findings: DataFrame, event_time: str, by: list[str], window: str, slide: str | None = None, delay: str | None = None) -> DataFrame:
    """Counts per rule and event-time window; with ``delay``, later rows are dropped on a stream."""
    df = findings.withWatermark(event_time, delay) if delay else findings
    span = F.window(event_time, window, slide) if slide else F.window(event_time, window)
    return df.groupBy(span.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")


def finding_sessions(findings: DataFrame, event_time: str, by: list[str], gap: str, delay: str | None = None) -> DataFrame:
    """Bursts of findings: sessions that end after ``gap`` without one."""
    df = findings.withWatermark(event_time, delay) if delay else findings
    return df.groupBy(F.session_window(event_time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")


def stream_findings(stream: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """Row rules on arriving rows: one finding per rule whose condition holds."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]))
    return stream.select(*keys, F.explode(found).alias("rule"))


def to_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over what is available and append its output, exactly once, to parquet files."""
    return (stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def upsert(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Write what each micro-batch changes under the number of the batch, so a repeated batch overwrites itself; ``latest`` reads it."""
    return (stream.writeStream.foreachBatch(upsert_batch(path)).outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def upsert_batch(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last written row of each key in a folder of ``upsert``."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v")).select(*keys, "_v.*") if values else rows.select(*keys).distinct()


def rates_batch(path: str, event_time: str, by: list[str], window: str, delay: str) -> Callable[[DataFrame, int], None]:
    """Batch function that counts rows on time by window and keeps late rows aside.

    A row is late if it is older than the watermark: the greatest event time of earlier batches less ``delay``. Per batch, under
    its number, are written: ``rows`` (split by ``late``), from these its counts (``rates``) and its greatest event time
    (``high``). Earlier batches only are read, so a repeated batch writes the same again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        high = None
        if batch_id:
            earlier = spark.read.schema("high timestamp, batch int").parquet(f"{path}/high").where(F.col("batch") < batch_id)
            high = earlier.agg((F.max("high") - F.expr(f"INTERVAL {delay}")).alias("w")).first()["w"]
        late = F.coalesce(F.col(event_time) < F.lit(high), F.lit(False)) if high is not None else F.lit(False)
        part = f"{path}/rows/batch={batch_id}"
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(part)
        done = spark.read.schema(batch.schema.add("late", "boolean") if "late" not in batch.columns else batch.schema).parquet(part)
        finding_rates(done.where(~F.col("late")), event_time, by, window).write.mode("overwrite").parquet(f"{path}/rates/batch={batch_id}")
        done.agg(F.max(event_time).alias("high")).write.mode("overwrite").parquet(f"{path}/high/batch={batch_id}")
    return write


def rates_with_late(stream: DataFrame, path: str, checkpoint: str, event_time: str, by: list[str], window: str, delay: str) -> StreamingQuery:
    """Counts by window, exactly once, and a side output of late rows; ``read_rates`` and ``read_late`` give both."""
    return (stream.writeStream.foreachBatch(rates_batch(path, event_time, by, window, delay)).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_rates(spark: SparkSession, path: str, by: list[str]) -> DataFrame:
    return spark.read.parquet(f"{path}/rates").groupBy("window_start", "window_end", *by).agg(F.sum("n").alias("n"))


def read_late(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").where(F.col("late").cast("boolean")).drop("late", "batch")


def in_steps(parts: list[DataFrame], folder: str, start: Callable[[], StreamingQuery]) -> None:
    """Write tables to the folder of a stream one after the other; after each, ``start`` runs the stream over it from its checkpoint."""
    for part in parts:
        part.write.mode("append").parquet(folder)
        start().awaitTermination()


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Drain a stream into parquet files and return them as a table."""
    spark = stream.sparkSession
    folder = work_folder(spark, name)
    to_parquet(stream, folder + "/out", folder + "/state").awaitTermination()
    return spark.read.schema(stream.schema).parquet(folder + "/out")
