"""Structured Streaming re-aims of the batch weather and history loaders.

L1: hourly observations -> tumbling one-day event-time windows (the hour
stamp is shifted back by one hour first), late rows dropped by the
watermark, closed windows appended to a sink.

L2: incremental history build - each micro-batch of new rows is normalised
and appended by ``foreachBatch`` with a per-batch count; progress lives in
the checkpoint so a restarted job resumes where it stopped.

Checkpoints and sinks go under the session's shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from herdflow.session import scratch_path


def daily_weather_stream(source: DataFrame, *, ts: str, stn: str, value_cols: dict[str, str],
                         watermark: str = "1 hour") -> DataFrame:
    """L1 logical plan on a streaming (or batch) DataFrame. ``value_cols`` maps
    output name -> 'max:<col>' / 'min:<col>' / 'avg:<col>'."""
    obs = source.select(F.col(stn).alias("stn"),
                        (F.col(ts).cast("timestamp") - F.expr("INTERVAL 1 HOUR")).alias("obs_time"),
                        *[F.col(spec.split(":", 1)[1]) for spec in value_cols.values()])
    aggs = []
    for out, spec in value_cols.items():
        fn, col = spec.split(":", 1)
        aggs.append(getattr(F, fn)(col).alias(out))
    return (obs.withWatermark("obs_time", watermark)
               .groupBy("stn", F.window("obs_time", "1 day"))
               .agg(*aggs, F.count(F.lit(1)).alias("n_obs")))


def run_available_now(stream: DataFrame, *, sink_format: str = "parquet", output_mode: str = "append",
                      name: str = "stream", timeout_s: float | None = None) -> str:
    """Run a streaming plan over everything available now and stop; returns
    the sink path (shared storage). Waits until it is done unless the caller
    sets ``timeout_s``."""
    spark = stream.sparkSession
    out = scratch_path(spark, f"{name}-out")
    ckpt = scratch_path(spark, f"{name}-ckpt")
    q = (stream.writeStream.format(sink_format).outputMode(output_mode)
               .option("path", out).option("checkpointLocation", ckpt)
               .trigger(availableNow=True).start())
    _finish(q, name, timeout_s)
    return out


def _finish(q: StreamingQuery, name: str, timeout_s: float | None) -> None:
    """Wait for the end of a query (a failure is raised)."""
    if timeout_s is None:
        q.awaitTermination()
    elif not q.awaitTermination(timeout_s):
        q.stop()
        raise TimeoutError(f"stream {name} did not finish in {timeout_s}s")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def file_stream(spark: SparkSession, path: str, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """Streaming scan of a file source with the schema taken from the data.

    The file source watches a folder or a glob; a single file is addressed
    as a one-file glob (``x.parque[t]``)."""
    schema = spark.read.format(fmt).load(path).schema
    r = spark.readStream.format(fmt).schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    base = path.rstrip("/").rsplit("/", 1)[-1]
    if "." in base and not any(ch in base for ch in "*?["):
        path = path.rstrip("/")
        path = f"{path[:-1]}[{path[-1]}]"
    return r.load(path)


def incremental_append(stream: DataFrame, *, normalise: Callable[[DataFrame], DataFrame], target: str,
                       counts: str, checkpoint: str, name: str = "history",
                       timeout_s: float | None = None) -> None:
    """L2: ``foreachBatch`` append of normalised rows plus one count row per
    batch (batch id, rows).

    ``checkpoint`` is the job's own folder: a later call with the same folder
    goes on after the last finished batch, reads only new files and numbers
    its batches on, so earlier rows stay."""
    spark = stream.sparkSession

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # Idempotent per batch: a replayed batch overwrites its own partition
        # (dynamic partition overwrite) instead of appending twice.
        rows = normalise(batch).withColumn("batch_id", F.lit(batch_id)).persist()
        try:
            (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                 .option("compression", "zstd").partitionBy("batch_id").parquet(target))
            n = rows.count()
        finally:
            rows.unpersist()
        (spark.createDataFrame([(batch_id, n)], "batch_id long, rows long")
              .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
              .partitionBy("batch_id").parquet(counts))

    q = (stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())
    _finish(q, name, timeout_s)
