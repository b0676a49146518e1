"""Stateless mapping on a file stream (§2.14): the reference has no streaming, so only the
stateless operators (term templates, triple mapping) run unchanged on a streaming DataFrame,
and "skip known ids" (C10) becomes ``dropDuplicates`` with state.

The stream is written with ``foreachBatch`` to a parquet table, one folder a batch; the checkpoint and the
table live under the session's ``spark.checkpoint.dir`` (the cluster's shared folder).
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from geoweave.session import ensure_checkpoint_dir

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def run_available(spark: SparkSession, source_dir: str, schema: str, transform, name: str,
                  file_glob: str = "*.parquet", dedupe_key: str | None = None, within: tuple[str, str] | None = None,
                  files_per_batch: int | None = None, progress: list | None = None) -> DataFrame:
    """Run ``transform`` over every file already in ``source_dir`` (trigger ``availableNow``),
    write each micro-batch to its own folder of a parquet table, and return that table.

    ``dedupe_key``: rows whose key was seen before are skipped; the state grows with the distinct keys.  With ``within`` =
    (time column, delay) the state is bounded: a key is remembered until the watermark (latest time seen less the delay) passes
    its first row's time by the delay, a replay inside that span is skipped, and rows older than the watermark are dropped as late.
    The time column must be an instant (``timestamp``).  ``files_per_batch`` bounds a micro-batch; ``progress`` collects each batch's
    rows in state."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    run = f"{base}/stream-{name}-{uuid.uuid4().hex[:8]}"
    out_path, ckpt = f"{run}/table", f"{run}/_checkpoint"
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    stream = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(source_dir)
    if dedupe_key and within:
        stream = stream.withWatermark(*within).dropDuplicatesWithinWatermark([dedupe_key])
    elif dedupe_key:
        stream = stream.dropDuplicates([dedupe_key])
    mapped = transform(stream)

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")  # a batch that is retried replaces itself

    q = mapped.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    if progress is not None:
        progress.extend(op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"])
    try:
        return spark.read.parquet(out_path).drop("epoch")
    except AnalysisException:  # no micro-batch had rows: nothing was written
        return spark.createDataFrame([], mapped.schema)
