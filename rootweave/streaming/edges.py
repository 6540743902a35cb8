"""Edge table that grows with a stream of payload files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rootweave.sources.payload import payload_edges
from rootweave.sources.sinks import flush_edges


def payload_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """JSON lines ``code, payload`` as they arrive in ``folder``."""
    return spark.readStream.schema("code string, payload string").option("maxFilesPerTrigger", files_per_batch).json(folder)


def grow_edges(payloads: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Flush each micro-batch's edges into ``table``. Merging is idempotent, so a batch that runs again after a
    failure changes nothing. Ends when the files that are there are done."""
    return (
        payloads.writeStream.foreachBatch(lambda batch, _: flush_edges(payload_edges(batch), table))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
