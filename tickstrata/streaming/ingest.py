"""Continuous ingest: files of source messages to the store.

Each micro-batch is parsed, validated and published as one version under its query and batch id, so a batch that is run
again after a failure is not stored twice, and batches of another query are never taken for it. Late events go to their
old shard, however late. The register lists of new devices are stored with their first rows.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tickstrata.model import SOURCE_MESSAGE
from tickstrata.sources.messages import ingest
from tickstrata.sources.store import Store


def read_messages(spark: SparkSession, folder: str, files_per_batch: int = 100, bytes_per_batch: int | None = None) -> DataFrame:
    """A batch, and so a run, has at most so many files, or with `bytes_per_batch` about so many bytes."""
    limit = ("maxBytesPerTrigger", bytes_per_batch) if bytes_per_batch else ("maxFilesPerTrigger", files_per_batch)
    return spark.readStream.schema(SOURCE_MESSAGE).option(*limit).json(folder)


def start(
    messages: DataFrame, store: Store, checkpoint: str, quarantine: str | None = None, now_ms: int | None = None, source: str | None = None, every: str | None = None
) -> StreamingQuery:
    """Store all messages that are there, then stop; with `every` (such as "10 seconds") go on until stopped.

    now_ms: fixes the clock of the future check. source: the name that batches are known by; by default the query's own id, which
    its checkpoint keeps.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        name = source or df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        now = now_ms if now_ms is not None else time.time_ns() // 1_000_000
        df = df.persist()
        try:
            found = ingest(df, now)
            store.append(found.rows, batch_id=batch_id, source=name)
            if quarantine:
                found.quarantine.write.mode("overwrite").parquet(f"{quarantine}/source={name}/batch={batch_id}")
        finally:
            df.unpersist()

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()
