"""Changes that arrive as a stream go into the overlay, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.engine import Engine


def ingest_changes(engine: Engine, changes: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """changes: a stream (path, content), perhaps with a sequence that orders changes of one path within a batch; a null content
    deletes. The overlay keeps the number of the last batch beside the changes, so one that runs again after a failure changes nothing, and
    an engine over the same index folder goes on with all batches before."""

    def upsert(batch: DataFrame, number: int) -> None:
        more = [F.col("sequence")] if "sequence" in batch.columns else []
        engine.index_update_files(batch.select("path", F.col("content").cast("binary").alias("content"), F.lit(True).alias("is_file"), *more), number)

    writer = changes.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start() if trigger else writer.start()
