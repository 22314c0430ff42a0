"""Pages as a stream: every page is searched on its own, so micro-batches give what one batch would."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def each_batch(pages: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Run a plan over each micro-batch of a streaming table and append its rows, tagged with the batch, as Parquet.

    A batch that is run again after a failure replaces its own rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
