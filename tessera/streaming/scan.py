"""Cell sums that grow as bands arrive. A scan's sums, least and largest values add up, so a batch is summed on its own and merged."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.summary import scan


def stream_sums(bands: DataFrame, out: str, checkpoint: str):
    """Start a query that appends each batch's sums to the table at `out`; a batch that is run again replaces its own part. Read it with summary.merged()."""

    def write(batch: DataFrame, number: int) -> None:
        scan(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return bands.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
