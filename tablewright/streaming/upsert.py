"""Streams into a catalog table: every micro-batch is one conflict-aware insert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablewright.catalog import Inserting


def stream_upsert(stream: DataFrame, into: Inserting, checkpoint: str, latest_by: str | None = None, once: bool = False) -> StreamingQuery:
    """Start a query that upserts each micro-batch. latest_by: of several rows of a key the one with the largest value stays.

    Replayed batches are harmless for UPDATE from the incoming row and for NOTHING.
    """

    def write(batch: DataFrame, _: int) -> None:
        if latest_by:
            key = into.spec.key(into.table.declared)
            names = [f"_k{i}" for i in range(len(key.parts))]
            keyed = batch.withColumns(dict(zip(names, key.columns())))
            picked = keyed.groupBy(*names).agg(F.max_by(F.struct(*batch.columns), latest_by).alias("_row"))
            batch = picked.select("_row.*")
        into.bulk_insert(batch)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
