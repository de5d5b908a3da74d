"""Incremental append of unseen keys from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from leaguelens.operators.common import Order
from leaguelens.sources.key_index import KeyIndex


def stream_append_new(stream: DataFrame, target: str, keys: Order, checkpoint: str) -> StreamingQuery:
    """Append the rows of a stream whose key the target lacks.

    Each batch is matched against the index of the target's keys, so a batch that is
    replayed after a failure adds nothing twice and no batch reads the target's rows.
    """
    index = KeyIndex(target, stream.schema, keys)

    def append(batch: DataFrame, _: int) -> None:
        index.append(batch)

    return (
        stream.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
