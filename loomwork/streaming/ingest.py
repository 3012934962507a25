"""A stream into a versioned table: each micro-batch is one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..session import Session


def append_stream(session: Session, table: str, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream's rows to a table with the checks of INSERT.

    The table records the last batch of each stream, known by its checkpoint, so
    a batch that runs again after a crash adds nothing.
    """

    def add(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            session.append(table, batch, (checkpoint, number))

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
