"""Streams of reads and reinforcements into the operation log of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def log_stream(rows: DataFrame, store: Store, name: str, checkpoint: str, compact_every: int = 100, once: bool = False) -> StreamingQuery:
    """Start a query that adds a stream of log rows (see `operators.oplog`) to a store, each batch once: a batch that was
    cut off is written again in its own place, one that a version has in it already is left out.

    After every `compact_every` batches the log is folded into a new version (0: never), so that its number of folders
    stays bounded. The name goes with the checkpoint: a stream that starts without one takes a new name. once: end when
    what is there now is read."""

    def add(df: DataFrame, n: int) -> None:
        store.append_log(df, stream=name, batch=n)
        if compact_every and (n + 1) % compact_every == 0:
            store.compact()

    writer = rows.writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(add)
    return (writer.trigger(availableNow=True) if once else writer).start()
