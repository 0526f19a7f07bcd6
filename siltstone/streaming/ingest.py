"""Change logs as streams: every micro-batch is one commit, and a collection's live rows follow.

A batch that is replayed after a failure is not taken again: the manifest keeps the number of the last batch of each
source, under the name of the stream's checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.collection import Collection


def into_collection(stream: DataFrame, collection: Collection, checkpoint: str, to_log: Callable[[DataFrame], DataFrame] | None = None, compact: bool = True, **trigger) -> StreamingQuery:
    """Start appending a stream of log entries (id, op, pos, touched and typed columns).

    Without a trigger, everything that is there is taken and the query ends.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        entries = to_log(batch) if to_log else batch
        if entries.isEmpty():
            return
        collection.append(entries, source=(checkpoint, batch_id))
        if compact and collection.needs_compaction():
            collection.compact(build_index=False)

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()
