"""Aggregates kept up to date by what each micro-batch adds, exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quarrylode.operators.versioned import VersionedTable


def keep_up(feed: DataFrame, name: str, partial: Callable[[DataFrame], DataFrame], table: VersionedTable, combine: dict[str, str], checkpoint: str, once: bool = False, interval: str = "2 seconds") -> StreamingQuery:
    """Merges partial(batch), one row for each key, into the table, by the feed's name and epoch.

    Only buckets with keys of the batch are read and written. The version that a batch publishes
    names its epoch, so a batch that is run again after a failure changes nothing, whether it failed
    before or after it published. Several feeds may keep up one table, each under its own name.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        table.merge(partial(batch), combine, ledger=(name, epoch))

    writer = feed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
