"""Resumable work as a stream: results appended once per item, however often and however late an item arrives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from verdigris.operators.jobs import pending
from verdigris.sources.records import path_of


def stream_once(items: DataFrame, key: str, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Write ``transform`` of every item of a stream to Parquet in ``out``, once for each key.

    Every batch leaves out the keys that have a result, by an anti-join with what is written; so no item is lost for being late,
    none is done twice for coming again, and a batch that is repeated after a failure adds only what it had not written.
    ``transform`` must keep the key. Progress is in ``checkpoint``: a restarted query goes on where it stopped. Runs through
    what is there and stops."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        folder, fs = path_of(spark, out)
        if fs.exists(folder):
            fresh = pending(fresh, spark.read.parquet(out), key)
        transform(fresh).write.mode("append").parquet(out)

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
