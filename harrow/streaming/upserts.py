"""The store fed by a stream: each micro-batch is one upsert and one commit.

The recorded source is a stream of files; the query's checkpoint gives each batch an id. A store in buckets
remembers the last one with its version, so a batch that is replayed after a failure is passed over; another
store upserts its rows again, which moves last_seen where the batch's moment is the clock's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lifecycle
from ..operators.buckets import BucketStore
from ..operators.store import Store


def start(records: DataFrame, store: Store, checkpoint: str, time: str | None = None, name: str = "stream"):
    """records: a streaming DataFrame with the columns that upsert() takes, and `seq`. A batch's moment, which
    first_seen and last_seen take, is when it is processed, or the largest value of the column `time`.
    A store in buckets rewrites only those of the batch's companies; `name` tells several streams apart."""

    def one(batch: DataFrame, batch_id: int) -> None:
        told = batch.agg(F.max(time)).first()[0] if time else None
        now = F.current_timestamp() if told is None else F.lit(told)
        upserted = lambda state: lifecycle.upsert(state, batch, now).drop("change")
        if not isinstance(store, BucketStore):
            store.commit(upserted(store.read()))
        elif batch_id > store.last_batch(name):
            store.update(batch.select(store.key), upserted, (name, batch_id))

    return records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sightings(events: DataFrame, delay: str = "1 day", window: str = "1 day") -> DataFrame:
    """Postings seen per company and window, late rows up to `delay` counted, for a streaming twin of the run log."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "company").agg(F.approx_count_distinct("job_id").alias("n"))
