"""The life of postings as a stateful stream: what lifecycle.history() says of all runs, kept up run by run.

The log is a stream of rows: sightings (company, job_id, run), and after those of a run the run itself
(job_id null; success, complete, n). State is dealt to (company, shard of the posting), so that a company
with a third of all postings is not one task's; a run's row goes to all its shards. A shard keeps its
company's clock, which a run that may remove advances, and for each posting the clock when it was seen
last: its misses are the difference. Sightings wait for their run to end. A run
that may remove also drops what has now missed too often: no timer is needed, as nothing is missed between
runs. Ids and runs may come again: a run that has ended is passed over."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.lifecycle import COLLAPSE_FROM, COLLAPSE_SHARE, MISSES

LOG = "company string, job_id string, run long, success boolean, complete boolean, n long"
CHANGES = "company string, job_id string, run long, event string, first_seen long, last_seen long, clock long"
SHARDS = 16
_NAMES = ["company", "job_id", "run", "event", "first_seen", "last_seen", "clock"]


class Postings(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "clock long, previous long, run long")
        self.jobs = handle.getMapState("jobs", "job_id string", "first_seen long, last_seen long, clock long")
        self.waiting = handle.getMapState("waiting", "run long, job_id string", "here boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clock, previous, ended = self.clock.get() if self.clock.exists() else (0, None, None)
        runs: dict[int, tuple] = {}
        seen: dict[int, set[str]] = {}
        for chunk in rows:
            for job, run, success, complete, n in zip(chunk.job_id, chunk.run, chunk.success, chunk.complete, chunk.n, strict=True):
                if ended is not None and run <= ended:
                    continue
                if isinstance(job, str):
                    seen.setdefault(int(run), set()).add(job)
                else:
                    runs[int(run)] = success is not None and bool(success), complete is not None and bool(complete), None if pd.isna(n) else int(n)
        last = max(runs, default=None)
        if runs:
            for run, job in [k for k, _ in self.waiting.iterator()]:
                if run <= last:
                    seen.setdefault(run, set()).add(job)
                    self.waiting.removeKey((run, job))
        for run in seen:  # these wait for their run to end
            if last is None or run > last:
                for job in seen[run]:
                    self.waiting.updateValue((run, job), (True,))
        out = []
        for run in sorted(runs):
            success, complete, n = runs[run]
            fell = previous is not None and n is not None and previous >= COLLAPSE_FROM and n < previous * COLLAPSE_SHARE
            step = int(success and complete and (n or 0) > 0 and not fell)
            if success and (n or 0) > 0:
                for job in sorted(seen.get(run, ())):
                    was = self.jobs.getValue((job,))
                    first = was[0] if was is not None and clock - was[2] < MISSES else run
                    self.jobs.updateValue((job,), (first, run, clock + step))
                    out.append((key[0], job, run, "seen", first, run, clock + step))
            clock, previous = clock + step, n if success else 0
            if key[1] == 0:
                out.append((key[0], None, run, "clock", None, None, clock))
            if step:
                out += self._gone(key[0], run, clock)
        if runs:
            self.clock.update((clock, previous, last))
        yield _frame(out)

    def _gone(self, company: str, run: int, clock: int) -> list[tuple]:
        """Forget what has missed too often by now."""
        gone = [(j[0], *v) for j, v in self.jobs.iterator() if clock - v[2] >= MISSES]
        for job, *_ in gone:
            self.jobs.removeKey((job,))
        return [(company, job, run, "removed", first, last, at) for job, first, last, at in gone]

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES).astype({c: "Int64" for c in ("run", "first_seen", "last_seen", "clock")})


def changes(log: DataFrame, shards: int = SHARDS) -> DataFrame:
    """log: a stream with the columns of LOG. Gives a stream of CHANGES: postings seen, clocks, postings removed.
    The state store has to be RocksDB (spark.sql.streaming.stateStore.providerClass)."""
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    own = F.when(F.col("job_id").isNull(), every).otherwise(F.array(F.pmod(F.xxhash64("job_id"), F.lit(shards)).cast("int")))
    dealt = log.where("company is not null and run is not null").withColumn("shard", F.explode(own))
    return dealt.groupBy("company", "shard").transformWithStateInPandas(Postings(), CHANGES, "append", "None")


def current(changed: DataFrame) -> DataFrame:
    """company, job_id, first_seen, last_seen, misses of the postings still there, by all changes so far."""
    seen = changed.where("event = 'seen'").groupBy("company", "job_id").agg(F.max_by(F.struct("first_seen", "last_seen", "clock"), "run").alias("s")).select("company", "job_id", "s.*")
    clocks = changed.where("event = 'clock'").groupBy("company").agg(F.max("clock").alias("now"))
    misses = F.col("now") - F.col("clock")
    return seen.join(clocks, "company").where(misses < MISSES).select("company", "job_id", "first_seen", "last_seen", misses.cast("int").alias("misses"))
