"""Handlers of pipeline events, called in order for each micro-batch; one that fails is quarantined and the others go on."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planframe.streaming.events import bus

Handler = Callable[[DataFrame, int], None]


class Observer:
    """Which handlers an event has, in the order in which they were added.

    A handler takes the batch's rows of its event and the batch's number. What it raises becomes a row
    (batch_id, event, handler, error) of the table at ``quarantine``, with how many events it was given.
    """

    SCHEMA = "batch_id long, event string, place int, handler string, error string, n long"

    def __init__(self, quarantine: str):
        self.quarantine = quarantine
        self._handlers: dict[str, list[Handler]] = {}

    def on(self, event: str) -> Callable[[Handler], Handler]:
        """A decorator that adds a handler."""

        def add(handler: Handler) -> Handler:
            self.subscribe(event, handler)
            return handler

        return add

    def subscribe(self, event: str, handler: Handler) -> None:
        self._handlers.setdefault(event, []).append(handler)

    def dispatch(self, batch: DataFrame, batch_id: int) -> None:
        """For ``writeStream.foreachBatch`` over events ``(job_id, event, ts, payload)``; events that no handler waits for cost nothing."""
        wanted = bus(batch).where(F.col("event").isin(*self._handlers)).persist()
        try:
            there = {r[0]: r[1] for r in wanted.groupBy("event").count().collect()}  # a row for each kind of event
            failed = []
            for event, handlers in self._handlers.items():
                if event not in there:
                    continue
                rows = wanted.where(F.col("event") == event)
                for place, handler in enumerate(handlers):
                    try:
                        handler(rows, batch_id)
                    except Exception as e:  # whatever a handler raises must not keep the next from its events
                        failed.append((batch_id, event, place, getattr(handler, "__name__", type(handler).__name__), f"{type(e).__name__}: {e}"[:2000], there[event]))
            self._report(batch.sparkSession, failed, batch_id)
        finally:
            wanted.unpersist()

    def _report(self, spark: SparkSession, failed: list[tuple], batch_id: int) -> None:
        if failed:  # a batch that is replayed writes its own folder again
            spark.createDataFrame(failed, self.SCHEMA).coalesce(1).write.mode("overwrite").json(f"{self.quarantine}/batch={batch_id}")

    def failures(self, spark: SparkSession) -> DataFrame:
        """The rows of all batches so far."""
        return spark.read.schema(self.SCHEMA).option("recursiveFileLookup", "true").json(self.quarantine)
