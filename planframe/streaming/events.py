"""Pipeline events and job operations as streams; each has a batch twin in ``planframe.operators.jobs``."""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from planframe.options import DEFAULTS, Options

#: Event kinds that a bus carries; others are passed over.
KINDS = ("stage_started", "stage_completed", "element_detected", "warning", "error", "job_completed")


def bus(events: DataFrame) -> DataFrame:
    """Known events only, of a stream or a table ``(job_id, event, ts, payload)``."""
    return events.where(F.col("event").isin(*KINDS))


def progress(events: DataFrame, late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """(window, event, n): counts in tumbling windows; events later than the watermark are dropped by Spark."""
    return bus(events).withWatermark("ts", late).groupBy(F.window("ts", window), "event").agg(F.count(F.lit(1)).alias("n"))


def routed(events: DataFrame, links: DataFrame) -> DataFrame:
    """A stream of events with the users that watch their job: a join with a table of (job_id, user_id)."""
    return events.join(links, "job_id")


def store(ops: DataFrame) -> DataFrame:
    """(job_id, data, created_ord, accessed_ord) after each batch of ``ops(job_id, ord, op, payload)``: the job store as keyed state.

    put replaces the data, update merges keys and is passed over before the first put, get and update touch,
    contains does not. Operations of a job are taken in the order of ``ord`` within each batch. A job stays for good;
    ``state.VersionedStore`` is the store that evicts.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        data, created, accessed = state.get if state.exists else (None, None, None)
        rows = pd.concat(list(parts)).sort_values("ord")
        for ord_, op, payload in rows[["ord", "op", "payload"]].itertuples(index=False):
            if op == "put":
                data, created, accessed = payload, ord_ if created is None else created, ord_
            elif data is not None and op in ("update", "get"):
                if op == "update":
                    data = json.dumps(json.loads(data) | json.loads(payload))
                accessed = ord_
        if data is not None:
            state.update((data, int(created), int(accessed)))
            yield pd.DataFrame({"job_id": [key[0]], "data": [data], "created_ord": [int(created)], "accessed_ord": [int(accessed)]})

    return ops.groupBy("job_id").applyInPandasWithState(
        fold, "job_id long, data string, created_ord long, accessed_ord long", "data string, created_ord long, accessed_ord long", "update", GroupStateTimeout.NoTimeout
    )


def chat_sessions(messages: DataFrame, late: str = "1 hour", options: Options = DEFAULTS) -> DataFrame:
    """(user_id, session, n): sessions that end after the time-to-live without a message."""
    return messages.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", f"{options.session_minutes} minutes").alias("session")).agg(F.count(F.lit(1)).alias("n"))
