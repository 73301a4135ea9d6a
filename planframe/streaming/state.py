"""Keyed state that ends: chat sessions, health of services, and a job store that evicts across all keys."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from planframe.operators import jobs
from planframe.options import DEFAULTS, Options

_SESSION = "status string, started timestamp, last timestamp, n long, snapshot string, roles array<string>, contents array<string>"
_SESSION_STATE = "started long, last long, n long, snapshot string, roles array<string>, contents array<string>"


def live_sessions(messages: DataFrame, late: str = "10 minutes", options: Options = DEFAULTS) -> DataFrame:
    """(user_id, status, started, last, n, snapshot, roles, contents) of a stream ``(user_id, ts, role, content, snapshot)``.

    A session lives until its user has said nothing for ``session_minutes``. It has the number of its messages, the last
    ``history`` of them and the latest snapshot that is not null. After each batch a live session gives a row
    open; one that a later message or the watermark finds over gives a row ended, and its state is gone. Messages
    of a batch are taken by time; one older than the session's last counts in it and moves nothing back.
    """
    idle = options.session_minutes * 60_000

    def row(user, status, s) -> tuple:
        return (user, status, pd.Timestamp(s[0], unit="ms", tz="UTC"), pd.Timestamp(s[1], unit="ms", tz="UTC"), s[2], s[3], list(s[4]), list(s[5]))

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session, out = (list(state.get) if state.exists else None), []
        if state.hasTimedOut:
            out.append(row(key[0], "ended", session))
            state.remove()
        else:
            rows = pd.concat(list(parts)).sort_values("ts", kind="stable")
            for ts, role, content, snapshot in zip(rows["ts"], rows["role"], rows["content"], rows["snapshot"], strict=True):
                at = int(pd.Timestamp(ts).timestamp() * 1000)
                if session is not None and at - session[1] > idle:
                    out.append(row(key[0], "ended", session))
                    session = None
                if session is None:
                    session = [at, at, 0, None, [], []]
                session[1], session[2] = max(session[1], at), session[2] + 1
                session[3] = session[3] if snapshot is None else snapshot
                session[4], session[5] = [*session[4], role][-options.history :], [*session[5], content][-options.history :]
            end = session[1] + idle
            if end < state.getCurrentWatermarkMs():
                out.append(row(key[0], "ended", session))
                if state.exists:
                    state.remove()
            else:
                state.update(tuple(session))
                state.setTimeoutTimestamp(end + 1)
                out.append(row(key[0], "open", session))
        yield pd.DataFrame(out, columns=["user_id", "status", "started", "last", "n", "snapshot", "roles", "contents"])

    dated = messages.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "role", "content", "snapshot").withWatermark("ts", late)
    return dated.groupBy("user_id").applyInPandasWithState(fold, f"user_id long, {_SESSION}", _SESSION_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def health(beats: DataFrame, silence_ms: int = 30_000) -> DataFrame:
    """(service, healthy, reason) of a stream ``(service, ts, healthy, error)``: a row whenever a flag is told anew.

    The latest beat of a batch tells: one with an error is not healthy. A service that has not been heard of for
    ``silence_ms`` of processing time is not healthy and its state is gone until it is heard of again.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            told = [(key[0], False, "silent")]
        else:
            last = pd.concat(list(parts)).sort_values("ts", kind="stable").iloc[-1]
            bad = isinstance(last["error"], str)
            healthy = bool(last["healthy"]) and not bad
            was = state.get[0] if state.exists else None
            state.update((healthy,))
            state.setTimeoutDuration(silence_ms)
            told = [] if was == healthy else [(key[0], healthy, "error" if bad else "beat")]
        yield pd.DataFrame(told, columns=["service", "healthy", "reason"])

    return beats.groupBy("service").applyInPandasWithState(fold, "service string, healthy boolean, reason string", "healthy boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


class VersionedStore:
    """The job store as versions of a table below ``path``, one for each micro-batch, which evicts across all jobs.

    A version is whole once its marker is there, so a batch that is replayed starts from the version before it
    and writes the same again: each batch counts once. The last two versions are kept.
    """

    SCHEMA = "job_id long, key string, value string, created_ord long, accessed_ord long"

    def __init__(self, spark: SparkSession, path: str, options: Options = DEFAULTS):
        self.spark, self.path, self.options = spark, path, options

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        jvm, root, fs = self._fs()
        if not fs.exists(root):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(root) if x.isDirectory()]
        whole = [n for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[2:]) for n in whole)

    def state(self, before: int | None = None) -> DataFrame:
        """(job_id, key, value, created_ord, accessed_ord) of the latest version, or of the one before a batch."""
        have = [v for v in self.versions() if before is None or v < before]
        if not have:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/v={have[-1]}")

    def merge(self, ops: DataFrame, batch_id: int) -> None:
        """Writes the version after ``ops(job_id, ord, op, payload)``: what ``jobs.fold`` gives after those before, less what is evicted."""
        old = self.state(batch_id)
        # A job as it stands is a put at its creation with all its keys, and a touch at its last access.
        kept = old.groupBy("job_id", "created_ord", "accessed_ord").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", "value")))).alias("payload"))
        whole = kept.select("job_id", F.col("created_ord").alias("ord"), F.lit("put").alias("op"), "payload").unionByName(kept.select("job_id", F.col("accessed_ord").alias("ord"), F.lit("get").alias("op"), F.lit("{}").alias("payload")))
        state = jobs.fold(whole.unionByName(ops.select("job_id", "ord", "op", "payload")))
        stay = jobs.survivors(state.select("job_id", "accessed_ord").distinct(), self.options).select("job_id")
        state.join(stay, "job_id", "left_semi").select("job_id", "key", "value", "created_ord", "accessed_ord").write.mode("overwrite").parquet(f"{self.path}/v={batch_id}")
        jvm, _, fs = self._fs()
        for v in self.versions()[:-2]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/v={v}"), True)

    def sink(self) -> Callable[[DataFrame, int], None]:
        """The function for ``writeStream.foreachBatch``."""
        return self.merge
