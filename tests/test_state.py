"""Streams whose state ends, versions of the job store, ordered handlers, and rules that are added."""

import json
import os
import time


from planframe.operators import admit, jobs
from planframe.options import Options
from planframe.streaming import events
from planframe.streaming.handlers import Observer
from planframe.streaming.state import VersionedStore, health, live_sessions


def files(spark, folder, schema, batches):
    """A stream of one file for each batch."""
    folder.mkdir()
    for k, rows in enumerate(batches):
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(folder / f"{k}.json", (1000 + k, 1000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_a_session_ends_and_its_state_goes(spark, tmp_path):
    say = lambda user, at, text, snapshot=None: {"user_id": user, "ts": f"2024-01-01T{at}:00Z", "role": "user", "content": text, "snapshot": snapshot}
    batches = [
        [say(1, "10:01", "b"), say(1, "10:00", "a", "s1"), say(2, "10:00", "x")],
        [say(2, "10:59", "y"), say(1, "10:30", "c")],
        [say(3, "12:30", "later")],  # the watermark passes the ends of 1 (11:30) and 2 (11:59)
        [say(3, "13:31", "again"), say(1, "13:31", "new")],  # more than an hour of silence between two messages
    ]
    stream = files(spark, tmp_path / "in", "user_id long, ts timestamp, role string, content string, snapshot string", batches)
    q = live_sessions(stream, "10 minutes", Options(history=2)).writeStream.format("memory").queryName("sessions_out").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(180)
    rows = spark.table("sessions_out").collect()
    state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    ended = {(r.user_id, r.n): (r.contents, r.snapshot) for r in rows if r.status == "ended"}
    assert ended == {(1, 3): (["b", "c"], "s1"), (2, 2): (["x", "y"], None), (3, 1): (["later"], None)}
    assert max(state) == 3 and state[-1] == 2  # 1 and 2 went; 3 and the new 1 live
    assert {(r.user_id, r.n) for r in rows if r.status == "open" and r.contents[-1] in ("again", "new")} == {(1, 1), (3, 1)}


def test_health_goes_false_when_beats_stop(spark, tmp_path):
    beat = lambda service, s, healthy=True, error=None: {"service": service, "ts": f"2024-01-01T00:00:{s:02d}Z", "healthy": healthy, "error": error}
    stream = files(spark, tmp_path / "in", "service string, ts timestamp, healthy boolean, error string", [[beat("a", 1, False), beat("a", 2), beat("b", 1)], [beat("b", 3, True, "refused")]])
    q = health(stream, 3000).writeStream.format("memory").queryName("health_out").outputMode("append").trigger(processingTime="300 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("health_out").where("reason = 'silent'").count() < 2:
            time.sleep(0.3)
        got = [(r.service, r.healthy, r.reason) for r in spark.table("health_out").collect()]
        left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        q.stop()
    assert [x[1:] for x in got if x[0] == "a"] == [(True, "beat"), (False, "silent")]
    assert [x[1:] for x in got if x[0] == "b"] == [(True, "beat"), (False, "error"), (False, "silent")]
    assert left == 0


OPS = "job_id long, ord long, op string, payload string"


def test_eviction_on_a_stream_counts_each_batch_once(spark, tmp_path):
    op = lambda o, job, what, **keys: {"job_id": job, "ord": o, "op": what, "payload": json.dumps(keys)}
    batches = [
        [op(i, i % 6, "put", a=str(i)) for i in range(6)],
        [op(10, 0, "get"), op(11, 1, "update", b="1"), op(12, 7, "put", a="7"), op(13, 9, "update", a="no job")],
        [op(20, 0, "update", a="20"), op(21, 3, "contains"), op(22, 8, "put", a="8"), op(23, 8, "put", c="8")],
    ]
    options = Options(max_jobs=4)
    store = VersionedStore(spark, str(tmp_path / "store"), options)
    stream = files(spark, tmp_path / "in", OPS, batches)
    stream.writeStream.foreachBatch(store.sink()).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(180)
    told = lambda: sorted(tuple(r) for r in store.state().collect())
    want, state = [], {}
    for b in batches:  # a plain loop: fold, then the least recently used go
        for o in b:
            j, keys = o["job_id"], json.loads(o["payload"])
            if o["op"] == "put":
                state[j] = [keys, state[j][1] if j in state else o["ord"], o["ord"]]
            elif j in state and o["op"] in ("update", "get"):
                state[j][0], state[j][2] = state[j][0] | keys, o["ord"]
        if len(state) > 4:
            gone = sorted(state, key=lambda j: state[j][2])[: len(state) - 4 + 1]
            state = {j: v for j, v in state.items() if j not in gone}
    want = sorted((j, k, v, c, a) for j, (keys, c, a) in state.items() for k, v in keys.items())
    assert told() == want
    last = store.versions()[-1]
    store.merge(spark.createDataFrame([tuple(o.values()) for o in batches[-1]], OPS), last)  # the batch is replayed
    assert told() == want and len(store.versions()) == 2


def test_one_batch_equals_the_batch_twin(spark, tmp_path):
    ops = spark.createDataFrame([(i % 9, i, ("put", "update", "get")[i % 3] if i > 8 else "put", json.dumps({f"k{i % 4}": str(i)})) for i in range(60)], OPS)
    store = VersionedStore(spark, str(tmp_path / "s"), Options(max_jobs=5))
    store.merge(ops, 0)
    whole = jobs.fold(ops)
    stay = jobs.survivors(whole.select("job_id", "accessed_ord").distinct(), Options(max_jobs=5)).select("job_id")
    assert sorted(map(tuple, store.state().collect())) == sorted(map(tuple, whole.join(stay, "job_id", "left_semi").select("job_id", "key", "value", "created_ord", "accessed_ord").collect()))


def test_handlers_run_in_order_and_a_failing_one_is_quarantined(spark, tmp_path):
    seen = Observer(str(tmp_path / "bad"))
    calls = []

    @seen.on("warning")
    def first(rows, batch_id):
        calls.append(("first", rows.count()))

    @seen.on("warning")
    def broken(rows, batch_id):
        calls.append(("broken", rows.count()))
        raise ValueError("no such job")

    seen.subscribe("warning", lambda rows, batch_id: calls.append(("third", rows.count())))
    seen.subscribe("error", lambda rows, batch_id: calls.append(("error", rows.first().job_id)))
    seen.subscribe("job_completed", lambda rows, batch_id: calls.append(("never", 0)))
    rows = [{"job_id": j, "event": e, "ts": "2024-01-01T00:00:00Z", "payload": None} for j, e in (("a", "warning"), ("b", "warning"), ("c", "nonsense"), ("d", "error"))]
    stream = files(spark, tmp_path / "in", "job_id string, event string, ts timestamp, payload string", [rows])
    stream.writeStream.foreachBatch(seen.dispatch).trigger(availableNow=True).start().awaitTermination(120)
    assert calls == [("first", 2), ("broken", 2), ("third", 2), ("error", "d")]
    assert [(r.event, r.place, r.handler, r.error, r.n) for r in seen.failures(spark).collect()] == [("warning", 1, "broken", "ValueError: no such job", 2)]


def test_a_third_rule_is_added_without_touching_judge(spark):
    box = "job_id long, ord long, type string, x1 double, y1 double, x2 double, y2 double, confidence double"
    boxes = spark.createDataFrame([(1, 0, "slab", 0.0, 0.0, 900.0, 900.0, 0.9), (1, 1, "slab", 10.0, 10.0, 12.0, 12.0, 0.9), (1, 2, "stair", 0.0, 0.0, 5.0, 5.0, 0.9), (1, 3, None, 0.0, 0.0, 5.0, 5.0, 0.9)], box)
    spans = spark.createDataFrame([], "job_id long, ord long, sx double, sy double, text string")
    grid = spark.createDataFrame([], "job_id long, axis string, idx long, px double")
    legend = spark.createDataFrame([], "job_id long, tag string, material string")
    paths = spark.createDataFrame([], "job_id long, path_ord long, x1 double, y1 double, x2 double, y2 double, dashes string")
    rules = {"slab": admit.slab_decisions}
    got = {r.ord: (r.action, r.reason) for r in admit.judge(boxes, spans, grid, legend, paths, rules=rules).collect()}
    assert got == {0: ("admit", "slab_stands"), 1: ("reject", "too_small"), 2: ("admit", "no_rule_for_type"), 3: ("admit", "no_rule_for_type")}
    assert {r.reason for r in admit.judge(boxes, spans, grid, legend, paths).collect()} == {"no_rule_for_type"}


def test_events_go_to_those_who_watch_their_job(spark, tmp_path):
    rows = [{"job_id": j, "event": "warning", "ts": "2024-01-01T00:00:00Z", "payload": None} for j in ("a", "b", "c")]
    stream = files(spark, tmp_path / "in", "job_id string, event string, ts timestamp, payload string", [rows])
    links = spark.createDataFrame([("a", 1), ("a", 2), ("c", 1)], "job_id string, user_id long")
    q = events.routed(stream, links).writeStream.format("memory").queryName("routed_out").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.job_id, r.user_id) for r in spark.table("routed_out").collect()) == [("a", 1), ("a", 2), ("c", 1)]
