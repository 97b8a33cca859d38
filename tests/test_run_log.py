"""The stateful run log: restarts, repeats, late events, masking, and equality with a batch over the whole log."""

import datetime as dt

import pandas as pd

from quillscreen.streaming import run_log


def event(i, at=None, **more):
    at = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i if at is None else at)
    row = {"run": f"r{i % 3}", "event_id": str(i), "ts": at, "level": "error" if i % 7 == 0 else "info", "stage": f"s{i % 2}", "message": "m", "details": {"n": str(i), "Api_Token": "hidden"}}
    return tuple((row | more).values())


def write(spark, path, rows):
    spark.createDataFrame(rows, run_log.EVENT).coalesce(1).write.mode("append").json(path)


def shown(d):
    return sorted((r.run, r.n_events, r.n_errors, r.n_masked, tuple(sorted((r.stages or {}).items())), r.first_ts, r.last_ts, r.last_details) for r in d.collect())


def test_a_stream_stopped_and_continued_equals_the_batch(spark, tmp_path):
    log, sink, state = (f"{tmp_path}/{n}" for n in ("log", "sink", "state"))
    events = [event(i) for i in range(200)]
    events += [event(300, run=None), event(301, ts=None), event(302, stage=None, level=None, details=None), event(303, event_id=None), event(304, event_id=None), event(305, at=199)]
    write(spark, log, events[:90])
    write(spark, log, events[80:110])  # thirty of them again, in a later file
    run_log.follow(run_log.read(spark, log, 1), sink, state)
    write(spark, log, events[100:])
    run_log.follow(run_log.read(spark, log, 1), sink, state)
    got, want = shown(run_log.latest(spark, sink)), shown(run_log.summarise(spark.createDataFrame(events, run_log.EVENT)))
    assert got == want and sum(r[1] for r in got) == len(events) - 2
    assert all("hidden" not in (r[-1] or "") for r in got)
    # Nothing new: nothing changes, and a repeat of the last batch would replace its own folder.
    run_log.follow(run_log.read(spark, log, 1), sink, state)
    assert shown(run_log.latest(spark, sink)) == want


def test_late_events_are_dropped_and_old_ids_forgotten(spark, tmp_path):
    log, sink, state = (f"{tmp_path}/{n}" for n in ("log", "sink", "state"))
    write(spark, log, [event(i, run="r") for i in range(10)])
    run_log.follow(run_log.read(spark, log), sink, state, delay=60)
    write(spark, log, [event(100, run="r", at=5000)])
    run_log.follow(run_log.read(spark, log), sink, state, delay=60)
    write(spark, log, [event(101, run="r", at=20), event(3, run="r", at=3), event(102, run="r", at=4990)])
    run_log.follow(run_log.read(spark, log), sink, state, delay=60)
    (row,) = run_log.latest(spark, sink).collect()
    assert row.n_events == 12 and row.last_ts == dt.datetime(2024, 1, 1, 1, 23, 20)


def test_empty_log(spark, tmp_path):
    write(spark, f"{tmp_path}/log", [event(1, ts=None)])
    run_log.follow(run_log.read(spark, f"{tmp_path}/log"), f"{tmp_path}/sink", f"{tmp_path}/state")
    assert run_log.latest(spark, f"{tmp_path}/sink").collect() == []
    assert run_log.summarise(spark.createDataFrame([], run_log.EVENT)).collect() == []


def test_events_are_masked_before_they_are_written(spark, tmp_path):
    log = f"{tmp_path}/log"
    run_log.append(spark, log, "r1", "retrieval", "asked", {"OPENAI_API_KEY": "k1", "tries": 3, "nested": {"password": "k2", "list": [{"token": "k3", "ok": 1}]}})
    run_log.append(spark, log, "r1", "rank", "done")
    raw = "".join(r.value for r in spark.read.text(log).collect())
    assert not any(k in raw for k in ("k1", "k2", "k3")) and raw.count("[redacted]") == 3
    (row,) = run_log.summarise(spark.read.schema(run_log.EVENT).json(log)).collect()
    assert row.n_events == 2 and row.stages == {"rank": 1, "retrieval": 1}
    assert run_log.mask(["x", {"k": ("a", {"secret": 1})}]) == ["x", {"k": ["a", {"secret": "[redacted]"}]}]


def test_a_run_reads_and_writes_its_state_once_for_many_events(monkeypatch):
    """Whatever the number of events in a batch, ids beyond those kept together excepted; these are known again, too, and forgotten by the same timer."""
    calls, kept, seen, timers = [], [], {}, []

    class State:
        def __init__(self, name):
            self.name = name

        def get(self):
            calls.append("get")
            return kept[-1] if kept else None

        def exists(self):
            return False

        def update(self, value):
            calls.append("update")
            kept.append(value)

        def containsKey(self, k):  # noqa: N802
            return k in seen

        def updateValue(self, k, v):  # noqa: N802
            seen[k] = v

        def removeKey(self, k):  # noqa: N802
            del seen[k]

        def iterator(self):
            return iter(list(seen.items()))

    class Handle:
        getValueState = getMapState = lambda self, name, *a: State(name)
        registerTimer = lambda self, at: timers.append(at)

    class Expired:
        getExpiryTimeInMs = lambda self: timers[-1]

    def rows(ids):
        return iter([pd.DataFrame({"event_id": [f"e{i}" for i in ids], "us": [i * 1000 for i in ids], "level": "info", "stage": "s", "n_masked": 0, "details": "{}"})])

    monkeypatch.setattr(run_log, "TOGETHER", 30)
    run = run_log.RunSummary(10)
    run.init(Handle())
    (out,) = run.handleInputRows(("r",), rows([*range(30), *range(10)]), None)
    assert calls == ["get", "update"] and not seen and out.n_events[0] == 30
    (out,) = run.handleInputRows(("r",), rows(range(50)), None)
    assert len(seen) == 20 and out.n_events[0] == 50 and out.stages[0] == {"s": 50}
    (out,) = run.handleInputRows(("r",), rows(range(60)), None)
    assert out.n_events[0] == 60 and len(calls) == 6
    list(run.handleExpiredTimer(("r",), None, Expired()))
    assert not seen and kept[-1][0] == 60 and kept[-1][-3:] == ([], [], False)
