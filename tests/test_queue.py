"""State with timers and queues against plain loops, in one batch and over several."""

import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstone.streaming import queue

START = datetime(2024, 1, 1)


@pytest.fixture
def streamed(spark, tmp_path):
    """Runs a stream over files of rows, one file a batch, and gives all rows that it wrote."""

    def run(batches, schema, plan, name):
        before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
        queue.rocksdb_state(spark)
        try:
            source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / name / "in"))
            writer = plan(source).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / name / "checkpoint"))
            writer.trigger(availableNow=True).start(str(tmp_path / name / "out")).awaitTermination()
        finally:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        return spark.read.parquet(str(tmp_path / name / "out")).collect()

    return run


def lines(events):
    """Positions by a list for each queue."""
    waiting, out = {}, set()
    for at, seq, q, task, kind in sorted(events):
        line, position = waiting.setdefault(q, []), None
        if kind == "arrive":
            outcome = "duplicate" if task in line else "queued"
            if outcome == "queued":
                line.append(task)
                position = line.index(task) + 1
        else:
            outcome = "done" if task in line else "unknown"
            if outcome == "done":
                line.remove(task)
        out.add((q, seq, task, outcome, position, len(line)))
    return out


def test_queue_over_batches(streamed):
    rng = random.Random(2)
    events = [(START + timedelta(seconds=i), i, rng.choice(["a", "b"]), f"t{rng.randrange(6)}", rng.choice(["arrive", "arrive", "end"])) for i in range(240)]
    schema = "at timestamp, seq long, q string, task string, kind string"
    got = streamed([events[:100], events[100:150], events[150:]], schema, lambda s: queue.queued(s, "q", "task", "kind", "at", "seq"), "queue")
    want = lines(events)
    assert {tuple(r) for r in got} == want and {x[3] for x in want} == {"queued", "duplicate", "done", "unknown"}
    odd = [(START, 1, "a", None, "arrive"), (START, 2, "a", "x", "other"), (START, 3, None, "x", "arrive"), (START, 4, "a", "x", "end")]
    got = streamed([odd], schema, lambda s: queue.queued(s, "q", "task", "kind", "at", "seq"), "odd")
    assert {tuple(r) for r in got} == {(None, 3, "x", "queued", 1, 1), ("a", 4, "x", "unknown", None, 0)}


def sessions(events, idle, until):
    out = []
    for k in {k for k, _ in events}:
        own = []
        for t in sorted(t for x, t in events if x == k):
            if own and t - own[-1][1] <= idle:
                own[-1] = (own[-1][0], t, own[-1][2] + 1)
            else:
                own.append((t, t, 1))
        out += [(k, a, z, n) for a, z, n in own if z + idle <= until]
    return sorted(out)


@pytest.mark.parametrize("cuts", [[300], [60, 61, 200, 300]])
def test_idle_keys_are_told_and_gone(streamed, cuts):
    rng = random.Random(7)
    seconds = sorted(rng.randrange(20_000) for _ in range(300))
    events = [(rng.choice(["x", "y", "z", "w"]), s) for s in seconds]
    events[40:60] = events[40:60][::-1]  # late, but within the delay
    rows = [(k, START + timedelta(seconds=s)) for k, s in events]
    batches = [rows[a:z] for a, z in zip([0, *cuts], cuts)]
    got = streamed(batches, "user string, ts timestamp", lambda s: queue.idle_sessions(s, "user", "ts", 300_000, "30 minutes"), f"idle{len(cuts)}")
    zero = int(START.timestamp())
    told = sorted((r["key"], r["first_us"] // 10**6 - zero, r["last_us"] // 10**6 - zero, r["n_events"]) for r in got)
    assert told == sessions(events, 300, max(seconds) - 1800) and len(told) > 40


def test_null_keys_and_times_do_not_open_sessions(streamed):
    rows = [(None, START), ("a", None), ("a", START), ("b", START + timedelta(days=2))]
    got = streamed([rows], "user string, ts timestamp", lambda s: queue.idle_sessions(s, "user", "ts", 1000, "1 second"), "nulls")
    assert [(r["key"], r["n_events"]) for r in got] == [("a", 1)]


class Held:
    """A state variable or a handle that notes what it is asked for."""

    def __init__(self):
        self.value, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    getListState = getMapState = getValueState  # noqa: N815

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


def test_a_group_of_keys_has_one_timer_however_many_sessions():
    held = Held()
    sessions = queue.IdleSessions(1000, "bigint")
    sessions.init(held)
    rows = pd.DataFrame({"key": [k for k in range(5) for _ in range(20)], "micros": [i * 10_000_000 + k for k in range(5) for i in range(20)]})
    list(sessions.handleInputRows((0,), iter([rows]), None))
    assert held.timers == [1000] and len(held.value[0]) == 100 and held.calls == 2


def test_the_lines_of_a_group_are_read_and_written_once():
    held = Held()
    line = queue.TaskQueue("bigint")
    line.init(held)
    rows = pd.DataFrame({"queue": [1, 2] * 50, "task": [f"t{i}" for i in range(100)], "kind": [queue.ARRIVES] * 100, "at": range(100), "seq": range(100)})
    (out,) = line.handleInputRows((0,), iter([rows.iloc[::-1]]), None)
    assert held.calls == 2 and out["position"].tolist() == [1 + i // 2 for i in range(100)]
    assert [queue for queue, _ in zip(*held.value, strict=True)] == [1] * 50 + [2] * 50
