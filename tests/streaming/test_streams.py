"""Keyed streams give the rows of the batch, whatever the batches, restarts and disorder; sinks and readers go on from where they were."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.sources.versioned import VersionedTable
from tessera.streaming import folds

SCHEMA = "id long, k long, ts timestamp, bad boolean, state string, digest long"
STATES = ["QUEUED", "RUNNING", "RUNNING", "RUNNING", "WAITING_APPROVAL", "CANCELLED"]
FOLDS = {
    "anchored": lambda d: folds.anchored_limit(d, "k", "ts", "id", 60, 2, late="30 seconds"),
    "block": lambda d: folds.failure_block(d, "k", "ts", "id", "bad", 2, 90, 120, late="30 seconds"),
    "sliding": lambda d: folds.sliding_limit(d, "k", "ts", "id", 60, 2, 20, late="30 seconds"),
    "throttle": lambda d: folds.throttled(d, "k", "ts", "id", 25, late="30 seconds"),
    "states": lambda d: folds.run_states(d, "k", "ts", "id", "state", 30, 3, late="30 seconds"),
    "rounds": lambda d: folds.evidence_rounds(d.select("k", F.unix_micros("ts").alias("us"), "id", "digest", "bad"), "k", ["us", "id"], "id", "digest", "bad", 3, late="30 seconds"),
}


def events(n=160, seed=11):
    r = random.Random(seed)
    at, rows = 1_700_000_000, []
    for i in range(n):
        at += r.choice([0, 1, 5, 20, 70])
        rows.append((i, r.choice([1, 2, 3, None]), at, r.random() < 0.5, r.choice(STATES), r.randrange(9)))
    # Neighbours change places, but by less than may be late.
    for i in range(0, n - 1, 2):
        if rows[i + 1][2] - rows[i][2] <= 20:
            rows[i], rows[i + 1] = rows[i + 1], rows[i]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, k long, t long, bad boolean, state string, digest long").select("id", "k", F.timestamp_seconds("t").alias("ts"), "bad", "state", "digest")


def feed(spark, folder, parts):
    for part in parts:
        frame(spark, part).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)


def reading(spark, folder):
    return spark.readStream.schema(frame(spark, events(1)).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def known(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", FOLDS)
def test_stream_equals_batch_over_batches_and_a_restart(spark, tmp_path, name):
    rows = events()
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    feed(spark, source, [rows[:60], rows[60:90]])
    first = known(folds.append_to_end(FOLDS[name](reading(spark, source)), folder))
    feed(spark, source, [rows[90:130], rows[130:], [(10_000, 77, rows[-1][2] + 500, False, "QUEUED", 0)]])
    both = known(folds.append_to_end(FOLDS[name](reading(spark, source)), folder))
    want = known(FOLDS[name](frame(spark, rows)))
    assert both == want and 0 < len(first) < len(want) and set(first) <= set(both)
    assert known(folds.append_to_end(FOLDS[name](reading(spark, source)), folder)) == want  # nothing new, nothing twice


def test_run_states(spark):
    asked = [(0, "COMPLETED"), (1, "RUNNING"), (30, "RUNNING"), (40, "WAITING_APPROVAL"), (50, "RUNNING"), (60, "QUEUED"), (70, "RUNNING"), (131, "RUNNING"), (140, "CANCELLED"), (150, "RUNNING"), (200, "RUNNING"), (210, "QUEUED")]
    rows = [(i, 1, 1_700_000_000 + s, False, w, 0) for i, (s, w) in enumerate(asked)] + [(50 + i, 2, 1_700_000_000 + 100 * i, False, "RUNNING", 0) for i in range(5)] + [(90, 3, 1_700_000_000, False, "CANCELLED", 0)]
    got = {r.id: (r.outcome, r.state, r.attempt) for r in folds.run_states(frame(spark, rows), "k", "ts", "id", "state").collect()}
    assert [got[i] for i in range(12)] == [
        ("REFUSED", "QUEUED", 0), ("MOVED", "RUNNING", 1), ("BUSY", "RUNNING", 1), ("MOVED", "WAITING_APPROVAL", 1), ("BUSY", "WAITING_APPROVAL", 1), ("MOVED", "QUEUED", 1),
        ("MOVED", "RUNNING", 2), ("MOVED", "RUNNING", 3), ("MOVED", "RUNNING", 3), ("BUSY", "RUNNING", 3), ("MOVED", "CANCELLED", 3), ("TERMINAL", "CANCELLED", 3),
    ]
    assert [got[50 + i] for i in range(5)] == [*[("MOVED", "RUNNING", i + 1) for i in range(3)], ("MOVED", "FAILED", 3), ("TERMINAL", "FAILED", 3)]
    assert got[90] == ("MOVED", "CANCELLED", 0)


def test_leases(spark, tmp_path):
    rows = [(i, k, 1_700_000_000 + s, False, state, 0) for i, (k, s, state) in enumerate([(1, 0, "QUEUED"), (1, 10, "RUNNING"), (1, 60, "RUNNING"), (2, 70, "RUNNING"), (2, 100, "COMPLETED"), (1, 300, "RUNNING"), (3, 310, "RUNNING"), (3, 400, "FAILED"), (1, 900, "RUNNING"), (2, 950, "RUNNING")])]
    lease = lambda d, **more: folds.leases(d, "k", "ts", "id", "state", seconds=120, attempts=3, late="30 seconds", **more)
    end = (1_700_000_000 + 5000) * 1_000_000
    want = [(1, 180, 1, "QUEUED"), (1, 420, 2, "QUEUED"), (1, 1020, 3, "FAILED")]
    plain = lambda df: sorted((k, us // 1_000_000 - 1_700_000_000, a, o) for k, us, a, o in df.collect())
    assert plain(lease(frame(spark, rows), upto=end)) == want
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    feed(spark, source, [rows[:5], rows[5:8]])
    folds.append_to_end(lease(reading(spark, source)), folder)
    # Time alone ends the last lease: only other runs have news.
    feed(spark, source, [rows[8:], [(99, 50, 1_700_000_000 + 6000, False, "QUEUED", 0)]])
    assert plain(folds.append_to_end(lease(reading(spark, source)), folder)) == want


def test_late_events_are_dropped(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    base = 1_700_000_000
    feed(spark, source, [[(0, 1, base, False, "", 0)], [(1, 1, base + 1000, False, "", 0)], [(2, 1, base + 5, False, "", 0)], [(3, 2, base + 3000, False, "", 0)]])
    assert sorted(r.id for r in folds.append_to_end(FOLDS["throttle"](reading(spark, source)), folder).collect()) == [0, 1]


def test_sink_writes_only_what_changed(spark, tmp_path):
    source, folder = str(tmp_path / "in"), f"file://{tmp_path}/state"
    (tmp_path / "nothing").mkdir()
    latest = lambda: folds.latest_state_stream(reading(spark, source), "k", "state", "id")
    assert folds.run_to_end(folds.latest_state_stream(spark.readStream.schema(frame(spark, events(1)).schema).parquet(str(tmp_path / "nothing")), "k", "state", "id"), f"file://{tmp_path}/none", ["k"]).count() == 0
    feed(spark, source, [[(i, i, 1_700_000_000, False, "QUEUED", 0) for i in range(300)]])
    assert folds.run_to_end(latest(), folder, ["k"]).count() == 300
    table = VersionedTable.open(spark, f"{folder}/table", latest().schema, ["k"])
    before = table._manifest()
    feed(spark, source, [[(1000, 5, 1_700_000_001, False, "RUNNING", 0)]])
    rows = {r.k: (r.state, r.n) for r in folds.run_to_end(latest(), folder, ["k"]).collect()}
    after = table._manifest()
    assert rows[5] == ("RUNNING", 2) and rows[6] == ("QUEUED", 1) and len(rows) == 300
    assert sum(after["folders"][b] != f for b, f in before["folders"].items()) == 1 and after["batch"] > before["batch"]


def test_reader_goes_on_from_its_position(spark, tmp_path):
    log = spark.createDataFrame([(k, s, f"e{s}") for k in (1, 2, None) for s in range(1, 8)], "run long, sequence long, what string")
    reader = folds.Reader(spark, f"file://{tmp_path}/at", "run", "long")
    first = reader.next(log, page=3)
    assert known(first.select("sequence")) == [(1,)] * 3 + [(2,)] * 3 + [(3,)] * 3
    reader.done(first)
    again = folds.Reader(spark, f"file://{tmp_path}/at", "run", "long")
    rest = again.next(log.where("run = 1 or run is null"))
    assert known(rest.select("sequence").distinct()) == [(4,), (5,), (6,), (7,)]
    again.done(rest)
    again.done(first)  # never back
    assert known(again.next(log).select("run").distinct()) == [(2,)]


def test_held_events_are_few_values_of_the_state():
    """Each call to the state is a message to another process: a key's events of a batch go there in packs."""
    from types import SimpleNamespace

    calls, timers, store = [], [], {"kept": None, "held": []}

    class State:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, what):
            def call(*given):
                calls.append((self.name, what))
                if what == "get":
                    return iter(list(store["held"])) if self.name == "held" else store["kept"]
                if what in ("appendList", "put"):
                    store["held"] = ([] if what == "put" else store["held"]) + list(given[0])
                elif what == "exists":
                    return store["kept"] is not None
                else:
                    store[self.name] = given[0] if what == "update" else [] if self.name == "held" else None

            return call

    handle = SimpleNamespace(getValueState=lambda name, _: State(name), getListState=lambda name, _: State(name), registerTimer=timers.append)
    fold = folds.Fold("k", ("us", "id"), lambda: 0, lambda n, row: (n + 1, (row.id, row.k, n)), "id long, k long, n long", idle=1_000_000)
    made = folds._Ordered(fold, ["k", "us", "id"], ["id", "k", "n"])
    made.init(handle)
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    rows = [(7, 5_000_000 + i * 1000, None if i == 20 else i) for i in range(10_000)]
    random.Random(1).shuffle(rows)
    late = [(7, 10, -1)]
    assert list(made.handleInputRows((7,), iter(rows[:9_000] + late), at(1))) == []
    assert list(made.handleInputRows((7,), iter(rows[9_000:]), at(1))) == []
    assert len(calls) <= 4 and len(store["held"]) <= 4 and min(timers) == 5_001
    first = list(made.handleExpiredTimer((7,), at(5_000 + 3_000), None))
    assert [tuple(r) for r in first] == [(None if i == 20 else i, 7, i) for i in range(3_000)] and first[0].asDict() == {"id": 0, "k": 7, "n": 0}
    rest = list(made.handleExpiredTimer((7,), at(60_000), None))
    assert [r.n for r in rest] == list(range(3_000, 10_000)) and store == {"kept": None, "held": []}
    assert len(calls) < 20


@pytest.mark.parametrize("name", ["anchored", "states"])
def test_keys_of_one_share_stay_apart(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(folds, "SHARES", 1)
    monkeypatch.setattr(folds, "HELD_ROWS", 20)
    test_stream_equals_batch_over_batches_and_a_restart(spark, tmp_path, name)


def test_leases_of_one_share(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folds, "SHARES", 1)
    test_leases(spark, tmp_path)


def test_rows_of_a_share_are_one_row(spark):
    rows = frame(spark, events()).select("k", F.unix_micros("ts").alias("us"), "state")
    packs = folds._packed(rows, "k")
    assert packs.count() == 4  # three keys and null
    assert known(packs.select(F.inline(F.arrays_zip("k", "us", "state")))) == known(rows)


def test_many_keys_cost_few_calls_to_the_state():
    """One call costs more than to fold a key's events, so the keys of a share are read and written together."""
    from types import SimpleNamespace

    calls, timers, store = [], [], {"kept": None, "held": []}

    class State:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, what):
            def call(*given):
                calls.append((self.name, what))
                if what == "get":
                    return iter(list(store["held"])) if self.name == "held" else store["kept"]
                if what in ("appendList", "put"):
                    store["held"] = ([] if what == "put" else store["held"]) + list(given[0])
                else:
                    store[self.name] = given[0] if what == "update" else [] if self.name == "held" else None

            return call

    handle = SimpleNamespace(getValueState=lambda name, _: State(name), getListState=lambda name, _: State(name), registerTimer=timers.append)
    fold = folds.Fold("k", ("us", "id"), lambda: 0, lambda n, row: (n + 1, (row.id, row.k, n)), "id long, k long, n long", idle=1_000_000)
    made = folds._InPacks(fold, ["k", "us", "id"], ["id", "k", "n"])
    made.init(handle)
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    rows = [(k if k else None, 5_000_000 + i * 1_000_000, 1000 * k + i) for k in range(300) for i in range(4)]
    random.Random(1).shuffle(rows)
    packs = [(0, *map(list, zip(*rows[i : i + 500], strict=True))) for i in range(0, len(rows), 500)]
    assert list(made.handleInputRows((0,), iter(packs), at(1))) == []
    given = [made.handleExpiredTimer((0,), at(ms), None) for ms in (6_500, 60_000)]
    first, last = ([r for row in g for r in zip(row.id, row.k, row.n, strict=True)] for g in given)
    assert sorted(first) == [(1000 * k + i, k if k else None, i) for k in range(300) for i in range(2)]
    assert sorted(last) == [(1000 * k + i, k if k else None, i) for k in range(300) for i in range(2, 4)]
    assert len(calls) < 12 and len(timers) < 4 and store == {"kept": None, "held": []}
