"""Per-key folds over ordered events, in batch and as streams.

A :class:`Fold` says what one key's events, taken in order, do to its state and
what they give.  In batch, each partition is read sorted by key and time and the
state of one key at a time is carried, so no key's events are ever held
together.  As a stream, keys are dealt to many shares; a share keeps its keys'
states and the events that may still be overtaken; once the watermark has passed
an event, it is folded.  So both give
the same rows for all events that the watermark has passed, however the stream
was cut into batches, and a stream goes on from its checkpoint.
"""

from __future__ import annotations

import pickle
from collections import namedtuple
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import chain, islice
from operator import itemgetter
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tessera.sources.versioned import VersionedTable


@dataclass(frozen=True)
class Fold:
    """One key's events in order.

    ``step(state, row)`` returns the new state and a tuple of results, or None
    for no result.  ``lapse(state, key, us)``, if given, tells what time alone
    does to a state up to ``us``: None for nothing, else the same pair; and
    ``wake(state)`` when that will be, None for never.  A state that has had no
    event for ``idle`` microseconds is as good as none.
    """

    key: str
    order: tuple[str, ...]
    start: Callable[[], Any]
    step: Callable[[Any, Any], tuple]
    result: str
    lapse: Callable[[Any, Any, int], tuple | None] | None = None
    wake: Callable[[Any], int | None] | None = None
    idle: int | None = None


def folded(df: DataFrame, fold: Fold, upto: int | None = None, late: str = "10 minutes") -> DataFrame:
    """The results of a fold over a batch, or over a stream whose events are at most ``late`` overtaken.

    Rows without a key make a group of their own.  Values come as plain Python
    ones: whole numbers stay whole, nulls are None.  ``upto`` (microseconds) is
    when a batch ends for :attr:`Fold.lapse`; a stream's first order column must
    be its time in microseconds, ``us``.
    """
    return _stream(df, fold, late) if df.isStreaming else _batch(df, fold, upto)


def ordered_fold(df: DataFrame, key: str, order: list[str], start: Callable[[], Any], step: Callable[[Any, Any], tuple], result: str) -> DataFrame:
    """:func:`folded` over a batch for a fold that needs no more than these."""
    return _batch(df, Fold(key, tuple(order), start, step, result), None)


def _batch(df: DataFrame, fold: Fold, upto: int | None) -> DataFrame:
    schema = to_arrow_schema(StructType.fromDDL(fold.result))
    names, at = df.columns, df.columns.index(fold.key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, begun = None, None, False
        kind = namedtuple("kind", names)

        def packed(out: list) -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[] for _ in schema]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        def ended() -> list:
            made = fold.lapse(state, current, upto) if begun and fold.lapse and upto is not None else None
            return [made[1]] if made and made[1] is not None else []

        for batch in batches:
            out = []
            for values in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not begun or values[at] != current:
                    out += ended()
                    current, state, begun = values[at], fold.start(), True
                state, made = _taken(fold, state, current, kind(*values))
                out += made
            yield packed(out)
        yield packed(ended())

    # By the key's hash, not the key: Spark leaves out a shuffle by the key itself over a union of parts that are dealt by it,
    # and then merges the partitions of each part by itself, as nothing tells it that a fold needs a key's rows together.
    return df.repartition(F.xxhash64(fold.key)).sortWithinPartitions(fold.key, *fold.order).mapInArrow(run, fold.result)


def _taken(fold: Fold, state: Any, key: Any, row: Any) -> tuple[Any, list]:
    """The state after an event and what time up to it and the event itself gave."""
    out = []
    if fold.lapse and (gone := fold.lapse(state, key, row.us)):
        state = gone[0]
        out += [gone[1]] if gone[1] is not None else []
    state, made = fold.step(state, row)
    return state, out + ([made] if made is not None else [])


#: So many held events at most are one value of the state, and so many results one row handed back.
PACK = 4096

#: Keys are dealt to so many shares, and a stream keeps its state by share: each call to the state is a message to another
#: process, and one for every key costs far more than to fold its events. Much more keys than these share a value that is rewritten as one.
SHARES = 1 << 15


class _Ordered(StatefulProcessor):
    """Holds the events of some keys back until the watermark has passed them, then folds each key's in order.

    Every call to the state is a message to another process, so events are held
    in packs, one for what a batch brings unless that is very much, and the
    states of the keys, each with the time of its last event, are one value.
    """

    def __init__(self, fold: Fold, names: list[str], out: list[str]):
        self.fold, self.names, self.out = fold, names, out

    def init(self, handle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "states binary")
        self.held = handle.getListState("held", "events binary")
        self.kind, self.row = namedtuple("kind", self.names), Row(*self.out)
        self.us, self.key, self.by = self.names.index("us"), self.names.index(self.fold.key), [self.names.index(c) for c in self.fold.order]

    def _in_order(self, events: list[tuple]) -> list[tuple]:
        try:
            return sorted(events, key=itemgetter(*self.by))
        except TypeError:  # nulls, which come first
            return sorted(events, key=lambda r: tuple((r[i] is not None, r[i]) for i in self.by))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        passed, us, first = timerValues.getCurrentWatermarkInMs() * 1000, self.us, None
        new = (r for r in map(tuple, rows) if r[us] >= passed)  # what comes later than allowed is dropped
        while pack := list(islice(new, PACK)):
            self.held.appendList([(pickle.dumps(pack),)])
            least = min(r[us] for r in pack)
            first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        passed, us, fold = timerValues.getCurrentWatermarkInMs() * 1000, self.us, self.fold
        rest, due = [], {}
        for (pack,) in self.held.get():
            for r in pickle.loads(pack):
                if r[us] < passed:
                    due.setdefault(r[self.key], []).append(r)
                else:
                    rest.append(r)
        kept = self.kept.get()
        states = pickle.loads(kept[0]) if kept else {}
        out, left, changed, wakes, ends = [], {}, bool(due), [r[us] for r in rest], []
        for k in states | due:
            state, last = states.get(k) or (fold.start(), None)
            for r in map(self.kind._make, self._in_order(due.get(k, []))):
                state, made = _taken(fold, state, k, r)
                out += made
                last = r.us
            if fold.lapse and (gone := fold.lapse(state, k, passed)):
                state, changed = gone[0], True
                out += [gone[1]] if gone[1] is not None else []
            if fold.idle is not None:
                if last + fold.idle < passed:
                    continue
                ends.append(last + fold.idle)
            left[k] = state, last
            if fold.wake and (at := fold.wake(state)) is not None:
                wakes.append(at)
        if left and (changed or len(left) < len(states)):
            self.kept.update((pickle.dumps(left),))
        elif kept and not left:
            self.kept.clear()
        if rest and due:
            self.held.put([(pickle.dumps(rest[i : i + PACK]),) for i in range(0, len(rest), PACK)])
        elif due:
            self.held.clear()
        if ends:  # a state that is over may stay until all of its share are
            wakes.append(max(ends))
        if wakes:
            self.handle.registerTimer(min(wakes) // 1000 + 1)
        yield from self._given(out)

    def _given(self, out: list[tuple]) -> Iterator[Row]:
        return (self.row(*r) for r in out)

    def close(self) -> None:
        pass


class _InPacks(_Ordered):
    """The same for rows that hold many events column by column, as :func:`_packed` makes them; results are given in such rows too."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        return super().handleInputRows(key, chain.from_iterable(zip(*r[1:], strict=True) for r in rows), timerValues)

    def _given(self, out: list[tuple]) -> Iterator[Row]:
        return (self.row(*map(list, zip(*out[i : i + PACK], strict=True))) for i in range(0, len(out), PACK))


#: So many rows, and a batch more at most, are looked through at once for those of one share.
HELD_ROWS = 1 << 17


def _packed(df: DataFrame, key: str) -> DataFrame:
    """One row for a share's rows of a partition, unless these are very many: ``_share``, and an array of each column."""
    dealt = df.select(F.pmod(F.xxhash64(key), F.lit(SHARES)).cast("int").alias("_share"), *df.columns)
    made = StructType([StructField("_share", IntegerType())] + [StructField(f.name, ArrayType(f.dataType)) for f in df.schema])
    schema = to_arrow_schema(made)

    def pack(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches)
        share = rows["_share"].to_numpy()
        order = np.argsort(share, kind="stable")
        first = np.flatnonzero(np.diff(share[order], prepend=-1))
        ends, order = pa.array(np.append(first, len(order)), pa.int32()), pa.array(order)
        rows = rows.take(order).combine_chunks().to_batches()[0]
        arrays = [pa.ListArray.from_arrays(ends, c) for c in rows.columns[1:]]
        return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip([rows["_share"].take(pa.array(first)), *arrays], schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD_ROWS:
                yield pack(held)
                held, n = [], 0
        if n:
            yield pack(held)

    return dealt.repartition("_share").mapInArrow(run, made)


def _stream(df: DataFrame, fold: Fold, late: str) -> DataFrame:
    # The watermark needs the time as such, the events don't: a timestamp costs more to hand over than all else of a row.
    timed = df.withColumn("_at", F.timestamp_micros("us")).withWatermark("_at", late).select(df.columns)
    result = StructType.fromDDL(fold.result)
    # A keyed state's rows go to Python and back value by value, so a row is what a batch brings of a share.
    packs = StructType([StructField(f.name, ArrayType(f.dataType)) for f in result])
    made = _packed(timed, fold.key).groupBy("_share").transformWithState(_InPacks(fold, df.columns, result.names), packs, "append", "eventTime")
    return made.select(F.inline(F.arrays_zip(*result.names)))


def _timed(df: DataFrame, key: str, time: str, tie: str, **more: str) -> DataFrame:
    return df.select(key, F.unix_micros(F.col(time).cast("timestamp")).alias("us"), tie, *[F.col(c).alias(n) for n, c in more.items()])


def anchored_limit(df: DataFrame, key: str, time: str, tie: str, seconds: int, most: int, late: str = "10 minutes") -> DataFrame:
    """Fixed windows that begin with the first event after the last one's end; events above ``most`` are rejected and change nothing."""
    rows = _timed(df, key, time, tie)
    span = seconds * 1_000_000

    def step(state: tuple | None, row: Any) -> tuple:
        begun, n = state if state else (None, 0)
        if begun is None or row.us >= begun + span:
            begun, n = row.us, 0
        ok = n < most
        return (begun, n + ok), (getattr(row, tie), getattr(row, key), bool(ok))

    kinds = {c: t for c, t in rows.dtypes}
    return folded(rows, Fold(key, ("us", tie), lambda: None, step, f"{tie} {kinds[tie]}, {key} {kinds[key]}, accepted boolean", idle=span), late=late)


def failure_block(df: DataFrame, key: str, time: str, tie: str, failed: str, most: int = 5, seconds: int = 900, block: int = 900, late: str = "10 minutes") -> DataFrame:
    """``most`` failures within ``seconds`` block a key for ``block`` seconds; blocked events count for nothing."""
    rows = _timed(df, key, time, tie, failed=failed)

    def step(state: tuple | None, row: Any) -> tuple:
        begun, n, until = state if state else (None, 0, 0)
        blocked = row.us < until
        if not blocked and row.failed:
            if begun is None or row.us >= begun + seconds * 1_000_000:
                begun, n = row.us, 0
            n += 1
            if n >= most:
                begun, n, until = None, 0, row.us + block * 1_000_000
        return (begun, n, until), (getattr(row, tie), getattr(row, key), bool(blocked))

    kinds = {c: t for c, t in rows.dtypes}
    result = f"{tie} {kinds[tie]}, {key} {kinds[key]}, blocked boolean"
    return folded(rows, Fold(key, ("us", tie), lambda: None, step, result, idle=max(seconds, block) * 1_000_000), late=late)


def sliding_limit(df: DataFrame, key: str, time: str, tie: str, seconds: int = 60, most: int = 12, in_all: int = 100, late: str = "10 minutes") -> DataFrame:
    """Accepts an event if fewer than ``most`` were accepted in the ``seconds`` before it and fewer than ``in_all`` ever; rejected ones leave no trace."""
    rows = _timed(df, key, time, tie)

    def step(state: tuple, row: Any) -> tuple:
        recent, total = state
        recent = [t for t in recent if t > row.us - seconds * 1_000_000]
        ok = len(recent) < most and total < in_all
        return ((recent + [row.us], total + 1) if ok else (recent, total)), (getattr(row, tie), getattr(row, key), ok)

    kinds = {c: t for c, t in rows.dtypes}
    return folded(rows, Fold(key, ("us", tie), lambda: ([], 0), step, f"{tie} {kinds[tie]}, {key} {kinds[key]}, accepted boolean"), late=late)


def throttled(df: DataFrame, key: str, time: str, tie: str, seconds: int = 1, late: str = "10 minutes") -> DataFrame:
    """Of each key, events at least ``seconds`` after the last one let through."""
    rows = _timed(df, key, time, tie)

    def step(last: int | None, row: Any) -> tuple:
        if last is not None and row.us - last < seconds * 1_000_000:
            return last, None
        return row.us, (getattr(row, tie), getattr(row, key))

    kinds = {c: t for c, t in rows.dtypes}
    return folded(rows, Fold(key, ("us", tie), lambda: None, step, f"{tie} {kinds[tie]}, {key} {kinds[key]}", idle=seconds * 1_000_000), late=late)


#: States that a run never leaves.
ENDED = ("COMPLETED", "FAILED", "CANCELLED")


def leases(df: DataFrame, key: str, time: str, tie: str, state: str, running: str = "RUNNING", seconds: int = 120, attempts: int = 3, upto: int | None = None, late: str = "10 minutes") -> DataFrame:
    """Runs that were ``running`` without news for ``seconds``: ``key, us`` (when the lease ended), ``attempt`` and ``outcome``.

    A run whose lease ends is queued again, or fails for good at its last
    attempt; an attempt begins when a run starts running after another state.
    Runs that have ended stay so.  In a batch, leases end up to ``upto``.
    """
    rows = _timed(df, key, time, tie, state=state)
    span = seconds * 1_000_000

    def step(now: tuple | None, row: Any) -> tuple:
        was, _, attempt = now if now else (None, 0, 0)
        if was in ENDED:
            return (was, row.us, attempt), None
        return (row.state, row.us, attempt + (row.state == running and was != running)), None

    def lapse(now: tuple | None, name: Any, us: int) -> tuple | None:
        if not now or now[0] != running or us <= now[1] + span:
            return None
        last = now[2] >= attempts
        return ("FAILED" if last else "QUEUED", now[1], now[2]), (name, now[1] + span, now[2], "FAILED" if last else "QUEUED")

    def wake(now: tuple | None) -> int | None:
        return now[1] + span if now and now[0] == running else None

    kinds = {c: t for c, t in rows.dtypes}
    return folded(rows, Fold(key, ("us", tie), lambda: None, step, f"{key} {kinds[key]}, us bigint, attempt int, outcome string", lapse=lapse, wake=wake), upto, late)


def run_states(df: DataFrame, key: str, time: str, tie: str, wanted: str, lease: int = 60, attempts: int = 3, late: str = "10 minutes") -> DataFrame:
    """What becomes of each request to move a run: ``tie, key, outcome, state, attempt``.

    A run begins QUEUED.  RUNNING claims it, which is BUSY while another claim's
    ``lease`` (seconds) holds or approval is waited for; beyond ``attempts``
    claims it has FAILED.  WAITING_APPROVAL, COMPLETED and FAILED need a running
    run, QUEUED one that runs or waits.  CANCELLED ends a run that doesn't run
    at once, and one that does at its next claim.  Nothing moves a run that has
    ended.
    """
    rows = _timed(df, key, time, tie, wanted=wanted)
    span = lease * 1_000_000

    def step(now: tuple | None, row: Any) -> tuple:
        state, attempt, until, cancel = now if now else ("QUEUED", 0, 0, False)
        outcome = "MOVED"
        if state in ENDED:
            outcome = "TERMINAL"
        elif row.wanted == "RUNNING":
            if state == "WAITING_APPROVAL" or (state == "RUNNING" and until > row.us):
                outcome = "BUSY"
            elif cancel:
                state = "CANCELLED"
            elif attempt >= attempts:
                state = "FAILED"
            else:
                state, attempt, until = "RUNNING", attempt + 1, row.us + span
        elif row.wanted == "CANCELLED":
            state, cancel = ("RUNNING", True) if state == "RUNNING" else ("CANCELLED", cancel)
        elif (state == "RUNNING" and row.wanted in ("WAITING_APPROVAL", "COMPLETED", "FAILED")) or (row.wanted == "QUEUED" and state in ("RUNNING", "WAITING_APPROVAL")):
            state = row.wanted
        else:
            outcome = "REFUSED"
        return (state, attempt, until, cancel), (getattr(row, tie), getattr(row, key), outcome, state, attempt)

    kinds = {c: t for c, t in rows.dtypes}
    result = f"{tie} {kinds[tie]}, {key} {kinds[key]}, outcome string, state string, attempt int"
    return folded(rows, Fold(key, ("us", tie), lambda: None, step, result), late=late)


#: Where a text may be shown although it is short; fixed values.
BREAKS = "\n。！？；："


def micro_batches(df: DataFrame, key: str, order: str, text: str, ms: str, least: int = 24, natural: int = 6, wait: int = 40, chunk: int = 480, stop: str | None = None) -> DataFrame:
    """Text deltas gathered into chunks: ``key, seq, chunk``.

    Text is let out at ``least`` characters, at ``natural`` ones that end a
    sentence, or once a delta comes ``wait`` milliseconds or more after the
    first one held back; what follows ``stop`` is dropped.  A row of ``order``
    null ends a key's text.
    """
    rows = df.select(F.col(key).alias("k"), F.col(order).isNull().alias("last"), F.col(order).alias("o"), F.col(text).alias("t"), F.col(ms).alias("ms"))

    def step(state: tuple, row: Any) -> tuple:
        held, since, seq, closed = state
        made: list[str] = []

        def let_out() -> None:
            nonlocal held, since
            made.extend(held[i : i + chunk] for i in range(0, len(held), chunk))
            held, since = "", None

        if held and since is not None and row.ms is not None and row.ms - since >= wait:
            let_out()
        if not closed and row.t:
            at = row.t.find(stop) if stop else -1
            held += row.t if at < 0 else row.t[:at]
            closed = at >= 0
            if held and (closed or len(held) >= least or (len(held) >= natural and held[-1] in BREAKS)):
                let_out()
            elif held and since is None:
                since = row.ms
        if row.last and held:
            let_out()
        return (held, since, seq + len(made), closed), (row.k, seq, made)

    out = ordered_fold(rows, "k", ["last", "o"], lambda: ("", None, 0, False), step, f"k {dict(rows.dtypes)['k']}, seq long, chunks array<string>")
    return out.select(F.col("k").alias(key), "seq", F.posexplode("chunks").alias("i", "chunk")).select(key, (F.col("seq") + F.col("i")).alias("seq"), "chunk")


def evidence_rounds(df: DataFrame, key: str, order: list[str], record: str, digest: str, valid: str, most: int = 3, late: str = "10 minutes") -> DataFrame:
    """Rounds without new valid evidence; ``most`` in a row escalate a key for good.

    A record or a digest counts once.  The first of ``order`` is ``us`` if rows
    are a stream.  Returns ``order`` columns, ``key``,
    ``stale`` (rounds in a row without new evidence) and ``status``.
    """
    rows = df.select(F.col(key).alias("k"), *order, F.col(record).alias("record"), F.col(digest).alias("digest"), F.col(valid).alias("valid"))

    def step(state: tuple, row: Any) -> tuple:
        stale, records, digests, escalated = state
        if not escalated:
            new = bool(row.valid) and row.record not in records and row.digest not in digests
            stale = 0 if new else min(most, stale + 1)
            if new:
                records, digests = records | {row.record}, digests | {row.digest}
            escalated = stale >= most
        return (stale, records, digests, escalated), (*(getattr(row, c) for c in order), row.k, stale, "ESCALATED" if escalated else "ACTIVE")

    kinds = dict(rows.dtypes)
    head = ", ".join(f"{c} {kinds[c]}" for c in order)
    fold = Fold("k", tuple(order), lambda: (0, frozenset(), frozenset(), False), step, f"{head}, k {kinds['k']}, stale int, status string")
    return folded(rows, fold, late=late).withColumnRenamed("k", key)


def latest_state_stream(events: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The current value of each key, kept up to date as a stream is read (update or complete mode)."""
    return events.groupBy(key).agg(F.max_by(value, order).alias(value), F.count(F.lit(1)).alias("n"))


def windowed_counts(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Event-time counts that forget windows older than ``late``."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))


def file_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table of Parquet files as a stream of its files; ``path`` may be a folder or one file."""
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, which a single file can fit too


#: Keyed state with timers needs this store; the default one has no column families.
_STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def append_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """Reads a stream of results that are final once given (a fold's) up to its present end, and returns all that it has given.

    Results and checkpoint lie in ``folder``: run again with the same one, it goes on where it stopped, and gives no row twice.
    """
    spark = stream.sparkSession
    with _settings(spark, **_STATE_STORE):
        stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(stream.schema)
    return rows.parquet(f"{folder}/rows") if VersionedTable.exists(spark, f"{folder}/rows/_spark_metadata") else spark.createDataFrame([], stream.schema)


def run_to_end(stream: DataFrame, folder: str, keys: list[str], buckets: int = 32) -> DataFrame:
    """Reads a stream of aggregates up to its present end and returns the rows, one for each of ``keys``, as they then are.

    Only rows whose aggregates changed in a batch reach the table in ``folder``,
    and only the buckets that they fall into are written anew; table and batch
    number are committed as one, so a batch that is repeated changes nothing.
    Run again with the same folder, the stream goes on where it stopped.
    """
    spark = stream.sparkSession
    table = VersionedTable.open(spark, f"{folder}/table", stream.schema, keys, buckets)

    def write(rows: DataFrame, batch: int) -> None:
        table.upsert(rows, batch=batch)

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    table.vacuum(keep=2)
    return table.read()


class Reader:
    """A reader of an event log that goes on from its own position: ``key`` and sequence of what it has read, kept in a versioned table."""

    def __init__(self, spark: SparkSession, folder: str, key: str, key_type: str, seq: str = "sequence"):
        self.key, self.seq = key, seq
        self.positions = VersionedTable.open(spark, folder, StructType.fromDDL(f"{key} {key_type}, {seq} bigint"), [key], 16)

    def next(self, log: DataFrame, page: int = 100) -> DataFrame:
        """The rows after the reader's position, at most ``page`` for each key."""
        seen = self.positions.read().select(F.col(self.key).alias("_k"), F.col(self.seq).alias("_seen"))
        new = log.join(seen, F.col(self.key).eqNullSafe(F.col("_k")), "left").where(F.col(self.seq) > F.coalesce("_seen", F.lit(0))).drop("_k")
        # Sequences have no gaps beyond the position, so a page needs no sorting.
        return new.where(F.col(self.seq) <= F.coalesce("_seen", F.lit(0)) + page).drop("_seen")

    def done(self, rows: DataFrame) -> None:
        """Moves the position past rows that have been dealt with; never back."""
        self.positions.upsert(rows.groupBy(self.key).agg(F.max(self.seq).alias(self.seq)), version=self.seq)
