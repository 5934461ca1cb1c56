"""Keyed state with event-time timers: alerts that fire after a breach has lasted, records that are tried again; and sessions of users that expire.

Rows of a key may come in any order within the watermark's lateness. They are held in state until the watermark has passed them and
then stepped through in order of time, so that results don't depend on how the stream was cut into batches; what is held is as much
as the lateness lets wait. Keys share state by a hash of theirs, in BUCKETS parts: a call costs more than a row, so rows of many keys
are handed over, kept and read together. State lives in RocksDB on the executors, with its changes in the checkpoint; a restart goes on from there."""

from __future__ import annotations

import contextlib
import pickle
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from corpusmill.streaming.jobs import LATENESS

# The driver starts a worker of its own for these processors; they travel to it by value, wherever it looks for modules.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """Streams that are started within keep their state in RocksDB, which timers need; the session's setting is put back."""
    before = {k: spark.conf.get(k, None) for k in PROVIDER}
    try:
        for k, v in PROVIDER.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Parts of the state, and rows that are kept as one value of it.
BUCKETS, PACK = 1024, 10_000


class Shared(StatefulProcessor):
    """The state of a bucket of keys: rows (key, ...) packed by the thousands, and one timer at the earliest time anything is due."""

    def init(self, handle) -> None:
        self.handle, self.seen = handle, set()
        self.held = handle.getListState("held", "rows binary")

    def read(self) -> list[tuple]:
        return [r for (pack,) in self.held.get() for r in pickle.loads(bytes(pack))]

    def keep(self, rows: list[tuple]) -> None:
        self.held.appendList([(pickle.dumps(rows[i : i + PACK]),) for i in range(0, len(rows), PACK)])

    def replace(self, rows: list[tuple]) -> None:
        self.held.clear()
        if rows:
            self.keep(rows)

    def first(self, bucket: tuple) -> bool:
        """Whether this is the first timer of a bucket to expire in this batch; it does all that is due."""
        new = bucket not in self.seen
        self.seen.add(bucket)
        return new

    def close(self) -> None:
        pass


def _tuples(f: pd.DataFrame, names: list[str]) -> list[tuple]:
    """Rows (key, names...) of a frame whose keys are in `of`."""
    return list(zip([tuple(k.values()) for k in f["of"]], *([None if v != v else v for v in f[c].tolist()] for c in names), strict=True))


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names, dtype=object)


def _by_bucket(stream: DataFrame, keys: list[str], ts: str, lateness: str, **columns):
    """Rows that have a time, grouped by a hash of their keys."""
    rows = stream.where(F.col(ts).isNotNull()).withWatermark(ts, lateness)
    of = F.struct(*[F.col(k).cast("string").alias(k) if k in _whole(stream, keys) else k for k in keys])
    return rows.select(F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("bucket"), of.alias("of"), *[c.alias(n) for n, c in columns.items()], ts).groupBy("bucket")


def _whole(stream: DataFrame, keys: list[str]) -> dict[str, str]:
    """Keys that are whole numbers, with their types. They travel as text: beside a null, pandas would make them floats."""
    return {k: kind for k, kind in stream.dtypes if k in keys and kind.endswith("int")}


def _fields(stream: DataFrame, keys: list[str]) -> str:
    kinds = dict(stream.dtypes) | dict.fromkeys(_whole(stream, keys), "string")
    return ", ".join(f"{k} {kinds[k]}" for k in keys)


def _restored(out: DataFrame, stream: DataFrame, keys: list[str]) -> DataFrame:
    return out.select(*[F.col(c).cast(_whole(stream, keys)[c]).alias(c) if c in _whole(stream, keys) else c for c in out.columns])


class InOrder(Shared):
    """Holds rows until the watermark passes them, then gives those of a key to step() in order.

    A subclass names what a row and a key's own state are, the first field of a row being its time in milliseconds, and says in step() what a
    row does, in due() what happens by itself and when. Both return (state, output rows). A state of None is forgotten."""

    row: str
    state: str
    out: list[str]
    key: str

    def init(self, handle) -> None:
        super().init(handle)
        self.own = handle.getMapState("own", self.key, self.state)

    def step(self, key: tuple, state: tuple | None, row: tuple) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def due(self, key: tuple, state: tuple | None, until: int) -> tuple[tuple | None, list[tuple]]:
        """What happens up to a time without a row."""
        raise NotImplementedError

    def next_due(self, state: tuple | None) -> int | None:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, names = None, [c.split()[0] for c in self.row.split(",")]
        for f in rows:
            new = _tuples(f, names)
            if new:
                self.keep(new)
                low = min(r[1] for r in new)
                first = low if first is None else min(first, low)
        if first is not None:
            self.handle.registerTimer(int(first))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.first(key):
            return
        until = timerValues.getCurrentWatermarkInMs()
        own = {tuple(k): tuple(v) for k, v in self.own.iterator()}
        ready, rest, out, later = {}, [], [], []
        for r in self.read():
            if r[1] <= until:
                ready.setdefault(r[0], []).append(r[1:])
            else:
                rest.append(r)
                later.append(r[1])
        for of in own | ready:
            state = own.get(of)
            for r in sorted(ready.get(of, ()), key=lambda r: tuple((v is not None, v) for v in r)):
                for what, given in ((self.due, r[0] - 1), (self.step, r)):
                    state, rows = what(of, state, given)
                    out += [(*of, *x) for x in rows]
            state, rows = self.due(of, state, until)
            out += [(*of, *x) for x in rows]
            if state is None and of in own:
                self.own.removeKey(of)
            elif state is not None and state != own.get(of):
                self.own.updateValue(of, state)
            if (at := self.next_due(state)) is not None:
                later.append(at)
        if ready:
            self.replace(rest)
        if later:
            self.handle.registerTimer(int(min(later)))
        if out:
            yield _frame(out, self.out)


class Alerts(InOrder):
    """A rule on one subject: pending from the first breach on, fired once the breach has lasted `lasting` ms and `cooldown` ms are over since it fired last, resolved by the first value that is none."""

    row, state = "at long, breach boolean", "pending long, fired long, firing boolean"

    def __init__(self, keys: list[str], key: str, lasting: int, cooldown: int):
        self.lasting, self.cooldown, self.key = lasting, cooldown, key
        self.out = [*keys, "event", "at"]

    def _when(self, state: tuple) -> int:
        pending, fired, _ = state
        return max(pending + self.lasting, pending if fired is None else fired + self.cooldown)

    def step(self, key, state, row):
        at, breach = row
        pending, fired, firing = state or (None, None, False)
        if breach:
            state = (at if pending is None else pending, fired, firing)
            # a breach that need not last fires with the row itself
            return self.due(key, state, at)
        return ((None, fired, False) if fired is not None else None), ([("resolved", at)] if firing else [])

    def due(self, key, state, until):
        if state is None or state[0] is None or state[2] or self._when(state) > until:
            return state, []
        at = self._when(state)
        return (state[0], at, True), [("fired", at)]

    def next_due(self, state):
        return None if state is None or state[0] is None or state[2] else self._when(state)


def _millis(ts: str):
    return F.unix_millis(F.col(ts).cast("timestamp"))


def alerts(stream: DataFrame, keys: list[str], ts: str, breach, lasting: int, cooldown: int, lateness: str = LATENESS) -> DataFrame:
    """(keys, event, at): 'fired' and 'resolved' of a rule for each subject, times in milliseconds, as the watermark passes them.

    A null `breach` is none; rows without a time are passed over; of rows of one subject at the same time a breach comes last."""
    key = _fields(stream, keys)
    rows = _by_bucket(stream, keys, ts, lateness, at=_millis(ts), breach=F.coalesce(breach, F.lit(False)))
    return _restored(rows.transformWithStateInPandas(Alerts(keys, key, lasting, cooldown), f"{key}, event string, at long", "Append", "EventTime"), stream, keys)


def sessions(stream: DataFrame, keys: list[str], ts: str, kind: str, value: str, idle: int, lateness: str = LATENESS) -> DataFrame:
    """(keys, start, last, requests, kinds, mean) of sessions that `idle` milliseconds without a row have ended. Rows without a time are passed over.

    Spark's own session windows over times in milliseconds, a microsecond short of `idle`: windows that touch are joined, and a row just `idle` after another is a new session's."""
    v = F.col(value).cast("double")
    rows = stream.where(F.col(ts).isNotNull()).select(*keys, F.timestamp_millis(_millis(ts)).alias("_at"), F.col(kind).cast("string").alias("_kind"), F.when(~F.isnan(v), v).alias("_value"))
    g = rows.withWatermark("_at", lateness).groupBy(*keys, F.session_window("_at", f"{idle * 1000 - 1} microseconds").alias("_w"))
    out = g.agg(F.count(F.lit(1)).alias("requests"), F.collect_set(F.when(F.col("_kind") != "", F.col("_kind"))).alias("_kinds"), F.avg("_value").alias("mean"))
    return out.select(*keys, F.unix_millis("_w.start").alias("start"), (F.unix_millis("_w.end") + 1 - idle).alias("last"), "requests", F.array_join(F.array_sort("_kinds"), ",").alias("kinds"), "mean")


def fold_alerts(df: DataFrame, keys: list[str], ts: str, breach, lasting: int, cooldown: int, until: int) -> DataFrame:
    """alerts() of a table, up to a time in milliseconds: each subject's changes between breach and none are folded in order.

    Only the rows where the answer changes matter; they are found in time order, and one short list of changes a subject is folded."""
    from pyspark.sql import Window as W

    kept = df.where(F.col(ts).isNotNull()).select(*keys, _millis(ts).alias("at"), F.coalesce(breach, F.lit(False)).alias("b")).where(F.col("at") <= until)
    order = W.partitionBy(*keys).orderBy("at", "b")
    changes = kept.withColumn("was", F.lag("b", 1, False).over(order)).where(F.col("b") != F.col("was"))
    runs = changes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "b"))).alias("c"))
    pairs = F.transform(F.filter("c", lambda x: x["b"]), lambda x: F.struct(x["at"].alias("start"), F.array_min(F.transform(F.filter("c", lambda y: ~y["b"] & (y["at"] > x["at"])), lambda y: y["at"])).alias("end")))
    zero = F.struct(F.lit(None).cast("long").alias("fired"), F.array().cast("array<struct<event:string,at:bigint>>").alias("out"))

    def fold(acc, run):
        at = F.greatest(run["start"] + lasting, F.coalesce(acc["fired"] + cooldown, run["start"]))
        fires = (at <= until) & (run["end"].isNull() | (at < run["end"]))
        one = lambda event, t: F.struct(F.lit(event).alias("event"), t.alias("at"))
        new = F.concat(acc["out"], F.array(one("fired", at)), F.when(run["end"].isNotNull(), F.array(one("resolved", run["end"]))).otherwise(F.array().cast("array<struct<event:string,at:bigint>>")))
        return F.struct(F.when(fires, at).otherwise(acc["fired"]).alias("fired"), F.when(fires, new).otherwise(acc["out"]).alias("out"))

    return runs.select(*keys, F.explode(F.aggregate(pairs, zero, fold)["out"]).alias("r")).select(*keys, "r.event", "r.at")


class Retries(Shared):
    """Records whose handler fails wait in state and are tried again by a timer, `backoff` ms after each attempt, `most` times in all.

    handler(body, attempt) returns None or an error. A record that succeeds is written as completed with the tries it took, one that
    fails `most` times as dead with its last error. Its attempts are in the checkpoint with it, so a restart neither loses one nor counts it twice."""

    def __init__(self, keys: list[str], handler, most: int, backoff: int):
        self.out, self.handler, self.most, self.backoff = [*keys, "body", "event", "tries", "error"], handler, most, backoff

    def _tried(self, of: tuple, body: str, tries: int, at: int) -> tuple[list[tuple], list[tuple]]:
        """What attempt number `tries` at a time writes, and what it leaves waiting."""
        error = self.handler(body, tries)
        if error is None:
            return [(*of, body, "completed", tries, None)], []
        if tries >= self.most:
            return [(*of, body, "dead", tries, error)], []
        return [], [(of, at + self.backoff, tries, error, body)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for f in rows:
            out, left = [], []
            for of, at, body in _tuples(f, ["at", "body"]):
                done, again = self._tried(of, body, 1, at)
                out += done
                left += again
            if left:
                self.keep(left)
                low = min(r[1] for r in left)
                first = low if first is None else min(first, low)
            if out:
                yield _frame(out, self.out)
        if first is not None:
            self.handle.registerTimer(int(first))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.first(key):
            return
        until = timerValues.getCurrentWatermarkInMs()
        todo, left, out = self.read(), [], []
        while todo:
            of, due, tries, error, body = todo.pop()
            if due > until:
                left.append((of, due, tries, error, body))
                continue
            done, again = self._tried(of, body, tries + 1, due)
            out += done
            todo += again
        self.replace(left)
        if left:
            self.handle.registerTimer(int(min(r[1] for r in left)))
        if out:
            yield _frame(out, self.out)


def retried(stream: DataFrame, keys: list[str], ts: str, body: str, handler, most: int = 3, backoff: int = 60_000, lateness: str = LATENESS) -> DataFrame:
    """(keys, body, event, tries, error): completed or dead records. The first attempt is made as a record comes, the others when the watermark has passed its time by the backoff, twice the backoff, and so on."""
    rows = _by_bucket(stream, keys, ts, lateness, at=_millis(ts), body=F.col(body).cast("string"))
    out = rows.transformWithStateInPandas(Retries(keys, handler, most, backoff), f"{_fields(stream, keys)}, body string, event string, tries int, error string", "Append", "EventTime")
    return _restored(out, stream, keys)
