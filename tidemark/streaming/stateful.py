"""Operators that keep a state for each key between micro-batches.

Keys are dealt into a fixed number of buckets by hash, and a processor sees one bucket's rows of one micro-batch: it takes the states of the bucket's keys from one entry of Spark's store, puts the rows
in order of key and time, goes on from each key's state, and writes the entry back. So a call to the store and a frame are paid for once a bucket and not once a key, however many keys there are.
Spark hands a processor its rows as one Python tuple each; where no watermark is asked about single rows, they come packed: a tuple has all of the bucket that stood in one Arrow batch.
State is checkpointed with the stream and bounded per key: a position, a window of errors, a day's sum that is let go when the watermark has passed the day. Rows that come after a later batch are
taken when they come.

Cases: rows with a null key share one state; rows with a null value change nothing and give their row with what is known; rows with a null time stand last in their batch; an empty stream gives nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets of keys. Part of the state's layout: a stream resumes with the number that it began with.
BUCKETS = 256
LAST = (1 << 63) - 1


def _bucket(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("bucket")


def _dealt(rows: DataFrame, *columns: str | Column) -> DataFrame:
    """Rows (key, id, at, ...) with their bucket. Whole numbers reach pandas without nulls, as it would turn the others of a batch into doubles."""
    whole = (F.coalesce("key", F.lit(0)).alias("key"), F.col("key").isNull().alias("no_key"), F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("no_id"), F.coalesce("at", F.lit(LAST)).alias("at"))
    return rows.select(_bucket("key"), *whole, *columns)


#: What a packed column holds; all others are doubles.
KINDS = {"key": "i8", "no_key": "?", "id": "i8", "no_id": "?", "at": "i8"}


def _packed(rows: DataFrame, *values: str) -> DataFrame:
    """One row for each bucket of an Arrow batch of `_dealt` rows: its values column by column as bytes."""
    kinds = KINDS | dict.fromkeys(values, "f8")

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bucket = batch.column("bucket").to_numpy()
                order = np.argsort(bucket, kind="stable")
                starts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
                ends = np.append(starts, len(order))
                columns = [pa.array(bucket[order][starts])]
                for name, kind in kinds.items():
                    x = batch.column(name).to_numpy(zero_copy_only=False).astype(kind)[order]
                    columns.append(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((ends * x.itemsize).astype("i4")), pa.py_buffer(x.tobytes())]))
                yield pa.RecordBatch.from_arrays(columns, ["bucket", *kinds])

    doubles = rows.withColumns({v: F.col(v).cast("double") for v in values})
    return doubles.mapInArrow(packs, ", ".join(["bucket long", *(f"{k} binary" for k in kinds)]))


def _by_key(rows: Iterator[pd.DataFrame], *values: str) -> dict[str, np.ndarray]:
    """The columns of a bucket, packed or not, by key, time and id."""
    frames = pd.concat(list(rows), ignore_index=True)
    x = {c: frames[c].to_numpy() for c in (*KINDS, *values)}
    x = {c: np.frombuffer(b"".join(v), KINDS.get(c, "f8")) if v.dtype == object else v for c, v in x.items()}
    order = np.lexsort([x[c] for c in ("id", "no_id", "at", "key", "no_key")])
    return {c: v[order] for c, v in x.items()}


def _tuples(x: dict[str, np.ndarray], *columns: str) -> Iterator[tuple]:
    """Rows of `columns`, key and id None where they are null."""
    return zip(*([None if n else v for v, n in zip(x[c].tolist(), x[f"no_{c}"].tolist())] if c in ("key", "id") else x[c].tolist() for c in columns))


class ByBucket(StatefulProcessor):
    """A processor whose state is a dictionary for each bucket: what is kept of each of its keys."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("keys", "kept binary")

    def kept(self) -> dict:
        return pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else {}

    def keep(self, kept: dict) -> None:
        if kept:
            self.state.update((pickle.dumps(kept, pickle.HIGHEST_PROTOCOL),))
        else:
            self.state.clear()

    def close(self) -> None:
        pass


def _frame(rows: list[tuple], **types: str) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series(v, dtype=t) for (n, t), v in zip(types.items(), zip(*rows) if rows else [[]] * len(types))})


def _named(x: dict[str, np.ndarray], found: pd.DataFrame) -> pd.DataFrame:
    """`found` with key and id of the rows before it."""
    names = {c: pd.Series(pd.arrays.IntegerArray(x[c], x[f"no_{c}"])) for c in ("key", "id")}
    return pd.DataFrame(names | dict(found.items()))


class Positions(ByBucket):
    """Long from a value above `enter` until it falls to the trailing stop, which the values seen before set."""

    def __init__(self, enter: float, floor: float, trail: float):
        self.enter, self.floor, self.trail = enter, floor, trail

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, out, x = self.kept(), [], _by_key(rows, "value")
        for k, value in _tuples(x, "key", "value"):
            entry, peak = held.get(k, (None, None))
            stop = None if entry is None else max(self.floor * entry, self.trail * peak)
            if entry is not None and value == value:
                if value <= stop:
                    entry = peak = None
                    del held[k]
                elif value > peak:
                    held[k] = entry, value
            elif entry is None and value == value and value > self.enter:
                entry = value
                held[k] = value, value
            out.append((int(entry is not None), stop))
        self.keep(held)
        yield _named(x, _frame(out, held="int32", stop="float64"))


class Fusion(ByBucket):
    """Two forecasts weighted by the inverse of their mean squared errors over the last `window` rows whose outcome was known by now.

    A key has a queue of errors in the order in which its rows came: those that are known in front (their time is KNOWN), then those that are not due yet; one becomes known when it and all before it are due.
    The state has the queues of a bucket's keys one after another, and all rows of a batch are looked up in them at once.
    """

    QUEUE = {"key": "i8", "no_key": "?", "at": "i8", "x": "f8", "y": "f8"}
    KNOWN = np.iinfo("i8").min

    def __init__(self, window: int, horizon: int):
        self.window, self.horizon = window, horizon

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new, kept = _by_key(rows, "value", "a", "b"), self.kept() or {c: np.empty(0, t) for c, t in self.QUEUE.items()}
        with np.errstate(over="ignore", invalid="ignore"):
            new |= {"x": (new["value"] - new["a"]) ** 2, "y": (new["value"] - new["b"]) ** 2}
        counts = ~np.isnan(np.stack([new[c] for c in ("value", "a", "b")])).any(axis=0)
        # kept errors and new rows by key, in order within it; `code` numbers the keys
        both = {c: np.concatenate([kept[c], new[c]]) for c in self.QUEUE}
        order = np.lexsort([both["key"], both["no_key"]])
        both = {c: v[order] for c, v in both.items()}
        other = (both["key"][1:] != both["key"][:-1]) | (both["no_key"][1:] != both["no_key"][:-1])
        code = np.concatenate([[0], np.cumsum(other)])
        queued, asks = np.concatenate([np.ones(len(kept["at"]), "?"), counts])[order], order >= len(kept["at"])
        queue = {c: v[queued] for c, v in both.items()}
        place, ahead = code[queued], (np.cumsum(queued) - queued)[asks]  # of a row: the errors that stand in the queues before it
        start = np.searchsorted(place, np.arange(code[-1] + 1))
        # when an error and all before it are due, as a rank, so that one search finds a row's place in its key's queue
        times, rank = np.unique(queue["at"], return_inverse=True)
        due = np.maximum.accumulate(place * (len(times) + 1) + rank)
        seen = np.searchsorted(times, both["at"][asks] - self.horizon, side="right")
        end = np.minimum(np.searchsorted(due, code[asks] * (len(times) + 1) + seen), ahead)
        first = start[code[asks]]
        x, y = np.zeros(len(end)), np.zeros(len(end))
        for back in range(self.window, 0, -1):
            i = np.flatnonzero(end - back >= first)
            x[i] += queue["x"][end[i] - back]
            y[i] += queue["y"][end[i] - back]
        with np.errstate(divide="ignore", invalid="ignore"):
            n = np.minimum(end - first, self.window)
            x, y = (1 / np.maximum(v / n, 1e-12) for v in (x, y))
            weight = np.where(n > 0, x / (x + y), np.nan)
            fused = weight * new["a"] + (1 - weight) * new["b"]
        known = start + np.bincount(place[queue["at"] == self.KNOWN], minlength=len(start))
        known[code[asks]] = end  # the last row of a key counts
        i, known = np.arange(len(place)), known[place]
        queue["at"] = np.where(i < known, self.KNOWN, queue["at"])
        stays = i >= known - self.window
        self.keep({c: v[stays] for c, v in queue.items()} if stays.any() else {})
        yield _named(new, pd.DataFrame({"weight": weight, "fused": fused}))


class RunningLoss(ByBucket):
    """One alert when a key's running result of the day first falls below -limit; the states of a bucket's day end with the day."""

    def __init__(self, limit: float):
        self.limit = limit

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept, out = self.kept(), []
        for k, id_, value in _tuples(_by_key(rows, "value"), "key", "id", "value"):
            total, told = kept.get(k, (0.0, False))
            total += value if value == value else 0.0
            if not told and total < -self.limit:
                told = True
                out.append((k, key[1], id_, total))
            kept[k] = total, told
        self.keep(kept)
        if key[1] is not None:
            self.handle.registerTimer((int(key[1]) + 1) * 86_400_000)
        yield _frame(out, key="Int64", day="Int64", id="Int64", total="float64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield _frame([], key="Int64", day="Int64", id="Int64", total="float64")


def positions(rows: DataFrame, enter: float, floor: float, trail: float) -> DataFrame:
    """key, id, held, stop (before the row) for each row of a stream (key, id, at, value)."""
    return _packed(_dealt(rows, "value"), "value").groupBy("bucket").transformWithStateInPandas(Positions(enter, floor, trail), "key long, id long, held int, stop double", "Append", "None")


def fusion(rows: DataFrame, window: int, horizon: int) -> DataFrame:
    """key, id, weight (of a), fused for each row of a stream (key, id, at, value, a, b)."""
    return _packed(_dealt(rows, "value", "a", "b"), "value", "a", "b").groupBy("bucket").transformWithStateInPandas(Fusion(window, horizon), "key long, id long, weight double, fused double", "Append", "None")


def running_losses(rows: DataFrame, time: str, limit: float, late: str = "1 hour") -> DataFrame:
    """key, day, id, total of the first row of each key and day whose running result is below -limit, from a stream (key, day, id, at, value, and the event time)."""
    x = _dealt(rows.withWatermark(time, late), "day", "value", F.col(time).alias("event_time"))
    return x.groupBy("bucket", "day").transformWithStateInPandas(RunningLoss(limit), "key long, day long, id long, total double", "Append", "EventTime")


class KeepFirst(ByBucket):
    """The earliest row of a key, given when the watermark has passed it, so that no earlier one can come in time; the key is then closed for `forget` milliseconds of event time.

    A bucket has one timer, for what is due first; all that is due is given then.
    """

    def __init__(self, forget: int):
        self.forget = forget

    def _keep(self, kept: dict, timer: int | None) -> None:
        """Keeps the states and has the timer stand at the first of their times."""
        due = min((v[3] for v in kept.values()), default=None)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.keep(kept)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = self.kept()
        timer = min((v[3] for v in kept.values()), default=None)
        for frame in rows:
            for k, at, id_, row in zip(*(frame[c].tolist() for c in ("kept_key", "at", "id", "row"))):
                best = kept.get(k)
                if best is None or (not best[4] and (at, id_) < best[:2]):
                    kept[k] = (at, id_, row, at // 1000 + 1, False)
        self._keep(kept, timer)
        yield _frame([], row="object")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, kept, out = timerValues.getCurrentWatermarkInMs(), {}, []
        for k, (at, id_, row, due, told) in self.kept().items():
            if due > now:
                kept[k] = at, id_, row, due, told
            elif not told:
                out.append((row,))
                if due + self.forget > now:
                    kept[k] = at, id_, "", due + self.forget, True
        self._keep(kept, None)  # Spark lets the expired timer go by itself
        yield _frame(out, row="object")


def first_captures(rows: DataFrame, keys: list[str], time: str, id_col: str, late: str = "1 hour", forget: str = "60 days") -> DataFrame:
    """The whole earliest row (by `time`, then `id_col` as text) of each key of a stream, however its rows are dealt into batches, as long as none is more than `late` out of order.

    A row is given when the watermark passes it; rows of the key that come within `forget` after are repeats.
    """
    stamps = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}
    taken = {c.lower() for c in rows.columns}
    names = {n: next(n + "_" * i for i in range(99) if n + "_" * i not in taken) for n in ("key", "at", "id", "row")}
    x = rows.withWatermark(time, late).withColumns({
        names["key"]: F.to_json(F.struct(*keys), stamps), names["at"]: F.unix_micros(time), names["id"]: F.coalesce(F.col(id_col).cast("string"), F.lit("")), names["row"]: F.to_json(F.struct(*rows.columns), stamps),
    })
    x = x.select(_bucket(names["key"]), *(F.col(v).alias(f"kept_{k}") for k, v in names.items()), F.col(time).alias("kept_time")).withColumnsRenamed({"kept_at": "at", "kept_id": "id", "kept_row": "row"})
    milliseconds = int(pd.Timedelta(forget).total_seconds() * 1000)
    first = x.groupBy("bucket").transformWithStateInPandas(KeepFirst(milliseconds), "row string", "Append", "EventTime")
    return first.select(F.from_json("row", rows.schema, stamps).alias("row")).select("row.*")
