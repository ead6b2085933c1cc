"""Keyed state: live streams, cancels, per-conversation rate counters, token buckets.

What happened when is told by the events' own times; the clock of the timers is the arrival (`arrived_at`, or the time
of the micro-batch).  Arrival never runs late, so no row is dropped before it reaches its processor, however old its
event is.  An own `arrived_at` must not decrease from one micro-batch to the next.

Keys are dealt to `slots` by their hash, and the state store holds one small table per slot.  A slot's table is read and
written once a micro-batch and its keys are worked on together, so the calls to the state store and the timers grow with
the slots and not with the keys.  A slot's keys must fit in a task's memory: where very many keys are remembered at a
time, take more slots.  Their number belongs to a checkpoint and can't be changed later.

Timers never run ahead of a replay: what a key needs to remember is kept for its time after the event or after its
arrival, whichever is later.  So events that come long after they happened meet the same state as live ones.  A
slot has one timer, for what is due first; when it fires, all that is due by then is done.

A slot's rows of a micro-batch reach the processor as an iterator of Arrow batches.  Results don't
depend on where these are cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from callscope.operators.governance import rate_bucket
from callscope.schemas import REQUESTS_PER_MINUTE, STREAM_TTL_SECONDS

LATENESS_SECONDS = 600
#: Parts that the keys of a job are dealt to.
SLOTS = 1024
_NEVER, _FAR = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def arriving(events: DataFrame) -> DataFrame:
    """Rows with `arrived_at` as the watermark column."""
    if "arrived_at" not in events.columns:
        events = events.withColumn("arrived_at", F.current_timestamp())
    return events.withColumn("arrived_ms", F.unix_millis("arrived_at")).withWatermark("arrived_at", "1 second")


def _by_slot(rows: DataFrame, keys: list[str], values: list[str | Column], slots: int, processor: StatefulProcessor, output: str) -> DataFrame:
    dealt = rows.select(F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int").alias("slot"), *keys, *values, "arrived_ms", "arrived_at")
    return dealt.groupBy("slot").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=output, outputMode="Append", timeMode="EventTime"
    )


def _codes(*keys: pd.Series) -> tuple[pd.Index, list[np.ndarray]]:
    """The different keys of all columns, and each column as places in them; nulls are a key."""
    codes, names = pd.factorize(pd.concat([k.astype(object) for k in keys], ignore_index=True), use_na_sentinel=False)
    return names, np.split(codes, np.cumsum([len(k) for k in keys])[:-1])


def _extreme(of: np.ufunc, n: int, codes: np.ndarray, values, start: int) -> np.ndarray:
    out = np.full(n, start, np.int64)
    of.at(out, codes, np.asarray(values, np.int64))
    return out


def _least(n: int, codes: np.ndarray, values) -> np.ndarray:
    return _extreme(np.minimum, n, codes, values, _FAR)


def _most(n: int, codes: np.ndarray, values) -> np.ndarray:
    return _extreme(np.maximum, n, codes, values, _NEVER)


class _Slot(StatefulProcessor):
    """The table of a slot, an Arrow stream with the columns `_SHAPE`; `due_ms` is when a row's turn comes."""

    _SHAPE: tuple[tuple[str, pa.DataType], ...]

    def init(self, handle) -> None:
        self._handle = handle
        self._schema = pa.schema([*self._SHAPE, ("due_ms", pa.int64())])
        self._state = handle.getValueState("slot", "rows binary, timer_ms long")

    def _load(self) -> tuple[pd.DataFrame, int]:
        if not self._state.exists():
            return self._schema.empty_table().to_pandas(), _NEVER
        rows, timer = self._state.get()
        return pa.ipc.open_stream(bytes(rows)).read_all().to_pandas(), int(timer)

    def _store(self, table: pd.DataFrame, timer: int, fired: bool = False) -> None:
        """Keeps the rows, and sets the timer for the first that has a time; one that fired goes by itself."""
        due = table["due_ms"].to_numpy()
        first = int(due[due != _FAR].min(initial=_FAR))
        if first != timer:
            if timer != _NEVER and not fired:
                self._handle.deleteTimer(timer)
            if first != _FAR:
                self._handle.registerTimer(first)
        if not len(table):
            self._state.clear()
            return
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, self._schema) as writer:
            writer.write_table(pa.Table.from_pandas(table, self._schema, preserve_index=False))
        self._state.update((out.getvalue().to_pybytes(), first if first != _FAR else _NEVER))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        fired = int(expiredTimerInfo.getExpiryTimeInMs())
        table, timer = self._load()
        if fired != timer:
            return
        # A timer fires before the watermark reaches it; so does all that is due earlier.
        end = max(int(timerValues.getCurrentWatermarkInMs()), fired + 1)
        left, out = self._expired(table, table["due_ms"].to_numpy() < end)
        self._store(left, timer, fired=True)
        if len(out):
            yield out

    def _expired(self, table: pd.DataFrame, over: np.ndarray) -> tuple[pd.DataFrame, pd.DataFrame]:
        """What is left of a table when the rows `over` have had their turn, and what comes out."""
        return table[~over], pd.DataFrame()

    def close(self) -> None:
        pass


class _LiveStream(_Slot):
    """Opens on the first `start`, closes on the earliest `end`, expires after the time to live.

    An end that arrives before its start is remembered, and so is a closed stream, until the time
    to live and the lateness have passed.
    """

    _SHAPE = (("request_id", pa.string()), ("started", pa.int64()), ("ended", pa.int64()), ("open", pa.bool_()))

    def __init__(self, ttl_seconds: int, lateness_seconds: int):
        self._ttl_ms = ttl_seconds * 1000
        self._keep_ms = self._ttl_ms + lateness_seconds * 1000

    def _rows(self, request_id, change, ms) -> pd.DataFrame:
        return pd.DataFrame({"request_id": request_id, "change": change, "at_ms": ms})

    def _first(self, batch: pd.DataFrame) -> pd.DataFrame:
        """Earliest start and end and latest arrival of each key."""
        names, (codes,) = _codes(batch["request_id"])
        n, known = len(names), batch["at_ms"].notna().to_numpy()
        out = {"request_id": names, "now": _most(n, codes, batch["arrived_ms"])}
        for kind in ("start", "end"):
            own = known & (batch["kind"] == kind).to_numpy()
            out[kind] = _least(n, codes[own], batch["at_ms"].to_numpy()[own])
        return pd.DataFrame(out)

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat([self._first(batch) for batch in rows], ignore_index=True)
        table, timer = self._load()
        names, (old, come) = _codes(table["request_id"], new["request_id"])
        n = len(names)
        started, ended, due = (_most(n, old, table[c]) for c in ("started", "ended", "due_ms"))
        is_open = np.zeros(n, bool)
        is_open[old] = table["open"].to_numpy(bool)
        now, start, end = _most(n, come, new["now"]), _least(n, come, new["start"]), _least(n, come, new["end"])

        opens = (started == _NEVER) & (start != _FAR)
        early = (started == _NEVER) & ~opens & (ended == _NEVER) & (end != _FAR)
        due = np.where(opens, np.maximum(start, now) + self._keep_ms, np.where(early, np.maximum(end, now) + self._keep_ms, due))
        started = np.where(opens, start, started)
        is_open |= opens
        if opens.any():
            yield self._rows(names[opens], "registered", started[opens])
        ended = np.where(end == _FAR, ended, np.where(ended == _NEVER, end, np.minimum(ended, end)))
        closes = is_open & (ended != _NEVER)
        if closes.any():
            # An end that comes after the time to live finds the stream already gone.
            at, expiry = ended[closes], started[closes] + self._ttl_ms
            yield self._rows(names[closes], np.where(at > expiry, "expired", "ended"), np.minimum(at, expiry))
        kept = (started != _NEVER) | (ended != _NEVER)
        left = {"request_id": names, "started": started, "ended": ended, "open": is_open & ~closes, "due_ms": due}
        self._store(pd.DataFrame(left)[kept], timer)

    def _expired(self, table, over):
        gone = table[over & table["open"].to_numpy(bool)]
        return table[~over], self._rows(gone["request_id"], "expired", gone["started"] + self._ttl_ms)


def track_streams(
    changes: DataFrame,
    ttl_seconds: int = STREAM_TTL_SECONDS,
    lateness_seconds: int = LATENESS_SECONDS,
    slots: int = SLOTS,
) -> DataFrame:
    """Stream lifecycle (request_id, kind start|end, at) to registry changes.

    Emits registered, ended and expired rows; registered minus the other two is what is live.  A
    stream without an end expires once arrival is `lateness_seconds` past its time to live.
    """
    return _by_slot(
        arriving(changes), ["request_id"], ["kind", F.unix_millis("at").alias("at_ms")], slots,
        _LiveStream(ttl_seconds, lateness_seconds),
        "request_id string, change string, at_ms long",
    )


class _FirstCancel(_Slot):
    """Keeps a stream's cancels until its end is past, then gives the earliest one in time.

    A row of the table is a stream's span with its earliest cancel, if there is one, or a cancel that waits for its stream.
    """

    _SHAPE = (("request_id", pa.string()), ("started", pa.int64()), ("ended", pa.int64()), ("at", pa.int64()))

    def __init__(self, lateness_seconds: int, wait_seconds: int):
        self._lateness_ms = lateness_seconds * 1000
        self._wait_ms = wait_seconds * 1000

    def handleInputRows(self, key, rows, timerValues):
        spans, asked, seen = [], [], []
        for batch in rows:
            known = batch["started_us"].notna() & batch["ended_us"].notna()
            spans.append(batch.loc[(batch["kind"] == "span") & known, ["request_id", "started_us", "ended_us"]])
            cancels = batch.loc[(batch["kind"] == "cancel") & batch["at_us"].notna(), ["request_id", "at_us"]]
            asked.append(cancels.drop_duplicates())
            seen.append(batch.groupby("request_id", dropna=False, sort=False)["arrived_ms"].max().reset_index())
        spans, asked, seen = (pd.concat(parts, ignore_index=True) for parts in (spans, asked, seen))
        table, timer = self._load()
        open_before = table["started"].to_numpy() != _NEVER
        had, waited = table[open_before], table[~open_before]
        names, (c_had, c_waited, c_spans, c_asked, c_seen) = _codes(*(t["request_id"] for t in (had, waited, spans, asked, seen)))
        n = len(names)
        now = _most(n, c_seen, seen["arrived_ms"])
        started, ended, due = (_most(n, c_had, had[c]) for c in ("started", "ended", "due_ms"))
        start, end = _least(n, c_spans, spans["started_us"]), _least(n, c_spans, spans["ended_us"])
        opens = (started == _NEVER) & (start != _FAR)
        started, ended = np.where(opens, start, started), np.where(opens, end, ended)
        due = np.where(opens, np.maximum(end // 1000, now) + self._lateness_ms, due)
        is_open = started != _NEVER

        codes = np.concatenate([c_had, c_waited, c_asked])
        at = np.concatenate([had["at"].to_numpy(np.int64), waited["at"].to_numpy(np.int64), asked["at_us"].to_numpy(np.int64)])
        in_time = is_open[codes] & (started[codes] <= at) & (at <= ended[codes])
        best = _least(n, codes[in_time], at[in_time])
        waiting = pd.DataFrame({"code": codes, "at": at})[~is_open[codes]].drop_duplicates()
        until = np.maximum(_most(n, waiting["code"], waiting["at"]) // 1000, now) + self._wait_ms
        until = np.where(now == _NEVER, _most(n, c_waited, waited["due_ms"]), until)
        w = waiting["code"].to_numpy()
        left = {
            "request_id": np.concatenate([names[is_open], names[w]]),
            "started": np.concatenate([started[is_open], np.full(len(w), _NEVER)]),
            "ended": np.concatenate([ended[is_open], np.full(len(w), _NEVER)]),
            "at": np.concatenate([best[is_open], waiting["at"].to_numpy()]),
            "due_ms": np.concatenate([due[is_open], until[w]]),
        }
        self._store(pd.DataFrame(left), timer)
        return iter(())

    def _expired(self, table, over):
        found = table[over & (table["started"] != _NEVER) & (table["at"] != _FAR)]
        return table[~over], pd.DataFrame({"request_id": found["request_id"], "cancel_us": found["at"]})


def first_cancels(
    changes: DataFrame, lateness_seconds: int = LATENESS_SECONDS, wait_seconds: int = 7 * 86_400, slots: int = SLOTS
) -> DataFrame:
    """request_id and cancel_us from rows (request_id, kind span|cancel, started_us, ended_us, at_us).

    A cancel waits for its stream for `wait_seconds`; what names no stream by then has no effect.
    """
    return _by_slot(
        arriving(changes), ["request_id"], ["kind", "started_us", "ended_us", "at_us"], slots,
        _FirstCancel(lateness_seconds, wait_seconds),
        "request_id string, cancel_us long",
    )


class _RateCounter(_Slot):
    """Counts each (conversation, bucket): micro-batches in their order, and requests by time in each.

    Holds no more than the requests that can still be admitted; the rest is refused as it comes.
    """

    _SHAPE = (("conversation_id", pa.string()), ("rate_bucket", pa.int64()), ("seen", pa.int64()))

    def __init__(self, limit: int, bucket_seconds: int, lateness_seconds: int):
        self._limit = limit
        self._bucket_ms = bucket_seconds * 1000
        self._lateness_ms = lateness_seconds * 1000

    def handleInputRows(self, key, rows, timerValues):
        table, timer = self._load()
        held, come = None, []
        for batch in rows:
            bucket = batch["rate_bucket"].fillna(_NEVER).astype("int64")
            batch = batch[["request_id", "conversation_id", "at_us", "arrived_ms"]].assign(rate_bucket=bucket)
            came = batch.groupby(_RATE_KEYS, dropna=False, sort=False).agg(seen=("arrived_ms", "size"), now=("arrived_ms", "max"))
            come.append(came.reset_index())
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            _, n, (old, own) = _pairs(table, held)
            free = np.maximum(self._limit - np.maximum(_most(n, old, table["seen"]), 0), 0)
            held = held.assign(_own=own).sort_values(["_own", "at_us", "request_id"])
            over = held.groupby("_own").cumcount().to_numpy() >= free[held["_own"].to_numpy()]
            if over.any():
                yield self._decided(held[over], True)
            held = held[~over].drop(columns="_own")
        if held is not None and len(held):
            yield self._decided(held, False)
        came = pd.concat(come, ignore_index=True)
        keys, n, (old, own) = _pairs(table, came)
        seen = np.zeros(n, np.int64)
        np.add.at(seen, old, table["seen"].to_numpy(np.int64))
        np.add.at(seen, own, came["seen"].to_numpy(np.int64))
        bucket, now = keys["rate_bucket"].to_numpy(), _most(n, own, came["now"])
        ends = np.where(bucket == _NEVER, now, (np.where(bucket == _NEVER, 0, bucket) + 1) * self._bucket_ms)
        due = np.where(now == _NEVER, _NEVER, np.maximum(ends, now) + self._lateness_ms)
        self._store(keys.assign(seen=seen, due_ms=np.maximum(due, _most(n, old, table["due_ms"]))), timer)

    def _decided(self, rows: pd.DataFrame, over: bool) -> pd.DataFrame:
        bucket = rows["rate_bucket"].astype("Int64").mask(rows["rate_bucket"] == _NEVER)
        return rows[["request_id", "conversation_id"]].assign(rate_bucket=bucket, over_rate=over)


_RATE_KEYS = ["conversation_id", "rate_bucket"]


def _pairs(*tables: pd.DataFrame) -> tuple[pd.DataFrame, int, list[np.ndarray]]:
    """The different conversations and buckets of all tables, their number, and each table's rows as places in them."""
    keys = pd.concat([t[_RATE_KEYS] for t in tables], ignore_index=True)
    _, (conversation,) = _codes(keys["conversation_id"])
    _, bucket = np.unique(keys["rate_bucket"].to_numpy(np.int64), return_inverse=True)
    _, first, codes = np.unique(conversation * (bucket.max(initial=0) + 1) + bucket, return_index=True, return_inverse=True)
    return keys.iloc[first].reset_index(drop=True), len(first), np.split(codes, np.cumsum([len(t) for t in tables])[:-1])


def limit_rate(
    requests: DataFrame,
    limit: int = REQUESTS_PER_MINUTE,
    bucket_seconds: int = 60,
    lateness_seconds: int = LATENESS_SECONDS,
    slots: int = SLOTS,
) -> DataFrame:
    """Live form of the rate check: request_id, conversation_id, started_at in, one decision each out.

    Dealt by conversation and bucket, so one busy conversation spreads over its buckets.  A
    request that comes after its bucket is forgotten starts a new count.
    """
    timed = arriving(requests).withColumns(
        {
            "rate_bucket": rate_bucket(F.col("started_at"), bucket_seconds),
            "at_us": F.unix_micros("started_at"),
        }
    )
    return _by_slot(
        timed, _RATE_KEYS, ["request_id", "at_us"], slots,
        _RateCounter(limit, bucket_seconds, lateness_seconds),
        "request_id string, conversation_id string, rate_bucket long, over_rate boolean",
    )


class _TokenBucket(_Slot):
    """Buckets that refill steadily; an admitted request takes one token.

    Requests wait until arrival is past their time by the lateness, and are then decided in the order
    of their times.  One that comes later still is decided at once, at the bucket's present level.

    A row of the table is a bucket's level (`at_ms` is the time it holds for) or a request that waits.
    """

    _SHAPE = (("conversation_id", pa.string()), ("request_id", pa.string()), ("waits", pa.bool_()), ("at_ms", pa.int64()), ("tokens", pa.float64()))

    def __init__(self, capacity: float, per_second: float, lateness_seconds: int):
        self._capacity = capacity
        self._rate = per_second
        self._lateness_ms = lateness_seconds * 1000
        self._refill_ms = int(capacity / per_second * 1000) + 1

    def _due(self, at):
        """When a request is decided, in whole seconds."""
        return -(-(at + self._lateness_ms) // 1000) * 1000

    def _decide(self, levels: pd.DataFrame, requests: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """The levels after some requests, which carry the time `now` of their decision, and the decisions."""
        names, (old, own) = _codes(levels["conversation_id"], requests["conversation_id"])
        n = len(names)
        tokens, last = np.full(n, self._capacity), np.full(n, _NEVER)
        tokens[old], last[old] = levels["tokens"], levels["at_ms"]
        tokens, last = tokens.tolist(), last.tolist()
        requests = requests.assign(_own=own).sort_values(["_own", "at_ms", "request_id"])
        over = []
        for k, at in zip(requests["_own"].tolist(), requests["at_ms"].tolist(), strict=True):
            gained = 0.0 if last[k] == _NEVER else max(at - last[k], 0) / 1000 * self._rate
            level = min(self._capacity, tokens[k] + gained)
            last[k] = max(at, last[k])
            over.append(level < 1.0)
            tokens[k] = level - (0.0 if over[-1] else 1.0)
        now, last = _most(n, own, requests.sort_index()["now"]), np.array(last, np.int64)
        kept = _most(n, old, levels["due_ms"])
        due = np.where(now == _NEVER, kept, self._due(np.maximum(last, now) + self._refill_ms))
        after = pd.DataFrame({"conversation_id": names, "request_id": None, "waits": False, "at_ms": last, "tokens": tokens, "due_ms": due})
        return after, requests[["request_id", "conversation_id"]].assign(over_rate=over)

    def handleInputRows(self, key, rows, timerValues):
        now = int(timerValues.getCurrentWatermarkInMs())
        come = pd.concat(list(rows), ignore_index=True)
        come["now"] = come.groupby("conversation_id", dropna=False, sort=False)["arrived_ms"].transform("max")
        come = come.assign(at_ms=come["at_ms"].astype("int64"), waits=True, tokens=np.nan)
        come["due_ms"] = self._due(come["at_ms"])
        late = (come["due_ms"] <= now).to_numpy()
        table, timer = self._load()
        if late.any():
            waits = table["waits"].to_numpy(bool)
            levels, decided = self._decide(table[~waits], come[late].reset_index(drop=True))
            yield decided
            table = pd.concat([table[waits], levels], ignore_index=True)
        wait = come.loc[~late, table.columns]
        self._store(pd.concat([t for t in (table, wait) if len(t)], ignore_index=True) if len(table) + len(wait) else table, timer)

    def _expired(self, table, over):
        waits = table["waits"].to_numpy(bool)
        ready, waiting, levels = table[over & waits], table[~over & waits], table[~waits]
        # A bucket is forgotten when it is full again, which is how a new one starts; not while requests wait or are decided.
        names, (busy, own) = _codes(table.loc[waits, "conversation_id"], levels["conversation_id"])
        in_use = np.zeros(len(names), bool)
        in_use[busy] = True
        full = over[~waits]
        levels = levels.assign(due_ms=np.where(full, _FAR, levels["due_ms"]))[~full | in_use[own]]
        after, decided = self._decide(levels, ready.assign(now=ready["due_ms"]).reset_index(drop=True))
        return pd.concat([t for t in (waiting, after) if len(t)], ignore_index=True) if len(waiting) + len(after) else waiting, decided


def token_bucket(
    requests: DataFrame, capacity: int, per_minute: float, lateness_seconds: int = LATENESS_SECONDS, slots: int = SLOTS
) -> DataFrame:
    """Smooth alternative to fixed buckets: bursts up to `capacity`, then `per_minute` steadily.

    Each decision depends on the one before, so a conversation is one sequence; only the
    requests of the last `lateness_seconds` and the level are kept.  A request without a time has that of its arrival.
    """
    return _by_slot(
        arriving(requests), ["conversation_id"], ["request_id", F.coalesce(F.unix_millis("started_at"), "arrived_ms").alias("at_ms")], slots,
        _TokenBucket(float(capacity), per_minute / 60.0, lateness_seconds),
        "request_id string, conversation_id string, over_rate boolean",
    )
