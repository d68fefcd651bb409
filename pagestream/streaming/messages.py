"""Message operators over streams, by event time: repeats, fragments and near-equal messages.

Rows of a batch are replayed in time order; timers are event-time timeouts, so results don't depend on when a
batch runs as long as no row is later than the watermark. State of a key ends with its last timer.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagestream.operators.coalesce import EXPIRY, Groups
from pagestream.operators.messages import micros

SECOND = 1_000_000


def _keyed(stream: DataFrame, late: str, *columns: str) -> DataFrame:
    return stream.withWatermark("ts", late).where("ts IS NOT NULL").select("ts", micros("ts").alias("t"), *columns)


def _wake(state: GroupState, due: int | None) -> None:
    """Calls the key again when the watermark passes `due`, or ends its state."""
    if due is None:
        state.remove()
    else:
        state.setTimeoutTimestamp(max(-(-due // 1000), state.getCurrentWatermarkMs() + 1))


def _times(frames: Iterator[pd.DataFrame], *columns: str) -> list[tuple]:
    return sorted(row for f in frames for row in f[list(columns)].itertuples(index=False, name=None))


def first_seen(stream: DataFrame, late: str = "10 seconds") -> DataFrame:
    """(carrier, t, body) of stream(carrier, ts, body) not seen in the 180 s before; a repeat renews the wait."""

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        last, out = state.get[0] if state.exists else None, []
        for (t,) in _times(frames, "t"):
            if last is None or t - last >= EXPIRY * SECOND:
                out.append((*key[:1], t, key[1]))
            last = t if last is None else max(last, t)
        state.update((last,))
        _wake(state, last + EXPIRY * SECOND)
        yield pd.DataFrame(out, columns=["carrier", "t", "body"])

    keyed = _keyed(stream, late, F.coalesce("carrier", F.lit("")).alias("carrier"), F.trim("body").alias("body")).where("body != ''")
    return keyed.groupBy("carrier", "body").applyInPandasWithState(run, "carrier string, t long, body string", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def stitched(stream: DataFrame, timeout: int = 8, late: str = "10 seconds") -> DataFrame:
    """(capcode, t, body, n_parts) of stream(capcode, ts, flag, body): F opens, C within the timeout appends or
    stands alone, K closes and stands alone. t: time of the first part."""

    def run(key, frames, state):
        start, last, parts = (state.get[0], state.get[1], json.loads(state.get[2])) if state.exists else (None, None, [])
        out = []

        def close():
            nonlocal parts
            if parts:
                out.append((*key, start, "".join(parts), len(parts)))
            parts = []

        if state.hasTimedOut:
            close()
        for t, flag, body in [] if state.hasTimedOut else _times(frames, "t", "flag", "body"):
            if parts and t - last >= timeout * SECOND:
                close()
            if flag == "C" and parts:
                parts.append(body)
                last = t
                continue
            if flag != "C":
                close()
            if flag == "F":
                start, last, parts = t, t, [body]
            else:
                out.append((*key, t, body, 1))
        if parts:
            state.update((start, last, json.dumps(parts)))
            _wake(state, last + timeout * SECOND)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["capcode", "t", "body", "n_parts"])

    keyed = _keyed(stream, late, F.coalesce("capcode", F.lit("")).alias("capcode"), F.coalesce("flag", F.lit("K")).alias("flag"), F.coalesce("body", F.lit("")).alias("body"))
    return keyed.groupBy("capcode").applyInPandasWithState(run, "capcode string, t long, body string, n_parts long", "start long, last long, parts string", "append", GroupStateTimeout.EventTimeTimeout)


def coalesced(stream: DataFrame, late: str = "10 seconds") -> DataFrame:
    """(carrier, t, body) of stream(carrier, ts, body): near-equal bodies once, as operators.coalesce does. The
    state of a carrier is its live groups and the bodies of the last 180 s."""

    def run(key, frames, state):
        groups, seen = Groups(), {}
        if state.exists:
            kept = json.loads(state.get[0])
            groups, seen = Groups(kept["groups"]), kept["seen"]
        shown = []
        if state.hasTimedOut:
            now = state.getCurrentWatermarkMs() * 1000
            shown += groups.advance(now)
        else:
            now = 0
            for now, body in _times(frames, "t", "body"):
                shown += groups.advance(now)
                fresh = now - seen.get(body, now - EXPIRY * SECOND) >= EXPIRY * SECOND
                seen[body] = now
                if fresh:
                    groups.offer(now, body)
        seen = {b: t for b, t in seen.items() if t + EXPIRY * SECOND > now}
        state.update((json.dumps({"groups": groups.state(), "seen": seen}),))
        ends = [t + EXPIRY * SECOND for t in seen.values()] + [d for d in [groups.next_due()] if d is not None]
        _wake(state, min(ends, default=None))
        yield pd.DataFrame([(*key, g.first, g.body) for g in shown], columns=["carrier", "t", "body"])

    keyed = _keyed(stream, late, F.coalesce("carrier", F.lit("")).alias("carrier"), F.trim("body").alias("body")).where("body != ''")
    return keyed.groupBy("carrier").applyInPandasWithState(run, "carrier string, t long, body string", "kept string", "append", GroupStateTimeout.EventTimeTimeout)
