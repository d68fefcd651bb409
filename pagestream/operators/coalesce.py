"""Near-equal messages of a carrier shown once, in their least garbled form.

Equal bodies within the expiry never reach the comparison: a window function drops them first. What is left
is replayed in time order, carrier by carrier; a carrier is cut where it was silent for the expiry, since no
group outlives that, and the parts are replayed apart. The state of a replay is the groups of the last
expiry only, so memory is bounded by the rate of a carrier and not by its length.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagestream.operators.messages import first_within, micros

# Seconds, and shares.
HOLD, EXPIRY = 4, 180
RATIO, LENGTHS = 0.85, 0.7


def garbled(body: str) -> tuple[int, int]:
    """Smaller is less garbled: characters that are no letters, then the longer body."""
    return sum(not c.isalpha() for c in body), -len(body)


def alike(held: str, body: str) -> bool:
    """Lengths first; the ratio isn't symmetric, so the held body stands first."""
    short, long = sorted((len(held), len(body)))
    return short >= LENGTHS * max(long, 1) and difflib.SequenceMatcher(None, held, body).ratio() >= RATIO


@dataclass
class Group:
    body: str
    first: int
    last: int
    n: int = 1
    shown: bool = False


class Groups:
    """The live groups of one carrier; times in microseconds."""

    def __init__(self, state: list[dict] | None = None):
        self.live = [Group(**g) for g in state or []]

    def state(self) -> list[dict]:
        return [asdict(g) for g in self.live]

    def advance(self, now: int) -> list[Group]:
        """Groups whose hold is over at now; those past their expiry are forgotten."""
        due = [g for g in self.live if not g.shown and g.first + HOLD * 1_000_000 <= now]
        for g in due:
            g.shown = True
        self.live = [g for g in self.live if g.last + EXPIRY * 1_000_000 > now]
        return due

    def offer(self, now: int, body: str) -> None:
        """To the oldest live group that is alike, or a new one."""
        home = next((g for g in self.live if alike(g.body, body)), None)
        if home is None:
            self.live.append(Group(body, now, now))
            return
        home.last, home.n = now, home.n + 1
        if not home.shown and garbled(body) < garbled(home.body):
            home.body = body

    def next_due(self) -> int | None:
        return min((g.first + HOLD * 1_000_000 if not g.shown else g.last + EXPIRY * 1_000_000 for g in self.live), default=None)


def _replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    at, groups = None, Groups()

    def rows(carrier, shown):
        return [(carrier, g.first, g.body) for g in shown]

    for frame in frames:
        out = []
        for carrier, part, t, body in frame.itertuples(index=False):
            if (carrier, part) != at:
                if at is not None:
                    out += rows(at[0], groups.advance(1 << 62))
                at, groups = (carrier, part), Groups()
            out += rows(carrier, groups.advance(t))
            groups.offer(t, body)
        yield pd.DataFrame(out, columns=["carrier", "t", "body"])
    if at is not None:
        yield pd.DataFrame(rows(at[0], groups.advance(1 << 62)), columns=["carrier", "t", "body"])


def coalesce(messages: DataFrame, tie: str) -> DataFrame:
    """(carrier, t, body) shown, of messages(carrier, ts, body); t: microseconds of a group's first message.
    Null or blank bodies and null times go; a null carrier is a carrier."""
    m = messages.select(F.col("carrier").cast("string").alias("carrier"), "ts", F.trim("body").alias("body"), F.col(tie).alias("tie"))
    m = first_within(m.where("ts IS NOT NULL AND body != ''"), ["carrier", "body"], "ts", EXPIRY, "tie").withColumn("t", micros("ts"))
    w = Window.partitionBy("carrier").orderBy("t", "tie")
    silent = F.coalesce(F.col("t") - F.lag("t").over(w) >= EXPIRY * 1_000_000, F.lit(True))
    m = m.withColumn("part", F.sum(silent.cast("int")).over(w))
    dealt = m.repartition("carrier", "part").sortWithinPartitions("carrier", "part", "t", "tie")
    return dealt.select(F.coalesce("carrier", F.lit("")).alias("carrier"), "part", "t", "body").mapInPandas(_replay, "carrier string, t long, body string")
