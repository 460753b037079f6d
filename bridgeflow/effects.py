"""What a run of rows does to any state it may meet: summaries that let the pieces of one key be walked side by side.

``ordered_fold`` cuts a long key into pieces. With an effect, every piece is summed up at the same
time, whatever state it will be entered with, and the summaries are then applied one after another,
so the number of jobs does not grow with the pieces. An effect has ``start()``, ``add(acc, rows)``,
``finish(acc)``, which gives a summary, and ``apply(summary, state)``.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pandas as pd

SECOND = 1_000_000


@dataclass
class Groups:
    """Entry states that have become one. Entry times below ``bound`` have run out, in the ranges that
    end at ``cuts``; those from ``bound`` on are as they were."""

    parent: list[int] = field(default_factory=list)
    cuts: list[int] = field(default_factory=list)
    of_cut: list[int] = field(default_factory=list)
    alive: deque = field(default_factory=deque)  # (time, group), oldest first
    bound: int | None = None
    first: int | None = None

    def new(self) -> int:
        self.parent.append(len(self.parent))
        return len(self.parent) - 1

    def root(self, g: int) -> int:
        while self.parent[g] != g:
            self.parent[g] = g = self.parent[self.parent[g]]
        return g

    def one(self, groups: list[int]) -> int:
        for g in groups[1:]:
            self.parent[g] = groups[0]
        return groups[0]

    def run_out(self, t: int, limit: int) -> list[int]:
        """Groups whose time is below ``limit`` by ``t``, among them the entry times that newly are."""
        gone = []
        while self.alive and self.alive[0][0] < limit:
            gone.append(self.alive.popleft()[1])
        if self.bound is None or self.bound < limit and self.bound <= self.first:
            self.first = t if self.first is None else self.first
            self.bound = limit
            g = self.new()
            self.cuts.append(limit)
            self.of_cut.append(g)
            gone.append(g)
        return gone

    def ranges(self, state_of: dict) -> tuple[list[int], list]:
        """Upper ends of the ranges of entry times and the state each has become, neighbours joined."""
        cuts, states = [], []
        for cut, g in zip(self.cuts, self.of_cut):
            state = state_of[self.root(g)]
            if states and states[-1] == state:
                cuts[-1] = cut
            else:
                cuts.append(cut)
                states.append(state)
        return cuts, states


class DedupeEffect:
    """State: the first sighting that is remembered, or None."""

    def __init__(self, time: str, ttl: int) -> None:
        self.time, self.ttl = time, ttl

    def start(self) -> Groups:
        return Groups()

    def add(self, acc: Groups, rows: pd.DataFrame) -> Groups:
        for t in rows[self.time].tolist():
            gone = acc.run_out(t, t - self.ttl)
            if gone:
                acc.alive.append((t, acc.one(gone)))
        return acc

    def finish(self, acc: Groups) -> tuple:
        return acc.ranges({acc.root(g): t for t, g in acc.alive})

    def apply(self, summary: tuple, first: int | None) -> int | None:
        cuts, states = summary
        i = 0 if first is None else bisect_right(cuts, first)
        return states[i] if i < len(cuts) else first


class BreakerEffect:
    """State: mode and trip time; closed, or open since a time. Rows carry the trip condition as ``__full``."""

    def __init__(self, time: str, failed: str, half_open: int) -> None:
        self.time, self.failed, self.half_open = time, failed, half_open

    def start(self) -> tuple[Groups, int, list]:
        groups = Groups()
        entered_closed = groups.new()
        return groups, entered_closed, [entered_closed]

    def add(self, acc: tuple, rows: pd.DataFrame) -> tuple:
        groups, _, closed = acc
        for t, bad, full in zip(rows[self.time].tolist(), rows[self.failed].tolist(), rows["__full"].tolist()):
            probing = groups.run_out(t, t - self.half_open + 1)
            opened = closed[:] if full else []
            stay = [] if full else closed[:]
            if bad:
                opened += probing
            else:
                stay += probing
            if opened:
                groups.alive.append((t, groups.one(opened)))
            closed[:] = [groups.one(stay)] if stay else []
        return acc

    def finish(self, acc: tuple) -> tuple:
        groups, entered_closed, closed = acc
        state_of = {groups.root(g): ("open", t) for t, g in groups.alive} | {groups.root(g): ("closed", 0) for g in closed}
        return state_of[groups.root(entered_closed)], groups.ranges(state_of)

    def apply(self, summary: tuple, state: tuple) -> tuple:
        if_closed, (cuts, states) = summary
        if state[0] == "closed":
            return if_closed
        i = bisect_right(cuts, state[1])
        return states[i] if i < len(cuts) else state


class Bucket:
    """A token bucket in whole units: a microsecond refills ``gain`` of them and a token is ``cost``, so that no
    order of summation changes an answer."""

    def __init__(self, rate_hz: float, capacity: float) -> None:
        # the simplest fraction near the rate
        rate = Fraction(rate_hz).limit_denominator(10**6) if rate_hz >= 1 else 1 / Fraction(1 / rate_hz).limit_denominator(10**6)
        self.gain, self.cost = rate.numerator, SECOND * rate.denominator
        self.full = int(Fraction(capacity).limit_denominator(10**9) * self.cost)

    def refill(self, credit: int, last: int | None, t: int) -> int:
        return credit if last is None else min(self.full, credit + (t - last) * self.gain)

    def take(self, credit: int, last: int | None, t: int) -> tuple[bool, int]:
        """Refill since ``last`` and take one token if there is one."""
        credit = self.refill(credit, last, t)
        return (True, credit - self.cost) if credit >= self.cost else (False, credit)


class BucketEffect:
    """State: credit left and time of the last message. What the credit at the first message becomes is
    kept as ranges from ``lo`` on, each moved as a whole or, after an overflow, fallen together."""

    def __init__(self, time: str, bucket: Bucket) -> None:
        self.time, self.bucket = time, bucket

    def start(self) -> dict:
        return {"first": None, "last": None, "lo": np.zeros(1, np.int64), "v": np.zeros(1, np.int64), "flat": np.zeros(1, bool)}

    def _split(self, acc: dict, at: np.ndarray, above: int, value: int, flat: bool) -> None:
        """Cut ranges ``at`` where their value reaches ``above``; the upper parts begin with ``value``."""
        cut = acc["lo"][at] + (above - acc["v"][at])
        acc["lo"] = np.insert(acc["lo"], at + 1, cut)
        acc["v"] = np.insert(acc["v"], at + 1, value)
        acc["flat"] = np.insert(acc["flat"], at + 1, flat)

    def _tops(self, acc: dict) -> np.ndarray:
        lo = acc["lo"]
        return acc["v"] + np.where(acc["flat"], 0, np.r_[lo[1:], self.bucket.full + 1] - lo - 1)

    def _refill(self, acc: dict, gained: int) -> None:
        full = self.bucket.full
        acc["v"] = acc["v"] + min(gained, full)
        over = np.flatnonzero((acc["v"] < full) & (self._tops(acc) > full))
        if len(over):
            self._split(acc, over, full, full, True)
        high = acc["v"] >= full
        acc["v"][high] = full
        acc["flat"] |= high

    def _take(self, acc: dict) -> None:
        cost = self.bucket.cost
        over = np.flatnonzero((acc["v"] < cost) & (self._tops(acc) >= cost))
        if len(over):
            self._split(acc, over, cost, cost, False)
        acc["v"] = acc["v"] - np.where(acc["v"] >= cost, cost, 0)

    def _join(self, acc: dict) -> None:
        lo, v, flat = acc["lo"], acc["v"], acc["flat"]
        same = (flat[1:] & flat[:-1] & (v[1:] == v[:-1])) | (~flat[1:] & ~flat[:-1] & (np.diff(v) == np.diff(lo)))
        if same.any():
            keep = np.r_[True, ~same]
            acc["lo"], acc["v"], acc["flat"] = lo[keep], v[keep], flat[keep]

    def add(self, acc: dict, rows: pd.DataFrame) -> dict:
        for t in rows[self.time].tolist():
            if len(acc["v"]) == 1 and acc["flat"][0]:
                acc["v"][0] = self.bucket.take(int(acc["v"][0]), acc["last"], t)[1]
            else:
                if acc["last"] is None:
                    acc["first"] = t
                else:
                    self._refill(acc, (t - acc["last"]) * self.bucket.gain)
                self._take(acc)
                self._join(acc)
            acc["last"] = t
        return acc

    def finish(self, acc: dict) -> dict:
        return {k: x.tolist() if isinstance(x, np.ndarray) else x for k, x in acc.items()}

    def apply(self, summary: dict, state: tuple) -> tuple:
        credit, last = state
        x = self.bucket.refill(credit, last, summary["first"])
        i = bisect_right(summary["lo"], x) - 1
        return (summary["v"][i] + (0 if summary["flat"][i] else x - summary["lo"][i]), summary["last"])
