"""Epochs of a live trace, with one state per manager.

Whether an epoch advances depends on all threads of a manager, so its operations are folded in order
of seq by one task; the state holds what the manager itself would: its threads, and how many
objects of each epoch wait where.  A row at or below the last seq seen of its manager is told as
``late`` and left out.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.functions.epochs import FIRST_EPOCH, GRACE, RULES, Rules, is_effective
from stillwater.session import ship

EVENTS = "manager_id long, participant string, seq long, event string, blocked boolean, epoch_after long, n_freed long"


class _Thread:
    def __init__(self):
        self.depth, self.pinned, self.waiting = 0, None, Counter()


class Machine:
    """The state of one manager; ``apply`` gives the attempts of an operation (blocked, epoch after, objects freed)."""

    def __init__(self, rules: Rules = RULES):
        self.rules, self.epoch, self.last = rules, FIRST_EPOCH, None
        self.threads: dict[int, _Thread] = {}
        self.ends: Counter = Counter()
        self.buckets: dict[int, Counter] = defaultdict(Counter)

    def apply(self, thread: int, op: str) -> list[tuple[bool, int, int]]:
        if op == "thread_exit" and thread not in self.threads:
            return []
        me = self.threads.setdefault(thread, _Thread())
        if op == "enter":
            me.pinned = self.epoch if me.depth == 0 else me.pinned
            me.depth += 1
        elif op == "exit":
            me.depth = max(0, me.depth - 1)
            if me.depth == 0:
                me.pinned = None
                if me.waiting.total() >= self.rules.exit_batch:
                    self._hand_over(me)
        elif op == "retire":
            me.waiting[self.epoch] += 1
            if me.waiting.total() >= self.rules.batch:
                self._hand_over(me)
                return [self._attempt()]
        else:
            self._hand_over(me)
            if op == "thread_exit":
                del self.threads[thread]
                self.ends[thread] += 1
            return [self._attempt()]
        return []

    def _hand_over(self, me: _Thread) -> None:
        for epoch, n in me.waiting.items():
            self.buckets[epoch % self.rules.buckets][epoch] += n
        me.waiting = Counter()

    def _attempt(self) -> tuple[bool, int, int]:
        blocked = any(t.pinned not in (None, self.epoch) for t in self.threads.values())
        self.epoch += not blocked
        bucket, safe = self.buckets[(self.epoch - GRACE) % self.rules.buckets], self.epoch - GRACE
        due = [e for e in bucket if e <= safe]
        return blocked, self.epoch, sum(bucket.pop(e) for e in due)


def _advance(rules: Rules) -> Callable:
    def run(key: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        machine = pickle.loads(state.get[0]) if state.exists else Machine(rules)
        rows, out = pd.concat(list(batches)).sort_values("seq", kind="stable"), []
        for seq, thread, op in zip(rows["seq"].tolist(), rows["thread_id"].tolist(), rows["op"].tolist(), strict=True):
            name = f"{thread}:{machine.ends[thread]}"
            if machine.last is not None and seq <= machine.last:
                out.append((key[0], name, seq, "late", None, None, None))
                continue
            machine.last = seq
            out += [(key[0], name, seq, "attempt", *told) for told in machine.apply(thread, op)]
        state.update((pickle.dumps(machine),))
        if out:
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])
            yield frame.astype({"participant": object, "event": object, "blocked": "boolean", "epoch_after": "Int64", "n_freed": "Int64"})

    return run


def manager_events(ops: DataFrame, rules: Rules = RULES) -> DataFrame:
    """A stream of attempts to advance the epoch, and of late rows, from a stream of trace rows."""
    ship(ops.sparkSession)
    rows = ops.where(is_effective(F.col("op"), F.col("ptr"), F.col("deleter"))).select("manager_id", "thread_id", "seq", "op")
    return rows.groupBy("manager_id").applyInPandasWithState(_advance(rules), EVENTS, "machine binary", "append", "NoTimeout")
