"""Pins and hand-overs of a live trace, with one state per thread.

Rows of a micro-batch are sorted by seq inside each thread.  A row at or below the last seq seen
of its thread would change the order of what is already told, so it is told as ``late`` and left
out.  There is no event time; ``streaming.managers`` tells of epochs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.functions.epochs import is_effective
from stillwater.operators.flushes import step
from stillwater.session import ship

EVENTS = "manager_id long, participant string, seq long, event string, open_seq long, n_nodes long"
_STATE = "last_seq long, generation long, depth long, open_seq long, size long, live boolean"


def _advance(key: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    last, generation, depth, opened, size, live = state.get if state.exists else (-(1 << 63), 0, 0, None, 0, False)
    manager, thread = key
    out = []
    rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
    for seq, op in zip(rows["seq"].tolist(), rows["op"].tolist(), strict=True):
        name = f"{thread}:{generation}"
        if seq <= last:
            out.append((manager, name, seq, "late", None, None))
            continue
        last, kind, ends = seq, None, False
        if op == "thread_exit" and not live:  # of no participant
            continue
        live = op != "thread_exit"
        if op == "enter":
            depth += 1
            if depth == 1:
                opened = seq
                out.append((manager, name, seq, "pin", seq, None))
        elif op == "exit":
            if depth == 0:
                out.append((manager, name, seq, "unbalanced", None, None))
            depth = max(0, depth - 1)
            ends, kind = depth == 0, 1 if depth == 0 else None
        else:
            kind = 0 if op == "retire" else 2
            ends = op == "thread_exit"
        if kind is not None:
            before = size + (kind == 0)
            size, flushed = step(size, kind)
            if flushed:
                out.append((manager, name, seq, "flush", None, before))
        if ends and opened is not None:
            out.append((manager, name, seq, "unpin", opened, None))
            opened = None
        if op == "thread_exit":
            generation, depth = generation + 1, 0
    state.update((last, generation, depth, opened, size, live))
    if out:
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])
        yield frame.astype({"participant": object, "event": object, "open_seq": "Int64", "n_nodes": "Int64"})


def participant_events(ops: DataFrame) -> DataFrame:
    """A stream of pin, unpin, unbalanced, flush and late events from a stream of trace rows."""
    ship(ops.sparkSession)
    rows = ops.where(is_effective(F.col("op"), F.col("ptr"), F.col("deleter"))).select("manager_id", "thread_id", "seq", "op")
    return rows.groupBy("manager_id", "thread_id").applyInPandasWithState(_advance, EVENTS, _STATE, "append", "NoTimeout")
