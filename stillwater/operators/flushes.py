"""Hand-over of retired objects from participants' lists to the shared buckets.

The length of a list is a state of 0 to 63 that operations map to a state, so blocks of
operations compose: the map of each block first, then the state at the start of each block of a
participant, then the flushes inside each block.  No task holds more than a block of a
participant, and no participant is folded by one task alone.  Participants within one block, which
begin with an empty list, need only the last step.

Between two looks at a list (an outermost exit, a collect, a thread's end) it only grows, so a block
is folded look by look, not operation by operation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.functions.epochs import RULES, Rules
from stillwater.operators.blocks import asof, block_of

KEY = ["manager_id", "participant"]
_RETIRE, _EXIT, _DRAIN = range(3)


def step(size: int, kind: int, rules: Rules = RULES) -> tuple[int, bool]:
    """List length after an operation, and whether the list was handed over in it."""
    if kind == _RETIRE:
        return (0, True) if size + 1 >= rules.batch else (size + 1, False)
    if kind == _EXIT:
        return (0, True) if size >= max(rules.exit_batch, 1) else (size, False)
    return 0, size > 0


def _looks(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the looks at a list, and the retires before each of them and in all."""
    retires = np.concatenate([[0], np.cumsum(kinds == _RETIRE)])
    at = np.flatnonzero(kinds != _RETIRE)
    return at, np.append(retires[at], retires[-1])


def block_map(kinds: np.ndarray, rules: Rules = RULES) -> list[int]:
    """Final list length for every initial one."""
    state, done = np.arange(rules.batch), 0
    at, retires = _looks(kinds)
    for k, i in enumerate(at.tolist()):
        state, done = (state + retires[k] - done) % rules.batch, retires[k]
        state = np.where(state >= rules.exit_batch, 0, state) if kinds[i] == _EXIT else np.zeros_like(state)
    return ((state + retires[-1] - done) % rules.batch).tolist()


def block_flushes(kinds: np.ndarray, size: int, rules: Rules = RULES) -> tuple[list[int], list[int]]:
    """Places and lengths of the hand-overs in a block that begins with ``size`` objects in the list."""
    at, retires = _looks(kinds)
    place = np.flatnonzero(kinds == _RETIRE)
    where, sizes, done = [], [], 0
    for k, i in enumerate([*at.tolist(), None]):
        size, first = size + int(retires[k]) - done, done - size
        done = int(retires[k])
        if size >= rules.batch:  # full at a retire, maybe several times
            full = first + rules.batch * np.arange(1, size // rules.batch + 1) - 1
            where += place[full].tolist()
            sizes += [rules.batch] * len(full)
            size %= rules.batch
        if i is not None and size > 0 and (kinds[i] == _DRAIN or size >= rules.exit_batch):
            where.append(i)
            sizes.append(size)
            size = 0
    return where, sizes


def _maps(rules: Rules):
    def run(table: pa.Table) -> pa.Table:
        kinds = table.sort_by("seq")["kind"].to_numpy()
        return table.select([*KEY, "_blk"]).slice(0, 1).append_column("out", pa.array([block_map(kinds, rules)], pa.list_(pa.int64())))

    return run


def _flushes(rules: Rules):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        where, sizes = block_flushes(table["kind"].to_numpy(), int(table["start"][0].as_py()), rules)
        found = table.take(pa.array(where, pa.int64()))
        return found.select([*KEY, "seq"]).append_column("reason", found["op"]).append_column("n_nodes", pa.array(sizes, pa.int64()))

    return run


def _with_starts(acts: DataFrame, rules: Rules) -> DataFrame:
    """``acts`` with the length of its participant's list at the start of its block."""
    ends = acts.groupBy(*KEY).agg(F.min("_blk").alias("_a"), F.max("_blk").alias("_b")).where("_a < _b")
    maps = acts.join(ends, KEY, "left_semi").groupBy(*KEY, "_blk").applyInArrow(_maps(rules), "manager_id long, participant string, _blk long, out array<long>")
    # a row per block of a participant: the length at the start of each block follows from the maps before it
    blocks = maps.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("_blk", "out"))).alias("b"))
    none = F.expr("cast(array() as array<struct<_blk: bigint, start: bigint>>)")
    begin = lambda x, b: F.concat(x["all"], F.array(F.struct(b["_blk"].alias("_blk"), x["size"].alias("start"))))
    fold = F.aggregate("b", F.struct(F.lit(0).cast("long").alias("size"), none.alias("all")), lambda x, b: F.struct(F.get(b["out"], x["size"].cast("int")).alias("size"), begin(x, b).alias("all")))
    starts = blocks.select(*KEY, F.inline(fold["all"]))
    return acts.join(starts, [*KEY, "_blk"], "left").withColumn("start", F.coalesce("start", F.lit(0).cast("long")))


def flushes(deep: DataFrame, width: int | None, rules: Rules = RULES) -> DataFrame:
    """manager_id, participant, seq, reason (retire, exit, collect, thread_exit), n_nodes of non-empty hand-overs."""
    kind = F.when(F.col("op") == "retire", _RETIRE).when((F.col("op") == "exit") & (F.col("depth") == 0), _EXIT).when(F.col("op").isin("collect", "thread_exit"), _DRAIN)
    acts = deep.select(*KEY, "seq", "op", kind.cast("int").alias("kind"), block_of("seq", width).alias("_blk")).where("kind is not null")
    rows = acts.withColumn("start", F.lit(0).cast("long")) if width is None else _with_starts(acts, rules)
    return rows.groupBy(*KEY, "_blk").applyInArrow(_flushes(rules), "manager_id long, participant string, seq long, reason string, n_nodes long")


def retired(deep: DataFrame, handed: DataFrame, width: int) -> DataFrame:
    """Retired objects with flush_seq, the hand-over that moved them (null: never)."""
    nodes = deep.where("op = 'retire'").select(*KEY, "seq", "ptr", "deleter")
    return asof(nodes, handed.select(*KEY, F.col("seq").alias("f")), KEY, "seq", "f", "f", "flush_seq", width, forward=True)


def attempts(deep: DataFrame, handed: DataFrame) -> DataFrame:
    """manager_id, seq, participant, trigger of every attempt to advance the epoch."""
    own = deep.where("op in ('collect', 'thread_exit')").select("manager_id", "seq", "participant", F.col("op").alias("trigger"))
    return own.unionByName(handed.where("reason = 'retire'").select("manager_id", "seq", "participant", F.col("reason").alias("trigger")))
