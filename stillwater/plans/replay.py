"""The replay of a trace: one lazy DataFrame per stage, each built from the ones before."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.functions.epochs import RULES, Rules
from stillwater.operators import blocks, epoch_chain, flushes, participants, pins, reclaim
from stillwater.scratch import materialize
from stillwater.session import ship


class Replay:
    """Stages of the reclamation of ``trace`` (columns of ``sources.trace.TRACE``).

    Stages that are read several times go through ``storage`` (a function from a DataFrame and a name to a
    DataFrame): by default they are written as tables in the shared folder and read back, so nothing is
    computed twice and a lost executor costs only its tasks.
    """

    def __init__(self, trace: DataFrame, storage=materialize, rules: Rules = RULES):
        ship(trace.sparkSession)
        self.trace = trace
        self.rules = rules
        self._keep = storage

    @cached_property
    def width(self) -> int | None:
        """Values of seq per block (None: all is one block)."""
        return blocks.span(self.trace, "seq")

    @cached_property
    def deep(self) -> DataFrame:
        return self._keep(participants.with_depth(self.trace, self.width), "deep")

    @cached_property
    def ops(self) -> DataFrame:
        return self.deep.drop("before", "depth")

    @cached_property
    def registry(self) -> DataFrame:
        return participants.registry(self.ops)

    @cached_property
    def pins(self) -> DataFrame:
        return self._keep(pins.pin_intervals(self.deep, self.width), "pins")

    @cached_property
    def unbalanced(self) -> DataFrame:
        return pins.unbalanced_exits(self.deep)

    @cached_property
    def hazards(self) -> DataFrame:
        return pins.hazards(self.trace, self.deep)

    @cached_property
    def flushes(self) -> DataFrame:
        return self._keep(flushes.flushes(self.deep, self.width, self.rules), "flushes")

    @cached_property
    def retired(self) -> DataFrame:
        return flushes.retired(self.deep, self.flushes, self.width)

    @cached_property
    def epochs(self) -> DataFrame:
        held = self._keep(epoch_chain.held(flushes.attempts(self.deep, self.flushes), self.pins, self.width), "tries")
        return self._keep(epoch_chain.with_epochs(held, self.width, self.rules), "epochs")

    @cached_property
    def timeline(self) -> DataFrame:
        return epoch_chain.epoch_timeline(self.epochs)

    @cached_property
    def stamped(self) -> DataFrame:
        return reclaim.stamped(self.retired, self.timeline, self.width, self.rules)

    @cached_property
    def fates(self) -> DataFrame:
        return self._keep(reclaim.fates(self.stamped, self.epochs, self.timeline, self.width), "fates")

    @cached_property
    def attempts(self) -> DataFrame:
        """Attempts with what they freed and, where they couldn't advance, the pin that held them."""
        freed = self.fates.where("reclaim_seq is not null").groupBy("manager_id", F.col("reclaim_seq").alias("seq")).agg(F.count(F.lit(1)).alias("n_freed"))
        held = ~F.col("advanced")
        rows = self.epochs.join(freed, ["manager_id", "seq"], "left")
        return rows.select("manager_id", "seq", "participant", "trigger", held.alias("blocked"), F.when(held, F.col("pin_holder")).alias("blocker"), F.when(held, F.col("pin_open")).alias("blocker_open"), "epoch_after", "safe_epoch", "bucket", F.coalesce("n_freed", F.lit(0).cast("long")).alias("n_freed"))

    @cached_property
    def backlog(self) -> DataFrame:
        return reclaim.backlog(self.fates, self.epochs, self.width)
