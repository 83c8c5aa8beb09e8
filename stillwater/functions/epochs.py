"""Constants and column expressions of epoch-based reclamation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide when objects are handed over and freed.
EPOCH_BUCKETS = 3
LOCAL_BATCH = 64  # a participant's list is handed over when a retire makes it this long
EXIT_BATCH = LOCAL_BATCH // 2  # and when an outermost exit finds it this long
FIRST_EPOCH = 1
GRACE = 2  # epochs between retiring and freeing

OPS = ("enter", "exit", "retire", "collect", "thread_exit")


@dataclass(frozen=True)
class Rules:
    """What may be tuned: shared buckets, and the length at which a list is handed over."""

    buckets: int = EPOCH_BUCKETS
    batch: int = LOCAL_BATCH

    def __post_init__(self):
        if self.buckets < 1 or self.batch < 1:
            raise ValueError("buckets and batch must be 1 or more")

    @property
    def exit_batch(self) -> int:
        return self.batch // 2


RULES = Rules()


def bucket_index(epoch: Column, rules: Rules = RULES) -> Column:
    """The bucket of a retire epoch."""
    return (epoch % rules.buckets).cast("long")


def safe_epoch(current: Column) -> Column:
    """The newest epoch whose objects may be freed; null while there is none."""
    return F.when(current >= GRACE, current - GRACE)


def is_effective(op: Column, ptr: Column, deleter: Column) -> Column:
    """False for a retire without object or deleter, which does nothing."""
    return (op != "retire") | (ptr.isNotNull() & deleter.isNotNull())


def pin_delta(op: Column) -> Column:
    return F.when(op == "enter", 1).when(op == "exit", -1).otherwise(0).cast("long")
