"""Registered queries over the trace of the events table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwater.operators.epoch_chain import current_epoch
from stillwater.plans.replay import Replay
from stillwater.scratch import Scope
from stillwater.sources.trace import events_trace


def replay(spark: SparkSession, sf_dir: str) -> Replay:
    return Replay(events_trace(spark.read.parquet(f"{sf_dir}/events.parquet")))


def _count(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def ebr_trace(r: Replay) -> DataFrame:
    return r.ops.select("seq", "thread_id", "generation", "participant", "op", "ptr", "deleter")


def ebr_participants(r: Replay) -> DataFrame:
    return r.registry.select("thread_id", "generation", "participant", "registered_seq", "unregistered_seq", "n_ops")


def ebr_pin_depth(r: Replay) -> DataFrame:
    return r.deep.select("participant", "seq", "op", "depth")


def ebr_pin_intervals(r: Replay) -> DataFrame:
    pinned = current_epoch(r.pins, r.timeline, "open_seq", "pinned_epoch", r.width)
    return pinned.select("participant", "open_seq", "close_seq", "pinned_epoch")


def ebr_unbalanced_exits(r: Replay) -> DataFrame:
    return r.unbalanced.select("participant", "seq")


def ebr_flushes(r: Replay) -> DataFrame:
    return r.flushes.select("participant", "seq", "reason", "n_nodes")


def ebr_attempts(r: Replay) -> DataFrame:
    return r.attempts.drop("manager_id")


def ebr_epoch_timeline(r: Replay) -> DataFrame:
    return r.timeline.select("epoch", "from_seq")


def ebr_current_epoch(r: Replay) -> DataFrame:
    return current_epoch(r.ops.select("manager_id", "seq"), r.timeline, "seq", "current_epoch", r.width).select("seq", "current_epoch")


def ebr_retired_stamped(r: Replay) -> DataFrame:
    return r.stamped.select("participant", "seq", "ptr", "deleter", "flush_seq", "retire_epoch", "bucket")


def ebr_reclaimed(r: Replay) -> DataFrame:
    return r.fates.where("fate = 'reclaimed'").select("participant", "seq", "ptr", "deleter", "flush_seq", "retire_epoch", "reclaim_seq", "reclaim_epoch", "lag")


def ebr_lag_histogram(r: Replay) -> DataFrame:
    return _count(r.fates.where("fate = 'reclaimed'"), "lag")


def ebr_bucket_occupancy(r: Replay) -> DataFrame:
    return _count(r.fates.where("fate = 'shutdown'"), "bucket", "retire_epoch")


def ebr_shutdown(r: Replay) -> DataFrame:
    return _count(r.fates, "fate")


def ebr_deleter_summary(r: Replay) -> DataFrame:
    return _count(r.fates, "deleter", "fate")


def ebr_backlog(r: Replay) -> DataFrame:
    return r.backlog.select("seq", "epoch_after", "outstanding")


def ebr_hazards(r: Replay) -> DataFrame:
    return r.hazards.select("thread_id", "seq", "hazard")


def _query(f: Callable[[Replay], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with Scope(spark) as tables:
            return tables.keep(f(replay(spark, sf_dir)))

    return run


_ALL = (ebr_trace, ebr_participants, ebr_pin_depth, ebr_pin_intervals, ebr_unbalanced_exits, ebr_flushes, ebr_attempts, ebr_epoch_timeline, ebr_current_epoch, ebr_retired_stamped, ebr_reclaimed, ebr_lag_histogram, ebr_bucket_occupancy, ebr_shutdown, ebr_deleter_summary, ebr_backlog, ebr_hazards)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: _query(f) for f in _ALL}

#: CTEs, one per stage; each is written apart from the DataFrame form (recursion, ASOF and range joins)
_STAGES = """
WITH RECURSIVE raw AS (
  SELECT event_id AS seq, user_id % 16 AS thread_id,
    CASE event_type WHEN 'view' THEN 'enter' WHEN 'click' THEN 'exit' WHEN 'purchase' THEN 'retire'
      WHEN 'error' THEN CASE WHEN event_id % 101 = 0 THEN 'collect' ELSE 'exit' END
      WHEN 'signup' THEN CASE WHEN event_id % 97 = 0 THEN 'thread_exit' ELSE 'retire' END END AS op
  FROM events),
used AS (
  SELECT * FROM (SELECT *, lag(op) OVER (PARTITION BY thread_id ORDER BY seq) AS prev FROM raw WHERE op IS NOT NULL)
  WHERE op <> 'thread_exit' OR (prev IS NOT NULL AND prev <> 'thread_exit')),
ops AS (
  SELECT seq, thread_id,
    CAST(coalesce(sum(CASE WHEN op = 'thread_exit' THEN 1 ELSE 0 END) OVER (PARTITION BY thread_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS generation,
    op, CASE WHEN op = 'retire' THEN seq END AS ptr,
    CASE WHEN op = 'retire' THEN CASE WHEN seq % 2 = 0 THEN 'free' ELSE 'delete' END END AS deleter
  FROM used),
named AS (SELECT *, CAST(thread_id AS VARCHAR) || ':' || CAST(generation AS VARCHAR) AS participant FROM ops),
walk AS (
  SELECT *, sum(CASE op WHEN 'enter' THEN 1 WHEN 'exit' THEN -1 ELSE 0 END) OVER (PARTITION BY participant ORDER BY seq) AS s,
    row_number() OVER (PARTITION BY participant ORDER BY seq) AS nr FROM named),
lowest AS (SELECT *, min(s) OVER (PARTITION BY participant ORDER BY seq) AS low FROM walk),
deep AS (SELECT *, CAST(s - least(0, low) AS BIGINT) AS depth FROM lowest),
lists AS (
  SELECT participant, nr, seq, op, CAST(CASE WHEN op = 'retire' THEN 1 ELSE 0 END AS BIGINT) AS size, CAST(0 AS BIGINT) AS moved
  FROM deep WHERE nr = 1
  UNION ALL
  SELECT d.participant, d.nr, d.seq, d.op,
    CAST(CASE WHEN d.op = 'retire' THEN CASE WHEN l.size + 1 >= 64 THEN 0 ELSE l.size + 1 END
      WHEN d.op = 'exit' AND d.depth = 0 AND l.size >= 32 THEN 0
      WHEN d.op IN ('collect', 'thread_exit') THEN 0 ELSE l.size END AS BIGINT),
    CAST(CASE WHEN d.op = 'retire' THEN CASE WHEN l.size + 1 >= 64 THEN l.size + 1 ELSE 0 END
      WHEN d.op = 'exit' AND d.depth = 0 AND l.size >= 32 THEN l.size
      WHEN d.op IN ('collect', 'thread_exit') THEN l.size ELSE 0 END AS BIGINT)
  FROM lists l JOIN deep d ON d.participant = l.participant AND d.nr = l.nr + 1),
flushes AS (SELECT participant, seq, op AS reason, moved AS n_nodes FROM lists WHERE moved > 0),
pins AS (
  SELECT participant, seq AS open_seq, close_seq FROM (
    SELECT participant, seq, op, depth,
      min(CASE WHEN (op = 'exit' AND depth = 0) OR op = 'thread_exit' THEN seq END)
        OVER (PARTITION BY participant ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS close_seq
    FROM deep)
  WHERE op = 'enter' AND depth = 1),
tries AS (
  SELECT seq, participant, op AS kind FROM deep WHERE op IN ('collect', 'thread_exit')
  UNION ALL SELECT seq, participant, reason FROM flushes WHERE reason = 'retire'),
blocks AS (
  SELECT t.seq, t.participant, t.kind, min(p.open_seq) AS pin_open, arg_min(p.participant, p.open_seq) AS holder
  FROM tries t LEFT JOIN pins p ON p.open_seq <= t.seq AND (p.close_seq IS NULL OR p.close_seq > t.seq)
  GROUP BY t.seq, t.participant, t.kind),
chain AS (
  SELECT CAST(-1 AS BIGINT) AS a
  UNION ALL
  SELECT x.a FROM (SELECT min(b.seq) AS a FROM chain c JOIN blocks b ON coalesce(b.pin_open, b.seq) > c.a) x WHERE x.a IS NOT NULL),
advances AS (SELECT a AS from_seq, CAST(1 + row_number() OVER (ORDER BY a) AS BIGINT) AS epoch FROM chain WHERE a >= 0),
known AS (SELECT CAST(-1 AS BIGINT) AS from_seq, CAST(1 AS BIGINT) AS epoch UNION ALL SELECT from_seq, epoch FROM advances),
epochs AS (
  SELECT b.seq, b.participant, b.kind, b.pin_open, b.holder, k.epoch AS epoch_after, k.from_seq = b.seq AS advanced
  FROM blocks b ASOF JOIN known k ON b.seq >= k.from_seq),
nodes AS (
  SELECT d.participant, d.seq, d.ptr, d.deleter, f.seq AS flush_seq
  FROM (SELECT * FROM deep WHERE op = 'retire') d ASOF LEFT JOIN flushes f ON d.participant = f.participant AND d.seq <= f.seq),
stamped AS (
  SELECT n.participant, n.seq, n.ptr, n.deleter, n.flush_seq, k.epoch AS retire_epoch, k.epoch % 3 AS bucket
  FROM nodes n ASOF JOIN known k ON n.seq > k.from_seq),
ripe AS (
  SELECT s.*, greatest(s.flush_seq, a.from_seq) AS ripe_seq FROM stamped s JOIN advances a ON a.epoch = s.retire_epoch + 2
  WHERE s.flush_seq IS NOT NULL),
looks AS (SELECT seq AS reclaim_seq, epoch_after AS reclaim_epoch, (epoch_after - 2) % 3 AS bucket FROM epochs WHERE epoch_after >= 2),
freed AS (
  SELECT r.seq, l.reclaim_seq, l.reclaim_epoch, l.reclaim_epoch - r.retire_epoch AS lag
  FROM ripe r ASOF JOIN looks l ON r.bucket = l.bucket AND r.ripe_seq <= l.reclaim_seq),
fates AS (
  SELECT s.*, f.reclaim_seq, f.reclaim_epoch, f.lag,
    CASE WHEN f.seq IS NOT NULL THEN 'reclaimed' WHEN s.flush_seq IS NOT NULL THEN 'shutdown' ELSE 'leaked_local' END AS fate
  FROM stamped s LEFT JOIN freed f ON f.seq = s.seq)
"""

_SELECTS = {
    "ebr_trace": "SELECT seq, thread_id, generation, participant, op, ptr, deleter FROM named",
    "ebr_participants": "SELECT thread_id, generation, participant, min(seq) AS registered_seq, max(CASE WHEN op = 'thread_exit' THEN seq END) AS unregistered_seq, count(*) AS n_ops FROM named GROUP BY ALL",
    "ebr_pin_depth": "SELECT participant, seq, op, depth FROM deep",
    "ebr_pin_intervals": "SELECT p.participant, p.open_seq, p.close_seq, k.epoch AS pinned_epoch FROM pins p ASOF JOIN known k ON p.open_seq >= k.from_seq",
    "ebr_unbalanced_exits": "SELECT participant, seq FROM (SELECT participant, seq, op, coalesce(lag(depth) OVER (PARTITION BY participant ORDER BY seq), 0) AS was FROM deep) WHERE op = 'exit' AND was = 0",
    "ebr_flushes": "SELECT participant, seq, reason, n_nodes FROM flushes",
    "ebr_attempts": "SELECT e.seq, e.participant, e.kind AS trigger, NOT e.advanced AS blocked, CASE WHEN NOT e.advanced THEN e.holder END AS blocker, CASE WHEN NOT e.advanced THEN e.pin_open END AS blocker_open, e.epoch_after, CASE WHEN e.epoch_after >= 2 THEN e.epoch_after - 2 END AS safe_epoch, CASE WHEN e.epoch_after >= 2 THEN (e.epoch_after - 2) % 3 END AS bucket, count(f.reclaim_seq) AS n_freed FROM epochs e LEFT JOIN freed f ON f.reclaim_seq = e.seq GROUP BY ALL",
    "ebr_epoch_timeline": "SELECT epoch, from_seq FROM advances",
    "ebr_current_epoch": "SELECT o.seq, k.epoch AS current_epoch FROM ops o ASOF JOIN known k ON o.seq >= k.from_seq",
    "ebr_retired_stamped": "SELECT participant, seq, ptr, deleter, flush_seq, retire_epoch, bucket FROM stamped",
    "ebr_reclaimed": "SELECT participant, seq, ptr, deleter, flush_seq, retire_epoch, reclaim_seq, reclaim_epoch, lag FROM fates WHERE fate = 'reclaimed'",
    "ebr_lag_histogram": "SELECT lag, count(*) AS n FROM fates WHERE fate = 'reclaimed' GROUP BY lag",
    "ebr_bucket_occupancy": "SELECT bucket, retire_epoch, count(*) AS n FROM fates WHERE fate = 'shutdown' GROUP BY ALL",
    "ebr_shutdown": "SELECT fate, count(*) AS n FROM fates GROUP BY fate",
    "ebr_deleter_summary": "SELECT deleter, fate, count(*) AS n FROM fates GROUP BY ALL",
    "ebr_hazards": "SELECT thread_id, seq, CASE op WHEN 'exit' THEN 'unbalanced_exit' WHEN 'collect' THEN 'pinned_collect' ELSE 'pinned_thread_exit' END AS hazard FROM (SELECT thread_id, seq, op, coalesce(lag(depth) OVER (PARTITION BY participant ORDER BY seq), 0) AS was FROM deep) WHERE (op = 'exit' AND was = 0) OR (op IN ('collect', 'thread_exit') AND was > 0)",
    "ebr_backlog": "SELECT e.seq, e.epoch_after, CAST((SELECT count(*) FROM fates x WHERE x.seq <= e.seq) - (SELECT count(*) FROM fates y WHERE y.reclaim_seq <= e.seq) AS BIGINT) AS outstanding FROM epochs e",
}
SQL = {name: f"{_STAGES}{select}" for name, select in _SELECTS.items()}
