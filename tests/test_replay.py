"""The replay against the sequential model, on random and hand-written traces (one manager each)."""

import random

import pytest
from model import run

from stillwater.functions.epochs import EPOCH_BUCKETS, LOCAL_BATCH, Rules
from stillwater.operators import blocks
from stillwater.plans.replay import Replay
from stillwater.scratch import materialize
from stillwater.sources.trace import TRACE, read_trace, refused, validate, write_trace


def random_trace(seed: int, n: int, weights: list[int]) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        op = rng.choices(["enter", "exit", "retire", "collect", "thread_exit"], weights)[0]
        out.append((seq * 3 + 1, rng.randrange(4), op, seq if op == "retire" else None, rng.choice(["free", "delete", "custom:x"]) if op == "retire" else None))
    return out


def steps(*parts) -> list[tuple]:
    """(thread, op, times) in order; retire* has a null deleter."""
    out = []
    for thread, op, times in parts:
        for _ in range(times):
            seq = len(out)
            out.append((seq, thread, op.rstrip("*"), seq if op.startswith("retire") else None, "free" if op == "retire" else None))
    return out


TRACES = [
    random_trace(1, 700, [2, 3, 6, 1, 0]),
    random_trace(2, 700, [3, 3, 5, 1, 1]),
    random_trace(3, 900, [1, 1, 20, 0, 0]),
    random_trace(4, 500, [6, 2, 6, 1, 0]),
    random_trace(5, 600, [1, 4, 12, 1, 1]),
    steps((0, "retire", 31), (0, "exit", 1), (0, "retire", 1), (0, "exit", 1)),
    steps((0, "retire", 63), (1, "collect", 2), (0, "retire", 1), (1, "collect", 6)),
    steps((0, "enter", 3), (0, "exit", 2), (1, "retire", 2), (1, "collect", 4), (0, "exit", 1), (1, "collect", 4)),
    steps((0, "enter", 1), (1, "retire", 3), (1, "collect", 3), (0, "thread_exit", 1), (0, "enter", 1), (1, "collect", 3)),
    steps((0, "enter", 1), (0, "retire", 2), (0, "collect", 3), (0, "exit", 3), (0, "collect", 2)),
    steps((0, "retire*", 5), (0, "collect", 1)),
    steps((0, "enter", 1), (1, "retire", 70), (1, "collect", 9)),
    steps((0, "thread_exit", 4), (1, "collect", 1)),
    steps((0, "retire", 2), (0, "thread_exit", 3), (1, "thread_exit", 1), (0, "enter", 1), (1, "collect", 2), (0, "thread_exit", 70), (0, "retire*", 1), (0, "thread_exit", 1), (1, "collect", 3)),
]


@pytest.fixture(scope="module", params=[(1 << 16, 1 << 19), (64, 1 << 19), (64, 0)], ids=["one block", "many blocks", "no broadcast"])
def replayed(spark, request):
    old = blocks.ROWS, blocks.LOOKUP
    blocks.ROWS, blocks.LOOKUP = request.param
    rows = [(m, *op) for m, trace in enumerate(TRACES) for op in trace]
    r = Replay(spark.createDataFrame(rows, TRACE))
    got = {
        "deep": r.deep.select("manager_id", "seq", "depth").collect(),
        "flushes": r.flushes.collect(),
        "epochs": r.attempts.collect(),
        "timeline": r.timeline.collect(),
        "fates": r.fates.collect(),
        "unbalanced": r.unbalanced.collect(),
        "pins": r.pins.collect(),
        "backlog": r.backlog.collect(),
    }
    yield got
    blocks.ROWS, blocks.LOOKUP = old


@pytest.mark.parametrize("m", range(len(TRACES)))
def test_equals_model(replayed, m):
    want = run(TRACES[m])
    own = {k: [r for r in rows if r.manager_id == m] for k, rows in replayed.items()}
    assert {r.seq: r.depth for r in own["deep"]} == want["depth"]
    assert sorted((r.participant, r.seq, r.reason, r.n_nodes) for r in own["flushes"]) == sorted(want["flushes"])
    assert sorted((r.seq, r.participant, r.trigger, r.blocked, r.epoch_after) for r in own["epochs"]) == sorted(want["attempts"])
    assert sorted((r.epoch, r.from_seq) for r in own["timeline"]) == want["advances"]
    assert {r.seq: (r.retire_epoch, r.flush_seq, r.reclaim_seq, r.lag) for r in own["fates"]} == {s: (n["epoch"], n["flush"], n["freed"], n["lag"]) for s, n in want["nodes"].items()}
    assert sorted(r.seq for r in own["unbalanced"]) == want["unbalanced"]
    assert {(r.participant, r.open_seq): r.close_seq for r in own["pins"]} == want["pins"]
    for r in own["backlog"]:
        assert r.outstanding == sum(s <= r.seq for s in want["nodes"]) - sum(n["freed"] is not None and n["freed"] <= r.seq for n in want["nodes"].values())


def test_invariants(replayed):
    fates = replayed["fates"]
    assert {r.fate for r in fates} <= {"reclaimed", "shutdown", "leaked_local"}
    assert all(r.lag >= 2 and r.lag % EPOCH_BUCKETS == 2 for r in fates if r.fate == "reclaimed")
    assert all(r.n_nodes <= LOCAL_BATCH for r in replayed["flushes"])
    pins = [(r.manager_id, r.open_seq, r.close_seq) for r in replayed["pins"]]
    for r in fates:  # nothing is freed while a pin from before it was retired is open
        if r.reclaim_seq is not None:
            assert not any(m == r.manager_id and o < r.seq and (c is None or c > r.reclaim_seq) for m, o, c in pins)


def test_sparse_order(spark, monkeypatch):
    """Times as seq: blocks hold as many rows as with dense ones."""
    dense = random_trace(6, 400, [2, 3, 6, 1, 1])
    sparse = [(seq * 10**9 + 7, *rest) for seq, *rest in dense]
    monkeypatch.setattr(blocks, "ROWS", 50)
    got = [Replay(spark.createDataFrame([(0, *op) for op in ops], TRACE)) for ops in (dense, sparse)]
    assert got[1].deep.select(blocks.block_of("seq", got[1].width)).distinct().count() <= 9
    one, two = ({(r.seq, r.flush_seq, r.reclaim_seq) for r in x.fates.collect()} for x in got)
    far = lambda s: None if s is None else s * 10**9 + 7
    assert two == {tuple(map(far, r)) for r in one} and len(one) > 100


@pytest.mark.parametrize("rules", [Rules(buckets=5, batch=8), Rules(buckets=1, batch=1)])
def test_other_rules(spark, rules):
    trace = random_trace(7, 500, [3, 4, 9, 1, 1])
    want = run(trace, rules.buckets, rules.batch)
    r = Replay(spark.createDataFrame([(0, *op) for op in trace], TRACE), rules=rules)
    assert {x.seq: (x.retire_epoch, x.flush_seq, x.reclaim_seq) for x in r.fates.collect()} == {s: (n["epoch"], n["flush"], n["freed"]) for s, n in want["nodes"].items()}
    assert sorted((x.participant, x.seq, x.reason, x.n_nodes) for x in r.flushes.collect()) == sorted(want["flushes"])
    with pytest.raises(ValueError):
        Rules(buckets=0)


def test_hazards(spark):
    ops = steps((0, "exit", 1), (0, "retire*", 2), (0, "enter", 2), (0, "collect", 1), (0, "exit", 1), (0, "thread_exit", 2), (1, "thread_exit", 1))
    r = Replay(spark.createDataFrame([(0, *op) for op in ops], TRACE))
    assert sorted((x.seq, x.hazard) for x in r.hazards.collect()) == [(0, "unbalanced_exit"), (1, "leaked_retire"), (2, "leaked_retire"), (5, "pinned_collect"), (7, "pinned_thread_exit")]


@pytest.mark.parametrize(("lookup", "most"), [(1 << 19, 2), (0, 6)])
def test_stored_stages_are_read_once(spark, monkeypatch, lookup, most):
    """What tells where each object is freed reads objects and beginnings of epochs once; where nothing may be
    broadcast, as often as one as-of join does."""
    monkeypatch.setattr(blocks, "LOOKUP", lookup)
    plans = []

    def store(df, tag):
        if tag == "fates":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        return materialize(df, tag)

    Replay(spark.createDataFrame([(0, *op) for op in TRACES[0]], TRACE), storage=store).fates  # noqa: B018
    assert len(plans) == 1 and plans[0] <= most


def test_trace_round_trip(spark, tmp_path):
    rows = [(0, *op) for op in TRACES[7]]
    for fmt in ("parquet", "json", "csv", "orc"):
        write_trace(spark.createDataFrame(rows, TRACE), str(tmp_path / fmt), fmt)
        back = read_trace(spark, str(tmp_path / fmt), fmt)
        assert sorted(map(tuple, back.select(*TRACE.names).collect()), key=lambda r: r[1]) == rows


def test_validate_and_empty(spark):
    rows = [(0, 1, 0, "retire", 5, "void"), (0, 2, 0, "jump", None, None), (0, None, 0, "exit", None, None), (0, 4, None, "exit", None, None), (0, 5, 0, "exit", None, None)]
    assert [r.seq for r in validate(spark.createDataFrame(rows, TRACE)).collect()] == [5]
    assert [r.reason for r in refused(spark.createDataFrame(rows, TRACE)).collect()] == ["typed delete of void", "unknown operation", *["no manager, seq or thread"] * 2]
    empty = Replay(spark.createDataFrame([], TRACE))
    assert empty.fates.count() == empty.attempts.count() == empty.pins.count() == 0
