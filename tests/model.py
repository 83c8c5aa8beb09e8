"""A sequential model of epoch-based reclamation: one operation after another, in plain Python."""

from __future__ import annotations

from collections import defaultdict


def run(ops: list[tuple], n_buckets: int = 3, batch: int = 64) -> dict:
    """ops: (seq, thread_id, op, ptr, deleter) in order."""
    epoch, buckets = 1, defaultdict(list)
    threads: dict = {}
    generation = defaultdict(int)
    out = {"depth": {}, "flushes": [], "attempts": [], "advances": [], "nodes": {}, "unbalanced": [], "pins": {}}

    def flush(t, seq, reason):
        if t["list"]:
            out["flushes"].append((t["name"], seq, reason, len(t["list"])))
            for node in t["list"]:
                node["flush"] = seq
                buckets[node["epoch"] % n_buckets].append(node)
            t["list"] = []

    def attempt(t, seq, trigger):
        nonlocal epoch
        held = [x for x in threads.values() if x["active"] and x["pinned"] != epoch]
        if not held:
            epoch += 1
            out["advances"].append((epoch, seq))
        if epoch >= 2:
            keep = []
            for node in buckets[(epoch - 2) % n_buckets]:
                if node["epoch"] <= epoch - 2:
                    node["freed"], node["lag"] = seq, epoch - node["epoch"]
                else:
                    keep.append(node)
            buckets[(epoch - 2) % n_buckets] = keep
        out["attempts"].append((seq, t["name"], trigger, bool(held), epoch))

    for seq, thread, op, ptr, deleter in ops:
        if op == "retire" and (ptr is None or deleter is None):
            continue
        if op == "thread_exit" and thread not in threads:
            continue  # it never used the manager, or not since it ended
        if thread not in threads:
            threads[thread] = {"name": f"{thread}:{generation[thread]}", "depth": 0, "active": False, "pinned": 0, "list": [], "open": None}
        t = threads[thread]
        if op == "enter":
            if t["depth"] == 0:
                t["active"], t["pinned"], t["open"] = True, epoch, seq
                out["pins"][t["name"], seq] = None
            t["depth"] += 1
        elif op == "exit":
            if t["depth"] == 0:
                out["unbalanced"].append(seq)
            if t["depth"] <= 1:
                if t["open"] is not None:
                    out["pins"][t["name"], t["open"]] = seq
                t["depth"], t["active"], t["open"] = 0, False, None
                if len(t["list"]) >= batch // 2:
                    flush(t, seq, "exit")
            else:
                t["depth"] -= 1
        elif op == "retire":
            node = {"epoch": epoch, "flush": None, "freed": None, "lag": None}
            out["nodes"][seq] = node
            t["list"].append(node)
            if len(t["list"]) >= batch:
                flush(t, seq, "retire")
                attempt(t, seq, "retire")
        elif op == "collect":
            flush(t, seq, "collect")
            attempt(t, seq, "collect")
        else:
            flush(t, seq, "thread_exit")
            if t["open"] is not None:
                out["pins"][t["name"], t["open"]] = seq
            out["depth"][seq] = t["depth"]
            del threads[thread]
            generation[thread] += 1
            attempt(t, seq, "thread_exit")
            continue
        out["depth"][seq] = t["depth"]
    return out
