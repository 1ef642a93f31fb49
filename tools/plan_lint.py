"""Plan review for every registered check (no execution).

For each check, from the physical plan: number of shuffles, parquet scans and
broadcasts, and every construct that would not survive a 100x scale-up unless its
input is bounded -- single-partition exchanges (global windows / sorts), nested-loop
joins and cartesian products.  Each flagged construct is listed with the operator
that feeds it so it can be checked against the bound documented in the code.

    python tools/plan_lint.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


_NODE = re.compile(r"^([\s:|+-]*?)(\*\(\d+\) )?([A-Z][A-Za-z]+)")


def _tree(plan: str):
    """(depth, node name, line) for each plan line; depth = column of the name."""
    out = []
    for line in plan.splitlines():
        m = _NODE.match(line)
        if m:
            out.append((len(m.group(1)) + len(m.group(2) or ""), m.group(3), line.strip()))
    return out


def _parent(nodes, i):
    d = nodes[i][0]
    for j in range(i - 1, -1, -1):
        if nodes[j][0] < d:
            return j
    return None


def _child(nodes, i):
    return i + 1 if i + 1 < len(nodes) and nodes[i + 1][0] > nodes[i][0] else None


def _children(nodes, i):
    d, out, cd = nodes[i][0], [], None
    for j in range(i + 1, len(nodes)):
        if nodes[j][0] <= d:
            break
        if cd is None:
            cd = nodes[j][0]
        if nodes[j][0] == cd:
            out.append(j)
    return out


def _below(nodes, i, skip=("Project", "Filter", "Sort", "BroadcastExchange", "AQEShuffleRead",
                           "ShuffleQueryStage", "BroadcastQueryStage", "Exchange")):
    k = _child(nodes, i)
    while k is not None and nodes[k][1] in skip:
        k = _child(nodes, k)
    return k


def _one_row(line: str) -> bool:
    return ("keys=[]" in line or "key=[]" in line) and "Aggregate" in line


def classify(plan: str) -> list[str]:
    """Single-partition exchanges and nested-loop joins, each labelled with what
    bounds it (or REVIEW when nothing obvious does)."""
    nodes = _tree(plan)
    found = []
    for i, (_, name, line) in enumerate(nodes):
        if name == "Exchange" and "SinglePartition" in line:
            par = _parent(nodes, i)
            pname = nodes[par][1] if par is not None else ""
            if pname in ("HashAggregate", "ObjectHashAggregate", "SortAggregate"):
                found.append("ok: global aggregate (one partial row per partition)")
                continue
            k = _below(nodes, i)
            feed = nodes[k][2] if k is not None else "?"
            gp = _parent(nodes, par) if par is not None else None
            window = nodes[gp][2] if gp is not None and nodes[gp][1] == "Window" else ""
            if "_zi" in window or "_z_0" in window:
                found.append("ok: numbering of the counted background table (<= 1,000,000 rows)")
            elif "_cat" in window:
                found.append("ok: cumulative shares over category frequencies (<= categories)")
            elif "Aggregate" in feed and "__b" in feed:
                found.append("ok: ordered window over running-sum bucket totals (<= occupied buckets)")
            elif "Aggregate" in feed and "_cat" in feed:
                found.append("ok: ordered window over category frequencies (<= categories)")
            elif "_z_0" in feed:
                found.append("ok: numbering of the counted background table (<= 1,000,000 rows)")
            else:
                found.append(f"REVIEW single-partition {pname} fed by: {feed[:80]}")
        if name == "BroadcastNestedLoopJoin":
            for j in _children(nodes, i):
                if nodes[j][1] != "BroadcastExchange":
                    continue
                k = _below(nodes, j, skip=("Project", "Filter"))
                line_k = nodes[k][2] if k is not None else "?"
                if _one_row(line_k):
                    found.append("ok: nested-loop join with a one-row statistic")
                elif "_qi" in line_k or "_frac" in line_k or "_k#" in line_k:
                    found.append("ok: nested-loop join with the quantile position table (2 x quantiles rows)")
                elif "value" in line_k or "_i#" in line_k or "BroadcastNestedLoopJoin" in line_k:
                    found.append("ok: nested-loop join with a bounded grid (<= grid_resolution^k)")
                else:
                    found.append(f"REVIEW nested-loop join broadcasting: {line_k[:80]}")
    return found


def lint(plan: str) -> dict:
    return {
        "shuffles": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning)", plan)),
        "scans": plan.count("FileScan parquet") + plan.count("Scan parquet"),
        "broadcasts": plan.count("BroadcastExchange"),
        "single_partition": plan.count("Exchange SinglePartition"),
        "nested_loop": plan.count("BroadcastNestedLoopJoin"),
        "cartesian": plan.count("CartesianProduct"),
    }


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if not os.path.isdir(a)]
    from probity.registry import queries
    from probity.session import get_session
    spark = get_session("local[8]", shuffle_partitions=8)
    total = {}
    for name, fn in sorted(queries().items()):
        if names and name not in names:
            continue
        try:
            df = fn(spark, sf_dir)
        except Exception as e:  # noqa: BLE001
            print(f"{name}: could not build ({type(e).__name__})")
            continue
        plan = df._jdf.queryExecution().executedPlan().toString()
        r = lint(plan)
        for k, v in r.items():
            total[k] = total.get(k, 0) + v
        issues = classify(plan)
        print(f"{name}: " + ", ".join(f"{k}={v}" for k, v in r.items()))
        for x in sorted(set(issues)):
            print(f"    {x}")
    print("total: " + ", ".join(f"{k}={v}" for k, v in total.items()))
    spark.stop()


if __name__ == "__main__":
    main()
