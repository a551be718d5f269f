"""What a query did, read from the metrics of its executed plan."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame

from sluice.plans import catalyst as c

_JOINS = ("BroadcastHashJoinExec", "SortMergeJoinExec", "ShuffledHashJoinExec", "BroadcastNestedLoopJoinExec", "CartesianProductExec")


def _nodes(plan, seen: set) -> list:
    """All operators that ran, once each: through query stages, reused exchanges and subqueries."""
    name = c.kind(plan)
    if name == "AdaptiveSparkPlanExec":
        return _nodes(plan.executedPlan(), seen)
    if name.endswith("QueryStageExec"):
        return _nodes(plan.plan(), seen)
    if name == "ReusedExchangeExec" or plan.id() in seen:
        return []
    seen.add(plan.id())
    return [plan, *[n for k in [*c.items(plan.children()), *c.items(plan.subqueries())] for n in _nodes(k, seen)]]


def _value(plan, metric: str) -> int:
    found = plan.metrics().get(metric)
    return max(0, found.get().value()) if found.isDefined() else 0


def measure(df: DataFrame) -> dict:
    """Run ``df`` and return rows and files scanned, rows out of joins (sum and most), bytes shuffled and broadcast, peak memory, spilled bytes, and milliseconds by operator."""
    execution = df._jdf.queryExecution()
    rows = execution.toRdd().count()
    out: Counter = Counter({"rows": rows, "rows_scanned": 0, "files": 0, "join_rows": 0, "most_join_rows": 0, "shuffle_bytes": 0, "broadcast_bytes": 0, "peak_memory": 0, "spill_bytes": 0})
    times: Counter = Counter()
    for node in _nodes(execution.executedPlan(), set()):
        name = c.kind(node)
        if name == "FileSourceScanExec":
            out["rows_scanned"] += _value(node, "numOutputRows")
            out["files"] += _value(node, "numFiles")
        elif name in _JOINS:
            out["join_rows"] += _value(node, "numOutputRows")
            out["most_join_rows"] = max(out["most_join_rows"], _value(node, "numOutputRows"))
        elif name == "ShuffleExchangeExec":
            out["shuffle_bytes"] += _value(node, "shuffleBytesWritten")
        elif name == "BroadcastExchangeExec":
            out["broadcast_bytes"] += _value(node, "dataSize")
        out["peak_memory"] += _value(node, "peakMemory")
        out["spill_bytes"] += _value(node, "spillSize")
        for metric, per in (("scanTime", 1), ("pipelineTime", 1), ("aggTime", 1), ("sortTime", 1), ("buildTime", 1), ("broadcastTime", 1), ("collectTime", 1), ("shuffleWriteTime", 1_000_000)):
            times[name.removesuffix("Exec")] += _value(node, metric) // per
    return {**out, "ms": {k: v for k, v in times.most_common() if v}}
