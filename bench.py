"""Headline queries: prints one JSON line with the seconds of each.

``queries`` is with transfer and default settings, ``plain_spark`` without it. ``shuffled`` has both for joins that can't broadcast (threshold off), as beyond
memory, and with the gate lowered so that transfers happen on tables of this size, with the variants of the passes. Each figure is the best of several interleaved
warm runs. ``jobs`` and ``filters`` tell what the transfer did.
"""

from __future__ import annotations

import json
import math
import os
import time

from pyspark.sql import SparkSession

from sluice.catalogue import SQL
from sluice.plans.metrics import measure
from sluice.session import TransferSession
from sluice.sources.tables import register

QUERIES = ["chain3", "chain4", "star4", "bushy5", "filter_in", "filter_bloom", "having_in_subquery", "exists_semi", "left_outer", "tpch_q1", "tpch_q3", "tpch_q6", "tpch_q7", "tpch_q8", "tpch_q10", "tpch_q14", "tpch_q17", "tpch_q18", "tpch_q21"]
SHUFFLED = ["chain3", "chain4", "star4", "bushy5", "filter_in", "tpch_q3", "tpch_q7", "tpch_q8", "tpch_q10", "tpch_q21"]
VARIANTS = {"forward_only": {"passMode": "forward_only"}, "largest_root": {"heuristic": "largest_root"}}


def run_all(df) -> None:
    """Run the query's own plan to the end."""
    df.collect()


def best(runs: dict, query: str, times: int) -> dict[str, float]:
    """Least seconds of each way to run the query, after one warm-up; the ways take turns, and another one is the first each time."""
    found, order = dict.fromkeys(runs, math.inf), list(runs.items())
    for k in range(times + 1):
        order.append(order.pop(0))
        for name, run in order:
            start = time.perf_counter()
            run_all(run(query))
            if k:
                found[name] = min(found[name], time.perf_counter() - start)
    return {k: round(v, 3) for k, v in found.items()}


def geomean(plain: dict, ours: dict) -> float:
    return round(math.exp(sum(math.log(plain[q] / ours[q]) for q in ours) / max(1, len(ours))), 3)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    register(spark, sf_dir)
    session = TransferSession(spark)

    def used() -> dict:
        return {"jobs": session.last_jobs, "filters": sum(bool(e["filters"]) for e in session.last_profile())}

    seconds, plain, jobs = {}, {}, {}
    for name in QUERIES:
        found = best({"with": session.sql, "plain": spark.sql}, SQL[name], 4)
        seconds[name], plain[name], jobs[name] = found["with"], found["plain"], used()

    def settled(extra: dict):
        def run(query: str):
            with session.settings(minShuffledProbeBytes=1 << 20, **extra):
                return session.sql(query)

        return run

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    ways = {"plain": spark.sql, "with": session.sql, "gate_lowered": settled({})}
    variants = {v: settled(s) for v, s in VARIANTS.items()}
    shuffled: dict = {way: {} for way in (*ways, *variants)}
    did, rows = {}, {}
    for name in SHUFFLED:
        for way, value in best(ways | (variants if name in SHUFFLED[:4] else {}), SQL[name], 2).items():
            shuffled[way][name] = value
        df = ways["gate_lowered"](SQL[name])
        did[name] = used()
        if did[name]["filters"]:
            a, b = measure(df), measure(spark.sql(SQL[name]))
            rows[name] = {k: [a[k], b[k]] for k in ("join_rows", "most_join_rows", "shuffle_bytes", "peak_memory")}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    pairs = {"default": (plain, seconds), "shuffled": (shuffled["plain"], shuffled["with"]), "shuffled_gate_lowered": (shuffled["plain"], {q: v for q, v in shuffled["gate_lowered"].items() if did[q]["filters"]})}
    ratios = {k: geomean(p, o) for k, (p, o) in pairs.items()}
    bands = {k: {"faster": sum(p[q] > 1.05 * o[q] for q in o), "slower": sum(p[q] < 0.95 * o[q] for q in o), "of": len(o)} for k, (p, o) in pairs.items()}
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": total, "unit": "sec", "queries": seconds, "plain_spark": plain, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0),
        "transfer": jobs, "geomean_over_plain": ratios, "bands": bands, "shuffled": {**shuffled, "transfer_gate_lowered": did, "with_and_plain": rows},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
