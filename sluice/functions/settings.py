"""Settings of predicate transfer: ``spark.transfer.*`` keys, read when a query is planned."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

PREFIX = "spark.transfer."
_CHOICES = {"heuristic": ("join_order", "largest_root"), "passMode": ("both", "forward_only"), "filterType": ("all", "bf_only", "minmax_only")}


@dataclass(frozen=True)
class Settings:
    enabled: bool = True
    heuristic: str = "join_order"
    passMode: str = "both"
    flipRoots: bool = True
    filterType: str = "all"
    inListThreshold: int = 50
    removeRedundantPairs: bool = True
    profiling: bool = False
    displayDag: bool = False
    displayPhysicalDag: bool = False
    #: A relation with a smaller estimate isn't worth a filter where its joins broadcast the other side; 0 switches all cost rules off.
    minProbeBytes: int = 64 << 20
    #: The same where one of its joins must shuffle it. A build costs one small job (0.1 s here), so what it saves must be worth that.
    minShuffledProbeBytes: int = 32 << 20
    #: A build side up to this estimate is collected once; its rows give the filters and stand for it in the query.
    localBuildBytes: int = 256 << 10
    #: A build side whose counted rows take no more than this is broadcast in its own joins, whatever Spark estimates.
    provenBroadcastBytes: int = 8 << 20
    #: Summaries are built from relations up to this estimate, unless a predicate or a filter already reduces them.
    maxBuildBytes: int = 1 << 30
    #: Keys beyond this number get no Bloom filter (12 bits a key).
    maxBloomKeys: int = 10_000_000
    #: Column statistics for the redundancy test are only gathered from relations up to this estimate.
    maxStatsBytes: int = 1 << 30

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        """Read the session's settings. Unknown values are refused."""
        found, held = {}, spark._jsparkSession.sessionState().conf().settings()  # one map: a call a key through the public API takes ten times as long
        for f in fields(cls):
            raw = held.get(PREFIX + f.name)
            if raw is None:
                continue
            if f.type == "bool":
                if raw.lower() not in ("true", "false"):
                    raise ValueError(f"{PREFIX}{f.name} must be true or false, not {raw!r}")
                found[f.name] = raw.lower() == "true"
            elif f.type == "int":
                found[f.name] = int(raw)
            else:
                if raw not in _CHOICES[f.name]:
                    raise ValueError(f"{PREFIX}{f.name} must be one of {', '.join(_CHOICES[f.name])}, not {raw!r}")
                found[f.name] = raw
        return cls(**found)
