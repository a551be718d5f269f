"""CREATE and PROBE: summaries of a relation's keys and the predicates made from them."""

from __future__ import annotations

import datetime
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from sluice.functions.settings import Settings
from sluice.plans import catalyst as c

_INTEGRAL = {"tinyint", "smallint", "int", "bigint"}
_ORDERED = _INTEGRAL | {"float", "double", "date", "timestamp", "timestamp_ntz", "string", "boolean"}
BITS_PER_KEY = 12
MOST_BITS = 64 << 20  #: Spark's own bound for a Bloom filter made by one aggregation
_TRACKED = 2000
_FEW_BYTES = 1 << 20
_LOCAL = 2000  #: rows up to which a local relation's keys are read


def _exact(kind: str) -> bool:
    """Types whose equality agrees with that of literals and hashes (floating zeros and NaN don't)."""
    return kind in _ORDERED - {"float", "double"} or kind.startswith("decimal")


def _bounded(kind: str) -> bool:
    return kind in _ORDERED or kind.startswith("decimal")


@dataclass
class Summary:
    """What one CREATE gathered: key rows seen, per column its values (if few) or bounds, and the whole key as a Bloom filter or, for a local relation, as its rows."""

    names: list[str]
    kinds: list[str]
    rows: int
    values: list[list | None] = field(default_factory=list)
    bounds: list[tuple | None] = field(default_factory=list)
    bloom: object = None
    keys: DataFrame | None = None

    @property
    def empty(self) -> bool:
        return self.rows == 0


def _keys(df: DataFrame, names: list[str]) -> DataFrame:
    """The key columns as k0, k1, ...; null keys never match and are left out."""
    return df.select(*[F.col(f"`{n}`").alias(f"k{i}") for i, n in enumerate(names)]).dropna()


def create_local(df: DataFrame, names: list[str], kinds: list[str], rows: int, settings: Settings) -> Summary:
    """Summary of a local relation (see ``catalyst.collected``) of ``rows`` rows: few keys are read, without a job; many stand for themselves in a semi-join."""
    keys = _keys(df, names)
    if rows > _LOCAL and all(map(_exact, kinds)) and settings.filterType != "minmax_only":
        return Summary(names, kinds, rows, [None] * len(names), [None] * len(names), keys=keys)
    found = list(set(map(tuple, keys.collect())))
    out = Summary(names, kinds, len(found))
    for i, k in enumerate(kinds):
        values = {r[i] for r in found}
        out.values.append(sorted(values) if _exact(k) and len(values) <= settings.inListThreshold else None)
        out.bounds.append((min(values), max(values)) if values and _exact(k) else None)
    if found and (len(found) > settings.inListThreshold or len(names) > 1) and all(map(_exact, kinds)):
        out.keys = keys
    return out


def create(df: DataFrame, names: list[str], kinds: list[str], size: int, settings: Settings) -> Summary:
    """Summarise the keys of ``df`` by one aggregation: count, bounds, the distinct values where they are few, and a Bloom filter for as many keys as ``size`` bytes can hold.

    Where so many keys would pass what one aggregation may build, a second one makes the filter at exactly the count. What comes to the driver is
    bounded: threshold values and two bounds a column, the filter.
    """
    keys = _keys(df, names)
    cols, most = keys.columns, settings.inListThreshold + 1
    known = [i for i, k in enumerate(kinds) if _bounded(k)]
    parts = [F.count("*").alias("n"), *[f(cols[i]).alias(f"{p}{i}") for i in known for f, p in ((F.min, "lo"), (F.max, "hi"))]]
    # The top items with their counts are all values if they are fewer than asked for and their counts add up. Large build sides seldom have so few.
    few = [i for i, k in enumerate(kinds) if _exact(k) and size <= _FEW_BYTES]
    parts += [F.expr(f"approx_top_k(k{i}, {most}, {max(_TRACKED, 4 * most)})").alias(f"top{i}") for i in few]
    fits = 1 << max(10, (size // 2).bit_length())  # a power of two, so that the filter can be folded to what the count needs
    blooms = settings.filterType != "minmax_only" and all(map(_exact, kinds))
    at_once = blooms and 16 * fits <= MOST_BITS
    if at_once:
        parts.append(c.bloom_aggregate(keys, cols, fits, 16 * fits).alias("bloom"))
    r = keys.agg(*parts).first()
    out = Summary(names, kinds, r["n"])
    for i, k in enumerate(kinds):
        top = r[f"top{i}"] if i in few else None
        out.values.append(sorted(x["item"] for x in top) if top is not None and len(top) < most and sum(x["count"] for x in top) == out.rows else None)
        out.bounds.append((r[f"lo{i}"], r[f"hi{i}"]) if i in known and r[f"lo{i}"] is not None else None)
    if at_once and out.rows:
        out.bloom = c.folded(bytes(r["bloom"]), BITS_PER_KEY * out.rows)
    elif blooms and 0 < out.rows <= settings.maxBloomKeys and not (len(names) == 1 and out.values[0] is not None):
        # These are the large ones; they stay in the JVM.
        out.bloom = c.collected(keys.agg(c.bloom_aggregate(keys, cols, out.rows, BITS_PER_KEY * out.rows).alias("bloom")), 1)[0]
    return out


def literal(value, kind: str) -> Column:
    if isinstance(value, (datetime.date, datetime.datetime)):
        return F.lit(str(value)).cast(kind)
    return F.lit(value).cast(kind)


def probe(df: DataFrame, summary: Summary, names: list[str], settings: Settings) -> tuple[DataFrame, list[str]]:
    """``df`` without the rows that the summary excludes, and the kinds of predicates in use. The rows of a local key set stand for a Bloom filter, exactly."""
    if summary.empty:
        return df.where(F.lit(False)), ["always false"]
    used: list[str] = []
    condition = None

    def add(predicate: Column, label: str) -> None:
        nonlocal condition
        condition = predicate if condition is None else condition & predicate
        used.append(label)

    pick, whole = settings.filterType, False
    for i, n in enumerate(names):
        col, kind, values, bounds = F.col(f"`{n}`"), summary.kinds[i], summary.values[i], summary.bounds[i]
        if pick == "all" and values is not None and len(values) == 1:
            add(col == literal(values[0], kind), "=")
            whole = whole or len(names) == 1
            continue
        dense = values is not None and kind in _INTEGRAL and values[-1] - values[0] + 1 == len(values)
        if values is not None and not (pick == "minmax_only" or dense and pick == "all"):
            # A small exact set stands for the Bloom filter as well: it lets nothing through that the filter would stop.
            add(col.isin([literal(v, kind) for v in values]), "in" if pick == "all" else "bloom")
            whole = whole or len(names) == 1
        if pick in ("all", "minmax_only") and bounds is not None:
            add((col >= literal(bounds[0], kind)) & (col <= literal(bounds[1], kind)), "min/max")
            whole = whole or dense and len(names) == 1
    bloom = not whole and pick in ("all", "bf_only")
    if bloom and summary.bloom is not None:
        add(c.might_contain(df, summary.bloom, names), "bloom")
    out = df.where(condition) if condition is not None else df
    if bloom and summary.keys is not None:
        same = [F.col(f"`{n}`") == F.col(f"__k{i}") for i, n in enumerate(names)]
        keys = summary.keys.toDF(*[f"__k{i}" for i in range(len(names))])
        out = out.join(F.broadcast(keys), same, "left_semi")
        used.append("bloom")
    return out, used


@dataclass
class Stats:
    """Statistics of an integral key of one or more columns for the redundancy test: each column's range, and a sketch of the whole keys. Keys with a null are left out."""

    low: tuple | None
    high: tuple | None
    distinct: int
    sketch: bytes


def key_stats(df: DataFrame, names: list[str]) -> Stats:
    keys = _keys(df, names)
    whole = keys[0].cast("long") if len(names) == 1 else F.xxhash64(*keys.columns)
    ranges = [f(k).alias(f"{p}{k}") for k in keys.columns for f, p in ((F.min, "lo"), (F.max, "hi"))]
    r = keys.agg(*ranges, F.hll_sketch_agg(whole).alias("s"), F.hll_sketch_estimate(F.hll_sketch_agg(whole)).alias("d")).first()
    low, high = (tuple(r[f"{p}{k}"] for k in keys.columns) for p in ("lo", "hi"))
    return Stats(None if None in low else low, None if None in high else high, r["d"] or 0, bytes(r["s"] or b""))


def always_true(op: str, value: int, stats: Stats) -> bool:
    """Whether ``column op value`` holds for all values that the statistics allow."""
    if stats.low is None:
        return False
    low, high = stats.low[0], stats.high[0]
    return {"GreaterThan": low > value, "GreaterThanOrEqual": low >= value, "LessThan": high < value, "LessThanOrEqual": high <= value, "EqualTo": low == high == value}[op]


def contained(df: DataFrame, build: Stats, probe_side: Stats) -> bool:
    """Whether the probe's keys are (very probably) among the build's: its ranges lie inside and the union of both sketches is no larger. A wrong yes costs work, never rows."""
    if probe_side.low is None:
        return True
    if build.low is None or any(b > p for b, p in zip(build.low, probe_side.low, strict=True)) or any(p > b for b, p in zip(build.high, probe_side.high, strict=True)):
        return False
    spark = df.sparkSession
    one = spark.createDataFrame([(bytearray(build.sketch), bytearray(probe_side.sketch))], "a binary, b binary")
    both = one.select(F.hll_sketch_estimate(F.hll_union("a", "b"))).first()[0]
    return both <= build.distinct * 1.02 + 1
