"""Access to Catalyst plans through py4j. Everything that touches Spark's internal classes is in this module."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.classic.column import Column as JavaColumn


INTEGRAL = ("tinyint", "smallint", "int", "bigint")
_CLASSES: dict[tuple[int, str], object] = {}
_EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."


def java(spark: SparkSession, name: str):
    """A class by its full name; a look-up takes a call for each part of the name, so classes are kept."""
    key = id(spark._jvm), name
    if key not in _CLASSES:
        found = spark._jvm
        for part in name.split("."):
            found = getattr(found, part)
        _CLASSES[key] = found
    return _CLASSES[key]


def items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def scala_seq(spark: SparkSession, values: list):
    held = java(spark, "java.util.ArrayList")()
    for v in values:
        held.add(v)
    return java(spark, "scala.jdk.javaapi.CollectionConverters").asScala(held).toSeq()


def optimized(df: DataFrame):
    return df._jdf.queryExecution().optimizedPlan()


def analyzed(df: DataFrame):
    return df._jdf.queryExecution().analyzed()


def frame(spark: SparkSession, plan) -> DataFrame:
    return DataFrame(java(spark, "org.apache.spark.sql.classic.Dataset").ofRows(spark._jsparkSession, plan), spark)


def collected(df: DataFrame, most: int) -> tuple[object, int] | None:
    """(a local relation with the rows and the columns of ``df``, their number), or None if there are more than ``most``: one job, and the rows stay in the JVM."""
    spark = df.sparkSession
    execution = df._jdf.queryExecution()
    rows = java(spark, "scala.collection.immutable.ArraySeq").unsafeWrapArray(execution.executedPlan().executeTake(most + 1))
    if rows.length() > most:
        return None
    local = java(spark, "org.apache.spark.sql.catalyst.plans.logical.LocalRelation")
    return local(execution.optimizedPlan().output(), rows, False, java(spark, "scala.Option").empty()), rows.length()


def leaf_sizes(plan) -> list[int]:
    """Estimates of all leaves, those of subqueries included."""
    return [estimate(leaf) for p in [plan, *items(plan.subqueriesAll())] for leaf in items(p.collectLeaves())]


def block_sizes(plan) -> list[int]:
    """Estimates of the join inputs that have no join of their own."""
    kids, at = children(plan), kind(plan) == "Join"
    out = []
    for k in kids:
        below = block_sizes(k)
        out += below or ([estimate(k)] if at else [])
    return out


def row_bytes(plan) -> int:
    """Spark's own width of an output row in memory."""
    return sum(max(8, int(a.dataType().defaultSize())) + 8 for a in items(plan.output()))


def broadcast_threshold(spark: SparkSession) -> int:
    """The session's ``autoBroadcastJoinThreshold`` in bytes; -1: off."""
    return int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def children(plan) -> list:
    return items(plan.children())


def kind(plan) -> str:
    return plan.getClass().getSimpleName()


def with_children(spark: SparkSession, plan, new: list):
    return plan.withNewChildren(scala_seq(spark, new))


def output(plan) -> list[tuple[int, str, str]]:
    """(expression id, name, type) of each output column."""
    return [(a.exprId().id(), a.name(), a.dataType().catalogString()) for a in items(plan.output())]


def has_join(plan) -> bool:
    return kind(plan) == "Join" or any(map(has_join, children(plan)))


def estimate(plan) -> int:
    return int(str(plan.stats().sizeInBytes()))


def conjuncts(condition) -> list:
    if kind(condition) == "And":
        return conjuncts(condition.left()) + conjuncts(condition.right())
    return [condition]


def equal_columns(condition) -> tuple[int, int] | None:
    """Expression ids of ``column = column`` with equal types, else None. Null-safe equality and computed keys aren't taken."""
    if kind(condition) != "EqualTo":
        return None
    a, b = condition.left(), condition.right()
    if kind(a) != "AttributeReference" or kind(b) != "AttributeReference" or a.dataType().catalogString() != b.dataType().catalogString():
        return None
    return a.exprId().id(), b.exprId().id()


def join_type(plan) -> str:
    """inner, left, right, semi, anti, exists (a flag column) or other. A null-aware anti join (NOT IN) has a disjunction in its condition and so has no equal columns."""
    name = plan.joinType().toString()
    return {"Inner": "inner", "LeftOuter": "left", "RightOuter": "right", "LeftSemi": "semi", "LeftAnti": "anti"}.get(name, "exists" if name.startswith("ExistenceJoin") else "other")


def renames(plan) -> dict[int, int]:
    """Plain column aliases of a projection: new expression id -> old one."""
    out = {}
    for e in items(plan.projectList()):
        if kind(e) == "Alias" and kind(e.child()) == "AttributeReference":
            out[e.exprId().id()] = e.child().exprId().id()
    return out


def deterministic_here(plan) -> bool:
    return all(e.deterministic() for e in items(plan.expressions()))


def deterministic(plan) -> bool:
    return deterministic_here(plan) and all(map(deterministic, children(plan)))


def repeatable(plan) -> bool:
    """Whether the block has the same rows each time it is computed: not if a limit or a window may choose among ties."""
    return kind(plan) not in ("GlobalLimit", "LocalLimit", "Tail", "Offset", "Sample", "Window", "RepartitionByExpression") and all(map(repeatable, children(plan)))


def has_predicate(plan) -> bool:
    """Whether a block drops rows by more than null checks."""
    k = kind(plan)
    if k == "Filter" and any(kind(c) != "IsNotNull" for c in conjuncts(plan.condition())):
        return True
    if k in ("GlobalLimit", "LocalLimit", "Join", "Sample", "Except", "Intersect", "Distinct", "LocalRelation"):
        return True
    return any(map(has_predicate, children(plan)))


def comparisons(plan) -> list[tuple[object, str, str, int]] | None:
    """(plan below, column, operator, constant) of a block's predicates if all compare an integral column with a constant and nothing else drops rows, else None."""
    k = kind(plan)
    if k == "LogicalRelation":
        return []
    if k not in ("Project", "Filter"):
        return None
    below = plan.child()
    found = comparisons(below)
    if k == "Project" or found is None:
        return found
    for part in conjuncts(plan.condition()):
        if kind(part) == "IsNotNull":
            continue
        if kind(part) not in ("GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual", "EqualTo"):
            return None
        a, b = part.left(), part.right()
        if kind(a) != "AttributeReference" or kind(b) != "Literal" or a.dataType().catalogString() not in INTEGRAL or b.value() is None:
            return None
        found = [*found, (below, a.name(), kind(part), int(b.value()))]
    return found


def table_name(plan) -> str:
    """A short name: the file or table of the only leaf, else the node's kind."""
    leaves = items(plan.collectLeaves())
    if len(leaves) == 1 and kind(leaves[0]) == "LogicalRelation":
        try:
            files = list(leaves[0].relation().inputFiles())
            if files:
                part = [p for p in files[0].split("/") if p.endswith(".parquet") and not p.startswith("part-")]
                return part[-1].removesuffix(".parquet") if part else files[0].rsplit("/", 1)[-1]
        except Exception:  # relations that aren't files have no input files
            pass
    return kind(leaves[0] if len(leaves) == 1 else plan)


def _hash(spark: SparkSession, df: DataFrame, names: list[str]):
    by = {a.name(): a for a in items(analyzed(df).output())}
    return java(spark, _EXPRESSIONS + "XxHash64")(scala_seq(spark, [by[n] for n in names]), 42)


def _column(spark: SparkSession, expression) -> JavaColumn:
    return JavaColumn(java(spark, "org.apache.spark.sql.classic.ExpressionUtils").column(expression))


def _literal(spark: SparkSession, value: int):
    return spark._jsparkSession.sessionState().sqlParser().parseExpression(f"{value}L")  # a long: a Python number may arrive as an int


def bloom_aggregate(df: DataFrame, names: list[str], keys: int, bits: int) -> JavaColumn:
    """Spark's own Bloom aggregate over xxhash64 of the named columns, to be read as bytes by ``might_contain``."""
    spark = df.sparkSession
    made = java(spark, _EXPRESSIONS + "aggregate.BloomFilterAggregate")(_hash(spark, df, names), _literal(spark, max(1, keys)), _literal(spark, max(64, bits)), 0, 0)
    return _column(spark, made.toAggregateExpression())


def folded(bloom: bytes, bits: int) -> bytes:
    """The same filter with half as many bits, again and again, as long as ``bits`` are left: a place modulo the half is where the whole's halves lie on each other."""
    start = {1: 12, 2: 16}.get(int.from_bytes(bloom[:4], "big"))  # version, hash functions, in version 2 a seed, and the number of words before the words
    if start is None:
        return bloom
    words = np.frombuffer(bloom, ">u8", offset=start)
    while len(words) % 2 == 0 and 32 * len(words) >= bits:
        words = words[: len(words) // 2] | words[len(words) // 2 :]
    return bloom[: start - 4] + len(words).to_bytes(4, "big") + words.astype(">u8").tobytes()


def _held(spark: SparkSession, data):
    """``data``, bytes or a local relation of one row, as a subquery that reads that row. A literal's bytes would stand in hex in every text of the plan, and Spark makes and keeps such texts
    for each execution and each adaptive step: 8 MB of bits took tens of MB a text."""
    plan = data
    if isinstance(data, bytes):
        row = spark.sparkContext._gateway.new_array(java(spark, "java.lang.Object"), 1)
        row[0] = data
        rows = java(spark, "java.util.ArrayList")()
        rows.add(java(spark, "org.apache.spark.sql.RowFactory").create(row))
        plan = spark._jsparkSession.createDataFrame(rows, java(spark, "org.apache.spark.sql.types.StructType").fromDDL("bloom binary")).queryExecution().analyzed()
    none, empty = java(spark, "scala.Option").empty(), scala_seq(spark, [])
    return java(spark, _EXPRESSIONS + "ScalarSubquery")(plan, empty, java(spark, _EXPRESSIONS + "NamedExpression").newExprId(), empty, none, none, none)


def might_contain(df: DataFrame, data, names: list[str]) -> JavaColumn:
    """Spark's own Bloom probe over xxhash64 of the named columns; it stays inside generated code."""
    spark = df.sparkSession
    return _column(spark, java(spark, _EXPRESSIONS + "BloomFilterMightContain")(_held(spark, data), _hash(spark, df, names)))


def table_files(plan) -> list[str]:
    """Root paths of the files below, so that statistics of one table never serve another."""
    out = []
    for leaf in items(plan.collectLeaves()):
        if kind(leaf) == "LogicalRelation":
            out += sorted(str(p) for p in items(leaf.relation().location().rootPaths())) if hasattr(leaf.relation(), "location") else [leaf.toString()]
        else:
            out.append(str(leaf.hashCode()))
    return out
