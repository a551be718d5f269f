"""Joins of many rows with one row a key, where a key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HOT, SALTS, FEW = 1000, 64, 1000


def parts() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))


def attached(rows: DataFrame, facts: DataFrame, key: list[str], by: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts``, which has one row a key and the key's number of rows as ``c``; ``how`` is inner or left_semi.

    A key with more than ``HOT`` rows is copied ``SALTS`` times and its rows are dealt by the hash of ``by``, so they meet their fact in as many
    tasks. Up to ``FEW`` such keys are named in one join by their hashes (another key of an equal hash is dealt likewise); more are joined apart from the
    rest, and both tables are read again for that, so they should be written ones. ``c`` is not in the result.
    """
    hot = facts.where(F.col("c") > HOT)
    named = [r[0] for r in hot.select(F.xxhash64(*key)).limit(FEW + 1).collect()]
    if len(named) <= FEW:
        often = F.xxhash64(*key).isin(named) if named else F.lit(False)
        salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.when(often, F.lit(SALTS)).otherwise(F.lit(1))))
        dealt = facts.drop("c").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.when(often, F.lit(SALTS - 1)).otherwise(F.lit(0)).cast("long"))))
        return salted.join(dealt, [*key, "__salt"], how).drop("__salt")
    hot = hot.drop("c").withColumn("__salt", parts())
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    apart = salted.join(hot, [*key, "__salt"], how).drop("__salt")
    rest = salted.join(hot.select(*key, "__salt"), [*key, "__salt"], "left_anti").drop("__salt")
    return apart.unionByName(rest.join(facts.where(F.col("c") <= HOT).drop("c"), key, how))
