"""Line dedup across documents with levelled sorted runs of line hashes. DataFrame functions only.

A run is a written table in hash buckets, each sorted, with one row a hash: how many documents hold the line, the largest doc_id among them, and whether
the hash was fresh when the run was added. A new batch is grouped by hash and merge-anti-joined with the live runs, bucket by bucket: what no run has is
fresh, so fresh rows are disjoint over all runs and are the store's keys; the rest only adds to a key's count. Totals are the fresh rows with what later runs
add to them. ``FANOUT`` runs of a level are merged into one of the next level. A store can be kept: its manifest names the live runs, and it is opened again by its path.

Defined cases: null text is one empty line; a document with a null doc_id isn't counted and keeps its lines; rows that share a doc_id count as one
document, and all of them keep the lines that the largest doc_id keeps; an empty table gives an empty table; other columns pass, save that one named like a
result is replaced by it; equal lines of one document count once; a very long text is split within its row.
"""

from __future__ import annotations

import json
import string
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sluice.llm.scratch import WRITTEN, Scratch, delete, read_text, write_text

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 4, 3
_SPACE = " \t\n\x0b\x0c\r"
_KEY = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space at both ends, with A-Z (only) in lower case."""
    bare = F.btrim(line, F.lit(_SPACE))
    # lower() is quick but also changes other capitals; lines that hold some go the slow way.
    plain = (F.length(bare) == F.octet_length(bare)) | ~bare.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def line_hash(line: Column) -> Column:
    """Both hashes of a line that is long enough, else null. What is too short before it is lower-cased isn't looked at further."""
    key = line_key(line)
    return F.when(F.length(F.btrim(line, F.lit(_SPACE))) >= MIN_CHARS, F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")))


class LineRuns:
    """The store below ``root``: ``add`` takes a batch of (h1, h2, doc_id) rows, ``totals`` gives each hash's documents and largest doc_id.

    The manifest is replaced after a run is complete, so a store whose writer was lost is as it was before the batch.
    """

    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT):
        self.spark, self.root, self.fanout = spark, root.rstrip("/"), fanout
        self.prefix = f"sluice_runs_{uuid.uuid4().hex[:12]}"
        held = read_text(spark, f"{self.root}/manifest.json")
        state = json.loads(held) if held else {"buckets": int(spark.conf.get("spark.sql.shuffle.partitions")), "levels": [[]], "next": 0}
        self.buckets, self.levels, self.next = state["buckets"], state["levels"], state["next"]

    def _table(self, run: str) -> DataFrame:
        """A run as a bucketed table; the catalogue entry is the session's, the files are the store's."""
        name = f"{self.prefix}_{run}"
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE {name} (h1 BIGINT, h2 BIGINT, n BIGINT, last BIGINT, fresh BOOLEAN) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self.root}/{run}'")
        return self.spark.table(name)

    def _write(self, df: DataFrame) -> str:
        run = f"run{self.next}"
        self.next += 1
        delete(self.spark, f"{self.root}/{run}")  # what a lost writer may have left
        df.write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("path", f"{self.root}/{run}").options(**WRITTEN).format("parquet").saveAsTable(f"{self.prefix}_{run}")
        return run

    def _live(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def _union(self, runs: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, map(self._table, runs))

    def add(self, batch: DataFrame) -> None:
        own = batch.groupBy(*_KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
        known = F.lit(False)
        for k, run in enumerate(self._live()):  # few: FANOUT - 1 a level
            seen = self._table(run).where("fresh").select(*_KEY, F.lit(True).alias(f"in{k}"))
            own = own.join(seen.hint("merge"), _KEY, "left")
            known |= F.coalesce(f"in{k}", F.lit(False))
        self.levels[0].append(self._write(own.select(*_KEY, "n", "last", (~known).alias("fresh"))))
        depth, old = 0, []
        while len(self.levels[depth]) >= self.fanout:
            if depth + 1 == len(self.levels):
                self.levels.append([])
            merged = self._union(self.levels[depth]).groupBy(*_KEY).agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.max("fresh").alias("fresh"))
            self.levels[depth + 1].append(self._write(merged))
            old += self.levels[depth]
            self.levels[depth] = []
            depth += 1
        write_text(self.spark, f"{self.root}/manifest.json", json.dumps({"buckets": self.buckets, "levels": self.levels, "next": self.next}))
        for run in old:
            self._drop(run)
            delete(self.spark, f"{self.root}/{run}")

    def _drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}_{run}")

    def totals(self) -> DataFrame:
        """(h1, h2, n, last) of every hash: the fresh rows, each with what the other runs know of it."""
        rows = self._union(self._live())
        more = rows.where("not fresh").groupBy(*_KEY).agg(F.sum("n").alias("more"), F.max("last").alias("later"))
        return rows.where("fresh").join(more.hint("merge"), _KEY, "left").select(*_KEY, (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("last", "later").alias("last"))

    def close(self) -> None:
        """Take the runs out of the session's catalogue; the files stay."""
        for run in self._live():
            self._drop(run)


def dropped_lines(df: DataFrame, scratch: Scratch, *, text: str = "text", key: str = "doc_id", batches: int = BATCHES, store: str | None = None) -> DataFrame:
    """(doc_id, drop): the hashes of the lines that the document loses; documents that lose none are absent. ``store``: path of a kept store, to which the table is added."""
    spark = df.sparkSession
    hashes = F.filter(F.array_distinct(F.transform(lines_of(F.col(text)), line_hash)), lambda x: x.isNotNull())
    # Exploded in place: from a column of their own Spark would infer a filter and make the hashes twice.
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.explode(hashes).alias("x")).select("doc_id", "x.h1", "x.h2", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("batch"))
    path = scratch.path("lines")
    rows.write.partitionBy("batch").options(**WRITTEN).parquet(path)
    stored = spark.read.schema("doc_id long, h1 long, h2 long, batch long").parquet(path)
    shared = scratch.table(df.groupBy(F.col(key).alias("doc_id")).agg(F.count("*").alias("c")).where("c > 1 and doc_id is not null").select("doc_id"), "shared")
    several = not shared.isEmpty()
    runs = LineRuns(spark, store or scratch.path("runs"))
    for b in range(batches):
        batch = stored.where(F.col("batch") == b).drop("batch")
        if several:  # rows of one document are in one batch: equal lines of theirs count once
            batch = batch.join(shared, "doc_id", "left_anti").unionByName(batch.join(shared, "doc_id", "left_semi").distinct())
        runs.add(batch)
    common = scratch.table(runs.totals().where(F.col("n") >= MIN_DOCS).select(*_KEY, "last"), "common")
    runs.close()
    losing = stored.drop("batch").join(common, _KEY).where(F.col("doc_id") != F.col("last"))
    return losing.groupBy("doc_id").agg(F.collect_set("h1").alias("drop"))


def without_repeated_lines(df: DataFrame, *, text: str = "text", key: str = "doc_id", batches: int = BATCHES, store: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``df`` with n_lines, n_dropped and kept_text. With ``store``, lines of tables that were added to it before count, too."""
    scratch = scratch or Scratch(df.sparkSession, "lines")
    drop = dropped_lines(df, scratch, text=text, key=key, batches=batches, store=store).select(F.col("doc_id").alias("__drop_id"), F.col("drop").alias("__drop"))
    kept = [c for c in df.columns if c.lower() not in ("n_lines", "n_dropped", "kept_text")]
    # Rows without an id meet nothing; a hash of their text deals them over all tasks.
    rows = df.select(*[F.col(f"`{c}`") for c in kept], lines_of(F.col(text)).alias("__lines"), F.coalesce(F.col(key), F.xxhash64(text)).alias("__id"), F.col(key).isNull().alias("__none"))
    out = rows.join(drop.withColumn("__never", F.lit(False)), (F.col("__id") == F.col("__drop_id")) & (F.col("__none") == F.col("__never")), "left")
    keep = F.filter("__lines", lambda x: ~F.coalesce(F.array_contains(F.col("__drop"), line_hash(x)["h1"]), F.lit(False)))
    out = out.withColumn("__kept", F.when(F.col("__drop").isNull(), F.col("__lines")).otherwise(keep))
    return out.select(*[F.col(f"`{c}`") for c in kept], F.size("__lines").cast("long").alias("n_lines"), (F.size("__lines") - F.size("__kept")).cast("long").alias("n_dropped"), F.array_join("__kept", "\n").alias("kept_text"))
