"""MinHash near-dedup with tensored banding.

``COLLECTIONS`` small collections of ``ROWS`` minhashes each give one hash per collection; a table key is a pair of collections, so
16 collections (32 minhashes) stand for 120 tables of 4 minhashes. Two texts of similarity 0.75 share a key unless fewer than two
collections agree: with chance 4e-5. Only collections whose hash some other text shares can lie in a shared key, so keys are formed after a semi-join.

Equal shingle sets are one class from the start. Candidates are verified on full shingle sets, in rounds that never emit all pairs of a bucket:
first each class against one hub of its buckets; then, ``ROUNDS`` times, what a bucket holds outside of its largest component against up to ``HUBS``
hubs inside of it, so that large groups of near copies grow together. What then still shares a bucket with another component is joined exactly: two sets of
the wanted similarity share one of the rarest quarter of their shingles, so texts that have only a frequent passage in common (as many
as there may be) never meet. No round drops a candidate for the size of its bucket.

Defined cases: null text has no words and is linked with nothing; a text of fewer words than a shingle is one shingle; a null doc_id is
linked with nothing (component null, kept); rows that share a doc_id are one node with the links of all its texts; repeated rows are one; an empty table gives an
empty table; other columns are ignored; bytes that aren't UTF-8 are taken as they are; a very long text is one set within its row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sluice.llm.batches import chunks, map_batches, texts_of
from sluice.llm.components import components
from sluice.llm.scratch import Scratch
from sluice.llm.spread import HOT, attached

WORDS, SIMILARITY = 5, 75
COLLECTIONS, ROWS = 16, 2
ROUNDS, HUBS = 2, 4
_ODD = np.random.default_rng(20240).integers(0, 1 << 63, COLLECTIONS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = np.random.default_rng(20241).integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles. bytes.lower and bytes.split are those of ASCII, as is asked for."""
    split = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    n = int(counts.sum())
    words = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in split for w in ws), np.uint64, n)
    full = np.zeros(max(0, n - WORDS + 1), np.uint64)
    for k in range(WORDS):
        full += words[k : k + len(full)] * _WORD[k]
    full = _mix(full)
    out, at = [], 0
    for c in counts.tolist():
        if c >= WORDS:
            out.append(np.unique(full[at : at + c - WORDS + 1]))
        elif c:
            out.append(_mix((words[at : at + c] * _WORD[:c]).sum(keepdims=True) + np.uint64(c)))
        else:
            out.append(np.empty(0, np.uint64))
        at += c
    return out


def _list_array(sets: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
    values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def signatures(df: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n, s1, s2, units): set size, a 128-bit hash of the set, and one hash per collection."""

    def run(batch: pa.RecordBatch):
        texts = texts_of(batch.column(1))
        for a, b in chunks(texts):
            sets = shingle_sets(texts[a:b])
            n = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(n)
            s1, s2 = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
            units = np.zeros((COLLECTIONS, len(some)), np.uint64)
            if len(some):
                flat = np.concatenate([sets[i] for i in some])
                starts = np.concatenate(([0], np.cumsum(n[some])[:-1]))
                s1[some] = np.add.reduceat(_mix(flat), starts)
                s2[some] = np.add.reduceat(_mix(flat ^ np.uint64(0x5851F42D4C957F2D)), starts)
                for i in range(COLLECTIONS):
                    for r in range(ROWS):
                        units[i] = _mix(units[i] + np.minimum.reduceat(flat * _ODD[i * ROWS + r], starts) * _WORD[r])
            each = [np.empty(0, np.uint64)] * (b - a)
            for k, i in enumerate(some.tolist()):
                each[i] = units[:, k]
            arrays = [batch.column(0).slice(a, b - a), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), _list_array(each)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "s1", "s2", "units"])

    return map_batches(df.select(F.col(key).cast("long").alias("doc_id"), F.col(text)), run, "doc_id long, n long, s1 long, s2 long, units array<long>")


def _sets(df: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch):
        texts = texts_of(batch.column(1))
        for a, b in chunks(texts):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _list_array(shingle_sets(texts[a:b]))], names=["doc_id", "items"])

    return map_batches(df, run, "doc_id long, items array<long>")


def bucket_rows(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, id) for the table keys that at least two classes may share; ``classes`` has id, s1 and units."""
    units = classes.select("id", "s1", F.posexplode("units").alias("i", "u"))
    shared = scratch.table(units.groupBy("i", "u").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    left = attached(units, shared, ["i", "u"], F.col("id"), "left_semi").groupBy("id", "s1").agg(F.array_sort(F.collect_list(F.struct("i", "u"))).alias("held"))
    pairs = F.flatten(F.transform("held", lambda x, k: F.transform(F.slice("held", k + 2, COLLECTIONS), lambda y: F.xxhash64(x["i"], y["i"], x["u"], y["u"]))))
    return left.where(F.size("held") > 1).select("id", F.explode(pairs).alias("key")).distinct()


def _linked(inter: Column, na: Column, nb: Column) -> Column:
    return 100 * inter >= SIMILARITY * (na + nb - inter)


def verified(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """``pairs`` (a, b) with ``inter`` and ``union``, counted on the full sets. An ``a`` with very many pairs meets them in many tasks; each ``b`` has a few."""
    pairs = scratch.table(pairs, "pairs")
    many = scratch.table(pairs.groupBy("a").agg(F.count("*").alias("c")), "many")
    left = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("__x")).join(many, "a")
    right = sets.select(F.col("doc_id").alias("__b"), F.col("items").alias("__y"))
    rows = attached(pairs, left, ["a"], F.col("b")).join(right, F.col("b") == F.col("__b")).drop("__b")
    rows = rows.withColumn("inter", F.size(F.array_intersect("__x", "__y")))
    return rows.withColumn("union", F.size("__x") + F.size("__y") - F.col("inter")).drop("__x", "__y")


def _mains(members: DataFrame, salt: int) -> DataFrame:
    """Per bucket with several components: its rows, the largest component and a hub inside of it; ``members`` has key, id, n and comp."""
    each = members.groupBy("key", "comp").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("id", F.lit(salt)).alias("o"), "id", "n")).alias("h"))
    most = each.groupBy("key").agg(F.max(F.struct("c", "comp", "h")).alias("m"), F.count("*").alias("comps"), F.sum("c").alias("c")).where("comps > 1")
    return most.select("key", "c", F.col("m.comp").alias("main"), F.col("m.h.id").alias("hub"), F.col("m.h.n").alias("hub_n"))


def _hub_pairs(members: DataFrame, salt: int, scratch: Scratch) -> DataFrame:
    """(a, b): members outside of their buckets' largest components with at most ``HUBS`` hubs each."""
    close = 100 * F.least("n", "hub_n") >= SIMILARITY * F.greatest("n", "hub_n")
    out = attached(members, scratch.table(_mains(members, salt), "mains"), ["key"], F.col("id")).where((F.col("comp") != F.col("main")) & close)
    few = F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("hub", "id").alias("o"), "hub"))), 1, HUBS)  # at most one hub a table before
    return out.groupBy("id").agg(few.alias("x")).select(F.col("id").alias("b"), F.explode("x").alias("x")).select(F.col("x.hub").alias("a"), "b")


def _prefixes(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, id, pos): the rarest shingles of each member, as many as a linked partner must share one of, with their places in that order; those of one member only are left out."""
    own = sets.join(members.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), F.xxhash64("items").alias("set"), "items").distinct()
    items = own.select("id", "set", F.explode("items").alias("item"))
    often = items.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    ranked = items.join(often, "item", "left").groupBy("id", "set").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "item"))).alias("x"))
    n = F.size("x")
    first = F.slice("x", 1, n - F.ceil(n * SIMILARITY / 100).cast("int") + 1)
    return ranked.select("id", F.posexplode(first).alias("pos", "x")).where("x.df > 1").select("id", F.col("x.item").alias("key"), "pos")


def _outside(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs a < b of members that share a key but no component, one of them outside of the key's largest component.

    ``rows`` has key, id, n, pos and comp. Two members that are both inside of it share a component, so nothing is lost. At the first key that two
    members share, what they have in common lies at or behind their places: where that is too little, they can't be linked. The rows of a
    frequent shingle are dealt to parts of about ``HOT`` rows, to each of which go those outside of the main component.
    """
    mains = scratch.table(_mains(rows, 0).select("key", "main", "c"), "mains")
    mixed = attached(rows, mains.withColumn("parts", F.ceil(F.col("c") / HOT)), ["key"], F.col("id"))
    mixed = scratch.table(mixed.select("key", "main", "comp", "id", "n", "pos", "parts", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")), "mixed")
    out = mixed.where("comp <> main").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    out = out.select(F.col("key").alias("key1"), F.col("part").alias("part1"), F.col("comp").alias("comp1"), F.col("id").alias("id1"), F.col("n").alias("n1"), F.col("pos").alias("pos1"))
    close = (100 + SIMILARITY) * F.least(F.col("n") - F.col("pos"), F.col("n1") - F.col("pos1")) >= SIMILARITY * (F.col("n") + F.col("n1"))
    once = (F.col("comp") == F.col("main")) | (F.col("id1") < F.col("id"))
    found = out.join(mixed, (F.col("key") == F.col("key1")) & (F.col("part") == F.col("part1")) & (F.col("comp") != F.col("comp1")) & close & once)
    return found.select(F.least("id", "id1").alias("a"), F.greatest("id", "id1").alias("b")).distinct()


def near_duplicates(df: DataFrame, *, text: str = "text", key: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach) and kept."""
    scratch = scratch or Scratch(df.sparkSession, "neardup")
    sig = scratch.table(signatures(df, text=text, key=key), "signatures")
    known = sig.where("n > 0 and doc_id is not null")
    heads = known.groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), F.count("*").alias("c"))
    heads = scratch.table(heads, "heads")
    classes = known.join(heads, (known.doc_id == heads.id) & (known.s1 == heads.s1) & (known.s2 == heads.s2)).select("id", known.s1, known.s2, "n", "units").dropDuplicates(["id", "s1", "s2"])
    classes = scratch.table(classes, "classes")
    size = classes.select("id", "n").distinct()  # several rows for an id with several texts
    rows = scratch.table(bucket_rows(classes, scratch), "rows")
    filled = rows.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("id").alias("o"), F.col("id"))).alias("hub")).where("c > 1").select("key", "c", F.col("hub.id").alias("hub"), F.col("hub.o").alias("hub_o"))
    buckets = scratch.table(attached(rows, scratch.table(filled, "filled"), ["key"], F.col("id")), "buckets")
    members = scratch.table(buckets.select(F.col("id").alias("doc_id")).distinct(), "members")
    texts = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("__text"))
    sets = scratch.table(_sets(texts.join(members, "doc_id", "left_semi")), "sets")

    # Round 1: each class against one hub, the first in hash order over all its buckets.
    one = buckets.where("id <> hub").groupBy("id").agg(F.min(F.struct("hub_o", "hub")).alias("h")).select(F.col("id").alias("b"), F.col("h.hub").alias("a"))
    one = scratch.table(verified(one, sets, scratch), "round1")
    links = scratch.table(one.where(100 * F.col("inter") >= SIMILARITY * F.col("union")).select("a", "b").unionByName(_same_id(known, heads, scratch)), "links")
    roots = scratch.table(components(links, scratch), "roots1")

    # More hubs, for what lies outside of its buckets' largest components.
    left = scratch.table(_mixed(buckets.select("key", "id").join(size, "id"), roots, scratch), "left")
    for k in range(ROUNDS):
        more = scratch.table(verified(_hub_pairs(left, k + 1, scratch), sets, scratch), "hubs")
        links = links.union(more.where(100 * F.col("inter") >= SIMILARITY * F.col("union")).select("a", "b"))
        roots = scratch.table(components(links, scratch), "roots")
        left = scratch.table(_mixed(left.drop("comp"), roots, scratch), "left")

    # The rest exactly: by the rarest shingles of what still shares a bucket with another component.
    rest = scratch.table(left.select("id", "n", "comp").distinct(), "rest")
    rare = scratch.table(_prefixes(rest, sets).join(rest, "id"), "rare")
    last = scratch.table(verified(_outside(rare, scratch), sets, scratch), "last")
    links = links.union(last.where(100 * F.col("inter") >= SIMILARITY * F.col("union")).select("a", "b"))
    roots = scratch.table(components(links, scratch), "roots")

    head = heads.join(roots, heads.id == roots.node, "left").select("s1", "s2", "c", F.coalesce("root", "id").alias("component_id"))
    out = attached(known, scratch.table(head, "head"), ["s1", "s2"], F.col("doc_id")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sig.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _same_id(known: DataFrame, heads: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b): the classes of texts that share a doc_id, by their heads."""
    twice = scratch.table(known.groupBy("doc_id").agg(F.min("s1").alias("lo"), F.max("s1").alias("hi"), F.min("s2").alias("lo2"), F.max("s2").alias("hi2")).where("lo <> hi or lo2 <> hi2").select("doc_id"), "twice")
    own = known.join(twice, "doc_id", "left_semi").select("doc_id", "s1", "s2").distinct().join(heads.drop("c"), ["s1", "s2"]).where("doc_id <> id")
    return own.select(F.col("doc_id").alias("a"), F.col("id").alias("b"))


def _mixed(rows: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """Bucket rows with their component, of the buckets that hold more than one."""
    rows = rows.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")
    rows = scratch.table(rows, "placed")
    several = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("key", "c")
    return attached(rows, scratch.table(several, "several"), ["key"], F.col("id"), "left_semi")
