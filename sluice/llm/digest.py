"""Improbable-feature digests.

A feature is a window of ``WINDOW`` bytes. Its entropy falls into one of ``CLASSES`` classes; how rarely a class occurs over the whole corpus ranks it (rare
first). The leftmost rarest of each run of ``RUN`` features gets a vote, features with ``VOTES`` votes are selected (all with a vote, where those would be fewer than ``FEW``), and their hashes go into
chained Bloom filters of ``BITS`` bits with ``HASHES`` positions each and at most ``FILL`` features a filter. Likeness of two digests: each filter of the
shorter chain against its best match in the other, by the bits in common between what chance gives and what the smaller filter allows.

Defined cases: null text counts as empty; an empty text has an empty chain, alike (1) to another empty one and unlike (0) to any other; a text
shorter than a window is padded with zero bytes; equal texts have equal digests; texts without any usable feature keep the plain ones; rows with one doc_id
follow each other in the order of their texts, and null doc_ids come first; an empty table gives an empty table; other columns are ignored; bytes that aren't UTF-8 count as
U+FFFD in edited texts; a very long text is read in parts and has a long chain.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sluice.llm.batches import chunks, texts_of

WINDOW, RUN, VOTES, FEW = 32, 64, 16, 16
BITS, HASHES, FILL = 2048, 5, 160
CLASSES, LEAST_CLASS = 1000, 150  #: classes below are too plain (runs of one character) to tell texts apart
MARGIN = 0.2
ROWS = 100_000  #: documents a partition
_PART = 1 << 19
_GAP = b"\0" * max(0, RUN - WINDOW)
_COUNTS = np.arange(WINDOW + 1)
_WEIGHT = np.rint(np.where(_COUNTS > 0, _COUNTS * np.log2(np.maximum(_COUNTS, 1)), 0) * 65536).astype(np.int64)
_STEP = np.diff(_WEIGHT, prepend=0)
_MOST = int(_WEIGHT[WINDOW])
_C = np.random.default_rng(5).integers(0, 1 << 63, 8, np.uint64) * np.uint64(2) + np.uint64(1)


def entropy_classes(raw: np.ndarray) -> np.ndarray:
    """The class of the window at each place of ``raw`` (len(raw) >= WINDOW), in whole numbers: 0 (one byte value) to CLASSES.

    A step to the right changes the sum over byte counts by what the byte that leaves and the byte that enters contribute; their counts in
    the window come from places sorted by byte value.
    """
    n = len(raw)
    order = np.argsort(raw, kind="stable")
    key = raw[order].astype(np.int64) * (n + 2 * WINDOW) + order
    place = np.arange(n)
    ahead, behind = np.empty(n, np.int64), np.empty(n, np.int64)
    ahead[order] = np.searchsorted(key, key + WINDOW) - place
    behind[order] = place - np.searchsorted(key, key - WINDOW, "right") + 1
    total = np.empty(n - WINDOW + 1, np.int64)
    total[0] = _WEIGHT[np.bincount(raw[:WINDOW])].sum()
    np.cumsum(_STEP[behind[WINDOW:]] - _STEP[ahead[: n - WINDOW]], out=total[1:])
    total[1:] += total[0]
    return (_MOST - total) * CLASSES // _MOST


def _padded(texts: list[bytes]) -> list[bytes]:
    return [t if len(t) >= WINDOW else t.ljust(WINDOW, b"\0") for t in texts]


def _parts(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes], int, int | None]]:
    """(indices, bytes, place in the text, features that count or None for all) of bounded size; a long text comes in overlapping parts."""
    for a, b in chunks(texts, _PART):
        if b - a > 1 or len(texts[a]) <= 2 * _PART:
            yield list(range(a, b)), texts[a:b], 0, None
        else:
            t = texts[a]
            for at in range(0, len(t) - WINDOW + 1, _PART):
                yield [a], [t[at : at + _PART + RUN + WINDOW - 2]], at, _PART


def class_counts(texts: list[bytes]) -> np.ndarray:
    """How often each class occurs over the windows of the texts."""
    out = np.zeros(CLASSES + 1, np.int64)
    for _, part, _, limit in _parts(_padded([t for t in texts if t])):
        lengths = np.array([len(t) for t in part])
        classes = entropy_classes(np.frombuffer(b"".join(part), np.uint8))
        ok = np.ones(len(classes), bool)
        ends = np.cumsum(lengths)[:-1]
        for k in range(1, WINDOW):
            ok[ends - k] = False
        out += np.bincount(classes[ok][:limit], minlength=CLASSES + 1)
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each class: the rarer, the lower; classes that are too plain come last."""
    rank = np.empty(CLASSES + 1, np.int64)
    rank[np.lexsort((np.arange(CLASSES + 1), counts))] = np.arange(CLASSES + 1)
    rank[:LEAST_CLASS] = CLASSES + 1
    return rank


def features(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """Hashes of the selected features of each (non-empty) text, in order, each once."""
    texts = _padded(texts)
    votes: list[list] = [[] for _ in texts]
    for which, part, at, limit in _parts(texts):
        raw = np.frombuffer(b"".join([t + _GAP for t in part]), np.uint8)
        starts = np.concatenate(([0], np.cumsum([len(t) + len(_GAP) for t in part])))
        key = np.full(len(raw) + RUN, np.iinfo(np.int64).max)
        n = len(raw) - WINDOW + 1
        key[:n] = rank[entropy_classes(raw)] << 32 | np.arange(n)
        for k in range(1, WINDOW + len(_GAP)):
            key[starts[1:] - k] = np.iinfo(np.int64).max
        best, width = key, 1
        while width < RUN:
            best = np.minimum(best[:-width], best[width:])
            width *= 2
        best = best[: len(raw)]
        # Runs that start at a usable feature; a run at a text's end is shorter, and RUN - 1 unusable places keep it from the next text.
        found = best[key[: len(raw)] < np.iinfo(np.int64).max][:limit]
        first = np.flatnonzero(np.diff(found, prepend=-1))
        count = np.diff(np.append(first, len(found)))
        place, plain = found[first] & 0xFFFFFFFF, found[first] >> 32 > CLASSES
        hashed = _feature_hash(raw, place)
        owner = np.searchsorted(starts, place, "right") - 1
        cuts = np.searchsorted(owner, np.arange(len(part) + 1))
        for k, i in enumerate(which):
            s = slice(cuts[k], cuts[k + 1])
            votes[i].append((place[s] - starts[k] + at, count[s], plain[s], hashed[s]))
    out = []
    for v in votes:
        place, count, plain, hashed = v[0] if len(v) == 1 else map(np.concatenate, zip(*v, strict=True))
        if len(v) > 1:  # votes for a feature near a border may come from both sides
            place, back = np.unique(place, return_inverse=True)
            first = np.full(len(place), len(back))
            np.minimum.at(first, back, np.arange(len(back)))
            count, plain, hashed = np.bincount(back, count).astype(np.int64), plain[first], hashed[first]
        if not plain.all():
            count, hashed = count[~plain], hashed[~plain]
        chosen = hashed[count >= VOTES] if (count >= VOTES).sum() >= FEW else hashed
        _, first = np.unique(chosen, return_index=True)
        out.append(chosen[np.sort(first)])
    return out


def _feature_hash(raw: np.ndarray, place: np.ndarray) -> np.ndarray:
    words = np.lib.stride_tricks.sliding_window_view(raw, WINDOW)[place].view("<u8")
    h = np.zeros(len(place), np.uint64)
    for k in range(WINDOW // 8):
        h = (h ^ words[:, k]) * _C[k]
        h ^= h >> np.uint64(29)
    return h * np.uint64(0x9E3779B97F4A7C15)


class Digest:
    """A chain of filters (n, BITS / 8) with the number of features in each."""

    __slots__ = ("filters", "sizes")

    def __init__(self, filters: np.ndarray, sizes: np.ndarray):
        self.filters, self.sizes = filters, sizes

    def __str__(self) -> str:
        return f"ifd1:{len(self.sizes)}:" + base64.b64encode(struct.pack(f"<{len(self.sizes)}H", *self.sizes.tolist()) + self.filters.tobytes()).decode()

    @classmethod
    def parse(cls, text: str) -> Digest:
        _, n, data = text.split(":")
        raw = base64.b64decode(data)
        return cls(np.frombuffer(raw, np.uint8, -1, 2 * int(n)).reshape(int(n), BITS // 8), np.frombuffer(raw, "<u2", int(n)).astype(np.int64))


def digests(texts: list[bytes], rank: np.ndarray) -> list[Digest]:
    out = [Digest(np.zeros((0, BITS // 8), np.uint8), np.zeros(0, np.int64))] * len(texts)
    some = [i for i, t in enumerate(texts) if t]
    for i, h in zip(some, features([texts[i] for i in some], rank) if some else [], strict=True):
        n = -(-len(h) // FILL)
        bits = np.zeros(n * BITS, np.uint8)
        base = np.arange(len(h)) // FILL * BITS
        for k in range(HASHES):
            bits[base + (h >> np.uint64(53 - 11 * k) & np.uint64(BITS - 1)).astype(np.int64)] = 1
        out[i] = Digest(np.packbits(bits).reshape(n, BITS // 8), np.bincount(np.arange(len(h)) // FILL, minlength=n))
    return out


def likeness(a: Digest, b: Digest) -> float:
    if not len(a.sizes) or not len(b.sizes):
        return float(len(a.sizes) == len(b.sizes))
    if (len(a.sizes), a.sizes.sum()) > (len(b.sizes), b.sizes.sum()):
        a, b = b, a
    ones = lambda d: np.bitwise_count(d.filters).sum(axis=1, dtype=np.float64)
    na, nb = ones(a)[:, None], ones(b)[None, :]
    best = np.empty(len(a.sizes))
    for k in range(0, len(best), 64):
        if len(b.sizes) == 1 == len(a.sizes):
            common = np.bitwise_count(a.filters & b.filters).sum(axis=1, dtype=np.float64)[:, None]
        else:
            common = np.unpackbits(a.filters[k : k + 64], axis=1).astype(np.float32) @ np.unpackbits(b.filters, axis=1).astype(np.float32).T
        n = na[k : k + 64]
        most, chance = np.minimum(n, nb), n * nb / BITS
        floor = chance + MARGIN * (most - chance)
        best[k : k + 64] = np.clip((common - floor) / np.maximum(most - floor, 1e-9), 0, 1).max(axis=1)
    return float((best * a.sizes).sum() / a.sizes.sum())


def fit_ranks(df: DataFrame, text: str = "text") -> np.ndarray:
    """Ranks from the class counts of all windows of all texts; each task sends one row a class."""

    def run(it):
        total = np.zeros(CLASSES + 1, np.int64)
        for batch in it:
            total += class_counts(texts_of(batch.column(0)))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["class", "n"])

    counts = np.zeros(CLASSES + 1, np.int64)
    for r in df.select(text).mapInArrow(run, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        counts[r["class"]] = r["n"]
    return ranks(counts)


def with_next(df: DataFrame, *, text: str, key: str) -> DataFrame:
    """(bucket, guest, doc_id, text) rows, ranged by doc_id and sorted, so that the row before a row is the next one in descending order.

    Buckets are ranges between approximate quantiles that are ids of the table. A row whose id ends a bucket is also sent, as a guest, to the following
    bucket (from the last to the first), where it comes before all others. Ids that are null come first; equal ids are in the order of their texts.
    """
    spark = df.sparkSession
    least = -(1 << 63)
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    k = F.coalesce(F.col("doc_id"), F.lit(least))
    n, top = rows.select(k.alias("k")).agg(F.count("*"), F.max("k")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // ROWS)
    bounds = rows.select(k.alias("k")).agg(F.percentile_approx("k", [i / parts for i in range(1, parts)] or [1.0], max(10_000, 4 * parts))).first()[0] if n else []
    bounds = np.array(sorted({*(bounds or []), *([top] if n else [])}), np.int64)

    @F.pandas_udf("struct<b:int,g:int>")
    def bucket(ids: pd.Series) -> pd.DataFrame:
        ids = ids.to_numpy(np.int64)
        b = np.minimum(np.searchsorted(bounds, ids), len(bounds) - 1)
        return pd.DataFrame({"b": b.astype(np.int32), "g": np.where(bounds[b] == ids, (b + 1) % len(bounds), -1).astype(np.int32)})

    placed = rows.withColumn("k", k).withColumn("at", bucket("k"))
    home = F.struct(F.col("at.b").alias("bucket"), F.lit(0).alias("own"))
    away = F.struct(F.col("at.g").alias("bucket"), F.lit(-1).alias("own"))
    each = placed.select("doc_id", "text", "k", F.explode(F.when(F.col("at.g") >= 0, F.array(home, away)).otherwise(F.array(home))).alias("x"))
    each = each.select(F.col("x.bucket").alias("bucket"), (F.col("x.own") < 0).alias("guest"), "doc_id", "text", "k")
    return each.repartitionById(max(1, len(bounds)), "bucket").sortWithinPartitions("bucket", F.desc("guest"), "k", "text").select("bucket", "guest", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """The last third (rounded down) replaced by as many characters from the start of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def neighbour_digests(df: DataFrame, *, text: str = "text", key: str = "doc_id", rank: np.ndarray | None = None) -> DataFrame:
    """Digest of every text and of its edited text, with their likeness and that to the next document's digest.

    ``rank``: ranks to use, as ``fit_ranks`` gives them. Digests can be compared if their ranks were the same, so keep those of the first corpus for later ones; by default they
    are fitted on this one.
    """
    import hashlib

    rank = df.sparkSession.sparkContext.broadcast(fit_ranks(df, text) if rank is None else rank)

    def run(it):
        bucket, text, digest = None, "", None
        for batch in it:
            buckets, guests = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            raw = texts_of(batch.column(3))
            own = digests(raw, rank.value)
            texts = [t.decode(errors="replace") for t in raw]
            before = [(text, digest) if buckets[0] == bucket else ("", None)] + [(texts[i], own[i]) if buckets[i] == buckets[i + 1] else ("", None) for i in range(len(raw) - 1)]
            some = [i for i, g in enumerate(guests) if not g]
            changed = [edited(texts[i], before[i][0]).encode() for i in some]
            theirs = digests(changed, rank.value)
            bucket, text, digest = buckets[-1], texts[-1], own[-1]
            arrays = [
                batch.column(2).take(pa.array(some, pa.int64())),
                pa.array([len(texts[i]) for i in some], pa.int64()),
                pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()),
                pa.array([str(own[i]) for i in some], pa.string()),
                pa.array([str(d) for d in theirs], pa.string()),
                pa.array([likeness(own[i], d) for i, d in zip(some, theirs, strict=True)], pa.float64()),
                pa.array([likeness(own[i], before[i][1]) if before[i][1] is not None else 0.0 for i in some], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(df, text=text, key=key).mapInArrow(run, schema)
