"""Packing documents into sequences by non-negative least squares over length combinations.

A document is cut every ``WINDOW`` tokens; full pieces are sequences of their own and the remainders are packed. Their lengths are counted in classes of
``STEP`` tokens; all combinations of at most three classes that fill the window exactly are columns, and the repeat counts solve
min |A x - h|, x >= 0 against the histogram h. The counts are rounded within what is there, and what is left is packed greedily, largest first.
Remainders for which even the best greedy sequence leaves more than ``SLACK`` tokens are cut at powers of two; such pieces fill
sequences exactly, so no length distribution (say a third of all rows of one length) leads to padding.

Only the histogram (1,024 counts) is solved on the driver. The plan is a table of rank intervals per length, whose size depends on the window alone;
a piece's rank within its length is its rank in the written part plus the part's prefix sum, so no task holds all pieces of a length.

Defined cases: null text is empty and gives one piece with the final id; a null doc_id is carried; repeated rows are packed one by one; an
empty table gives no pieces; other columns are ignored; bytes that aren't UTF-8 count as U+FFFD; a very long text has as many full pieces as it takes.
"""

from __future__ import annotations

import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from sluice.llm.batches import texts_of
from sluice.llm.scratch import Scratch

WINDOW, STEP, SLACK, FINAL_ID = 1024, 4, 8, 0
LONG_RUN = 50_000
# The characters that are white space to the tokenizer's pattern.
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LONG_RUN = re.compile(f"[{_SPACES}]{{{LONG_RUN},}}")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.lru_cache(maxsize=2)
def byte_level_encoder(path: str):
    """Text -> buffer of unsigned 32-bit ids, for a byte-level BPE in the tokenizers library's JSON format.

    tiktoken runs the file's vocabulary: a merge's rank there is the id of what it makes. As in that library, a text is first split at the contents
    of the added tokens (of those that begin at one place the longest); they get their ids, and only what lies between is encoded. A run of
    ``LONG_RUN`` or more white-space characters would exceed the pattern's stack: all of it but what the pattern leaves to the following word is one piece and is merged as such.
    """
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file; the others follow from 256 on
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if odd := [t["content"] for t in spec["added_tokens"] if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]:
        raise ValueError(f"added tokens with single_word, lstrip or rstrip aren't handled: {odd}")
    ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in spec["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    core = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
    pattern_ids = lambda text: np.frombuffer(core.encode_to_tiktoken_buffer(text, set()), np.uint32)

    def plain_ids(text: str) -> np.ndarray:
        runs = list(_LONG_RUN.finditer(text)) if len(text) >= LONG_RUN else []
        if not runs:
            return pattern_ids(text)
        out, at = [], 0
        for m in runs:
            end = m.end() if m.end() == len(text) else m.end() - 1  # the last one of a run belongs to what follows
            out += [pattern_ids(text[at : m.start()]), np.array(core.encode_single_piece(m[0][: end - m.start()].encode()), np.uint32)]
            at = end
        return np.concatenate([*out, pattern_ids(text[at:])])

    if not special:
        return plain_ids
    added = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")

    def encode(text: str) -> np.ndarray:
        found = added.split(text)
        if len(found) == 1:
            return plain_ids(text)
        return np.concatenate([np.array([special[x]], np.uint32) if k % 2 else plain_ids(x) for k, x in enumerate(found)])

    return encode


def binary_parts(n: int) -> list[int]:
    return [1 << k for k in reversed(range(n.bit_length())) if n >> k & 1]


def cut(df: DataFrame, tokenizer: str, text: str, key: str) -> DataFrame:
    """Tokenize and cut: per document the checksums of its full pieces, of its remainder, and of the remainder's power-of-two parts, with ranks within the part."""

    def run(it):
        encode, part = byte_level_encoder(tokenizer), TaskContext.get().partitionId()
        full_before, same = 0, np.zeros(WINDOW, np.int64)
        for batch in it:
            out: list[list] = [[] for _ in range(7)]
            for raw in texts_of(batch.column(1)):
                ids = np.append(encode(raw.decode(errors="replace")), np.uint32(FINAL_ID)).astype("<u4")
                view = memoryview(ids).cast("B")
                n, r = len(ids), len(ids) % WINDOW
                at, parts = n - r, []
                for size in binary_parts(r):
                    parts.append(zlib.crc32(view[4 * at : 4 * (at + size)]))
                    at += size
                fulls = [zlib.crc32(view[4 * a : 4 * (a + WINDOW)]) for a in range(0, n - r, WINDOW)]
                for column, value in zip(out, (n, fulls, r, zlib.crc32(view[4 * (n - r) :]), parts, full_before, int(same[r])), strict=True):
                    column.append(value)
                full_before += len(fulls)
                same[r] += 1
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
            arrays = [batch.column(0), *[pa.array(v, k) for v, k in zip(out, kinds, strict=True)], pa.array([part] * batch.num_rows, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "doc_tokens", "fulls", "r", "crc", "parts", "full_before", "same_before", "part"])

    schema = "doc_id long, doc_tokens long, fulls array<long>, r long, crc long, parts array<long>, full_before long, same_before long, part long"
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, schema)


def nnls(rows: np.ndarray, b: np.ndarray, steps: int = 1000) -> np.ndarray:
    """Least squares with x >= 0 by the active-set method of Lawson and Hanson.

    Column j of the matrix has a one for each entry of ``rows[j]`` that is below len(b) (a row named twice counts two). The normal equations of
    the active columns are kept up to date, so a step costs one solve of at most len(b) unknowns.
    """
    x, active = np.zeros(len(rows)), []
    columns, gram = np.zeros((0, len(b))), np.zeros((0, 0))
    residual = np.append(b, 0.0)
    tolerance = 1e-7 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(steps):
        gradient = residual[rows].sum(axis=1)
        gradient[active] = -np.inf
        j = int(gradient.argmax())
        if gradient[j] <= tolerance:
            break
        new = np.bincount(rows[j], minlength=len(b) + 1)[: len(b)].astype(float)
        cross = columns @ new
        gram = np.block([[gram, cross[:, None]], [cross[None, :], np.array([[new @ new]])]])
        columns, active = np.vstack([columns, new]), [*active, j]
        while active:
            z = np.linalg.solve(gram + 1e-9 * np.eye(len(active)), columns @ b)
            if (z > 0).all():
                x[active] = z
                break
            old, low = x[active], z <= 0
            step = np.min(old[low] / np.maximum(old[low] - z[low], 1e-300))
            x[active] = old + step * (z - old)
            gone = (x[active] <= 1e-12) & low
            if not gone.any():
                gone[int(z.argmin())] = True
            x[[k for k, g in zip(active, gone, strict=True) if g]] = 0
            active = [k for k, g in zip(active, gone, strict=True) if not g]
            columns, gram = columns[~gone], gram[np.ix_(~gone, ~gone)]
        residual[:-1] = b - x[active] @ columns
    return x


def combinations(classes: int) -> list[tuple[int, ...]]:
    """All non-increasing tuples of at most three classes that add up to the window."""
    two = [(a, classes - a) for a in range(classes - 1, (classes - 1) // 2, -1)]
    three = [(a, b, classes - a - b) for a in range(classes - 2, 0, -1) for b in range(min(a, classes - a - 1), 0, -1) if classes - a - b <= b]
    return [(classes,), *two, *three]


def plan(histogram: dict[int, int], first: int) -> list[tuple[int, int, int, int, int, bool]]:
    """Rows (length, rank from, rank to, sequence of rank from, offset, binary). In a binary row the last two numbers place the length's power-of-two parts, see ``place``.

    ``first`` is the first free sequence id. A row's ranks take consecutive sequences at the same offset.
    """
    left = np.zeros(WINDOW + 1, np.int64)
    for r, n in histogram.items():
        left[r] = n
    used, rows, sequence = np.zeros(WINDOW + 1, np.int64), [], first
    classes = WINDOW // STEP
    counts = np.zeros(classes + 1)
    for r in range(1, WINDOW):
        counts[-(-r // STEP)] += left[r]

    def place(lengths: list[int], times: int) -> None:
        nonlocal sequence
        offset, own = 0, {}
        for n in lengths:
            rows.append((n, int(used[n]) + own.get(n, 0), int(used[n]) + own.get(n, 0) + times, sequence, offset, False))
            own[n] = own.get(n, 0) + times
            offset += n
        for n, k in own.items():
            used[n] += k
            left[n] -= k
        sequence += times

    if counts.sum():
        columns = combinations(classes)
        slots = np.array([[*c, *[classes + 1] * (3 - len(c))] for c in columns]) - 1
        x = np.floor(nnls(slots, counts[1:]) + 0.5).astype(np.int64)
        for j in sorted(np.flatnonzero(x).tolist(), key=lambda j: (-x[j], j)):
            todo = int(x[j])
            while todo > 0:
                # The lengths of the classes that are there now: the longest first. Each step uses up a length or the strategy.
                lengths, taken = [], {}
                for c in columns[j]:
                    n = next((n for n in range(c * STEP, (c - 1) * STEP, -1) if n < WINDOW and left[n] > taken.get(n, 0)), None)
                    if n is None:
                        break
                    taken[n] = taken.get(n, 0) + 1
                    lengths.append(n)
                if len(lengths) < len(columns[j]):
                    break
                times = min(todo, *[int(left[n]) // k for n, k in taken.items()])
                place(lengths, times)
                todo -= times
    cuts = {}
    while (there := np.flatnonzero(left[:WINDOW])).size:
        lengths, gap, taken = [], WINDOW, {}
        while gap:
            fits = there[(there <= gap)]
            n = next((int(n) for n in fits[::-1] if left[n] > taken.get(int(n), 0)), None)
            if n is None:
                break
            lengths.append(n)
            taken[n] = taken.get(n, 0) + 1
            gap -= n
        if gap <= SLACK:
            place(lengths, min(int(left[n]) // k for n, k in taken.items()))
        else:
            n = int(there[-1])
            cuts[n] = (int(used[n]), int(left[n]))
            left[n] = 0
    # The parts of a size are a block; blocks follow each other from the largest size down, so no part lies across a sequence's end.
    at = sequence * WINDOW
    for size in (1 << k for k in reversed(range(WINDOW.bit_length() - 1))):
        for n, (low, many) in sorted(cuts.items()):
            if n & size:
                rows.append((n, low, low + many, at, size, True))
                at += many * size
    return rows


def pack(df: DataFrame, *, tokenizer: str, text: str = "text", key: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = df.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    stored = scratch.table(cut(df, tokenizer, text, key), "pieces")
    counts = stored.groupBy("part", "r").agg(F.count("*").alias("n"), F.sum(F.size("fulls")).alias("f"))
    counts = counts.select("part", F.explode(F.array(F.struct("r", "n"), F.struct(F.lit(WINDOW).cast("long").alias("r"), F.col("f").alias("n")))).alias("x"))
    counts = counts.groupBy("part", "x.r").agg(F.sum("x.n").alias("n"))
    counts = scratch.table(counts, "counts")
    total = {x["r"]: x["n"] for x in counts.groupBy("r").agg(F.sum("n").alias("n")).collect()}  # at most 1,025 rows
    before = Window.partitionBy("r").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = scratch.table(counts.select("part", "r", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")

    # The prefix sums grow with the number of parts, so they are never broadcast; a key holds no more than what one task has written.
    full = stored.where(F.size("fulls") > 0).join(bases.where(F.col("r") == WINDOW).select("part", "base").hint("merge"), "part")
    full = full.select("doc_id", "doc_tokens", (F.col("base") + F.col("full_before")).alias("s"), F.posexplode("fulls").alias("i", "crc"))
    number = lambda c: F.col(c).cast("long")
    full = full.select("doc_id", (number("i") * WINDOW).alias("start"), F.lit(WINDOW).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", (F.col("s") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    rows = plan({r: n for r, n in total.items() if 0 < r < WINDOW}, total.get(WINDOW, 0) or 0)
    # The plan's size is bounded by the window: a few rows for each of 1,023 lengths and each combination in use.
    steps = F.broadcast(spark.createDataFrame(rows, "r long, lo long, hi long, at long, off long, binary boolean"))
    rest = stored.where("r > 0").select("doc_id", "doc_tokens", "r", "crc", "parts", "same_before", "part").join(bases.hint("merge"), ["part", "r"])
    rest = rest.withColumn("rank", F.col("base") + F.col("same_before")).join(steps, "r").where("rank >= lo and rank < hi")
    first = F.col("doc_tokens") - F.col("r")
    spot = F.col("at") + (F.col("rank") - F.col("lo")) * F.col("off")
    larger = F.col("r").bitwiseAND(F.lit(-2) * F.col("off"))  # the parts before this one
    whole = rest.where("not binary").select("doc_id", first.alias("start"), F.col("r").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", (F.col("at") + F.col("rank") - F.col("lo")).alias("sequence_id"), F.col("off").alias("offset"))
    parts = rest.where("binary").select("doc_id", (first + larger).alias("start"), F.col("off").alias("length"), F.get("parts", F.bit_count(larger)).alias("ids_crc32"), "doc_tokens", F.floor(spot / WINDOW).alias("sequence_id"), F.pmod(spot, F.lit(WINDOW)).cast("long").alias("offset"))
    return full.unionByName(whole).unionByName(parts)
