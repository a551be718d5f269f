"""Averaged hashed subword embeddings under a linear softmax, trained by stochastic gradient descent in numpy.

A text is the mean of the embeddings of its hashed features; a linear layer and a softmax follow. Since the mean is
linear, a trained model folds into one row of logits per bucket, and scoring is a gather and a sum per text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from sluice.llm.batches import chunks

CLASSES = 200  #: labels that are learned, the most frequent ones
_M1, _M2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)


def _letters_only() -> bytes:
    """Byte map for language: A-Z lower-cased, other ASCII that isn't a letter becomes the word boundary (a space)."""
    table = bytearray(range(256))
    for b in range(128):
        c = chr(b)
        table[b] = ord(c.lower()) if c.isalpha() else 32
    return bytes(table)


LETTERS = _letters_only()


@dataclass(frozen=True)
class Features:
    """What is hashed. ``orders``: n-grams of bytes or, with ``chars``, of characters, that don't reach over a word boundary; ``words``: word n-grams up to this many words."""

    bits: int
    orders: tuple[int, ...]
    words: int = 0
    letters: bool = False
    chars: bool = False

    @property
    def buckets(self) -> int:
        return 1 << self.bits

    def of(self, texts: list[bytes]):
        """Yield (index of the bucket, first feature of each text) for each kind; each text has a feature of each kind (a dummy, index ``buckets``, where it has none)."""
        prepared = [t.translate(LETTERS) for t in texts] if self.letters else texts
        if self.chars:
            prepared = [t.decode(errors="replace") for t in prepared]
            raw = np.frombuffer((" " + " ".join(prepared) + " " * max((1, *self.orders))).encode("utf-32-le"), np.uint32)
        else:
            raw = np.frombuffer(b" " + b" ".join(prepared) + b" " * max((1, *self.orders)), np.uint8)
        lengths = np.fromiter(map(len, prepared), np.int64, len(prepared)) + 1
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        n = int(lengths.sum())
        wide = raw.astype(np.uint32)
        space = (raw == 32) | ((raw >= 9) & (raw <= 13))
        hashed, inner = wide[:n].copy(), np.zeros(n, bool)
        for order in range(2, max((1, *self.orders)) + 1):
            if order > 2:
                inner |= space[order - 2 : order - 2 + n]
            hashed *= _M1
            hashed += wide[order - 1 : order - 1 + n]
            if order in self.orders:
                mixed = (hashed ^ (hashed >> np.uint32(15))) * _M2
                index = (mixed >> np.uint32(32 - self.bits)).astype(np.int32)
                index[inner | (space[:n] & space[order - 1 : order - 1 + n])] = self.buckets
                yield index, starts
        if self.words:
            split = [t.split() or [b""] for t in texts]
            counts = np.fromiter(map(len, split), np.int64, len(split))
            first = np.concatenate(([0], np.cumsum(counts)[:-1]))
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for ws in split for w in ws), np.uint64, int(counts.sum()))
            gram = hashes.copy()
            for k in range(1, self.words + 1):
                if k > 1:
                    gram = gram * np.uint64(0x9E3779B97F4A7C15)
                    gram[: len(gram) - k + 1] += hashes[k - 1 :]
                    gram[:-1][hashes[1:] == hashes[:-1]] = k  # any word said again at once is the same feature
                index = (((gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.bits)).astype(np.int32)
                if k > 1:
                    ends = np.repeat(first + counts, counts)
                    index[np.arange(len(index)) + k > ends] = self.buckets
                yield index, first

    def counted(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per text the distinct buckets and their share of its features."""
        ids, shares = [], []
        for t in texts:
            found = np.concatenate([i for i, _ in self.of([t])])
            found, n = np.unique(found[found < self.buckets], return_counts=True)
            ids.append(found)
            shares.append((n / max(1, n.sum())).astype(np.float32))
        return ids, shares


@dataclass
class Model:
    """``logits``: per bucket (and an empty last row) the class logits of that feature."""

    features: Features
    classes: list
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    offset: np.ndarray | float = 0.0
    report: dict = field(default_factory=dict)

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty((len(texts), len(self.classes)))
        for a, b in chunks(texts):
            total, n = np.zeros((b - a, len(self.classes))), np.zeros(b - a)
            for index, starts in self.features.of(texts[a:b]):
                n += np.add.reduceat((index < self.features.buckets).astype(np.int64), starts)
                for c in range(len(self.classes)):
                    total[:, c] += np.add.reduceat(self.logits[c].take(index), starts, dtype=np.float64)
            out[a:b] = softmax((total / np.maximum(n, 1)[:, None] + self.bias) / self.temperature + self.offset)
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(features: Features, texts: list[bytes], labels: list, *, dim: int = 8, epochs: int = 6, rate: float = 30.0, batch: int = 32, seed: int = 7, held: float = 0.2, max_error: float = 0.01, priors: dict | None = None) -> Model:
    """Fit on (text, label) rows. A share ``held`` of them is kept from the gradient and gives the temperature (least log loss) and the
    rejection threshold: the least confidence above which at most ``max_error`` of those rows are wrong. ``priors``: how often each label occurs; the sample is balanced, so their odds are put back after the temperature.

    Rows are put in the order of their text and label first, so the result doesn't depend on the order in which they arrived.
    """
    order = sorted(range(len(texts)), key=lambda i: (xxhash.xxh3_64_intdigest(texts[i]), str(labels[i])))
    texts, labels = [texts[i] for i in order], [labels[i] for i in order]
    classes = sorted(set(labels), key=str)
    y = np.array([classes.index(v) for v in labels], np.int64)
    rng = np.random.default_rng(seed)
    ids, shares = features.counted(texts)
    n, c = len(texts), len(classes)
    embed = rng.uniform(-1 / dim, 1 / dim, (features.buckets, dim)).astype(np.float32)
    out, bias = np.zeros((dim, c), np.float32), np.zeros(c, np.float32)
    test = np.zeros(n, bool)
    if n >= 50:
        test[rng.permutation(n)[: int(held * n)]] = True
    fit = np.flatnonzero(~test)
    weight = np.ones(c, np.float32)
    if len(fit):
        weight = (len(fit) / (c * np.maximum(1, np.bincount(y[fit], minlength=c)))).astype(np.float32)

    def rows(which) -> np.ndarray:
        x = np.zeros((len(which), features.buckets), np.float32)
        for r, i in enumerate(which):
            x[r, ids[i]] = shares[i]
        return x

    steps, done = epochs * max(1, -(-len(fit) // batch)), 0
    for _ in range(epochs if c > 1 else 0):
        for k in range(0, len(fit), batch):
            which = fit[k : k + batch] if k else (fit := rng.permutation(fit))[:batch]
            lr = rate * (1 - done / steps)
            done += 1
            x = rows(which)
            hidden = x @ embed
            error = softmax(hidden @ out + bias)
            error[np.arange(len(which)), y[which]] -= 1
            error *= weight[y[which]][:, None] / len(which)
            back = error @ out.T
            out -= lr * 0.1 * (hidden.T @ error)
            bias -= lr * 0.01 * error.sum(axis=0)
            used = np.unique(np.concatenate([ids[i] for i in which]))
            embed[used] -= lr * (x[:, used].T @ back)
    logits = np.zeros((c, features.buckets + 1), np.float32)
    logits[:, :-1] = (embed @ out).T
    model = Model(features, classes, logits, bias.astype(np.float64))
    held_rows = np.flatnonzero(test) if test.any() else fit
    if len(held_rows) and c > 1:
        z = np.concatenate([rows(held_rows[k : k + batch]) @ logits[:, :-1].T for k in range(0, len(held_rows), batch)]) + bias
        truth = y[held_rows]
        loss = lambda t: -np.log(softmax(z / t)[np.arange(len(truth)), truth] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.05, 5, 41), key=loss))
        p = softmax(z / model.temperature)
        best, right = p.max(axis=1), p.argmax(axis=1) == truth
        by = np.argsort(-best, kind="stable")
        wrong = np.cumsum(~right[by]) / np.arange(1, len(by) + 1)
        ok = np.flatnonzero(wrong <= max_error)
        model.threshold = float(best[by][ok[-1]]) if len(ok) else 1.0
        model.report = {"rows": n, "held": len(held_rows), "accuracy": float(right.mean()), "covered": float((best >= model.threshold).mean())}
    if priors:
        model.offset = np.log(np.array([max(1, priors.get(k, 1)) for k in classes]) / max(1, sum(priors.values())))
    return model


def bounded_sample(df: DataFrame, label: Column, text: Column, key: Column, per_class: int, max_chars: int) -> list[tuple]:
    """About ``per_class`` (text, label) rows for each label, chosen by a hash of ``key`` and text.

    The bound: at most about ``per_class`` rows for each of the ``CLASSES`` most frequent labels, of texts with at most ``max_chars`` characters, and never more than four
    times as many (where equal rows are drawn together). Class sizes are counted over all rows first, then one scan keeps each row whose hash falls under its class's share.
    """
    rows = df.select(label.alias("label"), text.alias("text"), F.pmod(F.xxhash64(key.cast("string"), text, F.lit("sample")), F.lit(1 << 30)).alias("h"))
    rows = rows.where("label is not null and text is not null").where(F.length("text") <= max_chars)
    counts = df.where(label.isNotNull()).groupBy(label.alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(CLASSES)
    sizes = {r["label"]: r["n"] for r in counts.collect()}
    if not sizes:
        return []
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1 << 30, int((1 << 30) * per_class / n) + 1)))])
    drawn = rows.where(F.col("h") < share[F.col("label")]).select("text", "label").limit(4 * per_class * len(sizes))
    return [(r["text"].encode(), r["label"]) for r in drawn.collect()]
