"""Quality classifier: hashed word and character n-gram vectors averaged per document, softmax, numpy stochastic gradient descent.

Defined cases: null text counts as empty; an empty text gets the model's prior; without labelled rows every score is 0.5; labels that are
null are not learned from; repeated rows get the same score; an empty table gives an empty table; other columns are ignored, and a kept one named like the score is
replaced by it; bytes that aren't UTF-8 count as U+FFFD; a very long text is scored whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sluice.llm.batches import map_batches, texts_of
from sluice.llm.subword import Features, Model, train

FEATURES = Features(bits=15, orders=(2, 3), words=2, chars=True)
PER_LABEL, MAX_CHARS = 1500, 20_000


def fit(df: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "quality", where: Column | None = None) -> Model | None:
    """Learn from a sample of at most about 1,500 rows a label with up to 20,000 characters each; ``labels`` holds key and label. The ids to learn from are drawn from the labels alone,
    so no text is shuffled."""
    marked = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label")).where("__label in (0, 1) and __key is not null")
    docs = df.select(F.col(key).alias("__id"), F.col(text).alias("__text"))
    docs = docs.where(where) if where is not None else docs
    sizes = {r["__label"]: r["n"] for r in marked.groupBy("__label").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    chance = F.pmod(F.xxhash64(F.col("__key").cast("string"), F.lit("label")), F.lit(1 << 30))
    share = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1 << 30, int((1 << 30) * PER_LABEL / n) + 1)))])
    # About PER_LABEL ids a label and so never more than a few thousand rows: small enough to broadcast at any size of the tables.
    few = F.broadcast(marked.where(chance < share[F.col("__label")]))
    rows = docs.join(few, F.col("__id") == F.col("__key")).where(F.length("__text") <= MAX_CHARS).select("__text", "__label").limit(8 * PER_LABEL).collect()  # the limit only binds where rows share an id
    return train(FEATURES, [t.encode() for t, _ in rows], [y for _, y in rows], rate=60, dim=12, epochs=8, priors=sizes) if rows else None


def score(df: DataFrame, model: Model | None, *, text: str = "text", keep: list[str], name: str = "score") -> DataFrame:
    """``keep`` columns plus ``name``: the probability of label 1."""
    keep = [c for c in keep if c.lower() != name.lower()]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, raw = shared.value, texts_of(batch.column(batch.num_columns - 1))
        if m is None:
            p = [0.5] * len(raw)
        elif 1 not in m.classes:
            p = [0.0] * len(raw)
        else:
            p = m.probabilities(raw)[:, m.classes.index(1)].tolist()
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64())], names=[*keep, name])

    rows = df.select(*keep, F.col(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return map_batches(rows, run, f"{fields}, `{name}` double")
