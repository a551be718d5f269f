"""Language identification: averaged hashed subword embeddings, linear softmax, calibrated rejection.

Defined cases: null text or text without a letter gives ``und`` with score 0 and isn't accepted; an empty table gives an empty table;
without any labelled row every text is ``und``; repeated rows each get the same answer; of languages with equal scores the first in order wins; other columns are
ignored, and a kept one named like a result is replaced by it; bytes that aren't UTF-8 count as U+FFFD; a very long text is read whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sluice.llm.batches import map_batches, texts_of
from sluice.llm.subword import Features, Model, bounded_sample, train

FEATURES = Features(bits=15, orders=(2, 3, 4), letters=True)
PER_LANGUAGE, MAX_CHARS = 600, 20_000


def fit(df: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", where: Column | None = None) -> Model | None:
    """Learn from a sample of at most about 600 rows a language with up to 20,000 characters each."""
    df = df.where(where) if where is not None else df
    rows = bounded_sample(df, F.col(lang), F.col(text), F.col(key), PER_LANGUAGE, MAX_CHARS)
    return train(FEATURES, [t for t, _ in rows], [y for _, y in rows]) if rows else None


def has_letter(raw: bytes) -> bool:
    return raw.upper() != raw.lower() or any(map(str.isalpha, raw.decode(errors="replace")))


def predict(df: DataFrame, model: Model | None, *, text: str = "text", keep: list[str]) -> DataFrame:
    """``keep`` columns plus lang_pred, score (the calibrated probability) and accepted (score at or above the rejection threshold)."""
    keep = [c for c in keep if c.lower() not in ("lang_pred", "score", "accepted")]
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, raw = shared.value, texts_of(batch.column(batch.num_columns - 1))
        lang, score = ["und"] * len(raw), [0.0] * len(raw)
        some = [i for i, t in enumerate(raw) if has_letter(t)] if m else []
        if some:
            p = m.probabilities([raw[i] for i in some])
            for i, k, v in zip(some, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                lang[i], score[i] = m.classes[k], v
        accepted = [x != "und" and v >= m.threshold for x, v in zip(lang, score, strict=True)]
        more = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=[*keep, "lang_pred", "score", "accepted"])

    rows = df.select(*keep, F.col(text).alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    return map_batches(rows, run, f"{fields}, lang_pred string, score double, accepted boolean")
