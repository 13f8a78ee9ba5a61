"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios.

Features are the counts of the byte n-grams (3 to 6; a letter beyond ASCII has two bytes or more) of the lowered
text, hashed into ``buckets``, over the square root of the number of its n-grams. Each bucket has the log ratio of its
smoothed shares of all n-grams of the toxic and of the clean training rows; those in under 3 rows, or with a ratio
under 1 either way, are left out. A logistic regression is then fitted on the features scaled by the ratios.

The model is fitted on a sample of labelled training rows that is bounded by ``max_rows`` and
``max_bytes`` (the rows with the smallest hash of their id). Scoring is one Arrow pass over all
rows without a shuffle; the model it carries has ``buckets`` numbers, whatever the input's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .wordhash import text_bytes

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32
#: A text's features are gathered in pieces of this many bytes.
_PIECE = 1 << 16
#: Longest and shortest n-gram, in bytes.
SIZES = (3, 4, 5, 6)


def _ngrams(text: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Bucket numbers of the n-grams of a text padded by a space on either side."""
    for i in range(0, len(text), _PIECE):
        left = [32] if i == 0 else []
        own = _LOWER[text[max(0, i - (SIZES[-1] - 1) * (i > 0)) : i + _PIECE]]
        own = np.concatenate([left, own, [32] if i + _PIECE >= len(text) else []]).astype(np.uint64)
        packed, seen = np.zeros(len(own), np.uint64), 0
        for n in SIZES:
            while seen < n:
                if len(own) > seen:
                    packed = (packed[: len(own) - seen] << np.uint64(8)) | own[seen:]
                seen += 1
            # The first places of a later piece repeat the end of the one before.
            own_n = packed[SIZES[-1] - n if i else 0 :]
            if len(own) >= n:
                yield ((own_n + np.uint64(n << 56)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def _counts(text: np.ndarray, bits: int) -> np.ndarray:
    """How often each bucket occurs."""
    out = np.zeros(1 << bits, np.int64)
    for own in _ngrams(text, bits):
        out += np.bincount(own, minlength=1 << bits)
    return out


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray  # one for each bucket, the log-count ratio already multiplied in
    bias: float
    bits: int

    def score(self, text: np.ndarray) -> float:
        total, n = 0.0, 0
        for own in _ngrams(text, self.bits):
            total += float(self.weights[own].sum(dtype=np.float64))
            n += len(own)
        z = self.bias + total / max(1, n) ** 0.5
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def fit(texts: list[str | None], labels: list[int], bits: int = 18, alpha: float = 1.0, l2: float = 1.0, steps: int = 150) -> ToxicityModel:
    """Fit on texts in memory. With no rows, or one class only, every score is the smoothed rate of label 1."""
    y = np.asarray(labels, np.float64)
    rate = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(rate / (1 - rate)))
    if len(set(labels)) < 2:
        return ToxicityModel(np.zeros(1 << bits, np.float32), prior, bits)
    raw = [np.frombuffer((t or "").encode(), np.uint8) for t in texts]
    hits, held, sizes = np.zeros((2, 1 << bits)), np.zeros(1 << bits, np.int32), np.zeros(len(y))
    for i, t in enumerate(raw):
        own = _counts(t, bits)
        hits[int(y[i])] += own
        held += own > 0
        sizes[i] = own.sum()
    shares = [(h + alpha) / (h.sum() + alpha * len(h)) for h in hits]
    ratio = np.log(shares[1] / shares[0])
    # Rare and neutral features count as ratio 0, and so leave every product.
    ratio[(held < 3) | (np.abs(ratio) < 1)] = 0
    rows, values = [], []
    for i, t in enumerate(raw):  # counted anew: all counts of all rows would be much
        own = _counts(t, bits)
        at = np.flatnonzero((own > 0) & (ratio != 0))
        rows.append(at.astype(np.int32))
        values.append((own[at] * ratio[at] / max(1.0, sizes[i]) ** 0.5).astype(np.float32))
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    flat, value = np.concatenate(rows), np.concatenate(values)
    del rows, values
    balance = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w, b, mw, vw, mb, vb = np.zeros(1 << bits), 0.0, np.zeros(1 << bits), np.zeros(1 << bits), 0.0, 0.0
    for step in range(1, steps + 1):  # Adam over the whole sample
        z = np.bincount(row, value * w[flat], len(y)) + b
        error = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) * balance / len(y)
        gw, gb = np.bincount(flat, value * error[row], 1 << bits) + l2 * w / len(y) / 100, error.sum()
        mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix = (1 - 0.99**step) ** 0.5 / (1 - 0.9**step)
        w -= 0.1 * fix * mw / (np.sqrt(vw) + 1e-9)
        b -= 0.1 * fix * mb / (vb**0.5 + 1e-9)
    return ToxicityModel((w * ratio).astype(np.float32), float(b), bits)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", holdout: int | None = None, max_rows: int = 4000, max_bytes: int = 12_000_000, max_text: int = 400_000, bits: int = 18) -> ToxicityModel:
    """Fit on at most ``max_rows`` rows and ``max_bytes`` bytes of the labelled rows of ``docs``.

    Rows are taken in the order of a hash of their id. ``holdout`` leaves out ids whose crc32 is
    0 modulo it. Ids or labels that are null, and texts over ``max_text`` bytes, are not trained on.
    A label's id may repeat; its largest label counts.
    """
    key = F.col(id_col).cast("string")
    lab = labels.select(F.col(id_col).alias("_mr_id"), F.col(label_col).alias("_mr_y")).dropna()
    lab = lab.groupBy("_mr_id").agg(F.max("_mr_y").alias("_mr_y"))
    rows = docs.select(F.col(id_col).alias("_mr_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_mr_t"), F.xxhash64(key).alias("_mr_h"), F.crc32(key.cast("binary")).alias("_mr_c"))
    if holdout:
        lab = lab.where(F.crc32(F.col("_mr_id").cast("string").cast("binary")) % holdout != 0)
    # The smallest hashes are picked from ids alone; only their texts move.
    picked = lab.withColumn("_mr_h", F.xxhash64(F.col("_mr_id").cast("string"))).orderBy("_mr_h", "_mr_id").limit(max_rows)
    picked = picked.select("_mr_id", "_mr_y")
    small = F.broadcast(picked)  # max_rows rows of two numbers
    got = rows.join(small, "_mr_id").where(F.octet_length("_mr_t") <= max_text)
    texts, ys, size = [], [], 0
    for r in got.orderBy("_mr_h", "_mr_id", "_mr_t").select("_mr_t", "_mr_y").limit(max_rows).toLocalIterator():
        size += len(r["_mr_t"].encode())
        if size > max_bytes:
            break
        texts.append(r["_mr_t"])
        ys.append(int(r["_mr_y"] != 0))
    return fit(texts, ys, bits)


def score(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", out_col: str = "toxicity", with_text: bool = True) -> DataFrame:
    """``docs`` with the model's score of every whole text in ``out_col`` (a column of that name is replaced).

    Null and empty texts get the score of a text without features. Other columns pass through, the
    text too unless ``with_text`` is false.
    """
    fields = [f for f in docs.schema.fields if f.name != out_col]
    names = [f.name for f in fields]
    kept = [i for i, n in enumerate(names) if with_text or n != text_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw, at = text_bytes(batch.column(names.index(text_col)))
            out = [m.score(raw[at[i] : at[i + 1]]) for i in range(len(at) - 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(out, pa.float64())], names=[*(names[i] for i in kept), out_col])

    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, StructType([*(fields[i] for i in kept), StructField(out_col, DoubleType())]))


def keep_clean(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, all columns as they are; nothing shuffles."""
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            raw, at = text_bytes(batch.column(names.index(text_col)))
            yield batch.filter(pa.array([m.score(raw[at[i] : at[i + 1]]) < threshold for i in range(len(at) - 1)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's score; ids whose crc32 is 0 modulo 5 are never trained on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), holdout=5)
    scored = score(docs, model, out_col="score", with_text=False)
    return scored.select(
        "doc_id",
        (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
