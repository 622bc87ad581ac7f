"""Language identification with string kernels.

The kernel of two texts is the blended-spectrum presence kernel: the number of distinct character n-grams
(lengths 1 to ``max_n``, hashed into ``buckets``) that both contain, divided by the root of the product of
their own counts. Nyström landmarks (training texts of every language) span a feature space
``z(x) = K_mm^(-1/2) k_m(x)``; one-versus-rest kernel ridge regression is solved there, and a batch of texts
is scored by matrix products: presence matrix x landmark matrix x regression matrix.

Training rows are bounded by ``per_language`` for each of the ``languages`` most frequent labels, the first by hash
of all allowed rows (documented bounds: the classifier alone is fitted on a sample; every text is classified). The
bounds are kept in Spark, also where rows share a doc_id, and a row leaves its executor as a bitmap of fixed
size: neither long texts nor many rows fill the driver.

Cases: null text or text without a letter is ``und`` with score 0; so is everything when no labelled text
is available. A null label or doc_id is never trained on; of rows that share doc_id and label one is. Ties go to the first label in sort order. Whole
texts are read; repeated rows are classified alike; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shared

_LETTER = regex.compile(r"\p{L}")
_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


@dataclass(frozen=True)
class Settings:
    max_n: int = 4
    buckets: int = 1 << 16
    per_language: int = 300
    languages: int = 1000
    landmarks: int = 40
    ridge: float = 0.05
    rows: int = 128


def presence(texts: list[str], settings: Settings) -> np.ndarray:
    """Rows of 0/1: which hashed n-grams each lower-cased text contains."""
    out = np.zeros((len(texts), settings.buckets), np.uint8)
    flat = out.reshape(-1)
    mask = np.uint32(settings.buckets - 1)
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text)), 1 << 18):  # slices overlap by an n-gram
            codes = np.frombuffer(text[at : at + (1 << 18) + settings.max_n - 1].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
            h = np.zeros(len(codes), np.uint32)
            for n in range(1, settings.max_n + 1):
                if len(codes) < n:
                    break
                h = h[: len(codes) - n + 1] * np.uint32(0x01000193) ^ codes[n - 1 :] * np.uint32(0x9E3779B1)
                g = (h ^ np.uint32((n * 0x85EBCA6B) & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35)
                flat[((g ^ (g >> np.uint32(15))) & mask).astype(np.int64) + i * settings.buckets] = 1
    return out


@dataclass
class Model:
    labels: list[str]
    columns: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray
    sharpness: float
    settings: Settings

    def scores(self, bits: np.ndarray) -> np.ndarray:
        """Probabilities by label for presence rows."""
        size = np.sqrt(np.maximum(1, bits.sum(1, dtype=np.int64))).astype(np.float32)[:, None]
        kernel = bits[:, self.columns].astype(np.float32) @ self.landmarks / size
        margin = (kernel @ self.weights) * self.sharpness
        margin -= margin.max(1, keepdims=True)
        p = np.exp(margin)
        return p / p.sum(1, keepdims=True)


def fit(bits: np.ndarray, labels: list[str], settings: Settings) -> Model | None:
    """Nyström kernel ridge regression on presence rows; None without rows."""
    names = sorted(set(labels))
    if not names:
        return None
    y = np.array([names.index(x) for x in labels])
    size = np.sqrt(np.maximum(1, bits.sum(1, dtype=np.int64))).astype(np.float32)
    pick = np.concatenate([np.flatnonzero(y == k)[: settings.landmarks] for k in range(len(names))])
    columns = np.flatnonzero(bits[pick].any(0))
    marks = (bits[pick][:, columns].astype(np.float32) / size[pick, None]).T
    kernel = bits[:, columns].astype(np.float32) @ marks / size[:, None]
    values, vectors = np.linalg.eigh(kernel[pick].astype(float))
    good = values > 1e-6 * values[-1]
    root = (vectors[:, good] / np.sqrt(values[good])) @ vectors[:, good].T
    z = kernel.astype(float) @ root
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    share = 1 / np.bincount(y)[y]  # languages weigh alike
    w = np.linalg.solve((z * share[:, None]).T @ z + settings.ridge / len(pick) * np.eye(z.shape[1]), (z * share[:, None]).T @ target)
    margin = z @ w

    def loss(s):
        m = margin * s
        m = m - m.max(1, keepdims=True)
        return -np.mean(m[np.arange(len(y)), y] - np.log(np.exp(m).sum(1)))

    sharpness = min((0.5, 1, 2, 3, 4, 6), key=loss)  # bounded: training margins are too good
    return Model(names, columns, marks, (root @ w).astype(np.float32), float(sharpness), settings)


def train(docs: DataFrame, allowed: Column, settings: Settings = Settings()) -> Model | None:
    """Fit on at most `per_language` rows of each label among the allowed rows of docs(doc_id, text, lang)."""
    rows = docs.filter(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    # Documents, not rows, of each label; a sketch is enough for the doubled share below.
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("count"))
    key = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1 << 30))
    # Twice the wanted rows of each label on average, cut to the first ones below.
    share = counts.orderBy(F.desc("count"), "lang").limit(settings.languages).select("lang", (F.lit(2.0 * settings.per_language) / F.col("count") * (1 << 30)).alias("below"))
    some = rows.select("doc_id", "text", "lang", key.alias("k")).join(F.broadcast(share), "lang").filter("k < below")
    one = some.groupBy("lang", "doc_id", "k").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("r"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("k", "doc_id"))
    chosen = one.select("lang", "k", "doc_id", "r.text").withColumn("nth", nth).filter(F.col("nth") <= settings.per_language).select("lang", "k", "text")

    def pack(batches):
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            raw = [np.packbits(presence([t], settings)[0]).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch["lang"].cast(pa.string()), batch["k"], pa.array(raw, pa.binary())], names=["lang", "k", "bits"])

    found = chosen.mapInArrow(pack, "lang string, k long, bits binary")
    kept: dict[str, list] = {}
    for lang, _, raw in sorted((r[0], r[1], bytes(r[2])) for r in found.collect()):
        kept.setdefault(lang, []).append(raw)
    labels = [lang for lang, own in kept.items() for _ in own]
    raws = [raw for own in kept.values() for raw in own]
    bits = np.unpackbits(np.frombuffer(b"".join(raws), np.uint8).reshape(len(raws), -1), axis=1) if raws else np.zeros((0, settings.buckets), np.uint8)
    return fit(bits, labels, settings)


def identify(docs: DataFrame, held_out: Column, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; rows with held_out true are never learned from."""
    shared.tune(docs.sparkSession)
    model = train(docs, F.coalesce(~held_out, F.lit(False)), settings)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for batch in batches:
            texts = batch["text"].to_pylist()
            labels, scores = ["und"] * len(texts), [0.0] * len(texts)
            known = [i for i, t in enumerate(texts) if t and model is not None and _LETTER.search(t)]
            for at in range(0, len(known), settings.rows):
                part = known[at : at + settings.rows]
                p = model.scores(presence([texts[i] for i in part], settings))
                for i, k in zip(part, p.argmax(1).tolist()):
                    labels[i] = model.labels[k]
                for i, s in zip(part, p.max(1).tolist()):
                    scores[i] = s
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(labels), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _SCHEMA)
