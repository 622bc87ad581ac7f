"""Quality classification by co-training of two views.

* Text view: frequencies of hashed byte n-grams (1 to 3) of the whole text.
* Metadata view: what a record says about a page without reading its words: source, language label,
  length, and its layout (lines, words and characters per line, upper case, digits, punctuation).

Each view has a ridge-penalised logistic regression; the text view's is fitted on the sample's main directions
(``directions``). A quarter of the labelled rows of each class is held back. In each round both classifiers are
calibrated on it (Platt), label the unlabelled pool documents they are most sure of (up to ``per_round`` of
either class whose calibrated probability reaches ``confident``, of those not handed over yet) and hand them
to the other, which is then refitted. Rows that the two views label differently in one round are left in the
pool. At the end the held-back rows calibrate both views and then their combination, whose prior is that of all
labels, not of the balanced sample.

Bounds: the classifiers are fitted on at most ``labelled`` labelled rows of each class and ``pool``
unlabelled rows, the first ones by hash (the documented sample); rows leave executors as feature vectors of
fixed size. All documents are scored whole, in one pass without a shuffle of texts.

A document is rejected when its probability of good quality is below ``threshold``.

Cases: null or empty text scores as a text without bytes and is judged by both views like others; a null
source or language is a value of its own. Of a doc_id's labels the least counts; of rows that share a doc_id
one is trained on. Without labels of both classes nothing can be learned: all documents get score 0.5 and are
kept; with fewer than four of a class none of it is held back. Repeated rows are judged alike; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


@dataclass(frozen=True)
class Settings:
    text_size: int = 2048
    meta_size: int = 256
    labelled: int = 1000
    pool: int = 2000
    rounds: int = 4
    per_round: int = 100
    confident: float = 0.9
    directions: int = 192
    ridge: float = 1e-3
    #: How strongly the combination is drawn to equal weights of the views.
    hold: float = 20.0
    threshold: float = 0.5


_WORDY = np.zeros(256, np.uint8)  # classes of bytes: 1 upper, 2 lower, 3 digit, 4 space, 5 line end, 6 beyond ASCII
_WORDY[65:91], _WORDY[97:123], _WORDY[48:58], _WORDY[[9, 11, 12, 13, 32]], _WORDY[10], _WORDY[128:] = 1, 2, 3, 4, 5, 6


def text_view(raw: np.ndarray, size: int) -> np.ndarray:
    """Root frequencies of hashed byte 1- to 3-grams, of unit length."""
    out = np.zeros(size, np.float32)
    for at in range(0, len(raw), 1 << 20):
        part = raw[at : at + (1 << 20) + 2].astype(np.uint32)
        h = np.zeros(len(part), np.uint32)
        for n in range(1, 4):
            if len(part) < n:
                break
            h = h[: len(part) - n + 1] * np.uint32(0x01000193) ^ part[n - 1 :] * np.uint32(0x9E3779B1)
            g = (h + np.uint32(n)) * np.uint32(0x85EBCA6B)
            out += np.bincount((g[: 1 << 20] ^ (g[: 1 << 20] >> np.uint32(13))) % np.uint32(size), minlength=size)  # n-grams that start in this slice
    out = np.sqrt(out)
    norm = np.sqrt((out * out).sum())
    return out / norm if norm else out


def meta_view(raw: np.ndarray, lang: str | None, source: str | None, n_chars: int | None, size: int) -> np.ndarray:
    """Hashed source and language, length classes, and the layout's shares in steps."""
    import zlib

    out = np.zeros(size, np.float32)
    counts = np.bincount(_WORDY[raw], minlength=7)
    total = max(1, len(raw))
    lines = counts[5] + 1
    words = counts[4] + counts[5] + 1
    names = [f"lang={lang}", f"source={source}", f"length={int(np.log2((n_chars or 0) + 1))}"]
    for k, v in (("upper", counts[1] / max(1, counts[1] + counts[2])), ("digit", counts[3] / total), ("other", counts[0] / total), ("beyond", counts[6] / total)):
        names.append(f"{k}={int(min(1.0, v) * 20)}")
    names += [f"line={int(np.log2(total / lines + 1))}", f"word={int(2 * np.log2(total / words + 1))}", f"per={int(np.log2(words / lines + 1))}", f"marks={int(4 * min(3, counts[0] / words))}"]
    for name in names:
        out[zlib.crc32(name.encode()) % (size - 1)] = 1
    out[size - 1] = 1
    return out / np.sqrt(out.sum())


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 30) -> np.ndarray:
    """Weights with intercept, classes weighing alike, by Newton steps that are halved where they overshoot."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1).astype(float)
    weight = np.where(y > 0.5, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-9

    def loss(w):
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (penalty * w * w).sum())

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(steps):
        p = _sigmoid(x @ w)
        slope = x.T @ (weight * (p - y)) + penalty * w
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        while loss(w - step) > now and np.abs(step).max() > 1e-9:
            step /= 2
        w = w - step
        before, now = now, loss(w)
        if before - now < 1e-8:
            break
    return w


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def main_directions(x: np.ndarray, most: int, seed: int = 5) -> np.ndarray:
    """An orthonormal basis of the rows' main directions, by two rounds of random projection."""
    if min(x.shape) <= most:
        return np.linalg.qr(x.T)[0] if x.shape[0] < x.shape[1] else np.eye(x.shape[1])
    basis = np.random.default_rng(seed).normal(size=(x.shape[1], most + 16))
    for _ in range(3):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    return basis[:, :most]


def _margin(x, w):
    return x @ w[:-1] + w[-1]


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the calibrated log-odds, with smoothed targets."""
    a, b = _calibrated(margin[:, None], y, np.ones(1))
    return float(a[0]), b


def _calibrated(odds: np.ndarray, y: np.ndarray, start: np.ndarray, hold: float = 1e-2) -> tuple[np.ndarray, float]:
    """Slopes (none negative; `hold` draws them to their start) and intercept that turn columns of odds into
    log-odds of y."""
    pos, neg = y.sum(), (1 - y).sum()
    target = np.where(y > 0.5, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.concatenate([odds, np.ones((len(odds), 1))], 1)
    goal = np.append(start, 0.0)
    pull = np.append(np.full(odds.shape[1], hold), 1e-6)
    w = goal.copy()
    for _ in range(100):
        p = _sigmoid(x @ w)
        slope = x.T @ (p - target) + pull * (w - goal)
        bend = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + np.diag(pull)
        step = np.clip(np.linalg.solve(bend, slope), -2, 2)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    if (w[:-1] < 0).any():  # a view that tells nothing has no say
        good = w[:-1] >= 0
        if odds.shape[1] == 1 or not good.any():
            return np.zeros(odds.shape[1]), float(np.log((pos + 1) / (neg + 1)))
        part, b = _calibrated(odds[:, good], y, start[good], hold)
        whole = np.zeros(odds.shape[1])
        whole[good] = part
        return whole, b
    return w[:-1], float(w[-1])


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    text_platt: tuple[float, float]
    meta_platt: tuple[float, float]
    #: Weights of both views' log-odds and the intercept, the prior of all labels in it.
    mix: tuple[float, float, float]
    #: Held-back rows (of class 0, of class 1), and rows handed over by (round, view, class).
    held: tuple[int, int]
    exchanged: dict[tuple[int, int, int], int]
    settings: Settings

    def probability(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        a = self.text_platt[0] * _margin(text, self.text) + self.text_platt[1]
        b = self.meta_platt[0] * _margin(meta, self.meta) + self.meta_platt[1]
        return _sigmoid(self.mix[0] * a + self.mix[1] * b + self.mix[2])


def held_back(y: np.ndarray) -> np.ndarray:
    """Every fourth row of each class."""
    held = np.zeros(len(y), bool)
    for q in (0, 1):
        held[np.flatnonzero(y == q)[3::4]] = True
    return held


def fit(text, meta, y, pool_text, pool_meta, settings: Settings, prior: float | None = None) -> Model | None:
    """Co-train on labelled rows (y in 0, 1) and calibrate on the held-back ones of them."""
    if len(y) < 8 or y.min() == y.max():
        return None
    held = held_back(y)
    back = held if held.any() and y[held].min() < y[held].max() else ~held
    basis = main_directions(np.concatenate([text, pool_text]).astype(float), settings.directions)
    labelled, pool = [text @ basis, meta], [pool_text @ basis, pool_meta]
    sets = [[x[~held], y[~held]] for x in labelled]
    free = np.ones(len(pool_text), bool)
    weights = [logistic(*s, settings.ridge) for s in sets]
    exchanged = {}
    for turn in range(settings.rounds):
        label = np.full((2, len(free)), -1)
        for k in range(2):
            a, b = _platt(_margin(labelled[k][back], weights[k]), y[back])
            p = _sigmoid(a * _margin(pool[k], weights[k]) + b)
            for q, sure in ((1, p), (0, 1 - p)):
                rows = np.flatnonzero(free & (sure >= settings.confident))
                label[k, rows[np.argsort(-sure[rows], kind="stable")[: settings.per_round]]] = q
        label[:, (label[0] >= 0) & (label[1] >= 0) & (label[0] != label[1])] = -1
        for k in range(2):  # each view teaches the other
            rows = np.flatnonzero(label[k] >= 0)
            sets[1 - k] = [np.concatenate([sets[1 - k][0], pool[1 - k][rows]]), np.concatenate([sets[1 - k][1], label[k, rows].astype(float)])]
            exchanged.update({(turn, k, q): int((label[k] == q).sum()) for q in (0, 1)})
        if (label < 0).all():
            break
        free &= (label < 0).all(0)
        weights = [logistic(*s, settings.ridge) for s in sets]
    platt = [_platt(_margin(v[back], w), y[back]) for v, w in zip(labelled, weights)]
    odds = np.stack([a * _margin(v[back], w) + b for v, w, (a, b) in zip(labelled, weights, platt)], 1)
    mix, shift = _calibrated(odds, y[back], np.full(2, 0.5), settings.hold)
    if prior is not None:
        shift += np.log(prior / (1 - prior)) - np.log(y[back].mean() / (1 - y[back].mean()))
    whole = np.append(basis @ weights[0][:-1], weights[0][-1])
    counts = (int((y[held] == 0).sum()), int((y[held] == 1).sum()))
    return Model(whole.astype(np.float32), weights[1].astype(np.float32), platt[0], platt[1], (float(mix[0]), float(mix[1]), float(shift)), counts, exchanged, settings)


def _views(batch, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    at, raw = shared.offsets_of(batch["text"])
    lang, source, size = (batch[c].to_pylist() for c in ("lang", "source", "n_chars"))
    text = np.stack([text_view(raw[a:b], settings.text_size) for a, b in zip(at[:-1].tolist(), at[1:].tolist())])
    meta = np.stack([meta_view(raw[a:b], lang[i], source[i], size[i], settings.meta_size) for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist()))])
    return text, meta


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast(t).alias(c) for c, t in (("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "long"))))


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Fit on samples of docs; labels: doc_id, quality (0, 1 or null)."""
    label = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    counts = {r[0]: r[1] for r in label.filter("quality in (0, 1)").groupBy("quality").count().collect()}
    if len(counts) < 2:
        return None
    space = 1 << 30
    key = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("quality")), F.lit(space)).alias("k")
    first = lambda df, most: df.select("doc_id", "quality", key).orderBy("k", "doc_id").limit(most).select("doc_id", "quality")
    # Twice the pool on average before labelled ones go: the hash alone bounds what is made distinct.
    spare = _rows(docs).select("doc_id").filter(key < space * min(1.0, 2.0 * settings.pool / max(1, docs.count()))).distinct()
    spare = spare.join(label, "doc_id", "left_anti").select("doc_id", F.lit(-1).alias("quality"))
    wanted = first(label.filter("quality = 0"), settings.labelled).unionByName(first(label.filter("quality = 1"), settings.labelled)).unionByName(first(spare, settings.pool))
    # The limits bound these ids; rows that share one are cut down to one before they leave their task.
    columns = ("text", "lang", "source", "n_chars")
    found = _rows(docs).join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64(*columns).alias("h"), *columns)).alias("r")).select("doc_id", "quality", "r.*")

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                text, meta = _views(batch, settings)
                raw = [np.concatenate([a, b]).astype(np.float16).tobytes() for a, b in zip(text, meta)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["quality"], pa.array(raw, pa.binary())], names=["doc_id", "quality", "x"])

    rows: dict[int, list] = {-1: [], 0: [], 1: []}
    for _, q, raw in sorted((r[0], r[1], bytes(r[2])) for r in found.mapInArrow(pack, "doc_id long, quality int, x binary").collect()):
        rows[q].append(np.frombuffer(raw, np.float16))
    if not rows[0] or not rows[1]:
        return None
    y = np.array([0.0] * len(rows[0]) + [1.0] * len(rows[1]))
    x = np.stack(rows[0] + rows[1]).astype(np.float32)
    u = np.stack(rows[-1]).astype(np.float32) if rows[-1] else np.zeros((0, x.shape[1]), np.float32)
    t = settings.text_size
    return fit(x[:, :t], x[:, t:], y, u[:, :t], u[:, t:], settings, counts[1] / (counts[0] + counts[1]))


def score(docs: DataFrame, model: Model | None, settings: Settings = Settings(), carry: bool = False) -> DataFrame:
    """doc_id, text_score, meta_score, score, kept of every row; with carry, the rows' other columns too."""
    shared.tune(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    base = ("doc_id long, text string, lang string, source string, n_chars long, " if carry else "doc_id long, ") + "text_score double, meta_score double, score double, kept boolean"
    names = [f.split()[0] for f in base.split(", ")]

    def run(batches):
        model = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            if model is None:
                a = b = p = np.full(batch.num_rows, 0.5)
                keep = np.ones(batch.num_rows, bool)
            else:
                text, meta = _views(batch, settings)
                a, b = (_sigmoid(s[0] * _margin(v, w) + s[1]) for v, w, s in ((text, model.text, model.text_platt), (meta, model.meta, model.meta_platt)))
                p = model.probability(text, meta)
                keep = p >= settings.threshold
            got = {"text_score": pa.array(a.astype(float)), "meta_score": pa.array(b.astype(float)), "score": pa.array(p.astype(float)), "kept": pa.array(keep)}
            yield pa.RecordBatch.from_arrays([got[n] if n in got else batch[n] for n in names], names=names)

    return _rows(docs).mapInArrow(run, base)


def quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), carry: bool = False) -> DataFrame:
    return score(docs, train(docs, labels, settings), settings, carry)
