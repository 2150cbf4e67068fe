"""A quality classifier: a linear support vector machine on n-gram indicators scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.llm.common import pick, small_batches, tidied

#: Labelled rows from which a model is fitted, at most, on average over hashes; bits of a feature's number.
MAX_TRAIN, BITS = 8000, 20
#: Shares of a text's words from which on a shape counts as frequent; each is an indicator of its own.
TIERS = (0.01, 0.05, 0.2, 0.5)
_SHAPE = bytes(ord("A") if 65 <= i <= 90 else ord("a") if 97 <= i <= 122 or i >= 128 else ord("0") if 48 <= i <= 57 else i for i in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """A word's number (low 32 bits) and that of its shape (high 32): letters, capitals and digits as classes, runs as one."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        shape = _RUN.sub(rb"\1", w.translate(_SHAPE))
        self[w] = v = (xxhash.xxh32_intdigest(shape) << 32) | xxhash.xxh32_intdigest(w.lower())
        return v


def _mix(kind: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), kind * int(_ODD) % 2**64, dtype="u8")
    for p in parts:
        h = (h ^ p) * _ODD
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - BITS)).astype("u4")


def features(text: str | None, words: Words) -> np.ndarray:
    """Numbers of the distinct n-grams of a whole text: words (1, 2), shapes (1 to 3), frequent shapes, repeated words."""
    w = (text or "").encode("utf-8", "replace").split()
    if not w:
        return np.zeros(0, dtype="u4")
    a = np.array(list(map(words.__getitem__, w)), dtype="u8")
    word, shape = a & np.uint64(0xFFFFFFFF), a >> np.uint64(32)
    out = [_mix(1, word), _mix(2, word[:-1], word[1:]), _mix(3, shape), _mix(4, shape[:-1], shape[1:]), _mix(5, shape[:-2], shape[1:-1], shape[2:])]
    kinds, n = np.unique(shape, return_counts=True)
    for i, t in enumerate(TIERS):
        out.append(_mix(6 + i, kinds[n >= t * len(w)]))
        if len(w) > 1 and (word[1:] == word[:-1]).mean() >= t:
            out.append(_mix(20 + i, np.zeros(1, dtype="u8")))
        if len(set(w)) <= (1 - t) * len(w):
            out.append(_mix(30 + i, np.zeros(1, dtype="u8")))
    return np.unique(np.concatenate(out))


@dataclass
class Model:
    """weight of each feature (already scaled by its ratio), what it adds to a text's length, bias, and the sigmoid."""

    weight: np.ndarray
    ratio: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, f: np.ndarray) -> float:
        r = self.ratio[f]
        n = np.sqrt(float(r @ r))
        return self.bias + (float(self.weight[f] @ r) / n if n else 0.0)

    def score(self, f: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(f) + self.shift, -50, 50))))


def _ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0, least: int = 4) -> np.ndarray:
    """log of the smoothed shares of a feature in either class; 0 for features of fewer than `least` rows."""
    counts = [np.full(1 << BITS, alpha), np.full(1 << BITS, alpha)]
    for f, c in zip(rows, y, strict=True):
        counts[int(c > 0)][f] += 1
    rare = counts[0] + counts[1] < least + 2 * alpha
    r = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    r[rare] = 0
    return r.astype("f4")


def _svm(rows: list[np.ndarray], y: np.ndarray, cost: float, rounds: int, seed: int = 1) -> Model:
    """Dual coordinate descent for the hinge loss: one dual variable for each row, 0 to `cost`."""
    r = _ratios(rows, y)
    used = [f[r[f] != 0] for f in rows]
    vals = [r[f] / max(np.sqrt(float(r[f] @ r[f])), 1e-12) for f in used]
    w, bias, dual, rng = np.zeros(1 << BITS, dtype="f4"), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * (float(w[used[i]] @ vals[i]) + bias) - 1
            new = min(max(dual[i] - g / 2, 0.0), cost)  # a row has length 1, and 1 for the bias
            if new != dual[i]:
                step = (new - dual[i]) * y[i]
                w[used[i]] += np.float32(step) * vals[i]
                bias += step
                worst, dual[i] = max(worst, abs(step)), new
        if worst < 1e-3:
            break
    return Model(w, r, bias, 1.0, 0.0)


def _sigmoid(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make margins into probabilities, by Newton steps with a small ridge."""
    t, p = (y > 0).astype(float), np.zeros(2)
    x = np.stack([m, np.ones_like(m)], 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -50, 50)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (t - q) - 1e-3 * p)
        p += step
        if np.abs(step).max() < 1e-9:
            break
    return float(p[0]), float(p[1])


def fit_rows(rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0, rounds: int = 20, folds: int = 3) -> Model:
    """A model from feature lists and classes (1 or -1); the sigmoid is fitted on margins of held-out folds."""
    if len(y) < 2 * folds or abs(y.sum()) == len(y):
        share = (float((y > 0).sum()) + 1) / (len(y) + 2)
        return Model(np.zeros(1 << BITS, dtype="f4"), np.zeros(1 << BITS, dtype="f4"), 0.0, 0.0, float(np.log(share / (1 - share))))
    fold, m = np.arange(len(y)) % folds, np.zeros(len(y))
    for k in range(folds):
        part = _svm([r for r, f in zip(rows, fold, strict=True) if f != k], y[fold != k], cost, rounds)
        for i in np.flatnonzero(fold == k):
            m[i] = part.margin(rows[i])
    out = _svm(rows, y, cost, rounds)
    out.slope, out.shift = _sigmoid(m, y)
    return out


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = MAX_TRAIN, cost: float = 1.0) -> Model:
    """Fits a model on a sample of the labelled rows: those with the smallest hashes of their ids, about `max_train`.

    The sample's features (a few KB a row) are gathered in one task, whose size `max_train` bounds, and the model (two
    float arrays of 2**20) comes to the driver. Rows with null ids or labels teach nothing; a document that is labelled
    more than once counts once, with its largest label. Without two classes the score is the share of label 1.
    """
    small_batches(docs.sparkSession)
    given = pick(labels, id=doc_id, y=label).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    n = given.count()
    if n > max_train:
        given = given.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * max_train / n))
    rows = pick(docs, id=doc_id, text=text).join(F.broadcast(given), "id").select("id", F.col("y").cast("int"), F.col("text").cast("string"))

    def gather(it):
        words = Words()
        for b in it:
            c = b.to_pydict()
            yield pa.RecordBatch.from_pydict({"id": c["id"], "y": c["y"], "f": [features(t, words).tobytes() for t in c["text"]]}, schema=pa.schema([("id", pa.int64()), ("y", pa.int32()), ("f", pa.binary())]))

    def learn(it):
        got = pd.concat([*it, pd.DataFrame({"id": [], "y": [], "f": []})]).sort_values(["id", "f"])
        m = fit_rows([np.frombuffer(f, dtype="u4") for f in got["f"]], np.where(got["y"].to_numpy() > 0, 1, -1), cost)
        yield pd.DataFrame({"w": [m.weight.tobytes()], "r": [m.ratio.tobytes()], "p": [[m.bias, m.slope, m.shift]]})

    rows = rows.withColumn("id", F.col("id").cast("long"))
    got = rows.mapInArrow(tidied(gather), "id long, y int, f binary").repartition(1).mapInPandas(tidied(learn), "w binary, r binary, p array<double>").first()
    return Model(np.frombuffer(got.w, dtype="f4"), np.frombuffer(got.r, dtype="f4"), *got.p)


def score(docs: DataFrame, model: Model, *, text: str = "text", name: str = "score") -> DataFrame:
    """Adds a column: the probability, 0 to 1, that a text has label 1. Map only.

    Every whole text is scored; null and empty texts get the score of a text without features. All other columns
    stay as they are, whatever their names; a column that has the name of the score is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    told = spark.sparkContext.broadcast(model)

    def scored(it):
        words = Words()
        for texts in it:
            yield pd.Series([told.value.score(features(t, words)) for t in texts], dtype="float64")

    @F.pandas_udf("double")
    def rate(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return tidied(scored)(parts)

    return docs.withColumn(name, rate(F.col(f"`{text}`").cast("string")))
