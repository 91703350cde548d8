"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

A text's feature is the number of its distinct lower-case words that hold an n-gram (3 to 5 characters, with a space at
either end of the word), hashed to 2**BITS places and scaled by the log ratio of its smoothed frequencies in toxic and
other texts (Wang and Manning 2012). As the score is a sum over distinct words, a worker remembers each word's share.

The model is fitted on a bounded sample: at most `per_class` labelled documents of each label, those with the least
hash of their id, never those held out. All texts are scored whole.

Edge cases: a null or empty text scores as the intercept; several labels of one id count as toxic if one does; a null
label is none; without labels of both kinds the score is the smoothed share of toxic labels; of rows with equal ids
one is learnt from (the text of the least hash), and each is scored by itself, so extra columns and empty tables need no
care.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_mod, mix64, small_batches

BITS, SIZES, PER_CLASS = 18, (3, 4, 5), 3000
#: The least chi-square of a feature's presence against the label.
LEAST = 11.0
WORD = re.compile(r"[^\s.,;:!?\"()\[\]{}|]+")


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def grams(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of words, and the index of the word of each."""
    size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 2
    chars = np.frombuffer("".join([f" {w} " for w in found]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(found)), size)
    end = np.cumsum(size)[owner]
    place, out, of = np.arange(len(chars)), [], []
    for n in SIZES:
        ok = np.flatnonzero(place + n <= end)
        h = np.full(len(ok), n, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + chars[ok + k]
        out.append((mix64(h) >> np.uint64(64 - BITS)).astype(np.int64))
        of.append(owner[ok])
    return np.concatenate(out), np.concatenate(of)


class Model:
    """weight per hashed n-gram (already scaled by its ratio) and an intercept."""

    def __init__(self, weight: np.ndarray, bias: float):
        self.weight, self.bias = weight.astype(np.float64), float(bias)
        self.known: dict[str, float] = {}

    def __reduce__(self):
        return Model, (self.weight.astype(np.float32), self.bias)

    def score(self, texts: list[str]) -> np.ndarray:
        split = [words(t) for t in texts]
        lacking = sorted(set().union(*split) - self.known.keys())
        if len(self.known) + len(lacking) > 1_000_000:
            self.known.clear()
            lacking = sorted(set().union(*split))
        if lacking:
            g, of = grams(lacking)
            self.known.update(zip(lacking, np.bincount(of, self.weight[g], len(lacking)).tolist(), strict=True))
        get = self.known.__getitem__
        z = np.array([sum(map(get, sorted(ws))) for ws in split]) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], known: tuple[int, int] | None = None, steps: int = 300, ridge: float = 1e-4, alpha: float = 1.0, least: float = LEAST) -> Model:
    """From (features, counts, label) of each text: ratios of the features that a chi-square test ties to the label, then logistic regression by Adam.

    known: how many labels of either kind there are in all; the sample counts by them."""
    size = 1 << BITS
    y = np.array([r[2] for r in rows], dtype=float)
    known = known or (int(len(y) - y.sum()), int(y.sum()))
    bias = float(np.log((known[1] + 0.5) / (known[0] + 0.5))) - (not sum(known))
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(size), bias)
    at = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    f, c = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(float)
    toxic = y[at] == 1
    p, q = np.bincount(f[toxic], minlength=size) + alpha, np.bincount(f[~toxic], minlength=size) + alpha
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    n, a, b = len(y), p - alpha, q - alpha
    with np.errstate(divide="ignore", invalid="ignore"):  # chi-square of presence against the label
        chi = n * (a * (n - y.sum() - b) - b * (y.sum() - a)) ** 2 / ((a + b) * (n - a - b) * y.sum() * (n - y.sum()))
    ratio[~(chi >= least)] = 0
    use = ratio[f] != 0
    names, f = np.unique(f[use], return_inverse=True)
    at, x = at[use], c[use] * ratio[names][f]
    share = np.where(y == 1, known[1] / y.sum(), known[0] / (len(y) - y.sum())) / sum(known)  # as frequent as among all labels
    w, m, v = np.append(np.zeros(len(names)), bias), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(at, x * w[f], len(y)) + w[-1]
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        g = np.append(np.bincount(f, x * d[at], len(names)) + ridge * w[:-1], d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    weight = np.zeros(size)
    weight[names] = w[:-1] * ratio[names]
    return Model(weight, w[-1])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", holdout: int = 5, per_class: int = PER_CLASS) -> Model:
    """Fit on labelled documents whose id_mod(holdout) is not 0. One task fits; the driver gets the weights (2**BITS floats)."""
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(f"{label_col} is not null and doc_id is not null").groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y")).where(id_mod("doc_id", holdout) != 0)
    total = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    sample = [known.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    picked = docs.select("doc_id", "text").join(F.broadcast(sample[0].union(sample[1])), "doc_id")  # at most 2 * per_class ids
    picked = picked.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y"))  # one row an id, so the task that fits is bounded

    def features(batches):
        for b in batches:
            found = []
            for text in b.column(1).to_pylist():
                ws = sorted(words(text or ""))
                found.append(np.unique(grams(ws)[0], return_counts=True) if ws else (np.array([], dtype=np.int64),) * 2)
            lists = [pa.array([x[k].astype(np.int32) for x in found], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.record_batch([b.column(0), b.column(2), *lists], names=["doc_id", "y", "f", "c"])

    def fitted(batches):
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), [np.asarray(x.values) for x in b.column(2)], [np.asarray(x.values) for x in b.column(3)], b.column(1).to_pylist(), strict=True)]
        rows.sort(key=lambda r: (r[0], len(r[1])))
        model = fit([r[1:] for r in rows], (total.get(0, 0), total.get(1, 0)) if total else None)
        yield pa.record_batch([pa.array([model.weight.astype("<f4").tobytes()], pa.binary()), pa.array([model.bias])], names=["weight", "bias"])

    one = picked.mapInArrow(features, "doc_id long, y int, f array<int>, c array<int>").repartition(1).mapInArrow(fitted, "weight binary, bias double").first()
    return Model(np.frombuffer(one.weight, dtype="<f4"), one.bias)


def toxic_score(model: Model, text: Column) -> Column:
    """A column with the score (0 to 1) of each text. The model, of fixed size, goes to the executors once, by broadcast."""
    from pyspark.sql import SparkSession

    held = SparkSession.active().sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(held.value.score([t or "" for t in texts.to_pylist()]), pa.float64())

    return score(text.cast("string"))
