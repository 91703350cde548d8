"""Quality rules with risk-controlled thresholds.

Four rules look at shares of a text: symbols, repeated lines, words in repeated windows, capitals. Each rule rejects a
text above a cutoff, chosen for each stratum (language) from labelled good texts: going from the most lenient cutoff
down, a cutoff is accepted while an exact binomial test (the Clopper-Pearson bound) shows at level DELTA / (rules *
strata) that no more than RISK / rules of the good texts lie above it; the first that fails ends the walk (fixed-sequence
testing), so with confidence 1 - DELTA the rules together reject at most RISK of the good texts of every stratum. A stratum with
too few labels keeps the most lenient cutoff, which rejects nothing. The levels are counted in Spark; a group holds at
most LEVELS + 1 rows a rule.

Edge cases: a null or empty text has no words and fails the base rule; a null stratum is the stratum ''; several labels
of an id count as good if all are; null labels are none; copies of a labelled text are one trial of the tests; repeated
rows and equal ids are judged row by row; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, mix64, small_batches, written

RISK, DELTA, LEVELS, WINDOW = 0.02, 0.05, 50, 8
RULES = ("symbols", "dup_lines", "repeats", "capitals")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS, SPACES, UPPER = b"#*$%&|<>", b" \t\n\v\f\r", bytes(range(65, 91))
#: Strata up to which their cutoffs are broadcast; beyond, they are joined by a shuffle.
BROADCAST_STRATA = 10_000

_words = Remembered(xxhash.xxh3_64_intdigest, 500_000)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    out = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        out = mix64(out + h[k : k + n])
    ordered = np.sort(out)
    if (ordered[1:] != ordered[:-1]).all():  # all hashes differ, so all windows do
        return 0
    count: dict[tuple, int] = {}
    windows = [tuple(words[i : i + WINDOW]) for i in range(n)]
    for w in windows:
        count[w] = count.get(w, 0) + 1
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    for i in range(n):
        if count[windows[i]] > 1:
            covered[i] += 1
            covered[min(i + WINDOW, len(words))] -= 1
    return int((np.cumsum(covered[:-1]) > 0).sum())


def measured(text: bytes) -> tuple:
    """The base counts, then lines with a word, and capitals."""
    words = text.split()
    chars = len(text.translate(None, SPACES).decode())
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return (len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines), len(text) - len(text.translate(None, UPPER)))


def features(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """One row per document: doc_id, stratum, the base counts, each rule's share, and a signature of the text."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "stratum", *BASE, *RULES, "sig"]

    def run(batches):
        for b in batches:
            texts = [t or b"" for t in b.column(2).to_pylist()]
            rows = [measured(t) for t in texts]
            sig = pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary())
            x = np.array(rows, dtype=np.int64).reshape(-1, 7)
            share = lambda a, of: pa.array(np.minimum(1.0, a / np.maximum(of, 1)))
            rules = [share(x[:, 2], x[:, 1]), share(x[:, 3], x[:, 5]), share(x[:, 4], x[:, 0]), share(x[:, 6], x[:, 1])]
            yield pa.record_batch([b.column(0), b.column(1), *[pa.array(x[:, k]) for k in range(5)], *rules, sig], names=names)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), F.col("text").cast("binary"))
    return d.mapInArrow(run, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in BASE) + ", " + ", ".join(f"{c} double" for c in RULES) + ", sig binary")


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial of n and p, exactly summed."""
    i = np.arange(k + 1)
    logs = np.array([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in i]) + i * math.log(p) + (n - i) * math.log1p(-p)
    return float(min(1.0, np.exp(logs).sum()))


def cutoff(above: np.ndarray, n: int, level: float, risk: float = RISK) -> int:
    """The least accepted level; above[k]: good texts over level k. Level LEVELS (share 1) rejects nothing."""
    best = LEVELS
    for k in range(LEVELS - 1, -1, -1):
        if above[k] > n * risk or tail(int(above[k]), n, risk) > level:
            break
        best = k
    return best


def cutoffs(held: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, a cutoff for each rule) from the measured documents that labels call good."""
    good = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    known = held.where(f"n_words >= 20 and 100 * n_repeat_words <= 30 * n_words").join(good.hint("shuffle_merge"), "doc_id")
    known = known.dropDuplicates(["stratum", "sig" if "sig" in known.columns else "doc_id"])  # copies of a text are one trial
    level = lambda r: F.ceil(F.col(r) * LEVELS).cast("int")  # noqa: E731  a text is over level k if this is more than k
    long = known.select("stratum", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), level(r).alias("level")) for k, r in enumerate(RULES)])).alias("x"))
    counts = held.select("stratum").distinct().join(long.groupBy("stratum", "x.rule", "x.level").count().hint("shuffle_merge"), "stratum", "left")
    strata = max(1, held.select("stratum").distinct().count())

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {"stratum": [pdf.stratum.iloc[0]]}
        for k, r in enumerate(RULES):
            own = pdf[pdf.rule == k]
            per = np.bincount(own.level.astype(int), own["count"], LEVELS + 1) if len(own) else np.zeros(LEVELS + 1)
            n = int(per.sum())
            out[f"cut_{r}"] = [(cutoff(n - np.cumsum(per), n, delta / (len(RULES) * strata), risk / len(RULES)) if n else LEVELS) / LEVELS]
        return pd.DataFrame(out)

    return counts.groupBy("stratum").applyInPandas(choose, "stratum string, " + ", ".join(f"cut_{r} double" for r in RULES))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, stratum and each rule's share."""
    spark = docs.sparkSession
    held = written(spark, features(docs, stratum), "quality")
    cuts = written(spark, cutoffs(held, labels, risk, delta), "cutoffs")
    few = cuts.count() <= BROADCAST_STRATA
    rows = held.join(F.broadcast(cuts) if few else cuts.hint("shuffle_merge"), "stratum")
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    within = F.expr(" and ".join(f"ceil({r} * {LEVELS}) <= round(cut_{r} * {LEVELS})" for r in RULES))
    return rows.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & within).alias("kept"), "stratum", *RULES)
