"""Language-model scoring by context-tree weighting over binary-decomposed bytes, beside a word-unigram base.

Every byte is eight binary decisions; a decision's context is the bits before it in its byte and up to DEPTH bytes
before that, nearest first. A context at each depth keeps the counts of zeros and ones; its block probability is the
Krichevsky-Trofimov estimate of them, mixed half and half with the product of its children's (Willems et al. 1995). The
prediction of a bit mixes the estimates of all depths by the weights that the training texts leave. The code length of
a text is the sum over its bytes, lower-cased (A-Z), and one end byte (0).

All training texts are counted. Texts are held in blocks of about BLOCK_CHARS characters; a block sends each of its
distinct words and DEPTH + 1 byte strings once, with its training count, and gets back the corpus count of each word
and the code length of each string. Strings are worked out in groups by the two nearest context bytes, by three where
such a group has more than LARGE strings, and by four where that is more too, so no task holds a large group. What lies
above the groups is summed by Spark. Depths 0 and 1 (257 * 255 nodes at most) are shared by broadcast; the nodes of
split groups reach the groups below them by a join, 255 or 510 rows each, so nothing on the driver grows. The blocks of a word or string are kept in lists of some thousand at most.

Edge cases: a null text is empty and scores its end; without training texts every count is zero and every bit costs one
bit; repeated rows and equal ids are scored row by row; a null id hashes as empty text; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_mod, release, small_batches, written

DEPTH, BLOCK_CHARS, STEP = 4, 16_000_000, 1 << 20
#: Strings from which a group is split by one more context byte; partitions whose blocks make one list.
LARGE, LISTED = 100_000, 256
#: Split groups up to which their names are broadcast; beyond, they are joined by a shuffle.
BROADCAST_GROUPS = 500_000
LN10 = math.log(10)


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma for x >= 0.5 by Stirling's series after a shift of 8."""
    shift = sum(np.log(x + k) for k in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def kt_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return lgamma(n0 + 0.5) + lgamma(n1 + 0.5) - math.log(math.pi) - lgamma(n0 + n1 + 1.0)


def strings(data: np.ndarray) -> np.ndarray:
    """The DEPTH + 1 bytes that end at each place after the first DEPTH, as one number, nearest context byte next to the byte."""
    key = np.zeros(len(data) - DEPTH, dtype=np.int64)
    for k in range(DEPTH + 1):
        key = key << 8 | data[k : len(data) - DEPTH + k]
    return key


def framed(text: bytes) -> bytes:
    return b"\0" * DEPTH + text.lower() + b"\0"


def doc_strings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All strings of several texts, and the text each belongs to."""
    size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(map(framed, texts)), dtype=np.uint8).astype(np.int64)
    key = strings(data)
    ends = np.cumsum(size + DEPTH)
    keep = np.ones(len(key), dtype=bool)
    for k in range(DEPTH):  # strings that would start in one text and end in the next
        keep[ends[:-1] - DEPTH + k] = False
    return key[keep], np.repeat(np.arange(len(texts)), size)


def parts(texts: list[bytes]):
    """Consecutive texts of about STEP bytes."""
    out, size = [], 0
    for t in texts:
        if out and size + len(t) > STEP:
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t)
    if out:
        yield out


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, at = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(at, np.concatenate(counts), len(k)).astype(np.int64)


def by_block(batches):
    """(block, texts, training flags) of consecutive rows of one block, about 16 STEP bytes at most."""
    held, texts, train, size = None, [], [], 0
    for b in batches:
        for block, t, fit in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if texts and (block != held or size > 16 * STEP):
                yield held, texts, train
                texts, train, size = [], [], 0
            held = block
            texts.append(t)
            train.append(fit)
            size += len(t)
    if texts:
        yield held, texts, train


def word_counts(blocks: DataFrame) -> DataFrame:
    """(word, block, n): each distinct word of a block and its training count there."""

    def run(batches):
        for block, texts, train in by_block(batches):
            fit = Counter()
            for t, f in zip(texts, train, strict=True):
                if f:
                    fit.update(t.lower().split())
            for t, f in zip(texts, train, strict=True):
                if not f:
                    fit.update(dict.fromkeys(t.lower().split(), 0))
            yield pa.record_batch([pa.array(list(fit), pa.binary()), pa.array(np.full(len(fit), block)), pa.array(list(fit.values()), pa.int64())], names=["word", "block", "n"])

    return blocks.select("block", "text", "train").mapInArrow(run, "word binary, block long, n long")


def string_counts(blocks: DataFrame) -> DataFrame:
    """(key, block, n): each distinct string of a block and its training count there."""

    def run(batches):
        for block, texts, train in by_block(batches):
            keys, counts = [], []
            for fit in (True, False):
                for part in parts([t for t, f in zip(texts, train, strict=True) if f == fit]):
                    k, n = np.unique(doc_strings(part)[0], return_counts=True)
                    keys.append(k)
                    counts.append(n if fit else np.zeros(len(n), dtype=np.int64))
            k, n = merged(keys, counts)
            yield pa.record_batch([pa.array(k), pa.array(np.full(len(k), block)), pa.array(n)], names=["key", "block", "n"])

    return blocks.select("block", "text", "train").mapInArrow(run, "key long, block long, n long")


class Level:
    """The bit nodes of one depth: index of each (string, bit) in them, their counts."""

    def __init__(self, context: np.ndarray, byte: np.ndarray, n: np.ndarray):
        k = np.arange(8)
        node = (1 << k) | (byte[:, None] >> (8 - k))
        self.bit = byte[:, None] >> (7 - k) & 1
        self.ids, at = np.unique((context[:, None] << 8 | node).ravel(), return_inverse=True)
        self.at = at.reshape(node.shape)
        w = np.repeat(n, 8).reshape(node.shape)
        size = len(self.ids)
        self.n1 = np.bincount(self.at.ravel(), (w * self.bit).ravel(), size)
        self.n0 = np.bincount(self.at.ravel(), w.ravel(), size) - self.n1
        self.own = kt_block(self.n0, self.n1)

    def estimate(self) -> np.ndarray:
        """The KT estimate of each string's bits."""
        n0, n1 = self.n0[self.at], self.n1[self.at]
        return (np.where(self.bit, n1, n0) + 0.5) / (n0 + n1 + 1)


def weights(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log of the weighted probability, and the share of the node's own estimate."""
    return np.logaddexp(own, below) - math.log(2), 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


def subtree(key: np.ndarray, n: np.ndarray, first: int) -> tuple[list[Level], list[np.ndarray], np.ndarray]:
    """Depths `first` to DEPTH of strings with the same `first` nearest context bytes: levels, shares, log weighted at depth `first`."""
    byte = key & 255
    levels = [Level(key >> 8 & (1 << 8 * d) - 1, byte, n) for d in range(first, DEPTH + 1)]
    logs, shares = levels[-1].own, [np.ones(len(levels[-1].ids))]
    for d in range(len(levels) - 2, -1, -1):
        up, down = levels[d], levels[d + 1]
        parent = np.searchsorted(up.ids, (down.ids >> 8 & (1 << 8 * (d + first)) - 1) << 8 | down.ids & 255)
        logs, share = weights(up.own, np.bincount(parent, logs, len(up.ids)))
        shares.insert(0, share)
    return levels, shares, logs


NODES = "depth int, context long, node long, n0 long, n1 long, logs double, share double"


def raised(nodes: DataFrame, depth: int) -> DataFrame:
    """The nodes of `depth` above those of depth + 1, as Spark sums them: counts, log weighted, share of the own estimate."""
    up = nodes.where(F.col("depth") == depth + 1).groupBy(F.expr(f"context & {(1 << 8 * depth) - 1}L").alias("context"), "node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "logs")])

    def weigh(batches):
        for b in batches:
            n0, n1, below = (b.column(k).to_numpy() for k in (2, 3, 4))
            logs, share = weights(kt_block(n0.astype(float), n1.astype(float)), below)
            yield pa.record_batch([pa.array(np.full(len(n0), depth, dtype=np.int32)), *b.columns[:4], pa.array(logs), pa.array(share)], names=["depth", "context", "node", "n0", "n1", "logs", "share"])

    return up.mapInArrow(weigh, NODES)


class Top:
    """Nodes of depths above a group: by depth, their sorted (context, node) and for each the counts and the share of the own estimate."""

    def __init__(self, nodes: pa.Table):
        depth, context, node, *rest = (nodes.column(c).to_numpy() for c in ("depth", "context", "node", "n0", "n1", "share"))
        self.at: dict[int, tuple] = {}
        for d in np.unique(depth).tolist():
            of = np.flatnonzero(depth == d)
            of = of[np.argsort(context[of] << 8 | node[of])]
            self.at[d] = context[of] << 8 | node[of], *(x[of] for x in rest)

    def mix(self, key: np.ndarray, bits: np.ndarray, p: np.ndarray, depths: range) -> np.ndarray:
        """The prediction p mixed with the given depths, the nearest first."""
        k = np.arange(8)
        node = (1 << k) | ((key & 255)[:, None] >> (8 - k))
        for d in depths:
            ids, n0, n1, share = self.at[d]
            at = np.searchsorted(ids, (key >> 8 & (1 << 8 * d) - 1)[:, None] << 8 | node)
            own = (np.where(bits, n1[at], n0[at]) + 0.5) / (n0[at] + n1[at] + 1)
            p = share[at] * own + (1 - share[at]) * p
        return p


def grouped(table: DataFrame) -> DataFrame:
    """table with depth and context: the least depth, from 2 on, whose contexts have LARGE strings at most (DEPTH at the deepest)."""
    near = table.select("key", "n", F.lit(2).alias("depth"), F.expr("(key >> 8) & 65535").alias("context"))
    for d in range(2, DEPTH):
        # A row for each group of more than LARGE strings.
        large = near.where(F.col("depth") == d).groupBy("context").agg(F.count("*").alias("k")).where(F.col("k") > LARGE).select(F.lit(d).alias("depth"), "context", F.lit(True).alias("large"))
        large = written(table.sparkSession, large, "large")
        if many := large.count():
            near = near.join(F.broadcast(large) if many <= BROADCAST_GROUPS else large.hint("shuffle_merge"), ["depth", "context"], "left").withColumn("context", F.expr(f"if(large, (key >> 8) & {(1 << 8 * (d + 1)) - 1}L, context)")).withColumn("depth", F.expr(f"if(large, {d + 1}, depth)")).drop("large")
    return near


def paths(near: DataFrame, nodes: DataFrame, deepest: int) -> DataFrame:
    """Per group (of, at: its depth and context) below a split one: the nodes (depth, context, node, n0, n1, share) of depths 2 and more above it."""
    groups = near.where("depth > 2").select(F.col("depth").alias("of"), F.col("context").alias("at")).distinct()
    out = None
    for d in range(2, max(3, deepest)):
        up = nodes.where(F.col("depth") == d).select("depth", "context", "node", "n0", "n1", "share")
        below = groups.where(F.col("of") > d).withColumn("context", F.expr(f"at & {(1 << 8 * d) - 1}L"))
        part = below.join(up.hint("shuffle_merge"), "context").select("of", "at", "depth", "context", "node", "n0", "n1", "share")
        out = part if out is None else out.union(part)
    return out


def code_lengths(table: DataFrame) -> DataFrame:
    """(key, logp): log10 of the model's probability of each string's last byte; table: (key, n), a key's counts in any number of rows."""
    near = written(table.sparkSession, grouped(table.groupBy("key").agg(F.sum("n").alias("n"))), "near")

    def sums(t: pa.Table) -> pa.Table:
        first = t.column("depth")[0].as_py()
        levels, _, logs = subtree(t.column("key").to_numpy(), t.column("n").to_numpy(), first)
        ids = levels[0].ids
        return pa.table({"depth": np.full(len(ids), first, dtype=np.int32), "context": ids >> 8, "node": ids & 255, "n0": levels[0].n0.astype(np.int64), "n1": levels[0].n1.astype(np.int64), "logs": logs, "share": np.ones(len(ids))})

    nodes = written(table.sparkSession, near.groupBy("depth", "context").applyInArrow(sums, NODES), "nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    lowest, top = nodes, []
    for d in range(deepest - 1, -1, -1):
        up = written(table.sparkSession, raised(nodes, d), "above")
        top.append(up)
        nodes = nodes.where(F.col("depth") <= d).unionByName(up)
    split, high = lowest.limit(0), lowest.limit(0)
    for d, up in zip(range(deepest - 1, -1, -1), top, strict=True):
        split, high = (split.unionByName(up), high) if d > 1 else (split, high.unionByName(up))
    held = table.sparkSession.sparkContext.broadcast(Top(high.toArrow()))  # 257 * 255 rows at most

    def predict(t: pa.Table, above: pa.Table) -> pa.Table:
        first = t.column("depth")[0].as_py()
        key = t.column("key").to_numpy()
        levels, shares, _ = subtree(key, t.column("n").to_numpy(), first)
        p = levels[-1].estimate()
        for level, share in zip(levels[-2::-1], shares[-2::-1], strict=True):
            w = share[level.at]
            p = w * level.estimate() + (1 - w) * p
        if first > 2:
            p = Top(above).mix(key, levels[0].bit, p, range(first - 1, 1, -1))
        p = held.value.mix(key, levels[0].bit, p, range(1, -1, -1))
        key, at = np.unique(key, return_index=True)
        return pa.table({"key": key, "logp": np.log10(p).sum(axis=1)[at]})

    above = paths(near, split, deepest).groupBy("of", "at")
    out = written(table.sparkSession, near.groupBy("depth", "context").cogroup(above).applyInArrow(predict, "key long, logp double"), "lengths")
    discard(near, lowest, *top)
    return out


def score_texts(docs: DataFrame, holdout: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes) of every text."""
    spark = docs.sparkSession
    small_batches(spark, 500)

    def blocked(batches):
        block, size = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            n = np.cumsum(np.array([len(x or b"") for x in b.column(1).to_pylist()], dtype=np.int64)) + size
            size = int(n[-1]) if len(n) else size
            yield pa.record_batch([pa.array(block + n // BLOCK_CHARS), b.column(0), b.column(1).fill_null(b""), b.column(2)], names=["block", "doc_id", "text", "train"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary"), (id_mod("doc_id", holdout) != 0).alias("train"))
    blocks = written(spark, d.mapInArrow(blocked, "block long, doc_id long, text binary, train boolean"), "blocks")

    # Of a word or string, the blocks of LISTED partitions make one list, so no row grows with the corpus.
    lists = F.expr(f"(block >> 32) div {LISTED}")
    vocabulary = written(spark, word_counts(blocks).groupBy("word", lists.alias("list")).agg(F.sum("n").alias("n"), F.collect_set("block").alias("blocks")), "words")
    totals = written(spark, vocabulary.groupBy("word").agg(F.sum("n").alias("c")), "totals")
    trained = blocks.where("train").count()
    total, distinct = totals.agg(F.sum("c"), F.sum((F.col("c") > 0).cast("long"))).first()
    total, distinct = (total or 0) + trained, (distinct or 0) + (trained > 0)
    counts = written(spark, string_counts(blocks).groupBy("key", lists.alias("list")).agg(F.sum("n").alias("n"), F.collect_set("block").alias("blocks")), "strings")
    lengths = code_lengths(counts.select("key", "n"))
    release(spark)
    words = vocabulary.join(totals.hint("shuffle_merge"), "word").select(F.explode("blocks").alias("block"), "word", F.lit(None).cast("long").alias("key"), F.col("c").cast("double").alias("value"))
    keys = counts.join(lengths.hint("shuffle_merge"), "key").select(F.explode("blocks").alias("block"), F.lit(None).cast("binary").alias("word"), "key", F.col("logp").alias("value"))
    known = words.union(keys)
    low = math.log10(total + 0.1 * (distinct + 1))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"]

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        word, key = found.column("word").combine_chunks(), found.column("key").combine_chunks()
        value = found.column("value").to_numpy()
        count = dict(zip(word.drop_null().to_pylist(), value[np.asarray(word.is_valid())].tolist(), strict=True))
        at, logp = key.drop_null().to_numpy(), value[np.asarray(key.is_valid())]
        order = np.argsort(at)
        at, logp = at[order], logp[order]
        rows = []
        for part in parts(texts.column("text").to_pylist()):
            k, of = doc_strings(part)
            model = np.bincount(of, logp[np.searchsorted(at, k)], len(part))
            for t, m in zip(part, model.tolist(), strict=True):
                c = np.array([*map(count.__getitem__, t.lower().split()), trained])
                rows.append((len(c), int((c > 0).sum()), float(np.log10(c + 0.1).sum() - len(c) * low), m, len(t)))
        out = list(zip(*rows, strict=True))
        held = pa.array([not x for x in texts.column("train").to_pylist()])
        total_col = pa.array(np.full(len(rows), total))
        return pa.table([texts.column("doc_id"), held, pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), total_col, pa.array(out[2]), pa.array(out[3]), pa.array(out[4], pa.int64())], names=names)

    def safe(texts: pa.Table, found: pa.Table) -> pa.Table:
        if texts.num_rows:
            return score(texts, found)
        return pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *[(n, pa.int64()) for n in names[2:5]], ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())]).empty_table()

    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(safe, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")
