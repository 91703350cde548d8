"""N-gram Jaccard join by a token-group matrix.

A text's set is its distinct shingles of WORDS lower-case words (64-bit hashes); two texts link when
100 * |intersection| >= 75 * |union|. Texts with equal sets are one class, of which the least id stands for all.

1. Every set is put in one global order, rarest shingles first, by a count-min sketch of the corpus (log scale, then
   hash), and its first n/4 + 1 shingles are kept: two linked sets of sizes n <= m share a shingle among those.
2. Groups: sets that share a kept shingle are compared with one of them only, the one with the fewest rarer shingles
   (of copies with small changes, the one with the fewest changes), and the links found so far form groups of similar
   documents. Members of one group need no further comparison.
3. The token-group matrix holds, per kept shingle, the groups whose union has it. A query's overlap with a group is at
   most what either has left from the first shingle they share; only groups that reach the least overlap a link needs
   are opened, there, and their members are bounded in the same way, then compared whole.

So no link between different groups is lost, and pairs within a group are never enumerated.

Edge cases: a null or empty text, or one without words, has an empty set and links with nothing; a text of fewer than
WORDS words has one shingle, all of it; rows with the same id and other texts are told apart until the end, where their
classes are joined, as links reach an id; a null id is kept apart from all and has a null component; repeated rows come
back as often as they came; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, mix64, release, small_batches, written

WORDS = 5
#: Bounds of the sketch's width: it follows the corpus, a byte a counter when broadcast.
LEAST_BITS, MOST_BITS, CHUNK_BITS = 16, 24, 14

BASE = np.uint64(0x9E3779B97F4A7C15)
BYTE = mix64(np.arange(1, 257, dtype=np.uint64))
BYTE[65:91] = BYTE[97:123]  # A-Z count as a-z
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and its inverse modulo 2**64, for k below n."""
    out = []
    for x in (int(BASE), pow(int(BASE), -1, 1 << 64)):
        p = np.full(n, x, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct hashed shingles of each text, worked out side by side."""
    out = [np.zeros(0, dtype=np.uint64)] * len(texts)
    k = 0
    while k < len(texts):  # about a megabyte, or one longer text, at a time
        size, j = 0, k
        while j < len(texts) and (j == k or size + len(texts[j]) < 1 << 20):
            size += len(texts[j]) + 1
            j += 1
        data = np.frombuffer(b" ".join(texts[k:j]) + b" ", dtype=np.uint8)
        gap = SPACE[data]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        edge = edge if gap[0] else np.concatenate([[0], edge])
        start, end = edge[::2], edge[1::2]
        up, down = powers(len(data))
        h = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(BYTE[data] * up, dtype=np.uint64)])
        words = mix64((h[end] - h[start]) * down[start] + (end - start).astype(np.uint64))
        n = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts[k:j]]))
        rolled = np.zeros(max(0, len(words) - WORDS + 1), dtype=np.uint64)
        for w in range(WORDS):
            rolled = mix64(rolled + words[w : w + len(rolled)])
        first = 0
        for i, last in enumerate(n.tolist(), k):
            if last - first >= WORDS:
                out[i] = np.unique(rolled[first : last - WORDS + 1])
            elif last > first:
                x = np.array([last - first], dtype=np.uint64)
                for w in words[first:last]:
                    x = mix64(x + w)
                out[i] = x
            first = last
        k = j
    return out


def sketch(docs: DataFrame, bits: int) -> np.ndarray:
    """log2 (rounded down) of a count-min counter per hash place, one byte each; summed by Spark, chunk by chunk."""

    def count(batches):
        total = np.zeros(1 << bits, dtype=np.int64)
        for b in batches:
            found = shingle_sets([t for t in b.column(0).to_pylist() if t])
            if found:
                total += np.bincount((np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        step = 1 << min(bits, CHUNK_BITS)
        for k in range(0, 1 << bits, step):
            part = total[k : k + step]
            at = np.flatnonzero(part)
            if len(at):
                yield pa.record_batch([pa.array([k // step]), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([np.minimum(part[at], 2**32 - 1).astype("<u4").tobytes()], pa.binary())], names=["chunk", "at", "n"])

    def add(key, batches):
        total = np.zeros(1 << min(bits, CHUNK_BITS), dtype=np.int64)
        for b in batches:
            for at, n in zip(b.column("at").to_pylist(), b.column("n").to_pylist(), strict=True):
                total[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<u4")
        level = np.ceil(np.log2(total + 1)).astype(np.uint8)
        yield pa.record_batch([pa.array([key[0].as_py()]), pa.array([level.tobytes()], pa.binary())], names=["chunk", "level"])

    parts = docs.select(F.col("text").cast("binary")).mapInArrow(count, "chunk long, at binary, n binary")
    levels = np.zeros(1 << bits, dtype=np.uint8)
    step = 1 << min(bits, CHUNK_BITS)
    for r in parts.groupBy("chunk").applyInArrow(_streamed(add), "chunk long, level binary").collect():  # 2**bits bytes at most
        levels[r.chunk * step : (r.chunk + 1) * step] = np.frombuffer(r.level, np.uint8)
    return levels


def _streamed(f):
    """f(key, batches) with the annotations by which Spark hands a group over batch by batch."""
    from collections.abc import Iterator

    f.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return f


def features(docs: DataFrame, levels: np.ndarray, bits: int, token_bits: int) -> DataFrame:
    """(id, n, sig, kept): the size of each text's set, a 128-bit signature of it, and its first n/4 + 1 shingles.

    Kept shingles are cut to their first token_bits bits: where two meet, bounds are looser and no link is lost."""
    held = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        for b in batches:
            n, sig, kept = [], [], []
            for s in shingle_sets([t or b"" for t in b.column(1).to_pylist()]):
                order = np.argsort(held.value[(s >> np.uint64(64 - bits)).astype(np.int64)], kind="stable")
                n.append(len(s))
                sig.append(xxhash.xxh3_128_digest(s.tobytes()))
                kept.append((s[order[: len(s) - needed(len(s)) + 1 if len(s) else 0]] >> np.uint64(64 - token_bits)).view(np.int64))
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(kept, pa.list_(pa.int64()))], names=["id", "n", "sig", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary")).mapInArrow(run, "id long, n long, sig binary, kept array<long>")


def needed(n: int) -> int:
    """The least overlap of a set of n with any linked one: 3/4 of it, rounded up."""
    return (3 * n + 3) // 4


#: The least intersection of linked sets of sizes n and m: 100 i >= 75 (n + m - i).
ALPHA = "((3 * ({n} + {m}) + 6) div 7)"
#: An upper bound of the intersection: kept shingles in common, and those after the kept ones of one side.
BOUND = "{c} + greatest((3 * {n} + 3) div 4, (3 * {m} + 3) div 4) - 1"
SIZES = "4 * {n} >= 3 * {m} and 4 * {m} >= 3 * {n}"


#: (i, q, n) as one number of at most 38 digits, and back; i and n are below 10**9, as a text has at most 2**31 bytes.
BIG, SIZE = 1 << 64, 10**9
PACK = f"(cast(i as decimal(38,0)) * {BIG}BD + cast(q as decimal(38,0)) + {BIG // 2}BD) * {SIZE}BD + cast(n as decimal(38,0))"
UNPACK = (
    f"cast((low - low % {SIZE}BD) / {SIZE}BD as decimal(38,0)) as rest", f"cast(low % {SIZE}BD as int) as pn"
), (f"cast(rest % {BIG}BD - {BIG // 2}BD as long) as p", "pn", f"cast((rest - rest % {BIG}BD) / {BIG}BD as int) as pi")


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts link; texts: (id, text) of at least their ids."""
    small_batches(pairs.sparkSession, 200)

    def check(batches):
        for b in batches:
            same = []
            texts = list(dict.fromkeys(x or b"" for c in (2, 3) for x in b.column(c).to_pylist()))
            known = dict(zip(texts, shingle_sets(texts), strict=True))
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = known[x or b""], known[y or b""]
                both = np.intersect1d(x, y, assume_unique=True).size
                same.append(both > 0 and 100 * both >= 75 * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(same, pa.bool_()))

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    both = pairs.join(left.hint("shuffle_merge"), "a").join(right.hint("shuffle_merge"), "b").select("a", "b", F.col("x").cast("binary"), F.col("y").cast("binary"))
    return both.mapInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(size / 512 + 1)), LEAST_BITS, MOST_BITS))
    token_bits = int(np.clip(np.ceil(np.log2(size / 6 + 1)) + 14, 40, 63))
    levels = sketch(docs, bits)
    release(spark)
    full = written(spark, features(docs, levels, bits, token_bits), "features")
    held = written(spark, full.select("id", "n", "sig"), "sets")

    # Classes of equal sets; the least id stands for one.
    some = held.where("n > 0 and id is not null").select("id", "sig", "n")
    classes = some.groupBy("sig").agg(F.min("id").alias("rep"), F.first("n").alias("n"))
    # A class goes by its id, or by a number below zero if the id stands for several (an id with several texts).
    several = classes.groupBy("rep").agg(F.count("*").alias("k"))
    classes = classes.join(several.hint("shuffle_merge"), "rep")
    q = F.when(F.col("k") > 1, F.xxhash64("rep", "sig").bitwiseOR(F.lit(-(2**63)))).otherwise(F.col("rep"))
    classes = written(spark, classes.withColumn("q", q).select("sig", "rep", "n", "q"), "classes")
    release(spark)
    reps = full.select("id", "sig", "kept").where("size(kept) > 0").join(classes.select(F.col("rep").alias("id"), "sig", "q", "n").hint("shuffle_merge"), ["id", "sig"])
    ids = held.where("id is not null").select("id")
    unique = ids.count() == ids.distinct().count()
    tokens = reps if unique else reps.dropDuplicates(["q"])
    tokens = tokens.select("q", F.col("n").cast("int").alias("n"), F.posexplode("kept").alias("i", "token"))
    # The set in which a shingle comes earliest stands for it: (i, q, n) as one number, so that the least is found by a
    # hash aggregate, combined before the exchange. Shingles of one set go; the rest is joined back, and AQE splits a hot one.
    least = tokens.groupBy("token").agg(F.min(F.expr(PACK)).alias("low"), F.count("*").alias("k")).where("k > 1").selectExpr("token", *UNPACK[0]).selectExpr("token", *UNPACK[1])
    least = written(spark, least, "least")
    release(spark)
    grid = kept = written(spark, tokens.join(least.hint("shuffle_merge"), "token").select("token", "q", "n", "i", "p", "pn", "pi"), "grid")
    discard(least)
    discard(full)
    release(spark)

    named = grid.select("q").distinct().join(classes.select("q", "rep", "sig").hint("shuffle_merge"), "q")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text")).join(named.hint("shuffle_merge"), "rep")
    texts = texts.select(F.col("q").alias("id"), "text", "sig")
    texts = written(spark, texts.select("id", "text") if unique else _own_text(texts), "texts")
    release(spark)

    near = SIZES.format(n="n", m="pn") + " and n - i >= " + ALPHA.format(n="n", m="pn") + " and pn - pi >= " + ALPHA.format(n="n", m="pn")
    stars = grid.where("q <> p").where(near).groupBy("p", "q").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("pn").alias("pn"))
    stars = stars.where(f"4 * ({BOUND.format(c='c', n='n', m='pn')}) >= 3 * {ALPHA.format(n='n', m='pn')}").select(F.col("p").alias("a"), F.col("q").alias("b"))
    links = stars = written(spark, compared(stars, texts), "stars")
    release(spark)

    groups = components(spark, links)
    rows = grid.select("token", "q", "n", "i").join(groups.select(F.col("id").alias("q"), "comp").hint("shuffle_merge"), "q", "left").withColumn("comp", F.coalesce("comp", "q"))
    rows = written(spark, rows, "rows")
    discard(kept)
    release(spark)
    pairs = _opened(spark, rows)
    discard(rows)
    opened = written(spark, compared(pairs, texts), "opened")
    discard(pairs, texts)
    links = links.union(opened)
    release(spark)

    # Back to ids: classes tied by links, by equal sets and by ids with several texts.
    tag = classes.select("q", "rep").where("q <> rep")
    ties = links.select("a", "b").union(tag.select(F.col("q").alias("a"), F.col("rep").alias("b")))
    comp = components(spark, ties)
    discard(stars, opened)
    low = comp.join(classes.select(F.col("q").alias("id"), "rep").hint("shuffle_merge"), "id").groupBy("comp").agg(F.min("rep").alias("low"))
    comp = comp.join(low.hint("shuffle_merge"), "comp").select(F.col("id").alias("q"), "low")
    of = classes.join(comp.hint("shuffle_merge"), "q", "left").select("sig", F.coalesce("low", "rep").alias("comp"))
    if unique:
        out = held.select("id", "n", "sig").join(written(spark, of, "of").hint("shuffle_merge"), "sig", "left")
    else:  # an id in several classes ties them
        named_ids = held.where("n > 0 and id is not null").select("id", "sig").distinct().join(of.hint("shuffle_merge"), "sig")
        tied = components(spark, named_ids.select(F.col("id").alias("a"), F.col("comp").alias("b")))
        out = held.select("id", "n").join(tied.hint("shuffle_merge"), "id", "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("comp", "id")).otherwise(F.col("id")).alias("component_id"))


def _own_text(rows: DataFrame) -> DataFrame:
    """(id, text) where the text's set has the signature asked for (an id may have several texts)."""

    def run(batches):
        for b in batches:
            t = b.column(1).to_pylist()
            ok = [xxhash.xxh3_128_digest(x.tobytes()) == s for x, s in zip(shingle_sets([x or b"" for x in t]), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.string())], names=["id", "text"]).filter(pa.array(ok, pa.bool_()))

    return rows.select("id", F.col("text").cast("binary"), "sig").mapInArrow(run, "id long, text string").dropDuplicates(["id"])


def _opened(spark, rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of different groups that may link: query by group first, then by member of the groups opened."""
    matrix = lambda d: d.groupBy("token", F.col("comp").alias("g")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("i")).alias("room"))
    # Shingles of one group only have no partner: leave their rows out before the join.
    several = matrix(rows).groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token")
    open_rows = written(spark, rows.join(several.hint("shuffle_merge"), "token", "left_semi"), "open")
    # No overlap is larger than what is left of either set from the first shared shingle on; a link with the smallest
    # possible member needs the least.
    least = ALPHA.format(n="n", m="greatest(low, (3 * n + 3) div 4)")
    hits = open_rows.join(matrix(open_rows).hint("shuffle_merge"), "token").where(f"comp <> g and 4 * n >= 3 * low and 4 * high >= 3 * n and n - i >= {least} and room >= {least}")
    asked = hits.select("q", "g", "token", "n", "i")
    member = open_rows.select("token", F.col("q").alias("y"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("comp").alias("g"))
    alpha = ALPHA.format(n="n", m="m")
    pairs = asked.join(member.hint("shuffle_merge"), ["token", "g"]).where(f"q < y and {SIZES.format(n='n', m='m')} and n - i >= {alpha} and m - j >= {alpha}")
    pairs = written(spark, pairs.select(F.col("q").alias("a"), F.col("y").alias("b")).distinct(), "pairs")
    discard(open_rows)
    return pairs


ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {WORDS} THEN list_transform(range(len(w) - {WORDS - 1}), lambda i: array_to_string(list_slice(w, i + 1, i + {WORDS}), ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT c.a, c.b FROM c JOIN n x ON c.a = x.doc_id JOIN n y ON c.b = y.doc_id WHERE 100 * i >= 75 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id AS doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) m ON d.doc_id = m.a
"""
