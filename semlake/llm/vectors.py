"""Embedding near-dedup by a random-projection tree forest.

TREES trees halve the vectors again and again by a random direction at the median of a sample (at most SAMPLE vectors,
those with the least hash), down to leaves of about LEAF of all vectors, however many there are: where a node is left
with fewer than 2 * FEW vectors of the sample, the nodes below go on by the medians of those. A vector within SPILL
standard deviations of a threshold goes to both sides, and within SPREAD / depth where the trees are deep, so that a
vector has no more than about 36 leaves however many vectors there are. Every vector is routed to its leaves; vectors are compared by
cosine, in double precision, within leaves. A pair that meets in
several leaves counts in the first of them only, so link counts are sums and no list of pairs is ever made: a leaf
returns each vector's links and a spanning forest of them. Equal vectors are one class, compared once. Leaves of more
than BLOCK vectors are compared in blocks, so that no task holds a leaf of any size.

Edge cases: a null vector, one of zero length or norm, or one with a null or non-finite component links with nothing;
vectors of different lengths do not link; rows of the same id are vectors of their own and a null id has a null
component; repeated rows are equal vectors; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, small_batches, written

TREES, LEAF, SAMPLE, FEW, SPILL, SPREAD, LEAST, BLOCK = 12, 256, 20_000, 16, 0.15, 1.35, 0.95, 4096
#: Leaves up to which their sizes are broadcast; beyond, they are joined by a shuffle.
BROADCAST_LEAVES = 500_000
MAX_SAMPLE_BYTES = 32 << 20


class Forest:
    """Per length of vectors: directions by (tree, level), thresholds by (tree, level, node down to the depth `known` that the sample can tell)."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.depth, self.trees = depth, trees
        self.known = max(0, min(depth, int(np.log2(max(1, len(sample) / FEW)))))
        d = sample.shape[1]
        self.directions = rng.standard_normal((d, trees * max(depth, 1)))
        self.directions /= np.linalg.norm(self.directions, axis=0)
        p = sample @ self.directions
        self.margin = min(SPILL, SPREAD / max(1, depth)) * (p.std(axis=0) if len(sample) else np.zeros(trees * max(depth, 1)))
        self.cuts = [[np.zeros(1 << min(level, self.known)) for level in range(depth)] for _ in range(trees)]
        for t in range(trees):
            row, node = np.arange(len(sample)), np.zeros(len(sample), dtype=np.int64)
            for level in range(depth):
                x = p[row, t * depth + level]
                order = np.argsort(node, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                    if len(part):
                        self.cuts[t][level][node[part[0]]] = np.median(x[part])
                if level < self.known:
                    row, node = self.step(t, level, x, row, node)

    def step(self, t, level, x, row, node):
        cut, margin = self.cuts[t][level][node >> max(0, level - self.known)], self.margin[t * self.depth + level]
        left, right = x < cut + margin, x >= cut - margin
        return np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])

    def leaves(self, vectors: np.ndarray) -> list[np.ndarray]:
        """The leaves (numbered over all trees) of each vector, ascending."""
        p = vectors @ self.directions
        rows, codes = [], []
        for t in range(self.trees):
            row, node = np.arange(len(vectors)), np.zeros(len(vectors), dtype=np.int64)
            for level in range(self.depth):
                row, node = self.step(t, level, p[row, t * self.depth + level], row, node)
            rows.append(row)
            codes.append(node + (t << self.depth))
        row, code = np.concatenate(rows), np.concatenate(codes)
        order = np.lexsort((code, row))
        return np.split(code[order], np.cumsum(np.bincount(row, minlength=len(vectors)))[:-1])


def units(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector scaled to length 1 in double precision, None where it cannot link."""
    out = []
    for v in column.to_pylist():
        x = np.array(v, dtype=np.float64) if v and None not in v else np.zeros(0)
        with np.errstate(over="ignore", invalid="ignore"):
            top = np.abs(x).max() if len(x) else 0.0
            out.append(x / top / np.linalg.norm(x / top) if len(x) and np.isfinite(top) and top > 0 else None)
    return out


def unite(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of a[i] and b[i] for all i; up holds each member's least fellow and is changed in place."""
    while len(a):
        p, q = up[a], up[b]
        apart = p != q
        a, b, p, q = a[apart], b[apart], p[apart], q[apart]
        np.minimum.at(up, np.maximum(p, q), np.minimum(p, q))
        while (up[up] != up).any():
            up[:] = up[up]


def near_vectors(embeddings: DataFrame, id_col: str = "vec_id", column: str = "embedding", least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of embeddings."""
    spark = embeddings.sparkSession
    small_batches(spark, 2000)

    def normed(batches):
        for b in batches:
            # Equal vectors as given (not merely of one direction) are a class; -0.0 counts as 0.0.
            us = units(b.column(1))
            raw = [None if u is None else xxhash.xxh3_128_digest((np.array(v, dtype=np.float64) + 0.0).tobytes()) for u, v in zip(us, b.column(1).to_pylist(), strict=True)]
            yield pa.record_batch([b.column(0), pa.array(raw, pa.binary()), pa.array([None if u is None else u.tobytes() for u in us], pa.binary())], names=["id", "sig", "unit"])

    rows = written(spark, embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(column).cast("array<double>")).mapInArrow(normed, "id long, sig binary, unit binary"), "units")
    classes = rows.where("sig is not null").groupBy("sig").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min("unit").alias("unit"))
    classes = written(spark, classes.withColumn("node", F.xxhash64("sig")), "classes")

    # A forest for each length of vectors.
    count = {r.d: r.n for r in classes.groupBy(F.octet_length("unit").alias("d")).agg(F.count("*").alias("n")).collect()}  # one row a length
    forests = {}
    for d, n in count.items():
        if n <= LEAF:  # one leaf: nothing to fit
            forests[d] = Forest(np.zeros((0, d // 8)), 0)
            continue
        most = max(64, min(SAMPLE, MAX_SAMPLE_BYTES // d))
        sample = [r.unit for r in classes.where(F.octet_length("unit") == d).orderBy(F.xxhash64("node"), "node").select("unit").limit(most).collect()]
        x = np.frombuffer(b"".join(bytes(s) for s in sample), dtype=np.float64).reshape(len(sample), d // 8)
        forests[d] = Forest(x, max(0, int(np.ceil(np.log2(max(1, n) / LEAF)))))
    held = spark.sparkContext.broadcast(forests)  # thresholds and directions only, bounded by the sample

    def route(batches):
        for b in batches:
            units = b.column(2).to_pylist()
            by: dict[int, list[int]] = {}
            for i, u in enumerate(units):
                by.setdefault(len(u), []).append(i)
            for d, which in by.items():
                leaves = held.value[d].leaves(np.frombuffer(b"".join(units[i] for i in which), dtype=np.float64).reshape(len(which), d // 8))
                part = b.take(pa.array(which))
                yield pa.record_batch([*part.columns, pa.array([d] * len(which)), pa.array(leaves, pa.list_(pa.int64()))], names=["node", "copies", "unit", "d", "leaves"])

    routed = classes.select("node", "copies", "unit").mapInArrow(route, "node long, copies long, unit binary, d long, leaves array<long>")
    routed = written(spark, routed, "routed")
    each = routed.select("d", F.explode("leaves").alias("leaf"), "node", "copies", "unit", "leaves")
    sizes = written(spark, routed.select("d", F.explode("leaves").alias("leaf")).groupBy("d", "leaf").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "leaves")
    few = sizes.count() <= BROADCAST_LEAVES
    each = each.join(F.broadcast(sizes) if few else sizes.hint("shuffle_merge"), ["d", "leaf"]).withColumn("own", F.pmod("node", "blocks"))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least("own", k).alias("x"), F.greatest("own", k).alias("y")))
    each = each.select("d", "leaf", "own", "node", "copies", "unit", "leaves", F.explode(pair).alias("pair")).select("d", "leaf", "pair.x", "pair.y", "own", "node", "copies", "unit", "leaves")

    def compare(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        leaf, x, y = (t.column(c)[0].as_py() for c in ("leaf", "x", "y"))
        node, copies, own = (t.column(c).to_numpy() for c in ("node", "copies", "own"))
        unit = np.frombuffer(b"".join(t.column("unit").to_pylist()), dtype=np.float64).reshape(t.num_rows, -1)
        # Leaves before this one that two members share: such a pair counts there.
        lists = t.column("leaves").combine_chunks()
        of, codes = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
        of, codes = of[codes < leaf], codes[codes < leaf]
        names, codes = np.unique(codes, return_inverse=True)
        members = np.zeros((t.num_rows, len(names)), dtype=bool)
        members[of, codes] = True
        members = np.packbits(members, axis=1)
        step = max(1, (4 << 20) // max(1, members.shape[1]))
        links, up = np.zeros(t.num_rows, dtype=np.int64), np.arange(t.num_rows)
        for k in range(0, t.num_rows, 512):
            near = unit[k : k + 512] @ unit.T >= least
            i, j = np.nonzero(near)
            ok = i + k < j
            if x != y:
                ok &= own[i + k] != own[j]
            i, j = i[ok] + k, j[ok]
            for s in range(0, len(i), step):
                a, b = i[s : s + step], j[s : s + step]
                first = ~(members[a] & members[b]).any(axis=1)
                a, b = a[first], b[first]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                unite(up, a, b)
        has = np.flatnonzero(links)
        return pa.table({"node": node[has], "links": links[has], "up": node[up[has]]})

    found = written(spark, each.groupBy("d", "leaf", "x", "y").applyInArrow(compare, "node long, links long, up long"), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(spark, found.where("node <> up").select(F.col("node").alias("a"), F.col("up").alias("b")))
    info = classes.select("node", "sig", "rep", "copies").join(links.hint("shuffle_merge"), "node", "left").join(parts.withColumnRenamed("id", "node").hint("shuffle_merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    info = written(spark, info, "info")
    discard(routed, sizes, found)
    low = info.groupBy("comp").agg(F.min("rep").alias("component_id"))
    info = info.join(low.hint("shuffle_merge"), "comp").select("sig", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "sig").join(info.hint("shuffle_merge"), "sig", "left").select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
