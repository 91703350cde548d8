"""A Merkle manifest of a dataset, and proofs of its rows by octopus multiproofs.

Every row is a leaf. Per language the leaves, in doc_id order, form a tree of runs of eight; the languages' roots form
one more tree in the same way. The manifest is two tables: the leaves with their places, and the nodes above them.

Places come from one range exchange of the digests (no text goes along) and the prefix sums of what each of its parts
holds, so a language of any size is spread over all tasks. A block is 4,096 neighbouring leaves. For the leaves that
are asked of a block, the multiproof is the least set of nodes that must be known besides them: level by level the
children of the asked runs that are neither asked nor derived. These places are fetched once a block by one join with
the nodes; then the block derives the shared interior nodes and writes out each leaf's own proof from them.

Edge cases: a null value is '-', so a null text and an empty one are different leaves. A null lang is a language of its
own and comes first. Rows without an id come first in their language; equal ids go by their leaf; rows equal in all are
leaves side by side, in any order (their proofs differ, the set of rows does not). Very long texts are hashed by Spark
where they are read. An empty table gives an empty result; other columns are no part of a leaf and not returned. A null
id counts as empty text where tampering is chosen.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_mod, ship, written

#: Children of a node, and levels of one block (so 4,096 leaves).
RUN, DEPTH = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows up to which a table of totals (languages, parts) is broadcast; beyond, it is joined by a shuffle.
FEW = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NODE_SCHEMA = "grp string, level int, pos long, h string"
#: The tree of the languages' roots; the languages' own trees are named '0' (null) or '1' and the language.
TOP = ""


def leaf_of(*values: Column) -> Column:
    """SHA-256 in hex of values: '-' for null, else the number of UTF-8 bytes, ':' and the value."""
    part = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return F.sha2(F.concat(*[part(v.cast("string")) for v in values]).cast("binary"), 256)


def levels(n: Column) -> Column:
    """How often n nodes must be run together until one is left."""
    powers = F.array(*[F.lit(RUN**k).cast("long") for k in range(21)])
    return F.size(F.filter(powers, lambda x: x < n))


def few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= FEW else df.hint("shuffle_merge")


def numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """rows with pos (from 0, within grp, in order of `by`) and n, the number of the group's rows; a written table."""
    spark = rows.sparkSession
    tied = rows.withColumn("tie", F.monotonically_increasing_id())  # equal rows of any number spread over parts
    s = tied.repartitionByRange("grp", *by, "tie").sortWithinPartitions("grp", *by, "tie").drop("tie").withColumn("at", F.monotonically_increasing_id())
    s = written(spark, s.withColumn("part", F.shiftright("at", 33)), name)
    held = s.groupBy("grp", "part").agg(F.min("at").alias("low"), F.count("*").alias("m"))
    up = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("before", F.coalesce(F.sum("m").over(up), F.lit(0))).withColumn("n", F.sum("m").over(Window.partitionBy("grp")))
    held = written(spark, held, f"{name}-parts")
    return s.join(few(held), ["grp", "part"]).withColumn("pos", F.col("before") + F.col("at") - F.col("low")).drop("at", "part", "low", "m", "before")


def grown(block: pa.Table, depth: int) -> pa.Table:
    """The nodes above one block of leaves, `depth` levels or up to the group's root."""
    grp, n = block["grp"][0].as_py(), block["n"][0].as_py()
    here = dict(zip(block["pos"].to_pylist(), block["h"].to_pylist()))
    out = []
    for level in range(1, depth + 1):
        if n <= 1:
            break
        n = -(-n // RUN)
        runs: dict[int, list[str]] = {}
        for pos in sorted(here):
            runs.setdefault(pos // RUN, []).append(here[pos])
        here = {r: sha256("".join(hs).encode()).hexdigest() for r, hs in runs.items()}
        out += [(grp, level, r, h) for r, h in here.items()]
    return pa.table([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.string()))], names=["grp", "level", "pos", "h"])


def tree(leaves: DataFrame, name: str, depth: int) -> DataFrame:
    """(grp, level, pos, h): all nodes above leaves (grp, pos, n, h): blocks first, then level by level."""
    spark = leaves.sparkSession
    ship(spark)
    low = leaves.select("grp", "pos", "n", "h").withColumn("block", F.expr(f"pos div {RUN**depth}"))
    nodes = written(spark, low.groupBy("grp", "block").applyInArrow(lambda t: grown(t, depth), NODE_SCHEMA), name)
    sizes = leaves.groupBy("grp").agg(F.first("n").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    if most <= RUN**depth:
        return nodes
    wide = written(spark, sizes.where(F.col("n") > RUN**depth), f"{name}-sizes")
    last = nodes.where(F.col("level") == depth).join(few(wide), "grp")
    level, all_nodes = depth, nodes
    while RUN**level < most:
        level += 1
        runs = last.where(F.col("n") > RUN ** (level - 1)).groupBy("grp", "n", F.expr(f"pos div {RUN}").alias("pos")).agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("k"), "h"))).alias("hs"))
        last = written(spark, runs.select("grp", F.lit(level).alias("level"), "pos", F.sha2(F.array_join(F.col("hs.h"), "").cast("binary"), 256).alias("h"), "n"), name)
        all_nodes = all_nodes.unionByName(last.drop("n"))
    return all_nodes


@dataclass
class Manifest:
    """leaves (grp, pos, n, doc_id, h, changed), nodes (grp, level, pos, h; TOP's level 0 are the roots), groups (grp, gpos, groups, subroot, root)."""

    leaves: DataFrame
    nodes: DataFrame
    groups: DataFrame
    depth: int


def manifest(docs: DataFrame, depth: int = DEPTH) -> Manifest:
    """The manifest of a table of documents, worked out by blocks of `depth` levels; `changed` is the leaf after tampering, where a row is tampered with."""
    spark = docs.sparkSession
    d = docs.select(*[F.col(c).alias(c) for c in FIELDS])
    values = [F.col(c) for c in FIELDS]
    tampered = F.when(id_mod("doc_id", 3) == 0, leaf_of(*values[:-1], F.translate("text", UPPER, LOWER)))
    grp = F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0"))
    rows = written(spark, d.select(grp.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(*values).alias("h"), tampered.alias("changed")), "leaves")
    leaves = numbered(rows, ["doc_id", "h"], "places")
    nodes = tree(leaves, "nodes", depth)
    alone = leaves.where("n = 1").select("grp", "h")
    sizes = written(spark, leaves.groupBy("grp").agg(F.first("n").alias("n")), "sizes")
    heads = nodes.join(few(sizes), "grp").where((F.col("level") == levels(F.col("n"))) & (F.col("pos") == 0)).select("grp", "h")
    subroots = numbered(heads.unionByName(alone).select(F.lit(TOP).alias("grp"), F.col("grp").alias("own"), "h"), ["own"], "subroots")
    above = tree(subroots, "top", depth)
    root = above.join(F.broadcast(subroots.agg(F.max("n").alias("n"))), F.col("level") == levels(F.col("n"))).where("pos = 0").select(F.col("h").alias("root"))  # by one row
    root = root.unionByName(subroots.where("n = 1").select(F.col("h").alias("root")))
    groups = subroots.select(F.col("own").alias("grp"), F.col("pos").alias("gpos"), F.col("n").alias("groups"), F.col("h").alias("subroot")).crossJoin(F.broadcast(root))  # by one row
    bottom = subroots.select("grp", F.lit(0).alias("level"), "pos", "h")
    return Manifest(leaves, nodes.unionByName(above).unionByName(bottom), written(spark, groups, "groups"), depth)


def missing(pos: np.ndarray, n: int) -> list[tuple[int, np.ndarray]]:
    """(level, places) of the least set of nodes that, with the leaves at pos (sorted), give the root of a tree of n leaves."""
    out, level = [], 0
    while n > 1:
        runs = np.unique(pos // RUN)
        children = (runs[:, None] * RUN + np.arange(RUN)).ravel()
        out.append((level, np.setdiff1d(children[children < n], pos, assume_unique=True)))
        pos, n, level = runs, -(-n // RUN), level + 1
    return out


def wanted(block: pa.Table) -> pa.Table:
    """The places that one block fetches: of its own tree, and of the tree of languages."""
    grp, b, n, gpos, groups = (block[c][0].as_py() for c in ("grp", "block", "n", "gpos", "groups"))
    found = [(grp, level, p) for level, places in missing(np.unique(block["pos"].to_numpy()), n) for p in places.tolist()]
    found += [(TOP, level, p) for level, places in missing(np.array([gpos]), groups) for p in places.tolist()]
    cols = [pa.array([grp] * len(found), pa.string()), pa.array([b] * len(found), pa.int64())]
    cols += [pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64()))]
    return pa.table(cols, names=["own", "block", "grp", "level", "pos"])


PROOF_SCHEMA = "grp string, pos long, doc_id long, leaf string, proof_sha256 string, folded_root string"


class Known:
    """The nodes of one tree that a block knows, and what follows from them."""

    def __init__(self, n: int):
        self.sizes = [n]
        while self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // RUN))
        self.nodes: list[dict[int, str]] = [{} for _ in self.sizes]
        self.runs: list[dict[int, bytes]] = [{} for _ in self.sizes]

    def derive(self, pos: list[int]) -> str:
        """All nodes above the leaves at pos; the root."""
        for level in range(len(self.sizes) - 1):
            pos = sorted({p // RUN for p in pos})
            for r in pos:
                run = "".join(self.nodes[level][k] for k in range(r * RUN, min(r * RUN + RUN, self.sizes[level]))).encode()
                self.runs[level][r] = run
                self.nodes[level + 1][r] = sha256(run).hexdigest()
        return self.nodes[-1][0]

    def path(self, pos: int) -> list[tuple[bytes, bytes]]:
        """(left, right) siblings of a leaf, level by level."""
        out = []
        for level in range(len(self.sizes) - 1):
            run, k = self.runs[level][pos // RUN], pos % RUN * 64
            out.append((run[:k], run[k + 64 :]))
            pos //= RUN
        return out


def proved(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
    """The proofs of one block's leaves, expanded from what it has and what it fetched."""
    if not leaves.num_rows:
        return pa.table({c: pa.array([], t) for c, t in zip(("grp", "pos", "doc_id", "leaf", "proof_sha256", "folded_root"), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))})
    grp, n, gpos, groups = (leaves[c][0].as_py() for c in ("grp", "n", "gpos", "groups"))
    own, top = Known(n), Known(groups)
    for g, level, p, h in zip(*(fetched[c].to_pylist() for c in ("grp", "level", "pos", "h"))):
        (top if g == TOP else own).nodes[level][p] = h
    pos, hs = leaves["pos"].to_pylist(), leaves["h"].to_pylist()
    own.nodes[0].update(zip(pos, hs))
    top.nodes[0][gpos] = own.derive(pos)
    top.derive([gpos])
    upper = top.path(gpos)
    proofs, folded = [], []
    for p, h, other in zip(pos, hs, leaves["changed"].to_pylist()):
        path = own.path(p) + upper
        proofs.append(sha256(b"".join(a + b for a, b in path)).hexdigest())
        at = (h if other is None else other).encode()
        for a, b in path:
            at = sha256(a + at + b).hexdigest().encode()
        folded.append(at.decode())
    return pa.table({"grp": leaves["grp"], "pos": leaves["pos"], "doc_id": leaves["doc_id"], "leaf": leaves["h"], "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string())})


def proofs(spark: SparkSession, m: Manifest, asked: DataFrame | None = None) -> DataFrame:
    """Proofs of all leaves, or of those whose doc_id is in asked (doc_id): leaf, subroot, root, proof_sha256, folded_root, verified."""
    ship(spark)
    leaves, nodes = m.leaves, m.nodes
    if asked is not None:  # then a block lacks leaves of its own, too
        nodes = nodes.unionByName(leaves.select("grp", F.lit(0).alias("level"), "pos", "h"))
        leaves = leaves.join(asked.select("doc_id").distinct().hint("shuffle_merge"), "doc_id", "left_semi")
    d = leaves.join(few(m.groups), "grp").select("grp", "pos", "n", "gpos", "groups", "doc_id", "h", "changed", F.expr(f"pos div {RUN**m.depth}").alias("block"))
    need = written(spark, d.select("grp", "block", "pos", "n", "gpos", "groups").groupBy("grp", "block").applyInArrow(wanted, "own string, block long, grp string, level int, pos long"), "coordinates")
    got = written(spark, need.join(nodes.hint("shuffle_merge"), ["grp", "level", "pos"]), "fetched")
    out = d.groupBy("grp", "block").cogroup(got.groupBy("own", "block")).applyInArrow(proved, PROOF_SCHEMA)
    out = out.join(few(m.groups.select("grp", "subroot", "root")), "grp")
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), F.expr("if(grp = '0', null, substring(grp, 2))").alias("lang"), "pos")


def verify_rows(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Every row's proof in the manifest of docs, folded from its leaf after tampering where it is tampered with."""
    return proofs(docs.sparkSession, manifest(docs, depth))


_PART = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode(CAST({0} AS VARCHAR))) || ':' || {0} END"
_LEAF = lambda text: "sha256(" + " || ".join(_PART.format(c) for c in (*FIELDS[:-1], text)) + ")"
_CHILD = """SELECT grp, level, pos, k, coalesce(string_agg(h, '') OVER (PARTITION BY grp, level, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
  coalesce(string_agg(h, '') OVER (PARTITION BY grp, level, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b"""
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS grp, {_LEAF("text")} AS h, {_LEAF(f"translate(text, '{UPPER}', '{LOWER}')")} AS low FROM documents),
z AS (SELECT i, CAST(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(i AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda c, x: list_reduce(list_prepend(xor(c, x), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda v, y: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)) AS BIGINT) AS c
  FROM (SELECT DISTINCT doc_id AS i FROM documents)),
l AS (
  SELECT doc_id, grp, h, CASE WHEN xor(z.c, 4294967295) % 3 = 0 THEN low ELSE h END AS changed,
    row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM d JOIN z ON d.doc_id = z.i),
t AS (
  SELECT grp, 0 AS level, pos, h, n AS k FROM l
  UNION ALL SELECT grp, any_value(level) + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(k) + 7) // 8 FROM t WHERE k > 1 GROUP BY grp, pos // 8),
s AS (SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM t WHERE k = 1),
u AS (
  SELECT 0 AS level, pos, h, n AS k FROM s
  UNION ALL SELECT any_value(level) + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(k) + 7) // 8 FROM u WHERE k > 1 GROUP BY pos // 8),
c AS ({_CHILD} FROM (SELECT * FROM t WHERE k > 1 UNION ALL SELECT '' AS grp, level, pos, h, k FROM u WHERE k > 1)),
p AS (
  SELECT grp, pos AS leaf_pos, grp AS at, 0 AS level, pos, changed AS h, '' AS sibs, n AS k, 0 AS done FROM l
  UNION ALL
  SELECT p.grp, p.leaf_pos, CASE WHEN p.k > 1 THEN p.at ELSE '' END, CASE WHEN p.k > 1 THEN p.level + 1 ELSE 0 END, CASE WHEN p.k > 1 THEN p.pos // 8 ELSE s.pos END,
    CASE WHEN p.k > 1 THEN sha256(c.a || p.h || c.b) ELSE p.h END, CASE WHEN p.k > 1 THEN p.sibs || c.a || c.b ELSE p.sibs END, CASE WHEN p.k > 1 THEN (p.k + 7) // 8 ELSE s.n END,
    CASE WHEN p.k > 1 THEN p.done ELSE p.done + 1 END
  FROM p LEFT JOIN c ON p.at = c.grp AND p.level = c.level AND p.pos = c.pos LEFT JOIN s ON s.grp = p.grp
  WHERE p.k > 1 OR p.done = 0)
SELECT l.doc_id AS doc_id, l.h AS leaf, s.h AS subroot, u.h AS root, sha256(p.sibs) AS proof_sha256, p.h AS folded_root, p.h = u.h AS verified,
  CASE WHEN l.grp <> '0' THEN substring(l.grp, 2) END AS lang, l.pos AS pos
FROM l JOIN p ON p.grp = l.grp AND p.leaf_pos = l.pos AND p.k = 1 AND p.done = 1 JOIN s ON s.grp = l.grp JOIN (SELECT h FROM u WHERE k = 1) u ON true
"""
