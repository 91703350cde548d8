"""Exact dedup by a cuckoo-filter index over the digests of live texts.

A text's digest (SHA-256 of its UTF-8 bytes) belongs to one shard of the index. A shard holds a cuckoo filter: buckets
of four 16-bit fingerprints, each fingerprint in one of two buckets, and beside every slot the full digest that stands
there, with the number of its live copies and the id that stays. A lookup reads two buckets; a fingerprint that matches
is a hit only when the digest stored beside it is equal, so a false hit is told from a true one. A digest that finds no
slot after `KICKS` moves makes the filter double and be filled again from the stored digests. Copies that go are
counted off; the last one clears its slot.

The index is a table (a row a live digest: shard, buckets, slot, digest, keep_id, n) and a table of its members
(doc_id, digest), both in the shared folder; a change reads one version and writes the next, shard by shard. Before the
exchange each task puts its own copies of a text together, so a text that a third of all rows hold is one row a task,
and a shard's rows are bounded by its digests and the number of tasks.

Edge cases: a null text is an empty text; empty texts are equal. Very long texts are read by their digest alone. Of
equal texts the largest doc_id stays; null ids come last; of rows that repeat both id and text (or equal texts without
any id) one stays, the others go. An empty table gives an empty result; other columns are not read. Deleting an id
takes all rows of that id from the index (a null id none); ids that it does not hold change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, written

SLOTS, KICKS = 4, 200
#: Digests of a shard when an index is made, rows that a task puts together at once.
SHARD, COMBINE = 50_000, 200_000
SLOT_SCHEMA = "shard int, buckets int, slot int, digest binary, keep_id long, n long"
CHANGE_SCHEMA = "digest binary, doc_id long, n long"


class CuckooFilter:
    """Fingerprints in buckets of four, and the number of the stored key beside each."""

    def __init__(self, buckets: int = 1):
        self.buckets, self.fingers, self.rows = buckets, [0] * (buckets * SLOTS), [-1] * (buckets * SLOTS)
        self.false_hits = self.resizes = 0

    def places(self, digest: bytes) -> tuple[int, int, int]:
        """The fingerprint and the first slots of its two buckets; either bucket gives the other."""
        f = int.from_bytes(digest[:2], "little") or 1
        i = int.from_bytes(digest[2:8], "little") & (self.buckets - 1)
        return f, i * SLOTS, self.other(f, i * SLOTS)

    def other(self, f: int, at: int) -> int:
        return (at // SLOTS ^ (f * 0x9E3779B1 >> 7) & (self.buckets - 1)) * SLOTS

    def find(self, digest: bytes, keys: list[bytes]) -> int:
        """The slot that holds a digest, or -1."""
        f, i, j = self.places(digest)
        for at in (i, j) if i != j else (i,):
            for k in range(at, at + SLOTS):
                if self.fingers[k] == f:
                    if keys[self.rows[k]] == digest:
                        return k
                    self.false_hits += 1
        return -1

    def place(self, f: int, at: int, row: int) -> bool:
        for k in range(at, at + SLOTS):
            if not self.fingers[k]:
                self.fingers[k], self.rows[k] = f, row
                return True
        return False

    def add(self, digest: bytes, row: int, keys: list[bytes]) -> None:
        """Put keys[row] = digest in; the filter doubles where no slot can be freed."""
        f, i, j = self.places(digest)
        if self.place(f, i, row) or self.place(f, j, row):
            return
        at = j
        for k in range(KICKS):
            out = at + k * 5 % SLOTS
            (f, row), self.fingers[out], self.rows[out] = (self.fingers[out], self.rows[out]), f, row
            at = self.other(f, at)
            if self.place(f, at, row):
                return
        self.resize([*(r for r in self.rows if r >= 0), row], keys)

    def resize(self, live: list[int], keys: list[bytes]) -> None:
        resizes, false_hits = self.resizes + 1, self.false_hits
        self.__init__(self.buckets * 2)
        self.resizes, self.false_hits = resizes, false_hits
        for row in live:
            self.add(keys[row], row, keys)

    def remove(self, slot: int) -> None:
        self.fingers[slot], self.rows[slot] = 0, -1


def changed(stored: pa.Table, changes: pa.Table) -> pa.Table:
    """One shard after its changes: (digest, id, n) with n > 0 adds copies and raises the id; n < 0 counts copies off and sets the id."""
    keys, keep, n = (stored[c].to_pylist() for c in ("digest", "keep_id", "n"))
    shard = (stored if stored.num_rows else changes)["shard"][0].as_py()
    f = CuckooFilter(stored["buckets"][0].as_py() if keys else 1)
    for row, slot in enumerate(stored["slot"].to_pylist()):
        f.fingers[slot], f.rows[slot] = f.places(keys[row])[0], row
    for digest, doc_id, more in zip(*(changes[c].to_pylist() for c in ("digest", "doc_id", "n"))):
        slot = f.find(digest, keys)
        if slot < 0:
            if more > 0:
                keys.append(digest)
                keep.append(doc_id)
                n.append(more)
                f.add(digest, len(keys) - 1, keys)
            continue
        row = f.rows[slot]
        n[row] += more
        if more < 0:
            keep[row] = doc_id
        elif doc_id is not None:
            keep[row] = doc_id if keep[row] is None else max(keep[row], doc_id)
        if n[row] <= 0:
            f.remove(slot)
    live = [(k, r) for k, r in enumerate(f.rows) if r >= 0]
    rows = [r for _, r in live]
    return pa.table({"shard": pa.array([shard] * len(live), pa.int32()), "buckets": pa.array([f.buckets] * len(live), pa.int32()), "slot": pa.array([k for k, _ in live], pa.int32()),
                     "digest": pa.array([keys[r] for r in rows], pa.binary()), "keep_id": pa.array([keep[r] for r in rows], pa.int64()), "n": pa.array([n[r] for r in rows], pa.int64())})


def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's copies of a digest as one row, up to COMBINE rows at a time."""
    held: list[pa.RecordBatch] = []

    def out() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held).group_by("digest").aggregate([("doc_id", "max"), ("doc_id", "count", pc.CountOptions(mode="all"))])
        yield from t.select(["digest", "doc_id_max", "doc_id_count"]).rename_columns(["digest", "doc_id", "n"]).to_batches()

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= COMBINE:
            yield from out()
            held = []
    if held:
        yield from out()


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))


class DigestIndex:
    """An index of live digests: slots (see SLOT_SCHEMA) and members (doc_id, digest)."""

    def __init__(self, slots: DataFrame, members: DataFrame, shards: int):
        self.slots, self.members, self.shards = slots, members, shards

    @classmethod
    def empty(cls, spark: SparkSession, shards: int) -> DigestIndex:
        return cls(spark.createDataFrame([], SLOT_SCHEMA), spark.createDataFrame([], "doc_id long, digest binary"), shards)

    def _after(self, changes: DataFrame) -> DataFrame:
        at = changes.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(self.shards)).cast("int"))
        ship(at.sparkSession)
        return written(at.sparkSession, self.slots.groupBy("shard").cogroup(at.groupBy("shard")).applyInArrow(changed, SLOT_SCHEMA), "slots")

    def insert(self, members: DataFrame) -> DigestIndex:
        """members: (doc_id, digest), a written table: the index with these rows too."""
        ship(members.sparkSession)
        new = members.select("doc_id", "digest").mapInArrow(combined, CHANGE_SCHEMA)
        return DigestIndex(self._after(new), self.members.union(members.select("doc_id", "digest")), self.shards)

    def delete(self, ids: DataFrame) -> DigestIndex:
        """ids: (doc_id): the index without the rows of these ids; where the id that stayed goes, the next one takes its place."""
        spark = ids.sparkSession
        gone = ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
        left = written(spark, self.members.join(gone.hint("shuffle_merge"), "doc_id", "left_anti"), "members")
        lost = self.members.join(gone.hint("shuffle_merge"), "doc_id", "left_semi").groupBy("digest").agg((-F.count("*")).alias("n"))
        lost = written(spark, lost, "lost")
        keep = left.join(lost.select("digest").hint("shuffle_merge"), "digest", "left_semi").groupBy("digest").agg(F.max("doc_id").alias("doc_id"))
        return DigestIndex(self._after(lost.join(keep.hint("shuffle_merge"), "digest", "left").select("digest", "doc_id", "n")), left, self.shards)


def dedup_exact(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row a document, by an index of all of them."""
    spark = docs.sparkSession
    members = written(spark, digests(docs), "digests")
    shards = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-members.count() // SHARD))
    index = DigestIndex.empty(spark, shards).insert(members)
    # Rows equal in id and text are one row with their number until the end, as they cannot be told apart.
    rows = members.groupBy("doc_id", "digest").agg(F.count("*").alias("m")).join(index.slots.select("digest", "keep_id", F.col("n").alias("group_size")).hint("shuffle_merge"), "digest")
    each = rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("k"))
    return each.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("k") == 1)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS t FROM documents)
"""
