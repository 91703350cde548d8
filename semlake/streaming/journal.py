"""The change journal: publishing, bounded reads, point-in-time restore, and the same fold as a stream."""

from __future__ import annotations

import math
from datetime import datetime
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import JOURNAL_SCHEMA, QUAD, QUAD_SCHEMA, TRIPLE
from ..operators.segments import SegmentedIndex
from ..sources import store

OVERSIZED = 524_288


def journal_publish(events: DataFrame, carry: bool = True) -> DataFrame:
    """Events with the oversized flag set by the size of their body. With carry=False (for a broker that takes no large
    messages) an oversized body is left out, and a restore over that event fails rather than lose it."""
    big = F.coalesce(F.length(F.to_json("quads")) > OVERSIZED, F.lit(False))
    return events.withColumn("oversized", big).withColumn("quads", F.col("quads") if carry else F.when(~big, F.col("quads")))


#: Offsets of one folder of a journal, the folders of one append (about), the events of one task that appends.
SPAN, FOLDERS, TASK_EVENTS = 100_000, 1_000, 200_000


def stretches(spark: SparkSession, path: str) -> list[int]:
    """The stretches beyond the span that folders of a journal have, each marked by a file."""
    return [int(n.removesuffix(".json")) for n in store.names(spark, f"{path}/_stretches") if n.endswith(".json") and not n.startswith(".")]


def journal_append(events: DataFrame, path: str, span: int = SPAN) -> None:
    """Append events to a journal: JSON lines in a folder a part and stretch of offsets, so that a reader lists only what it needs.

    A folder holds `span` offsets; where that would make more than FOLDERS folders, the stretch is doubled as often as it
    takes. Tasks take ranges of offsets, so a folder of many events is written by several.
    """
    ends = events.groupBy("part").agg(F.min("off").alias("low"), F.max("off").alias("high"), F.count("*").alias("n")).collect()  # a row a part
    width = span
    while sum(r.high // width - r.low // width for r in ends) >= FOLDERS:
        width *= 2
    if width > span and width not in stretches(events.sparkSession, path):
        store.put_json(events.sparkSession, f"{path}/_stretches/{width}.json", {"span": span})
    tasks = max(1, -(-sum(r.n for r in ends) // TASK_EVENTS))
    e = events.withColumn("from", F.expr(f"off - pmod(off, {width})"))
    e.repartitionByRange(tasks, "part", "off").sortWithinPartitions("part", "from", "off").write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").partitionBy("part", "from").mode("append").json(path)  # the default has milliseconds


def journal_read(spark: SparkSession, path: str, since: dict[int, int] | None = None, until=None, span: int | None = None) -> DataFrame:
    """Events of a JSON journal from recorded offsets on, up to a time; malformed lines are skipped.

    span: the stretch of a journal in folders (journal_append); folders before the offsets are not opened. None: plain files.
    """
    schema = JOURNAL_SCHEMA + (", from long" if span else "") + ", _corrupt string"
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    width = max([span, *stretches(spark, path)]) if span else None
    for part, off in (since or {}).items():
        if span:
            raw = raw.where((F.col("part") != part) | (F.col("from") >= off - off % width))
        raw = raw.where((F.col("part") != part) | (F.col("off") >= off) | F.col("off").isNull())
    out = raw.where("_corrupt is null and seq is not null").drop("_corrupt", "from")
    return out.where(F.col("at") <= F.lit(until)) if until is not None else out


def mutations(journal: DataFrame) -> DataFrame:
    """One row per fact and drop: (graph, op, ord, fact columns). A replace is a drop, then inserts."""
    lost = F.coalesce(F.col("oversized"), F.lit(False)) & F.col("quads").isNull()
    whole = F.when(lost, F.raise_error(F.concat(F.lit("the body of an oversized event is missing: seq "), F.col("seq").cast("string"))).cast("boolean")).otherwise(True)
    j = journal.where(whole).withColumn("ord", F.struct("at", "seq", "step"))
    drops = j.where("op in ('drop', 'replace')").select("graph", F.lit("drop").alias("op"), F.struct("at", "seq", "step", F.lit(0).alias("sub")).alias("ord"), *[F.lit(None).cast("string").alias(c) for c in TRIPLE])
    rows = j.where("op in ('insert', 'delete', 'replace')").select("graph", F.when(F.col("op") == "delete", "delete").otherwise("insert").alias("op"), F.struct("at", "seq", "step", F.lit(1).alias("sub")).alias("ord"), F.explode("quads").alias("q")).select("graph", "op", "ord", "q.*")
    return drops.unionByName(rows)


def restore_pitr(checkpoint: DataFrame, journal: DataFrame, until=None) -> DataFrame:
    """The graph at a time: the last writer of each fact after its graph's last drop decides; two aggregations, no row loop."""
    j = journal.where(F.col("at") <= F.lit(until)) if until is not None else journal
    m = mutations(j)
    start = checkpoint.select("graph", F.lit("insert").alias("op"), F.lit(None).cast(m.schema["ord"].dataType).alias("ord"), *TRIPLE)
    reset = m.where("op = 'drop'").groupBy("graph").agg(F.max("ord").alias("reset"))
    rows = start.unionByName(m.where("op <> 'drop'")).join(reset.hint("shuffle_merge"), "graph", "left").where("reset is null or ord > reset")
    first = F.struct(F.col("ord").isNotNull().alias("has"), "ord")
    last = rows.groupBy(*QUAD).agg(F.max_by("op", first).alias("op"))
    return last.where("op = 'insert'").select(*QUAD)


def next_offsets(journal: DataFrame) -> dict[int, int]:
    """The next offset of each part: a row a part."""
    return {r.part: r.next for r in journal.groupBy("part").agg((F.max("off") + 1).alias("next")).collect()}


def open_offsets(journal: DataFrame, upto) -> dict[int, int]:
    """The first offset of each part that a checkpoint of all events up to a time leaves out; times need not follow offsets. A row a part."""
    late = F.min(F.when(F.col("at") > F.lit(upto), F.col("off")))
    return {r.part: r.next for r in journal.groupBy("part").agg(F.coalesce(late, F.max("off") + 1).alias("next")).collect()}


#: Ranges of time that one round of `moment` counts.
RANGES = 4096


def moment(df: DataFrame, column: str, share: float) -> datetime | None:
    """The least time of a column up to which `share` of its rows lie, exactly, as SQL's quantile_disc; None without rows.

    percentile_approx may be some rows off in a long table. Here each round counts the rows of RANGES equal ranges of time at
    most and goes on in the range that holds the wanted row: two to four rounds for a year of microseconds, however many rows.
    """
    us = df.where(F.col(column).isNotNull()).select(F.col(column).alias("at"), F.unix_micros(F.col(column).cast("timestamp")).alias("us"))
    of = [F.count("*").alias("n"), F.min("us").alias("low"), F.max("us").alias("high"), F.min("at").alias("at")]
    found = us.agg(*of).first()
    left = max(1, math.ceil(Fraction(str(share)) * found.n))
    while found.n and found.low < found.high:
        width = -(-(found.high - found.low + 1) // RANGES)
        ranges = us.where(F.col("us").between(found.low, found.high)).groupBy(F.expr(f"(us - ({found.low})) div {width}").alias("k")).agg(*of)
        for found in sorted(ranges.collect()):  # a row a range
            if left <= found.n:
                break
            left -= found.n
    return found.at


def checkpoint(quads: DataFrame, folder: str, at: str, offsets: dict[int, int] | None, label: str = "", upto: datetime | None = None) -> dict:
    """Write a snapshot: facts in files by ranges of graph, so that there are as many as the facts ask for whatever the number of graphs, then its manifest (id, at, label, graphs, triples, offsets), by which it is there or not.

    offsets: of the journal, as they were before the facts were read; None if there is no journal, then a restore has no replay.
    upto: the facts are those of all events up to this time, whatever their offsets (open_offsets); a restore replays later ones alone.
    """
    spark = quads.sparkSession
    name = "cp-" + at.replace(":", "-").replace(".", "-").replace(" ", "-")
    path = f"{folder}/{name}"
    if "manifest.json" in store.names(spark, path):
        raise ValueError(f"{name} is there already")
    quads.select(*QUAD).distinct().repartitionByRange("graph", "s").sortWithinPartitions("graph", "s").write.mode("overwrite").parquet(f"{path}/facts")
    n = spark.read.schema(QUAD_SCHEMA).parquet(f"{path}/facts").agg(F.count("*").alias("n"), F.countDistinct("graph").alias("g")).first()
    manifest = {"id": name, "at": at, "label": label, "graphs": n.g, "triples": n.n, "offsets": None if offsets is None else {str(p): o for p, o in offsets.items()}}
    if upto is not None:
        manifest["upto"] = upto.isoformat()
    store.put_json(spark, f"{path}/manifest.json", manifest)
    return manifest


def list_checkpoints(spark: SparkSession, folder: str) -> list[dict]:
    """Manifests of the finished checkpoints in a folder, newest first."""
    found = [store.get_json(spark, f"{folder}/{n}/manifest.json") for n in store.names(spark, folder) if n.startswith("cp-") and "manifest.json" in store.names(spark, f"{folder}/{n}")]
    return sorted(found, key=lambda m: m["at"], reverse=True)


def restore(spark: SparkSession, folder: str, checkpoint_id: str, journal: str | None = None, until=None, span: int | None = SPAN) -> DataFrame:
    """The graph at a time from what is on disk: a checkpoint's facts, and the journal from its offsets on. Without offsets, the facts alone."""
    found = {m["id"]: m for m in list_checkpoints(spark, folder)}
    if checkpoint_id not in found:
        raise ValueError(f"no such checkpoint: {checkpoint_id}. Available: {', '.join(found) or '(none)'}")
    facts = spark.read.schema(QUAD_SCHEMA).parquet(f"{folder}/{checkpoint_id}/facts").select(*QUAD)
    offsets = found[checkpoint_id]["offsets"]
    if journal is None or offsets is None:
        return facts
    tail = journal_read(spark, journal, {int(p): o for p, o in offsets.items()}, until, span)
    if "upto" in found[checkpoint_id]:
        tail = tail.where(F.col("at") > F.lit(datetime.fromisoformat(found[checkpoint_id]["upto"])))
    return restore_pitr(facts, tail)


def change_feed(events: DataFrame) -> DataFrame:
    """(at, seq, graph) of every change; works on streams."""
    return events.select("at", "seq", "graph").where("graph is not null")


class FactStore:
    """The last mutation of each fact, in buckets of files under numbered manifests.

    A batch appends its own last mutations to the buckets that it touches; a bucket that has come to MOST files sets is
    rewritten as one, so what is written follows the batch. The manifest of a batch (bucket -> the batches whose files
    hold it) is committed last; a batch that has one is not applied again, and readers of a manifest keep its files until
    `keep` later ones are there.
    """

    #: Buckets of a new store, and sets of files of one bucket.
    BUCKETS, MOST = 64, 8

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, most: int = MOST, keep: int = 3):
        self.spark, self.path, self.buckets, self.most, self.keep = spark, path, buckets, most, keep
        self.versions = store.Versions(spark, f"{path}/manifest")

    def files(self, held: dict[str, list[int]], among=None) -> list[str]:
        return [f"{self.path}/data/batch={e}/bucket={b}" for b, batches in held.items() if among is None or b in among for e in batches]

    def rows(self, paths: list[str]) -> DataFrame:
        schema = self.spark.read.parquet(paths[0]).schema
        return self.spark.read.schema(schema).parquet(*paths)

    def apply(self, events: DataFrame, batch: int) -> bool:
        """Merge a batch of events by (at, seq, step), so late and repeated events never undo newer ones; False if the batch is there already."""
        last, manifest = self.versions.read()
        if batch <= last:
            return False
        n, held = (manifest["buckets"], manifest["held"]) if manifest else (self.buckets, {})
        m = mutations(events).withColumn("bucket", F.pmod(F.xxhash64("graph", "s", "p", "o"), F.lit(n)).cast("int"))
        newest = lambda d: d.groupBy("bucket", *QUAD).agg(F.max_by(F.struct("op", "ord"), "ord").alias("x")).select("bucket", *QUAD, "x.op", "x.ord")
        target = f"{self.path}/data/batch={batch}"
        newest(m).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        touched = [x.removeprefix("bucket=") for x in store.names(self.spark, target) if x.startswith("bucket=")]  # `buckets` at most
        full = {b for b in touched if len(held.get(b, [])) + 1 >= self.most}
        if full:
            old = [f"{target}/bucket={b}" for b in full] + self.files(held, full)
            whole = self.spark.read.option("basePath", f"{self.path}/data").parquet(*old).drop("batch")
            newest(whole).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={batch}m")
        held = held | {b: [*held.get(b, []), batch] for b in touched} | {b: [f"{batch}m"] for b in full}
        self.versions.commit(batch, {"buckets": n, "held": held})
        stay = self.versions.forget(self.keep)
        used = {str(e) for v in stay for batches in v["held"].values() for e in batches}
        for name in store.names(self.spark, f"{self.path}/data"):
            if name.removeprefix("batch=") not in used:
                store.delete(self.spark, f"{self.path}/data/{name}")
        return True

    def graph(self, version: int | None = None) -> DataFrame:
        """The facts that a version leaves (the last, if none is named)."""
        number, manifest = self.versions.read(version)
        if number < 0 or not manifest["held"]:
            return self.spark.createDataFrame([], QUAD_SCHEMA)
        s = self.rows(self.files(manifest["held"])).groupBy(*QUAD).agg(F.max_by(F.struct("op", "ord"), "ord").alias("x")).select(*QUAD, "x.op", "x.ord")
        reset = s.where("op = 'drop'").groupBy("graph").agg(F.max("ord").alias("reset"))
        return s.where("op <> 'drop'").join(reset.hint("shuffle_merge"), "graph", "left").where("(reset is null or ord > reset) and op = 'insert'").select(*QUAD)


def journal_apply_stream(events: DataFrame, state_path: str, checkpoint: str, **options) -> StreamingQuery:
    """Fold a stream of events into a FactStore at state_path, a version a batch."""
    s = FactStore(events.sparkSession, state_path, **options)
    return events.writeStream.foreachBatch(lambda batch, epoch: s.apply(batch, epoch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_state(spark: SparkSession, state_path: str, version: int | None = None) -> DataFrame:
    """The graph that the folded stream leaves."""
    return FactStore(spark, state_path).graph(version)


def index_refresh_stream(changes: DataFrame, index: SegmentedIndex, present: DataFrame, checkpoint: str, every: str = "4 seconds", now: bool = False) -> StreamingQuery:
    """Keep an index up to date: each quiet spell's changed ids (id) come anew from `present`, their present documents; those that it lacks go.

    A batch is a segment with the batch's number, so a batch that is repeated changes nothing.
    """

    def refresh(batch: DataFrame, epoch: int) -> None:
        ids = batch.select("id").distinct()
        index.apply(present.join(ids.hint("shuffle_merge"), "id", "left_semi"), ids, epoch + 1)

    w = changes.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if now else w.trigger(processingTime=every)).start()


def search_watches(hits: DataFrame, seen: DataFrame, known: DataFrame, top: int = 100, reported: int = 10) -> DataFrame:
    """hits: (watch, id, score): new ids per watch since the last run; a watch not yet in `known` only records."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("watch").orderBy(F.desc("score"), "id"))
    new = hits.withColumn("rank", rank).where(F.col("rank") <= top).join(known, "watch", "left_semi").join(seen, ["watch", "id"], "left_anti")
    return new.withColumn("n", F.row_number().over(Window.partitionBy("watch").orderBy("rank"))).where(F.col("n") <= reported).select("watch", "id")
