"""Mixing sources to target weights by Pfair scheduling; DataFrame functions only.

Each source's documents, in doc_id order, form blocks of `block_chars` characters (a document belongs to the block in
which it starts). A source with `units` of the `cycle` slots of a round may start its block j (from 0) at slot
floor(j * cycle / units) and must have it done by slot ceil((j + 1) * cycle / units). Earliest deadline first among the
released blocks, ties to the first source by name, fills every slot of a round, and after any slot each source is less
than one block from its share. Rounds repeat, so one round of `cycle` slots is worked out (in one row, by a fold) and
every block's slot follows by arithmetic. No row is dropped: when a source runs out its slots stay empty and the
others keep their proportions. Documents are not cut: one that is longer than a block has the slot of its first block,
and the slots of the blocks that it covers stay empty, so in characters a source is ahead of its share by less than one
block and what its last document has beyond its block.

Edge cases: a null source is the source ''; a null text has no characters and stays in its place; a null id comes
first; equal ids (and rows without one) go by length, then by a hash of their text; equal rows follow one another in
any order, which shows in nothing but their own places (they alone are one task's rows); ids may be any long; an empty table gives an empty result; other columns pass
through, whatever their names, but for columns named mix_units, mix_block, mix_slot and mix_start, which are replaced.
Weights that name a source twice (null and '' are one) with different values, or leave out a source of the documents,
are a ValueError; named twice with one value, they count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

CYCLE = 1000
BLOCK_CHARS = 16384
#: The order of a source's documents: those without an id first, then by id, length and hash of the text.
ORDER = ("has", "id", "len", "h")
#: Keys of one step of the running sum (2^8); parts up to which their sums are broadcast, by a shuffle beyond.
STEP_BITS, BROADCAST_PARTS = 8, 10_000
#: Sources up to which their slots are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 1000
ADDED = ("mix_units", "mix_block", "mix_slot", "mix_start")

#: One round: for every slot the place (in name order) of the source that has it.
ROUND = """
aggregate(sequence(0L, cycle - 1),
  named_struct('done', transform(units, u -> 0L), 'pick', cast(array() as array<int>)),
  (s, t) -> transform(array(array_min(filter(
      transform(s.done, (d, i) -> if(d < units[i] and d * cycle div units[i] <= t,
        named_struct('due', ((d + 1) * cycle + units[i] - 1) div units[i], 'i', i), null)),
      x -> x is not null)).i),
    p -> named_struct('done', transform(s.done, (d, i) -> d + if(i = p, 1L, 0L)), 'pick', concat(s.pick, array(p))))[0]).pick
"""


def shares(sizes: DataFrame, cycle: int = CYCLE) -> DataFrame:
    """(source, units, cycle) from (source, weight long): at least one unit each, the rest by largest remainder.

    A round must have room for every source: it has ten slots for each, and `cycle` at least.
    """
    every = Window.partitionBy()
    s = sizes.withColumn("n", F.count("*").over(every)).withColumn("total", F.sum("weight").over(every))
    s = s.withColumn("cycle", F.greatest(F.lit(cycle).cast("long"), F.col("n") * 10))
    s = s.withColumn("base", F.expr("1 + (cycle - n) * weight div total")).withColumn("rest", F.expr("(cycle - n) * weight % total"))
    s = s.withColumn("left", F.col("cycle") - F.sum("base").over(every)).withColumn("rn", F.row_number().over(Window.orderBy(F.desc("rest"), "source")))
    return s.select("source", (F.col("base") + (F.col("rn") <= F.col("left")).cast("long")).alias("units"), "cycle")


def schedule(units: DataFrame) -> DataFrame:
    """(source, units, cycle, k, slot): the slot of a source's k-th block within a round."""
    one = units.agg(F.array_sort(F.collect_list(F.struct("source", "units"))).alias("all"), F.max("cycle").alias("cycle"))
    one = one.where("cycle is not null").selectExpr("all", "all.units as units", "cycle")
    slots = one.selectExpr("all", "cycle", f"posexplode({ROUND}) as (slot, i)").selectExpr("all[i].source as source", "all[i].units as units", "cycle", "cast(slot as long) as slot")
    return slots.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("slot")).cast("long") - 1)


def own_weights(weights: DataFrame) -> DataFrame:
    """(source, weight), each source once; a ValueError where two values meet."""
    w = weights.select(F.coalesce(F.col("source"), F.lit("")).alias("source"), F.col("weight").cast("long").alias("weight"))
    w = w.where("weight > 0").groupBy("source").agg(F.min("weight").alias("weight"), F.max("weight").alias("other"))
    if not w.where("weight <> other").isEmpty():
        raise ValueError("a source has two weights")
    return w.select("source", "weight")


def places(keys: DataFrame) -> DataFrame:
    """keys (source, *ORDER, m: rows) with start, the length of all rows before them in their source; a written table behind it.

    Keys are put in order by one range exchange, whatever their values, and summed in steps of STEP keys, parts of the
    exchange, and sources; no window but that over a source's parts grows with the input.
    """
    spark = keys.sparkSession
    s = keys.repartitionByRange("source", *ORDER).sortWithinPartitions("source", *ORDER).withColumn("at", F.monotonically_increasing_id())
    s = written(spark, s.withColumn("part", F.shiftright("at", 33)).withColumn("step", F.shiftright("at", STEP_BITS)).withColumn("size", F.col("len") * F.col("m")), "places")
    steps = written(spark, s.groupBy("source", "part", "step").agg(F.sum("size").alias("size")), "steps")
    before = lambda d, by, order: d.withColumn("before", F.sum("size").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    parts = written(spark, before(steps.groupBy("source", "part").agg(F.sum("size").alias("size")), ["source"], "part").select("source", "part", F.col("before").alias("above")), "parts")
    held = F.broadcast(parts) if parts.count() <= BROADCAST_PARTS else parts.hint("shuffle_merge")
    steps = before(steps, ["source", "part"], "step").join(held, ["source", "part"]).select("source", "step", (F.col("above") + F.col("before")).alias("above"))
    inside = before(s.select("source", *ORDER, "m", "at", "step", "size"), ["source", "step"], "at")
    return inside.join(steps.hint("shuffle_merge"), ["source", "step"]).select("source", *ORDER, "m", (F.col("above") + F.col("before")).alias("start"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, cycle: int = CYCLE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with mix_units, mix_block, mix_slot, mix_start; the mixture is the order of (mix_slot, mix_start, doc_id).

    weights: (source, weight) with positive whole numbers for every source (else a ValueError); by default the square root of a source's
    characters. Places come from `places`, so that a large source is spread over many tasks, whatever its ids.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    # The row's columns by number, so that their names cannot clash with those below.
    d = docs.select(
        *[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns)], F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").cast("long").isNotNull().alias("has"), F.coalesce(F.col("source"), F.lit("")).alias("source"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("len"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"),
    )
    starts = places(d.groupBy("source", *ORDER).agg(F.count("*").alias("m")))
    sums = written(spark, starts.groupBy("source").agg(F.sum(F.col("len") * F.col("m")).alias("sum")), "sums")
    if weights is None:
        weights = sums.groupBy("source").agg(F.floor(F.sqrt(F.greatest(F.sum("sum"), F.lit(1))) * 1000).cast("long").alias("weight"))
    else:
        weights = own_weights(weights)
        if not sums.select("source").distinct().join(weights, "source", "left_anti").isEmpty():
            raise ValueError("a source of the documents has no weight")
    weights = written(spark, weights, "weights")
    plan = schedule(shares(weights, cycle)).withColumnRenamed("units", "mix_units")
    each = plan.groupBy("source", "mix_units", "cycle").agg(F.array_sort(F.collect_list(F.struct("k", "slot"))).alias("slots"))  # `cycle` slots in all
    few = weights.count() <= BROADCAST_SOURCES
    d = d.join(starts.select("source", *ORDER, "start").hint("shuffle_merge"), ["source", *ORDER])
    again = F.row_number().over(Window.partitionBy("source", *ORDER).orderBy(F.lit(0))) - 1  # among rows that nothing here tells apart
    d = d.withColumn("mix_start", F.col("start") + F.col("len") * again)
    d = d.withColumn("mix_block", F.expr(f"mix_start div {block_chars}"))
    d = d.join(F.broadcast(each) if few else each.hint("shuffle_merge"), "source")
    d = d.withColumn("mix_slot", F.expr("(mix_block div mix_units) * cycle + slots[int(mix_block % mix_units)].slot"))
    return d.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)], *ADDED)


ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(length(text), 0) AS len FROM documents),
s AS (
  SELECT source, CAST(floor(sqrt(CAST(greatest(sum(len), 1) AS DOUBLE)) * 1000) AS BIGINT) AS weight FROM d GROUP BY source),
n AS (SELECT count(*) AS n, CAST(sum(weight) AS BIGINT) AS total, greatest({CYCLE}, 10 * count(*)) AS cycle FROM s),
b AS (
  SELECT source, cycle, 1 + (cycle - n) * weight // total AS base, (cycle - n) * weight % total AS rest FROM s, n),
u AS (
  SELECT source, cycle, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, source) <= cycle - sum(base) OVER () THEN 1 ELSE 0 END AS units FROM b),
a AS (
  SELECT list(source ORDER BY source) AS sources, list(CAST(units AS BIGINT) ORDER BY source) AS units, CAST(max(cycle) AS BIGINT) AS cycle FROM u),
r AS (
  SELECT CAST(-1 AS BIGINT) AS slot, list_transform(units, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick FROM a
  UNION ALL
  SELECT slot, list_transform(done, lambda v, i: v + CASE WHEN i = pick THEN 1 ELSE 0 END), pick FROM (
    SELECT r.slot + 1 AS slot, r.done AS done,
      CAST(list_min(list_filter(list_transform(r.done, lambda v, i:
        CASE WHEN v < a.units[i] AND v * a.cycle // a.units[i] <= r.slot + 1
        THEN ((v + 1) * a.cycle + a.units[i] - 1) // a.units[i] * 1000000 + i END), lambda x: x IS NOT NULL)) % 1000000 AS BIGINT) AS pick
    FROM r, a WHERE r.slot + 1 < a.cycle)),
p AS (
  SELECT a.sources[pick] AS source, a.units[pick] AS units, a.cycle AS cycle, slot,
    row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS k FROM r, a WHERE slot >= 0),
o AS (
  SELECT doc_id, source, CAST(sum(len) OVER (PARTITION BY source ORDER BY doc_id, len ROWS UNBOUNDED PRECEDING) - len AS BIGINT) AS start FROM d)
SELECT o.doc_id AS doc_id, o.source AS source, p.units AS mix_units, CAST(o.start // {BLOCK_CHARS} AS BIGINT) AS mix_block,
  CAST((o.start // {BLOCK_CHARS} // p.units) * p.cycle + p.slot AS BIGINT) AS mix_slot, o.start AS mix_start
FROM o JOIN p ON o.source = p.source AND p.k = (o.start // {BLOCK_CHARS}) % p.units
"""
