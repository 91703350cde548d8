"""Line dedup by a log-template tree; DataFrame functions only.

A line's tokens are its runs of characters other than ASCII white space; a token with a digit is a variable field and
becomes <*>. The tree has fixed depth: the token count, then the first DEPTH tokens, then a leaf, which holds any number
of templates. Two lines of a leaf share one if their masked tokens are equal, or differ only within one window of
field(n) tokens in a row (a quarter of the line, FIELD at most), which is then a variable field too. A template has
CONSTANT constant tokens at least, and at least half of its tokens: a line with fewer (a row of numbers, a line of one
or two tokens) recurs only in its own words, digits and all. A line of one of whose templates a document before its own
has a line goes, be that line kept or not, so a recurring template stays in its first document alone.

Every window of every line of a leaf with several wordings is grouped by what lies outside it; lines first meet by what
lies outside one of SEGMENTS overlapping stretches, and only those that meet there are grouped by window, so nothing is
paired and no line is only held against the leaf's first.

Edge cases: a null text stays null and has no lines; an empty text stays empty; a line without tokens is never dropped;
lines of any length are held whole; repeated rows (same id, same text) count as one document and lose the same lines;
rows with the same id but other texts are documents of their own; a null id comes before all others; an empty table
gives an empty result; other columns pass through, whatever their names, but for columns named n_lines or n_dropped,
which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

DEPTH, SEGMENTS = 4, 4
#: Tokens of the widest variable field, constant tokens of the barest template.
FIELD, CONSTANT = 3, 3
SPACE = "[\\x20\\x09-\\x0D]"


def wordings(lines: DataFrame, min_tokens: int) -> DataFrame:
    """lines (text __s) with tokens t (masked if enough are constant, else bare), their number n, leaf and wording w."""
    word = SPACE.replace("[", "[^")
    masked = F.when(F.col("__s").rlike("[0-9]"), F.regexp_replace("__s", f"(?<!{word})[^0-9\\x20\\x09-\\x0D]*+[0-9]{word}*+", "<*>")).otherwise(F.col("__s"))
    tokens = lambda s: F.array_remove(F.split(s, f"{SPACE}+", -1), "")
    d = lines.select("*", tokens(masked).alias("m")).withColumn("n", F.size("m")).where(F.col("n") >= max(1, min_tokens))
    bare = F.size(F.array_remove("m", "<*>")) < F.greatest(F.lit(CONSTANT), F.col("n") / 2)
    d = d.withColumn("t", F.when(bare, tokens(F.col("__s"))).otherwise(F.col("m"))).withColumn("bare", bare).drop("__s", "m")
    return d.select("*", F.xxhash64("n", F.slice("t", 1, DEPTH)).alias("leaf"), F.xxhash64("n", "t").alias("w"))


def templates(docs: DataFrame, min_tokens: int = 1) -> DataFrame:
    """(id, h, lines array) of the lines to drop by templates, any number of them in a leaf."""
    spark = docs.sparkSession
    split = F.posexplode(F.split("text", "\n", -1)).alias("__line", "__s")
    rows = written(spark, wordings(docs.select("__id", "__h", split), min_tokens).drop("t", "n", "bare"), "lines")
    doc = F.struct("__id", "__h")
    every = written(spark, rows.groupBy("leaf", "w").agg(F.min(F.struct("__id", "__h", "__line")).alias("at"), F.max(doc).alias("last")), "wordings")

    # The tokens of leaves with several wordings, one line for each wording.
    leaves = written(spark, every.groupBy("leaf").agg(F.min("w").alias("a"), F.max("w").alias("b")).where("a < b").select("leaf"), "leaves")
    place = written(spark, every.join(leaves.hint("shuffle_merge"), "leaf", "left_semi").groupBy("at.__id", "at.__h").agg(F.collect_set("at.__line").alias("__at")), "places")
    lined = docs.join(place.hint("shuffle_merge"), ["__id", "__h"]).select("__id", "__h", "__at", split).where("array_contains(__at, __line)").drop("__at")
    n, field = F.col("n"), F.least(F.lit(FIELD), F.floor(F.col("n") / 4).cast("int"))
    start = lambda k: F.lit(DEPTH) + F.floor((n - DEPTH) * k / SEGMENTS).cast("int")
    part = lambda a, b: F.slice("t", a + 1, F.greatest(F.lit(0), b - a))
    stop = lambda k: F.least(n, start(k + 1) + field - 1)
    stretch = [F.struct(F.xxhash64(F.lit(k), "leaf", part(F.lit(DEPTH), start(k)), part(stop(k), n)).alias("outside"), start(k).alias("a"), start(k + 1).alias("b"), part(start(k), stop(k)).alias("t")) for k in range(SEGMENTS)]
    spare = F.size(F.array_remove("t", "<*>")) - F.ceil(F.greatest(F.lit(CONSTANT), n / 2)).cast("int")  # constant tokens that a window may take
    held = wordings(lined, min_tokens).where("not bare").select("w", F.struct("__id", "__h").alias("first"), field.alias("field"), spare.alias("spare"), F.explode(F.array(*stretch)).alias("x")).select("w", "first", "field", "spare", "x.*").where("a < b")
    held = written(spark, held, "stretches")

    # Lines that meet outside a stretch, then outside a window of it.
    met = written(spark, held.groupBy("outside").agg(F.min("w").alias("lo"), F.max("w").alias("hi")).where("lo < hi").select("outside"), "met")
    near = held.join(met.hint("shuffle_merge"), "outside", "left_semi").select("*", F.explode(F.sequence(F.lit(0), F.col("b") - F.col("a") - 1)).alias("p"))
    window = F.xxhash64("outside", "p", F.expr("slice(t, 1, p)"), F.expr("slice(t, p + field + 1, greatest(0, size(t) - p - field))"))
    near = near.where("size(array_remove(slice(t, p + 1, field), '<*>')) <= spare")
    near = written(spark, near.select("w", "first", window.alias("window")), "windows")
    shared = near.groupBy("window").agg(F.min("first").alias("first"), F.min("w").alias("lo"), F.max("w").alias("hi")).where("lo < hi").select("window", "first")
    earlier = near.select("window", "w").join(shared.hint("shuffle_merge"), "window").groupBy("w").agg(F.min("first").alias("first"))

    again = every.select("w", F.struct("at.__id", "at.__h").alias("own"), "last").join(earlier.hint("shuffle_merge"), "w", "left")
    again = written(spark, again.select("w", F.least("own", F.coalesce("first", "own")).alias("first"), "last").where("first < last").select("w", "first"), "again")
    discard(every, leaves, place, held, met, near)
    return rows.join(again.hint("shuffle_merge"), "w").where(doc > F.col("first")).groupBy("__id", "__h").agg(F.collect_set("__line").alias("__drop"))


def drop_template_lines(docs: DataFrame, min_tokens: int = 1) -> DataFrame:
    """docs with the lines of recurring templates gone from text, and n_lines, n_dropped (long).

    min_tokens: lines of fewer tokens are left alone (1: every line with a token is looked at)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_dropped")])
    # The row's columns by number, so that their names cannot clash with those below.
    d = docs.select(*[docs[c].alias(f"c{k}") for k, c in enumerate(docs.columns) if c != "text"], docs["text"].cast("string").alias("text"), F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63))).alias("__id"))
    d = d.withColumn("__h", F.coalesce(F.xxhash64("text"), F.lit(0)))
    drop = templates(d.select("__id", "__h", "text"), min_tokens)
    d = d.join(drop.hint("shuffle_merge"), ["__id", "__h"], "left").withColumn("__lines", F.split("text", "\n", -1))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    text = F.when(F.col("__drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n"))
    counts = [F.coalesce(F.when(F.col("text").isNotNull(), F.size("__lines")), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped")]
    return d.select(*[text.alias(c) if c == "text" else F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)], *counts)


ORACLE = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS s, generate_subscripts(ls, 1) AS line FROM d),
t AS (SELECT doc_id, line, list_filter(string_split_regex(s, '[ \\t-\\r]+'), lambda x: x <> '') AS raw FROM l),
m AS (
  SELECT doc_id, line, raw, len(raw) AS n, list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS mask
  FROM t WHERE len(raw) > 0),
c AS (SELECT *, greatest({CONSTANT}, n / 2) AS least, len(list_filter(mask, lambda x: x <> '<*>')) AS constants FROM m),
r AS (SELECT doc_id, line, n, least, constants >= least AS open, CASE WHEN constants >= least THEN mask ELSE raw END AS t FROM c),
w AS (
  SELECT DISTINCT n, t, p, list_slice(t, 1, p) AS before, list_slice(t, p + least_f + 1, n) AS after
  FROM (SELECT n, t, least, least({FIELD}, n // 4) AS least_f, unnest(range({DEPTH}, n)) AS p FROM (SELECT DISTINCT n, t, least FROM r WHERE open AND n > {DEPTH}))
  WHERE len(list_filter(list_concat(list_slice(t, 1, p), list_slice(t, p + least_f + 1, n)), lambda x: x <> '<*>')) >= least),
own AS (SELECT t, open, min(doc_id) AS first FROM r GROUP BY t, open),
met AS (SELECT w.n, w.p, w.before, w.after, min(own.first) AS first FROM w JOIN own ON own.open AND own.t = w.t GROUP BY ALL),
near AS (SELECT w.t, min(met.first) AS first FROM w JOIN met ON w.n = met.n AND w.p = met.p AND w.before = met.before AND w.after = met.after GROUP BY w.t),
x AS (
  SELECT r.doc_id, r.line FROM r JOIN own ON r.t = own.t AND r.open = own.open LEFT JOIN near ON r.open AND r.t = near.t
  WHERE r.doc_id > least(own.first, coalesce(near.first, own.first))),
k AS (
  SELECT l.doc_id, count(*) AS n_lines, count(x.line) AS n_dropped,
    coalesce(string_agg(CASE WHEN x.line IS NULL THEN l.s END, chr(10) ORDER BY l.line), '') AS text
  FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.line = x.line GROUP BY l.doc_id)
SELECT d.doc_id AS doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
