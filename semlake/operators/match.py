"""Matching: crosswalks between schemes, field names to a business vocabulary, concepts in texts."""

from __future__ import annotations

import bisect
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import SKOS

# Executors get the automaton below with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RELATIONS = ("exactMatch", "closeMatch", "broadMatch", "narrowMatch", "relatedMatch")


def crosswalk_suggest(a: DataFrame, b: DataFrame, mapped: DataFrame | None = None, least: float = 0.5, limit: int | None = 50, ascii_only: bool = False) -> DataFrame:
    """a, b: (iri, label, alts array): (a, b, score, reason) by equal names (0.95) or by token overlap of labels.

    Names meet by an equi-join. For the overlap (Jaccard of `least` or more) a label's tokens are put in order, rarest in
    both schemes first: two such labels share one of the first n - ceil(least * n) + 1 of either, so only those are joined,
    a frequent word brings no pairs together, and nothing is missed.
    """
    norm = lambda c: S.norm_label(c, ascii_only)
    names = lambda d, n: d.select(F.col("iri").alias(n), F.explode(F.array_append(F.coalesce("alts", F.array().cast("array<string>")), F.col("label"))).alias("x")).select(n, norm(F.col("x")).alias("key")).where("key <> ''").distinct()
    exact = names(a, "a").join(names(b, "b").hint("shuffle_merge"), "key").select("a", "b").distinct().withColumn("score", F.lit(0.95)).withColumn("reason", F.lit("exact"))
    toks = lambda d, n: d.select(F.col("iri").alias(n), F.array_distinct(F.split(norm(F.col("label")), " ")).alias("ts")).where("ts[0] <> ''")
    ta, tb = toks(a, "a"), toks(b, "b")
    often = ta.select(F.explode("ts").alias("t")).union(tb.select(F.explode("ts").alias("t"))).groupBy("t").agg(F.count("*").alias("f"))

    def rare(d: DataFrame, n: str) -> DataFrame:
        """(id, its tokens, one of its first tokens)"""
        one = d.select(n, "ts", F.explode("ts").alias("t")).join(often.hint("shuffle_merge"), "t").groupBy(n, "ts").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("o"))
        first = F.slice("o", F.lit(1), (F.size("o") - F.ceil(F.size("o") * least) + 1).cast("int"))
        return one.select(n, F.col("ts").alias("ts_" + n), F.explode(first["t"]).alias("t"))

    both = rare(ta, "a").join(rare(tb, "b").hint("shuffle_merge"), "t").drop("t").distinct()
    k = F.size(F.array_intersect("ts_a", "ts_b"))
    j = k / (F.size("ts_a") + F.size("ts_b") - k)
    fuzzy = both.where(j >= least).select("a", "b", (F.round(j * 80) / 100).alias("score")).join(exact.select("a", "b").hint("shuffle_merge"), ["a", "b"], "left_anti").withColumn("reason", F.lit("overlap"))
    out = exact.unionByName(fuzzy)
    if mapped is not None:
        out = out.join(mapped.select("a", "b").hint("shuffle_merge"), ["a", "b"], "left_anti")
    out = out.join(a.select(F.col("iri").alias("a"), F.col("label").alias("label")).hint("shuffle_merge"), "a")
    out = out.orderBy(F.desc("score"), "label", "a", "b")
    return (out.limit(limit) if limit else out).select("a", "b", "score", "reason")


def crosswalk_facts(pairs: DataFrame, relation: str, graph: str) -> DataFrame:
    """Mapping facts of accepted pairs; the relation is one of five."""
    if relation not in RELATIONS:
        raise ValueError(f"unknown relation {relation}")
    return pairs.select(F.lit(graph).alias("graph"), F.col("a").alias("s"), F.lit(SKOS + relation).alias("p"), F.col("b").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))


def crosswalk_list(quads: DataFrame, labels: DataFrame) -> DataFrame:
    m = quads.where(F.col("p").isin([SKOS + r for r in RELATIONS])).select(F.col("s").alias("a"), F.expr(f"substring(p, {len(SKOS) + 1})").alias("relation"), F.col("o").alias("b"))
    la, lb = (labels.select(F.col("iri").alias(x), F.col("label").alias("label_" + x)) for x in "ab")
    return m.join(la.hint("shuffle_merge"), "a", "left").join(lb.hint("shuffle_merge"), "b", "left").select("a", "relation", "b", "label_a", "label_b")


#: Keywords up to which a vocabulary is broadcast; beyond, it is joined by a shuffle.
BROADCAST_KEYWORDS = 100_000


def match_field(names: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """names: (name); vocabulary: (ord, concept, area, keywords array): the best concept of each name.

    A keyword that is the whole name scores 3, one that stands in it as consecutive whole words 2, one that is a word of
    it without its plural s (of words over three letters) 1. A concept has its best score, by the first keyword that has
    it; ties between concepts go to the longer keyword, then to vocabulary order. Whatever scores has its first word, or
    itself, among the name's words, plural or not, so the join is an equi-join.
    """
    n = names.distinct().withColumn("words", S.tokenize_name(F.col("name"))).where("size(words) > 0")
    n = n.withColumn("singles", F.transform(F.filter("words", lambda w: w.endswith("s") & (F.length(w) > 3)), lambda w: F.substring(w, 1, F.length(w) - 1)))
    k = vocabulary.select("ord", "concept", "area", F.posexplode("keywords").alias("at", "kw")).withColumn("kws", S.tokenize_name(F.col("kw"))).where("size(kws) > 0").withColumn("w", F.col("kws")[0])
    held = F.broadcast(k) if k.count() <= BROADCAST_KEYWORDS else k.hint("shuffle_merge")
    on = n.select("name", "words", "singles", F.explode(F.array_union("words", "singles")).alias("w")).join(held, "w").drop("w")
    phrase, kw = F.array_join("words", " "), F.array_join("kws", " ")
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    score = F.when(phrase == kw, 3).when(F.contains(pad(phrase), pad(kw)), 2).when(F.array_contains("singles", kw), 1)
    hit = on.withColumn("score", score).where("score is not null")
    best = hit.groupBy("name", "ord", "concept", "area").agg(F.min(F.struct((-F.col("score")).alias("s"), "at", "kw", kw.alias("key"))).alias("x")).select("name", "ord", "concept", "area", (-F.col("x.s")).alias("score"), "x.kw", "x.key")
    first = F.min(F.struct((-F.col("score")).alias("s"), (-F.length("key")).alias("l"), "ord", "concept", "area", "kw")).alias("x")
    return best.groupBy("name").agg(first).select("name", "x.concept", "x.area", (-F.col("x.s")).alias("score"), F.col("x.kw").alias("hit"))


def concept_lexicon(concepts: DataFrame, shortest: int = 3, longest: int | None = 200) -> DataFrame:
    """concepts: (iri, names array): distinct (concept, name, key) of `shortest` to `longest` characters (None: of any length), by length down, IRI, name."""
    n = concepts.select(F.col("iri").alias("concept"), F.explode("names").alias("name")).select("concept", F.trim("name").alias("name")).where((F.length("name") >= shortest) & (F.length("name") <= (longest if longest is not None else 2**31 - 1)))
    n = n.withColumn("key", F.lower("name")).groupBy("concept", "key").agg(F.min("name").alias("name"))
    return n.withColumn("ord", F.struct((-F.length("name")).alias("l"), "concept", "name"))


#: Names up to which a lexicon is one automaton in every task, and of one part of a larger one.
BROADCAST_NAMES = 100_000
SPANS = "concept string, l int, name string, start int, `end` int"


def lower(text: str) -> str:
    """Lower case, place by place: a letter whose lower case is longer stays."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Automaton:
    """The names of a lexicon as one Aho-Corasick automaton: all whole-word mentions in one pass over a text."""

    def __init__(self, names: list[tuple[str, str, str]]):
        import ahocorasick

        self.names = sorted((-len(name), concept, name, key) for concept, name, key in names)
        self.machine = ahocorasick.Automaton()
        at: dict[str, list[int]] = {}
        for k, n in enumerate(self.names):
            at.setdefault(n[3], []).append(k)
        for key, ks in at.items():
            self.machine.add_word(key, ks)
        if at:
            self.machine.make_automaton()

    def mentions(self, text: str) -> list[tuple[int, int, int]]:
        """(place in the order of claim, start, end) of every mention; no letter or digit stands on either side."""
        if not self.names:
            return []
        low, out = lower(text), []
        for end, ks in self.machine.iter(low):
            start = end + 1 - len(self.names[ks[0]][3])
            if (start == 0 or not low[start - 1].isalnum()) and (end + 1 == len(low) or not low[end + 1].isalnum()):
                out += [(k, start, end + 1) for k in ks]
        return out


def claimed(found: list[tuple]) -> list[tuple]:
    """Of (order, start, end) those that claim their span: in order, then from the left, each span once."""
    out, starts, ends = [], [], []
    for x in sorted(found):
        i = bisect.bisect_right(starts, x[1])
        if (i == 0 or ends[i - 1] <= x[1]) and (i == len(starts) or starts[i] >= x[2]):
            starts.insert(i, x[1])
            ends.insert(i, x[2])
            out.append(x)
    return out


def auto_tag(docs: DataFrame, lexicon: DataFrame, limit: int | None = None) -> DataFrame:
    """(doc_id, concept, n, starts) of whole-word mentions; longer names claim their span first, then by concept and name.

    Up to BROADCAST_NAMES names are one automaton in every task: each text is read once, and nothing is exchanged. A larger
    lexicon is cut by the first words of its names; a text goes to the parts that have one of its words, and the mentions
    of one stretch of overlaps, never a whole text, contend for their spans.
    """
    names = lexicon.select("concept", "name", "key").distinct()
    size = names.count()
    d = docs.select("doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()
    if size <= BROADCAST_NAMES:
        spans = d.mapInArrow(_tag([tuple(r) for r in names.collect()]), f"doc_id {kind}, concept string, start int")  # bounded by BROADCAST_NAMES
    else:
        parts = -(-size // BROADCAST_NAMES) * 2
        word = lambda c: F.regexp_extract(c, r"[\p{L}\p{N}]+", 0)
        part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
        cut = names.withColumn("part", part(word("key")))
        asked = d.select("doc_id", "text", F.xxhash64("text").alias("h"), F.explode(F.array_distinct(F.concat(F.array(part(F.lit(""))), F.transform(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), part)))).alias("part"))
        deal = F.pmod("h", F.lit(DEAL)).cast("int")
        cut = cut.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1))))  # a part meets its texts in several tasks
        found = asked.withColumn("deal", deal).groupBy("part", "deal").cogroup(cut.groupBy("part", "deal")).applyInArrow(_find, f"doc_id {kind}, h long, {SPANS}")
        spans = contended(found)
    tags = spans.groupBy("doc_id", "concept").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("start")).alias("starts"))
    if limit is None:
        return tags.select("doc_id", "concept", "n", "starts")
    rn = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "concept"))
    return tags.withColumn("rank", rn).where(F.col("rank") <= limit).select("doc_id", "concept", "n", "starts")


#: Tasks among which one part of a large lexicon meets its texts.
DEAL = 16


def contended(found: DataFrame) -> DataFrame:
    """(doc_id, concept, start) of the mentions (doc_id, h: the text's hash, SPANS) that claim their spans: only spans of one stretch of overlaps contend."""
    by = Window.partitionBy("doc_id", "h").orderBy("start", "end", "concept", "name")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    cand = found.withColumn("opens", (reach.isNull() | (F.col("start") >= reach)).cast("int"))
    cand = cand.withColumn("stretch", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    one = cand.groupBy("doc_id", "h", "stretch").agg(F.array_sort(F.collect_list(F.struct("l", "concept", "name", "start", "end"))).alias("c"))
    kept = F.expr("aggregate(c, cast(array() as array<struct<start:int,end:int,concept:string>>), (acc, x) -> if(exists(acc, y -> x.start < y.end and y.start < x.end), acc, concat(acc, array(struct(x.start, x.end, x.concept)))))")
    return one.select("doc_id", F.explode(kept).alias("x")).select("doc_id", "x.concept", "x.start")


def _tag(names: list[tuple[str, str, str]]):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(names)
        for b in batches:
            rows, concepts, starts = [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                for order, start, _ in claimed(automaton.mentions(text)) if text else ():
                    rows.append(k)
                    concepts.append(automaton.names[order][1])
                    starts.append(start)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(concepts, pa.string()), pa.array(starts, pa.int32())], names=["doc_id", "concept", "start"])

    return f


def _find(texts: pa.Table, names: pa.Table) -> pa.Table:
    automaton = Automaton(list(zip(*(names[c].to_pylist() for c in ("concept", "name", "key")))))
    rows, found = [], []
    for k, text in enumerate(texts["text"].to_pylist()):
        for order, start, end in automaton.mentions(text) if text else ():
            l, concept, name, _ = automaton.names[order]
            rows.append(k)
            found.append((concept, l, name, start, end))
    types = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32())
    return pa.table([*[texts[c].take(pa.array(rows, pa.int64())) for c in ("doc_id", "h")], *[pa.array([x[k] for x in found], t) for k, t in enumerate(types)]], names=["doc_id", "h", "concept", "l", "name", "start", "end"])
