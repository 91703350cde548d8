"""Full-text search by BM25 over postings tables, and what builds on it."""

from __future__ import annotations

from copy import copy

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import TASK_ROWS, dealt

K1, B, PREFIX_WEIGHT, PREFIX_MIN, PREFIX_MAX = 1.2, 0.75, 0.3, 2, 12
DEFAULT_FIELDS = {"label": 3.0, "text": 1.0}


def crawl_rows(df: DataFrame, kind: str, iri, label, texts: list, source: str) -> DataFrame:
    """Search documents of a table: label, and all texts."""
    head = F.coalesce(F.nullif(label, F.lit("")), *texts[:1], iri)
    fields = F.create_map(F.lit("label"), F.concat_ws(" ", *texts[:2]), F.lit("text"), F.concat_ws(" ", *texts))
    return df.select(iri.alias("id"), iri.alias("iri"), F.lit(kind).alias("kind"), head.alias("label"), F.lit(source).alias("source_id"), fields.alias("fields"))


class Index:
    """postings(field, term, id, tf), lengths(field, id, len), corpus(field, total) and the number of documents."""

    def __init__(self, docs: DataFrame, postings: DataFrame, lengths: DataFrame):
        self.docs, self.postings, self.lengths = docs, postings, lengths
        self.corpus = lengths.groupBy("field").agg(F.sum("len").alias("total")).crossJoin(F.broadcast(docs.agg(F.count("*").alias("n_docs"))))  # two fields by one row
        self.df = postings.groupBy("field", "term").agg(F.count("*").alias("df"))


def build_index(docs: DataFrame) -> Index:
    """One pass: tokens per field, counted per document where it lies. Term statistics are sums over postings."""
    tok = dealt(docs, "id", rows=TASK_ROWS).select("id", F.explode("fields").alias("field", "value")).select("id", "field", F.explode(S.tokens(F.col("value"))).alias("term"))
    postings = tok.groupBy("field", "term", "id").agg(F.count("*").alias("tf"))
    lengths = postings.groupBy("field", "id").agg(F.sum("tf").alias("len"))
    return Index(docs, postings, lengths)


def postings_with_counts(index: Index) -> DataFrame:
    """Postings with the length of their document's field and the number of documents of their term.

    Terms of FREQUENT postings or more, of which there are few against the postings, are broadcast: no task gets all of one.
    """
    p = index.postings.join(index.lengths.hint("shuffle_merge"), ["field", "id"])
    often, rest = index.df.where(F.col("df") >= FREQUENT), index.df.where(F.col("df") < FREQUENT)
    names = F.broadcast(often.select("field", "term"))
    return p.join(F.broadcast(often), ["field", "term"]).unionByName(p.join(names, ["field", "term"], "left_anti").join(rest.hint("shuffle_merge"), ["field", "term"]))


def index_upsert(index: Index, docs: DataFrame) -> Index:
    new = build_index(docs)
    gone = docs.select("id")
    keep = lambda d: d.join(gone.hint("shuffle_merge"), "id", "left_anti")
    return Index(keep(index.docs).unionByName(docs), keep(index.postings).unionByName(new.postings), keep(index.lengths).unionByName(new.lengths))


def index_remove(index: Index, ids: DataFrame) -> Index:
    keep = lambda d: d.join(ids.hint("shuffle_merge"), "id", "left_anti")
    return Index(keep(index.docs), keep(index.postings), keep(index.lengths))


def query_terms(queries: DataFrame, fields: dict[str, float]) -> DataFrame:
    """(qid, field, boost, term, last, m): a query's tokens by field, repeats counted in m."""
    spark = queries.sparkSession
    f = spark.createDataFrame(list(fields.items()), "field string, boost double")
    t = queries.select("qid", S.tokens(F.col("text")).alias("ts")).select("qid", F.element_at("ts", -1).alias("tail"), F.explode("ts").alias("term"))
    t = t.groupBy("qid", "tail", "term").agg(F.count("*").alias("m"))
    return t.crossJoin(F.broadcast(f))  # two fields: a row each


#: Query terms up to which they are broadcast, and postings from which a term counts as frequent.
BROADCAST_TERMS, FREQUENT = 100_000, 100_000


def bm25_match(index: Index, queries: DataFrame, fields: dict[str, float] | None = None, prefix: bool = True) -> DataFrame:
    """(qid, id, score) of queries (qid, text): every token in every field, the last token also as a prefix.

    Terms join postings on (field, term); one aggregation per (query, document). Prefixes expand to the vocabulary's
    terms by their first PREFIX_MIN characters, an equi-join, before they touch postings. Few query terms are broadcast,
    so that the postings of a frequent one stay where they are.
    """
    q = query_terms(queries, fields or DEFAULT_FIELDS)
    few = q.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    by_term = lambda d: F.broadcast(d) if few else d.hint("shuffle_merge")
    asked = by_term(index.df.join(by_term(q), ["field", "term"]))
    hit = index.postings.join(asked, ["field", "term"]).join(index.lengths.hint("shuffle_merge"), ["field", "id"]).join(F.broadcast(index.corpus), "field")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    avg = F.greatest(F.lit(1.0), F.col("total") / F.greatest(F.lit(1), F.col("n_docs")))
    score = F.col("m") * F.col("boost") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / avg))
    out = hit.select("qid", "id", score.alias("score"))
    if prefix:
        tail = q.where("term = tail").select("qid", "field", "boost", "term").where(F.length("term").between(PREFIX_MIN, PREFIX_MAX)).withColumn("head", F.substring("term", 1, PREFIX_MIN))
        words = index.df.select("field", F.col("term").alias("word"), F.substring("term", 1, PREFIX_MIN).alias("head"))
        grown = tail.join(words.hint("shuffle_merge"), ["field", "head"]).where(F.col("word").startswith(F.col("term"))).select("qid", "field", "boost", F.col("word").alias("term"))
        near = grown.join(index.postings.select("field", "term", "id").hint("shuffle_merge"), ["field", "term"]).select("qid", "field", "boost", "id").distinct()
        out = out.unionByName(near.select("qid", "id", (PREFIX_WEIGHT * F.col("boost")).alias("score")))
    return out.groupBy("qid", "id").agg(F.sum("score").alias("score"))


def q_match_all(index: Index) -> DataFrame:
    return index.docs.select("id", F.lit(1.0).alias("score"))


def q_term(index: Index, field: str, value: str) -> DataFrame:
    return index.docs.where(F.coalesce(F.col(field).cast("string"), F.lit("")) == value).select("id", F.lit(1.0).alias("score"))


def q_bool(must=(), filters=(), should=(), must_not=(), index: Index | None = None) -> DataFrame:
    """Must and filter clauses intersect and add their scores; should clauses add (alone they select); must_not removes."""
    out = None
    for c in [*must, *filters]:
        c = c.select("id", F.col("score").alias("s2"))
        out = c.withColumnRenamed("s2", "score") if out is None else out.join(c.hint("shuffle_merge"), "id").select("id", (F.col("score") + F.col("s2")).alias("score"))
    alone = out is None
    if alone:
        out = index.docs.select("id", F.lit(0.0).alias("score"))
    for c in should:
        out = out.join(c.select("id", F.col("score").alias("s2")).hint("shuffle_merge"), "id", "left").select("id", (F.col("score") + F.coalesce("s2", F.lit(0.0))).alias("score"))
    if alone and should:
        out = out.where("score > 0")
    for c in must_not:
        out = out.join(c.select("id").hint("shuffle_merge"), "id", "left_anti")
    return out


def topk_hits(hits: DataFrame, size: int, start: int = 0) -> DataFrame:
    """A page per query: score down, then id."""
    rn = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rn).where((F.col("rank") > start) & (F.col("rank") <= start + size))


def terms_facet(hits: DataFrame, docs: DataFrame, field: str, size: int = 20) -> DataFrame:
    """Counts over all matches, not the page."""
    return hits.join(docs.select("id", F.col(field).alias("key")).hint("shuffle_merge"), "id").where("key is not null").groupBy("key").count().orderBy(F.desc("count"), "key").limit(size).select("key", F.col("count").alias("n"))


def highlight(df: DataFrame, text: str, query: str, width: int = 90, before: int = 30) -> DataFrame:
    """A fragment around the first token of two characters or more, tokens wrapped in <em>."""
    import re

    words = sorted({t for t in re.findall(r"\w+", query.lower()) if len(t) > 1}, key=lambda t: (-len(t), t))
    places = [F.locate(w, F.lower(F.col(text))) for w in words]
    at = F.least(*[F.when(p > 0, p) for p in places]) if len(places) > 1 else F.when(places[0] > 0, places[0])
    start = F.greatest(F.lit(1), F.coalesce(at, F.lit(1)) - before)
    frag = F.substring(F.col(text), start, F.lit(width))
    for w in words:
        frag = F.regexp_replace(frag, r"(?i)\Q" + w + r"\E", "<em>$0</em>")
    return df.withColumn("fragment", F.concat(F.when(start > 1, "…").otherwise(""), frag, F.when(F.length(text) >= start + width, "…").otherwise("")))


def alike(docs: DataFrame, most: int) -> DataFrame:
    """(rep, id, label): documents of the same fields score alike, so the least id of each such group stands for it; its `most` least ids."""
    by = Window.partitionBy("__fields").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = docs.select("id", "label", F.sha2(F.to_json(F.array_sort(F.map_entries("fields"))), 256).alias("__fields"))
    return d.withColumn("rep", F.first("id").over(by)).withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= most).select("rep", "id", "label")


def reconcile_batch(index: Index, queries: DataFrame, limit: int = 3) -> DataFrame:
    """(qid, id, label, score, exact, rank): exact labels 100, the rest 90 times their share of the best score; equal scores (to nine places) by id.

    Each text is asked once, of one document of each group that has the same fields, by the statistics of the whole
    index: a text's `most` best documents lie in its `most` best groups, each with its least ids.
    """
    most = min(20, 4 * limit)
    q = queries.where(F.trim("text") != "").select("qid", "text")
    members = alike(index.docs, most)
    reps = members.where("id = rep").select("id")
    few = copy(index)
    few.postings, few.lengths = (d.join(reps.hint("shuffle_merge"), "id", "left_semi") for d in (index.postings, index.lengths))
    asked = q.select("text").distinct().select(F.col("text").alias("qid"), "text")
    found = topk_hits(bm25_match(few, asked).withColumn("score", F.round("score", 9)), most).select("qid", F.col("id").alias("rep"), "score")
    hits = topk_hits(found.join(members.hint("shuffle_merge"), "rep"), most).select(F.col("qid").alias("text"), "id", "label", "score")
    best = F.max("score").over(Window.partitionBy("text"))
    exact = F.lower(F.trim("label")) == F.lower(F.trim("text"))
    out = hits.withColumn("exact", exact).withColumn("points", F.when(exact, 100.0).otherwise(F.round(F.col("score") / best * 90)))
    rn = F.row_number().over(Window.partitionBy("text").orderBy(F.desc("points"), F.desc("exact"), "id"))
    out = out.withColumn("rank", rn).where(F.col("rank") <= limit).drop("score")
    return q.join(out.hint("shuffle_merge"), "text").select("qid", "id", "label", F.col("points").cast("long").alias("score"), "exact", "rank")


def near_duplicate_labels(index: Index, rows: DataFrame) -> DataFrame:
    """Import labels close to, but not the same as, an indexed one."""
    return reconcile_batch(index, rows, 1).where("score >= 60 and not exact")
