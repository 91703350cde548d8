"""A search index on disk that follows changes: immutable segments, and top hits by block-max pruning.

A batch of changed documents becomes one segment: the documents with their terms, the postings, the ids whose earlier
versions are void from here on, and what the batch adds to and takes from document frequencies. A manifest, committed
last, names the segments and the sums of lengths; readers of a manifest see its segments only. When MOST segments are
there, they are merged into one.

Documents of a segment are put in order of length and id and cut into blocks. For each term and block the largest
frequency, the least length and the least id are kept, which bound any score in the block, whatever the averages become.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources import store
from .search import B, DEFAULT_FIELDS, K1, PREFIX_MAX, PREFIX_MIN, PREFIX_WEIGHT, Index, query_terms

DOCS = "id string, iri string, kind string, label string, source_id string, fields map<string,string>, terms array<struct<field:string,term:string,tf:long>>, lens map<string,long>, blk long, seg int, db int"
POSTINGS = "field string, term string, id string, tf long, len long, blk long, seg int, tb int"
BLOCKS = "field string, term string, blk long, max_tf long, min_len long, min_id string, n long, seg int, tb int"
GONE = "id string, seg int"
DF = "field string, term string, df long, tb int"
#: Documents of a block are 2^10; blocks that a query looks into first.
BLOCK_BITS, SEEDS = 10, 8


class SegmentedIndex:
    """An index at a path; `apply` adds a batch, `index` gives it as tables that every search takes, `topk` prunes by blocks."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32, most: int = 8, keep: int = 3, block_bits: int = BLOCK_BITS):
        self.spark, self.path, self.buckets, self.most, self.keep, self.block_bits = spark, path, buckets, most, keep, block_bits
        self.versions = store.Versions(spark, f"{path}/manifest")

    def manifest(self) -> dict:
        return self.versions.read()[1] or {"segments": [], "n_docs": 0, "totals": {}, "buckets": self.buckets}

    def table(self, m: dict, name: str, schema: str, buckets: tuple[str, list[int]] | None = None) -> DataFrame:
        """One table of all segments; of some buckets only, if named."""
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/seg={s}/{name}") for s in m["segments"]]  # `most` at most
        out = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)
        return out.where(F.col(buckets[0]).isin(buckets[1])) if buckets else out

    def bucket(self, *c: str | Column) -> Column:
        return F.pmod(F.xxhash64(*c), F.lit(self.manifest()["buckets"])).cast("int")

    # Writing.
    def write_segment(self, docs: DataFrame, gone: DataFrame, number: int, name: str) -> None:
        """The tables of one segment, from documents (id, ..., fields) each once, and the ids (id) whose earlier versions are void."""
        at = f"{self.path}/seg={name}"
        tok = docs.select("id", F.explode("fields").alias("field", "value")).repartition("id").select("id", "field", F.explode(S.tokens(F.col("value"))).alias("term"))
        terms = tok.groupBy("id", "field", "term").agg(F.count("*").alias("tf")).groupBy("id").agg(F.collect_list(F.struct("field", "term", "tf")).alias("terms"))  # one exchange, by id
        d = docs.join(terms.hint("shuffle_merge"), "id", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<field:string,term:string,tf:bigint>>")))
        length = lambda k: F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.when(t["field"] == k, t["tf"]).otherwise(0))
        d = d.withColumn("lens", F.map_from_entries(F.transform(F.map_keys("fields"), lambda k: F.struct(k, length(k))))).withColumn("size", F.aggregate(F.map_values("lens"), F.lit(0).cast("long"), lambda n, x: n + x))
        d = d.repartitionByRange("size", "id").sortWithinPartitions("size", "id").withColumn("blk", F.shiftright(F.monotonically_increasing_id(), self.block_bits))
        d = d.select("id", "iri", "kind", "label", "source_id", "fields", "terms", "lens", "blk", F.lit(number).alias("seg"), self.bucket("id").alias("db"))
        d.write.mode("overwrite").partitionBy("db").parquet(f"{at}/docs")
        written = self.spark.read.schema(DOCS).parquet(f"{at}/docs")
        p = written.select("id", "blk", "lens", F.explode("terms").alias("t")).select("t.field", "t.term", "id", "t.tf", F.col("lens")[F.col("t.field")].alias("len"), "blk", F.lit(number).alias("seg"))
        p = p.withColumn("tb", self.bucket("field", "term"))
        p.repartition("tb", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("field", "term", "blk").write.mode("overwrite").partitionBy("tb").parquet(f"{at}/postings")
        b = self.spark.read.schema(POSTINGS).parquet(f"{at}/postings").groupBy("tb", "field", "term", "blk", "seg").agg(F.max("tf").alias("max_tf"), F.min("len").alias("min_len"), F.min("id").alias("min_id"), F.count("*").alias("n"))
        b.repartition("tb").write.mode("overwrite").partitionBy("tb").parquet(f"{at}/blocks")
        gone.select("id", F.lit(number).alias("seg")).write.mode("overwrite").parquet(f"{at}/gone")

    def live_docs(self, m: dict, buckets: list[int] | None = None) -> DataFrame:
        """The present version of each document: that of its last segment, if no later one made it void."""
        d = self.table(m, "docs", DOCS, ("db", buckets) if buckets is not None else None)
        gone = self.table(m, "gone", GONE).groupBy("id").agg(F.max("seg").alias("void"))
        return d.join(gone.hint("shuffle_merge"), "id", "left").where("void is null or seg >= void").drop("void")

    def apply(self, docs: DataFrame, removed: DataFrame | None = None, batch: int | None = None) -> bool:
        """Documents (as crawl_rows gives them; of one id the row with the greatest label and text) that are new or replace
        their earlier versions, and ids (id) that go. False if the batch was applied before."""
        last = self.versions.read()[0] // 2
        number = last + 1 if batch is None else batch
        if number <= last:
            return False
        m = self.manifest()
        order = F.struct("label", F.to_json("fields"))
        new = docs.groupBy("id").agg(F.max_by(F.struct("iri", "kind", "label", "source_id", "fields"), order).alias("x")).select("id", "x.*")
        new.write.mode("overwrite").parquet(f"{self.path}/seg={number}/new")
        new = self.spark.read.schema(new.schema).parquet(f"{self.path}/seg={number}/new")
        ids = new.select("id") if removed is None else new.select("id").union(removed.select("id")).distinct()
        ids.withColumn("db", self.bucket("id")).write.mode("overwrite").parquet(f"{self.path}/seg={number}/ids")
        ids = self.spark.read.schema("id string, db int").parquet(f"{self.path}/seg={number}/ids")
        touched = [r.db for r in ids.select("db").distinct().collect()]  # `buckets` at most
        old = self.live_docs(m, touched).join(ids.select("id").hint("shuffle_merge"), "id", "left_semi")
        old.write.mode("overwrite").parquet(f"{self.path}/seg={number}/old")
        old = self.spark.read.schema(old.schema).parquet(f"{self.path}/seg={number}/old")
        self.write_segment(new, old.select("id"), number, str(number))
        added = self.spark.read.schema(DOCS).parquet(f"{self.path}/seg={number}/docs")
        terms = lambda d, sign: d.select(F.explode("terms").alias("t")).select("t.field", "t.term", F.lit(sign).cast("long").alias("df"))
        df = terms(added, 1).unionByName(terms(old, -1)).groupBy("field", "term").agg(F.sum("df").alias("df")).where("df <> 0")
        df.withColumn("tb", self.bucket("field", "term")).repartition("tb").write.mode("overwrite").partitionBy("tb").parquet(f"{self.path}/seg={number}/df")
        sizes = lambda d, sign: d.select(F.explode("lens").alias("field", "len")).select("field", (F.col("len") * sign).alias("len"))
        totals = dict(m["totals"])
        for r in sizes(added, 1).unionByName(sizes(old, -1)).groupBy("field").agg(F.sum("len").alias("n")).collect():  # a row a field
            totals[r.field] = totals.get(r.field, 0) + r.n
        n_docs = m["n_docs"] + added.count() - old.count()
        for name in ("new", "ids", "old"):
            store.delete(self.spark, f"{self.path}/seg={number}/{name}")
        self.versions.commit(2 * number, {"segments": [*m["segments"], str(number)], "n_docs": n_docs, "totals": totals, "buckets": m["buckets"]})
        if len(m["segments"]) + 1 >= self.most:
            self.compact()
        return True

    def compact(self) -> None:
        """All segments as one, without what is void; a manifest of its own between those of two batches."""
        last, m = self.versions.read()
        if not m or len(m["segments"]) < 2:
            return
        name = f"{last // 2}c"
        live = self.live_docs(m).select("id", "iri", "kind", "label", "source_id", "fields")
        self.write_segment(live, self.spark.createDataFrame([], "id string"), last // 2, name)
        df = self.table(m, "df", DF).groupBy("tb", "field", "term").agg(F.sum("df").alias("df")).where("df <> 0")
        df.select("field", "term", "df", "tb").repartition("tb").write.mode("overwrite").partitionBy("tb").parquet(f"{self.path}/seg={name}/df")
        self.versions.commit(last + 1, m | {"segments": [name]})
        used = {str(s) for v in self.versions.forget(self.keep) for s in v["segments"]}
        for name in store.names(self.spark, self.path):
            if name.startswith("seg=") and name.removeprefix("seg=") not in used:
                store.delete(self.spark, f"{self.path}/{name}")

    # Reading.
    def corpus(self, m: dict) -> DataFrame:
        return self.spark.createDataFrame([(f, t, m["n_docs"]) for f, t in m["totals"].items()], "field string, total long, n_docs long")

    def live_postings(self, m: dict, buckets: list[int] | None = None) -> DataFrame:
        p = self.table(m, "postings", POSTINGS, ("tb", buckets) if buckets is not None else None)
        gone = self.table(m, "gone", GONE).groupBy("id").agg(F.max("seg").alias("void"))
        return p.join(gone.hint("shuffle_merge"), "id", "left").where("void is null or seg >= void").drop("void")

    def index(self) -> Index:
        """The present index as tables, for the searches of `search`."""
        m = self.manifest()
        docs, p = self.live_docs(m), self.live_postings(m)
        out = Index.__new__(Index)
        out.docs, out.postings = docs.select("id", "iri", "kind", "label", "source_id", "fields"), p.select("field", "term", "id", "tf")
        out.lengths = docs.select("id", F.explode("lens").alias("field", "len")).where("len > 0").select("field", "id", "len")
        out.corpus, out.df = self.corpus(m), self.table(m, "df", DF).groupBy("field", "term").agg(F.sum("df").alias("df")).where("df > 0")
        return out

    def drop_work(self) -> None:
        """Delete what topk wrote on the way, once its results are no longer read."""
        store.delete(self.spark, f"{self.path}/work")

    def topk(self, queries: DataFrame, k: int, fields: dict[str, float] | None = None, prefix: bool = True, digits: int = 9) -> tuple[DataFrame, dict]:
        """(qid, id, score, rank) of each query's k best by score (rounded), then id: the rows that ranking all matches
        gives; and how many (query, block) pairs there were, were looked into first, and were opened.

        Every block of documents has a bound for each query, the sum of its terms' bounds. Some of the best blocks are
        scored first; the k-th score there closes all blocks that cannot reach it. Postings of closed blocks are not scored.
        """
        m = self.manifest()
        q = query_terms(queries, fields or DEFAULT_FIELDS)
        corpus = F.broadcast(self.corpus(m))  # a row a field
        df = self.table(m, "df", DF).groupBy("field", "term").agg(F.sum("df").alias("df")).where("df > 0")
        blocks = self.table(m, "blocks", BLOCKS)
        impact = lambda tf, length: F.col("m") * F.col("boost") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("avg")))
        weighed = q.join(df.hint("shuffle_merge"), ["field", "term"]).join(corpus, "field")
        weighed = weighed.withColumn("idf", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))).withColumn("avg", F.greatest(F.lit(1.0), F.col("total") / F.greatest(F.lit(1), F.col("n_docs"))))
        weighed = weighed.select("qid", "field", "term", "m", "boost", "idf", "avg", F.lit(False).alias("near"))
        if prefix:
            tail = q.where("term = tail").where(F.length("term").between(PREFIX_MIN, PREFIX_MAX)).select("qid", "field", "boost", F.col("term").alias("start"), F.substring("term", 1, PREFIX_MIN).alias("head"))
            words = df.select("field", "term", F.substring("term", 1, PREFIX_MIN).alias("head"))
            grown = tail.join(words.hint("shuffle_merge"), ["field", "head"]).where(F.col("term").startswith(F.col("start")))
            weighed = weighed.unionByName(grown.select("qid", "field", "term", F.lit(0).cast("long").alias("m"), "boost", F.lit(0.0).alias("idf"), F.lit(1.0).alias("avg"), F.lit(True).alias("near")))
        work = f"{self.path}/work/{uuid.uuid4().hex}"

        def kept(d: DataFrame, name: str) -> DataFrame:
            d.write.parquet(f"{work}/{name}")
            return self.spark.read.schema(d.schema).parquet(f"{work}/{name}")

        def summed(d: DataFrame, tf: str, length: str, by: list[str]) -> DataFrame:
            """Score by document or block: every term's part, and of a field its share for prefixes once."""
            part = d.groupBy(*by, "field", "near").agg(F.sum(impact(F.col(tf), F.col(length))).alias("s"), F.first("boost").alias("boost"), F.min("first_id").alias("first_id"))
            return part.groupBy(*by).agg(F.sum(F.when(F.col("near"), PREFIX_WEIGHT * F.col("boost")).otherwise(F.col("s"))).alias("score"), F.min("first_id").alias("first_id"))

        weighed = kept(weighed, "terms")
        met = blocks.withColumnRenamed("min_id", "first_id").join(weighed.hint("shuffle_merge"), ["field", "term"])
        bound = kept(summed(met, "max_tf", "min_len", ["qid", "seg", "blk"]).withColumnRenamed("score", "bound"), "bounds")
        postings = self.live_postings(m).withColumn("first_id", F.col("id"))

        def hits(opened: DataFrame) -> DataFrame:
            of = weighed.join(opened.hint("shuffle_merge"), "qid")
            return summed(postings.join(of.hint("shuffle_merge"), ["field", "term", "seg", "blk"]), "tf", "len", ["qid", "id"]).select("qid", "id", F.round("score", digits).alias("score"))

        best = F.max_by(F.struct("seg", "blk"), F.struct("bound", "first_id")).alias("x")
        seeds = bound.groupBy("qid", F.pmod(F.xxhash64("seg", "blk"), F.lit(SEEDS)).alias("deal")).agg(best).select("qid", "x.*")
        rank = lambda d: d.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")))
        last = kept(rank(hits(seeds)).where(F.col("rank") == k).select("qid", F.col("score").alias("least"), F.col("id").alias("least_id")), "least")
        unit = 10.0**-digits
        reach = F.round("bound", digits) + unit  # what rounding and the order of sums may add
        able = F.col("least").isNull() | (reach > F.col("least") + 2.5 * unit) | ((reach >= F.col("least")) & (F.col("first_id") <= F.col("least_id")))
        opened = kept(bound.join(last.hint("shuffle_merge"), "qid", "left").where(able).select("qid", "seg", "blk"), "opened")
        counts = {"blocks": bound.count(), "first": seeds.count(), "opened": opened.count()}
        return rank(hits(opened)).where(F.col("rank") <= k), counts

