"""Queries on search, matching, tagging and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import DATA, GRAPH, NS, SKOS, XSD
from ..operators import match, search, segments
from ..plans import meta
from ..plans.meta import TABLES, load
from .base import query, scratch

#: Search documents in SQL: customers, parts and the region and nation concepts.
DOCS = f"""docs AS (
  SELECT '{DATA}customer/' || c_custkey AS id, 'data' AS kind, 'crm' AS source_id, c_name AS label, concat_ws(' ', c_name, c_mktsegment) AS f_label, concat_ws(' ', c_name, c_mktsegment) AS f_text FROM customer
  UNION ALL SELECT '{DATA}part/' || p_partkey, 'data', 'supply', p_name, concat_ws(' ', p_name, p_brand), concat_ws(' ', p_name, p_brand, p_type) FROM part
  UNION ALL SELECT '{NS}geo/n' || n_nationkey, 'model', 'crm', n_name, n_name, n_name FROM nation)"""
INDEX = f"""WITH {DOCS}, f AS (SELECT id, 'label' AS field, f_label AS v FROM docs UNION ALL SELECT id, 'text', f_text FROM docs),
t AS (SELECT id, field, unnest(list_filter(string_split_regex(lower(v), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM f),
p AS (SELECT field, term, id, count(*) AS tf FROM t GROUP BY ALL),
len AS (SELECT field, id, sum(tf) AS len FROM p GROUP BY ALL),
n AS (SELECT count(*) AS n FROM docs), tot AS (SELECT field, sum(len) AS total FROM len GROUP BY field),
df AS (SELECT field, term, count(*) AS df FROM p GROUP BY ALL)"""


def bm25_sql(queries: str, boosts="(SELECT 'label' AS field, 3.0 AS boost UNION ALL SELECT 'text', 1.0)") -> str:
    """CTEs qt (query terms), s (scores) after INDEX; queries: a SELECT of qid, text."""
    return f""", qs AS ({queries}),
qw AS (SELECT qid, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ts FROM qs),
qt AS (SELECT qid, term, tail, count(*) AS m FROM (SELECT qid, unnest(ts) AS term, ts[-1] AS tail FROM qw) GROUP BY ALL),
hit AS (SELECT qt.qid, p.id, m * boost * ln(1 + (n.n - df.df + 0.5) / (df.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len.len / greatest(1.0, tot.total / greatest(1, n.n)))) AS score
  FROM qt JOIN p ON p.term = qt.term JOIN {boosts} b ON b.field = p.field JOIN df ON df.field = p.field AND df.term = p.term JOIN len ON len.field = p.field AND len.id = p.id JOIN tot ON tot.field = p.field, n),
pre AS (SELECT DISTINCT qt.qid, p.id, b.field, 0.3 * boost AS score FROM qt JOIN p ON starts_with(p.term, qt.term) JOIN {boosts} b ON b.field = p.field WHERE qt.term = qt.tail AND length(qt.term) BETWEEN 2 AND 12),
s AS (SELECT qid, id, sum(score) AS score FROM (SELECT qid, id, score FROM hit UNION ALL SELECT qid, id, score FROM pre) GROUP BY ALL)"""


def docs(spark, sf):
    c = search.crawl_rows(load(spark, sf, "customer"), "data", meta.subject(TABLES["customer"]), F.col("c_name"), [F.col("c_name"), F.col("c_mktsegment")], "crm")
    p = search.crawl_rows(load(spark, sf, "part"), "data", meta.subject(TABLES["part"]), F.col("p_name"), [F.col("p_name"), F.col("p_brand"), F.col("p_type")], "supply")
    n = search.crawl_rows(load(spark, sf, "nation"), "model", F.concat(F.lit(NS + "geo/n"), F.col("n_nationkey").cast("string")), F.col("n_name"), [F.col("n_name")], "crm")
    return c.unionByName(p).unionByName(n)


def index(spark, sf):
    return search.build_index(docs(spark, sf))


def ask(spark, sf):
    """The market segments and brands of the data as queries."""
    a = load(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_mktsegment")).alias("qid"), F.col("c_mktsegment").alias("text")).distinct()
    b = load(spark, sf, "part").select(F.concat(F.lit("b"), F.col("p_brand")).alias("qid"), F.col("p_brand").alias("text")).distinct()
    return a.union(b)


ASK = "SELECT DISTINCT 'c' || c_mktsegment AS qid, c_mktsegment AS text FROM customer UNION SELECT DISTINCT 'b' || p_brand, p_brand FROM part"
ROUND = "round(score, 6) AS score"


@query("crawl_rows", f"WITH {DOCS} SELECT id, kind, source_id, label, f_label, f_text FROM docs")
def crawl_rows(spark, sf):
    return docs(spark, sf).select("id", "kind", "source_id", "label", F.col("fields")["label"].alias("f_label"), F.col("fields")["text"].alias("f_text"))


@query("build_index", f"{INDEX} SELECT p.field AS field, p.term AS term, p.id AS id, p.tf AS tf, len.len AS len, df.df AS df FROM p JOIN len ON p.field = len.field AND p.id = len.id JOIN df ON p.field = df.field AND p.term = df.term")
def build_index(spark, sf):
    return search.postings_with_counts(index(spark, sf)).select("field", "term", "id", "tf", "len", "df")


@query("bm25_match", f"{INDEX}{bm25_sql(ASK)} SELECT qid, id, {ROUND} FROM s")
def bm25_match(spark, sf):
    return search.bm25_match(index(spark, sf), ask(spark, sf)).withColumn("score", F.round("score", 6))


TEXT_ONLY = "(SELECT 'text' AS field, 1.0 AS boost)"
ONE = "SELECT 'q' AS qid, 'building customer' AS text"


def one(spark, text="building customer"):
    return spark.createDataFrame([("q", text)], "qid string, text string")


@query("q_match", f"{INDEX}{bm25_sql(ONE, TEXT_ONLY)} SELECT id, {ROUND} FROM s")
def q_match(spark, sf):
    return search.bm25_match(index(spark, sf), one(spark), {"text": 1.0}).select("id", F.round("score", 6).alias("score"))


@query("q_multi_match", f"{INDEX}{bm25_sql(ONE)} SELECT id, {ROUND} FROM s")
def q_multi_match(spark, sf):
    return search.bm25_match(index(spark, sf), one(spark)).select("id", F.round("score", 6).alias("score"))


@query("q_query_string", f"{INDEX}{bm25_sql(ONE.replace('building customer', 'machinery'))} SELECT id, {ROUND} FROM s")
def q_query_string(spark, sf):
    return search.bm25_match(index(spark, sf), one(spark, "machinery")).select("id", F.round("score", 6).alias("score"))


@query("q_prefix", f"{INDEX}{bm25_sql(ONE.replace('building customer', 'bran'))} SELECT id, {ROUND} FROM s")
def q_prefix(spark, sf):
    return search.bm25_match(index(spark, sf), one(spark, "bran")).select("id", F.round("score", 6).alias("score"))


@query("q_match_all", f"WITH {DOCS} SELECT id, 1.0 AS score FROM docs")
def q_match_all(spark, sf):
    return search.q_match_all(index(spark, sf))


@query("q_term", f"WITH {DOCS} SELECT id, 1.0 AS score FROM docs WHERE kind = 'model'")
def q_term(spark, sf):
    return search.q_term(index(spark, sf), "kind", "model")


@query("q_bool", f"""{INDEX}{bm25_sql(ONE)} SELECT id, round(score + 1, 6) AS score FROM s JOIN docs USING (id) WHERE kind = 'data' AND source_id <> 'supply'""")
def q_bool(spark, sf):
    i = index(spark, sf)
    hits = search.bm25_match(i, one(spark)).select("id", "score")
    return search.q_bool(must=[hits], filters=[search.q_term(i, "kind", "data")], must_not=[search.q_term(i, "source_id", "supply")], index=i).select("id", F.round("score", 6).alias("score"))


@query("topk_hits", f"{INDEX}{bm25_sql(ASK)}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM s) SELECT qid, id, rank FROM r WHERE rank <= 10")
def topk_hits(spark, sf):
    hits = search.bm25_match(index(spark, sf), ask(spark, sf)).withColumn("score", F.round("score", 9))
    return search.topk_hits(hits, 10).select("qid", "id", "rank")


@query("terms_facet", f"{INDEX}{bm25_sql(ONE)} SELECT source_id AS key, count(*) AS n FROM s JOIN docs USING (id) GROUP BY source_id ORDER BY n DESC, key LIMIT 20")
def terms_facet(spark, sf):
    i = index(spark, sf)
    return search.terms_facet(search.bm25_match(i, one(spark)).select("id"), i.docs, "source_id")


@query("index_remove", f"{INDEX} SELECT count(*) AS n, sum(tf) AS tokens FROM p WHERE id NOT IN (SELECT id FROM docs WHERE kind = 'model')")
def index_remove(spark, sf):
    d = docs(spark, sf)
    i = search.index_remove(search.build_index(d), d.where("kind = 'model'").select("id"))
    return i.postings.agg(F.count("*").alias("n"), F.sum("tf").alias("tokens"))


def indexed(spark, sf):
    """The search documents as an index on disk, in three batches; the second replaces documents of the first by themselves."""
    i = segments.SegmentedIndex(spark, scratch(spark, "index"), buckets=4, block_bits=6)
    d = docs(spark, sf)
    i.apply(d.where("kind = 'data'"))
    i.apply(d.where("source_id = 'supply'"))
    i.apply(d.where("kind = 'model'"))
    return i


@query("topk_pruned", f"{INDEX}{bm25_sql(ASK)}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM s) SELECT qid, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def topk_pruned(spark, sf):
    """The ten best of each query from an index on disk, blocks that cannot reach them left closed."""
    hits, _ = indexed(spark, sf).topk(ask(spark, sf), 10)
    return hits.select("qid", "id", F.round("score", 6).alias("score"), "rank")


def names(spark, sf):
    """Names to reconcile: every nation and every market segment."""
    a = load(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("qid"), F.col("n_name").alias("text"))
    b = load(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_mktsegment")).alias("qid"), F.col("c_mktsegment").alias("text")).distinct()
    return a.union(b)


NAMES = "SELECT 'n' || n_nationkey AS qid, n_name AS text FROM nation UNION ALL SELECT DISTINCT 'c' || c_mktsegment, c_mktsegment FROM customer"
RECON = f"""{INDEX}{bm25_sql(NAMES)}, k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rk FROM (SELECT qid, id, round(score, 9) AS score FROM s)),
b AS (SELECT k.qid AS qid, k.id AS id, docs.label AS label, lower(docs.label) = lower(qs.text) AS exact, CASE WHEN lower(docs.label) = lower(qs.text) THEN 100.0 ELSE round(score / max(score) OVER (PARTITION BY k.qid) * 90) END AS points FROM k JOIN docs USING (id) JOIN qs ON qs.qid = k.qid WHERE rk <= 12),
z AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY points DESC, exact DESC, id) AS rank FROM b)"""


@query("reconcile_batch", f"{RECON} SELECT qid, id, label, CAST(points AS BIGINT) AS score, exact, rank FROM z WHERE rank <= 3")
def reconcile_batch(spark, sf):
    return search.reconcile_batch(index(spark, sf), names(spark, sf))


def scheme(spark, sf, altered=False):
    """Customers and part names as concepts, those of even number or length with another label; or the same with a word added to the label."""
    c = load(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("k"), F.col("c_name").alias("x"), (F.col("c_custkey") % 2 == 0).alias("even"))
    p = load(spark, sf, "part").select("p_name").distinct().select(F.concat(F.lit("p"), S.slug(F.col("p_name"))).alias("k"), F.col("p_name").alias("x"), (F.length("p_name") % 2 == 0).alias("even"))
    label = F.concat(F.initcap("x"), F.lit(" Area")) if altered else F.col("x")
    return c.union(p).select(F.concat(F.lit(f"{NS}{'b' if altered else 'a'}/"), "k").alias("iri"), label.alias("label"), F.when(F.col("even"), F.array("x")).otherwise(F.array().cast("array<string>")).alias("alts"))


CROSS = f"""WITH e AS (SELECT 'c' || c_custkey AS k, c_name AS x, c_custkey % 2 = 0 AS even FROM customer UNION ALL SELECT DISTINCT 'p' || regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), p_name, length(p_name) % 2 = 0 FROM part),
a AS (SELECT '{NS}a/' || k AS iri, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) AS label, x FROM e),
b AS (SELECT '{NS}b/' || k AS iri, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) || ' area' AS label, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) AS alt, even FROM e),
ex AS (SELECT a.iri AS a, b.iri AS b FROM a JOIN b ON a.label = b.alt AND b.even),
ta AS (SELECT iri, unnest(list_distinct(string_split(label, ' '))) AS t, len(list_distinct(string_split(label, ' '))) AS n FROM a), tb AS (SELECT iri, unnest(list_distinct(string_split(label, ' '))) AS t, len(list_distinct(string_split(label, ' '))) AS n FROM b),
fz AS (SELECT ta.iri AS a, tb.iri AS b, count(*) * 1.0 / (ta.n + tb.n - count(*)) AS j FROM ta JOIN tb ON ta.t = tb.t GROUP BY ta.iri, tb.iri, ta.n, tb.n),
x AS (SELECT a, b, 0.95 AS score, 'exact' AS reason FROM ex UNION ALL SELECT a, b, round(j * 80) / 100, 'overlap' FROM fz ANTI JOIN ex USING (a, b) WHERE j >= 0.5)"""


def crosswalk(spark, sf, mapped=None):
    return match.crosswalk_suggest(scheme(spark, sf), scheme(spark, sf, True), mapped, limit=None, ascii_only=True)


@query("crosswalk_suggest", f"{CROSS} SELECT * FROM x")
def crosswalk_suggest(spark, sf):
    return crosswalk(spark, sf)


@query("crosswalk_accept", f"{CROSS} SELECT a AS s, '{SKOS}exactMatch' AS p, b AS o FROM x WHERE reason = 'exact'")
def crosswalk_accept(spark, sf):
    return match.crosswalk_facts(crosswalk(spark, sf).where("reason = 'exact'"), "exactMatch", GRAPH + "maps").select("s", "p", "o")


@query("crosswalk_remove", f"{CROSS} SELECT a, b FROM x WHERE reason = 'overlap'")
def crosswalk_remove(spark, sf):
    """What is left to suggest when the exact pairs are mapped."""
    return crosswalk(spark, sf, crosswalk(spark, sf).where("reason = 'exact'")).select("a", "b")


@query("crosswalk_list", f"{CROSS} SELECT x.a AS a, 'closeMatch' AS relation, x.b AS b, n.x AS label_a FROM x JOIN a n ON n.iri = x.a")
def crosswalk_list(spark, sf):
    q = match.crosswalk_facts(crosswalk(spark, sf), "closeMatch", GRAPH + "maps")
    return match.crosswalk_list(q, scheme(spark, sf).select("iri", "label")).select("a", "relation", "b", "label_a")


VOCAB = [(0, "MonetaryAmount", "Finance", ["amount", "total", "balance", "price", "acctbal", "total price", "account balance"]), (1, "Party", "Parties", ["customer", "supplier", "client"]), (2, "Identifier", "Reference", ["key", "id", "number"]), (3, "Date", "Time", ["date", "ts", "order date"]), (4, "Status", "Process", ["status", "order status", "priority"]), (5, "Name", "Reference", ["name", "label"])]


def vocabulary(spark):
    return spark.createDataFrame(VOCAB, "ord int, concept string, area string, keywords array<string>")


EXPECTED = {"c_acctbal": ("MonetaryAmount", 2), "s_acctbal": ("MonetaryAmount", 2), "c_name": ("Name", 2), "n_name": ("Name", 2), "p_name": ("Name", 2), "s_name": ("Name", 2), "r_name": ("Name", 2), "customer": ("Party", 3), "supplier": ("Party", 3), "event_id": ("Identifier", 2), "doc_id": ("Identifier", 2), "user_id": ("Identifier", 2), "ts": ("Date", 3)}


def lexicon(spark, sf):
    """Concepts named by the benchmark's words: the first two words of each item, and its first word alone."""
    b = load(spark, sf, "benchmark").select("item_id", F.slice(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) > 2), 1, 2).alias("w")).where("size(w) = 2")
    return match.concept_lexicon(b.select(F.concat(F.lit(NS + "b/"), F.col("item_id").cast("string")).alias("iri"), F.array(F.array_join("w", " "), F.element_at("w", 1)).alias("names")))


@query("concept_lexicon", f"""WITH w AS (SELECT item_id, list_slice(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) > 2), 1, 2) AS w FROM benchmark)
SELECT DISTINCT '{NS}b/' || item_id AS concept, unnest([w[1] || ' ' || w[2], w[1]]) AS key FROM w WHERE len(w) = 2""")
def concept_lexicon(spark, sf):
    return lexicon(spark, sf).select("concept", "key")


@query("auto_tag", f"""WITH w AS (SELECT item_id, list_slice(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) > 2), 1, 2) AS w FROM benchmark),
lex AS (SELECT DISTINCT '{NS}b/' || item_id AS concept, unnest([w[1] || ' ' || w[2], w[1]]) AS name FROM w WHERE len(w) = 2),
p AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') AS ps FROM documents),
x AS (SELECT doc_id, unnest(ps) AS a, unnest(ps[2:]) AS gap, unnest(ps[3:]) AS b, unnest(range(1, len(ps) + 1)) AS i FROM p),
y AS (SELECT doc_id, a, gap, b, CAST(sum(length(a)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) - length(a) AS BIGINT) AS s FROM x),
c AS (SELECT doc_id, concept, name, s, s + length(name) AS e FROM y JOIN lex ON name = a UNION ALL SELECT doc_id, concept, name, s, s + length(name) FROM y JOIN lex ON gap = ' ' AND name = a || ' ' || b),
o AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY s, e, concept, name ROWS UNBOUNDED PRECEDING) AS stretch FROM (
  SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY doc_id ORDER BY s, e, concept, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM c)),
g AS (SELECT doc_id, list_transform(list_sort(list({{'l': -length(name), 'c': concept, 'n': name, 's': s, 'e': e}})), lambda z: [z]) AS l FROM o GROUP BY doc_id, stretch),
k AS (SELECT doc_id, unnest(list_reduce(l, lambda acc, z: CASE WHEN len(list_filter(acc, lambda q: q.s < z[1].e AND z[1].s < q.e)) > 0 THEN acc ELSE list_concat(acc, z) END)) AS t FROM g)
SELECT doc_id, t.c AS concept, count(*) AS n, string_agg(CAST(t.s AS VARCHAR), ',' ORDER BY t.s) AS starts FROM k GROUP BY doc_id, t.c""")
def auto_tag(spark, sf):
    return match.auto_tag(load(spark, sf, "documents").select("doc_id", "text"), lexicon(spark, sf), limit=None).withColumn("starts", F.array_join(F.col("starts").cast("array<string>"), ","))


# Scalar functions over whole columns.
@query("xsd_for", " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS \"column\", '{meta.datatype(ty)}' AS datatype FROM {n}" for n in ("customer", "orders", "events") for c, ty in TABLES[n].columns))
def xsd_for(spark, sf):
    """Datatypes from the files' own schemas."""
    rows = [(f.name, meta.SQL_TYPES[f.dataType.simpleString().replace("timestamp_ntz", "timestamp")]) for n in ("customer", "orders", "events") for f in load(spark, sf, n).schema.fields]
    return spark.createDataFrame(rows, "column string, sql_type string").select("column", S.xsd_for(F.col("sql_type")).alias("datatype")).distinct()


@query("scalars_names", f"""SELECT DISTINCT p_type AS x, regexp_replace(p_type, '[^A-Za-z0-9_-]', '_', 'g') AS sane, regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '-', 'g') AS slug,
  '{NS}' || p_type AS class_iri, '{NS}' || p_type || '_' || p_brand AS prop_iri FROM part""")
def scalars_names(spark, sf):
    x = F.col("p_type")
    return load(spark, sf, "part").select(x.alias("x"), S.sane(x).alias("sane"), S.slug(x).alias("slug"), S.class_iri(x).alias("class_iri"), S.prop_iri(x, F.col("p_brand")).alias("prop_iri")).distinct()


@query("humanize", "SELECT c_custkey AS k, 'Customer ' || c_custkey AS h, 'Name' AS d FROM customer")
def humanize(spark, sf):
    c = load(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("k"), S.humanize(F.concat(F.lit("customer_"), F.col("c_custkey").cast("string"))).alias("h"), S.display_name(F.lit(" "), F.concat(F.lit(NS), F.col("c_custkey").cast("string"), F.lit("/name"))).alias("d"))


@query("local_name", "SELECT c_custkey AS k, c_name AS l FROM customer")
def local_name(spark, sf):
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("k"), S.local_name(F.concat(F.lit(NS + "x/"), F.url_encode("c_name"))).alias("l"))


@query("scalar_for", f"""WITH q AS ({meta.sql_instances(["customer", "orders", "events"])}), d AS (SELECT datatype, count(*) AS n FROM q WHERE datatype IS NOT NULL GROUP BY datatype UNION ALL SELECT '{XSD}' || t, sum(n) FROM (SELECT unnest(['short', 'byte', 'long', 'double', 'boolean', 'date', 'positiveInteger']) AS t, (SELECT count(*) FROM events) AS n) GROUP BY t)
SELECT datatype, n, CASE WHEN datatype IN ('{XSD}integer', '{XSD}long', '{XSD}positiveInteger') THEN 'Int' WHEN datatype IN ('{XSD}decimal', '{XSD}double') THEN 'Float' WHEN datatype = '{XSD}boolean' THEN 'Boolean' ELSE 'String' END AS scalar,
  CASE WHEN datatype IN ('{XSD}integer', '{XSD}long', '{XSD}decimal', '{XSD}double') THEN 'number' WHEN datatype = '{XSD}boolean' THEN 'boolean' WHEN datatype = '{XSD}date' THEN 'date' WHEN datatype = '{XSD}dateTime' THEN 'datetime' ELSE 'text' END AS kind FROM d""")
def scalar_for(spark, sf):
    """The scalar and kind of every datatype of the facts, with its number; and of datatypes that the facts lack, for each event."""
    q = meta.instances(spark, sf, ["customer", "orders", "events"]).where("datatype is not null").select("datatype")
    more = load(spark, sf, "events").select(F.explode(F.array(*[F.lit(XSD + t) for t in ("short", "byte", "long", "double", "boolean", "date", "positiveInteger")])).alias("datatype"))
    n = q.union(more).groupBy("datatype").agg(F.count("*").alias("n"))
    return n.select("datatype", "n", S.scalar_for(F.col("datatype")).alias("scalar"), S.datatype_kind(F.col("datatype")).alias("kind"))


@query("cast_scalar", "SELECT event_id, TRY_CAST(user_id AS BIGINT) AS i, TRY_CAST(event_type AS DOUBLE) AS f FROM events")
def cast_scalar(spark, sf):
    return load(spark, sf, "events").select("event_id", S.cast_scalar(F.col("user_id").cast("string"), "Int").alias("i"), S.cast_scalar(F.col("event_type"), "Float").alias("f"))


@query("serialize_term", "SELECT event_id, '\"' || replace(replace(props, '\\', '\\\\'), '\"', '\\\"') || '\"' AS t FROM events")
def serialize_term(spark, sf):
    return load(spark, sf, "events").select("event_id", S.serialize_term(F.col("props"), F.lit("literal"), F.lit(XSD + "string"), F.lit(None).cast("string")).alias("t"))


@query("valid_iri", "SELECT page_id, NOT regexp_matches(url, '[\\x00-\\x20<>\"{}|^`\\\\]') AND length(url) > 0 AS ok, false AS bad FROM pages")
def valid_iri(spark, sf):
    return load(spark, sf, "pages").select("page_id", S.valid_iri(F.col("url")).alias("ok"), S.valid_iri(F.concat("url", F.lit(" x"))).alias("bad"))


@query("infer_term", f"SELECT event_id, CAST(user_id AS VARCHAR) AS o, 'literal' AS o_kind, '{XSD}integer' AS datatype FROM events UNION ALL SELECT -page_id - 1, url, 'iri', NULL FROM pages WHERE regexp_matches(url, '^https?://[^ ]+$')")
def infer_term(spark, sf):
    e = load(spark, sf, "events").select("event_id", *S.infer_term(F.col("user_id").cast("string")))
    p = load(spark, sf, "pages").where(F.col("url").rlike("^https?://[^ ]+$")).select((-F.col("page_id") - 1).alias("event_id"), *S.infer_term(F.col("url")))
    return e.union(p)


@query("tokenize", "SELECT doc_id, len(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS n FROM documents")
def tokenize(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.size(S.tokens(F.col("text"))).alias("n"))


@query("tokenize_name", "SELECT p_partkey, array_to_string(list_filter(string_split_regex(lower(p_type), '[^a-z0-9]+'), lambda x: x <> ''), '|') AS t, regexp_replace(lower(trim(p_type)), '[^a-z0-9]', '', 'g') AS h FROM part")
def tokenize_name(spark, sf):
    return load(spark, sf, "part").select("p_partkey", F.array_join(S.tokenize_name(F.lower("p_type")), "|").alias("t"), S.norm_header(F.col("p_type")).alias("h"))


@query("norm_label", "SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS l FROM part")
def norm_label(spark, sf):
    return load(spark, sf, "part").select("p_partkey", S.norm_label(F.col("p_type")).alias("l"))


@query("system_class", "SELECT 'urn:sem:' || c_mktsegment AS iri, false AS system FROM customer GROUP BY 1 UNION ALL SELECT 'http://www.w3.org/2002/07/owl#' || c_mktsegment, true FROM customer GROUP BY 1")
def system_class(spark, sf):
    s = load(spark, sf, "customer").select("c_mktsegment").distinct()
    i = s.select(F.concat(F.lit(NS), "c_mktsegment").alias("iri")).union(s.select(F.concat(F.lit("http://www.w3.org/2002/07/owl#"), "c_mktsegment")))
    return i.select("iri", S.system_class(F.col("iri")).alias("system"))


@query("apply_params", "SELECT c_custkey, 'hello ' || c_name || ' of X' AS t, 'who,where' AS params FROM customer")
def apply_params(spark, sf):
    c = load(spark, sf, "customer")
    t = F.lit("hello {{who}} of {{ where }}")
    done = F.replace(S.apply_params(t, {"where": "X"}), F.lit("{{who}}"), F.col("c_name"))
    return c.select("c_custkey", done.alias("t"), F.array_join(S.extract_params(t), ",").alias("params"))
