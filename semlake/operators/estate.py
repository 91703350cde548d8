"""Reads of the declared estate: labels, catalog, links, lineage, alignment, assets. Facts are pivoted by subject, not joined to themselves."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import ALT, DEFINITION, DOMAIN, GRAPH, IN_SCHEME, LABEL, NS, PREF, QUAD_SCHEMA, RANGE, RDF, RDFS, RR, SH, SKOS, TYPE, XSD, fact, facts, pivoted
from ..plans import meta as M
from .match import match_field
from .search import bm25_match, highlight, q_bool, q_term, terms_facet

#: What a query of the console may begin with; Spark's WITH cannot hold a change, and DML after it is refused.
READ_ONLY = re.compile(r"(?is)^\s*(?:(?:select|explain|values|table|from|show|describe)\b|with\b(?!.*\b(?:insert|update|delete|merge)\b))")
SOURCE_KEY, TARGET_KEY, CONSUMES, OUTPUT = NS + "sourceKeyProperty", NS + "targetKeyProperty", NS + "consumes", NS + "Output"
CONCEPT, AREA = NS + "businessConcept", NS + "businessArea"
ASSET_TYPE, ASSET_CLASS, PRESENTATION, ORDER, COMMENT = NS + "AssetType", NS + "assetClass", NS + "presentation", NS + "order", RDFS + "comment"
# The asset types that every estate has, in order.
ASSET_TYPES = [
    ("Taxonomies", SKOS + "ConceptScheme", "tree", 1),
    ("Business glossaries", NS + "Glossary", "list", 2),
    ("Business objects", NS + "BusinessObject", "catalog", 3),
    ("Physical objects", NS + "PhysicalObject", "catalog", 4),
    ("Mappings", RR + "TriplesMap", "catalog", 5),
]
# The fields that every concept and every scheme has: path, name, least count, most count, order.
FIELDS = {
    "concept": [(PREF, "Preferred label", 1, 1, 1), (ALT, "Alternative labels", None, None, 2), (DEFINITION, "Definition", None, 1, 3), (SKOS + "notation", "Notation", None, 1, 4)],
    "scheme": [(PREF, "Name", 1, 1, 1), (DEFINITION, "Description", None, 1, 2)],
}


def pick_label_columns(meta: DataFrame) -> DataFrame:
    """(source_id, table, label) from table_meta rows: a column called name or the like, else one that ends so, else a business key, else the first text that is no key; never a reference."""
    c = F.lower("column")
    rank = F.when(c.rlike("^(name|title|label|full_name|display_name)$"), 0).when(c.rlike("(_name|_title|_label)$"), 1)
    rank = rank.when(c.rlike("^(event|status|code|email|order_number|tracking_no|username)$"), 2).when(F.upper("sql_type").rlike("TEXT|CHAR|CLOB") & ~F.col("pk"), 3)
    m = meta.where("fk_table is null").withColumn("rank", rank).where("rank is not null")
    return m.groupBy("source_id", "table").agg(F.min_by("column", F.struct("rank", "ordinal")).alias("label"))


def translate_source(meta: DataFrame, source: str, kind: str, tables: list[str] | None = None) -> DataFrame:
    """The facts that put a source on the map: its node, and schema and mappings of its tables (or of some of them)."""
    own = meta.where(F.col("source_id") == source)
    own = own.where(F.col("table").isin(tables)) if tables is not None else own
    node = facts(own.groupBy("source_id").agg(F.countDistinct("table").alias("n")), GRAPH + "sources", F.concat(F.lit(NS + "source/"), "source_id"), fact(TYPE, F.lit(NS + "Source"), "iri"), fact(LABEL, F.col("source_id")), fact(NS + "kind", F.lit(kind)), fact(NS + "tables", F.col("n"), "literal", XSD + "integer"))
    return node.unionByName(M.schema_to_triples(own)).unionByName(M.schema_to_mappings(own))


def custom_fields(shapes: DataFrame, asset: str, shape: str) -> DataFrame:
    """(path, name, min_count, max_count, ord, custom) of an asset: the built-in fields, then those of its shape, each in order."""
    spark = shapes.sparkSession
    built_in = spark.createDataFrame([(*f, False) for f in FIELDS[asset]], "path string, name string, min_count int, max_count int, ord int, custom boolean")
    own = shapes.where(F.col("shape") == shape).select("path", "name", "min_count", "max_count", F.when(F.col("ord") == 9999, 100).otherwise(F.col("ord")).alias("ord"), F.lit(True).alias("custom"))
    return built_in.unionByName(own).orderBy("custom", "ord", "path")


def list_asset_types(quads: DataFrame) -> DataFrame:
    """(iri, label, asset_class, presentation, ord, built_in): the fixed types and those that facts declare, by order, then label."""
    spark = quads.sparkSession
    fixed = spark.createDataFrame([(label, c, p, n) for label, c, p, n in ASSET_TYPES], "label string, asset_class string, presentation string, ord int")
    fixed = fixed.select(F.concat(F.lit(NS + "assetType/"), S.slug(F.col("label"))).alias("iri"), "*", F.lit(True).alias("built_in"))
    own = pivoted(quads, {"type": TYPE, "label": LABEL, "asset_class": ASSET_CLASS, "presentation": PRESENTATION, "ord": ORDER}).where((F.col("type") == ASSET_TYPE) & F.col("label").isNotNull() & F.col("asset_class").isNotNull())
    own = own.select(F.col("s").alias("iri"), "label", "asset_class", F.coalesce("presentation", F.lit("list")).alias("presentation"), F.coalesce(F.col("ord").try_cast("int"), F.lit(50)).alias("ord"), F.lit(False).alias("built_in"))
    return fixed.unionByName(own).orderBy("ord", "label")


def class_row_counts(tables: dict[str, DataFrame], catalog: DataFrame) -> DataFrame:
    """(class_iri, n) of the catalogued tables that are given; one count a table."""
    n = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), "n") for t, df in tables.items()])
    return catalog.select("class_iri", "table").distinct().join(F.broadcast(n), "table").select("class_iri", "n")  # a row a table


def plan_sources(catalog: DataFrame, classes: list[str]) -> DataFrame:
    """(source_id, targets array of (class_iri, table)): the sources that a request over these classes touches."""
    return catalog.where(F.col("class_iri").isin(classes)).groupBy("source_id").agg(F.array_sort(F.collect_set(F.struct("class_iri", "table"))).alias("targets"))


def graph_sizes(quads: DataFrame, limit: int | None = 100) -> DataFrame:
    """(graph, n), the largest first."""
    n = quads.groupBy("graph").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "graph")
    return n if limit is None else n.limit(limit)


def schema_overview(quads: DataFrame, shapes: DataFrame, limit: int | None = 60) -> DataFrame:
    """(class_iri, instances, properties, required): declared classes and classes in use with their instances, and what their shapes ask."""
    used = quads.where(F.col("p") == TYPE)
    n = used.groupBy(F.col("o").alias("class_iri")).agg(F.countDistinct("s").alias("instances"))
    declared = used.where(F.col("o").isin(RDFS + "Class", "http://www.w3.org/2002/07/owl#Class")).select(F.col("s").alias("class_iri")).distinct()
    every = n.join(declared.hint("shuffle_merge"), "class_iri", "full").select("class_iri", F.coalesce("instances", F.lit(0)).alias("instances"))
    asked = shapes.groupBy(F.col("target_class").alias("class_iri")).agg(F.count("*").alias("properties"), F.count(F.when(F.col("min_count") > 0, 1)).alias("required"))
    out = every.join(asked.hint("shuffle_merge"), "class_iri", "left").select("class_iri", "instances", F.coalesce("properties", F.lit(0)).alias("properties"), F.coalesce("required", F.lit(0)).alias("required"))
    out = out.orderBy(F.desc("instances"), "class_iri")
    return out if limit is None else out.limit(limit)


def declare_link(spark: SparkSession, graph: str, predicate: str, source: str, source_key: str, target: str, target_key: str, label: str | None = None) -> DataFrame:
    """The facts of a link: a property with domain, range and the two key properties; its edges are joined when asked for."""
    rows = [(predicate, TYPE, RDF + "Property", "iri"), (predicate, DOMAIN, source, "iri"), (predicate, RANGE, target, "iri"), (predicate, SOURCE_KEY, source_key, "iri"), (predicate, TARGET_KEY, target_key, "iri")]
    rows += [(predicate, LABEL, label, "literal")] if label else []
    return spark.createDataFrame([(graph, *r, None, None) for r in rows], QUAD_SCHEMA)


def declared_links(quads: DataFrame) -> DataFrame:
    """(property, from_class, to_class, source_key_property, target_key_property): properties between classes, with join keys where they are declared."""
    p = pivoted(quads, {"from_class": DOMAIN, "to_class": RANGE, "source_key_property": SOURCE_KEY, "target_key_property": TARGET_KEY})
    return p.where(F.col("from_class").isNotNull() & F.col("to_class").isNotNull() & ~F.col("to_class").startswith(XSD)).withColumnRenamed("s", "property")


def catalog_links(quads: DataFrame, catalog: DataFrame) -> DataFrame:
    """declared_links between two catalogued classes."""
    ends = catalog.select("class_iri").distinct()
    links = declared_links(quads)
    for c in ("from_class", "to_class"):
        links = links.join(ends.withColumnRenamed("class_iri", c).hint("shuffle_merge"), c, "left_semi")
    return links.select("property", "from_class", "to_class", "source_key_property", "target_key_property")


def key_candidates(meta: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs: (a, b) tables; (a, b, column, first): columns the two share by name, the first of each pair marked."""
    own = meta.select("table", "column", "ordinal")
    x = pairs.join(own.withColumnRenamed("table", "a").hint("shuffle_merge"), "a").join(own.select(F.col("table").alias("b"), "column").hint("shuffle_merge"), ["b", "column"])
    first = x.groupBy("a", "b").agg(F.min_by("column", F.struct("ordinal", "column")).alias("first"))
    return x.join(first.hint("shuffle_merge"), ["a", "b"]).select("a", "b", "column", (F.col("column") == F.col("first")).alias("first"))


def flow_edges(catalog: DataFrame, links: DataFrame, quads: DataFrame, alignment: DataFrame) -> DataFrame:
    """(src, dst, kind, area): sources to their classes, classes to classes by links with keys, classes to the outputs that consume them."""
    area = alignment.groupBy(F.col("property").alias("class_iri")).agg(F.min("area").alias("area"))
    maps = catalog.select("source_id", "class_iri").distinct().join(area.hint("shuffle_merge"), "class_iri", "left")
    maps = maps.select(F.col("source_id").alias("src"), F.col("class_iri").alias("dst"), F.lit("maps").alias("kind"), F.coalesce("area", F.lit("Unclassified")).alias("area"))
    none = F.lit(None).cast("string").alias("area")
    link = links.where("source_key_property is not null").select(F.col("from_class").alias("src"), F.col("to_class").alias("dst"), F.lit("link").alias("kind"), none)
    outputs = quads.where((F.col("p") == TYPE) & (F.col("o") == OUTPUT)).select("s").distinct()
    eats = quads.where(F.col("p") == CONSUMES).join(outputs.hint("shuffle_merge"), "s", "left_semi").select(F.col("o").alias("src"), F.col("s").alias("dst"), F.lit("output").alias("kind"), none)
    return maps.unionByName(link).unionByName(eats)


def business_vocabulary(quads: DataFrame) -> DataFrame:
    """(concept, label, area, keywords array): concepts with a business area; keywords are their other labels, lower case. Also `ord`, by IRI."""
    c = pivoted(quads, {"label": LABEL, "area": AREA}).where("label is not null and area is not null")
    kw = quads.where(F.col("p") == ALT).groupBy("s").agg(F.array_sort(F.collect_set(F.lower("o"))).alias("keywords"))
    out = c.join(kw.hint("shuffle_merge"), "s", "left").select(F.col("s").alias("concept"), "label", "area", F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"))
    return out.withColumn("ord", F.col("concept"))


def discover_areas(catalog: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(kind, source_id, table, field, property, concept, area, confidence) of every table and column name that meets the vocabulary."""
    tables = catalog.select(F.lit("class").alias("kind"), "source_id", "table", F.col("table").alias("field"), F.col("class_iri").alias("property")).distinct()
    columns = catalog.select(F.lit("column").alias("kind"), "source_id", "table", F.col("column").alias("field"), "property")
    every = tables.unionByName(columns)
    found = match_field(every.select(F.col("field").alias("name")), vocabulary).withColumnRenamed("name", "field")
    return every.join(found.hint("shuffle_merge"), "field").select("kind", "source_id", "table", "field", "property", "concept", "area", F.col("score").alias("confidence"))


def alignment_facts(report: DataFrame, graph: str = GRAPH + "alignment") -> DataFrame:
    """The alignment graph of a report, made afresh: each aligned class or property with its concept."""
    return facts(report.select("property", "concept").distinct(), graph, F.col("property"), fact(CONCEPT, F.col("concept"), "iri"))


def area_totals(report: DataFrame) -> DataFrame:
    """(area, n): aligned fields per business area."""
    return report.groupBy("area").agg(F.count("*").alias("n"))


def read_alignment(quads: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(property, concept, area) of an alignment graph."""
    a = quads.where(F.col("p") == CONCEPT).select(F.col("s").alias("property"), F.col("o").alias("concept"))
    return a.join(vocabulary.select("concept", "area").hint("shuffle_merge"), "concept").select("property", "concept", "area")


def enrich_catalog(catalog: DataFrame, alignment: DataFrame) -> DataFrame:
    """catalog with the concept and area of each class and of each column, where they are aligned."""
    one = alignment.groupBy("property").agg(F.min(F.struct("concept", "area")).alias("x"))
    of = lambda key, name: one.select(F.col("property").alias(key), F.col("x.concept").alias(name + "_concept"), F.col("x.area").alias(name + "_area")).hint("shuffle_merge")
    return catalog.join(of("class_iri", "class"), "class_iri", "left").join(of("property", "column"), "property", "left")


def catalog_assets(catalog: DataFrame, counts: DataFrame, alignment: DataFrame) -> DataFrame:
    """(kind, iri, label, detail): tables with their rows, classes with a business area, and mappings."""
    c = catalog.select("class_iri", "source_id", "table").distinct().join(counts.hint("shuffle_merge"), "class_iri", "left")
    area = alignment.groupBy(F.col("property").alias("class_iri")).agg(F.min("area").alias("area"))
    physical = c.select(F.lit("physical").alias("kind"), F.col("class_iri").alias("iri"), F.col("table").alias("label"), F.concat("source_id", F.lit(" · "), F.coalesce("n", F.lit(0)), F.lit(" rows")).alias("detail"))
    business = c.join(area.hint("shuffle_merge"), "class_iri").select(F.lit("business").alias("kind"), F.col("class_iri").alias("iri"), S.humanize(F.col("table")).alias("label"), F.concat("area", F.lit(" · "), "source_id").alias("detail"))
    maps = c.select(F.lit("mapping").alias("kind"), F.concat(F.lit(NS + "map/"), "table").alias("iri"), F.concat("table", F.lit(" → mapping")).alias("label"), F.lit("R2RML").alias("detail"))
    return physical.unionByName(business).unionByName(maps)


def list_comments(comments: DataFrame, target: str | None = None) -> DataFrame:
    """Comments (target, id, parent, actor, at, text), of one target if it is given, oldest first."""
    c = comments if target is None else comments.where(F.col("target") == target)
    return c.orderBy("target", "at", "id")


def scheme_concepts(quads: DataFrame, scheme: str | None = None) -> DataFrame:
    """(scheme, iri, label, alts array) of the concepts of a scheme, or of all; the label is the preferred one, else a plain one, else the local name."""
    keys = quads.where(F.col("p") == IN_SCHEME).select("s", F.col("o").alias("scheme")).distinct()
    keys = keys if scheme is None else keys.where(F.col("scheme") == scheme)
    one = quads.where(F.col("p").isin(PREF, LABEL, ALT)).groupBy("s").agg(F.min(F.when(F.col("p") == PREF, F.col("o"))).alias("pref"), F.min(F.when(F.col("p") == LABEL, F.col("o"))).alias("plain"), F.array_sort(F.collect_set(F.when(F.col("p") == ALT, F.col("o")))).alias("alts"))
    out = keys.join(one.hint("shuffle_merge"), "s", "left")
    return out.select("scheme", F.col("s").alias("iri"), F.coalesce("pref", "plain", S.local_name(F.col("s"))).alias("label"), F.coalesce("alts", F.array().cast("array<string>")).alias("alts"))


def crawl_model(quads: DataFrame) -> DataFrame:
    """Search documents (id, iri, kind, type, label, source_id, fields) of classes, shapes, concepts, schemes and labelled instances.

    A subject of several kinds is the first of them in this order; its text is all its labels, then definitions and other labels.
    """
    kinds = [("class", RDFS + "Class"), ("class", "http://www.w3.org/2002/07/owl#Class"), ("shape", SH + "NodeShape"), ("concept", SKOS + "Concept"), ("scheme", SKOS + "ConceptScheme")]
    rank = F.lit(5)
    for n, (_, c) in reversed(list(enumerate(kinds))):
        rank = F.when(F.col("o") == c, n).otherwise(rank)
    q = quads.where(F.col("p").isin(TYPE, LABEL, PREF, DEFINITION, ALT) & ~F.col("s").startswith("_:"))
    place = F.when(F.col("p").isin(LABEL, PREF), 0).otherwise(1)
    text = F.array_sort(F.collect_set(F.when(F.col("p") != TYPE, F.struct(place.alias("k"), F.col("o").alias("o")))))
    labels = F.min(F.when(F.col("p").isin(LABEL, PREF), F.col("o")))
    one = q.groupBy("s").agg(F.min(F.when(F.col("p") == TYPE, rank)).alias("rank"), labels.alias("found"), text.alias("texts"))
    one = one.where("rank < 5 or (rank = 5 and found is not null)")
    names = F.array(*[F.lit(k) for k, _ in kinds], F.lit("instance"))
    label = F.coalesce("found", S.local_name(F.col("s")))
    full = F.array_join(F.transform("texts", lambda x: x["o"]), " ")
    fields = F.create_map(F.lit("label"), label, F.lit("text"), full)
    return one.select(F.col("s").alias("id"), F.col("s").alias("iri"), F.lit("model").alias("kind"), F.get(names, F.col("rank")).alias("type"), label.alias("label"), F.lit(None).cast("string").alias("source_id"), fields.alias("fields"))


def federated_search(index, text: str, size: int | None = 24, kind: str | None = None, source_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Hits (id, label, kind, type, source_id, score, fragment), best first, and facets (facet, key, n): kind, source and type, and the total, over all matches."""
    spark = index.docs.sparkSession
    asked = spark.createDataFrame([("q", text)], "qid string, text string")
    filters = [q_term(index, c, v) for c, v in (("kind", kind), ("source_id", source_id)) if v is not None]
    found = bm25_match(index, asked).select("id", "score")
    found = q_bool(must=[found], filters=filters, index=index) if filters else found
    docs = index.docs if "type" in index.docs.columns else index.docs.withColumn("type", F.lit(None).cast("string"))
    hits = found.join(docs.hint("shuffle_merge"), "id").orderBy(F.desc("score"), "id")
    hits = highlight(hits if size is None else hits.limit(size), "fields.text", text)
    total = found.agg(F.count("*").alias("n")).select(F.lit("total").alias("facet"), F.lit("total").alias("key"), "n")
    facets = [terms_facet(found, docs, c).select(F.lit(f).alias("facet"), "key", "n") for f, c in (("kind", "kind"), ("source", "source_id"), ("type", "type"))]
    return hits.select("id", "label", "kind", "type", "source_id", "score", "fragment"), reduce(DataFrame.unionByName, facets, total)


def namespaces(iris: DataFrame, known: dict[str, str] | None = None, least: int = 10) -> DataFrame:
    """(prefix, ns, n) of a column `iri`: each namespace of `least` characters with its IRIs, by a known prefix or one made of its last telling part; a number tells equal ones apart.

    The namespaces of a graph are few against its IRIs; they are numbered by prefix, in order of length and name.
    """
    from pyspark.sql import Window

    ns = iris.select(F.regexp_extract("iri", "^(.*[#/])[^#/]*$", 1).alias("ns")).where(F.length("ns") >= least).groupBy("ns").agg(F.count("*").alias("n"))
    known = known or {}
    given = ns.sparkSession.createDataFrame([(v, k) for k, v in known.items()] or [(None, None)], "ns string, given string")
    parts = F.filter(F.split(F.regexp_replace("ns", "[#/]+$", ""), "[#/:.]"), lambda x: (x != "") & ~x.isin("www", "com", "org", "net", "io", "http", "https", "example"))
    word = F.substring(F.regexp_replace(F.lower(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("ns"))), "[^a-z0-9]", ""), 1, 12)
    word = F.when(word == "", "ns").when(word.rlike("^[0-9]"), F.concat(F.lit("n"), word)).otherwise(word)
    x = ns.join(F.broadcast(given), "ns", "left").withColumn("word", word)  # known: a row a prefix
    taken = F.lit(0)
    for k in known:
        taken = taken + (F.col("word") == k).cast("int")
    rn = F.row_number().over(Window.partitionBy("word", F.col("given").isNotNull()).orderBy(F.length("ns"), "ns")) + taken
    return x.withColumn("rn", rn).select(F.coalesce("given", F.when(F.col("rn") == 1, F.col("word")).otherwise(F.concat("word", F.col("rn").cast("string")))).alias("prefix"), "ns", "n")


def sql_console(spark: SparkSession, sql: str, limit: int | None = 1000) -> tuple[DataFrame, bool]:
    """The rows of a read-only query, `limit` at most, and whether there were so many that some may be missing."""
    if not READ_ONLY.match(sql):
        raise ValueError("read-only: SELECT, WITH or EXPLAIN only")
    df = spark.sql(sql)
    if limit is None:
        return df, False
    return df.limit(limit), df.limit(limit).count() == limit
