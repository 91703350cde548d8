"""Queries on the declared estate: onboarding, catalog, links, alignment, assets, namespaces."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import ALT, DATA, DOMAIN, GRAPH, IN_SCHEME, LABEL, NS, OWL, QUAD, RANGE, RDF, RR, SH, SKOS, TYPE, XSD, fact, facts
from ..operators import algebra, dash, estate, search, validate
from ..plans import meta
from ..plans.meta import TABLES, load
from ..sources import io
from .base import query, scratch
from .catalog import QB, SCHEMA, Q, _meta_sql, big, crm, used
from .graphs import customer_shapes, geo_concepts
from .text import DOCS, INDEX, ONE, VOCAB, bm25_sql, docs, index, vocabulary


def said(name: str) -> str:
    """humanize, for constants in SQL."""
    words = re.sub("([a-z])([A-Z])", r"\1 \2", re.sub("[_-]+", " ", name)).split()
    return " ".join(w if len(w) <= 3 and w == w.upper() else w[:1].upper() + w[1:].lower() for w in words)


def union(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def values(rows: list[tuple], columns: str) -> str:
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "[" + ", ".join(f"'{x}'" for x in v) + "]" if isinstance(v, list) else f"'{v}'"
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") v({columns}))"


def schema_sql(names: list[str]) -> str:
    """A SELECT (s, p, o, o_kind) of the schema facts, after m of _meta_sql."""
    labels = values([(n, c, said(c)) for n in names for c, _ in TABLES[n].columns], "tab, col, label")
    tables = values([(n, said(n), TABLES[n].source) for n in names], "tab, label, src")
    ps = f"'{NS}' || m.tab || '_' || m.col || 'Shape'"
    prop = f"'{NS}' || m.tab || '_' || m.col"
    return f"""
  SELECT '{NS}' || tab AS s, '{TYPE}' AS p, '{OWL}Class' AS o, 'iri' AS o_kind FROM {tables} UNION ALL SELECT '{NS}' || tab, '{LABEL}', label, 'literal' FROM {tables} UNION ALL SELECT '{NS}' || tab, '{NS}source', src, 'literal' FROM {tables}
  UNION ALL SELECT '{NS}' || tab || 'Shape', '{TYPE}', '{SH}NodeShape', 'iri' FROM {tables} UNION ALL SELECT '{NS}' || tab || 'Shape', '{SH}targetClass', '{NS}' || tab, 'iri' FROM {tables}
  UNION ALL SELECT {prop}, '{TYPE}', '{RDF}Property', 'iri' FROM m UNION ALL SELECT {prop}, '{LABEL}', label, 'literal' FROM m JOIN {labels} l ON l.tab = m.tab AND l.col = m.col UNION ALL SELECT {prop}, '{DOMAIN}', '{NS}' || tab, 'iri' FROM m
  UNION ALL SELECT {prop}, '{RANGE}', CASE WHEN fk IS NULL THEN dt ELSE '{NS}' || fk END, 'iri' FROM m
  UNION ALL SELECT {ps}, '{SH}path', {prop}, 'iri' FROM m UNION ALL SELECT {ps}, '{SH}order', CAST(ord AS VARCHAR), 'literal' FROM m UNION ALL SELECT {ps}, '{SH}maxCount', '1', 'literal' FROM m UNION ALL SELECT {ps}, '{SH}minCount', '1', 'literal' FROM m WHERE nn OR pk
  UNION ALL SELECT {ps}, '{SH}class', '{NS}' || fk, 'iri' FROM m WHERE fk IS NOT NULL UNION ALL SELECT {ps}, '{SH}nodeKind', '{SH}IRI', 'iri' FROM m WHERE fk IS NOT NULL UNION ALL SELECT {ps}, '{SH}datatype', dt, 'iri' FROM m WHERE fk IS NULL
  UNION ALL SELECT '{NS}' || tab || 'Shape', '{SH}property', {ps}, 'iri' FROM m"""


def mapping_sql(names: list[str]) -> str:
    """A SELECT (s, p, o, o_kind) of the mapping facts, after m of _meta_sql."""
    tables = values([(n, TABLES[n].source, meta.template(TABLES[n])) for n in names], "tab, src, template")
    one, pom = f"'{NS}map/' || tab", f"'{NS}map/' || tab || '/' || col"
    return f"""
  SELECT {one} AS s, '{TYPE}' AS p, '{RR}TriplesMap' AS o, 'iri' AS o_kind FROM {tables} UNION ALL SELECT {one}, '{RR}tableName', tab, 'literal' FROM {tables} UNION ALL SELECT {one}, '{NS}source', src, 'literal' FROM {tables}
  UNION ALL SELECT {one}, '{RR}template', template, 'literal' FROM {tables} UNION ALL SELECT {one}, '{RR}class', '{NS}' || tab, 'iri' FROM {tables} UNION ALL SELECT {one}, '{RR}predicateObjectMap', {pom}, 'iri' FROM m
  UNION ALL SELECT {pom}, '{RR}predicate', '{NS}' || tab || '_' || col, 'iri' FROM m UNION ALL SELECT {pom}, '{RR}column', col, 'literal' FROM m UNION ALL SELECT {pom}, '{RR}datatype', dt, 'iri' FROM m WHERE fk IS NULL
  UNION ALL SELECT {pom}, '{RR}refTemplate', '{DATA}' || fk || '/{{' || col || '}}', 'literal' FROM m WHERE fk IS NOT NULL"""


# Sources.
@query("src_json_rows", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS nested FROM events""")
def src_json_rows(spark, sf):
    """Events as JSON documents of a thousand rows below data.rows, written and read again; nested values come as text."""
    e = load(spark, sf, "events").select("event_id", F.from_json("props", "k long").alias("p"))
    rows = F.array_sort(F.collect_list(F.struct("event_id", F.col("p.k").alias("k"), F.col("p").alias("nested"))))
    path = scratch(spark, "json")
    e.groupBy(F.floor(F.col("event_id") / 1000).alias("page")).agg(F.struct(rows.alias("rows")).alias("data")).write.json(path)
    return io.json_rows(spark, path, "data.rows", multi_line=False).select("event_id", "k", "nested")


@query("bulk_load", f"{QB} SELECT DISTINCT graph, s, p, o, o_kind, datatype, lang FROM q")
def bulk_load(spark, sf):
    """Facts with repeats, appended to a store in two loads and read back."""
    path = scratch(spark, "store")
    q = big(spark, sf)
    here = F.col("graph") == GRAPH + "crm"
    io.bulk_load(q.where(here).unionByName(q.where(here)), path)
    io.bulk_load(q.where(~here), path)
    return spark.read.parquet(path).select(*QUAD)


@query("sink_jsonld", f"""{Q}, v AS (
  SELECT DISTINCT s, CASE WHEN p = '{TYPE}' THEN '@type' ELSE p END AS key, CASE WHEN p = '{TYPE}' THEN '"' || o || '"'
    WHEN o_kind = 'literal' THEN '{{"@value":' || CAST(to_json(o) AS VARCHAR) || ',"@type":"' || datatype || '"}}' ELSE '{{"@id":"' || o || '"}}' END AS v FROM q),
k AS (SELECT s, '"' || key || '":' || CASE WHEN count(*) = 1 THEN min(v) ELSE '[' || string_agg(v, ',' ORDER BY v) || ']' END AS pair FROM v GROUP BY s, key)
SELECT s, '{{"@id":"' || s || '",' || string_agg(pair, ',' ORDER BY pair) || '}}' AS node FROM k GROUP BY s""")
def sink_jsonld(spark, sf):
    return io.sink_jsonld(crm(spark, sf))


SHORT = {"sem": NS, "xsd": XSD}


@query("sink_jsonld_compact", f"""{Q}, v AS (
  SELECT DISTINCT s, CASE WHEN p = '{TYPE}' THEN '@type' ELSE replace(p, '{NS}', 'sem:') END AS key, CASE WHEN p = '{TYPE}' THEN '"' || replace(o, '{NS}', 'sem:') || '"'
    WHEN o_kind = 'literal' THEN '{{"@value":' || CAST(to_json(o) AS VARCHAR) || ',"@type":"' || replace(datatype, '{XSD}', 'xsd:') || '"}}' ELSE '{{"@id":"' || o || '"}}' END AS v FROM q),
k AS (SELECT s, '"' || key || '":' || CASE WHEN count(*) = 1 THEN min(v) ELSE '[' || string_agg(v, ',' ORDER BY v) || ']' END AS pair FROM v GROUP BY s, key)
SELECT s, '{{"@context":{{"sem":"{NS}","xsd":"{XSD}"}},"@id":"' || s || '",' || string_agg(pair, ',' ORDER BY pair) || '}}' AS node FROM k GROUP BY s""")
def sink_jsonld_compact(spark, sf):
    """Nodes with their names shrunk by two prefixes; subjects, whose local names are paths, stay whole."""
    return io.sink_jsonld(crm(spark, sf), SHORT)


@query("schema_to_triples", f"WITH m AS ({_meta_sql(SCHEMA)}) {schema_sql(SCHEMA)}")
def schema_to_triples(spark, sf):
    return meta.schema_to_triples(used(spark, sf, SCHEMA)).select("s", "p", "o", "o_kind")


SOME = ["nation", "customer"]


@query("translate_source", f"""WITH m AS ({_meta_sql(SOME)})
SELECT '{NS}source/crm' AS s, p, o, k AS o_kind FROM {values([(TYPE, NS + "Source", "iri"), (LABEL, "crm", "literal"), (NS + "kind", "parquet", "literal"), (NS + "tables", "2", "literal")], "p, o, k")}
UNION ALL ({schema_sql(SOME)}) UNION ALL ({mapping_sql(SOME)})""")
def translate_source(spark, sf):
    """One source, two of its tables."""
    return estate.translate_source(used(spark, sf, ["region", *SCHEMA]), "crm", "parquet", SOME).select("s", "p", "o", "o_kind")


@query("pick_label_column", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS label, count({c}) AS n FROM {t}" for t, c in (("region", "r_name"), ("nation", "n_name"), ("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name"), ("orders", "o_orderstatus"), ("events", "event_type"), ("documents", "text"), ("conversations", "role"))))
def pick_label_column(spark, sf):
    """The label column of every table that has one, with its number of values."""
    n = union([load(spark, sf, t).agg(*[F.count(c).alias(c) for c, _ in x.columns]).select(F.lit(t).alias("table"), F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("n")) for c, _ in x.columns])).alias("x")).select("table", "x.*") for t, x in TABLES.items()])
    return estate.pick_label_columns(meta.table_meta(spark)).join(F.broadcast(n), ["table", "label"]).select("table", "label", "n")  # a row a column


# Catalog.
def counted(spark, sf, names):
    return estate.class_row_counts({n: load(spark, sf, n) for n in names}, meta.catalog(spark))


@query("class_row_counts", " UNION ALL ".join(f"SELECT '{NS}{n}' AS class_iri, count(*) AS n FROM {n}" for n in TABLES))
def class_row_counts(spark, sf):
    return counted(spark, sf, TABLES)


@query("plan_sources", "SELECT 'crm' AS source_id, 'customer,nation' AS tables, (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS n_rows UNION ALL SELECT 'sales', 'orders', (SELECT count(*) FROM orders)")
def plan_sources(spark, sf):
    """The sources of three classes, with the rows that they hold of them."""
    plan = estate.plan_sources(meta.catalog(spark), [NS + n for n in SCHEMA]).select("source_id", F.array_join("targets.table", ",").alias("tables"), F.explode("targets.class_iri").alias("class_iri"))
    return plan.join(F.broadcast(counted(spark, sf, SCHEMA)), "class_iri").groupBy("source_id", "tables").agg(F.sum("n").alias("n_rows"))  # a row a class


@query("graph_sizes", f"{QB} SELECT graph, count(*) AS n FROM q GROUP BY graph ORDER BY n DESC, graph LIMIT 100")
def graph_sizes(spark, sf):
    return estate.graph_sizes(big(spark, sf))


@query("schema_overview", f"""{Q}, m AS ({_meta_sql(SCHEMA)}), s AS (SELECT tab, count(*) AS properties, count(*) FILTER (nn OR pk) AS required FROM m GROUP BY tab),
n AS (SELECT o AS class_iri, count(DISTINCT s) AS instances FROM (SELECT s, o FROM q WHERE p = '{TYPE}' UNION ALL SELECT '{NS}' || tab, '{OWL}Class' FROM s UNION ALL SELECT '{NS}' || tab || 'Shape', '{SH}NodeShape' FROM s UNION ALL SELECT '{NS}' || tab || '_' || col, '{RDF}Property' FROM m) GROUP BY o),
e AS (SELECT class_iri FROM n UNION SELECT '{NS}' || tab FROM s)
SELECT e.class_iri AS class_iri, coalesce(instances, 0) AS instances, coalesce(properties, 0) AS properties, coalesce(required, 0) AS required FROM e LEFT JOIN n USING (class_iri) LEFT JOIN s ON e.class_iri = '{NS}' || s.tab ORDER BY instances DESC, class_iri LIMIT 60""")
def schema_overview(spark, sf):
    schema = meta.schema_to_triples(used(spark, sf, SCHEMA))
    return estate.schema_overview(crm(spark, sf).unionByName(schema), validate.read_shapes(schema))


def link_facts(spark):
    return union([estate.declare_link(spark, GRAPH + "model", NS + p, NS + a, f"{NS}{a}_{x}", NS + b, f"{NS}{b}_{y}", p) for p, a, x, b, y in meta.LINKS])


@query("declare_link", f"""{Q} SELECT s, p, o FROM q WHERE p = '{TYPE}' UNION ALL SELECT * FROM {values([r for p, a, x, b, y in meta.LINKS for r in ((NS + p, TYPE, RDF + "Property"), (NS + p, LABEL, p), (NS + p, DOMAIN, NS + a), (NS + p, RANGE, NS + b), (NS + p, estate.SOURCE_KEY, f"{NS}{a}_{x}"), (NS + p, estate.TARGET_KEY, f"{NS}{b}_{y}"))], "s, p, o")}""")
def declare_link(spark, sf):
    """The links declared beside the data: their facts and all types."""
    every = algebra.insert_data(crm(spark, sf), link_facts(spark))
    return every.where((F.col("p") == TYPE) | (F.col("graph") == GRAPH + "model")).select("s", "p", "o")


@query("catalog_links", f"WITH m AS ({_meta_sql(SCHEMA)}) SELECT '{NS}' || tab || '_' || col AS property, '{NS}' || tab AS from_class, '{NS}' || fk AS to_class, CAST(NULL AS VARCHAR) AS source_key_property, CAST(NULL AS VARCHAR) AS target_key_property FROM m WHERE fk = 'nation' UNION ALL SELECT DISTINCT '{NS}placedBy', '{NS}orders', '{NS}customer', '{NS}orders_o_custkey', '{NS}customer_c_custkey' FROM m")
def catalog_links(spark, sf):
    m = used(spark, sf, SCHEMA)
    return estate.catalog_links(meta.schema_to_triples(m).unionByName(link_facts(spark)), meta.read_catalog(meta.schema_to_mappings(m)))


@query("key_candidates", "SELECT 'conversations' AS a, 'documents' AS b, 'text' AS \"column\", true AS first, count(*) AS n_both FROM conversations c SEMI JOIN documents d ON c.text = d.text UNION ALL SELECT 'documents', 'labels', 'doc_id', true, count(*) FROM documents d SEMI JOIN labels l ON l.doc_id = d.doc_id")
def key_candidates(spark, sf):
    """Columns that two tables share by name, with how many rows of the first meet the second there."""
    names = meta.table_meta(spark).select("table").distinct()
    pairs = names.select(F.col("table").alias("a"), F.lit(1).alias("x")).join(names.select(F.col("table").alias("b"), F.lit(1).alias("x")), "x").where("a < b").drop("x")  # declared tables
    found = estate.key_candidates(meta.table_meta(spark), pairs).collect()  # declared columns
    return union([load(spark, sf, r.a).join(load(spark, sf, r.b).select(r["column"]).hint("shuffle_merge"), r["column"], "left_semi").agg(F.count("*").alias("n_both")).select(F.lit(r.a).alias("a"), F.lit(r.b).alias("b"), F.lit(r["column"]).alias("column"), F.lit(r["first"]).alias("first"), "n_both") for r in found])


# Business alignment.
def matched_sql(names: list[tuple]) -> str:
    """CTEs nm (kind, source_id, tab, field, property), hit (field, concept, area, confidence): each name's best concept."""
    words = lambda x: f"array_to_string(list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: w <> ''), ' ')"
    return f"""nm AS {values(names, "kind, source_id, tab, field, property")},
fw AS (SELECT DISTINCT field, {words("field")} AS phrase FROM nm),
kw AS (SELECT ord, concept, area, {words("kw")} AS key, nth FROM (SELECT ord, concept, area, unnest(keywords) AS kw, unnest(range(len(keywords))) AS nth FROM {values(VOCAB, "ord, concept, area, keywords")})),
sc AS (SELECT field, concept, area, ord, key, nth, CASE WHEN phrase = key THEN 3 WHEN starts_with(phrase, key || ' ') OR ends_with(phrase, ' ' || key) OR contains(phrase, ' ' || key || ' ') THEN 2
  WHEN list_contains(string_split(phrase, ' '), key || 's') AND length(key) > 2 THEN 1 END AS score FROM fw, kw),
cb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field, ord ORDER BY score DESC, nth) AS rn FROM sc WHERE score IS NOT NULL) WHERE rn = 1),
hit AS (SELECT field, concept, area, score AS confidence FROM (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY field ORDER BY score DESC, length(key) DESC, ord) AS rn FROM cb) WHERE rn = 1)"""


ESTATE = [("class", t.source, n, n, NS + n) for n, t in TABLES.items()] + [("column", t.source, n, c, f"{NS}{n}_{c}") for n, t in TABLES.items() for c, _ in t.columns]
COUNTS = "(" + " UNION ALL ".join(f"SELECT '{n}' AS tab, count(*) AS n FROM {n}" for n in TABLES) + ")"


def report(spark):
    return estate.discover_areas(meta.catalog(spark), vocabulary(spark))


@query("discover_areas", f"WITH {matched_sql(ESTATE)} SELECT kind, source_id, nm.tab AS \"table\", field, property, concept, area, confidence, n FROM nm JOIN hit USING (field) JOIN {COUNTS} c ON c.tab = nm.tab")
def discover_areas(spark, sf):
    """Every table and column of the estate that meets the vocabulary, with the rows behind it."""
    n = counted(spark, sf, TABLES).select(F.substring_index("class_iri", ":", -1).alias("table"), "n")
    return report(spark).join(F.broadcast(n), "table")  # a row a table


@query("area_totals", f"WITH {matched_sql(ESTATE)} SELECT area, count(*) AS n, CAST(sum(n) AS BIGINT) AS n_rows FROM nm JOIN hit USING (field) JOIN {COUNTS} c ON c.tab = nm.tab GROUP BY area")
def area_totals(spark, sf):
    """Aligned fields per business area, and the rows that they have."""
    r = report(spark)
    n = counted(spark, sf, TABLES).select(F.substring_index("class_iri", ":", -1).alias("table"), "n")
    return estate.area_totals(r).join(r.join(F.broadcast(n), "table").groupBy("area").agg(F.sum("n").alias("n_rows")), "area")


FILLED = "(" + " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n FROM {n}" for n, t in TABLES.items() for c, _ in t.columns) + ")"


@query("match_field", f"WITH {matched_sql([r for r in ESTATE if r[0] == 'column'])}, f AS (SELECT name, CAST(sum(n) AS BIGINT) AS n FROM {FILLED} GROUP BY name) SELECT name, concept, confidence AS score, n FROM hit JOIN f ON f.name = hit.field")
def match_field(spark, sf):
    """Every column of the estate matched to the vocabulary, with its number of values."""
    from ..operators.match import match_field as match

    n = union([load(spark, sf, t).agg(*[F.count(c).alias(c) for c, _ in x.columns]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c, _ in x.columns])).alias("x")).select("x.*") for t, x in TABLES.items()])
    n = n.groupBy("name").agg(F.sum("n").alias("n"))
    return match(n.select("name"), vocabulary(spark)).join(n.hint("shuffle_merge"), "name").select("name", "concept", "score", "n")


def part_vocabulary(spark, sf):
    """Part types as concepts: their last word is the area, brands are other names."""
    p = load(spark, sf, "part").select("p_type", "p_brand").distinct()
    iri = F.concat(F.lit(NS + "vocab/"), S.slug(F.col("p_type")))
    return facts(p, GRAPH + "vocab", iri, fact(TYPE, F.lit(SKOS + "Concept"), "iri"), fact(LABEL, F.col("p_type")), fact(estate.AREA, F.lower(F.element_at(F.split("p_type", " "), -1))), fact(ALT, F.col("p_brand")))


@query("vocab_index", f"SELECT '{NS}vocab/' || regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '-', 'g') AS concept, p_type AS label, lower(string_split(p_type, ' ')[-1]) AS area, string_agg(DISTINCT lower(p_brand), '|' ORDER BY lower(p_brand)) AS keywords FROM part GROUP BY p_type")
def vocab_index(spark, sf):
    return estate.business_vocabulary(part_vocabulary(spark, sf)).select("concept", "label", "area", F.array_join("keywords", "|").alias("keywords"))


def alignment(spark):
    q = estate.alignment_facts(report(spark))
    return estate.read_alignment(q, vocabulary(spark))


@query("enrich_catalog", f"WITH m AS ({_meta_sql(SCHEMA)}), {matched_sql(ESTATE)}, a AS (SELECT property, concept, area FROM nm JOIN hit USING (field)) SELECT '{NS}' || m.tab AS class_iri, m.col AS \"column\", x.concept AS class_concept, x.area AS class_area, y.concept AS column_concept, y.area AS column_area FROM m LEFT JOIN a x ON x.property = '{NS}' || m.tab LEFT JOIN a y ON y.property = '{NS}' || m.tab || '_' || m.col")
def enrich_catalog(spark, sf):
    cat = meta.read_catalog(meta.schema_to_mappings(used(spark, sf, SCHEMA)))
    return estate.enrich_catalog(cat, alignment(spark)).select("class_iri", "column", "class_concept", "class_area", "column_concept", "column_area")


@query("flow_edges", f"""WITH m AS ({_meta_sql(SCHEMA)}), {matched_sql(ESTATE)} SELECT DISTINCT CASE WHEN m.tab = 'orders' THEN 'sales' ELSE 'crm' END AS src, '{NS}' || m.tab AS dst, 'maps' AS kind, coalesce(area, 'Unclassified') AS area FROM m LEFT JOIN hit ON hit.field = m.tab
UNION ALL SELECT '{NS}orders', '{NS}customer', 'link', NULL FROM (SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey) WHERE n > 0
UNION ALL SELECT '{NS}' || t, '{NS}report/' || p, 'output', NULL FROM (SELECT DISTINCT regexp_replace(lower(trim(o_orderpriority)), '[^a-z0-9]+', '-', 'g') AS p FROM orders), (SELECT unnest(['customer', 'orders']) AS t)""")
def flow_edges(spark, sf):
    """Sources, classes, links and the reports (one for each order priority) that consume two of the classes."""
    m = used(spark, sf, SCHEMA)
    cat = meta.read_catalog(meta.schema_to_mappings(m))
    links = estate.catalog_links(meta.schema_to_triples(m).unionByName(link_facts(spark)), cat)
    p = load(spark, sf, "orders").select("o_orderpriority").distinct()
    outputs = facts(p, GRAPH + "model", F.concat(F.lit(NS + "report/"), S.slug(F.col("o_orderpriority"))), fact(TYPE, F.lit(estate.OUTPUT), "iri"), *[fact(estate.CONSUMES, F.lit(NS + t), "iri") for t in ("customer", "orders")])
    return estate.flow_edges(cat, links, outputs, alignment(spark))


@query("catalog_assets", f"""WITH {matched_sql(ESTATE)}, c AS (SELECT tab, source_id, n, CASE tab {" ".join(f"WHEN '{n}' THEN '{said(n)}'" for n in TABLES)} END AS label FROM nm JOIN {COUNTS} USING (tab) WHERE kind = 'class')
SELECT 'physical' AS kind, '{NS}' || tab AS iri, tab AS label, source_id || ' · ' || n || ' rows' AS detail FROM c
UNION ALL SELECT 'business', '{NS}' || tab, label, area || ' · ' || source_id FROM c JOIN hit ON hit.field = c.tab
UNION ALL SELECT 'mapping', '{NS}map/' || tab, tab || ' → mapping', 'R2RML' FROM c""")
def catalog_assets(spark, sf):
    return estate.catalog_assets(meta.catalog(spark), counted(spark, sf, TABLES), alignment(spark))


@query("list_asset_types", f"""SELECT '{NS}assetType/' || s AS iri, label, cls AS asset_class, pres AS presentation, ord, built_in FROM (
  SELECT regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g') AS s, label, cls, pres, ord, true AS built_in FROM {values(estate.ASSET_TYPES, "label, cls, pres, ord")}
  UNION ALL SELECT DISTINCT regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '-', 'g'), p_type, '{NS}' || p_type, CASE WHEN p_type LIKE '%a%' THEN 'tree' ELSE 'list' END, CASE WHEN p_type LIKE '%e%' THEN 50 ELSE length(p_type) END, false FROM part)""")
def list_asset_types(spark, sf):
    """The built-in asset types and one for each part type, some without a presentation or an order."""
    p = load(spark, sf, "part").select("p_type").distinct()
    t = F.col("p_type")
    own = facts(p, GRAPH + "extensions", F.concat(F.lit(NS + "assetType/"), S.slug(t)), fact(TYPE, F.lit(estate.ASSET_TYPE), "iri"), fact(LABEL, t), fact(estate.ASSET_CLASS, F.concat(F.lit(NS), t), "iri"), fact(estate.PRESENTATION, F.when(t.contains("a"), "tree")), fact(estate.ORDER, F.when(~t.contains("e"), F.length(t)), "literal", XSD + "integer"))
    return estate.list_asset_types(own)


@query("custom_fields", f"WITH m AS ({_meta_sql(['customer'])}) SELECT '{NS}customer_' || col AS path, CASE WHEN nn OR pk THEN 1 ELSE -1 END AS min_count, 1 AS max_count, ord, true AS custom FROM m UNION ALL SELECT path, coalesce(least, -1), coalesce(most, -1), ord, false FROM {values([(p, a, b, n) for p, _, a, b, n in estate.FIELDS['concept']], 'path, least, most, ord')}")
def custom_fields(spark, sf):
    shapes = validate.read_shapes(meta.schema_to_triples(used(spark, sf, SCHEMA)))
    return estate.custom_fields(shapes, "concept", NS + "customerShape").drop("name").fillna(-1, ["min_count", "max_count"])


@query("list_comments", "SELECT conv_id AS target, turn AS \"at\", CAST(conv_id AS VARCHAR) || '-' || turn AS id, role AS actor, text FROM conversations ORDER BY target, \"at\", id")
def list_comments(spark, sf):
    """Conversations as comment threads, oldest first."""
    c = load(spark, sf, "conversations").select(F.col("conv_id").alias("target"), F.col("turn").alias("at"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("role").alias("actor"), "text")
    return estate.list_comments(c)


@query("sql_console", "SELECT o_orderkey, o_totalprice, true AS truncated FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000")
def sql_console(spark, sf):
    dash.class_views(spark, {"sem_orders": load(spark, sf, "orders")})
    rows, truncated = estate.sql_console(spark, "SELECT o_orderkey, o_totalprice FROM sem_orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey")
    return rows.withColumn("truncated", F.lit(truncated))


# Model crawl and search.
@query("scheme_concepts", f"SELECT '{NS}geo' AS scheme, '{NS}geo/n' || n_nationkey AS iri, n_name AS label, lower(n_name) AS alts FROM nation UNION ALL SELECT '{NS}geo', '{NS}geo/r' || r_regionkey, r_name, '' FROM region UNION ALL SELECT DISTINCT '{NS}types', '{NS}t/' || p_type || '#' || p_brand, string_split(p_brand, '#')[-1], p_type FROM part")
def scheme_concepts(spark, sf):
    """Nations and regions, and a scheme of part types and brands whose concepts have no label but their local name."""
    p = load(spark, sf, "part").select("p_type", "p_brand").distinct()
    types = facts(p, GRAPH + "types", F.concat(F.lit(NS + "t/"), "p_type", F.lit("#"), "p_brand"), fact(IN_SCHEME, F.lit(NS + "types"), "iri"), fact(ALT, F.col("p_type")))
    return estate.scheme_concepts(geo_concepts(spark, sf).unionByName(types)).withColumn("alts", F.array_join("alts", "|"))


def model_facts(spark, sf):
    """Concepts and schemes of the geography, classes, shapes and properties of the schema, and parts as labelled instances."""
    p = load(spark, sf, "part")
    parts = facts(p, GRAPH + "supply", meta.subject(TABLES["part"]), fact(TYPE, F.lit(NS + "part"), "iri"), fact(LABEL, F.col("p_name")))
    return geo_concepts(spark, sf).unionByName(meta.schema_to_triples(used(spark, sf, SCHEMA))).unionByName(parts)


MODEL = f"""m AS ({_meta_sql(SCHEMA)}), x AS (
  SELECT '{NS}geo/n' || n_nationkey AS iri, 'concept' AS type, n_name AS label, concat_ws(' ', n_name, t2) AS text FROM (SELECT *, array_to_string(list_sort(list_distinct([lower(n_name), CASE WHEN n_nationkey % 2 = 0 THEN n_name END])), ' ') AS t2 FROM nation)
  UNION ALL SELECT '{NS}geo/r' || r_regionkey, 'concept', r_name, r_name FROM region UNION ALL SELECT '{NS}geo', 'scheme', 'Geography', 'Geography' UNION ALL SELECT '{DATA}part/' || p_partkey, 'instance', p_name, p_name FROM part
  UNION ALL SELECT '{NS}' || tab, 'class', label, label FROM {values([(n, said(n)) for n in SCHEMA], "tab, label")} UNION ALL SELECT '{NS}' || tab || 'Shape', 'shape', 'urn:sem:' || tab || 'Shape', '' FROM {values([(n,) for n in SCHEMA], "tab")}
  UNION ALL SELECT '{NS}' || tab || '_' || col, 'instance', label, label FROM {values([(n, c, said(c)) for n in SCHEMA for c, _ in TABLES[n].columns], "tab, col, label")})"""


@query("crawl_model", f"WITH {MODEL} SELECT iri, type, label, text FROM x")
def crawl_model(spark, sf):
    return estate.crawl_model(model_facts(spark, sf)).select("iri", "type", "label", F.col("fields")["text"].alias("text"))


@query("federated_search", f"{INDEX}{bm25_sql(ONE)}, h AS (SELECT * FROM s JOIN docs USING (id) WHERE kind = 'data') SELECT 'total' AS facet, 'total' AS key, count(*) AS n FROM h UNION ALL SELECT 'kind', kind, count(*) FROM h GROUP BY kind UNION ALL SELECT * FROM (SELECT 'source', source_id, count(*) AS n FROM h GROUP BY source_id ORDER BY n DESC LIMIT 20) UNION ALL SELECT * FROM (SELECT 'type', mod(CAST(hash_n AS BIGINT), 3)::VARCHAR, count(*) AS n FROM (SELECT length(label) AS hash_n FROM h) GROUP BY 2 ORDER BY n DESC LIMIT 20)")
def federated_search(spark, sf):
    """Facets of a search over rows: their number by kind, source and type (here the length of the label, modulo 3), and in all."""
    d = docs(spark, sf).withColumn("type", (F.length("label") % 3).cast("string"))
    return estate.federated_search(search.build_index(d), "building customer", kind="data")[1]


@query("federated_search_hits", f"{INDEX}{bm25_sql(ONE)} SELECT id, label, kind, source_id, round(score + 2, 6) AS score, replace(replace(replace(f_text, 'BUILDING', '<em>BUILDING</em>'), 'Customer', '<em>Customer</em>'), 'customer', '<em>customer</em>') AS fragment FROM s JOIN docs USING (id) WHERE kind = 'data' AND source_id = 'crm'")
def federated_search_hits(spark, sf):
    """All hits of one source, with their fragments."""
    hits, _ = estate.federated_search(index(spark, sf), "building customer", None, "data", "crm")
    return hits.select("id", "label", "kind", "source_id", F.round("score", 6).alias("score"), "fragment")


@query("index_upsert", f"WITH {DOCS.replace(chr(39) + 'model' + chr(39) + ', ' + chr(39) + 'crm' + chr(39) + ', n_name, n_name, n_name', chr(39) + 'model' + chr(39) + ', ' + chr(39) + 'crm' + chr(39) + ', n_name, n_name || ' + chr(39) + ' anew' + chr(39) + ', n_name || ' + chr(39) + ' anew' + chr(39))}, " + INDEX.split(", f AS", 1)[1].join(["f AS", ""]) + " SELECT p.field AS field, p.term AS term, p.id AS id, p.tf AS tf, len.len AS len FROM p JOIN len ON p.field = len.field AND p.id = len.id")
def index_upsert(spark, sf):
    """Documents that are there come again with other text: their old postings go."""
    d = docs(spark, sf)
    new = d.where("kind = 'model'").withColumn("fields", F.transform_values("fields", lambda k, v: F.concat(v, F.lit(" anew"))))
    i = search.index_upsert(search.build_index(d), new)
    return i.postings.join(i.lengths, ["field", "id"]).select("field", "term", "id", "tf", "len")


@query("near_duplicate_labels", f"""{INDEX}{bm25_sql("SELECT 'p' || p_partkey AS qid, p_name || ' xq' AS text FROM part UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation")}, k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rk FROM (SELECT qid, id, score FROM s)),
b AS (SELECT k.qid AS qid, k.id AS id, docs.label AS label, lower(docs.label) = lower(qs.text) AS exact, CASE WHEN lower(docs.label) = lower(qs.text) THEN 100.0 ELSE round(score / max(score) OVER (PARTITION BY k.qid) * 90) END AS points FROM k JOIN docs USING (id) JOIN qs ON qs.qid = k.qid WHERE rk <= 4),
z AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY points DESC, exact DESC, id) AS rank FROM b) SELECT qid, CAST(points AS BIGINT) AS score, exact FROM z WHERE rank <= 1 AND points >= 60 AND NOT exact""")
def near_duplicate_labels(spark, sf):
    """Part names with a word added are found again, close but not the same; nation names, which are there, are not."""
    p = load(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("qid"), F.concat("p_name", F.lit(" xq")).alias("text"))
    n = load(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("qid"), F.col("n_name").alias("text"))
    return search.near_duplicate_labels(index(spark, sf), p.union(n)).select("qid", "score", "exact")


@query("highlight", """WITH x AS (SELECT doc_id, text, greatest(1, coalesce(least(nullif(strpos(lower(text), 'token'), 0), nullif(strpos(lower(text), 'the'), 0)), 1) - 30) AS pos FROM documents)
SELECT doc_id, CASE WHEN pos > 1 THEN '…' ELSE '' END || regexp_replace(regexp_replace(substring(text, pos, 90), '(?i)token', '<em>\\0</em>', 'g'), '(?i)the', '<em>\\0</em>', 'g') || CASE WHEN length(text) >= pos + 90 THEN '…' ELSE '' END AS fragment FROM x""")
def highlight(spark, sf):
    return search.highlight(load(spark, sf, "documents").select("doc_id", "text"), "text", "token the").select("doc_id", "fragment")


# Prefixes.
PREFIXES = {"data": DATA, "part": DATA + "part/", "named": DATA + "part/named/"}


@query("shrink_iri", f"SELECT '{DATA}part/' || p_partkey AS iri, '{DATA}part/' || p_partkey AS curie FROM part UNION ALL SELECT DISTINCT '{DATA}part/named/' || regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g'), 'named:' || regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') FROM part UNION ALL SELECT DISTINCT '{DATA}part/x' || p_size, 'part:x' || p_size FROM part UNION ALL SELECT 'http://x/' || n_nationkey, 'http://x/' || n_nationkey FROM nation")
def shrink_iri(spark, sf):
    """The longest namespace wins; what follows it must be a name, so a number stays as it is."""
    p = load(spark, sf, "part")
    iris = p.select(meta.subject(TABLES["part"]).alias("iri")).union(p.select(F.concat(F.lit(DATA + "part/named/"), F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_"))).distinct()).union(p.select(F.concat(F.lit(DATA + "part/x"), "p_size")).distinct())
    iris = iris.union(load(spark, sf, "nation").select(F.concat(F.lit("http://x/"), "n_nationkey")))
    return iris.select("iri", S.shrink_iri(F.col("iri"), PREFIXES).alias("curie"))


@query("expand_curie", f"SELECT 'part:' || p_partkey AS curie, '{DATA}part/' || p_partkey AS iri FROM part UNION ALL SELECT page_id || '', page_id || '' FROM pages UNION ALL SELECT url, url FROM pages UNION ALL SELECT 'other:' || p_partkey, 'other:' || p_partkey FROM part UNION ALL SELECT 'data:a//' || p_partkey, 'data:a//' || p_partkey FROM part")
def expand_curie(spark, sf):
    p, g = load(spark, sf, "part"), load(spark, sf, "pages")
    of = lambda d, *x: d.select(F.concat(*x).alias("curie"))
    c = of(p, F.lit("part:"), F.col("p_partkey")).union(of(g, F.col("page_id").cast("string"))).union(of(g, F.col("url"))).union(of(p, F.lit("other:"), F.col("p_partkey"))).union(of(p, F.lit("data:a//"), F.col("p_partkey")))
    return c.select("curie", S.expand_curie(F.col("curie"), PREFIXES).alias("iri"))


@query("namespaces", f"""SELECT prefix, '{DATA}' || t || '/' AS ns, n FROM (SELECT 'customer' AS prefix, 'customer' AS t, count(*) AS n FROM customer UNION ALL SELECT 'places', 'nation', count(*) FROM nation UNION ALL SELECT 'region', 'region', count(*) FROM region)
UNION ALL SELECT 'customer2', 'http://example.com/own/customer#', count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT 'n2024', 'http://www.example.org/2024/', count(*) FROM region""")
def namespaces(spark, sf):
    """One prefix is known, the others are made; of two that would be equal the second gets a number."""
    s = crm(spark, sf).select(F.col("s").alias("iri")).distinct()
    s = s.union(load(spark, sf, "customer").select(F.concat(F.lit("http://example.com/own/customer#"), "c_mktsegment")).distinct()).union(load(spark, sf, "region").select(F.concat(F.lit("http://www.example.org/2024/"), "r_name"))).union(load(spark, sf, "region").select(F.concat(F.lit("urn:x/"), "r_name")))
    return estate.namespaces(s, {"places": DATA + "nation/"})


@query("shacl_validate", f"""WITH x AS (SELECT *, '{DATA}customer/' || c_custkey AS focus FROM customer),
v AS (SELECT focus, '{NS}customer_c_acctbal' AS path, 'minInclusive' AS "constraint" FROM x WHERE c_acctbal < 0
  UNION ALL SELECT focus, '{NS}customer_c_acctbal', 'maxInclusive' FROM x WHERE c_acctbal > 9000
  UNION ALL SELECT focus, '{NS}customer_c_name', 'pattern' FROM x WHERE NOT regexp_matches(c_name, '^Customer#0*[1-9][0-9]*$')
  UNION ALL SELECT focus, '{NS}customer_c_name', 'maxLength' FROM x WHERE length(c_name) > 18
  UNION ALL SELECT focus, '{NS}customer_c_mktsegment', 'in' FROM x WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')
  UNION ALL SELECT focus, '{NS}customer_c_nationkey', 'class' FROM x WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)
  UNION ALL SELECT focus, '{NS}customer_phone', 'minCount' FROM x)
SELECT '{GRAPH}crm' AS graph, focus, path, "constraint", CASE path WHEN '{NS}customer_c_acctbal' THEN 'Warning' ELSE 'Violation' END AS severity FROM v
UNION ALL SELECT '{GRAPH}copy', focus, path, "constraint", 'Info' FROM v WHERE path = '{NS}customer_c_acctbal'
UNION ALL SELECT '{GRAPH}copy', focus, '{NS}customer_c_nationkey', 'class', 'Info' FROM x""")
def shacl_validate(spark, sf):
    """Two graphs with shapes of their own: in the second the nations are missing, and all is told as Info."""
    q = crm(spark, sf)
    q = q.unionByName(q.where(F.col("s").startswith(DATA + "customer/")).withColumn("graph", F.lit(GRAPH + "copy")))
    sh = customer_shapes(spark)
    own = sh.withColumn("graph", F.lit(GRAPH + "crm")).withColumn("severity", F.when(F.col("path") == NS + "customer_c_acctbal", "Warning").otherwise("Violation"))
    other = sh.where(F.col("path").isin(NS + "customer_c_acctbal", NS + "customer_c_nationkey")).withColumn("graph", F.lit(GRAPH + "copy")).withColumn("severity", F.lit("Info"))
    return validate.shacl_validate(q, own.unionByName(other)).select("graph", "focus", "path", "constraint", "severity")
