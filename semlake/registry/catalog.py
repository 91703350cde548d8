"""Queries on sources, catalog, selects and links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import DATA, GRAPH, NS, RR, TYPE
from ..operators import closure, dash, graph, select, validate
from ..plans import meta
from ..plans.meta import TABLES, load, sql_instances
from ..sources import databases, io
from .base import ORACLES, query, scratch

CRM = ["region", "nation", "customer"]
Q = f"WITH q AS ({sql_instances(CRM)})"
BIG = ["region", "nation", "customer", "supplier", "part"]
QB = f"WITH q AS ({sql_instances(BIG)})"


def crm(spark, sf):
    return meta.instances(spark, sf, CRM)


def big(spark, sf):
    return meta.instances(spark, sf, BIG)


ORDER_IRI = f"'{DATA}orders/' || o_orderkey"
CUST_IRI = f"'{DATA}customer/' || c_custkey"


@query("entry_orders", f"""
SELECT {ORDER_IRI} AS order_iri, o_orderkey, o_totalprice, {CUST_IRI} AS customer_iri, c_name, 'sales' AS source_id
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000""")
def entry_orders(spark, sf):
    o = select.class_select(load(spark, sf, "orders"), TABLES["orders"], ["o_orderkey", "o_custkey", "o_totalprice"], [("o_totalprice", ">", 200000)])
    c = select.class_select(load(spark, sf, "customer"), TABLES["customer"], ["c_custkey", "c_name"])
    j = o.withColumnRenamed("__iri", "order_iri").join(c.withColumnRenamed("__iri", "customer_iri"), F.col("o_custkey") == F.col("c_custkey"))
    return j.select("order_iri", "o_orderkey", "o_totalprice", "customer_iri", "c_name", F.lit("sales").alias("source_id"))


@query("src_table", "SELECT count(*) AS n, sum(l_quantity) AS qty, count(DISTINCT l_orderkey) AS n_orders FROM lineitem")
def src_table(spark, sf):
    return io.attach(spark, "parquet", sf, "lineitem").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"), F.countDistinct("l_orderkey").alias("n_orders"))


HIGH = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')"


def high(df):
    kept = (F.col("o_totalprice") > 200000) & (F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return df.where(kept).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")


def order_files(spark, sf, path):
    """The orders as SQLite files, one a task, with their keys declared."""
    databases.write_sqlite(load(spark, sf, "orders").repartitionByRange(3, "o_orderkey"), path, "orders", keys="o_orderkey", foreign="o_custkey>customer>c_custkey")


@query("src_sqlite", HIGH)
def src_sqlite(spark, sf):
    """Orders written as SQLite files and read by ranges of rowids, the conditions in each task's query."""
    path = scratch(spark, "sqlite")
    order_files(spark, sf, path)
    return high(io.attach(spark, "sqlite", path, "orders", cutbytes=1, rangerows=20_000))


@query("src_sqlite_schema", """SELECT 'orders' AS "table", c AS "column", t AS sql_type, i AS ordinal, i = 0 AS pk, CASE WHEN i = 1 THEN 'customer' END AS fk_table, CASE WHEN i = 1 THEN 'c_custkey' END AS fk_column, n AS n_rows
FROM (VALUES (0, 'o_orderkey', 'BIGINT'), (1, 'o_custkey', 'BIGINT'), (2, 'o_orderstatus', 'TEXT'), (3, 'o_totalprice', 'DOUBLE'), (4, 'o_orderdate', 'TIMESTAMP'), (5, 'o_orderpriority', 'TEXT')) v(i, c, t), (SELECT count(*) AS n FROM orders)""")
def src_sqlite_schema(spark, sf):
    """What the files declare, and their rows, counted file by file."""
    path = scratch(spark, "sqlite")
    order_files(spark, sf, path)
    return databases.introspect_sqlite(spark, path).drop("notnull")


@query("src_jdbc", HIGH)
def src_jdbc(spark, sf):
    """Orders in a Derby database, read by ranges of their key, the conditions in each connection's query."""
    url = databases.derby_url(spark, scratch(spark, "derby"))
    o = load(spark, sf, "orders").repartitionByRange(2, "o_orderkey")
    o.write.format("jdbc").options(url=url, dbtable="orders", createTableColumnTypes="o_orderstatus VARCHAR(8), o_orderpriority VARCHAR(32)").save()
    return high(io.attach(spark, "derby", url, "orders", key="o_orderkey", rows=20_000))


def _introspect_sql(n):
    t = TABLES[n]
    return " UNION ALL ".join(f"SELECT '{t.source}' AS source_id, '{n}' AS \"table\", '{c}' AS \"column\", '{ty}' AS sql_type, {i} AS ordinal, {str(c in t.keys).lower()} AS pk, {repr(t.fks[c][0]) if c in t.fks else 'CAST(NULL AS VARCHAR)'} AS fk_table, {repr(t.fks[c][1]) if c in t.fks else 'CAST(NULL AS VARCHAR)'} AS fk_column, count(*) AS row_count, count({c}) AS n_values FROM {n}" for i, (c, ty) in enumerate(t.columns))


@query("src_introspect", " UNION ALL ".join(_introspect_sql(n) for n in ("customer", "orders", "part")))
def src_introspect(spark, sf):
    return reduce(DataFrame.unionByName, [select.introspect(load(spark, sf, n), TABLES[n]) for n in ("customer", "orders", "part")])


@query("src_page", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 50")
def src_page(spark, sf):
    return select.page(load(spark, sf, "orders"), ["o_orderkey"], 100, 50)


NT = f"""SELECT graph, '<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'iri' THEN '<' || o || '>'
  ELSE '"' || replace(replace(o, '\\', '\\\\'), '"', '\\"') || '"' || CASE WHEN datatype <> '{meta.XSD}string' THEN '^^<' || datatype || '>' ELSE '' END END || ' .' AS line FROM q"""


@query("sink_ntriples", f"{Q} {NT}")
def sink_ntriples(spark, sf):
    return io.sink_ntriples(crm(spark, sf))


@query("src_ntriples", f"{Q} SELECT graph, s, p, o, o_kind, CASE WHEN datatype <> '{meta.XSD}string' THEN datatype END AS datatype, lang FROM q")
def src_ntriples(spark, sf):
    """The round trip: facts as lines, and lines as facts."""
    return io.parse_ntriples(io.sink_ntriples(crm(spark, sf)))[0]


@query("rows_to_triples", f"{QB} SELECT * FROM q")
def rows_to_triples(spark, sf):
    return big(spark, sf)


@query("rows_to_triples_orders", f"WITH q AS ({sql_instances(['orders'])}) SELECT p, o_kind, datatype, count(*) AS n, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM q GROUP BY ALL")
def rows_to_triples_orders(spark, sf):
    q = meta.instances(spark, sf, ["orders"])
    return q.groupBy("p", "o_kind", "datatype").agg(F.count("*").alias("n"), F.countDistinct("s").alias("subjects"), F.countDistinct("o").alias("objects"))


def used(spark, sf, names):
    """Declared meta rows of tables, with the counts of the data they describe."""
    parts = [load(spark, sf, n).agg(*[F.count(c).alias(c) for c, _ in TABLES[n].columns], F.count("*").alias("__n")).select(F.lit(n).alias("table"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), (F.col(c) == F.col("__n")).alias("full")) for c, _ in TABLES[n].columns])).alias("x")).select("table", "x.*") for n in names]
    seen = reduce(DataFrame.unionByName, parts)
    return closure.cut(meta.table_meta(spark).join(F.broadcast(seen), ["table", "column"]).withColumn("notnull", F.col("full")).drop("full"))  # a row a column; counted once


SCHEMA = ["nation", "customer", "orders"]


def _meta_sql(names):
    rows = []
    for n in names:
        t = TABLES[n]
        rows += [f"SELECT '{n}' AS tab, '{c}' AS col, {i} AS ord, '{meta.datatype(ty)}' AS dt, {repr(t.fks[c][0]) if c in t.fks else 'CAST(NULL AS VARCHAR)'} AS fk, {str(c in t.keys).lower()} AS pk, count({c}) = count(*) AS nn FROM {n}" for i, (c, ty) in enumerate(t.columns)]
    return " UNION ALL ".join(rows)


@query("schema_to_mappings", f"""
WITH m AS ({_meta_sql(SCHEMA)}), c AS (SELECT DISTINCT tab FROM m)
SELECT '{NS}map/' || tab AS s, '{RR}tableName' AS p, tab AS o FROM c
UNION ALL SELECT '{NS}map/' || tab, '{RR}template', '{DATA}' || tab || '/{{' || col || '}}' FROM m WHERE pk
UNION ALL SELECT '{NS}map/' || tab || '/' || col, '{RR}column', col FROM m
UNION ALL SELECT '{NS}map/' || tab || '/' || col, '{RR}refTemplate', '{DATA}' || fk || '/{{' || col || '}}' FROM m WHERE fk IS NOT NULL""")
def schema_to_mappings(spark, sf):
    return meta.schema_to_mappings(used(spark, sf, SCHEMA)).where(F.col("p").isin(RR + "tableName", RR + "template", RR + "column", RR + "refTemplate")).select("s", "p", "o")


def mapping_quads(spark, sf, names=SCHEMA):
    return meta.schema_to_mappings(used(spark, sf, names))


CATALOG_SQL = f"""SELECT '{NS}' || tab AS class_iri, CASE WHEN tab = 'orders' THEN 'sales' ELSE 'crm' END AS source_id, tab AS "table",
  '{DATA}' || tab || '/{{' || (SELECT min(k.col) FROM m k WHERE k.tab = m.tab AND k.pk) || '}}' AS subject_template, col AS "column", '{NS}' || tab || '_' || col AS property,
  CASE WHEN fk IS NULL THEN dt END AS datatype, '{DATA}' || fk || '/{{' || col || '}}' AS ref_template FROM m"""


@query("read_catalog", f"WITH m AS ({_meta_sql(SCHEMA)}) {CATALOG_SQL}")
def read_catalog(spark, sf):
    return meta.read_catalog(mapping_quads(spark, sf))


@query("sync_provenance", f"""{Q}, g AS (SELECT graph, count(*) AS triples, count(DISTINCT s) AS n FROM q GROUP BY graph)
SELECT '{NS}load/' || regexp_extract(graph, '[^/]+$') AS s, '{NS}rows' AS p, CAST(n AS VARCHAR) AS o FROM g
UNION ALL SELECT '{NS}load/' || regexp_extract(graph, '[^/]+$'), '{NS}triples', CAST(triples AS VARCHAR) FROM g""")
def sync_provenance(spark, sf):
    p = io.sync_provenance(crm(spark, sf), "crm", "2024-01-01T00:00:00")
    return p.where(F.col("p").isin(NS + "rows", NS + "triples")).select("s", "p", "o")


@query("class_views", "SELECT c_mktsegment AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def class_views(spark, sf):
    dash.class_views(spark, {f"sem_{n}": load(spark, sf, n) for n in ("customer", "orders")})
    return spark.sql("SELECT c_mktsegment AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM sem_customer JOIN sem_orders ON o_custkey = c_custkey GROUP BY 1")


@query("class_select", f"SELECT {ORDER_IRI} AS __iri, o_orderkey, o_orderstatus FROM orders WHERE o_totalprice >= 100000 AND o_orderpriority LIKE '%HIGH%' ORDER BY o_orderkey DESC LIMIT 200")
def class_select(spark, sf, limit=200):
    return select.class_select(load(spark, sf, "orders"), TABLES["orders"], ["o_orderkey", "o_orderstatus"], [("o_totalprice", ">=", 100000), ("o_orderpriority", "LIKE", "%HIGH%")], ("o_orderkey", False), limit)


@query("class_select_all", ORACLES["class_select"].replace(" LIMIT 200", ""))
def class_select_all(spark, sf):
    """Every row that matches."""
    return class_select(spark, sf, None)


@query("mint_subject", f"SELECT doc_id, '{DATA}doc/' || replace(replace(source, '%', '%25'), ' ', '%20') || '_' || doc_id AS iri FROM documents")
def mint_subject(spark, sf):
    return load(spark, sf, "documents").select("doc_id", S.mint(DATA + "doc/", [F.col("source"), F.col("doc_id")]).alias("iri"))


@query("match_subject", f"SELECT {CUST_IRI} AS iri, 'customer' AS \"table\", CAST(c_custkey AS VARCHAR) AS key FROM customer UNION ALL SELECT {ORDER_IRI}, 'orders', CAST(o_orderkey AS VARCHAR) FROM orders")
def match_subject(spark, sf):
    iris = load(spark, sf, "customer").select(meta.subject(TABLES["customer"]).alias("iri")).union(load(spark, sf, "orders").select(meta.subject(TABLES["orders"])))
    return select.match_subject(iris, list(TABLES.values())).select("iri", "table", F.array_join("keys", "_").alias("key"))


@query("virtual_instances", f"SELECT '{DATA}part/' || p_partkey AS iri, p_name AS label FROM part WHERE contains(lower(p_name), 'a')")
def virtual_instances(spark, sf):
    return select.virtual_instances(load(spark, sf, "part"), TABLES["part"], "A")


@query("label_props", "SELECT 'urn:sem:' || t AS class_iri, 'urn:sem:' || t || '_' || l AS property, n FROM (SELECT 'customer' AS t, 'c_name' AS l, count(c_name) AS n FROM customer UNION ALL SELECT 'part', 'p_name', count(p_name) FROM part UNION ALL SELECT 'supplier', 's_name', count(s_name) FROM supplier UNION ALL SELECT 'nation', 'n_name', count(n_name) FROM nation UNION ALL SELECT 'region', 'r_name', count(r_name) FROM region)")
def label_props(spark, sf):
    roles = select.label_props(spark, [TABLES[n] for n in BIG])
    uses = big(spark, sf).groupBy(F.col("p").alias("property")).agg(F.count("*").alias("n"))
    return F.broadcast(roles).join(uses, "property").select("class_iri", "property", "n")


@query("read_links", "SELECT 'urn:sem:placedBy' AS property, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT 'urn:sem:byCustomer', count(*) FROM events JOIN customer ON user_id = c_custkey UNION ALL SELECT 'urn:sem:labels', count(*) FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def read_links(spark, sf):
    """The declared links, each with its number of row pairs."""
    return reduce(DataFrame.unionByName, [graph.link_join(load(spark, sf, a), TABLES[a], load(spark, sf, b), TABLES[b], NS + p, x, y).groupBy(F.col("predicate").alias("property")).agg(F.count("*").alias("n")) for p, a, x, b, y in meta.LINKS])


@query("resolve_label", f"""{QB} SELECT s AS iri, min(CASE WHEN p IN ('{NS}region_r_name', '{NS}nation_n_name', '{NS}customer_c_name', '{NS}supplier_s_name', '{NS}part_p_name') THEN o END) AS label FROM q GROUP BY s""")
def resolve_label(spark, sf):
    return select.resolve_label(big(spark, sf), select.label_props(spark, [TABLES[n] for n in BIG]))


@query("scope_graph", f"{QB} SELECT s, p, o FROM q WHERE graph = '{GRAPH}supply'")
def scope_graph(spark, sf):
    return select.scope_graph(big(spark, sf), GRAPH + "supply").select("s", "p", "o")


@query("search_contains", f"""{Q}, l AS (SELECT s AS iri, min(o) AS label FROM q WHERE p IN ('{NS}region_r_name', '{NS}nation_n_name', '{NS}customer_c_name') GROUP BY s),
r AS (SELECT s AS iri FROM q UNION SELECT o FROM q WHERE o_kind = 'iri')
SELECT r.iri AS iri, label FROM r LEFT JOIN l ON r.iri = l.iri WHERE contains(lower(coalesce(label, r.iri)), 'nation') OR contains(lower(r.iri), 'nation') ORDER BY iri LIMIT 50""")
def search_contains(spark, sf):
    q = crm(spark, sf)
    return select.search_contains(q, select.resolve_label(q, select.label_props(spark, [TABLES[n] for n in CRM])), "NATION")


@query("object_properties", f"WITH m AS ({_meta_sql(SCHEMA)}) SELECT '{NS}' || tab || '_' || col AS property, '{NS}' || fk AS range FROM m WHERE fk IS NOT NULL")
def object_properties(spark, sf):
    return select.object_properties(meta.schema_to_triples(used(spark, sf, SCHEMA)).where(~F.col("o").startswith("http"))).select("property", "range")


@query("row_provenance", f"SELECT {ORDER_IRI} AS iri, 'orders' AS \"table\", 'sales' AS source_id, '{DATA}orders/{{o_orderkey}}' AS subject_template FROM orders")
def row_provenance(spark, sf):
    rows = load(spark, sf, "orders").select(meta.subject(TABLES["orders"]).alias("iri"), F.lit("orders").alias("table"), F.lit("sales").alias("source_id"))
    return select.row_provenance(rows, meta.catalog(spark))


@query("fk_expand", f"SELECT {CUST_IRI} AS subject, '{NS}customer_c_nationkey' AS predicate, '{DATA}nation/' || c_nationkey AS object FROM customer WHERE c_nationkey IS NOT NULL")
def fk_expand(spark, sf):
    return graph.fk_expand(load(spark, sf, "customer"), TABLES["customer"], "c_nationkey")


@query("link_join", f"SELECT {ORDER_IRI} AS subject, '{NS}placedBy' AS predicate, {CUST_IRI} AS object, c_name AS label FROM orders JOIN customer ON o_custkey = c_custkey")
def link_join(spark, sf):
    return graph.link_join(load(spark, sf, "orders"), TABLES["orders"], load(spark, sf, "customer"), TABLES["customer"], NS + "placedBy", "o_custkey", "c_custkey")


@query("link_join_reverse", f"SELECT {CUST_IRI} AS subject, '^{NS}placedBy' AS predicate, {ORDER_IRI} AS object, o_orderpriority AS label FROM orders JOIN customer ON o_custkey = c_custkey")
def link_join_reverse(spark, sf):
    return graph.link_join(load(spark, sf, "orders"), TABLES["orders"], load(spark, sf, "customer"), TABLES["customer"], NS + "placedBy", "o_custkey", "c_custkey", reverse=True)


@query("describe_batch", f"""WITH q AS ({sql_instances(['customer'])}),
i AS (SELECT {CUST_IRI} AS iri FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT '{DATA}customer/' || (0 - c_custkey) FROM customer WHERE c_mktsegment = 'MACHINERY'),
l AS (SELECT {CUST_IRI} AS iri, '^{NS}placedBy' AS predicate, {ORDER_IRI} AS value, 'link' AS kind, row_number() OVER (PARTITION BY c_custkey ORDER BY {ORDER_IRI}) AS rn FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT s AS iri, p AS predicate, o AS value, o_kind AS kind FROM q SEMI JOIN i ON q.s = i.iri
UNION ALL SELECT iri, predicate, value, kind FROM l SEMI JOIN i ON l.iri = i.iri WHERE rn <= 25
UNION ALL SELECT iri, NULL, NULL, 'missing' FROM i ANTI JOIN q ON q.s = i.iri""")
def describe_batch(spark, sf, per_link=25):
    c = load(spark, sf, "customer")
    iris = c.where("c_mktsegment = 'BUILDING'").select(meta.subject(TABLES["customer"]).alias("iri")).union(c.where("c_mktsegment = 'MACHINERY'").select(F.concat(F.lit(DATA + "customer/"), (-F.col("c_custkey")).cast("string"))))
    links = graph.link_join(load(spark, sf, "orders"), TABLES["orders"], c, TABLES["customer"], NS + "placedBy", "o_custkey", "c_custkey", reverse=True)
    return graph.describe_batch(iris, meta.instances(spark, sf, ["customer"]), links, per_link)


@query("describe_batch_all", ORACLES["describe_batch"].replace(" WHERE rn <= 25", ""))
def describe_batch_all(spark, sf):
    """Every object of each link."""
    return describe_batch(spark, sf, None)


@query("lineage_path", f"""
SELECT {CUST_IRI} AS customer, {ORDER_IRI} AS order_iri, '{DATA}part/' || p_partkey AS part, '{DATA}supplier/' || s_suppkey AS supplier, count(*) AS n,
  'crm>sales>supply' AS sources
FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2, 3, 4""")
def lineage_path(spark, sf):
    t = {n: load(spark, sf, n) for n in ("customer", "orders", "lineitem", "part", "supplier")}
    hop = t["orders"].where("o_orderpriority = '1-URGENT'").join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["lineitem"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["part"], F.col("l_partkey") == F.col("p_partkey")).join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
    iri = lambda n: meta.subject(TABLES[n])
    return hop.groupBy(iri("customer").alias("customer"), iri("orders").alias("order_iri"), iri("part").alias("part"), iri("supplier").alias("supplier")).agg(F.count("*").alias("n")).withColumn("sources", F.lit("crm>sales>supply"))


LAB = f"(SELECT s AS iri, min(o) AS label FROM q WHERE p IN ('{NS}region_r_name', '{NS}nation_n_name', '{NS}customer_c_name') GROUP BY s)"


@query("describe_resource", f"""{Q}, l AS {LAB},
e AS (SELECT DISTINCT s AS iri, 'out' AS direction, p, o AS other, o_kind FROM q UNION SELECT DISTINCT o, 'in', p, s, 'iri' FROM q WHERE o_kind = 'iri'),
r AS (SELECT *, row_number() OVER (PARTITION BY iri, direction ORDER BY p, other, o_kind) AS rn FROM e WHERE iri LIKE '{DATA}nation/%')
SELECT r.iri AS iri, direction, p, other, label FROM r LEFT JOIN l ON r.other = l.iri WHERE rn <= CASE direction WHEN 'out' THEN 1000 ELSE 200 END""")
def describe_resource(spark, sf, out_limit=1000, in_limit=200):
    q = crm(spark, sf)
    labels = select.resolve_label(q, select.label_props(spark, [TABLES[n] for n in CRM]))
    return graph.describe_resource(q, labels, load(spark, sf, "nation").select(meta.subject(TABLES["nation"]).alias("iri")), GRAPH + "crm", out_limit, in_limit)


@query("describe_resource_all", ORACLES["describe_resource"].replace(" WHERE rn <= CASE direction WHEN 'out' THEN 1000 ELSE 200 END", ""))
def describe_resource_all(spark, sf):
    """Every statement from and to each IRI."""
    return describe_resource(spark, sf, None, None)


@query("expand_neighbors", f"""{Q}, e AS (SELECT DISTINCT s, o FROM q WHERE o_kind = 'iri' AND p <> '{TYPE}'),
b AS (SELECT s AS iri, o AS neighbor FROM e UNION SELECT o, s FROM e)
SELECT iri, neighbor FROM (SELECT *, row_number() OVER (PARTITION BY iri ORDER BY neighbor) AS rn FROM b WHERE iri <> neighbor AND iri LIKE '{DATA}nation/%') WHERE rn <= 25""")
def expand_neighbors(spark, sf, limit=25):
    return graph.expand_neighbors(crm(spark, sf), load(spark, sf, "nation").select(meta.subject(TABLES["nation"]).alias("iri")), limit)


@query("expand_neighbors_all", ORACLES["expand_neighbors"].replace(" WHERE rn <= 25", ""))
def expand_neighbors_all(spark, sf):
    """Every neighbour of each node."""
    return expand_neighbors(spark, sf, None)


@query("triples_to_edges", f"{QB} SELECT DISTINCT s AS src, p, o AS dst FROM q WHERE o_kind = 'iri' AND p <> '{TYPE}'")
def triples_to_edges(spark, sf):
    q = big(spark, sf)
    return graph.triples_to_edges(q, select.resolve_label(q, select.label_props(spark, [TABLES[n] for n in BIG])))[1]


@query("schema_edges", f"WITH m AS ({_meta_sql(SCHEMA)}) SELECT DISTINCT '{NS}' || tab AS a, '{NS}' || tab || '_' || col AS via, '{NS}' || fk AS b FROM m WHERE fk IS NOT NULL")
def schema_edges(spark, sf):
    return graph.schema_edges(meta.schema_to_triples(used(spark, sf, SCHEMA)))


@query("read_shapes", f"WITH m AS ({_meta_sql(SCHEMA)}) SELECT '{NS}' || tab || 'Shape' AS shape, '{NS}' || tab AS target_class, '{NS}' || tab || '_' || col AS path, CASE WHEN fk IS NULL THEN dt END AS datatype, '{NS}' || fk AS class_iri, CASE WHEN nn OR pk THEN 1 END AS min_count, 1 AS max_count, ord FROM m")
def read_shapes(spark, sf):
    return validate.read_shapes(meta.schema_to_triples(used(spark, sf, SCHEMA))).select("shape", "target_class", "path", "datatype", "class_iri", "min_count", "max_count", "ord")


@query("virtual_search", f"""
WITH e AS (SELECT '{NS}customer' AS class_iri, {CUST_IRI} AS iri, c_name AS label FROM customer UNION ALL SELECT '{NS}part', '{DATA}part/' || p_partkey, p_name FROM part UNION ALL SELECT '{NS}supplier', '{DATA}supplier/' || s_suppkey, s_name FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY class_iri ORDER BY label, iri) AS rn FROM e WHERE contains(lower(label), '1'))
SELECT class_iri, iri, label FROM r WHERE rn <= 3 ORDER BY class_iri, rn LIMIT 30""")
def virtual_search(spark, sf):
    return select.virtual_search(spark, sf, [TABLES[n] for n in ("customer", "part", "supplier")], "1")


@query("sort_page", f"SELECT '{DATA}part/' || p_partkey AS __iri, p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, __iri LIMIT 40 OFFSET 20")
def sort_page(spark, sf):
    return select.class_select(load(spark, sf, "part"), TABLES["part"], ["p_partkey", "p_retailprice"], order_by=("p_retailprice", False), limit=40, offset=20)
