"""Queries on graph counts, algebra, closures, rules and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model
from ..functions import scalars as S
from ..model import ALT, BROADER, DATA, DEFINITION, DEPRECATED, FIRST, GRAPH, IN_SCHEME, NIL, NS, PREF, REST, SH, SKOS, SUBCLASS, TOP_OF, TYPE, XSD, dealt, fact, facts
from ..operators import algebra, closure, graph, select, validate
from ..plans import meta
from ..plans.meta import TABLES, load, sql_instances
from .base import query
from .catalog import BIG, QB, SCHEMA, Q, _meta_sql, big, crm, used


@query("class_counts", f"{QB} SELECT o AS class_iri, count(DISTINCT s) AS n FROM q WHERE p = '{TYPE}' GROUP BY o ORDER BY n DESC, class_iri LIMIT 500")
def class_counts(spark, sf):
    q = big(spark, sf)
    return graph.class_counts(q, select.resolve_label(q, select.label_props(spark, [TABLES[n] for n in BIG]))).select("class_iri", "n")


@query("shape_counts", f"WITH m AS ({_meta_sql(SCHEMA)}) SELECT '{NS}' || tab || 'Shape' AS shape, '{NS}' || tab AS target_class, count(*) AS n FROM m GROUP BY tab")
def shape_counts(spark, sf):
    return graph.shape_counts(meta.schema_to_triples(used(spark, sf, SCHEMA)))


@query("usage_counts", f"""{Q}, u AS (
  SELECT DISTINCT 'incoming' AS role, o AS iri, s AS who FROM q WHERE o_kind = 'iri'
  UNION SELECT DISTINCT 'predicate', p, s || ' ' || o FROM q)
SELECT iri, count(*) FILTER (role = 'incoming') AS incoming, count(*) FILTER (role = 'predicate') AS as_predicate, 0 AS in_shapes, 0 AS in_mappings, false AS deprecated FROM u GROUP BY iri""")
def usage_counts(spark, sf):
    return graph.usage_counts(crm(spark, sf))


PROFILE = f"""t AS (SELECT DISTINCT s, o AS class_iri FROM q WHERE p = '{TYPE}'), c AS (SELECT class_iri, count(*) AS total FROM t GROUP BY class_iri),
pr AS (SELECT t.class_iri AS class_iri, q.p AS p, count(DISTINCT q.s) AS subjects, count(*) AS uses, min(q.datatype) AS datatype, min(CASE WHEN q.o_kind = 'iri' THEN k.class_iri END) AS o_class
  FROM q JOIN t ON q.s = t.s LEFT JOIN t k ON q.o = k.s WHERE q.p <> '{TYPE}' GROUP BY 1, 2)"""


@query("profile_class", f"{QB}, {PROFILE} SELECT pr.*, total FROM pr JOIN c USING (class_iri)")
def profile_class(spark, sf):
    return graph.profile_class(big(spark, sf))


@query("generate_shape", f"""{QB}, {PROFILE} SELECT class_iri, p AS path, CASE WHEN subjects = total THEN 1 END AS min_count, CASE WHEN uses = subjects THEN 1 END AS max_count, datatype,
  CASE WHEN datatype IS NULL THEN o_class END AS class_ref, row_number() OVER (PARTITION BY class_iri ORDER BY subjects DESC, p) AS ord FROM pr JOIN c USING (class_iri)""")
def generate_shape(spark, sf):
    return graph.generate_shape(graph.profile_class(big(spark, sf)))


@query("hist_buckets", "SELECT event_type, " + ", ".join(f"count(*) FILTER (value <= {b}) AS le_{b}" for b in (5, 25, 100, 250, 1000, 5000)) + ", round(sum(value), 4) AS total, count(value) AS n FROM events GROUP BY event_type")
def hist_buckets(spark, sf):
    return graph.hist_buckets(load(spark, sf, "events"), "value", ["event_type"]).withColumn("total", F.round("total", 4))


# A taxonomy of the data: regions above nations, part types as classes below Part.
def geo_concepts(spark, sf):
    r = facts(load(spark, sf, "region"), GRAPH + "geo", F.concat(F.lit(NS + "geo/r"), "r_regionkey"), fact(TYPE, F.lit(SKOS + "Concept"), "iri"), fact(PREF, F.col("r_name")), fact(IN_SCHEME, F.lit(NS + "geo"), "iri"), fact(TOP_OF, F.lit(NS + "geo"), "iri"))
    n = facts(load(spark, sf, "nation"), GRAPH + "geo", F.concat(F.lit(NS + "geo/n"), "n_nationkey"), fact(TYPE, F.lit(SKOS + "Concept"), "iri"), fact(PREF, F.col("n_name")), fact(IN_SCHEME, F.lit(NS + "geo"), "iri"), fact(BROADER, F.concat(F.lit(NS + "geo/r"), "n_regionkey"), "iri"), fact(DEPRECATED, F.when(F.col("n_nationkey") % 7 == 0, F.lit("true"))), fact(ALT, F.lower("n_name")), fact(DEFINITION, F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))))
    s = facts(load(spark, sf, "region").limit(1), GRAPH + "geo", F.lit(NS + "geo"), fact(TYPE, F.lit(SKOS + "ConceptScheme"), "iri"), fact(PREF, F.lit("Geography")))
    return r.unionByName(n).unionByName(s)


def part_classes(spark, sf):
    """Each part typed by its type's class; types below Part by their last word."""
    p = load(spark, sf, "part")
    cls = F.concat(F.lit(NS + "type/"), S.slug(F.col("p_type")))
    last = F.concat(F.lit(NS + "kind/"), S.slug(F.element_at(F.split("p_type", " "), -1)))
    t = facts(dealt(p, "p_partkey", rows=model.TASK_ROWS), GRAPH + "supply", meta.subject(TABLES["part"]), fact(TYPE, cls, "iri"))
    sub = facts(p.select("p_type").distinct(), GRAPH + "types", cls, fact(SUBCLASS, last, "iri"))
    top = facts(p.select(F.element_at(F.split("p_type", " "), -1).alias("k")).distinct(), GRAPH + "types", F.concat(F.lit(NS + "kind/"), S.slug(F.col("k"))), fact(SUBCLASS, F.lit(NS + "Part"), "iri"))
    return t.unionByName(sub).unionByName(top)


SLUG = "regexp_replace(lower(trim({0})), '[^a-z0-9]+', '-', 'g')"
LAST = "string_split(p_type, ' ')[-1]"
CLOSE = f"""WITH RECURSIVE e AS (SELECT DISTINCT '{NS}type/' || {SLUG.format('p_type')} AS sub, '{NS}kind/' || {SLUG.format(LAST)} AS super FROM part
  UNION SELECT DISTINCT '{NS}kind/' || {SLUG.format(LAST)}, '{NS}Part' FROM part),
r AS (SELECT sub, super FROM e UNION SELECT r.sub, e.super FROM r JOIN e ON r.super = e.sub),
c AS (SELECT sub, super FROM r UNION SELECT sub, sub FROM e UNION SELECT super, super FROM e)"""


@query("subclass_closure", f"{CLOSE} SELECT sub, super FROM c")
def subclass_closure(spark, sf):
    return closure.subclass_closure(part_classes(spark, sf))


@query("instances_closure", f"{CLOSE} SELECT '{DATA}part/' || p_partkey AS inst, c.super AS class_iri FROM part JOIN c ON c.sub = '{NS}type/' || {SLUG.format('p_type')}")
def instances_closure(spark, sf):
    return closure.instances_closure(part_classes(spark, sf))


UNDER = """WITH RECURSIVE u AS (SELECT c_custkey AS a, c_custkey // 2 AS b FROM customer WHERE c_custkey > 1 UNION ALL SELECT a, b // 2 FROM u WHERE b > 1)"""


def under(spark, sf):
    """Customers as a binary tree of their keys, each typed by its own class."""
    c = load(spark, sf, "customer")
    iri = lambda k: F.concat(F.lit(NS + "c/"), k.cast("string"))
    tree = c.where("c_custkey > 1").select(iri(F.col("c_custkey")).alias("a"), iri(F.expr("c_custkey div 2")).alias("b"))
    return tree, facts(c, GRAPH + "crm", F.concat(F.lit(DATA + "customer/"), F.col("c_custkey").cast("string")), fact(TYPE, iri(F.col("c_custkey")), "iri"))


@query("class_intervals", f"{UNDER} SELECT '{NS}c/' || c_custkey AS iri, '{NS}c/1' AS root, count(a) AS below FROM customer LEFT JOIN u ON b = c_custkey WHERE c_custkey > 0 GROUP BY c_custkey")
def class_intervals(spark, sf):
    """How many classes are below each, from its interval alone."""
    return closure.intervals(under(spark, sf)[0]).select("iri", "root", F.expr("(post - pre - 1) div 2").alias("below"))


@query("instances_within", f"{UNDER}, x AS (SELECT a, b FROM u UNION ALL SELECT c_custkey, c_custkey FROM customer) SELECT '{NS}c/' || b AS class_iri, '{DATA}customer/' || a AS inst FROM x WHERE b IN (2, 3, 5, 12)")
def instances_within(spark, sf):
    """The instances of four classes and all below them, by range tests."""
    tree, typed = under(spark, sf)
    asked = spark.createDataFrame([(f"{NS}c/{k}",) for k in (2, 3, 5, 12)], "class_iri string")
    return closure.instances_within(typed, closure.intervals(tree), asked)


@query("list_walk", "SELECT 'urn:sem:l/' || o_custkey || '/0' AS head, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, CAST(o_orderkey AS VARCHAR) AS value FROM orders")
def list_walk(spark, sf):
    """The orders of each customer as a list, walked."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = load(spark, sf, "orders").withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("o_custkey")))
    cell = lambda i: F.concat(F.lit("urn:sem:l/"), F.col("o_custkey").cast("string"), F.lit("/"), i.cast("string"))
    q = facts(o, GRAPH + "lists", cell(F.col("i")), fact(FIRST, F.col("o_orderkey")), fact(REST, F.when(F.col("i") + 1 < F.col("n"), cell(F.col("i") + 1)).otherwise(NIL), "iri"))
    return closure.list_walk(q)


@query("concept_rows", f"SELECT '{NS}geo/n' || n_nationkey AS iri, n_name AS label, '{NS}geo/r' || n_regionkey AS broader, n_nationkey % 7 = 0 AS deprecated FROM nation UNION ALL SELECT '{NS}geo/r' || r_regionkey, r_name, NULL, false FROM region")
def concept_rows(spark, sf):
    return closure.concept_rows(geo_concepts(spark, sf), NS + "geo")


@query("taxonomy_tree", f"""SELECT '{NS}geo/r' || r_regionkey AS iri, '{NS}geo/r' || r_regionkey AS root, 0 AS depth, CAST(NULL AS VARCHAR) AS parent, row_number() OVER (ORDER BY r_name) AS pos FROM region
UNION ALL SELECT '{NS}geo/n' || n_nationkey, '{NS}geo/r' || n_regionkey, 1, '{NS}geo/r' || n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name, '{NS}geo/n' || n_nationkey) FROM nation""")
def taxonomy_tree(spark, sf):
    return closure.taxonomy_tree(closure.concept_rows(geo_concepts(spark, sf), NS + "geo"))


@query("active_codes", f"SELECT '{NS}geo/n' || n_nationkey AS iri, n_name AS label FROM nation WHERE n_nationkey % 7 <> 0 UNION ALL SELECT '{NS}geo/r' || r_regionkey, r_name FROM region")
def active_codes(spark, sf):
    return select.active_codes(geo_concepts(spark, sf), NS + "geo")


@query("scheme_counts", f"SELECT '{NS}geo' AS scheme, 'Geography' AS label, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n")
def scheme_counts(spark, sf):
    return graph.scheme_counts(geo_concepts(spark, sf))


CHECK_SQL = f"""WITH m AS ({_meta_sql(SCHEMA)})
SELECT 'classes_without_label' AS check_id, 0 AS n UNION ALL SELECT 'classes_without_shape', 0
UNION ALL SELECT 'concepts_without_definition', count(*) FILTER (n_nationkey % 2 <> 0) + (SELECT count(*) FROM region) FROM nation
UNION ALL SELECT 'concepts_without_scheme', 0 UNION ALL SELECT 'properties_without_domain', 0 UNION ALL SELECT 'fields_without_concept', count(*) FROM m"""


def quality_quads(spark, sf):
    m = used(spark, sf, SCHEMA)
    return geo_concepts(spark, sf).unionByName(meta.schema_to_triples(m)).unionByName(meta.schema_to_mappings(m))


@query("quality_checks", CHECK_SQL)
def quality_checks(spark, sf):
    return graph.quality_checks(quality_quads(spark, sf))


@query("quality_snapshot", f"SELECT 1 AS run_id, TIMESTAMP '2024-01-01 00:00:00' AS at, check_id, n FROM ({CHECK_SQL})")
def quality_snapshot(spark, sf):
    return graph.quality_snapshot(graph.quality_checks(quality_quads(spark, sf)), F.lit(1), F.to_timestamp(F.lit("2024-01-01 00:00:00")))


@query("quality_history", "SELECT strftime(ts, '%Y-%m-%d') AS run_id, max(ts) AS at, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS purchases FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 30")
def quality_history(spark, sf):
    """Each day of events as a run with two checks."""
    e = load(spark, sf, "events").withColumn("run_id", F.date_format("ts", "yyyy-MM-dd"))
    at = e.groupBy("run_id").agg(F.max("ts").alias("at"), F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("purchases"))
    runs = at.select("run_id", "at", F.explode(F.array(F.struct(F.lit("errors").alias("check_id"), F.col("errors").alias("n")), F.struct(F.lit("purchases").alias("check_id"), F.col("purchases").alias("n")))).alias("x")).select("run_id", "at", "x.*")
    return graph.quality_history(runs, ["errors", "purchases"])


# Algebra: version 2 of the customer facts has changed balances and no MACHINERY customers.
def customer_versions(spark, sf):
    c = load(spark, sf, "customer")
    v2 = c.where("c_mktsegment <> 'MACHINERY'").withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 == 0, F.lit(0.0)).otherwise(F.col("c_acctbal")))
    return meta.rows_to_triples(c, TABLES["customer"]), meta.rows_to_triples(v2, TABLES["customer"])


V = f"""WITH a AS ({sql_instances(['customer'])}), b AS (SELECT * FROM ({sql_instances(['customer']).replace('FROM customer', "FROM (SELECT * REPLACE (CASE WHEN c_custkey % 10 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal) FROM customer WHERE c_mktsegment <> 'MACHINERY')")}))"""
T3 = "s, p, o, o_kind, datatype"
DIFF = f"SELECT 'added' AS change, {T3} FROM (SELECT {T3} FROM b EXCEPT SELECT {T3} FROM a) UNION ALL SELECT 'removed', {T3} FROM (SELECT {T3} FROM a EXCEPT SELECT {T3} FROM b)"


@query("graph_diff", f"{V} {DIFF}")
def graph_diff(spark, sf):
    return algebra.graph_diff(*customer_versions(spark, sf)).drop("lang")


@query("diff_mode", f"{V}, d AS ({DIFF}) SELECT CASE WHEN bool_or(s LIKE '\\_:%' ESCAPE '\\') THEN 'replace' ELSE 'patch' END AS mode FROM d")
def diff_mode(spark, sf):
    return algebra.diff_mode(algebra.graph_diff(*customer_versions(spark, sf)))


@query("invert_diff", f"{V}, d AS ({DIFF}) SELECT CASE change WHEN 'added' THEN 'removed' ELSE 'added' END AS change, {T3} FROM d")
def invert_diff(spark, sf):
    return algebra.invert_diff(algebra.graph_diff(*customer_versions(spark, sf))).drop("lang")


@query("apply_diff", f"{V} SELECT DISTINCT {T3} FROM b")
def apply_diff(spark, sf):
    a, b = customer_versions(spark, sf)
    return algebra.apply_diff(a, algebra.graph_diff(a, b)).drop("lang")


@query("insert_data", f"{V} SELECT {T3} FROM a UNION SELECT {T3} FROM b")
def insert_data(spark, sf):
    return algebra.insert_data(*customer_versions(spark, sf)).drop("lang", "graph")


@query("delete_data", f"{V} SELECT DISTINCT {T3} FROM a EXCEPT SELECT {T3} FROM b")
def delete_data(spark, sf):
    return algebra.delete_data(*customer_versions(spark, sf)).drop("lang", "graph")


@query("replace_value", f"WITH q AS ({sql_instances(['customer'])}) SELECT DISTINCT s, p, CASE WHEN p = '{NS}customer_c_mktsegment' AND o = 'BUILDING' THEN 'HOUSING' ELSE o END AS o FROM q")
def replace_value(spark, sf):
    q = meta.instances(spark, sf, ["customer"])
    ch = q.where((F.col("p") == NS + "customer_c_mktsegment") & (F.col("o") == "BUILDING")).withColumn("new_o", F.lit("HOUSING"))
    return algebra.replace_value(q, ch).select("s", "p", "o")


@query("delete_resource", f"{Q} SELECT s, p, o FROM q WHERE s NOT IN (SELECT '{DATA}nation/' || n_nationkey FROM nation WHERE n_nationkey % 3 = 0) AND NOT (o_kind = 'iri' AND o IN (SELECT '{DATA}nation/' || n_nationkey FROM nation WHERE n_nationkey % 3 = 0))")
def delete_resource(spark, sf):
    gone = load(spark, sf, "nation").where("n_nationkey % 3 = 0").select(meta.subject(TABLES["nation"]).alias("iri"))
    return algebra.delete_resource(crm(spark, sf), gone).select("s", "p", "o")


@query("rename_iri", f"{Q}, n AS (SELECT '{DATA}nation/' || n_nationkey AS old, '{DATA}country/' || n_name AS new FROM nation) SELECT DISTINCT coalesce(x.new, s) AS s, p, coalesce(y.new, o) AS o FROM q LEFT JOIN n x ON q.s = x.old LEFT JOIN n y ON q.o = y.old AND q.o_kind = 'iri'")
def rename_iri(spark, sf):
    names = load(spark, sf, "nation").select(meta.subject(TABLES["nation"]).alias("old"), F.concat(F.lit(DATA + "country/"), "n_name").alias("new"))
    return algebra.rename_iri(crm(spark, sf), names).select("s", "p", "o")


@query("set_deprecated", f"SELECT '{NS}geo/n' || n_nationkey AS s FROM nation WHERE n_nationkey % 7 = 0 UNION SELECT '{NS}geo/r' || r_regionkey FROM region")
def set_deprecated(spark, sf):
    iris = load(spark, sf, "region").select(F.concat(F.lit(NS + "geo/r"), "r_regionkey").alias("iri"))
    return algebra.set_deprecated(geo_concepts(spark, sf), iris, True, GRAPH + "geo").where((F.col("p") == DEPRECATED) & (F.col("o") == "true")).select("s")


@query("rename_concepts", f"SELECT '{NS}geo/n' || n_nationkey AS s, upper(n_name) || '!' AS o FROM nation UNION ALL SELECT '{NS}geo/r' || r_regionkey, r_name FROM region UNION ALL SELECT '{NS}geo', 'Geography'")
def rename_concepts(spark, sf):
    names = load(spark, sf, "nation").select(F.concat(F.lit(NS + "geo/n"), "n_nationkey").alias("s"), F.concat(F.upper("n_name"), F.lit("!")).alias("label"))
    return algebra.rename_concepts(geo_concepts(spark, sf), names).where(F.col("p") == PREF).select("s", "o")


@query("reparent_concepts", f"SELECT '{NS}geo/n' || n_nationkey AS s, CASE WHEN n_nationkey % 2 = 0 THEN '{TOP_OF}' ELSE '{BROADER}' END AS p, CASE WHEN n_nationkey % 2 = 0 THEN '{NS}geo' ELSE '{NS}geo/r0' END AS o FROM nation UNION ALL SELECT '{NS}geo/r' || r_regionkey, '{TOP_OF}', '{NS}geo' FROM region")
def reparent_concepts(spark, sf):
    ch = load(spark, sf, "nation").select(F.concat(F.lit(NS + "geo/n"), "n_nationkey").alias("s"), F.when(F.col("n_nationkey") % 2 != 0, F.lit(NS + "geo/r0")).alias("parent"))
    return algebra.reparent_concepts(geo_concepts(spark, sf), ch).where(F.col("p").isin(BROADER, TOP_OF)).select("s", "p", "o")


@query("create_entities", f"""WITH k AS (SELECT DISTINCT c_mktsegment AS m FROM customer), x AS (SELECT '{NS}' || {SLUG.format('m')} AS s, m FROM k)
SELECT s, '{TYPE}' AS p, '{SKOS}Concept' AS o FROM x UNION ALL SELECT s, '{PREF}', m FROM x UNION ALL SELECT s, '{IN_SCHEME}', '{NS}segments' FROM x UNION ALL SELECT s, '{TOP_OF}', '{NS}segments' FROM x""")
def create_entities(spark, sf):
    spec = load(spark, sf, "customer").select("c_mktsegment").distinct().select(F.lit("concept").alias("kind"), F.col("c_mktsegment").alias("name"), F.col("c_mktsegment").alias("label"), F.lit(None).cast("string").alias("parent"), F.lit("segments").alias("scheme"))
    return algebra.create_entities(spec).select("s", "p", "o")


@query("edit_mapping", f"WITH m AS ({_meta_sql(SCHEMA)}) SELECT '{NS}map/' || tab || '/' || col AS s, CASE WHEN fk IS NULL AND dt LIKE '%integer' THEN '{XSD}long' ELSE dt END AS o FROM m WHERE fk IS NULL")
def edit_mapping(spark, sf):
    q = meta.schema_to_mappings(used(spark, sf, SCHEMA))
    p = "http://www.w3.org/ns/r2rml#datatype"
    ch = q.where((F.col("p") == p) & (F.col("o") == XSD + "integer")).select("s", "p", F.lit(XSD + "long").alias("new_o"))
    return algebra.edit_mapping(q, ch).where(F.col("p") == p).select("s", "o")


@query("edit_constraint", f"WITH m AS ({_meta_sql(SCHEMA)}) SELECT '{NS}' || tab || '_' || col || 'Shape' AS s, CASE WHEN col = 'c_acctbal' THEN '0' ELSE '1' END AS o FROM m WHERE tab <> 'customer' OR col <> 'c_name'")
def edit_constraint(spark, sf):
    q = meta.schema_to_triples(used(spark, sf, SCHEMA))
    ch = spark.createDataFrame([(NS + "customerShape", NS + "customer_c_acctbal", SH + "maxCount", "0"), (NS + "customerShape", NS + "customer_c_name", SH + "maxCount", None)], "shape string, path string, constraint string, value string")
    return algebra.edit_constraint(q, ch, GRAPH + "schema").where(F.col("p") == SH + "maxCount").select("s", "o")


@query("upsert_keyed", f"""WITH a AS ({sql_instances(['customer'])}) SELECT s, p, o FROM a WHERE s NOT IN (SELECT '{DATA}customer/' || c_custkey FROM customer WHERE c_custkey % 10 = 0)
UNION ALL SELECT '{DATA}customer/' || c_custkey, '{NS}customer_c_name', upper(c_name) FROM customer WHERE c_custkey % 10 = 0""")
def upsert_keyed(spark, sf):
    c = load(spark, sf, "customer")
    new = facts(c.where("c_custkey % 10 = 0"), GRAPH + "crm", meta.subject(TABLES["customer"]), fact(NS + "customer_c_name", F.upper("c_name"), "literal", XSD + "string"))
    return algebra.upsert_keyed(meta.rows_to_triples(c, TABLES["customer"]), new).select("s", "p", "o")


@query("changed_graphs", f"""{V}, n AS (SELECT * FROM ({sql_instances(['nation'])}))
SELECT '{GRAPH}crm' AS graph, (SELECT count(*) FROM (SELECT DISTINCT * FROM a)) AS old_n, (SELECT count(*) FROM (SELECT DISTINCT * FROM b)) AS new_n""")
def changed_graphs(spark, sf):
    a, b = customer_versions(spark, sf)
    s = meta.instances(spark, sf, ["supplier"])
    return algebra.changed_graphs(a.unionByName(s), b.unionByName(s))


def staged(spark, sf):
    d = algebra.graph_diff(*customer_versions(spark, sf))
    return algebra.stage_proposal(d, F.concat(F.lit("p"), F.pmod(F.regexp_extract("s", r"(\d+)$", 1).cast("long"), F.lit(5)).cast("string")))


STAGED = f"{V}, d AS ({DIFF}), g AS (SELECT 'p' || CAST(regexp_extract(s, '(\\d+)$', 1) AS BIGINT) % 5 AS proposal, CASE change WHEN 'added' THEN 'add' ELSE 'del' END AS kind, {T3} FROM d)"


@query("stage_proposal", f"{STAGED} SELECT * FROM g")
def stage_proposal(spark, sf):
    return staged(spark, sf).drop("lang")


@query("proposal_diff", f"{STAGED} SELECT DISTINCT * FROM g")
def proposal_diff(spark, sf):
    s = staged(spark, sf)
    return algebra.proposal_diff(s.unionByName(s)).drop("lang")


def proposals(spark, sf):
    s = staged(spark, sf).select("proposal").distinct()
    return s.withColumn("status", F.when(F.col("proposal") == "p4", "merged").when(F.col("proposal") == "p3", "draft").otherwise("submitted"))


def decisions(spark, sf):
    return staged(spark, sf).select("proposal").distinct().select("proposal", F.when(F.col("proposal").isin("p0", "p3"), "approve").otherwise("reject").alias("decision"))


DECIDED = f"{STAGED}, x AS (SELECT proposal, CASE proposal WHEN 'p4' THEN 'merged' WHEN 'p0' THEN 'merged' WHEN 'p3' THEN 'merged' ELSE 'rejected' END AS status, count(*) FILTER (kind = 'add') AS n_add, count(*) FILTER (kind = 'del') AS n_del FROM g GROUP BY proposal)"


@query("decide_proposal", f"{DECIDED} SELECT * FROM x")
def decide_proposal(spark, sf):
    return algebra.decide_proposals(proposals(spark, sf), staged(spark, sf), decisions(spark, sf))


@query("apply_proposals", f"{DECIDED} SELECT count(*) AS n FROM (SELECT {T3} FROM (SELECT DISTINCT {T3} FROM a EXCEPT SELECT {T3} FROM g WHERE kind = 'del' AND proposal IN (SELECT proposal FROM x WHERE status = 'merged')) UNION SELECT {T3} FROM g WHERE kind = 'add' AND proposal IN (SELECT proposal FROM x WHERE status = 'merged'))")
def apply_proposals(spark, sf):
    st = staged(spark, sf)
    merged = algebra.decide_proposals(proposals(spark, sf), st, decisions(spark, sf)).where("status = 'merged'")
    return algebra.apply_proposals(customer_versions(spark, sf)[0], st, merged).agg(F.count("*").alias("n"))


@query("list_proposals", f"{DECIDED} SELECT proposal, status FROM x ORDER BY proposal DESC")
def list_proposals(spark, sf):
    return algebra.decide_proposals(proposals(spark, sf), staged(spark, sf), decisions(spark, sf)).select("proposal", "status").orderBy(F.desc("proposal"))


@query("source_dataset_union", f"{QB} SELECT s, p, o FROM q UNION ALL SELECT '{NS}geo/n' || n_nationkey, '{PREF}', n_name FROM nation")
def source_dataset_union(spark, sf):
    return big(spark, sf).select("s", "p", "o").unionByName(geo_concepts(spark, sf).where((F.col("p") == PREF) & F.col("s").startswith(NS + "geo/n")).select("s", "p", "o"))


# Rules on the part classes: parts are items; items of a kind are stocked.
def rules():
    def stocked(f, focus):
        return focus.join(f.where((F.col("p") == TYPE) & (F.col("o") == NS + "Item")).select(F.col("s").alias("inst")).distinct(), "inst").select(F.col("inst").alias("s"), F.lit(NS + "stocked").alias("p"), F.lit("yes").alias("o"), F.lit("literal").alias("o_kind"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))

    return [closure.triple_rule("item", NS + "Part", closure.FOCUS, TYPE, NS + "Item", order=1), closure.Rule("stock", NS + "Item", stocked, order=2), closure.triple_rule("broken", NS + "Part", closure.FOCUS, "", "x")]


@query("rules_materialize", f"SELECT '{DATA}part/' || p_partkey AS s, '{TYPE}' AS p, '{NS}Item' AS o, 'item' AS rule FROM part UNION ALL SELECT '{DATA}part/' || p_partkey, '{NS}stocked', 'yes', 'stock' FROM part")
def rules_materialize(spark, sf):
    return closure.rules_materialize(part_classes(spark, sf), rules())[0].select("s", "p", "o", "rule")


@query("rule_triple", f"SELECT '{DATA}part/' || p_partkey AS s, '{NS}checked' AS p, 'true' AS o FROM part")
def rule_triple(spark, sf):
    r = closure.triple_rule("check", NS + "Part", closure.FOCUS, NS + "checked", "true", "literal", XSD + "boolean")
    return closure.rules_materialize(part_classes(spark, sf), [r])[0].select("s", "p", "o")


@query("rule_pattern", f"SELECT '{DATA}part/' || p_partkey AS s, '{NS}big' AS p, 'yes' AS o FROM part WHERE p_size > 25")
def rule_pattern(spark, sf):
    q = part_classes(spark, sf).unionByName(meta.instances(spark, sf, ["part"]))
    large = closure.pattern_rule("big", NS + "Part", [(closure.FOCUS, NS + "part_p_size", "?size")], (closure.FOCUS, NS + "big", "yes"), "literal", where="try_cast(size as int) > 25")
    return closure.rules_materialize(q, [large])[0].select("s", "p", "o")


@query("rules_chained", f"""WITH RECURSIVE u AS (SELECT c_custkey AS a, c_custkey // 2 AS b FROM customer WHERE c_custkey > 1 UNION ALL SELECT a, b // 2 FROM u WHERE b > 1),
f AS (SELECT a, b FROM u), boss AS (SELECT b FROM u GROUP BY b HAVING count(*) >= 1)
SELECT '{DATA}customer/' || a AS s, '{NS}under' AS p, '{DATA}customer/' || b AS o FROM f WHERE a // 2 <> b
UNION ALL SELECT '{DATA}customer/' || b, '{TYPE}', '{NS}Boss' FROM boss UNION ALL SELECT '{DATA}customer/' || b, '{NS}paid', 'more' FROM boss""")
def rules_chained(spark, sf):
    """Customers under one another, as a binary tree of their keys: who is under whom at any distance, who has someone below, and what follows for them; each pass on what the last one found."""
    c = load(spark, sf, "customer").where("c_custkey > 1")
    iri = lambda k: F.concat(F.lit(DATA + "customer/"), k.cast("string"))
    q = facts(c, GRAPH + "crm", iri(F.col("c_custkey")), fact(TYPE, F.lit(NS + "customer"), "iri"), fact(NS + "under", iri(F.expr("c_custkey div 2")), "iri"))
    q = q.unionByName(facts(load(spark, sf, "customer"), GRAPH + "crm", iri(F.col("c_custkey")), fact(TYPE, F.lit(NS + "customer"), "iri")))
    this = closure.FOCUS
    of = [
        closure.pattern_rule("far", NS + "customer", [(this, NS + "under", "?x"), ("?x", NS + "under", "?y")], (this, NS + "under", "?y"), order=1),
        closure.pattern_rule("boss", NS + "customer", [("?x", NS + "under", this)], (this, TYPE, NS + "Boss"), order=2),
        closure.triple_rule("paid", NS + "Boss", this, NS + "paid", "more", "literal", order=3),
    ]
    return closure.rules_materialize(q, of, 12)[0].select("s", "p", "o")


@query("rules_explain", f"SELECT '{DATA}part/' || p_partkey AS s, '{TYPE}' AS p, '{NS}Item' AS o, 'item,item2' AS rules FROM part WHERE p_size > 25")
def rules_explain(spark, sf):
    two = [*rules(), closure.triple_rule("item2", NS + "Part", closure.FOCUS, TYPE, NS + "Item")]
    asked = load(spark, sf, "part").where("p_size > 25").select(meta.subject(TABLES["part"]).alias("s"), F.lit(TYPE).alias("p"), F.lit(NS + "Item").alias("o"))
    return closure.rules_explain(part_classes(spark, sf), two, asked).withColumn("rules", F.array_join("rules", ","))


CONSTRAINTS = [("customer_c_acctbal", XSD + "decimal", 0.0, 9000.0, None, None), ("customer_c_name", XSD + "string", None, None, "^Customer#0*[1-9][0-9]*$", 18), ("customer_c_mktsegment", XSD + "string", None, None, None, None)]


def customer_shapes(spark):
    rows = [(NS + "customerShape", NS + "customer", NS + p, None, d, None, None, 1, 1, lo, hi, rx, ml, ["BUILDING", "MACHINERY"] if p.endswith("segment") else None, k) for k, (p, d, lo, hi, rx, ml) in enumerate(CONSTRAINTS)]
    rows.append((NS + "customerShape", NS + "customer", NS + "customer_c_nationkey", None, None, NS + "nation", SH + "IRI", 1, 1, None, None, None, None, None, 9))
    rows.append((NS + "customerShape", NS + "customer", NS + "customer_phone", None, None, None, None, 1, None, None, None, None, None, None, 10))
    return spark.createDataFrame(rows, validate.SHAPE_SCHEMA)


@query("validate_values", f"""SELECT c_custkey AS "row", CASE WHEN c_acctbal < 0 THEN 'minInclusive' WHEN c_acctbal > 9000 THEN 'maxInclusive' END AS problem FROM customer
UNION ALL SELECT c_custkey, CASE WHEN NOT regexp_matches(c_mktsegment, '^(BUILDING|MACHINERY)$') THEN 'in' END FROM customer""")
def validate_values(spark, sf):
    c = load(spark, sf, "customer")
    cells = c.select(F.col("c_custkey").alias("row"), F.explode(F.array(F.struct(F.lit(NS + "customer_c_acctbal").alias("path"), F.col("c_acctbal").cast("string").alias("value")), F.struct(F.lit(NS + "customer_c_mktsegment").alias("path"), F.col("c_mktsegment").alias("value")))).alias("x")).select("row", "x.*")
    return validate.validate_values(cells, customer_shapes(spark)).select("row", "problem")
