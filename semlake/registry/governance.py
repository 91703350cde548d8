"""Queries on imports, governance, dashboards and the change journal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DATA, GRAPH, NS, XSD, fact, facts
from ..operators import dash, governance, imports, search, segments
from ..plans import meta
from ..plans.meta import TABLES, load
from ..streaming import journal, watches
from .base import ORACLES, query, scratch
from .text import ASK, INDEX, ROUND, ask, bm25_sql, docs


# Imports: the parts' names as a sheet, with duplicates as they come and broader terms from the types.
@query("csv_rows", "SELECT c_custkey AS k, c_name || ', \"' || c_mktsegment || '\"' AS v FROM customer")
def csv_rows(spark, sf):
    """Customers written as CSV with quotes and commas, and read again."""
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("v"))
    path = scratch(spark, "csv")
    c.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return imports.csv_rows(spark, path, "k long, v string")


@query("map_headers", "SELECT DISTINCT event_type AS header, CASE WHEN event_type = 'view' THEN 'label' END AS field FROM events")
def map_headers(spark, sf):
    h = load(spark, sf, "events").select(F.col("event_type").alias("header")).distinct()
    return imports.map_headers(h, {"view": "label"})


@query("apply_template", "SELECT DISTINCT event_type AS header, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN 'alt' END AS field FROM events")
def apply_template(spark, sf):
    h = imports.map_headers(load(spark, sf, "events").select(F.col("event_type").alias("header")).distinct(), {"view": "label"})
    t = spark.createDataFrame([("view", ""), ("click", "alt"), ("error", "nonsense")], "header string, choice string")
    return imports.apply_template(h, t, ["label", "alt"])


@query("validate_class_rows", """WITH x AS (SELECT c_custkey AS "row", c_mktsegment AS label, c_acctbal, lower(trim(c_mktsegment)) AS k FROM customer),
o AS (SELECT *, CASE WHEN k = 'machinery' THEN 'already exists' WHEN c_acctbal < 0 THEN 'negative' END AS own FROM x),
f AS (SELECT k, min("row") AS first FROM o WHERE own IS NULL GROUP BY k)
SELECT "row", label, CASE WHEN "row" > first THEN 'duplicate' ELSE own END AS problem FROM o LEFT JOIN f USING (k)""")
def validate_class_rows(spark, sf):
    c = load(spark, sf, "customer")
    errors = c.where("c_acctbal < 0").select(F.col("c_custkey").alias("row"), F.lit("negative").alias("error"))
    return imports.validate_class_rows(c.select(F.col("c_custkey").alias("row"), F.col("c_mktsegment").alias("label")), spark.createDataFrame([("Machinery",)], "label string"), errors)


@query("validate_concept_rows", """WITH x AS (SELECT n_nationkey AS "row", n_name AS label, r_name AS broader FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT "row", label, broader, CASE WHEN broader = 'ASIA' THEN 'unknown broader' END AS problem FROM x""")
def validate_concept_rows(spark, sf):
    """Nations as rows under their regions; every region but ASIA is in the scheme."""
    n = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("row"), F.col("n_name").alias("label"), F.col("r_name").alias("broader"))
    return imports.validate_concept_rows(n, load(spark, sf, "region").where("r_name <> 'ASIA'").select(F.col("r_name").alias("label")))


@query("build_import_triples", f"""SELECT '{NS}concept/' || regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g') AS s, count(*) AS n FROM (
  SELECT n_name, unnest([1, 2, 3, 4, 5, 6, 7]) FROM nation) GROUP BY n_name""")
def build_import_triples(spark, sf):
    """Each nation gives type, label, scheme, broader, definition and two alternative labels."""
    n = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.select(F.col("n_name").alias("label"), F.col("r_name").alias("broader"), F.concat(F.lower("n_name"), F.lit(" | "), F.initcap("n_name"), F.lit("2| ")).alias("alt"), F.col("n_name").alias("definition"))
    return imports.build_import_triples(rows, NS + "geo", GRAPH + "geo").groupBy("s").agg(F.count("*").alias("n"))


# Governance: customers are users, ranked by segment; they govern the graph of their nation.
ROLE = {"BUILDING": "admin", "MACHINERY": "steward", "HOUSEHOLD": "steward", "FURNITURE": "editor"}
ROLE_SQL = "CASE c_mktsegment WHEN 'BUILDING' THEN 'admin' WHEN 'MACHINERY' THEN 'steward' WHEN 'HOUSEHOLD' THEN 'steward' WHEN 'FURNITURE' THEN 'editor' ELSE 'viewer' END"


def users(spark, sf):
    c = load(spark, sf, "customer").where(F.col("c_mktsegment").isin(list(ROLE)))
    role = F.coalesce(*[F.when(F.col("c_mktsegment") == k, v) for k, v in ROLE.items()])
    return c.select(F.col("c_custkey").alias("user_id"), role.alias("role"))


def requests(spark, sf):
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_custkey").alias("user_id"))
    g = load(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.concat(F.lit("g"), F.col("c_nationkey").cast("string")).alias("graph"))
    return governance.resolve_users(o, users(spark, sf), g)


TARGET = "'g' || CAST(o_orderkey % 25 AS VARCHAR)"


@query("resolve_users", f"SELECT o_orderkey AS request, {ROLE_SQL} AS role, 'g' || c_nationkey AS governs FROM orders JOIN customer ON o_custkey = c_custkey")
def resolve_users(spark, sf):
    return requests(spark, sf).select("request", "role", F.array_join("governs", "|").alias("governs"))


def target():
    return F.concat(F.lit("g"), (F.col("request") % 25).cast("string"))


@query("can_write", f"SELECT o_orderkey AS request, CASE {ROLE_SQL} WHEN 'admin' THEN true WHEN 'steward' THEN {TARGET} = 'g' || c_nationkey ELSE false END AS ok, CASE {ROLE_SQL} WHEN 'admin' THEN true ELSE false END AS none FROM orders JOIN customer ON o_custkey = c_custkey")
def can_write(spark, sf):
    r = requests(spark, sf)
    return r.select("request", governance.can_write(F.col("role"), F.col("governs"), F.array(target())).alias("ok"), governance.can_write(F.col("role"), F.col("governs"), F.array().cast("array<string>")).alias("none"))


@query("can_propose", f"SELECT o_orderkey AS request, {ROLE_SQL} <> 'viewer' AS propose, {ROLE_SQL} = 'admin' OR ({ROLE_SQL} = 'steward' AND {TARGET} = 'g' || c_nationkey) AS review FROM orders JOIN customer ON o_custkey = c_custkey")
def can_propose(spark, sf):
    r = requests(spark, sf)
    return r.select("request", governance.can_propose(F.col("role")).alias("propose"), governance.can_review(F.col("role"), F.col("governs"), target()).alias("review"))


def workflow(spark):
    return spark.createDataFrame([("O", "P", "editor"), ("P", "F", "steward"), ("P", "O", "steward")], "source string, target string, least_role string")


@query("available_transitions", f"""WITH w AS (SELECT * FROM (VALUES ('O', 'P', 1), ('P', 'F', 2), ('P', 'O', 2)) w(source, target, least)),
x AS (SELECT o_orderkey AS asset, o_orderstatus AS state, CASE {ROLE_SQL} WHEN 'admin' THEN 3 WHEN 'steward' THEN 2 WHEN 'editor' THEN 1 ELSE 0 END AS r FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT asset, target FROM x JOIN w ON x.state = w.source WHERE r >= least""")
def available_transitions(spark, sf):
    a = requests(spark, sf).join(load(spark, sf, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_orderstatus").alias("state")), "request").select(F.col("request").alias("asset"), "state", "role")
    return governance.available_transitions(a, workflow(spark))


@query("validate_transitions", f"""WITH x AS (SELECT o_orderkey AS request, o_orderstatus AS s, CASE {ROLE_SQL} WHEN 'admin' THEN 3 WHEN 'steward' THEN 2 WHEN 'editor' THEN 1 ELSE 0 END AS r FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT request, CASE WHEN s <> 'O' THEN 400 WHEN r < 1 THEN 403 ELSE 200 END AS code FROM x""")
def validate_transitions(spark, sf):
    a = requests(spark, sf).join(load(spark, sf, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_orderstatus").alias("state")), "request")
    return governance.validate_transitions(a.select("request", "state", F.lit("P").alias("target"), "role"), workflow(spark))


@query("current_state", "SELECT user_id AS asset, arg_max(event_type, ts) AS state FROM events GROUP BY user_id")
def current_state(spark, sf):
    return governance.current_state(load(spark, sf, "events").select(F.col("user_id").alias("asset"), F.col("event_type").alias("state"), F.col("ts").alias("at")))


def changes(spark, sf):
    """Turns of conversations as changes of a graph by role."""
    return load(spark, sf, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("change"), (F.col("conv_id") * 1000 + F.col("turn")).alias("at"), F.col("role").alias("actor"), F.concat(F.lit("g"), (F.col("conv_id") % 3).cast("string")).alias("graph"), F.col("text").alias("detail"))


@query("record_changes", "SELECT conv_id || '-' || turn AS change, substring(text, 1, 800) AS detail FROM conversations")
def record_changes(spark, sf, most=800):
    return governance.record_changes(changes(spark, sf), most).select("change", "detail")


@query("record_changes_all", ORACLES["record_changes"].replace("substring(text, 1, 800)", "text"))
def record_changes_all(spark, sf):
    """The detail in full."""
    return record_changes(spark, sf, None)


@query("changelog_recent", "SELECT conv_id || '-' || turn AS change, role AS actor, 'g' || (conv_id % 3) AS graphs FROM conversations ORDER BY conv_id * 1000 + turn DESC, change DESC LIMIT 100")
def changelog_recent(spark, sf):
    return governance.changelog_recent(changes(spark, sf), 100).select("change", "actor", "graphs")


@query("entity_history", "SELECT conv_id || '-' || turn AS change FROM conversations WHERE contains(text, 'the') ORDER BY conv_id * 1000 + turn DESC, change DESC LIMIT 50")
def entity_history(spark, sf):
    return governance.entity_history(changes(spark, sf), "the").select("change")


# Dashboards.
@query("shape_plan", "SELECT 'Customer' AS type_name, 'customers' AS list_name, f AS field, s AS scalar, l AS is_list, n FROM (VALUES ('customerCAcctbal', 'Float', false), ('customerCName', 'String', false), ('customerCMktsegment', 'String', false), ('customerCNationkey', 'String', false), ('customerPhone', 'String', true)) v(f, s, l), (SELECT count(*) AS n FROM customer)")
def shape_plan(spark, sf):
    from .graphs import customer_shapes

    n = load(spark, sf, "customer").agg(F.count("*").alias("n"))
    plan = dash.shape_plan(customer_shapes(spark).withColumn("name", F.substring_index("path", ":", -1)).withColumn("target_class", F.concat(F.lit("x#"), F.substring_index("target_class", ":", -1))))
    return plan.crossJoin(F.broadcast(n)).select("type_name", "list_name", "field", "scalar", "is_list", "n")


@query("shape_select", f"SELECT 'urn:sem:data/customer/' || c_custkey AS _id, c_name AS name, c_acctbal AS balance FROM customer ORDER BY _id LIMIT 500")
def shape_select(spark, sf, limit=500):
    return dash.shape_select(load(spark, sf, "customer"), TABLES["customer"], {"name": ("c_name", "String"), "balance": ("c_acctbal", "Float")}, limit)


@query("shape_select_all", ORACLES["shape_select"].replace(" LIMIT 500", ""))
def shape_select_all(spark, sf):
    """Every row."""
    return shape_select(spark, sf, None)


@query("shape_nested", "WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) SELECT c_custkey AS k, c_name AS name, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FILTER (rn <= 200) AS orders FROM customer LEFT JOIN r ON c_custkey = o_custkey GROUP BY ALL")
def shape_nested(spark, sf, most=200):
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("child"))
    return dash.shape_nested(c, o, "k", "orders", most).withColumn("orders", F.array_join(F.col("orders").cast("array<string>"), ","))


@query("shape_nested_all", ORACLES["shape_nested"].replace(" FILTER (rn <= 200)", ""))
def shape_nested_all(spark, sf):
    """Every child of each parent."""
    return shape_nested(spark, sf, None)


TREE = {
    NS + "customer": [dash.Field("name", NS + "customer_c_name"), dash.Field("nation", NS + "customer_c_nationkey", target=NS + "nation"), dash.Field("orders", NS + "placed", is_list=True, target=NS + "orders"), dash.Field("segments", NS + "customer_c_mktsegment", is_list=True)],
    NS + "nation": [dash.Field("label", NS + "nation_n_name"), dash.Field("region", NS + "nation_n_regionkey", target=NS + "region")],
    NS + "region": [dash.Field("label", NS + "region_r_name"), dash.Field("key", NS + "region_r_regionkey", "Int")],
    NS + "orders": [dash.Field("status", NS + "orders_o_orderstatus"), dash.Field("key", NS + "orders_o_orderkey", "Int"), dash.Field("by", NS + "placedBy", target=NS + "customer")],
}


@query("shape_tree", f"""WITH o AS (SELECT o_custkey, to_json(list({{'_id': 'urn:sem:data/orders/' || o_orderkey, 'status': o_orderstatus, 'key': o_orderkey, 'by': {{'_id': 'urn:sem:data/customer/' || o_custkey, 'name': c_name}}}} ORDER BY 'urn:sem:data/orders/' || o_orderkey)) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey)
SELECT 'urn:sem:data/customer/' || c_custkey AS _id, c_name AS name, CAST(to_json({{'_id': 'urn:sem:data/nation/' || n_nationkey, 'label': n_name, 'region': {{'_id': 'urn:sem:data/region/' || r_regionkey, 'label': r_name, 'key': r_regionkey}}}}) AS VARCHAR) AS nation,
  coalesce(CAST(o.orders AS VARCHAR), '[]') AS orders, c_mktsegment AS segments
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN o ON o_custkey = c_custkey""")
def shape_tree(spark, sf):
    """Customers with their nation and its region, and their orders, each with the name of who placed it: three levels of structs, from facts."""
    o = load(spark, sf, "orders")
    order, who = meta.subject(TABLES["orders"]), F.concat(F.lit(DATA + "customer/"), F.col("o_custkey").cast("string"))
    q = meta.instances(spark, sf, ["region", "nation", "customer", "orders"]).unionByName(facts(o, GRAPH + "sales", who, fact(NS + "placed", order, "iri"))).unionByName(facts(o, GRAPH + "sales", order, fact(NS + "placedBy", who, "iri")))
    chosen = {"name": None, "nation": {"label": None, "region": {"label": None, "key": None}}, "orders": {"status": None, "key": None, "by": {"name": None}}, "segments": None}
    t = dash.shape_tree(q, TREE, NS + "customer", chosen, None)
    return t.select("_id", "name", F.to_json("nation").alias("nation"), F.to_json("orders").alias("orders"), F.array_join("segments", "|").alias("segments"))


@query("saved_query_run", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '2-HIGH' AND o_totalprice > 150000")
def saved_query_run(spark, sf):
    dash.class_views(spark, {"sem_orders": load(spark, sf, "orders")})
    return dash.saved_query_run(spark, "SELECT o_orderkey, o_totalprice FROM sem_orders WHERE o_orderpriority = :p AND o_totalprice > :least", {"p": "2-HIGH", "least": 150000})


def daily(spark, sf):
    return load(spark, sf, "events").groupBy("event_type").agg(F.count("value").alias("n"))


@query("widget_series", "SELECT event_type AS x, CAST(count(value) AS DOUBLE) AS y FROM events GROUP BY event_type")
def widget_series(spark, sf):
    return dash.widget_series(daily(spark, sf), "event_type", "n")


@query("widget_share", "SELECT event_type AS x, count(value) * 1.0 / (SELECT count(value) FROM events) AS share FROM events GROUP BY event_type")
def widget_share(spark, sf):
    return dash.widget_share(dash.widget_series(daily(spark, sf), "event_type", "n"))


@query("widget_kpi", "SELECT max(o_totalprice) AS value FROM orders")
def widget_kpi(spark, sf):
    o = load(spark, sf, "orders").withColumn("k", -F.col("o_totalprice"))
    return dash.widget_kpi(o, ["k", "o_orderkey"], "o_totalprice")


@query("dashboard_list", "SELECT n_nationkey AS dashboard, n_name AS title, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def dashboard_list(spark, sf):
    """Nations as dashboards, their customers as widgets."""
    d = load(spark, sf, "nation").select(F.col("n_nationkey").alias("dashboard"), F.col("n_name").alias("title"))
    return dash.dashboard_list(d, load(spark, sf, "customer").select(F.col("c_nationkey").alias("dashboard"), F.col("c_custkey").alias("widget")))


@query("dashboard_get", "SELECT c_nationkey AS dashboard, c_custkey AS widget, c_acctbal AS position FROM customer WHERE c_nationkey = 3 ORDER BY position, widget")
def dashboard_get(spark, sf):
    return dash.dashboard_get(load(spark, sf, "customer").select(F.col("c_nationkey").alias("dashboard"), F.col("c_custkey").alias("widget"), F.col("c_acctbal").alias("position")), 3)


# The journal: events in order of (ts, event_id); graph = user, fact = (user, k, k mod 5).
def events_journal(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").withColumn("k", F.from_json("props", "k long")["k"] % 5)
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "purchase", "replace").otherwise("insert")
    g = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    quad = F.array(F.struct(g.alias("s"), F.lit("k").alias("p"), F.col("k").cast("string").alias("o"), F.lit("literal").alias("o_kind"), F.lit(XSD + "integer").alias("datatype"), F.lit(None).cast("string").alias("lang")))
    return e.select(F.lit(0).alias("part"), F.col("event_id").alias("off"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.lit(0).alias("step"), g.alias("actor"), F.col("event_type").alias("operation"), g.alias("graph"), op.alias("op"), F.lit(False).alias("oversized"), quad.alias("quads"))


JOURNAL = """j AS (SELECT 'u' || user_id AS g, CAST(json_extract(props, '$.k') AS BIGINT) % 5 AS k, ts, event_id,
  CASE event_type WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'replace' ELSE 'insert' END AS op FROM events)"""


def fold_sql(where: str) -> str:
    return f"""(SELECT g AS graph, CAST(k AS VARCHAR) AS o FROM (
  SELECT j.g AS g, k, arg_max(op, (ts, event_id)) AS op FROM j LEFT JOIN (SELECT g, max((ts, event_id)) AS reset FROM j WHERE op = 'replace' AND {where} GROUP BY g) d ON j.g = d.g
  WHERE (reset IS NULL OR (ts, event_id) >= reset) AND {where} GROUP BY j.g, k) WHERE op <> 'delete')"""


@query("journal_publish", f"WITH {JOURNAL} SELECT event_id AS seq, op, false AS oversized FROM j")
def journal_publish(spark, sf):
    return journal.journal_publish(events_journal(spark, sf)).select("seq", "op", "oversized")


@query("journal_read", f"WITH {JOURNAL} SELECT event_id AS seq, op, k AS o FROM j WHERE event_id >= 450")
def journal_read(spark, sf):
    """The journal in folders by offset, read from an offset on: the folders before it are not opened."""
    path = scratch(spark, "journal")
    journal.journal_append(events_journal(spark, sf), path, 100)
    return journal.journal_read(spark, path, {0: 450}, span=100).select("seq", "op", F.col("quads")[0]["o"].cast("long").alias("o"))


def middle(spark, sf):
    return journal.moment(load(spark, sf, "events"), "ts", 0.5)


@query("restore_pitr", f"WITH {JOURNAL} SELECT * FROM {fold_sql('true')}")
def restore_pitr(spark, sf):
    """Checkpoint at the median time, and the journal after it: the same as the whole journal."""
    j, t = events_journal(spark, sf), middle(spark, sf)
    none = spark.createDataFrame([], "graph string, s string, p string, o string, o_kind string, datatype string, lang string")
    point = journal.restore_pitr(none, j, t)
    return journal.restore_pitr(point, j.where(F.col("at") > F.lit(t))).select("graph", "o")


def snapshot(spark, sf, folder):
    """A checkpoint of the journal's first half on disk; its offsets point at the rest."""
    early = events_journal(spark, sf).where(F.col("at") <= F.lit(middle(spark, sf)))
    none = spark.createDataFrame([], "graph string, s string, p string, o string, o_kind string, datatype string, lang string")
    return journal.checkpoint(journal.restore_pitr(none, early), folder, "2024-01-01T00:00:00", journal.next_offsets(early), "half")


HALF = "(SELECT quantile_disc(ts, 0.5) FROM events)"


@query("checkpoint", f"WITH {JOURNAL}, h AS MATERIALIZED (SELECT {HALF} AS t), early AS (SELECT j.* FROM j, h WHERE ts <= t), f AS {fold_sql('true').replace('FROM j ', 'FROM early j ')}, m AS (SELECT max(event_id) + 1 AS next FROM early) SELECT f.graph AS graph, f.o AS o, 'half' AS label, m.next AS next, (SELECT count(*) FROM f) AS triples FROM f, m")
def checkpoint(spark, sf):
    """The facts of a checkpoint as they lie on disk, with what its manifest says."""
    folder = scratch(spark, "checkpoints")
    made = snapshot(spark, sf, folder)
    m = journal.list_checkpoints(spark, folder)[0]
    return journal.restore(spark, folder, made["id"]).select("graph", "o", F.lit(m["label"]).alias("label"), F.lit(m["offsets"]["0"]).cast("long").alias("next"), F.lit(m["triples"]).cast("long").alias("triples"))


@query("checkpoint_restore", f"WITH {JOURNAL}, x AS (SELECT quantile_disc(ts, 0.75) AS t FROM events), late AS (SELECT j.* FROM j, x WHERE ts <= t) SELECT * FROM {fold_sql('true').replace('FROM j ', 'FROM late j ')}")
def checkpoint_restore(spark, sf):
    """From a checkpoint on disk and the folders of the journal after it, the graph at three quarters of the time: the same as the whole journal gives."""
    folder, path = scratch(spark, "checkpoints"), scratch(spark, "journal")
    journal.journal_append(events_journal(spark, sf), path, 100)
    j, t = events_journal(spark, sf), middle(spark, sf)
    none = spark.createDataFrame([], "graph string, s string, p string, o string, o_kind string, datatype string, lang string")
    made = journal.checkpoint(journal.restore_pitr(none, j.where(F.col("at") <= F.lit(t))), folder, "2024-01-01T00:00:00", journal.open_offsets(j, t), "half", t)
    until = journal.moment(load(spark, sf, "events"), "ts", 0.75)
    return journal.restore(spark, folder, made["id"], path, until, 100).select("graph", "o")


@query("journal_apply_stream", f"WITH {JOURNAL} SELECT * FROM {fold_sql('true')}")
def journal_apply_stream(spark, sf):
    """The journal's files as a stream, folded batch by batch into a store of buckets."""
    base = scratch(spark, "stream")
    src = f"{base}/journal"
    events_journal(spark, sf).repartitionByRange(6, "seq").write.parquet(src)
    stream = spark.readStream.schema(events_journal(spark, sf).schema).option("maxFilesPerTrigger", 1).parquet(src)
    journal.journal_apply_stream(stream, f"{base}/state", f"{base}/checkpoint", buckets=8, most=3).awaitTermination()
    return journal.stream_state(spark, f"{base}/state").select("graph", "o")


REFRESHED = INDEX.replace("c_name AS label, concat_ws(' ', c_name, c_mktsegment) AS f_label, concat_ws(' ', c_name, c_mktsegment) AS f_text FROM customer", "c_name AS label, concat_ws(' ', c_name, seg) AS f_label, concat_ws(' ', c_name, seg) AS f_text FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 'moved' ELSE c_mktsegment END AS seg FROM customer) WHERE c_custkey % 7 > 0")


@query("index_refresh_stream", f"{REFRESHED}{bm25_sql(ASK + chr(32) + 'UNION SELECT ' + repr('m') + ', ' + repr('moved customer'))} SELECT qid, id, {ROUND} FROM s")
def index_refresh_stream(spark, sf):
    """An index on disk that a stream of changes keeps up to date: every third customer moves, every seventh goes; searched as one built anew."""
    base = scratch(spark, "refresh")
    i = segments.SegmentedIndex(spark, f"{base}/index", buckets=4, most=3)
    i.apply(docs(spark, sf), batch=0)
    c = load(spark, sf, "customer")
    c.where("c_custkey % 3 = 0 or c_custkey % 7 = 0").select(meta.subject(TABLES["customer"]).alias("id")).repartition(3).write.parquet(f"{base}/changes")
    stream = spark.readStream.schema("id string").option("maxFilesPerTrigger", 1).parquet(f"{base}/changes")
    now = c.where("c_custkey % 7 > 0").withColumn("seg", F.when(F.col("c_custkey") % 3 == 0, "moved").otherwise(F.col("c_mktsegment")))
    now = search.crawl_rows(now, "data", meta.subject(TABLES["customer"]), F.col("c_name"), [F.col("c_name"), F.col("seg")], "crm")
    journal.index_refresh_stream(stream, i, now, f"{base}/checkpoint", now=True).awaitTermination()
    asked = ask(spark, sf).union(spark.createDataFrame([("m", "moved customer")], "qid string, text string"))
    return search.bm25_match(i.index(), asked).withColumn("score", F.round("score", 6))


@query("change_feed", "SELECT event_id AS seq, 'u' || user_id AS graph FROM events")
def change_feed(spark, sf):
    return journal.change_feed(events_journal(spark, sf)).select("seq", "graph")


@query("search_watches", """WITH h AS (SELECT p_brand AS watch, p_partkey AS id, p_retailprice AS score FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY watch ORDER BY score DESC, id) AS rk FROM h),
n AS (SELECT watch, id, row_number() OVER (PARTITION BY watch ORDER BY rk) AS n FROM r WHERE rk <= 100 AND id % 2 = 0 AND watch <> (SELECT min(p_brand) FROM part))
SELECT watch, id FROM n WHERE n <= 10""")
def search_watches(spark, sf):
    """Brands as watches: odd parts were seen last time; the first brand's watch is new."""
    h = load(spark, sf, "part").select(F.col("p_brand").alias("watch"), F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))
    known = h.select("watch").distinct().join(F.broadcast(h.agg(F.min("watch").alias("watch"))), "watch", "left_anti")
    return journal.search_watches(h, h.where("id % 2 = 1").select("watch", "id"), known)


@query("search_watches_stream", """WITH h AS (SELECT p_brand AS watch, CAST(p_partkey AS VARCHAR) AS id, p_retailprice AS score, p_partkey % 2 = 1 AS odd FROM part),
a AS (SELECT watch, id FROM (SELECT *, row_number() OVER (PARTITION BY watch ORDER BY score DESC, id) AS rk FROM h WHERE odd) WHERE rk <= 100),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY watch ORDER BY score DESC, id) AS rk FROM h) WHERE rk <= 100),
n AS (SELECT watch, id, row_number() OVER (PARTITION BY watch ORDER BY rk) AS n FROM b ANTI JOIN a USING (watch, id))
SELECT watch, 2 AS run, id, n FROM n WHERE n <= 10 AND watch IN (SELECT watch FROM a)""")
def search_watches_stream(spark, sf):
    """Brands as watches: the first run finds the odd parts and only records, the second finds all and reports the new ones. The state is kept between two streams."""
    base = scratch(spark, "watches")
    h = load(spark, sf, "part").select(F.col("p_brand").alias("watch"), F.col("p_partkey").cast("string").alias("id"), F.col("p_retailprice").alias("score"))
    schema = "watch string, run long, id string, score double"
    for run, part in ((1, h.where("cast(id as long) % 2 = 1")), (2, h)):
        part.select("watch", F.lit(run).cast("long").alias("run"), "id", "score").coalesce(1).write.mode("append").parquet(f"{base}/hits")
        watches.search_watches_stream(spark.readStream.schema(schema).parquet(f"{base}/hits"), f"{base}/new", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(watches.NEW).parquet(f"{base}/new")
