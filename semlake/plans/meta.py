"""The declared estate: which source owns which table, keys, links, label roles; and the facts made of them.

Keys and links are declarations (Spark schemas hold none), so they are constants of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import scalars as S
from ..model import DATA, DOMAIN, GRAPH, LABEL, NS, RANGE, RDF, RR, SH, TYPE, XSD, dealt, fact, facts, pivoted

SQL_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "TEXT", "timestamp": "TIMESTAMP", "boolean": "BOOLEAN", "date": "DATE", "binary": "BLOB"}


@dataclass
class Table:
    source: str
    name: str
    columns: list[tuple[str, str]]
    keys: list[str]
    fks: dict[str, tuple[str, str]] = field(default_factory=dict)
    label: str | None = None


TABLES = {
    t.name: t
    for t in [
        Table("crm", "region", [("r_regionkey", "INTEGER"), ("r_name", "TEXT")], ["r_regionkey"], label="r_name"),
        Table("crm", "nation", [("n_nationkey", "INTEGER"), ("n_name", "TEXT"), ("n_regionkey", "INTEGER")], ["n_nationkey"], {"n_regionkey": ("region", "r_regionkey")}, "n_name"),
        Table("crm", "customer", [("c_custkey", "BIGINT"), ("c_name", "TEXT"), ("c_nationkey", "INTEGER"), ("c_acctbal", "DOUBLE"), ("c_mktsegment", "TEXT")], ["c_custkey"], {"c_nationkey": ("nation", "n_nationkey")}, "c_name"),
        Table("sales", "orders", [("o_orderkey", "BIGINT"), ("o_custkey", "BIGINT"), ("o_orderstatus", "TEXT"), ("o_totalprice", "DOUBLE"), ("o_orderdate", "TIMESTAMP"), ("o_orderpriority", "TEXT")], ["o_orderkey"], label="o_orderpriority"),
        Table("supply", "part", [("p_partkey", "BIGINT"), ("p_name", "TEXT"), ("p_brand", "TEXT"), ("p_type", "TEXT"), ("p_size", "INTEGER"), ("p_retailprice", "DOUBLE")], ["p_partkey"], label="p_name"),
        Table("supply", "supplier", [("s_suppkey", "BIGINT"), ("s_name", "TEXT"), ("s_nationkey", "INTEGER"), ("s_acctbal", "DOUBLE")], ["s_suppkey"], label="s_name"),
        Table("logs", "events", [("event_id", "BIGINT"), ("ts", "TIMESTAMP"), ("user_id", "BIGINT"), ("event_type", "TEXT"), ("value", "DOUBLE"), ("props", "TEXT")], ["event_id"], label="event_type"),
        Table("text", "documents", [("doc_id", "BIGINT"), ("text", "TEXT"), ("lang", "TEXT"), ("source", "TEXT"), ("n_chars", "BIGINT")], ["doc_id"], label="text"),
        Table("text", "labels", [("doc_id", "BIGINT"), ("quality", "INTEGER"), ("toxic", "INTEGER")], ["doc_id"]),
        Table("text", "conversations", [("conv_id", "BIGINT"), ("turn", "BIGINT"), ("role", "TEXT"), ("text", "TEXT")], ["conv_id", "turn"], label="text"),
    ]
}
#: Key pairs across sources: (property, from table, from column, to table, to column).
LINKS = [
    ("placedBy", "orders", "o_custkey", "customer", "c_custkey"),
    ("byCustomer", "events", "user_id", "customer", "c_custkey"),
    ("labels", "labels", "doc_id", "documents", "doc_id"),
]
#: Business areas of tables, for alignment.
AREAS = {"customer": "Parties", "supplier": "Parties", "nation": "Geography", "region": "Geography", "orders": "Sales", "part": "Products"}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def datatype(sql_type: str) -> str | None:
    """As scalars.xsd_for, for declarations."""
    t = sql_type.upper()
    for words, d in ((("INT",), "integer"), (("REAL", "FLOA", "DOUB", "NUMERIC", "DECIMAL"), "decimal"), (("BOOL",), "boolean"), (("DATETIME", "TIMESTAMP"), "dateTime"), (("DATE",), "date"), (("BLOB",), None)):
        if any(w in t for w in words):
            return d and XSD + d
    return XSD + "string"


def table_meta(spark: SparkSession, tables=None) -> DataFrame:
    rows = [(t.source, t.name, c, ty, i, c in t.keys, c in t.keys, *t.fks.get(c, (None, None))) for t in (tables or TABLES).values() for i, (c, ty) in enumerate(t.columns)]
    return spark.createDataFrame(rows, "source_id string, table string, column string, sql_type string, ordinal int, notnull boolean, pk boolean, fk_table string, fk_column string")


def template(t: Table) -> str:
    return DATA + t.name + "/{" + "}_{".join(t.keys) + "}"


def catalog(spark: SparkSession, tables=None) -> DataFrame:
    """Long form: one row per mapped column."""
    tables = tables or TABLES
    rows = [(NS + t.name, t.source, t.name, template(t), c, NS + t.name + "_" + c, datatype(ty) if c not in t.fks else None, DATA + t.fks[c][0] + "/{" + c + "}" if c in t.fks else None) for t in tables.values() for c, ty in t.columns]
    return spark.createDataFrame(rows, "class_iri string, source_id string, table string, subject_template string, column string, property string, datatype string, ref_template string")


def links(spark: SparkSession) -> DataFrame:
    rows = [(NS + p, NS + a, NS + b, NS + a + "_" + x, NS + b + "_" + y) for p, a, x, b, y in LINKS]
    return spark.createDataFrame(rows, "property string, from_class string, to_class string, source_key_property string, target_key_property string")


def subject(t: Table) -> F.Column:
    return S.mint(DATA + t.name + "/", [F.col(k) for k in t.keys])


def literal(column: str, sql_type: str) -> F.Column:
    """A cell as text of its datatype."""
    c = F.col(column)
    if "TIMESTAMP" in sql_type:
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return c.cast("string")


def rows_to_triples(df: DataFrame, t: Table, graph: str | None = None, stamp: bool = False) -> DataFrame:
    """Every row as facts: its type, keys to other tables as IRIs, other values as literals; nulls and binaries left out."""
    of = [fact(TYPE, F.lit(NS + t.name), "iri")]
    if stamp:
        of.append(fact(NS + "fromSource", F.lit(NS + "source/" + t.source), "iri"))
    for c, ty in t.columns:
        p = NS + t.name + "_" + c
        if c in t.fks:
            of.append(fact(p, F.when(F.col(c).isNotNull(), S.mint(DATA + t.fks[c][0] + "/", [F.col(c)])), "iri"))
        elif datatype(ty):
            of.append(fact(p, literal(c, ty), "literal", datatype(ty)))
    return facts(dealt(df, *t.keys, rows=model.TASK_ROWS), graph or GRAPH + t.source, subject(t), *of)


def instances(spark: SparkSession, sf_dir: str, names: list[str], stamp: bool = False) -> DataFrame:
    out = None
    for n in names:
        part = rows_to_triples(load(spark, sf_dir, n), TABLES[n], stamp=stamp)
        out = part if out is None else out.unionByName(part)
    return out


def schema_to_triples(meta: DataFrame) -> DataFrame:
    """Classes, properties and shapes of a schema, from table_meta rows."""
    m = meta.withColumn("cls", S.class_iri(F.col("table"))).withColumn("prop", S.prop_iri(F.col("table"), F.col("column"))).withColumn("dt", S.xsd_for(F.col("sql_type")))
    graph = GRAPH + "schema"
    one = m.groupBy("table", "cls").agg(F.min("source_id").alias("source_id"))
    shape = lambda c: F.concat(c, F.lit("Shape"))
    classes = facts(one, graph, F.col("cls"), fact(TYPE, F.lit("http://www.w3.org/2002/07/owl#Class"), "iri"), fact(LABEL, S.humanize(F.col("table"))), fact(NS + "source", F.col("source_id")))
    shapes = facts(one, graph, shape(F.col("cls")), fact(TYPE, F.lit(SH + "NodeShape"), "iri"), fact(SH + "targetClass", F.col("cls"), "iri"))
    fk = F.col("fk_table").isNotNull()
    props = facts(m, graph, F.col("prop"), fact(TYPE, F.lit(RDF + "Property"), "iri"), fact(LABEL, S.humanize(F.col("column"))), fact(DOMAIN, F.col("cls"), "iri"), fact(RANGE, F.when(fk, S.class_iri(F.col("fk_table"))).otherwise(F.col("dt")), "iri"))
    ps = F.concat(F.col("prop"), F.lit("Shape"))
    constraints = facts(
        m, graph, ps, fact(SH + "path", F.col("prop"), "iri"), fact(SH + "order", F.col("ordinal"), "literal", XSD + "integer"), fact(SH + "maxCount", F.lit(1), "literal", XSD + "integer"),
        fact(SH + "minCount", F.when(F.col("notnull") | F.col("pk"), 1), "literal", XSD + "integer"), fact(SH + "class", F.when(fk, S.class_iri(F.col("fk_table"))), "iri"),
        fact(SH + "nodeKind", F.when(fk, SH + "IRI"), "iri"), fact(SH + "datatype", F.when(~fk, F.col("dt")), "iri"))
    owned = facts(m, graph, shape(F.col("cls")), fact(SH + "property", ps, "iri"))
    return classes.unionByName(shapes).unionByName(props).unionByName(constraints).unionByName(owned)


def schema_to_mappings(meta: DataFrame) -> DataFrame:
    """Mapping triples: logical table, subject template, and a predicate-object map per column."""
    graph = GRAPH + "mappings"
    tm = F.concat(F.lit(NS + "map/"), F.col("table"))
    keys = F.array_sort(F.collect_list(F.when(F.col("pk"), F.struct("ordinal", "column"))))
    one = meta.groupBy("source_id", "table").agg(F.concat(F.lit("{"), F.array_join(keys["column"], "}_{"), F.lit("}")).alias("keys"))
    maps = facts(one, graph, tm, fact(TYPE, F.lit(RR + "TriplesMap"), "iri"), fact(RR + "tableName", F.col("table")), fact(NS + "source", F.col("source_id")),
                 fact(RR + "template", F.concat(F.lit(DATA), F.col("table"), F.lit("/"), F.col("keys"))), fact(RR + "class", S.class_iri(F.col("table")), "iri"))
    pom = F.concat(tm, F.lit("/"), F.col("column"))
    owned = facts(meta, graph, tm, fact(RR + "predicateObjectMap", pom, "iri"))
    columns = facts(meta, graph, pom, fact(RR + "predicate", S.prop_iri(F.col("table"), F.col("column")), "iri"), fact(RR + "column", F.col("column")),
                    fact(RR + "datatype", F.when(F.col("fk_table").isNull(), S.xsd_for(F.col("sql_type"))), "iri"),
                    fact(RR + "refTemplate", F.when(F.col("fk_table").isNotNull(), F.concat(F.lit(DATA), F.col("fk_table"), F.lit("/{"), F.col("column"), F.lit("}")))))
    return maps.unionByName(owned).unionByName(columns)


def read_catalog(quads: DataFrame, detached: list[str] | None = None) -> DataFrame:
    """Catalog rows from mapping triples; of several mappings of a column the first holds. Two pivots by subject, two joins."""
    maps = pivoted(quads, {"table": RR + "tableName", "source_id": NS + "source", "subject_template": RR + "template", "class_iri": RR + "class"})
    maps = maps.where("table is not null and source_id is not null and subject_template is not null and class_iri is not null").withColumnRenamed("s", "tm")
    if detached:
        maps = maps.where(~F.col("source_id").isin(detached))
    columns = pivoted(quads, {"column": RR + "column", "property": RR + "predicate", "datatype": RR + "datatype", "ref_template": RR + "refTemplate"}).where("column is not null and property is not null")
    owned = quads.where(F.col("p") == RR + "predicateObjectMap").select(F.col("s").alias("tm"), F.col("o").alias("s"))
    first = owned.join(columns.hint("shuffle_merge"), "s").groupBy("tm", "column").agg(F.min_by(F.struct("property", "datatype", "ref_template"), "s").alias("f"))
    out = first.join(maps.hint("shuffle_merge"), "tm")
    return out.select("class_iri", "source_id", "table", "subject_template", "column", "f.property", "f.datatype", "f.ref_template")


# The same facts in SQL, for oracles.
def sql_literal(column: str, sql_type: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S')" if "TIMESTAMP" in sql_type else f"CAST({column} AS VARCHAR)"


def sql_instances(names: list[str]) -> str:
    """A SELECT of instance quads, equal to instances()."""
    out = []
    for n in names:
        t = TABLES[n]
        s = f"'{DATA}{n}/' || " + " || '_' || ".join(t.keys)
        row = lambda p, o, k, d, w: f"SELECT '{GRAPH}{t.source}' AS graph, {s} AS s, '{p}' AS p, {o} AS o, '{k}' AS o_kind, {d} AS datatype, CAST(NULL AS VARCHAR) AS lang FROM {n} WHERE {w} IS NOT NULL"
        out.append(row(TYPE, f"'{NS}{n}'", "iri", "CAST(NULL AS VARCHAR)", f"'{n}'"))
        for c, ty in t.columns:
            p = f"{NS}{n}_{c}"
            if c in t.fks:
                out.append(row(p, f"'{DATA}{t.fks[c][0]}/' || {c}", "iri", "CAST(NULL AS VARCHAR)", c))
            else:
                out.append(row(p, sql_literal(c, ty), "literal", f"'{datatype(ty)}'", c))
    return " UNION ALL ".join(out)
