"""Namespaces and table schemas shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NS, DATA, GRAPH = "urn:sem:", "urn:sem:data/", "urn:sem:graph/"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
OWL = "http://www.w3.org/2002/07/owl#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
SH = "http://www.w3.org/ns/shacl#"
RR = "http://www.w3.org/ns/r2rml#"
PROV = "http://www.w3.org/ns/prov#"

TYPE, LABEL, SUBCLASS, DOMAIN, RANGE = RDF + "type", RDFS + "label", RDFS + "subClassOf", RDFS + "domain", RDFS + "range"
FIRST, REST, NIL = RDF + "first", RDF + "rest", RDF + "nil"
PREF, ALT, BROADER, IN_SCHEME, TOP_OF, DEFINITION = SKOS + "prefLabel", SKOS + "altLabel", SKOS + "broader", SKOS + "inScheme", SKOS + "topConceptOf", SKOS + "definition"
DEPRECATED = OWL + "deprecated"

TERM = ("o", "o_kind", "datatype", "lang")
TRIPLE = ("s", "p", *TERM)
QUAD = ("graph", *TRIPLE)
QUAD_SCHEMA = "graph string, s string, p string, o string, o_kind string, datatype string, lang string"
JOURNAL_SCHEMA = "part int, off long, at timestamp, seq long, step int, actor string, operation string, graph string, op string, oversized boolean, quads array<struct<s:string,p:string,o:string,o_kind:string,datatype:string,lang:string>>"


#: Rows of a table, and facts made of them, that one task takes.
TASK_ROWS, TASK_FACTS = 50_000, 400_000


def tasks(df: DataFrame, rows: int) -> int:
    """Tasks of `rows` rows that a table asks for; rows of a file are counted from its footer."""
    return max(1, -(-df.count() // rows))


def dealt(df: DataFrame, *by: str, rows: int | None = None, n: int | None = None) -> DataFrame:
    """df by hash of its columns in tasks of about `rows` rows (TASK_FACTS), or in `n` where its rows are known, so that what a task holds doesn't grow with the input.

    A small file is one task whatever its rows unfold to, and small shuffle blocks are joined by their compressed bytes,
    which for facts are few: an aggregation of either holds millions of them at once. Grouping by these columns, or by
    more, takes no other exchange. A table of one task stays as it is.
    """
    if df.isStreaming:
        return df
    n = n or tasks(df, rows or TASK_FACTS)
    return df.repartition(n, *by) if n > 1 else df


def null() -> Column:
    return F.lit(None).cast("string")


def term(o: Column, kind: str = "literal", datatype: Column | str | None = None, lang: str | None = None) -> list[Column]:
    """The four columns of an object."""
    dt = datatype if isinstance(datatype, Column) else F.lit(datatype).cast("string")
    return [o.cast("string").alias("o"), F.lit(kind).alias("o_kind"), dt.alias("datatype"), F.lit(lang).cast("string").alias("lang")]


def fact(p: str | Column, o: Column, kind: str = "literal", datatype: Column | str | None = None) -> Column:
    """A struct (p, o, o_kind, datatype, lang) for explode."""
    return F.struct((F.lit(p) if isinstance(p, str) else p).alias("p"), *term(o, kind, datatype))


def facts(df: DataFrame, graph: str | Column, s: Column, *of: Column) -> DataFrame:
    """Quads of a row's facts; facts without an object are left out. No shuffle."""
    g = F.lit(graph) if isinstance(graph, str) else graph
    return df.select(g.alias("graph"), s.alias("s"), F.explode(F.array(*of)).alias("f")).where("f.o is not null").select("graph", "s", "f.*")


def quads_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, QUAD_SCHEMA)


def of_predicate(quads: DataFrame, p: str, s: str = "s", o: str = "o") -> DataFrame:
    """(s, o) of one predicate."""
    return quads.where(F.col("p") == p).select(F.col("s").alias(s), F.col("o").alias(o))


def pivoted(quads: DataFrame, of: dict[str, str], by: tuple[str, ...] = ("s",)) -> DataFrame:
    """A row per subject with, for each name, the least object of its predicate: one aggregation, combined before the exchange."""
    return quads.where(F.col("p").isin(list(of.values()))).groupBy(*by).agg(*[F.min(F.when(F.col("p") == p, F.col("o"))).alias(n) for n, p in of.items()])
