"""Spreadsheet imports: headers, row checks, triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import ALT, BROADER, DEFINITION, IN_SCHEME, NS, PREF, SKOS, TOP_OF, TYPE, fact, facts
from .closure import cut

#: What headers of concept sheets may be called.
ALIASES = {"label": "label", "name": "label", "term": "label", "preflabel": "label", "broader": "broader", "parent": "broader", "synonyms": "alt", "altlabel": "alt", "aliases": "alt", "definition": "definition", "description": "definition"}


def csv_rows(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with quotes, doubled quotes, line breaks in cells and a BOM; blank lines dropped."""
    r = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8")
    df = (r.schema(schema) if schema else r).csv(path)
    return df.where(F.concat_ws("", *[F.trim(F.col(f"`{c}`").cast("string")) for c in df.columns]) != "")


def map_headers(headers: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """headers: (header): (header, field), field null where the header is ignored."""
    rows = [(k, v) for k, v in (aliases or ALIASES).items()]
    a = headers.sparkSession.createDataFrame(rows, "key string, field string")
    return headers.withColumn("key", S.norm_header(F.col("header"))).join(F.broadcast(a), "key", "left").select("header", "field")


def apply_template(mapped: DataFrame, template: DataFrame, fields: list[str]) -> DataFrame:
    """template: (header, choice) overrides; '' ignores a header, an unknown choice keeps the automatic field."""
    choice = F.when(F.col("choice") == "", None).when(F.col("choice").isin(fields), F.col("choice")).otherwise(F.col("field"))
    return mapped.join(template, "header", "left").select("header", F.when(F.col("choice").isNull(), F.col("field")).otherwise(choice).alias("field"))


def validate_class_rows(rows: DataFrame, existing: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """rows: (row, label): (row, problem). Of rows with one label the first valid one stands, later ones are duplicates."""
    key = F.lower(F.trim("label"))
    r = rows.withColumn("key", key).join(existing.select(F.lower(F.trim("label")).alias("key")).distinct().withColumn("there", F.lit(True)), "key", "left")
    if errors is not None:
        r = r.join(errors, "row", "left")
    else:
        r = r.withColumn("error", F.lit(None).cast("string"))
    own = F.when(F.coalesce("key", F.lit("")) == "", "missing label").when(F.col("there"), "already exists").otherwise(F.col("error"))
    r = r.withColumn("own", own)
    first = F.min(F.when(F.col("own").isNull(), F.col("row"))).over(Window.partitionBy("key"))
    duplicate = (F.coalesce("key", F.lit("")) != "") & (F.col("row") > F.col("first"))
    return r.withColumn("first", first).select("row", "label", F.when(duplicate, "duplicate").otherwise(F.col("own")).alias("problem"))


def validate_concept_rows(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """rows: (row, label, broader): (row, label, broader, problem).

    A broader term must be in the scheme or a valid earlier row, so validity spreads in rounds: each round settles the
    rows whose broader is settled, and the first row of a label among them; rounds follow the depth of chains.
    """
    norm = lambda c: F.lower(F.trim(c))
    there = existing.select(norm("label").alias("key")).distinct()
    r = rows.withColumn("key", norm("label")).withColumn("up", F.nullif(norm("broader"), F.lit(""))).join(there.withColumn("there", F.lit(True)), "key", "left")
    r = r.withColumn("own", F.when(F.coalesce("key", F.lit("")) == "", "missing label").when(F.col("there"), "already exists")).drop("there")
    open_rows = r.where("own is null")
    known = there.select("key", F.lit(-1).cast("long").alias("at"))
    valid = cut(open_rows.select("row", "key").limit(0))
    n = 0
    while True:
        reach = known.union(valid.select("key", F.col("row").cast("long"))).groupBy("key").agg(F.min("at").alias("at"))
        fit = open_rows.join(reach.select(F.col("key").alias("up"), "at"), "up", "left").where("up is null or at < row")
        valid = cut(fit.groupBy("key").agg(F.min("row").alias("row")).select("row", "key"))
        now = valid.agg(F.count("*"), F.sum("row")).first()
        if now == n:
            break
        n = now
    v = valid.select("key", F.col("row").alias("ok"))
    reach = known.union(valid.select("key", F.col("row").cast("long"))).groupBy("key").agg(F.min("at").alias("at"))
    out = r.join(v, "key", "left").join(reach.select(F.col("key").alias("up"), "at"), "up", "left")
    problem = F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("row") == F.col("ok"), None).when(F.col("row") > F.col("ok"), "duplicate").otherwise("unknown broader")
    return out.select("row", "label", "broader", problem.alias("problem"))


def build_import_triples(rows: DataFrame, scheme: str, graph: str) -> DataFrame:
    """Valid rows (label, broader, alt, definition) as concepts; | splits alternative labels; top concept without a broader."""
    iri = lambda c: F.concat(F.lit(NS + "concept/"), S.slug(c))
    up = F.when(F.coalesce(F.trim("broader"), F.lit("")) != "", iri(F.col("broader")))
    base = facts(rows, graph, iri(F.col("label")), fact(TYPE, F.lit(SKOS + "Concept"), "iri"), fact(PREF, F.trim("label")), fact(IN_SCHEME, F.lit(scheme), "iri"), fact(BROADER, up, "iri"), fact(TOP_OF, F.when(up.isNull(), F.lit(scheme)), "iri"), fact(DEFINITION, F.nullif(F.trim("definition"), F.lit(""))))
    alt = rows.select("label", F.explode(F.split("alt", r"\|")).alias("x")).where("trim(x) <> ''")
    return base.unionByName(facts(alt, graph, iri(F.col("label")), fact(ALT, F.trim("x")))).distinct()
