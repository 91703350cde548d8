"""Guarded selects over mapped classes, labels, and the reads of the catalog."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import DATA, DEPRECATED, IN_SCHEME, LABEL, NS, PREF, RANGE, TYPE, XSD, of_predicate
from ..plans.meta import Table, load, subject

OPS = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, ">": lambda c, v: c > v, "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, "LIKE": lambda c, v: c.like(v), "ILIKE": lambda c, v: c.ilike(v),
}


def literal_for(df: DataFrame, column: str, value) -> Column:
    """The value in the column's own type; an error where it cannot be one."""
    kind = df.schema[column].dataType.simpleString()
    try:
        if kind in ("int", "bigint"):
            return F.lit(int(value))
        if kind == "double":
            return F.lit(float(value))
    except (TypeError, ValueError):
        raise ValueError(f"{value!r} is no value of {column} ({kind})") from None
    return F.lit(value).cast(kind)


def class_select(df: DataFrame, t: Table, columns: list[str] | None = None, filters: list[tuple[str, str, object]] = (), order_by: tuple[str, bool] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows of a mapped class with their subject; names and operators are checked before anything runs."""
    known = [c for c, _ in t.columns]
    wanted = known if columns is None else [c for c in columns if c in known]
    if not wanted:
        raise ValueError("no known columns")
    for c, op, _ in filters:
        if c not in known:
            raise ValueError(f"unknown column {c}")
        if op not in OPS:
            raise ValueError(f"unsupported operator {op}")
    if order_by and order_by[0] not in known:
        raise ValueError(f"unknown sort column {order_by[0]}")
    for c, op, v in filters:
        df = df.where(OPS[op](F.col(c), str(v) if "LIKE" in op else literal_for(df, c, v)))
    out = df.withColumn("__iri", subject(t))
    if order_by:
        c, up = order_by
        out = out.orderBy(F.col(c).asc() if up else F.col(c).desc(), "__iri")
    out = out.offset(offset) if offset else out
    out = out.limit(limit) if limit is not None else out
    return out.select("__iri", *wanted)


def match_subject(iris: DataFrame, tables: list[Table], column: str = "iri") -> DataFrame:
    """(iri, table, keys array) of IRIs that fit a template with keys; the first table wins."""
    options = []
    for n, t in enumerate(t for t in tables if t.keys):
        base = DATA + t.name + "/"
        parts = F.split(F.expr(f"substring({column}, {len(base) + 1})"), "_")
        keys = F.transform(parts, S.decode_key) if len(t.keys) > 1 else F.array(S.decode_key(F.expr(f"substring({column}, {len(base) + 1})")))
        fits = F.col(column).startswith(base) & (F.length(column) > len(base)) & (F.size(keys) == len(t.keys))
        options.append(F.when(fits, F.struct(F.lit(n).alias("n"), F.lit(t.name).alias("table"), keys.alias("keys"))))
    return iris.withColumn("m", F.coalesce(*options)).where("m is not null").select(F.col(column), "m.table", "m.keys")


def virtual_instances(df: DataFrame, t: Table, text: str | None = None) -> DataFrame:
    """(iri, label) of a class; text filters by label where there is one."""
    out = df
    if text and t.label:
        out = out.where(F.contains(F.lower(t.label), F.lit(text.lower())))
    return out.select(subject(t).alias("iri"), (F.col(t.label) if t.label else F.element_at(F.array(*[F.col(k).cast("string") for k in t.keys]), 1)).alias("label"))


def virtual_search(spark: SparkSession, sf_dir: str, tables: list[Table], text: str, per_class: int = 3, limit: int = 30) -> DataFrame:
    """Label search in every class: the first few of each, then a page."""
    parts = [virtual_instances(load(spark, sf_dir, t.name), t, text).withColumn("class_iri", F.lit(NS + t.name)) for t in tables if t.label]
    every = reduce(DataFrame.unionByName, parts)
    rn = F.row_number().over(Window.partitionBy("class_iri").orderBy("label", "iri"))
    return every.withColumn("rn", rn).where(F.col("rn") <= per_class).orderBy("class_iri", "rn").limit(limit).select("class_iri", "iri", "label")


def label_props(spark: SparkSession, tables: list[Table]) -> DataFrame:
    return spark.createDataFrame([(NS + t.name, NS + f"{t.name}_{t.label}") for t in tables if t.label], "class_iri string, property string")


def resolve_label(quads: DataFrame, label_of_class: DataFrame) -> DataFrame:
    """(iri, label) of every subject: its label fact, else the value of its class's label property, least value if several."""
    own = of_predicate(quads, LABEL, "iri", "own").groupBy("iri").agg(F.min("own").alias("own"))
    kinds = of_predicate(quads, TYPE, "iri", "class_iri").join(label_of_class.hint("shuffle_merge"), "class_iri")
    role = quads.select(F.col("s").alias("iri"), F.col("p").alias("property"), "o").join(kinds.select("iri", "property").hint("shuffle_merge"), ["iri", "property"]).groupBy("iri").agg(F.min("o").alias("role"))
    return quads.select(F.col("s").alias("iri")).distinct().join(own.hint("shuffle_merge"), "iri", "left").join(role.hint("shuffle_merge"), "iri", "left").select("iri", F.coalesce("own", "role").alias("label"))


def scope_graph(quads: DataFrame, graph: str | None = None) -> DataFrame:
    """One graph's facts, or every distinct fact."""
    return quads.where(F.col("graph") == graph) if graph else quads.drop("graph").distinct()


def search_contains(quads: DataFrame, labels: DataFrame, text: str, limit: int | None = 50) -> DataFrame:
    """Resources, as subject or IRI object, whose label or IRI holds the text, whatever the case."""
    found = quads.select(F.col("s").alias("iri")).union(quads.where("o_kind = 'iri'").select("o")).distinct()
    out = found.join(labels.hint("shuffle_merge"), "iri", "left").where(F.contains(F.lower(F.coalesce("label", "iri")), F.lit(text.lower())) | F.contains(F.lower("iri"), F.lit(text.lower())))
    out = out.orderBy("iri")
    return out.limit(limit) if limit else out


def active_codes(quads: DataFrame, scheme: str) -> DataFrame:
    """Concepts of a scheme that aren't deprecated, by label (else local name)."""
    member = of_predicate(quads, IN_SCHEME, "iri", "scheme").where(F.col("scheme") == scheme).select("iri").distinct()
    gone = of_predicate(quads, DEPRECATED, "iri", "flag").where("flag = 'true'").select("iri")
    label = of_predicate(quads, PREF, "iri", "label").groupBy("iri").agg(F.min("label").alias("label"))
    out = member.join(gone.hint("shuffle_merge"), "iri", "left_anti").join(label.hint("shuffle_merge"), "iri", "left")
    return out.select("iri", F.coalesce("label", S.local_name(F.col("iri"))).alias("label")).orderBy("label", "iri")


def object_properties(quads: DataFrame) -> DataFrame:
    """(property, label, range) of properties that lead to resources."""
    r = of_predicate(quads, RANGE, "property", "range").where(~F.col("range").startswith(XSD))
    return r.join(of_predicate(quads, LABEL, "property", "label").hint("shuffle_merge"), "property", "left").groupBy("property", "range").agg(F.min("label").alias("label"))


def row_provenance(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """(iri, table, source_id, subject_template) of virtual rows; joined on source and table."""
    one = catalog.groupBy("source_id", "table").agg(F.min("subject_template").alias("subject_template"))
    return rows.join(F.broadcast(one), ["source_id", "table"]).select("iri", "table", "source_id", "subject_template")


def introspect(df: DataFrame, t: Table) -> DataFrame:
    """One row per column: type, key, reference, and the table's row count; one pass."""
    meta = [(t.source, t.name, c, ty, i, c in t.keys, *t.fks.get(c, (None, None))) for i, (c, ty) in enumerate(t.columns)]
    m = df.sparkSession.createDataFrame(meta, "source_id string, table string, column string, sql_type string, ordinal int, pk boolean, fk_table string, fk_column string")
    counts = df.agg(F.count("*").alias("row_count"), *[F.count(c).alias(c) for c, _ in t.columns])
    long = counts.select("row_count", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_values")) for c, _ in t.columns])).alias("x")).select("row_count", "x.*")
    return m.join(F.broadcast(long), "column")


def page(df: DataFrame, keys: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A preview page in key order."""
    return df.orderBy(*keys).offset(offset).limit(limit)
