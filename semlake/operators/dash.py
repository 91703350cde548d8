"""Shape-driven selects, saved queries and dashboard widgets."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.meta import Table, subject
from . import closure


def unique_names(df: DataFrame, base: str, order: str, out: str, by: list[str] = ()) -> DataFrame:
    """Names made unique by suffixes 2, 3, ... in order."""
    rn = F.row_number().over(Window.partitionBy(*by, base).orderBy(order))
    return df.withColumn(out, F.when(rn == 1, F.col(base)).otherwise(F.concat(F.col(base), rn.cast("string"))))


def pascal(x):
    words = F.filter(F.split(x, "[^A-Za-z0-9]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def camel(x):
    p = pascal(x)
    return F.concat(F.lower(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))


def shape_plan(shapes: DataFrame) -> DataFrame:
    """(target_class, type_name, list_name, path, field, scalar, is_list)."""
    t = shapes.select("target_class").distinct().withColumn("base", pascal(S.local_name(F.col("target_class"))))
    t = unique_names(t, "base", "target_class", "type_name").withColumn("list_name", F.concat(F.lower(F.substring("type_name", 1, 1)), F.substring(F.col("type_name"), F.lit(2), F.length("type_name")), F.lit("s")))
    f = shapes.withColumn("fb", camel(F.coalesce("name", S.local_name(F.col("path")))))
    f = unique_names(f, "fb", "path", "field", ["target_class"])
    return f.join(F.broadcast(t.drop("base")), "target_class").select("target_class", "type_name", "list_name", "path", "field", S.scalar_for(F.col("datatype")).alias("scalar"), (F.col("max_count").isNull() | (F.col("max_count") > 1)).alias("is_list"))


def shape_select(df: DataFrame, t: Table, fields: dict[str, tuple[str, str]], limit: int | None = 50, offset: int = 0) -> DataFrame:
    """fields: field name -> (column, scalar): rows with _id and cast fields."""
    out = df.select(subject(t).alias("_id"), *[S.cast_scalar(F.col(c).cast("string"), s).alias(f) for f, (c, s) in fields.items()]).orderBy("_id")
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit else out


def shape_nested(parents: DataFrame, children: DataFrame, key: str, field: str, most: int | None = 200) -> DataFrame:
    """Parents with an array of their first `most` children (None: all), joined on the reference."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy("child"))
    kids = (children if most is None else children.withColumn("rn", rn).where(F.col("rn") <= most)).groupBy(key).agg(F.array_sort(F.collect_list("child")).alias(field))
    return parents.join(kids, key, "left")


@dataclass
class Field:
    """A field of a type: its path, its scalar or the class of the resources it leads to, one value or a list."""

    name: str
    path: str
    scalar: str = "String"
    is_list: bool = False
    target: str | None = None


#: Levels of a selection.
DEEPEST = 8


def whole_selection(plan: dict[str, list[Field]], cls: str, depth: int) -> dict:
    """All fields of a class to a depth; below it resources are their IRIs alone, so that shapes that lead back to themselves end."""
    return {f.name: (whole_selection(plan, f.target, depth - 1) if depth > 1 else {}) if f.target else None for f in plan[cls]}


def shape_tree(quads: DataFrame, plan: dict[str, list[Field]], root: str, selection: dict, most: int | None = 200) -> DataFrame:
    """Members of a class (and its subclasses) as nested rows: _id, and what is selected, {field: None, or the selection below it}.

    From the lowest level up: each level's plain values are one aggregation by subject, its resources a join of links with
    the level below and one aggregation. A list holds its first `most` values in order (None: all), a single field its
    first; a list without values is empty. Selections deeper than DEEPEST are a ValueError, as are unknown fields.
    """
    if root not in plan:
        raise ValueError(f"no shape for {root}")

    def level(cls: str, chosen: dict, depth: int) -> DataFrame:
        """(s, its selected fields): a row a subject that has any of them."""
        known = {f.name: f for f in plan.get(cls, [])}
        if depth > DEEPEST or set(chosen) - set(known):
            raise ValueError(f"deeper than {DEEPEST} levels" if depth > DEEPEST else f"unknown fields of {cls}: {', '.join(sorted(set(chosen) - set(known)))}")
        parts = []
        plain = [known[n] for n, below in chosen.items() if not known[n].target]
        if plain:
            here = quads.where(F.col("p").isin([f.path for f in plain])).select("s", "p", "o").distinct()
            if most is not None:
                here = here.withColumn("rn", F.row_number().over(Window.partitionBy("s", "p").orderBy("o"))).where(F.col("rn") <= most)
            value = lambda f: F.when(F.col("p") == f.path, S.cast_scalar(F.col("o"), f.scalar))
            parts.append(here.groupBy("s").agg(*[(F.array_sort(F.collect_list(value(f))) if f.is_list else F.min(value(f))).alias(f.name) for f in plain]))
        for f in (known[n] for n in chosen if known[n].target):
            links = quads.where((F.col("p") == f.path) & (F.col("o_kind") == "iri")).select("s", F.col("o").alias("_id")).distinct()
            keep = most if f.is_list else 1
            if keep is not None:
                links = links.withColumn("rn", F.row_number().over(Window.partitionBy("s").orderBy("_id"))).where(F.col("rn") <= keep).drop("rn")
            below = chosen[f.name] or {}
            if below:
                links = links.join(level(f.target, below, depth + 1).withColumnRenamed("s", "_id").hint("shuffle_merge"), "_id", "left")
            item = F.struct("_id", *[defaulted(n, g) for n, g in ((n, next(x for x in plan[f.target] if x.name == n)) for n in below)])
            parts.append(links.groupBy("s").agg((F.array_sort(F.collect_list(item)) if f.is_list else F.min(item)).alias(f.name)))
        if not parts:
            return quads.select("s").distinct()
        return reduce(lambda x, y: x.join(y.hint("shuffle_merge"), "s", "full"), parts)

    def defaulted(name: str, f: Field):
        return F.coalesce(F.col(name), F.array()).alias(name) if f.is_list else F.col(name)

    members = closure.instances_closure(quads).where(F.col("class_iri") == root).select(F.col("inst").alias("s")).distinct()
    out = members.join(level(root, selection, 1).hint("shuffle_merge"), "s", "left")
    return out.select(F.col("s").alias("_id"), *[defaulted(n, next(f for f in plan[root] if f.name == n)) for n in selection])


def class_views(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """Every mapped class as a temporary view; (table, column, type) of all of them."""
    rows = []
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
        rows += [(name, f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return spark.createDataFrame(rows, "table string, column string, type string")


def saved_query_run(spark: SparkSession, text: str, params: dict) -> DataFrame:
    """A named query with named parameters; values are bound, never pasted into the text."""
    return spark.sql(text, args=params)


def widget_series(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y) with a name and a finite number."""
    out = df.select(F.col(x).cast("string").alias("x"), F.col(y).try_cast("double").alias("y"))
    return out.where((F.col("x") != "") & F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("y") != float("inf")))


def widget_share(series: DataFrame) -> DataFrame:
    total = series.agg(F.sum("y").alias("total")).where("total > 0")
    return series.crossJoin(F.broadcast(total)).select("x", (F.col("y") / F.col("total")).alias("share"))  # by one row


def widget_kpi(df: DataFrame, order: list[str], column: str | None = None) -> DataFrame:
    return df.orderBy(*order).limit(1).select(F.col(column or df.columns[0]).alias("value"))


def dashboard_list(dashboards: DataFrame, widgets: DataFrame) -> DataFrame:
    return dashboards.join(widgets.groupBy("dashboard").agg(F.count("*").alias("n")), "dashboard", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def dashboard_get(widgets: DataFrame, dashboard) -> DataFrame:
    return widgets.where(F.col("dashboard") == dashboard).orderBy("position", "widget")
