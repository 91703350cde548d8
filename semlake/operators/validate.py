"""Shapes: reading them, validating facts and raw values against them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import FIRST, REST, SH, SUBCLASS, TYPE, XSD, of_predicate
from .closure import closure as closed
from .closure import list_walk

SHAPE_SCHEMA = "shape string, target_class string, path string, name string, datatype string, class_iri string, node_kind string, min_count int, max_count int, min_incl double, max_incl double, pattern string, max_length int, in_values array<string>, ord int"
COLUMNS = tuple(c.split(" ")[0] for c in SHAPE_SCHEMA.split(", "))


def read_shapes(quads: DataFrame) -> DataFrame:
    """Shape facts as the shapes table, with severity (Violation where none is declared): one pivot over the property shapes' facts; in-lists by list_walk."""
    ps = of_predicate(quads, SH + "property", "shape", "ps").join(of_predicate(quads, SH + "targetClass", "shape", "target_class").hint("shuffle_merge"), "shape", "left").dropDuplicates(["shape", "ps"])
    names = ["path", "name", "datatype", "class", "nodeKind", "minCount", "maxCount", "minInclusive", "maxInclusive", "pattern", "maxLength", "order", "in", "severity"]
    f = quads.where(F.col("p").isin([SH + n for n in names])).select(F.col("s").alias("ps"), F.expr(f"substring(p, {len(SH) + 1})").alias("k"), "o").groupBy("ps").pivot("k", names).agg(F.min("o"))
    if quads.where(F.col("p") == SH + "in").isEmpty():
        lists = quads.sparkSession.createDataFrame([], "head string, in_values array<string>")
    else:
        lists = list_walk(quads.where(F.col("p").isin(FIRST, REST))).groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("in_values"))
    out = ps.join(f.hint("shuffle_merge"), "ps").join(lists.hint("shuffle_merge"), F.col("in") == F.col("head"), "left")
    return out.select("shape", "target_class", "path", "name", "datatype", F.col("class").alias("class_iri"), F.col("nodeKind").alias("node_kind"), F.col("minCount").try_cast("int").alias("min_count"), F.col("maxCount").try_cast("int").alias("max_count"), F.col("minInclusive").try_cast("double").alias("min_incl"), F.col("maxInclusive").try_cast("double").alias("max_incl"), "pattern", F.col("maxLength").try_cast("int").alias("max_length"), "in_values", F.coalesce(F.col("order").try_cast("int"), F.lit(9999)).alias("ord"), F.coalesce(F.regexp_extract("severity", "[^#/]+$", 0), F.lit("Violation")).alias("severity"))


def well_formed(v: Column, datatype: Column) -> Column:
    """Whether a text is a value of the datatype; unknown datatypes accept all."""
    d = F.substring_index(datatype, "#", -1)
    rules = {"integer": r"^[+-]?\d+$", "decimal": r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$", "boolean": "^(true|false|1|0)$", "date": r"^\d{4}-\d{2}-\d{2}$", "dateTime": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}"}
    out = F.lit(True)
    for name, rx in rules.items():
        out = F.when(d == name, v.rlike(rx)).otherwise(out)
    return out


def shacl_validate(quads: DataFrame, shapes: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """(graph, focus, path, constraint, severity, shape) of every violation, graph by graph.

    Each graph is validated by itself: its members, values and subclasses; shapes with a column `graph` hold in theirs
    alone (shapes_by_graph reads such), others in all. closure: (inst, class_iri), and graph if it is known, in place of
    the class memberships that the facts give. Shapes are few and broadcast; values are joined on the path, so the work
    is one pass over the facts of shaped classes, one count per (focus, path), and one anti-join for class constraints.
    """
    if closure is None:
        inst = quads.where((F.col("p") == TYPE) & ~F.col("s").startswith("_:")).select(F.struct("graph", F.col("s").alias("x")).alias("s"), "p", F.struct("graph", F.col("o").alias("x")).alias("o"))
        tree = quads.where(F.col("p") == SUBCLASS).select(F.struct("graph", F.col("s").alias("x")).alias("a"), F.struct("graph", F.col("o").alias("x")).alias("b"))
        direct = inst.select(F.col("s").alias("inst"), F.col("o").alias("sub")).distinct()
        above = direct.join(closed(tree).select(F.col("a").alias("sub"), F.col("b").alias("class_iri")).hint("shuffle_merge"), "sub").select("inst", "class_iri")
        typed = direct.select("inst", F.col("sub").alias("class_iri")).union(above).distinct().select("inst.graph", F.col("inst.x").alias("inst"), F.col("class_iri.x").alias("class_iri"))
    elif "graph" in closure.columns:
        typed = closure.select("graph", "inst", "class_iri")
    else:
        typed = closure.join(quads.select("graph", F.col("s").alias("inst")).distinct().hint("shuffle_merge"), "inst").select("graph", "inst", "class_iri")
    of = shapes.withColumnRenamed("graph", "own_graph") if "graph" in shapes.columns else shapes.withColumn("own_graph", F.lit(None).cast("string"))
    of = of if "severity" in shapes.columns else of.withColumn("severity", F.lit("Violation"))
    of = of.withColumnRenamed("class_iri", "value_class")
    focus = typed.join(F.broadcast(of), (F.col("class_iri") == F.col("target_class")) & (F.col("own_graph").isNull() | (F.col("own_graph") == F.col("graph"))))
    focus = focus.drop("class_iri", "own_graph").withColumnsRenamed({"inst": "focus", "value_class": "class_iri"})
    values = quads.select("graph", F.col("s").alias("focus"), F.col("p").alias("path"), "o", "o_kind", F.col("datatype").alias("dt")).distinct()
    n = values.groupBy("graph", "focus", "path").agg(F.count("*").alias("n"))
    head = ("graph", "focus", "path")
    card = focus.where("min_count > 0 or max_count is not null").select(*head, "shape", "severity", "min_count", "max_count").distinct().join(n.hint("shuffle_merge"), list(head), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    said = lambda d, c: d.select(*head, (F.lit(c) if isinstance(c, str) else c).alias("constraint"), "severity", "shape")
    bad = [said(card.where("n < min_count"), "minCount"), said(card.where("n > max_count"), "maxCount")]
    v = focus.join(values.hint("shuffle_merge"), list(head))
    number = F.col("o").try_cast("double")
    tests = {
        "datatype": (F.col("datatype").isNotNull(), (F.col("o_kind") == "literal") & (F.coalesce("dt", F.lit(XSD + "string")) == F.col("datatype")) & well_formed(F.col("o"), F.col("datatype"))),
        "nodeKind": (F.col("node_kind").isNotNull(), F.when(F.col("node_kind") == SH + "IRI", F.col("o_kind") == "iri").when(F.col("node_kind") == SH + "Literal", F.col("o_kind") == "literal").otherwise(True)),
        "minInclusive": (F.col("min_incl").isNotNull(), F.coalesce(number >= F.col("min_incl"), F.lit(False))),
        "maxInclusive": (F.col("max_incl").isNotNull(), F.coalesce(number <= F.col("max_incl"), F.lit(False))),
        "pattern": (F.col("pattern").isNotNull(), F.expr("o rlike pattern")),
        "maxLength": (F.col("max_length").isNotNull(), F.length("o") <= F.col("max_length")),
        "in": (F.col("in_values").isNotNull(), F.array_contains("in_values", F.col("o"))),
    }
    failed = F.filter(F.array(*[F.when(has & ~ok, k) for k, (has, ok) in tests.items()]), lambda x: x.isNotNull())
    bad.append(said(v, F.explode(failed)))
    kinds = typed.select("graph", F.col("inst").alias("o"), F.col("class_iri").alias("cls"))
    wrong = v.where("class_iri is not null").select(*head, "severity", "shape", "o", F.col("class_iri").alias("cls")).distinct().join(kinds.hint("shuffle_merge"), ["graph", "o", "cls"], "left_anti")
    bad.append(said(wrong, "class"))
    return reduce(DataFrame.unionByName, bad).distinct()


def shapes_by_graph(quads: DataFrame, graphs: list[str]) -> DataFrame:
    """read_shapes of each of some graphs, with the graph."""
    return reduce(DataFrame.unionByName, [read_shapes(quads.where(F.col("graph") == g)).withColumn("graph", F.lit(g)) for g in graphs])


def usable(pattern: str | None) -> bool:
    try:
        re.compile(pattern or "")
        return True
    except re.error:
        return False


def validate_values(cells: DataFrame, shapes: DataFrame) -> DataFrame:
    """cells: (row, path, value): the first failed check of each, null if none. Broken patterns are ignored."""
    rows = [r.asDict() | {"pattern": r.pattern if usable(r.pattern) else None} for r in shapes.collect()]  # declared shapes, not data
    sh = cells.sparkSession.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], SHAPE_SCHEMA).drop("name", "shape", "target_class", "class_iri", "node_kind")
    v, d = F.trim("value"), F.substring_index("datatype", "#", -1)
    number = v.try_cast("double")
    first = F.when(F.coalesce(v, F.lit("")) == "", "empty").when(~well_formed(v, F.col("datatype")), d).when(number < F.col("min_incl"), "minInclusive").when(number > F.col("max_incl"), "maxInclusive")
    first = first.when(F.col("pattern").isNotNull() & ~F.expr("value rlike pattern"), "pattern").when(F.length(v) > F.col("max_length"), "maxLength").when(F.col("in_values").isNotNull() & ~F.array_contains("in_values", v), "in")
    return cells.join(F.broadcast(sh), "path").select("row", "path", "value", first.alias("problem"))


