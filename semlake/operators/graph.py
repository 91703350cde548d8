"""Reads of a graph of facts: links, descriptions, neighbours, counts, profiles, quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import DATA, DEFINITION, DEPRECATED, DOMAIN, IN_SCHEME, LABEL, NS, PREF, RANGE, RDF, SH, SKOS, SUBCLASS, TYPE, XSD, of_predicate
from ..plans.meta import Table, subject
from .closure import cut


def fk_expand(df: DataFrame, t: Table, column: str) -> DataFrame:
    """(subject, predicate, object) of one reference column; a projection, no join."""
    return df.where(F.col(column).isNotNull()).select(subject(t).alias("subject"), F.lit(f"{NS}{t.name}_{column}").alias("predicate"), S.mint(DATA + t.fks[column][0] + "/", [F.col(column)]).alias("object"))


def link_join(left: DataFrame, a: Table, right: DataFrame, b: Table, prop: str, x: str, y: str, reverse: bool = False) -> DataFrame:
    """Rows of two sources joined on declared keys: (subject, predicate, object, label). Null keys drop out."""
    l = left.select(subject(a).alias("subject"), F.col(x).alias("k"), (F.col(a.label) if a.label else F.lit(None).cast("string")).alias("la"))
    r = right.select(subject(b).alias("object"), F.col(y).alias("k"), (F.col(b.label) if b.label else F.lit(None).cast("string")).alias("lb"))
    out = l.join(r, "k")
    if reverse:
        return out.select(F.col("object").alias("subject"), F.lit("^" + prop).alias("predicate"), F.col("subject").alias("object"), F.col("la").alias("label"))
    return out.select("subject", F.lit(prop).alias("predicate"), "object", F.col("lb").alias("label"))


def describe_batch(iris: DataFrame, facts: DataFrame, links: DataFrame, per_link: int | None = 25) -> DataFrame:
    """(iri, predicate, value, kind) of many IRIs at once: their facts, and at most per_link objects of each link (None: all)."""
    own = facts.select(F.col("s").alias("iri"), F.col("p").alias("predicate"), F.col("o").alias("value"), F.col("o_kind").alias("kind")).join(iris.hint("shuffle_merge"), "iri", "left_semi")
    linked = links.select(F.col("subject").alias("iri"), "predicate", F.col("object").alias("value"), F.lit("link").alias("kind")).join(iris.hint("shuffle_merge"), "iri", "left_semi")
    if per_link is not None:
        rn = F.row_number().over(Window.partitionBy("iri", "predicate").orderBy("value"))
        linked = linked.withColumn("rn", rn).where(F.col("rn") <= per_link).drop("rn")
    missing = iris.join(own.select("iri").distinct().hint("shuffle_merge"), "iri", "left_anti").select("iri", F.lit(None).cast("string").alias("predicate"), F.lit(None).cast("string").alias("value"), F.lit("missing").alias("kind"))
    return own.unionByName(linked).unionByName(missing)


def describe_resource(quads: DataFrame, labels: DataFrame, iris: DataFrame, graph: str | None = None, out_limit: int | None = 1000, in_limit: int | None = 200) -> DataFrame:
    """Statements from and to each IRI with the other end's label; IRIs unknown in `graph` are described from all graphs."""
    scoped = quads.where(F.col("graph") == graph) if graph else quads
    there = scoped.select(F.col("s").alias("iri")).union(scoped.where("o_kind = 'iri'").select("o")).distinct()

    def around(q: DataFrame, who: DataFrame) -> DataFrame:
        out = q.select(F.col("s").alias("iri"), F.lit("out").alias("direction"), "p", F.col("o").alias("other"), "o_kind").join(who.hint("shuffle_merge"), "iri", "left_semi")
        into = q.where("o_kind = 'iri'").select(F.col("o").alias("iri"), F.lit("in").alias("direction"), "p", F.col("s").alias("other"), F.lit("iri").alias("o_kind")).join(who.hint("shuffle_merge"), "iri", "left_semi")
        return out.union(into).distinct()

    found = around(scoped, iris.join(there.hint("shuffle_merge"), "iri", "left_semi"))
    if graph:
        found = found.union(around(quads, iris.join(there.hint("shuffle_merge"), "iri", "left_anti")))
    if out_limit is not None or in_limit is not None:
        rn = F.row_number().over(Window.partitionBy("iri", "direction").orderBy("p", "other", "o_kind"))
        most = F.when(F.col("direction") == "out", F.lit(out_limit)).otherwise(F.lit(in_limit))
        found = found.withColumn("rn", rn).where((F.col("rn") <= most) | most.isNull())
    return found.join(labels.select(F.col("iri").alias("other"), "label").hint("shuffle_merge"), "other", "left").select("iri", "direction", "p", "other", "label")


def edges(quads: DataFrame) -> DataFrame:
    """(src, p, dst) of facts between resources, without types."""
    return quads.where((F.col("o_kind") == "iri") & (F.col("p") != TYPE)).select(F.col("s").alias("src"), "p", F.col("o").alias("dst")).distinct()


def expand_neighbors(quads: DataFrame, nodes: DataFrame, limit: int | None = 25) -> DataFrame:
    """The first distinct neighbours of each node (limit None: all), either way."""
    e = edges(quads)
    both = e.select(F.col("src").alias("iri"), F.col("dst").alias("neighbor")).union(e.select("dst", "src")).where("iri <> neighbor").join(nodes.hint("shuffle_merge"), "iri", "left_semi").distinct()
    if limit is None:
        return both.select("iri", "neighbor")
    return both.withColumn("rn", F.row_number().over(Window.partitionBy("iri").orderBy("neighbor"))).where(F.col("rn") <= limit).select("iri", "neighbor")


def triples_to_edges(quads: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node list (iri, label) and edge list of any facts."""
    e = edges(quads)
    nodes = quads.select(F.col("s").alias("iri")).union(e.select("dst")).distinct()
    return nodes.join(labels.hint("shuffle_merge"), "iri", "left").select("iri", "label"), e


def schema_edges(quads: DataFrame) -> DataFrame:
    """Class to class: domain and range, shape path and class, subclass; no self-loops."""
    d = of_predicate(quads, DOMAIN, "p", "a").join(of_predicate(quads, RANGE, "p", "b").where(~F.col("b").startswith(XSD)).hint("shuffle_merge"), "p").select("a", F.col("p").alias("via"), "b")
    sh = of_predicate(quads, SH + "targetClass", "shape", "a").join(of_predicate(quads, SH + "property", "shape", "ps").hint("shuffle_merge"), "shape").join(of_predicate(quads, SH + "path", "ps", "via").hint("shuffle_merge"), "ps").join(of_predicate(quads, SH + "class", "ps", "b").hint("shuffle_merge"), "ps").select("a", "via", "b")
    sub = of_predicate(quads, SUBCLASS, "a", "b").select("a", F.lit(SUBCLASS).alias("via"), "b")
    return d.unionByName(sh).unionByName(sub).where("a <> b").distinct()


def class_counts(quads: DataFrame, labels: DataFrame, virtual: DataFrame | None = None, limit: int = 500) -> DataFrame:
    """Classes, declared or used, with label, superclass and distinct instances; virtual counts (class_iri, n) override."""
    owl = "http://www.w3.org/2002/07/owl#Class"
    typed = of_predicate(quads, TYPE, "inst", "class_iri")
    used = typed.where(F.col("class_iri") != owl)
    known = typed.where(F.col("class_iri") == owl).select(F.col("inst").alias("class_iri")).union(used.select("class_iri")).distinct().where(~S.system_class(F.col("class_iri")))
    n = used.groupBy("class_iri").agg(F.countDistinct("inst").alias("n"))
    sup = of_predicate(quads, SUBCLASS, "class_iri", "super").groupBy("class_iri").agg(F.min("super").alias("super"))
    out = known.join(n.hint("shuffle_merge"), "class_iri", "left").join(sup.hint("shuffle_merge"), "class_iri", "left").join(labels.withColumnRenamed("iri", "class_iri").hint("shuffle_merge"), "class_iri", "left")
    if virtual is not None:
        out = out.join(F.broadcast(virtual.withColumnRenamed("n", "v")), "class_iri", "left").withColumn("n", F.coalesce("v", "n"))
    return out.select("class_iri", "label", "super", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "class_iri").limit(limit)


def usage_counts(quads: DataFrame) -> DataFrame:
    """Per IRI, in one pass: distinct subjects that point to it, uses as a predicate, shapes and mappings that name it, deprecated flag."""
    role = F.when(F.col("p").startswith(SH), "shape").when(F.col("p").startswith("http://www.w3.org/ns/r2rml#"), "mapping").otherwise("incoming")
    uses = quads.select("s", "p", "o", "o_kind", F.array(F.when(F.col("o_kind") == "iri", F.struct(role.alias("role"), F.col("o").alias("iri"), F.col("s").alias("by"))), F.struct(F.lit("predicate").alias("role"), F.col("p").alias("iri"), F.concat_ws(" ", "s", "o").alias("by")), F.when((F.col("p") == DEPRECATED) & (F.col("o") == "true"), F.struct(F.lit("deprecated").alias("role"), F.col("s").alias("iri"), F.col("s").alias("by")))).alias("u"))
    u = uses.select(F.explode("u").alias("u")).where("u is not null").select("u.*").distinct()
    count = lambda r: F.count(F.when(F.col("role") == r, 1))
    return u.groupBy("iri").agg(count("incoming").alias("incoming"), count("predicate").alias("as_predicate"), count("shape").alias("in_shapes"), count("mapping").alias("in_mappings"), (count("deprecated") > 0).alias("deprecated"))


def profile_class(quads: DataFrame) -> DataFrame:
    """Per class and predicate: subjects, uses, a datatype, an object class, and the class's total."""
    t = of_predicate(quads, TYPE, "s", "class_iri").distinct()
    total = t.groupBy("class_iri").agg(F.count("*").alias("total"))
    f = quads.where(F.col("p") != TYPE).select("s", "p", "o", "o_kind", "datatype").join(t.hint("shuffle_merge"), "s")
    f = f.join(t.select(F.col("s").alias("o"), F.col("class_iri").alias("o_class")).groupBy("o").agg(F.min("o_class").alias("o_class")).hint("shuffle_merge"), "o", "left")
    out = f.groupBy("class_iri", "p").agg(F.countDistinct("s").alias("subjects"), F.count("*").alias("uses"), F.min("datatype").alias("datatype"), F.min(F.when(F.col("o_kind") == "iri", F.col("o_class"))).alias("o_class"))
    return out.join(F.broadcast(total), "class_iri")


def generate_shape(profile: DataFrame) -> DataFrame:
    """Constraints that a profile supports, ordered by use."""
    order = F.row_number().over(Window.partitionBy("class_iri").orderBy(F.desc("subjects"), "p"))
    return profile.select("class_iri", F.col("p").alias("path"), F.when(F.col("subjects") == F.col("total"), 1).alias("min_count"), F.when(F.col("uses") == F.col("subjects"), 1).alias("max_count"), "datatype", F.when(F.col("datatype").isNull(), F.col("o_class")).alias("class_ref"), order.alias("ord"))


CHECKS = {
    "classes_without_label": lambda q: of_predicate(q, TYPE, "x", "o").where(F.col("o") == "http://www.w3.org/2002/07/owl#Class").join(of_predicate(q, LABEL, "x", "l").hint("shuffle_merge"), "x", "left_anti"),
    "classes_without_shape": lambda q: of_predicate(q, TYPE, "x", "o").where(F.col("o") == "http://www.w3.org/2002/07/owl#Class").join(of_predicate(q, SH + "targetClass", "s", "x").hint("shuffle_merge"), "x", "left_anti"),
    "concepts_without_definition": lambda q: of_predicate(q, TYPE, "x", "o").where(F.col("o") == SKOS + "Concept").join(of_predicate(q, DEFINITION, "x", "d").hint("shuffle_merge"), "x", "left_anti"),
    "concepts_without_scheme": lambda q: of_predicate(q, TYPE, "x", "o").where(F.col("o") == SKOS + "Concept").join(of_predicate(q, IN_SCHEME, "x", "d").hint("shuffle_merge"), "x", "left_anti"),
    "properties_without_domain": lambda q: of_predicate(q, TYPE, "x", "o").where(F.col("o") == RDF + "Property").join(of_predicate(q, DOMAIN, "x", "d").hint("shuffle_merge"), "x", "left_anti"),
    "fields_without_concept": lambda q: of_predicate(q, "http://www.w3.org/ns/r2rml#predicate", "m", "x").join(of_predicate(q, NS + "alignedTo", "x", "c").hint("shuffle_merge"), "x", "left_anti"),
}


def quality_checks(quads: DataFrame, checks=None) -> DataFrame:
    """(check_id, n): one distinct count per check, in one job over facts written once. A check that fails, fails the job."""
    out, quads = [], cut(quads)
    for name, check in (checks or CHECKS).items():
        out.append(check(quads).agg(F.countDistinct("x").alias("n")).select(F.lit(name).alias("check_id"), "n"))
    return reduce(DataFrame.unionByName, out)


def quality_snapshot(checks: DataFrame, run_id: Column, at: Column) -> DataFrame:
    """Rows to append to the table of runs."""
    return checks.select(run_id.alias("run_id"), at.alias("at"), "check_id", "n")


def quality_history(runs: DataFrame, checks: list[str], last: int = 30) -> DataFrame:
    """The newest runs, one column per check."""
    return runs.groupBy("run_id", "at").pivot("check_id", checks).agg(F.max("n")).orderBy(F.desc("at"), F.desc("run_id")).limit(last)


def scheme_counts(quads: DataFrame) -> DataFrame:
    scheme = of_predicate(quads, TYPE, "scheme", "o").where(F.col("o") == SKOS + "ConceptScheme").select("scheme").distinct()
    label = of_predicate(quads, PREF, "scheme", "label").groupBy("scheme").agg(F.min("label").alias("label"))
    return scheme.join(label.hint("shuffle_merge"), "scheme", "left").join(of_predicate(quads, IN_SCHEME, "c", "scheme").hint("shuffle_merge"), "scheme", "left").groupBy("scheme", "label").agg(F.countDistinct("c").alias("n"))


def shape_counts(quads: DataFrame) -> DataFrame:
    shape = of_predicate(quads, TYPE, "shape", "o").where(F.col("o") == SH + "NodeShape").select("shape").distinct()
    return shape.join(of_predicate(quads, SH + "targetClass", "shape", "t").hint("shuffle_merge"), "shape", "left").join(of_predicate(quads, SH + "property", "shape", "ps").hint("shuffle_merge"), "shape", "left").groupBy("shape").agg(F.min("t").alias("target_class"), F.countDistinct("ps").alias("n"))


def hist_buckets(df: DataFrame, value: str, by: list[str], bounds=(5, 25, 100, 250, 1000, 5000)) -> DataFrame:
    """Cumulative counts up to each bound, sum and count, per label set; partial aggregates only."""
    return df.groupBy(*by).agg(*[F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"le_{b}") for b in bounds], F.sum(value).alias("total"), F.count(value).alias("n"))
