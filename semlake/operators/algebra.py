"""Set algebra over facts: insert, delete, rename, diff, proposals. All null-safe on the term columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..model import BROADER, DEPRECATED, IN_SCHEME, LABEL, NS, OWL, PREF, QUAD, RDF, SH, SKOS, TOP_OF, TRIPLE, TYPE, XSD, dealt, fact, facts, of_predicate


def same(a: str, b: str, cols=QUAD) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return cond


def insert_data(quads: DataFrame, new: DataFrame) -> DataFrame:
    return dealt(quads.select(*QUAD).unionByName(new.select(*QUAD)), *QUAD).distinct()


def delete_data(quads: DataFrame, gone: DataFrame) -> DataFrame:
    """Exact facts out; identical facts on either side match null to null, and what stays has as many copies as before. One aggregation for both sides."""
    both = quads.select(*QUAD, F.lit(0).alias("gone")).unionByName(gone.select(*QUAD, F.lit(1).alias("gone")))
    n = dealt(both, *QUAD).groupBy(*QUAD).agg(F.max("gone").alias("gone"), F.count("*").alias("n")).where("gone = 0")
    return n.select(*QUAD, F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select(*QUAD)


def replace_value(quads: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: graph, s, p, the old object's columns, and new_o: the object is exchanged in place by one join."""
    c = changes.select(*QUAD, "new_o").distinct()
    out = quads.alias("a").join(c.alias("b").hint("shuffle_merge"), same("a", "b"), "left")
    return out.select("a.graph", "a.s", "a.p", F.coalesce("b.new_o", "a.o").alias("o"), "a.o_kind", "a.datatype", "a.lang").distinct()


def create_entities(spec: DataFrame, base: str = NS, graph: str = NS + "graph/model") -> DataFrame:
    """Facts for rows (kind, name, label, parent, scheme): classes, properties, shapes, instances, schemes, concepts. Bare names get `base`."""
    full = lambda c: F.when(c.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), c).otherwise(F.concat(F.lit(base), S.slug(c)))
    kind = F.col("kind")
    of = F.when(kind == "class", OWL + "Class").when(kind == "property", RDF + "Property").when(kind == "shape", SH + "NodeShape").when(kind == "scheme", SKOS + "ConceptScheme").when(kind == "concept", SKOS + "Concept").otherwise(full(F.col("parent")))
    up = F.when(kind == "class", RDF.replace("1999/02/22-rdf-syntax-ns#", "2000/01/rdf-schema#subClassOf")).when(kind == "concept", BROADER).when(kind == "shape", SH + "targetClass").when(kind == "property", "http://www.w3.org/2000/01/rdf-schema#domain")
    label = F.when(kind.isin("concept", "scheme"), PREF).otherwise(LABEL)
    p = lambda c, o, k="iri": F.struct(c.alias("p"), o.cast("string").alias("o"), F.lit(k).alias("o_kind"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))
    parent = F.when(F.col("parent").isNotNull() & up.isNotNull(), full(F.col("parent")))
    return facts(spec, graph, full(F.col("name")), p(F.lit(TYPE), of), p(label, F.col("label"), "literal"), p(F.coalesce(up, F.lit("")), parent), p(F.lit(IN_SCHEME), F.when(kind == "concept", full(F.col("scheme")))), p(F.lit(TOP_OF), F.when((kind == "concept") & F.col("parent").isNull(), full(F.col("scheme")))))


def rename_concepts(quads: DataFrame, names: DataFrame) -> DataFrame:
    """names: (s, label); the preferred label of each is replaced."""
    kept = quads.join(names.select("s").withColumn("p", F.lit(PREF)).hint("shuffle_merge"), ["s", "p"], "left_anti").select(*QUAD)
    where = quads.where(F.col("p") == PREF).groupBy("s").agg(F.min("graph").alias("graph"))
    new = names.join(where.hint("shuffle_merge"), "s").select("graph", "s", F.lit(PREF).alias("p"), F.col("label").alias("o"), F.lit("literal").alias("o_kind"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))
    return kept.unionByName(new)


def reparent_concepts(quads: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: (s, parent); a null parent makes the concept a top concept of its schemes."""
    kept = quads.where(F.col("p").isin(BROADER, TOP_OF)).join(changes.select("s").hint("shuffle_merge"), "s", "left_anti").select(*QUAD).unionByName(quads.where(~F.col("p").isin(BROADER, TOP_OF)).select(*QUAD))
    scheme = quads.where(F.col("p") == IN_SCHEME).select("graph", "s", F.col("o").alias("scheme")).distinct()
    new = changes.join(scheme.hint("shuffle_merge"), "s").select("graph", "s", F.when(F.col("parent").isNull(), TOP_OF).otherwise(BROADER).alias("p"), F.coalesce("parent", "scheme").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang")).distinct()
    return kept.unionByName(new)


def delete_resource(quads: DataFrame, iris: DataFrame, incoming: bool = True) -> DataFrame:
    """All statements of each IRI (column iri), and those that point to it."""
    out = quads.join(iris.select(F.col("iri").alias("s")).hint("shuffle_merge"), "s", "left_anti").select(*QUAD)
    if incoming:
        lit, ref = out.where("o_kind <> 'iri'"), out.where("o_kind = 'iri'")
        out = lit.unionByName(ref.join(iris.select(F.col("iri").alias("o")).hint("shuffle_merge"), "o", "left_anti").select(*QUAD))
    return out


#: Names up to which they are broadcast; beyond, they are joined by shuffles.
BROADCAST_NAMES = 100_000


def rename_iri(quads: DataFrame, names: DataFrame) -> DataFrame:
    """names: (old, new); rewritten as subject, predicate and object of every graph.

    Few names are broadcast. Many are joined by subject and object; predicates, of which a few hold most facts, are never
    shuffled by: those in use are looked up among the names first.
    """
    n = names.select(F.col("old").alias("__old"), F.col("new").alias("__new"))
    few = lambda d: F.broadcast(d) if d.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES else d.hint("shuffle_merge")
    held = few(n)
    used = few(n.join(quads.select(F.col("p").alias("__old")).distinct().hint("shuffle_merge"), "__old"))
    out = quads
    for c, of, cond in (("s", held, None), ("p", used, None), ("o", held, "iri")):
        on = F.col(c) == F.col("__old")
        out = out.join(of, on & (F.col("o_kind") == cond) if cond else on, "left").withColumn(c, F.coalesce("__new", c)).drop("__old", "__new")
    return out.select(*QUAD).distinct()


def set_deprecated(quads: DataFrame, iris: DataFrame, flag: bool, graph: str) -> DataFrame:
    kept = quads.join(iris.select(F.col("iri").alias("s")).withColumn("p", F.lit(DEPRECATED)).hint("shuffle_merge"), ["s", "p"], "left_anti").select(*QUAD)
    return kept.unionByName(facts(iris, graph, F.col("iri"), fact(DEPRECATED, F.lit("true"), "literal", XSD + "boolean"))) if flag else kept


def upsert_keyed(quads: DataFrame, new: DataFrame) -> DataFrame:
    """All facts of the new rows' subjects are replaced, graph by graph."""
    return quads.join(new.select("graph", "s").distinct().hint("shuffle_merge"), ["graph", "s"], "left_anti").select(*QUAD).unionByName(new.select(*QUAD))


def edit_mapping(quads: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: (s, p, new_o): one property of a mapping node set anew."""
    kept = quads.join(changes.select("s", "p").hint("shuffle_merge"), ["s", "p"], "left_anti").select(*QUAD)
    old = quads.join(changes.hint("shuffle_merge"), ["s", "p"]).select("graph", "s", "p", F.col("new_o").alias("o"), "o_kind", "datatype", "lang")
    return kept.unionByName(old.where("o is not null").distinct())


def edit_constraint(quads: DataFrame, changes: DataFrame, graph: str) -> DataFrame:
    """changes: (shape, path, constraint, value); found by shape and path, set, or removed where the value is null."""
    ps = of_predicate(quads, SH + "property", "shape", "ps").join(of_predicate(quads, SH + "path", "ps", "path").hint("shuffle_merge"), "ps").join(changes.hint("shuffle_merge"), ["shape", "path"])
    target = ps.select(F.col("ps").alias("s"), F.col("constraint").alias("p"), "value").distinct()
    kept = quads.join(target.select("s", "p").hint("shuffle_merge"), ["s", "p"], "left_anti").select(*QUAD)
    new = target.where("value is not null").select(F.lit(graph).alias("graph"), "s", "p", F.col("value").alias("o"), F.lit("literal").alias("o_kind"), F.lit(None).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))
    return kept.unionByName(new)


def graph_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, s, p, o, ...) of two versions, whatever their order; one aggregation for both sides."""
    both = old.select(*TRIPLE, F.lit(1).alias("side")).unionByName(new.select(*TRIPLE, F.lit(2).alias("side")))
    side = dealt(both, *TRIPLE).groupBy(*TRIPLE).agg(F.min("side").alias("a"), F.max("side").alias("b")).where("a = b")
    return side.select(F.when(F.col("a") == 2, "added").otherwise("removed").alias("change"), *TRIPLE)


def diff_mode(diff: DataFrame) -> DataFrame:
    """One row: `replace` if a blank node is among the changes, else `patch`."""
    return diff.agg(F.when(F.coalesce(F.bool_or((F.col("o_kind") == "bnode") | F.col("s").startswith("_:")), F.lit(False)), "replace").otherwise("patch").alias("mode"))


def apply_diff(quads: DataFrame, diff: DataFrame) -> DataFrame:
    """Removed facts out, then added ones in (a fact in both stays)."""
    d = diff.select("change", *TRIPLE)
    marked = quads.select(*TRIPLE).withColumn("change", F.lit("kept")).unionByName(d)
    m = dealt(marked, *TRIPLE).groupBy(*TRIPLE).agg(F.bool_or(F.col("change") == "added").alias("added"), F.bool_or(F.col("change") == "removed").alias("removed"))
    return m.where("added or not removed").select(*TRIPLE)


def invert_diff(diff: DataFrame) -> DataFrame:
    return diff.withColumn("change", F.when(F.col("change") == "added", "removed").otherwise("added"))


def stage_proposal(diff: DataFrame, proposal: Column) -> DataFrame:
    """Staged facts (proposal, kind, fact); they are kept apart from the graph's."""
    return diff.select(proposal.alias("proposal"), F.when(F.col("change") == "added", "add").otherwise("del").alias("kind"), *TRIPLE)


def proposal_diff(staged: DataFrame) -> DataFrame:
    return staged.distinct()


def decide_proposals(proposals: DataFrame, staged: DataFrame, decisions: DataFrame) -> DataFrame:
    """(proposal, status, n_add, n_del) after decisions (proposal, decision); only drafts and submitted ones can be decided."""
    n = staged.groupBy("proposal").agg(F.sum((F.col("kind") == "add").cast("long")).alias("n_add"), F.sum((F.col("kind") == "del").cast("long")).alias("n_del"))
    out = proposals.join(decisions.hint("shuffle_merge"), "proposal", "left").join(n.hint("shuffle_merge"), "proposal", "left")
    can = F.col("status").isin("draft", "submitted")
    status = F.when(can & (F.col("decision") == "approve"), "merged").when(can & (F.col("decision") == "reject"), "rejected").otherwise(F.col("status"))
    return out.select("proposal", status.alias("status"), F.coalesce("n_add", F.lit(0)).alias("n_add"), F.coalesce("n_del", F.lit(0)).alias("n_del"))


def apply_proposals(quads: DataFrame, staged: DataFrame, merged: DataFrame) -> DataFrame:
    """The graph's facts after the staged changes of merged proposals."""
    d = staged.join(merged.select("proposal").hint("shuffle_merge"), "proposal", "left_semi").select(F.when(F.col("kind") == "add", "added").otherwise("removed").alias("change"), *TRIPLE)
    return apply_diff(quads, d)


def canonical_lines(quads: DataFrame) -> DataFrame:
    """(graph, line): each fact as a line of N-Triples."""
    s = F.when(F.col("s").startswith("_:"), F.col("s")).otherwise(F.concat(F.lit("<"), F.col("s"), F.lit(">")))
    return quads.select("graph", F.concat_ws(" ", s, F.concat(F.lit("<"), F.col("p"), F.lit(">")), S.serialize_term(F.col("o"), F.col("o_kind"), F.col("datatype"), F.col("lang")), F.lit(".")).alias("line"))


def changed_graphs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Graphs whose canonical lines differ: compared by count and an order-free sum of hashes, never by content on one node."""
    mark = lambda q: canonical_lines(q).distinct().groupBy("graph").agg(F.count("*").alias("n"), F.sum(F.xxhash64("line").cast("decimal(38,0)")).alias("h"))
    a, b = mark(old).alias("a"), mark(new).alias("b")
    out = a.join(b.hint("shuffle_merge"), F.col("a.graph") == F.col("b.graph"), "full_outer")
    return out.where(~(F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.h").eqNullSafe(F.col("b.h")))).select(F.coalesce("a.graph", "b.graph").alias("graph"), F.coalesce("a.n", F.lit(0)).alias("old_n"), F.coalesce("b.n", F.lit(0)).alias("new_n"))
