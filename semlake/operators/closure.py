"""Loops over facts: closures, lists, rules to fixpoint, taxonomies. Each round is checkpointed to the shared folder."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..model import BROADER, DEPRECATED, FIRST, IN_SCHEME, NIL, PREF, REST, SUBCLASS, TRIPLE, TYPE, dealt, of_predicate, tasks


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint reliably; a folder of our own only where the session names none (tests)."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(where or "file://" + tempfile.mkdtemp(prefix="semlake-"))
    return df.checkpoint()


def closure(pairs: DataFrame, reflexive: bool = True) -> DataFrame:
    """Transitive closure of (a, b) by doubling paths: rounds grow with the logarithm of the longest."""
    edges = pairs.select("a", "b").distinct()
    out = cut(edges)
    n = out.count()
    while True:
        more = out.join(out.select(F.col("a").alias("b"), F.col("b").alias("c")).hint("shuffle_merge"), "b").select("a", F.col("c").alias("b"))
        out = cut(out.unionByName(more).distinct())
        now = out.count()
        if now == n:
            break
        n = now
    if reflexive:
        ids = edges.select("a").union(edges.select("b")).distinct()
        out = out.unionByName(ids.select("a", F.col("a").alias("b"))).distinct()
    return out


def subclass_closure(quads: DataFrame) -> DataFrame:
    return closure(of_predicate(quads, SUBCLASS, "a", "b")).select(F.col("a").alias("sub"), F.col("b").alias("super"))


def instances_closure(quads: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(class_iri, inst): every instance of a class or one of its subclasses."""
    pairs = subclass_closure(quads) if pairs is None else pairs
    t = quads.where((F.col("p") == TYPE) & ~F.col("s").startswith("_:")).select(F.col("s").alias("inst"), F.col("o").alias("sub")).distinct()
    return t.select("inst", F.col("sub").alias("class_iri")).union(t.join(pairs.hint("shuffle_merge"), "sub").select("inst", F.col("super").alias("class_iri"))).distinct()


def climb(up: DataFrame, tops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """up: (cell, far), one step each; tops: (cell): where the steps end. (cell, top, d) of all that reach a top, and (cell, far) of those that don't.

    Pointers jump by doubling: a row a cell and path, and rounds that grow with the logarithm of the longest path. What
    has not ended after as many steps as there are cells goes round in a circle, and `far` is then on it.
    """
    at = up.select("cell", "far", F.lit(1).cast("long").alias("d"), F.lit(False).alias("ended"))
    state = cut(at.union(tops.select("cell", F.col("cell").alias("far"), F.lit(0).cast("long"), F.lit(True))))
    n, steps = state.count(), 1
    while steps <= n and not state.where("not ended").isEmpty():
        look = state.select(F.col("cell").alias("far"), F.col("far").alias("next"), F.col("d").alias("more"), F.col("ended").alias("end"))
        on = state.where("not ended").join(look.hint("shuffle_merge"), "far").select("cell", F.col("next").alias("far"), (F.col("d") + F.col("more")).alias("d"), F.col("end").alias("ended"))
        state = cut(state.where("ended").unionByName(on))
        steps *= 2
    return state.where("ended").select("cell", F.col("far").alias("top"), "d"), state.where("not ended").select("cell", "far")


def list_walk(quads: DataFrame) -> DataFrame:
    """(head, pos, value) of every list that starts somewhere; a row a cell throughout."""
    first = of_predicate(quads, FIRST, "cell", "value")
    up = of_predicate(quads, REST, "far", "cell").where(F.col("cell") != NIL).select("cell", "far").distinct()
    heads = first.select("cell").distinct().join(up.select("cell").hint("shuffle_merge"), "cell", "left_anti")
    done, _ = climb(up, heads)
    return done.join(first.hint("shuffle_merge"), "cell").select(F.col("top").alias("head"), F.col("d").cast("int").alias("pos"), "value")


@dataclass
class Rule:
    """A rule: `derive(facts, focus)` gives triples; a triple rule is made by triple_rule."""

    name: str
    target: str | None
    derive: Callable[[DataFrame, DataFrame], DataFrame] | None
    order: int = 0
    active: bool = True
    #: For rules that read nothing but their members: their facts from members alone.
    body_of: Callable[[DataFrame], DataFrame] | None = None

    def given(self, facts: DataFrame, focus: DataFrame, n: int = 1) -> DataFrame:
        """What follows from facts for members that lie in n tasks."""
        return self.derive(facts, focus)


FOCUS = "$this"
#: Classes below a target up to which they are broadcast.
BROADCAST_CLASSES = 10_000


def triple_rule(name: str, target: str, s: str, p: str, o: str, kind: str = "iri", datatype: str | None = None, order: int = 0) -> Rule:
    """For every member of the target class one fact; $this stands for the member."""

    def derive(facts: DataFrame, focus: DataFrame) -> DataFrame:
        pick = lambda x: F.col("inst") if x == FOCUS else F.lit(x)
        return focus.select(pick(s).alias("s"), F.lit(p).alias("p"), pick(o).alias("o"), F.lit("iri" if o == FOCUS else kind).alias("o_kind"), F.lit(datatype).cast("string").alias("datatype"), F.lit(None).cast("string").alias("lang"))

    return Rule(name, target, derive if s and p and o else None, order, body_of=lambda focus: derive(focus, focus))


def classes_below(facts: DataFrame, target: str, tree: DataFrame) -> DataFrame:
    """(o): a class and what is below it in the closed tree; ready for a join: broadcast if it is small."""
    below = cut(tree.where(F.col("super") == target).select(F.col("sub").alias("o")).union(facts.sparkSession.createDataFrame([(target,)], "o string")).distinct())
    return F.broadcast(below) if below.count() <= BROADCAST_CLASSES else below.hint("shuffle_merge")


def members(facts: DataFrame, target: str, tree: DataFrame, below: DataFrame | None = None, n: int = 1) -> DataFrame:
    """(inst): the members of a class and of its subclasses in the closed tree, by hash in n tasks (1: as Spark has it)."""
    typed = facts.where((F.col("p") == TYPE) & ~F.col("s").startswith("_:")).select(F.col("s").alias("inst"), "o")
    return dealt(typed.join(classes_below(facts, target, tree) if below is None else below, "o", "left_semi").select("inst"), "inst", n=n).distinct()


def intervals(pairs: DataFrame) -> DataFrame:
    """(iri, root, pre, post) of a forest of (child, parent): a node is below another when its numbers lie between the other's.

    The tour that enters and leaves every node, children in order of their IRIs, is a list; pointers jump along it by
    doubling, so the numbers need two rows a node, whatever the depth, and no pair table. A node with two parents, or a
    circle, is a ValueError: take closure() there.
    """
    e = cut(pairs.select(F.col("a").alias("iri"), F.col("b").alias("parent")).distinct())
    if not e.groupBy("iri").count().where("count > 1").isEmpty():
        raise ValueError("a node has two parents")
    tops = e.select(F.col("parent").alias("iri")).distinct().join(e.select("iri").hint("shuffle_merge"), "iri", "left_anti")
    rank = F.row_number().over(Window.partitionBy("parent").orderBy("iri"))
    kids = cut(e.withColumn("n", rank))
    first = kids.where("n = 1").select(F.col("parent").alias("iri"), F.col("iri").alias("child"))
    next_ = kids.select("parent", (F.col("n") - 1).alias("n"), F.col("iri").alias("sibling"))
    every = e.select("iri").union(tops.select("iri"))
    tag = lambda c, x: F.concat(F.lit(x), F.col(c))
    down = every.join(first.hint("shuffle_merge"), "iri", "left").select(tag("iri", "<").alias("cell"), F.coalesce(tag("child", "<"), tag("iri", ">")).alias("far"))
    up = kids.join(next_.hint("shuffle_merge"), ["parent", "n"], "left").select(tag("iri", ">").alias("cell"), F.coalesce(tag("sibling", "<"), tag("parent", ">")).alias("far"))
    done, stuck = climb(down.unionByName(up), tops.select(tag("iri", ">").alias("cell")))
    if done.count() != 2 * every.count():
        raise ValueError("the pairs go round in a circle")
    side = lambda x, n: done.where(F.substring("cell", 1, 1) == x).select(F.substring(F.col("cell"), F.lit(2), F.length("cell")).alias("iri"), F.substring(F.col("top"), F.lit(2), F.length("top")).alias("root"), F.col("d").alias(n))
    back = side("<", "b").join(side(">", "a").hint("shuffle_merge"), ["iri", "root"])
    return back.select("iri", "root", (-F.col("b")).alias("pre"), (-F.col("a")).alias("post"))


def instances_within(quads: DataFrame, numbers: DataFrame, targets: DataFrame) -> DataFrame:
    """(class_iri, inst) of the target classes (class_iri) and what is below them, by intervals: each type fact takes its
    class's numbers, and a target takes what lies between its own; BROADCAST_CLASSES targets at most (else a ValueError)."""
    t = targets.select("class_iri").distinct()
    if t.count() > BROADCAST_CLASSES:
        raise ValueError(f"more than {BROADCAST_CLASSES} classes: take instances_closure")
    typed = quads.where((F.col("p") == TYPE) & ~F.col("s").startswith("_:")).select(F.col("s").alias("inst"), F.col("o").alias("iri")).distinct()
    own = numbers.join(F.broadcast(t), numbers["iri"] == t["class_iri"]).select("class_iri", F.col("root").alias("r"), F.col("pre").alias("from"), F.col("post").alias("to"))
    placed = typed.join(numbers.hint("shuffle_merge"), "iri")
    inside = (F.col("r") == F.col("root")) & F.col("pre").between(F.col("from"), F.col("to"))
    return placed.join(F.broadcast(own), inside).select("class_iri", "inst").distinct()


#: A body term: the focus, a variable, or a constant; see pattern_rule.
Pattern = tuple[str, str, str]


@dataclass
class PatternRule(Rule):
    """A rule whose body is patterns over facts, so that it can be run on what is new alone."""

    body: list[Pattern] = field(default_factory=list)
    head: tuple[str, str, str, str, str | None] = ("", "", "", "iri", None)
    where: str | None = None

    def matches(self, facts: DataFrame, pattern: Pattern, n: int = 1) -> DataFrame:
        """One row a fact that fits a pattern, a column a variable (for an object, its kind, datatype and language too); facts of the focus lie as members do."""
        out, seen = [], {}
        for term, c in zip(pattern, "spo"):
            if term == FOCUS or term.startswith("?"):
                name = "inst" if term == FOCUS else term[1:]
                if name in seen:
                    facts = facts.where(F.col(c) == F.col(seen[name]))
                    continue
                seen[name] = c
                out.append(F.col(c).alias(name))
                if c == "o" and term != FOCUS:
                    out += [F.col(k).alias(f"{name}__{k}") for k in ("o_kind", "datatype", "lang")]
            else:
                facts = facts.where(F.col(c) == term)
        found = facts.select(*out)
        return (dealt(found, "inst", n=n) if pattern[0] == FOCUS else found).distinct()

    def given(self, facts: DataFrame, focus: DataFrame, n: int = 1) -> DataFrame:
        return self.joined(focus, [facts] * len(self.body), n)

    def joined(self, focus: DataFrame, tables: list[DataFrame], n: int = 1) -> DataFrame:
        """Heads of all rows that fit: the focus and each pattern's matches in its own table, joined on the variables they share."""
        out = focus
        for pattern, facts in zip(self.body, tables):
            found = self.matches(facts, pattern, n)
            shared = [c for c in found.columns if c in out.columns and "__" not in c]
            if not shared:
                raise ValueError(f"{self.name}: {pattern} shares no variable with what stands before it")
            out = out.join(found.drop(*[c for c in found.columns if c in out.columns and c not in shared]).hint("shuffle_merge"), shared)
        if self.where:
            out = out.where(self.where)
        s, p, o, kind, datatype = self.head
        pick = lambda x: F.col("inst") if x == FOCUS else F.col(x[1:]) if x.startswith("?") else F.lit(x)
        own = lambda k, other: F.col(f"{o[1:]}__{k}") if f"{o[1:]}__{k}" in out.columns else other
        return out.select(pick(s).alias("s"), F.lit(p).alias("p"), pick(o).alias("o"), own("o_kind", F.lit("iri" if o == FOCUS else kind)).alias("o_kind"), own("datatype", F.lit(datatype).cast("string")).alias("datatype"), own("lang", F.lit(None).cast("string")).alias("lang")).distinct()


def pattern_rule(name: str, target: str, body: list[Pattern], head: Pattern, kind: str = "iri", datatype: str | None = None, where: str | None = None, order: int = 0) -> PatternRule:
    """For every way in which the body's patterns (subject, predicate, object; $this, ?variables, constants) fit the facts
    around a member of the target class, one fact; `where` is a condition on the variables. Every pattern shares a
    variable with the focus or a pattern before it."""
    rule = PatternRule(name, target, None, order, body=body, head=(*head, kind, datatype), where=where)
    rule.derive = (lambda facts, focus: rule.joined(focus, [facts] * len(body))) if all(head) else None
    return rule


class Run:
    """What a materialisation did: passes, and for each step (pass, rule) the facts that the rule gave, if it was asked to count
    them, and those that were new."""

    def __init__(self):
        self.passes, self.steps = 0, []


def rules_run(facts: DataFrame, rules: list[Rule], passes: int = 5, count: bool = False) -> tuple[DataFrame, Run]:
    """Inferred facts with the first rule that derived each and its pass, and the run; later rules see earlier output.

    Semi-naive: a rule that has run before is run on what came since. Its new members are joined with all facts, then
    all members with the new facts, pattern by pattern (the ones before it with all facts, the ones after with the old),
    so nothing is derived again from old facts alone. Rules given as functions see all facts again where there is
    something new. A fact that was asserted already counts as derived. Every step's new facts are one checkpoint. Facts and
    members lie in tasks of TASK_FACTS facts, by subject where a rule reads what its members say, so that a rule on their
    own facts takes one exchange.
    """
    todo = sorted((r for r in rules if r.active and r.target and r.derive), key=lambda r: (r.order, r.name))
    base, run = cut(dealt(facts.select(*TRIPLE), *TRIPLE).distinct()), Run()
    found: list[DataFrame] = []  # new facts of each step that had any
    tree, grown = cut(subclass_closure(base)), 0  # steps that the class tree has seen
    last: dict[str, int] = {}  # steps that each rule has seen
    below: dict[str, DataFrame] = {}  # classes below each target, in the present tree
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    held = base.count()
    for run.passes in range(1, passes + 1):
        added = 0
        for k, r in enumerate(todo):
            now = [base, *[d.select(*TRIPLE) for d in found]]
            key, before = f"{k}", last.get(f"{k}")
            last[key] = len(found)
            if before is not None and before == len(found):
                continue
            if grown < len(found) and not union([d for d in found[grown:]]).where(F.col("p") == SUBCLASS).isEmpty():
                tree = cut(subclass_closure(union(now)))
                last, below = {key: len(found)}, {}  # members may have changed everywhere: all rules start again
                before = None
            grown = len(found)
            if r.target not in below:
                below[r.target] = classes_below(base, r.target, tree)
            n = max(1, -(-held // model.TASK_FACTS))
            if before is None or (not isinstance(r, PatternRule) and r.body_of is None):
                new = r.given(union(now), members(union(now), r.target, tree, below[r.target], n), n)
            else:
                old, delta = union(now[: before + 1]), union(now[before + 1 :])
                both, fresh = (members(d, r.target, tree, below[r.target], n) for d in (union(now), delta))
                if not isinstance(r, PatternRule):
                    new = r.body_of(fresh)
                else:
                    parts = [r.joined(fresh, [union(now)] * len(r.body), n)]
                    parts += [r.joined(both, [union(now)] * i + [delta] + [old] * (len(r.body) - i - 1), n) for i in range(len(r.body))]
                    new = union(parts)
            new = new.select(*TRIPLE)
            fresh = new.distinct()
            if found:  # one aggregation for both sides
                sides = union([new.withColumn("known", F.lit(0)), *[d.select(*TRIPLE, F.lit(1).alias("known")) for d in found]])
                fresh = dealt(sides, *TRIPLE, n=n).groupBy(*TRIPLE).agg(F.max("known").alias("known")).where("known = 0").select(*TRIPLE)
            step = cut(fresh.withColumn("rule", F.lit(r.name)).withColumn("pass", F.lit(run.passes)))
            more = step.count()
            run.steps.append((run.passes, r.name, new.distinct().count() if count else None, more))
            if more:
                found.append(step)
                added += more
                held += more
        if not added:
            break
    return union(found) if found else base.limit(0).withColumn("rule", F.lit("")).withColumn("pass", F.lit(0)), run


def rules_materialize(facts: DataFrame, rules: list[Rule], passes: int = 5) -> tuple[DataFrame, int]:
    """rules_run with the number of passes alone."""
    out, run = rules_run(facts, rules, passes)
    return out, run.passes


def rules_explain(facts: DataFrame, rules: list[Rule], triples: DataFrame) -> DataFrame:
    """(s, p, o, rules) of the given triples: all rules that derive exactly each."""
    out, tree, n = None, cut(subclass_closure(facts)), tasks(facts, model.TASK_FACTS)
    for r in rules:
        if r.active and r.target and r.derive:
            focus = members(facts, r.target, tree, n=n)
            part = r.given(facts, focus, n).select("s", "p", "o").distinct().withColumn("rule", F.lit(r.name))
            out = part if out is None else out.unionByName(part)
    asked = triples.select("s", "p", "o").dropna().select("*", F.lit(None).cast("string").alias("rule"), F.lit(True).alias("asked"))
    both = dealt(out.withColumn("asked", F.lit(False)).unionByName(asked), "s", "p", "o", n=n)  # one aggregation for both sides
    found = both.groupBy("s", "p", "o").agg(F.max("asked").alias("asked"), F.array_sort(F.collect_set("rule")).alias("rules"))
    return found.where("asked and size(rules) > 0").drop("asked")


def concept_rows(quads: DataFrame, scheme: str) -> DataFrame:
    """(iri, label, broader, deprecated), one row per concept of a scheme."""
    c = of_predicate(quads, IN_SCHEME, "iri", "scheme").where(F.col("scheme") == scheme).select("iri").distinct()
    one = lambda p, n: of_predicate(quads, p, "iri", n).groupBy("iri").agg(F.min(n).alias(n))
    return c.join(one(PREF, "label").hint("shuffle_merge"), "iri", "left").join(one(BROADER, "broader").hint("shuffle_merge"), "iri", "left").join(one(DEPRECATED, "flag").hint("shuffle_merge"), "iri", "left").select("iri", "label", "broader", F.coalesce(F.col("flag") == "true", F.lit(False)).alias("deprecated"))


def placed(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """df with pos, from 1, in order within each value of `by` (null is a value), by a range exchange and the counts of its parts:
    a parent of any number of children is ranked in many tasks."""
    at = lambda x: F.struct(F.col(by).isNotNull().alias("has"), F.coalesce(by, F.lit("")).alias("v")).alias(x)
    d = df.withColumn("__k", at("k")).repartitionByRange("__k", *order).sortWithinPartitions("__k", *order).withColumn("__at", F.monotonically_increasing_id())
    d = cut(d.withColumn("__part", F.shiftright("__at", 33)))
    parts = d.groupBy("__k", "__part").agg(F.min("__at").alias("__low"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__k").orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    parts = cut(parts.withColumn("__before", before).drop("__n"))
    few = parts.count() <= BROADCAST_CLASSES
    out = d.join(F.broadcast(parts) if few else parts.hint("shuffle_merge"), ["__k", "__part"])
    return out.withColumn("pos", (F.col("__at") - F.col("__low") + F.col("__before") + 1).cast("int")).drop("__k", "__at", "__part", "__low", "__before")


def taxonomy_tree(concepts: DataFrame) -> DataFrame:
    """(iri, root, depth, pos) of a forest: nodes with a missing or foreign parent and nodes on a cycle are roots; siblings by label, then IRI."""
    ids = concepts.select(F.col("iri").alias("broader")).distinct()
    up = cut(concepts.join(ids.hint("shuffle_merge"), "broader", "left_semi").select(F.col("iri").alias("cell"), F.col("broader").alias("far")))
    top = lambda u: concepts.select(F.col("iri").alias("cell")).join(u.select("cell").hint("shuffle_merge"), "cell", "left_anti")
    done, stuck = climb(up, top(up))
    cyclic = stuck.select(F.col("far").alias("cell")).distinct()
    if not cyclic.isEmpty():
        up = up.join(cyclic.hint("shuffle_merge"), "cell", "left_anti")
        done, _ = climb(up, top(up))
    parent = up.select(F.col("cell").alias("iri"), F.col("far").alias("parent"))
    out = done.select(F.col("cell").alias("iri"), F.col("top").alias("root"), F.col("d").cast("int").alias("depth"))
    named = out.join(concepts.select("iri", "label").hint("shuffle_merge"), "iri").join(parent.hint("shuffle_merge"), "iri", "left")
    return placed(named.withColumn("key", F.coalesce("label", "iri")), "parent", ["key", "iri"]).select("iri", "root", "depth", F.col("parent"), "pos")
