"""Field names against a vocabulary, and intervals of forests, on small exact cases."""

import pytest

from semlake.model import TYPE
from semlake.operators import closure, match


def test_match_field_cases(spark):
    rows = [(0, "MonetaryAmount", "F", ["amount", "total", "balance", "salary", "claim amount", "total amount"]), (1, "Customer", "P", ["customer", "client", "customer email"]), (2, "Identifier", "R", ["id", "number", "order number", "tracking no"]), (3, "Date", "T", ["date", "created at", "hired at"]), (4, "Contract", "L", ["policy", "contract", "policy number"])]
    v = spark.createDataFrame(rows, "ord int, concept string, area string, keywords array<string>")
    names = ["claim_amount", "policy_number", "order_number", "gross_salary_2026", "customer_email", "flux_capacitance", "clientNames", "clients", "number_of_the_order", "ids", "date", "__", "orders_number_x"]
    got = {r.name: (r.concept, r.score, r.hit) for r in match.match_field(spark.createDataFrame([(n,) for n in names], "name string"), v).collect()}
    assert got == {
        "claim_amount": ("MonetaryAmount", 3, "claim amount"), "policy_number": ("Contract", 3, "policy number"), "order_number": ("Identifier", 3, "order number"), "gross_salary_2026": ("MonetaryAmount", 2, "salary"),
        "customer_email": ("Customer", 3, "customer email"), "clientNames": ("Customer", 2, "client"), "clients": ("Customer", 1, "client"), "number_of_the_order": ("Identifier", 2, "number"), "date": ("Date", 3, "date"), "orders_number_x": ("Identifier", 2, "number"),
    }  # fmt: skip  # "ids" has three letters and keeps its s; "order" and "number" apart are no phrase


def test_intervals_of_forests(spark):
    pairs = [("b", "a"), ("c", "a"), ("d", "b"), ("e", "b"), ("y", "x")]
    n = {r.iri: r for r in closure.intervals(spark.createDataFrame(pairs, "a string, b string")).collect()}
    below = lambda u, v: n[u].root == n[v].root and n[v].pre < n[u].pre and n[u].post < n[v].post
    assert {(u, v) for u in n for v in n if below(u, v)} == {("b", "a"), ("c", "a"), ("d", "a"), ("e", "a"), ("d", "b"), ("e", "b"), ("y", "x")}
    deep = spark.range(1, 10_001).selectExpr("concat('n', id) as a", "concat('n', id - 1) as b")
    numbers = closure.intervals(deep)
    assert numbers.where("post - pre = 2 * (10000 - cast(substring(iri, 2) as int)) + 1").count() == 10_001
    q = spark.createDataFrame([("g", f"i{k}", TYPE, f"n{k}", "iri", None, None) for k in (0, 5000, 10_000)], "graph string, s string, p string, o string, o_kind string, datatype string, lang string")
    asked = spark.createDataFrame([("n0",), ("n5000",), ("n10000",)], "class_iri string")
    got = sorted((r.class_iri, r.inst) for r in closure.instances_within(q, numbers, asked).collect())
    assert got == sorted([("n0", "i0"), ("n0", "i5000"), ("n0", "i10000"), ("n5000", "i5000"), ("n5000", "i10000"), ("n10000", "i10000")])
    with pytest.raises(ValueError, match="two parents"):
        closure.intervals(spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string"))
    with pytest.raises(ValueError, match="circle"):
        closure.intervals(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d")], "a string, b string"))
