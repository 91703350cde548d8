"""Small exact cases: errors, keys, search, matching, taxonomies, imports, journal."""

import datetime

import pytest
from pyspark.sql import functions as F

from semlake.functions import scalars as S
from semlake.model import FIRST, NIL, NS, QUAD_SCHEMA, REST, SH, SUBCLASS, TYPE, XSD
from semlake.operators import algebra, closure, dash, governance, graph, imports, match, search, select, validate
from semlake.plans import meta
from semlake.sources import io
from semlake.streaming import journal

ORDERS = meta.Table("sales", "orders", [("id", "TEXT"), ("order_number", "TEXT"), ("status", "TEXT")], ["id"])


def one(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


def quads(spark, rows):
    return spark.createDataFrame([("g", s, p, o, k, None, None) for s, p, o, k in rows], QUAD_SCHEMA)


def test_guarded_select(spark):
    d = spark.createDataFrame([("7", "A-1", "shipped"), ("a b", "B-2", "open")], "id string, order_number string, status string")
    got = select.class_select(d, ORDERS, ["order_number", "nope"], [("status", "=", "shipped")], limit=10).collect()
    assert [r.asDict() for r in got] == [{"__iri": meta.DATA + "orders/7", "order_number": "A-1"}]
    assert {r["__iri"].rsplit("/", 1)[1] for r in select.class_select(d, ORDERS).collect()} == {"7", "a%20b"}
    assert select.class_select(d, ORDERS, filters=[("order_number", "ILIKE", "%a-%")]).count() == 1
    for bad, text in (({"filters": [("evil", "=", 1)]}, "unknown column"), ({"filters": [("status", "UNION", 1)]}, "unsupported operator"), ({"columns": ["nope"]}, "no known columns"), ({"order_by": ("evil", True)}, "unknown sort column")):
        with pytest.raises(ValueError, match=text):
            select.class_select(d, ORDERS, **bad)


def test_numbers_are_checked(spark):
    d = spark.createDataFrame([(1, 2.0)], "o_orderkey long, o_totalprice double")
    with pytest.raises(ValueError, match="is no value"):
        select.class_select(d, meta.TABLES["orders"], ["o_orderkey"], [("o_totalprice", ">", "x")])


def test_keys_round_trip(spark):
    t = meta.Table("s", "album", [("id", "TEXT"), ("disc", "TEXT"), ("cover", "BLOB"), ("title", "TEXT")], ["id", "disc"])
    d = spark.createDataFrame([("a b/c", "x_y", b"1", None)], "id string, disc string, cover binary, title string")
    iri = d.select(meta.subject(t).alias("iri"))
    assert iri.first().iri == meta.DATA + "album/a%20b%2Fc_x%5Fy"
    assert select.match_subject(iri, [t]).first().keys == ["a b/c", "x_y"]
    facts = meta.rows_to_triples(d, t).collect()
    assert sorted(r.p for r in facts) == sorted([TYPE, NS + "album_id", NS + "album_disc"])  # null and binary cells give none


def test_scalars(spark):
    d = one(spark, x="  Wire-Transfers (SWIFT)! ")
    r = d.select(S.tokens(F.col("x")).alias("t"), S.slug(F.col("x")).alias("s"), S.norm_header(F.col("x")).alias("h"), S.norm_label(F.lit("naïve  Café")).alias("n"), S.humanize(F.lit("customerID_no")).alias("m"), S.local_name(F.lit("http://a/b#c%20d")).alias("l")).first()
    assert (r.t, r.s, r.h, r.n, r.l) == (["wire", "transfers", "swift"], "wire-transfers-swift", "wiretransfersswift", "naive cafe", "c d")
    terms = spark.createDataFrame([("<urn:x>",), ("42",), ("-3.5",), ("true",), ("2026-08-22",), ("hi",)], "x string").select(*S.infer_term(F.col("x"))).collect()
    assert [(t.o_kind, t.datatype and t.datatype.replace(XSD, "")) for t in terms] == [("iri", None), ("literal", "integer"), ("literal", "decimal"), ("literal", "boolean"), ("literal", "date"), ("literal", "string")]


def test_values_against_shapes(spark):
    shape = lambda p, dt=None, lo=None, hi=None, rx=None, ml=None, vals=None: ("s", "c", p, None, dt and XSD + dt, None, None, None, None, lo, hi, rx, ml, vals, 0)
    sh = spark.createDataFrame([shape("i", "integer"), shape("d", "date"), shape("r", None, 1900.0, 2100.0), shape("p", rx="^[A-Z]{3}$"), shape("b", rx="(["), shape("m", ml=5), shape("v", vals=["rock", "jazz"]), shape("o", "boolean")], validate.SHAPE_SCHEMA)
    cells = [("i", "42", None), ("i", "4.2", "integer"), ("d", "22/08/2026", "date"), ("d", "2026-08-22", None), ("r", "1850", "minInclusive"), ("r", "3000", "maxInclusive"), ("r", "1997", None), ("p", "abc", "pattern"), ("p", "ABC", None), ("b", "x", None), ("m", "abcdef", "maxLength"), ("v", "polka", "in"), ("o", "yes", "boolean"), ("i", " ", "empty")]
    got = validate.validate_values(spark.createDataFrame([(k, p, v) for k, (p, v, _) in enumerate(cells)], "row int, path string, value string"), sh).collect()
    assert {r.row: r.problem for r in got} == {k: w for k, (_, _, w) in enumerate(cells)}


DOCS = [("c:1", "data", "Alan Turing", "Alan Turing ada@x.com London"), ("c:2", "data", "Grace Hopper", "Grace Hopper compilers"), ("c:3", "model", "Turing Award", "prize named after Turing")]


@pytest.fixture(scope="module")
def index(spark):
    d = spark.createDataFrame(DOCS, "id string, kind string, label string, text string")
    return search.build_index(d.select("id", F.col("id").alias("iri"), "kind", "label", F.lit("s").alias("source_id"), F.create_map(F.lit("label"), "label", F.lit("text"), "text").alias("fields")))


def ids(df):
    return [r.id for r in df.orderBy(F.desc("score"), "id").collect()]


def test_search(spark, index):
    ask = lambda t: search.bm25_match(index, spark.createDataFrame([("q", t)], "qid string, text string"))
    assert set(ids(ask("turing"))) == {"c:1", "c:3"} and ids(ask("hopp"))[0] == "c:2"
    assert search.q_match_all(index).count() == 3 and ids(search.q_term(index, "kind", "model")) == ["c:3"]
    hits = ask("turing").select("id", "score")
    assert ids(search.q_bool(must=[hits], filters=[search.q_term(index, "kind", "data")], index=index)) == ["c:1"]
    assert ids(search.q_bool(must=[hits], must_not=[search.q_term(index, "kind", "model")], index=index)) == ["c:1"]
    assert set(ids(search.q_bool(should=[hits], index=index))) == {"c:1", "c:3"}
    assert "<em>compilers</em>" in search.highlight(one(spark, text="Grace Hopper compilers"), "text", "compilers").first().fragment
    facet = search.terms_facet(hits, index.docs, "kind").collect()
    assert [(r.key, r.n) for r in facet] == [("data", 1), ("model", 1)]


def test_reconcile(spark, index):
    got = search.reconcile_batch(index, spark.createDataFrame([("a", "alan turing"), ("b", "turing"), ("c", " ")], "qid string, text string")).orderBy("qid", "rank").collect()
    assert [(r.qid, r.score, r.exact) for r in got if r.rank == 1] == [("a", 100, True), ("b", 90, False)]


def test_matching(spark):
    vocab = [("MonetaryAmount", ["amount", "total", "balance", "salary", "claim amount", "total amount"]), ("Customer", ["customer", "client", "customer email"]), ("Identifier", ["id", "number", "order number", "tracking no"]), ("Date", ["date", "created at", "hired at"]), ("Contract", ["policy", "contract", "policy number"])]
    v = spark.createDataFrame([(k, c, "a", kws) for k, (c, kws) in enumerate(vocab)], "ord int, concept string, area string, keywords array<string>")
    names = ["claim_amount", "policy_number", "order_number", "gross_salary_2026", "customer_email", "flux_capacitance"]
    got = {r.name: (r.concept, r.score) for r in match.match_field(spark.createDataFrame([(n,) for n in names], "name string"), v).collect()}
    assert got == {"claim_amount": ("MonetaryAmount", 3), "policy_number": ("Contract", 3), "order_number": ("Identifier", 3), "gross_salary_2026": ("MonetaryAmount", 2), "customer_email": ("Customer", 3)}


def test_crosswalk(spark):
    a = spark.createDataFrame([("a1", "Car", []), ("a2", "Heavy Truck", []), ("a3", "Bicycle", [])], "iri string, label string, alts array<string>")
    b = spark.createDataFrame([("b1", "Automobile", ["Car"]), ("b2", "Heavy Goods Truck", [])], "iri string, label string, alts array<string>")
    assert {(r.a, r.b, r.score, r.reason) for r in match.crosswalk_suggest(a, b).collect()} == {("a1", "b1", 0.95, "exact"), ("a2", "b2", 0.53, "overlap")}
    left = match.crosswalk_suggest(a, b, spark.createDataFrame([("a1", "b1")], "a string, b string"))
    assert [r.a for r in left.collect()] == ["a2"]
    with pytest.raises(ValueError, match="unknown relation"):
        match.crosswalk_facts(left, "sameAs", "g")


def test_tagging(spark):
    text = "Jazz Fusion blends jazz with rock. Our ML models classify each Jazz record; Jazzercise is unrelated."
    lex = match.concept_lexicon(spark.createDataFrame([("j", ["Jazz"]), ("f", ["Jazz Fusion"]), ("m", ["Machine Learning", "ML models"])], "iri string, names array<string>"))
    got = {r.concept: (r.n, r.starts) for r in match.auto_tag(spark.createDataFrame([(1, text)], "doc_id long, text string"), lex).collect()}
    assert got == {"f": (1, [0]), "j": (2, [19, text.index("Jazz record")]), "m": (1, [39])}


def test_taxonomy(spark):
    rows = [("z", "Zeta", None), ("z1", "Zeta One", "z"), ("a", "Alpha", None), ("a2", "Alpha Two", "a"), ("a1", "Alpha One", "a"), ("x", "X", "foreign"), ("p", "P", "q"), ("q", "Q", "p"), ("r", "R", "p")]
    t = {r.iri: r for r in closure.taxonomy_tree(spark.createDataFrame(rows, "iri string, label string, broader string")).collect()}
    assert set(t) == {r[0] for r in rows} and {i for i, r in t.items() if r.depth == 0} == {"z", "a", "x", "p", "q"}
    assert (t["a1"].pos, t["a2"].pos, t["r"].root, t["r"].depth) == (1, 2, "p", 1)


def test_closure_and_lists(spark):
    q = quads(spark, [("Band", SUBCLASS, "Artist", "iri"), ("Duo", SUBCLASS, "Band", "iri"), ("x", TYPE, "Duo", "iri"), ("_:1", FIRST, "a", "literal"), ("_:1", REST, "_:2", "bnode"), ("_:2", FIRST, "b", "literal"), ("_:2", REST, "_:3", "bnode"), ("_:3", FIRST, "c", "literal"), ("_:3", REST, NIL, "iri")])
    assert {(r.sub, r.super) for r in closure.subclass_closure(q).collect()} == {("Band", "Artist"), ("Duo", "Band"), ("Duo", "Artist"), ("Band", "Band"), ("Artist", "Artist"), ("Duo", "Duo")}
    assert {r.class_iri for r in closure.instances_closure(q).where("inst = 'x'").collect()} == {"Duo", "Band", "Artist"}
    assert [(r.head, r.value) for r in closure.list_walk(q).orderBy("pos").collect()] == [("_:1", "a"), ("_:1", "b"), ("_:1", "c")]


def test_rules(spark):
    q = quads(spark, [("InRainbows", TYPE, "Album", "iri"), ("KidA", TYPE, "Album", "iri"), ("other", TYPE, "Band", "iri")])
    got, passes = closure.rules_materialize(q, [closure.triple_rule("r", "Album", closure.FOCUS, "kind", "recording", "literal"), closure.triple_rule("none", None, closure.FOCUS, "a", "b")])
    assert {(r.s, r.o, r.rule) for r in got.collect()} == {("InRainbows", "recording", "r"), ("KidA", "recording", "r")} and passes == 2


def test_shapes_and_lists(spark):
    q = quads(spark, [("S", SH + "targetClass", "Album", "iri"), ("S", SH + "property", "P", "iri"), ("P", SH + "path", "genre", "iri"), ("P", SH + "in", "_:1", "bnode"), ("P", SH + "maxCount", "1", "literal"), ("_:1", FIRST, "rock", "literal"), ("_:1", REST, "_:2", "bnode"), ("_:2", FIRST, "jazz", "literal"), ("_:2", REST, NIL, "iri"), ("a", TYPE, "Album", "iri"), ("a", "genre", "polka", "literal"), ("a", "genre", "jazz", "literal")])
    sh = validate.read_shapes(q)
    assert sh.first().in_values == ["rock", "jazz"] and sh.first().ord == 9999
    assert {(r.focus, r.constraint) for r in validate.shacl_validate(q, sh).collect()} == {("a", "in"), ("a", "maxCount")}


def test_imports(spark):
    rows = spark.createDataFrame([(1, "Alpha", None), (2, " ", None), (3, "Alpha", None), (4, "Child", "Nope"), (5, "Kid", "alpha"), (6, "Baby", "KID"), (7, "Hardware", None), (8, "Tool", "hardware")], "row int, label string, broader string")
    got = {r.row: r.problem for r in imports.validate_concept_rows(rows, spark.createDataFrame([("hardware",)], "label string")).collect()}
    assert got == {1: None, 2: "missing label", 3: "duplicate", 4: "unknown broader", 5: None, 6: None, 7: "already exists", 8: None}
    sheet = spark.createDataFrame([(1, "Sales"), (2, "Finance"), (3, ""), (4, "Sales")], "row int, label string")
    got = imports.validate_class_rows(sheet, spark.createDataFrame([("finance",)], "label string"), spark.createDataFrame([(4, "not an integer")], "row int, error string"))
    assert {r.row: r.problem for r in got.collect()} == {1: None, 2: "already exists", 3: "missing label", 4: "duplicate"}
    heads = spark.createDataFrame([("Term",), ("Parent",), ("Synonyms",), ("Description",), ("Unknown Col",)], "header string")
    assert {r.header: r.field for r in imports.map_headers(heads).collect()} == {"Term": "label", "Parent": "broader", "Synonyms": "alt", "Description": "definition", "Unknown Col": None}


def test_csv(spark, tmp_path):
    (tmp_path / "x.csv").write_text('\ufeffa,b\n"x ""y"", z","two\nlines"\n,\n1,2\n', encoding="utf-8")
    assert [tuple(r) for r in imports.csv_rows(spark, str(tmp_path / "x.csv")).collect()] == [('x "y", z', "two\nlines"), ("1", "2")]


def test_json_rows(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"data": {"items": [{"id": 1, "org": {"team": "apps"}}, {"id": 2, "org": null}]}, "n": 1}')
    assert [(r.id, r.org) for r in io.json_rows(spark, str(tmp_path / "d.json"), "data.items").collect()] == [(1, '{"team":"apps"}'), (2, None)]
    with pytest.raises(ValueError, match="no array"):
        io.json_rows(spark, str(tmp_path / "d.json"), "data")


def test_ntriples_round_trip(spark):
    rows = [("g", "urn:a", "urn:p", 'say "hi"\\n\n\ttab', "literal", None, None), ("g", "urn:a", "urn:p", "hallo", "literal", None, "de"), ("g", "urn:a", "urn:q", "4", "literal", XSD + "integer", None), ("g", "_:b", "urn:q", "urn:o", "iri", None, None)]
    q = spark.createDataFrame(rows, QUAD_SCHEMA)
    lines = io.sink_ntriples(q).union(spark.createDataFrame([("g", "# note"), ("g", "broken line"), ("g", "")], "graph string, line string"))
    good, bad = io.parse_ntriples(lines)
    assert sorted(map(tuple, good.collect()), key=str) == sorted(rows, key=str) and [r.line for r in bad.collect()] == ["broken line"]


def test_diffs(spark):
    a, b = quads(spark, [("x", "size", "5", "literal"), ("y", "n", "1", "literal")]), quads(spark, [("y", "n", "1", "literal"), ("c", "name", "Gamma", "literal")])
    d = algebra.graph_diff(a, b)
    assert {(r.change, r.s) for r in d.collect()} == {("removed", "x"), ("added", "c")} and algebra.diff_mode(d).first().mode == "patch"
    assert {r.s for r in algebra.apply_diff(a, d).collect()} == {"y", "c"}
    assert {r.s for r in algebra.apply_diff(algebra.apply_diff(a, d), algebra.invert_diff(d)).collect()} == {"x", "y"}
    assert algebra.diff_mode(algebra.graph_diff(a, quads(spark, [("_:b", "n", "1", "literal")]))).first().mode == "replace"


def test_governance(spark):
    r = spark.createDataFrame([("admin", [], []), ("steward", ["G1"], ["G1"]), ("steward", ["G1"], ["G2"]), ("steward", ["G1"], ["G1", "G2"]), ("steward", ["G1"], []), ("viewer", ["G1"], ["G1"])], "role string, governs array<string>, targets array<string>")
    assert [x.ok for x in r.select(governance.can_write(F.col("role"), F.col("governs"), F.col("targets")).alias("ok")).collect()] == [True, True, False, False, False, False]


def test_series(spark):
    d = spark.createDataFrame([("shipped", "42"), ("pending", "7"), ("", "3"), ("bad", "NaN-ish"), (None, "1"), ("n", "NaN")], "x string, y string")
    s = dash.widget_series(d, "x", "y")
    assert sorted(map(tuple, s.collect())) == [("pending", 7.0), ("shipped", 42.0)]
    assert sorted(r.share for r in dash.widget_share(spark.createDataFrame([("a", 1.0), ("b", 3.0)], "x string, y double")).collect()) == [0.25, 0.75]


def test_journal(spark):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    fact = lambda s: [(s, "p", "o", "literal", None, None)]
    rows = [(0, 0, at(1), 1, 0, "u", "w", "g", "insert", False, fact("A")), (0, 1, at(2), 2, 0, "u", "w", "g", "insert", False, fact("B")), (0, 2, at(5), 3, 0, "u", "w", "g", "insert", False, fact("C")), (0, 3, at(6), 4, 0, "u", "w", "g", "delete", False, fact("A")), (0, 4, at(7), 5, 0, "u", "w", "h", "replace", False, fact("D")), (0, 5, at(8), 6, 0, "u", "w", "h", "drop", False, None)]
    from semlake.model import JOURNAL_SCHEMA

    j, none = spark.createDataFrame(rows, JOURNAL_SCHEMA), spark.createDataFrame([], QUAD_SCHEMA)
    state = lambda t: {r.s for r in journal.restore_pitr(none, j, t).collect()}
    assert state(at(3)) == {"A", "B"} and state(at(5)) == {"A", "B", "C"} and state(at(7)) == {"B", "C", "D"} and state(None) == {"B", "C"}
    assert graph.hist_buckets(spark.createDataFrame([("a", 3.0), ("a", 30.0)], "k string, v double"), "v", ["k"]).first().le_25 == 1


def test_no_limits(spark):
    """A hot key keeps all its links, children, tags and text when the limit is off."""
    from semlake.operators import dash, governance, graph, match

    q = spark.createDataFrame([(f"s{k:04}", "urn:p", "hub", "iri", "g") for k in range(1300)] + [("hub", "urn:p", f"s{k:04}", "iri", "g") for k in range(1300)], "s string, p string, o string, o_kind string, graph string")
    hub = spark.createDataFrame([("hub",)], "iri string")
    links = q.where("s = 'hub'").select(q.s.alias("subject"), q.p.alias("predicate"), q.o.alias("object"))
    assert graph.describe_batch(hub, q.where("s = 'hub'").limit(1), links, None).where("kind = 'link'").count() == 1300
    assert graph.expand_neighbors(q, hub, None).count() == 1300
    assert graph.describe_resource(q, hub.selectExpr("iri", "iri as label"), hub, "g", None, None).count() == 2600
    kids = dash.shape_nested(spark.range(1).selectExpr("id as k"), spark.range(500).selectExpr("0L as k", "id as child"), "k", "c", None).first()
    assert kids.c == list(range(500))
    assert len(governance.record_changes(spark.createDataFrame([("x" * 5000,)], "detail string"), None).first().detail) == 5000
    names = [f"{a}{b}{c}" for a in "bcdf" for b in "aeio" for c in "nrst"]
    lexicon = match.concept_lexicon(spark.createDataFrame([(f"urn:{w}", [w]) for w in names], "iri string, names array<string>"))
    assert match.auto_tag(spark.createDataFrame([(1, " ".join(names))], "doc_id long, text string"), lexicon, None).count() == 64


def test_auto_tag_brute_force(spark):
    """Whole texts of the smallest table against a plain version: longer names first, each span claimed once, whole words."""
    import re

    from semlake.operators import match
    from semlake.registry.text import lexicon

    lex = lexicon(spark, "/root/testdata/sf0.001").union(match.concept_lexicon(spark.createDataFrame([("urn:the", ["the", "THE ", "on the"]), ("urn:c", ["the", "C++", "naïve"]), ("urn:long", ["x" * 201]), ("urn:short", ["on"])], "iri string, names array<string>")))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, "On the The other, (the) C++ and C++x; naïve NAÏVE naïves"), (-2, None), (-3, ""), (-4, "the the on the")], docs.schema))
    names = sorted({(-len(r.name), r.concept, r.name, r.key) for r in lex.collect()})
    assert not any(c in ("urn:long", "urn:short") for _, c, _, _ in names)
    word = lambda t, i: 0 <= i < len(t) and (t[i].isalnum())
    want = {}
    for r in docs.collect():
        t, taken = r.text or "", []
        low = t.lower()
        for _, concept, name, key in names:
            for m in re.finditer(f"(?={re.escape(key)})", low):
                a, b = m.start(), m.start() + len(name)
                if not word(t, a - 1) and not (word(t, b)) and not any(a < y and x < b for x, y in taken):
                    taken.append((a, b))
                    want.setdefault((r.doc_id, concept), []).append(a)
    got = {(r.doc_id, r.concept): (r.n, list(r.starts)) for r in match.auto_tag(docs, lex).collect()}
    assert got == {k: (len(v), sorted(v)) for k, v in want.items()} and len(got) > 100


def test_estate(spark):
    """Errors and edges of the estate's reads."""
    import pytest

    from semlake.operators import estate
    from semlake.plans import meta

    with pytest.raises(ValueError, match="read-only"):
        estate.sql_console(spark, "DROP TABLE x")
    with pytest.raises(ValueError, match="read-only"):
        estate.sql_console(spark, "WITH a AS (SELECT 1) INSERT INTO x SELECT * FROM a")
    rows, cut = estate.sql_console(spark, "SELECT id FROM range(5)", 5)
    assert rows.count() == 5 and cut
    assert estate.sql_console(spark, "SELECT id FROM range(5)", 6)[1] is False
    m = spark.createDataFrame([("s", "t", "title_fk", "TEXT", 0, False, False, "u", "id"), ("s", "t", "full_name", "TEXT", 3, False, False, None, None), ("s", "t", "x_name", "TEXT", 1, False, False, None, None), ("s", "k", "id", "TEXT", 0, True, True, None, None), ("s", "k", "note", "VARCHAR", 1, False, False, None, None), ("s", "n", "id", "INTEGER", 0, True, True, None, None)], meta.table_meta(spark).schema)
    assert {(r.table, r.label) for r in estate.pick_label_columns(m).collect()} == {("t", "full_name"), ("k", "note")}
    assert {r.s for r in estate.translate_source(m, "s", "csv", ["k"]).collect() if "map/" in r.s} == {"urn:sem:map/k", "urn:sem:map/k/id", "urn:sem:map/k/note"}
    assert [r.label for r in estate.list_asset_types(spark.createDataFrame([], QUAD_SCHEMA)).collect()][:2] == ["Taxonomies", "Business glossaries"]


def test_lists_of_every_kind(spark):
    """Long lists, shared tails, circles and cells without a value."""
    from semlake.operators import closure

    rows = [(f"l{i}", FIRST, str(i), "literal") for i in range(100)] + [(f"l{i}", REST, f"l{i + 1}" if i < 99 else NIL, "iri") for i in range(100)]
    rows += [("m0", FIRST, "m", "literal"), ("m0", REST, "l98", "iri"), ("c0", FIRST, "c", "literal"), ("c1", FIRST, "d", "literal"), ("c0", REST, "c1", "iri"), ("c1", REST, "c0", "iri"), ("one", FIRST, "1", "literal")]
    got = sorted(tuple(r) for r in closure.list_walk(quads(spark, rows)).collect())
    assert got == sorted([("l0", i, str(i)) for i in range(100)] + [("m0", 0, "m"), ("m0", 1, "98"), ("m0", 2, "99"), ("one", 0, "1")])
    forest = spark.createDataFrame([("a", "A", None), ("b", "B", "a"), ("x", "X", "y"), ("y", "Y", "x"), ("z", "Z", "x"), ("w", "W", "z"), ("lost", "L", "nowhere")], "iri string, label string, broader string")
    tree = {r.iri: (r.root, r.depth) for r in closure.taxonomy_tree(forest).collect()}
    assert tree == {"a": ("a", 0), "b": ("a", 1), "x": ("x", 0), "y": ("y", 0), "z": ("x", 1), "w": ("x", 2), "lost": ("lost", 0)}


def test_oversized_event(spark):
    """A body that the journal doesn't carry makes a restore fail; by default it is carried."""
    import pytest

    from semlake.model import JOURNAL_SCHEMA

    body = [("s", "p", "x" * 600_000, "literal", None, None)]
    j = spark.createDataFrame([(0, 0, datetime.datetime(2024, 1, 1), 1, 0, "u", "w", "g", "insert", False, body)], JOURNAL_SCHEMA)
    none = spark.createDataFrame([], QUAD_SCHEMA)
    assert journal.restore_pitr(none, journal.journal_publish(j)).count() == 1
    with pytest.raises(Exception, match="oversized"):
        journal.restore_pitr(none, journal.journal_publish(j, carry=False)).collect()


def plain_docs(spark, rows):
    d = spark.createDataFrame(rows, "id string, label string, text string")
    return search.build_index(d.select("id", F.col("id").alias("iri"), F.lit("data").alias("kind"), "label", F.lit("s").alias("source_id"), F.create_map(F.lit("label"), "label", F.lit("text"), "text").alias("fields")))


def test_reconcile_asks_each_text_once_of_each_kind_of_document(spark, monkeypatch):
    rows = [(f"d{k:03}", x, f"{x} {y}") for k, (x, y) in enumerate([("red bolt", "a"), ("red ring", "a"), ("red bolt", "b"), ("blue ring", "a")] * 50)]
    index, asked = plain_docs(spark, rows), spark.createDataFrame([(f"q{k:03}", t) for k, t in enumerate(["red bolt", "red xq", "none"] * 60)], "qid string, text string")
    inner, sizes = search.bm25_match, []
    want = {}
    for t in ("red bolt", "red xq", "none"):
        scores = {r.id: round(r.score, 9) for r in inner(index, spark.createDataFrame([("q", t)], "qid string, text string")).collect()}
        top = sorted(scores, key=lambda i: (-scores[i], i))[:12]
        points = {i: 100 if rows[int(i[1:])][1] == t else int(scores[i] / scores[top[0]] * 90 + 0.5) for i in top}
        want[t] = [(i, points[i]) for i in sorted(top, key=lambda i: (-points[i], i))[:3]]

    def counting(*args, **kwargs):
        out = inner(*args, **kwargs)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(search, "bm25_match", counting)
    got = {}
    for r in search.reconcile_batch(index, asked).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.id, r.score))
    assert got == {f"q{k:03}": want[t] for k, t in enumerate(["red bolt", "red xq", "none"] * 60) if want[t]}
    assert sizes == [6]  # two texts that hit three kinds of documents each, not 120 questions and 150 documents


def test_reconcile_ranks_scores_to_nine_places(spark, monkeypatch):
    index = plain_docs(spark, [(i, f"red {i}", "x") for i in "abcde"])
    scores = F.from_json(F.lit(str([{"id": i, "score": 0.3 if i == "a" else 0.30000000000000004} for i in "abcde"]).replace("'", '"')), "array<struct<id:string,score:double>>")
    monkeypatch.setattr(search, "bm25_match", lambda i, q, *_: q.select("qid", F.explode(scores).alias("x")).select("qid", "x.*"))
    got = search.reconcile_batch(index, spark.createDataFrame([("q", "red")], "qid string, text string"), 1).collect()
    assert [(r.id, r.score) for r in got] == [("a", 90)]  # of four hits that are kept: 0.1 + 0.2 is no better than 0.3


def test_facts_are_dealt_to_bounded_tasks(spark, tmp_path, monkeypatch):
    from semlake import model

    monkeypatch.setattr(model, "TASK_ROWS", 100)
    monkeypatch.setattr(model, "TASK_FACTS", 200)
    monkeypatch.setattr(io, "TASK_FACTS", 200)
    made = meta.rows_to_triples(spark.range(1000).selectExpr("cast(id as string) id", "cast(id % 7 as string) order_number", "'x' status").coalesce(1), ORDERS)
    assert made.rdd.getNumPartitions() == 10 and made.count() == 4000
    old, new = made.unionByName(made.where("o = '3'")), made.where("o <> '5'")
    gone = made.count() - new.count()
    for d, n in ((algebra.graph_diff(made, new), gone), (algebra.insert_data(made, new), 4000), (algebra.apply_diff(made, algebra.graph_diff(made, new)), 4000 - gone)):
        assert d.rdd.getNumPartitions() > 15 and d.count() == n
    left = algebra.delete_data(old, made.where("o = '5'"))
    assert left.rdd.getNumPartitions() > 15 and left.count() == old.count() - gone  # repeats of what stays are kept
    assert algebra.delete_data(quads(spark, [("a", "p", None, "literal")] * 2), quads(spark, [("a", "p", None, "literal")])).count() == 0
    io.bulk_load(old, f"file://{tmp_path}/store")
    assert spark.read.parquet(f"file://{tmp_path}/store").count() == 4000 and len(list((tmp_path / "store").rglob("*.parquet"))) > 15


def test_rules_run_in_bounded_tasks(spark, tmp_path, monkeypatch):
    from semlake import model
    from semlake.registry import graphs

    rows = [(k, f"p{k}", "b", "LARGE TIN" if k % 3 else "SMALL BRASS", k % 50, 1.0) for k in range(1000)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"file://{tmp_path}/part.parquet")
    sf, want = f"file://{tmp_path}", {f"{meta.DATA}part/{k}" for k in range(1000) if k % 50 > 25}
    assert {r.s for r in graphs.rule_pattern(spark, sf).collect()} == want
    held, cut = [], closure.cut

    def seen(df):
        out = cut(df)
        held.append([n for _, n in sorted(out.groupBy(F.spark_partition_id()).count().collect())])
        return out

    monkeypatch.setattr(model, "TASK_ROWS", 100)
    monkeypatch.setattr(model, "TASK_FACTS", 200)
    assert max(r["count"] for r in graphs.part_classes(spark, sf).where(F.col("p") == TYPE).groupBy(F.spark_partition_id()).count().collect()) < 200
    monkeypatch.setattr(closure, "cut", seen)
    got = graphs.rule_pattern(spark, sf)
    assert got.rdd.getNumPartitions() > 30 and {r.s for r in got.collect()} == want and got.count() == len(want)
    assert sum(held[0]) > 7000 and max(held[0]) < 400  # the facts that the rules start from
    explained = graphs.rules_explain(spark, sf)
    assert explained.rdd.getNumPartitions() > 4 and {r.s for r in explained.collect()} == want and explained.count() == len(want)


def test_index_is_built_in_bounded_tasks_and_frequent_terms_stay_put(spark, monkeypatch):
    rows = [(f"d{k:04}", f"part {k % 90}", f"part {k % 90} x{k}") for k in range(600)]
    want = sorted(map(tuple, search.postings_with_counts(plain_docs(spark, rows)).select("field", "term", "id", "tf", "len", "df").collect()))
    monkeypatch.setattr(search, "TASK_ROWS", 50)
    monkeypatch.setattr(search, "FREQUENT", 100)
    i = plain_docs(spark, rows)
    assert i.postings.rdd.getNumPartitions() == 12
    got = search.postings_with_counts(i)
    assert sorted(map(tuple, got.select("field", "term", "id", "tf", "len", "df").collect())) == want and len(want) == 3000
    asked = spark.createDataFrame([("q", "part 7"), ("r", "x5")], "qid string, text string")
    hits = lambda: sorted((r.qid, r.id, round(r.score, 9)) for r in search.bm25_match(i, asked).collect())
    plan = search.bm25_match(i, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    broadcast = hits()
    monkeypatch.setattr(search, "BROADCAST_TERMS", 0)
    assert hits() == broadcast and len(broadcast) >= 600
