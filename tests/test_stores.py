"""What lies on disk and outlives a job: journals, checkpoints, stream state, the index, watches; and rules run on what is new."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from semlake import registry
from semlake.model import JOURNAL_SCHEMA, QUAD_SCHEMA, SUBCLASS, TYPE
from semlake.operators import closure, match, search, segments
from semlake.sources import store
from semlake.streaming import journal, watches


def event(off, op, graph, facts, at=None, part=0):
    quads = [(s, "p", o, "literal", None, None) for s, o in facts]
    return (part, off, at or datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=off), off, 0, "u", "w", graph, op, False, quads)


def events(spark, rows):
    return spark.createDataFrame(rows, JOURNAL_SCHEMA)


def facts(df):
    return sorted((r.graph, r.s, r.o) for r in df.collect())


def test_manifest_is_there_whole_or_not(spark, tmp_path):
    v = store.Versions(spark, f"file://{tmp_path}/m")
    assert v.read() == (-1, None)
    for n in range(5):
        v.commit(n, {"n": n})
    with pytest.raises(ValueError, match="there already"):
        v.commit(4, {"n": "other"})
    assert v.read() == (4, {"n": 4}) and v.read(2) == (2, {"n": 2}) and v.forget(2) == [{"n": 3}, {"n": 4}] and v.numbers() == [3, 4]


def test_journal_opens_later_folders_only(spark, tmp_path):
    path = f"file://{tmp_path}/j"
    rows = [event(k, "insert", "g", [("s", str(k))], part=k % 2) for k in range(1000)]
    journal.journal_append(events(spark, rows[:600]), path, 100)
    journal.journal_append(events(spark, rows[600:]), path, 100)
    (tmp_path / "j" / "part=0" / "from=900" / "bad.json").write_text("{not json\n")
    d = journal.journal_read(spark, path, {0: 850, 1: 951}, rows[-2][2], span=100)
    assert sorted(r.off for r in d.collect()) == [k for k in range(1000) if (k >= 850 if k % 2 == 0 else k >= 951) and k <= 998]
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "from" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert len({r.f for r in d.select(F.input_file_name().alias("f")).collect()}) <= 4
    assert journal.journal_read(spark, path, span=100).count() == 1000


def test_checkpoint_outlives_its_session(spark, tmp_path):
    folder, path = f"file://{tmp_path}/c", f"file://{tmp_path}/j"
    rnd = random.Random(1)
    rows = [event(k, rnd.choice(["insert"] * 5 + ["delete", "delete", "replace", "drop"]), f"g/{rnd.randint(0, 3)}", [(f"s{rnd.randint(0, 5)}", str(rnd.randint(0, 3))) for _ in range(2)]) for k in range(400)]
    all_events = events(spark, rows)
    journal.journal_append(all_events, path, 50)
    none = spark.createDataFrame([], QUAD_SCHEMA)
    early = all_events.where("off < 230")
    made = journal.checkpoint(journal.restore_pitr(none, early), folder, "2024-01-01 10:00:00", journal.next_offsets(early), "before")
    other = spark.newSession()
    assert journal.list_checkpoints(other, folder) == [made] and made["offsets"] == {"0": 230}
    for off in (230, 300, 399):
        want = facts(journal.restore_pitr(none, all_events.where(F.col("off") <= off)))
        assert facts(journal.restore(other, folder, made["id"], path, rows[off][2], 50)) == want
    assert facts(journal.restore(other, folder, made["id"])) == facts(journal.restore_pitr(none, early))
    with pytest.raises(ValueError, match="no such checkpoint: cp-x. Available: cp-2024"):
        journal.restore(other, folder, "cp-x")
    with pytest.raises(ValueError, match="there already"):
        journal.checkpoint(none, folder, "2024-01-01 10:00:00", None)
    store.delete(spark, f"{folder}/{made['id']}/manifest.json")  # a checkpoint that was not finished
    assert journal.list_checkpoints(other, folder) == []


def test_stream_state_follows_the_batch(spark, tmp_path):
    rnd = random.Random(2)
    rows = [event(k, rnd.choice(["insert"] * 6 + ["delete", "replace"]), f"g{rnd.randint(0, 30)}", [(f"s{rnd.randint(0, 30)}", str(rnd.randint(0, 3)))]) for k in range(1200)]
    shuffled = rows[:]
    rnd.shuffle(shuffled)  # out of order
    s = journal.FactStore(spark, f"file://{tmp_path}/state", buckets=16, most=4, keep=2)
    none = spark.createDataFrame([], QUAD_SCHEMA)
    batches = [shuffled[:1000], shuffled[1000:1100], shuffled[1100:1150], [], shuffled[1150:1199], shuffled[1199:]]
    seen = []
    for k, b in enumerate(batches):
        assert s.apply(events(spark, b), k) and not s.apply(events(spark, b), k)  # a batch that is repeated is not applied again
        seen += b
        assert facts(s.graph()) == facts(journal.restore_pitr(none, events(spark, seen)))
    assert facts(s.graph()) == facts(journal.restore_pitr(none, events(spark, rows)))
    last, manifest = s.versions.read()
    assert last == 5 and s.versions.numbers() == [4, 5] and max(len(x) for x in manifest["held"].values()) < 4
    wrote = spark.read.option("basePath", f"file://{tmp_path}/state/data").parquet(f"file://{tmp_path}/state/data/batch=5").count()
    assert wrote <= 2  # one event: itself, and its drop if it replaces
    assert facts(s.graph(4)) == facts(journal.restore_pitr(none, events(spark, seen[:-1])))  # a reader of the version before still finds its files
    assert journal.stream_state(spark, f"file://{tmp_path}/nothing").count() == 0


def documents(spark, rows):
    d = spark.createDataFrame(rows, "id string, label string, body string")
    return search.crawl_rows(d, "data", F.col("id"), F.col("label"), [F.col("label"), F.col("body")], "src")


def random_docs(rnd, ids):
    words = ["alpha", "beta", "gamma", "delta", "turing", "hopper", "hop"]
    return {i: (i, " ".join(rnd.choices(words, k=rnd.randint(1, 2))), " ".join(rnd.choices(words, weights=[9, 7, 5, 3, 1, 1, 1], k=rnd.choice([1, 2, 5, 30])))) for i in ids}


def test_index_on_disk_equals_one_built_anew(spark, tmp_path):
    rnd = random.Random(3)
    i = segments.SegmentedIndex(spark, f"file://{tmp_path}/i", buckets=4, most=3, block_bits=3)
    asked = spark.createDataFrame([("a", "alpha turing"), ("b", "hop"), ("c", "beta beta"), ("d", "nothing here"), ("e", "")], "qid string, text string")
    now = {}
    for batch in range(5):
        changed = random_docs(rnd, [f"d{rnd.randint(0, 120):03}" for _ in range(60 if batch == 0 else 15)])
        gone = rnd.sample(sorted(now), 5) if now else []
        rows = list(changed.values())
        assert i.apply(documents(spark, rows), spark.createDataFrame([(g,) for g in gone] + [("never",)], "id string"), batch)
        assert not i.apply(documents(spark, rows), None, batch)
        now = {k: v for k, v in now.items() if k not in gone} | changed
        fresh = search.build_index(documents(spark, list(now.values())))
        rounded = lambda d: sorted((r.qid, r.id, round(r.score, 9)) for r in d.collect())
        want = rounded(search.bm25_match(fresh, asked))
        assert rounded(search.bm25_match(i.index(), asked)) == want
        best = {}
        for q, d, x in sorted(want, key=lambda r: (r[0], -r[2], r[1])):
            best.setdefault(q, []).append((q, d, x))
        hits, n = i.topk(asked, 4)
        assert rounded(hits) == sorted(x for rows in best.values() for x in rows[:4])
        assert n["opened"] <= n["blocks"]
    m = i.manifest()
    assert len(m["segments"]) < 3 and m["n_docs"] == len(now)


def test_blocks_that_cannot_win_stay_closed(spark, tmp_path):
    """Many long documents with one mention, a few short ones: only blocks of short ones are opened."""
    i = segments.SegmentedIndex(spark, f"file://{tmp_path}/i", buckets=2, block_bits=4)
    rows = [(f"l{k:04}", "page", "turing " + "filler " * (50 + k % 40)) for k in range(1500)] + [(f"s{k:02}", "turing", "turing turing") for k in range(20)]
    i.apply(documents(spark, rows))
    hits, n = i.topk(spark.createDataFrame([("q", "turing")], "qid string, text string"), 10)
    assert [r.id for r in hits.orderBy("rank").collect()] == [f"s{k:02}" for k in range(10)]
    assert n["blocks"] >= 90 and n["opened"] <= 4


def test_watches_keep_their_state(spark, tmp_path):
    schema = "watch string, run long, id string, score double"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/hits")
        watches.search_watches_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/hits"), f"{tmp_path}/new", f"{tmp_path}/state", 3, 2).awaitTermination()
        return sorted(map(tuple, spark.read.schema(watches.NEW).parquet(f"{tmp_path}/new").collect()))

    assert run([("w", 1, "a", 2.0), ("w", 1, "b", 1.0), ("v", 1, "x", 1.0)]) == []  # the first run only records
    first = [("w", 2, "c", 1), ("w", 2, "d", 2)]
    assert run([("w", 2, "a", 2.0), ("w", 2, "c", 9.0), ("w", 2, "d", 8.0), ("w", 2, "e", 7.0), ("v", 2, None, None)]) == first
    assert run([("w", 2, "z", 9.9)]) == first  # a run that comes again
    assert run([("w", 3, "b", 2.0), ("v", 3, "x", 1.0), ("new", 3, "q", 1.0)]) == sorted([*first, ("w", 3, "b", 1), ("v", 3, "x", 1)])


def test_rules_run_on_what_is_new(spark):
    n = 9
    rows = [("g", f"n{k}", "next", f"n{k + 1}", "iri", None, None) for k in range(n)] + [("g", f"n{k}", TYPE, "Node", "iri", None, None) for k in range(n + 1)]
    rows += [("g", "Stop", SUBCLASS, "Thing", "iri", None, None), ("g", f"n{n}", "size", "7", "literal", "int", None)]
    this = closure.FOCUS
    far = closure.pattern_rule("far", "Node", [(this, "next", "?x"), ("?x", "next", "?y")], (this, "next", "?y"), order=1)
    last = closure.pattern_rule("last", "Node", [(this, "next", "?x"), ("?x", "size", "?n")], (this, "ends", "?n"), where="try_cast(n as int) > 5", order=2)
    kinds = [closure.pattern_rule("kind", "Node", [(this, "ends", "?n")], (this, TYPE, "Stop"), order=3), closure.triple_rule("thing", "Thing", this, "seen", "yes", "literal", order=4)]
    got, run = closure.rules_run(spark.createDataFrame(rows, QUAD_SCHEMA), [*kinds, last, far], 10, count=True)
    found = {(r.s, r.p, r.o) for r in got.collect()}
    assert found == {(f"n{a}", "next", f"n{b}") for a in range(n) for b in range(a + 2, n + 1)} | {x for a in range(n) for x in ((f"n{a}", "ends", "7"), (f"n{a}", TYPE, "Stop"), (f"n{a}", "seen", "yes"))}
    assert {(r.o_kind, r.datatype) for r in got.where("p = 'ends'").collect()} == {("literal", "int")}
    assert run.passes <= 6 and len(got.collect()) == len(found)
    again = sum(given - new for p, name, given, new in run.steps if name in ("last", "kind", "thing") and p > 1)
    assert again <= n  # what was derived is not derived again from old facts
    with pytest.raises(ValueError, match="shares no variable"):
        closure.rules_run(spark.createDataFrame(rows, QUAD_SCHEMA), [closure.pattern_rule("x", "Node", [("?a", "next", "?b")], (this, "p", "?b"))])
    # A rule that adds to the class tree brings members to rules before it.
    sub = closure.triple_rule("sub", "Node", "Leaf", SUBCLASS, "Top", order=2)
    top = closure.triple_rule("top", "Top", this, "is", "top", "literal", order=1)
    got, _ = closure.rules_run(spark.createDataFrame([("g", "a", TYPE, "Node", "iri", None, None), ("g", "b", TYPE, "Leaf", "iri", None, None)], QUAD_SCHEMA), [sub, top])
    assert {(r.s, r.p, r.o) for r in got.collect()} == {("Leaf", SUBCLASS, "Top"), ("b", "is", "top")}


def test_large_lexicon_is_cut(spark, monkeypatch):
    """Tags by parts of a lexicon are those by one automaton."""
    names = [(f"urn:{k}", [w]) for k, w in enumerate(["new york", "york city hall", "New York City", "city", "hall", "C++", "(see", "naïve", "a b c", "b c d"])]
    lex = match.concept_lexicon(spark.createDataFrame(names, "iri string, names array<string>"))
    docs = spark.createDataFrame([(1, "New York City Hall, (see C++) naïve İ City a b c d; cityhall"), (2, None), (3, ""), (4, "city hall city " * 400), (None, "hall"), (4, "york city hall")], "doc_id long, text string")
    rows = lambda: sorted(((r.doc_id, r.concept, r.n, tuple(r.starts)) for r in match.auto_tag(docs, lex).collect()), key=str)
    whole = rows()
    assert ("1", "urn:1") in {(str(r[0]), r[1]) for r in whole} and (4, "urn:3", 800) in {r[:3] for r in whole}
    monkeypatch.setattr(match, "BROADCAST_NAMES", 3)
    monkeypatch.setattr(match, "DEAL", 2)
    assert rows() == whole


def test_journal_widens_its_folders_when_there_would_be_many(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(journal, "FOLDERS", 20)
    monkeypatch.setattr(journal, "TASK_EVENTS", 300)
    path = f"file://{tmp_path}/j"
    rows = [event(k, "insert", "g", [("s", str(k))], part=k % 2) for k in range(1000)]
    journal.journal_append(events(spark, rows[:60]), path, 10)  # few folders of ten offsets
    journal.journal_append(events(spark, rows[60:]), path, 10)
    assert {x.name for x in (tmp_path / "j" / "part=0").iterdir()} == {f"from={k}" for k in [*range(0, 60, 10), *range(160, 1000, 160)]}
    for since in ({}, {0: 33, 1: 57}, {0: 850, 1: 951}, {0: 5000, 1: 5000}):
        got = [r.off for r in journal.journal_read(spark, path, since, span=10).collect()]
        assert sorted(got) == [k for k in range(1000) if k >= since.get(k % 2, 0)]
    d = journal.journal_read(spark, path, {0: 850, 1: 951}, span=10)
    assert {r.f.split("from=")[1].split("/")[0] for r in d.select(F.input_file_name().alias("f")).collect()} == {"800", "960"}


def test_checkpoint_takes_no_folder_for_a_graph(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    quads = spark.createDataFrame([(f"g{k}", "s", "p", str(k), "literal", None, None) for k in range(300)], QUAD_SCHEMA)
    made = journal.checkpoint(quads, folder, "2024-01-01 10:00:00", None)
    assert (made["graphs"], made["triples"]) == (300, 300) and facts(journal.restore(spark, folder, made["id"])) == facts(quads)
    assert len(list((tmp_path / "c" / made["id"] / "facts").rglob("*.parquet"))) <= 8


def test_restore_where_times_do_not_follow_offsets(spark, tmp_path):
    folder, path = f"file://{tmp_path}/c", f"file://{tmp_path}/j"
    start, rnd = datetime.datetime(2024, 1, 1), random.Random(4)
    rows = [event(k, rnd.choice(["insert", "insert", "delete", "replace"]), f"g{k % 3}", [(f"s{k % 5}", str(k % 2))], start + datetime.timedelta(seconds=k % 100, microseconds=k)) for k in range(300)]
    j, t, none = events(spark, rows), start + datetime.timedelta(seconds=50), spark.createDataFrame([], QUAD_SCHEMA)
    journal.journal_append(j, path, 20)
    made = journal.checkpoint(journal.restore_pitr(none, j.where(F.col("at") <= F.lit(t))), folder, "2024-01-01", journal.open_offsets(j, t), "", t)
    assert made["offsets"] == {"0": 50}
    for until in (start + datetime.timedelta(seconds=75), start + datetime.timedelta(seconds=200)):
        assert facts(journal.restore(spark, folder, made["id"], path, until, 20)) == facts(journal.restore_pitr(none, j, until))


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_moment_counts_rows(spark, monkeypatch, kind):
    monkeypatch.setattr(journal, "RANGES", 64)
    start = datetime.datetime(1969, 12, 31, 23, 59)  # before and after 1970
    d = spark.range(0, 10_007, 1, 4).selectExpr(f"cast(timestamp_micros(-60000000 + id * 7919 % 10007 * 10001) as {kind}) as t")
    for share in (0, 0.1, 0.5, 1):
        place = max(1, -(-10_007 * int(share * 10) // 10)) - 1
        assert journal.moment(d, "t", share) == start + datetime.timedelta(microseconds=10_001 * place)
    same = spark.createDataFrame([(start + datetime.timedelta(seconds=k),) for k in [5] * 40 + [6] * 10 + [7] * 50] + [(None,)] * 30, "t timestamp").selectExpr(f"cast(t as {kind}) as t")  # times repeated, and none
    assert [(journal.moment(same, "t", s) - start).seconds for s in (0.4, 0.41, 0.5, 0.51)] == [5, 6, 6, 7]
    assert journal.moment(same.where("t is null"), "t", 0.5) is None


def separate_events(spark, path, n=1_000_003):
    """Events at times of their own in any order, each a fact of its own, so that a time that is one row off shows."""
    e = spark.range(0, n, 1, 8).selectExpr("id as event_id", f"cast(timestamp_micros(1704067200000000 + id * 7919 % {n} * 2001001) as timestamp_ntz) as ts", "id as user_id", "'view' as event_type", "1.0D as value", "'{\"k\": 3}' as props")
    e.write.parquet(f"{path}/events.parquet")


def test_checkpoint_ends_at_the_exact_median(spark, tmp_path):
    separate_events(spark, tmp_path)
    rows = registry.QUERIES["checkpoint"](spark, str(tmp_path)).groupBy("triples").count().collect()
    assert [(r.triples, r["count"]) for r in rows] == [(500_002, 500_002)]


def test_checkpoint_restore_ends_at_the_exact_time(spark, tmp_path):
    separate_events(spark, tmp_path)
    assert registry.QUERIES["checkpoint_restore"](spark, str(tmp_path)).count() == 750_003
