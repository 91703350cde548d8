"""Phrase mining, Merkle proofs and exact dedup against plain versions, with the awkward rows in them."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from semlake.llm import exact, merkle, phrases
from semlake.llm.common import written

from .test_llm import ROWS, SCHEMA


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


# Phrases.
def brute_phrases(rows, least, top=2000, cover=80):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            score, k = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items())
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, x, y, n[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return sorted(out)


def phrase_rows():
    rnd = random.Random(3)
    vocab = ["New", "york", "City", "hall", "of", "the", "é", "漢字", "a\x00b", "x\x1fy", "to"] + [f"w{k}" for k in range(30)]
    text = lambda n: "".join(rnd.choice(vocab[: rnd.choice([8, 41])]) + rnd.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\x0b", " "]) for _ in range(n))
    rows = [(rnd.choice(["en", "en", "de", None, "und"]), text(rnd.randint(0, 60))) for _ in range(150)]
    return rows + [("en", "new york city hall " * 3000), ("en", None), ("en", ""), (None, " \t\n"), ("fr", "only here")] + [("de", "the same row again")] * 40


@pytest.mark.parametrize("held", [{}, {"chunk": 500, "most": 50}])
def test_phrases(spark, held):
    rows = phrase_rows()
    docs = spark.createDataFrame([(i, *r, 1, "p") for i, r in enumerate(rows)], "doc_id long, lang string, text string, a int, phrase string").repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(docs, least=5, **held).collect())
    want = brute_phrases(rows, 5)
    assert got == want and len(want) > 50


def test_phrases_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "RANKED", 20)
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in phrases.collocations(docs, top=4, least=5).collect()) == brute_phrases(rows, 5, 4)


def test_phrases_of_nothing(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", "a b"), ("en", None)], "lang string, text string")).count() == 0


def accepted(t):
    return {tuple(t.words[k] for k in r): int(c) for rows, w in t.phrases() for r, c in zip(rows.tolist(), w.tolist())}


def built(counts):
    words = sorted({w for p in counts for w in p})
    by = collections.defaultdict(list)
    for p, c in counts.items():
        by[len(p)].append(([words.index(w) for w in p], c))
    return phrases.sorted_build(words, [(np.array([r for r, _ in x]), np.array([c for _, c in x])) for x in by.values()])


@pytest.mark.parametrize("seed", range(5))
def test_transducers(seed):
    rnd = random.Random(seed)
    make = lambda: {tuple(rnd.choice([b"a", b"b", b"cc", b"\xc3\xa9"]) for _ in range(rnd.randint(1, 4))): rnd.randint(1, 3) for _ in range(rnd.randint(1, 80))}
    shards = [make() for _ in range(4)]
    for s in shards:
        t = built(s)
        assert accepted(t) == s and accepted(phrases.Transducer.from_bytes(t.to_bytes())) == s
        states = {(tuple(zip(t.labels[t.starts[k] : t.starts[k + 1]].tolist(), t.targets[t.starts[k] : t.starts[k + 1]].tolist())), int(w)) for k, w in enumerate(t.weights)}
        assert len(states) == len(t.weights)  # minimal: no two states with equal continuations
    total = collections.Counter()
    for s in shards:
        total.update(s)
    t, n = phrases.union((built(s).to_bytes() for s in shards), 3)
    assert n == sum(total.values()) and (accepted(t) if t else {}) == {p: c for p, c in total.items() if c >= 3}
    asked = make()
    assert t.compose(built(asked)) == {b" ".join(p): total[p] for p in asked if total[p] >= 3}


# Merkle manifest.
def brute_merkle(rows):
    """rows: (doc_id, source, lang, n_chars, text), ids distinct within a language."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(enc, r)))

    def grow(hs):
        levels = [hs]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, i):
        for level in levels[:-1]:
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            yield "".join(run[: i % 8]), "".join(run[i % 8 + 1 :])
            i //= 8

    by = collections.defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: grow([leaf(r) for r in sorted(by[g], key=lambda r: (r[0] is not None, r[0], leaf(r)))]) for g in langs}
    top = grow([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, r in enumerate(sorted(by[g], key=lambda r: (r[0] is not None, r[0], leaf(r)))):
            steps = [*path(trees[g], i), *path(top, k)]
            at = leaf(r)
            if zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 3 == 0 and r[4] is not None:
                at = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in steps:
                at = sha(a + at + b)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), at, at == top[-1][0]))
    return out


def merkle_rows(seed=1):
    rnd = random.Random(seed)
    rows = [(k, rnd.choice(["s", None, ""]), rnd.choice(["en"] * 6 + ["de", None, "", "é"]), rnd.choice([None, 3, -7]), rnd.choice([None, "", "Some Text É", "lower", "x" * 3000])) for k in range(-30, 700)]
    return rows + [(5000, "s", "one", 1, "A lone Leaf"), (None, "s", "en", 1, "No Id"), (2**62, "s", "en", 1, "T")] + [(9000 + k, "s", f"l{k}", 1, "t") for k in range(9)]


@pytest.mark.parametrize("depth", [4, 1])
def test_merkle(spark, depth):
    rows = merkle_rows()
    docs = spark.createDataFrame([(*r, 1, "h") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, pos int, grp string").repartition(5)
    got = merkle.verify_rows(docs, depth).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_merkle(rows), key=str)
    assert {r.verified for r in got} == {True, False}


def test_merkle_proofs_of_some(spark):
    rows = merkle_rows(2)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    m = merkle.manifest(docs, 2)
    ids = [-30, 5, 6, 299, 5000, 9003]
    got = merkle.proofs(spark, m, spark.createDataFrame([(i,) for i in ids], "doc_id long")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got)) == sorted(r for r in brute_merkle(rows) if r[0] in ids)


def test_merkle_of_few(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert merkle.verify_rows(spark.createDataFrame([], schema)).count() == 0
    for rows in ([(1, "s", "en", 4, "Text")], [(3, None, None, None, None)] * 1, [(1, "s", "en", 4, "Text"), (2, "s", "de", 4, "Text")]):
        got = merkle.verify_rows(spark.createDataFrame(rows, schema)).collect()
        assert sorted(tuple(r)[:7] for r in got) == sorted(brute_merkle(rows))
    same = merkle.verify_rows(spark.createDataFrame([(7, "s", "en", 4, "text")] * 100, schema)).collect()  # equal rows are leaves side by side
    assert len(same) == 100 and all(r.verified for r in same) and sorted(r.pos for r in same) == list(range(100)) and len({r.root for r in same}) == 1


def test_multiproof_is_least():
    """Every place that is fetched is needed, and none that the asked leaves give."""
    rnd = random.Random(4)
    for n in (1, 2, 8, 9, 64, 65, 700, 4097):
        for _ in range(10):
            pos = sorted(rnd.sample(range(n), rnd.randint(1, min(n, 20))))
            got = {(level, p) for level, places in merkle.missing(np.array(pos), n) for p in places.tolist()}
            want, derived, size, level = set(), set(pos), n, 0
            while size > 1:
                want |= {(level, c) for p in derived for c in range(p // 8 * 8, min(p // 8 * 8 + 8, size)) if c not in derived}
                derived, size, level = {p // 8 for p in derived}, -(-size // 8), level + 1
            assert got == want


# Exact dedup.
def brute_exact(rows):
    by = collections.defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    out = []
    for t, ids in by.items():
        order = sorted(ids, key=lambda i: (i is not None, i), reverse=True)
        out += [(i, order[0], len(ids), k == 0, sha(t)) for k, i in enumerate(order)]
    return sorted(out, key=str)


def test_exact(spark):
    rnd = random.Random(8)
    rows = [(r[0], r[1]) for r in ROWS] + [(rnd.randint(100, 500), rnd.choice("abcdefgh")) for _ in range(400)] + [(7, "twice")] * 5 + [(None, "no id"), (None, "no id"), (None, "a"), (-(2**63), "far"), (2**63 - 1, "far")]
    rows += [(1000 + k, "a third of all rows") for k in range(300)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, n int, digest string").repartition(5)
    got = exact.dedup_exact(docs)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_exact(rows)
    assert exact.dedup_exact(spark.createDataFrame([], SCHEMA)).count() == 0


def live(index):
    return {r.digest: (r.keep_id, r.n) for r in map(lambda r: r, index.slots.collect())}


def expected(rows):
    out = {}
    for i, t in rows:
        d = hashlib.sha256((t or "").encode()).digest()
        keep, n = out.get(d, (None, 0))
        out[d] = (i if keep is None else keep if i is None else max(keep, i), n + 1)
    return out


def test_index_follows_inserts_and_deletes(spark):
    rnd = random.Random(9)
    first = [(k, f"t{rnd.randint(0, 60)}") for k in range(200)]
    more = [(k, f"t{rnd.randint(30, 400)}") for k in range(200, 900)]
    frame = lambda rows: written(spark, exact.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)), "digests")
    index = exact.DigestIndex.empty(spark, 3).insert(frame(first))
    assert live(index) == expected(first)
    index = index.insert(frame(more))
    assert live(index) == expected(first + more)
    gone = {k for k in range(900) if k % 3 or k > 700}
    index = index.delete(spark.createDataFrame([(k,) for k in gone] + [(5_000_000,), (None,)], "doc_id long"))
    assert live(index) == expected([r for r in first + more if r[0] not in gone])
    back = [(2000, "t1"), (2001, "t1"), (2002, "new")]
    assert live(index.insert(frame(back))) == expected([r for r in first + more if r[0] not in gone] + back)
    # A place in the table is a place in the filter: every digest stands in one of its two buckets, no two in one slot.
    rows = index.slots.collect()
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    for r in rows:
        f = exact.CuckooFilter(r.buckets)
        assert r.slot // 4 * 4 in f.places(bytes(r.digest))[1:]


def test_cuckoo_filter():
    rnd = random.Random(10)
    f, keys, at = exact.CuckooFilter(), [], {}
    for step in range(6000):
        k = rnd.randint(0, 2500)
        d = hashlib.sha256(str(k).encode()).digest()
        slot = f.find(d, keys)
        assert (slot >= 0) == (k in at)
        if slot < 0:
            keys.append(d)
            at[k] = len(keys) - 1
            f.add(d, at[k], keys)
        elif rnd.random() < 0.5:
            f.remove(slot)
            del at[k]
    assert f.resizes >= 7 and all(f.find(hashlib.sha256(str(k).encode()).digest(), keys) >= 0 for k in at)
    same = [b"\x01\x00" + b"\x00" * 6 + k.to_bytes(24, "little") for k in range(8)]  # one fingerprint, one bucket: hits that are not
    g = exact.CuckooFilter(16)
    for k, d in enumerate(same):
        assert g.find(d, same) < 0
        g.add(d, k, same)
    assert g.false_hits > 0 and all(g.rows[g.find(d, same)] == k for k, d in enumerate(same))


def test_changed_keeps_a_shard_whole():
    empty = pa.table({c: pa.array([], t) for c, t in (("shard", pa.int32()), ("buckets", pa.int32()), ("slot", pa.int32()), ("digest", pa.binary()), ("keep_id", pa.int64()), ("n", pa.int64()))})
    d = [hashlib.sha256(str(k).encode()).digest() for k in range(50)]
    change = lambda rows: pa.table({"digest": pa.array([r[0] for r in rows], pa.binary()), "doc_id": pa.array([r[1] for r in rows], pa.int64()), "n": pa.array([r[2] for r in rows], pa.int64()), "shard": pa.array([3] * len(rows), pa.int32())})
    t = exact.changed(empty, change([(x, k, 2) for k, x in enumerate(d)] + [(d[0], None, 1)]))
    assert sorted(zip(t["keep_id"].to_pylist(), t["n"].to_pylist())) == [(0, 3)] + [(k, 2) for k in range(1, 50)]
    t = exact.changed(t, change([(d[4], 1, -1), (d[5], None, -2), (b"x" * 32, None, -1)]))
    assert sorted(zip(t["keep_id"].to_pylist(), t["n"].to_pylist()))[:4] == [(0, 3), (1, 1), (1, 2), (2, 2)] and t.num_rows == 49
