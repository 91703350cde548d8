"""Phrase collocations by weighted acyclic automata.

Texts are read three times: for single words, for pairs of frequent words, and for triples and quadruples whose pairs
are all frequent (a phrase is never more frequent than a part of it, so nothing that could count is lost). Each task
counts its shard's phrases, sorts them, and builds count transducers from them one phrase after the other: acyclic
automata over words, states with equal continuations and weights shared as soon as no later phrase can change them, the
weight of a phrase at the state that ends it. A task makes one transducer for each language and prefix range (a range
of the hash of the first two words, or of the only one, so that a frequent first word is spread over many ranges).
Transducers of one range meet in one group, where their union sums the weights; phrases under `LEAST` go there, as they
can be neither a candidate nor a part of one. The parts of candidates are looked up by composition: the distinct parts
of a range, themselves an automaton, are run together with the range's transducer.

What is frequent comes to the next reading as a bitmap of hashes: 16 bits a frequent phrase, 2^28 bits (32 MB) at most,
so its broadcast is bounded; a hash that collides lets a phrase be counted that the union drops again, never the other
way round.

Edge cases: a null text is an empty text; a null lang is 'und', as is the language of that name. Very long texts are
read whole (they are cut at spaces only). Repeated rows count each time. Ties in score go to the larger a, then to the
phrase in byte order. An empty table, and a table without a candidate, give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, mix64, ship, written

LEAST, LONGEST, TOP, COVER = 30, 4, 2000, 80
#: Bytes of text that a task counts at once, and phrases that it holds before they go out as transducers.
CHUNK, HELD = 8_000_000, 3_000_000
BITS_LEAST, BITS_MOST, BLOCK = 1 << 16, 1 << 28, 1 << 16
#: Candidates of a language that one task ranks, on average.
RANKED = 50_000
#: Pieces end at . , ; : ! ? and line breaks; words at spaces and tabs. 0xFF is no byte of UTF-8.
BREAK = b"\xff"
TABLE = bytes(255 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
SHARD_SCHEMA = "lang string, kind int, range int, fst binary"
RANGE_SCHEMA = "lang string, kind int, range int, fst binary, size long, total long, marks binary"
PRIME = np.uint64(0x100000001B3)


class Transducer:
    """A minimal acyclic automaton over words; every state has arcs (word, state) and a weight, 0 where no phrase ends."""

    def __init__(self, words: list[bytes], starts: np.ndarray, labels: np.ndarray, targets: np.ndarray, weights: np.ndarray):
        self.words, self.starts, self.labels, self.targets, self.weights = words, starts, labels, targets, weights

    @classmethod
    def build(cls, words: list[bytes], rows: np.ndarray, counts: np.ndarray) -> Transducer:
        """From phrases in ascending order (rows of numbers of words, -1 beyond a phrase's end), one run after the other.

        A run is neighbours that differ in their last word alone and go no further; its arcs are added together. When a
        run leaves the path of the one before, the states it leaves are finished: one that equals an earlier one is that one.
        """
        lengths = (rows >= 0).sum(axis=1)
        common = np.zeros(len(rows) + 1, np.int64)
        common[1:-1] = np.minimum(np.cumprod(rows[1:] == rows[:-1], axis=1).sum(axis=1), np.minimum(lengths[1:], lengths[:-1]))
        ends = common[1:] < lengths  # no later phrase goes on from it
        ends[-1:] = True
        final, state = np.unique(counts[ends], return_inverse=True)
        states = np.zeros(len(rows), np.int64)
        states[ends] = state
        same_run = ends[1:] & ends[:-1] & (lengths[1:] == lengths[:-1]) & (common[1:-1] == lengths[1:] - 1)
        first = np.flatnonzero(np.concatenate([[True], ~same_run]))
        flat = np.column_stack([rows[np.arange(len(rows)), lengths - 1], states]).ravel().tolist()
        register: dict[tuple, int] = {}
        arcs: list[tuple] = [()] * len(final)
        weights: list[int] = final.tolist()
        path: list[list[int]] = [[] for _ in range(LONGEST + 1)]
        weight = [0] * (LONGEST + 1)
        last: list[int] = []
        until = np.append(first[1:], len(rows)).tolist()
        for s, e, phrase, depth, same, end, count in zip(first.tolist(), until, rows[first].tolist(), lengths[first].tolist(), common[first].tolist(), ends[first].tolist(), counts[first].tolist()):
            top = depth - 1 if end else depth
            for d in range(len(last), min(same, top), -1):
                cls.finish(d, last, path, weight, register, arcs, weights)
            last = phrase[:top]
            if end:
                path[top] += flat[2 * s : 2 * e]
            else:
                weight[top] = count
        for d in range(len(last), 0, -1):
            cls.finish(d, last, path, weight, register, arcs, weights)
        arcs.append(tuple(path[0]))
        weights.append(0)
        starts = np.concatenate([[0], np.cumsum([len(x) // 2 for x in arcs])]).astype(np.int64)
        both = np.fromiter(chain.from_iterable(arcs), np.int64, int(starts[-1]) * 2).reshape(-1, 2)
        return cls(words, starts, both[:, 0], both[:, 1], np.array(weights, np.int64))

    @staticmethod
    def finish(d: int, last: list[int], path: list[list[int]], weight: list[int], register: dict[tuple, int], arcs: list[tuple], weights: list[int]) -> None:
        """Close the open state at depth d, as a new one or as its equal, and lead an arc to it."""
        key = (*path[d], weight[d])
        number = register.get(key)
        if number is None:
            number = register[key] = len(arcs)
            arcs.append(key[:-1])
            weights.append(weight[d])
        path[d - 1] += (last[d - 1], number)
        path[d], weight[d] = [], 0

    def to_bytes(self) -> bytes:
        words = b" ".join(self.words)
        head = np.array([len(words), len(self.weights), len(self.labels)], np.int64)
        narrow = lambda x: x.astype(np.uint32).tobytes()
        return head.tobytes() + narrow(self.starts) + narrow(self.labels) + narrow(self.targets) + self.weights.tobytes() + words

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        n_words, n_states, n_arcs = np.frombuffer(data, np.int64, 3).tolist()
        at, out = 24, []
        for n, t in ((n_states + 1, np.uint32), (n_arcs, np.uint32), (n_arcs, np.uint32), (n_states, np.int64)):
            out.append(np.frombuffer(data, t, n, at).astype(np.int64))
            at += n * np.dtype(t).itemsize
        words = data[at : at + n_words]
        return cls(words.split(b" ") if words else [], *out)

    def phrases(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length (phrases x words, weights) of what the automaton accepts, all paths at a time."""
        state, rows = np.array([len(self.weights) - 1]), np.zeros((1, 0), np.int64)
        while len(state):
            w = self.weights[state]
            if rows.shape[1]:
                yield rows[w > 0], w[w > 0]
            first, n = self.starts[state], self.starts[state + 1] - self.starts[state]
            arc = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            rows = np.column_stack([np.repeat(rows, n, axis=0), self.labels[arc]])
            state = self.targets[arc]

    def compose(self, parts: Transducer) -> dict[bytes, int]:
        """The weights of the phrases of another automaton: both are walked together, arc by arc with equal words."""
        number = {w: k for k, w in enumerate(self.words)}
        same = [number.get(w, -1) for w in parts.words]
        out: dict[bytes, int] = {}
        walk = [(len(self.weights) - 1, len(parts.weights) - 1, b"")]
        own: dict[int, dict[int, int]] = {}
        while walk:
            a, b, read = walk.pop()
            if parts.weights[b] and self.weights[a] and read:
                out[read] = int(self.weights[a])
            if a not in own:
                own[a] = dict(zip(self.labels[self.starts[a] : self.starts[a + 1]].tolist(), self.targets[self.starts[a] : self.starts[a + 1]].tolist()))
            for k in range(parts.starts[b], parts.starts[b + 1]):
                label = int(parts.labels[k])
                on = own[a].get(same[label])
                if on is not None:
                    walk.append((on, int(parts.targets[k]), read + b" " + parts.words[label] if read else parts.words[label]))
        return out


def sorted_build(words: list[bytes], by_length: list[tuple[np.ndarray, np.ndarray]]) -> Transducer:
    """A transducer of phrases given by length as (phrases x numbers of words, counts) in any order, each once; words ascend."""
    used = np.unique(np.concatenate([rows.ravel() for rows, _ in by_length]))
    widest = max(rows.shape[1] for rows, _ in by_length)
    wide = np.full((sum(len(rows) for rows, _ in by_length), widest), -1, np.int64)
    at = 0
    for rows, _ in by_length:
        wide[at : at + len(rows), : rows.shape[1]] = np.searchsorted(used, rows)
        at += len(rows)
    by = np.lexsort(wide.T[::-1])
    return Transducer.build([words[k] for k in used.tolist()], wide[by], np.concatenate([c for _, c in by_length])[by])


def in_order(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Words in ascending order, and the new number of each."""
    order = sorted(range(len(words)), key=words.__getitem__)
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    return [words[k] for k in order], place


def union(transducers: Iterator[bytes], least: int) -> tuple[Transducer | None, int]:
    """The sum of transducers without phrases of a weight below least, and the weight of all phrases before."""
    number: dict[bytes, int] = {}
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    held = 0
    for data in transducers:
        t = Transducer.from_bytes(data)
        own = np.array([number.setdefault(w, len(number)) for w in t.words], np.int64)
        for rows, weights in t.phrases():
            found.setdefault(rows.shape[1], []).append((own[rows], weights))
            held += len(rows)
        if held > HELD:  # sums in between, so that what is held follows the distinct phrases
            found = {n: [summed(parts)] for n, parts in found.items()}
            held = sum(len(p[0][0]) for p in found.values())
    total, kept = 0, []
    for parts in found.values():
        rows, weights = summed(parts)
        total += int(weights.sum())
        rows, weights = rows[weights >= least], weights[weights >= least]
        if len(rows):
            kept.append((rows, weights))
    words, place = in_order(list(number))
    return sorted_build(words, [(place[rows], weights) for rows, weights in kept]) if kept else None, total


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    rows, weights = np.concatenate([r for r, _ in parts]), np.concatenate([w for _, w in parts])
    by = np.lexsort(rows.T[::-1])
    rows, weights = rows[by], weights[by]
    new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]) if len(rows) else np.zeros(0, bool)
    return rows[new], np.add.reduceat(weights, np.flatnonzero(new)) if len(rows) else weights


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, all at once; equal in every task."""
    if not len(words):
        return np.zeros(0, np.uint64)
    words = words.cast(pa.large_binary())
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(words.to_pylist()), np.uint8).astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    powers = np.cumprod(np.full(max(1, int(lengths.max())), PRIME, np.uint64))
    return mix64(np.add.reduceat((data + np.uint64(1)) * powers[np.arange(len(data)) - np.repeat(first, lengths)], first))


def joined_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * np.uint64(0x9E3779B97F4A7C15) + b)


def lang_hash(lang: str) -> np.uint64:
    return word_hashes(pa.array([b"\xff" + lang.encode()], pa.binary()))[0]


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """The range of a prefix hash; ranges are equal stretches of all hashes."""
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


class Bitmap:
    """Hashes of frequent phrases as bits; a hash that is set may be another's."""

    def __init__(self, data: bytes):
        self.bits = np.frombuffer(data, np.uint8)
        self.mask = np.uint64(len(data) * 8 - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        p = h & self.mask
        return (self.bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


class Counter:
    """The phrases of one language that a task holds: numbers of words and counts, by length."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.held = 0

    def add(self, words: pa.Array, rows: np.ndarray, counts: np.ndarray) -> None:
        """rows: phrases x places in words."""
        if len(rows):
            used = np.unique(rows)
            own = np.array([self.number.setdefault(w, len(self.number)) for w in words.take(pa.array(used)).to_pylist()], np.int64)
            self.found.setdefault(rows.shape[1], []).append((own[np.searchsorted(used, rows)], counts))
            self.held += len(rows)

    def shrink(self) -> int:
        self.found = {n: [summed(p)] for n, p in self.found.items()}
        self.held = sum(len(p[0][0]) for p in self.found.values())
        return self.held

    def out(self, lang: str, kind: int, ranges: int) -> Iterator[tuple[str, int, int, bytes]]:
        """A transducer a range of what is held; then nothing is held."""
        self.shrink()
        words, place = in_order(list(self.number))
        h = word_hashes(pa.array(words, pa.binary()))
        parts: dict[int, list] = {}
        for rows, counts in ((place[p[0][0]], p[0][1]) for p in self.found.values()):
            at = range_of(joined_hash(h[rows[:, 0]], h[rows[:, 1]]) if rows.shape[1] > 1 else h[rows[:, 0]], ranges)
            by = np.argsort(at, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(at[by])) + 1):
                parts.setdefault(int(at[part[0]]), []).append((rows[part], counts[part]))
        for r, by_length in parts.items():
            yield lang, kind, r, sorted_build(words, by_length).to_bytes()
        self.__init__()


def tokens(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """The words of texts, with breaks between pieces, as places in the second result."""
    joined = BREAK.join(texts).translate(TABLE).replace(BREAK, b" \xff ")
    words = pc.split_pattern(pa.array([b"\xff " + joined + b" \xff"], pa.large_binary()), b" ").flatten()
    coded = words.filter(pc.greater(pc.binary_length(words), 0)).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def pairs_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (a, b), the number of each row's, and how often each comes."""
    width = int(b.max(initial=0)) + 1
    keys, inverse, counts = np.unique(a.astype(np.int64) * width + b, return_inverse=True, return_counts=True)
    return np.column_stack([keys // width, keys % width]), inverse, counts


def count_chunk(held: Counter, lang: str, kind: int, texts: list[bytes], one: Bitmap | None, two: Bitmap | None) -> None:
    """Count the phrases of a kind (1: words, 2: pairs, 3: three and four words) in texts of one language."""
    ids, words = tokens(texts)
    stop = words.index(pa.scalar(BREAK, words.type)).as_py()
    if kind == 1:
        counts = np.bincount(ids, minlength=len(words))
        keep = np.flatnonzero(np.arange(len(words)) != stop)
        held.add(words, keep[:, None], counts[keep])
        return
    h, seed = word_hashes(words), lang_hash(lang)
    ok = one.has(h ^ seed)
    ok[stop] = False
    ok = ok[ids]
    i = np.flatnonzero(ok[:-1] & ok[1:])
    pairs, pair, counts = pairs_of(ids[i], ids[i + 1])
    if kind == 2:
        held.add(words, pairs, counts)
        return
    often = two.has(joined_hash(h[pairs[:, 0]], h[pairs[:, 1]]) ^ seed)
    at = np.full(len(ids), -1, np.int64)  # the frequent pair that starts at each place
    at[i] = np.where(often[pair], pair, -1)
    i = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
    triples, triple, counts = pairs_of(at[i], at[i + 1])
    held.add(words, np.column_stack([pairs[triples[:, 0]], pairs[triples[:, 1]][:, 1]]) if len(triples) else np.zeros((0, 3), np.int64), counts)
    three = np.full(len(ids), -1, np.int64)
    three[i] = triple
    i = np.flatnonzero((three[:-1] >= 0) & (three[1:] >= 0))
    if len(i):
        fours, _, counts = pairs_of(three[i], at[i + 2])
        left = triples[fours[:, 0]]
        held.add(words, np.column_stack([pairs[left[:, 0]], pairs[left[:, 1]][:, 1], pairs[fours[:, 1]][:, 1]]), counts)


def shards(batches: Iterator[pa.RecordBatch], kind: int, ranges: int, one=None, two=None, chunk: int = CHUNK, most: int = HELD) -> Iterator[pa.RecordBatch]:
    """A task's count transducers; one, two: broadcast bitmaps of frequent words and pairs."""
    one, two = (Bitmap(x.value) if x else None for x in (one, two))
    held: dict[str, Counter] = {}
    texts: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def out(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.binary()))], names=["lang", "kind", "range", "fst"])

    def count(lang: str) -> Iterator[pa.RecordBatch]:
        count_chunk(held.setdefault(lang, Counter()), lang, kind, texts.pop(lang), one, two)
        size.pop(lang)
        if sum(c.held for c in held.values()) > most and sum(c.shrink() for c in held.values()) > most / 2:
            for x, c in held.items():
                for row in c.out(x, kind, ranges):
                    yield out([row])

    for b in batches:
        for lang, text in zip(b["lang"].to_pylist(), b["text"].cast(pa.binary()).to_pylist()):
            if text:
                texts.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] >= chunk:
                    yield from count(lang)
    for lang in list(texts):
        yield from count(lang)
    for lang, c in held.items():
        for row in c.out(lang, kind, ranges):
            yield out([row])


def range_marks(t: Transducer, lang: str) -> bytes:
    """Hashes of a transducer's words and pairs, for the bitmap."""
    h, seed = word_hashes(pa.array(t.words, pa.binary())), lang_hash(lang)
    marks = [h[rows[:, 0]] ^ seed if rows.shape[1] == 1 else joined_hash(h[rows[:, 0]], h[rows[:, 1]]) ^ seed for rows, _ in t.phrases() if rows.shape[1] < 3]
    return np.concatenate(marks).tobytes() if marks else b""


def united(least: int):
    """The union of one range's transducers, without phrases of a weight below least."""

    def f(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, kind, r = (k.as_py() for k in key)
        t, total = union((x for b in batches for x in b["fst"].to_pylist()), least)
        n = sum(len(w) for _, w in t.phrases()) if t else 0
        row = [lang, kind, r, t.to_bytes() if t else None, n, total, range_marks(t, lang) if t and kind < 3 else None]
        types = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([v], ty) for v, ty in zip(row, types)], names=["lang", "kind", "range", "fst", "size", "total", "marks"])

    return f


def bit_blocks(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """A task's part of the bitmap: blocks that have a bit set."""
    blocks: dict[int, np.ndarray] = {}
    for b in batches:
        for marks in b["marks"].to_pylist():
            p = np.unique(np.frombuffer(marks or b"", np.uint64) & np.uint64(bits - 1)).astype(np.int64)
            for part in np.split(p, np.flatnonzero(np.diff(p // BLOCK)) + 1) if len(p) else ():
                flags = blocks.setdefault(int(part[0] // BLOCK), np.zeros(BLOCK, bool))
                flags[part % BLOCK] = True
    for k, flags in blocks.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])


def block_union(t: pa.Table) -> pa.Table:
    return pa.table({"block": t["block"][:1], "bits": pa.array([np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in t["bits"].to_pylist()]).tobytes()], pa.binary())})


def bitmap(spark: SparkSession, ranges: DataFrame):
    """A broadcast bitmap of the marks of a table of ranges, of BITS_MOST bits at most."""
    n = ranges.agg(F.sum("size")).first()[0] or 0
    bits = min(BITS_MOST, max(BITS_LEAST, 1 << (16 * n).bit_length()))
    parts = ranges.where("size > 0").select("marks").mapInArrow(partial(bit_blocks, bits=bits), "block int, bits binary")
    data = bytearray(bits // 8)
    for row in parts.groupBy("block").applyInArrow(block_union, "block int, bits binary").collect():  # BITS_MOST bits at most
        data[row.block * BLOCK // 8 : (row.block + 1) * BLOCK // 8] = row.bits
    return spark.sparkContext.broadcast(bytes(data))


def count_transducers(docs: DataFrame, kind: int, ranges: int, least: int = LEAST, **more) -> DataFrame:
    """(lang, kind, range, fst, size, total, marks): for each language and range the transducer of its phrases of weight least or more; more: see shards()."""
    d = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    parts = d.mapInArrow(partial(shards, kind=kind, ranges=ranges, **more), SHARD_SCHEMA)
    return written(docs.sparkSession, parts.groupBy("lang", "kind", "range").applyInArrow(united(least), RANGE_SCHEMA), f"phrases{kind}")


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, words, phrase, a) of transducers."""
    for b in batches:
        for lang, data in zip(b["lang"].to_pylist(), b["fst"].to_pylist()):
            t = Transducer.from_bytes(data)
            for rows, weights in t.phrases():
                names = [b" ".join([t.words[k] for k in r]) for r in rows.tolist()]
                n = len(names)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([rows.shape[1]] * n, pa.int32()), pa.array(names, pa.binary()).cast(pa.string()), pa.array(weights)], names=["lang", "words", "phrase", "a"])


def routed(batches: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """Parts of phrases with the kind and range of the transducer that knows them."""
    for b in batches:
        parts = [x.split(b" ") for x in b["part"].cast(pa.binary()).to_pylist()]
        first, second = (word_hashes(pa.array([p[min(k, len(p) - 1)] for p in parts], pa.binary())) for k in (0, 1))
        n = np.array([len(p) for p in parts], np.int64)
        at = range_of(np.where(n > 1, joined_hash(first, second), first), ranges)
        yield pa.RecordBatch.from_arrays([b["lang"], pa.array(np.minimum(n, 3), pa.int32()), pa.array(at, pa.int32()), b["part"]], names=["lang", "kind", "range", "part"])


def looked_up(parts: pa.Table, known: pa.Table) -> pa.Table:
    """(lang, part, f): the distinct parts of one range, as an automaton, composed with its transducer."""
    found: dict[bytes, int] = {}
    if parts.num_rows and known.num_rows and known["fst"][0].is_valid:
        number: dict[bytes, int] = {}
        by: dict[int, list] = {}
        for p in parts["part"].cast(pa.binary()).to_pylist():
            ws = p.split(b" ")
            by.setdefault(len(ws), []).append([number.setdefault(w, len(number)) for w in ws])
        words, place = in_order(list(number))
        asked = sorted_build(words, [(place[np.array(rows)], np.ones(len(rows), np.int64)) for rows in by.values()])
        found = Transducer.from_bytes(known["fst"][0].as_py()).compose(asked)
    lang = parts["lang"][0].as_py() if parts.num_rows else None
    return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "part": pa.array(list(found), pa.binary()).cast(pa.string()), "f": pa.array(list(found.values()), pa.int64())})


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, cover: int = COVER, **held: int) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to four words; held: chunk and most of shards()."""
    spark = docs.sparkSession
    ship(spark)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * docs.rdd.getNumPartitions())
    words = count_transducers(docs, 1, ranges, least, **held)
    one = bitmap(spark, words)
    pairs = count_transducers(docs, 2, ranges, least, one=one, **held)
    two = bitmap(spark, pairs)
    longer = count_transducers(docs, 3, ranges, least, one=one, two=two, **held)
    known = words.select("lang", "kind", "range", "fst").unionByName(pairs.select("lang", "kind", "range", "fst")).unionByName(longer.select("lang", "kind", "range", "fst")).where("fst is not null")
    cand = written(spark, known.where("kind > 1").select("lang", "fst").mapInArrow(listed, "lang string, words int, phrase string, a long"), "candidates")
    # Every cut of every candidate; the counts of the parts by composition, each distinct part once.
    cut = cand.withColumn("w", F.split("phrase", " ")).select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "w", "words")
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    cut = written(spark, cut, "cuts")
    parts = cut.select("lang", F.col("first").alias("part")).union(cut.select("lang", "rest")).distinct()
    asked = parts.mapInArrow(partial(routed, ranges=ranges), "lang string, kind int, range int, part string")
    f = written(spark, asked.groupBy("lang", "kind", "range").cogroup(known.groupBy("lang", "kind", "range")).applyInArrow(looked_up, "lang string, part string, f long"), "parts")
    for name, part in (("l", "first"), ("r", "rest")):
        cut = cut.join(f.select("lang", F.col("part").alias(part), F.col("f").alias(name)).hint("shuffle_merge"), ["lang", part])
    score = F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    best = cut.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.*")
    # Contained in a longer candidate that is nearly as frequent: the most frequent one around each phrase decides.
    w = F.split("phrase", " ")
    around = cand.where("words > 2").select("lang", "a", "words", w.alias("w"), F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    around = around.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    around = around.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("phrase")).agg(F.max("a").alias("outer"))
    left = best.join(around.hint("shuffle_merge"), ["lang", "phrase"], "left").where(f"outer is null or 100 * cast(outer as decimal(20, 0)) < {cover} * cast(a as decimal(20, 0))")
    left = written(spark, left.select("lang", "phrase", "a", "l", "r", "score"), "scored")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rows = left.count()
    while rows > 2 * RANKED:  # the best of parts first, so that no task ranks a whole language
        deal = F.pmod(F.xxhash64("phrase"), F.lit(-(-rows // RANKED)))
        rank = F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))
        before, left = left, written(spark, left.withColumn("deal", deal).withColumn("rank", rank).where(F.col("rank") <= top).drop("deal", "rank"), "ranked")
        discard(before)
        was, rows = rows, left.count()
        if rows > was / 2:
            break
    n = words.groupBy("lang").agg(F.sum("total").alias("n"))
    ranked = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(n.hint("shuffle_merge"), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


_GRAM = " UNION ALL ".join(f"SELECT lang, {k} AS k, array_to_string(w[i:i + {k - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM p)" for k in range(1, LONGEST + 1))
_PIECES = "string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')"
ORACLE = f"""
WITH p AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest({_PIECES}) AS piece FROM documents)),
g AS ({_GRAM}),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= {LEAST}),
h AS MATERIALIZED (SELECT lang, phrase, f FROM f WHERE f >= {LEAST}),
u AS MATERIALIZED (SELECT lang, k, phrase, a, q, array_to_string(w[1:q], ' ') AS head, array_to_string(w[q + 1:], ' ') AS tail FROM (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS q FROM c)),
v AS MATERIALIZED (SELECT u.*, h.f AS l FROM u JOIN h ON h.lang = u.lang AND h.phrase = u.head),
s AS (SELECT v.lang AS lang, v.phrase AS phrase, v.k AS k, a, q, l, h.f AS r, 2000000 * CAST(a AS HUGEINT) // (l + h.f) AS score FROM v JOIN h ON h.lang = v.lang AND h.phrase = v.tail),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, q) AS rn FROM s) WHERE rn = 1),
o AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS outer_a FROM (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, a, w, k, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL),
d AS (SELECT b.* FROM b LEFT JOIN o ON b.lang = o.lang AND b.phrase = o.phrase WHERE outer_a IS NULL OR 100 * CAST(outer_a AS HUGEINT) < {COVER} * a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d)
SELECT r.lang AS lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM r JOIN n ON n.lang = r.lang WHERE rank <= {TOP}
"""
