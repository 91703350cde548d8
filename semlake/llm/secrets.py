"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

The models give the chance of each character after the two before it. They are trained from labelled samples: ordinary
are words that the corpus holds twice or more (at most WORDS different ones, those with the least hash), other such
tokens of it that the patterns leave (as many), and identifiers made of such words (snake, camel, kebab and upper case, with numbers); random are
values that the patterns find (at most FOUND) and strings drawn evenly from the usual alphabets. Half of either
sample is held out. A token of MIN_TOKEN characters or more that lies outside the patterns' spans is a secret if the
log-likelihood ratio of the models, summed over it, is above the cutoff for its length: what the ratio must be before a
secret is likelier than not if one token in exp(PRIOR) is one (so few, for the sake of languages that the samples lack), and above SHARE of the held-out ordinary tokens of like length.
Every text is searched whole, so every token is scored; short ones seldom reach the cutoff.

Edge cases: a null or empty text has no spans; offsets count code points; rows are judged one by one, so repeated rows,
equal ids, extra columns and very long texts need no care; an empty table gives an empty result; without ordinary words
the models mark nothing.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, written

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Which texts can match at all, asked of a whole batch by a linear-time engine.
ANY = r"(?i:password|passwd|secret|token|api_?key)[\"']? *[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"
MIN_TOKEN, PRIOR, SHARE, WORDS, FOUND = 8, 24.0, 0.9995, 20_000, 5_000
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
KINDS = ("assign", "access", "hex", "model")
#: Letters, digits and marks of tokens, then one class for the rest.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
N = len(ALPHABET)
CLASS = np.full(256, N, dtype=np.int64)
CLASS[np.frombuffer(ALPHABET.encode(), dtype=np.uint8)] = np.arange(N)
LOWER, UPPER, DIGITS = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
ALPHABETS = (LOWER + UPPER + DIGITS, LOWER + UPPER + DIGITS + "-_", LOWER + UPPER + DIGITS + "+/", LOWER + DIGITS, UPPER + DIGITS, LOWER + UPPER, LOWER, DIGITS + "abcdef")
#: Words that identifiers are often made of, whatever the language of the corpus.
COMMON = """
access account action add address admin alias allow append array async attribute auth back background base batch before
begin binary block body bool branch browser buffer build button bytes cache call category change channel char check child
class clear client close code column command commit common compare config connect console content context copy count
create current cursor data date debug decode default delete delta depth device disable display document domain driver edit
element email empty enable encode endpoint entry error event exception execute export extract factory field file filter
first flag float folder format frame function generate global graph group handle hash header height hidden host icon image
import init inner input insert instance integer interface internal invalid iterator java label language last layer layout
length level library line link list load local lock login logger lower main manager matrix memory merge message method
mode model module mouse name network node null number object offset online open operation option order output owner
package page parent parse path pattern payload permission player plugin point policy pool port position prefix print
process product profile project property protocol provider public
""".split()
#: Lengths from which a cutoff of its own holds.
LENGTHS = (8, 10, 12, 16, 24, 40)


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the fixed patterns."""
    found = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def sampled(docs: DataFrame) -> tuple[list[str], list[str], list[str]]:
    """Words, other tokens and values of the patterns: of each the ones with the least hash in the whole corpus."""
    small_batches(docs.sparkSession)
    most = (WORDS, WORDS, FOUND)

    digest = xxhash.xxh3_64_intdigest

    def run(batches):
        held: list[dict[str, int]] = [{}, {}, {}]  # how often each was seen
        bound = [1 << 64] * 3

        def add(k: int, x: str, n: int = 1) -> None:
            if digest(x) < bound[k]:
                held[k][x] = held[k].get(x, 0) + n
                if len(held[k]) > 4 * most[k]:  # those with the least hash stay, so the counts of what is left in the end are whole
                    held[k] = dict(sorted(held[k].items(), key=lambda e: digest(e[0]))[: 2 * most[k]])
                    bound[k] = max(map(digest, held[k]))

        for b in batches:
            texts = pc.fill_null(b.column(0), "")
            maybe = pc.match_substring_regex(texts, ANY)
            for t in texts.filter(maybe).to_pylist():
                at = 0
                for start, _, stop, value in base_spans(t):
                    add(2, t[value:stop])
                    for m in TOKEN.finditer(t, at, max(at, start)):  # what lies between is ordinary
                        add(1, m[0])
                    at = max(at, stop)
            seen = pc.value_counts(pc.ascii_split_whitespace(texts.filter(pc.invert(maybe))).flatten())
            for w, n in zip(seen.field(0).to_numpy(zero_copy_only=False).tolist(), seen.field(1).to_pylist(), strict=True):
                x = w.strip(".,;:!?()[]{}\"'")
                if x.isascii() and x.isalpha():
                    add(0, x.lower(), n)
                elif len(x) >= MIN_TOKEN:
                    for m in TOKEN.finditer(x):
                        add(1, m[0], n)
        for k in range(3):
            some = sorted(held[k], key=digest)[: 2 * most[k]]
            hashes = np.array(list(map(digest, some)), dtype=np.uint64) ^ np.uint64(1 << 63)  # in order as signed numbers
            yield pa.record_batch([pa.array([k] * len(some), pa.int32()), pa.array(some, pa.string()), pa.array(hashes.view(np.int64)), pa.array([held[k][x] for x in some], pa.int64())], names=["kind", "x", "h", "n"])

    every = docs.select(F.col("text").cast("string")).mapInArrow(run, "kind int, x string, h long, n long").groupBy("kind", "x", "h").agg(F.sum("n").alias("n"))
    every = written(docs.sparkSession, every.where("kind = 2 or n > 1"), "samples")  # a secret that the patterns miss is seldom met twice
    known = {r.kind: r.n for r in every.groupBy("kind").agg(F.count("*").alias("n")).collect()}  # three rows
    out = []
    for k, n in enumerate(most):
        own = every.where(F.col("kind") == k)
        if known.get(k, 0) > n:  # by a quantile, so that the driver gets about n rows, however many tasks there are
            own = own.where(F.col("h") <= own.agg(F.percentile_approx("h", n / known[k], 100_000)).first()[0])
        out.append([x for _, x in sorted((r.h, r.x) for r in own.select("h", "x").collect())[:n]])
    discard(every)
    return tuple(out)


def identifiers(words: list[str], n: int, seed: int = 1) -> list[str]:
    """n identifiers made of words, half of them of the common ones, and long numbers."""
    rnd, out = random.Random(seed), []
    for _ in range(n if words else 0):
        if rnd.random() < 0.05:
            out.append(str(rnd.randint(10**7, 10**20)))
            continue
        some = rnd.choices(rnd.choice((words, COMMON)), k=rnd.randint(1, 4))
        number = str(rnd.randint(0, 10 ** rnd.randint(1, 4))) if rnd.random() < 0.4 else ""
        style = rnd.randrange(6)
        if style == 0:
            out.append("_".join([*some, *[number] * bool(number)]))
        elif style == 1:
            out.append(some[0] + "".join(w.capitalize() for w in some[1:]) + number)
        elif style == 2:
            out.append("".join(w.capitalize() for w in some) + number)
        elif style == 3:
            out.append("_".join(some).upper() + number)
        else:
            out.append("-/"[style - 4].join([*some, *[number] * bool(number)]))
    return out


def random_strings(n: int, seed: int = 2) -> list[str]:
    rnd = random.Random(seed)
    return ["".join(rnd.choices(rnd.choice(ALPHABETS), k=rnd.randint(8, 64))) for _ in range(n)]


def trigrams(strings: list[str]) -> np.ndarray:
    """Counts of (two before, one before, character), with class N before each string's start."""
    c = CLASS[np.frombuffer(("\n\n" + "\n\n".join(strings)).encode("ascii", "replace"), dtype=np.uint8)]
    c = c if len(c) > 2 else np.full(3, N)
    flat = (c[:-2] * (N + 1) + c[1:-1]) * (N + 1) + c[2:]
    return np.bincount(flat, minlength=(N + 1) ** 3).reshape(N + 1, N + 1, N + 1)[..., :N].astype(float)


def chances(n: np.ndarray, weight: float = 4.0) -> np.ndarray:
    """Log of p(character | two before), each order smoothed by the one below."""
    one = n.sum(axis=(0, 1)) + 0.5
    one /= one.sum()
    two = n.sum(axis=0)
    two = (two + weight * one) / (two.sum(axis=-1, keepdims=True) + weight)
    return np.log((n + weight * two) / (n.sum(axis=-1, keepdims=True) + weight))


class Models:
    """ratio: log-likelihood ratio, random over ordinary, of a character after two; cuts: by length class."""

    def __init__(self, words: list[str], tokens: list[str], found: list[str]):
        even = lambda xs, k: xs[k::2]
        drawn = random_strings(2 * FOUND)
        self.ratio = chances(trigrams([*even(found, 0), *drawn])) - chances(trigrams([*even(words, 0), *even(tokens, 0), *identifiers(even(words, 0), len(words))]))
        held = [x for x in [*even(words, 1), *even(tokens, 1), *identifiers(even(words, 1), len(words), 3)] if len(x) >= MIN_TOKEN]
        score, size = self.scores(held), np.array(list(map(len, held)), dtype=np.int64)
        kind = np.searchsorted(LENGTHS, size, side="right")
        self.cuts = np.array([max(PRIOR, np.quantile(score[kind == k], SHARE) if (kind == k).any() else 0) if words else np.inf for k in range(len(LENGTHS) + 1)])

    def scores(self, strings: list[str]) -> np.ndarray:
        return np.array([self.spans(x.encode(), 1, -np.inf)[2][0] for x in strings]) if strings else np.zeros(0)

    def spans(self, data: bytes, least: int = MIN_TOKEN, cut=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, score) of the tokens in data whose score is above the cutoff."""
        c = CLASS[np.frombuffer(b"\n\n" + data + b"\n", dtype=np.uint8)]
        edge = np.flatnonzero(np.diff((c != N).astype(np.int8)))
        start, end = edge[::2] + 1, edge[1::2] + 1
        long = end - start >= least
        start, end = start[long], end[long]
        if not len(start):
            return start, end, np.zeros(0)
        # Positions of the long tokens only, each with the two classes before it (N before the token's start).
        size = end - start
        first = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(start - first, size)
        b, a = c[at - 1], c[at - 2]
        b[first] = a[first] = N
        a[first + 1 if least > 1 else first[size > 1] + 1] = N
        score = np.add.reduceat(self.ratio[a, b, c[at]], first)
        ok = score > (self.cuts[np.searchsorted(LENGTHS, size, side="right")] if cut is None else cut)
        return start[ok] - 2, end[ok] - 2, score[ok]


def train(docs: DataFrame) -> Models:
    """The models of a corpus, from its bounded samples."""
    return Models(*sampled(docs))


def model_spans(texts: list[str], models: Models) -> dict[int, list[tuple[int, int, int, int]]]:
    """Per text that has any: the tokens above the cutoff, in code points."""
    out: dict[int, list] = {}
    k = 0
    while k < len(texts):  # about two megabytes, or one longer text, at a time
        some, size = [], 0
        while k + len(some) < len(texts) and (not some or size < 2 << 20):
            some.append(texts[k + len(some)].encode())
            size += len(some[-1]) + 1
        begin = np.cumsum([0] + [len(x) + 1 for x in some])
        start, end, _ = models.spans(b"\n".join(some))
        for s, e, i in zip(start.tolist(), end.tolist(), (np.searchsorted(begin, start, side="right") - 1).tolist(), strict=True):
            at = len(some[i][: s - begin[i]].decode())
            out.setdefault(k + i, []).append((at, 3, at + e - s, at))
        k += len(some)
    return out


def apart(model: list, base: list) -> list:
    """The model's spans that touch no span of the patterns."""
    return [m for m in model if all(m[2] <= b[0] or b[2] <= m[0] for b in base)]


def listed(spans: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


def find_secrets(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model) of every text."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(models or train(docs))  # of fixed size
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"]

    def run(batches):
        for b in batches:
            column = pc.fill_null(b.column(1), "")
            texts = column.to_pylist()
            base = {i: base_spans(texts[i]) for i in np.flatnonzero(pc.match_substring_regex(column, ANY).to_numpy(zero_copy_only=False)).tolist()}
            further = model_spans(texts, held.value)
            rows = []
            for i in range(len(texts)):
                own = base.get(i, [])
                model = apart(further[i], own) if i in further else []
                rows.append((*[sum(s[1] == k for s in own) for k in range(3)], hashlib.sha256(listed(own).encode()).hexdigest(), listed(sorted(own + model)), len(model)))
            yield pa.record_batch([b.column(0), *[pa.array([r[k] for r in rows], pa.string() if k in (3, 4) else pa.int64()) for k in range(6)]], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long")
