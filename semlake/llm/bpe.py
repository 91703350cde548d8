"""Byte-level BPE by a segment tree over byte positions.

The tree's leaf at a byte position holds the rank of the pair that starts there; its root is the leftmost minimum.
A merge changes three leaves (the merged part, its live left neighbour, the part that is gone), each with a
logarithmic walk to the root, so a piece of n bytes takes O(n log n) whatever it holds. Pieces of like length are
merged side by side in numpy; those of more than LONG bytes one by one, in flat arrays of 28 bytes a byte of the piece.

Edge cases: a null text is an empty text (no ids, decoded to no bytes); repeated rows and equal ids give one row each;
an empty table gives an empty result; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import string
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Remembered, small_batches

NONE = np.int64(2**62)
#: Pieces beyond this length are merged alone.
LONG = 256
#: A text may be cut before a space that follows a character that isn't white space: no match of the pattern spans it.
CUT = re.compile(r"(?<=\S)(?= )")
SPACED = re.compile(r"\s ")


class Ranks:
    """Ranks of a vocabulary, and of every pair of its entries whose join is an entry too."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.entries = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            self.entries[v] = k
        pairs = sorted((ranks[k[:i]] << 32 | ranks[k[i:]], v) for k, v in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks)
        self.pairs = np.array([p for p, _ in pairs] + [NONE], dtype=np.int64)
        self.merged = np.array([v for _, v in pairs] + [0], dtype=np.int64)
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)

    @classmethod
    def read(cls, path: str) -> Ranks:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())})

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each joined pair, NONE where the join is no entry."""
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.merged[at], NONE)

    def merge(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids (little-endian uint32) of pieces of at most `width` (a power of two) bytes, all trees advancing together."""
        n, place = len(pieces), np.arange(width)
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        data = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), dtype=np.uint8).reshape(n, width)
        ids = np.full((n, width + 1), -1)  # one past the end: no neighbour
        ids[:, :-1] = np.where(place < size[:, None], self.single[data], -1)
        after = np.tile(np.minimum(np.arange(1, width + 2), width), (n, 1))
        before = np.tile(np.concatenate([[width], np.arange(width)]), (n, 1))
        tree = np.full((n, 2 * width), NONE)
        tree[:, width:] = self.keyed(ids[:, :-1], ids[:, 1:], place, width)
        for k in range(width - 1, 0, -1):
            tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            root = tree[live, 1]
            at, rank = root % width, root // width
            gone = after[live, at]
            then = after[live, gone]
            ids[live, at] = rank
            ids[live, gone] = -1
            after[live, at] = then
            before[live, then] = at
            left = before[live, at]
            self.set(tree, live, gone, NONE, width)
            self.set(tree, live, at, self.keyed(rank, ids[live, then], at, width), width)
            has = left < width
            some, left = live[has], left[has]
            self.set(tree, some, left, self.keyed(ids[some, left], rank[has], left, width), width)
            live = live[tree[live, 1] < NONE]
        kept = ids >= 0
        flat = ids[kept].astype("<u4").tobytes()
        ends = (4 * kept.sum(axis=1).cumsum()).tolist()
        return [flat[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def keyed(self, left, right, place, width):
        """Rank and place in one number, so that the least is the leftmost of the least rank."""
        rank = self.rank(left, right)
        return np.where(rank < NONE, rank * width + place, NONE)

    @staticmethod
    def set(tree, rows, place, value, width):
        k = place + width
        tree[rows, k] = value
        while width > 1:
            k = k >> 1
            tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])
            width >>= 1

    def merge_long(self, piece: bytes) -> bytes:
        """Ids (little-endian uint32) of one piece of any length, by a tree of its own; a walk ends where nothing changes."""
        n, none = len(piece), int(NONE)
        ids = np.append(self.single[np.frombuffer(piece, dtype=np.uint8)], -1)
        tree = np.full(2 * n, NONE)
        tree[n:] = self.keyed(ids[:-1], ids[1:], np.arange(n), n)
        end = n
        while end > 1:
            start = (end + 1) // 2
            tree[start:end] = np.minimum(tree[2 * start : 2 * end : 2], tree[2 * start + 1 : 2 * end : 2])
            end = start
        tree, ids = array("q", tree.tobytes()), array("i", ids.astype(np.int32).tobytes())
        after, before = array("i", range(1, n + 2)), array("i", range(-1, n))
        entries, rank_of = self.entries, self.ranks.get

        def put(place, left, right):
            rank = rank_of(entries[left] + entries[right]) if left >= 0 and right >= 0 else None
            k, value = place + n, none if rank is None else rank * n + place
            while tree[k] != value:
                tree[k] = value
                if k == 1:
                    break
                other = tree[k ^ 1]
                k >>= 1
                if other < value:
                    value = other

        while (root := tree[1]) < none:
            rank, at = divmod(root, n)
            gone = after[at]
            then = after[at] = after[gone]
            ids[at], ids[gone], before[then] = rank, -1, at
            put(gone, -1, -1)
            put(at, rank, ids[then])
            if (left := before[at]) >= 0:
                put(left, ids[left], rank)
        found = np.frombuffer(ids, dtype=np.int32)
        return found[found >= 0].astype("<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece: its own entry if it has one, else by merges."""
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(p) > LONG:
                out[i] = self.merge_long(p)
            else:
                by_width.setdefault(1 << max(0, len(p) - 1).bit_length(), []).append(i)
        for width, which in by_width.items():
            step = max(1, (1 << 18) // width)
            for k in range(0, len(which), step):
                for i, ids in zip(which[k : k + step], self.merge([pieces[i] for i in which[k : k + step]], width), strict=True):
                    out[i] = ids
        return out


class Codec:
    """Encodes and decodes whole texts; remembers the ids of pieces and of stretches between spaces."""

    def __init__(self, ranks: Ranks, pattern: str, most: int = 500_000):
        self.ranks, self.pattern, self.most = ranks, regex.compile(pattern), most
        self.heads: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def stretches(self, text: str) -> list[str]:
        """The text cut at single spaces where no match of the pattern can span the cut; each part but the first has lost its space."""
        if not SPACED.search(text):
            return text.split(" ")
        head, *rest = CUT.split(text)
        return [head, *[x[1:] for x in rest]]

    def split(self, space: str, part: str) -> list[str]:
        """The pattern's matches; letters, or letters and one ASCII punctuation mark, need no search."""
        if part.isalpha():
            return [space + part]
        if part[:-1].isalpha() and part[-1] in string.punctuation:
            return [space + part[:-1], part[-1]]
        return self.pattern.findall(space + part)

    def learn(self, known: dict[str, bytes], parts: set[str], space: str) -> None:
        """Ids of parts not known yet, as little-endian unsigned 32-bit integers."""
        found = [(part, self.split(space, part)) for part in parts]
        lacking = list({p for _, ps in found for p in ps} - self.pieces.keys())
        if len(self.pieces) + len(lacking) > self.most:
            self.pieces.clear()
            lacking = list({p for _, ps in found for p in ps})
        self.pieces.update(zip(lacking, self.ranks.encode_pieces([p.encode() for p in lacking]), strict=True))
        get = self.pieces.__getitem__
        for part, ps in found:
            known[part] = get(ps[0]) if len(ps) == 1 else b"".join(map(get, ps))

    def need(self, known: dict[str, bytes], parts: set[str], space: str) -> None:
        lacking = parts - known.keys()
        if len(known) + len(lacking) > self.most:
            known.clear()
            lacking = parts
        if lacking:
            self.learn(known, lacking, space)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.stretches(t) for t in texts]
        self.need(self.heads, {parts[0] for parts in split}, "")
        self.need(self.known, set().union(*[parts[1:] for parts in split]), " ")
        get = self.known.__getitem__
        return [self.heads[parts[0]] + b"".join(map(get, parts[1:])) for parts in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.ranks.entries.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_codecs = Remembered(lambda key: Codec(Ranks.read(key[0]), key[1]), most=4)


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary: little-endian uint32, decoded binary) of every text; no shuffle, one pass."""
    small_batches(docs.sparkSession)

    def run(batches):
        codec = _codecs[ranks_path, pattern]
        gc.disable()  # no cycles here, and millions of small objects to walk
        for b in batches:
            ids = codec.encode([x or "" for x in b.column(1).to_pylist()])
            yield pa.record_batch([b.column(0), pa.array(ids, pa.binary()), pa.array(map(codec.decode, ids), pa.binary())], names=[id_col, "ids", "decoded"])

    d = docs.select(id_col, docs[text_col].cast("string").alias("text"))
    return d.mapInArrow(run, f"{id_col} {dict(d.dtypes)[id_col]}, ids binary, decoded binary")


def bpe_digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, the digests taken where the ids are made."""
    small_batches(docs.sparkSession)

    def run(batches):
        codec = _codecs[ranks_path, pattern]
        gc.disable()  # no cycles here, and millions of small objects to walk
        sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
        for b in batches:
            ids = codec.encode([x or "" for x in b.column(1).to_pylist()])
            yield pa.record_batch([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), sha(ids), sha(map(codec.decode, ids))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs.doc_id.cast("long").alias("doc_id"), docs.text.cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
