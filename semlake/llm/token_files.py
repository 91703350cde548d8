"""Token-id files: Parquet with a list of ids per document, made for selective reads.

Documents are dealt by ranges of doc_id, so the files, by name, are in ascending order. Id lists are dictionary-encoded
(a token id takes two bytes or less), metadata columns are delta-encoded by the second writer version, row groups and
pages have set sizes and page indexes, so a read of metadata or of a range of documents touches only those pages.
Every row holds its file's number (`shard`) and the ids before it in that file; `starts` adds the files before,
`read_documents` and `read_range` read stretches of documents and of ids.

Edge cases: a null text is an empty text with only the end id; a null doc_id comes first; repeated rows and equal ids
all stay, ordered by their text; an empty table makes an empty file set; other columns are not kept.
"""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Remembered, small_batches, written

END_ID, ROW_GROUP, PAGE = 2, 4 << 20, 128 << 10
#: Characters of text to a file.
FILE_CHARS = 32_000_000
#: Files up to which their starts are broadcast; beyond, they are joined by a shuffle. Files to a step of the running sum.
BROADCAST_FILES, SHARDS = 100_000, 4096
#: Characters of a text by which equal ids are dealt.
TIE_CHARS = 8
#: Bytes of text that are encoded together.
BATCH = 6 << 20
SCHEMA = "shard long, doc_id long, local_start long, n_tokens long, ids array<int>"
#: A text may be cut before a space that follows a character that isn't white space: no token spans it.
CUT = re.compile(r"(?<=\S)(?= )")
#: White space as Python and the library see it, then a space.
SPACED = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "


#: Stands before a part that has no space before it in the text.
BARE = "\x01"
#: A mark after a letter, at a line break or a space: no token spans these places.
MARK = r"[!-/:-@\[-`{-~]"
BREAK, STOP = (rf"(\pL)({MARK}?)\n(\pL)", rf"\1 {BARE}\2 {BARE}" + "\n" + rf" {BARE}\3"), (rf"(\pL)({MARK}) ", rf"\1 {BARE}\2 ")


class Encoder:
    """The library's ids of whole texts, put together from words, marks and other stretches between spaces, which it remembers.

    Texts that hold an added token of the file go through the library whole, as it looks for these before all else."""

    def __init__(self, path: str, special_as_text: bool = False, most: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.most, self.known = most, {}
        self.line = int.from_bytes(self.encode_parts(["\n"])[0], "little")  # one token in such files; if not, nothing is cut at it
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # tokens that begin with a space
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True

    def encode_parts(self, parts: list[str]) -> list[bytes]:
        """The library's ids of each part, little-endian."""
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def encode_words(self, words: list[str], space: str) -> list[bytes]:
        """Ids of words of letters, each after a space, or each bare: many go through the library as one text.

        It is cut at the tokens that hold the space, or at the line breaks between bare words."""
        out = []
        for k in range(0, len(words), 200):
            some = words[k : k + 200]
            ids = np.array(self.tokenizer.encode_batch_fast([space + (space or "\n").join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            at = np.flatnonzero(self.spaced[ids] if space else ids == self.line)
            data = ids.tobytes()
            if space and len(at) == len(some):
                at = (4 * at).tolist()
                out += [data[i:j] for i, j in zip(at, [*at[1:], len(data)], strict=True)]
            elif not space and len(at) == len(some) - 1:
                at = (4 * at).tolist()
                out += [data[i:j] for i, j in zip([0, *[x + 4 for x in at]], [*at, len(data)], strict=True)]
            else:
                out += self.encode_parts([space + w for w in some])
        return out

    def learn(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts, each after a space that isn't written here unless it begins with BARE."""
        out = [b""] * len(parts)
        words = [i for i, p in enumerate(parts) if p.isalpha()]
        other = [i for i, p in enumerate(parts) if not p.isalpha()]
        bare = [i for i in other if parts[i][1:].isalpha() and parts[i][0] == BARE]
        odd = [i for i in other if not (parts[i][1:].isalpha() and parts[i][0] == BARE)]
        for which, ids in ((words, self.encode_words([parts[i] for i in words], " ")), (bare, self.encode_words([parts[i][1:] for i in bare], ""))):
            for i, x in zip(which, ids, strict=True):
                out[i] = x
        for k in range(0, len(odd), 4096):
            some = [parts[i] for i in odd[k : k + 4096]]
            for i, x in zip(odd[k : k + 4096], self.encode_parts([p[1:] if p[:1] == BARE else " " + p for p in some]), strict=True):
                out[i] = x
        return out

    def parts(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts, from memory where they are known."""
        out = list(map(self.known.get, parts))
        lacking = [i for i, x in enumerate(out) if x is None]
        if lacking:
            if len(self.known) + len(lacking) > self.most:  # start afresh with what is in use
                self.known = {p: x for p, x in zip(parts, out, strict=True) if x is not None}
            new = [parts[i] for i in lacking]
            ids = self.learn(new)
            self.known.update(zip(new, ids, strict=True))
            for i, x in zip(lacking, ids, strict=True):
                out[i] = x
        return out

    def __call__(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with `end` after it, and the number of each text's ids."""
        whole = np.zeros(len(texts), dtype=bool)
        for s in self.added:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        spaced = pc.or_(pc.match_substring_regex(texts, SPACED), pc.match_substring(texts, BARE)).to_numpy(zero_copy_only=False)
        plain = texts if not (whole | spaced).any() else pc.if_else(pa.array(whole | spaced), "", texts)
        for pattern, then in (BREAK, STOP):
            plain = pc.replace_substring_regex(plain, pattern, then)
        split = pc.split_pattern(plain, " ")
        flat = split.flatten().dictionary_encode()
        codes, at = flat.indices.to_numpy().astype(np.int64), split.offsets.to_numpy().astype(np.int64)
        names = flat.dictionary.to_numpy(zero_copy_only=False).tolist()  # far faster than to_pylist
        # Each text's first part has no space before it, and texts with white space before a space are cut by hand.
        heads = [names[c] for c in codes[at[:-1]].tolist()]
        size, where, more = np.diff(at), [], []
        for i in np.flatnonzero(whole | spaced).tolist():
            text = texts[i].as_py()
            heads[i], *rest = [text] if whole[i] else CUT.split(text)
            size[i] += len(rest)
            where += [at[i + 1]] * len(rest)
            more += [BARE + x if x[1:2] == BARE else x[1:] for x in rest]
        ids = [*self.parts(names), *self.parts(more), *self.encode_parts(heads), end]
        codes[at[:-1]] = len(names) + len(more) + np.arange(len(heads))
        codes = np.insert(codes, where, len(names) + np.arange(len(more))) if more else codes
        codes = np.insert(codes, np.cumsum(size), len(ids) - 1)
        length = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        n = length[codes]
        stop = np.concatenate([[0], np.cumsum(n)])
        out = np.frombuffer(b"".join(ids), dtype="<u4")[np.repeat((np.cumsum(length) - length)[codes] - stop[:-1], n) + np.arange(stop[-1])]
        last = np.cumsum(size + 1)
        return out, stop[last] - stop[last - size - 1]


def larger(batches, size: int = BATCH):
    """Batches put together to about `size` bytes, as stretches are looked up once a batch."""
    held, n = [], 0
    for b in batches:
        if held and n + b.nbytes > size:
            yield pa.concat_batches(held)
            held, n = [], 0
        held.append(b)
        n += b.nbytes
    if held:
        yield pa.concat_batches(held)


_encoders = Remembered(lambda key: Encoder(*key), most=4)


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID, file_chars: int = FILE_CHARS, special_as_text: bool = False, row_group: int = ROW_GROUP) -> None:
    """Encode every text and write its ids, in ascending doc_id order, below path.

    special_as_text: whether the strings of the file's added tokens are ordinary text; by default, as the library has it,
    they give those tokens' ids."""
    spark = docs.sparkSession
    small_batches(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    files = max(1, round((d.agg(F.sum(F.length("text"))).first()[0] or 0) / file_chars))

    def run(batches):
        encode, shard, at = _encoders[tokenizer_path, special_as_text], TaskContext.get().partitionId(), 0
        end = int(end_id).to_bytes(4, "little")
        gc.disable()  # no cycles here, and millions of small objects to walk
        for b in larger(batches):
            ids, n = encode(b.column(1), end)
            before = at + np.cumsum(n) - n
            at += int(n.sum())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids.view("<i4")))
            yield pa.record_batch([pa.array(np.full(len(n), shard, dtype=np.int64)), b.column(0), pa.array(before), pa.array(n), lists], names=["shard", "doc_id", "local_start", "n_tokens", "ids"])

    # Equal ids go by text; its start and the row's place deal them to several files if they are many.
    order = [F.col("doc_id").asc_nulls_first(), F.substring("text", 1, TIE_CHARS)]
    ordered = d.repartitionByRange(files, *order, F.monotonically_increasing_id()).sortWithinPartitions(order[0], "text")
    writer = ordered.mapInArrow(run, SCHEMA).write.option("compression", "zstd").option("parquet.block.size", row_group).option("parquet.page.size", PAGE)
    writer.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "true").option("parquet.enable.dictionary#doc_id", "false").option("parquet.enable.dictionary#local_start", "false").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, base, size): the ids in all files before, and in it; reads metadata columns only. A running sum by two levels."""
    sizes = read_tokens(spark, path).groupBy("shard").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("size"))
    sizes = sizes.withColumn("some", F.expr(f"shard div {SHARDS}"))
    above = sizes.groupBy("some").agg(F.sum("size").alias("sum"))  # a row for every SHARDS files
    above = above.select("some", (F.sum("sum").over(Window.orderBy("some")) - F.col("sum")).alias("above"))
    within = F.sum("size").over(Window.partitionBy("some").orderBy("shard")) - F.col("size")
    return sizes.withColumn("within", within).join(above.hint("shuffle_merge"), "some").select("shard", (F.col("above") + F.col("within")).alias("base"), "size")


def read_documents(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The documents with first <= doc_id <= last: a filter that the row groups' and pages' least and largest ids answer."""
    return read_tokens(spark, path).where(F.col("doc_id").between(first, last))


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(doc_id, start, ids): the ids at places start <= place < stop of all ids in a row, cut at the ends.

    Which files these are in is read from metadata; of each, only the rows that overlap are."""
    base = [r for r in starts(spark, path).where((F.col("base") < stop) & (F.col("base") + F.col("size") > start)).collect()]  # a row a file asked for
    found = [read_tokens(spark, path).where(f"shard = {r.shard} and local_start < {stop - r.base} and local_start + n_tokens > {start - r.base}").withColumn("start", F.col("local_start") + r.base) for r in base]
    rows = read_tokens(spark, path).where("false").withColumn("start", F.lit(0).cast("long"))
    for f in found:
        rows = rows.union(f)
    skip = F.greatest(F.lit(start) - F.col("start"), F.lit(0)).cast("int")
    take = (F.least(F.lit(stop) - F.col("start"), F.col("n_tokens")) - skip).cast("int")
    return rows.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("ids", skip + 1, take).alias("ids"))


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    small_batches(spark, 500)

    def run(batches):
        for b in batches:
            ids = b.column(3)
            flat, at = ids.flatten().to_numpy().astype("<u4"), np.concatenate([[0], np.cumsum(b.column(4).to_numpy())])
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(at[1:] - at[:-1]), pa.array(crc, pa.int64())], names=["shard", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).select("shard", "doc_id", "local_start", "ids", F.size("ids").cast("long").alias("n"))
    rows = rows.mapInArrow(run, "shard long, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    base = written(spark, starts(spark, path), "starts")
    few = base.count() <= BROADCAST_FILES
    rows = rows.join(F.broadcast(base) if few else base.hint("shuffle_merge"), "shard")
    return rows.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
