"""Packing tokenised documents into fixed windows: concatenate and cut."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, materialize, small

#: Words, and pieces of words, whose ids a worker remembers twice over: a full table is kept as the older one until the next is full.
REMEMBERED = 450_000
#: Texts with other characters are left to the tokenizer: for these its lower case, white space and character classes agree with Python's.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u017f]*")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+|\n")
#: What a tokenizer has to agree on before it is used word by word: cases, contractions, digits, marks, lines, joined and doubled white space.
_PROBE = ("Don't stop, we'RE  here\n\tat 10.5% (or 3)!", "a_b-c--d \u00e9\u00dc\u0131'S x1y22 ...\"q\"", "\n\n one\r\ntwo\u00b0 #tag@home http://a.b/c?d=e&f", "supercalifragilistic ZZZZ \u017f\u0131 'll' 'tis")
#: Parts the ids of texts and words in a row; no four bytes of 32-bit ids look like it, whatever the alignment.
_BREAK = b"\xff\xff\xff\xff"


class Memory:
    """Ids by name, for about the names used last."""

    def __init__(self, mark: str):
        self.mark, self.old, self.now = mark, {}, {mark: _BREAK}

    def missing(self, names: set[str]) -> set[str]:
        if len(self.now) + len(names) > REMEMBERED:
            self.old, self.now = self.now, {self.mark: _BREAK}
        new = names - self.now.keys()
        back = new & self.old.keys()
        self.now.update(zip(back, map(self.old.__getitem__, back)))
        return new - back

    def join(self, names: list[str]) -> list[bytes]:
        return b"".join(map(self.now.__getitem__, names)).split(_BREAK)


class WordEncoder:
    """Ids of texts, as little-endian unsigned 32-bit numbers, from a tokenizers file that lower-cases and drops white space.

    Such a tokenizer never joins what white space parts, so the ids of a text are those of its words in a row, and the ids
    of a word those of its pieces (letters, single digits, other characters). Each is encoded once while it is remembered;
    new pieces are encoded together, parted by spaces. A text with characters outside _PLAIN, or with what could be a
    special token, is encoded as a whole. So is every text if the file's tokenizer is of another kind: if it differs on a
    probe, or parts words otherwise.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # For pieces that are cut and lower-cased already: their model alone.
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.bare.model._resize_cache(0)
        self.words, self.pieces = Memory("\0"), Memory("\n")
        self.by_word = True
        try:
            self.by_word = self(list(_PROBE)) == [self.whole(t) for t in _PROBE]
        except Exception:  # the pieces of another kind of tokenizer do not fit together
            self.by_word = False

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, new: list[str]) -> None:
        cut = _PIECES.findall("\n".join(new).lower())
        names = list(self.pieces.missing(set(cut)))
        for low in range(0, len(names), 2000):
            some = names[low : low + 2000]
            coded = self.bare.encode(" ".join(some), add_special_tokens=False)
            ids = np.array(coded.ids, "<u4").tobytes()
            ends = (np.searchsorted(np.array(coded.word_ids), np.arange(len(some)), side="right") * 4).tolist()
            self.pieces.now.update(zip(some, map(ids.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        self.words.now.update(zip(new, self.pieces.join(cut), strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        plain = [self.by_word and bool(_PLAIN.fullmatch(t)) and "<|" not in t for t in texts]
        flat = " \0 ".join(t for t, p in zip(texts, plain, strict=True) if p).split()
        new = self.words.missing(set(flat))
        if new:
            self.learn(list(new))
        done = iter(self.words.join(flat))
        return [next(done) if p else self.whole(t) for t, p in zip(texts, plain, strict=True)]


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """First pass: doc_id, part, start, n and ids of each document; start counts the tokens before it in its part (an input partition)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = WordEncoder(tokenizer), np.uint32(end_id).tobytes()
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for low in range(0, batch.num_rows, 1500):
                ids = [x + end for x in encode([t or "" for t in texts.slice(low, 1500).to_pylist()])]
                n = np.array([len(x) // 4 for x in ids], "i8")
                starts = start + np.cumsum(n) - n
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays([names.slice(low, 1500), pa.array(np.full(len(ids), part, "i4")), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())], ["doc_id", "part", "start", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, part int, start long, n long, ids binary")


def part_offsets(tokens: DataFrame) -> DataFrame:
    """part and first: the tokens in all parts before it. Parts are summed up within blocks of 1000, then over blocks, so no task sorts all of them unless there are few."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n")).withColumn("block", F.floor(F.col("part") / 1000))
    blocks = totals.groupBy("block").agg(F.sum("n").alias("n"))
    blocks = blocks.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return totals.withColumn("inside", inside).join(blocks, "block").select("part", (F.col("before") + F.col("inside")).alias("first"))


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and (if with_ids) ids.

    The documents' ids, each followed by end_id, form one stream in the order of the input partitions. The first pass
    tokenises, writes the ids and their place in the partition; the partitions' totals, summed up, give the global places;
    the second pass cuts at each multiple of length, so that only the last sequence of all is short. A piece is the record
    of one document in one sequence. Each input partition is read as it lies: nothing but the totals is shuffled.

    Null or empty text: end_id alone. Repeated rows: packed each. Null doc_id stays null. Very long texts: many pieces,
    made a few at a time. Empty table: no rows. Other columns of the input are not read.
    """
    bound_batches(docs.sparkSession)
    tokens = materialize(tokenized(docs, tokenizer, end_id), "tokens")
    placed = tokens.join(small(materialize(part_offsets(tokens.select("part", "n")), "parts")), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                some = batch.slice(low, 500)
                begin, n = some.column(1).to_numpy(), some.column(2).to_numpy()
                count = (begin + n - 1) // length - begin // length + 1
                doc = np.repeat(np.arange(len(n)), count)
                sequence = np.repeat(begin // length, count) + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                first = np.maximum(begin[doc], sequence * length)
                size = np.minimum((begin + n)[doc], (sequence + 1) * length) - first
                start = first - begin[doc]
                ids = some.column(3)
                texts = ids.to_pylist()
                cut = [texts[d][4 * s : 4 * (s + z)] for d, s, z in zip(doc.tolist(), start.tolist(), size.tolist(), strict=True)]
                names = some.column(0).take(pa.array(doc))
                arrays = [names, start, size, np.fromiter(map(zlib.crc32, cut), "i8", len(cut)), n[doc], sequence, first - sequence * length]
                if with_ids:
                    arrays.append(pa.array(cut, pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], schema=pa.schema([(k, t) for k, t in fields if with_ids or k != "ids"]))

    fields = [(k, pa.int64()) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return placed.select("doc_id", (F.col("first") + F.col("start")).alias("start"), "n", "ids").mapInArrow(run, schema)


def sequences(pieces: DataFrame, length: int = 4096, pad_id: int = 0) -> DataFrame:
    """The padded sequences of pack(): sequence_id, n_tokens and ids (binary). At most length pieces meet in a row. The last sequence is padded to the next power of two."""
    gathered = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    joined = F.aggregate("_p", F.lit(b""), lambda all_, x: F.concat(all_, x["ids"]))
    to = F.least(F.lit(length), F.pow(F.lit(2), F.ceil(F.log2(F.col("n_tokens"))))).cast("int")
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), to - F.col("n_tokens").cast("int")))
    return gathered.select("sequence_id", "n_tokens", F.concat(joined, pad).alias("ids"))
