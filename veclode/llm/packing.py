"""Packing by power-of-two decomposition: equal lengths share a bucket, and no sequence crosses documents.

A document's token ids, with an end id behind them, are cut into as many pieces of `most` ids as it fills and, for what is
left, one piece for each binary digit of its number, the longest first. Every piece is a sequence of its own, of a length
that is a power of two, so nothing is padded and nothing attends to another document. Sequences of one length are one
bucket: `write` puts them into a folder of their own, from which batches of equal shape are read. The work is one pass of
the texts without a shuffle; a sequence's number is made of its bucket, its task and its place there, so it is unique
without a count of all rows, and a bucket's numbers are a range.

Encoding: no token crosses the white space U+0009 to U+000D or the space (the tokenizer drops it, and NFC joins nothing
across it), nor the border of a letter and ASCII punctuation, so a task encodes each distinct unit between such borders
once and keeps what it found for the next texts, up to KEPT units; then it begins anew.

Defined cases: a null or empty text is the end id alone, one sequence of length 1; a very long text is cut like any other;
repeated rows are packed each on their own, ties do not occur; a null doc_id stays null; an empty table gives no
sequence; other columns are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, list_array, shared_dir, texts

MODEL = "word_bpe_49k.json"
#: Distinct units whose ids a task keeps, and the longest (in bytes) among them.
KEPT, SHORT = 1 << 18, 64
#: Punctuation that starts no contraction and no special token.
#: The characters that stand for the bytes of a letter beyond ASCII; those of U+00E0 on and of ASCII stand for themselves.
_LETTERS = "".join(chr(b + 0xA2 if 0x7F <= b <= 0xA0 else 0x143 if b == 0xAD else b) for b in range(256))
_MARKS = np.isin(np.arange(256), np.frombuffer(rb"""!"#$%&()*+,-./:;=?@[\]^_`{}~""", np.uint8))
_FIELDS = "doc_id long, start long, length long, doc_tokens long, sequence_id long, ids array<int>"
#: A sequence's number: bucket, task and place, the last two in so many bits.
_TASK, _PLACE = 27, 31


def model_path(name: str = MODEL) -> str:
    """The vocabulary file: a path, or the name of a public tokenizer's file."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts to ids, by their distinct units. Entry 0 is the end id, the others are units: words, cut further between a
    letter and punctuation. Those of letters alone, lower-cased, are one word to the tokenizer too and go straight to its model,
    in the characters that stand for their bytes."""

    def __init__(self, path: str, end: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.model, self.end = Tokenizer.from_file(path), end
        self.words = self.model.model
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.size = np.array([self.end], np.int32), np.ones(1, np.int64)

    def _encode(self, units: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units one after another, and how many each has; the first n are of letters."""
        letters = b"\n".join(units[:n]).decode("latin-1").split("\n") if n else []
        encode = self.words.tokenize
        found = [[token.id for token in encode(x if x.isascii() else x.translate(_LETTERS))] for x in letters]
        found += [x.ids for x in self.model.encode_batch_fast([u.decode() for u in units[n:]], add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(size.sum())), size

    def _entries(self, units: list[bytes], plain: np.ndarray) -> np.ndarray:
        """The entry of each of these distinct units (plain: of letters). What is kept begins anew beyond KEPT units."""
        if len(self.size) > KEPT or len(self.flat) > 4 * KEPT:
            self._reset()
        out = np.fromiter(map(self.known.get, units, repeat(-1)), np.int64, len(units))
        new, n = np.append(np.flatnonzero((out < 0) & plain), np.flatnonzero((out < 0) & ~plain)), int(((out < 0) & plain).sum())
        if len(new):
            names = [units[i] for i in new.tolist()]
            flat, size = self._encode(names, n)
            out[new] = np.arange(len(new)) + len(self.size)
            self.known.update((u, e) for u, e in zip(names, out[new].tolist(), strict=True) if len(u) <= SHORT)
            self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        return out

    def _units(self, data: np.ndarray, ends: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
        """The units of texts, given as bytes and by their ends, where each begins, and which distinct ones are of letters."""
        word = (data != 32) & ((data < 9) | (data > 13))
        upper = (data >= 65) & (data <= 90)
        letter = upper | (data >= 97) & (data <= 122)
        lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))  # U+00C0 to U+00FF without signs
        letter[lead] = letter[lead + 1] = True
        mark = _MARKS[data]
        first = word.copy()
        first[1:] &= ~word[:-1] | letter[:-1] & mark[1:] | mark[:-1] & letter[1:]
        begins = np.append(0, ends)[:-1]
        begins = begins[begins < len(data)]
        first[begins] = word[begins]
        at = np.flatnonzero(first)
        count = np.append(0, np.cumsum(word))
        offsets = np.append(count[at], count[-1])
        body, letter, upper = data[word], letter[word], upper[word]
        plain = np.logical_and.reduceat(letter, offsets[:-1]) if len(at) else np.zeros(0, bool)
        plain_ = np.repeat(plain, np.diff(offsets))
        body[upper & plain_] += 32
        capital = np.flatnonzero((body[:-1] == 0xC3) & (body[1:] < 0x9F) & plain_[1:]) + 1  # U+00C0 to U+00DE
        body[capital] += 32
        units = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body)]).dictionary_encode()
        kinds = np.zeros(len(units.dictionary), bool)
        kinds[units.indices.to_numpy()] = plain
        return units, at, kinds

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, each with the end id, one after another, and how many each text has."""
        raw = column.cast(pa.large_binary())
        ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends = ends[1:] - ends[0]
        units, at, plain = self._units(data, ends)
        entry = self._entries(units.dictionary.to_pylist(), plain)[units.indices.to_numpy()]
        until = at.searchsorted(ends)  # units up to each text's end
        entry = np.insert(entry, until, 0)
        n = self.size[entry]
        last = np.cumsum(n)
        start = (np.cumsum(self.size) - self.size)[entry]
        ids = self.flat[np.repeat(start - last + n, n) + np.arange(last[-1] if len(last) else 0)]
        return ids, np.diff(last[until + np.arange(len(until))], prepend=0)


def lengths(tokens: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of documents of so many tokens: whose they are, and their lengths, in order."""
    digits = most.bit_length() - 2 - np.arange(most.bit_length() - 1)
    whose, digit = np.nonzero(tokens[:, None] % most >> digits & 1)
    whole = np.repeat(np.arange(len(tokens)), tokens // most)
    doc = np.concatenate([whole, whose])
    order = np.argsort(doc, kind="stable")
    return doc[order], np.concatenate([np.full(len(whole), most), 1 << digits[digit]])[order]


def sequences(docs: DataFrame, path: str = MODEL, end: int = 2, most: int = 4096) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, ids of each document's pieces; start: the ids of its document before
    it. most: the longest length, a power of two."""
    if most < 1 or most & (most - 1):
        raise ValueError(f"most must be a power of two: {most}")
    file = model_path(path)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder(file, end), TaskContext.get().partitionId()
        seen = np.zeros(most.bit_length(), np.int64)
        for b in batches(it, 2):
            ids, tokens = encoder(b.column("text"))
            doc, size = lengths(tokens, most)
            bucket = np.round(np.log2(size)).astype(np.int64)
            place = np.empty(len(size), np.int64)
            for k in np.unique(bucket):
                own = np.flatnonzero(bucket == k)
                place[own] = seen[k] + np.arange(len(own))
                seen[k] += len(own)
            number = ((bucket << _TASK | task) << _PLACE) | place
            start = np.cumsum(size) - size - (np.cumsum(tokens) - tokens)[doc]
            columns = [b.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(tokens[doc]), pa.array(number), list_array(ids, size, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "ids"])

    return texts(docs).mapInArrow(run, _FIELDS)


def write(sequences: DataFrame, path: str) -> None:
    """The sequences as Parquet, a folder for each length."""
    sequences.write.partitionBy("length").parquet(path)


def read(spark: SparkSession, path: str, length: int | None = None) -> DataFrame:
    """What write wrote; with a length, that bucket alone."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException:  # nothing was written: no sequence
        return spark.createDataFrame([], _FIELDS)
    found = found.withColumn("length", F.col("length").cast("long"))
    return found if length is None else found.where(F.col("length") == length)


def _crc(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        ids = b.column("ids")
        ends = ids.offsets.to_numpy().tolist()
        data = memoryview(np.ascontiguousarray(ids.values.to_numpy(), "<u4").view(np.uint8))
        crc = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(ends, ends[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "start", "length")), pa.array(crc, pa.int64()), *(b.column(c) for c in ("doc_tokens", "sequence_id"))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id"])


def digest(docs: DataFrame) -> DataFrame:
    """The buckets, written to the shared folder and read again; a sequence holds one piece, at offset 0."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/packing-{uuid.uuid4().hex}"
    write(sequences(docs), path)
    out = read(spark, path).select("doc_id", "start", "length", "doc_tokens", "sequence_id", "ids")
    out = out.mapInArrow(_crc, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long")
    return out.withColumn("offset", F.lit(0).cast("long"))
