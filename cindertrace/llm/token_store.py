"""Token ids in binary shards, with document boundaries as Elias-Fano sequences.

Documents are dealt by ranges of doc_id, so shards in the order of their first doc_id hold the
corpus in ascending order (a tie in doc_id goes by the text's hash, then the text; the manifest numbers
the shards by task and place in it, so that order is the same in every run). A shard is

    magic, then n_docs, n_ids, width as little-endian u64,
    the n_docs + 1 boundaries and the n_docs doc_ids (less the first) as Elias-Fano blocks,
    n_ids ids of `width` bytes, little-endian.

An Elias-Fano block keeps the low bits of each value packed, the high bits in unary, and the place
of every 512th one as a 32-bit sample, from which select(i) counts on: about 2 + log2(U/n) bits for
a value and no table of 64-bit offsets.

Encoding: the tokenizer's added tokens are cut out first, as the library does. What lies between is cut
at single blanks and line feeds, where the byte-level pattern always cuts, and each worker keeps a
table of the distinct chunks with their ids. Longer runs of white space are cut as the pattern cuts
them, with a table of their own. Each shard gets a name of its own and counts only if its task's row
reaches the manifest, so repeated and lost tasks leave no wrong rows.

Defined results: a null text is empty (only the end id); rows with a null doc_id take no part; an
empty table gives no shard and no row; repeated rows are kept; further columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cindertrace.llm.common import cut, prepare, record_batch, shared_folder, table, texts

MAGIC = b"CTIDSEF1"
#: A shard is closed when it holds this many ids or more.
SHARD_IDS = 8_000_000
SAMPLE = 512
#: Distinct chunks that a worker keeps before it starts a new table.
TABLE_CHUNKS = 1_200_000
LONGEST_KEPT = 200
#: The characters that the pattern's white-space class holds.
SPACE = r"\t-\r \x85\xa0  -     　"
#: A word of Latin letters, with a blank before it, and ASCII signs after it that the byte-level alphabet writes as they are.
PLAIN = re.compile("( [A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,!?;:*#$%&|]*)")
CUT = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


#: Where the n-th set bit of a byte stands, the lowest first.
NTH_BIT = np.stack([np.pad(np.flatnonzero(np.unpackbits(np.uint8([b]), bitorder="little")), (0, 8))[:8] for b in range(256)])


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low: int, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray):
        self.n, self.low, self.lows, self.highs, self.samples = n, low, lows, highs, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        low = max(0, (top // n).bit_length() - 1) if n else 0
        v = values.astype(np.uint64)
        bits = (v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
        ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, low, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"), np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return struct.pack("<QQQQ", self.n, self.low, len(self.lows), len(self.highs)) + self.lows.tobytes() + self.highs.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, low, a, b = struct.unpack_from("<QQQQ", data, at)
        at += 32
        k = -(-n // SAMPLE)
        lows, highs = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        return cls(n, low, lows, highs, np.frombuffer(data, "<u4", k, at + a + b)), at + a + b + 4 * k

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        if left:
            byte = (place + 1) // 8
            found = np.unpackbits(self.highs[byte : byte + 1], bitorder="little")[(place + 1) % 8 :].sum()
            bits_from = place + 1
            if found < left:  # whole bytes follow
                counts = np.cumsum(np.unpackbits(self.highs[byte + 1 : byte + 1 + SAMPLE * 8][:, None], axis=1).sum(axis=1, dtype=np.int64))
                k = int(np.searchsorted(counts, left - found))
                while k == len(counts):  # long gaps between ones
                    more = np.unpackbits(self.highs[byte + 1 :][:, None], axis=1).sum(axis=1, dtype=np.int64)
                    counts = np.cumsum(more)
                    k = int(np.searchsorted(counts, left - found))
                left -= int(found) + (int(counts[k - 1]) if k else 0)
                bits_from = (byte + 1 + k) * 8
            own = np.unpackbits(self.highs[bits_from // 8 : bits_from // 8 + 1], bitorder="little")
            own[: bits_from % 8] = 0
            place = bits_from // 8 * 8 + int(np.flatnonzero(own)[left - 1])
        first = i * self.low
        own = np.unpackbits(self.lows[first // 8 : (first + self.low + 7) // 8], bitorder="little")[first % 8 : first % 8 + self.low]
        return ((place - i) << self.low) | int((own.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum())

    def many(self, i: np.ndarray) -> np.ndarray:
        """select() of each of i, in one pass over the high bits."""
        if len(i) and not (i.min() >= 0 and i.max() < self.n):
            raise IndexError(i)
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.highs), dtype=np.int64)])
        byte = np.searchsorted(before, i, "right") - 1
        place = byte * 8 + NTH_BIT[self.highs[byte], i - before[byte]]
        low = np.zeros(len(i), np.int64)
        for k in range(self.low):
            at_ = i * self.low + k
            low |= (self.lows[at_ >> 3] >> (at_ & 7) & 1).astype(np.int64) << k
        return ((place - i) << self.low) | low

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n]
        bits = np.unpackbits(self.lows, bitorder="little", count=self.n * self.low).reshape(self.n, self.low)
        lows = (bits.astype(np.int64) << np.arange(self.low)).sum(axis=1)
        return ((ones - np.arange(self.n)).astype(np.int64) << self.low) | lows


def single(word: str) -> bool:
    """No white space but a line feed in front."""
    bare = word[1:] if word[:1] == "\n" else word
    return bool(bare) and bare.split() == [bare]


class ByteCoder:
    """Encodes texts with one byte-level tokenizer."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        added = {x.content: (i, x) for i, x in t.get_added_tokens_decoder().items()}
        if any(x.lstrip or x.rstrip or x.single_word or x.normalized for _, x in added.values()):
            raise ValueError("added tokens that take in what is around them")
        self.model, self.split = t.model, t.pre_tokenizer.pre_tokenize_str
        self.width = 2 if t.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.code = "H" if self.width == 2 else "I"
        #: What the byte-level pre-tokenizer writes for each byte.
        self.written = {b: self.split(chr(b))[0][0] for b in range(0x21, 0x7F)} | {0x20: self.split(" a")[0][0][0]}
        for b in range(0x80, 0x100):  # by a two-byte character that has it (no Latin letter has the others)
            if b < 0xC0:
                self.written[b] = self.split(bytes([0xC4, b]).decode())[0][0][1]
            elif 0xC2 <= b <= 0xDF:
                self.written[b] = self.split(bytes([b, 0x80]).decode())[0][0][0]
        self.end = np.array([end_id], self.kind).tobytes()
        #: Added tokens as the library finds them in a text: the leftmost, of those that begin there the longest.
        self.added = {c: np.array([i], self.kind).tobytes() for c, (i, _) in added.items()}
        self.cut_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        #: Ids of words, by what plain() splits, and of chunks as they stand.
        self.kept: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        #: Bytes of the line feed that encode() puts before a text's first word.
        self.first = self.width
        self.tokens: dict[str, bytes] = {}

    def ids(self, chunk: str) -> bytes:
        plain = PLAIN.fullmatch(chunk)
        if plain:  # a word and what ends it: the pattern's two tokens
            word, end = plain.groups()
            return self.token(word.encode().decode("latin-1").translate(self.written)) + (self.token(end) if end else b"")
        return b"".join([self.token(t) for t, _ in self.split(chunk)])

    def token(self, token: str) -> bytes:
        own = self.tokens.get(token)
        if own is None:
            own = array(self.code, [x.id for x in self.model.tokenize(token)]).tobytes()
            if len(token) <= LONGEST_KEPT:
                self.tokens[token] = own
        return own

    def learn(self, words: set[str]) -> None:
        """Words that begin with a line feed stand as they are; before all others a blank is put."""
        for w in words:
            self.kept[w] = self.ids(w if w[:1] == "\n" else " " + w)

    def encode(self, batch: list[str]) -> list[bytes]:
        """The ids of each text, with the end id."""
        if not self.cut_added or not any(map(self.cut_added.search, batch)):
            return [ids + self.end for ids in self.plain(batch)]
        parts = [self.cut_added.split(t) for t in batch]  # every second part is an added token
        ids = iter(self.plain([p for own in parts for p in own[::2]]))
        return [b"".join([self.added[p] if k % 2 else next(ids) for k, p in enumerate(own)]) + self.end for own in parts]

    def plain(self, batch: list[str]) -> list[bytes]:
        """The ids of texts without added tokens."""
        if len(self.kept) > TABLE_CHUNKS:
            self.kept = {}
        if len(self.chunks) > TABLE_CHUNKS // 2:
            self.chunks = {}
        if len(self.tokens) > TABLE_CHUNKS // 2:
            self.tokens = {}
        # a line feed goes before a first word that has neither blank nor line feed, and its id away again
        split = [(t if t[0] in " \n" else "\n" + t).replace("\n", " \n").split(" ")[1:] if t else [] for t in batch]
        new = {w for w in set().union(*split).difference(self.kept) if single(w)}
        self.learn(new)
        out = []
        for t, words in zip(batch, split, strict=True):
            try:
                ids = b"".join(map(self.kept.__getitem__, words))
                out.append(ids[self.first :] if t and t[0] not in " \n" else ids)
            except KeyError:  # longer or other white space
                out.append(b"".join(map(self.chunk, CUT.findall(t))))
        for w in new:
            if len(w) > LONGEST_KEPT:
                del self.kept[w]
        return out

    def chunk(self, text: str) -> bytes:
        if len(text) > LONGEST_KEPT:
            return self.ids(text)
        own = self.chunks.get(text)
        if own is None:
            own = self.chunks[text] = self.ids(text)
        return own


@lru_cache(maxsize=2)
def coder(path: str, end_id: int) -> ByteCoder:
    return ByteCoder(path, end_id)


def at(place: str) -> tuple[fs.FileSystem, str]:
    if place.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(place).path
    return fs.FileSystem.from_uri(place.replace("s3a://", "s3://", 1))


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme: Spark's default file system where none is given, as Spark reads it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def shard_bytes(doc_ids: list[int], ids: list[bytes], width: int) -> bytes:
    bounds = np.concatenate([[0], np.cumsum([len(i) // width for i in ids])]).astype(np.int64)
    own = np.array(doc_ids, np.int64)
    return b"".join([MAGIC, struct.pack("<QQQq", len(own), int(bounds[-1]), width, int(own[0])), EliasFano.of(bounds).to_bytes(), EliasFano.of((own - own[0])).to_bytes(), *ids])


def read_shard(data: bytes) -> tuple[np.ndarray, EliasFano, np.ndarray]:
    """doc_ids, boundaries, ids."""
    view = memoryview(data)
    if view[:8] != MAGIC:
        raise ValueError("not a shard")
    _, n, width, least = struct.unpack_from("<QQQq", view, 8)
    bounds, at_ = EliasFano.read(view, 40)
    own, at_ = EliasFano.read(view, at_)
    return own.all() + least, bounds, np.frombuffer(view, f"<u{width}", n, at_)


def write(documents: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Writes the shards at once; returns the manifest: path, part and seq (the shards' order), first_doc, n_docs, n_ids."""
    folder = qualified(documents.sparkSession, folder)
    schema = pa.schema([("path", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(tokenizer, end_id)
        docs, ids, size, part, seq = [], [], 0, TaskContext.get().partitionId(), 0

        def close() -> pa.RecordBatch:
            path = f"{folder}/{uuid.uuid4().hex}.ids"
            store, place = at(path)
            with store.open_output_stream(place) as out:
                out.write(shard_bytes(docs, ids, c.width))
            return record_batch(schema, [path], [part], [seq], [docs[0]], [len(docs)], [size])

        for b in batches:
            coded = c.encode(b.column("text").to_pylist())
            for d, i in zip(b.column("doc_id").to_pylist(), coded, strict=True):
                docs.append(d)
                ids.append(i)
                size += len(i) // c.width
                if size >= SHARD_IDS:
                    yield close()
                    docs, ids, size, seq = [], [], 0, seq + 1
        if docs:
            yield close()

    store, place = at(folder)
    store.create_dir(place, recursive=True)
    rows = texts(documents).filter(F.col("doc_id").isNotNull()).withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return cut(dealt.mapInArrow(run, "path string, part int, seq int, first_doc long, n_docs long, n_ids long"))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, read from the shards."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                store, place = at(path)
                with store.open_input_stream(place) as f:
                    own, bounds, ids = read_shard(f.read())
                ends = bounds.many(np.arange(bounds.n))
                ids = ids.astype("<u4")
                sums = [zlib.crc32(ids[a:b]) for a, b in pairwise(ends.tolist())]
                yield record_batch(schema, own, ends[:-1] + base, np.diff(ends), sums)

    # one row for each shard, in one ordered sum: shards are of a set size, and the rows are a few bytes
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    # as many tasks as shards: the rows are too few for Spark to deal them out by itself
    return based.repartition(max(1, manifest.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_folder(prepare(spark)).rstrip('/')}/ids-{uuid.uuid4().hex}"
    return read(write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), 2))
