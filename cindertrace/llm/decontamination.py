"""Finds benchmark passages in documents by a prefix-filtered set join.

A document is contaminated by an item if one of the item's windows (WINDOW consecutive words; of a
shorter item, all its words) occurs in it. Since a window must occur whole, one word of it is prefix
enough: the one that is rarest over all documents. So

1. the words of all items are counted over all documents;
2. each distinct window is filed under its rarest word, with that word's place in it;
3. each word of a document that may head a window is offered with the words around it, and joined
   with the windows filed under it. A window must have room on both sides of the word (the length and
   positional bounds), and its words must be the document's, compared as strings.

What a document offers is thinned by a bit map of the words that are looked for (1 MB, whatever their
number); the join decides. The same steps run at every size.

Rows are told apart by doc_id and a hash of doc_id and text, so repeated and null doc_ids have their
own results; rows equal in both share them.

Defined results: ASCII letters are lower-cased; words are runs of digits, letters and characters
beyond ASCII. Null and empty texts have no words: such a document is clean and such an item has no
window. Repeated items count each; items with a null id take no part. Item ids in a list are sorted
as strings. Repeated documents each have a row. An empty benchmark leaves every document clean.
Further columns are ignored, or kept by without_contaminated().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cindertrace.llm.common import cut, prepare, record_batch, row_key, same_row, table, texts, without
from cindertrace.llm.words import LETTER_BYTES, LOWER, U, Words, groups, signed

WINDOW = 10
#: Bits of a word's hash that choose its place in the bit map: 2^23 places, 1 MB.
MAP_BITS = 23


def words_of(buf: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(LOWER[buf], offsets, LETTER_BYTES)


def word_at(w: Words, i: int) -> str:
    return w.buf[w.starts[i] : w.ends[i]].tobytes().decode()


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id (as string), tokens (the window's words) and hashes (theirs), for every window of every item."""
    schema = pa.schema([("item_id", pa.string()), ("tokens", pa.list_(pa.string())), ("hashes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, offsets in groups(b.column("text")):
                w = words_of(buf, offsets)
                own, rows = signed(w.hashes).tolist(), []
                for k in range(i, j):
                    a, z = int(w.first[k - i]), int(w.first[k - i + 1])
                    said = [word_at(w, p) for p in range(a, z)]
                    size = min(window, z - a)
                    rows += [(b.column("item_id")[k].as_py(), said[p : p + size], own[a + p : a + p + size]) for p in range(z - a - size + 1 if size else 0)]
                if rows:
                    yield record_batch(schema, *zip(*rows, strict=True))

    prepare(items.sparkSession)
    own = items.filter("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(run, "item_id string, tokens array<string>, hashes array<long>").distinct()


def bit_map(words: DataFrame) -> Broadcast:
    """Which places of the map the hashes in words(word) fall on: at most 2^(MAP_BITS - 6) rows reach the driver."""
    place = F.shiftrightunsigned("word", 64 - MAP_BITS)
    rows = words.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("k")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 AS int)))").alias("bits"))
    out = np.zeros(1 << MAP_BITS - 6, U)
    found = rows.toArrow()
    out[found.column("k").to_numpy()] = found.column("bits").to_numpy().view(U)
    return words.sparkSession.sparkContext.broadcast(out)


def in_map(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes >> U(65 - (len(bits) << 6).bit_length())).astype(np.int64)
    return (bits[place >> 6] >> (place & 63).astype(U) & U(1)).astype(bool)


def word_counts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """word, n: how often each of the wanted words (a column `word` of hashes) stands in all documents."""
    wanted = wanted.select("word").distinct()
    known = bit_map(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, buf, offsets in groups(b.column("text")):
                h = words_of(buf, offsets).hashes
                own, n = np.unique(h[in_map(known.value, h)], return_counts=True)
                if len(own):
                    yield pa.RecordBatch.from_pydict({"word": signed(own), "n": n})

    counted = documents.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "word long, n long")
    found = cut(counted.groupBy("word").agg(F.sum("n").alias("n")).join(wanted, "word", "left_semi"))
    known.destroy()
    return found


def file_windows(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """head (the rarest word), before (words in front of it), tokens, items: one row for each distinct window."""
    each = cut(windows.groupBy("tokens").agg(F.array_sort(F.collect_set("item_id")).alias("items"), F.first("hashes").alias("hashes")))
    words = each.select("tokens", F.posexplode("hashes").alias("before", "word"))
    counted = words.join(word_counts(documents, words), "word")
    # a word that no document has heads a window that cannot occur
    whole = F.count("*") == F.size(F.col("tokens"))
    heads = counted.groupBy("tokens").agg(F.min(F.struct("n", "word", "before")).alias("m"), whole.alias("whole")).filter("whole")
    return cut(heads.join(each, "tokens").select(F.col("m.word").alias("head"), F.col("m.before").alias("before"), "tokens", "items"))


def offers(documents: DataFrame, heads: DataFrame, window: int) -> DataFrame:
    """doc_id, key, n_words, and for words that may be in heads(word): word, at, around (words near it), off (its place there).

    One row for each document has no word.
    """
    known = bit_map(heads)
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("word", pa.int64()), ("at", pa.int32()), ("around", pa.list_(pa.string())), ("off", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column("doc_id"), b.column("key")
            for i, j, buf, offsets in groups(b.column("text")):
                w = words_of(buf, offsets)
                counts = w.counts()
                none = [None] * (j - i)
                yield record_batch(schema, ids.slice(i, j - i), keys.slice(i, j - i), counts, none, none, none, none)
                at = np.flatnonzero(in_map(known.value, w.hashes)) if len(w) else np.zeros(0, np.int64)
                for k in range(0, len(at), 4096):  # bounds a batch of words with what is around them
                    some = at[k : k + 4096]
                    doc = np.searchsorted(w.first, some, "right") - 1
                    lo, hi = np.maximum(some - window + 1, w.first[doc]), np.minimum(some + window, w.first[doc + 1])
                    places = np.unique(np.concatenate([np.arange(a, z) for a, z in zip(lo, hi, strict=True)]))
                    said = dict(zip(places.tolist(), (word_at(w, p) for p in places.tolist()), strict=True))
                    around = [[said[p] for p in range(a, z)] for a, z in zip(lo.tolist(), hi.tolist(), strict=True)]
                    rows = pa.array(i + doc)
                    yield record_batch(schema, ids.take(rows), keys.take(rows), counts[doc], signed(w.hashes[some].copy()), (some - w.first[doc]).astype(np.int32), around, (some - lo).astype(np.int32))

    rows = texts(documents).withColumn("key", row_key("doc_id", "text"))
    found = cut(rows.mapInArrow(run, "doc_id long, key long, n_words long, word long, at int, around array<string>, off int"))
    known.destroy()
    return found


def covered_words(spans: str) -> Column:
    """How many words an ascending array of (first, size) covers."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def step(s: Column, x: Column) -> Column:
        end = x["first"] + x["size"]
        return F.struct((s["n"] + F.greatest(F.lit(0), end - F.greatest(x["first"], s["end"]))).alias("n"), F.greatest(s["end"], end).alias("end"))

    return F.aggregate(spans, start, step, lambda s: s["n"])


def contaminated_words(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, key, n_words, n_hit, items (sorted ids), hits (array of (first, size) over the words), for every document."""
    filed = file_windows(documents, item_windows(benchmark, window))
    rows = offers(documents, filed.select(F.col("head").alias("word")), window)
    first = F.col("off") - F.col("before")
    met = rows.filter("word IS NOT NULL").join(filed, F.col("word") == F.col("head"))
    same = (first >= 0) & (first + F.size("tokens") <= F.size("around")) & (F.slice("around", F.greatest(first, F.lit(0)) + 1, F.size("tokens")) == F.col("tokens"))
    met = met.filter(same).select("doc_id", "key", F.struct((F.col("at") - F.col("before")).alias("first"), F.size("tokens").alias("size")).alias("hit"), "items")
    hit = met.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("hit")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    every = rows.filter("word IS NULL").select("doc_id", "key", "n_words")
    every = every.join(hit, same_row(hit, every), "left").select(every["doc_id"], every["key"], "n_words", "hits", "items")
    hits, items = F.coalesce("hits", F.array().cast("array<struct<first:int,size:int>>")), F.coalesce("items", F.array().cast("array<string>"))
    return every.select("doc_id", "key", "n_words", hits.alias("hits"), items.alias("items")).withColumn("n_hit", covered_words("hits"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def without_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """documents that hold no benchmark window, each row by its own text."""
    return without(documents, contaminated_words(documents, benchmark, window).filter("n_hit > 0").select("doc_id", "key"))
