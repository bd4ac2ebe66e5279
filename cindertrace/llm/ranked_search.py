"""Ranks documents for query texts by a two-level quantised index.

A document's score for an item is a sum over the item's terms of weight x impact, all in integers. The
impact (how much a term's frequency in a document of this length is worth, below IMPACTS) is kept
twice: as a byte, rounded up, and as what it is computed from.

1. One pass over the texts makes postings, in blocks of some thousand documents: for each term that
   some item asks for, the documents that have it and how often. A bit map of the items' terms (1 MB,
   whatever their number) thins the words. The number of documents, the terms' number and in how many
   documents each term stands are summed over all blocks.
2. The index is written in blocks: bytes (first level), and frequencies and lengths (second level).
3. Items are taken in blocks of at most BLOCK_ITEMS. For a block, each task adds up weight x byte for
   every document, which bounds each score from both sides, and tells the K greatest lower bounds of
   each item. The K-th greatest of all tasks is the item's bar.
4. The first level is read again: every document whose upper bound reaches an item's bar is scored
   exactly from the second level. A task keeps its K best for each item; a last window ranks these.

So a document that could be among the K best is never left out, and equal scores go to the smaller
doc_id. A task holds one block's sums at a time. What a task passes on is K rows for each item.

Defined results: ASCII letters are lower-cased; a term is a run of digits, letters and characters
beyond ASCII; terms are told apart by 64-bit hashes. Null and empty texts have no terms. Rows with a
null doc_id take no part, nor do items with a null id; the texts of one item_id count together.
Repeated documents are ranked each. An item without a document that scores above 0 has no row. Empty
tables give no row. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cindertrace.llm.common import cut, prepare, record_batch, table, texts
from cindertrace.llm.decontamination import bit_map, in_map, words_of
from cindertrace.llm.words import groups, signed

#: Documents ranked for each item.
K = 10
#: Fixed values of the score: impact of a term, and how a document's length (in hundredths of the mean) goes into it.
IMPACTS, TF, LENGTH, FLAT, SLOPE = 1_000_000_000, 1000, 8, 25, 75
#: Impacts are below IMPACTS / TF; a byte counts steps of this size.
STEP = -(-IMPACTS // TF // 255)
#: Documents of an index block (a block is closed when it has so many or more).
BLOCK_DOCS = 2048
#: Items, and rows of (item, term), that one pass over the index takes.
BLOCK_ITEMS, BLOCK_ROWS = 1024, 100_000


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term (its hash), times."""
    schema = pa.schema([("item_id", pa.int64()), ("term", pa.int64()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, offsets in groups(b.column("text")):
                w = words_of(buf, offsets)
                for k in range(i, j):
                    own, times = np.unique(w.hashes[w.first[k - i] : w.first[k - i + 1]], return_counts=True)
                    if len(own):
                        yield record_batch(schema, [b.column("item_id")[k].as_py()] * len(own), signed(own), times)

    prepare(items.sparkSession)
    own = items.filter("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return cut(own.mapInArrow(run, "item_id long, term long, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times")))


def postings(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Blocks of documents: doc_ids, lengths, terms, holders (documents that have each term), docs and tfs (of the terms in turn); n_docs and n_terms."""
    known = bit_map(wanted.select(F.col("term").alias("word")).distinct())
    schema = pa.schema([("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("terms", pa.list_(pa.int64())), ("holders", pa.list_(pa.int32())), ("docs", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("n_docs", pa.int64()), ("n_terms", pa.int64())])

    def block(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        ids, lengths, term, doc, tf = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((doc, term))
        terms, holders = np.unique(term, return_counts=True)
        lists = [ids, lengths, terms, holders.astype(np.int32), doc[order].astype(np.int32), tf[order].astype(np.int32)]
        return record_batch(schema, *[[x] for x in lists], [int((lengths > 0).sum())], [int(lengths.sum())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            for i, j, buf, offsets in groups(b.column("text")):
                w = words_of(buf, offsets)
                asked = np.flatnonzero(in_map(known.value, w.hashes)) if len(w) else np.zeros(0, np.int64)
                own, term = np.unique(w.hashes[asked], return_inverse=True)
                key, tf = np.unique(term * (j - i) + np.searchsorted(w.first, asked, "right") - 1, return_counts=True)
                parts.append((b.column("doc_id").slice(i, j - i).to_numpy(), w.counts(), signed(own)[key // (j - i)], key % (j - i) + held, tf))
                held += j - i
                if held >= BLOCK_DOCS:
                    yield block(parts)
                    parts, held = [], 0
        if parts:
            yield block(parts)

    shape = "doc_ids array<long>, lengths array<long>, terms array<long>, holders array<int>, docs array<int>, tfs array<int>, n_docs long, n_terms long"
    found = cut(texts(documents).filter("doc_id IS NOT NULL").mapInArrow(run, shape))
    known.destroy()
    return found


def norms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a document's length adds to the divisor; whole numbers, beyond 64 bits where need be."""
    if len(lengths) and int(lengths.max()) * SLOPE * n_docs >= 1 << 63:
        return np.array([FLAT + SLOPE * int(n) * n_docs // n_terms for n in lengths], np.int64)
    return FLAT + SLOPE * lengths * n_docs // max(1, n_terms)


def impacts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return IMPACTS * tf // (TF * tf + LENGTH * norm)


def flat(column: pa.ListArray, k: int) -> np.ndarray:
    return column[k].values.to_numpy()


def index(found: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The two levels over postings: doc_ids, terms, holders, docs and bytes; tfs and norms."""
    schema = pa.schema([("doc_ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.int64())), ("holders", pa.list_(pa.int32())), ("docs", pa.list_(pa.int32())), ("bytes", pa.binary()), ("tfs", pa.list_(pa.int32())), ("norms", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                own = norms(flat(b.column("lengths"), k), n_docs, n_terms)
                levels = -(-impacts(flat(b.column("tfs"), k), own[flat(b.column("docs"), k)]) // STEP)
                kept = [b.column(c).slice(k, 1) for c in ("doc_ids", "terms", "holders", "docs")]
                yield record_batch(schema, *kept, [levels.astype(np.uint8).tobytes()], b.column("tfs").slice(k, 1), [own])

    rows = found.select("doc_ids", "lengths", "terms", "holders", "docs", "tfs")
    return cut(rows.mapInArrow(run, "doc_ids array<long>, terms array<long>, holders array<int>, docs array<int>, bytes binary, tfs array<int>, norms array<long>"))


@dataclass
class Queries:
    """A block of items: the terms they ask for, in ascending order, and for each the items (by place) and weights."""

    items: np.ndarray
    terms: np.ndarray
    first: np.ndarray
    item: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Queries:
        item_id, term, weight = (rows.column(c).to_numpy() for c in ("item_id", "term", "weight"))
        items, item = np.unique(item_id, return_inverse=True)
        order = np.lexsort((item, term))
        terms, first = np.unique(term[order], return_index=True)
        return cls(items, terms, np.append(first, len(order)), item[order], weight[order])

    def met(self, terms: np.ndarray, holders: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """For each term that both have: where its postings are, its items and their weights."""
        ends = np.cumsum(holders)
        _, mine, theirs = np.intersect1d(self.terms, terms, assume_unique=True, return_indices=True)
        for t, k in zip(mine.tolist(), theirs.tolist(), strict=True):
            own = slice(self.first[t], self.first[t + 1])
            yield slice(ends[k] - holders[k], ends[k]), self.item[own], self.weight[own]

    def bounds(self, n: int, terms: np.ndarray, holders: np.ndarray, docs: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of n documents, a row for each item."""
        up, weights = np.zeros((len(self.items), n), np.int64), np.zeros((len(self.items), n), np.int64)
        for own, items, weight in self.met(terms, holders):
            at = np.ix_(items, docs[own])
            level = levels[own].astype(np.int64)
            up[at] += weight[:, None] * level
            weights[at] += weight[:, None] * (level > 0)
        up *= STEP
        return up - (STEP - 1) * weights, up

    def exact(self, wanted: np.ndarray, terms: np.ndarray, holders: np.ndarray, docs: np.ndarray, tfs: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, document and score of the wanted pairs (a matrix of items and documents)."""
        rows, columns = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
        row, column = np.full(wanted.shape[0], -1), np.full(wanted.shape[1], -1)
        row[rows], column[columns] = np.arange(len(rows)), np.arange(len(columns))
        score = np.zeros((len(rows), len(columns)), np.int64)
        for own, items, weight in self.met(terms, holders):
            r, c = row[items], column[docs[own]]
            asked, some = r >= 0, c >= 0
            if asked.any() and some.any():
                score[np.ix_(r[asked], c[some])] += weight[asked][:, None] * impacts(tfs[own][some], norm[docs[own][some]])
        item, doc = np.nonzero(wanted)
        return item, doc, score[row[item], column[doc]]


def bars(indexed: DataFrame, asked: Queries) -> np.ndarray:
    """The K-th greatest lower bound of each item over all documents; 0 where fewer documents score."""
    shared = indexed.sparkSession.sparkContext.broadcast(asked)
    schema = pa.schema([("item", pa.int64()), ("low", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        best = np.zeros((len(q.items), K), np.int64)
        for b in batches:
            for k in range(len(b)):
                low, _ = q.bounds(int(b.column("n")[k].as_py()), *(flat(b.column(c), k) for c in ("terms", "holders", "docs")), np.frombuffer(b.column("bytes")[k].as_py(), np.uint8))
                both = np.concatenate([best, low], axis=1)
                best = np.partition(both, both.shape[1] - K, axis=1)[:, -K:]
        item, place = np.nonzero(best > 0)
        yield record_batch(schema, item, best[item, place])

    lows = indexed.select(F.size("doc_ids").alias("n"), "terms", "holders", "docs", "bytes").mapInArrow(run, "item long, low long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low")))
    found = lows.withColumn("place", place).filter(F.col("place") == K).toArrow()  # at most one row for each item of the block
    out = np.zeros(len(asked.items), np.int64)
    out[found.column("item").to_numpy()] = found.column("low").to_numpy()
    shared.destroy()
    return out


def best_of(rows: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Of (item, doc_id, score) the K best rows of each item."""
    item, doc, score = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((doc, -score, item))
    item, doc, score = item[order], doc[order], score[order]
    first = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else np.zeros(0, np.int64)
    kept = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item)))) < K
    return item[kept], doc[kept], score[kept]


def best(indexed: DataFrame, asked: Queries) -> DataFrame:
    """item_id, doc_id and score of each task's K best for each item of the block."""
    shared = indexed.sparkSession.sparkContext.broadcast((asked, bars(indexed, asked)))
    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, bar = shared.value
        kept = (np.zeros(0, np.int64),) * 3
        for b in batches:
            for k in range(len(b)):
                ids, terms, holders, docs, tfs, norm = (flat(b.column(c), k) for c in ("doc_ids", "terms", "holders", "docs", "tfs", "norms"))
                _, up = q.bounds(len(ids), terms, holders, docs, np.frombuffer(b.column("bytes")[k].as_py(), np.uint8))
                item, doc, score = q.exact((up > 0) & (up >= bar[:, None]), terms, holders, docs, tfs, norm)
                some = score > 0
                kept = best_of([kept, (item[some], ids[doc[some]], score[some])])
        item, doc, score = kept
        yield record_batch(schema, q.items[item], doc, score)

    return cut(indexed.mapInArrow(run, "item_id long, doc_id long, score long"))


def ranked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id and score of the K best documents of each item."""
    asked = item_terms(items)
    found = postings(documents, asked)
    n_docs, n_terms = found.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    holders = found.select(F.explode(F.arrays_zip("terms", "holders")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.holders").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weighted = cut(asked.join(holders, "term").select("item_id", "term", (F.col("times") * weight).alias("weight")).filter("weight > 0"))
    rows, n_items = weighted.agg(F.count("*"), F.count_distinct("item_id")).first()
    n_blocks = max(1, -(-rows // BLOCK_ROWS), -(-n_items // BLOCK_ITEMS))
    indexed = index(found, n_docs, n_terms)
    out = documents.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for k in range(n_blocks if rows else 0):
        block = weighted.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k)
        out = out.unionAll(best(indexed, Queries.of(block.toArrow())))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return out.withColumn("rank", place).filter(F.col("rank") <= K).select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
OP12_SQL = f"""
WITH said AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} AS term FROM documents WHERE doc_id IS NOT NULL) GROUP BY ALL),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM said GROUP BY doc_id),
whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
norms AS (SELECT doc_id, 25 + (75 * n * n_docs) // n_terms AS m FROM sizes, whole),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM said, whole GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS} AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN said USING (term) JOIN norms USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
