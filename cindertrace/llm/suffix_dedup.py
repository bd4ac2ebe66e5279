"""Exact removal of repeated passages by a sparse suffix array.

Of all suffixes (from each word to the text's end) only those at minimiser positions are retained:
of every `length` - K + 1 neighbouring K-word grams the one with the least hash. So each window of
`length` words holds a retained suffix, chosen by its own words. The suffixes are sorted by their
head and context, neighbours compared, and matches extended to the left and right (repeats).

Defined results: words are runs without ASCII white space; a passage of `length` words or more that
occurs again, in another row or in the same one, is repeated, and its first occurrence (by doc_id,
nulls first, then a hash of the text, then place) stays. Texts with fewer words, null and empty texts
have no passage. Null and repeated doc_ids are rows like others; of rows equal in doc_id and text none
comes first, so what stays in one stays in each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindertrace.llm.common import packed, record_batch, same_row, sha256_hex, table
from cindertrace.llm.repeats import covered, repeated_ranges
from cindertrace.llm.repeats import texts as keyed
from cindertrace.llm.words import Words, groups, sliding_argmin

#: Words in the shortest passage that counts.
LENGTH = 50
#: Words in the gram that heads a retained suffix.
HEAD = 8


def minimisers(w: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    grams = w.grams(HEAD)
    best = sliding_argmin(grams, length - HEAD + 1)
    starts = np.flatnonzero(w.inside(length)[: len(best)])
    place = best[starts]
    return starts, place, grams[place], place


def repeated_passages(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, key, ranges as in repeats.repeated_ranges, for the rows that have repeated passages."""
    return repeated_ranges(keyed(documents), minimisers, length)


def without_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """documents without all later occurrences of repeated passages; what is between other words stays as it is."""
    columns = documents.columns
    own_name = "ranges"
    while own_name in columns:  # whatever the table's columns are called
        own_name += "_"
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, ranges = [], b.column(own_name)
            for i, j, buf, offsets in groups(b.column("text")):
                for k in range(i, j):
                    own = buf[offsets[k - i] : offsets[k - i + 1]]
                    if not ranges[k].is_valid:
                        out.append(b.column("text")[k].as_py())
                        continue
                    w = Words(own, np.array([0, len(own)]))
                    go = covered(len(w), ranges[k].as_py(), length, True)
                    keep = np.ones(len(own), bool)
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], go, [False]]).astype(np.int8)))
                    for x, y in zip(edges[::2], edges[1::2], strict=True):
                        keep[w.starts[x] : w.starts[y] if y < len(w) else len(own)] = False
                    out.append(own[keep].tobytes().decode())
            arrays = [b.column(c) for c in columns]
            arrays[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    rows, found = packed(documents), repeated_passages(documents, length)
    marked = rows.join(found, same_row(found, rows), "left").select("row.*", F.col("ranges").alias(own_name))
    return marked.mapInArrow(run, documents.schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold repeated passages: doc_id, n_words, n_repeated, n_removed, n_passages, kept_sha256."""
    documents = table(spark, sf_dir, "documents")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_repeated", pa.int64()), ("n_removed", pa.int64()), ("n_passages", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, text, ranges in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "ranges")), strict=True):
                words = text.encode().split()
                both, later = (covered(len(words), ranges, LENGTH, x) for x in (False, True))
                kept = b" ".join([words[i] for i in np.flatnonzero(~later)])
                rows.append((d, len(words), int(both.sum()), int(later.sum()), int((np.diff(both.astype(np.int8), prepend=0) > 0).sum()), sha256_hex(kept)))
            yield record_batch(schema, *zip(*rows, strict=True)) if rows else record_batch(schema, *[[]] * 6)

    rows, found = keyed(documents), repeated_passages(documents)
    marked = rows.join(found, same_row(found, rows)).select(rows["doc_id"], "text", "ranges")
    return marked.mapInArrow(run, "doc_id long, n_words long, n_repeated long, n_removed long, n_passages long, kept_sha256 string")


