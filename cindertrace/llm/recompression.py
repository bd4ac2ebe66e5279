"""Removal of repeated word windows through recompression.

A text's words are symbols. The first round names every run of one word, and each further round
splits the symbols in two halves by a bit of their name (another one each round) and names every
pair of a left symbol with a right one that follows it. A name is a 64-bit hash of what it stands
for, so all tasks give the same name to the same run or pair without a table: equal substrings get
the same symbols everywhere but near their ends. Rounds over one text run in the task that reads
it; what is global, the names, needs no shuffle, and the sharing of names is found by Spark.

Each symbol carries how far its naming looked to the left and right. A window of words shows a
symbol if it holds all of that. Of the highest level that shows a symbol, the window takes the one
with the least name (on low levels the leftmost one) as its anchor, headed by the name and the words
that the naming looked at: equal windows have equal anchors. Symbols that occur once clear all
their windows; shared ones lead to the comparison of whole contexts, then of single windows (repeats).

Defined results: words are runs without ASCII white space; every window of `length` words whose
sequence starts anywhere else, the same text included, loses its words, all occurrences alike.
Null and empty texts have no words. Null and repeated doc_ids are rows like others, and rows equal in
doc_id and text are occurrences of each other. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cindertrace.llm.common import record_batch, same_row, sha256_hex, table
from cindertrace.llm.repeats import covered, repeated_ranges
from cindertrace.llm.repeats import texts as keyed
from cindertrace.llm.words import U, Words, mix

LENGTH = 35
#: Symbols grow by a third each round: after five they hold some four words, which few other places share by chance.
ROUNDS = 5
#: Levels from which on the least name counts.
LEAST_FROM = 4


def levels(w: Words) -> list[tuple[np.ndarray, ...]]:
    """For each round: names, first words, and the first and last words that the naming looked at."""
    n = len(w)
    name, at = w.hashes, np.arange(n)
    doc = w.doc_of()
    first, last = w.first[doc] - 1, w.first[doc + 1]  # just outside the text
    out = [(name, at, at, at)]
    # runs of one word: each looks at the words on either side
    new = np.ones(n, bool)
    new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    a = np.flatnonzero(new)
    size = np.diff(np.append(a, n))
    name = np.where(size > 1, mix(name[a] + mix(size.astype(U))), name[a])
    at, doc, first, last = a, doc[a], first[a], last[a]
    lo, hi = a - 1, a + size
    out.append((name, at, lo, hi))
    for r in range(ROUNDS):
        right = (mix(name + U((r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> U(63)).astype(bool)
        same = np.zeros(len(name), bool)  # the next symbol is of the same text
        same[:-1] = doc[1:] == doc[:-1]
        pair = np.zeros(len(name), bool)
        pair[:-1] = ~right[:-1] & right[1:] & same[:-1]
        gone = np.zeros(len(name), bool)
        gone[1:] = pair[:-1]
        before, after = np.roll(lo, 1), np.roll(hi, -1)
        has_before = np.roll(same, 1)
        has_before[:1] = False
        # a pair looks at nothing else; a lone left symbol at what follows, a lone right one at what precedes
        new_hi = np.where(pair | ~right, np.where(same, after, last), hi)
        new_lo = np.where(right, np.where(has_before, before, first), lo)
        joined = mix(name * U(0x9E3779B97F4A7C55) + np.roll(name, -1))
        name = np.where(pair, joined, name)
        stay = np.flatnonzero(~gone)
        name, at, doc, lo, hi, first, last = name[stay], at[stay], doc[stay], new_lo[stay], new_hi[stay], first[stay], last[stay]
        out.append((name, at, lo, hi))
    return out


def shown_symbols(w: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    left = np.flatnonzero(w.inside(length))
    anchor, head, place = np.zeros(len(w), np.int64), np.zeros(len(w), U), np.zeros(len(w), np.int64)
    starts, base = left, 0
    for level, (name, at, lo, hi) in reversed(list(enumerate(levels(w) if len(left) else []))):
        if not len(left):
            break
        # both ends only grow from symbol to symbol, so what a window shows are neighbours
        i, z = np.searchsorted(lo, left), np.searchsorted(hi, left + length)
        ok = i < z
        here, i, z = left[ok], i[ok], z[ok]
        if level >= LEAST_FROM:
            i = _least(mix(name), i, z)
        anchor[here], place[here] = base + i, at[i]
        head[here] = mix(w.span_hashes(lo[i], hi[i] + 1) ^ name[i] ^ U(level))
        base += len(name)
        left = left[~ok]
    return starts, anchor[starts], head[starts], place[starts]


def _least(values: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Where the least of values[a:z] stands (compared by the upper 36 bits, the leftmost of equals)."""
    low = U((1 << 28) - 1)
    best = (values & ~low) | np.arange(len(values), dtype=U)
    out = np.zeros(len(a), U)
    size, span = z - a, 1
    while len(a):
        own = (size >= span) & (size < 2 * span)
        out[own] = np.minimum(best[a[own]], best[z[own] - span])
        if span * 2 > int(size.max(initial=0)):
            break
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    return (out & low).astype(np.int64)


def repeated_windows(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, key, ranges as in repeats.repeated_ranges."""
    return repeated_ranges(keyed(documents), shown_symbols, length)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, text, ranges in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "ranges")), strict=True):
                words = text.encode().split()
                n, go = len(words), 0
                if ranges:
                    gone = covered(n, ranges, LENGTH, False)
                    go = int(gone.sum())
                    words = [words[i] for i in np.flatnonzero(~gone)]
                rows.append((d, n, go, sha256_hex(b" ".join(words))))
            yield record_batch(schema, *zip(*rows, strict=True)) if rows else record_batch(schema, *[[]] * 4)

    rows, found = keyed(documents), repeated_windows(documents)
    marked = rows.join(found, same_row(found, rows), "left").select(rows["doc_id"], "text", "ranges")
    return marked.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")
