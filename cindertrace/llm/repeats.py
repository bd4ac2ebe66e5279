"""Exact repeated windows of words, found from anchors.

An anchor rule names, for each window of `length` words, one place inside it by the window's own
words, so that equal windows have equal anchors at equal offsets (suffix_dedup and recompression
give such rules). The windows of one anchor form a context: neighbouring windows with one anchor,
told by all their words.

1. suffixes() makes one row for each anchor: the hash that heads it, its context, where it lies.
2. neighbours() sorts the rows by head and context over range partitions and compares each with
   its neighbours. Equal contexts match whole. Rows with the same head but another context are
   kept for extension, one for each distinct context. What lies on the edges of partitions is
   compared once more by itself (the first rows and the last of each), so hot heads can be split.
3. extend() rereads the texts of those rows, takes each of their windows and matches them exactly.

Heads only bring together what may be equal. Contexts and windows are equal if 128-bit digests of
their words, as they stand and with one blank between them, are. All steps shuffle rows of a few
numbers, and a text only once, by its row.

Rows are told apart by doc_id, which may be null or repeat, and key (a hash of doc_id and text). Rows
equal in both each count as an occurrence, and what is found for one is found for the others; where
the first occurrence of something counts, none of them comes before another.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindertrace.llm.common import cut, record_batch, row_key, same_row
from cindertrace.llm.common import texts as bare_texts
from cindertrace.llm.words import U, Words, groups, mix, signed

#: words, length -> for each window start (ascending): the start, its anchor's id, the head's hash, the anchor's place
Rule = Callable[[Words, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def texts(documents: DataFrame) -> DataFrame:
    """doc_id, key, text and salt (0): windows are equal only under the same salt."""
    return bare_texts(documents).select("doc_id", row_key("doc_id", "text").alias("key"), "text", F.lit(0).cast("long").alias("salt"))


def salted(w: Words, salt: pa.Array) -> Words:
    salt = salt.to_numpy(zero_copy_only=False).view(U)
    if salt.any():
        w.hashes = mix(w.hashes ^ mix(salt)[w.doc_of()])
    return w


class Sequences:
    """The words of some texts with one blank between them, to digest sequences of them."""

    def __init__(self, w: Words, salt: pa.Array):
        lengths = w.ends - w.starts
        end = np.cumsum(lengths + 1) - 1
        flat = np.full(int(end[-1]) + 1 if len(w) else 0, 0x20, np.uint8)
        place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        flat[place + np.repeat(end - lengths, lengths)] = w.buf[place + np.repeat(w.starts, lengths)]
        self.data, self.begin, self.end = flat.tobytes(), end - lengths, end
        self.salt = salt.to_numpy(zero_copy_only=False).view(U)
        self.w = w

    def digests(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Two 64-bit integers for the words [lo, hi), of one text each."""
        data, digest = self.data, xxhash.xxh3_128_digest
        out = b"".join([digest(data[a:z]) for a, z in zip(self.begin[lo].tolist(), self.end[hi - 1].tolist(), strict=True)])
        out = np.frombuffer(out, "<i8").reshape(-1, 2).copy()
        if self.salt.any() and len(lo):
            out ^= mix(self.salt)[np.searchsorted(self.w.first, lo, "right") - 1].view(np.int64)[:, None]
        return out


def suffixes(rows: DataFrame, rule: Rule, length: int) -> DataFrame:
    """head, ctx and mark (the context's digest), doc_id, key, lo, hi: the anchor's windows start at words lo to hi of their row."""
    schema = pa.schema([("head", pa.int64()), ("ctx", pa.int64()), ("mark", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, offsets in groups(b.column("text")):
                salt = b.column("salt").slice(i, j - i)
                w = salted(Words(buf, offsets), salt)
                starts, anchor, head, place = rule(w, length)
                if not len(starts):
                    continue
                doc = w.doc_of()[starts]
                new = np.ones(len(starts), bool)
                new[1:] = (np.diff(starts) != 1) | (np.diff(anchor) != 0) | (np.diff(doc) != 0)
                a = np.flatnonzero(new)
                z = np.append(a[1:], len(starts)) - 1
                lo, hi = starts[a], starts[z]
                ctx = Sequences(w, salt).digests(lo, hi + length)
                first, at = w.first[doc[a]], pa.array(i + doc[a])
                yield record_batch(schema, signed(head[a]), ctx[:, 0], ctx[:, 1], b.column("doc_id").take(at), b.column("key").take(at), (lo - first).astype(np.int32), (hi - first).astype(np.int32))

    return rows.mapInArrow(run, "head long, ctx long, mark long, doc_id long, key long, lo int, hi int")


def neighbours(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compares suffixes() with their neighbours in sorted order.

    First: doc_id, key, lo, hi, later of the rows whose context another row has (later: and one of
    another place sorts before it). Second: doc_id, key, lo, hi of one row for each context whose
    head has others.
    """
    order = ["head", "ctx", "mark", "doc_id", "key", "lo"]
    own = ["head", "ctx", "mark", "doc_id", "key", "lo", "hi"]
    schema = pa.schema([(c, pa.int32() if c in ("lo", "hi") else pa.int64()) for c in own] + [(c, pa.bool_()) for c in ("whole", "later", "shared", "edge")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin: tuple | None = None  # the partition's first row: head, ctx, mark, key, lo
        group: tuple | None = None  # the first row of the context that the row before is of
        held = None

        def told(t: pa.Table, end: bool) -> pa.RecordBatch | None:
            """Compares all rows but the last, which waits for what follows (unless it ends)."""
            nonlocal begin, group
            c = {x: t.column(x).to_numpy() for x in ("head", "ctx", "mark", "key", "lo")}
            n = t.num_rows
            row = lambda i: tuple(int(c[x][i]) for x in c)
            same_head, same_ctx = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
            same_head[1:n] = c["head"][1:] == c["head"][:-1]
            same_ctx[1:n] = same_head[1:n] & (c["ctx"][1:] == c["ctx"][:-1]) & (c["mark"][1:] == c["mark"][:-1])
            if group:
                same_head[0] = c["head"][0] == group[0]
                same_ctx[0] = row(0)[:3] == group[:3]
            begin = begin or row(0)
            edge = np.ones(n, bool)
            for x, v in zip(c, begin, strict=True):
                edge &= c[x] == v
            edge[-1] |= end
            # where the context's first row stands: -1 if in an earlier batch
            at = np.where(same_ctx[:n], -1, np.arange(n))
            at = np.maximum.accumulate(at)
            away = np.zeros(n, bool)
            for x, k in (("key", 3), ("lo", 4)):
                away |= np.where(at >= 0, c[x][np.maximum(at, 0)], group[k] if group else 0) != c[x]
            whole, shared, later = same_ctx[:-1] | same_ctx[1:], same_head[:-1] | same_head[1:], same_ctx[:-1] & away
            m = n if end else n - 1
            if not end:  # the last row is looked at again, as the first one of what follows
                group = group if at[n - 2] < 0 else row(at[n - 2])
            keep = np.flatnonzero((shared | edge)[:m])
            if not len(keep):
                return None
            kept = t.take(pa.array(keep)).select(own)
            return record_batch(schema, *(x.combine_chunks() for x in kept.columns), *(x[keep] for x in (whole, later, shared, edge)))

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if held is not None:
                t = pa.concat_tables([held, t])
            if t.num_rows > 1:
                out = told(t, False)
                if out:
                    yield out
                t = t.slice(t.num_rows - 1)
            held = t
        if held is not None:
            out = told(held, True)
            if out:
                yield out

    kinds = ", ".join(f"{c} {'int' if c in ('lo', 'hi') else 'long'}" for c in own) + ", whole boolean, later boolean, shared boolean, edge boolean"
    near = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, kinds))
    # a few rows for each partition: what begins a partition may go on from the one before
    place = F.struct("doc_id", "key", "lo")
    edges = near.filter("edge")
    by_ctx = edges.groupBy("head", "ctx", "mark").agg(F.count("*").alias("n_ctx"), F.min(place).alias("first"))
    by_head = edges.groupBy("head").agg(F.count("*").alias("n_head"))
    again = edges.join(by_ctx, ["head", "ctx", "mark"]).join(by_head, "head")
    again = again.withColumns({"whole": F.col("whole") | (F.col("n_ctx") > 1), "later": F.col("later") | (place > F.col("first")), "shared": F.col("shared") | (F.col("n_head") > 1)})
    near = near.filter("NOT edge").select(*schema.names).unionByName(again.select(*schema.names)).filter("shared")
    # the first row stands for each context; only heads with several contexts need to be extended
    first = near.filter("NOT later")
    several = cut(first.groupBy("head").agg((F.min(F.struct("ctx", "mark")) != F.max(F.struct("ctx", "mark"))).alias("several")).filter("several").select("head"))
    return near.filter("whole").select("doc_id", "key", "lo", "hi", "later"), first.join(several, "head", "left_semi").select("doc_id", "key", "lo", "hi")


def extend(rows: DataFrame, some: DataFrame, length: int) -> DataFrame:
    """Matches the windows of some(doc_id, key, lo, hi) exactly: doc_id, key, at, later (an equal window of another place sorts before it)."""
    schema = pa.schema([("h", pa.int64()), ("mark", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, spans = b.column("doc_id"), b.column("key"), b.column("spans")
            for i, j, buf, offsets in groups(b.column("text")):
                w = Words(buf, offsets)
                said = Sequences(w, b.column("salt").slice(i, j - i))
                for k in range(i, j):
                    own = spans[k].values
                    lo, hi = own.field("lo").to_numpy(), own.field("hi").to_numpy()
                    n = hi - lo + 1
                    at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    at = np.unique(at)
                    h = said.digests(w.first[k - i] + at, w.first[k - i] + at + length)
                    same = pa.array(np.full(len(at), k))
                    yield record_batch(schema, h[:, 0], h[:, 1], ids.take(same), keys.take(same), at.astype(np.int32))

    spans = some.groupBy("doc_id", "key").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    read = rows.join(spans, same_row(spans, rows)).select(rows["doc_id"], rows["key"], "text", "salt", "spans")
    windows = cut(read.mapInArrow(run, "h long, mark long, doc_id long, key long, at int"))
    place = F.struct("doc_id", "key", "at")
    twice = cut(windows.groupBy("h", "mark").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").select("h", "mark", "first"))
    return windows.join(twice, ["h", "mark"]).select("doc_id", "key", "at", (place > F.col("first")).alias("later"))


def repeated_ranges(rows: DataFrame, rule: Rule, length: int) -> DataFrame:
    """doc_id, key, ranges: an array of (lo, hi, later): windows that start at words lo to hi occur elsewhere.

    rows: doc_id, key, text, salt, as texts() gives them. later tells whether an equal window sorts
    before (by doc_id, key, then place): all later ones can go and one of each stays.
    """
    # written first: the range partitioner reads its input twice
    whole, alike = neighbours(cut(suffixes(rows, rule, length)))
    found = extend(rows, alike, length)
    # one row for each run of windows, not for each window
    runs = found.groupBy("doc_id", "key", "later").agg(F.collect_set("at").alias("at")).mapInArrow(_runs, "doc_id long, key long, lo int, hi int, later boolean")
    return whole.unionByName(runs).groupBy("doc_id", "key").agg(F.collect_set(F.struct("lo", "hi", "later")).alias("ranges"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("later", pa.bool_())])
    for b in batches:
        for d, key, later, at in zip(*(b.column(c).to_pylist() for c in ("doc_id", "key", "later")), b.column("at"), strict=True):
            at = np.sort(at.values.to_numpy())
            cuts = np.flatnonzero(np.diff(at) != 1)
            lo, hi = at[np.append(0, cuts + 1)], at[np.append(cuts, len(at) - 1)]
            yield record_batch(schema, [d] * len(lo), [key] * len(lo), lo, hi, [later] * len(lo))


def covered(n_words: int, ranges: list | None, length: int, later_only: bool) -> np.ndarray:
    """Which of a document's words the windows of its ranges cover."""
    change = np.zeros(n_words + 1, np.int64)
    for r in ranges or ():
        if r["later"] or not later_only:
            change[r["lo"]] += 1
            change[r["hi"] + length] -= 1
    return np.cumsum(change[:-1]) > 0
