"""Approximate nearest neighbours: score-aware quantisation, four-bit table scans, exact reranking.

Of all vectors the nearest to q has the greatest q.x - |x|^2 / 2. The norm is kept exactly, one number
for each row; x is dealt to a cell, and its residual to the cell's centre is quantised in blocks of
BLOCK dimensions by 16 centres each. The codebooks minimise the anisotropic loss: error parallel to
the vector, which moves the scores of the queries that rank it high, costs ETA times as much as error
across it.

A query probes the cells nearest to it. How many is measured, not set: the exact neighbours of some
sample rows within the sample are looked up, and as many cells are probed as hold REACH of them (those
of a sample lie farther off than those of the whole table, so this errs on the safe side). That is right
for most queries, not for those far from all else, so each query also probes the cells of the sample
rows nearest to itself, and further cells until those that it probes hold KEEP * k rows. In a cell a
table of 16 scores for each block of dimensions is added up by code. Rows go on whose estimate, less
what their code is likely to err by (a number kept with each), is within the query's own bound: its
distance to the sample row of the rank that stands for RERANK rows of the table. A chunk of a cell passes
on RERANK rows of a query at most, and so do all together; those are reranked by exact distance in double
precision on the original vectors. Should a query be left with fewer than k rows, it is compared with all
rows, in blocks of QUERIES such queries. Of equal vectors only the k + 1
with the least ids can be among the k nearest, so the others are not coded.

What Spark moves for a query is its vector to each probed chunk and at most RERANK rows back from each.
Cells are cut in chunks of CHUNK rows by hash of vec_id, so a crowded cell is many tasks' work.

Centres and codebooks are fitted on a sample of at most SAMPLE vectors and SAMPLE_NUMBERS numbers (the
least by hash of vec_id), which goes to all tasks; every row is indexed.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no
part, nor those of another length than most have; a query never finds its own row; fewer candidates
than k are all returned; equal distances go to the smaller vec_id; of repeated vec_ids each row is
a candidate, the query's own id is none, and the least vector is the query. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cindertrace.llm.common import cut, prepare, record_batch, table

SAMPLE, SAMPLE_NUMBERS, CELLS, BLOCK, ETA = 16_384, 1 << 22, 256, 2, 4.0
#: Rows in a chunk of a cell, queries in a block, rows that are reranked for each one asked for.
CHUNK, QUERIES, KEEP = 8192, 256, 20
#: The share of sample neighbours whose cells are probed, and how many sample rows are asked.
REACH, ASKED = 0.985, 512
#: How many times its usual size the error of an estimate may have.
SURE = 3.0
#: A query probes the cells of so many times k sample rows near it.
OWN = 4


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (array of double) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).filter("vec_id IS NOT NULL AND size(vector) > 0")
    rows = rows.filter(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("d")).count().agg(F.max_by("d", F.struct("count", "d")).alias("d"))
    d = sizes.first()["d"]
    return rows.filter(F.size("vector") == (d or 0))


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        of = nearest(x, c)
        n = np.bincount(of, minlength=k)
        total = np.stack([np.bincount(of, x[:, j], k) for j in range(x.shape[1])], axis=1)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    own = (c**2).sum(axis=1)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = np.argmin(own - 2 * x[i : i + 4096] @ c.T, axis=1)
    return out


class Index:
    """Centres, codebooks and the sample they are fitted on."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, rows: int, k: int):
        self.rows, self.ids, self.k, self.rerank = rows, ids, k, KEEP * k
        self.mean = sample.mean(axis=0)
        self.sample = x = sample - self.mean
        self.cells = int(np.clip(rows // 256, 1, min(CELLS, len(x))))
        self.centres = kmeans(x, self.cells, 8)
        self.cell = cell = nearest(x, self.centres)
        rest = x - self.centres[cell]
        d = x.shape[1]
        self.pad = -d % BLOCK
        self.blocks = (d + self.pad) // BLOCK
        r, w = self.cut(self.unit(rest)), self.cut(self.unit(x))
        self.books = np.stack([kmeans(r[:, b], 16, 6, b) for b in range(self.blocks)])
        for _ in range(3):  # anisotropic Lloyd rounds: assign by the loss, then solve for each centre
            codes = np.concatenate([self.assign(r[i : i + 1024], w[i : i + 1024]) for i in range(0, len(r), 1024)])
            for b in range(self.blocks):
                for c in range(16):
                    own = codes[:, b] == c
                    if own.any():
                        u, y = w[own, b], r[own, b]
                        m = np.eye(BLOCK) * own.sum() + (ETA - 1) * u.T @ u
                        t = y.sum(axis=0) + (ETA - 1) * (u * (u * y).sum(axis=1, keepdims=True)).sum(axis=0)
                        self.books[b, c] = np.linalg.solve(m, t)
        self.probed = self.cells_to_probe(cell, k)

    def cells_to_probe(self, cell: np.ndarray, k: int) -> int:
        """How many of the nearest cells hold REACH of the k nearest sample rows of some of the sample."""
        x = self.sample
        some = x[:: max(1, len(x) // ASKED)][:ASKED]
        k = min(k + 1, len(x))  # the row itself is the nearest
        near = np.argpartition(squares(some, x), k - 1, axis=1)[:, :k]
        rank = np.argsort(np.argsort(squares(some, self.centres), axis=1), axis=1)
        held = np.sort(np.take_along_axis(rank, cell[near], axis=1).ravel())
        return int(held[int(np.ceil(REACH * len(held))) - 1]) + 1

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def cut(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.pad))).reshape(len(x), self.blocks, BLOCK)

    def assign(self, r: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Codes by coordinate descent on |e|^2 + (ETA - 1) (e.u)^2, where u is the vector's direction."""
        e = r[:, :, None, :] - self.books[None]  # rows, blocks, 16, BLOCK
        across = (e**2).sum(axis=3)
        along = (e * w[:, :, None, :]).sum(axis=3)
        codes = across.argmin(axis=2)
        picked = np.take_along_axis(along, codes[:, :, None], axis=2)[:, :, 0]
        total = picked.sum(axis=1)
        for b in range(self.blocks):
            other = total - picked[:, b]
            codes[:, b] = (across[:, b] + (ETA - 1) * (other[:, None] + along[:, b]) ** 2).argmin(axis=1)
            picked[:, b] = along[np.arange(len(r)), b, codes[:, b]]
            total = other + picked[:, b]
        return codes

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, ...]:
        """Cells, lengths of residuals, what is added to half the squared distance, lengths of what the codes miss, and codes with two to a byte.

        Codes are of directions, so that rows near their centre are told apart as finely as those far from
        it. What is missed is known here, so its product with the vector itself is made good; what is left
        is its product with the difference of query and vector, which is small for near ones.
        """
        x = vectors - self.mean
        cell = nearest(x, self.centres)
        rest = x - self.centres[cell]
        length = np.maximum(np.linalg.norm(rest, axis=1), 1e-12)
        toward = self.cut(rest / length[:, None])
        codes = np.concatenate([self.assign(toward[i : i + 1024], self.cut(self.unit(x[i : i + 1024]))) for i in range(0, len(x), 1024)])
        missed = (toward - self.books[np.arange(self.blocks), codes]) * length[:, None, None]
        half = (x**2).sum(axis=1) / 2 - (self.cut(x) * missed).sum(axis=(1, 2))
        if codes.shape[1] % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return cell, length, half, np.sqrt((missed**2).sum(axis=(1, 2))), (codes[:, ::2] | codes[:, 1::2] << 4).astype(np.uint8)

    def route(self, ids: np.ndarray, queries: np.ndarray, held: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The cells that each query probes, and the squared distance within which a row goes on. held: rows in each cell."""
        q = queries - self.mean
        order = np.argsort(squares(q, self.centres), axis=1)
        enough = np.minimum((np.cumsum(held[order], axis=1) <= self.rerank).sum(axis=1) + 1, self.cells)
        probed = np.zeros((len(q), self.cells), bool)
        np.put_along_axis(probed, order, np.arange(self.cells) < np.maximum(self.probed, enough)[:, None], axis=1)
        far = squares(q, self.sample)
        far[ids[:, None] == self.ids[None]] = np.inf
        own = min(OWN * self.k, far.shape[1])
        np.put_along_axis(probed, self.cell[np.argpartition(far, own - 1, axis=1)[:, :own]], True, axis=1)
        cells = [np.flatnonzero(p) for p in probed]
        stands = self.rerank * len(self.sample) / self.rows
        rank = int(np.ceil(stands + 4 * np.sqrt(stands))) + 10
        bound = np.partition(far, rank, axis=1)[:, rank] if rank < far.shape[1] else np.full(len(q), np.inf)
        return cells, bound

    def scan(self, queries: np.ndarray, cell: int, lengths: np.ndarray, halves: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Estimated squared distances, queries by rows of a cell."""
        q = queries - self.mean
        tables = np.einsum("qbd,bcd->qbc", self.cut(q), self.books).astype(np.float32)
        rest = np.zeros((len(q), len(codes)), np.float32)
        for b in range(self.blocks):
            rest += tables[:, b, codes[:, b // 2] >> 4 * (b % 2) & 15]
        products = (q @ self.centres[cell])[:, None] + rest * lengths
        return (q**2).sum(axis=1)[:, None] - 2 * (products - halves)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between all rows of both."""
    return (a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def compared(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """query_id, vec_id, score: each task's k nearest rows to some queries, by comparing all."""
    shared = rows.sparkSession.sparkContext.broadcast((ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        vec, score = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
        for b in batches:
            if b.num_rows:
                x, own = matrix(b.column("vector"), queries.shape[1]), b.column("vec_id").to_numpy()
                far = np.sqrt(((queries[:, None] - x[None]) ** 2).sum(axis=2))
                far[ids[:, None] == own] = np.inf
                vec, score = np.concatenate([vec, np.broadcast_to(own, far.shape)], axis=1), np.concatenate([score, far], axis=1)
                best = np.lexsort((vec, score), axis=1)[:, :k]
                vec, score = np.take_along_axis(vec, best, axis=1), np.take_along_axis(score, best, axis=1)
        q, j = np.nonzero(np.isfinite(score))
        yield record_batch(pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]), ids[q], vec[q, j], score[q, j])

    return rows.mapInArrow(run, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row of vectors that is_query picks."""
    spark = prepare(vectors.sparkSession)
    rows = cut(usable(vectors))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = rows.select(F.size("vector")).first()[0]
    equal = Window.partitionBy("vector").orderBy("vec_id")  # a group limit: each task passes on k + 1 rows of a vector
    distinct = cut(rows.withColumn("r", F.row_number().over(equal)).filter(F.col("r") <= k + 1).select("vec_id", "vector"))
    sample = distinct.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(256, min(SAMPLE, SAMPLE_NUMBERS // d))).toArrow()
    index = spark.sparkContext.broadcast(Index(matrix(sample.column("vector").combine_chunks(), d), sample.column("vec_id").to_numpy(), distinct.count(), k))
    most = index.value.rerank

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("vec_id", pa.int64()), ("cell", pa.int32()), ("length", pa.float64()), ("half", pa.float64()), ("missed", pa.float64()), ("code", pa.binary())])
        for b in batches:
            if b.num_rows:
                cell, length, half, missed, codes = index.value.encode(matrix(b.column("vector"), d))
                yield record_batch(schema, b.column("vec_id"), cell.astype(np.int32), length, half, missed, [c.tobytes() for c in codes])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("query_id", pa.int64()), ("query", pa.list_(pa.float64())), ("cells", pa.list_(pa.int32())), ("bound", pa.float64())])
        for b in batches:
            if b.num_rows:
                cells, bound = index.value.route(b.column("query_id").to_numpy(), matrix(b.column("query"), d), held)
                yield record_batch(schema, b.column("query_id"), b.column("query"), cells, bound)

    coded = cut(distinct.mapInArrow(code, "vec_id long, cell int, length double, half double, missed double, code binary"))
    sizes = cut(coded.groupBy("cell").agg(F.count("*").alias("n"), F.ceil(F.count("*") / CHUNK).alias("chunks")))  # a row for each of CELLS at most
    known = sizes.toArrow()
    held = np.zeros(index.value.cells, np.int64)
    held[known.column("cell").to_numpy()] = known.column("n").to_numpy()
    sizes, units = sizes.select("cell", "chunks"), sum(known.column("chunks").to_pylist())
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-units // 16))
    by = ["cell", "chunk"]
    chunks = coded.join(F.broadcast(sizes), "cell").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")))
    chunks = chunks.repartition(tasks, *by).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("vec_id", "length", "half", "missed", "code"))).alias("rows"))
    asked = cut(rows.filter(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("query"), F.count("*").alias("own")))
    probes = asked.mapInArrow(route, "query_id long, query array<double>, cells array<int>, bound double").select("query_id", "query", "bound", F.explode("cells").alias("cell"))
    probes = probes.join(F.broadcast(sizes), "cell").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-asked.count() // QUERIES)))).alias("block")
    blocks = probes.repartition(tasks, *by).groupBy(*by, block).agg(F.collect_list(F.struct("query_id", "query", "bound")).alias("queries"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("estimate", pa.float64())])
        for b in batches:
            for cell, own, asked_ in zip(b.column("cell").to_pylist(), b.column("rows"), b.column("queries"), strict=True):
                own, asked_ = own.values, asked_.values
                ids, lengths, halves, missed = (own.field(c).to_numpy() for c in ("vec_id", "length", "half", "missed"))
                codes = np.frombuffer(b"".join(own.field("code").to_pylist()), np.uint8).reshape(len(ids), -1)
                queries, bounds = asked_.field("query_id").to_numpy(), asked_.field("bound").to_numpy()
                far = index.value.scan(matrix(asked_.field("query"), d), cell, lengths, halves, codes)
                best = np.argsort(far, axis=1, kind="stable")[:, :most]  # equal estimates: the smaller ids
                near = np.take_along_axis(far, best, axis=1)
                near[ids[best] == queries[:, None]] = np.inf
                # what is left of an error is a product with a direction that knows nothing of it
                slack = SURE * 2 * np.sqrt(bounds)[:, None] * missed[best] / np.sqrt(d)
                x, y = np.nonzero(near <= bounds[:, None] * 1.02 + slack + 1e-9)
                ok = np.isfinite(near[x, y])
                yield record_batch(schema, queries[x[ok]], ids[best[x[ok], y[ok]]], near[x[ok], y[ok]])

    found = blocks.join(chunks, by).select("cell", "rows", "queries").mapInArrow(scan, "query_id long, vec_id long, estimate double")
    rough = Window.partitionBy("query_id").orderBy("estimate", "vec_id")
    best = found.withColumn("r", F.row_number().over(rough)).filter(F.col("r") <= most).select("query_id", "vec_id").distinct()
    exact = best.join(rows, "vec_id").join(asked, "query_id")
    total = F.aggregate(F.zip_with("vector", "query", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def ranked(near: DataFrame) -> DataFrame:
        return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    near = cut(ranked(exact.select("query_id", "vec_id", F.sqrt(total).alias("score"))))
    counts = near.groupBy("query_id").agg(F.count("*").alias("n"))
    short = cut(asked.join(counts, "query_id", "left").filter(F.coalesce("n", F.lit(0)) < F.least(F.lit(k), F.lit(n) - F.col("own"))).select("query_id", "query"))
    left = short.count()
    if not left:
        return near
    near = near.join(short, "query_id", "left_anti")
    blocks_ = -(-left // QUERIES)
    for i in range(blocks_):
        some = short.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks_)) == i).toArrow()
        near = near.unionByName(ranked(compared(rows, some.column("query_id").to_numpy(), matrix(some.column("query").combine_chunks(), d), k)))
    return near


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)
