"""Near-duplicates by SimHash fingerprints and the general pigeonhole principle.

Fingerprints: ASCII letters are lower-cased, words are runs without ASCII white space, and every
shingle of `words` words (space-joined, repeats included; of a shorter text, the whole) votes with
its XXH64 (seed 42) on each of 64 bits. A bit is set if more than half of the votes set it.

Search, over distinct fingerprints: bits are grouped by their correlation into parts. Two
fingerprints that differ in at most D bits agree in some part up to that part's threshold, if the
thresholds plus one add up to D + 1. The thresholds are dealt by dynamic programming on the numbers
of candidates that each part gives at each threshold: exact pair counts over all fingerprints at
zero, times the growth that the bits' frequencies imply beyond it. Each fingerprint is stored under
its parts' values, probes all values within the threshold, and candidates are verified.

A crowded value never has its pairs listed. There, each fingerprint is put under all places within
D / 2 bits (for two: itself and its 64 one-bit neighbours), so that any two that differ in D bits or
fewer meet, and no others do: all of one meeting are linked to the least. Linked fingerprints form components by alternating
large-star and small-star rounds.

Defined results: a text without words (null, empty) has fingerprint zero and links like any other;
a null doc_id stays out of the result's least ids but keeps its row. Ties and repeated rows share a
fingerprint, so a component. Further columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cindertrace.llm.common import cut, packed, record_batch, table, texts
from cindertrace.llm.words import LOWER, Words, groups, mix, signed

BITS = 64
#: Fingerprints that share a part's value: up to so many are compared one by one.
CROWD = 32


def fingerprint(shingles: list[int]) -> int:
    votes = np.unpackbits(np.array(shingles, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(shingles)).tobytes(), "big")


def fingerprints(documents: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    digest = xxhash.xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows, np.uint64)
            for i, j, buf, offsets in groups(b.column("text")):
                w = Words(LOWER[buf], offsets)
                n = len(w)
                if not n:
                    continue
                # all words with one blank between them, so that each shingle is a slice
                lengths = w.ends - w.starts
                to = np.cumsum(lengths + 1) - 1
                flat = np.full(int(to[-1]) + 1, 0x20, np.uint8)
                place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                flat[place + np.repeat(to - lengths, lengths)] = w.buf[place + np.repeat(w.starts, lengths)]
                data, begin = flat.tobytes(), (to - lengths).tolist()
                counts = w.counts()
                first, sizes = w.first[:-1], np.where(counts >= words, counts - words + 1, (counts > 0).astype(np.int64))
                starts = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
                ends = np.minimum(starts + words, np.repeat(w.first[1:], sizes)) - 1
                to = to.tolist()
                h = np.array([digest(data[begin[x] : to[y]], 42) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)], ">u8")
                some = np.flatnonzero(sizes)
                at = (np.cumsum(sizes) - sizes)[some]
                votes = _votes(h, at, sizes[some])
                out[i + some] = np.packbits(votes, axis=1).view(">u8").ravel()
            yield record_batch(schema, b.column("doc_id"), signed(out))

    return texts(documents).mapInArrow(run, "doc_id long, fp long")


def _votes(h: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of shingles: the bits that more than half of them set."""
    ends = at + sizes
    sums = np.zeros((len(at), BITS), np.int64)
    step = 1 << 16
    for x in range(0, len(h), step):  # bounds the memory that the unpacked bits take
        y = min(len(h), x + step)
        bits = np.unpackbits(h[x:y].view(np.uint8).reshape(-1, 8), axis=1)
        a, z = np.searchsorted(ends, x, "right"), np.searchsorted(at, y)
        cuts = np.maximum(at[a:z], x) - x
        sums[a:z] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
    return (2 * sums > sizes[:, None]).astype(np.uint8)


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how often each pair of bits is set together, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for b in batches:
            x = np.unpackbits(b.column("fp").to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            both += np.rint(x.T @ x).astype(np.int64)
            n += len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "both": [both.ravel().tolist()]})

    # one row of 4096 counts for each task, added up before they reach the driver
    parts = distinct.mapInArrow(run, "n long, both array<long>")
    sums = parts.select("n", F.posexplode("both").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
    both = np.zeros(BITS * BITS)
    for r in sums:
        both[r["k"]] = r["x"]
    return (int(sums[0]["n"]) if sums else 0), both.reshape(BITS, BITS)


def correlated_parts(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Deals the bits to parts of equal size, so that correlated bits share one."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = -(-len(left) // (parts - k))
        own = [max(left, key=lambda b: (tie[b, sorted(left)].sum(), -b))]
        left -= set(own)
        while len(own) < size:
            nearest = max(left, key=lambda b: (tie[b, own].sum(), -b))
            own.append(nearest)
            left.remove(nearest)
        out.append(sorted(own))
    return out


def deal_thresholds(costs: list[list[float]], budget: int) -> list[int]:
    """The cheapest thresholds (-1: the part is not used) whose sum with one for each part is the budget.

    costs[i][t + 1] is what part i costs at threshold t.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, len(own) - 1):
                to = used + t + 1
                if to <= budget and (to not in nxt or cost + own[t + 1] < nxt[to][0]):
                    nxt[to] = (cost + own[t + 1], [*chosen, t])
        best = nxt
    return best[budget][1]


def value_of(fp: Column, bits: list[int]) -> Column:
    """The given bits of a fingerprint (0: the highest), the others zero."""
    mask = sum(1 << (BITS - 1 - b) for b in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def plan_parts(distinct: DataFrame, within: int) -> list[tuple[list[int], int]]:
    """Parts and thresholds for a search within that many bits."""
    n, both = bit_statistics(distinct)
    p = np.diag(both) / max(n, 1)
    plans = []
    for k in range(1, within + 2):
        parts = correlated_parts(n, both, k)
        values = F.explode(F.array(*(F.struct(F.lit(i).alias("part"), value_of(F.col("fp"), bits).alias("v")) for i, bits in enumerate(parts)))).alias("x")
        pairs = dict(distinct.select(values).groupBy("x.part", "x.v").count().groupBy("part").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2)).collect())
        costs = []
        for i, bits in enumerate(parts):
            ratio = float(sum(2 * p[b] * (1 - p[b]) / max(p[b] ** 2 + (1 - p[b]) ** 2, 1e-9) for b in bits))
            own, probes, grown = [0.0], 0.0, 1.0
            for t in range(within + 1):
                probes += float(len(list(combinations(range(len(bits)), t)))) if t < 3 else np.inf
                grown *= max(1.0, ratio / t) if t else 1.0
                own.append(n * (1 + probes) + (pairs.get(i) or 0.0) * grown)
            costs.append(own)
        chosen = deal_thresholds(costs, within + 1)
        plans.append((sum(c[t + 1] for c, t in zip(costs, chosen, strict=True)), [(b, t) for b, t in zip(parts, chosen, strict=True) if t >= 0]))
    return min(plans, key=lambda x: x[0])[1]


def flips(bits: list[int], radius: int) -> list[int]:
    """Signed masks that change up to `radius` of the bits."""
    out = [sum(1 << (BITS - 1 - b) for b in some) for r in range(radius + 1) for some in combinations(bits, r)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def xor_each(fp: Column, masks: list[int]) -> Column:
    return F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: fp.bitwiseXOR(m)))


def links(distinct: DataFrame, within: int = 2) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that connect all that lie within that many bits (an even number)."""
    if within % 2:
        raise ValueError("within must be even")
    parts = plan_parts(distinct, within)
    stored = F.array(*(F.struct(F.lit(i).alias("part"), value_of(F.col("fp"), bits).alias("v")) for i, (bits, _) in enumerate(parts)))
    stored = distinct.select("fp", F.explode(stored).alias("x")).select("fp", "x.part", "x.v")
    # a value's crowd is all that are stored under it or probe it
    probes = None
    for i, (bits, t) in enumerate(parts):
        own = distinct.select("fp", F.lit(i).alias("part"), xor_each(value_of(F.col("fp"), bits), flips(bits, t)).alias("v"))
        probes = own if probes is None else probes.unionByName(own)
    crowds = stored.groupBy("part", "v").count().filter("count > 1 OR part IN (%s)" % (",".join(str(i) for i, (_, t) in enumerate(parts) if t) or "-1"))
    crowds = cut(crowds)
    small, large = crowds.filter(F.col("count") <= CROWD), crowds.filter(F.col("count") > CROWD)
    left = probes.join(small.select("part", "v"), ["part", "v"]).withColumnRenamed("fp", "a")
    near = left.join(stored.withColumnRenamed("fp", "b"), ["part", "v"]).filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= within))
    # each part is a plan of its own: as one, with what its callers add, it is planned again after every stage and fills the driver
    found = cut(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    # crowded values: meet at the points halfway between
    half = within // 2
    meet = cut(probes.join(large.select("part", "v"), ["part", "v"]).select("fp").distinct())
    meet = meet.select("fp", xor_each(F.col("fp"), flips(list(range(BITS)), half)).alias("m"))
    least = meet.groupBy("m").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").select("m", "a")
    met = cut(meet.join(least, "m").filter("fp != a").select("a", F.col("fp").alias("b")).distinct())
    return found.unionByName(met)


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each one's component, for edges (a, b) between longs."""
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    while True:
        # large star: all greater neighbours of a node are linked to the least of its neighbourhood
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its lesser neighbours are linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        small = cut(small)
        if small.count() == edges.count() and small.exceptAll(edges).isEmpty():
            return small.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = small


def near_duplicates(documents: DataFrame, words: int = 3, within: int = 2) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable over links of `within` bits or fewer)."""
    prints = cut(fingerprints(documents, words))
    least = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(least.select("fp"), within))
    of = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = of.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Similarity of the five-word shingle sets from which on documents are near copies, and words in a shingle.
SIMILARITY, SHINGLE = 0.8, 5
#: Bands of minima, and minima in a band: two sets at SIMILARITY share a band with a chance of 0.9996.
BANDS, ROWS = 20, 5
#: Texts that share a band: up to so many are compared one by one.
BAND_CROWD = 12
#: Texts, and shingles, in a block of a crowded band: any two blocks of a band meet in one task.
BLOCK, BLOCK_SHINGLES = 256, 1 << 17


def _shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all SHINGLE-word sequences (of a shorter text, the whole), and where each text's begin."""
    counts = w.counts()
    size = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(w.first[:-1] - first[:-1], size) + np.arange(first[-1])
    whole = np.minimum(at + SHINGLE, np.repeat(w.first[1:], size))
    return w.span_hashes(at, whole), first


def sketches(documents: DataFrame) -> DataFrame:
    """doc_id, copy (digest of the whole text), fp (five-word SimHash), bands (one hash each; none without words), size (shingles)."""
    schema = pa.schema([("doc_id", pa.int64()), ("copy", pa.binary()), ("fp", pa.int64()), ("bands", pa.list_(pa.int64())), ("size", pa.int64())])
    odd = [np.uint64(x) for x in (np.random.default_rng(17).integers(0, 1 << 62, BANDS * ROWS) * 2 + 1).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            copy = [md5(x.encode()).digest() for x in b.column("text").to_pylist()]
            fp, bands, size = np.zeros(b.num_rows, np.uint64), [[]] * b.num_rows, np.zeros(b.num_rows, np.int64)
            for i, j, buf, offsets in groups(b.column("text")):
                h, first = _shingles(Words(LOWER[buf], offsets))
                some = np.flatnonzero(np.diff(first))
                if not len(some):
                    continue
                at = first[some]
                size[i + some] = np.diff(first)[some]
                fp[i + some] = np.packbits(_votes(h.astype(">u8"), at, np.diff(first)[some]), axis=1).view(">u8").ravel()
                own = np.zeros((len(some), BANDS), np.uint64)
                for k, a in enumerate(odd):
                    band = k // ROWS
                    own[:, band] = mix(own[:, band] ^ np.minimum.reduceat(h * a, at) ^ np.uint64(k))
                for d, x in zip((i + some).tolist(), signed(own).tolist(), strict=True):
                    bands[d] = x
            yield record_batch(schema, b.column("doc_id"), copy, signed(fp), bands, size)

    return texts(documents).mapInArrow(run, "doc_id long, copy binary, fp long, bands array<long>, size long")


def candidates(one: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents worth comparing, for one(doc_id, fp, bands): near fingerprints, shared bands.

    A crowded band lists no pairs: its members are compared with the one that shares most bands with
    most others (the text that the others were copied from, if it is there) and with the least. What
    these leave apart, crowd_links() compares.
    """
    least = cut(one.groupBy("fp").agg(F.min("doc_id").alias("least")))
    same = one.join(least, "fp").filter("doc_id != least").select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
    near = links(least.select("fp"), 2)
    near = near.join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    rows = one.select("doc_id", F.posexplode("bands").alias("band", "v"))
    shared = rows.groupBy("band", "v").agg(F.count("*").alias("n")).filter("n > 1")
    live = cut(rows.join(shared, ["band", "v"]))
    wide = cut(live.filter(F.col("n") > BAND_CROWD))
    known = wide.groupBy("doc_id").agg(F.sum("n").alias("known"))
    centre = wide.join(known, "doc_id").groupBy("band", "v").agg(F.max(F.struct("known", (-F.col("doc_id")).alias("x"))).alias("c"), F.min("doc_id").alias("m"))
    starred = wide.join(centre, ["band", "v"]).select("doc_id", F.explode(F.array(-F.col("c.x"), F.col("m"))).alias("c")).filter("doc_id != c").select(F.col("doc_id").alias("a"), F.col("c").alias("b"))
    few = live.filter(F.col("n") <= BAND_CROWD).select("band", "v", "doc_id")
    pairs = few.withColumnRenamed("doc_id", "a").join(few.withColumnRenamed("doc_id", "b"), ["band", "v"]).filter("a < b").select("a", "b")
    both = same.unionByName(near).unionByName(cut(starred)).unionByName(cut(pairs))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sets(column: pa.Array) -> list[np.ndarray]:
    """Each text's sorted distinct shingles."""
    own = []
    for _, _, buf, offsets in groups(column):
        h, first = _shingles(Words(LOWER[buf], offsets))
        own += [np.unique(h[p:q]) for p, q in pairwise(first.tolist())]
    return own


def _alike(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of the sets at left are similar enough to which at right."""
    lengths = np.array([len(x) for x in sets])
    shingle, count = np.unique(np.concatenate(sets), return_counts=True)
    shingle = shingle[count > 1]
    both = np.zeros((len(left), len(right)))
    for k in range(0, len(shingle), 4096):
        some = shingle[k : k + 4096]
        has = np.zeros((len(sets), len(some)), np.float32)
        for i, x in enumerate(sets):
            part = x[np.searchsorted(x, some[0]) : np.searchsorted(x, some[-1], "right")]
            at = np.searchsorted(some, part)
            has[i, at[some[at] == part]] = 1
        both += has[left] @ has[right].T
    return (both > 0) & (both >= SIMILARITY * (lengths[left][:, None] + lengths[right] - both))


def _block_links(t: pa.Table) -> pa.Table:
    """Edges (a, b) that link all roots of one or two blocks which a similar pair of their texts links."""
    ids, roots, side = (t.column(c).to_numpy() for c in ("doc_id", "root", "side"))
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    x, y = np.nonzero(_alike(sum((_sets(c) for c in t.column("text").chunks), []), left, right) & (roots[left][:, None] != roots[right]))
    parent = {r: r for r in roots.tolist()}

    def find(r):
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r

    ends, first = np.unique(np.sort(np.stack([roots[left[x]], roots[right[y]]], 1), axis=1), axis=0, return_index=True)
    found = []
    for (p, q), k in zip(ends.tolist(), first.tolist(), strict=True):
        p, q = find(p), find(q)
        if p != q:
            parent[p] = q
            found.append((int(ids[left[x[k]]]), int(ids[right[y[k]]])))
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def bodies(documents: DataFrame, copies: DataFrame) -> DataFrame:
    """node, text of copies(node, copy): the text that each one stands for, once."""
    own = texts(documents).select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("copy"), "text")
    return own.join(copies.select("node", "copy"), "copy").dropDuplicates(["node"]).select("node", "text")


def crowd_links(documents: DataFrame, copies: DataFrame, one: DataFrame, roots: DataFrame) -> DataFrame | None:
    """Links (a, b) between roots(node, root) by similar texts that share a crowded band of one(doc_id, bands, size).

    Texts of one root need no comparison. In each band the root with most texts is the bulk, and all
    others are compared with it and with each other: both are dealt into blocks, and each task gets
    two blocks. None if no band has more than one root.
    """
    rows = one.select("doc_id", "size", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(BANDS - 1)).alias("band"), F.col("bands").alias("v"))).alias("x")).select("doc_id", "size", "x.band", "x.v")
    crowds = rows.groupBy("band", "v").count().filter(F.col("count") > BAND_CROWD).select("band", "v")
    wide = rows.join(crowds, ["band", "v"]).join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    wide = cut(wide)
    own = wide.groupBy("band", "v", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    bulk = own.groupBy("band", "v").agg(F.max(F.struct("n", "root", "size")).alias("bulk"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("roots")).filter("roots > 1")

    def blocks(n, size):
        return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES))

    bulk = cut(bulk.select("band", "v", F.col("bulk.root").alias("most"), blocks(F.col("bulk.n"), F.col("bulk.size")).alias("p"), blocks(F.col("n") - F.col("bulk.n"), F.col("size") - F.col("bulk.size")).alias("q")))
    if bulk.isEmpty():
        return None
    inside, h = F.col("root") == F.col("most"), F.xxhash64("doc_id")
    i, j = F.pmod(h, F.col("q")), F.pmod(h, F.col("p"))

    def task(x, y, side):
        return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), side.cast("int").alias("side"))

    # blocks of the bulk count as -1, -2 and so on; a block that meets itself is on both sides (2)
    with_bulk = F.transform(F.sequence(F.lit(1).cast("long"), F.col("p")), lambda k: task(i, -k, F.lit(0)))
    with_rest = F.transform(F.sequence(F.lit(0).cast("long"), F.col("q") - 1), lambda k: task(F.least(i, k), F.greatest(i, k), F.when(k == i, 2).when(i < k, 0).otherwise(1)))
    of_bulk = F.transform(F.sequence(F.lit(0).cast("long"), F.col("q") - 1), lambda k: task(k, -1 - j, F.lit(1)))
    dealt = wide.join(bulk, ["band", "v"]).select("doc_id", "root", "band", "v", F.explode(F.when(inside, of_bulk).otherwise(F.concat(with_bulk, with_rest))).alias("t")).select("doc_id", "root", "band", "v", "t.*")
    own = bodies(documents, copies.join(wide.select(F.col("doc_id").alias("node")).distinct(), "node", "left_semi"))
    told = dealt.join(own.withColumnRenamed("node", "doc_id"), "doc_id")
    return told.groupBy("band", "v", "x", "y").applyInArrow(_block_links, "a long, b long")


def verified(documents: DataFrame, copies: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets of shingles are similar enough, by the texts themselves."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [_sets(b.column(c)) for c in ("x", "y")]
            ok = []
            for x, y in zip(*sets, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both > 0 and both >= SIMILARITY * (len(x) + len(y) - both))
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], schema=schema)

    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    some = cut(bodies(documents, copies.join(ids, "node", "left_semi")))
    told = pairs.join(some.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(some.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return told.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def classes(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, copy of every row, and copy, root: distinct texts by class, told by equal texts or SIMILARITY of their shingles or more.

    Fingerprints alone cannot find these: at a similarity of 0.8, 64-bit fingerprints of five-word
    shingles differ in 3 to 14 bits, and no split of 64 bits searches within 14 at bearable cost.
    So bands of minima give further candidates, and the texts decide on all. Texts, not doc_ids, are
    compared: each distinct one has a number, in the order of the least doc_id that it stands under.
    """
    all_ = cut(sketches(documents))
    copies = all_.groupBy("copy").agg(F.min("doc_id").alias("least"), F.min(F.struct("fp", "bands", "size")).alias("m")).select("copy", "least", "m.*")
    # numbered once and written, so that the numbers hold however often it is read
    copies = cut(cut(copies.repartitionByRange(F.col("least").asc_nulls_last(), "copy").sortWithinPartitions(F.col("least").asc_nulls_last(), "copy")).withColumn("node", F.monotonically_increasing_id()))
    one = copies.filter(F.size("bands") > 0).select(F.col("node").alias("doc_id"), "fp", "bands", "size")
    edges = cut(verified(documents, copies, cut(candidates(one))))
    roots = cut(components(edges))
    more = crowd_links(documents, copies, one, roots)
    if more is not None:
        more = cut(more)
        if not more.isEmpty():
            roots = components(edges.unionByName(more))
    of = copies.select("copy", "node").join(roots, "node", "left").select("copy", F.coalesce("root", "node").alias("root"))
    return all_.select("doc_id", "copy"), of


def near_copies(documents: DataFrame) -> DataFrame:
    """doc_id, component_id of every row: the least doc_id (null if it has none) of all rows whose texts are of its class."""
    rows, of = classes(documents)
    rows = cut(rows.join(of, "copy"))
    return rows.join(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """documents without all but one row of each class of near copies: that of the least doc_id (nulls last).

    Of texts with that doc_id the one with the least digest stays; of rows equal in doc_id and text one stays.
    """
    rows, of = classes(documents)
    ids = cut(rows.groupBy("doc_id", "copy").agg(F.count("*").alias("n")).join(of, "copy"))
    best = ids.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")).alias("b"))
    kept = cut(best.join(ids.select("root", "doc_id", "copy", "n").withColumnsRenamed({"doc_id": "d", "copy": "c"}), "root").filter(F.col("d").eqNullSafe(F.col("b.doc_id")) & (F.col("c") == F.col("b.copy"))).select(F.col("d").alias("doc_id"), F.col("c").alias("copy"), "n"))
    gone = ids.join(kept, ids["doc_id"].eqNullSafe(kept["doc_id"]) & (ids["copy"] == kept["copy"]), "left_anti").select("doc_id", "copy")
    docs = packed(documents).withColumn("copy", F.unhex(F.md5(F.coalesce(F.col("row.text"), F.lit("")).cast("binary"))))
    left = docs.join(gone, docs["doc_id"].eqNullSafe(gone["doc_id"]) & (docs["copy"] == gone["copy"]), "left_anti")
    twice = kept.filter("n > 1").select("doc_id", "copy")
    if twice.isEmpty():
        return left.select("row.*")
    same = left["doc_id"].eqNullSafe(twice["doc_id"]) & (left["copy"] == twice["copy"])
    once = left.join(twice, same, "left_semi").groupBy("doc_id", "copy").agg(F.first("row").alias("row"))
    return left.join(twice, same, "left_anti").select("row.*").unionByName(once.select("row.*"))
