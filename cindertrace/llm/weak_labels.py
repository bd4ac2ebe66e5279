"""A quality classifier from weak labels.

Overlapping heuristic labellers vote on each document: reject, keep or abstain. Documents are
counted by their votes (at most 3^LABELLERS patterns, whatever the corpus), and expectation-
maximisation over those counts estimates how often each labeller casts each vote on good and on bad
documents; the posterior of a pattern is its documents' soft label. A linear scorer over hashed
words and the labellers' findings is fitted to the posteriors of a bounded sample and decides on
every document.

One labeller knows harsh words. They are mined, language by language, from a bounded sample of rows
labelled toxic or not: words and word beginnings that toxic texts use many times as often. It
rejects a text that has more of them than chance in clean texts of its language explains.

Bounds: LABELLED rows of either label are mined, SAMPLE distinct documents fit the scorer, both chosen by
the hash of doc_id; at most HARSH words are kept as harsh, the most used ones. Vote counts, and the
decisions, cover every document.

Defined results: a text without words (null, empty, white space) is rejected; a null language is a
language of its own; without labels no harsh words are known; ties and repeated rows get equal
scores; an empty table gives no rows. Labels with a null doc_id or null toxic are not used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindertrace.llm.common import cut, prepare, record_batch, row_key, table
from cindertrace.llm.words import LETTER_BYTES, LOWER, U, Words, groups, mix, signed

LABELLED, SAMPLE = 4000, 6000
#: Most harsh words that are kept, and the size of the scorer's table.
HARSH, TABLE = 20_000, 1 << 16
#: Bytes of a word's beginning that is looked at besides the whole word.
BEGINNING = 7
#: -log10 of the chance from which on harsh words count.
ODD = 2.5
REJECT, ABSTAIN, KEEP = 0, 1, 2
LABELLERS = ("signs", "capitals", "stutter", "lines", "cells", "harsh", "prose")

NOT_LINE_FEED = np.ones(256, bool)
NOT_LINE_FEED[0x0A] = False
SIGN = np.zeros(256, bool)
SIGN[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def beginnings(w: Words, buf: np.ndarray) -> np.ndarray:
    """Hashes of the first bytes of words that are longer than those."""
    out = np.zeros(len(w), U)
    long = np.flatnonzero(w.ends - w.starts > BEGINNING)
    if len(long):
        own = buf[w.starts[long][:, None] + np.arange(BEGINNING)].astype(U)
        h = np.zeros(len(long), U)
        for k in range(BEGINNING):
            h = h * U(257) + own[:, k]
        out[long] = mix(h) | U(1)
    return out


def language_salt(lang: list) -> np.ndarray:
    return mix(np.array([hash_text(x) for x in lang], U))


def hash_text(text: str | None) -> int:
    h = 1469598103934665603
    for c in (text or "").encode():
        h = (h ^ c) * 1099511628211 % (1 << 64)
    return h


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over [first[i], first[i + 1])."""
    total = np.concatenate([np.zeros(1, np.float64), np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def findings(buf: np.ndarray, offsets: np.ndarray, lang: list, harsh: np.ndarray, rates: dict) -> tuple[Words, np.ndarray]:
    """The bare words of some texts, and for each text its word count and what the labellers look at."""
    w = Words(buf, offsets)
    n = np.maximum(w.counts(), 1)
    last, before = buf[w.ends - 1], buf[np.maximum(w.ends - 2, w.starts)]
    signs = sums((w.ends - w.starts > 2) & SIGN[last] & SIGN[before] & (before != 0x2E), w.first) / n
    capital = (buf >= 0x41) & (buf <= 0x5A)
    letters = LETTER_BYTES[LOWER[buf]] & ~((buf >= 0x30) & (buf <= 0x39))
    capitals = sums(capital, offsets) / np.maximum(sums(letters, offsets), 1)
    again = np.zeros(len(w), bool)
    again[1:] = w.hashes[1:] == w.hashes[:-1]
    again[w.first[:-1][w.counts() > 0]] = False
    stutter = sums(again, w.first) / n
    cells = sums((w.ends - w.starts == 1) & (last == 0x7C), w.first) / n
    lines = Words(buf, offsets, NOT_LINE_FEED)
    key = mix(lines.hashes ^ mix(lines.doc_of().astype(U)))
    _, at = np.unique(key, return_index=True)
    first_seen = np.zeros(len(lines), bool)
    first_seen[at] = True
    size = (lines.ends - lines.starts).astype(np.float64)
    repeated = sums(np.where(first_seen, 0, size), lines.first) / np.maximum(sums(size, lines.first), 1)
    repeated[lines.counts() < 6] = 0
    ends = sums((last == 0x2E) | (last == 0x3F) | (last == 0x21), w.first)
    low = LOWER[buf]
    bare = Words(low, offsets, LETTER_BYTES)
    salt = np.repeat(language_salt(lang), bare.counts())
    hit = np.zeros(len(bare), bool)
    if len(harsh):
        for h in (bare.hashes, beginnings(bare, low)):
            own = mix(h ^ salt)
            hit |= (harsh[np.minimum(np.searchsorted(harsh, own), len(harsh) - 1)] == own) & (h != 0)
    hits = sums(hit, bare.first)
    expected = np.array([rates.get(x or "", 0.0) for x in lang]) * bare.counts() + 0.002
    return bare, np.column_stack([w.counts(), signs, capitals, stutter, repeated, cells, hits, surprise(hits, expected), ends])


def surprise(hits: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """-log10 of the chance of so many hits or more, where they come by themselves as expected."""
    out = np.zeros(len(hits))
    for i in np.flatnonzero(hits > 0):
        c, rate = int(hits[i]), float(expected[i])
        if c > 60 or c > 20 * rate + 10:
            out[i] = 20.0 if c > 2 * rate else 0.0
            continue
        term, below = exp(-rate), 0.0
        for k in range(c):
            below += term
            term *= rate / (k + 1)
        out[i] = min(20.0, -np.log10(max(1.0 - below, term, 1e-20)))
    return out


def votes(x: np.ndarray) -> np.ndarray:
    """One vote of each labeller for each text."""
    n, signs, capitals, stutter, repeated, cells, hits, odd, ends = x.T

    def cast(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, REJECT, np.where(good, KEEP, ABSTAIN))

    none = n < 0
    return np.column_stack([
        cast(signs > 0.1, signs < 0.02),
        cast((capitals > 0.35) & (n > 3), none),
        cast((stutter > 0.2) & (n > 8), stutter < 0.05),
        cast(repeated > 0.5, none),
        cast((cells > 0.1) & (n > 8), none),
        cast(odd > ODD, (hits == 0) & (n > 40)),
        cast(n < 1, (ends >= n / 40) & (ends > 0) & (signs < 0.1) & (cells < 0.1) & (stutter < 0.2)),
    ])


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def mine_harsh_words(documents: DataFrame, labels: DataFrame) -> tuple[np.ndarray, dict[str, float]]:
    """Salted hashes of harsh words, sorted, and for each language how often clean texts use them by word."""
    spark = prepare(documents.sparkSession)
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("toxic")]
    some = known.filter("toxic = 1").orderBy(*by_hash).limit(LABELLED).unionByName(known.filter("toxic = 0").orderBy(*by_hash).limit(LABELLED))
    some = some.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang")).join(F.broadcast(some), "doc_id")
    schema = pa.schema([("h", pa.int64()), ("lang", pa.string()), ("toxic", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, toxic = b.column("lang").to_pylist(), b.column("toxic").to_numpy()
            for i, j, buf, offsets in groups(b.column("text")):
                low = LOWER[buf]
                w = Words(low, offsets, LETTER_BYTES)
                doc, salt = w.doc_of(), language_salt(lang[i:j])
                for h in (w.hashes, beginnings(w, low)):
                    own, d = mix(h ^ salt[doc])[h != 0], doc[h != 0]
                    pairs, n = np.unique(np.stack([d.astype(U), own]), axis=1, return_counts=True)
                    d = pairs[0].astype(np.int64)
                    yield record_batch(schema, signed(pairs[1].copy()), [lang[i + k] for k in d.tolist()], toxic[i + d], n.astype(np.int64))
                yield record_batch(schema, np.zeros(j - i, np.int64), lang[i:j], toxic[i:j], w.counts().astype(np.int64))

    counted = rows.mapInArrow(run, "h long, lang string, toxic int, n long")

    def total(column: str, label: int) -> F.Column:
        return F.sum(F.when(F.col("toxic") == label, F.col(column)).otherwise(0))

    by = cut(counted.withColumn("one", F.lit(1)).groupBy("lang", "h").agg(total("n", 1).alias("bad"), total("n", 0).alias("good"), total("one", 1).alias("docs"), total("one", 0).alias("good_docs")).filter("docs >= 4 OR h = 0"))
    size = {r["lang"]: (r["bad"], r["good"], r["docs"], r["good_docs"]) for r in by.filter("h = 0").collect()}  # a row for each language
    if not size:
        return np.zeros(0, U), {}
    sizes = spark.createDataFrame([(k, *(float(max(x, 1)) for x in own)) for k, own in size.items()], "lang string, n_bad double, n_good double, all_bad double, all_good double")
    lift = (F.col("bad") / F.col("n_bad")) / ((F.col("good") + 0.5) / F.col("n_good"))
    # and in more toxic texts than chance allows for any word of a large vocabulary (a Poisson tail below e^-16)
    chance = (F.col("good_docs") + 0.5) / F.col("all_good") * F.col("all_bad")
    tail = F.col("docs") * F.ln(F.col("docs") / chance) - (F.col("docs") - chance)
    found = by.filter("h != 0").join(F.broadcast(sizes), "lang").filter((lift > 12) & (F.col("docs") > chance) & (tail > 16)).orderBy(F.desc("bad"), "h").limit(HARSH).collect()
    rates: dict[str, float] = {}
    for r in found:
        rates[r["lang"]] = rates.get(r["lang"], 0.0) + r["good"] / max(size[r["lang"]][1], 1)
    return np.sort(np.array([r["h"] for r in found], np.int64).view(U)), rates


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Dawid and Skene's model over vote patterns, with two ways of being bad: harsh, and poor in another way.

    Returns the posterior of each pattern being bad, and the vote rates of each labeller by class
    (good, poor, harsh). With one class for all that is bad, texts that are harsh but well formed
    would count as good ones on which a labeller errs.
    """
    v = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    harsh = v[:, LABELLERS.index("harsh")] == REJECT
    poor = (v == REJECT).sum(axis=1) > harsh
    of = np.full((3, len(v)), 0.05)
    of[np.where(harsh, 2, np.where(poor, 1, 0)), np.arange(len(v))] = 0.9
    rates = np.zeros((3, len(LABELLERS), 3))
    for _ in range(rounds):
        weight = counts * of
        for k in range(len(LABELLERS)):
            for x in range(3):
                rates[:, k, x] = weight[:, v[:, k] == x].sum(axis=1) + 0.5
        rates /= rates.sum(axis=2, keepdims=True)
        # known by design: chance alone gives so many harsh words to one good text in 10^ODD (one labeller alone can't tell)
        rates[0, LABELLERS.index("harsh"), REJECT] = min(rates[0, LABELLERS.index("harsh"), REJECT], 10**-ODD)
        share = (weight.sum(axis=1) + 1) / (weight.sum() + 3)
        logs = np.log(share)[:, None] + np.log(rates[:, np.arange(len(LABELLERS)), v]).sum(axis=2)
        new = np.exp(logs - logs.max(axis=0))
        new /= new.sum(axis=0)
        if np.abs(new - of).max(initial=0) < 1e-6:
            break
        of = new
    return 1 - of[0], rates


def fit_scorer(features: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]], rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression over word buckets (their shares of a text) and dense findings, by Adam."""
    index = np.concatenate([f[0] for f in features]).astype(np.int64)
    row = np.repeat(np.arange(len(features)), [len(f[0]) for f in features])
    value = np.concatenate([f[1] / max(f[1].sum(), 1) for f in features])
    dense, y = np.stack([f[2] for f in features]), np.array([f[3] for f in features])
    a, b = np.zeros(TABLE), np.zeros(dense.shape[1])
    m, v = np.zeros(TABLE + len(b)), np.zeros(TABLE + len(b))
    for t in range(1, rounds + 1):
        z = np.bincount(row, a[index] * value, len(y)) + dense @ b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        grad = np.concatenate([np.bincount(index, g[row] * value, TABLE) + 1e-5 * a, dense.T @ g + 1e-6 * b])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        a, b = a - step[:TABLE], b - step[TABLE:]
    return a, b


def dense_findings(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """What the scorer sees of the findings: one column for each labeller's vote to reject or keep, two scales, one."""
    return np.column_stack([v == REJECT, v == KEEP, np.minimum(x[:, 7], 5) / 5, np.log1p(x[:, 0]) / 10, np.ones(len(x))]).astype(np.float64)


def fit(documents: DataFrame, labels: DataFrame) -> Callable[[pa.RecordBatch], np.ndarray]:
    """Fits the model; returns what scores a batch (columns text and lang): each row's chance of being bad."""
    spark = prepare(documents.sparkSession)
    harsh, rates = mine_harsh_words(documents, labels)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    known = spark.sparkContext.broadcast((harsh, rates))  # at most HARSH hashes and a rate for each language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, x, _ in _looked(b, *known.value):
                p, n = np.unique(pattern(votes(x)), return_counts=True)
                yield pa.RecordBatch.from_pydict({"pattern": p.astype(np.int64), "n": n.astype(np.int64)})

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, bare, x, _ in _looked(b, *known.value):
                v = votes(x)
                bucket = (bare.hashes % U(TABLE)).astype(np.int32)
                rows = [np.unique(bucket[bare.first[k] : bare.first[k + 1]], return_counts=True) for k in range(len(x))]  # at most TABLE numbers for a text
                yield pa.RecordBatch.from_pydict({"pattern": pattern(v).astype(np.int64), "words": pa.array([r[0] for r in rows], pa.list_(pa.int32())), "times": pa.array([r[1] for r in rows], pa.list_(pa.int64())), "dense": pa.array(list(dense_findings(x, v)), pa.list_(pa.float64()))})

    tally = docs.mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # 3^7 rows at most
    patterns, counts = (np.array([r[c] for r in tally], np.int64) for c in ("pattern", "n"))
    bad, _ = estimate(patterns, counts.astype(np.float64)) if len(patterns) else (np.zeros(0), None)
    posterior = dict(zip(patterns.tolist(), bad.tolist(), strict=True))
    keyed = docs.filter("doc_id IS NOT NULL").withColumn("key", row_key("doc_id", "text", "lang"))
    ids = keyed.select("doc_id", "key").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "key").limit(SAMPLE)
    some = keyed.join(F.broadcast(ids), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).orderBy(F.xxhash64("doc_id"), "doc_id", "key")
    picked = some.select("text", "lang").mapInArrow(sample, "pattern long, words array<int>, times array<long>, dense array<double>").toArrow()
    lists = lambda c: [x.values.to_numpy(zero_copy_only=False) for x in picked.column(c)]
    rows = [(w, n, np.array(d), posterior[p]) for w, n, d, p in zip(lists("words"), lists("times"), picked.column("dense").to_pylist(), picked.column("pattern").to_pylist(), strict=True)]
    model = fit_scorer(rows) if rows else (np.zeros(TABLE), np.zeros(2 * len(LABELLERS) + 3))
    sent = spark.sparkContext.broadcast(model)  # TABLE weights

    def score(b: pa.RecordBatch) -> np.ndarray:
        words, dense = sent.value
        out = [np.zeros(0)]
        for _, bare, x, _ in _looked(b, *known.value):
            share = sums(words[(bare.hashes % U(TABLE)).astype(np.int64)], bare.first) / np.maximum(bare.counts(), 1)
            z = share + dense_findings(x, votes(x)) @ dense
            out.append(np.where(x[:, 0] < 1, 1.0, 1 / (1 + np.exp(-np.clip(z, -30, 30)))))
        return np.concatenate(out)

    return score


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score (the chance that the scorer gives a document of being bad), keep."""
    score = fit(documents, labels)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("keep", pa.bool_())])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = score(b)
            yield record_batch(schema, b.column("doc_id"), s, s < 0.5)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").mapInArrow(decide, "doc_id long, score double, keep boolean")


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents without the rejected ones."""
    score = fit(documents, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(score(b) < 0.5))

    return documents.mapInArrow(run, documents.schema)


def _looked(b: pa.RecordBatch, harsh: np.ndarray, rates: dict) -> Iterator[tuple]:
    lang = [x or "" for x in b.column("lang").to_pylist()]
    for i, j, buf, offsets in groups(b.column("text")):
        yield i, *findings(buf, offsets, lang[i:j], harsh, rates), j


def op9_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
