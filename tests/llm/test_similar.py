"""SimHash, near copies, nearest neighbours and decontamination against plain versions."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cindertrace.llm import decontamination, neighbours, simhash

RNG = np.random.default_rng(5)
VOCABULARY = [f"word{k}" for k in range(4000)]


def text(n):
    return " ".join(RNG.choice(VOCABULARY, n))


def edited(t, n):
    w = t.split()
    for k in RNG.choice(len(w), n, replace=False):
        w[k] = "changed" + str(RNG.integers(9999))
    return " ".join(w)


def roots(keys, linked):
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def plain_fingerprint(t, n=3):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split()
    shingles = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, tmp_path):
    base = [text(400), text(300)]
    docs = [None, "", " ", "A b", "a B", "a b c", "É é", *base, *(edited(base[0], k % 4) for k in range(60)), base[1].upper(), "long " * 40_000]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in simhash.op4_simhash(spark, str(tmp_path)).collect()}
    prints = [plain_fingerprint(t) for t in docs]
    want = roots(list(range(len(docs))), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert {k: (r["fingerprint"], r["component_id"]) for k, r in got.items()} == {k: (f"{prints[k]:016x}", want[k]) for k in want}


@pytest.mark.parametrize("crowd", [0, 3, 1000])
def test_links_with_and_without_crowds(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    centre = [int(x) for x in RNG.integers(0, 1 << 62, 4)]
    fps = sorted({c ^ sum(1 << int(b) for b in RNG.choice(64, k % 4)) for k in range(150) for c in centre})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    want = roots(signed, lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2)
    assert {k: found.get(k, k) for k in signed} == want


def test_candidates_are_planned_in_parts(spark):
    """One plan of all ways to a candidate had dozens of exchanges and was planned again after each of its stages."""
    one = spark.createDataFrame([(k, k * 7919, [k // 2, k // 3], 9) for k in range(40)], "doc_id long, fp long, bands array<long>, size long")
    pairs = simhash.candidates(one)
    assert pairs._jdf.queryExecution().executedPlan().toString().count("Exchange") < 15
    got = {(r["a"], r["b"]) for r in pairs.collect()}
    assert {(a, b) for a in range(40) for b in range(a + 1, 40) if a // 2 == b // 2 or a // 3 == b // 3} <= got


def test_thresholds():
    assert simhash.deal_thresholds([[0, 5, 9, 20], [0, 1, 2, 3]], 3) == [-1, 2]
    chosen = simhash.deal_thresholds([[0, 1, 50], [0, 1, 50], [0, 1, 50]], 3)
    assert chosen == [0, 0, 0]


def test_near_copies(spark):
    base = [text(200) for _ in range(6)]
    docs = [None, "", "  ", "one two", "one two", *base, *(edited(b, 2) for b in base for _ in range(8)), *(edited(base[0], 60) for _ in range(3))]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(docs)], "doc_id long, text string, fp string")
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    split = [(t or "").lower().split() for t in docs]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in split]

    def linked(a, b):
        return (docs[a] or "") == (docs[b] or "") or bool(sets[a] & sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])

    want = roots(list(range(len(docs))), linked)
    assert {r["doc_id"] for r in out.collect()} == {k for k, v in want.items() if k == v}
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_one_row_stays_where_doc_ids_are_null_or_repeat(spark):
    base, other = text(120), text(90)
    near = edited(base, 1)
    rows = [(None, base), (None, base), (7, near), (7, other), (7, other), (9, base), (None, other), (None, "alone"), (None, "alone"), (8, None), (8, None), (12, ""), (3, text(60))]
    df = spark.createDataFrame([(d, t, k, "x") for k, (d, t) in enumerate(rows)], "doc_id long, text string, copy int, root string").repartition(3)
    out = simhash.keep_one(df)
    assert out.columns == df.columns
    kept = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in out.collect())
    assert kept == sorted([(7, near), (7, other), (-1, "alone"), (8, ""), (3, rows[12][1])])
    found = {(r["doc_id"], r["component_id"]) for r in simhash.near_copies(df).collect()}
    assert found == {(None, 7), (7, 7), (9, 7), (None, None), (8, 8), (12, 8), (3, 3)}


@pytest.mark.parametrize("block", [256, 7])
def test_near_copies_in_crowds(spark, monkeypatch, block):
    """Families without their base text, most pairs below the limit and some above."""
    monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
    rng = np.random.default_rng(23)
    docs = []
    for _ in range(3):
        base = rng.choice(VOCABULARY, 200)
        for _ in range(60):
            w = base.copy()
            for k in rng.choice(200, 3, replace=False):
                w[k] = "changed" + str(rng.integers(99999))
            docs.append(" ".join(w))
    docs = [docs[k] for k in rng.permutation(len(docs))]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, docs)]
    want = roots(list(range(len(docs))), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_copies(df).collect()} == want


def test_nearest(spark):
    x = RNG.normal(size=(1500, 12))
    x[700:900] = x[700]
    rows = [(k, [float(f) for f in v]) for k, v in enumerate(x)] + [(2000, None), (2001, []), (2002, [0.0] * 12), (2003, [float("nan")] * 12), (2100, [1.0, None] * 6), (2200, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    assert set(got) == set(range(0, 1500, 100))
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        hit += len(set(best.tolist()) & {v for _, v, _ in found})
        assert sorted(k for k, _, _ in found) == list(range(1, 11))
        assert all(s == pytest.approx(d[v], abs=1e-12) for _, v, s in found)
        assert [v for _, v, _ in sorted(found)] == [v for _, v, _ in sorted(found, key=lambda f: (f[2], f[1]))]
    assert hit >= 0.97 * 10 * len(got)
    few = neighbours.search(df.filter("vec_id IN (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]
    assert neighbours.search(df.filter("vec_id > 1999 AND vec_id < 2004"), F.col("vec_id") == 2000).count() == 0


@pytest.mark.parametrize("kind", ["clusters", "cloud"])
def test_recall_at_forty_thousand(spark, monkeypatch, kind):
    """At most 0.5 % of the rows are reranked; every tenth vector is a copy of another."""
    rng = np.random.default_rng(31)
    n, d = 40_000, 64
    x = rng.normal(size=(n, d)).astype(np.float32)
    if kind == "clusters":
        x = rng.normal(size=(40, d))[rng.integers(0, 40, n)] * 4 + x * rng.uniform(0.2, 1.5, (n, 1))
    x = x.astype(np.float64)
    x[::10] = x[rng.integers(0, n, n // 10)]
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x), pa.list_(pa.float64()))}))
    assert neighbours.KEEP * 10 <= 0.005 * n
    asked = np.arange(0, n, 400)
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 400 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q in asked.tolist():
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        best = np.lexsort((np.arange(n), far))[:10]
        own = sorted(got[q])
        hit += len(set(best.tolist()) & {v for _, v, _ in own})
        assert [k for k, _, _ in own] == list(range(1, 11)) and all(s == pytest.approx(far[v], abs=1e-9) for _, v, s in own)
    assert hit / (10 * len(asked)) >= 0.93, hit / (10 * len(asked))


def shapes(kind, rng):
    """Vectors among which some lie far from all others, and which of them ask."""
    if kind == "far group":
        x = np.concatenate([rng.normal(size=(594, 16)), 50 + rng.normal(size=(6, 16))])
        return x, [*range(0, 594, 60), *range(594, 600)]
    if kind == "lone queries":
        x = np.concatenate([rng.normal(size=(5940, 16)) * 0.1, rng.normal(size=(60, 16)) * 30])
        return x, [*range(5940, 6000), *range(0, 5940, 500)]
    x = rng.normal(size=(12_000, 24)) * np.exp(rng.normal(size=(12_000, 1)) * 1.5)
    return x, list(range(0, 12_000, 100))


@pytest.mark.parametrize("kind", ["far group", "lone queries", "heavy tails"])
def test_queries_far_from_the_rest(spark, kind):
    """Each query has ten rows, and the recall holds for all and for the worst."""
    x, asked = shapes(kind, np.random.default_rng(3))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float64())), "rank": ["x"] * len(x), "query": [None] * len(x), "cell": [0] * len(x)}))
    got = {}
    for r in neighbours.search(df, F.col("vec_id").isin(asked)).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hit = []
    for q in asked:
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        assert len(got[q]) == 10
        hit.append(len(set(np.lexsort((np.arange(len(x)), far))[:10].tolist()) & set(got[q])) / 10)
    assert np.mean(hit) >= 0.95 and min(hit) >= 0.7, (np.mean(hit), min(hit), np.mean(np.array(hit) < 0.8))


def test_repeated_vector_ids(spark):
    """Each row of a repeated id is a candidate, the query's own id is none, and its least vector asks."""
    rows = [(0, [5.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 3.0]), (2, [9.0, 0.0]), (None, [1.0, 0.0]), (3, [0.0, 0.0])]
    found = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in found) == [(1, 1, 1.0), (2, 1, 3.0), (3, 2, 8.0)]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("bits", [23, 7])
def test_decontamination(spark, tmp_path, monkeypatch, bits):
    """With 7 bits the map lets most words through, and the join alone decides."""
    monkeypatch.setattr(decontamination, "MAP_BITS", bits)
    items = {1: text(25), 2: "short ITEM", 3: None, 4: "...", 10: text(10), 11: text(12).upper(), 12: "short item"}
    long = items[1].split()
    docs = [(1, None), (2, ""), (3, text(50)), (4, "so, short; item!"), (5, "x " + items[1] + " " + items[10].upper()), (6, " ".join(long[:9])), (7, items[1] * 3), (8, items[11].lower() + " " + text(20)), (9, "short short item short"), (10, "é " * 5000)]
    # nulls, ids that stand on several texts, and rows that stand twice
    docs += [(None, items[10]), (None, text(30)), (None, None), (5, "clean text of another row"), (3, items[1]), (4, "so, short; item!"), (11, " ".join(long[:12] * 400))]
    spark.createDataFrame([(k, t, k, "n") for k, t in docs], "doc_id long, text string, k long, hits string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*items.items(), (None, docs[2][1]), (1, items[1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want, clean = [], []
    for k, t in docs:
        w, hit, found = plain_words(t), set(), set()
        for i, x in items.items():
            own = plain_words(x)
            n = min(10, len(own))
            windows = {tuple(own[p : p + n]) for p in range(len(own) - n + 1 if n else 0)}
            for q in range(len(w) - n + 1 if n else 0):
                if tuple(w[q : q + n]) in windows:
                    hit |= set(range(q, q + n))
                    found.add(str(i))
        want.append((str(k), len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
        clean += [(str(k), str(t))] if not hit else []
    got = decontamination.op6_decontamination(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == sorted(want)
    tables = [spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("documents", "benchmark")]
    kept = decontamination.without_contaminated(*tables)
    assert kept.columns == tables[0].columns and sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == sorted(clean)
    assert decontamination.contaminated_words(tables[0].limit(0), tables[1]).count() == 0
    assert decontamination.without_contaminated(tables[0], tables[1].limit(0)).count() == len(docs)
