"""Suffix-array and recompression dedup against every window written down."""

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cindertrace.llm import recompression, suffix_dedup
from cindertrace.llm.common import texts
from cindertrace.llm.words import Words, groups

LONG = " ".join(f"w{i % 977}x{i * i % 89}" for i in range(3000))


def words(n, a=0):
    return " ".join(LONG.split()[a : a + n])


DOCS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, words(49)), (6, words(50)), (7, words(50)), (8, "head " + words(60, 300) + " tail"), (9, "other start " + words(60, 300)),
    (10, words(200, 500) + " " + words(80, 520)), (11, "a b " * 60), (12, "x " * 90), (13, words(40, 900)), (14, words(40, 900)), (15, words(34, 1000)), (16, words(34, 1000)), (17, LONG * 2), (18, "é ü " * 50), (19, "z " + "é ü " * 40),
    (20, words(30, 1500) + " " + words(30, 1600)), (21, words(30, 1500) + " gap " + words(30, 1600)), (22, words(70, 2000) + " mid " + words(70, 2200)), (23, words(70, 2200) + "\nmid\n" + words(70, 2000)),
]


def brute(docs, length):
    seen = defaultdict(list)
    split = {k: (t or "").encode().split() for k, t in docs}
    for k in sorted(split):
        for i in range(len(split[k]) - length + 1):
            seen[tuple(split[k][i : i + length])].append((k, i))
    both, later = ({k: np.zeros(len(w), bool) for k, w in split.items()} for _ in range(2))
    for v in seen.values():
        if len(v) > 1:
            for k, i in v:
                both[k][i : i + length] = True
                if (k, i) != min(v):
                    later[k][i : i + length] = True
    return split, both, later


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("docs")
    spark.createDataFrame([(k, t, "en", "fr", True) for k, t in DOCS], "doc_id long, text string, lang string, ranges string, later boolean").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{folder}/empty/documents.parquet")
    return str(folder)


def test_recompression(spark, tables):
    split, both, _ = brute(DOCS, 35)
    got = {r["doc_id"]: r for r in recompression.op2_substring_dedup(spark, tables).collect()}
    assert set(got) == set(split)
    for k, w in split.items():
        kept = b" ".join(x for x, gone in zip(w, both[k], strict=True) if not gone)
        assert (got[k]["n_words"], got[k]["n_removed"], got[k]["kept_sha256"]) == (len(w), both[k].sum(), hashlib.sha256(kept).hexdigest()), k
    assert recompression.op2_substring_dedup(spark, tables + "/empty").count() == 0


def test_suffix_dedup(spark, tables):
    split, both, later = brute(DOCS, 50)
    got = {r["doc_id"]: r for r in suffix_dedup.op1_suffix_dedup(spark, tables).collect()}
    assert set(got) == {k for k in split if both[k].any()}
    for k, r in got.items():
        kept = b" ".join(x for x, gone in zip(split[k], later[k], strict=True) if not gone)
        assert (r["n_words"], r["n_repeated"], r["n_removed"], r["kept_sha256"]) == (len(split[k]), both[k].sum(), later[k].sum(), hashlib.sha256(kept).hexdigest()), k
    assert suffix_dedup.op1_suffix_dedup(spark, tables + "/empty").count() == 0


def test_without_repeats_keeps_rows_and_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    split, _, later = brute(DOCS, 50)
    out = suffix_dedup.without_repeats(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got[1] is None and got[3] == " \n\t " and got[6] == words(50)
    for k, w in split.items():
        assert (got[k] or "").encode().split() == [x for x, gone in zip(w, later[k], strict=True) if not gone]


REPEATED = [(None, words(60, 300)), (None, "a " + words(60, 300)), (None, None), (5, words(70, 100)), (5, "b " + words(70, 110)), (5, "b " + words(70, 110)), (3, words(80, 600)), (3, words(80, 600)), (1, words(20, 600) + " z"), (9, "fresh " + words(30, 2900))]


def brute_rows(rows, length):
    """As brute(), for rows that share doc_ids: rows equal in both columns are no later than each other."""
    order = sorted({(d is not None, d or 0, t or "") for d, t in rows})
    split = [(t or "").encode().split() for _, t in rows]
    seen = defaultdict(list)
    for k, (w, (d, t)) in enumerate(zip(split, rows, strict=True)):
        for i in range(len(w) - length + 1):
            seen[tuple(w[i : i + length])].append((order.index((d is not None, d or 0, t or "")), i, k))
    both = [np.zeros(len(w), bool) for w in split]
    for v in seen.values():
        for _, i, k in v if len(v) > 1 else ():
            both[k][i : i + length] = True
    return split, both


def test_rows_that_share_doc_ids(spark, tmp_path):
    spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(REPEATED)], "doc_id long, text string, key long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    split, both = brute_rows(REPEATED, 35)
    kept = [hashlib.sha256(b" ".join(x for x, gone in zip(w, b, strict=True) if not gone)).hexdigest() for w, b in zip(split, both, strict=True)]
    want = sorted((str(d), len(w), int(b.sum()), k) for (d, _), w, b, k in zip(REPEATED, split, both, kept, strict=True))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in recompression.op2_substring_dedup(spark, str(tmp_path)).collect()) == want
    split, both = brute_rows(REPEATED, 50)
    want = sorted((str(d), len(w), int(b.sum())) for (d, _), w, b in zip(REPEATED, split, both, strict=True) if b.any())
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_repeated"]) for r in suffix_dedup.op1_suffix_dedup(spark, str(tmp_path)).collect()) == want
    out = suffix_dedup.without_repeats(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    got = {r["key"]: r["text"] for r in out.collect()}
    assert out.columns == ["doc_id", "text", "key"] and len(got) == len(REPEATED)
    assert got[6] == got[7] == REPEATED[6][1] and got[4] == got[5] and got[2] is None and got[9] == REPEATED[9][1]
    # every repeated window is left somewhere
    left = [" ".join((got[k] or "").split()) for k in got]
    for k, (w, b) in enumerate(zip(split, both, strict=True)):
        for i in range(len(w) - 49):
            if b[i : i + 50].all():
                assert any(b" ".join(w[i : i + 50]).decode() in t for t in left), (k, i)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a b c dd e".split()), max_size=60), min_size=1, max_size=4), st.integers(4, 12))
def test_equal_windows_have_equal_anchors(docs, length):
    for rule in (recompression.shown_symbols, lambda w, n: suffix_dedup.minimisers(w, max(n, suffix_dedup.HEAD + 1))):
        n = length if rule is recompression.shown_symbols else max(length, suffix_dedup.HEAD + 1)
        seen = {}
        for _, _, buf, offsets in groups(pa.array([" ".join(d) for d in docs])):
            w = Words(buf, offsets)
            starts, _, head, place = rule(w, length)
            every = [x for d in docs for x in d]
            assert len(starts) == sum(max(0, len(d) - n + 1) for d in docs)
            for s, h, p in zip(starts.tolist(), head.tolist(), place.tolist(), strict=True):
                assert s <= p < s + n
                assert seen.setdefault(tuple(every[s : s + n]), (h, p - s)) == (h, p - s)


def test_texts_fills_nulls(spark):
    df = spark.createDataFrame([(1, None)], "doc_id int, text string")
    assert texts(df).collect() == [(1, "")]
