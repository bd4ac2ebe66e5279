"""Filter audit, ranked search and token counts against plain versions, the library, and the SQL."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cindertrace.llm import filter_audit, ranked_search, token_counts
from cindertrace.llm.words import groups
from tests.conftest import rows_of

public = pytest.importorskip("public_tokenizers")
RNG = random.Random(11)


def audit(docs, labels):
    """Rows of the audit by counting; docs are (doc_id, text, source)."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least, rows = {}, []
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    for d, t, s in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0d]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": d is not None and d > least[t],
        }
        rows.append((s or "", fails, d in good, d in toxic))
    out, credit = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                here = [r for r in left if r[1][f]]
                out[part, order, step] = [len(left) - len(here), len(here), sum(r[1][f] for r in gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in left + gone), sum(r[2] for r in here), sum(r[3] for r in here)]
                credit[part, f] += len(here)
                gone += here
                left = [r for r in left if not r[1][f]]
    return {k: (*v, credit[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(found):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in found.collect()}


def test_audit(spark, monkeypatch):
    words = [f"w{k}" for k in range(80)]
    texts = [None, "", " ", "A B C #", " ".join(words), " ".join(words[:60]).upper(), " ".join(words[:20] * 5), "x " * 70, " ".join(words) + " $", "É" * 30, " ".join(words[:49]), " ".join(words[:50]), " ".join(words), "a\x1cb " * 60]
    docs = [(RNG.randrange(60), RNG.choice(texts), RNG.choice([None, "", "s", "s", "r"])) for _ in range(150)]
    docs += [(100 + k, texts[4], "s") for k in range(120)] + [(None, texts[4], "s"), (None, "", None), (-5, texts[6], "r"), docs[0], docs[0]]
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 110, 2)] + [(3, 0, 0), (3, 1, 1), (None, 1, 1), (4, None, None)]
    d = spark.createDataFrame([(*r, "x", True) for r in docs], "doc_id long, text string, source string, flags string, good boolean")
    la = spark.createDataFrame([(a, b, None if c is None else int(c)) for a, b, c in labels], "doc_id long, quality int, toxic int")
    want = audit(docs, labels)
    for hot in (1000, 20):  # 20: the largest groups of copies are broadcast, the rest joined; 1000: all broadcast
        monkeypatch.setattr(filter_audit, "HOT", hot)
        found = filter_audit.replay(filter_audit.labelled(filter_audit.document_flags(d), la))
        assert audited(found) == want and found.count() == len(want)
    assert len(want) == 3 * 600
    assert filter_audit.replay(filter_audit.labelled(filter_audit.document_flags(d.limit(0)), la)).count() == 0
    assert audited(filter_audit.replay(filter_audit.labelled(filter_audit.document_flags(d), la.limit(0)))) == audit(docs, [])


def test_audit_of_a_very_long_text(spark):
    docs = [(1, "Word " * 400_000, "s"), (2, "Word " * 400_000, "s"), (3, "W" * 1_000_000, "s")]
    found = filter_audit.document_flags(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    assert {r["doc_id"]: r["flags"] for r in found.collect()} == {1: 2 + 4, 2: 2 + 4 + 16, 3: 1 + 4}


def search(docs, items, k=10):
    """Ranks by scoring every document."""
    def terms(text):
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        return Counter(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", low))

    own = [(d, t) for d, t in ((d, terms(t)) for d, t in docs if d is not None) if t]
    n_docs, total = len(own), sum(sum(t.values()) for _, t in own)
    df = Counter(w for _, t in own for w in t)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for i, q in asked.items():
        scored = []
        for d, t in own:
            m = 25 + 75 * sum(t.values()) * n_docs // total
            scored.append((-sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1000000000 * t[w] // (1000 * t[w] + 8 * m)) for w, n in q.items() if w in t), d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(x for x in scored if x[0] < 0)[:k], 1)]
    return sorted(out)


def ranks(found):
    return sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect())


def test_search(spark, monkeypatch):
    vocabulary = [f"t{k}" for k in range(60)] + ["é", "É", "日本", "a1", "straße"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    say = lambda n: " ".join(RNG.choices(vocabulary, weights, k=n))
    docs = [(3 * k - 50, say(RNG.randrange(1, 80)).replace(" ", RNG.choice([" ", "-", "\n"]))) for k in range(400)]
    docs += [(5000 + k, docs[7][1]) for k in range(300)] + [(None, docs[3][1]), (9001, None), (9002, ""), (9003, "!?"), (9004, say(30_000)), (docs[0][0], docs[0][1]), (docs[0][0], "t1 T2 t50")]
    items = [(k, say(RNG.randrange(1, 15)).upper()) for k in range(40)] + [(100, docs[7][1]), (101, None), (102, "nowhere"), (103, "?"), (None, "t1"), (0, "t3 t3 t3"), (104, " ".join(vocabulary * 3)), (105, "t59")]
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, rank int, term string").repartition(5)
    q = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    want = search(docs, items)
    assert ranks(ranked_search.ranked(d, q)) == want
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", 16)  # items in blocks, small blocks of documents
    monkeypatch.setattr(ranked_search, "BLOCK_DOCS", 32)
    assert ranks(ranked_search.ranked(d, q)) == want
    for a, b in ((d.limit(0), q), (d, q.limit(0)), (d.filter("doc_id = 9003"), q)):
        assert ranked_search.ranked(a, b).count() == 0


def test_bounds_hold():
    """Levels bound every impact from both sides, also of very long documents."""
    import numpy as np

    tf, norm = np.array([1, 1, 2, 50, 10**6, 1]), np.array([25, 10**9, 100, 100, 25, 3 * 10**12])
    exact = ranked_search.impacts(tf, norm)
    assert exact.tolist() == [10**9 * t // (1000 * t + 8 * m) for t, m in zip(tf.tolist(), norm.tolist(), strict=True)]
    level = -(-exact // ranked_search.STEP)
    assert (level <= 255).all() and (level * ranked_search.STEP >= exact).all() and ((level - 1) * ranked_search.STEP + 1 <= exact)[level > 0].all()
    assert ranked_search.norms(np.array([10**8]), 3 * 10**10, 10**13).tolist() == [25 + 75 * 10**8 * 3 * 10**10 // 10**13]


PARTS = [*" \n\t'sStTdmMrevl1a2é!?.İßΣςǅﬁ", "<|endoftext|>", "<|startoftext|>", "<|end", "'re", "'VE", "'ll", "n't", "é", "́", "가", "ᄀ", "ᅡ", "\U0001f600", "中", "漢字", " ", " ", "\x1c", "\x85", "٣", "½", "aa", "the", "ing", "ation", "͸", "", "\U000e0001", "ẞ", "K", "Å", "\0", "ha" * 9]


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    return [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def counted(texts):
    c = token_counts.counter(public.path("word_bpe_49k.json"))
    return [n for _, _, buf, offsets in groups(pa.array(texts, pa.string())) for n in c.counts(buf, offsets).tolist()]


@pytest.mark.parametrize(("size", "texts"), [(4, 20_000), (30, 6000), (400, 400)])
def test_counts_of_random_texts(size, texts):
    said = ["".join(RNG.choices(PARTS, k=RNG.randrange(size))) for _ in range(texts)]
    assert counted(said) == library(said)


@pytest.mark.parametrize("base", ["a", "ab", "the", "lol", "!", "'s", "0", "é", "\U0001f602", "á"])
def test_counts_of_long_words(base):
    """Chunks without an end, whose maps are composed from left to right."""
    said = [base * 30_000 + " x " + base * 7, base * 127 + "b", base * 128, base * 129]
    assert counted(said) == library(said)


def test_counts_in_small_parts(monkeypatch):
    """Tables that start anew within a word, scans of a few chunks, long texts in blocks."""
    for name, value in (("SLAB", 256), ("BLOCK", 500), ("TABLE_ENTRIES", 1 << 17), ("ROUNDS", 1), ("KNOWN_PAIRS", 100)):
        monkeypatch.setattr(token_counts, name, value)
    said = ["".join(RNG.choices(PARTS, k=RNG.randrange(3000))) for _ in range(40)] + ["".join(RNG.choices("aehlot", k=20_000)), "word\n" * 5000]
    assert counted(said) == library(said)


def test_counts(spark):
    texts = [None, "", "It's  the\ncat", "é<|endoftext|>x", "word " * 3000, "word " * 2048, "same", "same"]
    rows = [*enumerate(texts), (None, "null id")]
    d = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n_tokens int, n_bytes string")
    found = token_counts.token_counts(d, public.path("word_bpe_49k.json"))
    want = [(k, len((t or "").encode()), n, n > 2048) for (k, t), n in zip(rows, library([t or "" for _, t in rows]), strict=True)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(d.limit(0), public.path("word_bpe_49k.json")).count() == 0
    with pytest.raises(ValueError):
        token_counts.Counter(public.path("byte_bpe_50k.json"))


def test_query_of_counts(spark, small):
    said = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = token_counts.op13_token_counts(spark, small).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in found} == dict(zip(said, library(list(said.values())), strict=True)) and len(found) == len(said)


@pytest.mark.parametrize(("query", "sql"), [(filter_audit.op11_filter_audit, filter_audit.OP11_SQL), (ranked_search.op12_ranked_search, ranked_search.OP12_SQL)])
def test_queries_match_sql(spark, small, oracle, query, sql):
    assert rows_of(r.asDict() for r in query(spark, small).collect()) == oracle(sql)


def test_texts_are_told_by_their_digest(spark):
    """The digest in document_flags is the text's SHA-256."""
    d = spark.createDataFrame([("é\0",)], "text string").select(F.sha2("text", 256).alias("h")).first()["h"]
    assert d == hashlib.sha256("é\0".encode()).hexdigest()
