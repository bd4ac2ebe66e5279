"""The pipeline's rows against a plain version of its stages, over whole texts."""

import hashlib
import re

import numpy as np
import pytest

import corpus_pipeline
from cindertrace.llm import pieces, weak_labels

pytest.importorskip("public_tokenizers")
WORD, LETTERS = re.compile(rb"[^\x20\x09-\x0D]+"), re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), text)


def first_of_near_copies(docs):
    sets = {}
    for k, t in docs.items():
        w = WORD.findall(lower(t))
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in docs}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if docs[a] == docs[b] or both and both >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: docs[k] for k in ids if find(k) == k}


def without_later_passages(docs, n=50):
    split = {k: list(WORD.finditer(t)) for k, t in docs.items()}
    seen, out = set(), {}
    for k in sorted(docs):
        words = [m[0] for m in split[k]]
        gone = np.zeros(len(words) + 1, bool)
        for i in range(len(words) - n + 1):
            window = tuple(words[i : i + n])
            if window in seen:
                gone[i : i + n] = True
            seen.add(window)
        text, begin = b"", 0
        starts = [m.start() for m in split[k]] + [len(docs[k])]
        for i in range(len(words)):
            if gone[i] and not (i and gone[i - 1]):
                text += docs[k][begin : starts[i]]
            if gone[i] and not gone[i + 1]:
                begin = starts[i + 1]
        out[k] = text + (docs[k][begin:] if not len(words) or not gone[len(words) - 1] else b"")
    return out


def clean_of(docs, items, n=10):
    windows = set()
    for t in items:
        w = LETTERS.findall(lower(t))
        windows |= {tuple(w[i : i + min(n, len(w))]) for i in range(len(w) - min(n, len(w)) + 1 if w else 0)}
    sizes = {len(w) for w in windows}

    def hit(t):
        w = LETTERS.findall(lower(t))
        return any(tuple(w[i : i + s]) in windows for s in sizes for i in range(len(w) - s + 1))

    return {k: t for k, t in docs.items() if not hit(t)}


def test_run_equals_its_stages_read_out_plainly(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    good = {r["doc_id"] for r in weak_labels.classify(rows, labels).filter("keep").collect()}
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in rows.collect() if r["doc_id"] in good}
    near = first_of_near_copies(docs)
    bare = without_later_passages(near)
    items = [(r["text"] or "").encode() for r in spark.read.parquet(f"{small}/benchmark.parquet").filter("item_id IS NOT NULL").collect()]
    left = clean_of(bare, items)
    assert len(docs) > len(near) > len(left) and bare != near
    m = pieces.load(pieces.public_model()).model
    want = {}
    for k, t in left.items():
        ids = m.encode(t.decode(), add_bos=True, add_eos=True)
        want[k] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(m.decode(ids).encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, small).collect()} == want
