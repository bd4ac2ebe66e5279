"""SentencePiece, the token store and chat formatting: exact round trips."""

import hashlib
import zlib
from itertools import accumulate

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cindertrace.llm import chat, pieces, token_store

public = pytest.importorskip("public_tokenizers")
TEXTS = [None, "", " ", "  ", "   ", " a", "a ", "a  ", "a  b", "\n", "a\n b", "\na", "a\n\nb", "a \n", "a\tb", "x" * 500 + " " + "y" * 300, "\0 a", "ﬁ ｆ é　z", "<s> </s> <|endoftext|>", "it's we'll", "a b", "▁▁a ▁", "\U0001f600 \U0010ffff", "12 345 ...!?", "word " * 3000, "a\r\nb\x85c\x0b\x1cd", "same", "same"]
ALPHABET = " \n\r\tab1.,'sé▁\x1c　"
TOKENS = [*ALPHABET, "<|endoftext|>", "<|endoftext", "sum", "\rsum", "  sum", "row \rsum"]


def test_pieces(spark):
    import sentencepiece

    path = pieces.public_model()
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, ids int")
    for r in pieces.encode(docs, path).collect():
        ids = m.encode(TEXTS[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids) and r["decoded"] == m.decode(ids)
    d = {r["doc_id"]: r for r in pieces.encode(docs, path, digests=True).collect()}
    assert d[1]["ids_sha256"] == hashlib.sha256(np.array([1, 2], "<u4").tobytes()).hexdigest() and len(d) == len(TEXTS)
    assert pieces.encode(docs.limit(0), path).count() == 0


def test_distinct_words_are_segmented_once(spark):
    """The table has each word that parts share, once for all if most of them do; other rows still get right ids."""
    path = pieces.public_model()
    rows = [(k, f"one two{k % 3} \n three{k} few{k // 90} {'x' * 300} ▁four") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(5, "doc_id")
    held = spark.read.parquet(pieces.chunk_table(docs, path))
    words = {w for _, t in rows for w in pieces.load(path).chunks(t) if 0 < len(w) <= pieces.LONGEST_KEPT}
    found = {r["word"] for r in held.collect()}
    assert found <= words and {"one", "two0", "few0", "few1"} <= found and not any(w.startswith("three") for w in found)
    assert held.filter("word = 'one'").count() == 1 and held.count() == held.select("part", "word").distinct().count()
    assert all(r["ids"] == pieces.load(path).segment([r["word"]])[0] for r in held.collect())
    m = pieces.load(path).model
    for r in pieces.encode(docs, path).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == m.encode(rows[r["doc_id"]][1], add_bos=True, add_eos=True)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(ALPHABET), max_size=40))
def test_chunks_equal_the_library(text):
    t = pieces.load(pieces.public_model())
    assert np.frombuffer(t.encode([text])[0], "<u4").tolist() == t.model.encode(text, add_bos=True, add_eos=True)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(TOKENS), max_size=30).map("".join), max_size=8))
def test_store_ids_equal_the_library(texts):
    """One coder through all examples, so what it has kept from earlier texts must not show."""
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    c = token_store.coder(path, 2)
    plain = _tokenizer(path, Tokenizer)
    got = [np.frombuffer(x, c.kind).tolist() for x in c.encode(texts)]
    assert got == [[*plain.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_store_ids_of_many_random_texts():
    from tokenizers import Tokenizer

    rng = np.random.default_rng(8)
    path = public.path("byte_bpe_50k.json")
    c, plain = token_store.ByteCoder(path, 2), _tokenizer(path, Tokenizer)
    for _ in range(40):
        batch = ["".join(rng.choice(TOKENS, rng.integers(0, 25))) for _ in range(500)]
        assert [np.frombuffer(x, c.kind).tolist() for x in c.encode(batch)] == [[*x.ids, 2] for x in plain.encode_batch(batch, add_special_tokens=False)]


def _tokenizer(path, kind, kept={}):  # noqa: B006
    if path not in kept:
        kept[path] = kind.from_file(path)
    return kept[path]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=1300), st.booleans())
def test_elias_fano(steps, small):
    v = np.sort(np.array([s % 50 if small else s for s in steps], np.int64))
    e, _ = token_store.EliasFano.read(memoryview(token_store.EliasFano.of(v).to_bytes()), 0)
    assert e.all().tolist() == v.tolist()
    assert [e.select(i) for i in range(0, len(v), 7)] == v[::7].tolist()
    assert e.many(np.arange(len(v))[::-3]).tolist() == v[::-3].tolist()
    with pytest.raises(IndexError):
        e.select(len(v))


def test_store(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = _tokenizer(public.path("byte_bpe_50k.json"), Tokenizer)
    order = [5 * k - 20 for k in range(len(TEXTS))]
    docs = spark.createDataFrame([*zip(order, TEXTS, strict=True), (None, "lost")], "doc_id long, text string").repartition(3)
    m = token_store.write(docs, str(tmp_path), public.path("byte_bpe_50k.json"), 2)
    ids = [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in TEXTS]
    want = [(d, s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i, s in zip(order, ids, accumulate([0, *map(len, ids[:-1])]), strict=True)]
    assert sorted(tuple(r) for r in token_store.read(m).collect()) == want
    own, bounds, flat = token_store.read_shard(open(m.orderBy("part", "seq").first()["path"].removeprefix("file:"), "rb").read())
    assert own[0] == -20 and bounds.select(0) == 0 and flat[: len(ids[0])].tolist() == ids[0]
    tied = docs.unionByName(docs.select("doc_id", F.lit("another text").alias("text"))).unionByName(docs)
    runs = [sorted(tuple(r) for r in token_store.read(token_store.write(tied.repartition(n), str(tmp_path / f"tied{n}"), public.path("byte_bpe_50k.json"), 2)).collect()) for n in (2, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == 3 * len(TEXTS)
    none = token_store.write(docs.limit(0), str(tmp_path / "none"), public.path("byte_bpe_50k.json"), 2)
    assert token_store.read(none).count() == 0


def test_chat_trees(spark):
    rows = [(1, 1, None, "user", "a\\n<|x|>\n", 0.0), (1, 2, 1, "assistant", "b\\", 5.0), (1, 3, 1, "assistant", "<|im_end|>\nc\\l", 1.0), (1, 4, 3, "user\nx", None, 9.0), (2, 1, None, None, "", None), (3, 1, 2, "user", "round", 0.0), (3, 2, 1, "user", "round", 0.0), (3, 5, 2, "user", "hangs", 0.0), (4, 7, 99, "user", "orphan", 0.0), (4, 7, 99, "user", "orphan", 0.0), (None, 1, None, "user", "x", 0.0)]
    m = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double")
    got = {(r["tree"], r["leaf"]): r for r in chat.turns_back(chat.conversations_of(m)).collect()}
    assert set(got) == {(1, 2), (1, 4), (2, 1), (4, 7)}
    assert [tuple(t) for t in got[1, 4]["turns"]] == [("user", "a\\n<|x|>\n"), ("assistant", "<|im_end|>\nc\\l"), ("user\nx", "")]
    assert got[1, 4]["loss_text"] == "<|im_end|>\nc\\l" and got[1, 4]["branch_rank"] == 1 and got[1, 2]["loss_text"] == "b\\"
    assert {(r["tree"], r["leaf"]) for r in chat.conversations_of(m, best=1).collect()} == {(1, 4), (2, 1), (4, 7)}
    assert chat.conversations_of(m.limit(0)).count() == 0


def test_long_thread(spark):
    m = spark.range(1, 301).selectExpr("1L AS tree", "id", "CASE WHEN id > 1 THEN id - 1 END AS parent", "CASE WHEN id % 2 = 0 THEN 'assistant' ELSE 'user' END AS role", "concat('t', id) AS text")
    r = chat.turns_back(chat.conversations_of(m)).first()
    assert [t["text"] for t in r["turns"]] == [f"t{k}" for k in range(1, 301)]
    assert r["loss_text"] == "".join(f"t{k}" for k in range(2, 301, 2))


def test_chat_query_matches_sql(spark, small, oracle):
    from tests.conftest import rows_of

    assert rows_of(r.asDict() for r in chat.op10_chat_formatting(spark, small).collect()) == oracle(chat.OP10_SQL)
