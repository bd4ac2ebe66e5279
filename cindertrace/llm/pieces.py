"""SentencePiece encoding and decoding through a distinct-chunk table.

Where no piece crosses from a letter to a following whitespace marker, the text falls into marked
words that are segmented independently. So

1. each task tells which distinct marked words its part of the corpus has;
2. those are dealt by word, so each distinct word of the corpus meets one task, which segments it once;
3. the ids go back to the parts that asked, and are saved by part in the shared folder. Words that most
   parts have are saved once for all (at most twice as many as one part has words); a word that one part
   alone has is segmented there;
4. the tasks read their texts again, with the ids of their own words at hand, and put the ids where the
   words stand.

A text is never shuffled; what is shuffled is a row for each distinct word of a part. Should a part hold
other rows when it is read again, words that it lacks are segmented on the spot, with the same ids.
Words of more than LONGEST_KEPT characters are segmented where they stand.

load() looks at the model's pieces and refuses the table where it would be wrong (then whole texts
are encoded). Defined results: a null text is an empty one; an empty text has only the begin and
end ids; repeated rows and further columns pass through. A null doc_id stays null.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import dataset, fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from cindertrace.llm.common import record_batch, sha256_hex, shared_folder, table, texts
from cindertrace.llm.token_store import at, qualified

#: Distinct words that a task keeps; beyond that it starts a new table, with the same results.
TABLE_WORDS = 1_200_000
#: Longer chunks are segmented each time, so that the table's memory has a bound.
LONGEST_KEPT = 200
MARK = "▁"
#: The part under which words are saved that most parts have.
FOR_ALL = -1
#: A run of markers and what follows it up to the next marker.
MARKED = re.compile(" [ ]*[^ ]*")
LINES = re.compile("(?=\n)")


class ChunkTable:
    """Segments texts with one model."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        plain = [p for i, p in enumerate(pieces) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        #: Chunks are independent if no piece has a marker after another character, and text is taken as it is.
        probe = "a  b\tﬁ é　x \n"
        self.by_chunk = not any(re.search(f"[^{MARK}]{MARK}", p) for p in plain) and self.model.decode(self.model.encode(probe)) == probe
        self.mark = np.array([self.model.piece_to_id(MARK)], "<u4").tobytes()
        self.ends = (np.array([self.model.bos_id()], "<u4").tobytes(), np.array([self.model.eos_id()], "<u4").tobytes())
        self.by_line = not any("\n" in p for p in plain)
        self.begin({})

    def begin(self, kept: dict[str, bytes]) -> None:
        """Starts a part of the corpus with the ids of its words."""
        self.kept: dict[str, bytes] = {"": self.mark} | kept

    def chunks(self, text: str) -> list[str]:
        """The text's marked words, each without its first marker, which the model puts back.

        Where no piece holds a line feed, words are cut before those too; what begins with a line
        feed has no marker.
        """
        if not text:
            return []
        text = text.replace(MARK, " ")
        if not self.by_line:
            return [c[1:] for c in MARKED.findall(" " + text)]
        if text[0] not in " \n" and "  " not in text and " \n" not in text:
            return text.replace("\n", " \n").split(" ")
        return [c for marked in MARKED.findall(" " + text) for c in LINES.split(marked[1:])]

    def segment(self, words: list[str]) -> list[bytes]:
        ids = self.model.encode(words, num_threads=1)
        return [np.array(i[self.by_line and w[0] == "\n" :], "<u4").tobytes() for w, i in zip(words, ids, strict=True)]

    def encode(self, batch: list[str]) -> list[bytes]:
        """The ids of each text, begin and end included, as little-endian unsigned 32-bit integers."""
        begin, end = self.ends
        if not self.by_chunk:
            return [begin + np.array(ids, "<u4").tobytes() + end for ids in self.model.encode(batch, num_threads=1)]
        if len(self.kept) > TABLE_WORDS:
            self.begin({})
        split = [self.chunks(t) for t in batch]
        new = list(set().union(*split).difference(self.kept))
        ids = self.segment(new)
        long = [c for c in new if len(c) > LONGEST_KEPT]
        self.kept.update(zip(new, ids, strict=True))
        out = [begin + b"".join(map(self.kept.__getitem__, cs)) + end for cs in split]
        for c in long:
            del self.kept[c]
        return out

    def decode(self, ids: bytes) -> str:
        return self.model.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(maxsize=2)
def load(model_path: str) -> ChunkTable:
    return ChunkTable(model_path)


def chunk_table(documents: DataFrame, model_path: str) -> str | None:
    """Where the ids of the distinct words of each part of documents lie; None if the model has no independent words."""
    if not load(model_path).by_chunk:
        return None

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, part = load(model_path).chunks, TaskContext.get().partitionId()  # which numbers the parts of the reading below alike
        seen: set[str] = set()
        for b in batches:
            own = set().union(*map(split, b.column("text").to_pylist())) - seen
            if len(seen) > TABLE_WORDS:
                seen = set()
            seen |= own
            new = [w for w in own if 0 < len(w) <= LONGEST_KEPT]
            yield record_batch(pa.schema([("part", pa.int32()), ("word", pa.string())]), [part] * len(new), new)

    asked = texts(documents).select("text")
    most = asked.rdd.getNumPartitions() / 2
    made = pa.schema([("part", pa.int32()), ("word", pa.string()), ("ids", pa.binary())])

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load(model_path)
        word, parts = None, []

        def out(done: list[tuple[str, list[int]]]) -> pa.RecordBatch | None:
            shared = [(w, [FOR_ALL] if len(p) > most else p) for w, p in done if len(p) > 1]
            if not shared:
                return None
            ids = table.segment([w for w, _ in shared])
            rows = [(part, w, i) for (w, own), i in zip(shared, ids, strict=True) for part in own]
            return record_batch(made, *zip(*rows, strict=True))

        for b in batches:
            done = []
            for w, part in zip(b.column("word").to_pylist(), b.column("part").to_pylist(), strict=True):
                if w != word:
                    done.append((word, parts))
                    word, parts = w, []
                if not parts or parts[-1] != part:
                    parts.append(part)
            found = out(done)
            if found:
                yield found
        found = out([(word, parts)])
        if found:
            yield found

    dealt = asked.mapInArrow(words, "part int, word string").repartition("word").sortWithinPartitions("word", "part")
    folder = qualified(documents.sparkSession, f"{shared_folder(documents.sparkSession).rstrip('/')}/words-{uuid.uuid4().hex}")
    dealt.mapInArrow(segment, "part int, word string, ids binary").repartition("part").write.partitionBy("part").parquet(folder)
    return folder


def words_of_part(folder: str) -> dict[str, bytes]:
    """The ids of the words that this task's part shares with others."""
    out: dict[str, bytes] = {}
    for part in (FOR_ALL, TaskContext.get().partitionId()):
        store, place = at(f"{folder}/part={part}")
        if store.get_file_info(place).type != fs.FileType.NotFound:
            held = dataset.dataset(place, filesystem=store, format="parquet").to_table(columns=["word", "ids"])
            out.update(zip(held.column("word").to_pylist(), held.column("ids").to_pylist(), strict=True))
    return out


def encode(documents: DataFrame, model_path: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, and ids (binary) and decoded text, or with digests their SHA-256."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())] + [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] * digests + [("ids", pa.binary()), ("decoded", pa.string())] * (not digests))
    folder = chunk_table(documents, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, begun = load(model_path), False
        for b in batches:
            if not begun and folder:
                table.begin(words_of_part(folder))
            begun = True
            ids = table.encode(b.column("text").to_pylist())
            decoded = [table.decode(i) for i in ids]
            last = ([sha256_hex(i) for i in ids], [sha256_hex(d.encode()) for d in decoded]) if digests else (ids, decoded)
            yield record_batch(schema, b.column("doc_id"), [len(i) // 4 for i in ids], *last)

    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string"
    return texts(documents).mapInArrow(run, f"doc_id long, n_tokens long, {kinds}")


def public_model(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), public_model(), digests=True)
