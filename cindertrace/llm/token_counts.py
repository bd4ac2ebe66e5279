"""Token counts by a compiled transducer, without making the tokens.

A byte-pair tokenizer whose merges are ordered by rank is a finite-state machine. Let last(i) be the
last token of what the tokenizer makes of the first i symbols of a word. Tokens t1..tn are what it
makes of a word if and only if it keeps each neighbouring pair apart, so last(i) is the one token that
ends at i and stands apart from last(i - its length). What later symbols can still change is bounded
by the longest token. A state is therefore the longest suffix that begins some token, with last() and
the number of tokens at each place of it where a token may yet begin; a transition on a symbol carries
the change of the number of tokens, which may be negative. The last symbol of a word is a symbol of
its own and leads back to the first state.

Counting a group of texts:

1. texts are normalised and cut into words by tables over code points, which are read off the library
   itself; texts with characters that these do not cover (combining marks, unassigned code points, the
   tokenizer's special strings) are normalised and cut by the library;
2. the words' bytes, end to end, fall into chunks of CHUNK symbols. All chunks step through the
   transducer together, each from the first state;
3. a chunk's state map sends the state at its entry to the state at its end and a count. A scan over
   the chunks composes the maps: each chunk whose true entry (the end of the one before it) differs
   steps on from that entry until it meets a state that it had at the same place, from where on the map
   is constant. Chunks are scanned in parallel until no entry changes; what a few rounds leave (long
   words without an end) goes from left to right, so the work stays linear;
4. a text's tokens are the sum of its transitions.

States are made when they are first met, and the table starts anew beyond TABLE_ENTRIES, with the same
results. Nothing is shuffled, and nothing is kept of a text but its count.

Defined results: a null text is an empty one, with no bytes and no tokens; repeated rows and null
doc_ids are kept; an empty table gives no row; further columns are ignored. A special string inside a
text is one token, as the library does by default.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindertrace.llm.common import record_batch, table, texts
from cindertrace.llm.words import groups

#: More tokens than this are over the limit.
LIMIT = 2048
#: Symbols of a chunk.
CHUNK = 128
#: Symbols that are scanned at once, and bytes of a long text that are worked on at once.
SLAB, BLOCK = 1 << 20, 1 << 20
#: Rounds of the scan before what is left goes from left to right.
ROUNDS = 6
#: Places of the transition table (states x symbols in use, 4 bytes each).
TABLE_ENTRIES = 1 << 25
#: Known pairs of tokens that a worker keeps.
KNOWN_PAIRS = 1 << 20
NEVER = 1 << 40
#: A symbol is a byte, or a byte + LAST at the end of a word.
LAST = 256
SPACE, LETTER, DIGIT, SIGN = range(4)
#: Fixed value: how the tokenizer cuts words; the code-point tables say the same.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SHORT, LONG = "stmd", ("re", "ve", "ll")


def byte_letters() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if it prints, the rest from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class Merges:
    """The tokens of a byte-pair model as sequences of symbols, and which pairs of them stay apart."""

    def __init__(self, model: dict):
        end, ids = model["end_of_word_suffix"], model["vocab"]
        letters = byte_letters()
        spelled = {ids[c + mark]: chr(b + add) for b, c in enumerate(letters) for mark, add in (("", 0), (end, LAST))}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = (ids[p] for p in (pair if isinstance(pair, list) else pair.split(" ")))
            t = ids["".join(pair) if isinstance(pair, list) else pair.replace(" ", "", 1)]
            if t in spelled or any(x in self.made and self.made[x][2] > r for x in (a, b)):
                raise ValueError("merges that make one token twice, or use a token before it is made")
            self.rank[a, b] = r
            self.made[t] = (a, b, r)
            spelled[t] = spelled[a] + spelled[b]
        self.edges = [{}, {}]
        whole = set(spelled) - set(self.made)
        for t, (a, b, r) in self.made.items():  # a token that its own symbols do not give never occurs
            if a in whole and b in whole and not self.meet(a, b, r):
                whole.add(t)
        self.tokens = {spelled[t]: t for t in whole}
        self.begins = {s[:k] for s in self.tokens for k in range(1, len(s))}
        self.apart: dict[int, bool] = {}

    def edge(self, t: int, side: int) -> list[tuple[int, int]]:
        """The parts of t that lie at one edge of it (0: left, 1: right), each with the rank at which it goes into the next."""
        out = self.edges[side].get(t)
        if out is None:
            out, part = [(t, NEVER)], t
            while part in self.made:
                made = self.made[part]
                part = made[side]
                out.append((part, made[2]))
            self.edges[side][t] = out
        return out

    def meet(self, a: int, b: int, before: int = NEVER) -> bool:
        """Is something merged across the border of a and b, at a rank below `before`?

        Merges go by rank, equal ones from the left. So parts at the border merge if both are still
        there at their rank; if the left one's own merge is the same, that comes first.
        """
        for x, until_x in self.edge(a, 1):
            for y, until_y in self.edge(b, 0):
                r = self.rank.get((x, y))
                if r is not None and r < until_x and r <= until_y and r < before:
                    return True
        return False

    def stay_apart(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) >= KNOWN_PAIRS:
                self.apart = {}
            found = self.apart[key] = not self.meet(a, b)
        return found


class Transducer:
    """Deterministic over symbols; its states and transitions are compiled when they are first met."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.begin()

    def begin(self) -> None:
        #: Of each state: the suffix that may begin a token, and (how far back, last token there, tokens there less tokens now).
        first = ("", ((0, None, 0),))
        self.states, self.number = [], {}
        self.column = np.full(2 * LAST, -1, np.int64)
        self.used = 1  # column 0 stands for no symbol: the state stays
        self.next = np.full((1 << 10, 64), -1, np.int32)
        self.place(first)

    def columns(self, symbols: np.ndarray) -> np.ndarray:
        """The table's columns for these symbols."""
        new = np.flatnonzero(np.bincount(symbols, minlength=2 * LAST).astype(bool) & (self.column < 0))
        self.column[new] = np.arange(self.used, self.used + len(new))
        self.used += len(new)
        while self.used > self.next.shape[1]:
            self.next = np.concatenate([self.next, np.full_like(self.next, -1)], axis=1)
        self.symbol_of = np.zeros(self.next.shape[1], np.int64)
        known = np.flatnonzero(self.column >= 0)
        self.symbol_of[self.column[known]] = known
        return self.column[symbols]

    def full(self) -> bool:
        return self.next.size > TABLE_ENTRIES

    def compile(self, state: int, column: int) -> int:
        """Fills in one transition: 64 * next state + 32 + change of the count."""
        suffix, marks = self.states[state]
        symbol = int(self.symbol_of[column])
        said = suffix + chr(symbol)
        tokens, begins, n = self.merges.tokens, self.merges.begins, len(said)
        for back, last, less in marks:
            t = tokens.get(said[n - back - 1 :])
            if t is not None and (last is None or self.merges.stay_apart(last, t)):
                break
        else:
            raise AssertionError("no token ends here")
        change, to = less + 1, 0
        if symbol < LAST:
            kept = tuple((b + 1, t_, less_ - change) for b, t_, less_ in marks if said[n - b - 1 :] in begins) + ((0, t, 0),)
            key = (said[n - kept[0][0] :] if kept[0][0] else "", kept)
            to = self.place(key)
        self.next[state, column] = to << 6 | change + 32
        return int(self.next[state, column])

    def step(self, states: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states that follow, and the changes of the count."""
        found = self.next[states, columns]
        if len(found) and found.min() < 0:
            width = self.next.shape[1]
            for key in np.unique((states.astype(np.int64) * width + columns)[found < 0]).tolist():
                self.compile(key // width, key % width)
            found = self.next[states, columns]
        return found >> 6, (found & 63) - 32

    def changes(self, symbols: np.ndarray) -> np.ndarray:
        """The change of the count at each of some whole words' symbols, SLAB of them at a time."""
        out, entry = [np.zeros(0, np.int8)], self.states[0]
        for i in range(0, len(symbols), SLAB):
            if self.full():
                self.begin()
            own, entry = self.scan(symbols[i : i + SLAB], entry)
            out.append(own)
        return np.concatenate(out)

    def place(self, key: tuple) -> int:
        """The number of a state."""
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            if to == len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
            self.next[to, 0] = to << 6 | 32
        return to

    def scan(self, symbols: np.ndarray, entry: tuple) -> tuple[np.ndarray, tuple]:
        """The changes of the count from a state on, and the state at the end."""
        n = len(symbols)
        lanes = -(-n // CHUNK)
        padded = np.zeros(lanes * CHUNK, np.int64)
        padded[:n] = self.columns(symbols)
        cols = np.ascontiguousarray(padded.reshape(lanes, CHUNK).T)
        at = np.zeros((CHUNK + 1, lanes), np.int32)
        at[0, 0] = self.place(entry)
        change = np.zeros((CHUNK, lanes), np.int8)
        for j in range(CHUNK):
            at[j + 1], change[j] = self.step(at[j], cols[j])
        late = np.flatnonzero(at[CHUNK, :-1] != at[0, 1:]) + 1
        for _ in range(ROUNDS):
            if not len(late):
                break
            state, lane, moved = at[CHUNK, late - 1], late, []
            for j in range(CHUNK):
                at[j, lane] = state
                state, change[j, lane] = self.step(state, cols[j, lane])
                apart = state != at[j + 1, lane]
                state, lane = state[apart], lane[apart]
                if not len(lane):
                    break
            else:
                at[CHUNK, lane] = state
                moved = lane[lane + 1 < lanes] + 1
            late = np.array(moved, np.int64)
        k = 0
        while k < len(late):  # from left to right; a chunk whose end changes makes the next one late
            lane = int(late[k])
            while lane < lanes and at[CHUNK, lane - 1] != at[0, lane]:
                state = int(at[CHUNK, lane - 1])
                for j in range(CHUNK):
                    at[j, lane] = state
                    c = int(cols[j, lane])
                    found = int(self.next[state, c])
                    if found < 0:
                        found = self.compile(state, c)
                    state, change[j, lane] = found >> 6, (found & 63) - 32
                    if state == at[j + 1, lane]:
                        break
                else:
                    at[CHUNK, lane] = state
                lane += 1
            k = int(np.searchsorted(late, lane)) if lane > late[k] else k + 1
        return change.T.reshape(-1)[:n], self.states[at[CHUNK, -1]]


class CodePoints:
    """For each code point: what it is normalised to, and whether it is space, letter, digit or sign, as the library has it."""

    def __init__(self, library):
        self.library = library
        seconds = {d[1] for c in range(0x110000) if (d := unicodedata.decomposition(chr(c)).split(" ")) and len(d) == 2 and d[0][0] != "<"}
        maybe = {int(s, 16) for s in seconds} | {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
        kinds = [unicodedata.category(chr(c)) for c in range(0x110000)]
        own = [c for c, k in enumerate(kinds) if k not in ("Cn", "Cs", "Co") and c not in maybe and not unicodedata.combining(chr(c)) and unicodedata.is_normalized("NFC", chr(c))]
        #: True: the library has to look at the text.
        self.hard = np.ones(0x110000, bool)
        self.kind = np.zeros(0x110000, np.uint8)
        self.to = np.arange(0x110000, dtype=np.uint32)
        for i in range(0, len(own), 4096):
            some = own[i : i + 4096]
            pieces, first = [0] * len(some), [0] * len(some)
            for _, (a, z) in library.pre_tokenizer.pre_tokenize_str(" ".join([f"a{chr(c)}{chr(c)}" for c in some])):
                pieces[a // 4] += 1
                first[a // 4] = first[a // 4] or z - a
            self.kind[some] = [SPACE if n == 1 and z == 1 else {1: LETTER, 2: SIGN, 3: DIGIT}[n] for n, z in zip(pieces, first, strict=True)]
            plain = [c for c in some if self.kind[c] != SPACE]
            for c, t in zip(plain, library.normalizer.normalize_str("\n".join(map(chr, plain))).split(" "), strict=True):
                if len(t) == 1:
                    self.to[c] = ord(t)
                    self.hard[c] = False
        space = [c for c in own if self.kind[c] == SPACE]
        self.hard[space], self.to[space] = False, 0x20
        self.hard |= self.hard[self.to]
        self.kind = self.kind[self.to]


class Counter:
    """Counts the tokens of texts as one tokenizer of the tokenizers library makes them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut, norm = spec["model"], spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
        plain = model["type"] == "BPE" and model["end_of_word_suffix"] and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        kinds = [p["type"] for p in cut.get("pretokenizers", [])] + [n["type"] for n in norm.get("normalizers", [])]
        if not plain or kinds != ["Split", "ByteLevel", "NFC", "Replace", "Lowercase"] or cut["pretokenizers"][0]["pattern"].get("Regex") != WORDS:
            raise ValueError("not a byte-pair tokenizer of the kind that is compiled here")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in what is around them")
        self.library = Tokenizer.from_file(path)
        self.points = CodePoints(self.library)
        self.transducer = Transducer(Merges(model))
        self.byte_of = {ord(c): b for b, c in enumerate(byte_letters())}
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def by_library(self, text: str) -> tuple[np.ndarray, int]:
        """The symbols of a text, and how many special strings it has."""
        parts = self.special.split(text) if self.special else [text]
        out = []
        for p in parts:
            for word, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(p)):
                own = [self.byte_of[ord(c)] for c in word]
                own[-1] += LAST
                out += own
        return np.array(out, np.int64), len(parts) - 1

    def symbols(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of texts that the tables cover, and where each text's begin."""
        kind, to, n = self.points.kind[points], self.points.to[points], len(points)
        fresh = np.zeros(n + 4, bool)  # a text begins here
        fresh[offsets] = True
        fresh[n:] = True
        begins = fresh[: n + 4].copy()
        begins[1:n] |= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        quote = np.flatnonzero((to == ord("'")) & begins[:n])
        padded = np.concatenate([to, np.zeros(4, to.dtype)])
        one, two = padded[quote + 1], padded[quote + 2]
        inside = ~fresh[quote + 1]
        short = inside & np.isin(one, [ord(c) for c in SHORT])
        long = inside & ~fresh[quote + 2] & np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in LONG])
        for hit, size in ((quote[short], 2), (quote[long], 3)):
            begins[hit + 1] = False
            begins[hit + size] = True
        kept = np.flatnonzero(kind != SPACE)
        ends = begins[kept + 1] | (np.concatenate([kind, [SPACE]])[kept + 1] == SPACE)
        own = to[kept]
        size = 1 + (own >= 0x80).astype(np.int64) + (own >= 0x800) + (own >= 0x10000)
        stop = np.cumsum(size)
        out = np.frombuffer(own.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8).astype(np.int64)
        out[stop[ends] - 1] += LAST
        bounds = np.concatenate([[0], stop])[np.searchsorted(kept, offsets)]
        return out, bounds

    def counts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The number of tokens of each text, given the texts' bytes end to end and where they begin."""
        if len(offsets) == 2 and len(buf) > 2 * BLOCK:
            return sum(self.counts(part, np.array([0, len(part)])) for part in blocks(buf))
        data = buf.tobytes()
        points = np.frombuffer(data.decode().encode("utf-32-le"), "<u4")
        at = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offsets]
        hard = np.unique(np.searchsorted(at, np.flatnonzero(self.points.hard[points]), "right") - 1).tolist()
        if self.special:
            found = [m.start() for m in re.finditer(self.special.pattern.encode(), data)]
            hard = sorted({*hard, *(np.searchsorted(offsets, found, "right") - 1).tolist()})
        if hard:
            points = points.copy()
        streams, extra = [], np.zeros(len(offsets) - 1, np.int64)
        for k in hard:
            own, extra[k] = self.by_library(data[offsets[k] : offsets[k + 1]].decode())
            streams.append(own)
            points[at[k] : at[k + 1]] = 0x20
        stream, bounds = self.symbols(points, at)
        change = self.transducer.changes(np.concatenate([stream, *streams]))
        total = np.concatenate([[0], np.cumsum(change, dtype=np.int64)])
        out = np.diff(total[bounds]) + extra
        place = len(stream)
        for k, own in zip(hard, streams, strict=True):
            out[k] += total[place + len(own)] - total[place]
            place += len(own)
        return out


def blocks(buf: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts that begin with a blank or a line feed, which nothing reaches across."""
    i, n = 0, len(buf)
    while i < n:
        j = min(i + BLOCK, n)
        while j < n:
            found = np.flatnonzero((buf[j : j + BLOCK] == 0x20) | (buf[j : j + BLOCK] == 0x0A))
            if len(found):
                j += int(found[0])
                break
            j = min(j + BLOCK, n)
        yield buf[i:j]
        i = j


@lru_cache(maxsize=1)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(documents: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(tokenizer)
        for b in batches:
            for i, j, buf, offsets in groups(b.column("text")):
                yield record_batch(schema, b.column("doc_id").slice(i, j - i), np.diff(offsets), c.counts(buf, offsets))

    return texts(documents).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
