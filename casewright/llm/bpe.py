"""Byte-level BPE encoding and decoding by merge replay over a block's word table.

Texts are split by the tokenizer's pattern. The distinct words of a block of
texts form one flat token table (each byte a token, linked to its neighbours
inside its word). An inverted index from token pair to positions, kept by the
pair's merge rank, then replays every merge in rank order: all positions of a
rank are merged at once, and only the two pairs next to each are looked up
again. Documents are written from the finished words. Words are independent of
each other, so blocks give the same ids as one table of the whole corpus, and no
text is shuffled; a task holds one Arrow batch (bounded by bytes) and a table of
the words seen so far, which starts anew beyond ``WORDS_KEPT`` words.

The replay needs each merged token to rank after its parts' merges, i.e. every
token of the vocabulary must encode to itself; ``encode`` checks that once, and
a vocabulary where it fails is refused.

Edge cases: null and empty texts have no ids and decode to no bytes; null ids
decode to no bytes; an id outside the vocabulary raises. Repeated rows are
encoded alike. Extra columns pass through; a column that has the name of the
added one is replaced. Very long texts are encoded whole.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import kernels as K
from casewright.llm import registry
from casewright.llm.session import prepare, read

#: Distinct words that a task keeps between batches before its table starts anew.
WORDS_KEPT = 300_000
#: Texts turned into ids at a time, in characters.
SLICE_CHARS = 1 << 20
NONE = np.int32(-1)


class Vocabulary:
    """Token bytes by id, and the rank of every mergeable pair of ids."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.size = max(ranks.values()) + 1
        self.lengths = np.zeros(self.size, np.int64)
        tokens = [b""] * self.size
        for token, rank in ranks.items():
            tokens[rank], self.lengths[rank] = token, len(token)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:k]] << 32 | ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        table = np.array([*pairs, (np.iinfo(np.int64).max, NONE)], dtype=np.int64)  # the last is no pair
        table = table[np.argsort(table[:, 0])]
        self.pair_codes, self.pair_ranks = np.ascontiguousarray(table[:, 0]), table[:, 1].astype(np.int32)

    def check(self) -> None:
        """Every token must encode to itself; then no merge makes a pair of a lower rank."""
        present = np.flatnonzero(self.lengths)
        ids, _ = self.replay([self.bytes[self.starts[i]:self.starts[i + 1]].tobytes() for i in present])
        if not np.array_equal(ids, present):
            raise ValueError("a token of the vocabulary does not encode to itself")

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each token pair, -1 without one."""
        code = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
        return np.where((self.pair_codes[at] == code) & (right >= 0), self.pair_ranks[at], NONE)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in one array, end of each word's ids)."""
        ends = np.cumsum([len(w) for w in words])
        n = int(ends[-1]) if len(words) else 0
        token = np.append(self.byte_ids[np.frombuffer(b"".join(words), np.uint8)], NONE)
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[ends - 1], before[np.append(0, ends[:-1])] = n, n  # position n is no token
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def add(positions: np.ndarray) -> None:
            rank = self.pair_rank(token[positions], token[after[positions]])
            positions, rank = positions[rank >= 0], rank[rank >= 0]
            if len(rank) == 0:
                return
            order = np.argsort(rank, kind="stable")
            positions, rank = positions[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            bounds = [0, *cut.tolist(), len(rank)]
            for a, b, r in zip(bounds, bounds[1:], rank[bounds[:-1]].tolist()):
                if r not in index:
                    index[r] = []
                    heapq.heappush(queue, r)
                index[r].append(positions[a:b])

        if n:
            add(np.arange(n, dtype=np.int32))
        while queue:
            r = heapq.heappop(queue)
            found = index.pop(r)
            at = np.sort(np.concatenate(found)) if len(found) > 1 else found[0]
            right = after[at]
            live = self.pair_rank(token[at], token[right]) == r
            at, right = at[live], right[live]
            if len(at) == 0:
                continue
            # Of overlapping positions the leftmost goes first: every other one of a chain.
            if len(at) > 1:
                chained = np.append(False, right[:-1] == at[1:])
                if chained.any():
                    place = np.arange(len(at))
                    first = np.maximum.accumulate(np.where(chained, 0, place))
                    taken = (place - first) % 2 == 0
                    at, right = at[taken], right[taken]
            token[at], token[right] = r, NONE
            following = after[right]
            after[at] = following
            inner = following < n
            before[following[inner]] = at[inner]
            left = before[at]
            near = np.concatenate([at, left[left < n]])
            add(np.unique(near) if len(near) > 1 else near)
        alive = token[:n] >= 0
        return token[:n][alive], np.cumsum(alive)[ends - 1] if len(words) else np.zeros(0, np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a run of ids."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise ValueError("an id is outside the vocabulary")
        return self.bytes[spans(self.starts[ids], self.lengths[ids])].tobytes()


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every span, one span after another."""
    total = np.cumsum(lengths)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - lengths), lengths)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Read once in each Python worker."""
    return Vocabulary(path)


class Numbers(dict):
    """Numbers words in the order they are first seen; ``new`` lists those without ids yet."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.new.append(word.encode())
        return at


class WordTable:
    """Distinct words seen by a task with their finished ids."""

    def __init__(self, vocab: Vocabulary, pattern: str):
        self.vocab, self.find = vocab, regex.compile(pattern).findall
        self.clear()

    def clear(self) -> None:
        self.number = Numbers()
        self.ids, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str | None]) -> pa.Array:
        """Ids of each text."""
        if len(self.number) > WORDS_KEPT:
            self.clear()
        places: list[int] = []
        counts, number = [], self.number
        for text in texts:
            words = self.find(text) if text else ()
            counts.append(len(words))
            places.extend(map(number.__getitem__, words))
        if number.new:
            ids, ends = self.vocab.replay(number.new)
            number.new = []
            lengths = np.diff(ends, prepend=0)
            self.starts = np.concatenate([self.starts, ends - lengths + len(self.ids)])
            self.lengths, self.ids = np.concatenate([self.lengths, lengths]), np.concatenate([self.ids, ids])
        place = np.array(places, dtype=np.int64)
        lengths = self.lengths[place]
        totals = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum(counts))]
        return pa.ListArray.from_arrays(pa.array(totals, pa.int32()), pa.array(self.ids[spans(self.starts[place], lengths)], pa.int32()))


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text."""
    prepare(docs.sparkSession)
    _checked(path)

    @F.arrow_udf("array<int>")
    def ids(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = WordTable(vocabulary(path), pattern)  # goes with the task
        yield from K.freed(_encoded(column, table) for column in columns)

    return docs.withColumn(into, ids(F.col(text).cast("string")))


def _encoded(column: pa.Array, table: WordTable) -> pa.Array:
    """Ids of each text of a column, some texts at a time."""
    parts, some, chars = [], [], 0
    for value in column:
        value = value.as_py()
        some.append(value)
        chars += len(value or "")
        if chars >= SLICE_CHARS:
            parts.append(table.encode(some))
            some, chars = [], 0
    parts.append(table.encode(some))
    return pa.concat_arrays(parts)


def round_trip(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text") -> DataFrame:
    """``docs`` with ids and decoded: the ids of each whole text and the bytes that they decode to. Both come from one Python
    worker, so ids do not travel to a second one."""
    prepare(docs.sparkSession)
    _checked(path)

    @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
    def both(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(path)
        table = WordTable(vocab, pattern)

        def decoded(ids: pa.Array) -> pa.Array:
            flat, ends = ids.flatten().to_numpy(), ids.offsets.to_numpy() - ids.offsets[0].as_py()
            return pa.array([vocab.decode(flat[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())

        yield from K.freed(pa.StructArray.from_arrays([ids, decoded(ids)], names=["ids", "decoded"])
                           for ids in (_encoded(column, table) for column in columns))

    kept = [c for c in docs.columns if c not in ("ids", "decoded")]
    return docs.withColumn("_both", both(F.col(text).cast("string"))).select(*kept, "_both.ids", "_both.decoded")


@lru_cache(maxsize=2)
def _checked(path: str) -> None:
    vocabulary(path).check()


def decode(encoded: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids."""

    @F.arrow_udf("binary")
    def bytes_of(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(path)
        yield from K.freed(pa.array([vocab.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else b"" for x in column], pa.binary())
                           for column in columns)

    return encoded.withColumn(into, bytes_of(F.col(ids)))


def digests(encoded: DataFrame) -> list[Column]:
    """n_tokens, ids_sha256 and decoded_sha256 of rows that have ids and decoded."""
    return [F.size("ids").cast("long").alias("n_tokens"),
            F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
            F.sha2(F.col("decoded"), 256).alias("decoded_sha256")]


@registry.query("op10_byte_bpe")
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = round_trip(read(spark, sf_dir, "documents", "doc_id", "text"), path)
    return encoded.select("doc_id", *digests(encoded))
