"""Byte-level BPE by Aho-Corasick search and backtracking, and its decoding.

Bytes are mapped to Latin-1 characters, so that one automaton over all tokens finds every
token at every place of a pre-token in one scan.  Encoding takes the longest token that
starts at a place.  Two neighbours are compatible if merging their joint bytes by rank
gives the two again; that is decided from the merge each token ends with and memoised.
Where a token isn't compatible with its left neighbour, the next shorter prefix is tried,
and where none is left the neighbour itself is shortened; places without a continuation
are marked, so that none is tried twice.  The result is that of merging by rank, in time
linear in the length.
"""

from __future__ import annotations

import array
import base64
import functools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from chainloom.llm.token_counts import LETTERS_FIRST, Memo, begins_word, slices

# Parts and pre-tokens of a generation of the memos, and pairs known, that a worker keeps.
MEMO = 300_000
WORDS = 50_000
PAIRS = 300_000


class Ranks:
    """A file of base64 tokens and ranks."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            parts = [line.split() for line in file if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in parts}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.words = regex.compile(pattern)
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError(f"{path} does not hold every byte")
        # The longest shorter token that a token begins with.
        self.prefix: dict[int, tuple[int, int] | None] = {}
        for token, rank in self.rank.items():
            cut = next((k for k in range(len(token) - 1, 0, -1) if token[:k] in self.rank), 0)
            self.prefix[rank] = (cut, self.rank[token[:cut]]) if cut else None
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.joined: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for token, rank in sorted(self.rank.items(), key=lambda item: item[1]):
            self.halves[rank] = self.last_merge(token, rank)
            if self.halves[rank][0] != rank:
                self.joined[self.halves[rank]] = rank
        self.fits: dict[tuple[int, int], bool] = {}
        self.letters = pattern.startswith(LETTERS_FIRST)
        self.memo: dict[str, list[int]] = {}
        self.spaced = Memo(MEMO)
        self.size_of = {rank: len(token) for rank, token in self.token.items()}.__getitem__
        size = max(self.token) + 1
        lengths = np.zeros(size, np.int64)
        for rank, token in self.token.items():
            lengths[rank] = len(token)
        self.lengths = lengths
        self.starts = np.cumsum(lengths) - lengths
        self.pool = np.frombuffer(b"".join(self.token.get(rank, b"") for rank in range(size)), np.uint8)

    def last_merge(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens that a token is merged from last; a byte stands for itself."""
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:
            ranks = [self.rank.get(a + b, rank) for a, b in zip(parts, parts[1:])]
            low = min(ranks)
            if low >= rank:
                return rank, rank  # no merge leads to it; only a whole pre-token gives it
            at = ranks.index(low)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) < 2:
            return rank, rank
        return self.rank[parts[0]], self.rank[parts[1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both by rank leaves exactly these two tokens: no
        merge across their border comes before a merge that built one of the sides."""
        known = self.fits.get((left, right))
        if known is not None:
            return known
        a, b, limit = left, right, 2**31
        while True:
            across = self.joined.get((a, b))
            if across is not None and across < limit:
                answer = False
                break
            # Undo the later of the two merges beside the border.
            if a > b:
                inner = self.halves[a][1]
                if inner != a:
                    limit, a = a, inner
                    continue
                limit, inner = b + 1, self.halves[b][0]
                if inner == b:
                    answer = True
                    break
                b = inner
            else:
                inner = self.halves[b][0]
                if inner != b:
                    limit, b = b + 1, inner
                    continue
                limit, inner = a, self.halves[a][1]
                if inner == a:
                    answer = True
                    break
                a = inner
        if len(self.fits) > PAIRS:
            self.fits = {}
        self.fits[(left, right)] = answer
        return answer

    def encode_word(self, word: bytes) -> list[int]:
        whole = self.rank.get(word)
        if whole is not None:
            return [whole]
        latin, n = word.decode("latin-1"), len(word)
        longest, known = self.automaton.iter_long, self.fits.get
        dead = bytearray(n + 1)  # places that no encoding continues from
        ids: list[int] = []
        at, last = 0, -1
        length, token = next(longest(latin, at))[1]
        while True:
            fits = not dead[at + length]
            if fits and last >= 0:
                fits = known((last, token))
                if fits is None:
                    fits = self.compatible(last, token)
            if fits:
                ids.append(token)
                at += length
                if at == n:
                    return ids
                last = token
                length, token = next(longest(latin, at))[1]
                continue
            shorter = self.prefix[token]
            if shorter is not None:
                length, token = shorter
            else:  # go back to the left neighbour, whose end is dead now
                dead[at] = 1
                token = ids.pop()
                length = self.size_of(token)
                at -= length
                last = ids[-1] if ids else -1

    def encode_chunk(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if len(self.memo) > WORDS:
            self.memo = {}
        known, ids = self.memo, []
        for word in self.words.findall(text):
            part = known.get(word)
            if part is None:
                part = known[word] = self.encode_word(word.encode("utf-8"))
            ids += part
        return array.array("i", ids).tobytes()

    def encode_part(self, part: str) -> bytes | None:
        """Ids of a space and the part; None if it doesn't stand by itself."""
        if self.letters and part.isalpha():
            return array.array("i", self.encode_word(b" " + part.encode("utf-8"))).tobytes()
        return self.encode_chunk(" " + part) if begins_word(part) else None

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as 32-bit integers."""
        split = [text.split(" ") for text in texts]
        missing = self.spaced.missing(set().union(*(parts[1:] for parts in split)))
        known = self.spaced.young
        known.update((part, self.encode_part(part)) for part in missing)
        known = known.__getitem__
        out = []
        for text, (first, *rest) in zip(texts, split):
            try:
                out.append(self.encode_chunk(first) + b"".join(map(known, rest)))
            except TypeError:  # a part that doesn't stand by itself
                out.append(self.encode_chunk(text))
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and the number of bytes of each id."""
        lengths = self.lengths[ids]
        shift = np.repeat(self.starts[ids] - (np.cumsum(lengths) - lengths), lengths)
        return self.pool[shift + np.arange(len(shift))], lengths


@functools.lru_cache(maxsize=2)
def ranks(path: str, pattern: str) -> Ranks:
    return Ranks(path, pattern)


def ids_of(bpe: Ranks, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after another, and where each text's begin and end."""
    parts = [ids for group in slices(texts) for ids in bpe.encode(group)]
    return np.frombuffer(b"".join(parts), "<i4"), np.r_[0, np.cumsum([len(p) // 4 for p in parts], dtype=np.int64)]


def id_lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, pa.int32()))


def decoded(bpe: Ranks, values: np.ndarray, offsets: np.ndarray) -> pa.BinaryArray:
    """The bytes of each text's ids; an id that the ranks do not hold has none."""
    known = (values >= 0) & (values < len(bpe.lengths))
    data, lengths = bpe.decode(values if known.all() else values[known])
    sizes = np.zeros(len(values) + 1, np.int64)
    sizes[1:][known] = lengths
    ends = np.cumsum(sizes)[offsets]
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data.tobytes())])


def with_ids(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """The rows with the token ids of their whole text.

    A null or empty text has an empty array, equal texts have equal ids, an empty table
    stays empty, and other columns stay; a column named ``out`` is replaced.
    """

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = ranks(path, pattern)
        for batch in batches:
            yield id_lists(*ids_of(bpe, batch.to_pylist()))

    return df.withColumn(out, encoded(F.coalesce(F.col(text), F.lit(""))))


def with_decoded(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with the bytes that their ids stand for; a null array gives no bytes.
    An id that the ranks do not hold has no bytes."""

    @F.arrow_udf("binary")
    def bytes_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = ranks(path, pattern)
        for batch in batches:
            offsets = batch.offsets.to_numpy().astype(np.int64)
            values = batch.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]] if len(batch) else np.zeros(0, np.int32)
            yield decoded(bpe, values, offsets - offsets[0])

    return df.withColumn(out, bytes_of(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def with_round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "coded") -> DataFrame:
    """The rows with a struct of the ids of their whole text and the bytes decoded from them,
    in one pass; null, empty and equal texts as in :func:`with_ids`."""
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = ranks(path, pattern)
        for batch in batches:
            values, offsets = ids_of(bpe, batch.to_pylist())
            yield pa.StructArray.from_arrays([id_lists(values, offsets), decoded(bpe, values, offsets)], fields=list(kind))

    return df.withColumn(out, coded(F.coalesce(F.col(text), F.lit(""))))
