"""Token counts of byte-level BPE by rank-synchronous merging of numpy arrays.

Texts are cut at their spaces by Arrow, and only distinct parts are looked at in Python.
New pre-tokens are merged together.  Short ones are the columns of a matrix of symbols:
each round finds every column's lowest pair rank and the first place of it, and merges there.
Long ones stand one after another in one ragged array: each round applies a sequence's lowest
pair wherever it occurs.  A sequence without a known pair is done, and its surviving symbols
are counted.  A merged symbol only forms pairs of higher rank, so that merging all
occurrences of the lowest pair together gives the result of merging them one by one.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

NO_PAIR = np.int32(2**31 - 1)
SPREAD = np.uint64(0x9E3779B97F4A7C15)  # Fixed value: 2**64 by the golden ratio, which spreads keys over slots.
# Words of a generation of a memo, of which there are two in a task, and how many of them a
# worker keeps from task to task; it stays, and other work needs the memory.
MEMO = 100_000
KEPT = 30_000
# Likewise for pre-tokens other than a space and letters.
LOOSE = 20_000
# Characters of texts that are cut together, and bytes of pre-tokens that are merged together.
CUT_CHARS = 1_000_000
MERGED_BYTES = 200_000
# Pre-tokens of up to so many bytes are merged in columns; a power of two.
SHORT = 32
# Fixed value: how patterns begin under which a space and letters are one pre-token.
LETTERS_FIRST = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+|"
# What often follows a word; other signs are cut by the pattern too.
ENDS = ".,;:!?"


class Memo:
    """What is known of parts of texts, in two generations of bounded size: when the young one
    is full it becomes the old one, and what is asked for again moves to the young one.  So
    common parts stay and rare ones go."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, parts: set[str]) -> set[str]:
        """The parts that nothing is known of; the others are in ``young`` now."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        missing = parts.difference(self.young)
        again = [part for part in missing if part in self.old]
        self.young.update((part, self.old[part]) for part in again)
        return missing.difference(again)

    def recall(self, parts: Sequence[str]) -> list[int | None]:
        """What is known of each of some distinct parts, which is in ``young`` now."""
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young
        found = list(map(self.young.get, parts))
        if self.old:
            for i, known in enumerate(found):
                if known is None and (again := self.old.get(parts[i])) is not None:
                    found[i] = self.young[parts[i]] = again
        return found

    def trim(self, keep: int) -> None:
        """Keep the words met first, which are the common ones."""
        self.young, self.old = dict(itertools.islice(self.young.items(), keep)), {}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file:
    printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merges:
    """A byte-level BPE vocabulary file, ready for counting."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, added = spec["model"], spec["added_tokens"]
        before = spec["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or spec["normalizer"]:
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        vocab = model["vocab"]
        self.first = np.array([vocab[s] for s in byte_symbols()], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.nothing = max(vocab.values()) + 1  # a symbol that no pair has
        self.width = np.int64(self.nothing + 1)
        keys = np.array([vocab[a] for a, _ in pairs], np.int64) * self.width + np.array([vocab[b] for _, b in pairs], np.int64)
        self.file(*np.unique(keys, return_index=True))
        self.words = regex.compile(pattern)
        whole = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, whole))) if whole else None
        self.letters = pattern.startswith(LETTERS_FIRST)
        self.ends = ENDS if self.letters and not regex.search(r"\(\?<|\\[bBGKm]", pattern) else ""
        self.spaced, self.loose = Memo(MEMO), Memo(LOOSE)

    def file(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Put each pair's key into its slot or, where that is taken, into the next free one."""
        bits = (4 * len(keys)).bit_length()
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key, self.slot_rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NO_PAIR, np.int32)
        at = self.slot(keys)
        while len(keys):
            free = self.slot_key[at] < 0
            self.slot_key[at[free]] = keys[free]
            placed = self.slot_key[at] == keys
            self.slot_rank[at[placed]] = ranks[placed]
            keys, ranks, at = keys[~placed], ranks[~placed], (at[~placed] + 1) & self.last

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * SPREAD) >> self.shift).view(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.width + right
        at = self.slot(keys)
        found = self.slot_key[at]
        ranks = np.where(found == keys, self.slot_rank[at], NO_PAIR)
        more = np.flatnonzero((found != keys) & (found >= 0))
        at = at[more]
        while len(more):  # the slot is another pair's
            at = (at + 1) & self.last
            found = self.slot_key[at]
            same = found == keys[more]
            ranks[more[same]] = self.slot_rank[at[same]]
            going = ~same & (found >= 0)
            more, at = more[going], at[going]
        return ranks

    def merged_columns(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each sequence of 1 to ``SHORT`` bytes."""
        n, rows = len(words), max(map(len, words)) + 1
        done = np.fromiter(map(len, words), np.int64, n)
        place = np.arange(rows, dtype=np.int32)[:, None]
        data = np.array(words, f"S{rows}").view(np.uint8).reshape(n, rows).T
        # The last row holds no symbol; it stands after the last and before the first one.
        ids = np.where(place < done, self.first[data], self.nothing).astype(np.int32).ravel()
        after = np.repeat(np.minimum(place + 1, rows - 1), n)
        before = np.repeat(np.where(place, place - 1, rows - 1), n)

        def numbered(left: np.ndarray, right: np.ndarray, row: np.ndarray) -> np.ndarray:
            """A pair's rank and the row of its left symbol in one number."""
            ranks = self.rank(left, right)
            return np.where(ranks == NO_PAIR, NO_PAIR, ranks * np.int32(SHORT) + row)

        pairs = np.full(rows * n, NO_PAIR, np.int32)
        pairs[:-n] = numbered(ids[:-n], ids[n:], np.repeat(place[:-1], n))
        while True:
            low = pairs.reshape(rows, n).min(axis=0)
            going = np.flatnonzero(low != NO_PAIR)
            if not len(going):
                return done
            low = low[going]
            row = low % SHORT
            left = row * n + going
            right = after[left] * n + going
            end, start = after[right], before[left]
            behind, ahead = end * n + going, start * n + going
            new = self.result[low // SHORT]
            ids[left], after[left], before[behind], pairs[right] = new, end, row, NO_PAIR
            pairs[left] = numbered(new, ids[behind], row)
            pairs[ahead] = numbered(ids[ahead], new, start)
            done[going] -= 1

    def merged_lengths(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each sequence of bytes; none of them is empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.first[np.frombuffer(b"".join(words), np.uint8)]
        seq = np.repeat(np.arange(len(words)), lengths)
        done = np.zeros(len(words), np.int64)
        ranks = np.full(len(ids), NO_PAIR, np.int32)
        inside = np.flatnonzero(seq[:-1] == seq[1:])
        ranks[inside] = self.rank(ids[inside], ids[inside + 1])
        while len(ids):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            sizes = np.diff(np.r_[starts, len(seq)])
            lowest = np.minimum.reduceat(ranks, starts)
            over = lowest == NO_PAIR
            done[seq[starts[over]]] = sizes[over]
            going = ~np.repeat(over, sizes)
            ids, seq, ranks = ids[going], seq[going], ranks[going]
            if not len(ids):
                break
            hit = ranks == np.repeat(lowest[~over], sizes[~over])
            # In a run of hits, as of equal symbols, every second one from the left is a pair.
            at = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], at, 0))
            hit &= (at - run) % 2 == 0
            ids[hit] = self.result[ranks[hit]]
            stay = ~np.r_[False, hit[:-1]]
            ids, seq, ranks, hit = ids[stay], seq[stay], ranks[stay], hit[stay]
            new = np.flatnonzero(hit | np.r_[hit[1:], False])
            ranks[new] = NO_PAIR
            new = new[new + 1 < len(ids)]
            new = new[seq[new] == seq[new + 1]]
            ranks[new] = self.rank(ids[new], ids[new + 1])
        return done

    def merged(self, words: Sequence[str]) -> list[int]:
        """Tokens of each pre-token; so many are merged at once that the arrays stay small."""
        coded = [word.encode("utf-8") for word in words]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        order = np.argsort(lengths, kind="stable")
        coded, lengths = [coded[i] for i in order.tolist()], lengths[order]
        short = int(np.searchsorted(lengths, SHORT, "right"))
        cuts = {0, short, len(coded), *(np.flatnonzero(np.diff(np.cumsum(lengths) // MERGED_BYTES)) + 1).tolist()}
        counts = np.zeros(len(coded), np.int64)
        for a, b in itertools.pairwise(sorted(cuts)):
            counts[order[a:b]] = (self.merged_columns if b <= short else self.merged_lengths)(coded[a:b])
        return counts.tolist()

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; all new pre-tokens of the texts are merged together."""
        plain = np.zeros(len(texts), np.int64)
        whole: list[tuple[int, str]] = []
        cut = list(texts)
        for i, text in enumerate(texts):
            if self.added is not None and self.added.search(text):
                segments = self.added.split(text)
                plain[i] = len(segments) - 1
                whole += [(i, s) for s in segments]
                cut[i] = ""
        # The first part of a text has no space before it and is counted by itself.
        lists = pc.split_pattern(pa.array(cut, pa.string()), " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        first = lists.values.take(pa.array(offsets[:-1])).to_pylist()
        rest = np.ones(offsets[-1], bool)
        rest[offsets[:-1]] = False
        coded = lists.values.filter(pa.array(rest)).dictionary_encode()
        offsets -= np.arange(len(offsets))
        parts, places = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        known = self.spaced.recall(parts)

        new = [i for i, n in enumerate(known) if n is None]
        letters, ended, apart, joined = [], [], [], []
        for i in new:
            part = parts[i]
            if self.letters and part.isalpha():
                letters.append(part)
            elif self.ends and (stem := part.rstrip(self.ends)).isalpha():
                ended.append((part, stem, part[len(stem):]))
            elif begins_word(part):
                apart.append(part)
            else:
                joined.append(i)
        odd = np.zeros(len(texts), bool)
        if joined:  # texts with a part that doesn't stand by itself
            met = np.zeros(len(parts), np.int64)
            met[joined] = 1
            met = np.r_[0, np.cumsum(met[places])]
            odd = met[offsets[1:]] > met[offsets[:-1]]
        whole += [(i, cut[i] if odd[i] else part) for i, part in enumerate(first)]
        tails = list({tail for _, _, tail in ended})
        chunks = [self.words.findall(chunk) for chunk in itertools.chain((" " + part for part in apart), tails, (s for _, s in whole))]

        # A space and letters are known as a part, wherever they stand.
        words = set().union(*chunks)
        spaced = {w for w in words if w[0] == " " and w[1:].isalpha()} if self.letters else set()
        stems = list({stem for _, stem, _ in ended}.union(w[1:] for w in spaced).difference(letters))
        loose = list(words - spaced)
        of_stem, of_word = dict(zip(stems, self.spaced.recall(stems))), dict(zip(loose, self.loose.recall(loose)))
        letters += [stem for stem, n in of_stem.items() if n is None]
        loose = [word for word, n in of_word.items() if n is None]
        merged = self.merged([*(" " + part for part in letters), *loose])
        of_stem.update(zip(letters, merged))
        of_word.update(zip(loose, merged[len(letters):]))
        self.loose.young.update((word, of_word[word]) for word in loose)
        of_word.update((word, of_stem[word[1:]]) for word in spaced)
        counts = [sum(map(of_word.__getitem__, chunk)) for chunk in chunks]
        of_tail = dict(zip(tails, counts[len(apart):]))
        of_part = dict(zip(letters, merged)) | {part: of_stem[stem] + of_tail[tail] for part, stem, tail in ended} | dict(zip(apart, counts))
        self.spaced.young.update(of_part)
        for (i, _), n in zip(whole, counts[len(apart) + len(tails):]):
            plain[i] += n
        for i in new:
            known[i] = of_part.get(parts[i], 0)
        total = np.r_[0, np.cumsum(np.array(known, np.int64)[places])]
        return (plain + np.where(odd, 0, total[offsets[1:]] - total[offsets[:-1]])).tolist()


def begins_word(part: str) -> bool:
    """Whether a space before this part begins a pre-token.

    A text is cut at its spaces.  A space before a visible character always begins a
    pre-token, so that such a part, with its space, holds whole pre-tokens.  A space before
    other white space does not, and a text with one is taken in one piece.
    """
    return bool(part) and not part[0].isspace()


@functools.lru_cache(maxsize=2)
def merges(path: str, pattern: str) -> Merges:
    return Merges(path, pattern)


def slices(texts: list[str], chars: int = 500_000) -> Iterator[list[str]]:
    """Texts in groups of bounded length; a longer text stands alone."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > chars:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def with_token_counts(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """The rows with the number of tokens of their whole text.

    A null text counts as empty, an empty text has no token, equal texts count alike, an
    empty table stays empty, and other columns stay; a column named ``out`` is replaced.
    """

    @F.arrow_udf("bigint")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = merges(path, pattern)
        for batch in batches:
            counts = [n for group in slices(batch.to_pylist(), CUT_CHARS) for n in bpe.count(group)]
            yield pa.array(counts, pa.int64())
        bpe.spaced.trim(KEPT)

    return df.withColumn(out, counted(F.coalesce(F.col(text), F.lit(""))))
