"""Vectorised text helpers used inside tasks: words, hashes and slices of Arrow string columns.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``.  All separators are single ASCII
bytes, so words are found on the UTF-8 bytes of a whole Arrow batch at once.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
LOWER_BYTES = bytes(_LOWER)          # for bytes.translate: A-Z only
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_HASH_BYTES = 1 << 20                # bytes hashed at a time: bounds the temporary arrays


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows holding at most ``max_bytes`` of text (one longer text stays alone)."""
    sizes = batch.column(column).cast(pa.large_string()).fill_null("")
    offsets = offsets_of(sizes)
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + max_bytes, "right")) - 1
        stop = min(max(stop, start + 1), n)
        yield batch.slice(start, stop - start)
        start = stop


def offsets_of(texts: pa.LargeStringArray) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, joined, and the n + 1 offsets of the texts in them (null: empty)."""
    texts = column.cast(pa.large_string()).fill_null("")
    offsets = offsets_of(texts)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word; no word crosses a text's end."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    word = ~_SEPARATOR[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    filled = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    first[heads] = word[heads]
    last[tails] = word[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, grown by doubling."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(1 << 12, 1 << int(n - 1).bit_length()) if n else 1 << 12
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        out = []
        for b in (_BASE, inverse):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps))
        _POWERS[0] = have = (out[0], out[1])
    return have


_TABLES: dict[tuple[int, bool], np.ndarray] = {}


def _table(seed: int, lower: bool) -> np.ndarray:
    if (seed, lower) not in _TABLES:
        table = np.random.default_rng(seed).integers(0, 1 << 64, 256, np.uint64, endpoint=False)
        _TABLES[seed, lower] = table[_LOWER] if lower else table
    return _TABLES[seed, lower]


def byte_codes(data: np.ndarray, seed: int = 1) -> np.ndarray:
    """A random 64-bit number for each byte: what ``gram_hashes`` needs to hash runs of bytes."""
    return _table(seed, False)[data]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1, lower: bool = False) -> np.ndarray:
    """64-bit hash of each byte span, from prefix sums of a random byte code times powers of a base."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + _HASH_BYTES, "right")))
        stop = ends[j - 1]
        power, inverse = _powers(int(stop - at) + 1)
        total = np.zeros(stop - at + 1, np.uint64)
        np.cumsum(_table(seed, lower)[data[at:stop]] * power[:stop - at], out=total[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
        i = j
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive word hashes (``len(words) - n + 1`` of them)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out, done = np.empty(count, np.uint64), 0
    while done < count:
        part = words[done:min(done + _HASH_BYTES, count) + n - 1]
        power, inverse = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[:len(part)], out=total[1:])
        got = len(part) - n + 1
        out[done:done + got] = mix((total[n:] - total[:-n]) * inverse[:got])
        done += got
    return out


class WordCodes:
    """128 bits of keyed BLAKE2b for every word, in two 64-bit lanes.

    The key is drawn for each run, so nobody can choose words whose codes collide.
    """

    def __init__(self, key: bytes, remembered: int = 1 << 20, lower: bool = False):
        self.key, self.remembered, self.lower = key, remembered, lower
        self.number: dict[bytes, int] = defaultdict(itertools.count().__next__)
        self.lanes = np.zeros((1024, 2), np.uint64)

    def numbers(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of a column of texts, valid until ``forget``, and how many words each text has."""
        data, offsets = text_bytes(column)
        raw, known, number = data.tobytes(), len(self.number), self.number
        raw = raw.translate(LOWER_BYTES) if self.lower else raw
        split = [raw[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        places = np.fromiter(map(number.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(sizes.sum()))
        if len(number) > len(self.lanes):
            more = np.zeros((max(len(number), 2 * len(self.lanes)), 2), np.uint64)
            more[:known] = self.lanes[:known]
            self.lanes = more
        if len(number) > known:
            new = list(itertools.islice(reversed(number), len(number) - known))[::-1]
            codes = b"".join(hashlib.blake2b(w, digest_size=16, key=self.key).digest() for w in new)
            self.lanes[known:known + len(new)] = np.frombuffer(codes, "<u8").reshape(-1, 2)
        return places, sizes

    def forget(self) -> None:
        """Start anew where too many words are remembered."""
        if len(self.number) > self.remembered:
            self.number = defaultdict(itertools.count().__next__)

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Lanes of all words of a column of texts, and the number of the text that each word is in."""
        self.forget()
        places, sizes = self.numbers(column)
        return self.lanes[places], np.repeat(np.arange(len(sizes)), sizes)

    def one(self, word: bytes) -> np.ndarray:
        return np.frombuffer(hashlib.blake2b(word, digest_size=16, key=self.key).digest(), "<u8").reshape(1, 2)
