"""Packing documents into sequences by cutting-stock column generation.

Pieces.  A document of n ids gives n // capacity full pieces, one main piece whose length is a
multiple of ``UNIT`` and one tail below ``UNIT``, so pieces have few distinct lengths and both kinds
fit their sequences without rounding.

Patterns.  Only the histogram of lengths (bounded by the capacity, whatever the corpus) comes to the
driver.  For mains and for tails a linear program over patterns (how many pieces of each length
one sequence holds) is solved by column generation: the revised simplex method prices the lengths,
and a knapsack dynamic program finds the pattern worth most at those prices, until none is worth
more than a sequence.  The solution is rounded down, and what is left is filled by exact
subset-sum patterns.

Assignment.  Pieces are ranked within their length (hash ranges are counted and ranked separately,
so a length that a third of the pieces share is not ranked in one task); a rank determines the
pattern, the sequence and the offset in closed form.

Special cases: a null or empty text is the end id alone; repeated rows are packed each; an empty
table gives an empty result; other columns are ignored.  A sequence that is not full is padded to
the capacity unless its length is a power of two; only the last few of each kind are not full.
"""

from __future__ import annotations

import array
import itertools
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalytics.llm import frames, text

CAPACITY = 4096
UNIT = 16
END_ID = 2
RANGE_ROWS = 50_000          # pieces of one length ranked in one task
_CACHE = 1_000_000             # distinct words, and distinct runs of them, from which on a worker starts anew

Pattern = tuple[dict[int, int], int]      # pieces by length in one sequence; number of sequences


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


# ---- ids ----

#: The text steps for which words can be coded one by one, as the tokenizer's file names them.
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters from ASCII to Latin Extended-B that no normalization changes and whose lower case is one of them.  A letter with a
#: lower case beyond that range (as in U+0181 or U+018F) is none: its word goes through the whole tokenizer.
_RANGE = {*map(chr, (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x250)))}
_LATIN = "".join(sorted(c for c in _RANGE if c.lower() in _RANGE))
_PLAIN = re.compile(f"[{_LATIN}!-~]+")
_RUN = re.compile(f"[{_LATIN}]+|[0-9]|[^{_LATIN}0-9]+")


def _byte_letters() -> list[str]:
    """The letter a byte-level tokenizer writes for each byte: printable Latin-1 as it is, the others from U+0100 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


class _Memory:
    """Ids of keys, one key after another; a key's number tells where its ids are."""

    def __init__(self):
        self.number: dict[str | bytes, int] = defaultdict(itertools.count().__next__)
        self.first, self.size, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)
        self.known = self.used = 0

    def numbers(self, keys: Iterator[str | bytes], n: int) -> tuple[np.ndarray, list[str | bytes]]:
        """Numbers of the n keys, and the keys that are new, whose ids are to be added next."""
        at = np.fromiter(map(self.number.__getitem__, keys), np.int64, n)
        new = list(itertools.islice(reversed(self.number), len(self.number) - self.known))
        new.reverse()
        return at, new

    def add(self, size: np.ndarray, ids: np.ndarray):
        n, used = self.known + len(size), self.used + len(ids)
        if n > len(self.first):
            self.first, self.size = (np.resize(x, 2 * n) for x in (self.first, self.size))
        if used > len(self.ids):
            self.ids = np.resize(self.ids, 2 * used)
        self.size[self.known:n], self.first[self.known:n] = size, self.used + np.cumsum(size) - size
        self.ids[self.used:used] = ids
        self.known, self.used = n, used

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered keys, joined, and the offsets of the keys in them."""
        size = self.size[at]
        stop = np.cumsum(size)
        return self.ids[np.repeat(self.first[at] - stop + size, size) + np.arange(int(stop[-1]) if len(stop) else 0)], np.concatenate([[0], stop])


class WordCoder:
    """Ids of texts through a memory of words.

    The tokenizer drops white space and never joins across it, so a word's ids do not depend on
    its neighbours.  A word of Latin letters, digits and ASCII marks is cut as the tokenizer's own
    pattern cuts it and each run goes straight to its merge model; any other word, and one that may
    hold an apostrophe form or a special token, goes through the whole tokenizer.  A tokenizer
    with other text steps codes whole texts.  Ids are kept in arrays: a list for each
    word would be visited by every collection of Python's garbage.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        steps = json.loads(self.tokenizer.to_str())
        split = (steps.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_word = steps.get("normalizer") == _NORMALIZER and split[0].get("pattern") == {"Regex": _SPLIT}
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.words, self.runs = _Memory(), _Memory()

    def _ids(self, run: str | bytes) -> list[int]:
        if isinstance(run, bytes):
            return self.tokenizer.encode(run.decode(), add_special_tokens=False).ids
        return [t.id for t in self.model.tokenize(run if run.isascii() else "".join(self.letters[b] for b in run.encode()))]

    @staticmethod
    def _cut(word: bytes) -> list[str] | list[bytes]:
        """The runs of a word, in lower case; a word for the whole tokenizer is one run, in bytes."""
        if word.isalpha():                                  # ASCII letters only
            return [word.decode().lower()]
        if word[:-1].isalpha() and word[-1:] in (b".", b","):
            body = word.decode().lower()
            return [body[:-1], body[-1]]
        body = word.decode()
        if _PLAIN.fullmatch(body) and "'" not in body and "<|" not in body:
            return _RUN.findall(body.lower())
        return [word]

    def _learn(self, words: list[bytes]):
        cut = [self._cut(w) for w in words]
        ends = np.cumsum([0, *map(len, cut)])
        at, new = self.runs.numbers(itertools.chain.from_iterable(cut), int(ends[-1]))
        size, flat = np.zeros(len(new), np.int64), array.array("I")
        for k, run in enumerate(new):
            ids = self._ids(run)
            size[k] = len(ids)
            flat.extend(ids)
        self.runs.add(size, np.array(flat, np.uint32))
        ids, offsets = self.runs.take(at)
        self.words.add(np.diff(offsets[ends]), ids)

    def encode(self, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, joined, and the offsets of the texts in them."""
        if not self.by_word:
            whole = [e.ids for e in self.tokenizer.encode_batch_fast([b.decode() for b in bodies], add_special_tokens=False)]
            return np.array([i for ids in whole for i in ids], np.uint32), np.cumsum([0, *map(len, whole)])
        if max(self.words.known, self.runs.known) > _CACHE:
            self.words, self.runs = _Memory(), _Memory()
        split = [b.split() for b in bodies]
        ends = np.cumsum([0, *map(len, split)])
        at, new = self.words.numbers(itertools.chain.from_iterable(split), int(ends[-1]))
        if new:
            self._learn(new)
        flat, offsets = self.words.take(at)
        return flat, offsets[ends]


_CODERS: dict[str, WordCoder] = {}


def _piece_lengths(n: int, capacity: int, unit: int) -> list[int]:
    rest = n % capacity
    main = rest // unit * unit
    return [capacity] * (n // capacity) + [x for x in (main, rest - main) if x]


def _piece_batches(path: str, capacity: int, unit: int, end_id: int, id_names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _CODERS:
            _CODERS[path] = WordCoder(path)
        coder = _CODERS[path]
        for batch in batches:
            for part in text.slices(batch, "__text", 1 << 20):
                bodies = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column("__text").cast(pa.large_string())]
                flat, offsets = coder.encode(bodies)
                row, start, length, ids, total = [], [], [], [], []
                for r, (b, e) in enumerate(zip(offsets[:-1], offsets[1:])):
                    own, at = np.append(flat[b:e], np.uint32(end_id)).astype("<u4"), 0
                    for n in _piece_lengths(len(own), capacity, unit):
                        row.append(r)
                        start.append(at)
                        length.append(n)
                        ids.append(own[at:at + n].tobytes())
                        total.append(len(own))
                        at += n
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(at) for c in id_names), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(ids, pa.binary()), pa.array(total, pa.int64())], [*id_names, "start", "length", "ids", "doc_tokens"])
    return run


def pieces(docs: DataFrame, keep: dict[str, Column], text_column: str = "text", path: str | None = None, capacity: int = CAPACITY,
           unit: int = UNIT, end_id: int = END_ID) -> DataFrame:
    """The kept columns, start, length, ids (little-endian unsigned 32-bit) and doc_tokens of every piece."""
    chosen = docs.select(*(c.alias(n) for n, c in keep.items()), docs[text_column].cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "__text")
    return chosen.mapInArrow(_piece_batches(path or tokenizer_path(), capacity, unit, end_id, list(keep)),
                             f"{schema}{', ' if keep else ''}start long, length long, ids binary, doc_tokens long")


# ---- patterns ----

def _knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Pattern of the greatest total price (lengths may repeat), by dynamic programming over the capacity."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        n = np.searchsorted(lengths, c, "right")
        if n:
            worth = best[c - lengths[:n]] + prices[:n]
            i = int(worth.argmax())
            if worth[i] > best[c] + 1e-12:
                best[c], choice[c] = worth[i], i
    column, c = np.zeros(len(lengths)), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            column[choice[c]] += 1
            c -= int(lengths[choice[c]])
    return float(best[capacity]), column


def column_generation(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and their fractional use in a least-sequences plan that covers the demand."""
    m = len(lengths)
    basis = np.diag((capacity // lengths).astype(float))
    inverse, use = np.diag(1 / np.diag(basis)), demand / np.diag(basis)
    while True:
        prices = inverse.sum(axis=0)                        # every pattern costs one sequence
        worth, column = _knapsack(lengths, prices, capacity)
        if worth <= 1 + 1e-7:
            return basis.T, use
        rise = inverse @ column
        able = rise > 1e-10
        ratio = np.full(m, np.inf)
        ratio[able] = use[able] / rise[able]
        out = int(ratio.argmin())
        step = max(ratio[out], 0.0)
        use = np.maximum(use - step * rise, 0.0)
        use[out] = step
        row = inverse[out] / rise[out]
        inverse -= np.outer(rise, row)
        inverse[out] = row
        basis[:, out] = column


def _fullest(lengths: np.ndarray, left: np.ndarray, capacity: int) -> np.ndarray:
    """Counts (at most ``left``) with the greatest total length within the capacity; long pieces first."""
    steps, reach, mask = [], 1, (1 << (capacity + 1)) - 1
    for i in range(len(lengths) - 1, -1, -1):
        n, k = min(int(left[i]), capacity // int(lengths[i])), 1
        while n:
            k = min(k, n)
            steps.append((i, k, reach))
            reach |= (reach << (k * int(lengths[i]))) & mask
            n, k = n - k, 2 * k
        if reach >> capacity:
            break
    counts, at = np.zeros(len(lengths), np.int64), reach.bit_length() - 1
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            counts[i] += k
            at -= k * int(lengths[i])
    return counts


def patterns(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Whole patterns that hold exactly the pieces of the histogram (length: count)."""
    if not histogram:
        return []
    lengths = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    out: list[Pattern] = []

    def take(counts: np.ndarray, most: int):
        used = np.flatnonzero(counts)
        times = min(most, int((left[used] // counts[used]).min())) if len(used) else 0
        if times > 0:
            out.append(({int(lengths[i]): int(counts[i]) for i in used}, times))
            left[used] -= counts[used] * times

    rows, use = column_generation(lengths, left.astype(float), capacity)
    for p in np.argsort(-use, kind="stable"):
        take(rows[p].astype(np.int64), int(np.floor(use[p] + 1e-9)))
    while left.any():
        take(_fullest(lengths, left, capacity), 1 << 62)
    return out


def plan(histogram: dict[int, int], capacity: int, unit: int) -> list[Pattern]:
    """Full pieces alone, mains in units, tails in ids."""
    full = [({capacity: 1}, histogram[capacity])] if histogram.get(capacity) else []
    mains = patterns({n // unit: c for n, c in histogram.items() if n < capacity and n % unit == 0}, capacity // unit)
    tails = patterns({n: c for n, c in histogram.items() if n % unit}, capacity)
    return full + [({n * unit: c for n, c in p.items()}, times) for p, times in mains] + tails


# ---- assignment ----

def _ranges(sequences: list[Pattern]) -> dict[int, np.ndarray]:
    """By length: first rank, pieces per sequence, first sequence, first offset of each pattern that holds the length."""
    out: dict[int, list] = {}
    seen: dict[int, int] = {}
    base = 0
    for pieces_by_length, times in sequences:
        offset = 0
        for n, count in sorted(pieces_by_length.items(), reverse=True):
            out.setdefault(n, []).append((seen.get(n, 0), count, base, offset))
            seen[n] = seen.get(n, 0) + count * times
            offset += n * count
        base += times
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def _assign_batches(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = broadcast.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                own, table = np.flatnonzero(length == n), ranges[int(n)]
                row = table[np.searchsorted(table[:, 0], rank[own], "right") - 1]
                within = rank[own] - row[:, 0]
                sequence[own] = row[:, 2] + within // row[:, 1]
                offset[own] = row[:, 3] + within % row[:, 1] * n
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])
    return run


def assign(cut: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """Add sequence_id and offset to every piece; ``cut`` is a written table (it is read three times)."""
    spark = cut.sparkSession
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}     # at most ``capacity`` rows
    sequences = plan(histogram, capacity, unit)
    parts = max(1, -(-max(histogram.values(), default=0) // RANGE_ROWS))
    names = cut.columns
    dealt = cut.withColumn("__part", F.pmod(F.xxhash64(*names), F.lit(parts)))
    own = Window.partitionBy("length", "__part").orderBy(*names)
    before = dealt.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(
        F.sum("__n").over(Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = dealt.withColumn("__row", F.row_number().over(own)).join(before.select("length", "__part", "__before"), ["length", "__part"]).select(
        *names, (F.col("__before") + F.col("__row") - 1).cast("long").alias("rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(_assign_batches(spark.sparkContext.broadcast(_ranges(sequences))), f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """Contract columns of every piece of ``docs``."""
    cut = pieces(docs, {"doc_id": docs[id_column]}, text_column, path)
    cut = cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return assign(frames.cut(cut, "pieces"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(frames.table(spark, sf_dir, "documents"))
