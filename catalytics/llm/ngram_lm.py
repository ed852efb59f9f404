"""Language-model scoring with a sharded Elias-Fano n-gram trie.

Model.  Training tokens are lower-cased words (A-Z) and one end per text; a begin mark stands before
each text.  With mu = ``MU`` the probabilities are smoothed order by order towards the shorter context:
P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)), P(w | v) = (c(v w) + mu P(w)) / (c(v) + mu) and
P(w | u v) = (c(u v w) + mu P(w | v)) / (c(u v) + mu).  An entry of the trie keeps two quantised numbers:
its own share c(.. w) / (c(..) + mu) and the weight mu / (c(.. w) + mu) with which it, as a context, passes
on the shorter order.  Codes are 16-bit logarithms in steps of 1/4096 decade.

Trie.  Words have dense numbers.  A level is one Elias-Fano sequence of (place of the parent, word number),
monotone because children lie behind those of the parent before; a second Elias-Fano sequence holds a
monotone pointer to each parent's first child.  A successor is searched relative to its context: select
on the high bits finds the few entries that share its high part, the pointers say whether they are the
context's own, and low bytes are compared in place.  Nothing is decoded but small directories of bit counts.
``train`` writes the encoded levels of every shard (``levels``); they can be saved and memory-mapped
(``Trie.save``, ``Trie.map_file``), and are asked in the form in which they are written.  The query, which scores
within the job that trains, asks the same encoded levels in its shards' tasks and does not store them.

Jobs.  1. Texts become blocks of about ``BLOCK_TOKENS`` tokens; a word is named by 128 bits of BLAKE2b
under a key drawn for the run.  2. Words are shuffled once per block, counted exactly and numbered in shards.
3. Every block sends each n-gram of known words once, in order, as variable-length gaps, to the shard
of its first word; the shard builds its trie from the training counts of all blocks and answers each
block's n-grams.  N-grams that start with a hot word (at least ``HOT_SHARE`` of all tokens, so the words are
few) are spread by their second word, so a word with a third of all tokens is never in one task.  4. Answers
return to the block, which adds up its texts.  The numbers of shards follow the number of tokens.

Special cases: a null or empty text is its end token; repeated rows are separate rows (and train as
often as they occur); ids may be of any type; without training rows every probability is the smoothed zero
count; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import mmap
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from catalytics.llm import frames, text

BLOCK_TOKENS = 1 << 20
SHARD_TOKENS = 2_500_000
ADD = 0.1
MU = 2.0
BEGIN = 1                      # number of the begin mark; 0 is a word that training has not seen
FIRST_WORD = 2
HOT_SHARE = 1 / 1000           # of all tokens: n-grams of a first word from here on are spread
_END = b" end"                 # no word holds a space
_STEP = 1 / 4096               # decades between two codes


# ---- codes and varints ----

def quantise(p: np.ndarray) -> np.ndarray:
    """Codes 1 to 65535 of probabilities from 1 down to 10^-16; 0 is left for none."""
    with np.errstate(divide="ignore"):
        return (1 + np.clip(np.rint(-np.log10(p) / _STEP), 0, 65534)).astype("<u2")


def restore(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** (-(code.astype(float) - 1) * _STEP), 0.0)


def varint(values: np.ndarray) -> bytes:
    """Seven bits a byte, low ones first; the last byte of a number is below 128."""
    v = np.asarray(values, np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1) << np.uint64(7 * k)
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > k)
        more = (size[own] > k + 1).astype(np.uint8) << 7
        out[start[own] + k] = ((v[own] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more
    return out.tobytes()


def read_varint(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    last = b < 128
    stop = np.flatnonzero(last) + 1
    start = np.concatenate([[0], stop[:-1]]) if len(stop) else stop
    place = np.arange(len(b)) - np.repeat(start, stop - start)
    part = (b & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.add.reduceat(part, start).astype(np.int64) if len(start) else np.zeros(0, np.int64)


def gaps(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Differences of numbers that rise within each group of neighbours; the first of a group as it is."""
    out = np.diff(values, prepend=0)
    first = np.diff(group, prepend=-1) != 0
    out[first] = values[first]
    return out


def ungap(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers again, for groups of the given sizes."""
    total = np.cumsum(steps)
    start = np.cumsum(sizes) - sizes
    held = sizes > 0
    before = np.zeros(len(sizes), np.int64)
    before[held] = total[start[held]] - steps[start[held]]
    return total - np.repeat(before, sizes)


# ---- Elias-Fano ----

_PLACE_OF_ONE = np.zeros((256, 8), np.int8)
for _b in range(256):
    _at = [i for i in range(8) if _b >> i & 1]
    _PLACE_OF_ONE[_b, :len(_at)] = _at
_SUPER = 8                     # 64-bit words of high bits counted together
_ASKED = 1 << 16               # numbers searched at a time


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers, and the place of each number among them; sorted numbers, as n-grams in order ask for, are not sorted again."""
    new = np.append(True, values[1:] != values[:-1]) if len(values) else np.zeros(0, bool)
    if (values[1:] < values[:-1]).any():
        return np.unique(values, return_inverse=True)
    return values[new], np.cumsum(new) - 1


class EliasFano:
    """A sorted sequence of numbers: low bytes, and high parts as unary gaps in a bit string of whole superblocks."""

    def __init__(self, high, lows, low: int, n: int):
        self.words = np.frombuffer(high, "<u8").reshape(-1, _SUPER)
        self.lows = np.frombuffer(lows, np.uint8).reshape(n, low) if low else None
        self.low, self.n = low, n
        ones = np.bitwise_count(self.words).sum(axis=1, dtype=np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])            # the directory: one number for 512 bits
        self.zeros = np.arange(len(self.ones)) * (64 * _SUPER) - self.ones

    @staticmethod
    def encode(values: np.ndarray) -> tuple[bytes, bytes, int, int]:
        n = len(values)
        if not n:
            return b"", b"", 0, 0
        low = min(7, max(0, -(-(int(values[-1]).bit_length() - n.bit_length()) // 8)))
        high = (values >> (8 * low)) + np.arange(n)
        bits = np.zeros(-(-(int(high[-1]) + 2) // (64 * _SUPER)) * 64 * _SUPER, np.uint8)      # a zero behind the last one
        bits[high] = 1
        lows = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :low]).tobytes()
        return np.packbits(bits, bitorder="little").tobytes(), lows, low, n

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Bit places of the k-th (from 0) ones or zeros."""
        directory, row = self.ones if one else self.zeros, np.arange(len(k))
        block = np.searchsorted(directory, k, "right") - 1
        words = self.words[block] if one else ~self.words[block]
        upto = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        rest = k - directory[block]
        w = (upto <= rest[:, None]).sum(axis=1)
        rest = rest - np.where(w > 0, upto[row, np.maximum(w - 1, 0)], 0)
        held = np.ascontiguousarray(words[row, w]).view(np.uint8).reshape(-1, 8)
        upto = np.cumsum(np.bitwise_count(held), axis=1, dtype=np.int64)
        byte = (upto <= rest[:, None]).sum(axis=1)
        rest = rest - np.where(byte > 0, upto[row, np.maximum(byte - 1, 0)], 0)
        return (block * _SUPER + w) * 64 + byte * 8 + _PLACE_OF_ONE[held[row, byte], rest]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low:
            return np.zeros(len(i), np.int64)
        whole = np.zeros((len(i), 8), np.uint8)
        whole[:, :self.low] = self.lows[i]
        return whole.view("<i8").ravel()

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th numbers."""
        out = np.empty(len(i), np.int64)
        for b in range(0, len(i), _ASKED):
            own = i[b:b + _ASKED]
            out[b:b + _ASKED] = (self._select(own, True) - own) << (8 * self.low) | self._low(own)
        return out

    def find(self, values: np.ndarray) -> np.ndarray:
        """Place of each number, or -1: select gives the run of entries with its high part, their low bytes are searched in place."""
        out = np.full(len(values), -1, np.int64)
        if not self.n:
            return out
        most = int(self.zeros[-1]) - 1
        for b in range(0, len(values), _ASKED):
            v = values[b:b + _ASKED]
            own = np.flatnonzero((v >= 0) & (v >> (8 * self.low) <= most))
            high, which = _runs(v[own] >> (8 * self.low))
            begin = np.zeros(len(high), np.int64)
            later = high > 0
            begin[later] = self._select(high[later] - 1, False) + 1 - high[later]
            end = self._select(high, False) - high
            low, stop, wanted = begin[which], end[which], v[own] & ((1 << (8 * self.low)) - 1)
            top = stop.copy()
            while len(open_ := np.flatnonzero(low < top)):                # binary search of all runs at once
                middle = (low[open_] + top[open_]) >> 1
                less = self._low(middle) < wanted[open_]
                low[open_] = np.where(less, middle + 1, low[open_])
                top[open_] = np.where(less, top[open_], middle)
            inside = np.flatnonzero(low < stop)
            inside = inside[self._low(low[inside]) == wanted[inside]]
            out[b + own[inside]] = low[inside]
        return out


# ---- one shard's trie ----

class Trie:
    """Levels of one shard: contexts of one word, their successors, and the successors of those pairs."""

    PARTS = ("words", "pairs", "triples")

    def __init__(self, levels: dict):
        self.levels = levels
        head = np.frombuffer(levels["head"], "<i8").tolist()
        self.bits = head[0]
        self.sequences = {}
        for k, name in enumerate((*self.PARTS, "pair_pointers", "triple_pointers")):
            self.sequences[name] = EliasFano(levels[f"{name}_high"], levels[f"{name}_low"], head[1 + 2 * k], head[2 + 2 * k])
        self.pair_codes = np.frombuffer(levels["pair_codes"], "<u2")
        self.pair_weights = np.frombuffer(levels["pair_weights"], "<u2")
        self.triple_codes = np.frombuffer(levels["triple_codes"], "<u2")

    @classmethod
    def build(cls, first: np.ndarray, total: np.ndarray, parent: np.ndarray, second: np.ndarray, c2: np.ndarray, grand: np.ndarray, third: np.ndarray,
              c3: np.ndarray, mu: float) -> Trie:
        """first: contexts, sorted; total: their counts; (parent, second): sorted pairs with counts c2, parent a place in first;
        (grand, third): sorted triples with counts c3, grand a place among the pairs."""
        bits = max(1, int(max(second.max(initial=0), third.max(initial=0))).bit_length())
        sequences = {"words": first, "pairs": parent << bits | second, "triples": grand << bits | third,
                     "pair_pointers": np.searchsorted(parent, np.arange(len(first) + 1)), "triple_pointers": np.searchsorted(grand, np.arange(len(second) + 1))}
        levels, head = {}, [bits]
        for name, values in sequences.items():
            levels[f"{name}_high"], levels[f"{name}_low"], low, n = EliasFano.encode(values.astype(np.int64))
            head += [low, n]
        levels["head"] = np.array(head, "<i8").tobytes()
        levels["pair_codes"] = quantise(c2 / (total[parent] + mu)).tobytes()
        levels["pair_weights"] = quantise(mu / (c2 + mu)).tobytes()
        levels["triple_codes"] = quantise(c3 / (c2[grand] + mu)).tobytes()
        return cls(levels)

    def _children(self, level: str, pointers: str, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places of (parent, word), or -1; the parent's pointers bound the search."""
        out = np.full(len(parent), -1, np.int64)
        known = np.flatnonzero(parent >= 0)
        own, which = _runs(parent[known])
        ends = np.unique(np.concatenate([own, own + 1]))               # neighbours share a pointer
        at = self.sequences[pointers].get(ends)
        begin, end = (at[np.searchsorted(ends, own + k)][which] for k in (0, 1))
        fits = (begin < end) & (word[known] < 1 << self.bits)
        known, begin, end = known[fits], begin[fits], end[fits]
        at = self.sequences[level].find(parent[known] << self.bits | word[known])
        out[known] = np.where((at >= begin) & (at < end), at, -1)
        return out

    def ask(self, first: np.ndarray, parent: np.ndarray, second: np.ndarray, grand: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes and weights of pairs (parent a place in first), codes of triples (grand a place among the pairs); 0 where there is none."""
        if not self.sequences["words"].n:
            return np.zeros(len(second), "<u2"), np.zeros(len(second), "<u2"), np.zeros(len(third), "<u2")
        pair = self._children("pairs", "pair_pointers", self.sequences["words"].find(first)[parent], second)
        triple = self._children("triples", "triple_pointers", pair[grand], third)
        pick = lambda codes, at: np.where(at >= 0, codes[np.maximum(at, 0)], 0).astype("<u2") if len(codes) else np.zeros(len(at), "<u2")
        return pick(self.pair_codes, pair), pick(self.pair_weights, pair), pick(self.triple_codes, triple)

    def save(self, path: str) -> None:
        """The levels one after another, behind a header of their names and sizes."""
        names = sorted(self.levels)
        with open(path, "wb") as f:
            head = ";".join(f"{k}:{len(self.levels[k])}" for k in names).encode()
            f.write(len(head).to_bytes(8, "little") + head)
            for k in names:
                f.write(self.levels[k])

    @classmethod
    def map_file(cls, path: str) -> Trie:
        """The levels as views of the memory-mapped file."""
        with open(path, "rb") as f:
            view = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        size = int.from_bytes(view[:8], "little")
        levels, at = {}, 8 + size
        for part in bytes(view[8:at]).decode().split(";"):
            name, n = part.split(":")
            levels[name], at = view[at:at + int(n)], at + int(n)
        return cls(levels)


# ---- 1. blocks ----

def _distinct(lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of lanes, and the place of each row among them."""
    _, first, which = np.unique(lanes[:, 0], return_index=True, return_inverse=True)
    if (lanes[first, 1][which] == lanes[:, 1]).all():
        return lanes[first], which
    whole, which = np.unique(lanes, axis=0, return_inverse=True)      # first lanes met by chance
    return whole, which.ravel()


def _block_batches(key: bytes, id_type: pa.DataType, block_tokens: int):
    """Blocks of texts: tokens as places in the block's own words, and the words' codes with their training counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, codes = TaskContext.get().partitionId() << 32, text.WordCodes(key, lower=True)
        ids, held, sizes, places, n = [], [], [], [], 0

        def flush():
            held_out, size, place = np.array(held, bool), np.concatenate(sizes), np.concatenate(places) + 1      # 0 is the end
            present = np.zeros(len(codes.number) + 1, np.int64)
            present[place] = 1
            own = np.flatnonzero(present)
            tokens = (np.cumsum(present) - 1)[place]
            words = np.concatenate([codes.one(_END), codes.lanes])[own]
            train = np.bincount(tokens[np.repeat(~held_out, size)], minlength=len(words))
            codes.forget()
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([held], pa.list_(pa.bool_())), pa.array([size], pa.list_(pa.int64())),
                 pa.array([_columns(tokens.astype("<u4"), 4)], pa.binary()), pa.array([words.tobytes()], pa.binary()), pa.array([varint(train)], pa.binary()),
                 pa.array([_buckets(words).tobytes()], pa.binary())],
                ["block", "ids", "held", "sizes", "tokens", "words", "counts", "buckets"])

        for batch in batches:
            for part in text.slices(batch, "text"):
                own, count = codes.numbers(part.column("text"))
                places.append(np.insert(own, np.cumsum(count), -1))
                ids += part.column("id").to_pylist()
                held += part.column("held").to_pylist()
                sizes.append(count + 1)
                n += len(places[-1])
                if n >= block_tokens:
                    yield flush()
                    number, ids, held, sizes, places, n = number + 1, [], [], [], [], 0
        if ids:
            yield flush()
    return run


def _buckets(words: np.ndarray) -> np.ndarray:
    """Two bytes of each code: all that a block needs of it to know the shard that answered."""
    return (words[:, 0] & np.uint64(0xFFFF)).astype("<u2")


def _columns(a: np.ndarray, width: int) -> bytes:
    """The bytes of the numbers, place by place: the high places are nearly all zero and compress."""
    return np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, width).T).tobytes()


def _from_columns(data: bytes, width: int, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


# ---- 2. words ----

def _word_batches(shards: int):
    """Each block's words by shard (of their code's first bits), in the block's own order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "counts"))):
                words, counts = np.frombuffer(words, "<u8").reshape(-1, 2), read_varint(counts)
                shard = _buckets(words).astype(np.int32) % shards
                own = np.unique(shard)
                parts = [(words[shard == s].tobytes(), varint(counts[shard == s])) for s in own]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([block] * len(own), pa.int64()), pa.array([w for w, _ in parts], pa.binary()),
                                                  pa.array([c for _, c in parts], pa.binary())], ["shard", "block", "words", "counts"])
    return run


def _numbered_words(shards: int, hot: float):
    """Numbers and training counts of one shard's words, for every block; words that no training text holds get 0.

    The first row of a shard also has its totals, and the words with at least ``hot`` tokens."""
    def run(entries: pa.Table) -> pa.Table:
        shard = entries["shard"][0].as_py()
        words = [np.frombuffer(w, "<u8").reshape(-1, 2) for w in entries["words"].to_pylist()]
        counts = [read_varint(c) for c in entries["counts"].to_pylist()]
        own, which = _distinct(np.concatenate(words))
        total = np.bincount(which, np.concatenate(counts), len(own)).astype(np.int64)
        known = total > 0
        number = np.where(known, FIRST_WORD + (np.cumsum(known) - 1) * shards + shard, 0)
        often = np.flatnonzero(total >= hot)
        hot_words = [number[often].tolist()] + [[]] * (len(words) - 1)
        hot_totals = [total[often].tolist()] + [[]] * (len(words) - 1)
        number, each = number[which], total[which]
        if number.max(initial=0) >= 1 << 32:
            raise OverflowError("more than 2^32 words")
        cuts = np.cumsum([len(w) for w in words])[:-1]
        once = np.zeros(len(words), np.int64)
        once[0] = 1                                        # the shard's totals stand in its first row
        return pa.table({"block": entries["block"], "shard": entries["shard"], "numbers": pa.array([_columns(x.astype("<u4"), 4) for x in np.split(number, cuts)], pa.binary()),
                         "totals": pa.array([varint(x) for x in np.split(each, cuts)], pa.binary()), "distinct": pa.array(once * int(known.sum())), "total": pa.array(once * int(total.sum())),
                         "hot": pa.array(hot_words, pa.list_(pa.int64())), "hot_n": pa.array(hot_totals, pa.list_(pa.int64()))})
    return run


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[dict]]]:
    """Rows sorted by block and kind: the row of kind 0 and the rows of kind 1 of every block."""
    head, rest = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 0:
                if head is not None:
                    yield head, rest
                head, rest = row, []
            else:
                rest.append(row)
    if head is not None:
        yield head, rest


def _resolved_batches(id_type: pa.DataType, shards: int):
    """Blocks with the numbers and training counts of their words in place of the codes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, answers in _grouped(batches):
            shard = np.frombuffer(block["buckets"], "<u2").astype(int) % shards
            numbers, totals = np.zeros(len(shard), np.int64), np.zeros(len(shard), np.int64)
            for a in answers:
                own = shard == a["shard"]
                numbers[own], totals[own] = _from_columns(a["numbers"], 4, "<u4"), read_varint(a["totals"])
            yield pa.RecordBatch.from_arrays(
                [pa.array([block["block"]], pa.int64()), pa.array([block["ids"]], pa.list_(id_type)), pa.array([block["held"]], pa.list_(pa.bool_())),
                 pa.array([block["sizes"]], pa.list_(pa.int64())), pa.array([block["tokens"]], pa.binary()), pa.array([_columns(numbers.astype("<u4"), 4)], pa.binary()),
                 pa.array([varint(totals)], pa.binary())], ["block", "ids", "held", "sizes", "tokens", "numbers", "totals"])
    return run


# ---- 3. n-grams ----

class Grams:
    """Distinct pairs and triples of known words of a block, by shard and in order: the same when asking and when answered."""

    def __init__(self, block: dict, shards: int, hot: np.ndarray):
        self.sizes = np.array(block["sizes"], np.int64)
        self.numbers, self.totals = _from_columns(block["numbers"], 4, "<u4").astype(np.int64), read_varint(block["totals"])
        self.tokens = _from_columns(block["tokens"], 4, "<u4").astype(np.int64)
        self.train = np.repeat(~np.array(block["held"], bool), self.sizes)
        word = self.numbers[self.tokens]
        begin = np.zeros(len(word), bool)
        begin[np.cumsum(self.sizes) - self.sizes] = True
        before = np.concatenate([[0], word[:-1]])
        before[begin] = BEGIN
        has2 = (word > 0) & (before > 0)
        self.at2 = np.flatnonzero(has2)                    # tokens with a pair
        pair = before[self.at2] << 32 | word[self.at2]
        own, which = np.unique(pair, return_inverse=True)
        first, second = (own >> 32).astype(np.uint64), (own & 0xFFFFFFFF).astype(np.uint64)
        shard = text.mix(first + np.isin(own >> 32, hot) * text.mix(second)) % np.uint64(shards)
        order = np.argsort(shard.astype(np.uint16 if shards <= 1 << 16 else np.uint64), kind="stable")     # pairs stay in order within a shard
        place = np.empty(len(own), np.int64)
        place[order] = np.arange(len(own))
        self.which2 = place[which]                         # number of a token's pair
        self.pair, self.shard = own[order], shard[order].astype(np.int64)
        # a triple's first pair is that of the token before, in the same text
        place2 = np.full(len(word), -1, np.int64)
        place2[self.at2] = self.which2
        self.context = np.concatenate([[-1], place2[:-1]])
        self.context[begin] = -1
        self.at3 = np.flatnonzero((self.context >= 0) & (word > 0))
        triple, self.which3 = np.unique(self.context[self.at3] << 32 | word[self.at3], return_inverse=True)
        self.grand, self.third = triple >> 32, triple & 0xFFFFFFFF
        self.cuts2 = np.searchsorted(self.shard, np.arange(shards + 1))
        self.cuts3 = np.searchsorted(self.grand, self.cuts2)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        return (np.bincount(self.which2[self.train[self.at2]], minlength=len(self.pair)), np.bincount(self.which3[self.train[self.at3]], minlength=len(self.grand)))


_GRAMS = ["first", "fan", "second", "c2", "fan3", "third", "c3"]


def _gram_batches(shards: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                g = Grams(row, shards, hot)
                c2, c3 = g.counts()
                out = []
                for s in range(shards):
                    a, b, e, f = g.cuts2[s], g.cuts2[s + 1], g.cuts3[s], g.cuts3[s + 1]
                    if a == b:
                        continue
                    first, fan = np.unique(g.pair[a:b] >> 32, return_counts=True)
                    out.append((s, varint(np.diff(first, prepend=0)), varint(fan), varint(gaps(g.pair[a:b] & 0xFFFFFFFF, g.pair[a:b] >> 32)), varint(c2[a:b]),
                                varint(np.bincount(g.grand[e:f] - a, minlength=b - a)), varint(gaps(g.third[e:f], g.grand[e:f])), varint(c3[e:f])))
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array([row["block"]] * len(out), pa.int64()),
                                                      *(pa.array(c, pa.binary()) for c in cols[1:])], ["shard", "block", *_GRAMS])
    return run


def _decoded(entry: dict) -> tuple[np.ndarray, ...]:
    """first, parent, second, c2, grand, third, c3 of one block's n-grams in a shard."""
    v = {c: read_varint(entry[c]) for c in _GRAMS}
    first = np.cumsum(v["first"])
    return (first, np.repeat(np.arange(len(first)), v["fan"]), ungap(v["second"], v["fan"]), v["c2"], np.repeat(np.arange(len(v["fan3"])), v["fan3"]),
            ungap(v["third"], v["fan3"]), v["c3"])


def distinct_grams(blocks: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Distinct pairs and triples (a place among the pairs, a word) of all blocks, sorted; their training counts; and the place of
    every block's pairs and triples, one block after another."""
    pairs = [f[p] << 32 | s for f, p, s, *_ in blocks]
    pair, which2 = np.unique(np.concatenate(pairs), return_inverse=True)
    cuts = np.cumsum([0, *(len(p) for p in pairs)])
    triples = [which2[a:b][g] << 32 | t for a, b, (*_, g, t, _c) in zip(cuts, cuts[1:], blocks)]
    triple, which3 = np.unique(np.concatenate(triples), return_inverse=True)
    c2, c3 = (np.bincount(at, np.concatenate([b[k] for b in blocks]), n).astype(np.int64) for at, k, n in ((which2, 3, len(pair)), (which3, 6, len(triple))))
    return pair, triple, c2, c3, which2, which3


def trained_grams(pair: np.ndarray, triple: np.ndarray, c2: np.ndarray, c3: np.ndarray) -> tuple[np.ndarray, ...]:
    """first, parent, second, c2, grand, third, c3 of the n-grams that training texts hold."""
    kept, some = np.cumsum(c2 > 0) - 1, c3 > 0
    first, parent = _runs(pair[c2 > 0] >> 32)
    return first, parent, pair[c2 > 0] & 0xFFFFFFFF, c2[c2 > 0], kept[triple[some] >> 32], triple[some] & 0xFFFFFFFF, c3[some]


def _answer_shard(mu: float, hot_total: dict[int, int], keep: bool):
    def run(entries: pa.Table) -> pa.Table:
        blocks = [_decoded(e) for e in entries.to_pylist()]
        pair, triple, n2, n3, which2, which3 = distinct_grams(blocks)
        first, parent, second, c2, grand, third, c3 = trained_grams(pair, triple, n2, n3)
        total = np.bincount(parent, c2, len(first)).astype(np.int64)
        for word, n in hot_total.items():                  # a hot word's successors are spread: its count is not the sum of those here
            total[first == word] = n
        trie = Trie.build(first, total, parent, second, c2, grand, third, c3, mu)
        # blocks share most of their n-grams: each is asked for once, in order, and every block gets its answers
        asked = trie.ask(*_runs(pair >> 32), pair & 0xFFFFFFFF, triple >> 32, triple & 0xFFFFFFFF)
        codes, weights, triples = (np.split(a[at], np.cumsum([len(b[k]) for b in blocks])[:-1]) for a, at, k in zip(asked, (which2, which2, which3), (3, 3, 6)))
        n = len(blocks)
        shard = entries["shard"]
        names = sorted(trie.levels) if keep else []
        level = pa.array([None] * n + names, pa.string())
        null = [None] * len(names)
        cols = {"block": pa.array(entries["block"].to_pylist() + null, pa.int64()), "shard": pa.array(shard.to_pylist() + [shard[0].as_py()] * len(names), pa.int32()),
                "level": level, "body": pa.array([None] * n + [bytes(trie.levels[k]) for k in names], pa.binary())}
        for name, x in (("codes", codes), ("weights", weights), ("triples", triples)):
            cols[name] = pa.array([_columns(a, 2) for a in x] + null, pa.binary())
        return pa.table(cols)
    return run


_ANSWERS = "block long, shard int, level string, body binary, codes binary, weights binary, triples binary"


# ---- 4. scores ----

def _score_batches(id_type: pa.DataType, shards: int, hot: np.ndarray, total: int, distinct: int, begins: int, mu: float):
    wide = total + ADD * (distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, answers in _grouped(batches):
            g = Grams(block, shards, hot)
            code2, weight2, code3 = np.zeros(len(g.pair), "<u2"), np.zeros(len(g.pair), "<u2"), np.zeros(len(g.grand), "<u2")
            for a in answers:
                s = a["shard"]
                for out, cuts, c in ((code2, g.cuts2, "codes"), (weight2, g.cuts2, "weights"), (code3, g.cuts3, "triples")):
                    out[cuts[s]:cuts[s + 1]] = _from_columns(a[c], 2, "<u2")
            base = np.log10((g.totals + ADD) / wide)
            plain = restore(quantise((g.totals + ADD) / wide))
            # order by order: the weight of the context for what is below, and the own share
            first = np.cumsum(g.sizes) - g.sizes
            n_before = np.concatenate([[0], g.totals[g.tokens][:-1]])
            n_before[first] = begins
            p = plain[g.tokens] * restore(quantise(mu / (n_before + mu)))
            p[g.at2] += restore(code2)[g.which2]
            weight = restore(weight2)
            later = np.flatnonzero(g.context >= 0)
            later = later[weight[g.context[later]] > 0]      # a pair that training has not seen passes everything on
            p[later] *= weight[g.context[later]]
            p[g.at3] += restore(code3)[g.which3]
            owner = np.repeat(np.arange(len(g.sizes)), g.sizes)
            add = lambda x: np.bincount(owner, x, len(g.sizes))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(block["ids"], id_type), pa.array(block["held"], pa.bool_()), pa.array(g.sizes), pa.array(add(g.totals[g.tokens] > 0).astype(np.int64)),
                                              pa.array(np.full(len(g.sizes), total, np.int64)), pa.array(add(base[g.tokens])), pa.array(add(np.log10(p)))],
                                             ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


_BLOCK = "block long, ids array<{id}>, held array<boolean>, sizes array<long>, tokens binary"


def _gathered(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Every block and what the shards answered to it, next to each other: kind 0, then kind 1 by shard."""
    both = blocks.withColumn("kind", F.lit(0)).unionByName(answers.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", "kind", "shard")


def train_and_score(docs: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text", mu: float = MU,
                    block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from the rows that are not held out."""
    return score(*train(docs, held_out, id_column, text_column, mu, block_tokens, shard_tokens, keep=False))


def train(docs: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text", mu: float = MU,
          block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, keep: bool = True) -> tuple[DataFrame, DataFrame, dict]:
    """Written blocks, written answers, with ``keep`` beside the encoded levels of all shards (``levels``), and what scoring needs besides."""
    id_type = docs.schema[id_column].dataType
    arrow_id, block_ddl = to_arrow_type(id_type), _BLOCK.format(id=id_type.simpleString())
    rows = docs.select(docs[id_column].alias("id"), held_out.alias("held"), docs[text_column].cast("string").alias("text"))
    blocks = frames.cut(rows.mapInArrow(_block_batches(os.urandom(16), arrow_id, block_tokens), f"{block_ddl}, words binary, counts binary, buckets binary"), "blocks")
    size = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"),
                      F.sum(F.size(F.filter("held", lambda h: ~h))).alias("texts")).first()
    n_tokens, texts = size.n or 0, size.texts or 0
    shards, hot_n = max(1, -(-n_tokens // shard_tokens)), max(1.0, n_tokens * HOT_SHARE)
    word_shards = min(shards, 1 << 16)

    words = blocks.select("block", "words", "counts").mapInArrow(_word_batches(word_shards), "shard int, block long, words binary, counts binary")
    numbered = frames.cut(words.groupBy("shard").applyInArrow(
        _numbered_words(word_shards, hot_n), "block long, shard int, numbers binary, totals binary, distinct long, total long, hot array<long>, hot_n array<long>"), "numbers")
    sums = numbered.agg(F.sum("total"), F.sum("distinct")).first()
    often = numbered.where(F.size("hot") > 0).select("hot", "hot_n").collect()              # at most 1 / HOT_SHARE words
    hot = {w: n for r in often for w, n in zip(r.hot, r.hot_n)} | ({BEGIN: texts} if texts >= hot_n else {})
    resolved = frames.cut(_gathered(blocks.drop("words", "counts"), numbered.select("block", "shard", "numbers", "totals")).mapInArrow(
        _resolved_batches(arrow_id, word_shards), f"{block_ddl}, numbers binary, totals binary"), "resolved")
    frames.drop(blocks, numbered)

    spread = np.array(sorted(hot), np.int64)
    grams = resolved.mapInArrow(_gram_batches(shards, spread), "shard int, block long, " + ", ".join(f"{c} binary" for c in _GRAMS))
    answers = frames.cut(grams.groupBy("shard").applyInArrow(_answer_shard(mu, hot, keep), _ANSWERS), "answers")
    return resolved, answers, {"id_type": id_type, "shards": shards, "hot": spread, "total": sums[0] or 0, "distinct": sums[1] or 0, "begins": texts, "mu": mu}


def levels(answers: DataFrame) -> DataFrame:
    """shard, level, body: the encoded model."""
    return answers.where("level is not null").select("shard", "level", "body")


def score(blocks: DataFrame, answers: DataFrame, model: dict) -> DataFrame:
    kind = model["id_type"]
    back = _gathered(blocks, answers.where("level is null").select("block", "shard", "codes", "weights", "triples"))
    run = _score_batches(to_arrow_type(kind), model["shards"], model["hot"], model["total"], model["distinct"], model["begins"], model["mu"])
    return back.mapInArrow(run, f"id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(doc_id: Column) -> Column:
    """Remainder by ten of the crc32 of the id as text is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def op9_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents")
    return train_and_score(docs, held_out(docs["doc_id"])).withColumnRenamed("id", "doc_id")
