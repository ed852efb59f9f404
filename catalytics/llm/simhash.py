"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints: one bit per position of the XXH64 hashes of a text's word shingles, set where more
than half the hashes have it.  Copies share a fingerprint, so the index holds distinct ones.

Index.  Two fingerprints within ``MAX_BITS`` = 2 bits agree on at least two of their four 16-bit
blocks, so each fingerprint goes to the six buckets of its block pairs.  A bucket above
``BUCKET_ROWS`` is dealt again, its remaining bits cut the same way, until a bucket's free bits
alone bound it (32, 16, then 8 bits: 256 distinct fingerprints at most): no bucket is ever large,
and no link is lost.  Inside a bucket the fingerprints are sorted by Gray rank, so neighbours in
the order differ in few bits; groups of consecutive ones become nodes that factor out the bits all
members share (mask and pattern), and groups of nodes become upper nodes.  Pairs of nodes are
walked from the top; the differences in newly shared bits are added up on the way down, and a
pair of groups is pruned as soon as they exceed the limit.  Leaves compare their members directly.
Each bucket returns a spanning forest of its links, at most one row per fingerprint.

Special cases: a null text counts as empty; without words the fingerprint is 0 and links like any
other; texts under the shingle length hash as one shingle; repeated rows share a fingerprint and
a component; null ids get the component's smallest non-null id (null if it has none); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalytics.llm import frames, text
from catalytics.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
BUCKET_ROWS = 4096
LEAF = 32               # fingerprints in a leaf of the index
FAN_OUT = 8             # nodes under an upper node
_PAIRS = list(combinations(range(4), 2))


def fingerprint(body: bytes, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    words = body.translate(text.LOWER_BYTES).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        spans = [(0, len(joined))]
    else:
        starts = list(accumulate((len(w) + 1 for w in words), initial=0))
        spans = list(zip(starts, [s - 1 for s in starts[shingle_words:]]))
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(spans), 1 << 14):
        part = np.array([digest(joined[s:e], seed) for s, e in spans[i:i + (1 << 14)]], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(spans), bitorder="little").view("<i8")[0])


def _fingerprint_batches(shingle_words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle_words, seed)
                      for x in batch.column("__text").cast(pa.large_string())]
            rest = [batch.column(c) for c in batch.schema.names if c != "__text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(prints, pa.int64())],
                                             [*(c for c in batch.schema.names if c != "__text"), "fp"])
    return run


def fingerprints(rows: DataFrame, text_column: Column, keep: dict[str, Column], shingle_words: int = SHINGLE_WORDS,
                 seed: int = SEED) -> DataFrame:
    """The kept columns and fp (long: the 64 bits) of every row."""
    chosen = rows.select(*(c.alias(n) for n, c in keep.items()), text_column.cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "__text")
    return chosen.mapInArrow(_fingerprint_batches(shingle_words, seed), f"{schema}, fp long")


# ---- buckets ----

def _deal(free: Column, bits: int) -> Column:
    """For each pair of the four blocks of the free bits: pair number, the pair's bits, the bits that stay free."""
    w = bits // 4
    block = [F.shiftrightunsigned(free, w * i).bitwiseAND(F.lit((1 << w) - 1)) for i in range(4)]
    join = lambda i, j: F.shiftleft(block[j], w).bitwiseOR(block[i])
    return F.array(*(F.struct(F.lit(k + 1).cast("long").alias("pair"), join(i, j).alias("kept"),
                              join(*(x for x in range(4) if x not in (i, j))).alias("free"))
                     for k, (i, j) in enumerate(_PAIRS)))


def _gray_rank(fp: Column) -> Column:
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def _buckets(prints: DataFrame, bucket_rows: int) -> DataFrame:
    """a, b (bucket), fp; no bucket has more than ``max(bucket_rows, 256)`` rows."""
    level = prints.select("fp", F.explode(_deal(F.col("fp"), 64)).alias("d")).select(
        F.shiftleft("d.pair", 32).bitwiseOR(F.col("d.kept")).alias("a"), F.lit(0).cast("long").alias("b"), "fp", F.col("d.free").alias("free"))
    done = None
    for bits in (32, 16):
        level = frames.cut(level, "buckets")
        large = frames.cut(level.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows).select("a", "b"), "large")
        fits = level.join(large, ["a", "b"], "left_anti").select("a", "b", "fp")
        done = fits if done is None else done.union(fits)
        level = level.join(large, ["a", "b"], "left_semi").select("a", "b", "fp", F.explode(_deal(F.col("free"), bits)).alias("d")).select(
            "a", F.shiftleft("b", 20).bitwiseOR(F.shiftleft("d.pair", bits // 2)).bitwiseOR(F.col("d.kept")).alias("b"), "fp", F.col("d.free").alias("free"))
    return done.union(level.select("a", "b", "fp"))


# ---- index of one bucket ----

def _close_pairs(x: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers i < j of all fingerprints of one bucket (in Gray order) within ``max_bits`` bits."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    pad = -len(x) % LEAF
    grid = np.concatenate([x, np.repeat(x[-1:], pad)]).reshape(-1, LEAF)
    low, high = np.bitwise_and.reduce(grid, 1), np.bitwise_or.reduce(grid, 1)
    levels = [(low, ~(low ^ high))]                                      # pattern and mask of each node
    while len(levels[-1][0]) > FAN_OUT:
        pattern, mask = levels[-1]
        pad = -len(pattern) % FAN_OUT
        pattern = np.concatenate([pattern, np.repeat(pattern[-1:], pad)]).reshape(-1, FAN_OUT)
        mask = np.concatenate([mask, np.repeat(mask[-1:], pad)]).reshape(-1, FAN_OUT)
        low, high = np.bitwise_and.reduce(pattern, 1), np.bitwise_or.reduce(pattern, 1)
        levels.append((low, np.bitwise_and.reduce(mask, 1) & ~(low ^ high)))
    i, j = np.triu_indices(len(levels[-1][0]))
    known, total = np.zeros(len(i), np.uint64), np.zeros(len(i), np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        pattern, mask = levels[depth]
        shared = mask[i] & mask[j]
        total = total + np.bitwise_count((pattern[i] ^ pattern[j]) & shared & ~known)   # only bits the parents did not fix
        keep = total <= max_bits
        i, j, known, total = i[keep], j[keep], shared[keep], total[keep]
        if depth:
            below, fan = len(levels[depth - 1][0]), np.arange(FAN_OUT)
            ci = (i[:, None, None] * FAN_OUT + fan[:, None]) + np.zeros((1, 1, FAN_OUT), np.int64)
            cj = (j[:, None, None] * FAN_OUT + fan[None, :]) + np.zeros((1, FAN_OUT, 1), np.int64)
            inside = (ci <= cj) & (ci < below) & (cj < below)
            known, total = (np.broadcast_to(a[:, None, None], ci.shape)[inside] for a in (known, total))
            i, j = ci[inside], cj[inside]
    left, right = [], []
    for k in range(0, len(i), 2048):
        a, b = grid[i[k:k + 2048]], grid[j[k:k + 2048]]
        near, r, c = np.nonzero(np.bitwise_count(a[:, :, None] ^ b[:, None, :]) <= max_bits)
        p, q = i[k:k + 2048][near] * LEAF + r, j[k:k + 2048][near] * LEAF + c
        ok = (p < q) & (q < len(x))
        left.append(p[ok])
        right.append(q[ok])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member number reachable from each member over the links."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, left, label[right])
        np.minimum.at(new, right, label[left])
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _link_batches(max_bits: int):
    def emit(a: np.ndarray, b: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0)) + 1
        bounds = np.concatenate([[0], cuts, [len(a)]])
        u, v = [], []
        sizes = np.diff(bounds)
        for k in np.flatnonzero(sizes > 1):
            x = fp[bounds[k]:bounds[k + 1]].view(np.uint64)
            if len(x) == 2:
                if int(x[0] ^ x[1]).bit_count() <= max_bits:
                    u.append(x[:1])
                    v.append(x[1:])
                continue
            left, right = _close_pairs(x, max_bits)
            if len(left):
                label = _forest(len(x), left, right)
                member = np.flatnonzero(label != np.arange(len(x)))
                u.append(x[label[member]])
                v.append(x[member])
        empty = np.zeros(0, np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([empty, *z]).view(np.int64)) for z in (u, v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            a, b, fp = (np.concatenate([r, batch.column(c).to_numpy()]) for r, c in zip(rest, ("a", "b", "fp")))
            if not len(a):
                continue
            last = int(np.flatnonzero((a != a[-1]) | (b != b[-1]))[-1]) + 1 if (a[0] != a[-1] or b[0] != b[-1]) else 0
            rest = [a[last:], b[last:], fp[last:]]
            if last:
                yield emit(a[:last], b[:last], fp[:last])
        if len(rest[0]):
            yield emit(*rest)
    return run


def links(prints: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """u, v: links between distinct fingerprints (column fp) that connect exactly what the links within ``max_bits`` connect."""
    if max_bits > 2:
        raise ValueError("four blocks and two kept guarantee distances up to 2")
    dealt = _buckets(prints, bucket_rows).repartition("a", "b").sortWithinPartitions("a", "b", _gray_rank(F.col("fp")))
    return dealt.mapInArrow(_link_batches(max_bits), "u long, v long")


def classes(prints: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """fp, label for every distinct fingerprint of ``prints``; fingerprints connected by links share a label."""
    found = components(links(prints, max_bits, bucket_rows))
    return prints.join(found, prints["fp"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("label"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents")
    rows = frames.cut(fingerprints(docs, docs["text"], {"doc_id": docs["doc_id"]}), "fingerprints")
    least = frames.cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    labels = frames.cut(classes(least.select("fp")), "labels")
    members = least.join(labels, "fp")
    first = members.groupBy("label").agg(F.min("least").alias("component_id"))
    by_print = members.join(first, "label").select("fp", "component_id")
    return rows.join(by_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
