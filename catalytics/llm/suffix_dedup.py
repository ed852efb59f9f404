"""Suffix-array dedup: repeated byte strings found by deep-shallow sorting of suffixes.

1. Texts.  Equal texts are one (named by SHA-256) with a number of copies; a text in two rows is
   repeated as a whole, and its copies are not looked at again.
2. Anchors.  Of the ``GRAM``-byte strings inside each window of ``min_bytes`` bytes the one with the
   smallest hash (leftmost on ties) is the window's anchor.  Equal windows have equal anchors at the
   same place.  A run of windows with one anchor is a piece: the bytes of all these windows.
   Pieces whose anchor occurs once are dropped; equal pieces are one, with their number.
3. Sparse suffix array.  Pieces of one anchor meet in a task.  The suffixes that start at the anchor
   are sorted, and so are the prefixes before it, read backwards: a multikey quicksort works down to
   ``SHALLOW`` bytes, and strings that agree so far go through a blind trie, which compares
   a new string with one leaf only.  The windows that reach o bytes before the anchor are equal where
   neighbours share ``min_bytes`` - o bytes after it and o before it; the classes change with o only
   at the values in the two lists of common-prefix lengths, and are counted once between them.
4. Large groups.  An anchor of more than ``GROUP`` different pieces is split: a piece's windows are
   cut into four ranges of o, and each range is dealt by all bytes that its windows have in common
   (64 bytes for all windows, 316, 379, 395, 399 and at last the whole window).  So no task
   holds more than ``GROUP`` pieces, and nothing is capped.
5. Removal.  Repeated starts go back to all texts that hold the piece and are merged there.

Windows are compared byte by byte, or by 128 bits of BLAKE2b where whole pieces are equal; the
64-bit hash of an anchor only decides who meets.

Results in special cases: a null or empty text, or one under ``min_bytes`` bytes, loses nothing;
repeated rows of ``min_bytes`` bytes or more lose all bytes; a removed run may end inside a
character; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalytics.llm import frames, text

MIN_BYTES = 400
GRAM = 64
SHALLOW = 96                         # bytes ordered by the multikey quicksort
STEP = 16                            # bytes it compares at a time
GROUP = 512                          # different pieces of an anchor in one task
_CHUNK = 1 << 20                     # windows hashed at a time
_PLACE = np.uint64((1 << 24) - 1)    # low bits of a hash replaced by its place in the chunk


# ---- anchors ----

def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive values, by doubling."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[span:], values[:-span])
        span *= 2
    return np.minimum(values[width - span:], values[:len(values) - (width - span)]) if span < width else values


def _runs(data: np.ndarray, offsets: np.ndarray, min_bytes: int, gram: int):
    """Anchor hash, anchor place, first and last window of every run of windows with one anchor, chunk by chunk."""
    for first in range(0, len(data) - min_bytes + 1, _CHUNK):
        part = data[first:first + _CHUNK + min_bytes - 1]
        windows = len(part) - min_bytes + 1
        edge = np.zeros(windows + 1, np.int32)
        lo, hi = np.maximum(offsets[:-1] - first, 0), np.minimum(offsets[1:] - min_bytes + 1 - first, windows)
        some = lo < hi
        np.add.at(edge, lo[some], 1)
        np.add.at(edge, hi[some], -1)
        inside = np.flatnonzero(np.cumsum(edge[:-1]))
        if not len(inside):
            continue
        grams = text.gram_hashes(text.byte_codes(part), gram)
        packed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        place = (_least(packed, min_bytes - gram + 1)[inside] & _PLACE).astype(np.int64)
        at = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(at[1:], len(inside)) - 1
        yield grams[place[at]].view(np.int64), place[at] + first, inside[at] + first, inside[last] + first


def _anchor_batches(min_bytes: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch, "text"):
                data, offsets = text.text_bytes(part.column("text"))
                for anchor, at, lo, hi in _runs(data, offsets, min_bytes, gram):
                    doc = np.searchsorted(offsets, lo, "right") - 1
                    begin = offsets[doc]
                    yield pa.RecordBatch.from_arrays(
                        [part.column("blob").take(pa.array(doc)), pa.array(anchor), *(pa.array((x - begin).astype(np.int32)) for x in (at, lo, hi))],
                        ["blob", "anchor", "at", "lo", "hi"])
    return run


def _piece_batches(min_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, body, seeds in zip(batch.column("blob"), batch.column("text"), batch.column("seeds")):
                whole, blob = body.as_py().encode(), blob.as_py()
                fields = [seeds.values.field(c).to_numpy() for c in ("anchor", "at", "lo", "hi")]
                for i in range(0, len(seeds), 4096):
                    anchor, at, lo, hi = (x[i:i + 4096] for x in fields)
                    pieces = [whole[a:b] for a, b in zip(lo.tolist(), (hi + min_bytes).tolist())]
                    place = at - lo
                    names = [hashlib.blake2b(p, digest_size=16, salt=k.to_bytes(8, "little")).digest() for p, k in zip(pieces, place.tolist())]
                    n = len(pieces)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([blob] * n, pa.binary()), pa.array([k.tobytes() for k in anchor], pa.binary()), pa.array(names, pa.binary()),
                         pa.array(pieces, pa.binary()), pa.array(place.astype(np.int32)), pa.array(lo.astype(np.int32))],
                        ["blob", "key", "piece", "body", "at", "lo"])
    return run


# ---- deep-shallow sorting ----

def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


def blind_trie_order(strings: list[bytes], items: list[int]) -> list[int]:
    """Items in the order of their strings: each is led down by single bytes and compared with the one leaf it meets."""
    def branch(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    root = [items[0]]                                     # a list of equal strings is a leaf; an inner node is (depth, children)
    for item in items[1:]:
        s, node = strings[item], root
        while isinstance(node, tuple):
            node = node[1].get(branch(s, node[0])) or next(iter(node[1].values()))
        other = strings[node[0]]
        shared = common_prefix(s, other)
        if shared == len(s) == len(other):
            node.append(item)
            continue
        above, node = None, root
        while isinstance(node, tuple) and node[0] < shared:
            above, node = node, node[1][branch(s, node[0])]
        if isinstance(node, tuple) and node[0] == shared:
            node[1][branch(s, shared)] = [item]
            continue
        fork = (shared, {branch(s, shared): [item], branch(other, shared): node})
        if above is None:
            root = fork
        else:
            above[1][branch(s, above[0])] = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        else:
            out += node
    return out


def deep_shallow_order(strings: list[bytes]) -> list[int]:
    """Numbers of the strings in sorted order."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        items, depth = stack.pop()
        if len(items) < 2:
            out += items
        elif depth >= SHALLOW:
            out += blind_trie_order(strings, items)
        else:
            words = [strings[i][depth:depth + STEP] for i in items]
            pivot = words[len(words) // 2]
            less = [i for i, w in zip(items, words) if w < pivot]
            same = [i for i, w in zip(items, words) if w == pivot]
            more = [i for i, w in zip(items, words) if w > pivot]
            stack.append((more, depth))
            stack.append((same, depth + STEP if len(pivot) == STEP else SHALLOW))
            stack.append((less, depth))
    return out


def _neighbours(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Sorted order, and the common prefix of each string with the one before it."""
    order = deep_shallow_order(strings)
    return order, [0, *(common_prefix(strings[i], strings[j]) for i, j in zip(order, order[1:]))]


def _class_of(order: list[int], shared: list[int], need: int) -> list[int]:
    """For every string the number of its class, where neighbours with ``need`` common bytes are in one."""
    out, number = [0] * len(order), 0
    for k, i in enumerate(order):
        number += k > 0 and shared[k] < need
        out[i] = number
    return out


def repeated_windows(pieces: list[tuple[bytes, int]], min_bytes: int) -> list[list[tuple[int, int]]]:
    """For pieces (bytes, place of the anchor) of one anchor: first and last start of the windows that another piece holds too."""
    after, before = [p[at:] for p, at in pieces], [p[:at][::-1] for p, at in pieces]
    (right, r_shared), (left, l_shared) = _neighbours(after), _neighbours(before)
    most_after, most_before = max(r_shared), max(l_shared)
    lowest, highest = max(min_bytes - most_after, 0), min(most_before, min_bytes - 1)
    out: list[list[tuple[int, int]]] = [[] for _ in pieces]
    if lowest > highest:
        return out
    turns = {lowest} | {min_bytes - v for v in r_shared} | {v + 1 for v in l_shared}
    turns = sorted(o for o in turns if lowest <= o <= highest) + [highest + 1]
    for o, stop in zip(turns, turns[1:]):
        both = list(zip(_class_of(right, r_shared, min_bytes - o), _class_of(left, l_shared, o)))
        number = Counter(both)
        for k, c in enumerate(both):
            if number[c] > 1:
                at = pieces[k][1]
                out[k].append((at - stop + 1, at - o))
    return out


def _sorted_groups(min_bytes: int):
    """Groups in rows sorted by key, one after the other; a group may go on in the next batch."""
    def answer(group: list) -> Iterator[tuple]:
        found = repeated_windows([(body, at) for _, _, body, at in group], min_bytes) if len(group) > 1 else []
        for (name, shift, _, _), spans in zip(group, found):
            for a, b in spans:
                yield name, shift + a, shift + b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "piece", "shift", "body", "at")]
            for k, *row in zip(*columns):
                if k != key:
                    out += answer(group)
                    key, group = k, []
                group.append(row)
            if out:
                yield _span_batch(out)
                out = []
        out += answer(group)
        if out:
            yield _span_batch(out)
    return run


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    name, first, last = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(name, pa.binary()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["piece", "first", "last"])


def _narrower(min_bytes: int, width: int):
    """Cut each piece's windows into four ranges of their distance to the anchor, keyed by what a range's windows share."""
    step = -(-width // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, name, shift, body, at, base in zip(*(batch.column(c).to_pylist() for c in ("key", "piece", "shift", "body", "at", "base"))):
                nearest, farthest = at - (len(body) - min_bytes), at
                for low in range(base, base + width, step):
                    high = min(low + step, base + width) - 1
                    near, far = max(low, nearest), min(high, farthest)
                    if near <= far:
                        core = body[at - low:at - high + min_bytes]
                        new = hashlib.blake2b(key + low.to_bytes(4, "little") + core, digest_size=16).digest()
                        out.append((new, name, shift + at - far, body[at - far:at - near + min_bytes], far, low))
            if out:
                cols = list(zip(*out))
                kinds = [pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["key", "piece", "shift", "body", "at", "base"])
    return run


# ---- operator ----

def repeated_pieces(shapes: DataFrame, min_bytes: int, gram: int, group: int) -> DataFrame:
    """piece, first, last: starts inside a piece of windows that other pieces hold, for rows key, piece, body, at."""
    row = "key binary, piece binary, shift int, body binary, at int, base int"
    width = min_bytes - gram + 1
    level = shapes.select("key", "piece", F.lit(0).alias("shift"), "body", "at", F.lit(0).alias("base"))
    found = None
    while True:
        sizes = frames.cut(level.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
        if width == 1:                                    # a range of one window is dealt by all its bytes: equal by its key
            part = level.join(sizes, "key").select("piece", F.col("shift").alias("first"), F.col("shift").alias("last"))
        else:
            meet = level.join(sizes.where(F.col("size") <= group).select("key"), "key").select("key", "piece", "shift", "body", "at")
            part = meet.repartition("key").sortWithinPartitions("key").mapInArrow(_sorted_groups(min_bytes), "piece binary, first int, last int")
        part = frames.cut(part, "windows")
        found = part if found is None else found.unionByName(part)
        large = sizes.where(F.col("size") > group).select("key")
        if width == 1 or large.isEmpty():
            return found
        level = frames.cut(level.join(large, "key").select("key", "piece", "shift", "body", "at", "base").mapInArrow(_narrower(min_bytes, width), row), "ranges")
        width = -(-width // 4)


def repeated_starts(texts: DataFrame, min_bytes: int = MIN_BYTES, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """blob, starts (array of first and last): windows that start anywhere else too, for different texts (blob, text)."""
    anchors = frames.cut(texts.mapInArrow(_anchor_batches(min_bytes, gram), "blob binary, anchor long, at int, lo int, hi int"), "anchors")
    # written, so that both sides of the join are plain exchanges, of which Spark splits the large partitions
    twice = frames.cut(anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "twice")
    seeds = anchors.join(twice, "anchor").groupBy("blob").agg(F.collect_list(F.struct("anchor", "at", "lo", "hi")).alias("seeds"))
    pieces = frames.cut(texts.join(seeds, "blob").select("blob", "text", "seeds").mapInArrow(
        _piece_batches(min_bytes), "blob binary, key binary, piece binary, body binary, at int, lo int"), "pieces")
    frames.drop(anchors, twice)
    shapes = frames.cut(pieces.groupBy("key", "piece").agg(F.first("body").alias("body"), F.first("at").alias("at"), F.count(F.lit(1)).alias("n")), "shapes")
    equal = shapes.where("n > 1").select("piece", F.lit(0).alias("first"), (F.length("body") - min_bytes).alias("last"))
    found = equal.unionByName(repeated_pieces(shapes, min_bytes, gram, group))
    held = pieces.select("blob", "piece", "lo").join(found, "piece")
    return held.groupBy("blob").agg(F.collect_list(F.struct((F.col("lo") + F.col("first")).alias("first"), (F.col("lo") + F.col("last")).alias("last"))).alias("starts"))


def _without(min_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, body, starts in zip(batch.column("blob"), batch.column("text"), batch.column("starts")):
                whole = body.as_py().encode()
                first, last = (starts.values.field(c).to_numpy().astype(np.int64) for c in ("first", "last"))
                order = np.argsort(first, kind="stable")
                begin, end = first[order], np.maximum.accumulate(last[order]) + min_bytes
                new = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
                begin, end = begin[new], end[np.append(new[1:], len(end)) - 1]
                edges = [0, *np.stack([begin, end], 1).ravel().tolist(), len(whole)]
                kept = b"".join(whole[a:b] for a, b in zip(edges[::2], edges[1::2]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([blob.as_py()], pa.binary()), pa.array([begin.tolist()], pa.list_(pa.int64())), pa.array([end.tolist()], pa.list_(pa.int64())),
                     pa.array([kept], pa.binary())], ["blob", "begins", "ends", "kept"])
    return run


def _blob(body):
    return F.unhex(F.sha2(F.coalesce(body.cast("string"), F.lit("")).cast("binary"), 256))


def removals(docs: DataFrame, text_column: str = "text", min_bytes: int = MIN_BYTES, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """blob, begins, ends, kept (bytes) for every different text that loses bytes and has one row."""
    body = docs[text_column].cast("string")
    long = docs.select(_blob(docs[text_column]).alias("blob"), body.alias("text")).where(F.octet_length("text") >= min_bytes)
    texts = frames.cut(long.groupBy("blob").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")), "texts")
    starts = frames.cut(repeated_starts(texts.select("blob", "text"), min_bytes, gram, group), "starts")
    once = texts.where("copies = 1").join(starts, "blob").select("blob", "text", "starts")
    return once.mapInArrow(_without(min_bytes), "blob binary, begins array<long>, ends array<long>, kept binary")


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_bytes: int = MIN_BYTES, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    found = removals(docs, text_column, min_bytes, gram, group)
    found = frames.cut(found.select("blob", (F.aggregate(F.zip_with("begins", "ends", lambda b, e: e - b), F.lit(0).cast("long"), lambda s, x: s + x)).alias("lost"),
                                    F.size("begins").cast("long").alias("spans"), F.sha2("kept", 256).alias("sha")), "removed")
    rows = docs.select(docs[id_column].alias("id"), _blob(docs[text_column]).alias("blob"),
                       F.coalesce(F.octet_length(docs[text_column].cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    copies = frames.cut(rows.groupBy("blob").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("blob", F.lit(True).alias("copied")), "copies")
    whole = F.col("copied").isNotNull() & (F.col("n_bytes") >= min_bytes)
    zero = F.lit(0).cast("long")
    out = rows.join(copies, "blob", "left").join(found, "blob", "left")
    return out.select("id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("lost", zero)).alias("n_removed"),
                      F.when(whole, zero + 1).otherwise(F.coalesce("spans", zero)).alias("n_spans"),
                      F.when(whole, F.sha2(F.lit(b""), 256)).otherwise(F.coalesce("sha", F.lower(F.hex("blob")))).alias("kept_sha256"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(frames.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
