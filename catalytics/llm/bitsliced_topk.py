"""Exact top-k search over a bit-sliced index.

Index.  Rows are dealt evenly into blocks of about ``BLOCK_ROWS``.  In a block every component,
quantised to floor(scale * x) and shifted to start at its smallest value, is stored as bit slices:
one bitmap over the block's rows per component and bit.

Search.  A query's score is a weighted sum of components; a negative weight uses the complemented
slices, so only additions remain.  Each set bit of each weight contributes a component's upper
slices (all but ``LOW_BITS``) at its binary place, and the bitmaps of a place are added with
carry-save adders (bitwise xor, and, or) until one sum slice per place is left.  The k-th largest
sum is found from the most significant slice downward.  What the omitted low slices can add is
bounded, so every row whose sum lies within that bound of the k-th largest is a boundary row; these
few are rebuilt from all their slices, scored exactly and ordered by score, then id.

Queries and blocks meet by an equi-join key: every block is read by ``ceil(queries /
QUERIES_PER_TASK)`` tasks, each holding one block and streaming its queries.

Special cases: rows with a null id or a null, empty or non-finite vector take no part; vectors of
other lengths than the longest are padded with zeros; components take as many slices as
they need, and a quantised component, or a score among the k best of a block, that does not fit a long raises an error; rows that share the query's id are its own and no candidates; repeated rows with
another id are candidates of their own; a repeated query row is searched once; a query id with several
different vectors is one query, and a candidate's score is the best over them; fewer candidates than k give them all; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalytics.llm import frames
from catalytics.llm.vectors import dense, usable

BLOCK_ROWS = 1 << 14
QUERIES_PER_TASK = 256
LOW_BITS = 3
_LIMIT = 2.0 ** 63


def _quantised(column: pa.Array, width: int, scale: float) -> np.ndarray:
    values = np.floor(dense(column, width) * scale)
    if not (np.abs(values) < _LIMIT).all():
        raise OverflowError("a quantised component does not fit a long")
    return values.astype(np.int64)


def _index_block(width: int, scale: float):
    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        values = _quantised(block.column("vector").chunk(0), width, scale)
        low = values.min(axis=0)
        values = values.view(np.uint64) - low.view(np.uint64)      # below 2^64
        bits = max(1, int(values.max()).bit_length())
        words = -(-len(values) // 64)
        slices = np.zeros((width, bits, words * 8), np.uint8)
        for b in range(bits):
            packed = np.packbits(((values >> np.uint64(b)) & np.uint64(1)).astype(np.uint8).T, axis=1, bitorder="little")
            slices[:, b, :packed.shape[1]] = packed
        ids = block.column("vec_id").to_numpy()
        return pa.table({"block": block.column("block").slice(0, 1), "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()),
                         "low": pa.array([low.tobytes()], pa.binary()), "bits": pa.array([bits], pa.int32()),
                         "slices": pa.array([slices.tobytes()], pa.binary())})
    return run


def build_index(rows: DataFrame, width: int, n_rows: int, scale: float = 1024.0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per block: block, ids, low, bits, slices.  ``rows`` has vec_id and vector, all usable."""
    n_blocks = max(1, -(-n_rows // block_rows))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_blocks)))
    return dealt.groupBy("block").applyInArrow(_index_block(width, scale), "block long, ids binary, low binary, bits int, slices binary")


class Block:
    """One block of the index in a task's memory."""

    def __init__(self, ids: bytes, low: bytes, bits: int, slices: bytes):
        self.ids, self.low, self.bits = np.frombuffer(ids, np.int64), np.frombuffer(low, np.int64), bits
        self.slices = np.frombuffer(slices, np.uint64).reshape(len(self.low), bits, -1)
        self.valid = np.zeros(self.slices.shape[2] * 64, np.uint8)
        self.valid[:len(self.ids)] = 1
        self.cut = min(LOW_BITS, bits - 1)
        upper = self.slices[:, self.cut:]
        self.signed = np.stack([upper, ~upper])            # a complement is the distance to the largest value

    def _sums(self, weights: np.ndarray) -> list[np.ndarray]:
        """Sum slices of |weight| times the upper slices (complemented for negative weights), least significant first."""
        size, negative = np.abs(weights), (weights < 0).astype(np.int64)
        places: dict[int, list[np.ndarray]] = {}
        for place in range(int(size.max()).bit_length()):
            at = np.flatnonzero((size >> place) & 1)
            for b in range(self.signed.shape[2]):
                places.setdefault(place + b, []).append(self.signed[negative[at], at, b])
        out, place, carried = [], 0, None
        while places or carried is not None:
            parts = places.pop(place, [])
            if carried is not None:
                parts.append(carried)
            stack, carries = np.concatenate(parts) if parts else self.signed[:0, 0, 0], []
            while len(stack) > 1:
                if len(stack) == 2:
                    a, b = stack[:1], stack[1:]
                    carries.append(a & b)
                    stack = a ^ b
                    break
                third = len(stack) // 3
                a, b, c = stack[:third], stack[third:2 * third], stack[2 * third:3 * third]
                half = a ^ b
                carries.append((a & b) | (half & c))
                stack = np.concatenate([half ^ c, stack[3 * third:]])
            out.append(stack[0] if len(stack) else np.zeros(self.signed.shape[3], np.uint64))
            carried = np.concatenate(carries) if carries else None
            place += 1
        return out

    def top(self, query_id: int, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the block and scores of the k best rows, best first."""
        valid = self.valid.copy()
        valid[:len(self.ids)] &= self.ids != query_id
        allowed = np.packbits(valid, bitorder="little").view(np.uint64)
        if not allowed.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not weights.any():
            rows = np.flatnonzero(valid)
        else:
            sums = self._sums(weights)
            above, level, kth = np.zeros_like(allowed), allowed, 0
            for place in range(len(sums) - 1, -1, -1):      # value of the k-th largest sum
                both = level & sums[place]
                if int(np.bitwise_count(above | both).sum()) >= k:
                    level, kth = both, kth | 1 << place
                else:
                    above, level = above | both, level & ~sums[place]
            slack = -(-sum(map(abs, weights.tolist())) * ((1 << self.cut) - 1) // (1 << self.cut))
            floor = max(0, kth - slack)                     # a lower sum cannot reach the k-th largest score
            above, level = np.zeros_like(allowed), allowed
            for place in range(len(sums) - 1, -1, -1):
                if floor >> place & 1:
                    level = level & sums[place]
                else:
                    above, level = above | (level & sums[place]), level & ~sums[place]
            rows = np.flatnonzero(np.unpackbits((above | level).view(np.uint8), bitorder="little"))
        picked = (self.slices[:, :, rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)
        values = (picked << np.arange(self.bits, dtype=np.uint64)[None, :, None]).sum(axis=1, dtype=np.uint64) + self.low.view(np.uint64)[:, None]
        values = values.view(np.int64)
        if np.abs(weights).astype(float) @ np.abs(values).max(axis=1).astype(float) < _LIMIT / 2:      # half for the rounding of the bound
            scores = weights @ values
            order = np.lexsort((self.ids[rows], -scores))[:k]
            return rows[order], scores[order]
        scores = (weights.astype(object) @ values.astype(object)).tolist()      # exact
        order = sorted(range(len(rows)), key=lambda r: (-scores[r], self.ids[rows[r]]))[:k]
        if any(not -1 << 63 <= scores[r] < 1 << 63 for r in order):
            raise OverflowError("a score does not fit a long")
        return rows[order], np.array([scores[r] for r in order], np.int64)


def _search_batches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            query, row, place, score = [], [], [], []
            for number, kind, key, ids, low, bits, body in zip(*(batch.column(c) for c in ("block", "kind", "key", "ids", "low", "bits", "body"))):
                if kind.as_py() == 0:
                    block = Block(ids.as_py(), low.as_py(), bits.as_py(), body.as_py())
                    continue
                found, scores = block.top(key.as_py(), np.frombuffer(body.as_py(), np.int64), k)
                query.append(np.full(len(found), key.as_py(), np.int64))
                row.append(block.ids[found])
                place.append(found | number.as_py() << 32)
                score.append(scores)
            empty = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([empty, *x])) for x in (query, row, place, score)],
                                             ["query_id", "vec_id", "place", "score"])
    return run


def _query_batches(width: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _quantised(batch.column("vector"), width, scale)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([v.tobytes() for v in values], pa.binary())], ["key", "body"])
    return run


def search(rows: DataFrame, queries: DataFrame, k: int, scale: float = 1024.0, block_rows: int = BLOCK_ROWS,
           queries_per_task: int = QUERIES_PER_TASK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of every query.  Both inputs have vec_id (long) and vector, all usable."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    queries = queries.select("vec_id", "vector").distinct()
    n_queries, named = queries.agg(F.count(F.lit(1)), F.count_distinct("vec_id")).first()
    schema = "query_id long, vec_id long, place long, score long"
    if not size.n or not n_queries:
        found = rows.sparkSession.createDataFrame([], schema)
    else:
        width, shares = int(size.width), -(-n_queries // queries_per_task)
        index = frames.cut(build_index(rows, width, size.n, scale, block_rows), "slices")
        blocks = index.select("block", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("kind"),
                              F.lit(None).cast("long").alias("key"), "ids", "low", "bits", F.col("slices").alias("body"))
        # a stated query set against all rows, in blocks: each query goes to every block, within its share
        n_blocks = max(1, -(-size.n // block_rows))
        asked = queries.select("vec_id", "vector").mapInArrow(_query_batches(width, scale), "key long, body binary")
        none = F.lit(None).cast("binary")
        asked = asked.withColumn("share", F.pmod(F.xxhash64("key"), F.lit(shares)).cast("int")).select(
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"), "share", F.lit(1).alias("kind"), "key",
            none.alias("ids"), none.alias("low"), F.lit(None).cast("int").alias("bits"), "body")
        asked = asked.join(index.select("block"), "block", "left_semi")
        met = blocks.union(asked).repartition("block", "share").sortWithinPartitions("block", "share", "kind")
        found = met.mapInArrow(_search_batches(k), schema)
        if named < n_queries:                               # several vectors of one id may have found the same row
            found = found.groupBy("query_id", "vec_id", "place").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def usable_rows(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    vec_id, vector = table[id_column], table[vector_column]
    return table.where(usable(vec_id, vector)).select(vec_id.cast("long").alias("vec_id"), vector.alias("vector"))


def divisible(column: Column, by: int) -> Column:
    return column % by == 0


def op4_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable_rows(frames.table(spark, sf_dir, "embeddings"))
    return search(rows, rows.where(divisible(F.col("vec_id"), 100)), k=10)
