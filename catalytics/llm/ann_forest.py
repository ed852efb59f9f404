"""Approximate nearest neighbours: forests of random-projection trees, one shared priority queue, exact reranking.

Shares.  Distinct vectors are dealt once, by hash, into shares of about ``SHARE_ROWS``; a vector
carries the smallest ids of its copies, as many as a result can need.  Queries go to every share in
blocks, so a vector is shuffled once for each group of query blocks and a query once for each share.

Fit.  The task that holds a share grows ``TREES`` trees over all its rows: a node splits at the
median projection on the line between two random members, down to leaves of about ``LEAF_ROWS``
rows.  Largest inner product becomes nearest direction by one more component sqrt(max norm^2 -
norm^2), which is 0 for queries; for unit vectors it vanishes.

Search.  A query keeps one queue over the nodes of all trees of a share, ordered by the smallest
margin on the way down, and pops leaves until they hold ``SEARCH`` of the forest's entries.  Leaves
of several trees that hold one row unite: a pair of query and row has one place in the block's score
table.  The best rows of a share are scored again on the original vectors in double precision, in
one order of summation; ties go to the smaller id.

Special cases: rows with a null id or a null, empty, zero or non-finite vector take no part; other
lengths than the longest are padded with zeros; the query's own id is no candidate, an equal vector
under another id is; repeated rows count once; an id with several vectors counts, as query and as
candidate, with the largest product of any of them; fewer candidates than k give them all that were
found; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalytics.llm import frames
from catalytics.llm.vectors import dense, usable

TREES = 8
LEAF_ROWS = 128
SEARCH = 0.16            # share of a forest's entries that a query's leaves hold
SHARE_ROWS = 1 << 13     # distinct vectors of a share
BLOCK_QUERIES = 256      # of a block: its score table has BLOCK_QUERIES x SHARE_ROWS places (16 MB)


class Forest:
    """Trees as arrays: inner node i has children 2i + 1 and 2i + 2; the last level are the leaves."""

    def __init__(self, sample: np.ndarray, trees: int, leaf_rows: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(sample)) / leaf_rows))))
        inner = (1 << self.depth) - 1
        self.normals = np.zeros((trees, inner, sample.shape[1]), np.float32)
        self.cuts = np.zeros((trees, inner), np.float32)
        self.sizes = np.zeros((trees, 1 << self.depth), np.int64)
        for t in range(trees):
            node = np.zeros(len(sample), np.int64)
            for i in range(inner):
                own = np.flatnonzero(node == i)
                if len(own) > 1:
                    a, b = rng.choice(own, 2, replace=False)
                    line = sample[a] - sample[b]
                else:
                    line = rng.standard_normal(sample.shape[1])
                line = line / (np.linalg.norm(line) or 1.0)
                along = sample[own] @ line
                self.normals[t, i], self.cuts[t, i] = line, np.median(along) if len(own) else 0.0
                node[own] = 2 * i + 1 + (along > self.cuts[t, i])
            self.sizes[t] = np.bincount(node - inner, minlength=1 << self.depth)

    def leaves(self, rows: np.ndarray, tree: int) -> np.ndarray:
        node = np.zeros(len(rows), np.int64)
        for _ in range(self.depth):
            along = np.einsum("ij,ij->i", rows, self.normals[tree, node])
            node = 2 * node + 1 + (along > self.cuts[tree, node])
        return node - ((1 << self.depth) - 1)

    def probe(self, queries: np.ndarray, search: float) -> list[list[tuple[int, int]]]:
        """For each query (tree, leaf) in the order in which its shared queue gives them, until their sizes reach the share."""
        inner, wanted = (1 << self.depth) - 1, search * self.sizes.sum()
        sizes = self.sizes.tolist()
        trees = len(sizes)
        margins = (queries @ self.normals.reshape(trees * inner, -1).T - self.cuts.ravel()).tolist() if inner else [[]] * len(queries)
        out = []
        for own in margins:
            queue, found, held = [(-np.inf, t, 0) for t in range(trees)], [], 0
            while queue and (held < wanted or not found):
                priority, t, i = heapq.heappop(queue)
                while i < inner:                          # down the nearer side; the other one waits in the queue
                    m = own[t * inner + i]
                    near, far = (2 * i + 2, 2 * i + 1) if m > 0 else (2 * i + 1, 2 * i + 2)
                    heapq.heappush(queue, (max(priority, abs(m)), t, far))
                    i = near
                found.append((t, i - inner))
                held += sizes[t][i - inner]
            out.append(found)
        return out


def _lifted(rows: np.ndarray, top: float) -> np.ndarray:
    """One more component, so that the largest inner product is the nearest direction."""
    rest = np.sqrt(np.maximum(top - (rows * rows).sum(axis=1), 0.0))
    return np.concatenate([rows, rest[:, None]], axis=1).astype(np.float32)


_MET = "place int, kind int, ids binary, body binary"


def _met(places: list[int], kind: int, ids: list[bytes], bodies: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array([kind] * len(places), pa.int32()), pa.array(ids, pa.binary()), pa.array(bodies, pa.binary())],
                                      ["place", "kind", "ids", "body"])


def _share_batches(width: int, groups: int):
    """Vectors packed by share, once for each group of query blocks: numbers of ids, then the ids; the vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            rows, names, share = dense(batch.column("vector"), width), batch.column("ids"), batch.column("share").to_numpy()
            edges, flat = names.offsets.to_numpy(), names.values.to_numpy()
            places, ids, bodies = [], [], []
            for s in np.unique(share):
                own = np.flatnonzero(share == s)
                packed = np.concatenate([edges[own + 1] - edges[own], *(flat[edges[i]:edges[i + 1]] for i in own)]).astype(np.int64).tobytes()
                places += [int(s) * groups + g for g in range(groups)]
                ids += [packed] * groups
                bodies += [rows[own].tobytes()] * groups
            yield _met(places, 0, ids, bodies)
    return run


def _query_batches(width: int, shares: int, groups: int):
    """Blocks of queries, once for each share; blocks go round the groups."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        for batch in batches:
            rows, ids = dense(batch.column("vector"), width), batch.column("vec_id").to_numpy()
            for at in range(0, len(ids), BLOCK_QUERIES):
                places = [s * groups + number % groups for s in range(shares)]
                yield _met(places, 1, [ids[at:at + BLOCK_QUERIES].tobytes()] * shares, [rows[at:at + BLOCK_QUERIES].tobytes()] * shares)
                number += 1
    return run


def _ranked(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best ids, every id once with its largest score, ties to the smaller id."""
    order = np.lexsort((-score, ids, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.append(True, (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])) if len(query) else np.zeros(0, bool)
    query, ids, score = query[first], ids[first], score[first]
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], ids[keep], score[keep]


class Share:
    """The vectors of one share, the ids of each, and their forest."""

    def __init__(self, packed: list[tuple[np.ndarray, np.ndarray]], top: float, trees: int, leaf_rows: int):
        self.rows = np.concatenate([r for _, r in packed])
        self.n_ids = np.concatenate([i[:len(r)] for i, r in packed])
        self.ids = np.concatenate([i[len(r):] for i, r in packed])
        order = np.lexsort(self.rows.T)                   # the forest does not depend on how rows arrive
        begin = np.cumsum(self.n_ids) - self.n_ids
        self.ids = self.ids[_ranges(begin[order], self.n_ids[order])]
        self.rows, self.n_ids = self.rows[order], self.n_ids[order]
        self.begin = np.cumsum(self.n_ids) - self.n_ids
        lifted = _lifted(self.rows, top)
        self.forest = Forest(lifted, trees, leaf_rows)
        self.members = []
        for t in range(trees):
            leaf = self.forest.leaves(lifted, t)
            by_leaf = np.argsort(leaf, kind="stable")
            self.members.append(np.split(by_leaf, np.searchsorted(leaf[by_leaf], np.arange(1, 1 << self.forest.depth))))
        self.longest = np.linalg.norm(self.rows, axis=1).max()

    def scores(self, queries: np.ndarray, search: float) -> np.ndarray:
        """Queries x rows: the product where a popped leaf holds the row, else minus infinity."""
        asked: dict[tuple[int, int], list[int]] = {}
        lifted = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        for q, leaves in enumerate(self.forest.probe(lifted, search)):
            for leaf in leaves:
                asked.setdefault(leaf, []).append(q)
        table = np.full((len(queries), len(self.rows)), -np.inf)
        for (t, leaf), own in asked.items():
            member = self.members[t][leaf]
            if len(member):
                table[np.ix_(own, member)] = queries[own] @ self.rows[member].T
        return table

    def _exact(self, queries: np.ndarray, names: np.ndarray, q: np.ndarray, r: np.ndarray, k: int):
        score = np.empty(len(q))
        for b in range(0, len(q), 1 << 14):
            score[b:b + (1 << 14)] = (self.rows[r[b:b + (1 << 14)]] * queries[q[b:b + (1 << 14)]]).sum(axis=1)      # one order of summation for all
        n = self.n_ids[r]
        query, ids, score = np.repeat(q, n), self.ids[_ranges(self.begin[r], n)], np.repeat(score, n)
        other = ids != names[query]
        return _ranked(query[other], ids[other], score[other], k)

    def best(self, queries: np.ndarray, names: np.ndarray, k: int, search: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query places, ids and exact scores of each query's k best ids found."""
        near = self.scores(queries, search)
        found = near > -np.inf
        n = min(k + 1, near.shape[1])
        kth = np.partition(near, near.shape[1] - n, axis=1)[:, near.shape[1] - n]
        # twice what two scores, each summed in another order, may lie off the true products
        slack = 4 * self.rows.shape[1] * np.finfo(float).eps * np.linalg.norm(queries, axis=1) * self.longest
        out = self._exact(queries, names, *np.nonzero(found & (near >= (kth - slack)[:, None])), k)
        # where ids name several vectors, k + 1 vectors may be fewer than k ids: those queries look at all they found
        few = np.flatnonzero((np.bincount(out[0], minlength=len(queries)) < k) & (found.sum(axis=1) > n))
        if len(few):
            q, r = np.nonzero(found[few])
            more = self._exact(queries, names, few[q], r, k)
            keep = ~np.isin(out[0], few)
            out = tuple(np.concatenate([a[keep], b]) for a, b in zip(out, more))
        return out


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, .. of every range, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _search_batches(k: int, width: int, top: float, trees: int, leaf_rows: int, search: float):
    """Rows sorted by place and kind: a share's vectors, then the query blocks that meet them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, packed, share = None, [], None
        for batch in batches:
            for here, kind, ids, body in zip(*(batch.column(c).to_pylist() for c in ("place", "kind", "ids", "body"))):
                if here != place:
                    place, packed, share = here, [], None
                ids, values = np.frombuffer(ids, np.int64), np.frombuffer(body, np.float64).reshape(-1, width)
                if kind == 0:
                    packed.append((ids, values))
                elif packed:
                    share = share or Share(packed, top, trees, leaf_rows)
                    q, found, exact = share.best(values, ids, k, search)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(found), pa.array(exact)], ["query_id", "vec_id", "score"])
    return run


def search(rows: DataFrame, queries: DataFrame, k: int, trees: int = TREES, share: float = SEARCH, share_rows: int = SHARE_ROWS,
           leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found per query.  Both inputs have vec_id (long) and vector, all usable."""
    spark = rows.sparkSession
    copies = Window.partitionBy("vector").orderBy("vec_id")
    # the smallest k + 1 ids of each distinct vector: one may be the query's own
    few = rows.distinct().withColumn("__r", F.row_number().over(copies)).where(F.col("__r") <= k + 1)
    distinct = frames.cut(few.groupBy("vector").agg(F.collect_list("vec_id").alias("ids")), "vectors")
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    size = distinct.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width"), F.max(norm).alias("top")).first()
    if not size.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, top, shares = int(size.width), float(size.top), max(1, -(-size.n // share_rows))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, parts // shares)                      # few shares: their query blocks are dealt over as many tasks as there are
    placed = distinct.withColumn("share", F.pmod(F.xxhash64("vector"), F.lit(shares)).cast("int")).mapInArrow(_share_batches(width, groups), _MET)
    asked = queries.select("vec_id", "vector").distinct().mapInArrow(_query_batches(width, shares, groups), _MET)
    met = placed.union(asked).withColumn("part", F.col("place") % parts).repartitionById(parts, "part").drop("part").sortWithinPartitions("place", "kind")
    found = met.mapInArrow(_search_batches(k, width, top, trees, leaf_rows, share), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def usable_rows(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    vec_id, vector = table[id_column], table[vector_column]
    return table.where(usable(vec_id, vector) & F.exists(vector, lambda x: x != 0)).select(vec_id.cast("long").alias("vec_id"), vector.alias("vector"))


def op8_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable_rows(frames.table(spark, sf_dir, "embeddings"))
    return search(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)
