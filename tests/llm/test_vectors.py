import numpy as np
import pytest

from catalytics.llm import ann_forest, bitsliced_topk

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n=1500, width=16, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, width)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[700:760] = v[100]                                       # many copies of one vector
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    rows += [(None, v[0].tolist(), 0), (9000, None, 0), (9100, [float("nan")] * width, None), (9200, [float("inf")] * width, 0),
             (9300, [None] * width, 0), (9400, [], 0)]
    return rows


def write(spark, rows, path, **extra):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, VECTORS)
    df.withColumns({k: F.lit(v) for k, v in extra.items()}).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def usable(rows, zero=True):
    return [(i, np.array(v, np.float64)) for i, v, _ in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))]


def test_topk_query_equals_brute_force(spark, tmp_path):
    rows = vectors() + [(9500, [0.0] * 16, 1), (9600, [0.5] * 16, 1)]
    got = sorted(map(tuple, bitsliced_topk.op4_bitsliced_topk(spark, write(spark, rows, tmp_path, block=1, score="x")).collect()))
    fine = usable(rows)
    q = [(i, np.floor(1024 * v).astype(int)) for i, v in fine]
    expected = []
    for i, a in q:
        if i % 100 == 0:
            best = sorted(((-int(a @ b), j) for j, b in q if j != i))[:10]
            expected += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(expected)


@pytest.mark.parametrize("block_rows, queries_per_task", [(64, 3), (1 << 14, 256)])
def test_topk_over_blocks_and_shares(spark, block_rows, queries_per_task):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-3, 4, 5) / 2).tolist(), 0) for i in range(300)]     # many equal scores
    df = bitsliced_topk.usable_rows(spark.createDataFrame(rows, VECTORS)).repartition(3)
    got = bitsliced_topk.search(df, df.where("vec_id % 10 = 0"), 7, 2.0, block_rows, queries_per_task).collect()
    q = {i: np.floor(2 * np.array(v)).astype(int) for i, v, _ in rows}
    for i in range(0, 300, 10):
        best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i)[:7]
        assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == i) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]


@pytest.mark.parametrize("block_rows", [64, 1 << 14])
def test_topk_of_repeated_query_rows(spark, block_rows):
    """A repeated query row is searched once; several vectors of one query id give each candidate row its best score."""
    rng = np.random.default_rng(6)
    rows = [(i, (rng.integers(-9, 10, 5) / 2).tolist(), 0) for i in range(300)]
    rows += rows[:1] + rows[10:11] * 9 + [(20, [4.0, -3.0, 2.0, 0.5, 1.0], 0), (20, [-4.0, 3.0, 2.0, 0.5, 1.0], 0)]
    df = bitsliced_topk.usable_rows(spark.createDataFrame(rows, VECTORS)).repartition(3)
    got = bitsliced_topk.search(df, df.where("vec_id % 10 = 0"), 10, 2.0, block_rows, 7).collect()
    q = [(i, np.floor(2 * np.array(v)).astype(int)) for i, v, _ in rows]
    for i in range(0, 300, 10):
        best = sorted((-max(int(a @ b) for n, a in q if n == i), j) for j, b in q if j != i)[:10]
        assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == i) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]


@pytest.mark.parametrize("size", [1e5, 1e6])
def test_topk_of_large_components(spark, size):
    """Components far beyond 2^24 after quantisation keep their values."""
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=5) * size).tolist(), 0) for i in range(200)] + [(300, [3e12, 0.0, 0.0, 0.0, 0.0], 0), (301, [-3e12, 1.0, 0.0, 0.0, 0.0], 0)]
    rows = [(i, np.array(v, np.float32).tolist(), 0) for i, v, _ in rows]
    df = bitsliced_topk.usable_rows(spark.createDataFrame(rows, VECTORS))
    q = [(i, [int(x) for x in np.floor(1024 * np.array(v))]) for i, v, _ in rows]
    asked = df.where("vec_id % 10 = 0 and vec_id < 300")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    fits = [(i, a) for i, a in q if i < 300]
    got = bitsliced_topk.search(df.where("vec_id < 300"), asked, 7, block_rows=64).collect()
    for i, a in fits[::10]:
        best = sorted((-dot(a, b), j) for j, b in fits if j != i)[:7]
        assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == i) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    with pytest.raises(Exception, match="fit a long"):
        bitsliced_topk.search(df, asked, 7).collect()


def test_block_scores_up_to_a_long():
    import pyarrow as pa
    values = [[2.0 ** 62, -(2.0 ** 62)], [-(2.0 ** 62), 2.0 ** 62], [2.0 ** 62, 0.0], [5.0, 7.0]]
    table = pa.table({"block": [0] * 4, "vec_id": [4, 3, 2, 1], "vector": pa.array(values, pa.list_(pa.float64()))})
    row = bitsliced_topk._index_block(2, 1.0)(table)
    block = bitsliced_topk.Block(*(row.column(c)[0].as_py() for c in ("ids", "low", "bits", "slices")))
    found, scores = block.top(9, np.array([1, 1], np.int64), 4)
    assert block.ids[found].tolist() == [2, 1, 3, 4] and scores.tolist() == [2 ** 62, 12, 0, 0]
    with pytest.raises(OverflowError):
        block.top(9, np.array([3, 1], np.int64), 4)


def test_topk_of_few_rows_and_of_an_empty_table(spark, tmp_path):
    assert bitsliced_topk.op4_bitsliced_topk(spark, write(spark, [], tmp_path / "a")).collect() == []
    got = bitsliced_topk.op4_bitsliced_topk(spark, write(spark, [(0, [1.0, 2.0], 0), (1, [1.0], 0)], tmp_path / "b")).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 1024 * 1024)]
    assert bitsliced_topk.op4_bitsliced_topk(spark, write(spark, [(0, [1.0], 0)], tmp_path / "c")).collect() == []


def test_forest_query_recall_and_exact_scores(spark, tmp_path):
    rows = vectors() + [(9500, [0.0] * 16, 1), (9600, (2 * np.array(vectors()[5][1])).tolist(), 1)]
    got = {}
    for r in ann_forest.op8_ann_forest(spark, write(spark, rows, tmp_path, tree=1, rep="x")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    fine = dict(usable(rows, zero=False))
    hit = 0
    queries = [i for i in fine if i % 20 == 0]
    assert sorted(got) == sorted(queries)
    for i in queries:
        best = sorted((-float(fine[i] @ fine[j]), j) for j in fine if j != i)[:20]
        mine = sorted(got[i])
        assert [r for r, *_ in mine] == list(range(1, 21)) and i not in [j for _, j, _ in mine]
        assert all(abs(s - float(fine[i] @ fine[j])) < 1e-12 for _, j, s in mine)
        assert [j for _, j, _ in mine] == [j for _, j in sorted((-s, j) for _, j, s in mine)]
        hit += len({j for _, j in best} & {j for _, j, _ in mine})
    assert hit / (20 * len(queries)) >= 0.9
    # the copies of one vector: ties to the smaller ids
    assert [j for _, j, _ in sorted(got[100])] == list(range(700, 720))


def test_forest_ties_of_distinct_vectors_go_to_the_smaller_ids(spark):
    """Binary vectors: many equal products at the cut of a leaf; every leaf is searched, so the result is the brute force one."""
    rng = np.random.default_rng(12)
    rows = [(i, (rng.permutation(12) < 5).astype(float).tolist(), 0) for i in rng.permutation(600).tolist()]
    df = ann_forest.usable_rows(spark.createDataFrame(rows, VECTORS))
    got = ann_forest.search(df, df.where("vec_id % 20 = 0"), 10, trees=2, share=1.0, leaf_rows=64).collect()
    v = {i: np.array(x) for i, x, _ in rows}
    for i in range(0, 600, 20):
        best = sorted((-float(v[i] @ v[j]), j) for j in v if j != i)[:10]
        assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == i) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]


@pytest.mark.parametrize("share_rows", [50, 10_000])
def test_forest_ids_with_several_vectors_count_once_with_the_best(spark, share_rows):
    rng = np.random.default_rng(8)
    rows = [(i % 90, np.round(rng.normal(size=6), 2).tolist(), 0) for i in range(400)] + [(7, [3.0, 0, 0, 0, 0, 0], 0)] * 30 + [(200, [3.0, 0, 0, 0, 0, 0], 0)]
    df = ann_forest.usable_rows(spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v, _ in rows], VECTORS)).repartition(4)
    got = ann_forest.search(df, df.where("vec_id % 20 = 0"), 10, trees=3, share=1.0, share_rows=share_rows, leaf_rows=16).collect()
    v = [(i, np.array(x, float)) for i, x, _ in rows]
    for i in sorted({n for n, _ in v if n % 20 == 0}):
        best = {j: max(float((a * b).sum()) for n, a in v if n == i for m, b in v if m == j) for j, _ in v if j != i}
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == i)
        want = sorted((-s, j) for j, s in best.items())[:10]
        assert [j for _, j, _ in mine] == [j for _, j in want] and np.allclose([s for *_, s in mine], [-s for s, _ in want], atol=1e-12)


@pytest.mark.parametrize("n, least, most", [(2_000, 0.9, 0.8), (40_000, 0.9, 0.8)])
def test_forest_scores_fewer_pairs_than_all_at_the_wanted_recall(n, least, most):
    """Isotropic vectors of 64 components, the hardest for such trees, in shares as the job makes them: recall, and pairs scored per pair."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64)).astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    queries, shares = x[:: n // 40][:40], max(1, -(-n // ann_forest.SHARE_ROWS))
    pairs, found = 0, []
    for s in range(shares):
        own = np.arange(s, n, shares)
        share = ann_forest.Share([(np.concatenate([np.ones(len(own), int), own]), x[own])], 1.0, ann_forest.TREES, ann_forest.LEAF_ROWS)
        pairs += int((share.scores(queries, ann_forest.SEARCH) > -np.inf).sum())
        found.append(share.best(queries, np.full(len(queries), -1), 20, ann_forest.SEARCH))
    q, ids, _ = ann_forest._ranked(*(np.concatenate(c) for c in zip(*found)), 20)
    near = queries @ x.T
    hit = sum(len(set(np.argsort(-near[k])[:20]) & set(ids[q == k])) for k in range(len(queries)))
    assert hit / (20 * len(queries)) >= least and pairs / (len(queries) * n) <= most


def test_forest_of_few_rows_and_of_an_empty_table(spark, tmp_path):
    assert ann_forest.op8_ann_forest(spark, write(spark, [], tmp_path / "a")).collect() == []
    got = ann_forest.op8_ann_forest(spark, write(spark, [(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (1, [0.5, 0.5], 0)], tmp_path / "b")).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 0.5)]
