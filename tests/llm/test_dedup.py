import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash

from catalytics.llm import components, simhash, substring_dedup
from samples import DOCS, frame, lower, special_rows, split, words


def brute_repeats(rows, width):
    count = collections.Counter()
    for _, text, *_ in rows:
        w = split(text)
        count.update(tuple(w[i:i + width]) for i in range(len(w) - width + 1))
    out = []
    for doc_id, text, *_ in rows:
        w = split(text)
        keep = [True] * len(w)
        for i in range(len(w) - width + 1):
            if count[tuple(w[i:i + width])] > 1:
                keep[i:i + width] = [False] * width
        kept = [x for x, k in zip(w, keep) if k]
        out.append((doc_id, len(w), len(w) - len(kept), b" ".join(kept).decode()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width", [35, 12])
def test_substring_dedup_equals_brute_force(spark, width):
    rng, pool = random.Random(4), [words(rng, k) for k, rng in enumerate([50, 70, 40, 33, 90])]
    rows = special_rows()
    for i in range(40):
        body = []
        for _ in range(rng.randint(1, 4)):
            body += words(rng.randint(0, 30), rng.random())
            passage = rng.choice(pool)
            a = rng.randint(0, 10)
            body += passage[a:a + rng.randint(20, 60)]
        rows.append((100 + i, " ".join(body), "en", "a", 0))
    df = frame(spark, rows, anchor=1, window=2, text_bytes="x").repartition(5)
    got = substring_dedup.remove_repeats(df, min_words=width, anchor_words=8)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_repeats(rows, width)


def thue_morse(n, a, b):
    out = a
    while len(out) < n:
        out = out + out.translate(str.maketrans(a + b, b + a))
    return out


def test_words_that_collide_under_powers_of_any_base_stay_apart(spark):
    """Two words of 1,024 letters whose hashes by powers of a base modulo 2^64 are equal for every base and byte table."""
    one, two = thue_morse(1024, "a", "b"), thue_morse(1024, "b", "a")
    tail = words(40, 3)
    rows = [(1, " ".join([one, *tail[:34]]), "en", "a", 1), (2, " ".join([two, *tail[:34]]), "en", "a", 1)]
    got = substring_dedup.remove_repeats(frame(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_repeats(rows, 35)


def test_substring_dedup_of_an_empty_table(spark):
    assert substring_dedup.remove_repeats(frame(spark, [])).collect() == []


def test_substring_query_digest(spark, tmp_path):
    rows = special_rows()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.op2_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == {(i, n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k in brute_repeats(rows, 35)}


def plain_fingerprint(text):
    w = lower(text).encode().split()
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes_of(prints, bits):
    prints = list(dict.fromkeys(prints))
    label = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= bits and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_simhash_query_equals_brute_force(spark, tmp_path):
    rng, rows = random.Random(9), special_rows()
    for k in range(6):
        body = words(120, 50 + k)
        for c in range(5):
            copy = list(body)
            copy[rng.randrange(120)] = "changed"
            rows.append((200 + 10 * k + c, " ".join(copy), "en", "a", 0))
    frame(spark, rows, fp=1, label="x", component="y").write.parquet(f"{tmp_path}/documents.parquet")
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    label = classes_of(prints, 2)
    least = collections.defaultdict(list)
    for (i, *_), p in zip(rows, prints):
        least[label[p]] += [i] if i is not None else []
    expected = sorted(((i, f"{p:016x}", min(least[label[p]], default=None)) for (i, *_), p in zip(rows, prints)), key=repr)
    assert sorted(map(tuple, simhash.op7_simhash(spark, str(tmp_path)).collect()), key=repr) == expected
    assert len({r[2] for r in expected}) < len({r[1] for r in expected})


@pytest.mark.parametrize("bucket_rows", [8, 4096])
def test_links_connect_dense_clusters(spark, bucket_rows):
    """Clusters around few centers, so that buckets are dealt again down to the last level when they may hold few rows."""
    rng, prints = np.random.default_rng(1), set()
    for center in rng.integers(0, 1 << 63, 4):
        for _ in range(150):
            x = int(center)
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(b)
            prints.add(x)
    prints |= set(rng.integers(0, 1 << 63, 300).tolist())
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    got = {r.fp: r.label for r in simhash.classes(df, bucket_rows=bucket_rows).collect()}
    label = classes_of(sorted(prints), 2)
    groups = lambda d, f: {frozenset(v) for v in _by(d, f).values()}
    assert groups(got, lambda k: k) == groups({signed(k): v for k, v in label.items()}, lambda k: k)


def _by(labels, name):
    out = collections.defaultdict(set)
    for k, v in labels.items():
        out[v].add(name(k))
    return out


def test_index_of_one_bucket_finds_every_close_pair():
    rng = np.random.default_rng(3)
    x = np.unique(rng.integers(0, 1 << 16, 700).astype(np.uint64))
    rank = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    x = x[np.argsort(rank)]
    left, right = simhash._close_pairs(x, 2)
    i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 2, 1))
    assert sorted(zip(left.tolist(), right.tolist())) == sorted(zip(i.tolist(), j.tolist()))


def test_simhash_of_an_empty_table(spark, tmp_path):
    frame(spark, [], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert simhash.op7_simhash(spark, str(tmp_path)).collect() == []


def test_components_of_a_long_path(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 103: 100}
