import collections
import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from catalytics.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            order = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own[conv].append(((turn is not None, turn or 0, role, order), (role, text)))
    turns = {c: [t for _, t in sorted(x, key=lambda p: p[0])] for c, x in own.items()}
    paths = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(turns.get(c - int(math.fmod(c, 100)), [])[:h] + mine[h:])
    nodes = collections.defaultdict(set)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes[path[:d]].add(c)
    children = collections.Counter(p[:-1] for p in nodes if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, held in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(held) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, held in nodes.items():
        ends = ",".join(str(c) for c in sorted(held) if len(paths[c]) == len(p))
        out.append((min(held), len(p), min(nodes[p[:-1]]) if p else None, len(held), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed=1, n=260):
    rng = random.Random(seed)
    texts = ["hi", "", "ünï 😀", "how are you", "same", "x" * 50]
    rows = [(c, k, rng.choice(["user", "bot"]), rng.choice(texts)) for c in range(n) if c % 100 or rng.random() < 0.7 for k in range(rng.randint(0, 8))]
    rows += [(1000 + c, k, "user", "copy" + str(k)) for c in range(40) for k in range(9)]                  # equal conversations
    rows += [(2000, None, None, "no number"), (2000, None, "a", None), (2000, 3, "b", "tie"), (2000, 3, "b", "tie"), (2000, 3, "b", "other"), (2000, 3, "a", "tie")]
    rows += [(None, 1, "user", "nobody"), (-5, 0, "user", "minus"), (-100, 0, "bot", "below"), (3001, 0, "user", "one turn, replaced or not"), (3002, 0, "u", "y"), (3005, 0, "u", "y")]
    rng.shuffle(rows)
    return rows


def long_conversations():
    """Two equal long ones, one that leaves them late, and one of equal turns."""
    rows = [(c, k, "u", str(k % 7)) for c in (6, 7) for k in range(90)]
    rows += [(8, k, "u", str(k % 7) if k < 60 else "else") for k in range(75)]
    return rows + [(9, 1, "u", "again")] * 70


@pytest.mark.parametrize("block, width, rows", [(1024, 1 << 22, conversations()), (4, 1 << 22, conversations(2) + long_conversations()), (16, 1 << 10, long_conversations()),
                                                (1024, 1, conversations(3))])
def test_trie_equals_brute_force(spark, monkeypatch, block, width, rows):
    if width == 1:                                        # a sketch that proves nothing: all prefixes take the exact way
        monkeypatch.setattr(prefix_trie, "screen", lambda prints, *_: prints.drop("prev").withColumns({"shared": F.lit(True), "prev_shared": F.lit(True)}))
    df = spark.createDataFrame(rows, TURNS).withColumns({"conv": F.lit(1), "digest": F.lit("x"), "n": F.lit(2)}).repartition(5)
    got = prefix_trie.trie(df, max_width=max(width, 16), block=block)
    got, want = sorted(map(tuple, got.collect()), key=repr), brute(rows)
    assert [x for x in got if x not in set(want)] == [x for x in want if x not in set(got)]
    assert got == want


def test_screening_keeps_most_prefixes_off_the_shuffle(spark):
    rows = [(c, k, "user", f"{c} {k}") for c in range(100, 400) for k in range(7)]
    _, parts = prefix_trie.rebuilt(*prefix_trie.ordered_turns(spark.createDataFrame(rows, TURNS)))
    prints = prefix_trie.prefixes(parts)
    members = prints.groupBy("digest").count()
    seen = prefix_trie.screen(prints, prints.count()).join(members, "digest").cache()
    assert seen.where("count > 1 and not shared").count() == 0
    assert seen.where("count = 1 and shared").count() <= 0.05 * seen.where("count = 1").count()
    small = prefix_trie.screen(prints, prints.count(), max_width=1024).join(members, "digest")
    assert small.where("count > 1 and not shared").count() == 0


def test_an_empty_table_and_only_empty_conversations(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).collect() == []
    rows = [(c, 0, "u", "t") for c in range(1, 60) if zlib.crc32(str(c).encode()) % 6 > 0]
    assert sorted(map(tuple, prefix_trie.trie(spark.createDataFrame(rows, TURNS)).collect()), key=repr) == brute(rows)
