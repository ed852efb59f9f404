import collections
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from catalytics.llm import suffix_dedup
from samples import frame, special_rows, words


def brute(rows, width):
    count = collections.Counter()
    bodies = [(i, (t or "").encode()) for i, t, *_ in rows]
    for _, b in bodies:
        count.update(b[k:k + width] for k in range(len(b) - width + 1))
    out = []
    for i, b in bodies:
        cover = [False] * (len(b) + 1)
        for k in range(len(b) - width + 1):
            if count[b[k:k + width]] > 1:
                cover[k:k + width] = [True] * width
        kept = bytes(x for x, c in zip(b, cover) if not c)
        out.append((i, len(b), len(b) - len(kept), sum(c and not p for c, p in zip(cover, [False, *cover])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def mixed_rows(n=50):
    rng, pool = random.Random(5), [" ".join(words(k, 90 + k)) for k in (40, 80, 120, 160)]
    rows = []
    for i in range(n):
        body = ""
        for _ in range(rng.randint(1, 5)):
            passage = rng.choice(pool)
            a = rng.randint(0, 60)
            body += " ".join(words(rng.randint(0, 30), rng.random())) + passage[a:a + rng.randint(50, 700)]
        rows.append((100 + i, body, "en", "a", 0))
    return rows


@pytest.mark.parametrize("width, gram, group", [(400, 64, 512), (60, 16, 512), (60, 16, 3)])
def test_suffix_dedup_equals_brute_force(spark, width, gram, group):
    long_free = [r for r in special_rows() if len(r[1] or "") < 20_000]
    rows = long_free + mixed_rows() + [(300, "ab" * 500, "en", "a", 0), (301, "é" * 450, "en", "a", 0), (302, "x" * width, "en", "a", 0), (303, "x" * (width - 1), "en", "a", 0)]
    df = frame(spark, rows, blob=1, key="x", piece=2).repartition(5)
    got = suffix_dedup.dedup(df, min_bytes=width, gram=gram, group=group)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, width)


def test_a_common_line_in_many_texts_is_split_and_kept(spark):
    """A line shorter than the window in every text: one anchor, many pieces, nothing to remove but the planted pair."""
    line, rng = " ".join(words(30, 1))[:50], random.Random(3)
    rows = [(i, " ".join(words(15, i + 10)) + line + " ".join(words(15, i + 1000)), "en", "a", 0) for i in range(80)]
    planted = "q" + line + " ".join(words(15, 5))
    rows += [(900, "first " + planted, "en", "a", 0), (901, planted + " last", "en", "a", 0)]
    rng.shuffle(rows)
    got = suffix_dedup.dedup(frame(spark, rows).repartition(4), min_bytes=60, gram=16, group=4)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 60)


def test_long_texts_cross_chunks(spark, monkeypatch):
    body = " ".join(words(3_000, 8))
    rows = [(1, body, "en", "a", 0), (2, "head " + body[5_000:9_000] + " tail", "en", "a", 0)]
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 700)
    found = list(suffix_dedup._runs(*__import__("catalytics.llm.text", fromlist=["x"]).text_bytes(__import__("pyarrow").array([body])), 400, 64))
    assert sum(int((hi - lo + 1).sum()) for _, _, lo, hi in found) == len(body.encode()) - 399
    got = suffix_dedup.dedup(frame(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 400)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda b: b"\x01" * (len(b) % 3) * 40 + bytes(x % 3 for x in b)), min_size=1, max_size=30))
def test_deep_shallow_order_sorts(strings):
    order = suffix_dedup.deep_shallow_order(strings)
    assert sorted(order) == list(range(len(strings)))
    assert [strings[i] for i in order] == sorted(strings)
    assert [strings[i] for i in suffix_dedup.blind_trie_order(strings, list(range(len(strings))))] == sorted(strings)


def test_an_empty_table(spark):
    assert suffix_dedup.dedup(frame(spark, [])).collect() == []
