import collections
import hashlib

import pytest

from catalytics.llm import token_alignment
from samples import frame, special_rows, words


@pytest.fixture(scope="module")
def models():
    return token_alignment.Tokenizers(*token_alignment.default_paths())


def plain_tokens(models, text):
    """(id, end) of A and B by the two libraries alone, or none."""
    raw = (" " + text).encode()
    out = []
    for ids, table in ((models.a.encode(" " + text, add_special_tokens=False).ids, models.a_bytes), (models.b.encode(text), models.b_bytes)):
        if b"".join(table[i] for i in ids) != raw:
            return None
        at, spans = 0, []
        for i in ids:
            at += len(table[i])
            spans.append((i, at))
        out.append(spans)
    return out


def brute(models, rows):
    tokens = [plain_tokens(models, t) if t else None for _, t, *_ in rows]
    links = [[(a, b) for a, x in t[0] for b, y in t[1] if x == y] if t and len(t[0]) < 3000 else [] for t in tokens]
    for k, t in enumerate(tokens):
        if t and len(t[0]) >= 3000:
            by_end = dict((y, b) for b, y in t[1])
            links[k] = [(a, by_end[x]) for a, x in t[0] if x in by_end]
    count = collections.Counter(p for own in links for p in own)
    most = collections.Counter()
    for (a, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for (i, *_), t, own in zip(rows, tokens, links):
        if not t:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        cuts = sorted({x for _, x in t[0]} & {y for _, y in t[1]})
        low, groups = 0, []
        a_at, b_at = iter(t[0]), iter(t[1])
        for stop in cuts:
            sides = []
            for side in (a_at, b_at):
                ids = []
                for x, end in side:
                    ids.append(str(x))
                    if end == stop:
                        break
                sides.append(",".join(ids))
            groups.append("|".join(sides))
            low = stop
        out.append((i, len(t[0]), len(t[1]), len(cuts), len(own), sum(count[p] == most[p[1]] for p in own), sum(count[p] for p in own),
                    hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=repr)


def odd_texts():
    return ["a  b\n\n c\t", " x", "x ", "  ", "\n", "ﬁ ½ Ⅳ", "▁a", "a▁b", "<s> </s> <unk> <|endoftext|>", "a\x00b", "\xa0x 　y", "é é 😀 日本語 ἀρχή",
            "don't I'll we've", "12345 67,890.5!!", "word\n  next", "tab\t end", " x ​", "a" * 300, "x " * 50 + "y", "same same same same"]


@pytest.mark.parametrize("limits", [{}, {"block_links": 50, "block_docs": 256}])
def test_alignment_equals_brute_force(spark, models, limits):
    rows = special_rows() + [(100 + k, t, "en", "a", 1) for k, t in enumerate(odd_texts())]
    rows += [(200 + k, " ".join(words(30, k % 7)) + ".", "en", "a", 1) for k in range(60)]
    df = frame(spark, rows, pair=1, slot="x", block=2.5).repartition(4)
    got = token_alignment.align(df, **limits).collect()
    assert sorted(map(tuple, got), key=repr) == brute(models, rows)


def test_pair_scores_equal_brute_force(spark, models):
    rows = [(k, " ".join(words(20, k % 5)) + " the the the", "en", "a", 1) for k in range(30)]
    posted = token_alignment.postings(frame(spark, rows).repartition(3), block_links=40, block_docs=256)
    got = {(r.a_id, r.b_id): (r.docs, r.links) for r in token_alignment.pair_scores(token_alignment.pair_counts(posted)).collect()}
    links, docs = collections.Counter(), collections.Counter()
    for _, text, *_ in rows:
        a, b = plain_tokens(models, text)
        by_end = {y: j for j, y in b}
        own = [(i, by_end[x]) for i, x in a if x in by_end]
        links.update(own)
        docs.update(set(own))
    assert got == {p: (docs[p], links[p]) for p in links}


def test_every_plain_character_is_cut_as_the_tokenizer_cuts_it(models):
    parts = token_alignment.Parts(models)
    points = [*range(0x250), *range(0x2000, 0x2070)]
    texts = [f"a{c}b 1{c}2 !{c}? {c}{c} x{c} {c}x\n{c}y '{c}s {c}" for c in map(chr, points)]
    for text, own in zip(texts, parts.of(texts)):
        t = plain_tokens(models, text)
        assert (own is None) == (t is None), repr(text)
        if own:
            assert (sum(parts.n_a[i] for i in own), sum(parts.n_b[i] for i in own)) == (len(t[0]), len(t[1])), repr(text)
            flat = ",".join(parts.groups[i] for i in own).replace(";", ",")
            assert sorted(flat.replace("|", ",").split(",")) == sorted(str(i) for i, _ in t[0] + t[1]), repr(text)


def test_an_empty_table(spark):
    assert token_alignment.align(frame(spark, [])).collect() == []
