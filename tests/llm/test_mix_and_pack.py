import gc
import zlib

import numpy as np
import pytest

from catalytics.llm import mixing, packing
from oracle_harness import compare
from samples import frame, special_rows, split, words


def duck_over(path):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    return con


def write(df, path):
    df.write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_mixing_query_equals_its_sql_on_special_rows(spark, tmp_path):
    rows = special_rows() + [(600 + i, " ".join(words(5 + i % 90, i)), "en", f"s{i % 13}", 0) for i in range(300)]
    path = write(frame(spark, rows, size="x", whole=1, h="y").coalesce(1), tmp_path)
    df = mixing.op6_source_mixing(spark, path)
    assert compare(df, duck_over(path), mixing.ORACLE_SQL)["ok"]


def water_fill(sizes, weights, total, epochs):
    """Clamp and redistribute until no source is above its cap."""
    out, free = dict.fromkeys(sizes, 0.0), set(sizes)
    while free:
        left = total - sum(out[s] for s in sizes if s not in free)
        part = {s: left * weights[s] / sum(weights[f] for f in free) for s in free}
        over = {s for s in free if part[s] > epochs * sizes[s]}
        if not over:
            return out | part
        for s in over:
            out[s] = float(epochs * sizes[s])
        free -= over
    return out


def test_mixing_targets_and_words(spark, tmp_path):
    rows = special_rows() + [(600 + i, " ".join(words(1 + i % 70, i)), "en", f"s{min(i % 31, 9)}", 0) for i in range(400)]
    got = mixing.op6_source_mixing(spark, write(frame(spark, rows), tmp_path)).collect()
    assert len(got) == len(rows)
    size = {}
    for _, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + len(split(t))
    order = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    expected = water_fill(size, weights, 1.5 * sum(size.values()), 2)
    by_target = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by_target.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    assert set(by_target) == {(size[s], round(expected[s], 6)) for s in size}
    for (_, target), taken in by_target.items():
        assert abs(sum(taken) - target) <= 2                       # rows that tie at the edge round down
    again = mixing.op6_source_mixing(spark, str(tmp_path)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixing_of_an_empty_table_and_of_empty_texts(spark, tmp_path):
    assert mixing.op6_source_mixing(spark, write(frame(spark, []), tmp_path / "a")).collect() == []
    got = mixing.op6_source_mixing(spark, write(frame(spark, [(1, None, None, None, None), (2, "", "en", "a", 0)]), tmp_path / "b")).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_packing_query_is_a_partition_of_the_ids(spark, tmp_path):
    from tokenizers import Tokenizer
    rows = special_rows() + [(800 + i, " ".join(words(i * 7 % 900, i)), "en", "a", 0) for i in range(120)] + [(999, "<|endoftext|> it's 3rd ́e É", "en", "a", 0)]
    rows = [r for r in rows if r[0] is not None]
    got = packing.op5_packing(spark, write(frame(spark, rows, length="x", rank=1, start=2), tmp_path)).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    ids, pieces = {}, {}
    for i, t, *_ in rows:
        ids.setdefault(i, []).append(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4"))
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(ids)
    for i, copies in ids.items():
        own = sorted(pieces[i], key=lambda r: r.start)
        assert sum(r.length for r in own) == sum(map(len, copies))
        for r in own:
            assert r.doc_tokens == len(copies[0]) and zlib.crc32(copies[0][r.start:r.start + r.length].tobytes()) == r.ids_crc32
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    short = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
        short += at < packing.CAPACITY
    assert short <= 4


@pytest.mark.parametrize("seed", range(4))
def test_patterns_use_every_piece_in_near_least_sequences(seed):
    rng = np.random.default_rng(seed)
    histogram = {int(n): int(rng.integers(1, 400)) for n in rng.choice(np.arange(1, 256), 120, replace=False)}
    out = packing.patterns(histogram, 256)
    used = {}
    for p, times in out:
        assert sum(n * c for n, c in p.items()) <= 256
        for n, c in p.items():
            used[n] = used.get(n, 0) + c * times
    assert used == histogram
    lengths = np.array(sorted(histogram))
    _, use = packing.column_generation(lengths, np.array([histogram[n] for n in lengths.tolist()], float), 256)
    assert sum(t for _, t in out) <= use.sum() * 1.005 + 2          # no plan uses fewer than the linear optimum


def test_column_generation_reaches_the_linear_optimum():
    rows, use = packing.column_generation(np.array([3, 5, 7]), np.array([10.0, 20.0, 10.0]), 10)
    assert (use @ rows >= np.array([10, 20, 10]) - 1e-9).all() and use.sum() == pytest.approx(20)


def test_words_are_coded_as_the_whole_tokenizer_codes_texts():
    from tokenizers import Tokenizer
    tokenizer, coder = Tokenizer.from_file(packing.tokenizer_path()), packing.WordCoder(packing.tokenizer_path())
    assert coder.by_word
    texts = ["It's 'S we'LL <|endoftext|> a<|startoftext|>b", "ÉÀÜß straße Ça-va? İstanbul ΣΑΣ ŉ ǅ ǰ ß", "a1b22 3.14 x_y --!!** &&&", "e\u0301 n\u0303o \u1e9e",
             "日本語 ２３ ½ ²", "tab\tnew\nline\x0bv\x0cf nb\u00a0sp \u2028 z\x1cq \x85 w", "ĳ ŀ Ŀ ǆ Ǆ Ʒ ȡ ɏ × ÷ a×b", "", "'", "''s <| |>", "a" * 300]
    texts += [" ".join(words(40, i)) for i in range(20)]
    rng = np.random.default_rng(2)
    texts += ["".join(chr(c) for c in rng.integers(33, 0x260, 60)) for _ in range(200)]
    flat, offsets = coder.encode([t.encode() for t in texts])
    for t, b, e in zip(texts, offsets[:-1], offsets[1:]):
        assert flat[b:e].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_every_letter_of_the_plain_range_is_coded_as_the_tokenizer_codes_it():
    from tokenizers import Tokenizer
    tokenizer, coder = Tokenizer.from_file(packing.tokenizer_path()), packing.WordCoder(packing.tokenizer_path())
    texts = [t for c in map(chr, range(0xA1, 0x270)) for t in (f"x{c}liyev", f"{c}an", f"KW{c}", f"a{c}{c}1{c}!", f"{c}")]
    flat, offsets = coder.encode([t.encode() for t in texts])
    wrong = [t for t, b, e in zip(texts, offsets[:-1], offsets[1:]) if flat[b:e].tolist() != tokenizer.encode(t, add_special_tokens=False).ids]
    assert not wrong


def test_packing_of_an_empty_table(spark, tmp_path):
    assert packing.op5_packing(spark, write(frame(spark, []), tmp_path)).collect() == []


def test_word_memory_holds_no_object_for_each_word(monkeypatch):
    """Remembered ids are arrays (a list a word was visited by every garbage collection), and a full memory starts anew."""
    from tokenizers import Tokenizer
    tokenizer, coder = Tokenizer.from_file(packing.tokenizer_path()), packing.WordCoder(packing.tokenizer_path())
    letters = ["".join(chr(97 + n // 26 ** k % 26) for k in range(4)) for n in range(0, 20_000)]
    coder.encode([b"warm"])
    gc.collect()
    before = len(gc.get_objects())
    coder.encode([" ".join(letters).encode()])
    gc.collect()
    assert len(gc.get_objects()) - before < 2_000
    monkeypatch.setattr(packing, "_CACHE", 100)
    for texts in (["Zwei", "zwei. drei", "", "zwei drei."], [" ".join(letters[:300])], ["zwei, aaaa's 12"]):
        flat, offsets = coder.encode([t.encode() for t in texts])
        for t, b, e in zip(texts, offsets[:-1], offsets[1:]):
            assert flat[b:e].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
    assert coder.words.known < 1_000
