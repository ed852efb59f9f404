import collections
import zlib

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from catalytics.llm import frames, mixing, packing, pii_crf, simhash
from samples import frame, special_rows, split, words
from test_dedup import classes_of, plain_fingerprint
from test_text_models import SECRETS, language_rows, plain_secrets

EXTRA = {"spans": "x", "fp": 1, "score": "y", "blob": 2, "whole": "z", "lang_pred": 3}


def rows_of_pipeline():
    rows = language_rows(60) + special_rows()
    body = " ".join(words(150, 77))
    rows += [(5000 + i, body, "en", "a", len(body)) for i in range(5)]
    rows += [(6000 + i, body + " " + t, "en", "b", 0) for i, t in enumerate(SECRETS)]
    return rows


def plain(r, columns):
    return tuple(r[c] for c in columns)


def test_stages_against_brute_force(spark):
    rows = rows_of_pipeline()
    docs = frame(spark, rows, **EXTRA)
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    said = frames.cut(stages["language"](spark, docs, ""), "t")
    assert said.columns == columns
    kept = collections.Counter(plain(r, columns[:2]) for r in said.collect())
    letters = collections.Counter(r[:2] for r in rows if any(c.isalpha() for c in r[1] or ""))
    assert not kept - letters
    clean = collections.Counter(r[:2] for r in language_rows(60))
    assert not clean - kept

    deduped = frames.cut(stages["near_dedup"](spark, said, ""), "t")
    assert deduped.columns == columns
    before, after = [plain(r, columns[:2]) for r in said.collect()], [plain(r, columns[:2]) for r in deduped.collect()]
    label = classes_of([plain_fingerprint(t) for _, t in before], 2)
    groups = collections.defaultdict(list)
    for i, t in before:
        groups[label[plain_fingerprint(t)]].append(i)
    stay = collections.Counter(min((i for i in ids if i is not None), default=None) for ids in groups.values())
    assert collections.Counter(i for i, _ in after) == stay and len(after) == len(groups)

    masked = frames.cut(stages["secrets"](spark, deduped, ""), "t")
    assert masked.columns == columns and masked.count() == len(after)
    texts = dict(after)
    for r in masked.collect():
        old = texts[r.doc_id]
        if plain_secrets(old):
            assert corpus_pipeline.MASK in r.text and not plain_secrets(r.text) and r.n_chars == len(r.text)
            assert r.text.startswith(old[:plain_secrets(old)[0][0]])
        elif corpus_pipeline.MASK not in r.text:
            assert r.text == old

    mixed = frames.cut(stages["mixing"](spark, masked, ""), "t")
    assert mixed.columns == columns
    taken, source = collections.Counter(), {r.doc_id: r.source for r in masked.collect()}
    size = collections.Counter()
    for r in masked.collect():
        size[r.source] += len(split(r.text))
    for r in mixed.collect():
        taken[source[r.doc_id]] += len(split(r.text))
    targets = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(size.items()), "source string, source_size long")).collect()}
    assert all(abs(taken[s] - targets[s]) <= 2 for s in size)

    packed = stages["packing"](spark, mixed, "").collect()
    from tokenizers import Tokenizer
    tokenizer, want = Tokenizer.from_file(packing.tokenizer_path()), collections.Counter()
    for r in mixed.collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for n in packing._piece_lengths(len(ids), packing.CAPACITY, packing.UNIT):
            want[r.doc_id, at, n, zlib.crc32(ids[at:at + n].tobytes())] += 1
            at += n
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed) == want


def test_run_applies_the_stages_to_the_table(spark, tmp_path):
    frame(spark, rows_of_pipeline()).write.parquet(f"{tmp_path}/documents.parquet")
    out = entry.queries()["pipeline"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_of_an_empty_table(spark):
    docs = frame(spark, [], **EXTRA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


def test_pipeline_stage_names_and_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "secrets", "mixing", "packing"]
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n[2].isdigit()) == list(range(1, 14))
    assert simhash.MAX_BITS == 2 and pii_crf.KINDS == ("email", "ip", "card", "phone")
