"""Substring dedup by seed and extend over winnowed anchors.

1. Seeds.  A text is named by 128 bits of SHA-256.  Every text is cut into words; the hashes of its ``anchor_words``-grams are winnowed:
   of the grams inside each window of ``min_words`` words the smallest hash (leftmost on ties) is
   that window's anchor.  The choice depends on the window's words alone, so two equal windows
   carry the same anchor at the same place.  Anchors that occur once in the corpus are dropped.
2. Join.  The documents are joined with their own repeated anchors only.
3. Extend.  Each remaining anchor is extended both ways to every window that chose it; windows
   whose words are equal meet by a 128-bit fingerprint of all ``min_words`` words.  Occurrences
   are counted, never paired, so a passage shared by n documents costs n rows.
4. Maximal repeats.  The windows that occur at least twice are merged per document into maximal
   intervals of repeated words, each at least ``min_words`` long.

A word enters all hashes by 128 bits of BLAKE2b under a key drawn for the run, so no choice of words
makes two windows collide; two lanes of the window's hash stay apart.  An anchor is one 64-bit hash,
which only decides which windows are looked at.  Shuffles carry hashes and twice the texts by name.  A hot passage is pre-aggregated by the partial counts, and the joins
on hashes are plain equi-joins whose skewed partitions Spark splits.

Results in special cases: a null or empty text, or one under ``min_words`` words, has no repeats
and loses nothing; repeated rows are occurrences of their own, so both copies of a text of
``min_words`` words or more lose all words (the contract removes every covered word); an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalytics.llm import frames, text

MIN_WORDS = 35
ANCHOR_WORDS = 8
_SALT = np.uint64(0x5851F42D4C957F2D)


def _leftmost_minima(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest value and its leftmost position in every window of ``width`` values, by doubling."""
    least, at, span = values, np.arange(len(values)), 1
    while span * 2 <= width:
        later = least[span:] < least[:-span]
        at, least = np.where(later, at[span:], at[:-span]), np.where(later, least[span:], least[:-span])
        span *= 2
    if span < width:
        d = width - span
        later = least[d:] < least[:-d]
        at, least = np.where(later, at[d:], at[:-d]), np.where(later, least[d:], least[:-d])
    return least, at


def _windows(part: pa.RecordBatch, codes: text.WordCodes, min_words: int, anchor_words: int):
    """Anchor hash, anchor position, first word, text number and word lanes for all windows inside one text."""
    words, owner = codes.of(part.column("text"))
    if len(words) < min_words:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, owner, words
    least, at = _leftmost_minima(text.gram_hashes(words[:, 0], anchor_words), min_words - anchor_words + 1)
    inside = np.flatnonzero(owner[:len(words) - min_words + 1] == owner[min_words - 1:])
    return least[inside], at[inside], inside, owner, words


def _anchor_batches(key: bytes, min_words: int, anchor_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = text.WordCodes(key)
        for batch in batches:
            for part in text.slices(batch, "text"):
                least, at, first, owner, _ = _windows(part, codes, min_words, anchor_words)
                _, one = np.unique(at, return_index=True)          # every selected position once
                pair = np.empty(len(one), [("doc", np.int64), ("anchor", np.uint64)])
                pair["doc"], pair["anchor"] = owner[first[one]], least[one]
                pair, n = np.unique(pair, return_counts=True)
                doc = pa.array(pair["doc"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("blob").take(doc), pa.array(pair["anchor"].view(np.int64)), pa.array(n.astype(np.int32))], ["blob", "anchor", "n"])
    return run


def _window_batches(key: bytes, min_words: int, anchor_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = text.WordCodes(key)
        for batch in batches:
            for part in text.slices(batch, "text"):
                least, _, first, owner, words = _windows(part, codes, min_words, anchor_words)
                seeds = part.column("anchors")
                seed_doc = np.repeat(np.arange(len(seeds)), np.diff(seeds.offsets.to_numpy()))
                seed = seeds.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                # (text, anchor) membership: both sides mixed into one key; a false hit only sends a window more
                wanted = text.mix(seed + seed_doc.astype(np.uint64) * _SALT)
                doc = owner[first]
                first = first[np.isin(text.mix(least + doc.astype(np.uint64) * _SALT), wanted)]
                doc = owner[first]
                prints = [text.gram_hashes(text.mix(words[:, k] + _SALT), min_words)[first] if len(first) else np.zeros(0, np.uint64) for k in (0, 1)]
                start = first - np.searchsorted(owner, np.arange(len(part)))[doc]
                names, rows = ["blob", "copies", "doc", "w1", "w2", "start"], len(doc)
                # a row for each text, then its windows, which know it by its number
                long, none = pa.int64(), len(part)
                yield pa.RecordBatch.from_arrays([part.column("blob"), part.column("copies"), part.column("doc"), pa.nulls(none, long), pa.nulls(none, long),
                                                  pa.nulls(none, pa.int32())], names)
                yield pa.RecordBatch.from_arrays([pa.nulls(rows, pa.binary()), pa.nulls(rows, long), part.column("doc").take(pa.array(doc)),
                                                  *(pa.array(x.view(np.int64)) for x in prints), pa.array(start.astype(np.int32))], names)
    return run


def _merge(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins, stops = [], []
            for starts in batch.column("starts"):
                s = np.unique(np.asarray(starts.values.to_numpy(zero_copy_only=False), np.int64))
                new = np.flatnonzero(np.diff(s, prepend=s[0] - min_words - 1) > min_words)
                begins.append(s[new])
                stops.append(s[np.append(new[1:], len(s)) - 1] + min_words)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(begins, pa.list_(pa.int64())), pa.array(stops, pa.list_(pa.int64()))],
                                             ["doc", "begins", "stops"])
    return run


def _blob(body):
    """128 bits of SHA-256 name a text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(body.cast("string"), F.lit("")).cast("binary"), 256), 1, 32))


def repeats(docs: DataFrame, text_column: str = "text", min_words: int = MIN_WORDS, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """blob, begins, stops of the maximal repeated word intervals (stop exclusive) of every text that other texts share words with;
    copied: whether the text has several rows, and so is a repeat as a whole."""
    rows = docs.select(_blob(docs[text_column]).alias("blob"), docs[text_column].cast("string").alias("text")).where("text is not null")
    key = os.urandom(16)
    anchors = frames.cut(rows.mapInArrow(_anchor_batches(key, min_words, anchor_words), "blob binary, anchor long, n int"), "anchors")
    twice = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")
    seeds = frames.cut(anchors.join(twice, "anchor").select("blob", "anchor").distinct().groupBy("blob").agg(F.collect_list("anchor").alias("anchors")), "seeds")
    frames.drop(anchors)
    # copies of a text are one: each task keeps one of them before the shuffle
    texts = rows.groupBy("blob").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    seeded = texts.join(seeds, "blob").withColumn("doc", F.monotonically_increasing_id()).select("doc", "blob", "copies", "text", "anchors")
    windows = frames.cut(seeded.mapInArrow(_window_batches(key, min_words, anchor_words), "blob binary, copies long, doc long, w1 long, w2 long, start int"), "windows")
    named = frames.cut(windows.where("blob is not null").select("doc", "blob", "copies"), "named")
    windows_only = windows.where("blob is null").select("doc", "w1", "w2", "start")
    copied = frames.cut(windows_only.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2"), "copied")
    starts = windows_only.join(copied, ["w1", "w2"]).groupBy("doc").agg(F.collect_set("start").alias("starts"))
    merged = frames.cut(starts.mapInArrow(_merge(min_words), "doc long, begins array<long>, stops array<long>"), "merged")
    frames.drop(windows, copied)
    found = named.join(merged, "doc", "left").where("begins is not null or copies > 1")
    found = frames.cut(found.select("blob", "begins", "stops", (F.col("copies") > 1).alias("copied")), "repeats")
    frames.drop(merged, seeds, named)
    return found


def _apply(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text.slices(batch, "text"):
                total, removed, kept = [], [], []
                for body, begins, stops, copied in zip(*(part.column(c) for c in ("text", "begins", "stops", "copied"))):
                    words = (body.as_py() or "").encode().split()
                    keep = np.ones(len(words), bool)
                    if copied.as_py() and len(words) >= min_words:
                        keep[:] = False
                    elif begins.is_valid:
                        for b, e in zip(begins.as_py(), stops.as_py()):
                            keep[b:e] = False
                    total.append(len(words))
                    removed.append(len(words) - int(keep.sum()))
                    kept.append(b" ".join(words if not removed[-1] else [w for w, k in zip(words, keep) if k]).decode())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                                                  pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])
    return run


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS,
                   anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """id, n_words, n_removed, kept: every text without its repeated words, the kept words joined by one space."""
    found = repeats(docs, text_column, min_words, anchor_words)
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"), _blob(docs[text_column]).alias("blob"))
    kind = docs.schema[id_column].dataType.simpleString()
    return rows.join(found, "blob", "left").select("id", "text", "begins", "stops", "copied").mapInArrow(
        _apply(min_words), f"id {kind}, n_words long, n_removed long, kept string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(frames.table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
