"""Cross-tokenizer alignment with inverted pair bitmaps.

1. Align.  Every text is encoded by a byte-level BPE (A) and by a piece model (B); the byte offsets
   where tokens of both end cut the tokens into groups, and the two tokens that end there are a link.
   A task works on blocks of documents numbered from 0.  Parts of a text that both models encode on
   their own (a space and the characters up to the next one) are encoded and aligned once and reused.
2. Postings.  Of every pair (A id, B id) that is linked in a block there is one compressed bitmap of
   the block's documents (16-bit numbers, or plain bits where those are smaller), and for documents
   that link the pair m > 1 times a bitmap for each bit of m - 1, the multiplicity planes.
3. Counts.  Blocks share no document, so the union of a pair's bitmaps over all blocks has the sum of
   their popcounts: the document count; planes weighted by their power of two add the link count.
   Only these numbers are shuffled, added up before the shuffle.
4. Scores.  The best count of each B id is a maximum over the pair counts.  Pair scores are joined to
   the postings, which go back to their blocks, and each bit returns its pair's score to its document.

A block holds at most 65,536 documents and, but for its last one, ``BLOCK_LINKS`` links; a frequent
pair has one posting per block and plane, however many documents link it.  Nothing is broadcast.

Results in special cases: a null or empty text, and one whose token bytes are not a space and the
text (as where it holds U+2581), has no tokens: zeros and an empty digest.  Repeated rows are
documents of their own, null ids included.  Texts of any length are encoded whole.  An empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from catalytics.llm import frames, text

BLOCK_LINKS = 1 << 21
BLOCK_DOCS = 1 << 16
CACHED_PARTS = 300_000               # distinct parts remembered by a worker
LONGEST_PART = 64                    # characters; a longer part is not remembered
PAIR_SHIFT = 24                      # a pair is one number: A id above B id
#: Characters of which both regular-expression engines are tested to think alike.
_PLAIN = re.compile(r"[\x00-ɏ -⁯]*")
_PART = re.compile(" [^ ]+")


def default_paths() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 as is, others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _piece_bytes(piece: str) -> bytes:
    if re.fullmatch("<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Tokenizers:
    """Both models, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tokenizers
        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b_bytes = [_piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.fast = self._ranked()

    def _ranked(self):
        """The same merges for plain texts as ranks, where ids are in the order of the merges."""
        import json

        import public_tokenizers
        import tiktoken
        model = json.loads(self.a.to_str())["model"]
        ids, merges = model["vocab"], model["merges"]
        made = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        if any(x >= y for x, y in zip(made, made[1:])):
            return None
        ranks = {self.a_bytes[i]: i for token, i in ids.items() if token not in special}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, raw: list[str], plain: bool) -> tuple[list, list]:
        """Ids of A and B for strings that start with the space before them."""
        if plain and self.fast:
            a = [self.fast.encode_ordinary(x) for x in raw]
        else:
            a = [self.a.encode(x, add_special_tokens=False).ids for x in raw]
        return a, self.b.encode([x[1:] for x in raw], num_threads=1)


class Parts:
    """Aligned parts of texts, each known by a number: token counts, links, and the written form of the groups."""

    def __init__(self, models: Tokenizers):
        self.models = models
        self.a_len = np.array([len(x) for x in models.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in models.b_bytes], np.int64)
        self.a_sep = [f"{i}{s}" for i in range(len(models.a_bytes)) for s in ",|"]
        self.b_sep = [f"{i}{s}" for i in range(len(models.b_bytes)) for s in ",;"]
        self.written = self.a_sep + self.b_sep
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.good: list[bool] = []
        self.groups: list[str] = []
        self.n_a: list[int] = []
        self.n_b: list[int] = []
        self.links: list[np.ndarray] = []

    def add(self, raw: list[str], plain: bool) -> range:
        """Align strings (each with the space before it); their numbers."""
        first = len(self.good)
        a_ids, b_ids = self.models.ids(raw, plain)
        good = []
        for s, a, b in zip(raw, a_ids, b_ids):
            body = s.encode()
            good.append(b"".join(map(self.models.a_bytes.__getitem__, a)) == body and b"".join(map(self.models.b_bytes.__getitem__, b)) == body)
        a_ids = [x if g else [] for x, g in zip(a_ids, good)]
        b_ids = [x if g else [] for x, g in zip(b_ids, good)]
        n_a, n_b = np.array([len(x) for x in a_ids], np.int64), np.array([len(x) for x in b_ids], np.int64)
        a = np.fromiter((i for x in a_ids for i in x), np.int64, int(n_a.sum()))
        b = np.fromiter((i for x in b_ids for i in x), np.int64, int(n_b.sum()))
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        total = int(a_end[-1]) if len(a_end) else 0
        ends = np.zeros(total + 1, bool)
        ends[b_end] = True
        a_last = ends[a_end]
        ends[:] = False
        ends[a_end] = True
        b_last = ends[b_end]
        # every string's last byte ends tokens of both, so groups never cross strings
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        n_groups = int(a_last.sum())
        a_before = np.concatenate([[0], np.cumsum(np.bincount(a_group, minlength=n_groups))])
        b_before = np.concatenate([[0], np.cumsum(np.bincount(b_group, minlength=n_groups))])
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + b_before[a_group]] = a * 2 + a_last
        order[np.arange(len(b)) + a_before[b_group + 1]] = len(self.a_sep) + b * 2 + b_last
        tokens = [self.written[i] for i in order.tolist()]
        links = a[a_last] << PAIR_SHIFT | b[b_last]
        a_stop, b_stop = np.cumsum(n_a), np.cumsum(n_b)
        group_stop = np.concatenate([[0], np.cumsum(a_last)])[a_stop]
        token_stop, at, link_at = (a_stop + b_stop).tolist(), 0, 0
        for k, stop in enumerate(token_stop):
            self.groups.append("".join(tokens[at:stop])[:-1])
            self.links.append(links[link_at:group_stop[k]].copy())
            at, link_at = stop, group_stop[k]
        self.good += good
        self.n_a += n_a.tolist()
        self.n_b += n_b.tolist()
        return range(first, len(self.good))

    def of(self, texts: list[str | None]) -> list[list[int] | None]:
        """For each text the numbers of its parts in order, or None where it has no tokens."""
        if len(self.good) > CACHED_PARTS:
            self.forget()
        split: list[list[str] | None] = []
        new: dict[str, None] = {}
        for t in texts:
            if t and "  " not in t and t[0] != " " and t[-1] != " " and _PLAIN.fullmatch(t):
                split.append(_PART.findall(" " + t))
                new.update(dict.fromkeys(split[-1]))
            else:
                split.append(None)
        fresh = [s for s in new if s not in self.number]
        number = self.number
        passing = {}
        for s, k in zip(fresh, self.add(fresh, True)):
            (number if len(s) <= LONGEST_PART else passing)[s] = k
        out = []
        for t, parts in zip(texts, split):
            if parts is not None:
                own = [number[s] if s in number else passing[s] for s in parts]
            elif t:
                own = list(self.add([" " + t], _PLAIN.fullmatch(t) is not None))
            else:
                own = []
            out.append(own if own and all(map(self.good.__getitem__, own)) else None)
        return out


def _schema(id_kind: pa.DataType) -> pa.Schema:
    long, part = pa.int64(), pa.int32()
    return pa.schema([("block", long), ("id", id_kind), ("slot", part), ("n_a", long), ("n_b", long), ("n_groups", long), ("groups_sha256", pa.string()),
                      ("pair", long), ("plane", part), ("n", part), ("dense", pa.bool_()), ("bits", pa.binary())])


def _filled(schema: pa.Schema, rows: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)


def _bitmaps(pair: np.ndarray, slot: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Pair, popcount, whether plain bits, and bitmap of every run of equal pairs (sorted by pair and slot)."""
    at = np.flatnonzero(np.diff(pair, prepend=-1))
    n = np.diff(np.append(at, len(pair)))
    dense = n * 2 > (docs + 7) // 8
    numbers = slot.astype("<u2")
    out = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(pair)).astype(np.int32) * 2), pa.py_buffer(numbers)])
    if dense.any():
        cells = out.to_pylist()
        for k in np.flatnonzero(dense):
            bits = np.zeros(docs, bool)
            bits[slot[at[k]:at[k] + n[k]]] = True
            cells[k] = np.packbits(bits).tobytes()
        out = pa.array(cells, pa.binary())
    return pair[at], n, dense, out


def _postings(schema: pa.Schema, block: int, pairs: np.ndarray, slots: np.ndarray, docs: int) -> Iterator[pa.RecordBatch]:
    """The block's bitmaps: plane 0 has a pair's documents, plane i + 1 those with bit i in (multiplicity - 1)."""
    key, m = np.unique((pairs << 16) | slots, return_counts=True)
    pair, slot, more = key >> 16, key & 0xFFFF, m - 1
    for plane in range(int(more.max(initial=0)).bit_length() + 1):
        here = (more >> (plane - 1)) & 1 == 1 if plane else np.ones(len(key), bool)
        ids, n, dense, bits = _bitmaps(pair[here], slot[here], docs)
        yield _filled(schema, len(ids), block=pa.array(np.full(len(ids), block)), pair=pa.array(ids), plane=pa.array(np.full(len(ids), plane, np.int32)),
                      n=pa.array(n.astype(np.int32)), dense=pa.array(dense), bits=bits)


def _align(a_path: str, b_path: str, schema: pa.Schema, block_links: int, block_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Parts(Tokenizers(a_path, b_path))
        block, docs, held, pairs, slots = TaskContext.get().partitionId() << 32, 0, 0, [], []
        for batch in batches:
            for piece in text.slices(batch, "text"):
                aligned = parts.of(piece.column("text").to_pylist())
                for first in range(0, len(aligned), 256):
                    some = aligned[first:first + 256]
                    rows = {c: [] for c in ("n_a", "n_b", "n_groups", "groups_sha256")}
                    for k, own in enumerate(some):
                        own = own or []
                        links = np.concatenate([parts.links[i] for i in own]) if own else np.zeros(0, np.int64)
                        rows["n_a"].append(sum(map(parts.n_a.__getitem__, own)))
                        rows["n_b"].append(sum(map(parts.n_b.__getitem__, own)))
                        rows["n_groups"].append(len(links))
                        rows["groups_sha256"].append(hashlib.sha256(";".join(map(parts.groups.__getitem__, own)).encode()).hexdigest() if own else "")
                        pairs.append(links)
                        slots.append(np.full(len(links), docs + k, np.int64))
                        held += len(links)
                    yield _filled(schema, len(some), block=pa.array(np.full(len(some), block)), id=piece.column("id").slice(first, len(some)),
                                  slot=pa.array(np.arange(docs, docs + len(some), dtype=np.int32)),
                                  **{c: pa.array(v, schema.field(c).type) for c, v in rows.items()})
                    docs += len(some)
                    if held >= block_links or docs + 256 > block_docs:
                        yield from _postings(schema, block, np.concatenate(pairs), np.concatenate(slots), docs)
                        block, docs, held, pairs, slots = block + 1, 0, 0, [], []
        if pairs:
            yield from _postings(schema, block, np.concatenate(pairs), np.concatenate(slots), docs)
    return run


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of postings, sorted by block, added to the documents whose bits are set."""
    block, best, total = None, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def done():
        hit = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), block)), pa.array(hit.astype(np.int32)), pa.array(best[hit]), pa.array(total[hit])],
                                          ["block", "slot", "n_best", "count_sum"])

    for batch in batches:
        blocks = batch.column("block").to_numpy()
        edges = np.append(np.flatnonzero(np.diff(blocks, prepend=blocks[0] - 1)), len(blocks)) if len(blocks) else np.zeros(1, int)
        for i, j in zip(edges[:-1], edges[1:]):
            if blocks[i] != block:
                if block is not None:
                    yield done()
                block, best, total = int(blocks[i]), np.zeros(BLOCK_DOCS, np.int64), np.zeros(BLOCK_DOCS, np.int64)
            part = batch.slice(i, j - i)
            weight, links = part.column("weight").to_numpy(), part.column("links").to_numpy()
            top, dense = part.column("top").to_numpy(zero_copy_only=False), part.column("dense").to_numpy(zero_copy_only=False)
            thin = np.flatnonzero(~dense)
            bits = part.column("bits").take(pa.array(thin))
            slot = np.frombuffer(b"".join(bits.to_pylist()), "<u2")
            each = np.repeat(thin, part.column("n").to_numpy()[thin])
            np.add.at(total, slot, (weight * links)[each])
            np.add.at(best, slot, (weight * top)[each])
            for k in np.flatnonzero(dense):
                slot = np.flatnonzero(np.unpackbits(np.frombuffer(part.column("bits")[int(k)].as_py(), np.uint8)))
                total[slot] += weight[k] * links[k]
                best[slot] += weight[k] * top[k]
    if block is not None:
        yield done()


def postings(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", a_path: str | None = None, b_path: str | None = None,
             block_links: int = BLOCK_LINKS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Written rows of two kinds: documents (``slot`` not null) with their own counts, and bitmaps (``pair`` not null)."""
    if not a_path or not b_path:
        a_path, b_path = default_paths()
    if not 256 <= block_docs <= BLOCK_DOCS:
        raise ValueError(f"a block holds 256 to {BLOCK_DOCS} documents")
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    kind = docs.schema[id_column].dataType
    ddl = (f"block long, id {kind.simpleString()}, slot int, n_a long, n_b long, n_groups long, groups_sha256 string, "
           "pair long, plane int, n int, dense boolean, bits binary")
    return frames.cut(rows.mapInArrow(_align(a_path, b_path, _schema(to_arrow_type(kind)), block_links, block_docs), ddl), "postings")


def _weight():
    return F.expr("shiftleft(1L, greatest(plane - 1, 0))")


def pair_counts(posted: DataFrame) -> DataFrame:
    """pair, docs, links: popcounts of every pair's bitmaps over all blocks; planes count by their power of two."""
    return posted.where("pair is not null").groupBy("pair").agg(
        F.sum(F.when(F.col("plane") == 0, F.col("n")).otherwise(0)).alias("docs"), F.sum(_weight() * F.col("n")).alias("links"))


def pair_scores(counts: DataFrame) -> DataFrame:
    """pair, a_id, b_id, docs, links and top: whether no other A id is linked to the B id more often."""
    parts = counts.withColumn("a_id", F.shiftright("pair", PAIR_SHIFT)).withColumn("b_id", F.col("pair").bitwiseAND((1 << PAIR_SHIFT) - 1))
    most = parts.groupBy("b_id").agg(F.max("links").alias("most"))
    return parts.join(most, "b_id").select("pair", "a_id", "b_id", "docs", "links", (F.col("links") == F.col("most")).alias("top"))


def align(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", a_path: str | None = None, b_path: str | None = None, **limits) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    posted = postings(docs, id_column, text_column, a_path, b_path, **limits)
    scores = pair_scores(frames.cut(pair_counts(posted), "pairs")).select("pair", "links", "top")
    met = posted.where("pair is not null").select("block", "pair", _weight().alias("weight"), "n", "dense", "bits").join(scores, "pair")
    back = met.repartition("block").sortWithinPartitions("block").mapInArrow(_returned, "block long, slot int, n_best long, count_sum long")
    own = posted.where("slot is not null").select("block", "slot", "id", "n_a", "n_b", "n_groups", "groups_sha256")
    zero = F.lit(0).cast("long")
    return own.join(back, ["block", "slot"], "left").select(
        "id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(frames.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
