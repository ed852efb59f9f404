"""Trie of conversation prefixes, screened by a count-min sketch of prefix digests.

1. Order.  Turns are sorted over all tasks by conversation, number (nulls first), role and digest,
   and numbered from counts per task, so that one long conversation lies in many tasks.
2. Rebuild.  Conversation c takes the first h turns of conversation c - c % 100 (as many as there
   are) and its own turns from the h-th on; h is crc32 of the decimal c, modulo 6.  The remainder of
   a negative c is negative, as in SQL.
3. Digests.  128 bits of SHA-256 name every prefix: turns are chained inside blocks of ``BLOCK``
   places, and a block's links are joined with the digest of the prefix before the block.  Blocks
   are chained side by side, so a long conversation is no chain in one task.
4. Screening.  A count-min sketch of four rows counts all prefix digests; its cells stop at two and
   ``MAX_WIDTH`` bounds its size to 16 MB, whatever the input.  An estimate of one proves that a
   prefix has one member: its node is final where it stands.  Only prefixes that may be shared are
   shuffled; too small a sketch lets more of them through and changes no result.
5. Exact nodes.  Possibly shared prefixes are grouped by digest.  Every node belongs to its smallest
   member, and a conversation owns the nodes of its path from one depth on.  What it owns lies below
   every node that it only passes, so sums over subtrees are sums over members: no walk by depth.
6. Ends.  Ids that end at a node are joined to strings by tasks that hold neighbouring ids; a node's
   strings then pass through one SHA-256 in order.

Results in special cases: a null role or text is empty; rows with a null conv_id are no conversation
and are dropped; turns with equal numbers follow by role, then by the SHA-256 of role and text;
repeated rows are turns of their own; conversations whose turns are all replaced by none end at the
root; an empty table has no node, not even a root; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalytics.llm import frames

BLOCK = 1024                         # places chained in one task
ROWS = 4                             # of the sketch
MAX_WIDTH = 1 << 22                  # cells in a row, a byte each: 16 MB in all
_TILE = 1 << 16                      # cells merged by one task
_IDS = 1 << 16                       # ids joined to one string
_EMPTY = hashlib.sha256(b"").hexdigest()


def _digest(*parts: Column) -> Column:
    """The first 128 bits of SHA-256, as bytes."""
    return F.unhex(F.substring(F.sha2(F.concat(*(p.cast("binary") for p in parts)), 256), 1, 32))


def _short(body: bytes) -> bytes:
    return hashlib.sha256(body).digest()[:16]


# ---- turns in order ----

def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number a task's sorted rows within each conversation."""
    task, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column("conv").to_numpy()
        if not len(conv):
            continue
        new = np.flatnonzero(np.diff(conv, prepend=conv[0])) if len(conv) > 1 else np.zeros(0, int)
        begin = np.concatenate([[0], new])
        size = np.diff(np.append(begin, len(conv)))
        place = np.arange(len(conv)) - np.repeat(begin, size)
        if last is not None and conv[0] == last:
            place[:size[0]] += seen
        last, seen = conv[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(conv), task, np.int32)), batch.column("conv"), pa.array(place), batch.column("turn_digest"),
                                          batch.column("n_chars")], ["task", "conv", "place", "turn_digest", "n_chars"])


def ordered_turns(turns: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text"
                  ) -> tuple[DataFrame, DataFrame]:
    """conv, i (place from 0), turn_digest, n_chars of every turn; conv, n_own of every conversation."""
    role, body = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in (role_column, text_column))
    rows = turns.select(turns[conv_column].cast("long").alias("conv"), turns[turn_column].alias("turn"), role.alias("role"),
                        _digest(F.octet_length(role).cast("string"), F.lit(":"), role, body).alias("turn_digest"),
                        F.length(body).cast("long").alias("n_chars"), F.rand(7).alias("any")).where("conv is not null")
    keys = ["conv", "turn", "role", "turn_digest", "any"]          # the last one parts rows that are alike
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "turn_digest", "n_chars")
    placed = frames.cut(placed.mapInArrow(_numbered, "task int, conv long, place long, turn_digest binary, n_chars long"), "turns")
    held = frames.cut(placed.groupBy("task", "conv").agg(F.count(F.lit(1)).alias("n")), "held")
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    # a task's first conversation is the only one that others before it can hold: at most a row per task
    offsets = held.withColumn("offset", before).where("offset > 0").select("task", "conv", "offset")
    numbered = placed.join(F.broadcast(offsets), ["task", "conv"], "left")
    return (numbered.select("conv", (F.col("place") + F.coalesce("offset", F.lit(0))).alias("i"), "turn_digest", "n_chars"),
            held.groupBy("conv").agg(F.sum("n").alias("n_own")))


def rebuilt(numbered: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv, n (turns) of every conversation; conv, n, pos, turn_digest, n_chars of every rebuilt turn."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    heads = numbered.where("conv % 100 = 0 and i < 5").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("i", "turn_digest", "n_chars"))).alias("all"))
    convs = sizes.select("conv", "n_own", h.alias("h"), (F.col("conv") - F.col("conv") % 100).alias("base"))
    convs = convs.join(heads.withColumnRenamed("conv", "base"), "base", "left")
    convs = convs.withColumn("head", F.slice(F.coalesce("all", F.array().cast("array<struct<i:bigint,turn_digest:binary,n_chars:bigint>>")), F.lit(1), F.col("h").cast("int")))
    convs = convs.select("conv", "h", "head", F.size("head").cast("long").alias("taken"),
                         (F.size("head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).cast("long").alias("n"))
    convs = frames.cut(convs, "convs")
    first = convs.select("conv", "n", F.posexplode("head").alias("pos", "t")).select("conv", "n", F.col("pos").cast("long").alias("pos"), "t.turn_digest", "t.n_chars")
    own = numbered.where(F.col("i") >= h).join(convs.select("conv", "n", "h", "taken"), "conv")
    own = own.select("conv", "n", (F.col("taken") + F.col("i") - F.col("h")).alias("pos"), "turn_digest", "n_chars")
    return convs.select("conv", "n"), first.unionByName(own)


# ---- digests of prefixes ----

def _chained(block: int):
    """Chain the turns of each (conversation, block), sorted, which may go on in the next batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, link = None, b""
        for batch in batches:
            links, before = [], []
            for conv, pos, turn in zip(*(batch.column(c).to_pylist() for c in ("conv", "pos", "turn_digest"))):
                if key != (conv, pos // block):
                    key, link = (conv, pos // block), b""
                before.append(link)
                link = _short(link + turn)
                links.append(link)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "n", "pos", "n_chars")), pa.array(links, pa.binary()), pa.array(before, pa.binary())],
                                             ["conv", "n", "pos", "n_chars", "link", "last"])
    return run


def _joined_blocks(block: int):
    """For the last links of a conversation's blocks, in order: digest of the prefix before each next block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, before = None, b""
        for batch in batches:
            out = []
            for conv, link in zip(batch.column("conv").to_pylist(), batch.column("link").to_pylist()):
                before = _short(before + link) if conv == key else link
                key = conv
                out.append(before)
            number = pa.array((batch.column("pos").to_numpy() + 1) // block)
            yield pa.RecordBatch.from_arrays([batch.column("conv"), number, pa.array(out, pa.binary())], ["conv", "block", "before"])
    return run


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv, n, depth, digest, prev (digest of the prefix one shorter; the root's is empty), n_chars (of the last text)."""
    number = F.floor(F.col("pos") / block)
    dealt = turns.withColumn("block", number).repartition("conv", "block").sortWithinPartitions("conv", "pos").drop("block")
    links = frames.cut(dealt.mapInArrow(_chained(block), "conv long, n long, pos long, n_chars long, link binary, last binary"), "links")
    ends = links.where(((F.col("pos") + 1) % block == 0) & (F.col("pos") + 1 < F.col("n"))).select("conv", "pos", "link")
    before = ends.repartition("conv").sortWithinPartitions("conv", "pos").mapInArrow(_joined_blocks(block), "conv long, block long, before binary")
    met = links.where(F.col("pos") >= block).withColumn("block", number).join(before, ["conv", "block"])
    later = met.select("conv", "n", "pos", "n_chars", _digest(F.col("before"), F.col("link")).alias("digest"),
                       F.when(F.length("last") == 0, F.col("before")).otherwise(_digest(F.col("before"), F.col("last"))).alias("prev"))
    both = links.where(F.col("pos") < block).select("conv", "n", "pos", "n_chars", F.col("link").alias("digest"), F.col("last").alias("prev")).unionByName(later)
    return frames.cut(both.select("conv", "n", (F.col("pos") + 1).alias("depth"), "digest", "prev", "n_chars"), "prefixes")


# ---- count-min sketch ----

def _cells(digests: pa.Array, width: int) -> np.ndarray:
    """Cells of each digest, one in each row of the sketch."""
    half = np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 2)
    rows = np.arange(ROWS, dtype=np.uint64)[:, None]
    return ((half[:, 0] + rows * (half[:, 1] | np.uint64(1))) % np.uint64(width) + rows * np.uint64(width)).astype(np.int64)


def _counted(cells: np.ndarray, held: np.ndarray) -> None:
    """Add cells to counts that stop at two."""
    at, n = np.unique(cells, return_counts=True)
    held[at] = np.minimum(held[at] + np.minimum(n, 2), 2)


def _task_sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(ROWS * width, np.uint8)
        for batch in batches:
            if len(batch):
                _counted(_cells(batch.column("digest"), width).ravel(), held)
        tiles, parts = [], []
        for tile in range(-(-len(held) // _TILE)):
            part = held[tile * _TILE:(tile + 1) * _TILE]
            if part.any():
                once, twice = (np.flatnonzero(part == k).astype("<u2").tobytes() for k in (1, 2))
                tiles.append(tile)
                parts.append((once, twice))
        if tiles:
            yield pa.RecordBatch.from_arrays([pa.array(tiles, pa.int32()), *(pa.array(x, pa.binary()) for x in zip(*parts))], ["tile", "once", "twice"])
    return run


def _merged_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of all tasks, sorted by tile, added up."""
    tile, held = None, np.zeros(_TILE, np.uint8)

    def done():
        return pa.RecordBatch.from_arrays([pa.array([tile], pa.int32()), pa.array([held.tobytes()], pa.binary())], ["tile", "cells"])

    for batch in batches:
        for k, once, twice in zip(*(batch.column(c).to_pylist() for c in ("tile", "once", "twice"))):
            if k != tile:
                if tile is not None:
                    yield done()
                tile = k
                held[:] = 0
            held[np.frombuffer(twice, "<u2")] = 2
            at = np.frombuffer(once, "<u2")
            held[at] = np.minimum(held[at] + 1, 2)
    if tile is not None:
        yield done()


def sketch(prints: DataFrame, width: int) -> np.ndarray:
    """Counts (0, 1, or 2 for more) of all prefix digests in four rows of ``width`` cells; at most ROWS * MAX_WIDTH bytes reach the driver."""
    parts = prints.select("digest").mapInArrow(_task_sketch(width), "tile int, once binary, twice binary")
    tiles = parts.repartition("tile").sortWithinPartitions("tile").mapInArrow(_merged_tiles, "tile int, cells binary")
    out = np.zeros(max(ROWS * width, _TILE), np.uint8)
    for r in tiles.collect():
        out[r.tile * _TILE:(r.tile + 1) * _TILE] = np.frombuffer(r.cells, np.uint8)
    return out[:ROWS * width]


def _screened(held, width: int):
    def shared(digests: pa.Array, counts: np.ndarray) -> np.ndarray:
        return counts[_cells(digests, width)].min(axis=0) > 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(held.value, np.uint8)
        for batch in batches:
            if not len(batch):
                continue
            below = np.ones(len(batch), bool)                      # the root is shared by all
            inner = np.flatnonzero(batch.column("depth").to_numpy() > 1)
            if len(inner):
                below[inner] = shared(batch.column("prev").take(pa.array(inner)), counts)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "n", "depth", "digest", "n_chars")),
                                              pa.array(shared(batch.column("digest"), counts)), pa.array(below)],
                                             ["conv", "n", "depth", "digest", "n_chars", "shared", "prev_shared"])
    return run


def screen(prints: DataFrame, total: int, max_width: int = MAX_WIDTH) -> DataFrame:
    """Prefixes with ``shared`` and ``prev_shared``: false proves one member."""
    width = 1 << 10
    while width < min(4 * total, max_width):
        width *= 2
    held = prints.sparkSession.sparkContext.broadcast(sketch(prints, width).tobytes())
    return prints.mapInArrow(_screened(held, width), "conv long, n long, depth long, digest binary, n_chars long, shared boolean, prev_shared boolean")


# ---- exact nodes ----

def _id_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join the sorted ids of each digest to strings of at most ``_IDS`` ids."""
    key, ids, rows = None, [], []
    for batch in batches:
        for digest, conv in zip(batch.column("digest").to_pylist(), batch.column("conv").to_pylist()):
            if digest != key or len(ids) == _IDS:
                if ids:
                    rows.append((key, ids[0], ",".join(map(str, ids))))
                key, ids = digest, []
            ids.append(conv)
        if rows:
            yield _string_batch(rows)
            rows = []
    if ids:
        yield _string_batch([(key, ids[0], ",".join(map(str, ids)))])


def _string_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.binary(), pa.int64(), pa.string()))], ["digest", "first", "ids"])


def _hashed_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over each digest's strings in order, joined by commas."""
    key, state, out = None, None, []

    def done():
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([s for _, s in out], pa.string())], ["digest", "ends"])

    for batch in batches:
        for digest, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist()):
            if digest == key:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                out.append((key, state.hexdigest()))
            key, state = digest, hashlib.sha256(ids.encode())
        if out:
            yield done()
            out = []
    if state is not None:
        out.append((key, state.hexdigest()))
        yield done()


def _ends(members: DataFrame) -> DataFrame:
    """digest, ends: SHA-256 of the ids (rows digest, conv) of each digest."""
    strings = members.repartitionByRange("digest", "conv").sortWithinPartitions("digest", "conv").mapInArrow(_id_strings, "digest binary, first long, ids string")
    strings = frames.cut(strings, "ends")
    return strings.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(_hashed_strings, "digest binary, ends string")


def _below(nodes: DataFrame, block: int) -> DataFrame:
    """rep, depth, owned_below: what a node and the nodes deeper on its owner's path save."""
    value = nodes.select("rep", "depth", F.floor(F.col("depth") / block).alias("block"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("v"))
    inside = value.withColumn("inside", F.sum("v").over(Window.partitionBy("rep", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)))
    blocks = value.groupBy("rep", "block").agg(F.sum("v").alias("v"))
    deeper = F.sum("v").over(Window.partitionBy("rep").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("rep", "block", F.coalesce(deeper, F.lit(0)).alias("deeper"))
    return inside.join(blocks, ["rep", "block"]).select("rep", "depth", (F.col("inside") + F.col("deeper")).alias("owned_below"))


def trie(turns: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text",
         max_width: int = MAX_WIDTH, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    convs, parts = rebuilt(*ordered_turns(turns, conv_column, turn_column, role_column, text_column))
    root_conv, total = convs.agg(F.min("conv"), F.sum("n")).first()
    prints = prefixes(parts, block)
    screened = screen(prints, total or 0, max_width)
    long = lambda c: c.cast("long")
    zero, one, root = long(F.lit(0)), long(F.lit(1)), long(F.lit(root_conv))

    shared = frames.cut(screened.where("shared").drop("shared", "prev_shared"), "shared")
    nodes = frames.cut(shared.groupBy("digest").agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.min("depth").alias("depth"),
                                                     F.min("n_chars").alias("n_chars"), F.sum(long(F.col("depth") == F.col("n"))).alias("n_end")), "nodes")
    members = frames.cut(shared.select("conv", "n", "digest").join(nodes, "digest"), "members")
    mine = F.col("rep") == F.col("conv")
    # a conversation owns what follows the prefixes that it shares with a smaller one
    facts = members.groupBy("conv").agg(
        (F.sum(long(~mine)) + 1).alias("top"), F.max(F.when(~mine, F.struct("depth", "rep")))["rep"].alias("above"),
        F.sum(F.when(mine, (F.col("n_convs") - 1) * F.col("n_chars")).otherwise(0)).alias("owned"),
        F.coalesce(F.max(F.when(F.col("depth") == F.col("n"), long(mine & (F.col("n_end") == F.col("n_convs"))))), one).alias("leaf"))
    facts = frames.cut(facts.select("conv", "top", F.coalesce("above", root).alias("above"), "owned", "leaf"), "facts")

    passing = members.join(facts, "conv")
    sums = passing.groupBy("digest", "rep", "depth", "n_convs").agg(
        F.max(F.when(mine, F.when(F.col("depth") > F.col("top"), F.col("conv")).otherwise(F.col("above")))).alias("parent"),
        F.sum(long((F.col("n") > F.col("depth")) & (mine | (F.col("top") == F.col("depth") + 1)))).alias("n_children"),
        F.sum("leaf").alias("n_leaves"), F.sum(F.when(mine, zero).otherwise(F.col("owned"))).alias("owned_by_others"))
    ended = members.where("depth = n").select("digest", "conv").unionByName(convs.where("n = 0").select(F.lit(b"").alias("digest"), "conv"))
    ends = frames.cut(_ends(ended), "hashes")
    exact = sums.join(_below(nodes, block), ["rep", "depth"]).join(ends, "digest", "left").select(
        F.col("rep").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (F.col("owned_by_others") + F.col("owned_below")).alias("saved_tokens"), F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256"))

    single = screened.where("not shared")
    head = single.where("prev_shared").join(facts.select("conv", "top", "above"), "conv", "left")
    parent = F.when(F.col("depth") > F.coalesce("top", one), F.col("conv")).otherwise(F.coalesce("above", root))
    last = F.col("depth") == F.col("n")

    def alone(rows: DataFrame, parent: Column) -> DataFrame:
        return rows.select(F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), one.alias("n_convs"), long(~last).alias("n_children"),
                           one.alias("n_leaves"), zero.alias("saved_tokens"),
                           F.when(last, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(_EMPTY).alias("ends_sha256"))

    top = convs.join(facts, "conv", "left")
    below = long((F.col("n") > 0) & ((F.col("conv") == root) | (F.coalesce("top", one) == 1)))
    top = top.agg(F.count(F.lit(1)).alias("n_convs"), F.sum(below).alias("n_children"), F.sum(F.coalesce("leaf", long(F.col("n") > 0))).alias("leaves"),
                  F.sum(F.coalesce("owned", zero)).alias("saved_tokens")).where("n_convs > 0").withColumn("digest", F.lit(b""))
    top = top.join(ends, "digest", "left").select(
        root.alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        F.when(F.col("n_children") == 0, one).otherwise(F.col("leaves")).alias("n_leaves"), "saved_tokens", F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256"))
    return exact.unionByName(alone(single.where("not prev_shared"), F.col("conv"))).unionByName(alone(head, parent)).unionByName(top)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(frames.table(spark, sf_dir, "conversations"))
