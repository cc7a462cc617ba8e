"""Best-fit packing by hierarchical residuals: documents into as few sequences as can be.

Pieces are dealt out by a hash of their number, so that every group meets the same mix of lengths. Each
group is packed best-fit, longest piece first. Its nearly full bins are done; an underfull bin becomes an
item of its own, and `fan_in` groups meet in a group of the next round, best-fit again, until one is left.

No two bins of a packed group fit into one another: a bin is opened only where no other has room. So at most
one bin of a group is half full or less, and of the others a round can fill no more than there are such small
bins among its groups. A group therefore hands on its small bin and its `keep` emptiest ones, and what a
task holds is bounded whatever the input: rounds never meet in a task that grows with the documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, new_path
from .tokens import word_ids

PIECES = "key long, doc_id long, piece int, start long, length long, ids_crc32 long"
#: A child item (a piece or a bin) in its bin, and what the bin holds; bins bear the number of their first item.
PLACED = "item long, bin long, offset long, used long, node long, on boolean"


def best_fit(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin of each item, its offset there, and what each bin holds; longest first, each into the fullest bin that has room.

    Bins are kept by the room they have left, as stacks; one bit for each room tells which are not empty, so that the
    least sufficient room is the lowest bit at or above the item's length.
    """
    order = np.argsort(-lengths, kind="stable").tolist()
    sizes = lengths.tolist()
    bins, offsets, used = [0] * len(sizes), [0] * len(sizes), []
    by_room: list[list[int]] = [[] for _ in range(width + 1)]
    rooms = 0
    for i in order:
        size = sizes[i]
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(used), width
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        room -= size
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return np.array(bins, np.int64), np.array(offsets, np.int64), np.array(used, np.int64)


def pieces_of(docs: DataFrame, tokenizer_file: str, width: int, end_id: int) -> DataFrame:
    """A row for each piece: its number, doc_id, piece, start, length, ids_crc32. Texts are tokenized where they are read, and go no further."""

    def run(batches):
        words, tail, number = word_ids(tokenizer_file), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = memoryview(words.encode(text) + tail)
                for piece, at in enumerate(range(0, len(ids), 4 * width)):
                    part = ids[at : at + 4 * width]
                    rows.append((number, doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                    number += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

    return id_and_text(docs).mapInArrow(run, PIECES)


_NAMES = [c.split()[0] for c in PIECES.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def packed_groups(items: DataFrame, width: int, slack: int, keep: int, last: bool = False) -> DataFrame:
    """PLACED of each `node` of items (item, used, node), packed by itself. `on` marks the bins that go to the next round."""

    def run(table: pa.Table) -> pa.Table:
        # the order of arrival is not fixed: that of the numbers is
        table = table.sort_by("item")
        items, sizes = table.column("item").to_numpy(), table.column("used").to_numpy()
        bins, offsets, used = best_fit(sizes, width)
        first = np.zeros(len(used), np.int64)
        first[bins[offsets == 0]] = items[offsets == 0]
        open_bins = np.flatnonzero(used < width - slack) if not last else np.zeros(0, np.int64)
        on = np.zeros(len(used), bool)
        on[open_bins[np.argsort(used[open_bins], kind="stable")[: keep + 1]]] = True
        node = np.full(len(items), table.column("node")[0].as_py(), np.int64)
        return pa.table({"item": items, "bin": first[bins], "offset": offsets, "used": used[bins], "node": node, "on": on[bins]})

    return items.groupBy("node").applyInArrow(run, PLACED)


def pack_best_fit(docs: DataFrame, tokenizer_file: str, width: int = 4096, end_id: int = 1, group: int = 100_000, fan_in: int = 16, slack: int | None = None, keep: int = 64) -> DataFrame:
    """One row a piece: doc_id, piece, start (its document's ids before it), length, ids_crc32, sequence_id, offset.

    A document is the ids of its text and `end_id`; only those of more than `width` ids are cut, every `width` ids. A null
    text is the empty text (a piece of one id); rows that share a doc_id, or have none, are documents of their own;
    an empty table gives no pieces. Other columns are not read. `group` is about how many pieces are packed at once,
    `slack` the room (a hundredth of the width unless given) that a bin may have left and yet is done. sequence_id is the number of the
    sequence's first piece. The rounds, of which there are log(groups) to the base `fan_in`, are written to the shared folder.
    """
    spark, slack = docs.sparkSession, width // 100 if slack is None else slack
    path = new_path(spark, "pieces")
    pieces_of(docs, tokenizer_file, width, end_id).write.parquet(path)
    pieces = spark.read.schema(PIECES).parquet(path)
    short = pieces.where(F.col("length") < width)
    groups = 1 + short.count() // group
    items = short.select(F.col("key").alias("item"), F.col("length").alias("used"), F.pmod(F.xxhash64("key"), F.lit(groups)).alias("node"))
    rounds = []
    while True:
        done = new_path(spark, "bins")
        packed_groups(items, width, slack, keep, last=groups == 1).write.parquet(done)
        rounds.append(spark.read.schema(PLACED).parquet(done))
        if groups == 1:
            break
        items = rounds[-1].where("on AND offset = 0").select(F.col("bin").alias("item"), "used", F.expr(f"node div {fan_in}").alias("node"))
        groups = -(-groups // fan_in)
    # where each item of a round ends up, from the last round to the first
    at = None
    for placed in reversed(rounds):
        here = placed.select("item", "bin", "offset")
        if at is not None:
            above = at.select(F.col("item").alias("bin"), F.col("bin").alias("top"), F.col("offset").alias("before"))
            here = here.join(above, "bin", "left").select("item", F.coalesce("top", "bin").alias("bin"), (F.col("offset") + F.coalesce("before", F.lit(0))).alias("offset"))
        at = here
    found = pieces.join(at.select(F.col("item").alias("key"), "bin", "offset"), "key", "left")
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("bin", "key").alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))


def fill(packed: DataFrame, width: int = 4096) -> DataFrame:
    """One row: sequences, ids, and the least number of sequences that could hold them."""
    return packed.agg(F.count_distinct("sequence_id").alias("sequences"), F.sum("length").alias("ids")).withColumn("least", F.ceil(F.col("ids") / width))
