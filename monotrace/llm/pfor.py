"""Token-id files in patched frame-of-reference blocks.

Ids are cut into blocks of 128. A block stores its minimum, the low `width` bits of each id above
that minimum, and a list of exceptions: positions and remaining high bits of ids that need more.
`width` is the bit length that `percentile` of the block's ids do not exceed. Blocks fill segments,
the unit that a reader loads; in a segment, in this order, all little-endian:

    4 bytes magic, then uint32 version, documents, ids, block size, blocks, exceptions
    int64 doc_id of each document; uint8 whether that is null; uint32 ids of each document
    uint32 start of each block's packed bits, and the end of the last
    uint32 minimum, uint8 width, uint8 exceptions of each block
    uint8 position of each exception; uint32 high bits of each exception
    the packed bits; uint32 crc32 of all before it

Segments are rows of a Parquet table, so any store that Spark writes to can hold them.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_and_text
from .tokens import word_ids

MAGIC, VERSION, BLOCK = b"PFOR", 1, 128
SEGMENTS = "part long, segment long, first_id long, n_docs long, n_ids long, data binary"


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bits of each value, one after the other from the lowest bit of the first byte; a row for each row."""
    if width > 16:
        bits = ((values[:, :, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8)
        return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")
    # eight values are `width` bytes: four make a word of at most 64 bits, two such words the bytes
    w = np.uint64(width)
    eight = (values & np.uint32((1 << width) - 1)).astype(np.uint64).reshape(-1, 2, 4)
    four = eight[:, :, 0] | eight[:, :, 1] << w | eight[:, :, 2] << w * np.uint64(2) | eight[:, :, 3] << w * np.uint64(3)
    if width < 16:
        low, high = four[:, 0], four[:, 1]
        four = np.stack((low | high << np.uint64(4 * width), high >> np.uint64(64 - 4 * width)), axis=1)
    return four.astype("<u8").view(np.uint8).reshape(-1, 16)[:, :width].reshape(len(values), -1)


def unpack_bits(packed: np.ndarray, width: int) -> np.ndarray:
    """The values that pack_bits packed, a row for each row."""
    if width > 16:
        flat = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(packed), -1, width)
        whole = np.zeros((*flat.shape[:2], 32), np.uint8)
        whole[:, :, :width] = flat
        return np.packbits(whole, axis=2, bitorder="little").view("<u4")[:, :, 0]
    eight = np.zeros((packed.size // width, 16), np.uint8)
    eight[:, :width] = packed.reshape(-1, width)
    four = eight.view("<u8")
    if width < 16:
        four[:, 1] = four[:, 0] >> np.uint64(4 * width) | four[:, 1] << np.uint64(64 - 4 * width)
    shifts = np.arange(4, dtype=np.uint64) * np.uint64(width)
    return ((four[:, :, None] >> shifts) & np.uint64((1 << width) - 1)).astype(np.uint32).reshape(len(packed), -1)


def encode_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, percentile: float = 0.9) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    square = np.empty(blocks * BLOCK, np.uint32)
    square[:n] = ids
    square[n:] = ids[-1] if n else 0
    square = square.reshape(blocks, BLOCK)
    low = square.min(axis=1) if blocks else np.zeros(0, np.uint32)
    above = square - low[:, None]
    bits = np.frexp(above.astype(np.float64))[1].astype(np.uint8)  # bit length, 0 for 0
    rank = max(0, int(np.ceil(percentile * BLOCK)) - 1)
    width = np.partition(bits, rank, axis=1)[:, rank] if blocks else np.zeros(0, np.uint8)
    starts = np.concatenate(([0], np.cumsum(width.astype(np.int64) * (BLOCK // 8))))
    packed = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width).tolist():
        if w:
            rows = np.flatnonzero(width == w)
            packed[(starts[rows, None] + np.arange(w * BLOCK // 8)).ravel()] = pack_bits(above[rows], w).ravel()
    row, col = np.nonzero(bits > width[:, None]) if blocks else (np.zeros(0, int), np.zeros(0, int))
    high = above[row, col] >> width[row].astype(np.uint32)
    body = b"".join(
        [
            MAGIC,
            struct.pack("<6I", VERSION, len(doc_ids), n, BLOCK, blocks, len(row)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            np.asarray(lengths, "<u4").tobytes(),
            starts.astype("<u4").tobytes(),
            low.astype("<u4").tobytes(),
            width.astype(np.uint8).tobytes(),
            np.bincount(row, minlength=blocks).astype(np.uint8).tobytes(),
            col.astype(np.uint8).tobytes(),
            high.astype("<u4").tobytes(),
            packed.tobytes(),
        ]
    )
    return body + struct.pack("<I", zlib.crc32(body))


def decode_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids of each document, and the ids one after the other."""
    if data[:4] != MAGIC or struct.unpack("<I", data[-4:])[0] != zlib.crc32(memoryview(data)[:-4]):
        raise ValueError("not a whole segment")
    version, docs, n, block, blocks, exceptions = struct.unpack_from("<6I", data, 4)
    if version != VERSION:
        raise ValueError(f"version {version} is not known")
    at = 28

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(data, kind, count, at)
        at += got.nbytes
        return got

    doc_ids, is_null, lengths = take("<i8", docs), take("u1", docs), take("<u4", docs)
    starts, low, width, counts = take("<u4", blocks + 1).astype(np.int64), take("<u4", blocks), take("u1", blocks), take("u1", blocks)
    col, high = take("u1", exceptions), take("<u4", exceptions)
    packed = take("u1", int(starts[-1]))
    out = np.zeros((blocks, block), np.uint32)
    for w in np.unique(width).tolist():
        if w:
            rows = np.flatnonzero(width == w)
            out[rows] = unpack_bits(packed[(starts[rows, None] + np.arange(w * block // 8)).ravel()].reshape(len(rows), -1), w)
    row = np.repeat(np.arange(blocks), counts)
    out[row, col] |= high << width[row].astype(np.uint32)
    out += low[:, None]
    return [None if z else int(d) for d, z in zip(doc_ids, is_null, strict=True)], lengths, out.reshape(-1)[:n]


def write_ids(docs: DataFrame, tokenizer_file: str, path: str, end_id: int = 1, segment: int = 1 << 18, percentile: float = 0.9) -> None:
    """Writes the ids of every text, `end_id` after each, in ascending doc_id.

    A null text is the empty text; rows that share a doc_id are documents of their own; null ids come
    first; an empty table gives files without segments. Other columns are not read.
    """
    sorted_docs = id_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        words, tail = word_ids(tokenizer_file), np.array([end_id], "<u4").tobytes()
        part, number, first = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def flush():
            nonlocal number, first, doc_ids, parts, held
            lengths = np.array([len(p) // 4 for p in parts], np.uint32)
            data = encode_segment(doc_ids, lengths, np.frombuffer(b"".join(parts), "<u4"), percentile)
            out = pa.RecordBatch.from_pydict({"part": [part], "segment": [number], "first_id": [first], "n_docs": [len(doc_ids)], "n_ids": [held], "data": [data]})
            number, first = number + 1, first + held
            doc_ids, parts, held = [], [], 0
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts.append(words.encode(text) + tail)
                doc_ids.append(doc_id)
                held += len(parts[-1]) // 4
                if held >= segment:
                    yield flush()
        if doc_ids:
            yield flush()

    sorted_docs.mapInArrow(run, SEGMENTS).write.mode("overwrite").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document of the files: doc_id, start (ids of all documents before it), ids (uint32, as binary).

    What lies before a part is summed over one row a part, of which there are as many as tasks wrote
    the files; that small table is what the broadcast holds.
    """
    segments = spark.read.parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))

    def run(batches):
        for batch in batches:
            for part, first, data in zip(*(batch.column(c).to_pylist() for c in ("part", "first_id", "data")), strict=True):
                doc_ids, lengths, ids = decode_segment(data)
                ends = np.cumsum(lengths, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(doc_ids), pa.int64()),
                        pa.array(doc_ids, pa.int64()),
                        pa.array(first + ends - lengths),
                        pa.array([ids[a:b].tobytes() for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)], pa.binary()),
                    ],
                    names=["part", "doc_id", "start_in_part", "ids"],
                )

    docs = segments.select("part", "first_id", "data").mapInArrow(run, "part long, doc_id long, start_in_part long, ids binary")
    return docs.join(F.broadcast(before), "part").select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "ids")


def digest(read: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of documents read back."""
    return read.select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
