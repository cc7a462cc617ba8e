"""Substring dedup by content-defined chunks.

A gear hash rolls over a text's bytes: each byte shifts the hash and adds the byte's own number, so the
hash hangs on the last few bytes alone. Where it meets a mask, a chunk ends. An insertion moves
the ends around it and no others, so equal passages fall into equal chunks wherever they stand. Chunks
are compared over the whole table by a 128-bit digest; the first by doc_id and place stays, later ones are
removed where a run of them is long enough to be a passage rather than a common phrase.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

#: Bytes of a chunk: at least, about on average, at most.
LEAST, MEAN, MOST = 20, 52, 192
#: Characters that a run of repeated chunks must cover: more than a line that documents share, less than what is left of 50 words once both ends lie within chunks.
RUN = 100
#: Bits of the hash that must be 0 at an end; the highest of them hangs on 20 bytes.
_TOP_BIT = 19
_WINDOW = 32


def gear_numbers() -> np.ndarray:
    """One 32-bit number a byte value, from a fixed seed."""
    seeded = random.Random(20240229)
    return np.array([seeded.getrandbits(32) for _ in range(256)], np.uint32)


_GEAR = gear_numbers()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: the sum of the last 32 bytes' numbers, each shifted by its distance, in 32 bits."""
    h = _GEAR[data]
    reach = 1
    while reach < _WINDOW:  # the hash over twice as many bytes from two over half
        h[reach:] = h[reach:] + (h[:-reach] << np.uint32(reach))
        reach *= 2
    return h


def cuts_of(data: np.ndarray, hashes: np.ndarray, least: int = LEAST, mean: int = MEAN, most: int = MOST) -> list[int]:
    """Where chunks end, at borders of code points."""
    n = len(data)
    bits = max(1, round(np.log2(max(2, mean - least))))
    mask = np.uint32(((1 << bits) - 1) << (_TOP_BIT - bits + 1))
    border = np.ones(n + 1, bool)
    border[:n] = (data & 0xC0) != 0x80
    ends = np.flatnonzero((hashes & mask) == 0) + 1
    cuts, at = [], 0
    for e in [*ends[border[ends]].tolist(), n]:
        while e - at > most:
            at += most
            while not border[at]:
                at -= 1
            cuts.append(at)
        if e - at >= least or e == n and e > at:
            cuts.append(e)
            at = e
    return cuts


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, begin, end (code points), d1, d2 (the digest)."""

    def run(batches):
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            ids, hashes, texts = batch.column("doc_id"), batch.column("text_hash"), batch.column("text").to_pylist()
            k = 0
            while k < len(texts):
                doc, begin, end, digests, held = [], [], [], [], 0
                while k < len(texts) and held < 1 << 21:
                    raw = texts[k].encode("utf-8", "replace")
                    if raw:
                        data = np.frombuffer(raw, np.uint8)
                        cuts = cuts_of(data, gear_hashes(data))
                        starts = [0, *cuts[:-1]]
                        digests += [digest(raw[a:b]) for a, b in zip(starts, cuts, strict=True)]
                        places = np.array([0, *cuts], np.int64)
                        if len(raw) != len(texts[k]):
                            places = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[places]
                        doc.append(np.full(len(cuts), k))
                        begin.append(places[:-1])
                        end.append(places[1:])
                        held += len(raw)
                    k += 1
                if doc:
                    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                    row = pa.array(np.concatenate(doc))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(row), hashes.take(row), *(pa.array(np.concatenate(x).astype(np.int32)) for x in (begin, end)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())],
                        names=["doc_id", "text_hash", "begin", "end", "d1", "d2"],
                    )

    return _keyed(docs).mapInArrow(run, "doc_id long, text_hash int, begin int, end int, d1 long, d2 long")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and 32 bits of a hash of the text, which keep rows apart that share a doc_id."""
    return id_and_text(docs).withColumn("text_hash", F.shiftright(F.xxhash64("text"), 32).cast("int"))


def repeated_runs(docs: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, text_hash, begins, ends: the stretches of consecutive later chunks that cover `run` characters or more.

    Partial counts meet a digest once a task, and the join with the repeated ones is one that Spark can
    split where a digest is hot. Rows with a null doc_id are left out.
    """
    every = chunks(docs.where("doc_id IS NOT NULL"))
    place = F.struct("doc_id", "text_hash", "begin")
    first = every.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    later = every.join(first, ["d1", "d2"]).where(place != F.col("first")).select("doc_id", "text_hash", F.struct("begin", "end").alias("c"))
    by_doc = later.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("c")).alias("c"))
    # a run begins at a chunk that does not follow on the one before, and ends where the next one does not follow
    c = F.col("c")
    begins = F.transform(F.filter(c, lambda x, i: (i == 0) | (F.get(c, i - 1)["end"] != x["begin"])), lambda x: x["begin"])
    ends = F.transform(F.filter(c, lambda x, i: (i == F.size(c) - 1) | (F.get(c, i + 1)["begin"] != x["end"])), lambda x: x["end"])
    runs = by_doc.select("doc_id", "text_hash", F.arrays_zip(begins.alias("begin"), ends.alias("end")).alias("r"))
    return runs.select("doc_id", "text_hash", F.filter("r", lambda r: r["end"] - r["begin"] >= run).alias("runs")).where(F.size("runs") > 0)


def remove_repeated_chunks(docs: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, text without later copies of passages, runs (what was removed, as code points); a row for each row of `docs`.

    A null text is the empty text; a text of fewer than `run` characters stays as it is, and so do rows
    without a doc_id. Rows with equal doc_id and text are one document and are cut alike; rows that share
    a doc_id alone are documents of their own, which follow each other by a hash of their texts. Other
    columns are not read; an empty table gives an empty one.
    """
    joined = _keyed(docs).join(repeated_runs(docs, run), ["doc_id", "text_hash"], "left").select("doc_id", "text", "runs")

    def cut(batches):
        for batch in batches:
            kept = []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                at, pieces = 0, []
                for r in runs or ():
                    pieces.append(text[at : r["begin"]])
                    at = r["end"]
                kept.append("".join([*pieces, text[at:]]) if runs else text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.string()), batch.column("runs")], names=["doc_id", "text", "runs"])

    none = F.array().cast("array<struct<begin:int,end:int>>")
    out = joined.withColumn("runs", F.coalesce("runs", none).cast("array<struct<begin:int,end:int>>"))
    return out.mapInArrow(cut, "doc_id long, text string, runs array<struct<begin:int,end:int>>")
