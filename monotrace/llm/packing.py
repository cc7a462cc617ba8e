"""Packing: documents cut into training sequences by an order-preserving dynamic programme.

The ids of all documents, in ascending doc_id, form one stream, which is cut into windows of at most
`width` ids. Cuts may fall where a document ends (free), where a sentence ends (`sentence_penalty`)
or, in stretches without such a place, every `stride` ids (`split_penalty`). With p the positions of
these places, the least cost of the stream up to p[j] is

    f(j) = min over i, p[j] - p[i] <= width, of f(i) + (width - p[j] + p[i]) + penalty(j)

(no padding counts where the length is one of `exact`). The term f(i) + p[i] does not hang on j, so
a monotone queue gives each minimum in constant time.

Each range of doc_id is one task, which cuts its stream `segment` ids at a time and hands the last
window of a segment on to the next, so that memory stays bounded.
"""

from __future__ import annotations

import functools
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text
from .tokens import word_ids

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def plan_cuts(places: np.ndarray, penalties: np.ndarray, width: int, exact: tuple[int, ...] = ()) -> list[int]:
    """The places of least total cost, first and last included; neighbours in `places` are at most `width` apart."""
    p, pen = places.tolist(), penalties.tolist()
    without_padding: dict[int, list[int]] = {}
    for length in exact:
        i = np.searchsorted(places, places - length)
        for j in np.flatnonzero(places[i] == places - length).tolist():
            without_padding.setdefault(j, []).append(int(i[j]))
    cost, back = [0.0] * len(p), [0] * len(p)
    queue = deque([0])
    keys = [0.0] * len(p)
    keys[0] = p[0]
    for j in range(1, len(p)):
        end = p[j]
        while p[queue[0]] < end - width:
            queue.popleft()
        i = queue[0]
        least = keys[i] + width - end
        for k in without_padding.get(j, ()):
            if cost[k] < least:
                i, least = k, cost[k]
        back[j] = i
        cost[j] = least = least + pen[j]
        keys[j] = key = least + end
        while queue and keys[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(p) - 1
    while j:
        cuts.append(p[j])
        j = back[j]
    return [p[0], *reversed(cuts)]


@functools.lru_cache(maxsize=2)
def sentence_ends(path: str) -> np.ndarray:
    """For each id of a tokenizer file whether its text ends a sentence or a line."""
    from tokenizers import Tokenizer

    file = Tokenizer.from_file(path)
    vocabulary = file.get_vocab(with_added_tokens=True)
    ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
    for text, k in vocabulary.items():
        ends[k] = text.removesuffix("</w>").endswith((".", "!", "?", "Ċ", "\n"))
    return ends


def places_of(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, stride: int, sentence_penalty: float, split_penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Where a stream may be cut, and what each cut costs."""
    sentences = np.flatnonzero(ends[np.minimum(ids, len(ends) - 1)]) + 1
    known = np.unique(np.concatenate(([0], sentences, doc_ends)))
    gaps = np.diff(known)
    extra = (gaps - 1) // stride
    wide = np.flatnonzero(extra > 0)
    counts = extra[wide]
    steps = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + 1
    splits = np.repeat(known[wide], counts) + steps * stride
    places = np.concatenate((known, splits))
    order = np.argsort(places, kind="stable")
    penalties = np.concatenate((np.full(len(known), float(sentence_penalty)), np.full(len(splits), float(split_penalty))))[order]
    places = places[order]
    penalties[np.searchsorted(places, doc_ends)] = 0.0
    return places, penalties


def pack_documents(
    docs: DataFrame,
    tokenizer_file: str,
    width: int = 1024,
    end_id: int = 0,
    sentence_penalty: float = 1.0,
    split_penalty: float = 3.0,
    stride: int = 32,
    exact: tuple[int, ...] | None = None,
    segment: int = 1 << 20,
) -> DataFrame:
    """One row a piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document, and `end_id` after it, lies in exactly one piece. A null text is the
    empty text (a piece of one id); rows that share a doc_id are documents of their own, next to each
    other; null ids come first; an empty table gives no pieces. Other columns are not read.
    sequence_id is unique and ascends with the documents, but leaves gaps between ranges of doc_id. Windows
    of `exact` lengths need no padding: every power of two below `width`, unless others are given.
    """
    exact = tuple(1 << k for k in range((width - 1).bit_length())) if exact is None else exact
    sorted_docs = id_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        words, ends = word_ids(tokenizer_file), sentence_ends(tokenizer_file)
        tail = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 32
        parts: list[bytes] = []
        meta: list[tuple] = []  # doc_id, its ids in all, its ids before this part, ids in this part
        held = 0

        def flush(last: bool):
            nonlocal sequence, parts, meta, held
            if not meta:
                return None
            ids = np.frombuffer(b"".join(parts), "<u4")
            lengths = np.array([m[3] for m in meta], np.int64)
            doc_ends = np.cumsum(lengths)
            cuts = np.array(plan_cuts(*places_of(ids, doc_ends, ends, stride, sentence_penalty, split_penalty), width, exact), np.int64)
            if not last and len(cuts) > 2:
                cuts = cuts[:-1]
            stop = int(cuts[-1])
            edges = np.unique(np.concatenate((cuts, doc_ends[doc_ends < stop])))
            begin, length = edges[:-1], np.diff(edges)
            doc = np.searchsorted(doc_ends, begin, "right")
            window = np.searchsorted(cuts, begin, "right") - 1
            before = np.array([m[2] for m in meta], np.int64)
            raw = memoryview(ids).cast("B")
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([meta[d][0] for d in doc.tolist()], pa.int64()),
                    pa.array(begin - (doc_ends - lengths)[doc] + before[doc]),
                    pa.array(length),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.int64()),
                    pa.array(np.array([m[1] for m in meta], np.int64)[doc]),
                    pa.array(sequence + window),
                    pa.array(begin - cuts[window]),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )
            sequence += len(cuts) - 1
            first = int(np.searchsorted(doc_ends, stop, "right"))
            rest = [list(m) for m in meta[first:]]
            if rest:
                done = stop - int(doc_ends[first] - lengths[first])
                rest[0][2] += done
                rest[0][3] -= done
            meta, parts, held = [tuple(m) for m in rest], [ids[stop:].tobytes()], len(ids) - stop
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                got = words.encode(text) + tail
                n = len(got) // 4
                parts.append(got)
                meta.append((doc_id, n, 0, n))
                held += n
                if held >= segment:
                    yield flush(False)
        if (out := flush(True)) is not None:
            yield out

    return sorted_docs.mapInArrow(run, SCHEMA)


def padding(pieces: DataFrame, width: int = 1024) -> DataFrame:
    """Sequences, ids and padding of packed pieces; a sequence whose length is a power of two needs none."""
    lengths = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    exact = F.expr("bit_count(n) = 1")
    return lengths.agg(F.count("*").alias("sequences"), F.sum("n").alias("ids"), F.sum(F.when(exact, 0).otherwise(width - F.col("n"))).alias("padding"))
