"""Alignment of two tokenizers over the bytes of each text.

The ends of both tokenizers' tokens are marked in packed bitsets over the bytes of a batch of texts, 64
to a word. Where both bits are set (AND) both cut, and the tokens between two such cuts are a group. Every bit that
is set in either (OR) ends a stretch that one token of each side covers: a link. How many bits of a side
lie before a byte, from counts a word and the bits below in its own, is the number of the token that covers
it; so cuts become ranges of tokens and stretches pairs of them, without a loop over tokens.

Id pairs are counted by documents over the whole corpus: each task merges its own before they are shuffled. The
`most` most frequent pairs go to every task (12 bytes apiece); rarer ones, if there are more, are joined by
shuffle, where none of them can be frequent.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, new_path, stored
from .tokens import bytes_of_ids, piece_ids, word_ids

#: Bytes of text that are aligned at once.
BATCH = 1 << 20
ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
#: Distinct pairs that a task gathers before it hands them on.
GATHERED = 2_000_000


class Bits:
    """A bitset over the places 1..n, in words of 64, with the number of bits before each word."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @classmethod
    def of(cls, places: np.ndarray, n: int) -> Bits:
        flags = np.zeros(((n + 1) // 64 + 1) * 64, np.uint8)
        flags[places] = 1
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits lie below each place."""
        word, bit = places >> 6, (places & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)

    def places(self) -> np.ndarray:
        """Where the bits are, in ascending order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def spelled(ids: np.ndarray, path: str) -> np.ndarray:
    """The bytes that ids stand for, one after the other."""
    text, starts = _table(path)
    begin = starts[ids]
    size = starts[ids + 1] - begin
    ends = np.cumsum(size)
    return text[np.arange(int(ends[-1])) + np.repeat(begin - (ends - size), size)]


def spelled_by_both(texts: list[np.ndarray], ids: dict[str, list[np.ndarray]]) -> list[int]:
    """Which texts (as bytes) the ids of every file spell, each id at least one byte of it."""
    left = list(range(len(texts)))
    for file, own in ids.items():
        size = np.diff(_table(file)[1])
        left = [k for k in left if len(own[k]) and (sizes := size[own[k]]).all() and sizes.sum() == len(texts[k])]
    if not left:
        return []
    whole, ends = np.concatenate([texts[k] for k in left]), np.cumsum([len(texts[k]) for k in left])
    bad: set[int] = set()
    for file, own in ids.items():
        wrong = np.flatnonzero(spelled(np.concatenate([own[k] for k in left]), file) != whole)
        bad.update(np.searchsorted(ends, wrong, "right").tolist())
    return [k for j, k in enumerate(left) if j not in bad]


@functools.lru_cache(maxsize=2)
def _table(path: str) -> tuple[np.ndarray, np.ndarray]:
    text, starts = bytes_of_ids(path)
    return np.frombuffer(text, np.uint8), starts


@functools.lru_cache(maxsize=4)
def _decimals(count: int, tail: str) -> np.ndarray:
    """Each number below `count` as decimal text with a character after it, filled up with zero bytes."""
    return np.array([f"{i}{tail}" for i in range(count)], bytes)


def aligned(texts: list[str], file_a: str, file_b: str) -> dict[str, list]:
    """n_a, n_b, n_groups, n_links, groups_sha256, pairs and times of each text, of which none is empty.

    `pairs` are a text's distinct linked id pairs, a * (ids of B) + b in ascending order as little-endian uint64, `times` how
    often each is linked, as uint32. Texts whose tokens do not spell a space and the text have zeros.
    """
    words_a, words_b = word_ids(file_a, True), piece_ids(file_b)
    ids_a, ids_b, spoken = [], [], []
    for text in texts:
        spoken.append(np.frombuffer(b" " + text.encode("utf-8", "surrogatepass"), np.uint8))
        ids_a.append(np.frombuffer(words_a.encode(f" {text}"), "<u4").astype(np.int64))
        ids_b.append(np.frombuffer(words_b.encode(text), "<u4").astype(np.int64))
    same = spelled_by_both(spoken, {file_a: ids_a, file_b: ids_b})
    out = {"n_a": [0] * len(texts), "n_b": [0] * len(texts), "n_groups": [0] * len(texts), "n_links": [0] * len(texts), "groups_sha256": [""] * len(texts), "pairs": [b""] * len(texts), "times": [b""] * len(texts)}
    if not same:
        return out
    a, b = (np.concatenate([ids[k] for k in same]) for ids in (ids_a, ids_b))
    starts_a, starts_b = _table(file_a)[1], _table(file_b)[1]
    n = int(sum(len(spoken[k]) for k in same))
    ends = np.cumsum([len(spoken[k]) for k in same])
    side_a, side_b = Bits.of(np.cumsum(starts_a[a + 1] - starts_a[a]), n), Bits.of(np.cumsum(starts_b[b + 1] - starts_b[b]), n)
    # groups: the tokens up to each shared cut
    shared = Bits(side_a.words & side_b.words)
    cuts = shared.places()
    upto_a, upto_b = side_a.rank(cuts) + 1, side_b.rank(cuts) + 1
    # their texts: a group's ids of A, then those of B; each id knows what follows it
    group_a, group_b = (np.repeat(np.arange(len(cuts)), np.diff(upto, prepend=0)) for upto in (upto_a, upto_b))
    at_a = np.arange(len(a)) + np.concatenate(([0], upto_b))[group_a]
    at_b = np.arange(len(b)) + upto_a[group_b]
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[upto_a - 1] = last_b[upto_b - 1] = True
    count_a, count_b = len(starts_a) - 1, len(starts_b) - 1
    told = np.empty(len(a) + len(b), f"S{len(str(max(count_a, count_b))) + 1}")
    for at, ids, last, count, tail in ((at_a, a, last_a, count_a, "|"), (at_b, b, last_b, count_b, ";")):
        told[at] = np.where(last, _decimals(count, tail)[ids], _decimals(count, ",")[ids])
    # links: a stretch up to each cut of either side
    either = Bits(side_a.words | side_b.words)
    stretches = either.places()
    pair = a[side_a.rank(stretches)] * count_b + b[side_b.rank(stretches)]
    cut_of, token_a, token_b, link_of = (np.concatenate(([0], bits.rank(ends + 1))) for bits in (shared, side_a, side_b, either))
    for j, k in enumerate(same):
        pairs, times = np.unique(pair[link_of[j] : link_of[j + 1]], return_counts=True)
        text = told[token_a[j] + token_b[j] : token_a[j + 1] + token_b[j + 1]].tobytes().translate(None, b"\0")
        for name, value in (("n_a", token_a[j + 1] - token_a[j]), ("n_b", token_b[j + 1] - token_b[j]), ("n_groups", cut_of[j + 1] - cut_of[j]), ("n_links", link_of[j + 1] - link_of[j])):
            out[name][k] = int(value)
        out["groups_sha256"][k], out["pairs"][k], out["times"][k] = hashlib.sha256(text[:-1]).hexdigest(), pairs.astype("<u8").tobytes(), times.astype("<u4").tobytes()
    return out


def aligned_documents(docs: DataFrame, file_a: str, file_b: str) -> DataFrame:
    """ALIGNED: a row for each document, numbered; texts are tokenized and aligned where they are read."""

    def run(batches):
        number = TaskContext.get().partitionId() << 40

        def told(ids, texts):
            nonlocal number
            some = [k for k, t in enumerate(texts) if t]
            got = aligned([texts[k] for k in some], file_a, file_b)
            zeros = {"groups_sha256": "", "pairs": b"", "times": b""}
            columns = {name: [zeros.get(name, 0)] * len(texts) for name in got}
            for name, values in got.items():
                for k, value in zip(some, values, strict=True):
                    columns[name][k] = value
            rows = pa.RecordBatch.from_pydict({"row": range(number, number + len(ids)), "doc_id": ids, **columns}, schema=_ALIGNED)
            number += len(ids)
            return rows

        ids, texts, size = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(i)
                texts.append(text)
                size += len(text)
                if size >= BATCH or len(ids) >= 10_000:
                    yield told(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield told(ids, texts)

    return id_and_text(docs).mapInArrow(run, ALIGNED)


_ALIGNED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n: in how many documents each pair is linked."""

    def run(batches):
        pairs, counts, new = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def merged():
            every, place = np.unique(np.concatenate([pairs, *new]), return_inverse=True)
            return every, np.bincount(place, np.concatenate([counts, np.ones(len(place) - len(pairs))]), len(every)).astype(np.int64)

        held = 0
        for batch in batches:
            for data in batch.column("pairs"):
                new.append(np.frombuffer(data.as_buffer(), "<u8"))
                held += len(new[-1])
                if held > GATHERED:
                    pairs, counts = merged()
                    new, held = [], 0
                    if len(pairs) > GATHERED:
                        yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(counts)], names=["pair", "n"])
                        pairs, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if new or len(pairs):
            pairs, counts = merged()
            yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(counts)], names=["pair", "n"])

    return rows.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def alignments(docs: DataFrame, file_a: str, file_b: str, most: int = 2_000_000) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    File A is a byte-level `tokenizers` file, which encodes a space and the text, B a `sentencepiece` file, which puts the space
    itself; special tokens are plain text. A pair's count is the number of rows (documents) that hold it linked; `n_best` counts the links whose
    count is the highest of their A id's. Null and empty texts, and texts that the tokens of either side do not spell,
    have no tokens: zeros and an empty groups_sha256. Rows that share a doc_id or have none are documents of their own; an empty table
    gives none. Other columns are not read. `most` bounds the pairs that every task holds, not those that are counted.
    """
    spark = docs.sparkSession
    path = new_path(spark, "aligned")
    aligned_documents(docs, file_a, file_b).write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(ALIGNED).parquet(path)
    count_b = len(bytes_of_ids(file_b)[1]) - 1
    counted = stored(pair_counts(rows), "pair-counts")
    # one row an id of A at most: the vocabulary bounds what is given to every task
    highest = counted.groupBy(F.expr(f"pair div {count_b}").alias("a")).agg(F.max("n").alias("highest"))
    marked = counted.withColumn("a", F.expr(f"pair div {count_b}")).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    pairs = stored(marked, "pairs")
    more = pairs.count() > most
    frequent = pairs
    if more:
        # pairs of one count are all frequent or all rare, so that no order among them decides
        per_count = pairs.groupBy("n").agg(F.count("*").alias("pairs")).orderBy(F.col("n").desc())
        least, total = None, 0
        for r in per_count.toLocalIterator():  # a row for each count that occurs, from the highest, until `most` pairs are reached
            total += r["pairs"]
            if total > most:
                break
            least = r["n"]
        frequent = pairs.where(F.col("n") >= least) if least is not None else pairs.where("false")
    given = frequent.orderBy("pair").toArrow()
    shared = spark.sparkContext.broadcast((given.column("pair").to_numpy().astype(np.uint64), given.column("n").to_numpy().astype(np.uint32), given.column("best").to_numpy(zero_copy_only=False)))

    def known(data, times):
        """Places among the frequent pairs, how often each is linked, and which are found."""
        keys, counts, best = shared.value
        own, often = np.frombuffer(data, "<u8"), np.frombuffer(times, "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
        return own, often, at, keys[at] == own if len(keys) else np.zeros(len(own), bool)

    def sums(batches):
        keys, counts, best = shared.value
        for batch in batches:
            n_best, total = [], []
            for data, times in zip(batch.column("pairs"), batch.column("times"), strict=True):
                own, often, at, found = known(data.as_buffer(), times.as_buffer())
                often, at = often[found], at[found]
                total.append(int((counts[at] * often).sum()))
                n_best.append(int(often[best[at]].sum()))
            kept = [batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n_best, pa.int64()), pa.array(total, pa.int64())], names=_SUMS)

    def rare(batches):
        for batch in batches:
            for row, data, times in zip(batch.column("row").to_pylist(), batch.column("pairs"), batch.column("times"), strict=True):
                own, often, _, found = known(data.as_buffer(), times.as_buffer())
                if not found.all():
                    own, often = own[~found], often[~found]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), row)), pa.array(own.astype(np.int64)), pa.array(often)], names=["row", "pair", "times"])

    told = rows.mapInArrow(sums, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    if more:
        links = rows.select("row", "pairs", "times").mapInArrow(rare, "row long, pair long, times long").join(pairs, "pair")
        rest = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rest_best"), F.sum(F.col("n") * F.col("times")).alias("rest_sum"))
        told = told.join(rest, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("rest_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("rest_sum", F.lit(0)))
    return told.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


_SUMS = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
