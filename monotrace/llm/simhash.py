"""SimHash near-dedup by a binary trie joined with itself.

A text's fingerprint has 64 bits, each the majority of that bit over the hashes of its word shingles.
Fingerprints that differ in at most `most` bits are linked, and links make components.

The trie of all fingerprints is met with itself from the root: a pair of nodes carries the bits in which
their paths differ and is dropped once that exceeds its budget. Of `most` differing bits on a ring of
four equal arcs, there is always an arc from which on no stretch of j arcs holds more than j * most / 4
of them; so four tries, one from each arc, need only that rising budget, which drops nearly all
pairs early. Nodes of the upper levels are rows: blocks of sorted fingerprints with a common prefix, joined
with the blocks of every prefix within the budget. Below, a task walks the two subtrees. Prefixes are no
longer than an arc, so with a radius of 11 a block is sent to 68 others at most (at n bits of prefix, to half
of the prefixes that differ in two bits), whatever the number of documents.

A wider radius finds texts with a few changed words, but chance pairs too. There, each fingerprint carries
three more words of 64 bits from other hashes of the same shingles, and a pair is linked if few enough of
all 256 bits differ. Each of the four words has its tries: of at most 46 differing bits, some word holds
at most 11, so no pair is lost.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, fresh, id_and_text
from .components import Forest, components, thinned

ARCS = 4
#: Fingerprints of a block at most, and what the number of prefix bits aims at.
BLOCK, AIM = 2048, 1024
#: The same for four words, whose fingerprints are longer and sent to more prefixes: larger and fewer blocks, so that each is sent less often.
BLOCK_WIDE, AIM_WIDE = 32_768, 32_768
#: Pairs of fingerprints, and pairs of nodes, that a task has in hand at once.
ROOM, NODES = 1 << 18, 1 << 15
#: Further words of a wide fingerprint: odd factors that make other hashes of a shingle's hash.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Bits of a near copy of similarity 0.8: cos = 0.89 makes 15 % of the bits differ, 10 of 64 and 39 of 256 on average. 46 < 4 * (11 + 1).
NEAR_BITS, NEAR_WIDE_BITS = 11, 46


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle; of the whole sequence of words where there are fewer; none without words."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    n = max(1, len(words) - shingle + 1)
    return np.fromiter(map(xxhash.xxh64_intdigest, [joined[a:b] for a, b in zip(starts[:n], ends[shingle - 1 :] or ends[-1:], strict=True)], itertools.repeat(42)), "<u8", n)


def majority(hashes: np.ndarray) -> bytes:
    """The 64 bits, least significant first, each set if over half the hashes have it set."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def fingerprint_of(text: str, shingle: int) -> int:
    """The fingerprint of one text as an unsigned number."""
    return int.from_bytes(majority(shingle_hashes(text, shingle)), "little")


def wide_of(hashes: np.ndarray) -> bytes:
    """Further words of 64 bits, from other hashes of the same shingles."""
    out = []
    for factor in FACTORS:
        other = hashes * np.uint64(factor)
        other = (other ^ (other >> np.uint64(32))) * np.uint64(factor)
        out.append(majority(other ^ (other >> np.uint64(29))))
    return b"".join(out)


def fingerprints(docs: DataFrame, shingle: int = 5, wide: bool = False) -> DataFrame:
    """doc_id, own (a hash of the text), fp (the fingerprint's bits as a long) and, if asked for, wide (binary). A null or blank text has the fingerprint 0; a text of fewer words than `shingle` is one shingle."""

    def run(batches):
        for batch in batches:
            fps, more = [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_hashes(text, shingle)
                fps.append(majority(hashes))
                if wide:
                    more.append(wide_of(hashes))
            columns = [batch.column("doc_id"), batch.column("own"), pa.array(np.frombuffer(b"".join(fps), "<i8"))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(more, pa.binary())] if wide else columns, names=["doc_id", "own", "fp", "wide"][: 3 + wide])

    return id_and_text(docs).withColumn("own", F.xxhash64("text")).mapInArrow(run, "doc_id long, own long, fp long" + ", wide binary" * wide)


def budget(depth: int, most: int) -> int:
    """The differing bits that a path of `depth` bits may hold."""
    return most * math.ceil(depth / (64 // ARCS)) // ARCS


def masks(bits: int, most: int) -> list[int]:
    """The differences of two prefixes of `bits` bits that keep within the budget at every depth."""
    found = [(0, 0)]
    for depth in range(1, bits + 1):
        found = [x for mask, n in found for x in ((mask << 1, n), (mask << 1 | 1, n + 1)) if x[1] <= budget(depth, most)]
    return [mask for mask, _ in found]


def meet(a: np.ndarray, b: np.ndarray, depth: int, most: int, room: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in the sorted arrays a and b whose fingerprints differ in at most `most` bits, found by walking both subtries below `depth`.

    About `room` comparisons are made at a time, and of the pairs of nodes NODES at most go down together, so
    memory is bounded however many meet. An array that meets itself gives each pair of places once.
    """
    room, itself = room or ROOM, a is b
    zero, one = np.zeros(1, np.int64), np.uint64(1)
    errors = np.bitwise_count((a[:1] ^ b[:1]) >> np.uint64(64 - depth)).astype(np.int64) if depth else zero
    waiting = [(depth, zero, zero + len(a), zero, zero + len(b), errors)] if len(a) and len(b) else []
    while waiting:
        depth, al, ah, bl, bh, errors = waiting.pop()
        size = (ah - al) * (bh - bl)
        ready = size <= 32 if depth < 64 else np.ones(len(al), bool)
        if ready.any():
            done = np.cumsum(size[ready])
            start = 0
            while start < len(done):
                stop = max(start + 1, int(np.searchsorted(done, (done[start - 1] if start else 0) + room, "right")))
                x, width, y, n = (v[ready][start:stop] for v in (al, bh - bl, bl, size))
                k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                width = np.repeat(width, n)
                i, j = np.repeat(x, n) + k // width, np.repeat(y, n) + k % width
                near = np.bitwise_count(a[i] ^ b[j]) <= most
                yield i[near], j[near]
                start = stop
            al, ah, bl, bh, errors = (x[~ready] for x in (al, ah, bl, bh, errors))
        if depth == 64 or not len(al):
            continue
        shift, bit = np.uint64(63 - depth), one << np.uint64(63 - depth)
        am = np.clip(np.searchsorted(a, (a[al] >> shift | one) << shift), al, ah) if depth < 63 else np.clip(np.searchsorted(a, a[al] | bit), al, ah)
        bm = np.clip(np.searchsorted(b, (b[bl] >> shift | one) << shift), bl, bh) if depth < 63 else np.clip(np.searchsorted(b, b[bl] | bit), bl, bh)
        depth += 1
        al, ah = np.concatenate((al, al, am, am)), np.concatenate((am, am, ah, ah))
        bl, bh = np.concatenate((bl, bm, bl, bm)), np.concatenate((bm, bh, bm, bh))
        errors = np.concatenate((errors, errors + 1, errors + 1, errors))
        on = (al < ah) & (bl < bh) & (errors <= budget(depth, most))
        if itself:
            on &= al <= bl
        nodes = [x[on] for x in (al, ah, bl, bh, errors)]
        waiting += [(depth, *(x[k : k + NODES] for x in nodes)) for k in range(0, len(nodes[0]), NODES)]


def by_word(fps: DataFrame) -> DataFrame:
    """word, fp, wide, id: four rows for each of `fps`, each with another word as fp and the other three as wide."""

    def run(batches):
        for batch in batches:
            n = len(batch)
            words = np.column_stack((batch.column("fp").to_numpy(), np.frombuffer(b"".join(batch.column("wide").to_pylist()), np.int64).reshape(n, len(FACTORS))))
            for k in range(words.shape[1]):
                others = [row.tobytes() for row in np.delete(words, k, axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array(words[:, k]), pa.array(others, pa.binary()), batch.column("id")], names=["word", "fp", "wide", "id"])

    return fps.select("fp", "wide", "id").mapInArrow(run, "word int, fp long, wide binary, id long")


def blocks(fps: DataFrame, bits: int, most: int) -> DataFrame:
    """arc, prefix, block, fps, ids, wides: the sorted fingerprints of each prefix of `bits` bits, in runs of at most `most`, for the trie from each arc (of each word, if there is a column word)."""
    wide = F.col("wide") if "wide" in fps.columns else F.lit(b"")
    several = "word" in fps.columns
    turned = fps.select("fp", "id", wide.alias("wide"), *["word"] * several, F.explode(F.array(*map(F.lit, range(ARCS)))).alias("arc"))
    step = 64 // ARCS
    turn = F.expr(f"CASE arc WHEN 0 THEN fp {' '.join(f'WHEN {k} THEN shiftleft(fp, {k * step}) | shiftrightunsigned(fp, {64 - k * step})' for k in range(1, ARCS))} END")
    # signed order is unsigned order once the top bit is flipped
    arc = F.expr(f"word * {ARCS} + arc").alias("arc") if several else "arc"
    placed = turned.select(arc, turn.alias("turned"), "id", "wide").withColumn("place", F.col("turned").bitwiseXOR(F.lit(-(2**63)).cast("long")))
    by_range = placed.repartitionByRange("arc", "place").sortWithinPartitions("arc", "place")

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        arc, held, ids, wides = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def cut(last: bool):
            nonlocal number, arc, held, ids, wides
            prefix = held >> np.uint64(64 - bits) if bits else np.zeros(len(held), np.uint64)
            edges = np.flatnonzero((np.diff(prefix) != 0) | (np.diff(arc) != 0)) + 1
            edges = [0, *edges.tolist(), len(held)]
            if not last:
                edges = edges[:-1] if len(edges) > 2 else [0, len(held)]
            rows = []
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                for k in range(x, y, most):
                    part = slice(k, min(y, k + most))
                    rows.append((int(arc[k]), int(prefix[k]), number, held[part].tobytes(), ids[part].tobytes(), b"".join(wides[part])))
                    number += 1
            arc, held, ids, wides = arc[edges[-1] :], held[edges[-1] :], ids[edges[-1] :], wides[edges[-1] :]
            return pa.RecordBatch.from_pydict(dict(zip(("arc", "prefix", "block", "fps", "ids", "wides"), map(list, zip(*rows, strict=True)), strict=True)), schema=schema)

        schema = pa.schema([("arc", pa.int32()), ("prefix", pa.int64()), ("block", pa.int64()), ("fps", pa.binary()), ("ids", pa.binary()), ("wides", pa.binary())])
        for batch in batches:
            arc = np.concatenate((arc, batch.column("arc").to_numpy()))
            held = np.concatenate((held, batch.column("turned").to_numpy().view(np.uint64)))
            ids = np.concatenate((ids, batch.column("id").to_numpy()))
            wides += batch.column("wide").to_pylist()
            if len(held) >= 16 * most:
                yield cut(False)
        if len(held):
            yield cut(True)

    return by_range.mapInArrow(run, "arc int, prefix long, block long, fps binary, ids binary, wides binary")


def near_links(fps: DataFrame, most: int = 4, most_wide: int | None = None) -> DataFrame:
    """a, b: ids of distinct fingerprints (columns fp, id) within `most` bits; enough of them to connect all that are linked.

    With `most_wide`, fp and the column wide (24 bytes) are four words, and ids are of distinct words: at most
    so many bits of all four may differ, and at most `most` in at least one of them, which every pair
    meets where most_wide < 4 * (most + 1).

    Of a pair of blocks, and of a batch of such pairs, only links that connect anew are given, which
    leaves every component whole.
    """
    if not 0 <= most < 64:
        raise ValueError("most must lie in 0..63")
    n, aim, size = fps.count(), *((AIM, BLOCK) if most_wide is None else (AIM_WIDE, BLOCK_WIDE))
    # up to one arc's bits a prefix has few others within the budget, so what a block is sent to stays bounded; beyond that, prefixes hold more blocks
    bits = min(64 // ARCS, max(0, math.ceil(math.log2(max(n, 1) / aim))))
    found = cut_lineage(blocks(fps if most_wide is None else by_word(fps), bits, size))
    near = F.explode(F.lit(masks(bits, most)).cast("array<bigint>"))
    right = found.select("arc", F.col("prefix").alias("own"), *(F.col(c).alias(f"{c}_b") for c in ("block", "fps", "ids", "wides")), near.alias("mask"))
    right = right.withColumn("prefix", F.col("own").bitwiseXOR(F.col("mask"))).where("prefix <= own").drop("mask")
    met = found.join(right, ["arc", "prefix"]).where("prefix < own OR block <= block_b").select("fps", "ids", "wides", "fps_b", "ids_b", "wides_b", (F.col("block") == F.col("block_b")).alias("itself"))

    def run(batches):
        for batch in batches:
            out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in range(len(batch)):
                x, i, v, y, j, w, itself = (batch.column(c)[k].as_py() for c in ("fps", "ids", "wides", "fps_b", "ids_b", "wides_b", "itself"))
                x, y, i, j = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), np.frombuffer(i, np.int64), np.frombuffer(j, np.int64)
                v, w = np.frombuffer(v, np.uint64).reshape(len(x), -1), np.frombuffer(w, np.uint64).reshape(len(y), -1)
                # a row that stands on both sides, as in a block that meets itself, is one vertex
                vertex = np.unique(np.concatenate((i, j)), return_inverse=True)[1]
                forest = Forest(int(vertex.max()) + 1)
                for at, bt in meet(x, x if itself else y, bits, most):
                    apart = forest.root[vertex[at]] != forest.root[vertex[len(i) + bt]]
                    at, bt = at[apart], bt[apart]
                    if most_wide is not None:
                        differ = np.bitwise_count(x[at] ^ y[bt]).astype(np.int64) + np.bitwise_count(v[at] ^ w[bt]).sum(axis=1, dtype=np.int64)
                        at, bt = at[differ <= most_wide], bt[differ <= most_wide]
                    new = forest.added(vertex[at], vertex[len(i) + bt])
                    out_a.append(i[at[new]])
                    out_b.append(j[bt[new]])
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            vertex = np.unique(np.concatenate((a, b)), return_inverse=True)[1]
            new = Forest(int(vertex.max(initial=0)) + 1).added(vertex[: len(a)], vertex[len(a) :])  # the tries of other words and arcs meet the same pairs
            yield pa.RecordBatch.from_pydict({"a": pa.array(a[new]), "b": pa.array(b[new])})

    return met.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, shingle: int = 5, most: int = NEAR_BITS, most_wide: int | None = NEAR_WIDE_BITS) -> DataFrame:
    """doc_id, fp, component_id: a row for each row of `docs`, with the smallest doc_id that links reach from its fingerprint.

    Equal fingerprints (of 256 bits with `most_wide`) are one vertex, named by their smallest doc_id, so copies make no links of their own.
    Null and blank texts share the fingerprint 0. Rows without a doc_id take the component of their
    fingerprint, or null where no numbered row has that fingerprint; they do not connect others. Rows
    may repeat; other columns are not read; an empty table gives an empty one. Without `most_wide`, `most`
    bits of 64 alone decide; with it, `most` is the radius of the search in each of the four words.
    """
    return _grouped(docs, shingle, most, most_wide).drop("own")


def _grouped(docs: DataFrame, shingle: int, most: int, most_wide: int | None) -> DataFrame:
    """near_groups, with the hash of each row's text."""
    known = cut_lineage(fingerprints(docs, shingle, most_wide is not None))
    key = ["fp"] if most_wide is None else ["fp", "wide"]
    vertices = cut_lineage(known.where("doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("id")))
    roots = components(thinned(near_links(vertices, most, most_wide)))
    named = vertices.join(roots, F.col("id") == F.col("vertex"), "left").select(*key, F.coalesce("root", "id").alias("component_id"))
    return known.join(named, key, "left").select("doc_id", "own", "fp", "component_id")


def first_of_each(docs: DataFrame, shingle: int = 5, most: int = NEAR_BITS, most_wide: int | None = NEAR_WIDE_BITS) -> DataFrame:
    """One row of each component, with all its columns: of those with the component's smallest doc_id, one of the text with the least hash. Rows without a doc_id stay.

    So rows that share a doc_id are documents of their own: a copy of another document goes though its doc_id stays with another text, and of
    rows with the same doc_id and text one stays. An empty table gives an empty one.
    """
    own = fresh(docs, "own")
    first = _grouped(docs, shingle, most, most_wide).where("doc_id = component_id").groupBy("component_id").agg(F.min("own").alias(own))
    keyed = docs.where("doc_id IS NOT NULL").withColumn(own, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    kept = keyed.join(first, (F.col("doc_id").cast("long") == F.col("component_id")) & (keyed[own] == first[own]), "left_semi")
    return kept.dropDuplicates(["doc_id", own]).drop(own).unionByName(docs.where("doc_id IS NULL"))
