"""The trie of conversations that share their first turns.

Every turn becomes a digest of its role and text, and a prefix the digest of its turns' digests, so that
texts are read once and never shuffled. Turns are sorted by blocks of conversations and chained in one
stream; equal prefixes meet partly aggregated, and a node is a row however many conversations hold it.

Nodes that several conversations share are dealt out by the digest of their first turn, and each group becomes a trie of
pointers that is walked in postorder. A first turn with more than `most` such nodes is dealt out again by
its next turn, and so on; the nodes above the groups then take the sums of the groups beneath. A
prefix of one conversation alone branches nowhere: its sums are known without a trie.
"""

from __future__ import annotations

import hashlib
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Bytes of a turn's and a prefix's digest.
DIGEST = 16
ROOT = hashlib.sha256(b"").digest()[:DIGEST]
EMPTY = hashlib.sha256(b"").hexdigest()
PREFIXES = "conv_id long, depth int, node binary, parent binary, first binary, words long, last boolean"
SUMS = "node binary, parent binary, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def prefixes(conversations: DataFrame, swap: int, block: int) -> DataFrame:
    """PREFIXES: a row for each conversation and number of its first turns, from none on, once conversations are rebuilt.

    A block holds the conversations that take their first turns from the same one, which comes first in it. Memory holds the
    digests of `swap` - 1 turns.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.expr(f"CAST(conv_id AS long) - CAST(conv_id AS long) % {block}").alias("base"),
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        role.alias("role"),
        F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * DIGEST)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    order = ["base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "role", "digest"]
    rows = turns.repartition("base").sortWithinPartitions(*order).select("base", "conv_id", "digest", "words")

    def run(batches):
        base = conv = first = None
        head: list[tuple[bytes, int]] = []
        node, depth, place, taken = ROOT, 0, 0, 0
        out: list[list] = [[] for _ in range(7)]

        def add(digest, words):
            nonlocal node, first, depth
            parent, node = node, hashlib.sha256(node + digest).digest()[:DIGEST] if digest is not None else node
            if digest is not None:
                depth += 1
            first = node if depth == 1 else first
            for column, value in zip(out, (conv, depth, node, parent if depth else None, first, words, False), strict=True):
                column.append(value)

        def begin():
            """Root, then the turns of the block's first conversation."""
            nonlocal node, first, depth, place, taken
            node, first, depth, place = ROOT, None, 0, 0
            taken = zlib.crc32(str(conv).encode()) % swap
            add(None, 0)
            if conv != base:
                for digest, words in head[:taken]:
                    add(digest, words)

        def batch_of():
            nonlocal out
            got, out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _TYPES, strict=True)], names=_NAMES), [[] for _ in range(7)]
            return got

        for batch in batches:
            for b, c, digest, words in zip(*(batch.column(k).to_pylist() for k in ("base", "conv_id", "digest", "words")), strict=True):
                if c != conv:
                    if out[0]:
                        out[6][-1] = True
                    if len(out[0]) > 20_000:
                        yield batch_of()
                    if b != base:
                        base, head = b, []
                    conv = c
                    begin()
                place += 1
                if conv == base:
                    if place < swap:
                        head.append((digest, words))
                    add(digest, words)
                elif place > taken:
                    add(digest, words)
                if len(out[0]) > 20_001:
                    # the last row stays: whether a turn follows it is not known yet
                    held = [column.pop() for column in out]
                    yield batch_of()
                    for column, value in zip(out, held, strict=True):
                        column.append(value)
        if out[0]:
            out[6][-1] = True
            yield batch_of()

    return rows.mapInArrow(run, PREFIXES)


_NAMES = [c.split()[0] for c in PREFIXES.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]


def trie_sums(table: pd.DataFrame) -> pd.DataFrame:
    """SUMS of one group of shared nodes: a trie of pointers from each node to its children, walked in postorder without recursion.

    `private` children, held by one conversation each, stand for a leaf apiece.
    """
    rows = table.sort_values("depth", kind="stable")
    nodes, parents = rows["node"].tolist(), rows["parent"].tolist()
    place = {node: i for i, node in enumerate(nodes)}
    children: list[list[int]] = [[] for _ in nodes]
    tops = []
    for i, parent in enumerate(parents):
        (children[place[parent]] if parent in place else tops).append(i)
    leaves = [n if k else 1 for n, k in zip(rows["private"].tolist(), rows["n_children"].tolist(), strict=True)]
    saved = [(n - 1) * w for n, w in zip(rows["n_convs"].tolist(), rows["words"].tolist(), strict=True)]
    convs = rows["conv_id"].tolist()
    above: list[int | None] = [None] * len(nodes)
    stack = [(top, False) for top in tops]
    while stack:
        i, back = stack.pop()
        if not back:
            stack.append((i, True))
            stack.extend((child, False) for child in children[i])
            continue
        for child in children[i]:
            leaves[i] += leaves[child]
            saved[i] += saved[child]
            above[child] = convs[i]
    out = rows[["node", "parent", "depth", "conv_id"]].copy()
    out["parent_conv_id"] = pd.array(above, "Int64")
    out["n_convs"], out["n_children"], out["n_leaves"], out["saved_tokens"] = rows["n_convs"], rows["n_children"], leaves, saved
    return out


def end_digests(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 over node, conv_id: SHA-256 of each node's conv_ids as decimals, ascending, comma-joined.

    Ranges of (node, conv_id) make blocks of text, and the blocks of a node meet in order in a stream, so that a node
    with very many ends is a few blocks, and memory holds one of them.
    """

    def blocks(batches):
        node, first, text = None, 0, []
        for batch in batches:
            done = []
            for n, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if n != node or len(text) >= 100_000:
                    done.append((node, first, ",".join(text)))
                    node, first, text = n, c, []
                text.append(str(c))
            if done := [d for d in done if d[2]]:
                yield pa.RecordBatch.from_pylist([dict(zip(("node", "first", "text"), d, strict=True)) for d in done], schema=_BLOCK)
        if text:
            yield pa.RecordBatch.from_pylist([{"node": node, "first": first, "text": ",".join(text)}], schema=_BLOCK)

    def digests(batches):
        node, state = None, None
        for batch in batches:
            done = []
            for n, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if n != node:
                    if state is not None:
                        done.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if done:
                yield pa.RecordBatch.from_pylist([{"node": n, "ends_sha256": h} for n, h in done], schema=_DIGEST)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"node": node, "ends_sha256": state.hexdigest()}], schema=_DIGEST)

    packed = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(blocks, "node binary, first long, text string")
    return packed.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digests, "node binary, ends_sha256 string")


_BLOCK = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("text", pa.string())])
_DIGEST = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])


def prefix_trie(conversations: DataFrame, swap: int = 4, block: int = 20, most: int = 200_000) -> DataFrame:
    """A row for each node: node (digest), conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by `turn` (null first), then role and digest; null role or text is the empty text. Conversation c is
    rebuilt: its first h turns, h = crc32(c) % `swap`, give way to those of conversation c - c % `block` (remainders have
    the sign of c), of which there may be fewer or none. conv_id is a node's smallest member. Rows without a conv_id belong
    to no conversation; repeated rows are turns of their own; an empty table has no nodes, not even the root. Other
    columns are not read. `most` is the number of shared nodes that one trie holds; a group that has more is split by the next turn,
    and so on, a round for each.
    """
    spark = conversations.sparkSession
    rows = stored(prefixes(conversations, swap, block), "prefixes")
    merged = rows.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.any_value("depth").alias("depth"), F.any_value("parent").alias("parent"), F.any_value("first").alias("first"), F.any_value("words").alias("words")
    )
    nodes = stored(merged, "nodes")
    born = nodes.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("private"))
    shared = stored(nodes.where("n_convs > 1 OR depth = 0").join(born, "node", "left").fillna(0, ["n_children", "private"]), "shared")
    root = shared.where("depth = 0").select("conv_id").first()
    if root is None:
        return spark.createDataFrame([], "node binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")

    left, depth, built, tops = shared.where("depth > 0").withColumn("key", F.col("first")), 1, [], [shared.where("depth = 0")]
    while True:
        sizes = left.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most)
        large = stored(sizes.select("key"), "large")
        if large.isEmpty():
            built.append(left)
            break
        built.append(left.join(large, "key", "left_anti"))
        over = left.join(large, "key", "left_semi")
        tops.append(stored(over.where(F.col("depth") == depth).drop("key"), "tops"))
        depth += 1
        turn = rows.where(F.col("depth") == depth).select("conv_id", F.col("node").alias("key"))
        left = stored(over.where(F.col("depth") >= depth).drop("key").join(turn, "conv_id"), "left")
    # first turns are dealt out by hash; a task builds the tries of several, of about `most` nodes in all
    buckets = 1 + 2 * shared.count() // most
    tries = [stored(groups.groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets))).applyInPandas(trie_sums, SUMS), "tries") for groups in built]

    # nodes above the groups, from the deepest to the root: each has the sums of its children, which are groups' tops or such nodes
    above = None
    for depth in range(len(tops) - 1, -1, -1):
        beneath = tries[depth].where(F.col("depth") == depth + 1)
        if above is not None:
            beneath = beneath.unionByName(above.where(F.col("depth") == depth + 1))
        sums = beneath.groupBy(F.col("parent").alias("node")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        here = tops[depth].join(sums, "node", "left").select(
            "node", "parent", "depth", "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
            (F.coalesce("leaves", F.lit(0)) + F.when(F.col("n_children") == 0, 1).otherwise(F.col("private"))).cast("long").alias("n_leaves"),
            (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("words")).cast("long").alias("saved_tokens"),
        )
        above = stored(here if above is None else here.unionByName(above), "above")
    every = above
    for t in tries:
        every = every.unionByName(t)
    # a prefix that one conversation holds alone ends there, or has one child
    number = lambda n, name: F.lit(n).cast("long").alias(name)
    alone = nodes.where("n_convs = 1 AND depth > 0").select("node", "parent", "depth", "conv_id", number(None, "parent_conv_id"), "n_convs", number(None, "n_children"), number(1, "n_leaves"), number(0, "saved_tokens"))
    every = every.unionByName(alone).join(end_digests(rows.where("last")), "node", "left")
    # parents outside of a node's own trie: the root is known, others are joined; a key of its own where there is none to find
    outside = F.col("parent_conv_id").isNull() & (F.col("depth") > 1)
    parent = shared.where("depth > 0").select(F.col("node").alias("above"), F.col("conv_id").alias("above_conv"))
    known = every.withColumn("above", F.when(outside, F.col("parent")).otherwise(F.col("node"))).join(parent, "above", "left")
    return known.select(
        "node",
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == 1, F.lit(root[0])).when(outside, F.coalesce("above_conv", "conv_id")).otherwise(F.col("parent_conv_id")).cast("long").alias("parent_conv_id"),
        "n_convs",
        F.coalesce("n_children", F.when(F.col("ends_sha256").isNull(), 1).otherwise(0)).cast("long").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def oracle(swap: int = 4, block: int = 20) -> str:
    """The same as SQL, over lists of turns; subtrees by way of each node's own prefixes."""
    byte = "list_transform(range(length(c::VARCHAR)::BIGINT), lambda i: ascii(substr(c::VARCHAR, i + 1, 1))::BIGINT)"
    bits = "list_reduce(list_prepend(xor(s, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda s, b: {bits}), 4294967295)"
    return f"""
WITH own AS (SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
whole AS (SELECT a.c, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS p FROM (SELECT *, ({crc} % {swap})::BIGINT AS h FROM own) AS a LEFT JOIN own AS b ON b.c = a.c - a.c % {block}),
held AS (SELECT c, p[1:d] AS p, d, len(p) = d AS ends FROM (SELECT c, p, unnest(range(len(p) + 1)) AS d FROM whole) AS u),
nodes AS (SELECT p, d, min(c) AS c, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '') AS ended, CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].text, '[^\\x20\\x09-\\x0D]+')) END AS w FROM held GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
full_nodes AS (SELECT nodes.*, coalesce(kids.k, 0) AS k FROM nodes LEFT JOIN kids ON kids.p = nodes.p),
sums AS (SELECT p[1:u] AS p, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * w) AS saved FROM (SELECT *, unnest(range(d + 1)) AS u FROM full_nodes) AS v GROUP BY 1)
SELECT a.c AS conv_id, a.d::BIGINT AS depth, b.c AS parent_conv_id, a.n AS n_convs, a.k AS n_children, sums.leaves::BIGINT AS n_leaves, sums.saved::BIGINT AS saved_tokens, sha256(a.ended) AS ends_sha256
FROM full_nodes AS a JOIN sums ON sums.p = a.p LEFT JOIN nodes AS b ON a.d > 0 AND b.d = a.d - 1 AND b.p = a.p[1:a.d - 1]"""
