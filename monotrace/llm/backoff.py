"""Stupid-backoff scores from count tables that are partitioned by n-gram hash.

A word scores c(n-gram) / c(n-gram without its last word) for the longest n-gram that ends there and occurs;
each word that is dropped from the front multiplies the score by DISCOUNT. A word alone scores c / N, one
that never occurs DISCOUNT / N; at the start of a text, n-grams are no longer than what stands before. Counts
are those of all other documents, for every text would find its own n-grams in its own counts.

The work is three joins by key. Documents are dealt into bundles of about BUNDLE bytes by a hash; each
bundle gives its distinct n-grams with their counts, by hash and in as many rows as parts of the table
hold one of them, so there are never more rows than n-grams. Each part adds its rows up and answers every
bundle with the totals of the n-grams that it asked for. Bundles meet their answers and sum up per
document. An n-gram that every document holds is one entry a bundle, so frequent ones make no part larger.

A row for each n-gram instead would take some twelve times the input on disk, for most are met once: sorted
and packed, a hash takes five to six bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

DISCOUNT, ORDER = 0.4, 3
#: Bytes of text in a bundle, and n-grams in a part of the table, about.
BUNDLE, PART = 10 << 20, 2_000_000
_GOLDEN, _MIX_1, _MIX_2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[bytes]:
    """Runs of characters that are not ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "replace").lower().split()


class Bundle:
    """The n-grams of some texts: hashes ascending, their counts, and for each token and length where the n-gram that ends there is."""

    def __init__(self, texts: list[str], order: int):
        import xxhash

        place: dict[bytes, int] = {}
        tokens, sizes = [], []
        for t in texts:
            own = words_of(t)
            sizes.append(len(own))
            tokens.append(np.fromiter((place.setdefault(w, len(place)) for w in own), np.int64, len(own)))
        self.order, self.sizes = order, np.array(sizes, np.int64)
        token = np.concatenate(tokens or [np.zeros(0, np.int64)])
        word = np.fromiter(map(xxhash.xxh64_intdigest, place), np.uint64, len(place))[token]
        self.doc = np.repeat(np.arange(len(sizes)), self.sizes)
        #: How many words stand before each one in its text.
        self.depth = np.arange(len(token)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        grams, gram = [word], word
        for n in range(2, order + 1):
            gram = mixed(np.concatenate((gram[:1], gram[:-1])) * _GOLDEN + word + np.uint64(n))
            grams.append(gram[self.depth >= n - 1])
        # the empty n-gram, hash 0, counts all words
        self.hashes, at, self.counts = np.unique(np.concatenate((np.zeros(1, np.uint64), *grams)), return_inverse=True, return_counts=True)
        self.counts[0] += len(token) - 1
        self.at, done = [], 1
        for n, gram in enumerate(grams):
            where = np.zeros(len(token), np.int64)
            where[self.depth >= n] = at[done : done + len(gram)]
            self.at.append(where)
            done += len(gram)

    def scores(self, totals: np.ndarray) -> np.ndarray:
        """Sum over each text's words of the natural logarithm of their scores, from the counts of all documents."""
        if not len(self.doc):
            return np.zeros(len(self.sizes))
        every = np.maximum(totals[0] - self.sizes[self.doc], 1).astype(float)
        longest = np.minimum(self.depth, self.order - 1)
        context = None
        for n in range(self.order):
            inside = self.depth >= n
            other = np.where(inside, totals[self.at[n]] - self._own(self.at[n]), 0)
            if context is None:
                best = np.where(other > 0, other, DISCOUNT) / every * DISCOUNT**longest
            else:
                best = np.where(other > 0, other / np.maximum(context, 1) * DISCOUNT ** (longest - n), best)
            context = np.concatenate((other[:1], other[:-1]))
        return np.bincount(self.doc, np.log(best), len(self.sizes))

    def _own(self, at: np.ndarray) -> np.ndarray:
        """How often each token's n-gram stands in its own text."""
        _, back, counts = np.unique(self.doc * len(self.hashes) + at, return_inverse=True, return_counts=True)
        return counts[back]


def _packed(x: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel()


def _dealt(docs: DataFrame, bundles: int) -> DataFrame:
    """bundle, ids, sizes, texts: the documents of each batch that go to the same bundle, their texts one after the other and compressed."""

    def run(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = [t.encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
            ids, bundle = batch.column("doc_id").to_pylist(), batch.column("bundle").to_numpy()
            order = np.argsort(bundle, kind="stable")
            rows = [(int(bundle[own[0]]), [ids[k] for k in own], [len(texts[k]) for k in own], squeeze(b"".join([texts[k] for k in own]))) for own in np.split(order, np.flatnonzero(np.diff(bundle[order])) + 1) if len(own)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()), strict=True)], names=["bundle", "ids", "sizes", "texts"])

    return docs.mapInArrow(run, "bundle long, ids array<long>, sizes array<int>, texts binary")


def _texts(table: pa.Table) -> list[str]:
    """The texts of dealt rows, in their order."""
    import zstandard

    out = []
    for sizes, data in zip(table.column("sizes").to_pylist(), table.column("texts").to_pylist(), strict=True):
        whole = zstandard.ZstdDecompressor().decompress(data, max_output_size=sum(sizes) + 1)
        ends = np.cumsum(sizes).tolist()
        out += [whole[a:b].decode() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    return out


def backoff_scores(docs: DataFrame, order: int = ORDER, bundle_bytes: int = BUNDLE, part_ngrams: int = PART) -> DataFrame:
    """doc_id, n_tokens, log_score (the sum), mean_log_score: a row for each row of `docs`, from n-grams of up to `order` words.

    Null, empty and blank texts have no words and the score 0. Rows that share a doc_id, or lack one, are
    documents of their own; a lone document finds no counts but its own. Other columns are not read; an
    empty table gives an empty one.
    """
    known = id_and_text(docs)
    size = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bundles, parts = 1 + size // bundle_bytes, 1 + size * order // (12 * part_ngrams)
    dealt = _dealt(known.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(bundles)).alias("bundle"), "doc_id", "text"), bundles)
    borders = (np.arange(1, parts, dtype=object) * 2**64 // parts).astype(np.uint64)

    def ask(key, table):
        own = Bundle(_texts(table), order)
        edges = [0, *np.searchsorted(own.hashes, borders).tolist(), len(own.hashes)]
        rows = [(key[0].as_py(), p, _packed(np.diff(own.hashes[a:b], prepend=np.uint64(0))), _packed(own.counts[a:b])) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bundle", "part", "hashes", "counts"])

    def answer(key, table):
        asked = [np.cumsum(_unpacked(x)) for x in table.column("hashes").to_pylist()]
        every = np.concatenate(asked)
        counts = np.concatenate([_unpacked(x) for x in table.column("counts").to_pylist()])
        by_hash = np.argsort(every, kind="stable")
        every, counts = every[by_hash], counts[by_hash]
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(every)), bool), every[1:] != every[:-1])))
        totals = np.add.reduceat(counts, starts) if len(starts) else counts
        hashes = every[starts]
        told = [_packed(totals[np.searchsorted(hashes, x)]) for x in asked]
        return pa.Table.from_arrays([table.column("bundle"), table.column("part"), pa.array(told, pa.binary())], names=["bundle", "part", "totals"])

    def score(key, table, told):
        own = Bundle(_texts(table), order)
        by_part = np.argsort(told.column("part").to_numpy())
        packed = told.column("totals").to_pylist()
        sums = own.scores(np.concatenate([_unpacked(packed[k]) for k in by_part]).astype(np.int64))
        ids = [i for row in table.column("ids").to_pylist() for i in row]
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(own.sizes), pa.array(sums), pa.array(sums / np.maximum(own.sizes, 1))], names=["doc_id", "n_tokens", "log_score", "mean_log_score"])

    asked = dealt.groupBy("bundle").applyInArrow(ask, "bundle long, part long, hashes binary, counts binary")
    told = asked.groupBy("part").applyInArrow(answer, "bundle long, part long, totals binary")
    return dealt.groupBy("bundle").cogroup(told.groupBy("bundle")).applyInArrow(score, "doc_id long, n_tokens long, log_score double, mean_log_score double")


def floor_of_log(n_words: int, order: int = ORDER) -> float:
    """The score of a lone text of so many words."""
    return sum(math.log(DISCOUNT) * (1 + min(k, order - 1)) for k in range(n_words))


def _oracle() -> str:
    """The same in DuckDB, for n-grams of up to three words, over the words themselves instead of their hashes."""
    lists = {"c1": "w", "c2": "v, w", "c3": "u, v, w"}
    counted = [f"{n} AS (SELECT {cols}, count(*) AS n FROM g WHERE {cols.split(', ')[0]} IS NOT NULL GROUP BY ALL), o{n[1]} AS (SELECT doc_id, {cols}, count(*) AS n FROM g WHERE {cols.split(', ')[0]} IS NOT NULL GROUP BY ALL)" for n, cols in lists.items()]
    # x2: the two words before this one; x1: the one before
    needs = {"1": "w = g.w", "2": "v = g.v AND {t}.w = g.w", "3": "u = g.u AND {t}.v = g.v AND {t}.w = g.w"}
    joins = "".join(f" LEFT JOIN {t} AS {t} ON {t}." + need.format(t=t) + (f" AND {t}.doc_id = g.doc_id" if t[0] == "o" else "") for k, need in needs.items() for t in (f"c{k}", f"o{k}"))
    joins += "".join(f" LEFT JOIN {kind}{k} AS x{kind}{k} ON " + on.format(t=f"x{kind}{k}") + (f" AND x{kind}{k}.doc_id = g.doc_id" if kind == "o" else "") for k, on in (("1", "{t}.w = g.v"), ("2", "{t}.v = g.u AND {t}.w = g.v")) for kind in "co")
    return (
        "WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents), "
        "t AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS k FROM d), "
        "g AS (SELECT doc_id, k, w, lag(w, 1) OVER p AS v, lag(w, 2) OVER p AS u FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY k)), "
        + ", ".join(counted)
        + ", s AS (SELECT g.doc_id, least(g.k, 3) AS longest, c1.n - o1.n AS n1, coalesce(c2.n - o2.n, 0) AS n2, coalesce(c3.n - o3.n, 0) AS n3, xc1.n - xo1.n AS x1, xc2.n - xo2.n AS x2, "
        f"greatest((SELECT count(*) FROM g) - len(d.ws), 1) AS every FROM g JOIN d ON d.doc_id = g.doc_id{joins}), "
        f"l AS (SELECT doc_id, sum(ln(CASE WHEN n3 > 0 THEN n3 / x2 WHEN n2 > 0 THEN n2 / x1 * pow({DISCOUNT}, longest - 2) ELSE (CASE WHEN n1 > 0 THEN n1 ELSE {DISCOUNT} END) / every * pow({DISCOUNT}, longest - 1) END)) AS x FROM s GROUP BY doc_id) "
        "SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_tokens, round(coalesce(x, 0), 4) AS log_score, round(coalesce(x, 0) / greatest(len(d.ws), 1), 6) AS mean_log_score FROM d LEFT JOIN l ON l.doc_id = d.doc_id"
    )


ORACLE = _oracle()
