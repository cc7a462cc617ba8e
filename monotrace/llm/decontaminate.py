"""Benchmark decontamination: an inverted index of the test items, searched with every training passage.

Items are the indexed texts, passages of training documents the queries. An item's score is its BM25
sum over the passage's words, as a share of what the item's own words would score, so that a
passage that holds the whole item scores 1. All items at or above a threshold are retrieved by
block-max WAND, and kept if the passage overlaps both the item's question and its answer.

Before a passage is searched, a bound is taken over many passages at once: each item has a few essential
words, the rarest ones, chosen so that all its others cannot reach half the threshold. Passages whose
essential words leave every item below it need no search.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_and_text, stored

K1, B = 1.2, 0.75
POSTING_BLOCK = 16
#: Bytes of item text that one index holds, about; more items make more indexes, built, searched and dropped one after the other.
INDEX_BYTES = 8 << 20
_WORD = re.compile(r"\w+")
MATCHES = "doc_id long, lone long, item_id long, score double, question_overlap double, answer_overlap double"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's words in two parts: its last sentence is the answer; a lone sentence gives its last quarter, three words at least."""
    sentences = [w for s in re.split(r"(?<=[.?!])\s+|\n+", text) if (w := words_of(s))]
    words = [w for s in sentences for w in s]
    cut = len(words) - len(sentences[-1]) if len(sentences) > 1 else max(0, len(words) - max(3, len(words) // 4))
    return words[:cut], words[cut:]


def shingles(words: list[str], n: int = 3) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def overlap(part: list[str], passage: list[str]) -> float:
    """The share of a part's three-word runs that the passage holds; a part of fewer words is one run; 1 for an empty part."""
    runs = shingles(part)
    if not runs:
        return 1.0
    held = shingles(passage) if len(part) >= 3 else {tuple(passage[i : i + len(part)]) for i in range(len(passage) - len(part) + 1)}
    return len(runs & held) / len(runs)


class ItemIndex:
    """Postings of items in blocks, with what a search needs to bound them."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n_items: int, mean_words: float, threshold: float):
        self.threshold = threshold
        self.items = [(i, *question_and_answer(t)) for i, t in items]
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        essential: set[str] = set()
        rest = np.zeros(len(items))
        for k, (_, q, a) in enumerate(self.items):
            words = q + a
            tf: dict[str, int] = defaultdict(int)
            for w in words:
                tf[w] += 1
            norm = K1 * (1 - B + B * len(words) / max(mean_words, 1e-9))
            weight = {w: np.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + norm) for w, f in tf.items()}
            total = sum(weight.values())
            for w, x in sorted(weight.items()):
                postings[w].append((k, x / total))
        by_item: dict[int, list[tuple[int, str, float]]] = defaultdict(list)
        for w, p in postings.items():
            for k, x in p:
                by_item[k].append((df[w], w, x))
        for k, own in by_item.items():
            left = 1.0
            for _, w, x in sorted(own):
                if left < threshold / 2:
                    break
                essential.add(w)
                left -= x
        for k, own in by_item.items():
            rest[k] = sum(x for _, w, x in own if w not in essential)
        self.terms = {w: i for i, w in enumerate(sorted(postings))}
        lists = [postings[w] for w in self.terms]
        self.docs = [[k for k, _ in p] for p in lists]
        self.weights = [[x for _, x in p] for p in lists]
        self.most = [max(x) for x in self.weights]
        self.block_most = [[max(x[i : i + POSTING_BLOCK]) for i in range(0, len(x), POSTING_BLOCK)] for x in self.weights]
        self.block_last = [[d[min(i + POSTING_BLOCK, len(d)) - 1] for i in range(0, len(d), POSTING_BLOCK)] for d in self.docs]
        # the essential words' postings, one after the other
        counts = np.array([len(p) if w in essential else 0 for w, p in zip(self.terms, lists, strict=True)], np.int64)
        self.first, self.count = np.cumsum(counts) - counts, counts
        self.flat_item = np.array([k for w, p in zip(self.terms, lists, strict=True) if w in essential for k, _ in p], np.int64)
        self.flat_weight = np.array([x for w, p in zip(self.terms, lists, strict=True) if w in essential for _, x in p])
        self.need = threshold - rest - 1e-9

    def hopeful(self, term_ids: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Windows in which some item may reach the threshold: each token lies in its window and the one before."""
        known = np.flatnonzero(term_ids >= 0)
        known = known[self.count[term_ids[known]] > 0]
        if not len(known):
            return known
        terms = term_ids[known]
        n = self.count[terms]
        at = np.repeat(self.first[terms], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item, weight, own = self.flat_item[at], self.flat_weight[at], np.repeat(window[known], n)
        keys = np.concatenate((own, own - 1)) * len(self.need) + np.concatenate((item, item))
        order = np.argsort(keys, kind="stable")
        keys, weight = keys[order], np.concatenate((weight, weight))[order]
        starts = np.flatnonzero(np.concatenate(([True], np.diff(keys) != 0)))
        sums, keys = np.add.reduceat(weight, starts), keys[starts]
        return np.unique(keys[sums >= self.need[keys % len(self.need)]] // len(self.need))

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: every item whose score over these distinct terms reaches the threshold."""
        limit, end = self.threshold - 1e-9, len(self.items)
        docs, most = self.docs, self.most
        at = dict.fromkeys(terms, 0)
        block = dict.fromkeys(terms, 0)
        order = sorted((docs[t][0], t) for t in terms)
        found = []

        def advance(t: int, to: int) -> int:
            d, b, last = docs[t], block[t], self.block_last[t]
            while b < len(last) and last[b] < to:
                b += 1
            block[t] = b
            i = max(at[t], b * POSTING_BLOCK)
            while i < len(d) and d[i] < to:
                i += 1
            at[t] = i
            return d[i] if i < len(d) else end

        while order:
            bound, pivot = 0.0, -1
            for k, (_, t) in enumerate(order):
                bound += most[t]
                if bound >= limit:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = order[pivot][0]
            if item >= end:
                break
            while pivot + 1 < len(order) and order[pivot + 1][0] == item:
                pivot += 1
            in_blocks, border = 0.0, order[pivot + 1][0] if pivot + 1 < len(order) else end
            for _, t in order[: pivot + 1]:
                b, last = block[t], self.block_last[t]
                while b < len(last) and last[b] < item:
                    b += 1
                if b < len(last):
                    in_blocks += self.block_most[t][b]
                    border = min(border, last[b] + 1)
            if in_blocks < limit:
                to = max(border, item + 1)
                order[: pivot + 1] = [(advance(t, to), t) for _, t in order[: pivot + 1]]
            elif order[0][0] == item:
                score = sum(self.weights[t][at[t]] for d, t in order[: pivot + 1])
                if score >= limit:
                    found.append((item, score))
                order[: pivot + 1] = [(advance(t, item + 1), t) for _, t in order[: pivot + 1]]
            else:
                order[: pivot + 1] = [(d if d >= item else advance(t, item), t) for d, t in order[: pivot + 1]]
            order = sorted(x for x in order if x[0] < end)
        return found


def step_of(words: int) -> int:
    """Half the words of the passages that are searched for an item of so many words: the next power of two, 16 at least."""
    return max(16, 1 << (words - 1).bit_length())


class ItemIndexes:
    """An index for each class of items whose passages are of one length, over the same numbered words."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n_items: int, mean_words: float, threshold: float):
        by_step: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for i, text in items:
            by_step[step_of(len(words_of(text)))].append((i, text))
        self.classes = [(step, ItemIndex(own, df, n_items, mean_words, threshold)) for step, own in sorted(by_step.items())]
        self.terms = {w: k for k, w in enumerate(sorted({w for _, index in self.classes for w in index.terms}))}
        #: For each class its own number of each word, -1 for words that it does not have.
        self.own = [np.array([index.terms.get(w, -1) for w in self.terms] + [-1], np.int64) for _, index in self.classes]


def item_indexes(items: DataFrame, threshold: float):
    """The items' indexes, one after the other; each is built from about INDEX_BYTES of text.

    Word counts and mean length are those of all items, and the passages of an item hang on its own length alone, so that passages and
    scores are the same however many indexes there are.
    """
    known = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("item_id IS NOT NULL")

    def split(batches):
        for batch in batches:
            ids, words, n = [], [], []
            for i, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = words_of(text)
                for w in set(own):
                    ids.append(i)
                    words.append(w)
                    n.append(len(own))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["item_id", "word", "n"])

    size, rows = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    if not rows:
        return
    shards = 1 + size // INDEX_BYTES
    terms = known.mapInArrow(split, "item_id long, word string, n long")
    df = terms.groupBy("word").agg(F.count("*").alias("df"))
    n_items, mean = terms.groupBy("item_id").agg(F.max("n").alias("n")).agg(F.count("*"), F.avg("n")).first()
    for shard in range(shards):
        own = known.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == shard)
        texts = [(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect()]
        texts = [x for x in texts if words_of(x[1])]
        if texts:
            held = own.mapInArrow(split, "item_id long, word string, n long").select("word").distinct().join(df, "word")
            yield ItemIndexes(texts, {r["word"]: r["df"] for r in held.collect()}, n_items, mean or 1.0, threshold), shards


def matches(docs: DataFrame, items: DataFrame, threshold: float = 0.6, least_overlap: float = 0.5) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: each verified pair of document and item once, with its best passage.

    The passages for an item are windows of two to four times its words, half overlapping, so that every occurrence
    of it lies in one; items of other lengths have windows of their own. Null and empty texts, on either side, match nothing; rows that share a doc_id
    are taken as one document, rows without one as a document for each text; other columns are not read;
    empty tables give no rows.
    """
    return _matches(docs, items, threshold, least_overlap).drop("lone")


def _with_key(docs: DataFrame) -> DataFrame:
    """doc_id, text and, for rows without a doc_id, a hash of the text in their stead."""
    known = id_and_text(docs)
    return known.withColumn("lone", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))


def _matches(docs: DataFrame, items: DataFrame, threshold: float, least_overlap: float) -> DataFrame:
    """Matches with the key of _with_key. Of several indexes, the driver holds one at a time, and what it finds is stored."""
    spark, known = docs.sparkSession, _with_key(docs)
    out = None
    for index, indexes in item_indexes(items, threshold):
        shared = spark.sparkContext.broadcast(index)
        got = known.mapInArrow(_searcher(shared, least_overlap), MATCHES)
        if indexes > 1:
            got = stored(got, "matches")
            shared.unpersist()
        out = got if out is None else out.unionByName(got)
    if out is None:
        return spark.createDataFrame([], MATCHES)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap"))
    return out.groupBy("doc_id", "lone", "item_id").agg(best.alias("m")).select("doc_id", "lone", "item_id", "m.score", "m.question_overlap", "m.answer_overlap")


def _searcher(shared, least_overlap: float):
    def run(batches):
        indexes: ItemIndexes = shared.value
        get = indexes.terms.get
        for batch in batches:
            ids, texts = list(zip(batch.column("doc_id").to_pylist(), batch.column("lone").to_pylist(), strict=True)), batch.column("text").to_pylist()
            at = 0
            rows = []
            while at < len(ids):
                taken, words, sizes, held = [], [], [], 0
                while at < len(ids) and held < 400_000:
                    own = words_of(texts[at])
                    taken.append(ids[at])
                    words.append(own)
                    sizes.append(len(own))
                    held += len(own)
                    at += 1
                n = np.array(sizes, np.int64)
                doc = np.repeat(np.arange(len(n)), n)
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                numbers = np.fromiter((get(w, -1) for own in words for w in own), np.int64, int(n.sum()))
                for (step, index), own_of in zip(indexes.classes, indexes.own, strict=True):
                    windows = -(-n // step) + 1  # one before the first
                    base = np.cumsum(windows) - windows + 1
                    for k in index.hopeful(own_of[numbers], base[doc] + place // step).tolist():
                        d = int(np.searchsorted(base - 1, k, "right")) - 1
                        start = max(0, k - int(base[d])) * step
                        stop = (k - int(base[d]) + 2) * step
                        passage = words[d][start:stop]
                        terms = sorted({t for w in passage if (t := index.terms.get(w, -1)) >= 0})
                        for item, score in index.search(terms):
                            item_id, question, answer = index.items[item]
                            q, a = overlap(question, passage), overlap(answer, passage)
                            if q >= least_overlap and a >= least_overlap:
                                rows.append((*taken[d], item_id, min(1.0, score), q, a))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "lone", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def clean_documents(docs: DataFrame, items: DataFrame, threshold: float = 0.6, least_overlap: float = 0.5) -> DataFrame:
    """The rows of `docs`, with all their columns, that match no item. Rows without a doc_id go by their own text."""
    found = _matches(docs, items, threshold, least_overlap).select(F.col("doc_id").alias("m_id"), F.col("lone").alias("m_lone")).distinct()
    doc_id, lone = fresh(docs, "m_doc"), fresh(docs, "m_lone")
    number = F.col("doc_id").cast("long")
    keyed = docs.withColumn(doc_id, F.coalesce(number, F.lit(0))).withColumn(lone, F.when(number.isNull(), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    found = found.select(F.coalesce("m_id", F.lit(0)).alias(doc_id), F.col("m_lone").alias(lone))
    same = (keyed[doc_id] == found[doc_id]) & keyed[lone].eqNullSafe(found[lone])
    return keyed.join(found, same, "left_anti").drop(doc_id, lone)
