"""Quality classifier by compression.

Two zstandard dictionaries are made, of good and of bad labelled texts. A text costs fewer bytes with
the dictionary of the kind that it is like. Texts are compressed in pieces, so that a long text cannot
outgrow the dictionaries. Two normalised differences describe a text: that of its size with either
dictionary, as a share of both, and that of its plain size and the smaller of these, which is large
where a text repeats itself, whichever dictionary it is compressed with. A logistic curve over the
two and their squares, fitted on labelled texts that the dictionaries have not seen, makes a probability of them.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, stored

#: Labelled documents of each class that are fitted on at most: half make the dictionaries, half the curve.
SAMPLE = 1500
#: Pieces of PIECE bytes that a dictionary is made of at most, drawn by hash from all pieces of all its texts.
SAMPLE_PIECES = 16_384
PIECE, LEVEL, DICTIONARY = 2048, 3, 112_640
FOLDS = 5


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slopes: tuple[float, ...]
    offset: float

    def score(self, text: str) -> float:
        x = self.offset + sum(s * f for s, f in zip(self.slopes, differences(self.good, self.bad, text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


@functools.lru_cache(maxsize=4)
def _compressor(dictionary: bytes):
    import zstandard

    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
    known = zstandard.ZstdCompressionDict(dictionary)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False, write_checksum=False)


def differences(good: bytes, bad: bytes, text: str) -> tuple[float, float, float, float]:
    """(with the bad dictionary - with the good one) / both, (plain size - smaller of the two) / both, and their squares; 0 for an empty text."""
    data = text.encode("utf-8", "replace")
    if not data:
        return (0.0,) * 4
    n = max(1, round(len(data) / PIECE))
    edges = [len(data) * k // n for k in range(n + 1)]
    with_good, with_bad = _compressor(good), _compressor(bad)
    pieces = [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    g, b = sum(len(with_good.compress(p)) for p in pieces), sum(len(with_bad.compress(p)) for p in pieces)
    kind, saved = (b - g) / (b + g), (len(data) - min(b, g)) / (len(data) + min(b, g))
    return kind, saved, kind * abs(kind), saved * abs(saved)


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is never learned from; a null doc_id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[tuple[float, ...], float]:
    """Slopes and offset of the logistic curve by Newton's method, with a weak pull of the slopes to 0."""
    scale = np.std(x, axis=0)
    scale[scale == 0] = 1.0
    z = np.column_stack((x / scale, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    pull = np.diag([1e-1] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + pull, z.T @ (y - p) - pull @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple((w[:-1] / scale).tolist()), float(w[-1])


def _dictionary(pieces: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY, pieces, k=256, d=8, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few texts to train on: their own bytes are the dictionary
        return b"".join(pieces)[-DICTIONARY:]


def _pieces(texts: DataFrame, most: int) -> list[bytes]:
    """Of all pieces of these texts (doc_id, text, place), `most` at most, in the order of their texts."""

    def run(batches):
        for batch in batches:
            columns = ([], [], [], [])
            for doc_id, place, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "place", "text")), strict=True):
                data = text.encode("utf-8", "replace")
                for n, k in enumerate(range(0, len(data), PIECE)):
                    for column, value in zip(columns, (doc_id, place, n, data[k : k + PIECE]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "place", "n", "piece"])

    drawn = texts.mapInArrow(run, "doc_id long, place long, n long, piece binary").orderBy(F.xxhash64("doc_id", "n"), "doc_id", "n").limit(most)
    return [bytes(r["piece"]) for r in sorted(drawn.collect(), key=lambda r: (r["place"], r["n"]))]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pieces: int = SAMPLE_PIECES) -> QualityModel:
    """A model of labels.quality (1 good, 0 bad) from at most `sample` documents of each class.

    Which ones is settled by a hash of doc_id. Half of them make the dictionaries, from at most `pieces` pieces drawn over the whole
    of their texts; the others, whole, make the curve, and are compressed where they are read. Labels that are null,
    contradict each other or are held out are not used; of rows that share a doc_id the least text is taken. The share of good labels is counted over
    all that may be used, and sets the curve's offset. Without labels of one of the classes every score is 0.5 or
    on the side of the other.
    """
    spark = docs.sparkSession
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most").where(~held_out(F.col("doc_id")))
    counts = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit("sample"))
    # 2 * sample rows at most: a bounded broadcast
    picked = [usable.where(F.col("quality") == q).orderBy(order, "doc_id").limit(sample) for q in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    known = stored(id_and_text(docs).join(ids, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")), "labelled")
    listed = sorted(known.select(order.alias("o"), "doc_id", "quality").collect())
    of = {q: [r["doc_id"] for r in listed if r["quality"] == q] for q in (0, 1)}
    if not of[0] or not of[1]:
        good, bad = counts.get(1, 0), counts.get(0, 0)
        return QualityModel(b"", b"", (0.0,) * 4, math.log((good + 1) / (bad + 1)))
    train = {q: d[: -(-len(d) // 2)] for q, d in of.items()}
    rest = {q: d[-(-len(d) // 2) :] or d for q, d in of.items()}
    numbered = {q: spark.createDataFrame(list(enumerate(train[q])), "place long, doc_id long") for q in of}
    good, bad = (_dictionary(_pieces(known.join(F.broadcast(numbered[q]), "doc_id").select("doc_id", "place", "text"), pieces)) for q in (1, 0))
    shared = spark.sparkContext.broadcast((good, bad))

    def described(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([list(differences(*shared.value, t)) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))], names=["doc_id", "x"])

    of_doc = {r["doc_id"]: r["x"] for r in known.join(F.broadcast(spark.createDataFrame([(d,) for q in of for d in rest[q]], "doc_id long")), "doc_id").select("doc_id", "text").mapInArrow(described, "doc_id long, x array<double>").collect()}
    x = np.array([of_doc[d] for q in (1, 0) for d in rest[q]])
    y = np.array([1.0] * len(rest[1]) + [0.0] * len(rest[0]))
    slopes, offset = logistic(x, y)
    # the sample's classes are not in the proportion of all labels
    shift = math.log(counts[1] / counts[0]) - math.log(len(rest[1]) / len(rest[0]))
    return QualityModel(good, bad, slopes, offset + shift)


def scored(docs: DataFrame, model: QualityModel, reject_below: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of `docs`, from its text alone.

    A null text is the empty text, whose differences are 0, so that its score is the curve's offset. Other
    columns are not read; an empty table gives an empty one. The model is two dictionaries of at most
    110 KiB, whatever the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            scores = [shared.value.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    out = id_and_text(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= reject_below).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, reject_below: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text scores `reject_below` or more; a null text is the empty text, repeated rows stay or go together, and an empty table gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    @F.pandas_udf("double")
    def score(texts):
        return texts.fillna("").map(shared.value.score).astype("float64")

    return docs.where(score(F.col("text").cast("string")) >= reject_below)
