"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors, one for each of its words, one for each character n-gram inside a word
and one for each word that repeats the word before it, looked up by hash in one table; a softmax layer over that mean gives the class. The table and the layer are
trained together by stochastic gradient descent in numpy, on the driver, from a sample of labelled rows with a
fixed bound: ``FIT_ROWS`` per class, those with the smallest hash of their id. Spark picks the sample, turns its
texts into counts of features in its tasks, and scores all rows.

As the layer is linear, class scores of a mean of vectors are means of class scores of vectors: for scoring, the
model is one number per bucket (the difference of the two classes), which each task gathers over whole texts.

Defined results: null and empty texts, and texts without words, have no features and get the score of the bias
alone; with labels of one class only, or none, every score is the share of label 1 (0.5 without labels); repeated
ids in the labels count once, label 1 winning; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm._spark import fold
from tidewater.llm._text import U, hash_spans, mix, pieces, utf8, word_spans

#: Labelled rows of each class that a fit reads at most.
FIT_ROWS = 1500
BUCKET_BITS = 17
NGRAMS = (2, 4)
DIM = 8


def feature_ids(data: np.ndarray, offsets: np.ndarray, bits: int = BUCKET_BITS, ngrams: tuple[int, ...] = NGRAMS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket ids of the features of each kind, with the place (byte) of each: words, then n-grams of bytes inside words."""
    s, e, _ = word_spans(data, offsets)
    shift = U(64 - bits)
    words = hash_spans(data, s, e)
    yield (words >> shift).astype(np.int64), s
    if not len(s):
        return
    # the bigram of a word with itself is one feature, whatever the word
    again = np.flatnonzero((words[1:] == words[:-1]) & (np.searchsorted(offsets, s[1:], "right") == np.searchsorted(offsets, s[:-1], "right"))) + 1
    yield np.full(len(again), int(mix(np.array([12345], U))[0] >> shift)), s[again]
    word = np.repeat(np.arange(len(s)), e - s)
    at = np.arange(len(word)) - np.repeat(np.cumsum(e - s) - (e - s), e - s) + s[word]
    rest = e[word] - at
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(U)
    for n in ngrams:
        ok = at[rest >= n]
        h = np.full(len(ok), n, U)
        for k in range(n):
            h = (h << U(8)) ^ padded[ok + k] ^ (h >> U(40))
        yield (mix(h) >> shift).astype(np.int64), ok


@dataclass
class QualityModel:
    weights: np.ndarray  # of each bucket, label 1 minus label 0
    bias: float
    bits: int = BUCKET_BITS
    ngrams: tuple[int, ...] = NGRAMS

    def scores(self, col: pa.Array) -> np.ndarray:
        """Probability of label 1 for each text."""
        data, offsets = utf8(col)
        out = np.zeros(len(offsets) - 1)
        for a, b in pieces(offsets):
            part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            total, n = np.zeros(b - a), np.zeros(b - a)
            for ids, at in feature_ids(part, own, self.bits, self.ngrams):
                first = np.searchsorted(at, own)
                sums = np.concatenate([[0.0], np.cumsum(self.weights[ids], dtype=np.float64)])
                total += sums[first[1:]] - sums[first[:-1]]
                n += np.diff(first)
            out[a:b] = total / np.maximum(n, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], share: float, bits: int = BUCKET_BITS, dim: int = DIM, epochs: int = 6, rate: float = 1.0, seed: int = 7) -> tuple[np.ndarray, float]:
    """SGD over (label, bucket ids, counts). Classes are weighted to ``share``, that of label 1. Returns weights and bias."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    layer, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    n1 = sum(r[0] for r in rows)
    scale = (2 * (1 - share) * len(rows) / max(1, len(rows) - n1) / 2, 2 * share * len(rows) / max(1, n1) / 2)
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, ids, counts = rows[k]
            lr = rate * (1 - done / steps) * scale[y]
            done += 1
            if not len(ids):
                continue
            w = counts / counts.sum()
            hidden = w @ table[ids]
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = layer.T @ p
            layer -= lr * np.outer(p, hidden)
            bias -= lr * 0.1 * p
            # the mean divides each feature's step by the number of features; the usual factor of that number is kept
            # below one per feature so that frequent features don't run away
            table[ids] -= np.outer(np.minimum(w * len(ids), 1.0) * lr, back).astype(np.float32)
    return (table @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0])


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fit on at most ``fit_rows`` rows of each class among ``labels`` (id_col, label_col); rows without text or label don't count."""
    known = labels.filter(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_y"))
    n0, n1 = (known.agg(F.count_if(F.col("_y") == k)) for k in (0, 1))
    n0, n1 = n0.first()[0], n1.first()[0]
    share = n1 / (n0 + n1) if n0 + n1 else 0.5
    if not n0 or not n1:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return QualityModel(np.zeros(1 << BUCKET_BITS, np.float32), float(np.log(share / (1 - share))))
    chosen = [known.filter(F.col("_y") == k).orderBy(F.xxhash64(id_col), id_col).limit(fit_rows) for k in (0, 1)]
    picked = chosen[0].unionByName(chosen[1])  # 2 * fit_rows ids at most

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys, ids_, counts_ = [], [], []
            for y, text in zip(batch.column("_y").to_pylist(), batch.column(text_col), strict=True):
                data, offsets = utf8(pa.array([text.as_py()], pa.string()))
                ids, n = np.unique(np.concatenate([x for x, _ in feature_ids(data, offsets)]), return_counts=True)
                ys.append(y)
                ids_.append(ids.astype("<i4").tobytes())
                counts_.append(n.astype("<f4").tobytes())
            yield pa.record_batch([pa.array(ys, pa.int32()), pa.array(ids_, pa.binary()), pa.array(counts_, pa.binary())], names=["y", "ids", "n"])

    texts = docs.select(id_col, text_col).join(F.broadcast(picked), id_col).select(text_col, "_y")
    rows = texts.mapInArrow(counts, "y int, ids binary, n binary").collect()
    rows = sorted(((r.y, bytes(r.ids), bytes(r.n)) for r in rows))  # the order of arrival isn't fixed, that of training is
    data = [(y, np.frombuffer(i, "<i4"), np.frombuffer(n, "<f4")) for y, i, n in rows]
    weights, bias = train(data, share)
    return QualityModel(weights, bias)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """Adds score (double) and predicted (int) to the documents."""
    docs = docs.drop("score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^BUCKET_BITS floats, whatever the input

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = sent.value.scores(batch.column(batch.schema.get_field_index(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(score, T.StructType([*docs.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> QualityModel:
    """The model of the labels table, without the rows that are held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fit_quality(docs, labels.filter(~fold(F.col("doc_id"), 4, 2)))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_quality(docs, fitted(spark, docs, sf_dir)).select("doc_id", fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")
