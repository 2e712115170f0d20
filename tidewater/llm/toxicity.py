"""Toxicity: non-negative positive-unlabelled learning.

The classifier is linear over the presence of hashed words and word prefixes. It is trained in numpy from confirmed
toxic documents (P, a sample of ``FIT_TOXIC`` labelled rows at most) and from all documents of the training part,
labelled or not (U). No document counts as clean. With g the decision function and l the sigmoid loss, the risk is

    prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])

the second term being the risk on clean text, from which the toxic share of U is taken out; where it turns
negative, the step goes against its own gradient instead, which keeps the fit from explaining U away. The class prior is
a parameter; by default it is the share of confirmed toxic rows among the labelled rows.

Spark counts features over all confirmed toxic and all training documents and keeps the ``MAX_FEATURES`` whose document
frequencies differ most (z-score); training sees those only. U is dealt by a hash of the id into blocks of about
``BLOCK_ROWS`` documents; each block is fitted against P in a task of its own, and the mean of the blocks' weights is the
model, so that every document counts and no task or driver holds more than a block. Scoring runs over whole texts of all documents.

Defined results: null and empty texts have no features and get the score of the bias alone; without confirmed toxic
rows every score is 0; repeated ids in the labels count once, toxic winning; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm._spark import cut, fold, free
from tidewater.llm._text import U, hash_spans, pieces, utf8, word_spans

FIT_TOXIC = 4000
#: Unlabelled documents of a block; their number decides only how many blocks there are.
BLOCK_ROWS = 8000
MAX_FEATURES = 4096
#: Up to so many ids of toxic documents (they have been counted) are broadcast, so that texts stay where they are.
BROADCAST_IDS = 1_000_000
#: Weights are added up over the blocks as whole numbers of this unit: the sum doesn't depend on their order.
UNIT = 2.0**-16
#: Least z-score of a feature, and least number of toxic documents that have it.
MIN_Z, MIN_DOCS = 4.0, 5
BITS = 22
PREFIXES = (4, 5, 6)


def doc_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of every word and word prefix (of so many bytes) of the rows; with repeats."""
    s, e, first = word_spans(data, offsets, words_only=True)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    shift = U(64 - BITS)
    ids, rows = [(hash_spans(data, s, e) >> shift).astype(np.int64)], [row]
    for k in PREFIXES:
        longer = e - s > k
        salt = U(k * 0x9E3779B97F4A7C15 % (1 << 64))
        ids.append(((hash_spans(data, s[longer], s[longer] + k) ^ salt) >> shift).astype(np.int64))
        rows.append(row[longer])
    return np.concatenate(rows), np.concatenate(ids)


@dataclass
class ToxicityModel:
    ids: np.ndarray  # sorted buckets of the features
    weights: np.ndarray
    bias: float

    def scores(self, col: pa.Array) -> np.ndarray:
        data, offsets = utf8(col)
        table = np.zeros(1 << BITS, np.float32)
        table[self.ids] = self.weights
        out = np.full(len(offsets) - 1, self.bias)
        for a, b in pieces(offsets):
            rows, ids = doc_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            known = table[ids] != 0
            both = np.unique(rows[known] << BITS | ids[known])
            out[a:b] += np.bincount(both >> BITS, table[both & ((1 << BITS) - 1)], b - a)
        return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def train_nnpu(rows: np.ndarray, cols: np.ndarray, toxic: np.ndarray, n_features: int, prior: float, steps: int = 400, rate: float = 0.1, decay: float = 1e-5, beta: float = 0.0) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk. (rows, cols) are the features present; toxic marks the rows of P, the others are U."""
    w, m, v = np.zeros(n_features + 1), np.zeros(n_features + 1), np.zeros(n_features + 1)
    w[-1] = -1.0
    n = len(toxic)
    n_p, n_u = max(1, toxic.sum()), max(1, (~toxic).sum())
    for t in range(1, steps + 1):
        g = np.bincount(rows, w[cols], n) + w[-1]
        p = 1 / (1 + np.exp(np.clip(g, -50, 50)))  # sigmoid loss l(g)
        slope = p * (1 - p)  # of l(-g); that of l(g) is its negative
        clean = (1 - p)[~toxic].sum() / n_u - prior * (1 - p)[toxic].sum() / n_p
        d_clean = np.where(toxic, -prior * slope / n_p, slope / n_u)
        d = np.where(toxic, -prior * slope / n_p, 0) + d_clean if clean >= -beta else -d_clean
        grad = np.append(np.bincount(cols, d[rows], n_features), d.sum()) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _counter(wanted=None):
    """Counts, task by task, the documents that have a bucket; with ``wanted`` (packed bits, broadcast) only those buckets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = None if wanted is None else np.unpackbits(wanted.value).view(bool)
        total = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in pieces(offsets, 8 << 20):
                rows, ids = doc_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if allowed is not None:
                    rows, ids = rows[allowed[ids]], ids[allowed[ids]]
                ids, n = np.unique(np.unique(rows << BITS | ids) & ((1 << BITS) - 1), return_counts=True)
                total[ids] += n.astype(np.int32)
        ids = np.flatnonzero(total)
        for k in range(0, len(ids), 1 << 16):
            part = ids[k : k + (1 << 16)]
            yield pa.record_batch([pa.array(part), pa.array(total[part].astype(np.int64))], names=["id", "c"])

    return count


def fit_toxicity(docs: DataFrame, labels: DataFrame, train_rows: Column, prior: float | None = None, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fit on rows for which ``train_rows`` (over id_col) holds."""
    known = labels.filter(train_rows & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("_y"))
    n, n1 = known.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0))).first()
    if not n1:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0, np.float32), -50.0)
    prior = min(0.9, max(1e-4, n1 / n)) if prior is None else prior
    toxic = known.filter("_y = 1").select(id_col)
    train = docs.filter(train_rows).select(id_col, text_col)
    small = F.broadcast if n1 <= BROADCAST_IDS else lambda df: df
    confirmed = train.join(small(toxic), id_col, "left_semi")

    # a feature has to stand in MIN_DOCS toxic documents; only such ones are counted over the whole training part
    p_counts = cut(confirmed.select(text_col).mapInArrow(_counter(), "id long, c long").groupBy("id").agg(F.sum("c").alias("p")).filter(F.col("p") >= MIN_DOCS), "toxic-features")
    wanted = np.zeros(1 << BITS, bool)
    wanted[p_counts.select("id").toArrow().column("id").to_numpy()] = True  # 2 ** BITS buckets at most
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))
    n_p, n_u = confirmed.count(), train.count()
    if not n_u:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0, np.float32), -50.0)
    n_p = max(1, n_p)
    pooled = (F.col("p") + F.col("u") + 1) / (n_p + n_u + 2)
    z = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u))
    u_counts = train.select(text_col).mapInArrow(_counter(sent), "id long, c long").groupBy("id").agg(F.sum("c").alias("u"))
    best = p_counts.join(u_counts, "id").withColumn("z", z).filter(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "id").limit(MAX_FEATURES)
    features = np.array(sorted(r.id for r in best.select("id").collect()), np.int64)
    free(p_counts)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in pieces(offsets, 8 << 20):
                rows, ids = doc_features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                at = np.minimum(np.searchsorted(features, ids), max(0, len(features) - 1))
                ok = features[at] == ids if len(features) else np.zeros(len(ids), bool)
                both = np.unique(rows[ok] << 16 | at[ok])
                ends = np.searchsorted(both >> 16, np.arange(b - a + 1))
                at = (both & 65535).astype("<u2")
                yield pa.record_batch([batch.column(1).slice(a, b - a), pa.array([at[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:])], pa.binary())], names=["block", "at"])

    chosen = toxic.orderBy(F.xxhash64(id_col), id_col).limit(FIT_TOXIC)  # labelled rows: the documented bound
    marked = train.join(F.broadcast(chosen), id_col, "left_semi").select(text_col, F.lit(0).alias("block"))
    positive = sorted(bytes(r["at"]) for r in marked.mapInArrow(present, "block int, at binary").collect())
    n_blocks = -(-n_u // BLOCK_ROWS)
    unlabelled = train.select(text_col, F.pmod(F.xxhash64(id_col), F.lit(n_blocks)).cast("int").alias("block")).mapInArrow(present, "block int, at binary")
    p_sent = docs.sparkSession.sparkContext.broadcast(positive)  # FIT_TOXIC rows of MAX_FEATURES numbers at most

    def fit(block: pa.Table) -> pa.Table:
        rows = [*p_sent.value, *sorted(block.column("at").to_pylist())]  # in a fixed order: reruns agree
        cols = [np.frombuffer(at, "<u2") for at in rows]
        is_toxic = np.arange(len(rows)) < len(p_sent.value)
        w, bias = train_nnpu(np.repeat(np.arange(len(rows)), [len(c) for c in cols]), np.concatenate([np.zeros(0, "<u2"), *cols]).astype(np.int64), is_toxic, len(features), prior)
        whole = np.rint(np.append(w, bias) * (block.num_rows / UNIT)).astype(np.int64)
        return pa.table({"at": np.arange(len(whole), dtype=np.int32), "w": whole})

    dealt = unlabelled.repartition(n_blocks, "block")  # by number: the rows are small, and a fit takes seconds
    summed = dealt.groupBy("block").applyInArrow(fit, "at int, w long").groupBy("at").agg(F.sum("w").alias("w")).collect()  # MAX_FEATURES + 1 rows at most
    total = np.zeros(len(features) + 1)
    for r in summed:
        total[r["at"]] = r.w * UNIT / n_u
    return ToxicityModel(features, total[:-1].astype(np.float32), float(total[-1]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """Adds score (double) and predicted (int) to the documents."""
    docs = docs.drop("score", "predicted")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # MAX_FEATURES weights at most

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = sent.value.scores(batch.column(batch.schema.get_field_index(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(score, T.StructType([*docs.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 5, 0)
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
