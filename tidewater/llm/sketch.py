"""Document fingerprints: invertible Bloom lookup sketches of a document's paragraphs.

A text is cut into paragraphs: at line ends, and, so that a change inside a long line doesn't change all of it, behind
every word whose hash is divisible by ``CUT`` (about one in so many; the cut depends on the word alone, so equal
passages are cut alike wherever they stand). A paragraph's digest is a hash of its words in order; the second and
later equal paragraphs of a text get digests of their own.

The sketch is a table of cells. Each digest goes into ``HASHES`` cells, one in each part of the table, as (count, xor of digests,
xor of check values). Two sketches of one size subtract cell by cell; cells that then hold a single digest are peeled off
until none is left, which recovers the digests that only one of the two documents has. Where peeling gets stuck, both sketches
are made anew with more cells, and again, until it succeeds.

The published fingerprint is the smallest sketch as text, "paragraphs:cells:table in base64". The likeness of two
documents is the number of paragraphs in common over those in either, from the recovered difference.

Defined results: null and empty texts, and texts of white space, have no paragraphs and sketches of zeros; their
likeness is 1 to each other, 0 to others. Equal texts have equal fingerprints and likeness 1, as have texts that
differ in white space inside lines only.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm._spark import total_bytes
from tidewater.llm._text import U, hash_spans, mix, utf8, word_spans

CUT = 6
HASHES = 3
#: Cells of the smallest sketch, the published one; every retry has so many times more.
CELLS, GROW = 12, 4
#: Bytes of text of one range of ids; a task works on one range.
RANGE_BYTES = 8 << 20
WEIGHT_BYTES = 1024
_CELL = np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u4")])


def paragraphs(data: np.ndarray, offsets: np.ndarray, cut: int = CUT) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all rows' paragraphs, and the first of each row (rows + 1); the digests of a row are distinct."""
    s, e, first = word_spans(data, offsets)
    if not len(s):
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    h = hash_spans(data, s, e, lower=False)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    ends = h % U(cut) == 0
    ends[:-1] |= lines[s[1:]] != lines[s[:-1]]
    ends[first[1:][first[1:] > 0] - 1] = True
    last = np.flatnonzero(ends)
    starts = np.concatenate([[0], last[:-1] + 1])
    pos = np.arange(len(s)) - np.repeat(starts, last - starts + 1)
    digest = mix(np.add.reduceat(h * (mix(pos.astype(U)) | U(1)), starts))
    bounds = np.searchsorted(starts, first)
    row = np.repeat(np.arange(len(first) - 1), np.diff(bounds))
    by = np.lexsort((digest, row))
    digest, row = digest[by], row[by]
    fresh = np.ones(len(digest), bool)
    fresh[1:] = (digest[1:] != digest[:-1]) | (row[1:] != row[:-1])
    k = np.arange(len(digest))
    nth = k - np.maximum.accumulate(np.where(fresh, k, 0))
    return np.where(nth > 0, mix(digest + nth.astype(U) * U(0xD6E8FEB86659FD93)), digest), bounds


class Sketches:
    """Lookup tables of many rows, side by side: row r has ``cells[r]`` cells from ``start[r]`` on."""

    def __init__(self, cells: np.ndarray):
        self.part = -(-cells // HASHES)
        self.start = np.concatenate([[0], np.cumsum(self.part * HASHES)])
        n = self.start[-1]
        self.count, self.key, self.check = np.zeros(n, np.int64), np.zeros(n, U), np.zeros(n, U)

    def add(self, row: np.ndarray, digest: np.ndarray, sign: np.ndarray | int = 1) -> None:
        check = mix(digest ^ U(0xA0761D6478BD642F)) >> U(32)
        for k in range(HASHES):
            at = self.start[row] + k * self.part[row] + (mix(digest + U(k + 1)) % self.part[row].astype(U)).astype(np.int64)
            self.count += np.bincount(at, np.broadcast_to(sign, at.shape), len(self.count)).astype(np.int64)
            np.bitwise_xor.at(self.key, at, digest)
            np.bitwise_xor.at(self.check, at, check)

    def texts(self, sizes: np.ndarray) -> list[str]:
        """Each row's table as text; ``sizes`` has its number of digests."""
        table = np.zeros(len(self.count), _CELL)
        table["count"], table["key"], table["check"] = self.count, self.key, self.check
        return [f"{n}:{b - a}:{base64.b64encode(table[a:b].tobytes()).decode()}" for n, a, b in zip(sizes, self.start[:-1], self.start[1:], strict=True)]

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, digest and sign of all that comes off, and for each row whether nothing is left."""
        rows, digests, signs = [np.zeros(0, np.int64)], [np.zeros(0, U)], [np.zeros(0, np.int64)]
        while True:
            pure = np.flatnonzero(np.abs(self.count) == 1)
            pure = pure[mix(self.key[pure] ^ U(0xA0761D6478BD642F)) >> U(32) == self.check[pure]]
            if not len(pure):
                break
            row = np.searchsorted(self.start, pure, "right") - 1
            _, one = np.unique(mix(self.key[pure] ^ mix(row.astype(U) + U(1))), return_index=True)
            row, digest, sign = row[one], self.key[pure[one]], self.count[pure[one]]
            rows.append(row)
            digests.append(digest)
            signs.append(sign)
            self.add(row, digest, -sign)
        left = (self.count != 0) | (self.key != 0)
        clean = np.concatenate([[0], np.cumsum(left)])
        return np.concatenate(rows), np.concatenate(digests), np.concatenate(signs), clean[self.start[1:]] == clean[self.start[:-1]]


def _rows_of(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the chosen rows: index of all their digests, and which of the chosen each belongs to."""
    n = first[rows + 1] - first[rows]
    at = np.repeat(first[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return at, np.repeat(np.arange(len(rows)), n)


def differences(a: np.ndarray, b: np.ndarray, digest: np.ndarray, first: np.ndarray, cells: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For pairs of rows (a[k], b[k]): what is recovered, size by size, as (pairs done, pair, digest, sign) of those pairs."""
    open_ = np.arange(len(a))
    while len(open_):
        # more rows than cells to tell them apart can't be decoded: such pairs wait for a size that may do
        gap = np.abs((first[a[open_] + 1] - first[a[open_]]) - (first[b[open_] + 1] - first[b[open_]]))
        may = open_[gap <= cells]
        if len(may):
            sketch = Sketches(np.full(len(may), cells, np.int64))
            for side, sign in ((a, 1), (b, -1)):
                at, row = _rows_of(first, side[may])
                sketch.add(row, digest[at], sign)
            row, found, sign, done = sketch.peel()
            ok = done[row]
            yield may[done], may[row[ok]], found[ok], sign[ok]
            open_ = np.setdiff1d(open_, may[done])
        cells *= GROW


def likeness(a: np.ndarray, b: np.ndarray, digest: np.ndarray, first: np.ndarray, cells: int = CELLS) -> np.ndarray:
    """Likeness of each pair of rows."""
    mine, theirs = np.zeros(len(a)), np.zeros(len(a))
    for _, pair, _, sign in differences(a, b, digest, first, cells):
        mine += np.bincount(pair[sign > 0], minlength=len(a))
        theirs += np.bincount(pair[sign < 0], minlength=len(a))
    n = first[a + 1] - first[a]
    either = n + theirs
    return np.where(either > 0, (n - mine) / np.maximum(either, 1), 1.0)


def edited(text: str, following: str) -> str:
    """The last third of the text's code points replaced by as many of the following text's first (or all it has)."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def fingerprint_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells: int = CELLS) -> DataFrame:
    """Fingerprints of every text and of its edited version, and likenesses to that and to the next document.

    The next document is the one with the next smaller id; null ids come last, then the first again; rows of one id follow
    by text. Documents are dealt into ranges of ids of about as many bytes by quantiles; each range also gets a copy of the
    first document of the range after it, so that nothing else crosses ranges.
    """
    docs = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes(docs, text_col) // RANGE_BYTES))
    # an id counts once for every WEIGHT_BYTES of its text, so that ranges are even in bytes
    weighed = docs.select(F.explode(F.array_repeat(id_col, (F.octet_length(text_col) / WEIGHT_BYTES + 1).cast("int"))).alias("id"))
    edges = np.array(sorted(set(weighed.stat.approxQuantile("id", [k / n for k in range(1, n)], 0.1 / n))) if n > 1 else [], np.int64)
    sent = spark.sparkContext.broadcast(edges)  # one number per RANGE_BYTES of text

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            # range 0 has the largest ids, the last one null ids
            at = len(sent.value) - np.searchsorted(sent.value, ids.fill_null(0).to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(known, at, len(sent.value) + 1), pa.int32())], names=[*batch.schema.names, "range"])

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(deal, T.StructType([*rows.schema, T.StructField("range", T.IntegerType())]))

    ranged = dealt(docs)
    order = F.struct(F.coalesce(-F.col(id_col), F.lit(0)).alias("o"), F.col(text_col))
    heads = ranged.groupBy("range").agg(F.min(order).alias("head"))
    # one number per range, no texts
    to = F.coalesce(F.lag("range").over(Window.orderBy("range")), F.max("range").over(Window.partitionBy()))
    numbers = dealt(docs.select(id_col)).select("range").distinct().select("range", to.alias("to"))
    guests = heads.join(numbers, "range").select(F.lit(None).cast(docs.schema[id_col].dataType).alias(id_col), F.col(f"head.{text_col}").alias(text_col), F.col("to").alias("range"), F.lit(True).alias("guest"))

    def work(table: pa.Table) -> pa.Table:
        ids, texts, guest = table.column(id_col).to_pylist(), table.column(text_col).to_pylist(), table.column("guest").to_pylist()
        own = sorted((k for k in range(len(ids)) if not guest[k]), key=lambda k: (ids[k] is None, -(ids[k] or 0), texts[k]))
        flat = [texts[k] for k in [*own, guest.index(True)]]
        out: dict[str, list] = {id_col: [ids[k] for k in own], "n_chars": [len(t) for t in flat[:-1]]}
        out |= {k: [] for k in ("edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")}
        for a in range(0, len(own), 256):
            here = flat[a : a + 257]
            m = len(here) - 1
            changed = [edited(t, u) for t, u in zip(here[:-1], here[1:], strict=True)]
            digest, first = paragraphs(*utf8(pa.array([*here, *changed], pa.string())))
            prints = Sketches(np.full(2 * m + 1, cells, np.int64))
            at, row = _rows_of(first, np.arange(2 * m + 1))
            prints.add(row, digest[at])
            prints = prints.texts(np.diff(first))
            k = np.arange(m)
            near = likeness(np.concatenate([k, k]), np.concatenate([m + 1 + k, k + 1]), digest, first, cells).tolist()
            out["edited_sha256"] += [hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed]
            out["fingerprint"] += prints[:m]
            out["edited_fingerprint"] += prints[m + 1 :]
            out["near_edited"] += near[:m]
            out["near_next"] += near[m:]
        return pa.table({k: pa.array(v, table.schema.field(id_col).type if k == id_col else None) for k, v in out.items()})

    kind = docs.schema[id_col].dataType.simpleString()
    both = ranged.withColumn("guest", F.lit(False)).unionByName(guests)
    return both.groupBy("range").applyInArrow(work, f"{id_col} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_versions(spark.read.parquet(f"{sf_dir}/documents.parquet"))
