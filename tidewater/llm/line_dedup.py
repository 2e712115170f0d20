"""Line deduplication: sharded minimal perfect hashes over distinct line hashes.

1. Documents are dealt into blocks by a hash of their id; each block hands on its distinct line hashes with a
   count and the largest id (so a line of every document is one row per block, not one per document).
2. The hashes are summed up and those in ``min_docs`` documents or more kept. Each shard of them becomes an index:
   a minimal perfect hash (hash and displace) over an array of fingerprints and an array of counts and ids.
3. Blocks probe the shards' arrays with their distinct hashes; what they find comes back to the block, whose
   documents then drop lines. Documents are never joined with lines, and no array goes to all executors.

A shard holds the hashes of about ``SHARD_BYTES`` of text, so shards grow in number, not in size. The fingerprint
is the other 64 bits of a 128-bit hash; a line that isn't indexed passes for one with probability 2^-64.

Defined results: null or empty text is one empty line; every row is a document of its own, also where ids repeat
(the copies with the largest id all keep the line, as do null ids where no other id holds it); empty tables give
empty results; columns besides id and text are kept as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm._spark import BLOCK_BYTES, block_of, total_bytes
from tidewater.llm._text import U, mix

#: White space that a key loses at both ends.
_STRIP = " \t\n\x0b\x0c\r"
SHARD_BYTES = 16 << 20
_NO_ID = -(1 << 63)
#: Name of the block column beside a caller's own.
_BLOCK = "__block"


def _line_hashes(text: str | None, min_chars: int) -> tuple[list[str], list[bytes | None]]:
    """The lines and the 128-bit hashes of their keys, None for keys shorter than ``min_chars`` code points."""
    lines = (text or "").split("\n")
    keys = [x.strip(_STRIP) for x in lines]
    # lower() of bytes changes A-Z alone
    return lines, [xxhash.xxh3_128_digest(k.encode("utf-8", "surrogatepass").lower()) if len(k) >= min_chars else None for k in keys]


class PerfectHash:
    """Hash and displace: keys fall into buckets of about four; each bucket gets the seed that sends its keys to free slots.

    n keys take n slots (minimal); arrays that are indexed by slot need no keys.
    """

    def __init__(self, seeds: np.ndarray, n: int):
        self.seeds, self.n = seeds, n

    @classmethod
    def build(cls, keys: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """The hash over distinct uint64 keys, and each key's slot."""
        n = len(keys)
        n_buckets = max(1, n // 4)
        bucket = (mix(keys) % U(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        sizes = np.diff(first)
        taken, slots = np.zeros(n, bool), np.zeros(n, np.int64)
        seeds = np.zeros(n_buckets, np.int64)
        big = np.argsort(-sizes, kind="stable")
        for b in big[sizes[big] > 1]:
            members = order[first[b] : first[b + 1]]
            own = keys[members]
            seed = 1
            while True:
                at = (mix(own + U(seed * 0x9E3779B97F4A7C15 % (1 << 64))) % U(n)).astype(np.int64)
                if not taken[at].any() and len(np.unique(at)) == len(at):
                    break
                seed += 1
            taken[at] = True
            slots[members], seeds[b] = at, seed
        # a bucket of one key names its slot outright
        ones = big[sizes[big] == 1]
        free = np.flatnonzero(~taken)[: len(ones)]
        slots[order[first[ones]]] = free
        seeds[ones] = -1 - free
        return cls(seeds, n), slots

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for any keys; of keys that weren't built in, some other key's."""
        seed = self.seeds[(mix(keys) % U(len(self.seeds))).astype(np.int64)]
        at = (mix(keys + seed.astype(U) * U(0x9E3779B97F4A7C15)) % U(max(1, self.n))).astype(np.int64)
        return np.where(seed < 0, -1 - seed, at)


_FOUND = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("n", T.LongType()), T.StructField("largest", T.LongType())])


def find_repeats(blocks: DataFrame, n_shards: int, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(block, hi, lo, n, largest) of every line hash of a block that ``min_docs`` documents or more hold."""

    def extract(table: pa.Table) -> pa.Table:
        found: dict[bytes, list] = {}
        block = table.column(_BLOCK)[0].as_py()
        for doc, text in zip(table.column(id_col).to_pylist(), table.column(text_col).to_pylist(), strict=True):
            doc = _NO_ID if doc is None else doc
            for h in {h for h in _line_hashes(text, min_chars)[1] if h}:
                if (x := found.get(h)) is None:
                    found[h] = [1, doc]
                else:
                    x[0] += 1
                    x[1] = max(x[1], doc)
        both = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
        return pa.table({"block": pa.array(np.full(len(found), block), pa.int32()), "hi": both[:, 0], "lo": both[:, 1], "n": pa.array([x[0] for x in found.values()], pa.int64()), "largest": pa.array([x[1] for x in found.values()], pa.int64())})

    lines = blocks.groupBy(_BLOCK).applyInArrow(extract, _FOUND).withColumn("shard", F.pmod(F.col("hi"), F.lit(n_shards)).cast("int"))
    counts = lines.groupBy("shard", "hi", "lo").agg(F.sum("n").alias("n"), F.max("largest").alias("largest")).filter(F.col("n") >= min_docs)

    def index(table: pa.Table) -> pa.Table:
        hi, lo, n, largest = (table.column(c).to_numpy() for c in ("hi", "lo", "n", "largest"))
        # keys are the first halves; the rare second line with the same half stands in a list beside the arrays
        _, firsts = np.unique(hi, return_index=True)
        twins = np.setdiff1d(np.arange(len(hi)), firsts)
        hi_, lo_ = hi[firsts].view(U), lo[firsts]
        perfect, slots = PerfectHash.build(hi_)
        fingerprints, counted, ids = np.zeros(len(firsts), "<i8"), np.zeros(len(firsts), "<i8"), np.zeros(len(firsts), "<i8")
        fingerprints[slots], counted[slots], ids[slots] = lo_, n[firsts], largest[firsts]
        more = np.stack([hi[twins], lo[twins], n[twins], largest[twins]]).astype("<i8")
        return pa.table({"shard": table.column("shard").slice(0, 1), **{k: pa.array([v.astype("<i8").tobytes()], pa.binary()) for k, v in (("seeds", perfect.seeds), ("fingerprints", fingerprints), ("counts", counted), ("ids", ids), ("twins", more))}})

    # shards are few bytes and much work: a number of partitions that is given isn't merged by bytes
    spread = counts.repartition(min(n_shards, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "shard")
    shards = spread.groupBy("shard").applyInArrow(index, "shard int, seeds binary, fingerprints binary, counts binary, ids binary, twins binary")

    def probe(asked: pa.Table, shard: pa.Table) -> pa.Table:
        block, hi, lo = (asked.column(c).to_numpy() for c in ("block", "hi", "lo"))
        if not len(block) or not shard.num_rows:
            return pa.table({c: pa.array([], pa.int32() if c == "block" else pa.int64()) for c in _FOUND.names})
        seeds, fingerprints, counts, ids, twins = (np.frombuffer(shard.column(c)[0].as_py(), "<i8") for c in ("seeds", "fingerprints", "counts", "ids", "twins"))
        at = PerfectHash(seeds, len(ids)).slots(hi.view(U))
        hit, n, largest = fingerprints[at] == lo, counts[at].copy(), ids[at].copy()
        for h, x, c, i in zip(*twins.reshape(4, -1), strict=True):
            same = (hi == h) & (lo == x)
            hit |= same
            n[same], largest[same] = c, i
        return pa.table({"block": pa.array(block[hit], pa.int32()), "hi": hi[hit], "lo": lo[hit], "n": n[hit], "largest": largest[hit]})

    return lines.select("shard", "block", "hi", "lo").groupBy("shard").cogroup(shards.groupBy("shard")).applyInArrow(probe, _FOUND)


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with repeated lines dropped from ``text_col``; adds n_lines and n_dropped (long).

    A line's key is the line without white space at its ends and with A-Z as a-z. Keys of at least ``min_chars``
    code points that ``min_docs`` documents hold lose their lines everywhere but in the document with the largest id.
    """
    spark = docs.sparkSession
    size = total_bytes(docs, text_col)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = docs.drop("n_lines", "n_dropped").withColumn(_BLOCK, block_of(max(least, -(-size // BLOCK_BYTES)), id_col, text_col))
    found = find_repeats(blocks, max(least, -(-size // SHARD_BYTES)), min_docs, min_chars, id_col, text_col)
    out = T.StructType([*[f for f in blocks.schema if f.name != _BLOCK], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def drop(table: pa.Table, found: pa.Table) -> pa.Table:
        both = np.stack([found.column("hi").to_numpy(), found.column("lo").to_numpy()], axis=1).astype("<i8")
        keeper = dict(zip([x.tobytes() for x in both], found.column("largest").to_pylist(), strict=True))
        texts, n_lines, n_dropped = [], [], []
        for doc, text in zip(table.column(id_col).to_pylist(), table.column(text_col).to_pylist(), strict=True):
            doc = _NO_ID if doc is None else doc
            lines, hashes = _line_hashes(text, min_chars)
            kept = [x for x, h in zip(lines, hashes, strict=True) if h is None or keeper.get(h, doc) == doc]
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
            texts.append(text if len(kept) == len(lines) else "\n".join(kept))
        table = table.drop_columns([_BLOCK])
        at = table.column_names.index(text_col)
        table = table.set_column(at, text_col, pa.array(texts, table.schema.field(text_col).type))
        return table.append_column("n_lines", pa.array(n_lines, pa.int64())).append_column("n_dropped", pa.array(n_dropped, pa.int64()))

    return blocks.groupBy(_BLOCK).cogroup(found.groupBy("block")).applyInArrow(drop, out)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = dedup_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc) >= 3),
m AS (SELECT k.doc, k.doc_id, k.line, k.pos, r.key IS NULL OR r.keeper IS NOT DISTINCT FROM k.doc_id AS stays FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE NOT stays)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE stays), '')) AS kept_sha256
FROM m GROUP BY doc, doc_id
"""
