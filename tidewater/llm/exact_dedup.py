"""Exact deduplication: documents split by successive bytes until a group is one document or its texts have ended.

Most significant bytes first: a round reads the next stretch of the lower-cased texts of all groups that are still
open and splits each group by it. A part of one document is done; a part whose texts ended in the stretch is a group
of equal texts; the rest goes on to the next, longer stretch. Parts are told apart by the bytes themselves, no digest
stands for a text. Stretches end between characters and grow ``growth``-fold, so a text of n bytes takes part in about
log(n / first) rounds, and only as long as another text starts with the same bytes.

Groups are counted where they lie before anything is shuffled. Documents then meet the counts of their part by a join;
parts with over a thousandth of all documents (a thousand at most) are dealt over several tasks there. The join is a
merge at every size, so that its cost grows in proportion.

Defined results: null text counts as empty, and empty texts are equal; null ids are smaller than all others; rows that
repeat both id and text are one document and share ``kept``, of which ``drop_copies`` leaves one row; an empty table
gives an empty one; other columns stay, save that
``radix_groups`` replaces those named like its results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm._spark import cut, free, text_of

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Characters of the first stretch, and how much longer each next one is.
FIRST, GROWTH = 64, 16
#: A part with more than this share of the documents is dealt over tasks, so at most its inverse of parts are.
HOT = 1 / 1000
_GROUP, _HEAD, _ENDED, _SALT, _PART, _N, _KEEP = "__group", "__head", "__ended", "__salt", "__part", "__n", "__keep"


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z alone lower-cased; texts without other letters take the fast path of ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def _salted(rows: DataFrame, parts: DataFrame, most: int, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a salt, and parts once for every salt that their rows can have."""
    named = F.xxhash64(_GROUP, _HEAD, _ENDED)
    # a part here has over ``most`` rows: by count there are 1 / HOT of them at most
    hot = F.broadcast(parts.filter(F.col(_N) > most).groupBy(named.alias(_PART + "_h")).agg((F.max(_N) / most).cast("int").alias(_SALT + "s")))
    spread = F.coalesce(F.col(_SALT + "s"), F.lit(0))
    rows = rows.join(hot, named == F.col(_PART + "_h"), "left").withColumn(_SALT, F.pmod(F.xxhash64(id_col) + F.spark_partition_id(), spread + 1).cast("int"))
    parts = parts.join(hot, named == F.col(_PART + "_h"), "left").withColumn(_SALT, F.explode(F.sequence(F.lit(0), spread)))
    return rows.drop(_PART + "_h", _SALT + "s"), parts.drop(_PART + "_h", _SALT + "s")


def radix_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = FIRST, growth: int = GROWTH) -> tuple[DataFrame, list[DataFrame]]:
    """The documents with keep_id (largest id of the equal texts), group_size (long) and kept; and the tables they are read from.

    The tables can be freed once the result has been written.
    """
    docs = docs.drop("keep_id", "group_size", "kept", _GROUP, _HEAD, _ENDED, _SALT, _PART, _N, _KEEP)
    columns = docs.columns
    most = max(1, int(docs.count() * HOT))
    start, width, live, done, tables = 0, first, docs.withColumn(_GROUP, F.lit(0).cast("long")), [], []
    while True:
        text = text_of(live, text_col)
        # a stretch is counted in characters, so that no character is torn; equal bytes are equal characters
        rows = live.withColumn(_HEAD, ascii_lower(F.substring(text, start + 1, width))).withColumn(_ENDED, F.char_length(text) <= start + width)
        counted = rows.groupBy(_GROUP, _HEAD, _ENDED).agg(F.count(F.lit(1)).alias(_N), F.max(id_col).alias(_KEEP)).filter(F.col(_N) > 1)
        # numbered as it is written: a part keeps its number whatever is computed again later
        parts = cut(counted.withColumn(_PART, F.monotonically_increasing_id()), "exact-parts")
        tables.append(parts)
        salted, spread = _salted(rows, parts, most, id_col)
        met = salted.join(spread.hint("merge"), [_GROUP, _HEAD, _ENDED, _SALT], "left")
        out = met.filter(F.col(_PART).isNull() | F.col(_ENDED))
        done.append(out.select(*columns, F.when(F.col(_PART).isNull(), F.col(id_col)).otherwise(F.col(_KEEP)).alias("keep_id"), F.coalesce(_N, F.lit(1)).cast("long").alias("group_size")))
        if parts.filter(~F.col(_ENDED)).isEmpty():
            break
        live = cut(met.filter(F.col(_PART).isNotNull() & ~F.col(_ENDED)).select(*columns, F.col(_PART).alias(_GROUP)), "exact-open")
        tables.append(live)
        start, width = start + width, width * growth
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id"))), tables


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without exact copies: of equal texts the one with the largest id stays, in one row."""
    # a row travels whole, so that no name in it can clash
    packed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*docs.columns).alias("row"))
    found, tables = radix_groups(packed, "id", "text")
    alone = found.filter(F.col("group_size") == 1).select("row.*")
    # rows of one id and text are combined where they lie; any of them serves
    tied = found.filter(F.col("kept") & (F.col("group_size") > 1)).withColumn("norm", ascii_lower(text_of(found)))
    out = cut(alone.unionByName(tied.groupBy("id", "norm").agg(F.first("row").alias("row")).select("row.*")), "exact-kept")
    free(*tables)
    return out


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # the digest is a column of the result and no part of the comparison; made here, it travels in place of the text
    docs = docs.withColumn("text_sha256", F.sha2(ascii_lower(text_of(docs)).cast("binary"), 256))
    found, tables = radix_groups(docs)
    out = cut(found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256"), "exact-groups")
    free(*tables)
    return out


OP11_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM t WINDOW same AS (PARTITION BY norm)
"""
