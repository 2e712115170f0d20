"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Every source has a weight and a size (its words). Targets share the words of all sources in
proportion to the weights, but no source is taken more than ``max_epochs`` times: the excess of a
clamped source goes to the others, by weight, until none is above its cap. The water level has a
closed form: with the sources in order of cap / weight, the first k are clamped, and
level = (total - their caps) / (weights of the others), for the first k at which the next source
stays below its cap.

The sample: with f = target / size every document is taken floor(f) times whole; for the fraction,
documents are put in a seeded order and taken while the source's remaining words last, the one at the
edge in part. So every source meets its target to the word, and no document exceeds ``max_epochs``
times its size. The order is by md5 of seed and id: reruns agree. A source is cut into buckets by that
md5; sums per bucket tell in which bucket the fraction ends, and only the rows of that one are put in order,
so that a hot source isn't one task and texts stay where they are: the rest is a comparison with the edge.

Defined results: null text has size 0; a null source is a source of its own and comes last; sources of
size 0 have target 0; rows equal in id and text share what is left at the edge evenly, in whole words; an
empty table gives an empty result; other columns are kept, those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a bucket of a source that the sample aims at.
BUCKET_ROWS = 2000
#: Up to so many sources (one row of sums each) are broadcast; more are joined by source and bucket.
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text, 0 for null.

    A word starts where a character that isn't white space follows white space or the start.
    """
    plain = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(plain, " "), lambda w: w != "")).cast("long")


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Targets of (source, source_size, weight) rows: adds ``target`` double.

    One row per source goes through an ordered window; that table holds sums only.
    """
    cap = F.col("source_size") * F.lit(max_epochs)
    order = Window.orderBy((cap / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    with_level = sources.withColumns(
        {
            "_cap": cap,
            "_level": (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))).cast("double") / F.sum("weight").over(after).cast("double"),
        }
    )
    level = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.struct(F.col("_cap") / F.col("weight"), F.col("_level")))).over(everything)["_level"]
    return with_level.withColumn("target", F.least(F.col("_cap").cast("double"), F.col("weight") * level)).drop("_cap", "_level")


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Adds size, source_size, target and taken (words) to the documents. ``weights`` repeat over the sources by code point."""
    n_buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // bucket_rows))
    made = ["size", "source_size", "target", "taken"]
    base = docs.drop(*[c for c in made if c not in (id_col, text_col, source_col)])
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    # the first 8 hex digits of the md5, spread evenly over the buckets in the order of the md5
    bucket = F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * F.lit(n_buckets) / F.lit(1 << 32)).cast("int")
    sized = base.withColumn("size", word_count(F.col(text_col))).withColumn("_key", key).withColumn("_bucket", bucket)

    buckets = sized.groupBy(F.col(source_col).alias("source"), "_bucket").agg(F.sum("size").alias("_words"))
    sources = buckets.groupBy("source").agg(F.sum("_words").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = water_fill(sources.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (nth % len(weights)).cast("int") + 1)), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("_whole", whole).withColumn("_rest", F.round(F.col("target") - F.col("_whole") * F.col("source_size")).cast("long"))
    # the bucket in which a source's fraction ends, and in it the document at the edge; only those buckets' rows are sorted
    ahead = F.coalesce(F.sum("_words").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = buckets.withColumn("_ahead", ahead).join(sources.select(F.col("source").alias("_s"), "_rest"), F.col("source").eqNullSafe(F.col("_s")))
    ends = ends.filter((F.col("_ahead") <= F.col("_rest")) & (F.col("_rest") < F.col("_ahead") + F.col("_words"))).select("_s", F.col("_bucket").alias("_b"), (F.col("_rest") - F.col("_ahead")).alias("_left"))
    tie = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    keyed = base.withColumn("_key", key).withColumn("_bucket", bucket)
    # sources are few as a rule; where they are, texts needn't be dealt by source, which a hot one would make uneven
    narrow = base.select(source_col).distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    edge = keyed.join(F.broadcast(ends) if narrow else ends, F.col(source_col).eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    edge = edge.select("_s", "_b", "_left", "_key", word_count(F.col(text_col)).alias("size"), tie.alias("_tie")).groupBy("_s", "_b", "_left", "_key", "size", "_tie").agg(F.count("*").alias("_same"))
    before = F.coalesce(F.sum(F.col("size") * F.col("_same")).over(Window.partitionBy("_s").orderBy("_key", "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = edge.withColumn("_before", before).filter((F.col("_before") <= F.col("_left")) & (F.col("_left") < F.col("_before") + F.col("size") * F.col("_same")))
    edge = edge.select(F.col("_s").alias("_e"), F.struct("_b", "_key", "size", "_tie").alias("_edge"), F.floor((F.col("_left") - F.col("_before")) / F.col("_same")).alias("_part"))
    plan = sources.withColumnRenamed("source", "_s").join(edge, F.col("_s").eqNullSafe(F.col("_e")), "left").select("_s", "source_size", "target", "_whole", "_rest", "_edge", "_part")

    same = F.col(source_col).eqNullSafe(F.col("_s"))
    if narrow:
        joined = sized.join(F.broadcast(plan), same)
    else:  # by source and bucket: a hot source is spread over its buckets
        spread = plan.join(buckets.select(F.col("source").alias("_p"), F.col("_bucket").alias("_pb")), F.col("_s").eqNullSafe(F.col("_p")))
        joined = sized.join(spread, same & (F.col("_bucket") == F.col("_pb")))
    here, end = F.struct("_bucket", "_key", "size"), F.struct("_edge._b", "_edge._key", "_edge.size")
    at_edge = F.when(tie < F.col("_edge._tie"), F.col("size")).when(tie == F.col("_edge._tie"), F.col("_part")).otherwise(0)
    part = F.when(F.col("_edge").isNull(), F.when(F.col("_rest") > 0, F.col("size")).otherwise(0)).when(here < end, F.col("size")).when(here == end, at_edge).otherwise(0)
    return joined.withColumn("taken", (F.col("_whole") * F.col("size") + part).cast("long")).select(*base.columns, *made)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS k, md5(coalesce(text, '')) AS tk
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
w AS (SELECT source, source_size, 3 * source_size AS cap, (nth % 3) + 1 AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
      FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)),
v AS (SELECT first(level ORDER BY cap::DOUBLE / weight, level) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, least(cap::DOUBLE, weight * v.level) AS target FROM w, v),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (SELECT *, round(target - whole * source_size)::BIGINT AS rest FROM f),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, size, tk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d)
SELECT c.doc_id, c.size, r.source_size, r.target, (whole * c.size + greatest(0, least(c.size, rest - before)))::BIGINT AS taken
FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source
"""
