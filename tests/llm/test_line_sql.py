"""Line deduplication and its SQL agree on odd rows: repeated and null ids, copies, empty texts."""

from collections import Counter

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from tidewater.llm import line_dedup

LINE, OTHER = "A line that is long enough to count", "another line that is long enough, too"


def test_sql_on_repeated_ids(spark):
    rows = [(1, LINE), (1, LINE), (2, LINE), (3, OTHER), (3, OTHER + "\n" + LINE.upper()), (3, OTHER), (None, " " + LINE), (None, None), (4, ""), (5, "short\nshort"), (6, "short"), (7, "short\n" + "long " * 40_000)]
    rows += [(None, "a line that only rows without an id hold")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]}))
    want = con.sql(line_dedup.OP4_SQL).fetchall()
    assert Counter(map(tuple, kept.collect())) == Counter(want)
