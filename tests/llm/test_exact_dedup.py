"""Exact deduplication by successive bytes, against a plain dictionary and the registered SQL."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import types as T

pytest.importorskip("tidewater.llm")
from tidewater.llm import exact_dedup as ed


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(lower(t), []).append(d)
    out = []
    for d, t in rows:
        ids = groups[lower(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((d, keep, len(ids), d == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=str)


def table(seed=1):
    r = random.Random(seed)
    base = ["x" * n + tail for n in (0, 1, 3, 4, 5, 7, 8, 15, 16, 17, 100, 5000) for tail in ("", "a", "b", "É", "日本")]
    rows = [(k, r.choice(base)) for k in range(400)]
    rows += [(1000 + k, "One very common text, longer than the first stretch. " * 4) for k in range(300)]
    return rows + [(2000, None), (2001, ""), (2002, "ABC é"), (2003, "abc É"), (2004, "aBc é"), (2005, "abc é\u0000"), (2006, " abc é")]


@pytest.mark.parametrize("first,growth", [(1, 2), (4, 4), (64, 16)])
def test_groups_against_dictionary(spark, first, growth):
    rows = table()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found, tables = ed.radix_groups(docs, first=first, growth=growth)
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, hashlib.sha256(lower(r.text).encode()).hexdigest()) for r in found.collect()]
    assert sorted(got, key=str) == plain(rows)
    assert len(tables) > 1


def test_query_against_sql_and_dictionary(spark, tmp_path):
    rows = table(2)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, ed.op11_exact_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == plain(rows)
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(c.sql(ed.OP11_SQL).fetchall(), key=str)


def test_odd_rows(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("keep_id", T.StringType()), T.StructField("n", T.StringType()), T.StructField("__salt", T.StringType())])
    rows = [(1, "Aa", "k", "n", "s"), (1, "aa", "k", "n", "s"), (1, "aa", None, None, None), (None, "aa", None, "m", None), (None, None, None, "x", None), (None, "", None, "y", None), (3, "b", None, "z", None), (None, None, None, "x", None)]
    docs = spark.createDataFrame(rows, schema)
    found = ed.radix_groups(docs)[0].collect()
    assert sorted((str(r.doc_id), r.text or "", r.keep_id, r.group_size, r.kept) for r in found) == sorted(
        [("1", "Aa", 1, 4, True), ("1", "aa", 1, 4, True), ("1", "aa", 1, 4, True), ("None", "aa", 1, 4, False), ("3", "b", 3, 1, True), *[("None", "", None, 3, True)] * 3]
    )
    assert "n" in found[0].asDict()
    left = ed.drop_copies(docs)
    assert left.columns == ["doc_id", "text", "keep_id", "n", "__salt"] and sorted((str(r.doc_id), lower(r.text)) for r in left.collect()) == [("1", "aa"), ("3", "b"), ("None", "")]
    assert ed.drop_copies(docs.limit(0)).count() == 0 and ed.radix_groups(docs.limit(0))[0].count() == 0


def test_very_long_texts_and_string_ids(spark):
    long = "word " * 300_000
    rows = [("a", long + "x"), ("b", long + "X"), ("c", long + "y"), ("d", long), ("e", long[:-1])]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in ed.radix_groups(spark.createDataFrame(rows, "doc_id string, text string"))[0].collect()}
    assert got == {"a": ("b", 2, False), "b": ("b", 2, True), "c": ("c", 1, True), "d": ("d", 1, True), "e": ("e", 1, True)}
