"""Collocations from interval sizes, against plain counting and the registered SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

pytest.importorskip("tidewater.llm")
from tidewater.llm import collocations as co


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def plain(docs, least=10, top=2000):
    """The contract by loops: (lang, rank, phrase, a, l, r, n, score)."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower(text)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    rows = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            cuts = [(1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, p, l_, r) in enumerate(sorted(scored)[:top], 1):
            rows.append((lang, rank, p.decode(), -a, l_, r, n[lang], -score))
    return sorted(rows)


def corpus(n=1500, seed=1):
    r = random.Random(seed)
    words = ["the", "New", "york", "city", "a", "b", "of", "É", "é", "日本", "x y", "-", "state"]
    docs = []
    for _ in range(n):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", "! ", "\x0b"]) for _ in range(r.randint(0, 40)))
        docs.append((text, r.choice(["en", "de", None, "und", ""])))
    return docs + [("New York City is New York city", "en")] * 30 + [(None, "en"), ("", None), (" . , ", "fr"), ("solo", "fr")]


@pytest.mark.parametrize("seed", range(4))
def test_intervals_count_all_phrases(seed):
    r = np.random.default_rng(seed)
    for sigma, n in ((1, 0), (2, 1), (2, 30), (3, 200), (40, 3000), (1 << 22, 500)):
        symbols = r.integers(0, sigma, n)
        grams, counts = co.phrases(symbols)
        expected = Counter()
        for i in range(n - 1):
            if symbols[i] and symbols[i + 1]:
                expected[(int(symbols[i]), int(symbols[i + 1]), 0)] += 1
                if i + 2 < n and symbols[i + 2]:
                    expected[tuple(map(int, symbols[i : i + 3]))] += 1
        assert dict(zip(map(tuple, grams.tolist()), counts.tolist(), strict=True)) == expected


def test_query_against_loops_and_sql(spark, tmp_path):
    docs = corpus()
    spark.createDataFrame([(k, *d) for k, d in enumerate(docs)], "doc_id long, text string, lang string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, co.op12_collocations(spark, str(tmp_path)).collect()))
    assert len(got) > 40 and got == plain(docs)
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(c.sql(co.OP12_SQL).fetchall())


def test_top_and_least(spark):
    docs = corpus(80, 7)
    frame = spark.createDataFrame([(k, *d) for k, d in enumerate(docs)], "doc_id long, text string, lang string")
    assert sorted(map(tuple, co.collocations(frame, least=3, top=5).collect())) == plain(docs, 3, 5)


def test_odd_rows(spark):
    schema = T.StructType([T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("word", T.StringType()), ("block", T.StringType()), ("n", T.StringType()))])
    rows = [(1, "one two", "en", "w", "b", "n")] * 6 + [(None, "One Two", "en", None, None, None)] * 6 + [(None, None, None, None, None, None)]
    got = [tuple(r) for r in co.collocations(spark.createDataFrame(rows, schema)).collect()]
    assert got == [("en", 1, "one two", 12, 12, 12, 24, 1_000_000)]
    assert co.collocations(spark.createDataFrame([], schema)).count() == 0
    assert co.collocations(spark.createDataFrame([(1, "too few words here", "en", None, None, None)], schema)).count() == 0
    long = "a b c. " * 100_000
    got = [tuple(r) for r in co.collocations(spark.createDataFrame([(1, long, "en", None, None, None)], schema)).collect()]
    assert got == [("en", 1, "a b c", 100_000, 100_000, 100_000, 300_000, 1_000_000)]


def test_scores_are_exact_beyond_64_bits(spark):
    big = 3_000_000_019
    words = spark.createDataFrame([("en", "x", big + 7, 1), ("en", "y", big + 9, 2)], "lang string, word string, f long, id long")
    got = co.score_phrases(spark.createDataFrame([(1, 2, 0, big)], "w1 long, w2 long, w3 long, a long"), words).first()
    assert got.score == 1_000_000 * big * big // ((big + 7) * (big + 9))
