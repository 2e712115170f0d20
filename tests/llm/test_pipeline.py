"""The pipeline's stages, each against brute force on what the stage before it kept."""

import random
import re

from test_operators import brute_components, brute_lines, prose, tokens

import corpus_pipeline
from tidewater.llm._spark import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def tables(spark, folder):
    rng = random.Random(20)
    item = " ".join(f"bench{k}" for k in range(12))
    repeated = "this very line of text is repeated in many documents"
    docs = []
    for k in range(240):
        text = prose(rng, k % 6 == 0)
        if k % 6 and k % 9 == 1:
            text += "\n" + repeated
        if k % 40 == 7:
            text += "\n" + item
        docs.append((k, text, "en", f"s{k % 4}", len(text)))
    for k in range(240, 260):  # near copies
        text = docs[k - 239][1].split("\n")[0] + " tail"
        docs.append((k, text, "en", "s1", len(text)))
    docs += [(300, None, None, None, None), (301, "", "en", "s0", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k % 6 != 0), 0) for k in range(0, 240)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return {d[0]: d for d in docs}


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    before = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "mix"]
    for name, stage in corpus_pipeline.STAGES:
        kept = cut(stage(spark, docs, folder), name)
        rows = {r.doc_id: r for r in kept.collect()}
        if name != "mix":
            assert kept.columns == COLUMNS
        if name == "quality":
            clean = {k for k, d in before.items() if d[1] and "|" not in d[1]}
            assert len(clean - set(rows)) <= 2 and not {k for k in rows if "|" in (before[k][1] or "")}
            assert all(tuple(rows[k]) == before[k] for k in rows)
        elif name == "line_dedup":
            want = {(d, t) for d, _, _, t in brute_lines([(r.doc_id, r.text) for r in last.values()])}  # noqa: F821
            assert {(k, r.text or "") for k, r in rows.items()} == want
            assert all(r.n_chars is None if r.text is None else r.n_chars == len(r.text) for r in rows.values())
        elif name == "near_duplicates":
            groups = brute_components([(r.doc_id, r.text) for r in last.values()])  # noqa: F821
            assert set(rows) == {d for d, _, c in groups if d == c} and len(rows) < len(last)  # noqa: F821
        elif name == "decontamination":
            leaks = {k for k, r in last.items() if re.search(r"bench0 bench1 bench2", r.text or "")}  # noqa: F821
            assert leaks and set(rows) == set(last) - leaks  # noqa: F821
        else:
            assert all(0 < r.taken <= 3 * len(tokens(r.text)) and r.size == len(tokens(r.text)) for r in rows.values())
            for s in {r.source for r in rows.values()}:
                assert abs(sum(r.taken for r in rows.values() if r.source == s) - next(r.target for r in rows.values() if r.source == s)) <= 1
        docs, last = kept, rows
    whole = {tuple(r) for r in corpus_pipeline.run(spark, folder).collect()}
    assert whole == {tuple(r) for r in last.values()}
