"""Alignment of two tokenizers, against the whole encodings of each text and a plain walk over their ends."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import types as T

pytest.importorskip("tidewater.llm")
import numpy as np
import sentencepiece
from tokenizers import Tokenizer

from tidewater.llm import alignment as al

ODD = [
    None, "", " ", "a", " a  b ", "a\n\n  b", "Tab\tand nbsp x", "a▁b", "<s> it's </s> <|endoftext|>", "é ﬁ 日本語 \U0001f600\U0001f600",
    "x\x00y z", "ends in space ", "don't  I'LL we've", "a" * 3000, "éè " * 200, "1234 5678.90, \r\n--", "　wide  line", " . ", "ß   a",
]


@pytest.fixture(scope="module")
def whole():
    a = Tokenizer.from_file(f"{al.FOLDER}/{al.BYTE_BPE}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{al.FOLDER}/{al.PIECE_BPE}")
    letters = al._byte_letters()

    def groups(text):
        """Groups by walking over both lists of ends; the encodings are those of the libraries, of the whole text."""
        if not text:
            return []
        x, y = a.encode(" " + text, add_special_tokens=False), b.encode(text)
        xs = [bytes(letters[c] for c in t) for t in x.tokens]
        ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        if b"".join(xs) != (" " + text).encode() or b"".join(ys) != (" " + text).encode():
            return []
        out, i, j, p, q = [], 0, 0, 0, 0
        left, right = [], []
        while i < len(xs) or j < len(ys):
            if p <= q:
                p += len(xs[i])
                left.append((x.ids[i], p - len(xs[i]), p))
                i += 1
            else:
                q += len(ys[j])
                right.append((y[j], q - len(ys[j]), q))
                j += 1
            if p == q:
                out.append((left, right))
                left, right = [], []
        return out

    return groups


def plain(docs, groups):
    """Every figure of the contract by loops over all pairs of a group."""
    found = {d: groups(t) for d, t in docs}
    links = {d: [(a[0], b[0]) for left, right in g for a in left for b in right if a[1] < b[2] and b[1] < a[2]] for d, g in found.items()}
    count = Counter(x for own in links.values() for x in own)
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    rows = []
    for d, g in found.items():
        text = ";".join(",".join(str(a[0]) for a in left) + "|" + ",".join(str(b[0]) for b in right) for left, right in g)
        rows.append((d, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links[d]), sum(count[x] == most[x[1]] for x in links[d]), sum(count[x] for x in links[d]), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(rows)


def random_texts(n, seed=5):
    r = random.Random(seed)
    letters = " \n\t.a▁é  Tthe<s>1　 日\U0001f600  \x00́'à"
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_segments_encode_like_whole_texts(whole):
    both = al.pair()
    texts = [x for x in ODD if x] + random_texts(3000)
    found = al.Aligned(pa.chunked_array([pa.array(texts)]), both)
    for text, groups in zip(texts, found.groups(), strict=True):
        assert groups == [([a[0] for a in left], [b[0] for b in right]) for left, right in whole(text)], repr(text)


def test_cuts_of_random_ends():
    r = np.random.default_rng(3)
    for size in (1, 2, 3, 10, 400):
        for share in (0.02, 0.3, 0.9):
            ends = [np.unique(np.append(np.flatnonzero(r.random(size * 3) < share) + 1, size * 3)) for _ in range(2)]
            a_cut, b_cut = al.shared_cuts(*ends, np.array([0, len(ends[0])]), np.array([0, len(ends[1])]))
            both = np.intersect1d(*ends)
            assert ends[0][a_cut].tolist() == both.tolist() == ends[1][b_cut].tolist()


def test_query_against_brute_force(spark, tmp_path, whole):
    texts = ODD + random_texts(300, 9) + ["the same text of many, many words"] * 40
    docs = list(enumerate(texts))
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = al.op13_align_tokenizers(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == plain(docs, whole)


def test_odd_rows(spark):
    schema = T.StructType([T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("n_a", T.StringType()), ("block", T.StringType()), ("code", T.StringType()))])
    rows = [(1, "one two", "x", "b", "c"), (1, "one two", "x", "b", "c"), (None, "one two", None, None, None), (2, None, "x", "b", None), (None, None, None, None, None)]
    got = al.align_corpus(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and {(r.n_a, r.n_best) for r in got if r.text} == {(2, 2)} and {(r.n_a, r.count_sum, r.groups) for r in got if not r.text} == {(0, 0, "")}
    assert [r.block for r in got].count("b") == 3
    assert al.align_corpus(spark.createDataFrame([], schema)).count() == 0
    long = " ".join(f"word{k}" for k in range(60000))
    one = al.align_corpus(spark.createDataFrame([(7, long)], "doc_id long, text string"), digest=True).first()
    assert one.n_links == one.n_a + one.n_b - one.n_groups and one.n_groups >= 60000
