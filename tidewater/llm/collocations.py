"""Phrase collocations: an FM-index per shard over word ids, whose counts are summed over the shards.

1. Shards are blocks of about ``BLOCK_BYTES`` of text. They hand on their distinct words with counts; words that occur
   ``least`` times or more get a number (no phrase with another word can reach ``least``) and go back to the shards
   that asked. A number stands for a word of one language, so languages never mix.
2. Each shard turns its text into numbers, 0 between pieces and for rarer words, and builds a bidirectional index: the
   Burrows-Wheeler transform of the numbers and of the reversed numbers, sorted to the depth of the longest phrase. The
   intervals of the words are extended to the left, those of the pairs to the right through their mirror interval; an
   interval's size is a phrase's count. Nothing is read off the text itself.
3. Counts are dealt by a hash of the phrase, packed by shard and bucket, and added up; what stays is scored.

Rows of one phrase are at most one per shard, however often it occurs. Numbers are long integers, products decimals of
38 digits: exact for counts up to 10^16.

Defined results: null text is empty, null language ``und``; every row is a document, repeated or with a null id too;
an empty table or one without phrases gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidewater.llm._spark import block_of, cut, free, n_blocks, text_of
from tidewater.llm._text import U, mix, utf8

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes between words, and those of them that end a piece.
_SPACE, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SPACE[[0x20, 0x09]] = True
_BETWEEN = _SPACE | _STOP
#: Words of the longest phrase.
DEPTH = 3
_BLOCK = "__block"


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] numbers), first[1], ..."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def words_of(texts: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct lower-cased words; and for each word of the texts its number among them, its text, and whether its piece starts with it."""
    data, offsets = utf8(texts)
    edge = np.zeros(len(data) + 1, bool)
    edge[:-1] = ~_BETWEEN[data]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    start = edge.copy()
    start[1:] &= ~edge[:-1]
    start[cuts] |= edge[cuts]
    end = np.zeros(len(data) + 1, bool)
    end[1:] = edge[:-1] & ~edge[1:]
    end[cuts] |= edge[cuts - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    lengths = np.concatenate([[0], np.cumsum(e - s)])
    strings = pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(lengths), pa.py_buffer(_LOWER[data[edge[:-1]]]))
    found = strings.dictionary_encode()
    doc = np.searchsorted(offsets, s, side="right") - 1
    stops = np.cumsum(_STOP[data], dtype=np.int32)[s] if len(s) else np.zeros(0, np.int32)
    opens = np.ones(len(s), bool)
    opens[1:] = (np.diff(doc) > 0) | (np.diff(stops) > 0)
    return found.dictionary, found.indices.to_numpy(), doc, opens


class Index:
    """Both Burrows-Wheeler transforms of a sequence of symbols, sorted to ``depth`` symbols; 0 separates and is in no phrase.

    A phrase is an interval of rows that start with it, in either order. Of a phrase shorter than ``depth`` both
    intervals of every extension by one symbol follow from its own.
    """

    def __init__(self, symbols: np.ndarray, depth: int = DEPTH):
        text = np.concatenate([[0], symbols, [0]]).astype(np.int64)
        self.sigma = int(text.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        self.forward, self.mirror = self._transform(text, depth), self._transform(text[::-1], depth)
        # the row that a row's own symbol leads to: the count of smaller symbols, and of the same one before
        self.leads = tuple(self._leads(bwt) for bwt in (self.forward, self.mirror))

    def _transform(self, text: np.ndarray, depth: int) -> np.ndarray:
        bits = max(1, (self.sigma - 1).bit_length())
        ahead = [np.concatenate([text[k:], np.zeros(k, np.int64)])[: len(text)] for k in range(depth)]
        if bits * depth < 64:
            key = np.zeros(len(text), U)
            for x in ahead:
                key = key << U(bits) | x.astype(U)
            rows = np.argsort(key, kind="stable")
        else:
            rows = np.lexsort(ahead[::-1])
        return text[rows - 1]

    @staticmethod
    def _leads(bwt: np.ndarray) -> np.ndarray:
        out = np.empty(len(bwt), np.int64)
        out[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
        return out

    def symbols(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every symbol: itself, first row, first mirror row, count."""
        n = np.diff(self.first)
        some = np.flatnonzero(n[1:] > 0) + 1
        return some, self.first[some], self.first[some], n[some]

    def extend(self, rows: np.ndarray, mirror: np.ndarray, n: np.ndarray, right: bool = False) -> tuple[np.ndarray, ...]:
        """All phrases one symbol longer: of which interval, by which symbol, first row, first mirror row, count."""
        bwt, leads = (self.mirror, self.leads[1]) if right else (self.forward, self.leads[0])
        own, other = (mirror, rows) if right else (rows, mirror)
        at = _ranges(own, n)
        key = np.repeat(np.arange(len(n)), n) * self.sigma + bwt[at]
        order = np.argsort(key, kind="stable")
        key = key[order]
        run = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        counts = np.diff(np.append(run, len(key)))
        of, symbol = key[run] // self.sigma, key[run] % self.sigma
        lead = leads[at[order[run]]]
        # in the other order the extensions of an interval lie inside it, smaller symbols first
        inside = other[of] + run - (np.cumsum(n) - n)[of]
        some = symbol > 0
        new, old = (inside, lead) if right else (lead, inside)
        return of[some], symbol[some], new[some], old[some], counts[some]


def phrases(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All phrases of 2 and 3 symbols, a row each with 0 for no third one, and their counts."""
    index = Index(symbols)
    last, rows, mirror, n = index.symbols()
    of, first, rows, mirror, n = index.extend(rows, mirror, n)
    pairs = np.stack([first, last[of], np.zeros(len(of), np.int64)], axis=1)
    of, third, _, _, n3 = index.extend(rows, mirror, n, right=True)
    triples = np.concatenate([pairs[of, :2], third[:, None]], axis=1)
    return np.concatenate([pairs, triples]), np.concatenate([n, n3])


def count_words(blocks: DataFrame) -> DataFrame:
    """(block, lang, word, n): the distinct words of each shard."""

    def count(table: pa.Table) -> pa.Table:
        block = table.column(_BLOCK)[0].as_py()
        langs = table.column("lang").combine_chunks().dictionary_encode()
        langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
        words, at, doc, _ = words_of(table.column("text"))
        both, n = np.unique(langs.indices.to_numpy()[doc].astype(np.int64) * len(words) + at, return_counts=True)
        size = max(1, len(words))
        return pa.table({"block": pa.array(np.full(len(both), block), pa.int32()), "lang": langs.dictionary.take(pa.array(both // size)).cast(pa.string()), "word": words.take(pa.array(both % size)).cast(pa.string()), "n": pa.array(n, pa.int64())})

    return blocks.groupBy(_BLOCK).applyInArrow(count, "block int, lang string, word string, n long")


def number_words(counted: DataFrame, least: int) -> DataFrame:
    """(lang, word, f, id): words with ``least`` occurrences, numbered from 1 without gaps."""
    found = cut(counted.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least).withColumn("at", F.monotonically_increasing_id()), "words")
    part = F.shiftright("at", 33)
    # one row for each partition of the table that was written
    sizes = found.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size")).collect()
    starts, total = [], 0
    for part_no, size in sorted(map(tuple, sizes)):
        starts.append((part_no, total))
        total += size
    start = found.sparkSession.createDataFrame(starts, "part long, start long")
    out = cut(found.join(F.broadcast(start), part == F.col("part")).select("lang", "word", "f", (F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).alias("id")), "numbered-words")
    free(found)
    return out


def count_phrases(blocks: DataFrame, numbered: DataFrame, n_buckets: int, least: int) -> DataFrame:
    """(w1, w2, w3, a): phrases of numbered words with ``least`` occurrences; w3 is 0 for pairs. ``numbered`` is (block, lang, word, id)."""

    def enumerate_(table: pa.Table, known: pa.Table) -> pa.Table:
        ids = dict(zip(zip(known.column("lang").to_pylist(), known.column("word").to_pylist(), strict=True), known.column("id").to_pylist(), strict=True))
        numbers = np.array(sorted(ids.values()), np.int64)
        if not table.num_rows or not len(numbers):
            return pa.table({"bucket": pa.array([], pa.int64()), "grams": pa.array([], pa.binary())})
        langs = table.column("lang").combine_chunks().dictionary_encode()
        langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
        words, at, doc, opens = words_of(table.column("text"))
        named = words.to_pylist()
        symbol_of = np.array([[0 if (i := ids.get((lang, w))) is None else i for w in named] for lang in langs.dictionary.to_pylist()], np.int64).reshape(len(langs.dictionary), len(named))
        local = np.where(symbol_of > 0, np.searchsorted(numbers, symbol_of) + 1, 0)
        symbols = local[langs.indices.to_numpy()[doc], at]
        # a 0 before each word that opens a piece
        grams, n = phrases(np.insert(symbols, np.flatnonzero(opens), 0))
        grams = np.concatenate([[0], numbers])[grams]
        h = mix(grams[:, 0].astype(U) + mix(grams[:, 1].astype(U) + mix(grams[:, 2].astype(U))))
        bucket = (h % U(n_buckets)).astype(np.int64)
        order = np.lexsort((grams[:, 2], grams[:, 1], grams[:, 0], bucket))
        bucket, columns = bucket[order], np.concatenate([grams[order].T, n[order][None]]).astype("<i8")
        run = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        pack = zstandard.ZstdCompressor(level=3)
        packed = [pack.compress(columns[:, i:j].tobytes()) for i, j in zip(run, np.append(run, len(bucket))[1:], strict=True)]
        return pa.table({"bucket": pa.array(bucket[run], pa.int64()), "grams": pa.array(packed, pa.binary())})

    def add_up(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        columns = np.concatenate([np.frombuffer(unpack.decompress(x), "<i8").reshape(4, -1) for x in table.column("grams").to_pylist()], axis=1)
        summed = pa.table(dict(zip(("w1", "w2", "w3", "n"), columns, strict=True))).group_by(["w1", "w2", "w3"]).aggregate([("n", "sum")])
        summed = summed.select(["w1", "w2", "w3", "n_sum"]).rename_columns(["w1", "w2", "w3", "a"])
        return summed.filter(pa.compute.greater_equal(summed.column("a"), least))

    dealt = blocks.groupBy(_BLOCK).cogroup(numbered.groupBy("block")).applyInArrow(enumerate_, "bucket long, grams binary")
    return dealt.groupBy("bucket").applyInArrow(add_up, "w1 long, w2 long, w3 long, a long")


def _score(l_: str, r: str) -> F.Column:
    """floor(10^6 a^2 / (l r)), exactly."""
    a, l_, r = (F.col(c).cast("decimal(16,0)") for c in ("a", l_, r))
    product = (a * a).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", product.cast("decimal(38,0)"), (l_ * r).cast("decimal(32,0)"))


def score_phrases(counted: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score): each phrase at the cut that scores lowest, without those that a longer phrase takes up."""
    f = {k: words.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"word{k}"), F.col("f").alias(f"f{k}"), *([F.col("lang")] if k == 1 else [])) for k in (1, 2, 3)}
    pairs, triples = counted.filter(F.col("w3") == 0).drop("w3"), counted.filter(F.col("w3") > 0)
    # a pair in triples: the most frequent one decides
    inside = triples.select("w1", "w2", "a").unionByName(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a")).groupBy("w1", "w2").agg(F.max("a").alias("most"))
    pairs_left = pairs.join(inside, ["w1", "w2"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < 50 * F.col("a"))).drop("most")
    two = pairs_left.join(f[1], "w1").join(f[2], "w2")
    two = two.select("lang", F.concat_ws(" ", "word1", "word2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score("f1", "f2").alias("score"))
    three = triples.join(pairs.select("w1", "w2", F.col("a").alias("f12")), ["w1", "w2"]).join(pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23")), ["w2", "w3"])
    three = three.join(f[1], "w1").join(f[2], "w2").join(f[3], "w3").withColumn("at1", _score("f1", "f23")).withColumn("at2", _score("f12", "f3"))
    early = F.col("at1") <= F.col("at2")
    three = three.select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", F.when(early, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(early, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("at1", "at2").alias("score"))
    return two.unionByName(three)


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", least: int = 10, top: int = 2000) -> DataFrame:
    """Each language's ``top`` phrases of 2 to 3 words: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("id"), text_of(docs, text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    shards = n_blocks(plain)
    blocks = plain.withColumn(_BLOCK, block_of(shards, "id", "text", "lang"))
    counted = cut(count_words(blocks), "shard-words")
    words = number_words(counted, least)
    numbered = counted.join(words, ["lang", "word"]).select("block", "lang", "word", "id")
    grams = cut(count_phrases(blocks, numbered, max(2 * shards, int(spark.conf.get("spark.sql.shuffle.partitions"))), least), "phrases")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # parts of a language first, so that no task sees all of it
    scored = score_phrases(grams, words).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).filter(F.col("rank") <= top)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    out = cut(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    free(counted, words, grams)
    return out


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))


OP12_SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\x0c\r]')) AS piece
  FROM documents),
s AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM t),
f1 AS (SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(w) AS w FROM s) GROUP BY lang, w),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
f2 AS (SELECT lang, g[1] AS w1, g[2] AS w2, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: [w[i], w[i + 1]])) AS g FROM s) GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, g[1] AS w1, g[2] AS w2, g[3] AS w3, count(*) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) AS g FROM s) GROUP BY ALL HAVING count(*) >= 10),
c3 AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3 AS phrase, c.f AS a, x.f AS l1, yz.f AS r1, xy.f AS l2, z.f AS r2,
         (1000000 * c.f::HUGEINT * c.f) // (x.f::HUGEINT * yz.f) AS s1, (1000000 * c.f::HUGEINT * c.f) // (xy.f::HUGEINT * z.f) AS s2
  FROM f3 c JOIN f1 x ON x.lang = c.lang AND x.w = c.w1 JOIN f2 yz ON yz.lang = c.lang AND yz.w1 = c.w2 AND yz.w2 = c.w3
  JOIN f2 xy ON xy.lang = c.lang AND xy.w1 = c.w1 AND xy.w2 = c.w2 JOIN f1 z ON z.lang = c.lang AND z.w = c.w3),
m AS (SELECT lang, w1, w2, max(f) AS most FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY lang, w1, w2),
c AS (
  SELECT b.lang, b.w1 || ' ' || b.w2 AS phrase, b.f AS a, x.f AS l, y.f AS r, (1000000 * b.f::HUGEINT * b.f) // (x.f::HUGEINT * y.f) AS score
  FROM f2 b JOIN f1 x ON x.lang = b.lang AND x.w = b.w1 JOIN f1 y ON y.lang = b.lang AND y.w = b.w2 LEFT JOIN m ON m.lang = b.lang AND m.w1 = b.w1 AND m.w2 = b.w2
  WHERE m.most IS NULL OR 100 * m.most < 50 * b.f
  UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM c3),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c)
SELECT k.lang, k.rank, k.phrase, k.a::BIGINT AS a, k.l::BIGINT AS l, k.r::BIGINT AS r, n.n, k.score::BIGINT AS score
FROM k JOIN n ON n.lang = k.lang WHERE k.rank <= 2000
"""
