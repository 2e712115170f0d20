"""PII: bootstrapped contextual extraction.

Base rules find e-mail addresses, IP addresses, card and phone numbers. They are the seeds. Lexical patterns are the word to the
left of a seed, the two words to its left, the word to its right (of a word that holds the seed, the part beside it), and
its own shape (digits as 9, letters as a). What else such patterns go with, among strings that look like identifiers (long
numbers with separators, addresses with a spelt-out at) but that no rule matches, are instances to be judged.
Patterns and instances form a graph with one row per edge, which Spark scores in rounds:

    pattern:  how often it goes with accepted instances / occurrences of the pattern in the corpus
              (of its words; of a shape: among strings that look like identifiers)
    instance: 1 for seeds, else 1 - product over the patterns of its words of (1 - score)

so that words which mostly don't stand beside identifiers score low, however many seeds they go with. A pattern takes part
once ``MIN_SEEDS`` distinct accepted instances of one kind go with it. Seeds are accepted from the start, and others
in the round after they reach ``MIN_SCORE``: so new instances bring new patterns, for ``ROUNDS`` rounds.
Words that reach ``MIN_SCORE`` then mark whatever identifier-like string they stand beside, as their kind; a shape neither marks
nor brings in a string, as the base rules have just turned it down. The rounds run on
Spark tables of all patterns; executors are sent only those that reach the score. Base spans are never changed.

Defined results: null text is empty; extra spans never overlap base spans or each other; without seeds there are none, nor in an
empty table; repeated documents and instances count each in a pattern's score, above and below the line, but once among its
seeds; of the patterns that mark a string the first counts, in the order above, two words before one; other columns are left out.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm._spark import cut, free
from tidewater.llm._text import U, grams, hash_spans, mix, utf8, word_spans, words

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS, MIN_SCORE, ROUNDS = 3, 0.5, 3
#: Bits of a filter that keeps most words that are no pattern from being counted; which pass matters to speed only.
FILTER_BITS = 22
#: Counts that a task holds before it gives them out.
HELD = 1 << 20

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9][0-9.]*\.[0-9.]*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: What may be an identifier though no base rule says so: seven digits or more with separators; an address with its at spelt out.
_LIKELY = re.compile(r"(?<![A-Za-z0-9])[+(]?[0-9](?:[\x20().-]{0,2}[0-9]){6,24}(?![A-Za-z0-9])")
_SPELT_AT = re.compile(r"\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]+(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]+)+")
_LETTER = re.compile(r"[^\W\d_]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local part and domain, found from each @ leftwards: the same as a scan from the left, without its cost."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four runs of digits with dots between, from the left: looked for part by part, as a scan of a long run is quadratic."""
    for m in _DOTTED.finditer(text):
        start, parts, k = m.start(), m[0].split("."), 0
        while k + 3 < len(parts):
            if all(parts[k : k + 4]):
                end = start + sum(map(len, parts[k : k + 4])) + 3
                yield start, end
                start, k = end + 1, k + 4
            else:
                start, k = start + len(parts[k]) + 1, k + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of what the base rules match, in order; code points."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for a, b in _addresses(text) if "." in text else ():
        if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in text[a:b].split(".")):
            out.append((a, 1, b))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def likely_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like strings that overlap no base span nor each other, in order."""
    found = [m.span() for m in _LIKELY.finditer(text)] if _DIGIT.search(text) else []
    if "at)" in text or "at]" in text:
        end = 0
        for m in _SPELT_AT.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < m.start():
                end = m.end()
                found.append((start, end))
        found.sort()
    starts, ends, out = [a for a, _, _ in taken], [], []
    for _, _, b in taken:
        ends.append(max(b, ends[-1]) if ends else b)
    for a, b in found:
        k = bisect.bisect_left(starts, b)
        if not (k and ends[k - 1] > a) and not (out and out[-1][1] > a):
            out.append((a, b))
    return out


def _rightward(keys: np.ndarray) -> np.ndarray:
    """The pattern of a word to the right, from that of the same word to the left."""
    return mix(keys ^ U(0x8EBC6AF09C88C6E3))


def _pattern_keys(text: str, spans: list[tuple[int, int]]) -> list[list[int]]:
    """Of each span the patterns: two words left, one word left, one word right, shape; those that it has."""
    data, offsets = utf8(pa.array([text], pa.string()))
    s, e, _ = word_spans(data, offsets)
    at = np.arange(len(data) + 1) if len(data) == len(text) else np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    a, b = at[[x for x, _ in spans]], at[[x for _, x in spans]]
    w, v = np.searchsorted(s, a, "right") - 1, np.searchsorted(s, b - 1, "right") - 1
    # what is left of the span in its own word, or the word before; likewise to the right
    own, rest = a > s[w], b < e[v]
    one = np.where(own, w, w - 1)
    left = hash_spans(data, np.where(own, s[w], s[one]), np.where(own, a, e[one]))
    two = hash_spans(data, s[np.maximum(one - 1, 0)], e[np.maximum(one - 1, 0)])
    after = np.minimum(np.where(rest, v, v + 1), len(s) - 1)
    right = hash_spans(data, np.where(rest, b, s[after]), e[after])
    out = []
    for k, (x, y) in enumerate(spans):
        keys = []
        if one[k] >= 1:
            keys.append(grams(np.array([two[k], left[k]]), 2)[0])
        if one[k] >= 0:
            keys.append(grams(left[k : k + 1], 1)[0])
        if rest[k] or v[k] + 1 < len(s):
            keys.append(_rightward(grams(right[k : k + 1], 1))[0])
        out.append([*np.array(keys, U).view(np.int64).tolist(), _value("shape " + _LETTER.sub("a", _DIGIT.sub("9", text[x:y])))])
    return out


def _value(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.lower().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def pattern_edges(texts: DataFrame) -> DataFrame:
    """(pattern, instance, kind, shape, c) of the graph, kind -1 for instances that no rule matches; one row per edge, c times in the corpus."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: Counter = Counter()
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                base = base_spans(text)
                every = [*base, *((a, -1, b) for a, b in likely_spans(text, base))]
                for (a, kind, b), keys in zip(every, _pattern_keys(text, [(a, b) for a, _, b in every]) if every else (), strict=True):
                    value = _value(text[a:b])
                    rows.update((p, value, kind, n == len(keys) - 1) for n, p in enumerate(keys))
            p, v, k, x = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.record_batch([pa.array(p, pa.int64()), pa.array(v, pa.int64()), pa.array(k, pa.int32()), pa.array(x, pa.bool_()), pa.array(rows.values(), pa.int64())], names=["pattern", "instance", "kind", "shape", "c"])

    return texts.mapInArrow(edges, "pattern long, instance long, kind int, shape boolean, c long").groupBy("pattern", "instance", "kind", "shape").agg(F.sum("c").alias("c"))


def context_counts(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, n): how often the words of each pattern occur in the corpus. patterns: (pattern), distinct."""
    size = 1 << FILTER_BITS
    bits = np.zeros(size, bool)
    bits[patterns.select(F.pmod("pattern", F.lit(size)).alias("bit")).distinct().toArrow().column("bit").to_numpy()] = True
    sent = texts.sparkSession.sparkContext.broadcast(bits)

    def added_up(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        g, at = np.unique(np.concatenate([np.zeros(0, np.int64), *(g for g, _ in found)]), return_inverse=True)
        c = np.zeros(len(g), np.int64)
        np.add.at(c, at, np.concatenate([np.zeros(0, np.int64), *(c for _, c in found)]))
        return g, c

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # counts of a task are added up across its batches, and given out where they are many
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for _, _, h, first in words(batch.column(0)):
                last = np.zeros(len(h) + 1, bool)
                last[first[1:] - 1] = True
                for n in (1, 2):
                    g = grams(h, n).view(np.int64)
                    if n == 2:
                        g = g[~last[: len(g)]]
                    sides = [g, _rightward(g.view(U)).view(np.int64)] if n == 1 else [g]
                    held += [np.unique(x[sent.value[x & (size - 1)]], return_counts=True) for x in sides]
                if sum(len(g) for g, _ in held) > HELD:
                    held = [added_up(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield pa.record_batch([pa.array(x) for x in held.pop()], names=["pattern", "n"])
        yield pa.record_batch([pa.array(x) for x in added_up(held)], names=["pattern", "n"])

    counts = cut(texts.mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")), "contexts")
    return counts.join(patterns.select("pattern"), "pattern", "left_semi")


def learn_patterns(texts: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE) -> dict[int, int]:
    """Kind of each high-confidence pattern."""
    edges = cut(pattern_edges(texts), "edges")
    # only patterns with enough instances, and one of them a seed or near one, can ever take part
    enough = edges.groupBy("pattern").agg(F.count_distinct("instance").alias("instances"), F.sum("c").alias("links"), F.max("shape").alias("shape")).filter(F.col("instances") >= min_seeds)
    enough = cut(enough, "enough")
    if enough.isEmpty():
        return {}
    counts = context_counts(texts, enough.filter(~F.col("shape")))
    n = F.when(F.col("shape"), F.col("links")).otherwise(F.greatest(F.coalesce("n", F.lit(0)), "links"))
    sized = enough.join(counts, "pattern", "left").select("pattern", n.alias("n"))
    graph = cut(edges.select("pattern", "instance", "kind", "shape", "c").join(sized, "pattern"), "graph")
    free(edges, enough)
    # what is accepted: (instance, of); seeds stand for their own kind only
    seeds = graph.filter("kind >= 0").select("instance", F.col("kind").alias("of"), F.lit(1.0).alias("score")).distinct()
    accepted = cut(seeds, "accepted")
    patterns = None
    for _ in range(rounds):
        known = graph.join(accepted, "instance").filter((F.col("kind") < 0) | (F.col("kind") == F.col("of")))
        scored = known.groupBy("pattern", "of", "n").agg(F.count_distinct("instance").alias("seeds"), (F.sum(F.col("score") * F.col("c")) / F.col("n")).alias("p")).filter(F.col("seeds") >= min_seeds)
        best = scored.groupBy("pattern").agg(F.max(F.struct("p", "seeds", -F.col("of"))).alias("b")).select("pattern", (-F.col("b.col3")).alias("of"), F.least("b.p", F.lit(1.0)).alias("p"))
        patterns = cut(best, "patterns")
        # no rule took such a string: its words are judged, its shape isn't
        found = graph.filter((F.col("kind") < 0) & ~F.col("shape")).join(patterns, "pattern").groupBy("instance", "of").agg((1 - F.exp(F.sum(F.log1p(-F.least("p", F.lit(0.999999)))))).alias("score")).filter(F.col("score") >= min_score)
        accepted = cut(seeds.unionByName(found.withColumn("score", F.lit(1.0))), "accepted")
    return {r.pattern: r.of for r in patterns.filter(F.col("p") >= min_score).collect()}


def find_pii(docs: DataFrame, patterns: dict[int, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every document; counts are of base spans."""
    sent = docs.sparkSession.sparkContext.broadcast(patterns)  # only those that reached the score

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = np.zeros((batch.num_rows, len(KINDS)), np.int64), [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                text = text or ""
                base = base_spans(text)
                for _, kind, _ in base:
                    counts[k, kind] += 1
                every = base
                if sent.value and (likely := likely_spans(text, base)):
                    keys = _pattern_keys(text, likely)
                    every = sorted([*base, *((a, of[0], b) for (a, b), own in zip(likely, keys, strict=True) if (of := [sent.value[p] for p in own[:-1] if p in sent.value]))])
                digests.append(hashlib.sha256(",".join(f"{KINDS[n]}:{a}:{b}" for a, n, b in base).encode()).hexdigest())
                spans.append(",".join(f"{KINDS[n]}:{a}:{b}" for a, n, b in every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts.T.copy()), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=[id_col, *(f"n_{x}" for x in KINDS), "base_sha256", "spans"])

    schema = T.StructType([docs.schema[id_col], *(T.StructField(f"n_{x}", T.LongType()) for x in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    return docs.select(id_col, text_col).mapInArrow(search, schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_pii(docs, learn_patterns(docs.select("text")))
