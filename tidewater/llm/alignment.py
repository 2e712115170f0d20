"""Cross-tokenizer alignment: both encodings of a text are cut where tokens of both end, by divide and conquer.

``Pair`` encodes texts with a byte-level BPE (A) and a piece BPE (B). A document is one interval of A and B tokens.
``shared_cuts`` looks for a common end near an interval's middle: A ends around the middle are looked up in the B ends
by bisection, in a window that widens until an end is found or the interval is used up. A found end splits the interval
and both halves go on; an interval without one is a group. All intervals of a block are handled side by side.

Tokens of a group link where their byte ranges overlap. Blocks of about ``BLOCK_BYTES`` of text add up how often they
link two ids, the sums over the corpus come back to the blocks that asked, and a document's links look up their sums.
No table of pairs goes to all executors, and links wait for the sums packed, a few bits each, in the shared folder.

Words come often: a block encodes each distinct segment once. Segments start at a space after a letter, digit or mark
that is not white space; no token of either vocabulary reaches over such a place, so that encoding by segment equals
encoding the whole (the tests hold it against the whole).

Defined results: texts that are null, empty or not given back byte for byte by both encodings have no tokens and all
figures 0; every row is a document, repeated or with a null id too; an empty table gives an empty one; columns beside id
and text are kept unless they have the name of a result.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm._spark import BLOCK_BYTES, block_of, cut, free, n_blocks
from tidewater.llm._text import utf8

#: Where the vocabularies are; every executor has them.
FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: How the byte-level vocabulary takes texts apart before it merges: a fixed value of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BLOCK = "__block"


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 as itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """Two vocabularies: encoders of segments and the bytes of every token."""

    def __init__(self, folder: str = FOLDER):
        import sentencepiece
        import tiktoken

        with open(os.path.join(folder, BYTE_BPE), encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        letters = _byte_letters()
        # ids are in the order of the merges, so ranks by id merge alike
        ranks = {bytes(letters[x] for x in token): i for token, i in vocabulary.items()}
        self.a = tiktoken.Encoding(BYTE_BPE, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, PIECE_BPE))
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.a_len, self.b_len = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """Ids of both vocabularies of each segment (a space first), and whether both give back its bytes."""
        a = [self.a.encode_ordinary(s) for s in segments]
        b = self.b.encode([s[1:] for s in segments], num_threads=1)
        whole = np.array([b"".join([self.a_bytes[i] for i in x]) == (raw := s.encode()) and b"".join([self.b_bytes[i] for i in y]) == raw for s, x, y in zip(segments, a, b, strict=True)], bool)
        return a, b, whole


@functools.lru_cache(maxsize=2)
def pair(folder: str = FOLDER) -> Pair:
    """The vocabularies, loaded once in each Python worker."""
    return Pair(folder)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] numbers), first[1], ..."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _segments(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the segments of documents that lie one after another."""
    start = np.zeros(len(data), bool)
    if len(data) > 2:
        before = (data[1:-1] > 0x20) & (data[1:-1] < 0x7F)
        before[1:] |= (data[1:-2] == 0xC3) & (data[2:-1] >= 0x80)
        start[2:] = (data[2:] == 0x20) & before
    # the last byte of a document doesn't start a segment: B has no token for a lone space
    start[offsets[1:][np.diff(offsets) > 0] - 1] = False
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(start)


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, a_docs: np.ndarray, b_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each A token and each B token ends a group.

    Ends are byte offsets that rise over all documents; documents are given as the first token of each, and the number
    of tokens at the end. Every document with tokens ends at the same byte in both.
    """
    a_cut, b_cut = np.zeros(len(a_ends), bool), np.zeros(len(b_ends), bool)
    some = np.diff(a_docs) > 0
    a_cut[a_docs[1:][some] - 1] = True
    b_cut[b_docs[1:][some] - 1] = True
    a0, a1, b0, b1 = a_docs[:-1][some], a_docs[1:][some], b_docs[:-1][some], b_docs[1:][some]
    while True:
        # one token on either side can't be split
        some = (a1 - a0 > 1) & (b1 - b0 > 1)
        a0, a1, b0, b1 = a0[some], a1[some], b0[some], b1[some]
        if not len(a0):
            return a_cut, b_cut
        middle = (a0 + a1 - 2) // 2
        at_a, at_b = np.full(len(a0), -1), np.full(len(a0), -1)
        open_, width = np.arange(len(a0)), 0
        while len(open_):
            m = middle[open_]
            low, high = np.maximum(a0[open_], m - width), np.minimum(a1[open_] - 2, m + width)
            n = high - low + 1
            tried = _ranges(low, n)
            found = np.searchsorted(b_ends, a_ends[tried])
            away = np.where(b_ends[found] == a_ends[tried], np.abs(tried - np.repeat(m, n)) * 2 + (tried > np.repeat(m, n)), len(a_ends) * 2 + 2)
            nearest = np.minimum.reduceat(away, np.cumsum(n) - n)
            hit = nearest <= 2 * width + 1
            side = np.where(nearest[hit] % 2 == 1, 1, -1)
            at_a[open_[hit]] = m[hit] + side * (nearest[hit] // 2)
            used_up = (low == a0[open_]) & (high == a1[open_] - 2)
            open_, width = open_[~hit & ~used_up], width * 4 + 1
        split = at_a >= 0
        at_a = at_a[split]
        at_b = np.searchsorted(b_ends, a_ends[at_a])
        a_cut[at_a], b_cut[at_b] = True, True
        # halves side by side: the next bisections walk through the ends in order
        a0, a1 = np.stack([a0[split], at_a + 1], axis=1).ravel(), np.stack([at_a + 1, a1[split]], axis=1).ravel()
        b0, b1 = np.stack([b0[split], at_b + 1], axis=1).ravel(), np.stack([at_b + 1, b1[split]], axis=1).ravel()


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ASCII digits of 0 to n - 1 from the left in rows of one byte more than the longest, and their numbers."""
    width = len(str(n - 1))
    table = np.frombuffer("".join(str(i).ljust(width + 1) for i in range(n)).encode(), np.uint8).reshape(n, width + 1)
    return table, (table != 32).sum(axis=1)


class Aligned:
    """Both encodings of a block of documents, cut into groups and linked."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, both: Pair):
        raw, offsets = utf8(texts)
        n_docs = len(offsets) - 1
        sizes = np.diff(offsets)
        own = sizes + (sizes > 0)
        at = np.concatenate([[0], np.cumsum(own)])
        data = np.full(at[-1], 32, np.uint8)
        given = np.ones(at[-1], bool)
        given[at[:-1][sizes > 0]] = False
        data[given] = raw
        first = _segments(data, at)
        strings = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(np.append(first, len(data)).astype(np.int64)), pa.py_buffer(data))
        words = strings.dictionary_encode()
        index, distinct = words.indices.to_numpy(), words.dictionary.to_pylist()
        a, b, whole = both.encode(distinct)
        doc = np.searchsorted(at, first, side="right") - 1
        good = np.ones(n_docs, bool)
        good[doc[~whole[index]]] = False
        index, doc = index[good[doc]], doc[good[doc]]
        self.n_docs = n_docs
        self.a_ids, self.a_docs = self._gather(a, index, doc, n_docs)
        self.b_ids, self.b_docs = self._gather(b, index, doc, n_docs)
        a_ends, b_ends = np.cumsum(both.a_len[self.a_ids]), np.cumsum(both.b_len[self.b_ids])
        self.a_cut, self.b_cut = shared_cuts(a_ends, b_ends, self.a_docs, self.b_docs)
        # ranges overlap once for each stretch between two ends of either side
        ends = np.concatenate([a_ends, b_ends[~self.b_cut]])
        order = np.argsort(ends, kind="stable")
        ends, of_a = ends[order], order < len(a_ends)
        # so many ends of A came before; those of B by bisection
        self.link_a, self.link_b = np.cumsum(of_a) - of_a, np.searchsorted(b_ends, ends)
        self.n_groups = self._per_doc(self.a_cut)
        self.n_a, self.n_b = np.diff(self.a_docs), np.diff(self.b_docs)
        self.links = np.concatenate([[0], np.cumsum(self.n_a + self.n_b - self.n_groups)])

    @staticmethod
    def _gather(ids: list[list[int]], index: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(n.sum()))
        taken = n[index]
        docs = np.concatenate([[0], np.cumsum(np.bincount(doc, taken, n_docs).astype(np.int64))])
        return flat[_ranges((np.cumsum(n) - n)[index], taken)], docs

    def _per_doc(self, flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[self.a_docs[1:]] - sums[self.a_docs[:-1]]

    def codes(self, n_b: int) -> np.ndarray:
        """One number for the ids of each link."""
        return self.a_ids[self.link_a] * n_b + self.b_ids[self.link_b]

    def groups(self) -> list[list[tuple[list[int], list[int]]]]:
        """The groups of each document: ids of A, ids of B."""
        a_at, b_at = np.concatenate([[0], np.flatnonzero(self.a_cut) + 1]), np.concatenate([[0], np.flatnonzero(self.b_cut) + 1])
        a, b = self.a_ids.tolist(), self.b_ids.tolist()
        every = [(a[i:j], b[k:m]) for i, j, k, m in zip(a_at[:-1], a_at[1:], b_at[:-1], b_at[1:], strict=True)]
        first = np.concatenate([[0], np.cumsum(self.n_groups)])
        return [every[i:j] for i, j in zip(first[:-1], first[1:], strict=True)]

    def written(self, a_digits: tuple[np.ndarray, np.ndarray], b_digits: tuple[np.ndarray, np.ndarray]) -> list[bytes]:
        """Each document's groups as ``a1,a2|b1;a3|b2,b3``."""
        # a token's place: all A tokens of its group come before the group's B tokens
        a_group, b_group = np.cumsum(self.a_cut) - self.a_cut, np.cumsum(self.b_cut) - self.b_cut
        b_before = np.concatenate([[0], np.flatnonzero(self.b_cut) + 1])
        a_through = np.flatnonzero(self.a_cut) + 1
        n = len(a_group) + len(b_group)
        width = max(a_digits[0].shape[1], b_digits[0].shape[1])
        out, long = np.full((n, width), 32, np.uint8), np.empty(n, np.int64)
        for ids, place, (table, digits), mark in (
            (self.a_ids, np.arange(len(a_group)) + b_before[a_group], a_digits, np.where(self.a_cut, ord("|"), ord(","))),
            (self.b_ids, np.arange(len(b_group)) + a_through[b_group], b_digits, np.where(self.b_cut, ord(";"), ord(","))),
        ):
            out[place, : table.shape[1]] = table[ids]
            out[place, digits[ids]] = mark
            long[place] = digits[ids] + 1
        at = np.concatenate([[0], np.cumsum(long)])[self.a_docs + self.b_docs]
        flat = out[out != 32].tobytes()
        return [flat[i : max(i, j - 1)] for i, j in zip(at[:-1], at[1:], strict=True)]


def _pieces(texts: pa.ChunkedArray, size: int = 2 << 20):
    """Runs of documents of about ``size`` bytes; a longer document is a run of its own."""
    _, offsets = utf8(texts)
    k = 0
    while k < len(texts):
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + size, side="right")) - 1)
        yield texts.slice(k, end - k)
        k = end


_RESULTS = ("n_a", "n_b", "n_groups", "n_links")


def align(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", folder: str = FOLDER, digest: bool = False) -> DataFrame:
    """The documents with n_a, n_b, n_groups, n_links (long), groups (``a1,a2|b1;a3|b2,b3``), and their block and packed links.

    With ``digest`` groups is the SHA-256 of that (lowercase hex; empty without tokens) and text is left out.
    """
    docs = docs.drop(*_RESULTS, "groups", "links", _BLOCK)
    kept = [c for c in docs.columns if not (digest and c == text_col)]
    blocks = docs.withColumn(_BLOCK, block_of(n_blocks(docs, text_col), id_col, text_col))
    out = T.StructType([blocks.schema[c] for c in [*kept, _BLOCK]] + [T.StructField(c, T.LongType()) for c in _RESULTS] + [T.StructField("groups", T.StringType()), T.StructField("links", T.BinaryType())])

    def work(table: pa.Table) -> pa.Table:
        both = pair(folder)
        digits = _digits(len(both.a_bytes)), _digits(len(both.b_bytes))
        pack = zstandard.ZstdCompressor(level=3)
        numbers, groups, links = [[] for _ in _RESULTS], [], []
        for texts in _pieces(table.column(text_col)):
            found = Aligned(texts, both)
            codes = found.codes(len(both.b_bytes)).astype("<i4")
            for into, x in zip(numbers, (found.n_a, found.n_b, found.n_groups, np.diff(found.links)), strict=True):
                into.append(x)
            groups += [(hashlib.sha256(x).hexdigest() if x else "") if digest else x.decode() for x in found.written(*digits)]
            links += [pack.compress(codes[i:j].tobytes()) for i, j in zip(found.links[:-1], found.links[1:], strict=True)]
        table = table.select([*kept, _BLOCK])
        for name, x in zip(_RESULTS, numbers, strict=True):
            table = table.append_column(name, pa.array(np.concatenate(x), pa.int64()))
        return table.append_column("groups", pa.array(groups, pa.string())).append_column("links", pa.array(links, pa.binary()))

    return blocks.groupBy(_BLOCK).applyInArrow(work, out)


def _unpacked(links: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Links of all rows one after another, and the first of each row."""
    unpack = zstandard.ZstdDecompressor()
    parts = [np.frombuffer(unpack.decompress(x), "<i4") if x else np.zeros(0, "<i4") for x in links.to_pylist()]
    return np.concatenate([np.zeros(0, "<i4"), *parts]), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


def linked_pairs(aligned: DataFrame) -> DataFrame:
    """How often a block links two ids: (block, code, n); a block may be told in several rows that add up."""

    def count(batches):
        for batch in batches:
            block = batch.column(_BLOCK).to_numpy()
            codes, first = _unpacked(pa.chunked_array([batch.column("links")]))
            # block and code as one number: codes take 31 bits
            both, n = np.unique(np.repeat(block.astype(np.int64), np.diff(first)) << 31 | codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((both >> 31).astype(np.int32)), pa.array(both & 0x7FFFFFFF), pa.array(n, pa.int64())], ["block", "code", "n"])

    return aligned.select(_BLOCK, "links").mapInArrow(count, "block int, code long, n long")


def pair_counts(pairs: DataFrame, n_b: int) -> DataFrame:
    """Corpus-wide links of two ids: (code, a, b, n), and whether no other pair of that B id has more (best)."""
    total = pairs.groupBy("code").agg(F.sum("n").alias("n")).withColumn("a", (F.col("code") / n_b).cast("long")).withColumn("b", F.col("code") % n_b)
    most = total.groupBy("b").agg(F.max("n").alias("most"))
    return total.join(most, "b").select("code", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def score_links(aligned: DataFrame, answers: DataFrame) -> DataFrame:
    """``aligned`` with n_best and count_sum (long) in place of its links; answers are (block, code, n, best) for every pair of a block."""
    kept = [c for c in aligned.columns if c not in ("links", _BLOCK, "n_best", "count_sum")]
    out = T.StructType([aligned.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")])

    def add_up(table: pa.Table, known: pa.Table) -> pa.Table:
        code, at = np.unique(known.column("code").to_numpy(), return_index=True)
        n, best = known.column("n").to_numpy()[at], known.column("best").to_numpy()[at]
        codes, first = _unpacked(table.column("links"))
        found = np.searchsorted(code, codes)
        table = table.select(kept)
        for name, of in (("n_best", best), ("count_sum", n)):
            sums = np.concatenate([[0], np.cumsum(of[found], dtype=np.int64)])
            table = table.append_column(name, pa.array(sums[first[1:]] - sums[first[:-1]], pa.int64()))
        return table

    return aligned.groupBy(_BLOCK).cogroup(answers.groupBy("block")).applyInArrow(add_up, out)


def align_corpus(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", folder: str = FOLDER, digest: bool = False) -> DataFrame:
    """``align``, with n_best (links whose count is their B id's highest) and count_sum (their counts added up) over the whole corpus."""
    aligned = cut(align(docs, text_col, id_col, folder, digest), "aligned")
    pairs = cut(linked_pairs(aligned), "linked-pairs")
    counts = pair_counts(pairs, len(pair(folder).b_bytes))
    answers = pairs.select("block", "code").join(counts.select("code", "n", "best"), "code")
    out = cut(score_links(aligned, answers), "alignment")
    free(aligned, pairs)
    return out


def op13_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return align_corpus(docs, digest=True).select("doc_id", *_RESULTS, "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
