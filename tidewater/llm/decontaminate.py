"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item are compared as sequences of tokens (runs of letters and digits, A-Z as a-z).
Pairs that share no run of ``min_match`` tokens are never looked at: the item's runs are the seeds, and one lookup per
position of a document finds the items that it shares seeds with. Such a pair is tiled: the longest common
runs of unmarked tokens are found by running Karp-Rabin (rolling hashes of the document's runs of a search length,
probed with the item's), marked, and the search goes on with shorter runs down to ``min_match``. The
marked share of the item's tokens is its coverage; as tiles may lie anywhere, passages in another order count in
full. A document is contaminated by an item whose coverage reaches ``threshold``.

Only tokens that stand in a shared seed can be in a tile, so of a long document just those segments are tiled.
Items are handed to all executors in parts of ``PART_BYTES`` at most; a larger benchmark takes several passes.

Defined results: null or empty documents and items match nothing; an item with fewer than ``min_match`` tokens has
one seed, its whole sequence; repeated items are each reported; ids may be of any type;
without documents or items nothing is found; other columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewater.llm._spark import total_bytes
from tidewater.llm._text import U, grams, mix, words

PART_BYTES = 16 << 20
MIN_MATCH, THRESHOLD = 4, 0.6


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Run:
    """A sequence with its tokens' marks, and the running Karp-Rabin hash of its windows of any length."""

    def __init__(self, tokens: np.ndarray):
        self.tokens, n = tokens, len(tokens)
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(tokens) * _powers(_BASE, n), dtype=U)])
        self.back = _powers(_INVERSE, n)
        self.marked = np.zeros(n, bool)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows without a marked token, ascending, and their hashes."""
        marks = np.concatenate([[0], np.cumsum(self.marked)])
        at = np.flatnonzero(marks[length:] == marks[: len(marks) - length])
        return at, (self.sums[at + length] - self.sums[at]) * self.back[at]


def greedy_tiles(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Non-overlapping (doc position, item position, length) tiles, longest first; ties by item, then document position.

    A common window of unmarked tokens holds common ones of every smaller length, so that the longest is found by bisection. All
    windows of that length are longest matches: each is marked at the first place of the document that is left for it. Work
    is the number of different tile lengths times (document + item), however often tokens repeat.
    """
    if not len(doc) or not len(item):
        return []
    d_run, i_run = _Run(np.asarray(doc).astype(U)), _Run(np.asarray(item).astype(U))
    tiles: list[tuple[int, int, int]] = []
    limit = min(len(doc), len(item))
    while limit >= min_match:
        low = min_match - 1
        while low < limit:
            n = (low + limit + 1) // 2
            if np.isin(i_run.windows(n)[1], d_run.windows(n)[1]).any():
                low = n
            else:
                limit = n - 1
        if low < min_match:
            break
        places, hashes = d_run.windows(low)
        order = np.argsort(hashes, kind="stable")
        places, hashes = places[order], hashes[order]
        at, wanted = i_run.windows(low)
        first, last = np.searchsorted(hashes, wanted, "left"), np.searchsorted(hashes, wanted, "right")
        # places of a hash that are marked stay so, so that each is looked at once
        upto: dict[int, int] = {}
        for k in np.flatnonzero(first < last).tolist():
            i = int(at[k])
            if i_run.marked[i : i + low].any():
                continue
            p, end = upto.get(int(wanted[k]), int(first[k])), int(last[k])
            while p < end and d_run.marked[places[p] : places[p] + low].any():
                p += 1
            upto[int(wanted[k])] = p
            # windows with equal hashes are compared; others than the first behind one hash are passed by one by one
            q = p
            while q < end and (d_run.marked[places[q] : places[q] + low].any() or not np.array_equal(d_run.tokens[places[q] : places[q] + low], i_run.tokens[i : i + low])):
                q += 1
            if q < end:
                d = int(places[q])
                tiles.append((d, i, low))
                d_run.marked[d : d + low] = i_run.marked[i : i + low] = True
        limit = low - 1
    return tiles


class Seeds:
    """Seed hashes of a part of the benchmark, sorted, with the items and positions behind each, in flat arrays."""

    def __init__(self, items: list[tuple[int, str]], min_match: int, threshold: float):
        self.min_match, self.threshold = min_match, threshold
        self.ids = [i for i, _ in items]
        tokens, sizes = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for _, _, h, first in words(pa.array([t for _, t in items], pa.string()), words_only=True):
            tokens.append(h)
            sizes.append(np.diff(first))
        self.tokens, size = np.concatenate(tokens), np.concatenate(sizes)
        self.first = np.concatenate([[0], np.cumsum(size)])
        #: Length of a seed: its hashes (sorted, distinct), the first entry of each, and the entries' items and positions.
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({int(x) for x in np.minimum(size[size > 0], min_match)}):
            which = np.flatnonzero(np.minimum(size, min_match) == n)
            item = np.repeat(which, size[which] - n + 1).astype(np.int32)
            pos = (np.arange(len(item)) - np.repeat(np.cumsum(size[which] - n + 1) - (size[which] - n + 1), size[which] - n + 1)).astype(np.int32)
            g = grams(self.tokens, n)[self.first[item] + pos]
            by = np.argsort(g, kind="stable")
            seeds, start = np.unique(g[by], return_index=True)
            self.by_length[n] = seeds, np.append(start, len(by)), item[by], pos[by]

    @staticmethod
    def outside(tokens: np.ndarray) -> np.uint64:
        """A token that isn't among these."""
        return next(U(x) for x in range(len(tokens) + 1) if U(x) not in tokens)

    def matches(self, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item id, matched tokens, tokens of the item) of the rows' pairs whose tiles reach the threshold."""
        row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for n, (seeds, start, items, positions) in self.by_length.items():
            g = grams(h, n)
            if not len(g):
                continue
            at = np.minimum(np.searchsorted(seeds, g), len(seeds) - 1)
            hits = np.flatnonzero((seeds[at] == g) & (row_of[: len(g)] == row_of[n - 1 :]))
            if not len(hits):
                continue
            seed, row_hit = at[hits], row_of[hits]
            # a seed counts once a row, however often the row repeats it
            row, once = np.divmod(np.unique(row_hit * len(seeds) + seed), len(seeds))
            many = start[once + 1] - start[once]
            entry = np.repeat(start[once] - np.cumsum(many) + many, many) + np.arange(many.sum())
            row, once, item, pos = np.repeat(row, many), np.repeat(once, many), items[entry], positions[entry]
            by = np.lexsort((pos, item, row))
            row, once, item, pos = row[by], once[by], item[by], pos[by]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
            pair = np.flatnonzero(new)
            # tokens of the item that lie under its seeds: each adds n, or as far as the next one of the pair
            ahead = np.full(len(row), n)
            ahead[:-1][~new[1:]] = np.minimum(pos[1:] - pos[:-1], n)[~new[1:]]
            under = np.add.reduceat(ahead, pair)
            ends = np.append(pair[1:], len(row))
            wanted = np.zeros(len(seeds), bool)
            for k in np.flatnonzero(under >= self.threshold * (self.first[item[pair] + 1] - self.first[item[pair]])):  # tiles cover no more than seeds do
                own = item[pair[k]]
                tokens = self.tokens[self.first[own] : self.first[own + 1]]
                a, b = np.searchsorted(row_hit, [row[pair[k]], row[pair[k]] + 1])
                wanted[once[pair[k] : ends[k]]] = True
                places = hits[a:b][wanted[seed[a:b]]]
                wanted[once[pair[k] : ends[k]]] = False
                # segments of the document under the item's seeds; where one ends a token stands that the item doesn't hold
                under_seed = np.zeros(places[-1] - places[0] + n + 1, bool)
                for step in range(n):
                    under_seed[places - places[0] + step] = True
                kept = under_seed.copy()
                kept[1:] |= under_seed[:-1]
                segment = np.append(h[places[0] : places[-1] + n], U(0))[kept]
                segment[~under_seed[kept]] = self.outside(tokens)
                matched = sum(t[2] for t in greedy_tiles(segment, tokens, n))
                if matched >= self.threshold * len(tokens):
                    yield int(row[pair[k]]), self.ids[own], matched, len(tokens)


def _parts(benchmark: DataFrame, id_col: str, text_col: str, min_match: int, threshold: float) -> Iterator[Seeds]:
    n = max(1, -(-total_bytes(benchmark, text_col) // PART_BYTES))
    for k in range(n):
        rows = benchmark.select(id_col, text_col).filter(F.pmod(F.xxhash64(id_col, text_col), F.lit(n)) == k).collect()
        yield Seeds(sorted(((r[0], r[1] or "") for r in rows), key=repr), min_match, threshold)


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc, item, matched tokens, coverage) of every pair whose coverage reaches the threshold."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(item_col, benchmark.schema[item_col].dataType), T.StructField("matched", T.LongType()), T.StructField("coverage", T.DoubleType())])
    item_type, found = to_arrow_type(schema[1].dataType), None
    for seeds in _parts(benchmark, item_col, text_col, min_match, threshold):
        sent = docs.sparkSession.sparkContext.broadcast(seeds)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                ids = batch.column(0)
                for a, _, h, first in words(batch.column(1), words_only=True):
                    out += [(ids[a + row].as_py(), item, n, n / size) for row, item, n, size in sent.value.matches(h, first)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [()] * 4, [ids.type, item_type, pa.int64(), pa.float64()], strict=True)], names=schema.names)

        part = docs.select(id_col, text_col).mapInArrow(search, schema)
        found = part if found is None else found.unionByName(part)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, threshold: float = THRESHOLD, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The documents that no item contaminates; rows are kept whole or dropped."""
    for seeds in _parts(benchmark, item_col, text_col, min_match, threshold):
        sent = docs.sparkSession.sparkContext.broadcast(seeds)

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for a, _, h, first in words(batch.column(batch.schema.get_field_index(text_col)), words_only=True):
                    for row, *_ in sent.value.matches(h, first):
                        clean[a + row] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
