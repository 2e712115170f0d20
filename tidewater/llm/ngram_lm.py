"""LM scoring: a weighted backoff automaton over smoothed n-grams.

Every n-gram of up to ``order`` tokens that occurs in the training texts is a state, at any size of the corpus. The arcs of a
state g are the n-grams seen that extend it by a word w; its failure arc leads to its longest proper suffix g'. The weights are
those of hierarchical Dirichlet smoothing, with c for counts in training:

    arc:      p(w | g) = (c(g w) + b p(w | g')) / (c(g) + b)
    failure:  b / (c(g) + b)

b is that of ``CONCENTRATIONS`` under which training is likeliest when every token is taken out of the counts that predict it
(pairs of tokens, over all training texts). As a state other than a text's end is always followed by some token, the weights that leave it sum to one. The root's arcs are
all words, seen or not: (c + 0.5) / (N + 0.5 (V + 1)), which sum to one with one unseen word.

A text is scored in one left-to-right traversal: from the state reached so far take the arc of the next token, or add
the failure weight and try again from the shorter state; the longest suffix seen is the next state. As a state is a function of
the last order - 1 tokens, the traversal is done for all tokens of a block of documents at once: the n-grams at all positions
order by order, then weights from the longest order down.

The model fits nowhere, and isn't gathered: documents are dealt into blocks, and n-grams, by hash, into shards. Each block sends
every shard one row with its distinct n-grams and how often its training texts hold them; the shard sums them up and answers
with one row of totals in the same order. Words and pairs go first. Of longer n-grams only those go whose prefix and suffix
some other block holds, too: those of all others are known where they stand. What a task holds is a block or a shard.

Words are told apart by 64-bit hashes, longer n-grams by 48 bits within their shard. Defined results: null or empty text is the
end token alone; without training rows every count is 0 (N = 0, V = 0), and an empty table gives no rows; repeated rows are
scored each and each counts in training; other columns are left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm._spark import BLOCK_BYTES, block_of, cut, fold, total_bytes
from tidewater.llm._text import U, mix, words

ORDER = 3
#: Weights of the shorter state against the counts of the longer one, in occurrences.
CONCENTRATIONS = (1.0, 4.0, 16.0, 64.0, 256.0, 1024.0, 4096.0)
END = mix(np.array([0xE0F], U))[0]
#: Bytes of text for each of which there is a shard of n-grams.
SHARD_BYTES = 4 << 20
#: Bytes of an n-gram's key, by number of tokens up to two.
WIDTH = {1: 8, 2: 6}


def with_ends(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with one end token behind each row's words, and the first token of each row (rows + 1)."""
    rows = len(first) - 1
    out = np.full(len(h) + rows, END, U)
    out[np.arange(len(h)) + np.repeat(np.arange(rows), np.diff(first))] = h
    return out, first + np.arange(rows + 1)


def longer(keys: np.ndarray, inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of the n-gram that ends at each token, from those of its prefix and suffix, and whether it lies within one row."""
    k, ok = np.zeros_like(keys), np.zeros_like(inside)
    k[1:] = mix(keys[:-1] * U(0x9E3779B97F4A7C15) + mix(keys[1:]))
    ok[1:] = inside[:-1] & inside[1:] & ~starts[1:]
    return k, ok


def before(x: np.ndarray) -> np.ndarray:
    """The value at the token before."""
    return np.concatenate([np.zeros_like(x[:1]), x[:-1]])


def pack(counts: np.ndarray) -> bytes:
    """Counts as one byte each; those from 255 follow in full."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<i8", offset=n)
    return out


def shard_keys(h: np.ndarray, bits: int, width: int) -> np.ndarray:
    """The hashes' bits below the ``bits`` that name the shard, ``width`` bytes of them, as rows of bytes."""
    key = (h << U(bits)) >> U(64 - 8 * width)
    return key.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]


class Block:
    """The tokens of a block of documents, and what is known of its n-grams."""

    def __init__(self, texts: pa.ChunkedArray, train: np.ndarray, order: int):
        runs = [with_ends(h, first) for _, _, h, first in words(texts)]
        self.h = np.concatenate([np.zeros(0, U), *(h for h, _ in runs)])
        sizes = np.concatenate([np.zeros(0, np.int64), *(np.diff(first) for _, first in runs)])
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.train = np.repeat(train, sizes)
        self.starts = np.zeros(len(self.h), bool)
        self.starts[self.first[:-1]] = True
        self.keys, self.inside = [self.h], [np.ones(len(self.h), bool)]
        for _ in range(1, order):
            k, ok = longer(self.keys[-1], self.inside[-1], self.starts)
            self.keys.append(k)
            self.inside.append(ok)
        #: By order, at each token: occurrences of the n-gram in training, and whether another block holds it.
        self.count: list[np.ndarray] = []
        self.shared: list[np.ndarray] = []
        self._asked: tuple = ()

    def ask(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams of ``k`` tokens that other blocks may hold, in order, and their counts here."""
        asked = self.inside[k - 1].copy()
        if k > 2:
            asked &= self.shared[k - 2] & before(self.shared[k - 2])
        h, at = np.unique(self.keys[k - 1][asked], return_inverse=True)
        self._asked = asked, at
        return h, np.bincount(at, self.train[asked], len(h)).astype(np.int64)

    def learn(self, k: int, totals: np.ndarray, shared: np.ndarray) -> None:
        """Takes the answer to what was asked last; other n-grams of ``k`` tokens stand in this block alone."""
        asked, at = self._asked
        count, other = np.zeros(len(self.h), np.int64), np.zeros(len(self.h), bool)
        count[asked], other[asked] = totals[at], shared[at]
        alone = np.flatnonzero(self.inside[k - 1] & ~asked)
        if len(alone):
            _, at = np.unique(self.keys[k - 1][alone], return_inverse=True)
            count[alone] = np.bincount(at, self.train[alone]).astype(np.int64)[at]
        self.count.append(count)
        self.shared.append(other)

    def fit(self, total: int, distinct: int) -> list[float]:
        """For each of ``CONCENTRATIONS`` the sum of log10 p over training, each token left out of the counts of its pair."""
        ours = np.flatnonzero(self.inside[1] & self.train)
        root = (self.count[0][ours] + 0.5) / (total + 0.5 * (distinct + 1))
        pair, state = self.count[1][ours] - 1, before(self.count[0])[ours] - 1
        return [float(np.log10((pair + b * root) / (state + b)).sum()) for b in CONCENTRATIONS]

    def probabilities(self, total: int, distinct: int, concentration: float) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the probability of each token at the root, and along the automaton."""
        at_root = (self.count[0] + 0.5) / (total + 0.5 * (distinct + 1))
        arcs, fails = [at_root], []
        for k in range(1, len(self.count)):
            state = np.where(self.inside[k], before(self.count[k - 1]), 0)  # 0: there is no such state
            arcs.append((np.where(self.inside[k], self.count[k], 0) + concentration * arcs[-1]) / (state + concentration))
            fails.append(concentration / (state + concentration))
        out, open_ = np.zeros(len(self.h)), np.ones(len(self.h), bool)
        for k in range(len(self.count) - 1, 0, -1):
            seen = open_ & self.inside[k] & (self.count[k] > 0)
            out[seen] += np.log10(arcs[k][seen])
            open_ &= ~seen
            out[open_] += np.log10(fails[k - 1][open_])
        out[open_] += np.log10(at_root[open_])
        return np.log10(at_root), out


_ASKED = "block int, k int, shard int, n int, keys binary, counts binary"
_ANSWER = "block int, k int, shard int, totals binary, shared binary, tokens long, types long, fit double"


def answer(table: pa.Table) -> pa.Table:
    """Totals of what blocks ask a shard, each in the order asked; the first row carries the shard's tokens and distinct n-grams."""
    if table.column("k")[0].as_py() == 0:
        # what a block has learned of the concentrations
        fit = np.frombuffer(b"".join(table.column("keys").to_pylist())).reshape(-1, len(CONCENTRATIONS)).sum(0)
        empty = {x.split()[0]: pa.nulls(len(fit), pa.binary() if "binary" in x else pa.int64() if "long" in x else pa.int32()) for x in _ANSWER.split(", ")[:-1]}
        return pa.table(empty | {"k": pa.array(np.zeros(len(fit)), pa.int32()), "shard": pa.array(range(len(fit)), pa.int32()), "fit": fit})
    width = WIDTH[min(table.column("k")[0].as_py(), 2)]
    rows = table.column("n").to_numpy()
    raw = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint8).reshape(-1, width)
    keys = np.zeros((len(raw), 8), np.uint8)
    keys[:, 8 - width :] = raw
    counts = np.concatenate([unpack(c, n) for c, n in zip(table.column("counts").to_pylist(), rows, strict=True)])
    _, at = np.unique(keys.view(">u8").ravel().astype(U), return_inverse=True)
    totals, holders = np.zeros(at.max(initial=-1) + 1, np.int64), np.bincount(at)
    np.add.at(totals, at, counts)
    ends = np.cumsum(rows)
    spread, several = totals[at], holders[at] > 1
    first = np.arange(len(rows)) == 0
    return pa.table({
        "block": table.column("block"), "k": table.column("k"), "shard": table.column("shard"),
        "totals": pa.array([pack(spread[e - n : e]) for n, e in zip(rows, ends, strict=True)], pa.binary()),
        "shared": pa.array([np.packbits(several[e - n : e]).tobytes() for n, e in zip(rows, ends, strict=True)], pa.binary()),
        "tokens": pa.array(np.where(first, totals.sum(), 0), pa.int64()), "types": pa.array(np.where(first, np.count_nonzero(totals), 0), pa.int64()), "fit": pa.nulls(len(rows), pa.float64()),
    })


def score_lm(docs: DataFrame, train_rows: Column, order: int = ORDER, concentration: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every document, learned from those where ``train_rows`` holds.

    Without a ``concentration`` it is fitted (for an order of 2: the middle one).
    """
    spark = docs.sparkSession
    size, least = total_bytes(docs, text_col), int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(1, int(np.ceil(np.log2(max(least, size / SHARD_BYTES)))))
    blocks = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(train_rows, F.lit(False)).alias("train"))
    blocks = blocks.withColumn("block", block_of(max(least, -(-size // BLOCK_BYTES)), "id", "text"))

    def asks(table: pa.Table, block: Block, orders: range) -> pa.Table:
        out: dict[str, list] = {x: [] for x in ("k", "shard", "n", "keys", "counts")}
        for k in orders:
            h, counts = block.ask(k)
            keys = shard_keys(h, bits, WIDTH[min(k, 2)])
            edges = np.append(np.searchsorted(h >> U(64 - bits), np.arange(1 << bits, dtype=U)), len(h))
            for s in np.flatnonzero(np.diff(edges)):
                a, b = edges[s], edges[s + 1]
                for x, v in zip(out, (k, s, b - a, keys[a:b].tobytes(), pack(counts[a:b])), strict=True):
                    out[x].append(v)
        if orders[0] == 3 and concentration is None:
            fit = np.array(block.fit(total, distinct)).tobytes()
            for x, v in zip(out, (0, table.column("block")[0].as_py() % (1 << bits), 0, fit, b""), strict=True):
                out[x].append(v)
        kinds = {"k": pa.int32(), "shard": pa.int32(), "n": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}
        return pa.table({"block": pa.array(np.full(len(out["k"]), table.column("block")[0].as_py() if table.num_rows else 0), pa.int32()), **{x: pa.array(v, kinds[x]) for x, v in out.items()}})

    def informed(table: pa.Table, known: pa.Table, upto: int) -> Block:
        """A block with the answers to its n-grams of up to ``upto`` tokens."""
        block = Block(table.column("text"), table.column("train").to_numpy(), order)
        answers: dict[int, list] = {k: [] for k in range(1, upto + 1)}
        for k, shard, totals, shared in zip(*(known.column(x).to_pylist() for x in ("k", "shard", "totals", "shared")), strict=True):
            answers[k].append((shard, totals, shared))
        for k in range(1, upto + 1):
            h, _ = block.ask(k)
            edges = np.append(np.searchsorted(h >> U(64 - bits), np.arange(1 << bits, dtype=U)), len(h))
            totals, shared = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
            for s, t, x in answers[k]:
                n = edges[s + 1] - edges[s]
                totals[edges[s] : edges[s + 1]] = unpack(t, n)
                shared[edges[s] : edges[s + 1]] = np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool)
            block.learn(k, totals, shared)
        return block

    def ask_short(table: pa.Table) -> pa.Table:
        return asks(table, Block(table.column("text"), table.column("train").to_numpy(), min(2, order)), range(1, min(2, order) + 1))

    def ask_longer(k: int):
        return lambda table, known: asks(table, informed(table, known, k - 1), range(k, k + 1))

    def answered(asked: DataFrame) -> DataFrame:
        return cut(asked.groupBy("shard", "k").applyInArrow(answer, _ANSWER), "answers")

    known = answers = answered(blocks.groupBy("block").applyInArrow(ask_short, _ASKED))
    total, distinct = answers.filter("k = 1").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    for k in range(3, order + 1):
        asked = blocks.groupBy("block").cogroup(known.select("block", "k", "shard", "totals", "shared").groupBy("block")).applyInArrow(ask_longer(k), _ASKED)
        answers = answered(asked)
        if k == 3 and concentration is None:
            best = answers.filter("k = 0").groupBy("shard").agg(F.sum("fit").alias("fit")).orderBy(F.desc("fit"), "shard").first()
            concentration = CONCENTRATIONS[best.shard if best else 0]
        known = known.unionByName(answers.filter("k > 0"))
    concentration = concentration or CONCENTRATIONS[len(CONCENTRATIONS) // 2]

    def score(table: pa.Table, known: pa.Table) -> pa.Table:
        block = informed(table, known, order)
        base, along = block.probabilities(total, distinct, concentration)
        sums = lambda x: np.add.reduceat(x, block.first[:-1]) if len(block.h) else np.zeros(0, x.dtype)
        n = np.diff(block.first)
        return pa.table({
            id_col: table.column("id"), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(sums((block.count[0] > 0).astype(np.int64)), pa.int64()),
            "train_tokens": pa.array(np.full(len(n), total), pa.int64()), "base_score": pa.array(sums(base), pa.float64()), "score": pa.array(sums(along), pa.float64()),
        })

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(x, T.DoubleType()) for x in ("base_score", "score"))])
    return blocks.groupBy("block").cogroup(known.select("block", "k", "shard", "totals", "shared").groupBy("block")).applyInArrow(score, schema)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 5, 1)
    return score_lm(docs, ~held_out).withColumn("held_out", held_out)
