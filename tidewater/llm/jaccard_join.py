"""N-gram Jaccard join by a token-group matrix: all links at or above a Jaccard similarity of word-shingle sets.

Documents with equal sets are one node. In a global order of tokens (rare ones first) two sets that link share a token
among the first size - ceil(t * size) + 1 of each, their prefixes; nothing else needs a look. Then

1. Grouping: among the nodes with a prefix token in common, one is the pivot. Nodes that link to their pivots, and so on,
   make a group; so do those without a link that share most with one pivot. Groups are cut so that each has about
   ``GROUP_ROWS`` members, or fewer if these are long.
2. Matrix: for each group the union of its members' tokens.
3. Bound: a node of another group that shares prefix tokens with the group can link to a member only if these are
   enough (see may_link), and if the group's union holds at least t of the node's tokens. Of two groups the smaller one asks;
   a group whose holders of the token are all connected with the node already isn't asked.
4. Opening: only where the bound allows, the node is compared with the group's members, exactly. What comes out are the
   links that connect what wasn't connected before, so at most one for each node that was put in.

Pairs of connected nodes aren't tested any more: the result is every document's component, which needs no list of all pairs. The prefix order is any order that all documents share: it puts tokens that are frequent in
many batches last, found over all documents, and affects speed only.

Groups of copies don't gather: equal sets are one node, a pivot's nodes are dealt out in salted parts, and parts of
groups are separate. What meets in one task is a group's members and about as many nodes that ask.

Defined results: null texts and texts without words have no shingles and link with nothing, their component is
their own id; a text of fewer words than n is one shingle; a null id is a document, but never names a component
unless all ids of a component are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm._spark import cut, free
from tidewater.llm._text import U, mix, shingles, words
from tidewater.llm.components import connected_components

N, PERCENT = 5, 75
#: What members, and nodes that ask them, are dealt by: rows, and tokens where these are many.
GROUP_ROWS, GROUP_TOKENS = 512, 1 << 20
#: Frequent tokens that the prefix order puts last, at most; which they are matters to speed only.
FREQUENT = 1 << 17


def _sets(col: pa.Array, n: int) -> Iterator[np.ndarray]:
    for _, _, h, first in words(col):
        for a, b in zip(first[:-1], first[1:], strict=True):
            yield shingles(h[a:b], n)


def node_of(tokens: np.ndarray) -> int:
    """A 64-bit name of a sorted set."""
    return int((np.sum(mix(tokens + U(7)), dtype=U) ^ mix(np.array([len(tokens)], U))[0]).view(np.int64))


def frequent_tokens(texts: DataFrame, n: int, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens that several documents of a batch hold, and their rank by how often; ``most`` at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_sets(batch.column(0), n))
            tokens, c = np.unique(np.concatenate([np.zeros(0, U), *sets]), return_counts=True)
            tokens, c = tokens[c > 2], c[c > 2]
            yield pa.record_batch([pa.array(tokens.view(np.int64)), pa.array(c.astype(np.int64))], names=["token", "c"])

    top = texts.mapInArrow(count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "token").limit(most).toArrow()
    tokens, c = top.column("token").to_numpy().view(U), top.column("c").to_numpy()
    by = np.argsort(tokens)
    return tokens[by], c[by]


def document_sets(docs: DataFrame, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, node, prefix) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent_tokens(docs.select(text_col), n))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, count = sent.value
        for batch in batches:
            size, node, prefix = [], [], []
            for tokens in _sets(batch.column(1), n):
                size.append(len(tokens))
                node.append(node_of(tokens))
                keep = len(tokens) - -(-percent * len(tokens) // 100) + 1 if len(tokens) else 0
                if len(frequent) and len(tokens):
                    at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
                    known = frequent[at] == tokens
                    tokens = np.concatenate([tokens[~known], tokens[known][np.argsort(count[at[known]], kind="stable")]])
                prefix.append(tokens[:keep].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int64), *prefix])
            yield pa.record_batch([batch.column(0), pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[id_col, "n", "node", "prefix"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(work, f"{id_col} {kind}, n long, node long, prefix array<long>")


def may_link(c: Column, n: Column, n0: Column, n1: Column, percent: int) -> Column:
    """Whether a set of n tokens can link to one of n0 to n1 tokens when c of its prefix tokens are in the other's prefix at most.

    Of two prefixes the one that ends first in the order shares all that its set shares there; so the overlap is at most
    c plus the rest of that set, r(size) = ceil(t size) - 1. It has to reach t / (1 + t) of both sizes. The first bound is
    easiest to meet for the smallest other set. The second isn't so for any one size, as r grows in steps; with t size in
    place of r, which is never smaller, it is for the largest. Where all other sets are of one size r itself is taken.
    """
    rest = lambda size: F.ceil(size * percent / 100) - 1
    most = lambda size: F.when(low == high, rest(size)).otherwise(size * percent / 100)
    enough = lambda bound, other: bound * (100 + percent) >= (n + other) * percent
    low = F.greatest(n0, F.ceil(n * percent / 100))
    high = F.least(n1, F.floor(n * 100 / percent))
    return (low <= high) & (enough(c + rest(n), low) | enough(c + most(high), high))


def spanning_links(sets: list[np.ndarray], node: np.ndarray, root: np.ndarray, asks: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (asking node, member) that connect roots which aren't connected by those before them; the other rows are members."""
    held = np.flatnonzero(~asks)
    _, label = np.unique(root, return_inverse=True)
    # the group's tokens in order, each with the member that has it: the union, and who to open
    tokens = np.concatenate([np.zeros(0, U), *(sets[k] for k in held)])
    member = np.repeat(np.arange(len(held)), [len(sets[k]) for k in held])
    by = np.argsort(tokens, kind="stable")
    tokens, member = tokens[by], member[by]
    sizes = np.array([len(sets[k]) for k in held], np.int64)
    out = []
    for q in np.flatnonzero(asks):
        own = sets[q]
        if (label[held] == label[q]).all():
            continue
        low, high = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
        if 100 * np.count_nonzero(high > low) < percent * len(own):
            continue
        runs = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
        common = np.bincount(member[at], minlength=len(held))
        for k in held[100 * common >= percent * (len(own) + sizes - common)]:
            if label[k] != label[q]:
                label[label == label[k]] = label[q]
                out.append((int(node[q]), int(node[k])))
    return out


def pieces(rows: Column, tokens: Column) -> Column:
    """Into how many pieces sets are dealt that have so many rows and tokens."""
    return F.greatest(F.ceil(rows / GROUP_ROWS), F.ceil(tokens / GROUP_TOKENS)).cast("int")


def open_groups(docs: DataFrame, nodes: DataFrame, members: DataFrame, queries: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) that connect (gid, node, root, n) queries with members whose sets are similar enough. nodes: (node, rep)."""
    parts = queries.groupBy("gid").agg(pieces(F.count("*"), F.sum("n")).alias("parts"))
    asked = queries.join(parts, "gid").select("gid", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node", "root", F.lit(True).alias("asks"))
    held = members.join(parts, "gid").select("gid", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "node", "root", F.lit(False).alias("asks"))
    rows = cut(asked.unionByName(held), "rows")
    # null ids don't name a text: their nodes are looked up by the text's own hash
    needed = rows.select("node").distinct().join(nodes, "node").select("node", "rep")
    named = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("_text")).filter("rep IS NOT NULL")
    texts = named.join(needed.filter("rep IS NOT NULL"), "rep").select("node", "_text")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            right = [node_of(s) == node for s, node in zip(_sets(batch.column(1), n), batch.column(0).to_pylist(), strict=True)]
            yield batch.filter(pa.array(right, pa.bool_()))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([node_of(s) for s in _sets(batch.column(0), n)], pa.int64()), batch.column(0)], names=["node", "_text"])

    # an id that isn't unique brings texts of other sets along; those don't hash to the node
    texts = texts.mapInArrow(own, "node long, _text string")
    unnamed = docs.filter(F.col(id_col).isNull()).select(F.col(text_col).alias("_text")).mapInArrow(hashed, "node long, _text string")
    texts = texts.unionByName(unnamed.join(needed.filter("rep IS NULL").select("node"), "node")).dropDuplicates(["node"])

    def compare(table: pa.Table) -> pa.Table:
        node, root = table.column("node").to_numpy(), table.column("root").to_numpy()
        links = spanning_links(list(_sets(table.column("_text"), n)), node, root, np.array(table.column("asks").to_pylist(), bool), percent)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    found = cut(rows.join(texts, "node").groupBy("gid", "part").applyInArrow(compare, "a long, b long"), "found")
    free(rows)
    return found


def jaccard_components(docs: DataFrame, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every document."""
    docs = docs.select(id_col, text_col)
    sets = cut(document_sets(docs, n, percent, id_col, text_col), "sets")
    some = sets.filter("n > 0")
    nodes = some.groupBy("node").agg(F.min(id_col).alias("rep"))
    # one row per node, then one per prefix token; of tokens that several nodes hold the rows stay
    one = cut(some.groupBy("node").agg(F.min("n").alias("n"), F.any_value("prefix").alias("prefix")), "nodes")
    rows = one.select("node", "n", F.explode("prefix").alias("token"))
    several = cut(rows.groupBy("token").agg(F.min(F.struct("node", "n")).alias("pivot"), F.max("node").alias("last")).filter("pivot.node <> last").select("token", "pivot"), "several")
    shared = cut(rows.join(several, "token"), "shared")
    free(one, several)

    alike = lambda x, y: (F.least(x, y) * 100 >= F.greatest(x, y) * percent)
    # which pairs are looked at here is a matter of speed: the groups meet again below, by all their tokens
    met = shared.filter((F.col("pivot.node") != F.col("node")) & alike(F.col("n"), F.col("pivot.n")))
    near = cut(met.groupBy(F.col("pivot.node").alias("gid"), "node").agg(F.count("*").alias("c"), F.min("n").alias("n"), F.min("pivot.n").alias("m")), "near")
    tested = near.filter(may_link(F.col("c"), F.col("n"), F.col("m"), F.col("m"), percent)).select("gid", "node", F.col("node").alias("root"), "n")
    first = tested.select("gid", F.col("gid").alias("node"), F.col("gid").alias("root")).distinct()
    stars = open_groups(docs, nodes, first, tested, n, percent, id_col, text_col)

    roots = connected_components(stars)  # (u, v)
    linked = roots.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    # a node without a link stands in a group with others that share most with the same pivot
    best = near.groupBy("node").agg(F.max_by("gid", F.struct("c", "gid")).alias("pivot"))
    best = best.join(linked.select(F.col("node").alias("pivot"), F.col("root").alias("to")), "pivot", "left").select("node", F.coalesce("to", "pivot").alias("to"))
    placed = shared.groupBy("node").agg(F.min("n").alias("n")).join(linked, "node", "left").join(best, "node", "left")
    placed = placed.withColumn("grp", F.coalesce("root", F.when(F.col("to").isNotNull(), F.xxhash64(F.lit("by pivot"), "to")), "node"))
    sizes = placed.groupBy("grp").agg(F.count("*").alias("size"), pieces(F.count("*"), F.sum("n")).alias("parts"))
    gid = F.when(F.col("size") == 1, F.col("node")).otherwise(F.xxhash64("grp", F.pmod(F.xxhash64("node"), F.col("parts"))))
    placed = cut(placed.join(sizes, "grp").select("node", F.coalesce("root", "node").alias("root"), "size", gid.alias("gid")), "placed")

    # tokens whose holders aren't all connected yet
    held = shared.select("token", "node", "n").join(placed, "node")
    spans = held.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("token")
    crossing = cut(held.join(spans, "token"), "crossing")
    free(shared)
    groups = crossing.groupBy("token", "gid", "size").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    x, g = crossing.alias("x"), groups.alias("g")
    asks = (F.col("x.token") == F.col("g.token")) & (F.struct("x.size", "x.gid") <= F.struct("g.size", "g.gid")) & ((F.col("g.r0") != F.col("x.root")) | (F.col("g.r1") != F.col("x.root")))
    fits = (F.col("x.n") * 100 >= F.col("g.n0") * percent) & (F.col("g.n1") * 100 >= F.col("x.n") * percent)
    met = x.join(g, asks & fits).groupBy("g.gid", "x.node").agg(F.count("*").alias("c"), F.min("x.n").alias("n"), F.min("x.root").alias("root"), F.min("g.n0").alias("n0"), F.max("g.n1").alias("n1"))
    pairs = met.filter(may_link(F.col("c"), F.col("n"), F.col("n0"), F.col("n1"), percent)).select("gid", "node", "root", "n")
    known = tested.select("gid", "node").unionByName(tested.select(F.col("node").alias("gid"), F.col("gid").alias("node")))
    pairs = cut(pairs.join(known, ["gid", "node"], "left_anti"), "pairs")
    members = placed.select("gid", "node", "root").join(pairs.select("gid").distinct(), "gid", "left_semi")
    more = open_groups(docs, nodes, members, pairs, n, percent, id_col, text_col)
    free(near, placed, crossing, pairs, roots)

    roots = connected_components(stars.unionByName(more))
    named = nodes.join(roots.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("v", "node"))
    names = cut(named.select("node", "rep", "root"), "named")
    free(stars, more, roots)
    smallest = names.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_node = names.join(smallest, "root").select("node", "component_id")
    out = sets.select(id_col, "n", "node").join(of_node, "node", "left")
    return out.select(id_col, F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col(id_col)).otherwise(F.col("component_id")).alias("component_id"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
