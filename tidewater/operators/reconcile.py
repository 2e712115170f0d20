"""Reconciliation of additive hierarchies: bottom-up, least squares, minimum trace and weighted objectives."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.schema import TIME


@dataclass
class Hierarchy:
    """A tree by levels: levels[d] has the number of children of every node at depth d. Nodes are numbered by depth, then in order."""

    levels: list[list[int]]

    def __post_init__(self):
        for above, below in zip(self.levels[:-1], self.levels[1:], strict=True):
            if sum(above) != len(below):
                raise ValueError("each node of a level needs its number of children")
        self.depth_sizes = [1, *[sum(x) for x in self.levels]]
        self.n_nodes, self.n_leaves = sum(self.depth_sizes), self.depth_sizes[-1]
        self.first = np.cumsum([0, *self.depth_sizes]).tolist()

    def children(self, node: int) -> list[int]:
        d = next(k for k in range(len(self.depth_sizes)) if node < self.first[k + 1])
        if d == len(self.levels):
            return []
        at = node - self.first[d]
        start = self.first[d + 1] + sum(self.levels[d][:at])
        return list(range(start, start + self.levels[d][at]))

    def edges(self) -> list[tuple[int, int]]:
        return [(p, c) for p in range(self.n_nodes) for c in self.children(p)]

    def sum_matrix(self) -> np.ndarray:
        """Nodes by leaves: 1 where the leaf is below the node."""
        s = np.zeros((self.n_nodes, self.n_leaves))
        for leaf in range(self.n_leaves):
            s[self.first[-2] + leaf, leaf] = 1
        for node in range(self.n_nodes - self.n_leaves - 1, -1, -1):
            s[node] = s[self.children(node)].sum(axis=0)
        return s

    def constraint_matrix(self) -> np.ndarray:
        """One row for each inner node: node less its children."""
        rows = []
        for node in range(self.n_nodes - self.n_leaves):
            r = np.zeros(self.n_nodes)
            r[node], r[self.children(node)] = 1, -1
            rows.append(r)
        return np.array(rows)

    def bottom_up(self) -> np.ndarray:
        out = np.zeros((self.n_nodes, self.n_nodes))
        out[:, self.first[-2] :] = self.sum_matrix()
        return out


def generalised_ls(s: np.ndarray, w: np.ndarray) -> np.ndarray:
    """S (S' W^-1 S)^-1 S' W^-1."""
    wi = np.linalg.pinv(w, hermitian=True)
    return s @ np.linalg.solve(s.T @ wi @ s, s.T @ wi)


def residual_covariance(actuals: DataFrame, forecasts: DataFrame, nodes: Sequence[str], ts: str = TIME, value: str = "value", node: str = "node") -> np.ndarray:
    """R R' / n over times at which all nodes are there: one n_nodes x n_nodes matrix per partition, added up."""
    joined = actuals.alias("a").join(forecasts.alias("f"), [ts, node]).select(ts, node, (F.col(f"a.{value}") - F.col(f"f.{value}")).alias("r"))
    rows = joined.groupBy(ts).agg(F.map_from_entries(F.collect_list(F.struct(node, "r"))).alias("m"))  # one entry per node
    flat = rows.select(F.array(*[F.col("m")[n] for n in nodes]).alias("v"))

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(nodes) ** 2 + 1)
        for b in batches:
            m = np.array([[np.nan if x is None else x for x in v] for v in b["v"]], float).reshape(-1, len(nodes))
            m = m[~np.isnan(m).any(axis=1)]
            total += np.append((m.T @ m).ravel(), len(m))
        yield pd.DataFrame({"i": range(len(total)), "x": total})

    sums = flat.mapInPandas(part, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toPandas()["x"].to_numpy()
    return sums[:-1].reshape(len(nodes), len(nodes)) / max(1.0, sums[-1])


@dataclass
class Reconciler:
    """A transform matrix between base and reconciled forecasts."""

    nodes: list[str]
    transform: np.ndarray

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.nodes[i], self.nodes[j], float(w)) for (i, j), w in np.ndenumerate(self.transform) if w]
        return spark.createDataFrame(rows, "node string, base string, w double")

    def apply(self, forecasts: DataFrame, keys: Sequence[str] = (TIME,), value: str = "value", node: str = "node") -> DataFrame:
        """Long forecasts (keys, node, value) reconciled: a join with the weights, then sums."""
        w = self.table(forecasts.sparkSession)
        joined = forecasts.withColumnRenamed(node, "base").join(F.broadcast(w), "base")
        return joined.groupBy(*keys, "node").agg(F.sum(F.col("w") * F.col(value)).alias(value))


def fit_reconciler(hierarchy: Hierarchy, nodes: Sequence[str], method: str = "ols", actuals: DataFrame | None = None, forecasts: DataFrame | None = None, covariance: np.ndarray | None = None, **weights) -> Reconciler:
    """bottom_up; ols (identity covariance); mint_sample (residual covariance); custom (see weighted_transform)."""
    s = hierarchy.sum_matrix()
    if method == "bottom_up":
        t = hierarchy.bottom_up()
    elif method == "ols":
        t = generalised_ls(s, np.eye(hierarchy.n_nodes))
    else:
        cov = residual_covariance(actuals, forecasts, nodes) if covariance is None else covariance
        t = generalised_ls(s, cov) if method == "mint_sample" else weighted_transform(hierarchy, cov, **weights)
    return Reconciler(list(nodes), t)


def weighted_transform(hierarchy: Hierarchy, covariance: np.ndarray, adjust: float = 1.0, variance: float = 1.0, unbiased: bool = True, lower: float | None = None, upper: float | None = None, rounds: int = 2000) -> np.ndarray:
    """Minimiser of adjust |T - I|^2 + variance tr(T W T') with consistent results (T = S G), optionally unbiased (G S = I) and with
    bounds on the entries of G. Without bounds closed form; with them projected gradient with the constraint by alternation."""
    s, m = hierarchy.sum_matrix(), hierarchy.n_nodes
    scale = np.trace(covariance) / m or 1.0
    w = adjust * np.eye(m) + variance * covariance / scale
    sts = s.T @ s
    # stationary point of the quadratic in G: S'S G (adjust I + variance W) = adjust S'
    g = np.linalg.solve(sts, adjust * s.T) @ np.linalg.inv(w)
    if unbiased:
        wi_s = np.linalg.solve(w, s)
        g = g + (np.eye(s.shape[1]) - g @ s) @ np.linalg.solve(s.T @ wi_s, wi_s.T)
    if lower is not None or upper is not None:
        step = 1 / (np.linalg.norm(sts, 2) * np.linalg.norm(w, 2))
        back = np.linalg.pinv(s)
        for _ in range(rounds):
            g = g - step * (sts @ g @ w - adjust * s.T)
            for _ in range(5):
                if unbiased:
                    g = g + (np.eye(s.shape[1]) - g @ s) @ back
                g = np.clip(g, lower, upper)
    return s @ g


def wide_to_long(df: DataFrame, nodes: Sequence[str], ts: str = TIME) -> DataFrame:
    return df.unpivot([ts], [f"`{n}`" if not n.isidentifier() else n for n in nodes], "node", "value")


def evaluate_reconciled(actuals: DataFrame, base: DataFrame, reconciled: DataFrame, hierarchy: Hierarchy, nodes: Sequence[str], ts: str = TIME) -> DataFrame:
    """MAPE, median APE and RMSE per node of base and reconciled forecasts."""
    from tidewater.functions.metrics import mape, median_ape, rmse

    a = actuals.withColumnRenamed("value", "_y")
    out = None
    for kind, f in (("base", base), ("reconciled", reconciled)):
        j = a.join(f, [ts, "node"])
        e = j.groupBy("node").agg(*[m(F.col("_y"), F.col("value")).alias(f"{n}_{kind}") for n, m in (("MAPE", mape), ("MedAPE", median_ape), ("RMSE", rmse))])
        out = e if out is None else out.join(e, "node")
    return out


def violation(df: DataFrame, hierarchy: Hierarchy, nodes: Sequence[str], ts: str = TIME) -> DataFrame:
    """Root mean square over inner nodes of node less children, per time."""
    edges = df.sparkSession.createDataFrame([(nodes[p], nodes[c]) for p, c in hierarchy.edges()], "node string, child string")
    below = df.withColumnRenamed("node", "child").join(F.broadcast(edges), "child").groupBy(ts, "node").agg(F.sum("value").alias("_sum"))
    return df.join(below, [ts, "node"]).groupBy(ts).agg(F.sqrt(F.avg(F.pow(F.col("value") - F.col("_sum"), F.lit(2)))).alias("violation"))
