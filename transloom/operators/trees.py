"""Gradient-boosted regression trees from histograms.

Features are cut into bins at their quantiles once. Rows of the same bins go the same way through every tree, so the rows are
read once more and become cells: (bins, sum of residuals, rows). A level of a tree is one aggregation of the cells by (node,
feature, bin), and the best split of every node is read off these sums. Their number is bounded by nodes, features and bins,
whatever the number of rows; cells are no more than the combinations of bins that exist, and never more than rows. The model is a
small table of splits and leaves. Cells are kept in the shared folder from tree to tree.

Defined cases: null and NaN values have a bin of their own, below all others; rows without a target are not learned from and are
predicted like any other; a feature of one value is never split; ties go to the first feature and the lowest cut.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from transloom.sources.shared import cut

#: (accuracy of the quantiles) is a multiple of the bins.
ACCURACY = 100


@dataclass
class Trees:
    """Splits {(tree, node): (feature, cut)} (left: null, or at most the cut), leaves {(tree, node): value}, start value.

    Node 1 is the root; the children of node i are 2 i and 2 i + 1.
    """

    start: float
    splits: dict[tuple[int, int], tuple[str, float]] = field(default_factory=dict)
    leaves: dict[tuple[int, int], float] = field(default_factory=dict)

    def table(self, spark: SparkSession) -> DataFrame:
        """(tree, node, feature, cut, value); the start value is tree 0."""
        rows = [(0, 1, None, None, self.start)]
        rows += [(t, n, f, c, None) for (t, n), (f, c) in sorted(self.splits.items())]
        rows += [(t, n, None, None, v) for (t, n), v in sorted(self.leaves.items())]
        return spark.createDataFrame(rows, "tree int, node int, feature string, cut double, value double")

    @staticmethod
    def read(table: DataFrame) -> Trees:
        out = Trees(0.0)
        for r in table.collect():  # a row for each node of the model
            if r["tree"] == 0:
                out.start = r["value"]
            elif r["feature"] is not None:
                out.splits[r["tree"], r["node"]] = r["feature"], r["cut"]
            else:
                out.leaves[r["tree"], r["node"]] = r["value"]
        return out

    def prediction(self, of: Callable[[str], Column] | None = None) -> Column:
        """The prediction of a row, inside whole-stage code. ``of`` gives a feature's value without nulls; see ``predict``."""
        trees = sorted({t for t, _ in self.leaves})
        return sum((self._value(t, 1, of or _ranked) for t in trees), F.lit(self.start))

    def _value(self, tree: int, node: int, of: Callable[[str], Column]) -> Column:
        if (tree, node) not in self.splits:
            return F.lit(self.leaves[tree, node])
        feature, at = self.splits[tree, node]
        return F.when(of(feature) <= at, self._value(tree, 2 * node, of)).otherwise(self._value(tree, 2 * node + 1, of))

    def predict(self, rows: DataFrame, out: str = "prediction") -> DataFrame:
        """Rows with their prediction. Values are made ready once a row: repeated at every split, they make a method that is too
        long for the JVM to compile."""
        names = {f: f"__x{i}" for i, f in enumerate(sorted({f for f, _ in self.splits.values()}))}
        return rows.withColumns({n: _ranked(f) for f, n in names.items()}).withColumn(out, self.prediction(lambda f: F.col(names[f]))).drop(*names.values())


def _value_of(feature: str) -> Column:
    return F.nanvl(F.col(f"`{feature}`").cast("double"), F.lit(None).cast("double"))


def _ranked(feature: str) -> Column:
    """The value with null below all others; no cut tells null from minus infinity."""
    return F.coalesce(_value_of(feature), F.lit(float("-inf")))


def cuts(rows: DataFrame, features: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Different quantiles of each feature, without the largest value; rising."""
    shares = [i / bins for i in range(1, bins + 1)]
    quantiles = [F.percentile_approx(_value_of(f), shares, bins * ACCURACY).alias(f"q{i}") for i, f in enumerate(features)]
    found = rows.agg(*quantiles, *[F.max(_value_of(f)).alias(f"m{i}") for i, f in enumerate(features)]).first()
    return {f: sorted({q for q in found[i] or [] if q < found[len(features) + i]}) for i, f in enumerate(features)}


def _bin(feature: str, edges: Sequence[float]) -> Column:
    """0 for null, else 1 and the number of edges below the value: a balanced tree of comparisons."""
    x = _value_of(feature)

    def among(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo + 1)
        middle = (lo + hi) // 2
        return F.when(x <= edges[middle], among(lo, middle)).otherwise(among(middle + 1, hi))

    return F.when(x.isNull(), 0).otherwise(among(0, len(edges)))


def _node(tree: dict[int, tuple[int, int]], node: int = 1) -> Column:
    """The open node of a row in a tree whose splits are (number of the feature, bin)."""
    if node not in tree:
        return F.lit(node)
    feature, at = tree[node]
    return F.when(F.col(f"b{feature}") <= at, _node(tree, 2 * node)).otherwise(_node(tree, 2 * node + 1))


def best_split(sums: dict[tuple[int, int], tuple[float, int]], features: int, ridge: float, least: int) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the best split of a node, from {(feature, bin): (sum of residuals, rows)}; None if none gains."""
    best = None
    for f in range(features):
        cells = sorted((b, *x) for (g, b), x in sums.items() if g == f)
        total, rows = sum(c[1] for c in cells), sum(c[2] for c in cells)
        left, n = 0.0, 0
        for b, s, m in cells[:-1]:
            left, n = left + s, n + m
            if n < least or rows - n < least:
                continue
            gain = left**2 / (n + ridge) + (total - left) ** 2 / (rows - n + ridge) - total**2 / (rows + ridge)
            if gain > 1e-9 * max(1.0, abs(total)) and (best is None or gain > best[0] * (1 + 1e-12)):
                best = gain, f, b
    return best


def fit_trees(rows: DataFrame, features: Sequence[str], target: str, trees: int = 10, depth: int = 3, bins: int = 32, rate: float = 0.3, ridge: float = 1.0, least: int = 20) -> Trees:
    """Boosted trees for the squared error of ``target``."""
    known = rows.where(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")))
    edges = cuts(known, features, bins)
    start = known.agg(F.avg(F.col(target).cast("double"))).first()[0]
    if start is None:
        return Trees(0.0)
    model = Trees(float(start))
    bin_of = [_bin(f, edges[f]).cast("short").alias(f"b{i}") for i, f in enumerate(features)]
    data = known.groupBy(*bin_of).agg(F.sum(F.col(target).cast("double") - start).alias("residual"), F.count("*").alias("rows"))
    data = cut(data)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"b{i}").cast("int").alias("b")) for i in range(len(features))])).alias("x")
    for t in range(1, trees + 1):
        splits: dict[int, tuple[int, int]] = {}
        open_, totals = {1}, {}
        for level in range(depth + 1):
            found = data.select(_node(splits).alias("node"), "residual", "rows", each).where(F.col("node").isin(*open_)).groupBy("node", "x.f", "x.b").agg(F.sum("residual").alias("s"), F.sum("rows").alias("n"))
            sums: dict[int, dict[tuple[int, int], tuple[float, int]]] = {}
            for r in found.collect():  # nodes x features x bins at most
                sums.setdefault(r["node"], {})[r["f"], r["b"]] = r["s"], r["n"]
            deeper = set()
            for node in sorted(open_):
                cells = sums.get(node, {})
                totals[node] = sum(s for (f, _), (s, _) in cells.items() if f == 0), sum(n for (f, _), (_, n) in cells.items() if f == 0)
                best = best_split(cells, len(features), ridge, least) if level < depth else None
                if best:
                    splits[node] = best[1], best[2]
                    deeper |= {2 * node, 2 * node + 1}
            open_ = deeper
            if not open_:
                break
        if not splits:
            break
        leaves = {n: rate * s / (m + ridge) for n, (s, m) in totals.items() if n not in splits}
        for node, (f, b) in splits.items():
            # bin 0 is null: a cut below every value
            model.splits[t, node] = features[f], edges[features[f]][b - 1] if b else float("-inf")
        model.leaves |= {(t, n): v for n, v in leaves.items()}
        step = F.create_map(*[x for n, v in leaves.items() for x in (F.lit(n), F.lit(v))])[_node(splits)]
        data = cut(data.withColumn("residual", F.col("residual") - F.col("rows") * step))
    return model
