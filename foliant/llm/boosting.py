"""Gradient-boosted trees, lasso logistic regression and isotonic calibration, fitted on the driver from a bounded sample.

Trees are also fitted on a whole table: boost_table() has Spark sum the histograms of every row, and only sums reach the
driver.

A tree is (feature, threshold, left, right): rows with x[feature] <= threshold go left; a leaf is a float.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import written

Tree = tuple | float


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _grow(bins: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, least: float, ridge: float) -> Tree:
    g, h = grad[rows].sum(), hess[rows].sum()
    leaf = float(-g / (h + ridge))
    if depth == 0 or len(rows) < 2 * least:
        return leaf
    best, split = 1e-6, None
    for f, own in enumerate(edges):
        if not len(own):
            continue
        b = bins[rows, f]
        gs, hs, ns = (np.cumsum(np.bincount(b, w, len(own) + 1))[:-1] for w in (grad[rows], hess[rows], None))
        gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
        gain[(ns < least) | (len(rows) - ns < least)] = 0
        k = int(gain.argmax())
        if gain[k] > best:
            best, split = gain[k], (f, k)
    if split is None:
        return leaf
    f, k = split
    left = bins[rows, f] <= k
    return (f, float(edges[f][k]), *(_grow(bins, edges, grad, hess, rows[m], depth - 1, least, ridge) for m in (left, ~left)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, least: int = 10, ridge: float = 1.0, bins: int = 48, weight: np.ndarray | None = None) -> tuple[float, list[Tree]]:
    """(bias, trees) of a logistic model; leaves are scaled by the learning rate."""
    weight = np.ones(len(y)) if weight is None else weight
    edges = [_edges(x[:, f], bins) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    p = float(np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3))
    bias = float(np.log(p / (1 - p)))
    z, out, rows = np.full(len(y), bias), [], np.arange(len(y))
    for _ in range(trees):
        q = sigmoid(z)
        tree = _scaled(_grow(binned, edges, weight * (q - y), weight * q * (1 - q), rows, depth, least, ridge), rate)
        out.append(tree)
        z += predict_tree(tree, x)
    return bias, out


def _edges(v: np.ndarray, bins: int) -> np.ndarray:
    """Midways between neighbouring quantiles, so that a threshold lies between values."""
    u = np.unique(v)
    if len(u) > bins:
        u = np.unique(np.quantile(v, np.linspace(0, 1, bins + 1), method="nearest"))
    return (u[:-1] + u[1:]) / 2


def _scaled(tree: Tree, rate: float) -> Tree:
    return tree * rate if isinstance(tree, float) else (tree[0], tree[1], _scaled(tree[2], rate), _scaled(tree[3], rate))


def predict_tree(tree: Tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], predict_tree(tree[2], x), predict_tree(tree[3], x))


def margin(model: tuple[float, list[Tree]], x: np.ndarray) -> np.ndarray:
    z = np.full(len(x), model[0])
    for tree in model[1]:
        z += predict_tree(tree, x)
    return z


def tree_column(tree: Tree, features: list[Column]) -> Column:
    """The tree as a Spark expression."""
    if isinstance(tree, float):
        return F.lit(tree)
    f, at, left, right = tree
    return F.when(features[f] <= F.lit(at), tree_column(left, features)).otherwise(tree_column(right, features))


#: Gradients are summed as integers of this part, so that sums don't hang on their order; leaves are multiples of GRAIN, so that margins are exact.
PART, GRAIN = 1 << 20, 1 / 1024
#: A binned tree: ({node: (feature, bin)}, {leaf: value}); the root is 1, the children of n are 2n (bin or lower) and 2n + 1.
Binned = tuple[dict[int, tuple[int, int]], dict[int, float]]


def table_edges(rows: DataFrame, names: list[str], most: int) -> list[np.ndarray]:
    """For each numeric column, ends of at most `most` bins of about as many rows each, midway between values; every row counts."""
    each = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(n).cast("double").alias("v")) for k, n in enumerate(names)])).alias("x")).select("x.*")
    place, whole = Window.partitionBy("f").orderBy("v"), Window.partitionBy("f")
    sums = each.groupBy("f", "v").agg(F.count(F.lit(1)).alias("n")).withColumns({"cum": F.sum("n").over(place), "all": F.sum("n").over(whole), "values": F.count(F.lit(1)).over(whole)})
    bin_ = F.when(F.col("values") <= most, F.col("cum")).otherwise(F.floor((F.col("cum") - 1) * most / F.col("all")))
    ends = sums.withColumn("bin", bin_).select("f", "v", "bin", F.lead("v").over(place).alias("v2"), F.lead("bin").over(place).alias("bin2")).where("bin <> bin2")
    out: list[list[float]] = [[] for _ in names]
    for r in ends.collect():
        out[r.f].append((r.v + r.v2) / 2)
    return [np.array(sorted(e)) for e in out]


def _nodes(splits: dict[int, tuple[int, int]], bins: np.ndarray) -> np.ndarray:
    """The node of a binned tree that each row ends in."""
    at = np.ones(len(bins), np.int64)
    for node in sorted(splits):
        f, k = splits[node]
        own = at == node
        at[own] = 2 * node + (bins[own, f] > k)
    return at


def binned_margin(model: tuple[float, list[Binned]], bins: np.ndarray) -> np.ndarray:
    z = np.full(len(bins), model[0])
    for splits, leaves in model[1]:
        value = np.zeros(max(leaves) + 1)
        value[list(leaves)] = list(leaves.values())
        z += value[_nodes(splits, bins)]
    return z


def packed(bins: list[Column]) -> Column:
    """Small numbers, of 255 at most, as a byte each."""
    return F.unhex(F.concat(*[F.lpad(F.hex(b), 2, "0") for b in bins]))


def unpacked(bins: Column, features: int) -> Column:
    """The numbers of packed(), as an array."""
    return F.transform(F.sequence(F.lit(1), F.lit(features)), lambda k: F.conv(F.hex(F.substring(bins, k, F.lit(1))), 16, 10).cast("int"))


def _node_column(splits: dict[int, tuple[int, int]], worth, node: int = 1) -> Column:
    """worth(node) of the node of a binned tree that a row ends in, its bins being an array."""
    if node not in splits:
        return worth(node)
    f, k = splits[node]
    return F.when(F.get("bins", F.lit(f)) <= k, _node_column(splits, worth, 2 * node)).otherwise(_node_column(splits, worth, 2 * node + 1))


def margin_column(model: tuple[float, list[Binned]]) -> Column:
    """binned_margin() over a column of arrays."""
    z = F.lit(model[0])
    for splits, leaves in model[1]:
        z = z + _node_column(splits, lambda n, own=leaves: F.lit(own[n]))
    return z


def _histograms(rows: DataFrame, growing: list[dict], nodes: list[list[int]], features: int, slots: int) -> DataFrame:
    """(at, g, h, n): sums of the gradients and of the forms of each model, node, feature and bin."""
    own = []
    for m, now in enumerate(nodes):
        if not now:
            continue
        q = 1 / (1 + F.exp(-F.greatest(F.least(f"z{m}", F.lit(35.0)), F.lit(-35.0))))
        slot = _node_column(growing[m], lambda n, m=m, now=now: F.lit(m * slots + now.index(n) if n in now else None).cast("long"))
        g, h = F.rint(F.col("n") * (q - F.col("label")) * PART), F.rint(F.col("n") * q * (1 - q) * PART)
        own.append(F.struct(F.when(F.col("fold") != m, slot).alias("slot"), g.cast("long").alias("g"), h.cast("long").alias("h")))
    each = rows.select("bins", F.col("forms").alias("n"), F.inline(F.array(*own))).where("slot is not null")
    cut = each.select("slot", "g", "h", "n", F.posexplode("bins").alias("f", "bin"))
    at = (F.col("slot") * features + F.col("f")) * 256 + F.col("bin")
    return cut.groupBy(at.alias("at")).agg(*[F.sum(c).alias(c) for c in "ghn"])


def boost_table(cells: DataFrame, edges: list[np.ndarray], folds: int, trees: int, depth: int, rate: float, least: int = 10, ridge: float = 1.0) -> list[tuple[float, list[Binned]] | None]:
    """Logistic models over the bins of every row: one without each fold, then one of all; None where a model's rows have one label.

    cells: (fold, label, n, forms, bins), n the weight of `forms` equal rows, bins a byte for each feature. All models
    grow together, a level at a time; a level's histograms are summed by Spark, and at most one row for each model, node,
    feature and bin comes to the driver. The margins so far are written with the cells after each tree.
    """
    features, models = len(edges), []
    counts = cells.groupBy("fold", "label").agg(F.sum("n").alias("n")).collect()
    for m in range(folds + 1):
        n = [sum(r.n for r in counts if r.fold != m and r.label == k) for k in (0, 1)]
        p = float(np.clip(n[1] / max(1, sum(n)), 1e-3, 1 - 1e-3))
        models.append((round(float(np.log(p / (1 - p))) / GRAIN) * GRAIN, []) if min(n) else (0.0, None))
    kept = [m for m, model in enumerate(models) if model[1] is not None]
    if not kept:
        return [None for _ in models]
    rows = cells.select("fold", "label", "n", "forms", unpacked(F.col("bins"), features).alias("bins"), *[F.lit(models[m][0]).alias(f"z{m}") for m in kept])
    rows = written(rows.repartition(cells.sparkSession.sparkContext.defaultParallelism), "margins")
    for k in range(trees):
        growing, leaves = [{} for _ in models], [{} for _ in models]
        nodes = [[1] if m in kept else [] for m in range(len(models))]
        for _level in range(depth):
            if not any(nodes):
                break
            slots = max(map(len, nodes))
            sums = _histograms(rows, growing, nodes, features, slots).toArrow()
            total = np.zeros((len(models) * slots * features * 256, 3))
            total[sums.column("at").to_numpy()] = np.stack([sums.column(c).to_numpy() for c in "ghn"], axis=1)
            total = total.reshape(len(models), -1, features, 256, 3)
            total[..., :2] /= PART
            for m in kept:
                after = []
                for j, node in enumerate(nodes[m]):
                    after += _split(total[m, j], edges, growing[m], leaves[m], node, least, ridge, rate)
                nodes[m] = after
        for m in kept:
            models[m][1].append((growing[m], {n: v for n, v in leaves[m].items() if n not in growing[m]}))
        if k < trees - 1:
            rows = written(rows.withColumns({f"z{m}": F.col(f"z{m}") + margin_column((0.0, models[m][1][-1:])) for m in kept}), "margins")
    return [model if model[1] is not None else None for model in models]


def _split(own: np.ndarray, edges: list[np.ndarray], growing: dict, leaves: dict, node: int, least: int, ridge: float, rate: float) -> list[int]:
    """Splits a node where that gains most; its leaf, or those of its children, are noted, and the children given."""
    worth = lambda g, h: round(float(-g / (h + ridge)) * rate / GRAIN) * GRAIN
    g, h, n = own[0].sum(axis=0)
    leaves[node] = worth(g, h)
    best, found = 1e-6, None
    for f, e in enumerate(edges):
        if n < 2 * least or not len(e):
            continue
        gs, hs, ns = np.cumsum(own[f, : len(e)], axis=0).T
        gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
        gain[(ns < least) | (n - ns < least)] = 0
        k = int(gain.argmax())
        if gain[k] > best:
            best, found = gain[k], (f, k, gs[k], hs[k])
    if found is None:
        return []
    f, k, gl, hl = found
    growing[node] = (f, k)
    leaves[2 * node], leaves[2 * node + 1] = worth(gl, hl), worth(g - gl, h - hl)
    return [2 * node, 2 * node + 1]


def unbinned(tree: Binned, edges: list[np.ndarray], node: int = 1) -> Tree:
    """A binned tree with the thresholds that its bins end at."""
    splits, leaves = tree
    if node not in splits:
        return float(leaves[node])
    f, k = splits[node]
    return (f, float(edges[f][k]), unbinned(tree, edges, 2 * node), unbinned(tree, edges, 2 * node + 1))


def paths(tree: Tree, above: tuple = ()) -> list[tuple]:
    """The conjunctions of a tree: for each node below the root, ((feature, threshold, is_left), ...)."""
    if isinstance(tree, float):
        return []
    f, at, left, right = tree
    out = []
    for branch, side in ((left, True), (right, False)):
        rule = (*above, (f, at, side))
        out += [rule, *paths(branch, rule)]
    return out


def rule_values(rule: tuple, x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, at, left in rule:
        hit &= (x[:, f] <= at) == left
    return hit


def rule_column(rule: tuple, features: list[Column]) -> Column:
    hit = None
    for f, at, left in rule:
        one = features[f] <= F.lit(at) if left else features[f] > F.lit(at)
        hit = one if hit is None else hit & one
    return hit


def lasso_logistic(x: np.ndarray, y: np.ndarray, strength: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """(intercept, weights) by accelerated proximal gradient steps; the intercept is not penalised."""
    n = len(y)
    a = np.column_stack([np.ones(n), x])
    rate = 4.0 * n / (np.linalg.norm(a, 2) ** 2 + 1e-12)
    w = np.zeros(a.shape[1])
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    w[0] = np.log(p / (1 - p))
    v, t = w.copy(), 1.0
    for _ in range(steps):
        new = v - rate * (a.T @ (sigmoid(a @ v) - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * strength, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[0]), w[1:]


def isotonic(z: np.ndarray, y: np.ndarray, prior: float = 1.0, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Knots (z, probability) of a nondecreasing fit by pooling adjacent violators, for linear interpolation.

    Each pool is shrunk by `prior` pseudo-rows towards the overall rate, so that no score is exactly 0 or 1.
    """
    weight = np.ones(len(y)) if weight is None else weight
    order = np.argsort(z, kind="stable")
    z, y, weight = z[order], y[order].astype(float), weight[order]
    u, start = np.unique(z, return_index=True)
    total, count = np.add.reduceat(y * weight, start), np.add.reduceat(weight, start)
    pools: list[list[float]] = []
    for k, (s, n) in enumerate(zip(total, count, strict=True)):
        pools.append([s, n, k, k])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s2, n2, _, last = pools.pop()
            pools[-1] = [pools[-1][0] + s2, pools[-1][1] + n2, pools[-1][2], last]
    rate = float(np.average(y, weights=weight))
    at, p = [], []
    for s, n, first, last in pools:
        value = (s + prior * rate) / (n + prior)
        for k in sorted({int(first), int(last)}):
            at.append(u[k]), p.append(value)
    return np.array(at), np.maximum.accumulate(np.array(p))


def auc(score: np.ndarray, y: np.ndarray) -> float:
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    u, inverse, count = np.unique(score[order], return_inverse=True, return_counts=True)
    upper = np.cumsum(count)
    ranks[order] = (upper - (count - 1) / 2)[inverse]
    n1 = int((y == 1).sum())
    n0 = len(y) - n1
    return float((ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / max(1, n1 * n0))
