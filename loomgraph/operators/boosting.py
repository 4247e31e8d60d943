"""Boosted trees that grow leaf by leaf, from histograms of gradients.

Features are cut into bins; a tree's leaves are split best first, the split with the largest gain next, up to a number of leaves. All that the driver holds is the
trees and the histograms of the leaves that may be split next: leaves x features x bins numbers, whatever the number of rows. A pass over
the rows sums the histograms of the lesser child of each leaf that may be split; the other child is its parent less that. A pass serves all leaves
that could come next, so a tree takes about as many passes as it is deep. Gradients are summed as whole numbers (in units of
2 ** -40), so a model doesn't depend on how rows are dealt to tasks. Rows with equal bins, label and weight are one row with their number, which
changes no sum; passes go over these.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.models import check_predictors
from loomgraph.session import discard, staged

UNIT = float(1 << 40)
#: Trees after which the rows' scores are written; between, tasks work out the last trees again.
WRITE_EVERY = 16


@dataclass
class Tree:
    """Nodes: feature (-1 for a leaf), the last bin that goes left, children, value."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        at = np.zeros(len(bins), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not inner.size:
                return at
            own = at[inner]
            left = bins[inner, self.feature[own]] <= self.cut[own]
            at[inner] = np.where(left, self.left[own], self.right[own])


@dataclass
class Model:
    names: list[str]
    edges: list[np.ndarray]
    start: float
    trees: list[Tree] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bins of a matrix of features: the number of edges below a value; a missing value has the last bin."""
        out = np.empty(x.shape, np.int16)
        for j, e in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(x[:, j]), e.size + 1, np.searchsorted(e, x[:, j], "left"))
        return out

    def staged_scores(self, x: np.ndarray, rounds: list[int]) -> np.ndarray:
        """The raw scores after so many trees each, a column for each number."""
        bins, score, out = self.bins(x), np.full(len(x), self.start), np.empty((len(x), len(rounds)))
        for k in range(len(self.trees) + 1):
            for j, r in enumerate(rounds):
                if r == k or r > k == len(self.trees):
                    out[:, j] = score
            if k < len(self.trees):
                score = score + self.trees[k].value[self.trees[k].place(bins)]
        return out


@dataclass
class Node:
    g: np.ndarray
    h: np.ndarray
    n: np.ndarray
    gain: float = 0.0
    feature: int = -1
    cut: int = -1
    children: tuple[int, int] | None = None

    def find(self, least_rows: int, l2: float) -> Node:
        """Fills in the best split: the first of those with the largest gain, by feature and bin."""
        g, h, n = (np.cumsum(a, axis=1)[:, :-1] for a in (self.g / UNIT, self.h / UNIT, self.n))
        G, H, N = self.g[0].sum() / UNIT, self.h[0].sum() / UNIT, self.n[0].sum()
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = g**2 / (h + l2) + (G - g) ** 2 / (H - h + l2) - G**2 / (H + l2)
        gain[~((n >= least_rows) & (N - n >= least_rows) & (h > 1e-3) & (H - h > 1e-3))] = -np.inf
        best = int(np.argmax(np.round(gain, 9)))
        f, b = divmod(best, gain.shape[1])
        if gain[f, b] > 1e-9:
            self.gain, self.feature, self.cut = float(gain[f, b]), f, b
        return self


def grown(histograms, leaves: int, rate: float, least_rows: int, l2: float) -> Tree:
    """A tree of at most so many leaves. histograms(tree, nodes) gives (g, h, n) of each of the nodes of a tree, in whole units."""
    root = Tree(np.array([-1]), np.array([-1]), np.array([-1]), np.array([-1]), np.zeros(1))
    nodes = [Node(*histograms(root, [0])[0]).find(least_rows, l2)]

    def tree_of(chosen: set[int]) -> Tree:
        made = [nodes[k].children if k in chosen else None for k in range(len(nodes))]
        value = [0.0 if c else -rate * x.g[0].sum() / max(x.h[0].sum() + l2 * UNIT, 1e-12) for x, c in zip(nodes, made, strict=True)]
        return Tree(*(np.array([getattr(x, a) if c else -1 for x, c in zip(nodes, made, strict=True)]) for a in ("feature", "cut")), *(np.array([c[i] if c else -1 for c in made]) for i in range(2)), np.array(value))

    chosen: set[int] = set()
    while len(chosen) < leaves - 1:
        open_, k = [0], None
        for x in chosen:
            open_ += nodes[x].children
        open_ = [x for x in open_ if x not in chosen and nodes[x].gain > 0]
        if not open_:
            break
        k = max(open_, key=lambda x: (nodes[x].gain, -x))
        if nodes[k].children is None:  # a pass for all that may come next
            wanted, parents = [], []
            room = leaves - 1 - len(chosen)
            for x in sorted((x for x in open_ if nodes[x].children is None), key=lambda x: -nodes[x].gain)[:room]:
                own = nodes[x]
                own.children = len(nodes), len(nodes) + 1
                zero = np.zeros_like(own.g)
                nodes += [Node(zero, zero, zero), Node(zero, zero, zero)]
                in_left = own.n[own.feature, : own.cut + 1].sum()
                wanted.append(own.children[int(in_left * 2 > own.n[0].sum())])
                parents.append(x)
            routing = tree_of({x for x in range(len(nodes)) if nodes[x].children})
            for x, lesser, sums in zip(parents, wanted, histograms(routing, wanted), strict=True):
                other = sum(nodes[x].children) - lesser
                nodes[lesser] = Node(*sums).find(least_rows, l2)
                nodes[other] = Node(*(a - b for a, b in zip((nodes[x].g, nodes[x].h, nodes[x].n), sums, strict=True))).find(least_rows, l2)
        chosen.add(k)
    return tree_of(chosen)


def gradients(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the weighted logistic loss, in whole units."""
    p = 1 / (1 + np.exp(-score))
    return np.rint(w * (p - y) * UNIT).astype(np.int64), np.rint(w * np.maximum(p * (1 - p), 1e-12) * UNIT).astype(np.int64)


def summed(at: np.ndarray, nodes: list[int], bins: np.ndarray, values: tuple[np.ndarray, ...], width: int) -> np.ndarray:
    """[node, value, feature, bin]: sums of whole numbers over the rows of each node."""
    out = np.zeros((len(nodes), len(values), bins.shape[1], width), np.int64)
    for i, k in enumerate(nodes):
        own = np.flatnonzero(at == k)
        for f in range(bins.shape[1]):
            for j, v in enumerate(values):
                np.add.at(out[i, j, f], bins[own, f], v[own])
    return out


def fit(df: DataFrame, names: list[str], y: str = "y", weight: str | None = None, rounds: int = 100, leaves: int = 7, rate: float = 0.1, least_rows: int = 20, l2: float = 0.0, most_bins: int = 255) -> Model:
    """Trees that tell y = 1 from 0. Bins are cut at distinct quantiles of the features, as many as there are bins at most; missing features go right of all others."""
    check_predictors(names)
    x = [F.col(c).cast("double").alias(c) for c in names]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*x, F.col(y).cast("double").alias("_y"), w.alias("_w"))
    shares = [i / most_bins for i in range(1, most_bins)]
    cuts = rows.agg(F.sum(F.col("_w") * F.col("_y")).alias("_p"), F.sum("_w").alias("_m"), *(F.percentile_approx(F.when(~F.isnan(c), F.col(c)), shares, 20_000).alias(c) for c in names)).first()
    positives, everything = cuts["_p"] or 0.0, cuts["_m"] or 0.0
    if not 0 < positives < everything:
        raise ValueError("both classes are needed")
    model = Model(list(names), [np.unique(np.array(cuts[c] if cuts[c] is not None else [], float)) for c in names], float(np.log(positives / (everything - positives))))
    width = max(e.size for e in model.edges) + 2

    def cut(batches):
        for b in batches:
            bins = model.bins(np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in bins], pa.binary()), b.column("_y"), b.column("_w")], ["bins", "y", "w"])

    kind = "bins binary, y double, w double, n long, score double"
    alike = rows.mapInArrow(cut, "bins binary, y double, w double").groupBy("bins", "y", "w").agg(F.count("*").alias("n"))
    data, written = staged(alike.withColumn("score", F.lit(model.start)), "binned"), 0

    def read(b: pa.RecordBatch, trees: list[Tree]):
        bins = np.frombuffer(b"".join(b.column("bins").to_pylist()), np.int16).reshape(b.num_rows, len(names))
        score = b.column("score").to_numpy()
        for t in trees:
            score = score + t.value[t.place(bins)]
        return bins, b.column("y").to_numpy(), b.column("w").to_numpy(), b.column("n").to_numpy(), score

    for _ in range(rounds):
        late = model.trees[written:]

        def histograms(tree: Tree, nodes: list[int], late=late, data=data) -> list:
            def count(batches):
                total = 0
                for b in batches:
                    if b.num_rows:
                        bins, own_y, own_w, n, score = read(b, late)
                        total = total + summed(tree.place(bins), nodes, bins, (*(x * n for x in gradients(score, own_y, own_w)), n), width)
                if np.any(total):
                    at = np.nonzero(total.any(axis=1))
                    yield pa.RecordBatch.from_arrays([*(pa.array(a.astype(np.int32)) for a in at), *(pa.array(total[at[0], j, at[1], at[2]]) for j in range(3))], ["node", "feature", "bin", "g", "h", "n"])

            sums = data.mapInArrow(count, "node int, feature int, bin int, g long, h long, n long").groupBy("node", "feature", "bin").agg(*(F.sum(c).alias(c) for c in "ghn")).toArrow()  # nodes x features x bins at most
            out = np.zeros((3, len(nodes), len(names), width), np.int64)
            at = tuple(sums.column(c).to_numpy() for c in ("node", "feature", "bin"))
            for j, c in enumerate("ghn"):
                out[j][at] = sums.column(c).to_numpy()
            return [tuple(out[:, i]) for i in range(len(nodes))]

        model.trees.append(grown(histograms, leaves, rate, least_rows, l2))
        if len(model.trees) - written >= WRITE_EVERY:
            pending = model.trees[written:]

            def advance(batches, pending=pending):
                for b in batches:
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("bins", "y", "w", "n")), pa.array(read(b, pending)[4])], ["bins", "y", "w", "n", "score"])

            before, data, written = data, staged(data.mapInArrow(advance, kind), "binned"), len(model.trees)
            discard(before)
    discard(data)
    return model


def score(model: Model, df: DataFrame, rounds: list[int] | None = None, name: str = "logit") -> DataFrame:
    """df with the raw score; with rounds, an array of the scores after so many trees each."""
    own = rounds or [len(model.trees)]

    @F.pandas_udf("array<double>")
    def run(x: pd.DataFrame) -> pd.Series:
        return pd.Series(list(model.staged_scores(x.to_numpy(float), own)))

    made: Column = run(F.struct(*(F.col(c).cast("double").alias(c) for c in model.names)))
    return df.withColumn(name, made if rounds else made[0])
