"""Gradient boosting with trees that grow leaf by leaf, the leaf of the largest gain first.

Features are cut into at most ``bins`` codes once. Rows of equal codes go the same way in every tree, so they
become one row with their number and the sum of their labels: trees are grown over as many rows as there are
different codes. What a split needs are counts and sums of residuals by (leaf, feature, code), which partitions
add up on their own. A round asks for all leaves that the order of
gains may reach next, so a tree takes as many rounds as it is deep, not as many as it has leaves.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, field
from math import inf, isfinite, nextafter, sqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.forecast.models import Regression
from tidewell.plans.quantiles import known
from tidewell.session import written

#: the code of a missing value
MISSING = -1


@dataclass
class Leaf:
    """A node of a growing tree: its rows, the sum of their residuals and, once asked for, its best split."""

    rows: float
    total: float
    path: list[tuple[int, int, bool, bool]]  # (feature, code, missing goes left, this side is left)
    gain: float | None = None
    split: tuple[int, int, bool] | None = None
    children: tuple[Leaf, Leaf] | None = None


@dataclass
class Tree:
    """Nodes as arrays; ``feature`` is -1 at a leaf."""

    feature: list[int] = field(default_factory=list)
    code: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    rows: list[float] = field(default_factory=list)

    def add(self, feature: int, code: int, missing_left: bool, value: float, gain: float, rows: float) -> int:
        for own, x in zip(
            (self.feature, self.code, self.missing_left, self.left, self.right, self.value, self.gain, self.rows),
            (feature, code, missing_left, -1, -1, value, gain, rows),
            strict=True,
        ):
            own.append(x)
        return len(self.feature) - 1

    def column(self, at: int = 0) -> Column:
        """The value of a row as an expression over its codes."""
        if self.feature[at] < 0:
            return F.lit(float(self.value[at]))
        return F.when(_goes_left(self.feature[at], self.code[at], self.missing_left[at]), self.column(self.left[at])).otherwise(
            self.column(self.right[at])
        )

    def values(self, codes: np.ndarray) -> np.ndarray:
        """The values of rows of codes, all of them one level down at a time."""
        feature, code, left, right = (np.array(x) for x in (self.feature, self.code, self.left, self.right))
        missing_left = np.array(self.missing_left)
        at = np.zeros(len(codes), np.int64)
        while (inner := np.flatnonzero(feature[at] >= 0)).size:
            node = at[inner]
            own = codes[inner, feature[node]]
            goes = np.where(own == MISSING, missing_left[node], own <= code[node])
            at[inner] = np.where(goes, left[node], right[node])
        return np.array(self.value)[at]


@dataclass
class Boosted:
    """``base`` plus ``rate`` times the trees, over features cut at ``edges``."""

    features: list[str]
    edges: list[list[float]]
    base: float
    rate: float
    trees: list[Tree]

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """``df`` with its prediction; a missing feature goes the way that was best in training."""
        trees, base, rate, width = self.trees, self.base, self.rate, len(self.features)

        def run(codes: pa.Array) -> pa.Array:
            rows = codes.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            out = np.full(len(rows), base)
            for tree in trees:
                out += rate * tree.values(rows)
            return pa.array(out)

        coded = _coded(df, self.features, self.edges)
        codes = F.array(*[F.col(f"__c{i}") for i in range(width)])
        return coded.withColumn(name, F.arrow_udf(run, "double")(codes)).drop(*[f"__c{i}" for i in range(width)])

    def importance(self) -> dict[str, float]:
        """The share of all gains that the splits of a feature made."""
        gains = [0.0] * len(self.features)
        for tree in self.trees:
            for feature, gain in zip(tree.feature, tree.gain, strict=True):
                if feature >= 0:
                    gains[feature] += gain
        return {f: g / (sum(gains) or 1.0) for f, g in zip(self.features, gains, strict=True)}


def _goes_left(feature: int, code: int, missing_left: bool) -> Column:
    own = F.col(f"__c{feature}")
    inside = own <= code
    return inside if missing_left else inside & (own != MISSING)


def _edges(df: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """At most ``bins`` - 1 thresholds per feature, in one aggregate; all values of a feature that has few, 0 if it has none."""
    probs = [i / bins for i in range(1, bins)]
    cuts = [F.percentile_approx(known(f), probs, 20 * max(bins, 500)).alias(f"q{i}") for i, f in enumerate(features)]
    row = df.agg(*cuts).first()
    return [sorted({e for e in row[f"q{i}"] or [] if isfinite(e)}) or [0.0] for i in range(len(features))]


def _coded(df: DataFrame, features: Sequence[str], edges: list[list[float]]) -> DataFrame:
    """``__c<i>``: how many thresholds of feature i are below its value, or ``MISSING``."""
    n = range(len(features))
    numbers = df.withColumns({f"__x{i}": known(f) for i, f in enumerate(features)})
    # a bucket holds its lower end, so each threshold is moved to the next number
    splits = [[-inf, *[nextafter(e, inf) for e in own], inf] for own in edges]
    cut = Bucketizer(
        splitsArray=splits, inputCols=[f"__x{i}" for i in n], outputCols=[f"__b{i}" for i in n], handleInvalid="keep"
    ).transform(numbers)
    codes = {f"__c{i}": F.when(F.col(f"__x{i}").isNull(), F.lit(MISSING)).otherwise(F.col(f"__b{i}").cast("int")) for i in n}
    return cut.withColumns(codes).drop(*[f"__x{i}" for i in n], *[f"__b{i}" for i in n])


def _best_split(rows: np.ndarray, sums: np.ndarray, least_rows: int, ridge: float) -> tuple[float, tuple | None, tuple | None]:
    """(gain, (feature, code, missing goes left), left side) from counts and sums by feature and code, missing ones first."""
    n, s = rows[0].sum(), sums[0].sum()
    best: tuple = (0.0, None, None)
    for missing_left in (True, False):
        if not missing_left and not rows[:, 0].any():
            continue
        left_n, left_s = rows.copy(), sums.copy()
        if not missing_left:
            left_n[:, 0] = left_s[:, 0] = 0
        left_n, left_s = left_n.cumsum(axis=1)[:, 1:], left_s.cumsum(axis=1)[:, 1:]
        right_n, right_s = n - left_n, s - left_s
        fits = (left_n >= least_rows) & (right_n >= least_rows)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left_s**2 / (left_n + ridge) + right_s**2 / (right_n + ridge) - s**2 / (n + ridge)
        gain = np.where(fits, gain, -inf)
        feature, code = np.unravel_index(np.argmax(gain), gain.shape)
        if gain[feature, code] > best[0]:
            side = (float(left_n[feature, code]), float(left_s[feature, code]))
            best = (float(gain[feature, code]), (int(feature), int(code), missing_left), side)
    return best


def _ask(rows: DataFrame, leaves: list[Leaf], width: int, bins: int, least_rows: int, ridge: float) -> None:
    """Find the best splits of ``leaves``, all from one aggregate."""
    place = F.lit(None).cast("int")
    for k, leaf in enumerate(leaves):
        inside = F.lit(True)
        for feature, code, missing_left, is_left in leaf.path:
            goes = _goes_left(feature, code, missing_left)
            inside = inside & (goes if is_left else ~goes)
        place = F.when(inside, F.lit(k)).otherwise(place)
    rest = F.col("label") - F.col("n") * F.col("score")
    placed = rows.select(place.alias("leaf"), "n", rest.alias("rest"), *[f"__c{i}" for i in range(width)])
    codes = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f"__c{i}").alias("code")) for i in range(width)])
    each = placed.where("leaf IS NOT NULL").select("leaf", "n", "rest", F.explode(codes).alias("c"))
    cells = each.groupBy("leaf", "c.feature", "c.code").agg(F.sum("n").alias("n"), F.sum("rest").alias("s"))
    counts = np.zeros((len(leaves), width, bins + 1))
    sums = np.zeros_like(counts)
    for leaf, feature, code, n, s in cells.collect():  # at most leaves x features x (bins + 1) rows
        counts[leaf, feature, code - MISSING] = n
        sums[leaf, feature, code - MISSING] = s
    for k, leaf in enumerate(leaves):
        if not leaf.path:
            leaf.rows, leaf.total = float(counts[k, 0].sum()), float(sums[k, 0].sum())
        leaf.gain, leaf.split, side = _best_split(counts[k], sums[k], least_rows, ridge)
        if leaf.split:
            n, s = side
            below = [[*leaf.path, (*leaf.split, is_left)] for is_left in (True, False)]
            leaf.children = (Leaf(n, s, below[0]), Leaf(leaf.rows - n, leaf.total - s, below[1]))


def _in_order(root: Leaf, leaves: int, least_rows: int) -> tuple[list[Leaf], list[Leaf]]:
    """The splits by decreasing gain as far as gains are known, and the leaves whose gain is to be asked for."""
    heap, chosen, unknown = [(-(root.gain or 0.0), 0, root)], [], []
    number = 1
    while heap and len(chosen) + 1 < leaves:
        gain, _, leaf = heapq.heappop(heap)
        if gain >= 0:
            break
        chosen.append(leaf)
        for child in leaf.children:
            if child.gain is None and child.rows < 2 * least_rows:
                child.gain = 0.0  # too few rows for two sides
            if child.gain is None:
                unknown.append(child)
            elif child.split:
                heapq.heappush(heap, (-child.gain, number, child))
                number += 1
    return chosen, unknown


def grow(rows: DataFrame, width: int, bins: int, leaves: int, least_rows: int, ridge: float) -> Tree:
    """One tree for the residuals over the codes ``__c0`` to ``__c<width - 1>``: rows are ``n`` each, with the sum
    ``label`` of their labels and one ``score`` for all."""
    root = Leaf(0.0, 0.0, [])
    _ask(rows, [root], width, bins, least_rows, ridge)
    while True:
        chosen, unknown = _in_order(root, leaves, least_rows)
        if not unknown:
            break
        _ask(rows, unknown, width, bins, least_rows, ridge)
    tree, split = Tree(), {id(leaf) for leaf in chosen}

    def add(leaf: Leaf) -> int:
        inner = id(leaf) in split
        feature, code, missing_left = leaf.split if inner else (-1, 0, False)
        value = leaf.total / (leaf.rows + ridge) if leaf.rows else 0.0
        at = tree.add(feature, code, missing_left, value, leaf.gain if inner else 0.0, leaf.rows)
        if inner:
            tree.left[at], tree.right[at] = (add(child) for child in leaf.children)
        return at

    add(root)
    return tree


def boost(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    rounds: int = 100,
    leaves: int = 31,
    rate: float = 0.05,
    bins: int = 255,
    least_rows: int = 20,
    ridge: float = 0.0,
) -> Boosted:
    """Boosted trees for squared error on all rows of ``df`` whose ``label`` is a number.

    Missing features (null or NaN) are a value of their own that each split sends to the better side. A side of
    a split has at least ``least_rows`` rows. Without a labelled row the model has no trees and predicts 0.
    The rows are read twice, for the thresholds and for the sums by codes; the codes and their running score are
    written anew to the shared folder after every tree.
    """
    features = list(features)
    labelled = df.withColumn("__y", known(label)).where(F.col("__y").isNotNull())
    edges = _edges(labelled, features, bins)
    codes = [f"__c{i}" for i in range(len(features))]
    coded = _coded(labelled, features, edges).groupBy(*codes)
    cells = written(coded.agg(F.count("*").alias("n"), F.sum("__y").alias("label")), "codes")
    total, n = cells.agg(F.sum("label"), F.sum("n")).first()
    base = total / n if n else None
    model = Boosted(features, edges, 0.0 if base is None else base, rate, [])
    if base is None:
        return model
    rows = cells.withColumn("score", F.lit(base))
    for k in range(rounds):
        tree = grow(rows, len(features), bins, leaves, least_rows, ridge)
        if len(tree.feature) == 1:
            break  # no split gains anything any more
        model.trees.append(tree)
        if k + 1 < rounds:
            rows = written(rows.withColumn("score", F.col("score") + rate * tree.column()), "scores")
    return model


def leafwise_trees(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    order: Sequence[str],
    last: int = 30,
    test_share: float = 0.2,
    **options,
) -> Regression:
    """Fit on about 80 % of the labelled rows, measure on the rest, predict the last ``last`` rows of all.

    A row belongs to the test part by a hash of its ``order`` columns, so that repeated runs agree whatever the
    partitions. ``options`` go to ``boost``.
    """
    labelled = df.withColumn("label", known(target)).where(F.col("label").isNotNull())
    held = F.pmod(F.xxhash64(*order), F.lit(10_000)) < round(10_000 * test_share)
    model = boost(labelled.where(~held), features, "label", **options)
    error = model.predict(labelled.where(held).select("label", *features)).agg(F.avg((F.col("label") - F.col("prediction")) ** 2))
    squared = error.first()[0]
    recent = model.predict(df.orderBy(*[F.desc(o) for o in order]).limit(last))
    rmse = float("nan") if squared is None else sqrt(squared)
    return Regression(recent.select(*order, "prediction"), rmse, model.importance(), model)
