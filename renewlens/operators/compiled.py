"""A fitted model as column expressions: no vectors, no Python, additive explanations.

Trees become nested conditions on the feature columns (thresholds, missing flags, category levels),
a logistic model a sum of terms. Contributions of trees are exact path-dependent Shapley values.
For one leaf the coalition game is a product over the features on its path, each of which the row
either follows or, if left out, follows with the share of training rows that went that way; its
values are therefore a small table of the patterns of followed features. The leaves of a low subtree
depend on few tests together, so their sum is one table per feature and group of leaves, computed
once here and only looked up per row. Below that depth a leaf has its values as an integral over the
product's factors, which a few nodes give exactly: trees may have any number of splits and levels.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewlens.functions.scalars import sigmoid
from renewlens.operators.guards import GuardViolation
from renewlens.operators.models import Fitted, level_number
from renewlens.session import staging_root

SHAP = "shap__"
GROUP_TESTS = 7  # leaves share their tables while they depend on at most so many tests together
WORD = 62  # tests whose outcomes share one bigint


@dataclass(frozen=True)
class Node:
    """A leaf (``value``) or a split: rows for which SQL ``test`` holds go left."""

    rows: float
    value: float = 0.0
    feature: str = ""
    test: str = ""
    left: Node | None = None
    right: Node | None = None


def _number(x: float) -> str:
    return f"{float(x)!r}D"


def _table(values: Sequence[float]) -> str:
    """An array constant as one text: Spark turns it into numbers once a plan, not into an expression each."""
    return f"cast(split('{','.join(repr(float(x)) for x in values)}', ',') AS array<double>)"


@dataclass
class _Leaf:
    """A leaf's way down: per feature, the bits of its tests, their wanted state, the training share."""

    value: float
    care: dict[str, int]
    want: dict[str, int]
    share: dict[str, float]


def _splits(node: Node) -> int:
    return 0 if node.left is None or node.right is None else 1 + _splits(node.left) + _splits(node.right)


def _groups(root: Node) -> tuple[list[str], list[tuple[list[int], list[_Leaf]]]]:
    """Tests of a tree (one bit each) and its leaves, grouped by low subtree: the numbers of all tests
    that the group's leaves depend on, and the leaves."""
    tests: list[str] = []
    groups: list[tuple[list[int], list[_Leaf]]] = []

    def down(node: Node, path: list[int], care: dict, want: dict, share: dict, own: tuple | None) -> None:
        leaf = node.left is None or node.right is None
        if own is None and (leaf or len(path) + _splits(node) <= GROUP_TESTS):
            own = (list(path), [])
            groups.append(own)
        if leaf:
            own[1].append(_Leaf(node.value, care, want, share))
            return
        no = len(tests)
        tests.append(node.test)
        if own is not None:
            own[0].append(no)
        bit, f = 1 << no, node.feature
        for child, taken in ((node.left, bit), (node.right, 0)):
            down(
                child,
                [*path, no],
                {**care, f: care.get(f, 0) | bit},
                {**want, f: want.get(f, 0) | taken},
                {**share, f: share.get(f, 1.0) * child.rows / node.rows},
                own,
            )

    down(root, [], {}, {}, {}, None)
    return tests, groups


def _group_tables(tests: Sequence[int], leaves: Sequence[_Leaf], weight: float) -> dict[str, list[float]]:
    """Per feature, its summed Shapley values in the leaves for every outcome of ``tests`` (bit i: the i-th holds)."""
    states = [sum(1 << no for i, no in enumerate(tests) if outcome >> i & 1) for outcome in range(1 << len(tests))]
    out: dict[str, list[float]] = {}
    for leaf in leaves:
        path = list(leaf.care)
        share = [leaf.share[f] for f in path]
        patterns = [
            sum(1 << j for j, f in enumerate(path) if state & leaf.care[f] == leaf.want[f]) for state in states
        ]
        for j, f in enumerate(path):
            values = shapley_table(weight * leaf.value, share, j)
            sums = out.setdefault(f, [0.0] * len(states))
            for at, pattern in enumerate(patterns):
                sums[at] += values[pattern]
    return out


def _word(bits: int, w: int) -> int:
    return bits >> WORD * w & ((1 << WORD) - 1)


def _unit_nodes(players: int) -> list[tuple[float, float]]:
    """Nodes and weights on 0..1 that integrate a product of one factor less than ``players`` exactly.

    A Shapley value of the game of :func:`shapley_table` is its player's gain times the integral over t
    of the product of the others' ``(1 - t) * share + t * follows``.
    """
    nodes, weights = np.polynomial.legendre.leggauss((players + 1) // 2)
    return [(float(x + 1) / 2, float(w) / 2) for x, w in zip(nodes, weights)]


def shapley_table(value: float, share: Sequence[float], j: int) -> list[float]:
    """Shapley value of player j for every pattern of followed players (bit i: player i follows).

    The game is ``value`` times the product, over players, of 1 or 0 for a member that follows or
    does not, and of ``share`` for a player left out.
    """
    d = len(share)
    others = [i for i in range(d) if i != j]
    weight = [math.factorial(s) * math.factorial(d - 1 - s) / math.factorial(d) for s in range(d)]
    out = []
    for pattern in range(1 << d):
        # ways[s]: sum over coalitions of s other players of the product of their factors
        ways = [1.0] + [0.0] * len(others)
        for n, i in enumerate(others):
            follows = pattern >> i & 1
            for s in range(n + 1, -1, -1):
                ways[s] = ways[s] * share[i] + (ways[s - 1] * follows if s else 0.0)
        gain = (pattern >> j & 1) - share[j]
        out.append(value * gain * sum(w * v for w, v in zip(weight, ways)))
    return out


@dataclass(frozen=True)
class CompiledScorer:
    """Probability = link(base + contributions); the same interface as a linear scorer.

    ``link`` is ``logit`` (boosted trees, logistic) or ``identity`` (forests, whose trees vote with
    probabilities). :meth:`score` adds the contributions as columns unless told not to.
    """

    name: str
    features: tuple[str, ...]
    link: str
    base: float
    trees: tuple[Node, ...] = ()
    tree_weights: tuple[float, ...] = ()
    terms: Mapping[str, str] = field(default_factory=dict)  # logistic: SQL per feature

    def probability(self, z: Column) -> Column:
        return sigmoid(z) if self.link == "logit" else z

    def contribution(self, feature: str) -> Column:
        return F.col(f"{SHAP}{feature}") if feature in self._used() else F.lit(0.0)

    def log_odds(self) -> Column:
        """Base and contributions, which :meth:`score` must have added."""
        total = F.lit(self.base)
        for f in self.features:
            if f in self._used():
                total = total + F.col(f"{SHAP}{f}")
        return total

    def _used(self) -> frozenset[str]:
        if self.terms:
            return frozenset(self.terms)

        def seen(node: Node) -> frozenset[str]:
            return frozenset() if node.left is None else seen(node.left) | seen(node.right) | {node.feature}

        return frozenset().union(*map(seen, self.trees))

    def check(self, df: DataFrame) -> None:
        """The features of a table must be the model's, in its order (G10)."""
        given = [c for c in df.columns if c in set(self.features)]
        if given != list(self.features):
            missing = sorted(set(self.features) - set(given))
            raise GuardViolation(f"features_match: the model needs its features in its order (missing {missing})")

    def _raw_sql(self) -> str:
        def value(node: Node) -> str:
            if node.left is None:
                return _number(node.value)
            return f"IF({node.test}, {value(node.left)}, {value(node.right)})"

        if self.terms:
            return " + ".join([_number(self.base), *self.terms.values()])
        return " + ".join(f"{_number(w)} * {value(t)}" for t, w in zip(self.trees, self.tree_weights))

    def score(self, df: DataFrame, out: str = "p", *, contributions: bool = True) -> DataFrame:
        self.check(df)
        scored = df.withColumn(out, self.probability(F.expr(self._raw_sql())))
        return self.attributed(scored) if contributions else scored

    def attributed(self, df: DataFrame) -> DataFrame:
        """Contribution columns next to the row's own."""
        if self.terms:
            return df.selectExpr("*", *[f"{sql} AS `{SHAP}{f}`" for f, sql in self.terms.items()])
        *steps, sums = self._lookups
        rows = df
        for columns in steps:
            rows = rows.selectExpr("*", *columns)
        contributions = [f"{' + '.join(parts)} AS `{SHAP}{f}`" for f, parts in sums.items()]
        return rows.selectExpr(*[f"`{c}`" for c in df.columns], *contributions)

    @cached_property
    def _lookups(self) -> tuple[list[str], list[str], list[str], dict[str, list[str]]]:
        """SQL of three steps, each reading the one before, and of the terms of each feature.

        First the outcomes of a tree's tests as bits; then, per group of leaves, the place in its tables
        or, for a leaf of many tests, which features follow its way; then the products of such leaves.
        """
        masks: list[str] = []
        places: list[str] = []
        products: list[str] = []
        sums: dict[str, list[str]] = {}
        for t, (tree, weight) in enumerate(zip(self.trees, self.tree_weights)):
            tests, groups = _groups(tree)
            for w in range(0, len(tests), WORD):
                bits = [f"IF({test}, {1 << i}L, 0L)" for i, test in enumerate(tests[w : w + WORD])]
                masks.append(f"{' | '.join(bits)} AS __tests{t}_{w // WORD}")
            for numbers, leaves in groups:
                if not numbers:  # a tree without splits
                    continue
                at = f"__at{len(places)}"
                if len(numbers) <= GROUP_TESTS:
                    bits = [
                        f"IF((__tests{t}_{no // WORD} & {1 << no % WORD}L) = 0L, 0, {1 << i})"
                        for i, no in enumerate(numbers)
                    ]
                    places.append(f"{' | '.join(bits)} AS {at}")
                    for f, values in _group_tables(numbers, leaves, weight).items():
                        sums.setdefault(f, []).append(f"get({_table(values)}, {at})")
                    continue
                (leaf,) = leaves
                follows = []
                for i, f in enumerate(leaf.care):
                    parts = {w: _word(leaf.care[f], w) for w in range(max(numbers) // WORD + 1)}
                    same = [f"(__tests{t}_{w} & {c}L) = {_word(leaf.want[f], w)}L" for w, c in parts.items() if c]
                    places.append(f"{' AND '.join(same)} AS {at}_{i}")
                    follows.append(f"{at}_{i}")
                for k, (node, part) in enumerate(_unit_nodes(len(follows))):
                    factors = [
                        f"IF({x}, {_number((1 - node) * r + node)}, {_number((1 - node) * r)})"
                        for x, r in zip(follows, leaf.share.values())
                    ]
                    products.append(f"{' * '.join([_number(weight * leaf.value * part), *factors])} AS {at}_product{k}")
                    for f, x in zip(leaf.care, follows):
                        r = leaf.share[f]
                        gains = _number((1 - r) / ((1 - node) * r + node)), _number(-1 / (1 - node))
                        sums.setdefault(f, []).append(f"{at}_product{k} * IF({x}, {', '.join(gains)})")
        return masks, places, products, sums

    def explained_columns(self) -> list[str]:
        return [f"{SHAP}{f}" for f in self.features if f in self._used()]


def _expected(node: Node) -> float:
    if node.left is None or node.right is None:
        return node.value
    return (node.left.rows * _expected(node.left) + node.right.rows * _expected(node.right)) / node.rows


def _trees(fitted: Fitted, data: DataFrame, leaf: str) -> tuple[Node, ...]:
    """Trees from the stored form of a tree model (a row per node)."""
    rows: dict[int, dict[int, object]] = {}
    for r in data.collect():  # nodes of the model: bounded by its depth and number of trees
        rows.setdefault(r.treeID, {})[r.nodeData.id] = r.nodeData
    inputs = fitted.inputs

    def grow(nodes: dict, at: int) -> Node:
        n = nodes[at]
        stats = list(n.impurityStats)
        if n.leftChild < 0:
            value = n.prediction if leaf == "prediction" else stats[1] / sum(stats)
            return Node(float(n.rawCount), float(value))
        spec, on = n.split, inputs[n.split.featureIndex]
        if spec.numCategories >= 0:
            test = f"{on.sql} IN ({', '.join(_number(c) for c in spec.leftCategoriesOrThreshold)})"
        else:
            test = f"{on.sql} <= {_number(spec.leftCategoriesOrThreshold[0])}"
        left, right = grow(nodes, n.leftChild), grow(nodes, n.rightChild)
        return Node(left.rows + right.rows, 0.0, on.feature, test, left, right)

    return tuple(grow(rows[t], 0) for t in sorted(rows))


def compile_scorer(fitted: Fitted, path: str | None = None) -> CompiledScorer:
    """The scorer of a fitted model. ``path``: where the bundle keeps it, if it is stored already."""
    model = fitted.model.stages[-1]
    if fitted.name == "logistic":
        terms: dict[str, list[str]] = {}
        base = float(model.intercept)
        means = fitted.means or (0.0,) * len(fitted.inputs)
        tables: dict[str, list[float]] = {}
        shift: dict[str, float] = {}
        for on, weight, mean in zip(fitted.inputs, model.coefficients, means, strict=True):
            base += float(weight) * mean
            if on.feature in fitted.levels:  # indicators of one category: a lookup by level, 0 if unseen
                tables.setdefault(on.feature, []).append(float(weight))
                shift[on.feature] = shift.get(on.feature, 0.0) + float(weight) * mean
            else:
                terms.setdefault(on.feature, []).append(f"{_number(weight)} * ({on.sql} - {_number(mean)})")
        for f, weights in tables.items():
            at = f"cast({level_number(f, fitted.levels[f])} AS int)"
            terms[f] = [f"get({_table([*weights, 0.0])}, {at}) - {_number(shift[f])}"]
        sums = {f: f"({' + '.join(parts)})" for f, parts in terms.items()}
        return CompiledScorer(fitted.name, fitted.features, "logit", base, terms=sums)
    if path is None:
        from uuid import uuid4

        spark = fitted.spark()
        path = f"{staging_root(spark)}/renewlens/compiled-{uuid4().hex}"
        model.write().save(path)
    data = fitted.spark().read.parquet(f"{path}/data")
    boosted = isinstance(model, GBTClassificationModel)
    trees = _trees(fitted, data, "prediction" if boosted else "share")
    # boosting's probability is the logistic function of twice the margin; a forest's the trees' mean
    scale = [2.0 * w for w in model.treeWeights] if boosted else [1.0 / len(trees)] * len(trees)
    base = sum(w * _expected(t) for t, w in zip(trees, scale))
    return CompiledScorer(
        fitted.name, fitted.features, "logit" if boosted else "identity", base, trees, tuple(scale)
    )
