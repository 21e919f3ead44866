"""Decision trees and boosted ensembles as column expressions (M5-M7).

A fitted tree is a nested choice over feature columns.  ``compile_tree`` and
``compile_boosted`` write it as such: nested CASE expressions of native
columns, which Catalyst puts into the scan's code generation, so scoring needs
neither a feature vector nor the learner's classes, and the expression can be
given to SQL as it stands (``to_sql``).  The learner's splits on indexed
categorical features are written back to the features' own values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    """Rows whose ``feature`` is at most ``threshold``, or one of ``values``,
    go left; all others, nulls among them, go right."""

    feature: str
    left: Leaf | Split
    right: Leaf | Split
    threshold: float | None = None
    values: tuple[float, ...] | None = None


Tree = Leaf | Split


def compile_tree(tree: Tree) -> Column:
    """The tree's value for a row."""
    if isinstance(tree, Leaf):
        return F.lit(float(tree.value))
    x = F.col(f"`{tree.feature}`").cast("double")
    left = x <= tree.threshold if tree.values is None else x.isin(*map(float, tree.values))
    return F.when(left, compile_tree(tree.left)).otherwise(compile_tree(tree.right))


def compile_boosted(trees: Sequence[Tree], weights: Sequence[float]) -> Column:
    """1.0 where the weighted sum of the trees is above zero, else 0.0."""
    total = reduce(lambda a, b: a + b, [F.lit(float(w)) * compile_tree(t) for t, w in zip(trees, weights, strict=True)])
    return F.when(total > 0, F.lit(1.0)).otherwise(F.lit(0.0))


def to_sql(tree: Tree) -> str:
    """The tree as a CASE expression of standard SQL; numeric features."""
    if isinstance(tree, Leaf):
        return f"CAST({float(tree.value)!r} AS DOUBLE)"
    test = f"<= {float(tree.threshold)!r}" if tree.values is None else f"IN ({', '.join(repr(float(v)) for v in tree.values)})"
    return f'(CASE WHEN CAST("{tree.feature}" AS DOUBLE) {test} THEN {to_sql(tree.left)} ELSE {to_sql(tree.right)} END)'


def label_of(index: Column, labels: Sequence[str]) -> Column:
    """M7: the label at a predicted index."""
    return F.element_at(F.array(*map(F.lit, labels)), index.cast("int") + 1)


def _read(node, features: Sequence[str], categories: dict[int, dict[float, int]]) -> Tree:
    if node.getClass().getSimpleName() == "LeafNode":
        return Leaf(float(node.prediction()))
    split = node.split()
    at = int(split.featureIndex())
    left, right = (_read(child, features, categories) for child in (node.leftChild(), node.rightChild()))
    if split.getClass().getSimpleName() == "ContinuousSplit":
        return Split(features[at], left, right, threshold=float(split.threshold()))
    indices = {int(c) for c in split.leftCategories()}
    own = categories.get(at, {})
    return Split(features[at], left, right, values=tuple(sorted(v for v, i in own.items() if i in indices)))


def _categories(indexer) -> dict[int, dict[float, int]]:
    """Feature -> value -> index of a fitted vector indexer."""
    return {int(f): {float(v): int(i) for v, i in m.items()} for f, m in dict(indexer.categoryMaps).items()} if indexer is not None else {}


def read_tree(model, features: Sequence[str], indexer=None) -> Tree:
    """A fitted single tree over the named features."""
    return _read(model._java_obj.rootNode(), features, _categories(indexer))


def read_boosted(model, features: Sequence[str], indexer=None) -> tuple[list[Tree], list[float]]:
    """The trees and weights of a fitted boosted ensemble."""
    known = _categories(indexer)
    return ([_read(t.rootNode(), features, known) for t in model._java_obj.trees()], [float(w) for w in model.treeWeights])
