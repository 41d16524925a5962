"""Boosted trees as SQL: a model is fitted with MLlib and read out as a Column expression."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fit_trees(rows: DataFrame, features: list[str], label: str, *, weight: str, trees: int = 8, depth: int = 3, seed: int = 7) -> Callable[[dict[str, Column]], Column] | None:
    """What gives the probability of label 1 from named feature columns; None if a label is missing.

    rows stand for as many as ``weight`` says. There are bins enough that MLlib takes its split points from all rows.
    """
    if rows.select(label).distinct().count() < 2:
        return None
    bins = max(32, math.ceil(rows.count() ** 0.5))
    data = VectorAssembler(inputCols=features, outputCol="__features", handleInvalid="keep").transform(rows.withColumn(label, F.col(label).cast("double")))
    model = GBTClassifier(featuresCol="__features", labelCol=label, maxIter=trees, maxDepth=depth, maxBins=bins, weightCol=weight, seed=seed, stepSize=0.3).fit(data)
    roots = [(tree.rootNode(), float(weight)) for tree, weight in zip(model._java_obj.trees(), model.treeWeights)]

    def chance(named: dict[str, Column]) -> Column:
        margin = F.lit(0.0)
        for root, weight in roots:
            margin = margin + F.lit(weight) * _tree(root, [named[k] for k in features])
        return 1.0 / (1.0 + F.exp(-2.0 * margin))

    return chance


def _tree(node, features: list[Column]) -> Column:
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(features[split.featureIndex()] <= F.lit(float(split.threshold())), _tree(node.leftChild(), features)).otherwise(_tree(node.rightChild(), features))
