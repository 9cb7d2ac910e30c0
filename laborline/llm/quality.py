"""Quality by a sparse rule ensemble.

Shallow trees over text statistics give paths; each path is a conjunctive rule. A lasso logistic regression over the
rules keeps few of them, and these are compiled into one Spark column expression. The sample has a fixed bound (SAMPLE),
which is a parameter.

Defined results: null and empty texts have the statistics of an empty text; labels of null value are left out, of several
labels of an id the largest holds; rows that repeat an id are scored each for itself, and are samples each; equal texts have
equal scores; without labels of both kinds every score is the share of ones (1 without labels); an empty table gives no rows;
extra columns stay, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_bytes, views
from .features import QUALITY_FEATURES, quality_features
from .toxicity import SAMPLE, assembled, labelled_sample

THRESHOLD = 0.3
TREES, DEPTH, SEED = 16, 3, 11
LASSO = 0.002

#: feature number, True for "at most", bound
Condition = tuple[int, bool, float]


def paths(node, above: tuple[Condition, ...] = ()) -> list[tuple[Condition, ...]]:
    """Every path from the root to a node below it, as conditions, from a Spark ML tree's nodes (JVM handles)."""
    out = [above] if above else []
    if node.subtreeDepth() == 0:
        return out
    split = node.split()
    k, bound = split.featureIndex(), round(float(split.threshold()), 6)
    return out + paths(node.leftChild(), (*above, (k, True, bound))) + paths(node.rightChild(), (*above, (k, False, bound)))


def simplified(rule: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """One condition for each feature and direction: the tightest."""
    best: dict[tuple[int, bool], float] = {}
    for k, at_most, bound in rule:
        old = best.get((k, at_most))
        best[k, at_most] = bound if old is None else min(old, bound) if at_most else max(old, bound)
    return tuple(sorted((k, m, b) for (k, m), b in best.items()))


def rule_column(rule: tuple[Condition, ...], features: Column) -> Column:
    out = F.lit(True)
    for k, at_most, bound in rule:
        out = out & (features[k] <= bound if at_most else features[k] > bound)
    return out


def feature_udf():
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("array<double>")
    def features(column: pa.Array) -> pa.Array:
        return pa.array([quality_features(bytes(v)) for v in views(column)], pa.list_(pa.float64()))

    return features


@dataclass
class QualityModel:
    rules: list[tuple[tuple[Condition, ...], float]]
    intercept: float
    share: float | None = None

    def column(self, features: Column) -> Column:
        """The ensemble as one expression over the array of statistics."""
        if self.share is not None:
            return F.lit(self.share)
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule_column(rule, features), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def described(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{QUALITY_FEATURES[k]} {'<=' if m else '>'} {b:g}" for k, m, b in r) for r, w in self.rules]

    def scored(self, df: DataFrame, text: str = "text") -> DataFrame:
        """``df`` with all its columns, and quality_score from 0 to 1."""
        keep = [f"_keep_{k}" for k in range(len(df.columns))]
        with_stats = df.toDF(*keep).withColumn("_features", feature_udf()(text_bytes(keep[df.columns.index(text)])))
        return with_stats.select(*[F.col(k).alias(n) for k, n in zip(keep, df.columns, strict=True)], self.column(F.col("_features")).alias("quality_score"))


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> QualityModel:
    sample = labelled_sample(docs, labels, "quality", limit)
    rows = cut(sample.select("doc_id", (F.col("label") > 0).cast("double").alias("label"), feature_udf()("body").alias("_features")))
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    n, ones = sum(counts.values()), int(counts.get(1.0, 0))
    if not ones or ones == n:
        return QualityModel([], 0.0, ones / n if n else 1.0)
    forest = RandomForestClassifier(featuresCol="_vector", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxBins=64, featureSubsetStrategy="onethird").fit(assembled(rows, QUALITY_FEATURES).select("label", "_vector").coalesce(4))
    rules = sorted({simplified(p) for t in forest.trees for p in paths(t._call_java("rootNode"))}, key=lambda r: (len(r), r))
    marks = rows.select("label", *[rule_column(r, F.col("_features")).cast("double").alias(f"r{k}") for k, r in enumerate(rules)])
    data = cut(VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="_vector").transform(marks).select("label", "_vector").coalesce(4))
    lasso = LogisticRegression(featuresCol="_vector", labelCol="label", elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(data)
    kept = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if abs(w) > 1e-6]
    return QualityModel(kept, float(lasso.intercept))
