"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from the labelled sample: words and word beginnings whose presence says most about the label.
Trees are fitted on three quarters of the sample, with
features by lexicons that were learned without the text; the rest calibrates their scores. Sample and lexicon have fixed
bounds (SAMPLE, LEXICON), which are parameters.

Defined results: null and empty texts have the features of an empty text; labels of null value are left out, of several
labels of an id the largest holds; rows that repeat an id are scored each for itself, and are samples each; terms of equal
support go by name; without labels of both kinds every score is the share of ones (0 without labels); an empty table gives
no rows; extra columns stay, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, text_bytes, views
from .features import TOXIC_FEATURES, terms_of, toxic_features, words_of

SAMPLE = 12_000
LEXICON = 256
#: Least support of a lexicon term: the likelihood ratio of its counts under the two labels; a lower one does for terms
#: that only toxic texts have, and these again and again (OFTEN times a text on average).
LEAST_G2, LEAST_G2_OFTEN, OFTEN = 18.0, 9.0, 2.0
THRESHOLD = 0.5
TREES, DEPTH, STEP_SIZE, SEED = 20, 3, 0.25, 7


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int = SAMPLE) -> DataFrame:
    """doc_id, body, label: at most ``limit`` labelled rows that aren't held out, by a hash of the id."""
    usable = labels.filter(~held_out() & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    ids = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("double")).alias("label"))
    chosen = cut(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body")).join(F.broadcast(chosen), "doc_id")
    return found.select("doc_id", "body", "label")


def learn_lexicon(sample: DataFrame, size: int = LEXICON) -> frozenset[str]:
    """The terms with the largest likelihood ratio among those that are commoner under label 1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: tuple[Counter, Counter] = (Counter(), Counter())
        uses: Counter = Counter()
        for batch in batches:
            for v, y in zip(views(batch.column("body")), batch.column("label").to_pylist(), strict=True):
                terms = terms_of(words_of(bytes(v).decode("utf-8", "replace")))
                texts[int(y > 0)].update(terms.keys())
                if y > 0:
                    uses.update(terms)
        terms = list(texts[0] | texts[1])
        for lo in range(0, len(terms), 100_000):
            part = terms[lo : lo + 100_000]
            yield pa.RecordBatch.from_pydict({"term": part, "ones": [texts[1][t] for t in part], "zeros": [texts[0][t] for t in part], "uses": [uses[t] for t in part]})

    totals = sample.groupBy((F.col("label") > 0).alias("y")).count().collect()
    n1, n0 = (sum(r["count"] for r in totals if r["y"] is kind) for kind in (True, False))
    if not n1 or not n0:
        return frozenset()
    counted = sample.select("body", "label").mapInArrow(count, "term string, ones long, zeros long, uses long")
    terms = counted.groupBy("term").agg(F.sum("ones").alias("a"), F.sum("zeros").alias("b"), F.sum("uses").alias("u"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    share = n1 / (n1 + n0)
    g2 = 2 * (a * F.log(a / ((a + b) * share)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0))
    best = terms.filter((a >= 2) & (a / (a + b) >= math.sqrt(share))).withColumn("g2", g2)
    best = best.filter(((F.col("a") >= 3) & (F.col("g2") >= LEAST_G2)) | ((F.col("g2") >= LEAST_G2_OFTEN) & (F.col("b") == 0) & (F.col("u") >= OFTEN * F.col("a"))))
    return frozenset(r[0] for r in best.orderBy(F.desc("g2"), "term").limit(size).select("term").collect())


def feature_udf(lexicon: frozenset[str]):
    """An Arrow UDF from the bytes of a text to its features."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("array<double>")
    def features(column: pa.Array) -> pa.Array:
        memo: dict[str, bool] = {}
        return pa.array([toxic_features(bytes(v), lexicon, memo) for v in views(column)], pa.list_(pa.float64()))

    return features


def assembled(df: DataFrame, names: tuple[str, ...], features: str = "_features") -> DataFrame:
    split = df.withColumns({f"_f_{n}": F.col(features)[k] for k, n in enumerate(names)})
    return VectorAssembler(inputCols=[f"_f_{n}" for n in names], outputCol="_vector").transform(split)


@dataclass
class ToxicityModel:
    lexicon: frozenset[str]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    share: float

    def scored(self, df: DataFrame, text: str = "text") -> DataFrame:
        """``df`` with all its columns, and toxicity_score from 0 to 1."""
        if self.trees is None:
            return df.withColumn("toxicity_score", F.lit(self.share))
        keep = [f"_keep_{k}" for k in range(len(df.columns))]
        plain = df.toDF(*keep)
        body = text_bytes(keep[df.columns.index(text)])
        marked = _margin(self.trees, assembled(plain.withColumn("_features", feature_udf(self.lexicon)(body)), TOXIC_FEATURES))
        out = self.calibration.transform(marked)
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("_calibrated")))
        return out.select(*[F.col(k).alias(n) for k, n in zip(keep, df.columns, strict=True)], score.alias("toxicity_score"))


def _margin(trees: GBTClassificationModel, df: DataFrame) -> DataFrame:
    # The last digits of the margin hold no information; without them ties of the calibration don't depend on rounding.
    return trees.transform(df).withColumn("_margin", F.round(vector_to_array(F.col("_raw"))[1], 6))


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, lexicon_size: int = LEXICON) -> ToxicityModel:
    sample = cut(labelled_sample(docs, labels, "toxic", limit))
    counts = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    n, ones = sum(counts.values()), sum(c for y, c in counts.items() if y > 0)
    if not ones or ones == n:
        return ToxicityModel(frozenset(), None, None, ones / n if n else 0.0)
    part = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(4))
    lexicon = learn_lexicon(sample, lexicon_size)
    # A training text's features come from a lexicon that hasn't seen it, so that chance terms look as weak as they are.
    half = F.pmod(F.xxhash64("doc_id", F.lit(SEED + 1)), F.lit(2))
    halves = [(sample.filter(half == k), learn_lexicon(sample.filter(half != k), lexicon_size) or lexicon) for k in (0, 1)]
    featured = [rows.withColumn("_features", feature_udf(words)("body")) for rows, words in halves]
    label = (F.col("label") > 0).cast("double").alias("label")
    rows = cut(assembled(featured[0].unionByName(featured[1]), TOXIC_FEATURES).select("doc_id", label, "_vector"))
    first, rest = rows.filter(part != 0), rows.filter(part == 0)
    if first.select("label").distinct().count() < 2:
        first = rows
    boosted = GBTClassifier(featuresCol="_vector", labelCol="label", predictionCol="_guess", maxIter=TREES, maxDepth=DEPTH, stepSize=STEP_SIZE, seed=SEED, maxBins=64)
    trees = boosted.setRawPredictionCol("_raw").setProbabilityCol("_probability").fit(first.coalesce(4))
    marked = _margin(trees, rest if rest.select("label").distinct().count() == 2 else rows)
    calibration = IsotonicRegression(featuresCol="_margin", labelCol="label", predictionCol="_calibrated").fit(marked.select("_margin", "label").coalesce(1))
    return ToxicityModel(lexicon, trees, calibration, ones / n)
