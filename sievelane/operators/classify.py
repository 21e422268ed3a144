"""Trained classifiers on vectors."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .metrics import summary
from .split import split_dataset


@dataclass
class Bundle:
    """A model with what is needed to refuse wrong use of it."""

    classifier: str
    key: str
    label: str
    vec: str
    classes: list[str]
    extras: list[str] = field(default_factory=list)
    mean: list[float] = field(default_factory=list)
    std: list[float] = field(default_factory=list)
    backend: str = "embedding"
    model: PipelineModel | None = None

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        meta = {k: v for k, v in asdict(self).items() if k != "model"}
        SparkSession.getActiveSession().createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    @staticmethod
    def load(spark, path: str, **expected) -> "Bundle":
        """Refuses a bundle that differs in any of the named fields."""
        meta = json.loads(spark.read.text(f"{path}/meta").first().value)
        for k, v in expected.items():
            if meta.get(k) != v:
                raise ValueError(f"{k}: bundle has {meta.get(k)!r}, {v!r} was asked for")
        return Bundle(**meta, model=PipelineModel.load(f"{path}/model"))


def extras_gate(df: DataFrame, extras: list[str]) -> None:
    """Refuses extra columns with values that aren't numbers."""
    bad = df.agg(*[F.count(F.when(F.expr(f"try_cast(`{c}` as double)").isNull(), 1)).alias(c) for c in extras]).first()
    for c in extras:
        if bad[c]:
            raise ValueError(f"{bad[c]} rows of {c} aren't numeric")


def standardize_stats(df: DataFrame, extras: list[str]) -> tuple[list[float], list[float]]:
    """Means and population deviations; a constant column gets deviation 1."""
    if not extras:
        return [], []
    r = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(extras)], *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(extras)]).first()
    return [r[f"m{i}"] for i in range(len(extras))], [r[f"s{i}"] or 1.0 for i in range(len(extras))]


def _features(df: DataFrame, vec: str, extras: list[str], mean: list[float], std: list[float]) -> DataFrame:
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    for c, m, s in zip(extras, mean, std):
        v = F.concat(v, F.array((F.col(c).cast("double") - m) / s))
    return df.withColumn("features", array_to_vector(v))


def train_classifier(df: DataFrame, key: str, label: str = "label", vec: str = "embedding", extras: list[str] | None = None, classifier: str | None = None, c: float = 1.0, seed: int = 42, trees: int = 300, depth: int = 6) -> tuple[Bundle, dict]:
    """Fits on 80 %, scores the stratified rest, then fits again on all rows. Logistic regression,
    or boosted trees (one against the rest) if there are extra columns."""
    extras = extras or []
    kind = classifier or ("gbt" if extras else "logreg")
    if extras:
        extras_gate(df, extras)
    per = df.groupBy(label).count().agg(F.count("*").alias("k"), F.sum("count").alias("n"), F.min("count").alias("least")).first()
    if per.k < 2 or per.n < 5 * per.k:
        raise ValueError(f"{per.k} classes in {per.n} rows: at least 2 classes and 5 rows for each on average are needed")
    mean, std = standardize_stats(df, extras)
    rows = _features(df.filter(F.col(label).isNotNull()).withColumn("_label", F.col(label).cast("string")), vec, extras, mean, std)
    parts = split_dataset(rows, key, "_label", (0.8, 0.0, 0.2), seed)

    def fit(train: DataFrame, n: int) -> PipelineModel:
        index = StringIndexer(inputCol="_label", outputCol="_y", stringOrderType="alphabetAsc").fit(train)
        base = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed) if kind == "gbt" else None
        model = OneVsRest(classifier=base, labelCol="_y", featuresCol="features", predictionCol="_p") if base else LogisticRegression(labelCol="_y", featuresCol="features", predictionCol="_p", maxIter=2000, regParam=1.0 / (c * max(n, 1)), standardization=False)
        return Pipeline(stages=[index, model, IndexToString(inputCol="_p", outputCol="predicted", labels=index.labels)]).fit(train)

    held = fit(parts.filter("split = 'train'"), int(per.n * 0.8)).transform(parts.filter("split = 'test'"))
    report = summary(held, "_label", "predicted").first().asDict()
    final = fit(rows, per.n)
    return Bundle(kind, key, label, vec, list(final.stages[0].labels), extras, mean, std, model=final), report


def predict(bundle: Bundle, df: DataFrame) -> DataFrame:
    """key, predicted, confidence (probability of the best class less that of the second; null
    for trees, which give none)."""
    out = bundle.model.transform(_features(df.withColumn("_label", F.lit(bundle.classes[0])), bundle.vec, bundle.extras, bundle.mean, bundle.std))
    if "probability" in out.columns:
        p = F.reverse(F.array_sort(vector_to_array("probability")))
        conf = F.get(p, F.lit(0)) - F.coalesce(F.get(p, F.lit(1)), F.lit(0.0))
    else:
        conf = F.lit(None).cast("double")
    return out.select(bundle.key, "predicted", conf.alias("confidence"))
