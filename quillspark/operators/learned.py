"""An edge classifier that is learned: multinomial logistic regression over features, with an indicator for each that may be missing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Strength of the L2 penalty on standardised weights, most rounds of the fit, and when it ends.
PENALTY, ROUNDS, TOLERANCE = 0.01, 200, 1e-9
#: Probabilities of the label from which on its tier is high, or medium.
HIGH, MEDIUM = 0.9, 0.6


def is_held_out(*keys: str, share: int = 5) -> Column:
    """Whether a row is one of those that no classifier learns from, one in `share`, by its keys alone."""
    return F.crc32(F.encode(F.concat_ws("|", *keys), "UTF-8")) % share == 0


def _quoted(name: str) -> str:
    return f"`{name}`"


@dataclass(frozen=True)
class LearnedClassifier:
    """An EdgeClassifier that is fitted, saved and loaded as one pyspark.ml pipeline."""

    model: PipelineModel

    @staticmethod
    def fit(rows: DataFrame, features: list[str], label: str = "label", penalty: float = PENALTY) -> LearnedClassifier:
        """Learns from the rows whose label isn't null. A null or non-finite feature is 0 with an indicator of 1; labels go by name."""
        lost = lambda c: f"({c} IS NULL OR isnan(cast({c} AS double)) OR abs(cast({c} AS double)) = double('inf'))"
        cells = [f"CASE WHEN {lost(_quoted(f))} THEN 0D ELSE cast({_quoted(f)} AS double) END AS `__v_{f}`, CASE WHEN {lost(_quoted(f))} THEN 1D ELSE 0D END AS `__m_{f}`" for f in features]
        names = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(rows.where(F.col(label).isNotNull()).select(label))
        stages = [
            SQLTransformer(statement=f"SELECT *, {', '.join(cells)} FROM __THIS__"),
            VectorAssembler(inputCols=[f"__{k}_{f}" for k in "vm" for f in features], outputCol="__x"),
            LogisticRegression(featuresCol="__x", labelCol="__y", family="multinomial", regParam=penalty, elasticNetParam=0.0, maxIter=ROUNDS, tol=TOLERANCE, predictionCol="__p", probabilityCol="__ps", rawPredictionCol="__raw"),
            IndexToString(inputCol="__p", outputCol="__label", labels=names.labels),
        ]
        known = names.transform(rows.where(F.col(label).isNotNull()).select(label, *features)).drop(label)
        return LearnedClassifier(Pipeline(stages=stages).fit(known))

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> LearnedClassifier:
        return LearnedClassifier(PipelineModel.load(path))

    @property
    def labels(self) -> list[str]:
        return self.model.stages[3].getLabels()

    def __call__(self, rows: DataFrame) -> DataFrame:
        """rows with label, tier, decision_path and probability, which replace columns of their names; a row for each row."""
        own = [c for c in rows.columns if c not in ("label", "tier", "decision_path", "probability")]
        p = F.array_max(vector_to_array("__ps"))
        out = self.model.transform(rows)
        tier = F.when(p >= HIGH, "high").when(p >= MEDIUM, "medium").otherwise("low")
        path = F.array(F.struct(F.lit("learned").alias("rule"), F.lit(True).alias("fired")))
        return out.select(*own, F.col("__label").alias("label"), tier.alias("tier"), path.alias("decision_path"), p.alias("probability"))

    def weights(self, spark: SparkSession) -> DataFrame:
        """(label, feature, missing, weight) of the fit; the intercept has a null feature. As many rows as labels times weights."""
        lr, names = self.model.stages[2], [c[2:] for c in self.model.stages[1].getInputCols()]
        rows = [(y, None, None, float(b)) for y, b in zip(self.labels, lr.interceptVector, strict=False)]
        rows += [(y, n[2:], n[0] == "m", float(w)) for y, line in zip(self.labels, lr.coefficientMatrix.toArray(), strict=False) for n, w in zip(names, line, strict=True)]
        return spark.createDataFrame(rows, "label string, feature string, missing boolean, weight double")


def confusion(rows: DataFrame, classifier: LearnedClassifier, label: str = "label") -> DataFrame:
    """(held_out, label, predicted, edges) of rows with boolean held_out and the true label."""
    said = classifier(rows.withColumn("__true", F.col(label)))
    return said.groupBy("held_out", F.col("__true").alias("label"), F.col("label").alias("predicted")).agg(F.count(F.lit(1)).alias("edges"))
