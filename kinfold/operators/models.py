"""Splits, training sets and learned models (pyspark.ml)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.windows import ranks

SHARES = (("A", 0.8), ("B", 0.1), ("C1", 0.08), ("C2", 0.02))


def assign_splits(s1: DataFrame, seed: int = 0) -> DataFrame:
    """s1, country, grp: shares of each country, in an order by md5."""
    marked = s1.select("s1", "country", F.md5(F.concat_ws("|", F.lit(str(seed)), "s1")).alias("_mark"))
    at = (F.col("_rank") - 1) / F.col("_n")
    grp, edge = F.lit(SHARES[-1][0]), 1.0
    for name, share in reversed(SHARES[:-1]):
        edge -= dict(SHARES)[{"A": "B", "B": "C1", "C1": "C2"}[name]]
        grp = F.when(at < round(edge, 6), name).otherwise(grp)
    return ranks(marked, ["country"], "_mark", "s1").select("s1", "country", grp.alias("grp"))


def record_groups(records: DataFrame, truth: DataFrame, splits: DataFrame) -> DataFrame:
    """rec, s1, grp: a record is in its S1's group; one without an S1 is in X."""
    rec = records.where("src > 1").select(F.col("entity_id").alias("rec"))
    return rec.join(truth, "rec", "left").join(splits.select("s1", "grp"), "s1", "left").select("rec", "s1", F.coalesce("grp", F.lit("X")).alias("grp"))


def labels(pairs: DataFrame, truth: DataFrame, splits: DataFrame) -> DataFrame:
    """pairs with y and the S1's grp."""
    y = truth.select("s1", "rec", F.lit(1).alias("y"))
    return pairs.drop("y").join(y, ["s1", "rec"], "left").na.fill(0, ["y"]).join(splits.select("s1", "grp"), "s1")


def hard_negatives(edges: DataFrame, truth: DataFrame, splits: DataFrame, groups: DataFrame, n: int = 3) -> DataFrame:
    """s1, hns: an S1 of A and its n nearest records of A or X that aren't its own."""
    from kinfold.operators.relational import top_list

    free = edges.where("rf is not null").join(truth, ["s1", "rec"], "left_anti").join(splits.where("grp = 'A'").select("s1"), "s1", "left_semi").join(groups.where("grp in ('A', 'X')").select("rec"), "rec", "left_semi")
    return top_list(free, "s1", "rec", F.desc("cos"), n, "hns")


def batch_plan(pairs: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """s1, rec, country, turn, batch: batches of one country in which an S1 comes once; those under a quarter full are dropped."""
    marked = pairs.withColumn("_mark", F.md5(F.concat_ws("|", F.lit(str(seed)), "s1", "rec")))
    dealt = marked.withColumn("turn", F.row_number().over(Window.partitionBy("s1").orderBy("_mark", "rec")))
    place = F.col("_rank") - 1
    batch = F.floor(place / size).cast("int")
    # only a country's last batch of a turn isn't full
    full = F.least(F.lit(size), F.col("_n") - batch * size)
    return ranks(dealt, ["country", "turn"], "_mark", "s1", "rec").where(full >= size / 4).select("s1", "rec", "country", "turn", batch.alias("batch"))


def cross_training_set(pairs: DataFrame, truth: DataFrame, splits: DataFrame, groups: DataFrame, n: int, positives: float = 0.4, seed: int = 0) -> DataFrame:
    """s1, rec, y: pairs of A whose records are in A or X, a share of them positive."""
    from kinfold.operators.relational import sample

    own = labels(pairs.select("s1", "rec"), truth, splits).where("grp = 'A'").drop("grp").join(groups.where("grp in ('A', 'X')").select("rec"), "rec", "left_semi").select("s1", "rec", "y")
    return sample(own.where("y = 1"), int(n * positives), seed, "s1", "rec").union(sample(own.where("y = 0"), n - int(n * positives), seed, "s1", "rec"))


def assemble(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Doubles with an indicator for each that may be missing; MLlib's trees take no NaN."""
    typed = df.withColumns({f: F.col(f).cast("double") for f in features} | {f"{f}_missing": F.col(f).isNull().cast("double") for f in features})
    return typed, [*features, *[f"{f}_missing" for f in features]]


def fit_gbt(df: DataFrame, features: list[str], rounds: int = 20, depth: int = 5, seed: int = 0) -> PipelineModel:
    typed, columns = assemble(df, features)
    filled = [f"{f}_filled" for f in features]
    stages = [Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=[*filled, *columns[len(features) :]], outputCol="features"), GBTClassifier(labelCol="y", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed)]
    return Pipeline(stages=stages).fit(typed)


def predict(model: PipelineModel, df: DataFrame, features: list[str], name: str = "p") -> DataFrame:
    typed, _ = assemble(df, features)
    out = model.transform(typed).withColumn("_p", vector_to_array("probability")[1])
    return out.select(*df.columns, F.col("_p").alias(name))


def importance(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    names = [*features, *[f"{f}_missing" for f in features]]
    return sorted(zip(names, model.stages[-1].featureImportances.toArray().tolist(), strict=True), key=lambda x: -x[1])


def fold_of(k: int):
    return F.pmod(F.xxhash64("s1"), F.lit(k)).cast("int")


def fit_stacker(train: DataFrame, features: list[str], k: int = 4, **options) -> list[PipelineModel]:
    """A model for each fold of S1s, fitted on the others."""
    train = train.withColumn("fold", fold_of(k)).persist()
    models = [fit_gbt(train.where(F.col("fold") != i), features, **options) for i in range(k)]
    train.unpersist()
    return models


def predict_stacker(models: list[PipelineModel], df: DataFrame, features: list[str], own: str = "grp = 'B'") -> DataFrame:
    """Out-of-fold probabilities within the training group, averages over the folds elsewhere."""
    out = df.withColumn("fold", fold_of(len(models)))
    for i, m in enumerate(models):
        out = predict(m, out, features, f"_p{i}")
    each = [F.col(f"_p{i}") for i in range(len(models))]
    p = F.when(F.expr(own), F.get(F.array(*each), F.col("fold"))).otherwise(sum(each[1:], each[0]) / len(models))
    return out.select(*df.columns, p.alias("p"))


def save_models(models: list[PipelineModel], path: str) -> None:
    """The models of all folds, in a folder that Spark writes."""
    for i, m in enumerate(models):
        m.write().overwrite().save(f"{path}/fold={i}")


def load_models(path: str, k: int) -> list[PipelineModel]:
    return [PipelineModel.load(f"{path}/fold={i}") for i in range(k)]


class PairScorer:
    """An offline stand-in for a learned pair encoder: a logistic regression on interaction features."""

    def __init__(self, features: list[str]):
        self.features, self.model = features, None

    def fit(self, train: DataFrame) -> PairScorer:
        typed, columns = assemble(train, self.features)
        filled = [f"{f}_filled" for f in self.features]
        self.model = Pipeline(stages=[Imputer(inputCols=self.features, outputCols=filled), VectorAssembler(inputCols=[*filled, *columns[len(self.features) :]], outputCol="features"), LogisticRegression(labelCol="y", maxIter=50, regParam=1e-3)]).fit(typed)
        return self

    def transform(self, pairs: DataFrame, name: str = "score") -> DataFrame:
        return predict(self.model, pairs, self.features, name)


def calibrate(holdout: DataFrame, score: str = "p"):
    """An isotonic map of the score, fitted on holdout pairs with y."""
    data = VectorAssembler(inputCols=[score], outputCol="features").transform(holdout.withColumn("y", F.col("y").cast("double")))
    return IsotonicRegression(labelCol="y").fit(data)


def calibrated(model, pairs: DataFrame, score: str = "p", name: str = "q") -> DataFrame:
    out = VectorAssembler(inputCols=[score], outputCol="features").transform(pairs)
    return model.transform(out).select(*pairs.columns, F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)).alias(name))


def transfer(feat: DataFrame, features: list[str], source: str, target: str, truth: DataFrame, s1: DataFrame, threshold: float = 0.6, rounds: int = 20) -> DataFrame:
    """Macro F0.5 in one country of a model trained on another."""
    from kinfold.operators.evaluate import per_entity, score
    from kinfold.operators.selection import one_to_one

    model = fit_gbt(feat.where(F.col("country") == source), features, rounds)
    pred = predict(model, feat.where(F.col("country") == target).drop("p"), features)
    own = s1.where(F.col("country") == target)
    chosen = one_to_one(pred).where(F.col("p") >= threshold)
    return score(per_entity(chosen, truth.join(own, "s1", "left_semi"), own)).where("country is not null")
