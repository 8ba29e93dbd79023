"""Boosted-tree scoring models, gate for mixtures, fold evaluation, bundles."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.schema import context_columns
from ..functions.storage import materialise, shared_dir
from . import signals as sg

# Score column of each target.
SCORES = {
    "target_long": "pred_long",
    "target_short": "pred_short",
    "target_dir_long": "pred_dir_long",
    "target_dir_short": "pred_dir_short",
}


@dataclass(frozen=True)
class ModelParams:
    """Defaults are fixed values of the model configuration."""

    trees: int = 1500
    learning_rate: float = 0.05
    depth: int = 5
    min_rows: int = 20
    subsample: float = 0.7
    columns: float = 0.2
    seed: int = 42


@dataclass
class ScoreModels:
    """One fitted pipeline per target, the inputs they share and their scaler table."""

    features: list[str]
    models: dict[str, PipelineModel]
    scaler: DataFrame | None = None

    @property
    def context(self) -> list[str]:
        return context_columns(self.features)


def with_weights(df: DataFrame, target: str) -> DataFrame:
    """Positive rows weigh negatives/positives of the training rows."""
    train = df.filter(~F.col("held_out")) if "held_out" in df.columns else df
    c = train.agg(
        F.sum(F.when(F.col(target) == 1, 1).otherwise(0)).alias("p"), F.count(F.lit(1)).alias("n")
    ).first()
    up = (c["n"] - c["p"]) / c["p"] if c["p"] else 1.0
    return df.withColumn("weight", F.when(F.col(target) == 1, float(up)).otherwise(1.0))


def fit_one(df: DataFrame, features: Sequence[str], target: str, params: ModelParams) -> PipelineModel:
    """Boosted trees on ``split = train``, stopped early on ``split = val``.

    Without a ``split`` column every row trains.
    """
    shared_dir(df.sparkSession)
    rows = df.withColumn("label", F.col(target).cast("double"))
    trees = GBTClassifier(
        featuresCol="inputs", labelCol="label", weightCol="weight", maxIter=params.trees,
        maxDepth=params.depth, stepSize=params.learning_rate, subsamplingRate=params.subsample,
        featureSubsetStrategy=str(params.columns), minInstancesPerNode=params.min_rows,
        checkpointInterval=10, seed=params.seed,
    )
    if "split" in df.columns:
        rows = rows.filter(F.col("split").isin("train", "val")).withColumn(
            "held_out", F.col("split") == "val"
        )
        trees = trees.setValidationIndicatorCol("held_out")
    assembler = VectorAssembler(inputCols=list(features), outputCol="inputs", handleInvalid="error")
    return Pipeline(stages=[assembler, trees]).fit(with_weights(rows, target))


def fit_scores(
    df: DataFrame, features: Sequence[str], params: ModelParams = ModelParams(), direction_share: float = 0.5
) -> ScoreModels:
    """The four score models; ``close`` is never an input.

    Direction models get ``direction_share`` of the trees.
    """
    inputs = [f for f in features if f != "close"]
    keep = [*inputs, *SCORES, *(["split"] if "split" in df.columns else [])]
    rows = materialise(df.select(*keep), "train")
    models = {}
    for target in SCORES:
        share = direction_share if "_dir_" in target else 1.0
        p = replace(params, trees=max(1, int(params.trees * share)))
        models[target] = fit_one(rows, inputs, target, p)
    return ScoreModels(list(features), models)


def _positive(df: DataFrame, model: PipelineModel, out: str) -> DataFrame:
    scored = model.transform(df).withColumn(out, vector_to_array("probability")[1])
    return scored.drop("inputs", "context", "rawPrediction", "probability", "prediction")


def score(df: DataFrame, bundle: ScoreModels) -> DataFrame:
    """Score columns of all models, in one pass over the rows."""
    for target, out in SCORES.items():
        if target in bundle.models:
            df = _positive(df, bundle.models[target], out)
        else:
            df = df.withColumn(out, F.lit(1.0))
    return df


def importances(bundle: ScoreModels, target: str = "target_long") -> DataFrame:
    """Feature importance, highest first, named by the assembler's inputs."""
    model = bundle.models[target]
    names = model.stages[0].getInputCols()
    gains = model.stages[-1].featureImportances.toArray()
    spark = SparkSession.getActiveSession()
    rows = [(n, float(g)) for n, g in zip(names, gains)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def fit_gate(df: DataFrame, context: Sequence[str], primary: str, second: str, target: str) -> PipelineModel:
    """Weight of the primary score from context: how likely it is the closer one."""
    y = F.col(target).cast("double")
    closer = F.abs(F.col(primary) - y) <= F.abs(F.col(second) - y)
    rows = df.withColumn("label", closer.cast("double"))
    steps = [
        VectorAssembler(inputCols=list(context), outputCol="context", handleInvalid="error"),
        LogisticRegression(featuresCol="context", labelCol="label", regParam=0.01),
    ]
    return Pipeline(stages=steps).fit(rows)


def apply_gate(df: DataFrame, gate: PipelineModel) -> DataFrame:
    return _positive(df, gate, "gate")


def evaluate_folds(
    folds: DataFrame,
    bars: DataFrame,
    features: Sequence[str],
    params: ModelParams,
    strategy: sg.Strategy,
) -> DataFrame:
    """Statistics of out-of-fold signals, one row per fold.

    ``folds``: labelled feature rows with ``fold`` and ``role`` from the purged
    split.  Fitting loops over the few folds; the work of each runs on Spark.
    """
    rows = materialise(folds, "folds")
    numbers = [r["fold"] for r in rows.select("fold").distinct().orderBy("fold").collect()]
    runs = None
    for k in numbers:
        part = rows.filter(F.col("fold") == k)
        bundle = fit_scores(part.filter(F.col("role") == "train"), features, params)
        scored = score(part.filter(F.col("role") == "test"), bundle)
        ledger = sg.outcomes(bars, sg.signals(scored, [strategy]), strategy.reach)
        ledger = ledger.withColumn("fold", F.lit(k))
        runs = ledger if runs is None else runs.unionByName(ledger)
    keys = ["set_id", "fold"]
    stats = sg.trade_stats(sg.equity_curve(materialise(runs, "fold-ledger"), keys), keys)
    every = rows.select(F.lit(0).alias("set_id"), "fold").distinct()
    return sg.complete_stats(stats, every, keys).withColumn(
        "score", sg.fold_score(F.col("trades"), F.col("sortino"), F.col("max_drawdown"))
    )


def save_bundle(bundle: ScoreModels, path: str) -> None:
    """Models, the ordered feature list and the scaler under one folder."""
    if bundle.scaler is not None:
        bundle.scaler.write.mode("overwrite").parquet(f"{path}/scaler")
    for target, model in bundle.models.items():
        model.write().overwrite().save(f"{path}/{target}")
    spark = SparkSession.getActiveSession()
    rows = [(i, f) for i, f in enumerate(bundle.features)]
    scaled = bundle.scaler is not None
    names = spark.createDataFrame(rows, "pos int, feature string").withColumn("scaled", F.lit(scaled))
    names.coalesce(1).write.mode("overwrite").json(f"{path}/features")


def load_bundle(spark: SparkSession, path: str, targets: Sequence[str] = tuple(SCORES)) -> ScoreModels:
    schema = "pos int, feature string, scaled boolean"
    names = spark.read.schema(schema).json(f"{path}/features").orderBy("pos").collect()
    scaler = spark.read.parquet(f"{path}/scaler") if names and names[0]["scaled"] else None
    models = {t: PipelineModel.load(f"{path}/{t}") for t in targets}
    return ScoreModels([r["feature"] for r in names], models, scaler)


def sequence_step(position: int, seed: int) -> tuple[float, float]:
    """Step and start of the additive sequence of one parameter, in [0, 1)."""
    primes = [p for p in range(2, 400) if all(p % d for d in range(2, int(p**0.5) + 1))]
    return math.sqrt(primes[position]) % 1.0, math.sqrt(primes[position] * (seed + 1)) % 1.0


def sweep_values(spark: SparkSession, n: int, ranges: dict[str, tuple[float, float, str]], seed: int = 42) -> DataFrame:
    """``n`` parameter rows drawn from ranges: ``lin``, ``log`` or ``int`` scale.

    Each parameter follows an additive sequence with an irrational step, which covers its
    range evenly at any ``n``.  Values depend on row number and seed only, so a sweep can
    be repeated and extended.
    """
    cols = [F.col("id").cast("int").alias("set_id")]
    for position, (name, (lo, hi, scale)) in enumerate(ranges.items()):
        step, start = sequence_step(position, seed)
        u = (F.lit(start) + F.col("id") * F.lit(step)) % 1.0
        if scale == "log":
            low, high = math.log(lo), math.log(hi)
            value = F.exp(F.lit(low) + u * (high - low))
        elif scale == "int":
            value = F.floor(F.lit(lo) + u * (hi - lo + 1)).cast("int")
        else:
            value = F.lit(float(lo)) + u * (hi - lo)
        cols.append(value.alias(name))
    return spark.range(n).select(*cols)


#: Names of the search and of the strategy's fields.
STRATEGY_NAMES = {
    "limit_offset_atr": "offset",
    "take_profit_atr": "take_profit",
    "stop_loss_atr": "stop_loss",
    "model_threshold": "threshold",
    "direction_threshold": "direction",
    "aggressive_threshold": "aggressive",
}


# Ranges of the parameter search.
SEARCH_RANGES = {
    "limit_offset_atr": (0.5, 2.0, "lin"),
    "take_profit_atr": (1.0, 3.0, "lin"),
    "stop_loss_atr": (1.0, 2.5, "lin"),
    "learning_rate": (0.005, 0.05, "log"),
    "max_depth": (3, 6, "int"),
    "num_leaves": (8, 64, "int"),
    "model_threshold": (0.70, 0.95, "lin"),
    "direction_threshold": (0.35, 0.65, "lin"),
    "aggressive_threshold": (0.75, 0.98, "lin"),
}
