"""Standardisation, class weights, training and batch scoring."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lobwright.functions.scalars import KEYS, no_nan
from lobwright.operators.labels import LABELS
from lobwright.operators.quantiles import group_quantiles
from lobwright.sources.stages import checkpoint_root, cut, per_key

# The features the forecasting models read.
MODEL_FEATURES = (
    "rel_spread", "microprice_deviation", "depth_imbalance_1", "depth_imbalance_5", "depth_imbalance_10",
    "ofi_1", "ofi_5", "realized_vol_20", "realized_vol_100", "spread_z_1m", "depth_z_1m",
    "liquidity_drought_score", "adverse_selection_score", "momentum_score", "choppiness_score",
)
# A fixed linear model: feature -> weight per class, and the intercepts.
FIXED_WEIGHTS = {
    "momentum_score": (1.2, 0.0, -1.2),
    "depth_imbalance_10": (-1.5, 0.1, 1.5),
    "spread_z_1m": (0.1, 0.3, 0.1),
    "ofi_5": (-0.02, 0.0, 0.02),
}
FIXED_INTERCEPTS = (0.0, 0.2, 0.0)


def fit_standardizer(df: DataFrame, columns, split: str = "train", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Mean and sample deviation per column on one split; a deviation of 0 counts as 1."""
    aggs = []
    for c in columns:
        sd = F.stddev_samp(c)
        aggs += [F.avg(c).alias(f"{c}__mean"), F.when(F.coalesce(sd, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(sd).alias(f"{c}__std")]
    return per_key(df.filter(F.col("split") == split).groupBy(*keys).agg(*aggs))


def apply_standardizer(df: DataFrame, stats: DataFrame, columns, keys: tuple[str, ...] = KEYS) -> DataFrame:
    joined = df.join(stats, list(keys))
    scaled = {c: (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__std") for c in columns}
    return joined.withColumns(scaled).drop(*[c for c in stats.columns if c not in keys])


#: Fixed value: the least variance of a cell, so that a cell that never changes is divided by a small number, not by zero.
VARIANCE_FLOOR = 1e-12


def fit_vector_scaler(df: DataFrame, vector: Column, cells: int, split: str = "train", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Mean and population deviation of each cell of a vector on one split, as ``scaler`` (mean, std): two arrays per key.

    All cells are summed side by side in one aggregation of mergeable central moments, so partitions send one row per key and
    nothing cancels.  All rows of the split take part; cells that are missing do not.  A split without rows is an error.
    """
    rows = df.filter(F.col("split") == split).select(*keys, vector.alias("_v"))
    cell = [F.element_at("_v", i + 1).cast("double") for i in range(cells)]
    moments = rows.groupBy(*keys).agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cell)], *[F.var_pop(c).alias(f"_s{i}") for i, c in enumerate(cell)])
    std = [F.sqrt(F.greatest(F.coalesce(f"_s{i}", F.lit(0.0)), F.lit(VARIANCE_FLOOR))) for i in range(cells)]
    mean = [F.coalesce(f"_m{i}", F.lit(0.0)) for i in range(cells)]
    scaler = per_key(moments.select(*keys, F.struct(F.array(*mean).alias("mean"), F.array(*std).alias("std")).alias("scaler")))
    if scaler.isEmpty():
        raise ValueError(f"no rows in split {split!r} to fit a scaler on")
    return scaler


def class_weights(df: DataFrame, split: str = "train", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """n / (classes * max(count, 1)) for every class, seen or not."""
    counted = df.filter(F.col("split") == split).groupBy(*keys).agg(
        F.count("*").alias("_n"), *[F.count_if(F.col("label") == c).alias(f"_{c}") for c in LABELS]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"_{c}").alias("n_rows")) for c in LABELS])
    out = counted.select(*keys, "_n", F.explode(rows).alias("_r")).select(*keys, "_n", "_r.*")
    weight = F.col("_n") / (F.lit(float(len(LABELS))) * F.greatest(F.col("n_rows"), F.lit(1)))
    return out.withColumn("class_weight", weight).drop("_n")


def softmax_columns(logits: list[Column]) -> dict[str, Column]:
    top = F.greatest(*logits)
    parts = [F.exp(x - top) for x in logits]
    total = reduce(add, parts)
    return {f"prob_{c.lower()}": p / total for c, p in zip(LABELS, parts)}


def predicted_label() -> Column:
    """The most probable class; equal probabilities go to the first in label order."""
    d, f, u = (F.col(f"prob_{c.lower()}") for c in LABELS)
    return F.when((d >= f) & (d >= u), LABELS[0]).when(f >= u, LABELS[1]).otherwise(LABELS[2])


def score_linear(df: DataFrame, weights=None, intercepts=FIXED_INTERCEPTS) -> DataFrame:
    """Class probabilities of a linear model with given coefficients, inside generated code."""
    weights = weights or FIXED_WEIGHTS
    logits = [
        reduce(add, [F.lit(intercepts[k])] + [F.lit(w[k]) * F.coalesce(F.col(f), F.lit(0.0)) for f, w in weights.items()])
        for k in range(len(LABELS))
    ]
    return df.withColumns(softmax_columns(logits)).withColumn("pred_label", predicted_label())


def score_with(df: DataFrame, predict, columns, keep) -> DataFrame:
    """Scores with any Python model: ``predict(numpy matrix) -> (rows, 3)`` on Arrow batches.

    ``predict`` is shipped to the executors once per task; rows stay where they are.
    """
    from pyspark.sql import types as T

    columns, keep = list(columns), list(keep)
    probs = [f"prob_{c.lower()}" for c in LABELS]
    schema = T.StructType(
        [df.schema[c] for c in keep] + [T.StructField(p, T.DoubleType()) for p in probs]
    )

    def run(batches):
        for pdf in batches:
            out = pdf[keep].copy()
            p = predict(pdf[columns].fillna(0.0).to_numpy(dtype="float64"))
            for k, name in enumerate(probs):
                out[name] = p[:, k]
            yield out

    return df.select(*dict.fromkeys([*keep, *columns])).mapInPandas(run, schema).withColumn("pred_label", predicted_label())


def score_windows(df: DataFrame, predict, keep, window_col: str = "window") -> DataFrame:
    """Like ``score_with`` for sliding windows: ``predict`` gets a (rows, window, cells) array."""
    import numpy as np
    from pyspark.sql import types as T

    keep = list(keep)
    probs = [f"prob_{c.lower()}" for c in LABELS]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(p, T.DoubleType()) for p in probs])

    def run(batches):
        for pdf in batches:
            out = pdf[keep].copy()
            if len(pdf):
                cube = np.stack([np.stack([np.asarray(r, dtype="float32") for r in w]) for w in pdf[window_col]])
                p = predict(cube)
            else:
                p = np.zeros((0, len(probs)))
            for k, name in enumerate(probs):
                out[name] = p[:, k]
            yield out

    return df.select(*dict.fromkeys([*keep, window_col])).mapInPandas(run, schema).withColumn(
        "pred_label", predicted_label()
    )


def _assembled(df: DataFrame, features) -> DataFrame:
    filled = df.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features})
    return filled


def _feature_stages(features):
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    return [
        VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
    ]


def label_number() -> Column:
    return (F.array_position(F.array(*[F.lit(c) for c in LABELS]), F.col("label")) - 1).cast("double")


def fit_medians(df: DataFrame, features=MODEL_FEATURES, split: str = "train") -> dict[str, float]:
    """The exact median of each feature over a split, of the values that are there; 0 for a feature without any."""
    rows = df.filter(F.col("split") == split).select(F.lit(1).alias("_all"), *[no_nan(F.col(c).cast("double")).alias(c) for c in features])
    got = group_quantiles(rows, ["_all"], {c: (F.col(c), 0.5) for c in features}).first()
    return {c: 0.0 if got is None or got[c] is None else got[c] for c in features}


def imputer(medians: dict[str, float]):
    """A pipeline stage that puts the training medians where a feature is missing, NaN or infinite; it is part of the fitted model."""
    from pyspark.ml.feature import SQLTransformer

    def cell(c: str, median: float) -> str:
        value = f"double(`{c}`)"
        return f"if(abs(nanvl({value}, double('Infinity'))) < double('Infinity'), {value}, double('{median!r}')) as `_f_{c}`"

    return SQLTransformer(statement=f"select *, {', '.join(cell(*m) for m in medians.items())} from __THIS__")


def label_counts(df: DataFrame, split: str = "train") -> dict[str, int]:
    """Rows of each class in a split; a split without a labelled row is an error."""
    counts = {r["label"]: r["count"] for r in df.filter((F.col("split") == split) & F.col("label").isin(*LABELS)).groupBy("label").count().collect()}
    if not counts:
        raise ValueError(f"no labelled rows in split {split!r} to train on")
    return counts


def balanced_weights(counts: dict[str, int]) -> dict[str, float]:
    """Rows over classes times the rows of a class, as if a class that isn't there had one."""
    return {c: sum(counts.values()) / (len(LABELS) * max(counts.get(c, 0), 1)) for c in LABELS}


def _single_class(df: DataFrame, label: str, medians: dict[str, float]):
    """A model that gives every row the one class there is to learn from."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer

    sure = ", ".join("1D" if c == label else "0D" for c in LABELS)
    return Pipeline(stages=[imputer(medians), SQLTransformer(statement=f"select *, array({sure}) as probability from __THIS__")]).fit(df)


def train_linear(df: DataFrame, features=MODEL_FEATURES, split: str = "train", max_iter: int = 20, reg: float = 1e-4):
    """Balanced multinomial regression on one split.  ``df`` holds one market or many; the model sees them as one.

    Missing features take the median of the split.  A split of one class gives a model that always answers with it.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression

    counts, medians = label_counts(df, split), fit_medians(df, features, split)
    if len(counts) == 1:
        return _single_class(df, *counts, medians)
    train = df.filter((F.col("split") == split) & F.col("label").isin(*LABELS)).withColumn("_y", label_number())
    weight = F.lit(1.0)
    for c, w in balanced_weights(counts).items():
        weight = F.when(F.col("label") == c, w).otherwise(weight)
    lr = LogisticRegression(
        featuresCol="features", labelCol="_y", weightCol="_w", family="multinomial", maxIter=max_iter, regParam=reg
    )
    return Pipeline(stages=[imputer(medians), *_feature_stages(features), lr]).fit(train.withColumn("_w", weight))


def train_trees(df: DataFrame, features=MODEL_FEATURES, split: str = "train", trees: int = 20, depth: int = 5, seed: int = 7):
    """Tree ensemble over the three classes; missing features and a split of one class as in ``train_linear``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier

    counts, medians = label_counts(df, split), fit_medians(df, features, split)
    if len(counts) == 1:
        return _single_class(df, *counts, medians)
    train = df.filter((F.col("split") == split) & F.col("label").isin(*LABELS)).withColumn("_y", label_number())
    rf = RandomForestClassifier(featuresCol="features", labelCol="_y", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[imputer(medians), *_feature_stages(features), rf]).fit(train)


def train_boosted(df: DataFrame, features=MODEL_FEATURES, split: str = "train", rounds: int = 150, depth: int = 5,
                  step: float = 0.05, seed: int = 7):
    """Gradient-boosted trees, one against the rest for each class.

    The classes train side by side: a round is some short jobs after each other, which leave cores idle.  The residuals of a round
    follow from those of the round before, so their lineage is cut by checkpoints.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier

    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_root(df.sparkSession))
    train = _assembled(df.filter(F.col("split") == split), features)
    prep = Pipeline(stages=_feature_stages(features)).fit(train)
    ready = prep.transform(train)

    def fit(c: str):
        gbt = GBTClassifier(featuresCol="features", labelCol="_y", maxIter=rounds, maxDepth=depth, stepSize=step,
                            subsamplingRate=0.9, seed=seed, predictionCol=f"_q_{c}")
        gbt.setProbabilityCol(f"_p_{c}").setRawPredictionCol(f"_r_{c}")
        return gbt.fit(ready.withColumn("_y", (F.col("label") == c).cast("double")))

    with ThreadPoolExecutor(len(LABELS)) as pool:
        return prep, list(pool.map(inheritable_thread_target(df.sparkSession)(fit), LABELS))


def score_boosted(df: DataFrame, trained, features=MODEL_FEATURES) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    prep, models = trained
    out = prep.transform(_assembled(df, features))
    for m in models:
        out = m.transform(out)
    # Once a row: what reads the partition's number is not put into the filters and columns above it, where all trees would run again.
    out = out.withColumn("_p_all", F.when(F.spark_partition_id() >= 0, F.array(*[vector_to_array(F.col(f"_p_{c}"))[1] for c in LABELS])))
    raw = [F.col("_p_all")[k] for k in range(len(LABELS))]
    total = reduce(add, raw)
    out = out.withColumns({f"prob_{c.lower()}": F.coalesce(F.try_divide(r, total), F.lit(1 / 3)) for c, r in zip(LABELS, raw)})
    out = out.withColumn("pred_label", predicted_label())
    return out.drop(*[c for c in out.columns if c.startswith(("_f_", "_p_", "_r_", "_q_"))], "_raw", "features")


def _standardised(features) -> Column:
    """The row's features against ``_mean`` and ``_std``, a missing one or NaN as the mean, and 1 for the intercept."""
    there = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    cells = [F.coalesce((there(c) - F.col("_mean")[j]) / F.col("_std")[j], F.lit(0.0)) for j, c in enumerate(features)]
    return F.array(*cells, F.lit(1.0))


def _grouped_softmax(weights: Column, cells: Column, size: int) -> list[Column]:
    logits = [reduce(add, [weights[c * size + j] * cells[j] for j in range(size)]) for c in range(len(LABELS))]
    return list(softmax_columns(logits).values())


def train_grouped(
    df: DataFrame, features=MODEL_FEATURES, split: str = "train", steps: int = 20, rate: float = 0.125, reg: float = 1e-4,
    keys: tuple[str, ...] = KEYS,
) -> DataFrame:
    """A balanced multinomial model per key, all keys at once: (keys, ``_mean``, ``_std``, ``_weights``).

    Accelerated gradient steps of a fixed number: each is one aggregation of all gradients of all keys over the training rows,
    joined with a table of one row per key.  On standardised features the loss bends by at most half the number of inputs,
    so the default rate, 1/8 for 16 of them, never overshoots.  A key with one class learns to predict that class.
    """
    size, k = len(features) + 1, len(LABELS)
    df = df.withColumns({c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features})
    stats = fit_standardizer(df, features, split, keys).select(
        *keys, F.array(*[F.coalesce(f"{c}__mean", F.lit(0.0)) for c in features]).alias("_mean"), F.array(*[F.col(f"{c}__std") for c in features]).alias("_std"))
    balance = per_key(class_weights(df, split, keys).select(*keys, "label", F.col("class_weight").alias("_balance")))
    rows = cut(
        df.filter(F.col("split") == split).select(*keys, "label", *features).join(stats, list(keys)).join(balance, [*keys, "label"]).select(
            *keys, "label", "_balance", _standardised(features).alias("_z")), "training_rows")
    zeros = F.array_repeat(F.lit(0.0), size * k)
    state = per_key(stats.select(*keys, zeros.alias("_weights"), zeros.alias("_before")))
    for t in range(steps):
        led = per_key(state.selectExpr(*keys, "_weights", f"zip_with(_weights, _before, (w, b) -> w + {t / (t + 3)!r}D * (w - b)) as _ahead"))
        probs = rows.join(led.select(*keys, "_ahead"), list(keys))
        wrong = probs.withColumns({f"_e{c}": F.col("_balance") * (p - (F.col("label") == LABELS[c]).cast("double"))
                                   for c, p in enumerate(_grouped_softmax(F.col("_ahead"), F.col("_z"), size))})
        slope = F.array(*[F.avg(F.col(f"_e{c}") * F.col("_z")[j]) for c in range(k) for j in range(size)])
        moved = F.expr(f"zip_with(_ahead, _slope, (v, g) -> v - {rate!r}D * (g + {reg!r}D * v))")
        state = per_key(led.join(wrong.groupBy(*keys).agg(slope.alias("_slope")), list(keys)).select(
            *keys, moved.alias("_weights"), F.col("_weights").alias("_before")))
    return per_key(stats.join(state, list(keys)).select(*keys, "_mean", "_std", F.transform("_weights", lambda w: F.round(w, 9)).alias("_weights")))


def score_grouped(df: DataFrame, models: DataFrame, features=MODEL_FEATURES, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Class probabilities and predicted label by the model of each row's key."""
    boxed = df.join(models, list(keys)).withColumn("_z", _standardised(features))
    names = [f"prob_{c.lower()}" for c in LABELS]
    probs = dict(zip(names, _grouped_softmax(F.col("_weights"), F.col("_z"), len(features) + 1), strict=True))
    return boxed.withColumns(probs).withColumn("pred_label", predicted_label()).drop("_mean", "_std", "_weights", "_z")


def score_model(df: DataFrame, model, features=MODEL_FEATURES) -> DataFrame:
    """Probabilities and predicted label of a fitted pipeline."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df)
    p = F.col("probability")
    p = p if isinstance(out.schema["probability"].dataType, T.ArrayType) else vector_to_array(p)
    n = {f"prob_{c.lower()}": F.coalesce(F.get(p, F.lit(k)), F.lit(0.0)) for k, c in enumerate(LABELS)}
    out = out.withColumns(n).withColumn("pred_label", predicted_label())
    return out.drop(*[f"_f_{c}" for c in features], "_raw", "features", "rawPrediction", "probability", "prediction")
