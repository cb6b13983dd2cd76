"""Classification of segments: split, scaling, models, constrained classes, reports, attributions."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.common import ranked
from gridloom.operators.raster import exact_percentiles

#: Features up to which Shapley values go over all subsets (2^8 predictions of a row).
EXACT_FEATURES = 8


def split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """``is_test``: exactly ceil(test_size * n) rows, the first in a seeded hash order of the key."""
    n = df.count()
    marked = ranked(df, [], F.xxhash64(key, F.lit(seed)), [key], rank="_rank")
    return marked.withColumn("is_test", F.col("_rank") <= math.ceil(test_size * n)).drop("_rank")


def scale(df: DataFrame, features: list[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """Features less their mean over their population standard deviation; a constant feature is only centred.

    Means come from ``fitted_on`` (the training rows), or from the rows themselves to follow
    scalers fitted on each part.  One row of statistics reaches the driver.
    """
    s = (df if fitted_on is None else fitted_on).agg(*[F.struct(F.avg(f), F.stddev_pop(f)).alias(f) for f in features]).first()
    rest = [c for c in df.columns if c not in features]
    return df.select(*rest, *[((F.col(f) - F.lit(s[f][0])) / F.lit(s[f][1] or 1.0)).alias(f) for f in features])


def fit(train: DataFrame, features: list[str], method: str = "rf", **params):
    """A fitted pipeline; method "rf" (n_estimators, max_depth) or "mlp" (hidden_layer_sizes, max_iter), either with random_state; other parameters are refused."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    known = {"rf": {"n_estimators", "max_depth", "random_state"}, "mlp": {"hidden_layer_sizes", "max_iter", "random_state"}}
    if method not in known:
        raise ValueError(f"method {method!r} is neither 'rf' nor 'mlp'")
    if strange := set(params) - known[method]:
        raise TypeError(f"{method} has no parameters {sorted(strange)}")
    index = StringIndexer(inputCol="feature_class", outputCol="_label", stringOrderType="alphabetAsc")
    vector = VectorAssembler(inputCols=features, outputCol="_features")
    if method == "rf":
        model = RandomForestClassifier(labelCol="_label", featuresCol="_features", probabilityCol="_proba", numTrees=params.get("n_estimators", 100), maxDepth=params.get("max_depth", 10), seed=params.get("random_state", 42))
    else:
        classes = train.select("feature_class").distinct().count()
        layers = [len(features), *params.get("hidden_layer_sizes", (100,)), classes]
        model = MultilayerPerceptronClassifier(labelCol="_label", featuresCol="_features", probabilityCol="_proba", layers=layers, maxIter=params.get("max_iter", 200), seed=params.get("random_state", 42))
    return Pipeline(stages=[index, vector, model]).fit(train)


def predict(model, df: DataFrame) -> DataFrame:
    """``df`` with ``proba`` (array) by the classes of ``class_labels(model)``."""
    from pyspark.ml.functions import vector_to_array

    vector, classifier = model.stages[1], model.stages[2]
    out = classifier.transform(vector.transform(df))
    return out.select(*df.columns, vector_to_array("_proba").alias("proba"))


def class_labels(model) -> list[int]:
    return [int(float(x)) for x in model.stages[0].labels]


def choose(proba: Column, classes: list[int], acceptable: Column) -> tuple[Column, Column]:
    """(class, margin): the likeliest class among the acceptable ones (all where null) and its lead over the next.

    Ties go to the earlier class.  Without a candidate both are null; with one the margin is null.
    """
    names = F.array(*[F.lit(c) for c in classes])
    pairs = F.zip_with(proba, names, lambda p, c: F.struct(p.alias("p"), (-c).alias("c")))
    ok = F.filter(pairs, lambda s: acceptable.isNull() | F.array_contains(acceptable, -s["c"]))
    best = F.sort_array(ok, asc=False)
    first, second = F.get(best, F.lit(0)), F.get(best, F.lit(1))
    return -first["c"], first["p"] - second["p"]


def confusion_matrix(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """y, yhat, n over all classes seen in either column, zeros included."""
    counts = df.groupBy(y, yhat).agg(F.count(F.lit(1)).alias("n"))
    classes = counts.select(F.explode(F.array(y, yhat)).alias("c")).agg(F.collect_set("c").alias("_c"))
    grid = classes.select(F.explode("_c").alias(y), "_c").select(y, F.explode("_c").alias(yhat))
    return grid.join(counts, [y, yhat], "left").select(y, yhat, F.coalesce("n", F.lit(0)).alias("n"))


def classification_report(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """label, precision, recall, f1, support of each class, accuracy, and macro and weighted means; 0 where undefined."""
    counts = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).groupBy(y, yhat).agg(F.count(F.lit(1)).alias("n"))
    sides = F.explode(F.array(F.struct(F.col(y).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(yhat).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"))))
    right = (F.col("_s.t") == 1) & (F.col(y) == F.col(yhat))
    per = counts.withColumn("_s", sides).groupBy(F.col("_s.c").alias("c")).agg(F.sum(F.when(right, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.col("n") * F.col("_s.p")).alias("predicted"), F.sum(F.col("n") * F.col("_s.t")).alias("support"))
    per = per.withColumn("precision", F.coalesce(F.try_divide("tp", "predicted"), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide("tp", "support"), F.lit(0.0)))
    per = per.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    cols = ["precision", "recall", "f1"]
    classes = per.select(F.col("c").cast("string").alias("label"), *cols, "support")
    means = per.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"w_{c}") for c in cols], F.try_divide(F.sum("tp"), F.sum("support")).alias("acc"), F.sum("support").alias("support"))
    null = F.lit(None).cast("double")
    lines = F.explode(F.array(
        F.struct(F.lit("accuracy").alias("label"), null.alias("precision"), null.alias("recall"), F.col("acc").alias("f1"), "support"),
        F.struct(F.lit("macro avg").alias("label"), *[F.col(f"m_{c}").alias(c) for c in cols], "support"),
        F.struct(F.lit("weighted avg").alias("label"), *[F.col(f"w_{c}").alias(c) for c in cols], "support"),
    ))
    return classes.unionByName(means.select(lines.alias("_l")).select("_l.*"))


def box_plot(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, q1, median, q3 and the whiskers: the least and greatest values within 1.5 quartile ranges."""
    q = exact_percentiles(df, [key], value, [0.25, 0.5, 0.75], "_q")
    j = df.join(q, key).withColumn("q1", F.col("_q")[0]).withColumn("median", F.col("_q")[1]).withColumn("q3", F.col("_q")[2])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)
    return j.groupBy(key).agg(F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"), F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"))


def forest_votes(model) -> Callable[[np.ndarray], np.ndarray]:
    """The fitted forest as a NumPy function: (n, features) -> share of trees that vote for each class."""
    n_classes = len(model.stages[0].labels)
    trees = []
    for tree in model.stages[2].trees:
        nodes: list[list[float]] = []  # feature, threshold, left, right, class

        def read(lines: list[tuple[int, str]], at: int) -> tuple[int, int]:
            text = lines[at][1]
            me = len(nodes)
            nodes.append([-1, 0.0, -1, -1, 0])
            if m := re.match(r"Predict: ([-0-9.Ee]+)", text):
                nodes[me][4] = int(float(m[1]))
                return me, at + 1
            m = re.match(r"If \(feature (\d+) <= ([-0-9.Ee]+)\)", text)
            nodes[me][0], nodes[me][1] = int(m[1]), float(m[2])
            nodes[me][2], at = read(lines, at + 1)
            nodes[me][3], at = read(lines, at + 1)  # skips the Else line
            return me, at

        lines = [(len(s) - len(s.lstrip()), s.strip()) for s in tree.toDebugString.splitlines()[1:] if s.strip()]
        read(lines, 0)
        trees.append(np.array(nodes, dtype=float))

    def votes(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), n_classes))
        rows = np.arange(len(x))
        for t in trees:
            at = np.zeros(len(x), dtype=int)
            while (live := t[at, 0] >= 0).any():
                f = t[at, 0].astype(int)
                left = x[rows, np.maximum(f, 0)] <= t[at, 1]
                at = np.where(live, np.where(left, t[at, 2], t[at, 3]).astype(int), at)
            out[rows, t[at, 4].astype(int)] += 1
        return out / len(trees)

    return votes


def shapley_values(df: DataFrame, key: str, features: list[str], predict_fn: Callable[[np.ndarray], np.ndarray], background: list[float], permutations: int = 16, seed: int = 42) -> DataFrame:
    """key, class_no, feature, value: Shapley attributions against a background row.

    Exact, over all subsets, for up to ``EXACT_FEATURES`` features; sampled over ``permutations``
    random orders above.  In either case the attributions of a row add up to f(row) - f(background).
    """
    k = len(features)

    def exact(x: np.ndarray) -> np.ndarray:
        ground, total = np.asarray(background, float), None
        for subset in range(2**k):
            inside = [bool(subset >> f & 1) for f in range(k)]
            value = predict_fn(np.where(inside, x, ground))
            total = np.zeros((len(x), value.shape[1], k)) if total is None else total
            size = sum(inside)
            for f in range(k):
                others = size - inside[f]
                total[:, :, f] += (1 if inside[f] else -1) * value / (k * math.comb(k - 1, others))
        return total

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(seed)
        orders = [] if k <= EXACT_FEATURES else [rng.permutation(k) for _ in range(permutations)]
        for batch in batches:
            x = batch[features].to_numpy(float)
            if not len(x):
                continue
            total = exact(x) if k <= EXACT_FEATURES else None
            for order in orders:
                at = np.tile(np.asarray(background, float), (len(x), 1))
                before = predict_fn(at)
                total = np.zeros((len(x), before.shape[1], k)) if total is None else total
                for f in order:
                    at[:, f] = x[:, f]
                    after = predict_fn(at)
                    total[:, :, f] += after - before
                    before = after
            total /= len(orders) or 1
            n, c, _ = total.shape
            yield pd.DataFrame({key: np.repeat(batch[key].to_numpy(), c * k), "class_no": np.tile(np.repeat(np.arange(c), k), n), "feature": np.tile(np.array(features), n * c), "value": total.ravel()})

    return df.select(key, *features).mapInPandas(run, f"{key} long, class_no int, feature string, value double")


def class_names(df: DataFrame, names: dict[int, str], column: str, out: str = "class_name") -> DataFrame:
    """Class codes as text; codes without a name become null."""
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
    return df.withColumn(out, F.element_at(F.create_map(*pairs), F.col(column)))


def classified_raster(labels: DataFrame, classified: DataFrame) -> DataFrame:
    """raster_id, band, row, col, v: the predicted class of each pixel's segment, ready to be written; null without one."""
    c = classified.select("segment_id", F.col("predicted_class").cast("double").alias("v"))
    return labels.select("segment_id", "raster_id", "row", "col").join(c, "segment_id", "left").select("raster_id", F.lit(0).alias("band"), "row", "col", "v")
