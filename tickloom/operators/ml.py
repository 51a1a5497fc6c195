"""Data work around models (M1-M9)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scale(x: DataFrame, columns: list[str], how: str = "standard", train: str = "part = 'train'") -> DataFrame:
    """M1: columns scaled with statistics of the training rows only. how: standard (population deviation), min_max, robust (quartiles)."""
    t = x.where(train)
    if how == "standard":
        a, b = lambda c: F.avg(c), lambda c: F.stddev_pop(c)
    elif how == "min_max":
        a, b = lambda c: F.min(c), lambda c: F.max(c) - F.min(c)
    elif how == "robust":
        a, b = lambda c: F.percentile(c, F.lit(0.5)), lambda c: F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25))
    else:
        raise ValueError(how)
    s = t.agg(*(a(c).alias(f"_a_{c}") for c in columns), *(b(c).alias(f"_b_{c}") for c in columns))
    out = x.join(F.broadcast(s), how="cross")  # one row
    return out.withColumns({c: (F.col(c) - F.col(f"_a_{c}")) / F.when(F.col(f"_b_{c}") == 0, 1.0).otherwise(F.col(f"_b_{c}")) for c in columns}).select(*x.columns)


def pca(x: DataFrame, vector: str, k: int = 8) -> tuple[DataFrame, list[float]]:
    """M2: `projected` (array of k) and the explained variance ratios. vector: an array column."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = x.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(x)
    return model.transform(x).withColumn("projected", vector_to_array("_p")).drop("_v", "_p"), [float(v) for v in model.explainedVariance.toArray()]


def cluster(x: DataFrame, columns: list[str], k: int = 4, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """M3: rows with `cluster` (k-means on standardised columns), and the means of each cluster."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    v = VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="skip").transform(x)
    v = StandardScaler(inputCol="_raw", outputCol="_v", withMean=True).fit(v).transform(v)
    out = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(v).transform(v).drop("_raw", "_v")
    return out, out.groupBy("cluster").agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in columns))


def boosted(x: DataFrame, features: list[str], label: str, validation: str = "is_validation", seed: int = 3) -> DataFrame:
    """M4: rows with `pred` of boosted trees that stop early on the validation rows. One model for all symbols, the symbol's
    own features among the columns; a model a symbol is a loop over a short list of symbols by the caller."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    v = VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="skip").transform(x)
    model = GBTRegressor(featuresCol="_v", labelCol=label, predictionCol="pred", maxIter=20, maxDepth=4, seed=seed, validationIndicatorCol=validation)
    return model.fit(v.where(F.col(label).isNotNull())).transform(v).drop("_v")


def training_matrix(features: DataFrame, symbols: list[str], columns: list[str]) -> DataFrame:
    """M5: one row a time: every symbol's features side by side, mean and deviation over the symbols, and next returns; complete rows only."""
    x = features.withColumn("next_ret", F.lead("ret").over(Window.partitionBy("symbol").orderBy("ts")))
    g = x.groupBy("ts").pivot("symbol", symbols).agg(*(F.first(c).alias(c) for c in [*columns, "next_ret"]))
    m = x.groupBy("ts").agg(*(F.avg(c).alias(f"mkt_{c}_mean") for c in columns), *(F.stddev_samp(c).alias(f"mkt_{c}_std") for c in columns))
    return g.join(m, "ts").dropna()


def mutual_information(x: DataFrame, features: list[str], label: str, bins: int = 8, k: int = 5) -> DataFrame:
    """M6: the k features with the highest mutual information with the label, by equal-count bins.

    Bin edges are approximate quantiles from one pass, so no feature is ranked in a single task.
    """
    probs = [i / bins for i in range(1, bins)]
    long = x.select(F.col(label).cast("int").alias("y"), *features).unpivot(["y"], features, "feature", "v").where("v is not null and y is not null")
    edges = long.groupBy("feature").agg(F.percentile_approx("v", probs, 10_000).alias("e"))
    b = long.join(F.broadcast(edges), "feature").select("feature", "y", F.size(F.filter("e", lambda q: F.col("v") > q)).alias("b"))  # a row a feature
    n = b.groupBy("feature", "b", "y").agg(F.count("*").alias("n"))
    n = n.withColumns({"nx": F.sum("n").over(Window.partitionBy("feature", "b")), "ny": F.sum("n").over(Window.partitionBy("feature", "y")), "t": F.sum("n").over(Window.partitionBy("feature"))})
    mi = n.groupBy("feature").agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("mi"))
    return mi.orderBy(F.desc("mi"), "feature").limit(k)


def score_in_batches(x: DataFrame, fn, schema: str, batch: int = 1024, seed: int | None = None) -> DataFrame:
    """M7: fn on frames of at most `batch` rows, which has to give a row for each; in a seeded random order on demand."""
    if seed is not None:
        x = x.orderBy(F.xxhash64(*x.columns, F.lit(seed)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                out = fn(part)
                if len(out) != len(part):
                    raise ValueError(f"{len(out)} predictions for {len(part)} rows")
                yield out

    return x.mapInPandas(run, schema)


def answers(x: DataFrame, columns: list[str] = ["AnswerAText", "AnswerBText", "AnswerCText", "AnswerDText"], correct: str = "CorrectAnswer") -> DataFrame:  # noqa: B006
    """M8: options as an array and the place of the right letter (0 for A), null for other letters."""
    at = F.instr(F.lit("ABCD"), F.upper(F.col(correct))) - 1
    return x.select("*", F.array(*columns).alias("options"), F.when((at >= 0) & (F.length(correct) == 1), at).alias("answer"))


def split(x: DataFrame, key: str, share: float = 0.8, seed: int = 11) -> DataFrame:
    """M9: adds is_train by a hash of the key: the same rows each time, whatever their order and partitions."""
    return x.withColumn("is_train", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10_000)) < int(share * 10_000))
