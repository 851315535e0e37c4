"""Size-intensity scores of objects against control objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tissue(df: DataFrame, dataset: str, region: str = "region") -> DataFrame:
    """condition and tissue_class of a dataset type: controls keep region 0, tumour sets split there."""
    kind = dataset.strip().lower()
    if kind == "control":
        return df.filter(F.col(region) == 0).withColumns({"condition": F.lit("Control"), "tissue_class": F.lit("parenchyma")})
    if kind == "hcc":
        tumour = F.col(region) > 0
        return df.withColumns({"condition": F.when(tumour, "Tumor").otherwise("Adjacent"), "tissue_class": F.when(tumour, "tumor").otherwise("adjacent")})
    raise ValueError(f"unknown dataset type {dataset!r}")


def log_features(df: DataFrame) -> DataFrame:
    """Positive rows with base-2 logarithms of size and summed intensity."""
    return df.filter((F.col("volume") > 0) & (F.col("dapi_sum") > 0)).withColumns({"log_volume": F.log2("volume"), "log_dapi": F.log2("dapi_sum")})


def fit_controls(df: DataFrame) -> DataFrame:
    """One row (alpha, beta): least squares of log_dapi on log_volume over controls."""
    own = df.filter(F.col("condition") == "Control")
    return own.agg(F.regr_intercept("log_dapi", "log_volume").alias("alpha"), F.regr_slope("log_dapi", "log_volume").alias("beta"))


def fit_controls_huber(df: DataFrame, epsilon: float = 1.35) -> tuple[float, float, float]:
    """(alpha, beta, scale) of the robust fit over controls, by pyspark.ml."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    own = df.filter(F.col("condition") == "Control").select(F.col("log_volume"), F.col("log_dapi").alias("label"))
    rows = VectorAssembler(inputCols=["log_volume"], outputCol="features").transform(own)
    model = LinearRegression(loss="huber", epsilon=epsilon, regParam=0.0, standardization=False, maxIter=200).fit(rows)
    return model.intercept, model.coefficients[0], model.scale


def scores(df: DataFrame, line: DataFrame | None = None) -> DataFrame:
    """expected, residual, nds = |residual| / sigma and signed snds; sigma is the controls' sample deviation.

    The fit and sigma are one row each, joined by broadcast."""
    line = fit_controls(df) if line is None else line
    out = df.crossJoin(F.broadcast(line)).withColumn("expected", F.col("alpha") + F.col("beta") * F.col("log_volume"))
    out = out.withColumn("residual", F.col("log_dapi") - F.col("expected"))
    sigma = out.filter(F.col("condition") == "Control").agg(F.stddev_samp("residual").alias("sigma"))
    out = out.crossJoin(F.broadcast(sigma))
    return out.withColumns({"nds": F.abs("residual") / F.nullif(F.col("sigma"), F.lit(0.0)), "snds": F.col("residual") / F.nullif(F.col("sigma"), F.lit(0.0))})


def quality_table(df: DataFrame) -> DataFrame:
    """Per condition: mean and sample deviation of residuals, mean snds, shares above 2 and 3."""
    above = lambda k: F.avg((F.col("nds") > k).cast("int"))
    return df.groupBy("condition").agg(
        F.count("*").alias("n"), F.avg("residual").alias("mean_residual"), F.stddev_samp("residual").alias("std_residual"),
        F.avg("snds").alias("mean_snds"), above(2).alias("above_2"), above(3).alias("above_3"),
    )


def score_class(nds: Column) -> Column:
    return F.when(nds < 1, "Normal").when(nds < 2, "Mild").when(nds < 3, "Abnormal").otherwise("Strongly abnormal")


def ecdf(df: DataFrame, value: str, by: str = "condition") -> DataFrame:
    """(by, value, n, below, ecdf): the share of a group's rows at or below each distinct value.

    Rows are aggregated by value first, so the window runs over distinct values only."""
    counts = df.groupBy(by, value).agg(F.count("*").alias("n"))
    up = Window.partitionBy(by).orderBy(value)
    total = F.sum("n").over(Window.partitionBy(by))
    below = F.sum("n").over(up)
    return counts.withColumns({"below": below, "ecdf": below / total})


def exact_quantiles(df: DataFrame, value: str, shares: tuple[float, ...], by: str = "condition", bins: int = 4096) -> DataFrame:
    """(by, share, quantile): exact quantiles, interpolated linearly between neighbouring values.

    Values are counted by group and bin; only the bins that hold a wanted rank are counted by value,
    so no task holds a group's values."""
    stats = df.filter(F.col(value).isNotNull()).groupBy(by).agg(F.min(value).alias("lo_"), F.max(value).alias("hi_"), F.count("*").alias("n_"))
    span = F.nullif((F.col("hi_") - F.col("lo_")).cast("double"), F.lit(0.0))
    binned = df.filter(F.col(value).isNotNull()).select(by, F.col(value).alias("v_")).join(stats, by)
    binned = binned.withColumn("b_", F.least(F.floor(F.coalesce((F.col("v_") - F.col("lo_")).cast("double") / span, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int"))
    up = Window.partitionBy(by).orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
    counts = binned.groupBy(by, "b_").count().withColumn("before_", F.coalesce(F.sum("count").over(up), F.lit(0)))
    wanted = stats.select(by, "n_", F.explode(F.array(*map(F.lit, shares))).alias("share")).withColumn("h_", F.col("share") * (F.col("n_") - 1))
    wanted = wanted.withColumn("end_", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("rank_", F.least(F.floor("h_") + F.col("end_"), F.col("n_") - 1))
    cells = wanted.join(counts, by).filter((F.col("rank_") >= F.col("before_")) & (F.col("rank_") < F.col("before_") + F.col("count")))
    cells = cells.select(by, "b_", "share", "h_", "end_", (F.col("rank_") - F.col("before_")).alias("place_"))
    within = Window.partitionBy(by, "b_").orderBy("v_").rowsBetween(Window.unboundedPreceding, 0)
    values = binned.join(cells.select(by, "b_").distinct(), [by, "b_"], "left_semi").groupBy(by, "b_", "v_").agg(F.count("*").alias("c_")).withColumn("below_", F.sum("c_").over(within))
    found = cells.join(values, [by, "b_"]).filter((F.col("place_") < F.col("below_")) & (F.col("place_") >= F.col("below_") - F.col("c_")))
    ends = found.groupBy(by, "share").agg(F.min_by("v_", "end_").cast("double").alias("a_"), F.max_by("v_", "end_").cast("double").alias("z_"), F.first("h_").alias("h_"))
    part = F.col("h_") - F.floor("h_")
    return ends.select(by, "share", ((1 - part) * F.col("a_") + part * F.col("z_")).alias("quantile"))


def box_summary(df: DataFrame, value: str, by: str = "condition") -> DataFrame:
    """Exact quartiles of each group."""
    found = exact_quantiles(df, value, (0.25, 0.5, 0.75), by)
    of = lambda q: F.max(F.when(F.col("share") == q, F.col("quantile")))
    return found.groupBy(by).agg(of(0.25).alias("q1"), of(0.5).alias("median"), of(0.75).alias("q3"))


def kernel_density(df: DataFrame, value: str, points: list[float], bandwidth: float) -> list[float]:
    """Gaussian kernel density at points, summed over the rows by pyspark.mllib."""
    from pyspark.mllib.stat import KernelDensity

    estimate = KernelDensity()
    estimate.setBandwidth(bandwidth)
    estimate.setSample(df.select(F.col(value).cast("double")).rdd.map(lambda r: r[0]))
    return list(estimate.estimate(points))
