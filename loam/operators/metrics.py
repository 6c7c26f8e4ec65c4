"""Reports and selection metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(value: Column, buckets: int = 10) -> Column:
    """The label of the bucket of 0..1 that holds the clamped value."""
    k = F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(0.999999)) * buckets)
    return F.format_string("%.1f-%.1f", k / F.lit(float(buckets)), (k + 1) / F.lit(float(buckets)))


def confusion(rows: DataFrame, prob: str, truth: str, threshold: float) -> DataFrame:
    """Counts and rates at one threshold, in one pass."""
    on = F.col(prob) >= threshold
    c = rows.agg(F.count_if(on & F.col(truth)).alias("tp"), F.count_if(on & ~F.col(truth)).alias("fp"), F.count_if(~on & F.col(truth)).alias("fn"), F.count_if(~on & ~F.col(truth)).alias("tn"))
    p, r = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return c.select("tp", "fp", "fn", "tn", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(2 * p * r / F.greatest(p + r, F.lit(1e-12)), 9).alias("f1"))


def threshold_curve(rows: DataFrame, prob: str, truth: str) -> DataFrame:
    """Keep ratio and recall at .05, .10, .. .95: rows are first counted by the number of thresholds they reach, so the
    19 thresholds meet 20 rows and not the data."""
    reach = F.floor(F.col(prob) * 20 + 1e-9)
    counts = rows.groupBy(F.least(F.greatest(reach, F.lit(0)), F.lit(19)).cast("int").alias("reach")).agg(F.count("*").alias("n"), F.count_if(truth).alias("pos"))
    steps = rows.sparkSession.range(1, 20).select(F.col("id").cast("int").alias("step"))
    at = counts.join(F.broadcast(steps), how="cross").groupBy("step")
    sums = at.agg(F.sum(F.when(F.col("reach") >= F.col("step"), F.col("n")).otherwise(0)).alias("kept"), F.sum("n").alias("n"), F.sum(F.when(F.col("reach") >= F.col("step"), F.col("pos")).otherwise(0)).alias("hit"), F.sum("pos").alias("pos"))
    return sums.select((F.col("step") * 5).alias("percent"), F.round(F.col("kept") / F.greatest("n", F.lit(1)), 9).alias("keep_ratio"), F.round(F.col("hit") / F.greatest("pos", F.lit(1)), 9).alias("recall"))


def operating_point(curve: DataFrame, wanted: float) -> DataFrame:
    near = F.struct(F.round(F.abs(F.col("keep_ratio") - wanted), 9), F.col("percent"))
    return curve.agg(F.min_by(F.struct("percent", "keep_ratio", "recall"), near).alias("p")).select(F.lit(wanted).alias("wanted"), "p.*")
