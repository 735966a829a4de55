"""Judging classifiers: reports, thresholds, escalation, votes of pages for their document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "UNKNOWN"


def confusion(predictions: DataFrame, truth: str, predicted: str) -> DataFrame:
    return predictions.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_report(predictions: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1, support) over all true and predicted labels; a quotient by zero counts as 0."""
    cells = confusion(predictions, truth, predicted)
    hits = F.sum(F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0))
    by_truth = cells.groupBy(F.col(truth).alias("label")).agg(F.sum("n").alias("support"), hits.alias("tp"))
    by_guess = cells.groupBy(F.col(predicted).alias("label")).agg(F.sum("n").alias("guessed"))
    both = by_truth.join(by_guess, "label", "full_outer").na.fill(0)
    share = lambda a, b: F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0))
    both = both.select("label", share("tp", "guessed").alias("p"), share("tp", "support").alias("r"), "support")
    f1 = F.coalesce(2 * F.col("p") * F.col("r") / F.when(F.col("p") + F.col("r") > 0, F.col("p") + F.col("r")), F.lit(0.0))
    return both.select("label", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(f1, 6).alias("f1"), F.col("support").cast("long").alias("support"))


def summary(report: DataFrame) -> DataFrame:
    """macro_f1 and weighted_f1 of a report."""
    return report.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 6).alias("weighted_f1"))


def chosen(baseline_f1: Column, challenger_f1: Column, margin: float = 0.03) -> Column:
    """CHALLENGER if its macro-F1 is better by more than the margin, else BASELINE; a missing one counts as 0."""
    gain = F.coalesce(challenger_f1, F.lit(0.0)) - F.coalesce(baseline_f1, F.lit(0.0))
    return F.when(gain > margin, "CHALLENGER").otherwise("BASELINE")


def with_abstention(predictions: DataFrame, label: str, confidence: str, threshold: float) -> DataFrame:
    """``decided``: the label, or UNKNOWN below the threshold."""
    return predictions.withColumn("decided", F.when(F.col(confidence) >= threshold, F.col(label)).otherwise(UNKNOWN))


def threshold_sweep(predictions: DataFrame, truth: str, label: str, confidence: str, thresholds: list[float]) -> DataFrame:
    """(threshold, macro_f1) of each candidate; every row is judged under each of them in one pass."""
    tried = predictions.select(truth, label, confidence, F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    tried = tried.select("threshold", F.col(truth).alias("t"), F.when(F.col(confidence) >= F.col("threshold"), F.col(label)).otherwise(UNKNOWN).alias("g"))
    cells = tried.groupBy("threshold", "t", "g").agg(F.count(F.lit(1)).alias("n"))
    rows = cells.select("threshold", F.explode(F.array(F.struct(F.col("t").alias("label"), F.col("n").alias("s"), F.lit(0).cast("long").alias("g"), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("g").alias("label"), F.lit(0).cast("long").alias("s"), F.col("n").alias("g"), F.lit(0).cast("long").alias("tp")))).alias("x")).select("threshold", "x.*")
    sums = rows.groupBy("threshold", "label").agg(F.sum("s").alias("s"), F.sum("g").alias("g"), F.sum("tp").alias("tp"))
    f1 = F.coalesce(2 * F.col("tp") / F.when(F.col("s") + F.col("g") > 0, F.col("s") + F.col("g")), F.lit(0.0))
    return sums.groupBy("threshold").agg(F.round(F.avg(f1), 6).alias("macro_f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The first threshold with the highest macro-F1."""
    return sweep.orderBy(F.desc("macro_f1"), "threshold").limit(1)


def escalated(predictions: DataFrame, decided: str, confidence: str, low: float = 0.15, high: float = 0.40) -> DataFrame:
    """The abstentions that a second model sees: confidence in [low, high)."""
    return predictions.filter((F.col(decided) == UNKNOWN) & (F.col(confidence) >= low) & (F.col(confidence) < high))


def vote(pages: DataFrame, doc: str, page: str, label: str, confidence: str) -> DataFrame:
    """(doc, label, confidence, triage): the label with the largest sum of confidence over pages that aren't UNKNOWN, with their mean; ties to the first page."""
    sums = pages.filter(F.col(label) != UNKNOWN).groupBy(doc, label).agg(F.sum(confidence).alias("_s"), F.avg(confidence).alias("_m"), F.min(page).alias("_p"))
    first = F.row_number().over(Window.partitionBy(doc).orderBy(F.desc(F.round("_s", 9)), "_p"))
    won = sums.withColumn("_r", first).filter("_r = 1").select(doc, F.col(label).alias("_l"), F.round("_m", 4).alias("_m"))
    return pages.select(doc).distinct().join(won, doc, "left").select(doc, F.coalesce("_l", F.lit(UNKNOWN)).alias("label"), F.coalesce("_m", F.lit(0.0)).alias("confidence"), F.col("_l").isNull().alias("triage"))


def latency(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and interpolated percentiles."""
    return rows.groupBy(key).agg(F.round(F.percentile(value, F.lit(0.5)), 6).alias("p50"), F.round(F.percentile(value, F.lit(0.95)), 6).alias("p95"), F.round(F.avg(value), 6).alias("mean"))
