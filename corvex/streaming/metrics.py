"""Metric windows over events, the same for batch and streams (give streams a watermark first)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = (1.0, 2.5, 5.0, 10.0, 25.0, 50.0)


def rate(events: DataFrame, labels: list[str], width: str = "5 minutes", slide: str = "15 seconds", seconds: int = 300) -> DataFrame:
    """Events a second over a sliding window, by labels."""
    return events.groupBy(F.window("ts", width, slide).alias("w"), *labels).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *labels, "n", F.round(F.col("n") / seconds, 6).alias("rate"))


def increase(events: DataFrame, labels: list[str], width: str = "15 minutes") -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), *labels).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *labels, "n")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes") -> DataFrame:
    """Session windows (an extension: the metrics need none)."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def bucket(value: Column, bounds: tuple[float, ...] = BUCKETS) -> Column:
    """The number of the first bound that is not below value; one more than the last for none."""
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < value))


def histogram_quantile(events: DataFrame, label: str, share: float = 0.95, bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """A quantile from cumulative bucket counts, linear within the bucket; the last bound where it lies beyond."""
    counts = events.groupBy(label, bucket(F.col("value"), bounds).alias("b")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(label)
    upto = F.sum("n").over(w.orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    ready = counts.withColumn("cum", upto).withColumn("target", F.sum("n").over(w) * share)
    hit = ready.where("cum >= target").withColumn("k", F.row_number().over(w.orderBy("b"))).where("k = 1")
    edges = F.array(F.lit(0.0), *map(F.lit, bounds))
    low, high = F.get(edges, F.col("b")), F.get(edges, F.col("b") + 1)
    inside = low + (high - low) * (F.col("target") - (F.col("cum") - F.col("n"))) / F.col("n")
    return hit.select(label, F.round(F.when(F.col("b") >= len(bounds), F.lit(bounds[-1])).otherwise(inside), 6).alias("q"))
