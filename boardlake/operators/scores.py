"""Score fusion, decisions, classification measures and score calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import HOT_KEY_ROWS, ordered, top_rows
from .quantiles import exact_quantiles


def accuracy(predictions: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Share of right predictions; null without rows."""
    return predictions.agg(F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"))


def confusion_matrix(predictions: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Counts for every pair of classes, zero where nothing was seen.

    Rows are reduced to one per seen pair first; the class list is then one array value.
    """
    seen = predictions.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )
    classes = seen.select(F.explode(F.array("label", "predicted")).alias("c")).agg(
        F.array_sort(F.collect_set("c"))
    ).scalar()
    grid = (
        seen.select("label").unionByName(seen.select(F.col("predicted").alias("label"))).distinct()
        .select("label", F.explode(classes).alias("predicted"))
    )
    return grid.join(seen, ["label", "predicted"], "left").select("label", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def class_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; a zero denominator gives 0."""
    m = confusion_matrix(predictions)
    per_class = (
        m.select(F.col("label").alias("class_name"), "n", (F.col("label") == F.col("predicted")).alias("hit"), F.lit(True).alias("truth"))
        .unionByName(m.select(F.col("predicted").alias("class_name"), "n", (F.col("label") == F.col("predicted")).alias("hit"), F.lit(False).alias("truth")))
        .groupBy("class_name").agg(
            F.sum(F.when(F.col("truth") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("truth"), F.col("n")).otherwise(0)).alias("support"),
            F.sum(F.when(~F.col("truth"), F.col("n")).otherwise(0)).alias("claimed"),
        )
    )
    share = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    return per_class.select(
        "class_name", share(F.col("tp"), F.col("claimed")).alias("precision"),
        share(F.col("tp"), F.col("support")).alias("recall"),
        share(2 * F.col("tp"), F.col("support") + F.col("claimed")).alias("f1"), "support",
    )


def fuse(scores: DataFrame, item: str, score: str) -> DataFrame:
    """Maximum and mean per item; items with an unbounded or non-finite score are flagged."""
    s = F.col(score)
    good = s.isNotNull() & ~F.isnan(s) & (s >= 0) & (s <= 1)
    return scores.groupBy(item).agg(
        F.max(s).alias("maximum"), F.avg(s).alias("mean"), F.every(good).alias("is_bounded")
    )


def fused_decision(scores: DataFrame, item: str, score: str, threshold: float) -> DataFrame:
    return scores.groupBy(item).agg(
        F.when(F.max(score) >= threshold, "FAIL").otherwise("PASS").alias("decision")
    )


def group_logic(values: DataFrame, key: str, flag: Column) -> DataFrame:
    return values.groupBy(key).agg(
        F.bool_and(flag).alias("all_of"), F.bool_or(flag).alias("any_of"),
        (F.count_if(flag) % 2 == 1).alias("odd_of"),
    )


def merge_ready(arrivals: DataFrame, target: str, source: str, required: list[str]) -> DataFrame:
    """Whether any, and whether all, required inputs of a target have arrived."""
    wanted = arrivals.where(F.col(source).isin(required))
    return arrivals.select(target).distinct().join(
        wanted.groupBy(target).agg(F.countDistinct(source).alias("_n")), target, "left"
    ).select(
        target, (F.coalesce("_n", F.lit(0)) > 0).alias("any_arrived"),
        (F.coalesce("_n", F.lit(0)) == len(required)).alias("all_arrived"),
    )


def image_summary(scanlines: DataFrame) -> DataFrame:
    return scanlines.groupBy("image_id").agg(
        F.countDistinct("y").alias("height"), F.max(F.size("row")).alias("width"), F.countDistinct("ch").alias("channels"),
        F.min(F.array_min("row")).alias("lowest"), F.max(F.array_max("row")).alias("highest"),
    )


def heightmap_summary(scanlines: DataFrame) -> DataFrame:
    """Valid and missing cells with their range; a missing cell is null."""
    valid = F.filter("row", lambda v: v.isNotNull())
    return scanlines.groupBy("image_id").agg(
        F.sum(F.size(valid)).cast("bigint").alias("valid_count"),
        F.sum(F.size("row") - F.size(valid)).cast("bigint").alias("missing_count"),
        F.min(F.array_min("row")).alias("lowest"), F.max(F.array_max("row")).alias("highest"),
    )


def luminance_checks(scanlines: DataFrame, blur_limit: float = 16.0) -> DataFrame:
    """Variance with the blur verdict, and the distance of the mean from mid-grey."""
    stats = scanlines.select("image_id", F.explode("row").alias("v")).groupBy("image_id").agg(
        F.var_pop("v").alias("variance"), F.avg("v").alias("mean")
    )
    return stats.select(
        "image_id", "variance", (F.col("variance") < blur_limit).alias("is_blurred"),
        F.least(F.abs(F.col("mean") - 127.5) / 127.5, F.lit(1.0)).alias("reference_score"),
    )


def auroc(scores: DataFrame, detector: str, score: str, positive: Column, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Area under the ROC curve per detector by average ranks over distinct scores."""
    values = scores.groupBy(detector, score).agg(
        F.count(F.lit(1)).alias("c"), F.count_if(positive).alias("p")
    )
    ranked = ordered(values, [detector], [score], running={"cum": F.col("c")}, hot_rows=hot_rows)
    rank = F.col("cum") - (F.col("c") - 1) / 2.0
    sums = ranked.groupBy(detector).agg(
        F.sum(F.col("p") * rank).alias("r"), F.sum("p").cast("double").alias("np"), F.sum("c").cast("double").alias("n")
    )
    negatives = F.col("n") - F.col("np")
    area = (F.col("r") - F.col("np") * (F.col("np") + 1) / 2.0) / (F.col("np") * negatives)
    return sums.select(detector, F.when((F.col("np") > 0) & (negatives > 0), area).alias("auroc"))


def visit_limit(visits: DataFrame, key: str, order: list[str], limit: int, hot_rows: int = HOT_KEY_ROWS):
    if limit < 1:
        raise ValueError("limit has to allow one visit or more")
    counted = ordered(visits, [key], order, number="visit", hot_rows=hot_rows)
    return counted.withColumn("branch", F.when(F.col("visit") < limit, "under-limit").otherwise("limit-reached"))


def top_k_mean(values: DataFrame, key: str, value: str, tie: list[Column], k: int) -> DataFrame:
    best = top_rows(values, [key], [F.desc(value), *tie], k)
    return best.groupBy(key).agg(F.avg(value).alias("score"))


def empirical_rank(scores: DataFrame, detector: str, score: str, reference: Column, hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """Share of reference scores at or below each score, per detector."""
    values = scores.groupBy(detector, score).agg(F.count_if(reference).alias("ok"))
    ranked = ordered(
        values, [detector], [score], running={"_upto": F.col("ok")}, total={"_all": F.col("ok")}, hot_rows=hot_rows
    ).select(detector, score, (F.col("_upto") / F.col("_all")).alias("normalized"))
    return scores.join(ranked, [detector, score])


def robust_normalised(scores: DataFrame, detector: str, score: str, reference: Column, epsilon: float = 1e-6) -> DataFrame:
    """Robust z-score against the reference scores of the detector."""
    ok = scores.where(reference)
    medians = exact_quantiles(ok, [detector], score, {"median": 0.5})
    gaps = ok.join(medians, detector).select(detector, F.abs(F.col(score) - F.col("median")).alias("d"))
    model = medians.join(exact_quantiles(gaps, [detector], "d", {"mad": 0.5}), detector)
    return scores.join(model, detector).withColumn(
        "z", (F.col(score) - F.col("median")) / (1.4826 * F.col("mad") + epsilon)
    )
