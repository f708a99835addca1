"""Golden-reference models fitted per pixel across images, and scores against them."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .images import DERIVE, SMOOTH, gaussian_kernel, on_strips, pixels, separable, strips
from .quantiles import exact_quantiles

POSITION = ["grp", "ch", "y", "x"]
LINE = ["grp", "ch", "y"]


def golden_lines(scanlines: DataFrame) -> DataFrame:
    """Reference image per group: the image with the smallest id."""
    first = scanlines.groupBy("grp").agg(F.min("image_id").alias("image_id"))
    return scanlines.join(first, ["grp", "image_id"], "left_semi").select(*LINE, F.col("row").alias("other_row"))


def against_golden(scanlines: DataFrame, golden: DataFrame) -> DataFrame:
    return scanlines.join(golden, LINE)


def image_scores(maps: DataFrame) -> DataFrame:
    """Mean of the clamped anomaly map per image (channels averaged)."""
    total = F.aggregate("map", F.lit(0.0), lambda a, v: a + F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
    return maps.groupBy("image_id").agg((F.sum(total) / F.sum(F.size("map"))).alias("score"))


# ---------------------------------------------------------------- fitted models

def fit_median_mad(scanlines: DataFrame) -> DataFrame:
    """Median and median absolute deviation per group and pixel."""
    p = pixels(scanlines, ["grp"])
    medians = exact_quantiles(p, POSITION, "v", {"median": 0.5})
    spread = p.join(medians, POSITION).select(*POSITION, F.abs(F.col("v") - F.col("median")).alias("d"))
    return medians.join(exact_quantiles(spread, POSITION, "d", {"mad": 0.5}), POSITION)


def fit_gaussian(scanlines: DataFrame) -> DataFrame:
    """Mean and population variance per group and pixel, one channel."""
    return pixels(scanlines, ["grp"]).groupBy(*POSITION).agg(F.avg("v").alias("mean"), F.var_pop("v").alias("variance"))


def _colour_lines(scanlines: DataFrame) -> DataFrame:
    """The three channels of each scanline side by side."""
    return scanlines.groupBy("image_id", "grp", "y").agg(
        *[F.max(F.when(F.col("ch") == c, F.col("row"))).alias(f"c{c}") for c in range(3)]
    )


def _colour_pixels(scanlines: DataFrame) -> DataFrame:
    return _colour_lines(scanlines).select("image_id", "grp", "y", F.posexplode(F.arrays_zip("c0", "c1", "c2")).alias("x", "_z")).select(
        "image_id", "grp", "y", "x", "_z.c0", "_z.c1", "_z.c2"
    )


PAIRS = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]


def fit_colour_gaussian(scanlines: DataFrame) -> DataFrame:
    """Mean vector and population covariance per group and pixel, three channels."""
    return _colour_pixels(scanlines).groupBy("grp", "y", "x").agg(
        *[F.avg(f"c{c}").alias(f"m{c}") for c in range(3)],
        *[F.covar_pop(f"c{i}", f"c{j}").alias(f"s{i}{j}") for i, j in PAIRS],
    )


def as_lines(model: DataFrame, keys: list[str]) -> DataFrame:
    """A model per pixel as one row per scanline, each value an array over ``x``."""
    values = [c for c in model.columns if c not in (*keys, "x")]
    lines = model.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", *values))).alias("_m"))
    return lines.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in values])


def robust_map(scanlines: DataFrame, model: DataFrame, epsilon: float = 0.001) -> DataFrame:
    """Anomaly map per scanline; ``model`` has ``median`` and ``mad`` per pixel, joined as scanlines."""
    z = lambda c: F.abs(c["row"] - c["median"]) / (1.4826 * c["mad"] + epsilon)
    cells = F.transform(F.arrays_zip("row", "median", "mad"), lambda c: 1.0 - F.exp(-z(c)))
    return scanlines.join(as_lines(model, LINE), LINE).select("image_id", "ch", "y", cells.alias("map"))


def mahalanobis_map(scanlines: DataFrame, model: DataFrame, ridge: float = 0.001) -> DataFrame:
    """Anomaly map per scanline; ``model`` has ``mean`` and ``variance`` per pixel, joined as scanlines."""
    def anomaly(c):
        d = c["row"] - c["mean"]
        return 1.0 - F.exp(-0.5 * F.greatest(d * d / (c["variance"] + ridge), F.lit(0.0)))

    cells = F.transform(F.arrays_zip("row", "mean", "variance"), anomaly)
    return scanlines.join(as_lines(model, LINE), LINE).select("image_id", "ch", "y", cells.alias("map"))


def colour_mahalanobis_map(scanlines: DataFrame, model: DataFrame, ridge: float = 0.001) -> DataFrame:
    """Three channels with the inverse of the symmetric 3 x 3 covariance written out, per scanline."""
    def anomaly(z):
        s = {(i, j): z[f"s{i}{j}"] + (ridge if i == j else 0.0) for i, j in PAIRS}
        a, b, c, d, e, f = (s[p] for p in PAIRS)
        inverse = {
            (0, 0): d * f - e * e, (0, 1): c * e - b * f, (0, 2): b * e - c * d,
            (1, 1): a * f - c * c, (1, 2): b * c - a * e, (2, 2): a * d - b * b,
        }
        det = a * inverse[0, 0] + b * inverse[0, 1] + c * inverse[0, 2]
        diff = [z[f"c{i}"] - z[f"m{i}"] for i in range(3)]
        total = F.lit(0.0)
        for i, j in PAIRS:
            total = total + (1.0 if i == j else 2.0) * inverse[i, j] * diff[i] * diff[j]
        return 1.0 - F.exp(-0.5 * F.greatest(total / det, F.lit(0.0)))

    values = [f"c{i}" for i in range(3)] + [f"m{i}" for i in range(3)] + [f"s{i}{j}" for i, j in PAIRS]
    both = _colour_lines(scanlines).join(as_lines(model, ["grp", "y"]), ["grp", "y"])
    return both.select("image_id", F.lit(0).alias("ch"), "y", F.transform(F.arrays_zip(*values), anomaly).alias("map"))


# ---------------------------------------------------------------- comparisons with a reference

def absolute_difference(scanlines: DataFrame, golden: DataFrame) -> DataFrame:
    return against_golden(scanlines, golden).select(
        "image_id", "ch", "y", F.zip_with("row", "other_row", lambda a, b: F.abs(a - b)).alias("map")
    )


def _compared(scanlines: DataFrame, golden: DataFrame, radius: int, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Anomaly map from the neighbourhoods of both images."""
    both = against_golden(scanlines, golden)
    return on_strips(both, radius, "reflect101", kernel, columns=("row", "other_row"), out="map").select("image_id", "ch", "y", "map")


def _moments(a: np.ndarray, b: np.ndarray, k: list[float]) -> tuple[np.ndarray, ...]:
    """Local means, variances and covariance of two blocks under weights ``k``."""
    ma, mb = separable(a, k, k), separable(b, k, k)
    return (
        ma, mb, separable(a * a, k, k) - ma * ma, separable(b * b, k, k) - mb * mb, separable(a * b, k, k) - ma * mb,
    )


def _dissimilarity(similarity: np.ndarray) -> np.ndarray:
    return (1.0 - np.clip(similarity, -1.0, 1.0)) / 2.0


def structural_similarity(scanlines: DataFrame, golden: DataFrame, window: int) -> DataFrame:
    if window < 3 or window % 2 == 0:
        raise ValueError("The window must be odd and at least three.")
    k = gaussian_kernel(window, max(0.5, 1.5 * window / 11.0))
    c1, c2 = 0.01**2, 0.03**2

    def compare(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ma, mb, va, vb, cov = _moments(a, b, k)
        return _dissimilarity((2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2)))

    return _compared(scanlines, golden, window // 2, compare)


def cross_correlation(scanlines: DataFrame, golden: DataFrame, size: int) -> DataFrame:
    """Local normalised cross-correlation; ``size`` is the smaller image side."""
    window = min(11, size)
    window -= 1 - window % 2
    if window < 3:
        raise ValueError("Images must be at least three pixels wide and high.")
    k = [1.0 / window] * window

    def compare(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ma, mb, va, vb, cov = _moments(a, b, k)
        spread = np.sqrt(np.maximum(va, 0.0) * np.maximum(vb, 0.0))
        flat = spread <= 1e-8
        similarity = np.where(flat, 0.0, cov / np.where(flat, 1.0, spread))
        return _dissimilarity(np.where(flat & (np.abs(ma - mb) <= 1e-6), 1.0, similarity))

    return _compared(scanlines, golden, window // 2, compare)


def _magnitude(block: np.ndarray) -> np.ndarray:
    return np.sqrt(separable(block, SMOOTH, DERIVE) ** 2 + separable(block, DERIVE, SMOOTH) ** 2)


def gradient_difference(scanlines: DataFrame, golden: DataFrame) -> DataFrame:
    scale = 4.0 * math.sqrt(2.0)
    return _compared(scanlines, golden, 1, lambda a, b: np.abs(_magnitude(a) - _magnitude(b)) / scale)


def edge_difference(scanlines: DataFrame, golden: DataFrame, threshold: float) -> DataFrame:
    """Where one image has an edge and the other none; an edge is a strong gradient."""
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold is a share of the largest gradient, from 0 to 1")
    return _compared(
        scanlines, golden, 1, lambda a, b: ((_magnitude(a) > threshold) != (_magnitude(b) > threshold)).astype(float)
    )


def mask_xor(masks: DataFrame, golden: DataFrame) -> DataFrame:
    return against_golden(masks, golden).select(
        "image_id", "ch", "y",
        F.zip_with("row", "other_row", lambda a, b: F.when((a != 0) != (b != 0), 1.0).otherwise(0.0)).alias("map"),
    )


def template_matches(scanlines: DataFrame, templates: DataFrame, height: int, method: str) -> DataFrame:
    """Best placement of the group's template in every image.

    ``templates`` has one row per group: ``template`` as ``height`` rows, of one size. A strip gets as
    many rows below it as the template is high, and the template once; sums run over shifted slices.
    """
    if method not in ("sqdiff", "sqdiff-normed", "ccorr-normed", "ccoeff-normed"):
        raise ValueError("no such way to compare with a template")
    t = templates.select(
        "grp", F.flatten("template").alias("template"), F.size("template").alias("height"), F.size(F.col("template")[0]).alias("wide")
    )
    gathered = strips(scanlines, 0, height - 1).withColumn("grp", F.col("lines")[0]["grp"]).join(t, "grp")

    def quality_map(cells: np.ndarray, patch: np.ndarray) -> np.ndarray:
        high, wide = patch.shape
        rows, cols = cells.shape[0] - high + 1, cells.shape[1] - wide + 1
        vt = vv = v1 = 0.0
        for dy in range(high):
            for dx in range(wide):
                v, w = cells[dy:dy + rows, dx:dx + cols], patch[dy, dx]
                vt, vv, v1 = vt + v * w, vv + v * v, v1 + v
        n, t1, t2 = patch.size, patch.sum(), (patch**2).sum()
        if method == "sqdiff":
            return vv - 2.0 * vt + t2
        if method == "sqdiff-normed":
            return (vv - 2.0 * vt + t2) / np.sqrt(t2 * vv)
        if method == "ccorr-normed":
            return vt / np.sqrt(t2 * vv)
        spread = np.sqrt(np.maximum((t2 - t1 * t1 / n) * (vv - v1 * v1 / n), 0.0))
        flat = spread <= 1e-12
        return np.where(flat, 0.0, (vt - v1 * t1 / n) / np.where(flat, 1.0, spread))

    lower_is_better = method.startswith("sqdiff")

    @F.pandas_udf("s double, y int, x int")
    def best_of(ys: pd.Series, flat: pd.Series, starts: pd.Series, owns: pd.Series, patches: pd.Series, wides: pd.Series) -> pd.DataFrame:
        out = []
        for y, cells, start, own, patch, wide in zip(ys, flat, starts, owns, patches, wides):
            block, template = cells.reshape(len(y), -1), patch.reshape(height, wide)
            if block.shape[0] < height or block.shape[1] < wide:
                out.append((None, None, None))
                continue
            found = np.round(quality_map(block, template), 9)[:own]
            score = found if lower_is_better else -found
            at = int(np.argmin(score))  # the first, in order of y and x
            out.append((float(score.flat[at]), start + at // score.shape[1], at % score.shape[1]))
        return pd.DataFrame(out, columns=["s", "y", "x"]).astype({"s": "float64", "y": "Int32", "x": "Int32"})

    found = gathered.select("image_id", "height", F.col("wide").alias("width"), best_of("_ys", "_row", "_from", F.size("lines"), "template", "wide").alias("p"))
    best = found.where("p.s IS NOT NULL").groupBy("image_id").agg(F.min(F.struct("p.s", "p.y", "p.x", "height", "width")).alias("b"))
    m = F.col("b.s")
    quality = {
        "sqdiff": F.when(m <= 1e-12, 1.0).otherwise(1.0 / (1.0 + m)), "sqdiff-normed": 1.0 - m,
    }.get(method, -m)
    quality = F.greatest(F.lit(0.0), F.least(F.lit(1.0), quality))
    return best.select("image_id", "b.x", "b.y", "b.width", "b.height", quality.alias("quality"), (1.0 - quality).alias("score"))
