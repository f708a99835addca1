"""Image operators over a scanline table.

Scanlines are rows ``(image_id, ch, y, width, row ARRAY<DOUBLE>)``. Point operators change
``row`` in place. Neighbourhood operators gather strips: runs of scanlines of one image, with as many rows
of the strips beside them as the neighbourhood reaches. So each row is shuffled once, a few twice, a
task holds strips of a bounded number of cells however high the image, and one NumPy call serves a strip.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE = ["image_id", "ch"]


def pixels(scanlines: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    return scanlines.select("image_id", *extra, "ch", "y", F.posexplode("row").alias("x", "v"))


def map_rows(scanlines: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return scanlines.withColumn("row", F.transform("row", f))


def map_with_image(scanlines: DataFrame, per_image: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """Change values with constants of their image, joined by image and channel."""
    keep = scanlines.columns
    return map_rows(scanlines.join(per_image, IMAGE), f).select(*keep)


def pair_rows(scanlines: DataFrame, other: DataFrame, keys: Sequence[str], f: Callable[[Column, Column], Column]) -> DataFrame:
    """Combine two images pixel by pixel; ``other`` holds its values in ``other_row``."""
    keep = scanlines.columns
    joined = scanlines.join(other.select(*keys, "other_row"), list(keys))
    return joined.withColumn("row", F.zip_with("row", "other_row", f)).select(*keep)


def shape_mismatches(observed: DataFrame, golden: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Images whose scanlines do not line up with their reference."""
    o = observed.select(*keys, "image_id", "y", F.size("row").alias("w"))
    g = golden.select(*keys, "y", F.size("other_row").alias("gw"))
    heights = g.groupBy(*keys).agg(F.count(F.lit(1)).alias("gh"))
    lines = o.join(g, [*keys, "y"], "left").groupBy(*keys, "image_id").agg(
        F.count(F.lit(1)).alias("h"), F.count_if(F.col("gw").isNull() | (F.col("gw") != F.col("w"))).alias("bad")
    )
    return lines.join(heights, list(keys), "left").where(
        (F.col("bad") > 0) | F.col("gh").isNull() | (F.col("gh") != F.col("h"))
    ).select("image_id")


# ---------------------------------------------------------------- point operators

def clamp_byte(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))


def to_bytes(scanlines: DataFrame) -> DataFrame:
    """Values in [0, 1] as whole numbers 0..255."""
    return map_rows(scanlines, lambda v: F.floor(v * 255.0).cast("double"))


def _planes(scanlines: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The three channels of each scanline side by side."""
    return scanlines.groupBy("image_id", *extra, "y", "width").agg(
        *[F.max(F.when(F.col("ch") == c, F.col("row"))).alias(f"c{c}") for c in range(3)]
    )


def to_gray(scanlines: DataFrame, order: str = "bgr") -> DataFrame:
    # Luma weights for blue, green, red.
    weights = (0.114, 0.587, 0.299) if order == "bgr" else (0.299, 0.587, 0.114)
    p = F.arrays_zip("c0", "c1", "c2")
    gray = F.transform(p, lambda z: z["c0"] * weights[0] + z["c1"] * weights[1] + z["c2"] * weights[2])
    return _planes(scanlines).select("image_id", F.lit(0).alias("ch"), "y", "width", gray.alias("row"))


def swap_channels(scanlines: DataFrame) -> DataFrame:
    return scanlines.withColumn("ch", F.lit(2) - F.col("ch"))


def to_hsv(scanlines: DataFrame) -> DataFrame:
    """Blue, green, red bytes to hue 0..180, saturation 0..255 and value 0..255."""
    def hsv(z: Column) -> Column:
        b, g, r = z["c0"], z["c1"], z["c2"]
        top, low = F.greatest(b, g, r), F.least(b, g, r)
        span = top - low
        degrees = F.when(span == 0, 0.0).when(top == r, 60.0 * (g - b) / span).when(
            top == g, 120.0 + 60.0 * (b - r) / span
        ).otherwise(240.0 + 60.0 * (r - g) / span)
        hue = F.when(degrees < 0, degrees + 360.0).otherwise(degrees) / 2.0
        return F.struct(hue.alias("h"), F.when(top == 0, 0.0).otherwise(span * 255.0 / top).alias("s"), top.alias("v"))

    mixed = _planes(scanlines).withColumn("_z", F.transform(F.arrays_zip("c0", "c1", "c2"), hsv))
    parts = F.array(*[F.col("_z")[n] for n in ("h", "s", "v")])
    return mixed.select("image_id", "y", "width", F.posexplode(parts).alias("ch", "row")).select(
        "image_id", "ch", "y", "width", "row"
    )


def ranges(scanlines: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    return scanlines.groupBy(*keys).agg(
        F.min(F.array_min("row")).alias("lowest"), F.max(F.array_max("row")).alias("highest"),
        F.count(F.lit(1)).alias("height"), F.max(F.size("row")).cast("bigint").alias("image_width"),
    )


def normalize(scanlines: DataFrame, alpha: float, beta: float) -> DataFrame:
    """Stretch each image to [alpha, beta]."""
    low, high = min(alpha, beta), max(alpha, beta)
    span = F.col("highest") - F.col("lowest")
    scale = F.when(span > 0, (high - low) / span).otherwise(0.0)
    return map_with_image(
        scanlines, ranges(scanlines).select(*IMAGE, "lowest", scale.alias("_scale")),
        lambda v: (v - F.col("lowest")) * F.col("_scale") + low,
    )


def gamma(scanlines: DataFrame, value: float) -> DataFrame:
    if value <= 0:
        raise ValueError("gamma has to be positive")
    return map_rows(scanlines, lambda v: F.floor(clamp_byte(F.pow(v / 255.0, F.lit(value)) * 255.0)).cast("double"))


def threshold(scanlines: DataFrame, level: float) -> DataFrame:
    return map_rows(scanlines, lambda v: F.when(v > level, 255.0).otherwise(0.0))


def histogram(scanlines: DataFrame) -> DataFrame:
    return (
        scanlines.select(*IMAGE, F.explode("row").alias("v")).groupBy(*IMAGE, F.col("v").cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def otsu_levels(scanlines: DataFrame) -> DataFrame:
    """Threshold per image with the largest between-class variance (smallest on ties)."""
    by_image = Window.partitionBy(*IMAGE)  # at most 256 bins per image
    upto = by_image.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    h = histogram(scanlines).select(
        *IMAGE, "bin", F.sum("n").over(upto).alias("w1"), F.sum("n").over(by_image).alias("w"),
        F.sum(F.col("n") * F.col("bin")).over(upto).alias("s1"), F.sum(F.col("n") * F.col("bin")).over(by_image).alias("s"),
    )
    w2 = F.col("w") - F.col("w1")
    gap = F.col("s1") / F.col("w1") - (F.col("s") - F.col("s1")) / w2
    between = F.when(w2 > 0, F.col("w1").cast("double") * w2.cast("double") * gap * gap).otherwise(0.0)
    return h.groupBy(*IMAGE).agg(
        F.max(F.struct(between.alias("b"), (-F.col("bin")).alias("neg"))).alias("m")
    ).select(*IMAGE, (-F.col("m.neg")).alias("level"))


def otsu(scanlines: DataFrame) -> DataFrame:
    return map_with_image(
        scanlines, otsu_levels(scanlines), lambda v: F.when(v > F.col("level"), 255.0).otherwise(0.0)
    )


def in_range(scanlines: DataFrame, lower: Sequence[float], upper: Sequence[float]) -> DataFrame:
    """Mask of pixels with every channel inside its bounds."""
    bounds = lambda xs: F.element_at(F.array(*[F.lit(float(x)) for x in xs]), F.col("ch") + 1)
    inside = scanlines.select(
        "image_id", "ch", "y", "width",
        F.transform("row", lambda v: F.when((v >= bounds(lower)) & (v <= bounds(upper)), 255.0).otherwise(0.0)).alias("row"),
    )
    if len(lower) == 1:
        return inside
    p = F.arrays_zip("c0", "c1", "c2")
    return _planes(inside).select(
        "image_id", F.lit(0).alias("ch"), "y", "width",
        F.transform(p, lambda z: F.least(z["c0"], z["c1"], z["c2"])).alias("row"),
    )


def equalize(scanlines: DataFrame) -> DataFrame:
    """Histogram equalisation through a 256-entry table per image."""
    by_image = Window.partitionBy(*IMAGE)
    upto = by_image.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    h = histogram(scanlines).select(
        *IMAGE, "bin", F.sum("n").over(upto).alias("cdf"), F.sum("n").over(by_image).alias("total"),
        F.min_by("n", "bin").over(by_image).alias("first"),
    )
    span = F.col("total") - F.col("first")
    level = F.when(span == 0, F.col("bin").cast("double")).otherwise(
        F.rint((F.col("cdf") - F.col("first")) * (255.0 / span))
    )
    table = h.groupBy(*IMAGE).agg(F.map_from_entries(F.collect_list(F.struct("bin", level.alias("to")))).alias("_lut"))
    return map_with_image(scanlines, table, lambda v: F.col("_lut")[v.cast("int")])


def masked(v: Column, mask: Column) -> Column:
    return F.when(mask != 0, v).otherwise(0.0)


def blended(alpha: float) -> Callable[[Column, Column], Column]:
    if not 0.0 <= alpha <= 1.0:
        raise ValueError("alpha is a share, from 0 to 1")
    return lambda v, o: v * (1.0 - alpha) + o * alpha


ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda v, o: clamp_byte(v + o),
    "subtract": lambda v, o: clamp_byte(v - o),
    "multiply": lambda v, o: clamp_byte(v * o),
}
BITWISE: dict[str, Callable[[Column, Column], Column]] = {
    "and": lambda v, o: v.cast("int").bitwiseAND(o.cast("int")).cast("double"),
    "or": lambda v, o: v.cast("int").bitwiseOR(o.cast("int")).cast("double"),
    "xor": lambda v, o: v.cast("int").bitwiseXOR(o.cast("int")).cast("double"),
}


# ---------------------------------------------------------------- geometry

def with_height(scanlines: DataFrame) -> DataFrame:
    return scanlines.withColumn("height", F.count(F.lit(1)).over(Window.partitionBy(*IMAGE)))


def crop(scanlines: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    inside = scanlines.where((F.col("y") >= y) & (F.col("y") < y + height))
    return inside.withColumn("row", F.slice("row", x + 1, width)).withColumn("y", F.col("y") - y).withColumn(
        "width", F.lit(width)
    )


def flip(scanlines: DataFrame, axis: str) -> DataFrame:
    out = scanlines
    if axis in ("horizontal", "both"):
        out = out.withColumn("row", F.reverse("row"))
    if axis in ("vertical", "both"):
        out = with_height(out).withColumn("y", (F.col("height") - 1 - F.col("y")).cast("int")).drop("height")
    return out


def source_index(i: Column, n: Column, border: str) -> Column:
    """Where a position outside 0..n-1 takes its value from."""
    if border == "replicate":
        return F.greatest(F.lit(0), F.least(n - 1, i))
    if border == "wrap":
        return F.pmod(i, n)
    if border == "reflect":
        return F.when(i < 0, -i - 1).when(i >= n, 2 * n - 1 - i).otherwise(i)
    if border == "reflect101":
        return F.when(i < 0, -i).when(i >= n, 2 * n - 2 - i).otherwise(i)
    if border == "constant":
        return F.when((i >= 0) & (i < n), i)
    raise ValueError(f"Unknown border {border}.")


def pad(scanlines: DataFrame, top: int, bottom: int, left: int, right: int, border: str, value: float = 0.0) -> DataFrame:
    if min(top, bottom, left, right) < 0:
        raise ValueError("a margin has no fewer than 0 pixels")
    # Renamed, as the select below gives new meaning to ``y``, ``width`` and ``row``.
    sized = with_height(scanlines).withColumnsRenamed({"width": "_w", "row": "_row"})
    h, w = F.col("height").cast("int"), F.col("_w")
    targets = F.sequence(F.lit(-top), h + bottom - 1)
    if border == "constant":
        own = F.filter(targets, lambda i: (i == F.col("y")) | ((F.col("y") == 0) & ((i < 0) | (i >= h))))
    else:
        own = F.filter(targets, lambda i: source_index(i, h, border) == F.col("y"))
    spread = sized.withColumn("_i", F.explode(own)).withColumnRenamed("y", "_y")
    at = F.sequence(F.lit(-left), w + right - 1)
    cells = F.transform(at, lambda j: F.get(F.col("_row"), source_index(j, w, border).cast("int")))
    if border == "constant":
        outside = F.col("_i") != F.col("_y")
        cells = F.transform(cells, lambda v: F.when(outside, value).otherwise(F.coalesce(v, F.lit(value))))
    return spread.select(
        "image_id", "ch", (F.col("_i") + top).alias("y"), (w + left + right).alias("width"), cells.alias("row")
    )


def resize_nearest(scanlines: DataFrame, width: int, height: int) -> DataFrame:
    sized = with_height(scanlines).withColumnsRenamed({"width": "_w", "row": "_row"})
    own = F.filter(
        F.sequence(F.lit(0), F.lit(height - 1)),
        lambda i: F.floor(i * F.col("height") / F.lit(height)) == F.col("y"),
    )
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda j: F.get(F.col("_row"), F.floor(j * F.col("_w") / F.lit(width)).cast("int")),
    )
    return sized.select(
        "image_id", "ch", F.explode(own).alias("y"), F.lit(width).alias("width"), cells.alias("row")
    )


def shrink(scanlines: DataFrame, factor: int) -> DataFrame:
    """Area down-scale by a whole factor: mean of factor x factor cells."""
    w = F.floor(F.col("width") / factor).cast("int")
    sums = F.transform(
        F.sequence(F.lit(0), w - 1),
        lambda j: F.aggregate(F.slice("row", j * factor + 1, factor), F.lit(0.0), lambda a, v: a + v),
    )
    lines = scanlines.select("image_id", "ch", F.floor(F.col("y") / factor).cast("int").alias("y"), w.alias("width"), sums.alias("s"))
    cells = lines.select("image_id", "ch", "y", "width", F.posexplode("s").alias("x", "s"))
    means = cells.groupBy("image_id", "ch", "y", "width", "x").agg((F.sum("s") / float(factor * factor)).alias("v"))
    return means.groupBy("image_id", "ch", "y", "width").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda z: z["v"]).alias("row")
    )


def regions(scanlines: DataFrame, rois: DataFrame) -> DataFrame:
    """Scanlines of every region; a region is spread over its rows, so the join is on equality."""
    lines = rois.select(
        "image_id", "roi_id", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("width").alias("rw"),
        F.explode(F.sequence(F.col("y"), F.col("y") + F.col("height") - 1)).alias("y"),
    )
    return scanlines.join(lines, ["image_id", "y"]).select(
        "image_id", "roi_id", "ch", (F.col("y") - F.col("ry")).alias("y"), F.col("rw").alias("width"),
        F.expr("slice(row, rx + 1, rw)").alias("row"),
    )


def tiles(scanlines: DataFrame, size: int) -> DataFrame:
    n = F.ceil(F.col("width") / size).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.slice("row", j * size + 1, size))
    return scanlines.select(
        "image_id", "ch", F.floor(F.col("y") / size).cast("int").alias("tile_y"), F.pmod("y", F.lit(size)).alias("y"),
        F.posexplode(parts).alias("tile_x", "row"),
    )


# ---------------------------------------------------------------- neighbourhoods

#: Scanlines of a strip; fewer where they are wide, but never fewer than the neighbourhood needs.
STRIP_ROWS = 64
STRIP_CELLS = 65_536
BORDERS = {"reflect101": "reflect", "replicate": "edge", "constant": "constant"}


def strips(scanlines: DataFrame, above: int, below: int, columns: Sequence[str] = ("row",)) -> DataFrame:
    """Strips of each image: ``lines`` (its scanlines in order, structs), ``_ys`` and one flat array per column
    of all gathered rows, those of the strips beside it included, and ``_from``, its own first ``y``."""
    reach = max(above, below)
    size = F.greatest(F.lit(max(4 * reach, 1)), F.least(F.lit(STRIP_ROWS), F.ceil(F.lit(STRIP_CELLS) / F.greatest(F.col("width"), F.lit(1))))).cast("int")
    # A row also goes to the strips that it is within reach of.
    first, last = F.floor((F.col("y") - below) / size), F.floor((F.col("y") + above) / size)
    at = F.explode(F.sequence(F.greatest(first, F.lit(0)), last)).alias("_strip")
    placed = scanlines.select(*IMAGE, "y", F.struct("y", *[c for c in scanlines.columns if c not in (*IMAGE, "y")]).alias("_line"), size.alias("_size"), at)
    grouped = placed.groupBy(*IMAGE, "_strip", "_size").agg(F.array_sort(F.collect_list("_line")).alias("_all"))
    start = (F.col("_strip") * F.col("_size")).cast("int")
    own = F.filter("_all", lambda x: (x["y"] >= start) & (x["y"] < start + F.col("_size")))
    flat = [F.flatten(F.col(f"_all.{c}")).alias(f"_{c}") for c in columns]
    return grouped.select(*IMAGE, own.alias("lines"), F.col("_all.y").alias("_ys"), *flat, start.alias("_from")).where(F.size("lines") > 0)


def _padded(cells: np.ndarray, ys: np.ndarray, start: int, own: int, above: int, below: int, sides: int, border: str, value: float) -> np.ndarray:
    """A strip with its neighbourhood; what lies outside the image follows the border rule."""
    block = cells.reshape(len(ys), -1)
    over, under = max(0, above - (start - int(ys[0]))), max(0, below - (int(ys[-1]) - (start + own - 1)))
    fill = {"constant_values": value} if border == "constant" else {}
    return np.pad(block, ((over, under), (sides, sides)), BORDERS[border], **fill)


def on_strips(
    scanlines: DataFrame, radius: int, border: str, kernel: Callable[..., np.ndarray], value: float = 0.0,
    columns: Sequence[str] = ("row",), out: str = "row",
) -> DataFrame:
    """``scanlines`` with ``out`` computed from the neighbourhoods in ``columns``.

    ``kernel`` takes a block per column, ``radius`` cells larger than the strip on each side, and gives one as large as the strip.
    All scanlines of an image are as wide as each other.
    """

    def blocks(ys: pd.Series, starts: pd.Series, owns: pd.Series, *flat: pd.Series) -> pd.Series:
        found = np.empty(len(ys), dtype=object)
        for i, (y, start, own) in enumerate(zip(ys, starts, owns)):
            parts = [_padded(f.iloc[i], y, start, own, radius, radius, radius, border, value) for f in flat]
            found[i] = np.ascontiguousarray(kernel(*parts), dtype=np.float64).ravel()
        return pd.Series(found)

    udf = _flat_udf(blocks, len(columns))
    gathered = strips(scanlines, radius, radius, columns)
    flat = gathered.withColumn("_out", udf("_ys", "_from", F.size("lines"), *[f"_{c}" for c in columns]))
    width = (F.size("_out") / F.size("lines")).cast("int")
    rows = F.transform("lines", lambda x, i: F.struct(x.alias("line"), F.slice("_out", i * width + 1, width).alias("out")))
    kept = [c for c in scanlines.columns if c != out]
    found = flat.select(*IMAGE, F.explode(rows).alias("_x"))
    return found.select(*[F.col(c) if c in IMAGE else F.col(f"_x.line.{c}").alias(c) for c in kept], F.col("_x.out").alias(out))


def _flat_udf(run: Callable[..., pd.Series], inputs: int) -> Callable[..., Column]:
    """``run`` as a pandas UDF of the strip's place and one or two flat arrays."""
    if inputs == 2:
        def two(ys: pd.Series, starts: pd.Series, owns: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
            return run(ys, starts, owns, a, b)
        return F.pandas_udf(two, T.ArrayType(T.DoubleType()))

    def one(ys: pd.Series, starts: pd.Series, owns: pd.Series, a: pd.Series) -> pd.Series:
        return run(ys, starts, owns, a)
    return F.pandas_udf(one, T.ArrayType(T.DoubleType()))


def separable(block: np.ndarray, vertical: Sequence[float], horizontal: Sequence[float]) -> np.ndarray:
    """Weighted sum with a kernel that is the product of two vectors."""
    height, width = block.shape[0] - len(vertical) + 1, block.shape[1] - len(horizontal) + 1
    lines = sum(w * block[k:k + height] for k, w in enumerate(vertical) if w)
    return sum(w * lines[:, k:k + width] for k, w in enumerate(horizontal) if w)


def windowed(block: np.ndarray, kernel: Sequence[Sequence[float]]) -> np.ndarray:
    """Weighted sum with any small kernel, given row by row."""
    height, width = block.shape[0] - len(kernel) + 1, block.shape[1] - len(kernel[0]) + 1
    return sum(w * block[i:i + height, j:j + width] for i, line in enumerate(kernel) for j, w in enumerate(line) if w)


def shifted(block: np.ndarray, size: int) -> np.ndarray:
    """All cells of each window, stacked on a new first axis."""
    height, width = block.shape[0] - size + 1, block.shape[1] - size + 1
    return np.stack([block[i:i + height, j:j + width] for i in range(size) for j in range(size)])


def extreme(block: np.ndarray, size: int, pick: Callable) -> np.ndarray:
    """Largest or smallest cell of each window, along one side and then along the other."""
    height, width = block.shape[0] - size + 1, block.shape[1] - size + 1
    lines = block[:height]
    for k in range(1, size):
        lines = pick(lines, block[k:k + height])
    out = lines[:, :width]
    for k in range(1, size):
        out = pick(out, lines[:, k:k + width])
    return out


def gaussian_kernel(size: int, sigma: float) -> list[float]:
    if sigma <= 0:
        # Small kernels used when no sigma is given.
        small = {1: [1.0], 3: [0.25, 0.5, 0.25], 5: [0.0625, 0.25, 0.375, 0.25, 0.0625]}
        if size in small:
            return small[size]
        sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    centre = (size - 1) / 2
    raw = [math.exp(-((i - centre) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    total = sum(raw)
    return [r / total for r in raw]


def _odd(size: int) -> int:
    if size < 1 or size % 2 == 0:
        raise ValueError("Kernel size must be a positive odd number.")
    return size


def gaussian_blur(scanlines: DataFrame, size: int, sigma: float, border: str = "reflect101") -> DataFrame:
    k = gaussian_kernel(_odd(size), sigma)
    return on_strips(scanlines, size // 2, border, lambda b: separable(b, k, k))


def box_blur(scanlines: DataFrame, size: int) -> DataFrame:
    k = [1.0 / _odd(size)] * size
    return on_strips(scanlines, size // 2, "reflect101", lambda b: separable(b, k, k))


def median_blur(scanlines: DataFrame, size: int) -> DataFrame:
    if _odd(size) < 3:
        raise ValueError("Median blur needs a kernel of at least three.")
    middle = (size * size) // 2
    return on_strips(
        scanlines, size // 2, "replicate", lambda b: np.partition(shifted(b, size), middle, axis=0)[middle]
    )


def _extreme(scanlines: DataFrame, size: int, largest: bool) -> DataFrame:
    pick = np.maximum if largest else np.minimum
    outside = float("-inf") if largest else float("inf")
    return on_strips(scanlines, size // 2, "constant", lambda b: extreme(b, size, pick), outside)


def erode(mask: DataFrame, size: int = 3, iterations: int = 1) -> DataFrame:
    for _ in range(iterations):
        mask = _extreme(mask, size, largest=False)
    return mask


def dilate(mask: DataFrame, size: int = 3, iterations: int = 1) -> DataFrame:
    for _ in range(iterations):
        mask = _extreme(mask, size, largest=True)
    return mask


def morphology(mask: DataFrame, operation: str, size: int = 3) -> DataFrame:
    def against(other: DataFrame, f: Callable[[Column, Column], Column]) -> DataFrame:
        right = other.select("image_id", "ch", "y", F.col("row").alias("other_row"))
        return pair_rows(mask, right, ["image_id", "ch", "y"], f)

    if operation == "open":
        return dilate(erode(mask, size), size)
    if operation == "close":
        return erode(dilate(mask, size), size)
    if operation == "gradient":
        low = erode(mask, size).select("image_id", "ch", "y", F.col("row").alias("other_row"))
        return pair_rows(dilate(mask, size), low, ["image_id", "ch", "y"], lambda a, b: a - b)
    if operation == "top-hat":
        return against(morphology(mask, "open", size), lambda a, b: a - b)
    if operation == "black-hat":
        return against(morphology(mask, "close", size), lambda a, b: b - a)
    raise ValueError(f"Unknown morphology operation {operation}.")


# Derivative kernels.
SMOOTH, DERIVE, IDENTITY = [1.0, 2.0, 1.0], [-1.0, 0.0, 1.0], [0.0, 1.0, 0.0]
SCHARR_SMOOTH = [3.0, 10.0, 3.0]
SECOND = [1.0, -2.0, 1.0]
LAPLACIAN = {
    1: [[0.0, 1.0, 0.0], [1.0, -4.0, 1.0], [0.0, 1.0, 0.0]],
    3: [[2.0, 0.0, 2.0], [0.0, -8.0, 0.0], [2.0, 0.0, 2.0]],
}
DERIVATIVES = {0: SMOOTH, 1: DERIVE, 2: SECOND}


def _absolute(values: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(np.abs(values)), 255.0)


def sobel(scanlines: DataFrame, dx: int, dy: int) -> DataFrame:
    v, h = DERIVATIVES[dy], DERIVATIVES[dx]
    return on_strips(scanlines, 1, "reflect101", lambda b: _absolute(separable(b, v, h)))


def scharr(scanlines: DataFrame, axis: str) -> DataFrame:
    v, h = (SCHARR_SMOOTH, DERIVE) if axis == "x" else (DERIVE, SCHARR_SMOOTH)
    return on_strips(scanlines, 1, "reflect101", lambda b: _absolute(separable(b, v, h)))


def laplacian(scanlines: DataFrame, size: int = 1) -> DataFrame:
    if size not in LAPLACIAN:
        raise ValueError("Laplacian kernels of size one and three are offered.")
    kernel = LAPLACIAN[size]
    return on_strips(scanlines, 1, "reflect101", lambda b: _absolute(windowed(b, kernel)))


def adaptive_threshold(scanlines: DataFrame, block: int, constant: float) -> DataFrame:
    """Compare with the rounded Gaussian mean of the block minus a constant."""
    k = gaussian_kernel(_odd(block), 0.0)
    delta, r = float(math.ceil(constant)), block // 2

    def compare(b: np.ndarray) -> np.ndarray:
        own = b[r:b.shape[0] - r, r:b.shape[1] - r]
        mean = np.clip(np.rint(separable(b, k, k)), 0.0, 255.0)
        return np.where(own > mean - delta, 255.0, 0.0)

    return on_strips(scanlines, r, "replicate", compare)


# ---------------------------------------------------------------- components and lines

def coverage(mask: DataFrame) -> DataFrame:
    set_cells = F.size(F.filter("row", lambda v: v != 0))
    return mask.groupBy("image_id").agg((F.sum(set_cells) / F.sum(F.size("row"))).alias("score"))


def runs(mask: DataFrame) -> DataFrame:
    """Foreground runs of each scanline: ``(image_id, y, node, first, last)``."""
    on = lambda x: F.coalesce(F.get(F.col("row"), x), F.lit(0.0)) != 0
    at = F.sequence(F.lit(0), F.size("row") - 1)
    # A position before the row has no value to get, so it is tested explicitly.
    starts = F.filter(at, lambda x: on(x) & ((x == 0) | ~on(F.greatest(x - 1, F.lit(0)))))
    ends = F.filter(at, lambda x: on(x) & ~on(x + 1))
    return mask.select("image_id", "y", "width", F.arrays_zip(starts.alias("first"), ends.alias("last")).alias("_r")).select(
        "image_id", "y",
        F.transform(
            "_r", lambda r: F.struct((F.col("y") * F.col("width") + r["first"]).cast("bigint").alias("node"),
                                     r["first"].alias("first"), r["last"].alias("last"))
        ).alias("runs"),
    )


def connected_components(mask: DataFrame) -> DataFrame:
    """8-way components of a mask: runs with the smallest node id of their component.

    Inside a strip, which is bounded, runs are united where they touch. Strips then meet only at their
    borders: a run on a strip's last line and one on the next strip's first line that touch are an edge between
    what the strips call them. Those edges are contracted, in as many rounds as they take; runs are joined
    with the outcome once.
    """
    from ..sources.storage import written

    # Each strip also gets the line below it, for its border edges.
    lines = runs(mask)
    size = F.lit(STRIP_ROWS)
    own = F.floor(F.col("y") / size).cast("int")
    both = F.when((F.pmod("y", size) == 0) & (F.col("y") > 0), F.array(own, own - 1)).otherwise(F.array(own))
    placed = lines.select("image_id", "y", F.explode(both).alias("strip"), "runs").select("image_id", "y", "strip", F.explode("runs").alias("r"))
    grouped = placed.groupBy("image_id", "strip").agg(F.array_sort(F.collect_list(F.struct("y", F.col("r.first").alias("first"), F.col("r.last").alias("last"), F.col("r.node").alias("node")))).alias("runs"))

    @F.pandas_udf("labels array<bigint>, a array<bigint>, b array<bigint>")
    def united(strip: pd.Series, y: pd.Series, first: pd.Series, last: pd.Series, node: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([unite((int(s) + 1) * STRIP_ROWS, *(x.tolist() for x in r)) for s, *r in zip(strip, y, first, last, node)], columns=["labels", "a", "b"])

    local = written(grouped.withColumn("_u", united("strip", *[F.col(f"runs.{c}") for c in ("y", "first", "last", "node")])).select("image_id", "strip", "runs", "_u.labels", "_u.a", "_u.b"), "strip-runs")
    inside = local.select("image_id", "strip", F.inline(F.arrays_zip("runs", "labels"))).select("image_id", "strip", "runs.*", F.col("labels").alias("label"))
    inside = inside.where(F.floor(F.col("y") / size) == F.col("strip"))
    # The lower end of an edge is a run of the next strip; that strip knows its label.
    ends = local.select("image_id", F.explode(F.arrays_zip("a", "b")).alias("e"))
    top = inside.where(F.pmod("y", size) == 0).select("image_id", "node", F.col("label").alias("b"))
    edges = ends.select("image_id", F.col("e.a").alias("a"), F.col("e.b").alias("node")).join(top, ["image_id", "node"]).select("image_id", "a", "b")
    moved = contracted(edges)
    settled = moved.select("image_id", F.col("node").alias("label"), F.col("to").alias("_to"))
    return inside.join(settled, ["image_id", "label"], "left").select(
        "image_id", "y", "node", "first", "last", F.coalesce("_to", "label").alias("component"))


def unite(end: int, ys: list, firsts: list, lasts: list, nodes: list) -> tuple[list, list, list]:
    """Labels (smallest node) of a strip's runs in order of y and position, and edges to the line at ``end``, which is the next strip's."""
    parent = list(range(len(ys)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    above, line, border = [], [], []
    for i, y in enumerate(ys):
        if line and y != ys[line[0]]:
            above, line = line if ys[line[0]] == y - 1 else [], []
        for j in above:
            if firsts[j] <= lasts[i] + 1 and firsts[i] <= lasts[j] + 1:
                if y == end:
                    border.append((j, i))
                else:
                    a, b = sorted((root(j), root(i)))
                    parent[b] = a
        line.append(i)
    # Runs come in order, so a root is the first run of its component and has the smallest node.
    labels = [nodes[root(i)] for i in range(len(ys))]
    return labels, [labels[j] for j, _ in border], [nodes[i] for _, i in border]


def contracted(edges: DataFrame) -> DataFrame:
    """``node`` and ``to``, the smallest node it is connected with, for every node of an edge (``image_id, a, b``).

    Each round, every node moves to the neighbour that comes first in an order drawn anew by hash, or stays if it comes first itself,
    and the edges between the new places are kept, until none is left. So a long chain shrinks by a share of
    its length each round, whatever its numbers.
    """
    from ..sources.storage import checkpoint

    edges = checkpoint(edges.select("image_id", "a", "b").where("a <> b").distinct())
    moved, turn = None, 0
    while True:
        drawn = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("p"), F.col(c).alias("to"))
        ends = edges.unionByName(edges.select("image_id", F.col("b").alias("a"), F.col("a").alias("b")))
        step = ends.groupBy("image_id", F.col("a").alias("node")).agg(F.min(drawn("b")).alias("m"))
        step = checkpoint(step.select("image_id", "node", F.least("m", drawn("node"))["to"].alias("to")))
        if moved is None:
            moved = step
        else:
            onward = step.select("image_id", F.col("node").alias("to"), F.col("to").alias("_next"))
            moved = checkpoint(moved.join(onward, ["image_id", "to"], "left").select("image_id", "node", F.coalesce("_next", "to").alias("to")))
        for side in ("a", "b"):
            edges = edges.join(step.select("image_id", F.col("node").alias(side), F.col("to").alias(f"_{side}")), ["image_id", side])
        edges = checkpoint(edges.select("image_id", F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).where("a <> b").distinct())
        if edges.isEmpty():
            break
        turn += 1
    least = moved.groupBy("image_id", "to").agg(F.min("node").alias("least"))
    return moved.join(least, ["image_id", "to"]).select("image_id", "node", F.col("least").alias("to"))


def component_shapes(labelled: DataFrame) -> DataFrame:
    """Box, area, centroid and box fill of every component."""
    n = F.col("last") - F.col("first") + 1
    return labelled.groupBy("image_id", "component").agg(
        F.min("first").alias("x"), F.min("y").alias("y"),
        (F.max("last") - F.min("first") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"),
        F.sum(n).cast("bigint").alias("area"),
        (F.sum(n * (F.col("first") + F.col("last")) / 2.0) / F.sum(n)).alias("centroid_x"),
        (F.sum(n * F.col("y")) / F.sum(n)).alias("centroid_y"),
    ).withColumn("fill", F.col("area") / (F.col("width") * F.col("height")))


def line_votes(mask: DataFrame, minimum: int, steps: int = 180) -> DataFrame:
    """Votes of foreground pixels for lines (rho, theta), kept from ``minimum`` upwards.

    Tasks count the votes of each image's scanlines in their batch, so counts are shuffled, not pixels.
    """
    turns = math.pi / steps * np.arange(steps)
    cos, sin = np.round(np.cos(turns), 9), np.round(np.sin(turns), 9)

    def count(batches):
        for batch in batches:
            for image, lines in batch.groupby("image_id", sort=False):
                found = []
                for y, row in zip(lines["y"], lines["row"]):
                    x = np.flatnonzero(row)
                    rho = np.rint(np.outer(cos, x) + (y * sin)[:, None]).astype(np.int64)
                    found.append((rho + (np.arange(steps) << 32)[:, None]).ravel())
                keys, votes = np.unique(np.concatenate(found), return_counts=True)
                theta = (keys + (1 << 31)) >> 32
                yield pd.DataFrame({"image_id": image, "theta": theta, "rho": keys - (theta << 32), "votes": votes})

    kind = dict(mask.dtypes)["image_id"]
    parts = mask.select("image_id", "y", "row").mapInPandas(count, f"image_id {kind}, theta int, rho int, votes long")
    return parts.groupBy("image_id", "theta", "rho").agg(F.sum("votes").alias("votes")).where(F.col("votes") >= minimum)
