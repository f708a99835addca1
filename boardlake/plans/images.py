"""Image operator queries; every embedding is an 8 x 8 image."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import images as im
from .catalog import query

REFLECT = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} >= 8 THEN 14 - ({0}) ELSE {0} END"
CLAMP = "greatest(0, least(7, {0}))"


def cells(lines, digits=6):
    """Pixels of a result for comparison."""
    return im.pixels(lines).select("image_id", "ch", "y", "x", F.round("v", digits).alias("v"))


def paired(lines):
    """Each image with its group's first image as the second operand."""
    first = lines.groupBy("grp").agg(F.min("image_id").alias("image_id"))
    return lines.join(first, ["grp", "image_id"], "left_semi").select("grp", "ch", "y", F.col("row").alias("other_row"))


def combine(t, f, lines=None):
    lines = t.v_byte_scanline if lines is None else lines
    return cells(im.pair_rows(lines, paired(lines), ["grp", "ch", "y"], f))


PAIR = """
p AS (SELECT a.image_id, a.ch, a.y, a.x, a.v AS a, b.v AS b FROM v_byte a JOIN (SELECT grp, min(image_id) AS i FROM v_byte GROUP BY grp) g ON g.grp = a.grp
  JOIN v_byte b ON b.image_id = g.i AND b.y = a.y AND b.x = a.x)
"""


def stencil(offsets: str, value: str, border: str, source: str = "v_byte", name: str = "s") -> str:
    """Gather neighbours by an offset table; ``value`` aggregates ``n.v`` and ``w``."""
    if border == "ignore":
        at = "n.y = c.y + dy AND n.x = c.x + dx"
    else:
        rule = REFLECT if border == "reflect101" else CLAMP
        at = f"n.y = {rule.format('c.y + dy')} AND n.x = {rule.format('c.x + dx')}"
    return f"""{name} AS MATERIALIZED (SELECT c.image_id, c.ch, c.y, c.x, any_value(c.v) AS own, {value} AS v FROM {source} c CROSS JOIN {offsets} AS k(dy, dx, w)
 JOIN {source} n ON n.image_id = c.image_id AND n.ch = c.ch AND {at} GROUP BY c.image_id, c.ch, c.y, c.x)"""


def square(r: int, weight=lambda dy, dx: 1.0) -> str:
    rows = [(dy, dx, weight(dy, dx)) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
    return "(VALUES " + ", ".join(f"({dy}, {dx}, {w!r}::double)" for dy, dx, w in rows if w != 0) + ")"


def kernel_weights(k: list[float]):
    r = len(k) // 2
    return lambda dy, dx: k[dy + r] * k[dx + r]


def matrix_weights(m):
    return lambda dy, dx: m[dy + 1][dx + 1]


B = "(SELECT * FROM v_byte)"
ALL = "SELECT image_id, ch, y, x, round(v, 6) AS v FROM"
GRAY = """(SELECT image_id, y, x, max(v) FILTER (WHERE ch = 0) * 0.114::double + max(v) FILTER (WHERE ch = 1) * 0.587::double
  + max(v) FILTER (WHERE ch = 2) * 0.299::double AS v FROM v_colour GROUP BY image_id, y, x)"""


@query("k01_colour_to_gray", f"SELECT image_id, 0::int AS ch, y, x, round(v, 6) AS v FROM {GRAY}")
def colour_to_gray(t):
    return cells(im.to_gray(t.v_colour_scanline))


@query("k01_swap_channels", "SELECT image_id, (2 - ch)::int AS ch, y, x, v FROM v_colour")
def swap_channels(t):
    return cells(im.swap_channels(t.v_colour_scanline))


@query("k01_colour_to_hsv", """
WITH p AS (SELECT image_id, y, x, max(v) FILTER (WHERE ch = 0) AS b, max(v) FILTER (WHERE ch = 1) AS g, max(v) FILTER (WHERE ch = 2) AS r FROM v_colour GROUP BY image_id, y, x),
 q AS (SELECT *, greatest(b, g, r) AS hi, greatest(b, g, r) - least(b, g, r) AS span FROM p),
 h AS (SELECT *, CASE WHEN span = 0 THEN 0.0 WHEN hi = r THEN 60 * (g - b) / span WHEN hi = g THEN 120 + 60 * (b - r) / span ELSE 240 + 60 * (r - g) / span END AS d FROM q)
SELECT image_id, 0::int AS ch, y, x, round(CASE WHEN d < 0 THEN d + 360 ELSE d END / 2, 6) AS v FROM h
UNION ALL SELECT image_id, 1, y, x, round(CASE WHEN hi = 0 THEN 0.0 ELSE span * 255 / hi END, 6) FROM h
UNION ALL SELECT image_id, 2, y, x, hi FROM h
""")
def colour_to_hsv(t):
    return cells(im.to_hsv(t.v_colour_scanline))


@query("k02_min_max_normalize", f"""
{ALL} (SELECT image_id, ch, y, x, (v - min(v) OVER w) * (255.0::double / (max(v) OVER w - min(v) OVER w)) AS v FROM v_pixel WINDOW w AS (PARTITION BY image_id, ch))
""")
def min_max_normalize(t):
    return cells(im.normalize(t.v_scanline, 0.0, 255.0))


@query("k03_gamma", f"{ALL} (SELECT image_id, ch, y, x, floor(power(v / 255, 0.7::double) * 255) AS v FROM v_byte)")
def gamma(t):
    return cells(im.gamma(t.v_byte_scanline, 0.7))


@query("k04_global_threshold", "SELECT image_id, ch, y, x, CASE WHEN v > 130 THEN 255.0::double ELSE 0.0::double END AS v FROM v_byte")
def global_threshold(t):
    return cells(im.threshold(t.v_byte_scanline, 130))


OTSU = """
h AS (SELECT image_id, ch, cast(v AS int) AS bin, count(*) AS n FROM v_byte GROUP BY ALL),
c AS (SELECT image_id, ch, bin, sum(n) OVER w AS w1, sum(n) OVER p AS w, sum(n * bin) OVER w AS s1, sum(n * bin) OVER p AS s FROM h
  WINDOW p AS (PARTITION BY image_id, ch), w AS (PARTITION BY image_id, ch ORDER BY bin ROWS UNBOUNDED PRECEDING)),
b AS (SELECT image_id, ch, bin, CASE WHEN w > w1 THEN cast(w1 AS double) * cast(w - w1 AS double) * power(cast(s1 AS double) / cast(w1 AS double)
   - cast(s - s1 AS double) / cast(w - w1 AS double), 2) ELSE 0 END AS v FROM c),
o AS (SELECT image_id, ch, bin AS level FROM (SELECT *, row_number() OVER (PARTITION BY image_id, ch ORDER BY v DESC, bin) AS n FROM b) WHERE n = 1)
"""


@query("k05_otsu_levels", f"WITH {OTSU} SELECT image_id, level FROM o")
def otsu_levels(t):
    return im.otsu_levels(t.v_byte_scanline).select("image_id", "level")


@query("k05_otsu_threshold", f"WITH {OTSU} SELECT p.image_id, p.ch, y, x, CASE WHEN v > level THEN 255.0::double ELSE 0.0::double END AS v FROM v_byte p JOIN o USING (image_id, ch)")
def otsu_threshold(t):
    return cells(im.otsu(t.v_byte_scanline))


@query("k06_adaptive_threshold", f"""
WITH {stencil(square(1, kernel_weights([0.25, 0.5, 0.25])), "sum(w * n.v)", "replicate", B)}
SELECT image_id, ch, y, x, CASE WHEN own > round_even(v, 0) - 2 THEN 255.0::double ELSE 0.0::double END AS v FROM s
""")
def adaptive_threshold(t):
    return cells(im.adaptive_threshold(t.v_byte_scanline, 3, 1.5))


@query("k07_in_range_gray", "SELECT image_id, ch, y, x, CASE WHEN v BETWEEN 110 AND 140 THEN 255.0::double ELSE 0.0::double END AS v FROM v_byte")
def in_range_gray(t):
    return cells(im.in_range(t.v_byte_scanline, [110], [140]))


@query("k07_in_range_colour", """
SELECT image_id, 0::int AS ch, y, x, CASE WHEN bool_and(v BETWEEN 100 + ch * 5 AND 150 + ch * 5) THEN 255.0::double ELSE 0.0::double END AS v FROM v_colour GROUP BY image_id, y, x
""")
def in_range_colour(t):
    return cells(im.in_range(t.v_colour_scanline, [100, 105, 110], [150, 155, 160]))


@query("k08_histogram_equalization", """
WITH h AS (SELECT image_id, ch, v, count(*) AS n FROM v_byte GROUP BY ALL),
 c AS (SELECT image_id, ch, v, sum(n) OVER (PARTITION BY image_id, ch ORDER BY v ROWS UNBOUNDED PRECEDING) AS cdf, sum(n) OVER (PARTITION BY image_id, ch) AS total,
   first_value(n) OVER (PARTITION BY image_id, ch ORDER BY v) AS first FROM h)
SELECT p.image_id, p.ch, p.y, p.x, CASE WHEN total = first THEN p.v ELSE round_even(cast(cdf - first AS double) * (255.0::double / cast(total - first AS double)), 0) END AS v
FROM v_byte p JOIN c USING (image_id, ch, v)
""")
def histogram_equalization(t):
    return cells(im.equalize(t.v_byte_scanline))


@query("k09_apply_mask", f"WITH {PAIR} SELECT image_id, ch, y, x, CASE WHEN b > 128 THEN a ELSE 0.0::double END AS v FROM p")
def apply_mask(t):
    return combine(t, lambda v, m: im.masked(v, F.when(m > 128, 255.0).otherwise(0.0)))


@query("k09_blend", f"WITH {PAIR} SELECT image_id, ch, y, x, round(a * 0.7::double + b * 0.3::double, 6) AS v FROM p")
def blend(t):
    return combine(t, im.blended(0.3))


ARITHMETIC_SQL = {"add": "least(255, a + b)", "subtract": "greatest(0, a - b)", "multiply": "least(255, a * b)"}
BITWISE_SQL = {"and": "cast(a AS int) & cast(b AS int)", "or": "cast(a AS int) | cast(b AS int)", "xor": "xor(cast(a AS int), cast(b AS int))"}


def _pair_query(name, f, expression):
    query(name, f"WITH {PAIR} SELECT image_id, ch, y, x, cast({expression} AS double) AS v FROM p")(lambda t: combine(t, f))


for _name, _f in im.ARITHMETIC.items():
    _pair_query(f"k10_arithmetic_{_name}", _f, ARITHMETIC_SQL[_name])
for _name, _f in im.BITWISE.items():
    _pair_query(f"k10_bitwise_{_name}", _f, BITWISE_SQL[_name])


@query("k11_crop", f"{ALL} (SELECT image_id, ch, (y - 2)::int AS y, (x - 1)::int AS x, v FROM v_pixel WHERE x BETWEEN 1 AND 5 AND y BETWEEN 2 AND 5)")
def crop(t):
    return cells(im.crop(t.v_scanline, 1, 2, 5, 4))


@query("k11_flip", f"{ALL} (SELECT image_id, ch, (7 - y)::int AS y, (7 - x)::int AS x, v FROM v_pixel)")
def flip(t):
    return cells(im.flip(t.v_scanline, "both"))


PAD_RULE = {
    "replicate": CLAMP, "wrap": "(({0}) + 8) % 8", "reflect": "CASE WHEN {0} < 0 THEN -({0}) - 1 WHEN {0} >= 8 THEN 15 - ({0}) ELSE {0} END",
}


def pad_sql(border: str) -> str:
    targets = "SELECT image_id, (oy.range)::int AS y, (ox.range)::int AS x FROM (SELECT DISTINCT vec_id AS image_id FROM embeddings) CROSS JOIN range(11) oy CROSS JOIN range(13) ox"
    if border == "constant":
        return f"WITH o AS ({targets}) SELECT o.image_id, 0::int AS ch, o.y, o.x, round(coalesce(p.v, 0.5::double), 6) AS v FROM o LEFT JOIN v_pixel p ON p.image_id = o.image_id AND p.y = o.y - 1 AND p.x = o.x - 3"
    rule = PAD_RULE[border]
    return f"WITH o AS ({targets}) SELECT o.image_id, 0::int AS ch, o.y, o.x, round(p.v, 6) AS v FROM o JOIN v_pixel p ON p.image_id = o.image_id AND p.y = {rule.format('o.y - 1')} AND p.x = {rule.format('o.x - 3')}"


def _pad_query(border):
    query(f"k11_pad_{border}", pad_sql(border))(lambda t: cells(im.pad(t.v_scanline, 1, 2, 3, 2, border, 0.5)))


for _border in ("constant", "replicate", "reflect", "wrap"):
    _pad_query(_border)


@query("k11_resize_nearest", """
SELECT p.image_id, p.ch, oy.range::int AS y, ox.range::int AS x, round(p.v, 6) AS v FROM v_pixel p JOIN range(5) oy ON floor(oy.range * 8 / 5) = p.y JOIN range(13) ox ON floor(ox.range * 8 / 13) = p.x
""")
def resize_nearest(t):
    return cells(im.resize_nearest(t.v_scanline, 13, 5))


@query("k11_area_shrink", "SELECT image_id, ch, (y // 2)::int AS y, (x // 2)::int AS x, round(avg(v), 6) AS v FROM v_pixel GROUP BY image_id, ch, y // 2, x // 2")
def area_shrink(t):
    return cells(im.shrink(t.v_scanline, 2))


@query("k12_gaussian_blur", f"WITH {stencil(square(2, kernel_weights(im.gaussian_kernel(5, 1.1))), 'sum(w * n.v)', 'reflect101', '(SELECT * FROM v_pixel)')} {ALL} s")
def gaussian_blur(t):
    return cells(im.gaussian_blur(t.v_scanline, 5, 1.1))


@query("k12_box_blur", f"WITH {stencil(square(1), 'avg(n.v)', 'reflect101', '(SELECT * FROM v_pixel)')} {ALL} s")
def box_blur(t):
    return cells(im.box_blur(t.v_scanline, 3))


@query("k13_median_blur", f"WITH {stencil(square(1), 'quantile_disc(n.v, 0.5)', 'replicate', '(SELECT * FROM v_pixel)')} {ALL} s")
def median_blur(t):
    return cells(im.median_blur(t.v_scanline, 3))


MASK = "(SELECT image_id, ch, y, x, CASE WHEN v > 130 THEN 255.0::double ELSE 0.0::double END AS v FROM v_byte)"


def mask(t):
    return im.threshold(t.v_byte_scanline, 130)


def chain(*steps: str) -> str:
    """Erode (e) and dilate (d) one after the other."""
    parts, source = [], MASK
    for i, step in enumerate(steps):
        parts.append(stencil(square(1), "min(n.v)" if step == "e" else "max(n.v)", "ignore", source, f"m{i}"))
        source = f"(SELECT image_id, ch, y, x, v FROM m{i})"
    return "WITH " + ",\n".join(parts)


@query("k14_erode_twice", chain("e", "e") + " SELECT image_id, ch, y, x, v FROM m1")
def erode_twice(t):
    return cells(im.erode(mask(t), 3, 2))


@query("k14_dilate", chain("d") + " SELECT image_id, ch, y, x, v FROM m0")
def dilate(t):
    return cells(im.dilate(mask(t)))


@query("k14_open", chain("e", "d") + " SELECT image_id, ch, y, x, v FROM m1")
def morphology_open(t):
    return cells(im.morphology(mask(t), "open"))


@query("k14_close", chain("d", "e") + " SELECT image_id, ch, y, x, v FROM m1")
def morphology_close(t):
    return cells(im.morphology(mask(t), "close"))


@query("k14_gradient", chain("d") + ", " + stencil(square(1), "min(n.v)", "ignore", MASK, "e0") + " SELECT image_id, ch, y, x, m0.v - e0.v AS v FROM m0 JOIN e0 USING (image_id, ch, y, x)")
def morphology_gradient(t):
    return cells(im.morphology(mask(t), "gradient"))


@query("k14_top_hat", chain("e", "d") + " SELECT image_id, ch, y, x, p.v - m1.v AS v FROM m1 JOIN " + MASK + " p USING (image_id, ch, y, x)")
def morphology_top_hat(t):
    return cells(im.morphology(mask(t), "top-hat"))


@query("k14_black_hat", chain("d", "e") + " SELECT image_id, ch, y, x, m1.v - p.v AS v FROM m1 JOIN " + MASK + " p USING (image_id, ch, y, x)")
def morphology_black_hat(t):
    return cells(im.morphology(mask(t), "black-hat"))


def derivative_sql(matrix) -> str:
    return f"WITH {stencil(square(1, matrix_weights(matrix)), 'sum(w * n.v)', 'reflect101', B)} SELECT image_id, ch, y, x, least(round_even(abs(v), 0), 255) AS v FROM s"


def outer(vertical, horizontal):
    return [[a * b for b in horizontal] for a in vertical]


@query("k15_sobel_x", derivative_sql(outer(im.SMOOTH, im.DERIVE)))
def sobel_x(t):
    return cells(im.sobel(t.v_byte_scanline, 1, 0))


@query("k15_sobel_second_y", derivative_sql(outer(im.SECOND, im.SMOOTH)))
def sobel_second_y(t):
    return cells(im.sobel(t.v_byte_scanline, 0, 2))


@query("k15_scharr_y", derivative_sql(outer(im.DERIVE, im.SCHARR_SMOOTH)))
def scharr_y(t):
    return cells(im.scharr(t.v_byte_scanline, "y"))


@query("k15_laplacian", derivative_sql(im.LAPLACIAN[1]))
def laplacian(t):
    return cells(im.laplacian(t.v_byte_scanline))


@query("k15_laplacian_three", derivative_sql(im.LAPLACIAN[3]))
def laplacian_three(t):
    return cells(im.laplacian(t.v_byte_scanline, 3))


COMPONENTS = """
f AS MATERIALIZED (SELECT image_id, y, x, y * 8 + x AS node FROM v_byte WHERE v > 130),
r AS (SELECT image_id, node, node AS seed FROM f
  UNION SELECT a.image_id, b.node, r.seed FROM r JOIN f a ON a.image_id = r.image_id AND a.node = r.node
   JOIN f b ON b.image_id = a.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
c AS (SELECT image_id, node, min(seed) AS component FROM r GROUP BY image_id, node),
s AS (SELECT image_id, component, min(x)::int AS x, min(y)::int AS y, (max(x) - min(x) + 1)::int AS width, (max(y) - min(y) + 1)::int AS height, count(*) AS area,
  round(avg(x), 6) AS centroid_x, round(avg(y), 6) AS centroid_y, round(count(*) / ((max(x) - min(x) + 1) * (max(y) - min(y) + 1)), 6) AS fill
  FROM c JOIN f USING (image_id, node) GROUP BY image_id, component)
"""


def shapes(t):
    s = im.component_shapes(im.connected_components(mask(t)))
    return s.select(
        "image_id", F.col("component").cast("bigint").alias("component"), "x", "y", "width", "height", "area",
        *[F.round(c, 6).alias(c) for c in ("centroid_x", "centroid_y", "fill")],
    )


@query("k16_connected_components", f"WITH RECURSIVE {COMPONENTS} SELECT image_id, component::bigint AS component, x, y, width, height, area FROM s")
def connected_components(t):
    return shapes(t).drop("centroid_x", "centroid_y", "fill")


@query("k17_evidence_filter", f"WITH RECURSIVE {COMPONENTS} SELECT image_id, component::bigint AS component, area FROM s WHERE area >= 4")
def evidence_filter(t):
    return shapes(t).where("area >= 4").select("image_id", "component", "area")


@query("k18_shape_metrics", f"WITH RECURSIVE {COMPONENTS} SELECT image_id, component::bigint AS component, area, centroid_x, centroid_y, fill FROM s")
def shape_metrics(t):
    return shapes(t).select("image_id", "component", "area", "centroid_x", "centroid_y", "fill")


@query("k19_line_votes", """
SELECT image_id, theta, rho, count(*) AS votes FROM (SELECT image_id, t.range::int AS theta,
  round_even(x * round(cos(t.range * (pi() / 180)), 9) + y * round(sin(t.range * (pi() / 180)), 9), 0)::int AS rho FROM v_byte CROSS JOIN range(180) t WHERE v > 130)
GROUP BY image_id, theta, rho HAVING count(*) >= 6
""")
def line_votes(t):
    return im.line_votes(mask(t), 6)


@query("k20_mask_coverage", "SELECT image_id, round(avg(CASE WHEN v > 130 THEN 1.0 ELSE 0.0 END), 6) AS score FROM v_byte GROUP BY image_id")
def mask_coverage(t):
    return im.coverage(mask(t)).select("image_id", F.round("score", 6).alias("score"))


@query("k21_region_extraction", """
SELECT r.image_id, r.roi_id, (p.y - r.y)::int AS y, (p.x - r.x)::int AS x, round(p.v, 6) AS v FROM v_roi r JOIN v_pixel p ON p.image_id = r.image_id
 AND p.x >= r.x AND p.x < r.x + r.width AND p.y >= r.y AND p.y < r.y + r.height
""")
def region_extraction(t):
    r = im.regions(t.v_scanline, t.v_roi)
    return r.select("image_id", "roi_id", "y", F.posexplode("row").alias("x", "v")).withColumn("v", F.round("v", 6))


@query("k22_tiles", "SELECT image_id, (y // 3)::int AS tile_y, (x // 3)::int AS tile_x, (y % 3)::int AS y, (x % 3)::int AS x, round(v, 6) AS v FROM v_pixel")
def tiles(t):
    r = im.tiles(t.v_scanline, 3)
    return r.select("image_id", "tile_y", "tile_x", "y", F.posexplode("row").alias("x", "v")).withColumn("v", F.round("v", 6))
