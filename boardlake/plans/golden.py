"""Golden models fitted per pixel, and scores against golden references."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import golden as op
from ..operators import images as im
from .catalog import query

GOLDEN = "(SELECT p.* FROM v_pixel p JOIN (SELECT grp, min(image_id) AS gid FROM v_pixel GROUP BY grp) g ON g.gid = p.image_id)"
# Reflect-101 position of an offset inside 8 cells.
REFLECT = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} >= 8 THEN 14 - ({0}) ELSE {0} END"


def rounded(df, *columns):
    return df.select(*[c for c in df.columns if c not in columns], *[F.round(c, 6).alias(c) for c in columns])


def scores(maps):
    return rounded(op.image_scores(maps), "score")


@query("c11_pixel_aligned_join", f"""
SELECT p.image_id, p.y, p.x, round(p.v, 6) AS observed, round(g.v, 6) AS reference FROM v_pixel p JOIN {GOLDEN} g
  ON g.grp = p.grp AND g.ch = p.ch AND g.y = p.y AND g.x = p.x
""")
def pixel_aligned_join(t):
    both = op.against_golden(t.v_scanline, op.golden_lines(t.v_scanline))
    cells = both.select("image_id", "y", F.posexplode(F.arrays_zip("row", "other_row")).alias("x", "_z"))
    return cells.select("image_id", "y", "x", F.round("_z.row", 6).alias("observed"), F.round("_z.other_row", 6).alias("reference"))


@query("c11_shape_mismatches", """
SELECT vec_id AS image_id FROM embeddings WHERE label = 3 OR label = 9
""")
def shape_mismatches(t):
    lines = t.v_scanline
    golden = op.golden_lines(lines).where(~((F.col("grp") == 3) & (F.col("y") == 7)))
    golden = golden.withColumn("other_row", F.when(F.col("grp") == 9, F.slice("other_row", 1, 7)).otherwise(F.col("other_row")))
    return im.shape_mismatches(lines, golden, ["grp", "ch"]).distinct()


FIT = """
m AS (SELECT grp, ch, y, x, quantile_cont(v, 0.5) AS median FROM v_pixel GROUP BY grp, ch, y, x),
d AS (SELECT p.grp, p.ch, p.y, p.x, quantile_cont(abs(p.v - m.median), 0.5) AS mad FROM v_pixel p JOIN m USING (grp, ch, y, x) GROUP BY ALL)
"""


@query("l01_median_mad_fit", f"WITH {FIT} SELECT grp, y, x, round(median, 6) AS median, round(mad, 6) AS mad FROM m JOIN d USING (grp, ch, y, x)")
def median_mad_fit(t):
    return rounded(op.fit_median_mad(t.v_scanline), "median", "mad").drop("ch")


@query("l02_gaussian_fit", """
SELECT grp, y, x, round(avg(v), 6) AS mean, round(var_pop(v), 8) AS variance FROM v_pixel GROUP BY grp, ch, y, x
""")
def gaussian_fit(t):
    m = op.fit_gaussian(t.v_scanline)
    return m.select("grp", "y", "x", F.round("mean", 6).alias("mean"), F.round("variance", 8).alias("variance"))


PLANES = """
k AS (SELECT image_id, grp, y, x, max(v) FILTER (WHERE ch = 0) / 255 AS a, max(v) FILTER (WHERE ch = 1) / 255 AS b, max(v) FILTER (WHERE ch = 2) / 255 AS c
      FROM v_colour GROUP BY image_id, grp, y, x),
cm AS (SELECT grp, y, x, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, var_pop(a) AS saa, covar_pop(a, b) AS sab, covar_pop(a, c) AS sac,
      var_pop(b) AS sbb, covar_pop(b, c) AS sbc, var_pop(c) AS scc FROM k GROUP BY grp, y, x)
"""


def unit_colour(t):
    return im.map_rows(t.v_colour_scanline, lambda v: v / 255)


@query("l02_colour_gaussian_fit", f"""
WITH {PLANES} SELECT grp, y, x, round(ma, 6) AS m0, round(mb, 6) AS m1, round(mc, 6) AS m2, round(saa, 8) AS s00, round(sab, 8) AS s01, round(sac, 8) AS s02,
  round(sbb, 8) AS s11, round(sbc, 8) AS s12, round(scc, 8) AS s22 FROM cm
""")
def colour_gaussian_fit(t):
    m = op.fit_colour_gaussian(unit_colour(t))
    return m.select(
        "grp", "y", "x", *[F.round(f"m{c}", 6).alias(f"m{c}") for c in range(3)],
        *[F.round(f"s{i}{j}", 8).alias(f"s{i}{j}") for i, j in op.PAIRS],
    )


@query("l03_absolute_difference", f"""
SELECT p.image_id, round(avg(abs(p.v - g.v)), 6) AS score FROM v_pixel p JOIN {GOLDEN} g ON g.grp = p.grp AND g.y = p.y AND g.x = p.x GROUP BY p.image_id
""")
def absolute_difference(t):
    return scores(op.absolute_difference(t.v_scanline, op.golden_lines(t.v_scanline)))


def local_means(kernel: list[float]) -> str:
    r = len(kernel) // 2
    k = ", ".join(f"({i - r}, {w!r}::double)" for i, w in enumerate(kernel))
    return f"""
b AS MATERIALIZED (SELECT p.image_id, p.y, p.x, p.v AS a, g.v AS b FROM v_pixel p JOIN {GOLDEN} g ON g.grp = p.grp AND g.y = p.y AND g.x = p.x),
kv AS (SELECT * FROM (VALUES {k}) AS t(o, w)),
vert AS MATERIALIZED (SELECT c.image_id, c.y, c.x, sum(w * s.a) AS ma, sum(w * s.b) AS mb, sum(w * s.a * s.a) AS aa, sum(w * s.b * s.b) AS bb, sum(w * s.a * s.b) AS ab
  FROM b c CROSS JOIN kv JOIN b s ON s.image_id = c.image_id AND s.x = c.x AND s.y = {REFLECT.format('c.y + o')} GROUP BY c.image_id, c.y, c.x),
means AS (SELECT c.image_id, c.y, c.x, sum(w * s.ma) AS ma, sum(w * s.mb) AS mb, sum(w * s.aa) AS aa, sum(w * s.bb) AS bb, sum(w * s.ab) AS ab
  FROM vert c CROSS JOIN kv JOIN vert s ON s.image_id = c.image_id AND s.y = c.y AND s.x = {REFLECT.format('c.x + o')} GROUP BY c.image_id, c.y, c.x)
"""


@query("l04_structural_similarity", f"""
WITH {local_means(im.gaussian_kernel(7, max(0.5, 1.5 * 7 / 11.0)))}
SELECT image_id, round(avg((1 - greatest(-1, least(1, ((2 * ma * mb + 0.0001::double) * (2 * (ab - ma * mb) + 0.0009::double))
 / ((ma * ma + mb * mb + 0.0001::double) * (aa - ma * ma + bb - mb * mb + 0.0009::double))))) / 2), 6) AS score FROM means GROUP BY image_id
""")
def structural_similarity(t):
    return scores(op.structural_similarity(t.v_scanline, op.golden_lines(t.v_scanline), 7))


@query("l05_cross_correlation", f"""
WITH {local_means([1 / 7] * 7)},
 s AS (SELECT *, sqrt(greatest(aa - ma * ma, 0) * greatest(bb - mb * mb, 0)) AS sp FROM means)
SELECT image_id, round(avg((1 - greatest(-1, least(1, CASE WHEN sp <= 1e-8 AND abs(ma - mb) <= 1e-6 THEN 1.0 WHEN sp > 1e-8 THEN (ab - ma * mb) / sp ELSE 0.0 END))) / 2), 6) AS score
FROM s GROUP BY image_id
""")
def cross_correlation(t):
    return scores(op.cross_correlation(t.v_scanline, op.golden_lines(t.v_scanline), 8))


def gradients(source: str, name: str) -> str:
    k = "(VALUES (-1,-1,-1,-1),(-1,0,0,-2),(-1,1,1,-1),(0,-1,-2,0),(0,1,2,0),(1,-1,-1,1),(1,0,0,2),(1,1,1,1)) AS k(dy, dx, wx, wy)"
    return f"""{name} AS MATERIALIZED (SELECT c.image_id, c.grp, c.y, c.x, sqrt(power(sum(wx * s.v), 2) + power(sum(wy * s.v), 2)) AS g FROM {source} c CROSS JOIN {k}
  JOIN {source} s ON s.image_id = c.image_id AND s.y = {REFLECT.format('c.y + dy')} AND s.x = {REFLECT.format('c.x + dx')} GROUP BY c.image_id, c.grp, c.y, c.x)"""


GRADIENTS = f"WITH gp AS MATERIALIZED (SELECT * FROM v_pixel), {gradients('gp', 'ga')}, gb AS (SELECT a.* FROM ga a JOIN (SELECT grp, min(image_id) AS i FROM ga GROUP BY grp) m ON m.i = a.image_id)"


@query("l06_edge_difference", GRADIENTS + """
SELECT a.image_id, round(avg(CASE WHEN (a.g > 0.5) <> (b.g > 0.5) THEN 1.0 ELSE 0.0 END), 6) AS score FROM ga a JOIN gb b ON b.grp = a.grp AND b.y = a.y AND b.x = a.x GROUP BY a.image_id
""")
def edge_difference(t):
    return scores(op.edge_difference(t.v_scanline, op.golden_lines(t.v_scanline), 0.5))


@query("l07_gradient_difference", GRADIENTS + """
SELECT a.image_id, round(avg(least(1, abs(a.g - b.g) / (4 * sqrt(2)))), 6) AS score FROM ga a JOIN gb b ON b.grp = a.grp AND b.y = a.y AND b.x = a.x GROUP BY a.image_id
""")
def gradient_difference(t):
    return scores(op.gradient_difference(t.v_scanline, op.golden_lines(t.v_scanline)))


@query("l08_robust_score", f"""
WITH {FIT} SELECT p.image_id, round(avg(1 - exp(-abs(p.v - median) / (1.4826::double * mad + 0.001::double))), 6) AS score
FROM v_pixel p JOIN m USING (grp, ch, y, x) JOIN d USING (grp, ch, y, x) GROUP BY p.image_id
""")
def robust_score(t):
    lines = t.v_scanline
    return rounded(op.image_scores(op.robust_map(lines, op.fit_median_mad(lines))), "score")


@query("l09_mahalanobis_score", """
WITH g AS (SELECT grp, y, x, avg(v) AS mu, var_pop(v) AS var FROM v_pixel GROUP BY grp, y, x)
SELECT image_id, round(avg(1 - exp(-0.5 * (v - mu) * (v - mu) / (var + 0.001::double))), 6) AS score FROM v_pixel JOIN g USING (grp, y, x) GROUP BY image_id
""")
def mahalanobis_score(t):
    lines = t.v_scanline
    return rounded(op.image_scores(op.mahalanobis_map(lines, op.fit_gaussian(lines))), "score")


@query("l09_colour_mahalanobis_score", f"""
WITH {PLANES}, r AS (SELECT k.image_id, a - ma AS p, b - mb AS q, c - mc AS s, saa + 0.001::double AS aa, sab AS ab, sac AS ac, sbb + 0.001::double AS bb, sbc AS bc, scc + 0.001::double AS cc
  FROM k JOIN cm USING (grp, y, x)),
 z AS (SELECT *, bb * cc - bc * bc AS i00, ac * bc - ab * cc AS i01, ab * bc - ac * bb AS i02, aa * cc - ac * ac AS i11, ab * ac - aa * bc AS i12, aa * bb - ab * ab AS i22 FROM r)
SELECT image_id, round(avg(1 - exp(-0.5 * greatest((i00 * p * p + i11 * q * q + i22 * s * s + 2 * (i01 * p * q + i02 * p * s + i12 * q * s))
  / (aa * i00 + ab * i01 + ac * i02), 0))), 6) AS score FROM z GROUP BY image_id
""")
def colour_mahalanobis_score(t):
    lines = unit_colour(t)
    return rounded(op.image_scores(op.colour_mahalanobis_map(lines, op.fit_colour_gaussian(lines))), "score")


def masks(t):
    return im.map_rows(t.v_scanline, lambda v: F.when(v > 0.52, 255.0).otherwise(0.0))


@query("l10_mask_xor", f"""
SELECT p.image_id, round(avg(CASE WHEN (p.v > 0.52) <> (g.v > 0.52) THEN 1.0 ELSE 0.0 END), 6) AS score
FROM v_pixel p JOIN {GOLDEN} g ON g.grp = p.grp AND g.y = p.y AND g.x = p.x GROUP BY p.image_id
""")
def mask_xor(t):
    m = masks(t)
    return scores(op.mask_xor(m, op.golden_lines(m)))


def templates(t):
    """A 3 x 3 patch at (2, 3) of each group's golden image."""
    lines = op.golden_lines(t.v_scanline).where("y BETWEEN 3 AND 5")
    return lines.groupBy("grp").agg(
        F.array_sort(F.collect_list(F.struct("y", F.slice("other_row", 3, 3).alias("r"))))["r"].alias("template")
    )


def match_sql(method: str) -> str:
    value = {
        "sqdiff": "vv - 2 * vt + t2", "sqdiff-normed": "(vv - 2 * vt + t2) / sqrt(t2 * vv)", "ccorr-normed": "vt / sqrt(t2 * vv)",
        "ccoeff-normed": "(vt - v1 * t1 / 9) / sqrt((t2 - t1 * t1 / 9) * (vv - v1 * v1 / 9))",
    }[method]
    order = "m" if method.startswith("sqdiff") else "-m"
    quality = {"sqdiff": "CASE WHEN m <= 1e-12 THEN 1.0 ELSE 1 / (1 + m) END", "sqdiff-normed": "1 - m"}.get(method, "m")
    return f"""
WITH tp AS MATERIALIZED (SELECT grp, y - 3 AS dy, x - 2 AS dx, v AS w FROM {GOLDEN} WHERE y BETWEEN 3 AND 5 AND x BETWEEN 2 AND 4),
 px AS MATERIALIZED (SELECT * FROM v_pixel),
 s AS (SELECT p.image_id, p.y - dy AS y, p.x - dx AS x, sum(p.v * w) AS vt, sum(p.v * p.v) AS vv, sum(p.v) AS v1, sum(w) AS t1, sum(w * w) AS t2
   FROM px p JOIN tp USING (grp) WHERE p.y - dy BETWEEN 0 AND 5 AND p.x - dx BETWEEN 0 AND 5 GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {order}, y, x) AS n FROM (SELECT image_id, y, x, round({value}, 9) AS m FROM s))
SELECT image_id, x, y, 3::int AS width, 3::int AS height, round(greatest(0, least(1, {quality})), 6) AS quality FROM r WHERE n = 1
"""


def _match(method):
    def run(t):
        found = op.template_matches(t.v_scanline, templates(t), 3, method)
        return rounded(found.drop("score"), "quality")

    return run


for _method in ("sqdiff", "sqdiff-normed", "ccorr-normed", "ccoeff-normed"):
    query(f"l11_template_match_{_method.replace('-', '_')}", match_sql(_method))(_match(_method))


@query("l12_image_score_decision", f"""
SELECT p.image_id, round(avg(abs(p.v - g.v)), 6) AS score, CASE WHEN avg(abs(p.v - g.v)) >= 0.07 THEN 'FAIL' ELSE 'PASS' END AS decision
FROM v_pixel p JOIN {GOLDEN} g ON g.grp = p.grp AND g.y = p.y AND g.x = p.x GROUP BY p.image_id
""")
def image_score_decision(t):
    s = op.image_scores(op.absolute_difference(t.v_scanline, op.golden_lines(t.v_scanline)))
    return s.select(
        "image_id", F.round("score", 6).alias("score"), F.when(F.col("score") >= 0.07, "FAIL").otherwise("PASS").alias("decision")
    )
