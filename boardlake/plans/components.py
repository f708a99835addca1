"""Component logic queries.

A board is an order, its detections are the order's lines; the golden board of a type is the first
order of that type with seven lines. Boards whose order is open are the good ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components as op
from .catalog import query

COST = op.MatchCost(tolerance=12.0, position=1.0, size=0.5, kind=4.0, unmatched=20.0)
RIDGE, REACH, NEIGHBOURS, LEAST_SAMPLES, LIMIT = 0.5, 30.0, 3, 30, 3.0
PARTS = 7

# Least assignments by trying every subset of a board's detections, one golden component after the other.
STEPS = ",\n".join(f"""s{k} AS MATERIALIZED (SELECT board_id, board_type, mask, min(cost) AS cost, arg_min(picks, cost) AS picks FROM (
  SELECT * FROM s{k - 1} UNION ALL
  SELECT s.board_id, s.board_type, s.mask | n.bit, s.cost + n.gain, list_append(s.picks, {{'ref': n.ref, 'det_id': n.det_id}})
  FROM s{k - 1} s JOIN near n ON n.board_id = s.board_id AND n.ref = {k} AND s.mask & n.bit = 0) GROUP BY ALL)""" for k in range(1, PARTS + 1))
MATCHED = f"""
o AS MATERIALIZED (SELECT * FROM v_component_obs), g AS MATERIALIZED (SELECT * FROM v_component_golden), boards AS MATERIALIZED (SELECT * FROM v_board),
near AS MATERIALIZED (SELECT * FROM (SELECT *, (floor(({COST.position}::double * distance + {COST.size}::double * abs(size - g_size)
     + CASE WHEN kind <> g_kind THEN {COST.kind}::double ELSE 0::double END) * {op.COST_UNIT} + 0.5::double)::bigint - {int(COST.apart * op.COST_UNIT)}) * {op.TIE_UNIT}
     + (ref * det_id * 7919 + ref * 131 + det_id) % 1009 AS gain, 1::bigint << (det_id - 1) AS bit
   FROM (SELECT o.board_id, o.board_type, o.det_id, g.ref, o.kind, g.kind AS g_kind, o.x, o.y, g.x AS gx, g.y AS gy, o.angle, g.angle AS g_angle, o.size, g.size AS g_size,
     round(sqrt((o.x - g.x) * (o.x - g.x) + (o.y - g.y) * (o.y - g.y)), 9) AS distance FROM o JOIN g ON g.board_type = o.board_type)
   WHERE distance <= {COST.tolerance}) WHERE gain < 0),
s0 AS (SELECT DISTINCT board_id, board_type, 0::bigint AS mask, 0::bigint AS cost, []::struct(ref int, det_id bigint)[] AS picks FROM near),
{STEPS},
taken AS (SELECT board_id, unnest(arg_min(picks, cost), recursive := true) FROM s{PARTS} GROUP BY board_id),
matched AS MATERIALIZED (SELECT near.board_id, board_type, g_kind AS kind, kind AS seen_kind, ref, det_id, distance, x, y, gx, gy, angle, g_angle FROM near JOIN taken USING (board_id, ref, det_id))
"""
REPORT = """
report AS MATERIALIZED (SELECT b.board_id, b.board_type, g.kind, g.ref, coalesce(m.det_id, -1) AS det_id, m.seen_kind,
  CASE WHEN m.det_id IS NULL THEN 'missing' WHEN m.seen_kind <> g.kind THEN 'wrong' ELSE 'matched' END AS state
 FROM boards b JOIN g USING (board_type) LEFT JOIN matched m ON m.board_id = b.board_id AND m.ref = g.ref
UNION ALL SELECT board_id, board_type, kind, -1, det_id, kind, 'extra' FROM o
  WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.board_id = o.board_id AND m.det_id = o.det_id))
"""
COUNTS = """
counts AS MATERIALIZED (SELECT coalesce(w.board_id, h.board_id) AS board_id, coalesce(w.board_type, h.board_type) AS board_type, coalesce(w.kind, h.kind) AS kind,
  abs(coalesce(n, 0) - coalesce(g, 0)) AS deviation
 FROM (SELECT b.board_id, b.board_type, kind, count(*) AS g FROM boards b JOIN g USING (board_type) GROUP BY ALL) w
 FULL OUTER JOIN (SELECT board_id, board_type, kind, count(*) AS n FROM o GROUP BY ALL) h ON h.board_id = w.board_id AND h.board_type = w.board_type AND h.kind = w.kind)
"""
TURN = "degrees(atan2(sin(radians(angle - g_angle)), cos(radians(angle - g_angle))))"
POSITIONS = f"""
spots AS MATERIALIZED (SELECT board_type, ref, count(*) AS samples, avg(x) AS mx, avg(y) AS my, var_pop(x) + {RIDGE} AS xx, covar_pop(x, y) AS xy, var_pop(y) + {RIDGE} AS yy
  FROM matched SEMI JOIN (SELECT board_id FROM boards WHERE good) USING (board_id) GROUP BY ALL),
placed AS MATERIALIZED (SELECT matched.*, sqrt(greatest(((x - mx) * (x - mx) * yy - 2 * (x - mx) * (y - my) * xy + (y - my) * (y - my) * xx) / (xx * yy - xy * xy), 0)) AS deviation
  FROM matched JOIN spots USING (board_type, ref))
"""


def good_only(matched, t):
    """Rows of the good boards."""
    return matched.join(t.v_board.where("good").select("board_id"), "board_id", "left_semi")


def stored_sides(t):
    """Detections and golden components, stored: a report reads both several times, and numbering the lines sorts them all."""
    from ..sources.storage import written

    return tuple(written(x, "components", compression="zstd") for x in (t.v_component_obs, t.v_component_golden))


def matched_components(t):
    return op.match_components(t.v_component_obs, t.v_component_golden, COST)


@query("j01_component_report", f"""WITH {MATCHED}, {REPORT} SELECT board_type, kind, ref, state, seen_kind, count(*) AS n, sum(board_id)::bigint AS board_sum,
  sum(det_id)::bigint AS det_sum FROM report GROUP BY ALL""")
def component_report(t):
    report = op.component_report(*stored_sides(t), COST, t.v_board)
    return report.groupBy("board_type", "kind", "ref", "state", "seen_kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum("board_id").alias("board_sum"), F.sum("det_id").alias("det_sum")
    )


@query("j01_least_assignment", f"""WITH {MATCHED} SELECT board_id, count(*) AS n_pairs, sum(ref)::bigint AS ref_sum, sum(det_id * (ref + 1))::bigint AS pair_sum,
  round(sum(distance), 5) AS distance FROM matched GROUP BY board_id""")
def least_assignment(t):
    return matched_components(t).groupBy("board_id").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum("ref").alias("ref_sum"), F.sum(F.col("det_id") * (F.col("ref") + 1)).alias("pair_sum"),
        F.round(F.sum("distance"), 5).alias("distance"),
    )


@query("j02_count_deviation", f"WITH {MATCHED}, {COUNTS} SELECT board_id, board_type, kind, deviation FROM counts")
def count_deviation(t):
    return op.count_deviation(t.v_component_obs, t.v_component_golden, t.v_board)


@query("j03_pose_deviation", f"""
WITH {MATCHED} SELECT board_id, board_type, kind, ref, det_id, round(distance, 6) AS distance, round({TURN}, 6) AS turn,
  CASE WHEN distance > 3 THEN 'misplaced' WHEN abs({TURN}) > 5.5 THEN 'rotated' ELSE 'ok' END AS state FROM matched
""")
def pose_deviation(t):
    p = op.pose_deviation(matched_components(t), 3.0, 5.5)
    # A half turn may come out with either sign.
    return p.select(
        "board_id", "board_type", "kind", "ref", "det_id", F.round("distance", 6).alias("distance"),
        F.round("turn", 6).alias("turn"), "state",
    )


@query("j03_position_deviation", f"WITH {MATCHED}, {POSITIONS} SELECT board_id, ref, det_id, round(deviation, 5) AS deviation FROM placed JOIN boards USING (board_id) WHERE NOT good")
def position_deviation(t):
    matched = saved_matches(t)
    scored = op.position_deviation(matched, op.fit_positions(good_only(matched, t), RIDGE))
    return scored.join(t.v_board.where("not good").select("board_id"), "board_id", "left_semi").select(
        "board_id", "ref", "det_id", F.round("deviation", 5).alias("deviation"))


FEATURES = f"""
dist AS MATERIALIZED (SELECT a.board_type, a.ref, b.ref AS other, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS length
  FROM g a JOIN g b ON a.board_type = b.board_type AND a.ref <> b.ref),
edges AS MATERIALIZED (SELECT DISTINCT board_type, least(ref, other) AS ref, greatest(ref, other) AS other FROM (
  SELECT * FROM dist WHERE length <= {REACH} QUALIFY row_number() OVER (PARTITION BY board_type, ref ORDER BY length, other) <= {NEIGHBOURS})),
f AS MATERIALIZED (SELECT a.board_id, a.board_type, e.ref, e.other, b.x - a.x AS dx, b.y - a.y AS dy, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS length,
   sin(radians(b.angle - a.angle)) AS turn_sin, cos(radians(b.angle - a.angle)) AS turn_cos
  FROM matched a JOIN edges e ON e.board_type = a.board_type AND e.ref = a.ref JOIN matched b ON b.board_id = a.board_id AND b.ref = e.other)
"""


def saved_matches(t):
    """The matches, stored: models are fitted on some boards and applied to others."""
    return stored_matches(matched_components(t))


def stored_matches(matched):
    from ..sources.storage import written

    return written(matched, "matched-components", compression="zstd")


def features(t, matched):
    return op.edge_features(matched, op.relation_graph(t.v_component_golden, REACH, NEIGHBOURS))


@query("j04_relation_graph", f"WITH {MATCHED}, {FEATURES} SELECT board_type, ref, other FROM edges")
def relation_graph(t):
    return op.relation_graph(t.v_component_golden, REACH, NEIGHBOURS)


@query("j04_relation_fit", f"""
WITH {MATCHED}, {FEATURES} SELECT f.board_type, ref, other, count(*) AS samples, round(avg(dx), 6) AS dx_mean, round(avg(length), 6) AS length_mean,
  round(stddev_pop(dx), 5) AS dx_std, round(stddev_pop(length), 5) AS length_std FROM f JOIN boards USING (board_id) WHERE good GROUP BY ALL
""")
def relation_fit(t):
    m = op.fit_relations(features(t, good_only(matched_components(t), t)))
    return m.select(
        "board_type", "ref", "other", "samples", *[F.round(c, 6).alias(c) for c in ("dx_mean", "length_mean")],
        *[F.round(c, 5).alias(c) for c in ("dx_std", "length_std")],
    )


Z = {f: f"(({f} - {f}_m) / greatest({f}_s, 0.1))" for f in op.RELATION_FEATURES}
FIT = ", ".join(f"avg({f}) AS {f}_m, stddev_pop({f}) AS {f}_s" for f in op.RELATION_FEATURES)
SCORED = f"""
m AS (SELECT f.board_type, ref, other, count(*) AS samples, {FIT} FROM f JOIN boards USING (board_id) WHERE good GROUP BY ALL),
scored AS MATERIALIZED (SELECT board_id, f.board_type, ref, other, greatest({', '.join(f'abs({z})' for z in Z.values())}) AS z, sqrt({' + '.join(f'{z} * {z}' for z in Z.values())}) AS distance
  FROM f JOIN m USING (board_type, ref, other) JOIN boards USING (board_id) WHERE samples >= {LEAST_SAMPLES} AND NOT good)
"""


def scored_relations(t):
    found = features(t, saved_matches(t))
    model = op.fit_relations(good_only(found, t))
    others = found.join(t.v_board.where("not good").select("board_id"), "board_id", "left_semi")
    return op.relation_scores(others, model, LEAST_SAMPLES)


@query("j04_relation_scores", f"WITH {MATCHED}, {FEATURES}, {SCORED} SELECT board_id, board_type, ref, other, round(z, 5) AS z, round(distance, 5) AS distance FROM scored")
def relation_scores(t):
    return scored_relations(t).select("board_id", "board_type", "ref", "other", F.round("z", 5).alias("z"), F.round("distance", 5).alias("distance"))


@query("j04_relation_suspects", f"""
WITH {MATCHED}, {FEATURES}, {SCORED}, ends AS (SELECT board_id, ref, distance FROM scored UNION ALL SELECT board_id, other, distance FROM scored)
SELECT board_id, ref, count(*) AS edges, count(*) FILTER (distance > {LIMIT}) AS broken, round(max(distance), 5) AS worst, 2 * count(*) FILTER (distance > {LIMIT}) > count(*) AS suspect
FROM ends GROUP BY ALL
""")
def relation_suspects(t):
    return op.relation_suspects(scored_relations(t), LIMIT).select("board_id", "ref", "edges", "broken", F.round("worst", 5).alias("worst"), "suspect")


@query("j05_logic_score", f"""
WITH {MATCHED}, {REPORT}, {COUNTS}, {POSITIONS},
 a AS (SELECT board_id, count(*) FILTER (WHERE state = 'missing') AS m, count(*) FILTER (WHERE state = 'extra') AS e, count(*) FILTER (WHERE state = 'wrong') AS w FROM report GROUP BY board_id),
 b AS (SELECT board_id, sum(deviation) AS d, sum(abs(radians({TURN}))) AS t FROM placed GROUP BY board_id),
 c AS (SELECT board_id, sum(deviation) AS n FROM counts GROUP BY board_id)
SELECT board_id, round(cast(1.0 * m + 0.5 * e + 0.75 * w AS double) + 0.1::double * coalesce(d, 0) + 0.2::double * coalesce(t, 0) + 0.3::double * coalesce(n, 0), 5) AS score
FROM a LEFT JOIN b USING (board_id) LEFT JOIN c USING (board_id)
""")
def logic_score(t):
    observed, golden = stored_sides(t)
    matched = stored_matches(op.match_components(observed, golden, COST))
    placed = op.position_deviation(matched, op.fit_positions(good_only(matched, t), RIDGE))
    poses = placed.withColumn("turn", op.angle_deviation(F.col("angle"), F.col("g_angle")))
    s = op.logic_score(
        op.component_report(observed, golden, COST, t.v_board, matched), poses, op.count_deviation(observed, golden, t.v_board),
        missing=1.0, extra=0.5, wrong=0.75, position=0.1, angle=0.2, count=0.3,
    )
    return s.select("board_id", F.round("score", 5).alias("score"))


HISTOGRAM = """
h AS (SELECT l_partkey % 50 AS board_type, l_orderkey AS board_id, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS p,
  sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS q, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS r FROM lineitem GROUP BY ALL),
m AS (SELECT board_type, avg(p) AS mp, avg(q) AS mq, avg(r) AS mr, var_pop(p) + 0.5 AS a, covar_pop(p, q) AS b, covar_pop(p, r) AS c, var_pop(q) + 0.5 AS d,
  covar_pop(q, r) AS e, var_pop(r) + 0.5 AS f FROM h GROUP BY board_type)
"""


@query("j06_area_histogram_scores", f"""
WITH {HISTOGRAM}, z AS (SELECT board_id, board_type, p - mp AS p, q - mq AS q, r - mr AS r, a, b, c, d, e, f FROM h JOIN m USING (board_type))
SELECT board_id, board_type, round(sqrt(greatest(((d * f - e * e) * p * p + (a * f - c * c) * q * q + (a * d - b * b) * r * r + 2 * ((c * e - b * f) * p * q
  + (b * e - c * d) * p * r + (b * c - a * e) * q * r)) / (a * (d * f - e * e) + b * (c * e - b * f) + c * (b * e - c * d)), 0)), 6) AS distance FROM z
""")
def area_histogram_scores(t):
    parts = t.lineitem.select(
        (F.col("l_partkey") % 50).alias("board_type"), F.col("l_orderkey").alias("board_id"),
        F.col("l_returnflag").alias("kind"), F.col("l_quantity").alias("area"),
    )
    s = op.histogram_scores(op.area_histograms(parts, ["A", "N", "R"]), 3, 0.5)
    return s.select("board_id", "board_type", F.round("distance", 6).alias("distance"))
