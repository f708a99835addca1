"""Component logic on detections: assignment, counts, deviations, relations and composite scores."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import written

#: Costs are compared in millionths; within one, pairs are told apart by a small term of their numbers.
COST_UNIT = 1_000_000
TIE_UNIT = 1024


@dataclass(frozen=True)
class MatchCost:
    """Cost of giving a detection to a golden component, and of leaving the two alone.

    ``position`` counts per unit of distance, ``size`` per unit of size difference (both tables then
    have ``size``), ``kind`` once if the kinds differ (null: such pairs are not made).
    """

    tolerance: float
    position: float = 1.0
    size: float = 0.0
    kind: float | None = None
    unmatched: float | None = None

    @property
    def apart(self) -> float:
        """Cost of a missing and an extra component; by default any pair in reach is better."""
        if self.unmatched is not None:
            return self.unmatched
        return 1e6


def pair_costs(observed: DataFrame, golden: DataFrame, cost: MatchCost) -> DataFrame:
    """Pairs in reach that are better than none, with ``cost`` as a whole number.

    Candidates meet through grid cells as wide as the tolerance: a golden component is
    placed in its cell and the eight around it, so a detection joins only what can be in
    reach. Of a golden component's candidates an assignment never needs more than the cheapest
    ones, as many as its board type has golden components: one of them is free whatever the others take. The
    rest go before any board is gathered, so a board holds a bounded number of pairs.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(float(cost.tolerance))).cast("bigint")
    spread = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    sized = bool(cost.size)
    parts = golden.groupBy(F.col("board_type").alias("_bt")).agg(F.count(F.lit(1)).alias("_parts"))
    g = golden.select(
        "board_type", "ref", F.col("kind").alias("g_kind"), F.col("x").alias("gx"), F.col("y").alias("gy"), F.col("angle").alias("g_angle"),
        (F.col("size") if sized else F.lit(0.0)).alias("g_size"), cell("x").alias("_cx"), cell("y").alias("_cy"),
    ).join(parts, F.col("board_type") == F.col("_bt")).drop("_bt")
    g = g.withColumn("_dx", F.explode(spread)).withColumn("_dy", F.explode(spread))
    g = g.withColumn("_cx", F.col("_cx") + F.col("_dx")).withColumn("_cy", F.col("_cy") + F.col("_dy")).drop("_dx", "_dy")
    o = observed.select("board_id", "board_type", "det_id", "kind", "x", "y", "angle", (F.col("size") if sized else F.lit(0.0)).alias("size"), cell("x").alias("_cx"), cell("y").alias("_cy"))
    dx, dy = F.col("x") - F.col("gx"), F.col("y") - F.col("gy")
    near = o.join(g, ["board_type", "_cx", "_cy"]).withColumn("distance", F.round(F.sqrt(dx * dx + dy * dy), 9))
    other = F.col("kind") != F.col("g_kind")
    price = F.lit(float(cost.position)) * F.col("distance")
    if sized:
        price = price + F.lit(float(cost.size)) * F.abs(F.col("size") - F.col("g_size"))
    if cost.kind is not None:
        price = price + F.when(other, F.lit(float(cost.kind))).otherwise(0.0)
    else:
        near = near.where(~other)
    # A product, so that two pairs do not weigh the same with their detections exchanged.
    tie = F.pmod(F.col("ref") * F.col("det_id") * 7919 + F.col("ref") * 131 + F.col("det_id"), F.lit(1009))
    near = near.where(F.col("distance") <= cost.tolerance).withColumn(
        "cost", F.floor(price * COST_UNIT + 0.5).cast("bigint") * TIE_UNIT + tie.cast("bigint"))
    near = near.where(F.col("cost") < _whole(cost.apart)).drop("_cx", "_cy")
    cheapest = Window.partitionBy("board_id", "board_type", "ref").orderBy("cost", "det_id")
    return near.withColumn("_nth", F.row_number().over(cheapest)).where(F.col("_nth") <= F.col("_parts")).drop("_nth", "_parts")


def _whole(cost: float) -> int:
    return int(cost * COST_UNIT + 0.5) * TIE_UNIT


def least_assignment(refs: list, dets: list, costs: list, apart: int) -> list[tuple]:
    """Pairs (ref, det) of least total cost, a ref without one costing ``apart``.

    References join one after the other, each by the shortest path of exchanges (with node
    prices that keep every step non-negative) to a free detection or to staying alone.
    """
    by_ref: dict = {}
    paid = {(r, d): c for r, d, c in zip(refs, dets, costs)}
    for (r, d), c in paid.items():
        by_ref.setdefault(r, []).append((d, c))
    first = {r: min(options, key=lambda x: (x[1], x[0])) for r, options in by_ref.items()}
    if len({d for d, _ in first.values()}) == len(first):  # nobody is in another's way
        return sorted((r, d) for r, (d, _) in first.items())
    for r, options in by_ref.items():
        options.append((("alone", r), apart))
        paid[r, ("alone", r)] = apart
    taker: dict = {}
    taken: dict = {}
    price: dict = {}
    for start in sorted(by_ref):
        dist: dict = {}
        came: dict = {}
        done = set()
        heap: list = []
        order, ref, base = 0, start, 0
        while True:
            for d, c in by_ref[ref]:
                at = base + c - price.get(d, 0)
                if d not in done and at < dist.get(d, at + 1):
                    dist[d], came[d] = at, ref
                    order += 1
                    heapq.heappush(heap, (at, order, d))
            while True:
                at, _, d = heapq.heappop(heap)
                if d not in done and at == dist[d]:
                    break
            done.add(d)
            if d not in taker:
                end = d
                break
            # Going on through the reference that holds d gives d back at what it paid.
            ref = taker[d]
            base = at - (paid[ref, d] - price.get(d, 0))
        length = dist[end]
        for d in done:
            price[d] = price.get(d, 0) + dist[d] - length
        d = end
        while True:
            r = came[d]
            before = taken.get(r)
            taken[r], taker[d] = d, r
            if r == start:
                break
            d = before
    return sorted((r, d) for r, d in taken.items() if not isinstance(d, tuple))


def match_components(observed: DataFrame, golden: DataFrame, tolerance: float | MatchCost) -> DataFrame:
    """One-to-one pairs of detections and golden components, of least total cost on each board.

    One gathering per board, of its candidate pairs alone; see ``pair_costs`` for their bound. A plain
    number for ``tolerance`` means distance as cost and equal kinds only. ``kind`` is that of the
    golden component, ``seen_kind`` that of the detection.
    """
    cost = tolerance if isinstance(tolerance, MatchCost) else MatchCost(float(tolerance))
    apart = _whole(cost.apart)
    near = pair_costs(observed, golden, cost)
    kept = ["ref", "cost", "det_id", "distance", "g_kind", "kind", "x", "y", "gx", "gy", "angle", "g_angle", "size", "g_size"]
    boards = near.groupBy("board_id", "board_type").agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("pairs"))
    # Pairs come by reference, each one's cheapest first.
    first = F.filter("pairs", lambda p, i: (i == 0) | (F.get("pairs", i - 1)["ref"] != p["ref"]))
    boards = boards.withColumn("first", first)

    @F.pandas_udf("array<int>")
    def chosen(refs: pd.Series, dets: pd.Series, costs: pd.Series) -> pd.Series:
        out = []
        for r, d, c in zip(refs, dets, costs):
            if r is None:
                out.append(None)
                continue
            r, d = r.tolist(), d.tolist()
            at = {pair: k for k, pair in enumerate(zip(r, d))}
            out.append([at[pair] for pair in least_assignment(r, d, c.tolist(), apart)])
        return pd.Series(out, dtype=object)

    # Where the cheapest pairs take different detections nobody is in another's way, and no choice is needed.
    crowded = F.size(F.array_distinct("first.det_id")) < F.size("first")
    picked = chosen(*[F.when(crowded, F.col(f"pairs.{c}")) for c in ("ref", "det_id", "cost")])
    boards = boards.withColumn("_picked", picked)
    matched = F.when(F.col("_picked").isNull(), F.col("first")).otherwise(F.transform("_picked", lambda k: F.get("pairs", k)))
    return boards.select("board_id", "board_type", F.explode(matched).alias("p")).select(
        "board_id", "board_type", F.col("p.g_kind").alias("kind"), "p.ref", "p.det_id", "p.distance", "p.x", "p.y", "p.gx", "p.gy",
        "p.angle", "p.g_angle", F.col("p.kind").alias("seen_kind"), (F.floor(F.col("p.cost") / TIE_UNIT) / COST_UNIT).alias("cost"),
    )


def board_list(observed: DataFrame, boards: DataFrame | None = None) -> DataFrame:
    """Boards with their type; without a list of ``boards``, those that have a detection."""
    return (observed if boards is None else boards).select("board_id", "board_type").distinct()


def expected_components(observed: DataFrame, golden: DataFrame, boards: DataFrame | None = None) -> DataFrame:
    """Golden components each board should have, boards without any detection too if listed."""
    boards = board_list(observed, boards)
    return boards.join(golden.select("board_type", "ref", "kind"), "board_type")


def component_report(
    observed: DataFrame, golden: DataFrame, tolerance: float | MatchCost, boards: DataFrame | None = None, matched: DataFrame | None = None,
) -> DataFrame:
    """Golden components matched, taken by a wrong object or missing, and extra detections.

    ``kind`` is that of the golden component, for extra ones the detection's; ``seen_kind`` is what was found.
    ``matched`` is what ``match_components`` has found for the same tables; it is read twice, so without it the
    pairs are worked out once and stored.
    """
    keys = ["board_id", "board_type"]
    if matched is None:
        found = match_components(observed, golden, tolerance).select(*keys, "ref", "det_id", "seen_kind")
        matched = written(found, "component-pairs", compression="zstd")
    pairs = matched.select(*keys, F.col("ref").alias("_ref"), F.col("det_id").alias("_det"), "seen_kind")
    want = expected_components(observed, golden, boards)
    on_ref = [want[k] == pairs[k] for k in keys] + [want["ref"] == pairs["_ref"]]
    state = F.when(F.col("_det").isNull(), "missing").when(F.col("kind") != F.col("seen_kind"), "wrong").otherwise("matched")
    found = want.join(pairs, on_ref, "left").select(
        want["board_id"], want["board_type"], "kind", "ref", F.coalesce("_det", F.lit(-1)).cast("bigint").alias("det_id"), "seen_kind", state.alias("state"))
    on_det = [observed[k] == pairs[k] for k in keys] + [observed["det_id"] == pairs["_det"]]
    extra = observed.join(pairs, on_det, "left_anti").select(
        *keys, "kind", F.lit(-1).alias("ref"), F.col("det_id").cast("bigint").alias("det_id"), F.col("kind").alias("seen_kind"), F.lit("extra").alias("state"))
    return found.unionByName(extra)


def count_deviation(observed: DataFrame, golden: DataFrame, boards: DataFrame | None = None) -> DataFrame:
    """Absolute difference of component counts per board and kind."""
    have = observed.groupBy("board_id", "board_type", "kind").agg(F.count(F.lit(1)).alias("n"))
    want = golden.groupBy("board_type", "kind").agg(F.count(F.lit(1)).alias("g"))
    expected = board_list(observed, boards).join(want, "board_type")
    return expected.join(have, ["board_id", "board_type", "kind"], "full_outer").select(
        "board_id", "board_type", "kind",
        F.abs(F.coalesce("n", F.lit(0)) - F.coalesce("g", F.lit(0))).alias("deviation"),
    )


def angle_deviation(a: Column, b: Column) -> Column:
    """Smallest signed angle from ``b`` to ``a`` in degrees."""
    d = F.radians(a - b)
    return F.degrees(F.atan2(F.sin(d), F.cos(d)))


def pose_deviation(matched: DataFrame, position_tolerance: float, angle_tolerance: float) -> DataFrame:
    turn = angle_deviation(F.col("angle"), F.col("g_angle"))
    return matched.withColumn("turn", turn).withColumn(
        "state",
        F.when(F.col("distance") > position_tolerance, "misplaced")
        .when(F.abs("turn") > angle_tolerance, "rotated").otherwise("ok"),
    )


def fit_positions(matched: DataFrame, ridge: float) -> DataFrame:
    """Mean position of each golden component and the inverse of its covariance, from good boards.

    ``ridge`` is added to both variances, so one sample gives a circle of that size.
    """
    a, b, c = F.var_pop("x") + F.lit(ridge), F.covar_pop("x", "y"), F.var_pop("y") + F.lit(ridge)
    stats = matched.groupBy("board_type", "ref").agg(
        F.count(F.lit(1)).alias("samples"), F.avg("x").alias("x_mean"), F.avg("y").alias("y_mean"), a.alias("xx"), b.alias("xy"), c.alias("yy"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    return stats.select(
        "board_type", "ref", "samples", "x_mean", "y_mean",
        (F.col("yy") / det).alias("inv_xx"), (-F.col("xy") / det).alias("inv_xy"), (F.col("xx") / det).alias("inv_yy"),
    )


def position_deviation(matched: DataFrame, model: DataFrame) -> DataFrame:
    """``deviation``: the distance from the component's mean in units of its tolerance covariance."""
    dx, dy = F.col("x") - F.col("x_mean"), F.col("y") - F.col("y_mean")
    square = dx * dx * F.col("inv_xx") + 2 * dx * dy * F.col("inv_xy") + dy * dy * F.col("inv_yy")
    return matched.join(model, ["board_type", "ref"]).withColumn("deviation", F.sqrt(F.greatest(square, F.lit(0.0))))


# ---------------------------------------------------------------- relations

def relation_graph(golden: DataFrame, reach: float, neighbours: int) -> DataFrame:
    """Undirected edges (``ref`` < ``other``) between golden components of a board type.

    Each component is joined with its ``neighbours`` nearest ones within ``reach``, ties to the
    smaller reference. They meet through grid cells as wide as ``reach``, so far ones never do, and edges
    are linear in the components.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(float(reach))).cast("bigint")
    spread = F.array(*[F.lit(d) for d in (-1, 0, 1)])
    here = golden.select("board_type", "ref", "x", "y", cell("x").alias("_cx"), cell("y").alias("_cy"))
    around = here.select(
        "board_type", F.col("ref").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"),
        "_cx", "_cy", F.explode(spread).alias("_dx"),
    ).withColumn("_dy", F.explode(spread))
    around = around.withColumn("_cx", F.col("_cx") + F.col("_dx")).withColumn("_cy", F.col("_cy") + F.col("_dy"))
    dx, dy = F.col("ox") - F.col("x"), F.col("oy") - F.col("y")
    near = here.join(around, ["board_type", "_cx", "_cy"]).where("ref <> other").withColumn("length", F.sqrt(dx * dx + dy * dy))
    nearest = Window.partitionBy("board_type", "ref").orderBy("length", "other")
    kept = near.where(F.col("length") <= reach).withColumn("_nth", F.row_number().over(nearest)).where(F.col("_nth") <= neighbours)
    return kept.select("board_type", F.least("ref", "other").alias("ref"), F.greatest("ref", "other").alias("other")).distinct()


def edge_features(matched: DataFrame, edges: DataFrame) -> DataFrame:
    """Offsets and relative angle along the graph's edges, where both ends were found."""
    a = matched.select("board_id", "board_type", "ref", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("angle").alias("aa"))
    b = matched.select("board_id", "board_type", F.col("ref").alias("other"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("angle").alias("ba"))
    dx, dy, turn = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.radians(F.col("ba") - F.col("aa"))
    return a.join(edges, ["board_type", "ref"]).join(b, ["board_id", "board_type", "other"]).select(
        "board_id", "board_type", "ref", "other", dx.alias("dx"), dy.alias("dy"), F.sqrt(dx * dx + dy * dy).alias("length"),
        F.sin(turn).alias("turn_sin"), F.cos(turn).alias("turn_cos"),
    )


RELATION_FEATURES = ["dx", "dy", "length", "turn_sin", "turn_cos"]


def fit_relations(features: DataFrame) -> DataFrame:
    """Mean and spread of each edge's features over the given (good) boards."""
    return features.groupBy("board_type", "ref", "other").agg(
        F.count(F.lit(1)).alias("samples"),
        *[F.avg(f).alias(f"{f}_mean") for f in RELATION_FEATURES],
        *[F.stddev_pop(f).alias(f"{f}_std") for f in RELATION_FEATURES],
    )


def relation_scores(features: DataFrame, model: DataFrame, least_samples: int = 30, floor: float = 0.1) -> DataFrame:
    """Largest and joint deviation of each edge whose Gaussian has enough samples.

    Spreads below ``floor`` count as ``floor``.
    """
    z = [(F.col(f) - F.col(f"{f}_mean")) / F.greatest(F.col(f"{f}_std"), F.lit(floor)) for f in RELATION_FEATURES]
    joint = F.sqrt(sum((x * x for x in z[1:]), z[0] * z[0]))
    return features.join(model.where(F.col("samples") >= least_samples), ["board_type", "ref", "other"]).select(
        "board_id", "board_type", "ref", "other", F.greatest(*[F.abs(x) for x in z]).alias("z"), joint.alias("distance")
    )


def relation_suspects(scores: DataFrame, limit: float) -> DataFrame:
    """Per component of a board: its edges, those beyond ``limit``, and whether most are.

    A component in the wrong place breaks most of its edges at once, its neighbours only one each.
    """
    ends = scores.select("board_id", "board_type", F.explode(F.array("ref", "other")).alias("ref"), "distance")
    broken = F.count_if(F.col("distance") > limit)
    return ends.groupBy("board_id", "board_type", "ref").agg(
        F.count(F.lit(1)).alias("edges"), broken.alias("broken"), F.max("distance").alias("worst"),
    ).withColumn("suspect", 2 * F.col("broken") > F.col("edges"))


def logic_score(
    report: DataFrame, poses: DataFrame, counts: DataFrame, *, missing: float, extra: float, wrong: float, position: float, angle: float, count: float
) -> DataFrame:
    """Weighted sum of missing, extra and wrong components, deviations and count differences per board.

    ``poses`` has ``deviation`` and ``turn`` of each matched component.
    """
    states = [F.count_if(F.col("state") == x).alias(f"n_{x}") for x in ("missing", "extra", "wrong")]
    a = report.groupBy("board_id").agg(*states)
    b = poses.groupBy("board_id").agg(F.sum("deviation").alias("sum_deviation"), F.sum(F.abs(F.radians("turn"))).alias("sum_turn"))
    c = counts.groupBy("board_id").agg(F.sum("deviation").alias("sum_count"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0.0))
    return a.join(b, "board_id", "left").join(c, "board_id", "left").select(
        "board_id",
        (missing * F.col("n_missing") + extra * F.col("n_extra") + wrong * F.col("n_wrong") + position * zero("sum_deviation")
         + angle * zero("sum_turn") + count * zero("sum_count")).alias("score"),
    )


# ---------------------------------------------------------------- area histograms

def area_histograms(components: DataFrame, kinds: list[str]) -> DataFrame:
    """Total area per kind as one vector per board."""
    sums = [F.sum(F.when(F.col("kind") == k, F.col("area")).otherwise(0.0)) for k in kinds]
    return components.groupBy("board_type", "board_id").agg(F.array(*sums).alias("h"))


def histogram_scores(histograms: DataFrame, size: int, ridge: float) -> DataFrame:
    """Mahalanobis distance of a board's histogram to its board type.

    Means and covariances come from plain aggregates; the small solve runs per batch.
    """
    at = [F.col("h")[i] for i in range(size)]
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    model = histograms.groupBy("board_type").agg(
        F.array(*[F.avg(c) for c in at]).alias("mean"),
        *[F.covar_pop(at[i], at[j]).alias(f"c{i}_{j}") for i, j in pairs],
    ).select(
        "board_type", "mean",
        F.array(*[F.array(*[F.col(f"c{min(i, j)}_{max(i, j)}") for j in range(size)]) for i in range(size)]).alias("cov"),
    )
    from .vectors import mahalanobis

    return histograms.join(model, "board_type").select(
        "board_id", "board_type", mahalanobis(ridge)("h", "mean", "cov").alias("distance")
    )
