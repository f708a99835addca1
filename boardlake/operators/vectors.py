"""Nearest neighbours, statistical classifiers and distribution scores on vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import top_rows
from .quantiles import exact_quantiles

SMALL_SIDE_BYTES = 64 << 20
PIVOTS = 64
BLOCK_ROWS = 20_000
MAX_BLOCKS = 16
FEW_DIMENSIONS = 8
TASK_PAIRS = 2_000_000_000
TASK_QUERIES = 20_000
METRICS = ("euclidean", "squared", "manhattan", "cosine")


# ---------------------------------------------------------------- nearest neighbours

def _exact(metric: str, q: np.ndarray, s: np.ndarray) -> np.ndarray:
    if metric == "manhattan":
        return np.abs(s - q).sum(axis=1)
    if metric == "cosine":
        return 1.0 - (s @ q) / (np.sqrt((s * s).sum(axis=1)) * np.sqrt((q * q).sum()))
    squared = ((s - q) ** 2).sum(axis=1)
    return squared if metric == "squared" else np.sqrt(squared)


def _paired(metric: str, q: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Distance of each row of ``q`` from the row of ``s`` beside it; equal vectors get equal distances."""
    if metric == "manhattan":
        return np.abs(s - q).sum(axis=1)
    if metric == "cosine":
        return 1.0 - (s * q).sum(axis=1) / (np.sqrt((s * s).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))
    squared = ((s - q) ** 2).sum(axis=1)
    return squared if metric == "squared" else np.sqrt(squared)


def _halved(v: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers in runs of at most ``size`` rows that lie close together, cut in halves along the widest side."""
    todo, out = [np.arange(len(v))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        part, half = v[rows], len(rows) // 2
        side = part[:, np.argmax(part.max(axis=0) - part.min(axis=0))]
        order = np.argpartition(side, half)
        todo += [rows[order[half:]], rows[order[:half]]]
    return out


def _sample_leaves(metric: str, samples: np.ndarray, k: int) -> dict:
    """Samples, which come in tie order, as leaves with their bounds, ready to be searched for ``k`` neighbours.

    Samples with a component that is no number take no part. Of equal samples only the first ``k`` can be among a
    query's neighbours. Beyond ``FEW_DIMENSIONS`` distances
    are narrowed in short numbers, whose error is kept: single precision for products, and for sums of differences
    whole numbers, as ``|a - b| = 2 max(a, b) - a - b``.
    """
    numbers = np.flatnonzero(np.isfinite(samples).all(axis=1))
    whole = np.ascontiguousarray(samples[numbers])
    if not len(whole):
        return {"few": True, "rank": numbers}
    _, same = np.unique(whole.view(np.dtype((np.void, whole.dtype.itemsize * whole.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    starts = np.flatnonzero(np.diff(same[order], prepend=-1))
    nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    kept = np.sort(order[nth < k])
    v = _prepared(whole[kept], metric)
    width = v.shape[1]
    few = width <= FEW_DIMENSIONS
    leaves = _halved(v, 64 if few else 512)
    at = np.concatenate(leaves)
    v = v[at]
    ends = np.cumsum([len(x) for x in leaves])
    begins = np.append(0, ends[:-1])
    index = {
        "few": few, "rank": numbers[kept[at]], "exact": whole[kept[at]], "begins": begins, "ends": ends,
        "low": np.minimum.reduceat(v, begins), "high": np.maximum.reduceat(v, begins),
    }
    if few:
        return index | {"v": v}
    if metric == "manhattan":
        least, most = float(v.min()), float(v.max())
        step = max((most - least) / (65535 // width), 1e-300)
        whole_v = np.clip(np.rint((v - least) / step), 0, 65535 // width).astype(np.uint16)
        # What a sample loses at most, with the rounding of the sums.
        error = np.abs(v - least - step * whole_v).sum(axis=1).max(initial=0.0) + 0.05 * step
        return index | {"least": least, "step": step, "v": whole_v, "error": error, "sums": whole_v.sum(axis=1, dtype=np.int64).astype(np.float32)}
    centre = v.mean(axis=0)
    v = v - centre
    short = np.float32 if np.abs(v).max(initial=0.0) < 1e15 else np.float64
    v = v.astype(short)
    return index | {"centre": centre, "v": v, "norms": (v * v).sum(axis=1)}


def _rough_distances(metric: str, index: dict, q: np.ndarray):
    """A function from places of samples to narrowed distances, what to add to them per query, and their error."""
    v = index["v"]
    zero = np.zeros(len(q))
    if index["few"]:
        def direct(cols):
            out = np.zeros((len(q), len(cols)))
            for j in range(q.shape[1]):
                d = q[:, j, None] - v[cols, j][None, :]
                out += np.abs(d) if metric == "manhattan" else d * d
            return out

        # Cosines of vectors that lie one behind the other differ by rounding alone.
        return direct, zero, zero + (1e-13 if metric == "cosine" else 0.0)
    if metric == "manhattan":
        step = index["step"]
        whole_q = np.clip(np.rint((q - index["least"]) / step), 0, 65535 // q.shape[1]).astype(np.uint16)
        error = np.abs(q - index["least"] - step * whole_q).sum(axis=1) + index["error"]
        sums = whole_q.sum(axis=1, dtype=np.int64).astype(np.float32)

        def by_larger(cols):
            out = np.empty((len(q), len(cols)), dtype=np.float32)
            for at in range(0, len(cols), 4096):  # NumPy is several times slower on longer rows
                columns = np.ascontiguousarray(v[cols[at:at + 4096]].T)
                larger = np.empty_like(columns)
                for i in range(len(q)):
                    np.maximum(columns, whole_q[i][:, None], out=larger)
                    out[i, at:at + 4096] = np.add.reduce(larger, axis=0, dtype=np.uint16)
            out *= 2.0
            out -= sums[:, None]
            out -= index["sums"][cols][None, :]
            out *= np.float32(step)
            return out

        return by_larger, zero, error
    c = q - index["centre"]
    own = (c * c).sum(axis=1)
    short_q = (-2.0 * c).astype(v.dtype)
    norms = index["norms"]
    reach = float(norms.max(initial=0.0))
    error = (q.shape[1] + 8) * float(np.finfo(v.dtype).eps) * (np.sqrt(own) + np.sqrt(reach)) ** 2

    def product(cols):
        out = short_q @ v[cols].T
        out += norms[cols][None, :]
        return out

    return product, own, error


def _group_nearest(metric: str, index: dict, queries: np.ndarray, k: int):
    """Query, sample and distance of the ``k`` nearest samples of a few queries that lie close together.

    Leaves are visited by their least possible distance, until none can hold anything closer.
    """
    q = _prepared(queries, metric)
    rough, own, error = _rough_distances(metric, index, q)
    gap = np.maximum(np.maximum(index["low"] - q.max(axis=0), q.min(axis=0) - index["high"]), 0.0)
    floor = (gap if metric == "manhattan" else gap * gap).sum(axis=1) * (1 - 1e-9) - error.max()
    order = np.argsort(floor, kind="stable")
    floor = floor[order]
    begins, ends = index["begins"][order], index["ends"][order]
    filled = np.cumsum(ends - begins)
    run = 1024 if index["few"] else 4096
    best = np.full((len(q), k), np.inf)
    limit = np.full(len(q), np.inf)
    found, at = [], 0
    while at < len(order):
        reach = (limit + own).max()
        if floor[at] > reach:
            break
        before = filled[at - 1] if at else 0
        stop = min(np.searchsorted(filled, before + run) + 1, np.searchsorted(floor, reach, side="right"))
        cols = np.concatenate([np.arange(b, e) for b, e in zip(begins[at:stop], ends[at:stop])])
        at = stop
        near = rough(cols)
        if len(found) == 0 and len(cols) > k:
            first = np.partition(near, k - 1, axis=1)[:, k - 1].astype(np.float64)
            limit = first + 2 * error + 1e-9 * np.abs(first)
        # Rounded up, as narrowed distances are compared in their own precision.
        hits = np.flatnonzero(near <= np.nextafter(limit.astype(near.dtype), np.array(np.inf, dtype=near.dtype))[:, None])
        if not len(hits):
            continue
        row, col = np.divmod(hits, len(cols))
        value = near[row, col].astype(np.float64)
        found.append((row, cols[col], value))
        counts = np.bincount(row, minlength=len(q))
        more = np.full((len(q), counts.max()), np.inf)
        more[row, np.arange(len(row)) - (np.cumsum(counts) - counts)[row]] = value
        best = np.partition(np.concatenate([best, more], axis=1), k - 1, axis=1)[:, :k]
        kth = best.max(axis=1)
        limit = np.minimum(limit, kth + 2 * error + 1e-9 * np.abs(kth))
    if not found:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
    row, col, value = (np.concatenate(x) for x in zip(*found))
    kept = value <= limit[row]
    row, col = row[kept], col[kept]
    d = _paired(metric, queries[row], index["exact"][col])
    rank = index["rank"][col]
    order = np.lexsort((rank, d, row))
    row = row[order]
    first = np.searchsorted(row, row, side="left")
    kept = np.arange(len(row)) - first < k
    return row[kept], rank[order][kept], d[order][kept]


def _leaves_nearest(metric: str, index: dict, queries: np.ndarray, k: int):
    """Query, sample (its place in tie order) and distance of the ``k`` nearest samples per query."""
    numbers = np.flatnonzero(np.isfinite(queries).all(axis=1))
    out = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0))]
    if len(numbers) and len(index["rank"]):
        for rows in _halved(_prepared(queries[numbers], metric), 64 if index["few"] else 256):
            rows = numbers[rows]
            row, near, d = _group_nearest(metric, index, queries[rows], k)
            out.append((rows[row], near, d))
    return tuple(np.concatenate(x) for x in zip(*out))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))


def _stored(v: np.ndarray) -> list[bytes]:
    """Each vector as bytes: single precision where that is the same number in every component, else double."""
    with np.errstate(over="ignore", invalid="ignore"):
        short = v.astype("<f4")
    same = (short == v).all(axis=1)
    return [a.tobytes() if x else b.tobytes() for x, a, b in zip(same, short, v.astype("<f8"))]


def _restored(column: pd.Series, width: int) -> np.ndarray:
    data = column.to_numpy()
    short = np.fromiter((len(x) == 4 * width for x in data), dtype=bool, count=len(data))
    out = np.empty((len(data), width))
    for rows, kind in ((short, "<f4"), (~short, "<f8")):
        out[rows] = np.frombuffer(b"".join(data[rows]), dtype=kind).reshape(-1, width)
    return out


def _neighbours(metric, k, q_ids, q, ids, index, same_side):
    """Query, sample (its place among ``ids``, which are in tie order) and distance of the ``k`` nearest, nearest first."""
    row, near, d = _leaves_nearest(metric, index, q, min(k + 1 if same_side else k, len(ids)))
    if same_side:
        other = ids[near] != q_ids[row]
        row, near, d = row[other], near[other], d[other]
        # Queries come one after the other, their neighbours nearest first.
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        nth = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
        row, near, d = row[nth < k], near[nth < k], d[nth < k]
    return row, near, d


def _pairs(metric, k, q_ids, q, sample_frame, index, same_side) -> pd.DataFrame:
    ids = sample_frame["_sid"].to_numpy()
    labels = sample_frame["_label"].to_numpy()
    row, near, d = _neighbours(metric, k, q_ids, q, ids, index, same_side)
    return pd.DataFrame({"_qid": q_ids[row], "_sid": ids[near], "_label": labels[near], "distance": d})


def nearest(
    queries: DataFrame,
    samples: DataFrame,
    query_id: str,
    sample_id: str,
    features: str,
    k: int,
    *,
    metric: str = "euclidean",
    order: str = "id",
    exclude_self: bool = False,
    small_side_bytes: int = SMALL_SIDE_BYTES,
    pivots: int = PIVOTS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact k nearest samples per query: ``(query_id, rank, sample_id, label, distance)``.

    Ties go to the smaller sample id, or to the smaller label when ``order="label"``. The
    sample side is counted first: within ``small_side_bytes`` it is broadcast; beyond that
    both sides are partitioned around pivots and cells are skipped by the triangle
    inequality. Cells share blocks of at least ``block_rows`` rows; there are at most
    ``MAX_BLOCKS``, more only where blocks would exceed ``SMALL_SIDE_BYTES``. Two blocks meet once, for the
    queries of both. Where no cell can be skipped every row therefore moves as often as there are blocks, and
    rows that are query and sample at a time (the same table and id on both sides) move once for both.
    """
    if metric not in METRICS:
        raise ValueError(f"no distance named {metric!r}")
    label = F.col("label").cast("string") if "label" in samples.columns else F.lit("")
    s = samples.select(F.col(sample_id).alias("_sid"), label.alias("_label"), F.col(features).alias("_f"))
    q = queries.select(F.col(query_id).alias("_qid"), F.col(features).alias("_f"))
    row = s.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_f")).alias("d")).first()
    count, width = row["n"], row["d"] or 0
    if not 1 <= k <= count:
        raise ValueError("Neighbours must be between one and the number of training samples.")
    id_type = dict(q.dtypes)["_qid"]
    sample_type = dict(s.dtypes)["_sid"]
    schema = f"_qid {id_type}, _sid {sample_type}, _label string, distance double"
    by_label = order == "label"
    if count * (width * 8 + 64) <= small_side_bytes:
        found = _nearest_broadcast(q, s, k, metric, by_label, exclude_self, schema)
    else:
        one_table = queries is samples and query_id == sample_id
        found = _nearest_cells(None if one_table else q, s, k, metric, by_label, exclude_self, schema, pivots, block_rows)
    ties = [F.asc("distance"), *([F.asc("_label")] if by_label else []), F.asc("_sid")]
    ranked = top_rows(found, ["_qid"], ties, k)
    return ranked.select(
        F.col("_qid").alias(query_id), "rank", F.col("_sid").alias("neighbour_id"), F.col("_label").alias("label"), "distance"
    )


def _tie_sorted(frame: pd.DataFrame, by_label: bool) -> pd.DataFrame:
    return frame.sort_values((["_label"] if by_label else []) + ["_sid"], ignore_index=True)


def _nearest_broadcast(q, s, k, metric, by_label, exclude_self, schema):
    """Sample side within the checked size: one broadcast block; queries are spread over tasks by the work they make."""
    block = _tie_sorted(s.toPandas(), by_label)
    index = _sample_leaves(metric, _matrix(block["_f"]), k + 1 if exclude_self else k)
    shared = q.sparkSession.sparkContext.broadcast((block[["_sid", "_label"]], index))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame, leaves = shared.value
        for batch in _gathered(batches, TASK_QUERIES):
            yield _pairs(metric, k, batch["_qid"].to_numpy(), _matrix(batch["_f"]), frame, leaves, exclude_self)

    total = q.count()
    tasks = max(1, min(-(-total * len(block) // TASK_PAIRS), -(-total // TASK_QUERIES)), min(8, total // 1000))
    return q.repartition(tasks, "_qid").mapInPandas(search, schema)


def _gathered(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The same rows in batches of about ``rows``."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += len(batch)
        if count >= rows:
            yield pd.concat(held, ignore_index=True)
            held, count = [], 0
    if count:
        yield pd.concat(held, ignore_index=True)


def _rows_per_block(rows: int, width: int, block_rows: int, blocks: int = MAX_BLOCKS) -> int:
    return max(block_rows, min(-(-rows // blocks), SMALL_SIDE_BYTES // (width * 8 + 64)))


def _blocks_for(tasks: int) -> int:
    """Blocks whose meetings, one of each two, keep ``tasks`` tasks busy."""
    return min(MAX_BLOCKS, max(4, (1 + math.isqrt(1 + 8 * tasks)) // 2))


def _shared_blocks(sizes: dict[int, int], most: int) -> tuple[dict[int, int], list[int]]:
    """Group of each cell and number of blocks of each group; a block has about ``most`` rows, at most half as many again.

    Cells in a row share a group, which is one block if they are small; a cell larger than a block is a group of its own.
    """
    numbers, totals, group_of, before = {}, [], {}, 0
    for cell, n in sorted(sizes.items()):
        share = ("large", cell) if n > most else ("small", (2 * before + n) // (2 * most))
        before += 0 if n > most else n
        group_of[cell] = numbers.setdefault(share, len(numbers))
        totals += [0] * (len(numbers) - len(totals))
        totals[group_of[cell]] += n
    return group_of, [max(1, round(n / most)) for n in totals]


def _to_meetings(home: DataFrame) -> DataFrame:
    """Rows as often as their block has meetings with others that they ask, or where they are asked for.

    ``home``: rows with their ``block`` and the blocks they must look into (``near``).
    """
    # At most one row per block.
    wanted = home.select(F.col("block").alias("asker"), F.explode("near").alias("block")).distinct().groupBy("block").agg(
        F.collect_set("asker").alias("askers")
    )
    asked_by = F.coalesce(F.when(F.col("held"), F.col("askers")), F.array().cast("array<int>"))
    sent = home.join(F.broadcast(wanted), "block", "left").select(
        "_qid", "_sid", "_label", "v", "held", "block", "reach", "near", F.explode(F.array_union("near", asked_by)).alias("other")
    )
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return sent.select(
        "_qid", "_sid", "_label", "v", "held", "block", "reach", F.array_contains("near", F.col("other")).alias("asks"),
        (F.floor(high * (high - 1) / 2) + low).cast("int").alias("meeting"),
    )


def _nearest_cells(q, s, k, metric, by_label, exclude_self, schema, pivots, block_rows):
    """Partitioned search. Round one looks into each query's own block and gives an upper bound; round two visits
    only blocks with a cell that may hold something closer than that bound. Without ``q`` the samples are the queries."""
    from ..sources.storage import checkpoint

    # Cosine order equals Euclidean order of unit vectors; other distances are metrics.
    bound_metric = "manhattan" if metric == "manhattan" else "euclidean"
    # Vectors with a component that is no number are nobody's neighbour and have none.
    in_numbers = F.forall("_f", lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    s = s.where(in_numbers)
    spark = s.sparkSession
    chosen = s.orderBy(F.xxhash64("_sid"), "_sid").limit(pivots).select("_f").toPandas()
    if not len(chosen):
        return spark.createDataFrame([], schema)
    centres = _prepared(_matrix(chosen["_f"]), metric)
    width = centres.shape[1]
    # Cells are numbered along the side on which the pivots differ most, so neighbours in number lie close.
    centres = centres[np.argsort(centres[:, np.argmax(centres.max(axis=0) - centres.min(axis=0))], kind="stable")]

    def to_pivots(v: np.ndarray) -> np.ndarray:
        v = _prepared(v, metric)
        return np.stack([_exact(bound_metric, c, v) for c in centres], axis=1)

    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for f in batches:
            v = _matrix(f)
            d = to_pivots(v) if len(v) else np.empty((0, len(centres)))
            yield pd.DataFrame({"cell": d.argmin(axis=1).astype("int32"), "d": d.min(axis=1), "v": pd.Series(_stored(v), dtype=object)})

    id_type, sample_type = (x.split()[1] for x in schema.split(", ")[:2])
    if q is None:
        rows = s.select(F.col("_sid").alias("_qid"), "_sid", "_label", "_f", F.lit(True).alias("asks"), F.lit(True).alias("held"))
    else:
        rows = q.where(in_numbers).select(
            "_qid", F.lit(None).cast(sample_type).alias("_sid"), F.lit(None).cast("string").alias("_label"), "_f",
            F.lit(True).alias("asks"), F.lit(False).alias("held"),
        ).unionByName(s.select(F.lit(None).cast(id_type).alias("_qid"), "_sid", "_label", "_f", F.lit(False).alias("asks"), F.lit(True).alias("held")))
    placed = F.pandas_udf("struct<cell int, d double, v binary>")(place)
    rows = checkpoint(rows.withColumn("_p", placed("_f")).select("_qid", "_sid", "_label", "asks", "held", "_p.v", "_p.cell", "_p.d"))
    cells = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("held"), F.col("d"))).alias("radius"))
    info = {r["cell"]: (r["n"], r["radius"]) for r in cells.collect()}  # at most one row per pivot
    # As many blocks as keep all tasks busy, whatever the rows: what moves grows with the rows.
    most = _rows_per_block(sum(n for n, _ in info.values()), width, block_rows, _blocks_for(spark.sparkContext.defaultParallelism))
    group_of, counts = _shared_blocks({c: n for c, (n, _) in info.items()}, most)
    total = sum(counts)
    begins = np.append(0, np.cumsum(counts))

    def lookup(values: dict) -> Column:
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("cell")]

    share = F.pmod(F.xxhash64("_qid", "_sid"), lookup({c: counts[g] for c, g in group_of.items()}))
    block = (lookup({c: int(begins[g]) for c, g in group_of.items()}) + share).cast("int")
    rows = rows.withColumn("block", block).drop("d", "cell")

    # Cells with samples.
    occupied = sorted(c for c, (_, radius) in info.items() if radius is not None)
    radius = np.array([info[c][1] for c in occupied], dtype=float)
    group_at = np.array([group_of[c] for c in occupied])

    def search(asking: pa.Table, held: pa.Table):
        if not len(asking) or not len(held):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
        names = _tie_sorted(held.select(["_sid", "_label"]).to_pandas().assign(at=np.arange(len(held))), by_label)
        at = names["at"].to_numpy()
        leaves = _sample_leaves(metric, _restored(held["v"].to_pandas(), width)[at], k + 1 if exclude_self else k)
        q_ids = asking["_qid"].to_pandas().to_numpy()
        row, near, d = _neighbours(metric, k, q_ids, _restored(asking["v"].to_pandas(), width), names["_sid"].to_numpy(), leaves, exclude_self)
        return row, at[near], d

    def blocks_within(v: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Blocks (across) that may hold something closer than ``far`` to a vector (down)."""
        d = to_pivots(v)[:, occupied]
        with np.errstate(invalid="ignore"):
            # No bound, where fewer than k were found, leaves nothing out.
            inside = ~(d - radius > far[:, None] + 1e-9 * (1 + d))
        groups = np.stack([inside[:, group_at == g].any(axis=1) for g in range(len(counts))], axis=1)
        return np.repeat(groups, counts, axis=1)

    def listed(lengths: np.ndarray, values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), values)

    def at_home(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        asking, held = table.filter(table["asks"]), table.filter(table["held"])
        row, at, d = search(asking, held)
        order = np.argsort(row, kind="stable")
        row, at, d = row[order], at[order], d[order]
        found = np.bincount(row, minlength=len(asking))
        reach = np.full(len(asking), np.nan)
        full = found >= k
        reach[full] = d[(np.cumsum(found) - found)[full] + k - 1]
        far = reach
        if metric == "squared":
            far = np.sqrt(reach)
        elif metric == "cosine":
            far = np.sqrt(np.maximum(2.0 * reach, 0.0) + 1e-12)
        near = np.zeros((len(table), total), dtype=bool)
        if len(asking):
            near[asks] = blocks_within(_restored(asking["v"].to_pandas(), width), far)
        near[np.arange(len(table)), table["block"].to_numpy()] = False
        lengths, bounds = np.zeros(len(table), dtype=np.int64), np.full(len(table), np.nan)
        lengths[asks], bounds[asks] = found, reach
        out = {c: table[c] for c in ("_qid", "_sid", "_label", "v", "held", "block")}
        return pa.table(out | {
            "reach": bounds, "near": listed(near.sum(axis=1), pa.array(np.nonzero(near)[1], pa.int32())),
            "n_sid": listed(lengths, held["_sid"].take(pa.array(at)).combine_chunks()),
            "n_label": listed(lengths, held["_label"].take(pa.array(at)).combine_chunks()), "n_distance": listed(lengths, pa.array(d)),
        })

    def meet(table: pa.Table) -> pa.Table:
        blocks, asks, held = (table[c].to_numpy() for c in ("block", "asks", "held"))
        out = []
        for mine in np.unique(blocks):
            asking, others = table.filter(pa.array((blocks == mine) & asks)), table.filter(pa.array((blocks != mine) & held))
            row, at, d = search(asking, others)
            with np.errstate(invalid="ignore"):
                kept = ~(d > asking["reach"].to_numpy()[row])
            row, at, d = pa.array(row[kept]), pa.array(at[kept]), pa.array(d[kept])
            out.append(pa.table({"_qid": asking["_qid"].take(row), "_sid": others["_sid"].take(at), "_label": others["_label"].take(at), "distance": d}))
        return pa.concat_tables(out)

    home = checkpoint(rows.repartitionById(total, "block").groupBy("block").applyInArrow(
        at_home, f"_qid {id_type}, _sid {sample_type}, _label string, v binary, held boolean, block int, reach double, near array<int>, "
        f"n_sid array<{sample_type}>, n_label array<string>, n_distance array<double>",
    ))
    first = home.select("_qid", F.explode(F.arrays_zip("n_sid", "n_label", "n_distance")).alias("n")).select(
        "_qid", F.col("n.n_sid").alias("_sid"), F.col("n.n_label").alias("_label"), F.col("n.n_distance").alias("distance")
    )
    if total == 1:
        return first
    # A partition per meeting, so that no two share a task.
    sent = _to_meetings(home).repartitionById(total * (total - 1) // 2, "meeting")
    return first.unionByName(sent.groupBy("meeting").applyInArrow(meet, schema))


def _prepared(v: np.ndarray, metric: str) -> np.ndarray:
    if metric != "cosine":
        return v
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)


def nearest_by_hashing(queries: DataFrame, samples: DataFrame, features: str, radius: float, bucket: float):
    """Approximate Euclidean pairs within ``radius`` by random projections."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    a = queries.withColumn("_v", array_to_vector(F.col(features).cast("array<double>")))
    b = samples.withColumn("_v", array_to_vector(F.col(features).cast("array<double>")))
    model = BucketedRandomProjectionLSH(inputCol="_v", outputCol="_h", bucketLength=bucket, numHashTables=4, seed=7).fit(b)
    return model.approxSimilarityJoin(a, b, radius, distCol="distance")


def ratio_matches(found: DataFrame, query_id: str, ratio: float = 0.75) -> DataFrame:
    """Best neighbour kept when it is clearly closer than the second; needs k = 2."""
    pair = found.groupBy(query_id).agg(
        F.min_by("neighbour_id", "rank").alias("neighbour_id"),
        F.min_by("distance", "rank").alias("distance"),
        F.max_by("distance", "rank").alias("second_distance"),
        F.count(F.lit(1)).alias("_n"),
    )
    return pair.where((F.col("_n") == 2) & (F.col("distance") < ratio * F.col("second_distance"))).drop("_n")


def tabular_vote(found: DataFrame, query_id: str) -> DataFrame:
    """Plain majority, ties to the smallest label."""
    votes = found.groupBy(query_id, "label").agg(F.count(F.lit(1)).alias("v"))
    return votes.groupBy(query_id).agg(F.min(F.struct((-F.col("v")).alias("v"), "label"))["label"].alias("predicted"))


def object_vote(found: DataFrame, query_id: str, weighted: bool = False) -> DataFrame:
    """Vote with optional inverse-distance weights; winner by weight, nearest, label."""
    weight = 1.0 / F.greatest(F.col("distance"), F.lit(1e-9)) if weighted else F.lit(1.0)
    votes = found.groupBy(query_id, "label").agg(F.sum(weight).alias("w"), F.min("distance").alias("d"))
    best = F.min(F.struct((-F.col("w")).alias("w"), "d", "label"))
    return votes.groupBy(query_id).agg(best.alias("b"), F.sum("w").alias("t")).select(
        query_id, F.col("b.label").alias("predicted"),
        (-F.col("b.w") / F.greatest("t", F.lit(1e-9))).alias("confidence"),
    )


def neighbour_lists(found: DataFrame, query_id: str) -> DataFrame:
    """The neighbours of each query, nearest first, with id, label and distance; as many as the search has found."""
    entry = F.struct("rank", F.col("neighbour_id").alias("id"), "label", "distance")
    lists = found.groupBy(query_id).agg(F.array_sort(F.collect_list(entry)).alias("_n"))
    return lists.select(query_id, F.transform("_n", lambda n: F.struct(n["id"].alias("id"), n["label"].alias("label"), n["distance"].alias("distance"))).alias("neighbours"))


def neighbour_classification(found: DataFrame, query_id: str, weighted: bool = False) -> DataFrame:
    """The vote of a query's neighbours together with the neighbours themselves."""
    lists = neighbour_lists(found, query_id).withColumnRenamed(query_id, "_q")
    return object_vote(found, query_id, weighted).join(lists, F.col(query_id) == F.col("_q")).drop("_q")


def neighbour_segmentation(
    cells: DataFrame, samples: DataFrame, cell_id: str, sample_id: str, features: str, k: int,
    foreground: list[str], least_confidence: float, weighted: bool = False,
) -> DataFrame:
    """``mask`` of each cell: 255 where its neighbours agree on a foreground label with enough confidence."""
    vote = object_vote(nearest(cells, samples, cell_id, sample_id, features, k), cell_id, weighted)
    inside = F.col("predicted").isin(*foreground) & (F.col("confidence") >= least_confidence)
    return vote.select(cell_id, "predicted", "confidence", F.when(inside, 255).otherwise(0).alias("mask"))


# ---------------------------------------------------------------- class models

def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def _by_dimension(samples: DataFrame, label: str, features: str) -> DataFrame:
    return samples.select(F.col(label).cast("string").alias("label"), F.posexplode(features).alias("dim", "v")).select(
        "label", "dim", F.col("v").cast("double").alias("v")
    )


def _as_model(per_dimension: DataFrame, fields: list[str]) -> DataFrame:
    """One row per class with arrays over the dimensions (as long as one vector)."""
    listed = per_dimension.groupBy("label").agg(
        F.array_sort(F.collect_list(F.struct("dim", *fields))).alias("_d")
    )
    return listed.select("label", *[F.col("_d")[f].alias(f) for f in fields])


def _model_value(model: DataFrame) -> Column:
    """The class table as one array value; it has one entry per class."""
    return model.agg(F.array_sort(F.collect_list(F.struct(*model.columns)))).scalar()


def gaussian_naive_bayes(
    samples: DataFrame, queries: DataFrame, key: str, features: str, label: str = "label", smoothing: float = 1e-9
) -> DataFrame:
    """Class probabilities from per-class means and smoothed population variances."""
    dims = _by_dimension(samples, label, features)
    overall = dims.groupBy("dim").agg(F.var_pop("v").alias("s")).agg(F.max("s")).scalar()
    stats = dims.groupBy("label", "dim").agg(
        F.avg("v").alias("mean"), (F.var_pop("v") + F.lit(smoothing) * overall).alias("var")
    )
    sizes = samples.groupBy(F.col(label).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = samples.agg(F.count(F.lit(1))).scalar()
    model = _as_model(stats, ["mean", "var"]).join(sizes, "label").select(
        "label", "mean", "var", F.log(F.col("n") / total).alias("prior")
    )
    spread = F.lit(2.0 * np.pi)

    def log_likelihood(m: Column) -> Column:
        x = F.col(features)
        at = F.sequence(F.lit(1), F.size(features))
        terms = F.transform(
            at,
            lambda i: F.log(spread * F.element_at(m["var"], i))
            + F.pow(F.element_at(x, i).cast("double") - F.element_at(m["mean"], i), F.lit(2.0)) / F.element_at(m["var"], i),
        )
        return m["prior"] - 0.5 * F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)

    scored = queries.select(key, features).withColumn("_m", _model_value(model)).withColumn(
        "_s", F.transform("_m", lambda m: F.struct(log_likelihood(m).alias("score"), m["label"].alias("label")))
    )
    peak = F.array_max("_s")
    total_weight = F.aggregate("_s", F.lit(0.0), lambda a, v: a + F.exp(v["score"] - F.col("_b.score")))
    return scored.withColumn("_b", peak).select(
        key, F.col("_b.label").alias("predicted"), (F.lit(1.0) / total_weight).alias("confidence")
    )


def nearest_centroid(
    samples: DataFrame, queries: DataFrame, key: str, features: str, label: str = "label", metric: str = "euclidean"
) -> DataFrame:
    """Closest class centre; the centre is the mean, or the median for Manhattan distance."""
    dims = _by_dimension(samples, label, features)
    if metric == "manhattan":
        centres = exact_quantiles(dims, ["label", "dim"], "v", {"centre": 0.5})
    else:
        centres = dims.groupBy("label", "dim").agg(F.avg("v").alias("centre"))
    model = _as_model(centres, ["centre"])

    def distance(m: Column) -> Column:
        x = F.transform(features, lambda v: v.cast("double"))
        if metric == "manhattan":
            return F.aggregate(F.zip_with(x, m["centre"], lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, v: a + v)
        return F.sqrt(squared_distance(x, m["centre"]))

    scored = queries.select(key, features).withColumn("_m", _model_value(model)).select(
        key, F.array_min(F.transform("_m", lambda m: F.struct(distance(m).alias("d"), m["label"].alias("label")))).alias("_b")
    )
    return scored.select(key, F.col("_b.label").alias("predicted"), F.col("_b.d").alias("distance"))


def sample_checks(samples: DataFrame, label: str, features: str, low: float, high: float) -> DataFrame:
    """Counts that decide whether a training set is usable."""
    bad = F.exists(features, lambda v: v.isNull() | F.isnan(v) | (v < low) | (v > high))
    blank = F.coalesce(F.trim(F.col(label).cast("string")), F.lit("")) == ""
    return samples.agg(
        F.count(F.lit(1)).alias("sample_count"), F.countDistinct(label).alias("label_count"),
        F.count_if(blank).alias("blank_labels"), F.count_if(bad).alias("out_of_range"),
        F.countDistinct(F.size(features)).alias("width_count"),
    ).withColumn(
        "is_usable",
        (F.col("sample_count") >= 2) & (F.col("label_count") >= 2) & (F.col("blank_labels") == 0)
        & (F.col("out_of_range") == 0) & (F.col("width_count") == 1),
    )


def class_mapping_contract(items: DataFrame, class_id: str) -> DataFrame:
    """Class ids must be contiguous from zero with at least two classes."""
    return items.agg(
        F.min(class_id).cast("bigint").alias("first_id"), F.max(class_id).cast("bigint").alias("last_id"),
        F.countDistinct(class_id).alias("class_count"),
    ).withColumn(
        "is_valid",
        (F.col("first_id") == 0) & (F.col("last_id") == F.col("class_count") - 1) & (F.col("class_count") >= 2),
    )


def split_failed_items(items: DataFrame, reasons: dict[str, Column], policy: str = "skip") -> tuple[DataFrame, DataFrame]:
    """Good items and failed items with the first reason; policy ``fail`` raises when any failed."""
    code = None
    for name, bad in reasons.items():
        code = F.when(bad, name) if code is None else code.when(bad, name)
    tagged = items.withColumn("reason", code)
    failed = tagged.where("reason IS NOT NULL")
    if policy == "fail" and failed.limit(1).count():
        raise ValueError("Items failed feature extraction.")
    return tagged.where("reason IS NULL").drop("reason"), failed


# ---------------------------------------------------------------- distributions and banks

def position_blocks(vectors: DataFrame, keys: list[str], features: str, size: int) -> DataFrame:
    """One row per vector and position; a position is a run of ``size`` dimensions."""
    n = F.size(features)
    parts = F.transform(
        F.sequence(F.lit(1), n, F.lit(size)),
        lambda i: F.transform(F.slice(features, i, F.lit(size)), lambda v: v.cast("double")),
    )
    return vectors.select(*keys, F.posexplode(parts).alias("position", "block"))


def position_gaussians(blocks: DataFrame, group: str, size: int) -> DataFrame:
    """Mean and population covariance per group and position, from plain aggregates."""
    at = [F.col("block")[i] for i in range(size)]
    means = [F.avg(c).alias(f"m{i}") for i, c in enumerate(at)]
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    covs = [F.covar_pop(at[i], at[j]).alias(f"c{i}_{j}") for i, j in pairs]
    stats = blocks.groupBy(group, "position").agg(*means, *covs)
    rows = F.array(*[F.array(*[F.col(f"c{min(i, j)}_{max(i, j)}") for j in range(size)]) for i in range(size)])
    return stats.select(group, "position", F.array(*[F.col(f"m{i}") for i in range(size)]).alias("mean"), rows.alias("cov"))


def mahalanobis(ridge: float):
    @F.pandas_udf("double")
    def distance(block: pd.Series, mean: pd.Series, cov: pd.Series) -> pd.Series:
        diff = _matrix(block) - _matrix(mean)
        spread = np.stack([np.stack(c) for c in cov]) + ridge * np.eye(diff.shape[1])
        solved = np.linalg.solve(spread, diff[..., None])[..., 0]
        return pd.Series(np.sqrt(np.maximum((diff * solved).sum(axis=1), 0.0)))

    return distance


def position_scores(vectors: DataFrame, key: str, group: str, features: str, size: int, ridge: float = 0.01) -> DataFrame:
    """Mahalanobis distance of each position to its group's Gaussian."""
    blocks = position_blocks(vectors, [key, group], features, size)
    model = position_gaussians(blocks, group, size)
    return blocks.join(model, [group, "position"]).select(
        key, group, "position", mahalanobis(ridge)("block", "mean", "cov").alias("distance")
    )


def coreset(vectors: DataFrame, key: str, features: str, size: int) -> DataFrame:
    """Greedy k-centre selection: each round takes the vector farthest from those chosen.

    The running minimum distance is kept in a checkpoint per round; only the chosen vector
    reaches the driver.
    """
    from ..sources.storage import checkpoint

    if size < 1:
        raise ValueError("The coreset needs at least one vector.")
    spark = vectors.sparkSession
    x = vectors.select(F.col(key).alias("id"), F.transform(features, lambda v: v.cast("double")).alias("f"))
    pick = x.agg(F.min_by(F.struct("id", "f"), "id").alias("p")).first()["p"]
    chosen = [(0, pick["id"], None)]
    state = x.withColumn("far", F.lit(float("inf")))
    for step in range(1, size):
        centre = F.array(*[F.lit(v) for v in pick["f"]])
        state = checkpoint(state.withColumn("far", F.least("far", F.sqrt(squared_distance(F.col("f"), centre)))))
        best = state.agg(
            F.max(F.struct("far", (-F.col("id")).alias("neg"))).alias("m"),
            F.max_by(F.struct("id", "f"), F.struct("far", (-F.col("id")).alias("neg"))).alias("p"),
        ).first()
        pick = best["p"]
        chosen.append((step, pick["id"], best["m"]["far"]))
    return spark.createDataFrame(chosen, "step int, id bigint, distance double")


# ---------------------------------------------------------------- library models

def _with_vector(df: DataFrame, features: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("_v", array_to_vector(F.transform(features, lambda v: v.cast("double"))))


def logistic_classifier(samples: DataFrame, queries: DataFrame, key: str, features: str, label: str, strength: float = 1.0):
    """L2 logistic regression; ties between classes go to the larger label."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    train = _with_vector(samples, features).withColumn("_y", F.col(label).cast("double"))
    n = train.count()
    model = LogisticRegression(
        featuresCol="_v", labelCol="_y", regParam=strength / n, elasticNetParam=0.0, maxIter=100
    ).fit(train)
    scored = model.transform(_with_vector(queries, features)).withColumn("_p", vector_to_array("probability"))
    best = F.array_max(F.transform("_p", lambda p, i: F.struct(p.alias("p"), i.alias("i"))))
    return scored.select(key, best["i"].alias("predicted"), best["p"].alias("confidence"))


def linear_svm(samples: DataFrame, queries: DataFrame, key: str, features: str, label: str, scale: bool = True, penalty: float = 1.0):
    """One-vs-rest linear SVM with optional standard scaling. Other kernels are not offered."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.feature import StandardScaler

    train = _with_vector(samples, features).withColumn("_y", F.col(label).cast("double"))
    column = "_v"
    stages = []
    if scale:
        stages.append(StandardScaler(inputCol="_v", outputCol="_w", withMean=True, withStd=True))
        column = "_w"
    n = train.count()
    svc = LinearSVC(featuresCol=column, regParam=1.0 / (penalty * n), maxIter=25, tol=1e-4)
    stages.append(OneVsRest(classifier=svc, featuresCol=column, labelCol="_y", predictionCol="_hat", parallelism=8))
    model = Pipeline(stages=stages).fit(train)
    return model.transform(_with_vector(queries, features)).select(key, F.col("_hat").cast("int").alias("predicted"))


def kmeans_clusters(pixels: DataFrame, keys: list[str], features: str, clusters: int, foreground: list[int], seed: int = 7, max_iter: int = 50, tol: float = 1e-4) -> DataFrame:
    """k-means with cluster ids ordered by mean brightness and a foreground mask."""
    from pyspark.ml.clustering import KMeans

    data = _with_vector(pixels, features)
    model = KMeans(k=clusters, featuresCol="_v", predictionCol="_c", seed=seed, maxIter=max_iter, tol=tol).fit(data)
    centres = [float(np.mean(c)) for c in model.clusterCenters()]
    rank = {c: r for r, c in enumerate(sorted(range(len(centres)), key=lambda c: centres[c]))}
    renamed = F.create_map(*[F.lit(x) for c, r in rank.items() for x in (c, r)])[F.col("_c")]
    return model.transform(data).select(
        *keys, renamed.alias("cluster"), F.when(renamed.isin(foreground), 255).otherwise(0).alias("mask")
    )


def pca_anomaly(train: DataFrame, queries: DataFrame, key: str, features: str, components: int) -> DataFrame:
    """Mean squared reconstruction error over the train 95th percentile, clamped to [0, 1]."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    dims = train.select(F.posexplode(features).alias("dim", "v")).groupBy("dim").agg(F.avg(F.col("v").cast("double")).alias("m"))
    mean = dims.agg(F.array_sort(F.collect_list(F.struct("dim", "m")))["m"]).scalar()

    def centred(df: DataFrame) -> DataFrame:
        x = F.transform(features, lambda v: v.cast("double"))
        return df.withColumn("_mean", mean).withColumn("_x", F.zip_with(x, F.col("_mean"), lambda a, b: a - b))

    model = PCA(k=components, inputCol="_v", outputCol="_t").fit(_with_vector(centred(train), "_x"))
    basis = model.pc.toArray()
    columns = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in basis])

    def errors(df: DataFrame) -> DataFrame:
        scored = model.transform(_with_vector(centred(df), "_x")).withColumn("_t", vector_to_array("_t"))
        rebuilt = F.transform(
            columns, lambda w: F.aggregate(F.zip_with(w, F.col("_t"), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        )
        return scored.withColumn("error", squared_distance(F.col("_x"), rebuilt) / F.size("_x"))

    base = exact_quantiles(errors(train), [], "error", {"p95": 0.95}).select(F.greatest("p95", F.lit(1e-9))).scalar()
    return errors(queries).select(key, "error", F.least(F.col("error") / base, F.lit(1.0)).alias("anomaly"))
