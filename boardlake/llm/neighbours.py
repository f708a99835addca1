"""Approximate nearest neighbours by several shifted space-filling curves.

Every vector is projected by a random rotation, shifted, put on a grid and given its place on a
Hilbert curve; ``CURVES`` rotations and shifts give as many orderings. Spark range-partitions
the vectors by curve and key, consecutive runs of ``BLOCK_ROWS`` are the blocks of a curve. A
query looks at the blocks within ``reach`` of its own on every curve; what the curves offer is
merged and ranked by the exact score on the original vectors.

``reach`` is not fixed in advance: for a bounded sample of queries the true neighbours are
found by brute force, and the least reach is taken with which the wanted share of them lies in
a window of some curve. On vectors with few degrees of freedom that is a block or two; on
vectors spread evenly in many dimensions no ordering keeps neighbours together, and the windows
grow to a share of the curve.

For the largest inner product, vectors are placed with one more component that makes all norms
equal (zero for queries), which turns it into nearness. Equal vectors are one candidate with
its smallest ids, so a vector that a third of all rows share costs as much as any other.

Defined cases: rows with null id, null or zero vector, or null or non-finite components take no
part, nor do vectors of another length than most have. Repeated rows count once. Equal scores
go to the smaller id. With fewer candidates than asked for, all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, count_rows, saved

K = 20
CURVES = 4
DIMENSIONS = 8
BITS = 7
BLOCK_ROWS = 256
GROUP_BLOCKS = 64
SEGMENT_BLOCKS = 64
SPARE = 12
RECALL = 0.95
SAMPLE_QUERIES = 150
FIT_ROWS = 10_000
SEED = 7


def valid(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``id`` and ``v`` (array of double) of the rows that take part."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("v") == (most["d"] if most else 0))


def classes(rows: DataFrame, ids: int) -> DataFrame:
    """``cid``, ``v`` and ``ids``, the smallest ids of each distinct vector."""
    first = Window.partitionBy("v").orderBy("id")
    top = rows.distinct().withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= ids)
    grouped = top.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return saved(grouped.withColumn("cid", F.monotonically_increasing_id()), "ann-classes")


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of grid cells, as one whole number.

    Works from the highest bit down: each level's corner is looked up relative to the entry
    corner and direction that the levels above have led to.
    """
    n, d = cells.shape
    entry, turn, key = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    all_bits = (1 << d) - 1

    def rotate(x: np.ndarray, by: np.ndarray) -> np.ndarray:  # right, within d bits
        return ((x >> by) | (x << (d - by))) & all_bits

    for level in range(bits - 1, -1, -1):
        corner = np.zeros(n, np.int64)
        for axis in range(d):
            corner |= ((cells[:, axis] >> level) & 1) << axis
        local = rotate(corner ^ entry, (turn + 1) % d)
        rank, shift = local.copy(), 1
        while shift < d:  # inverse Gray code
            rank ^= rank >> shift
            shift *= 2
        key = (key << d) | rank
        # Entry corner and direction of the sub-cube with this rank.
        low = np.where(rank == 0, 0, 2 * ((rank - 1) // 2))
        start = low ^ (low >> 1)
        odd = np.where(rank % 2 == 0, np.maximum(rank - 1, 0), rank)
        ones = np.zeros(n, np.int64)
        counting = (odd & 1) == 1
        value = odd.copy()
        while counting.any():
            ones[counting] += 1
            value >>= 1
            counting &= (value & 1) == 1
        step = np.where(rank == 0, 0, ones % d)
        back = (turn + 1) % d
        entry ^= ((start << back) | (start >> (d - back))) & all_bits
        turn = (turn + step + 1) % d
    return key


class Curves:
    """Projections, shifts and grids of all curves, fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray, norm: float, curves: int, dimensions: int, bits: int, seed: int):
        rng = np.random.default_rng(seed)
        size = sample.shape[1] + 1
        self.norm, self.bits, self.dimensions = norm, bits, min(dimensions, size)
        self.turns = [np.linalg.qr(rng.standard_normal((size, self.dimensions)))[0] for _ in range(curves)]
        wide = self.widened(sample, False)
        self.centre = [(wide @ t).mean(0) for t in self.turns]
        self.scale = [4.0 * max(float((wide @ t).std()), 1e-12) for t in self.turns]
        self.shift = [rng.random(self.dimensions) for _ in range(curves)]

    def widened(self, v: np.ndarray, query: bool) -> np.ndarray:
        rest = np.zeros(len(v)) if query else np.sqrt(np.maximum(self.norm**2 - (v**2).sum(1), 0.0))
        return np.column_stack([v, rest])

    def keys(self, v: np.ndarray, query: bool) -> list[np.ndarray]:
        wide, out = self.widened(v, query), []
        for turn, centre, scale, shift in zip(self.turns, self.centre, self.scale, self.shift):
            at = ((wide @ turn - centre) / scale + 0.5 + shift / 2) / 1.5  # shifted by up to a third of the cube
            cells = np.clip(at * (1 << self.bits), 0, (1 << self.bits) - 1).astype(np.int64)
            out.append(hilbert(cells, self.bits))
        return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64) if len(column) else np.zeros((0, 0))


def _best(scores: np.ndarray, keep: int) -> np.ndarray:
    """Columns of the ``keep`` largest scores of each row."""
    return np.argpartition(-scores, keep - 1, axis=1)[:, :keep] if scores.shape[1] > keep else np.tile(np.arange(scores.shape[1]), (len(scores), 1))


def placed(items: DataFrame, queries: DataFrame, curves: Curves, block_rows: int) -> DataFrame:
    """``curve``, ``block`` (from 0), ``cid``, ``query`` and ``v`` of vectors and queries on every curve."""
    sent = items.sparkSession.sparkContext.broadcast(curves)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for query in (False, True):
                part = batch[batch["query"] == query]
                if len(part):
                    for k, key in enumerate(sent.value.keys(_matrix(part["v"]), query)):
                        yield part.assign(curve=k, key=key)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, run, curve, seen = TaskContext.get().partitionId(), 0, None, 0
        for batch in batches:
            runs = np.empty(len(batch), np.int64)
            for i, (c, q) in enumerate(zip(batch["curve"].to_numpy(), batch["query"].to_numpy())):
                if c != curve or seen >= block_rows:
                    run, seen, curve = run + 1, 0, c
                runs[i] = run
                seen += not q
            yield batch.assign(part=part, run=runs)[["curve", "part", "run", "cid", "query", "v"]]

    both = items.select("cid", "v", F.lit(False).alias("query")).unionByName(queries.select("cid", "v", F.lit(True).alias("query")))
    keys = both.mapInPandas(keyed, "cid long, v array<double>, query boolean, curve int, key long")
    order = ["curve", "key", "cid", "query"]
    rows = keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(cut, "curve int, part int, run long, cid long, query boolean, v array<double>")
    rows = saved(rows, "ann-placed")
    runs = rows.groupBy("curve", "part", "run").agg(F.count(F.lit(1)).alias("_n"))
    number = Window.partitionBy("curve").orderBy("part", "run")
    runs = checkpoint(runs.select(F.col("curve").alias("_c"), F.col("part").alias("_p"), F.col("run").alias("_r"), (F.row_number().over(number) - 1).alias("block")))
    on = (F.col("curve") == F.col("_c")) & (F.col("part") == F.col("_p")) & (F.col("run") == F.col("_r"))
    return saved(rows.join(runs, on).select("curve", "block", "cid", "query", "v"), "ann-blocks")


def brute_force(queries: DataFrame, items: DataFrame, keep: int) -> DataFrame:
    """``q`` and ``cid`` of the ``keep`` nearest of a bounded number of queries, against all items."""
    rows = queries.select("cid", "v").toPandas()
    sent = queries.sparkSession.sparkContext.broadcast((rows["cid"].to_numpy(np.int64), _matrix(rows["v"])))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, wanted = sent.value
        for batch in batches:
            if len(batch) and len(names):
                scores = wanted @ _matrix(batch["v"]).T
                scores[names[:, None] == batch["cid"].to_numpy()[None, :]] = -np.inf
                best = _best(scores, keep)
                q = np.repeat(names, best.shape[1])
                yield pd.DataFrame({"q": q, "cid": batch["cid"].to_numpy()[best.ravel()], "s": np.take_along_axis(scores, best, 1).ravel()})

    found = items.select("cid", "v").mapInPandas(search, "q long, cid long, s double")
    top = Window.partitionBy("q").orderBy(F.desc("s"), "cid")
    return found.withColumn("_r", F.row_number().over(top)).where((F.col("_r") <= keep) & (F.col("q") != F.col("cid"))).select("q", "cid")


def needed_reach(blocks: DataFrame, sample: DataFrame, items: DataFrame, recall: float, keep: int) -> int:
    """Least distance in blocks that holds the wanted share of the sample's true neighbours.

    At most SAMPLE_QUERIES * keep numbers reach the driver.
    """
    truth = checkpoint(brute_force(sample, items, keep))
    asked = blocks.where("query").select(F.col("cid").alias("q"), F.col("curve").alias("qc"), F.col("block").alias("qb"))
    asked = asked.join(truth, "q")
    data = blocks.where("not query").select(F.col("cid").alias("_n"), "curve", "block")
    far = asked.join(data, (F.col("cid") == F.col("_n")) & (F.col("qc") == F.col("curve"))).groupBy("q", "cid").agg(F.min(F.abs(F.col("qb") - F.col("block"))).alias("far"))
    found = sorted(r["far"] for r in far.select("far").collect())
    return int(found[min(len(found) - 1, int(np.ceil(recall * len(found))))]) if found else 0


def candidates(blocks: DataFrame, reach: int, keep: int, group_blocks: int = GROUP_BLOCKS, segment_blocks: int = SEGMENT_BLOCKS) -> DataFrame:
    """``q`` and ``cid``: per query, curve and stretch of its window the ``keep`` nearest.

    Queries of ``group_blocks`` neighbouring blocks are served together; their common window is
    cut into stretches of ``segment_blocks`` blocks, so a task holds a bounded number of rows.
    """
    count = blocks.groupBy("curve").agg(F.max("block").alias("last"))
    group = F.floor(F.col("block") / group_blocks)
    segment = F.floor(F.col("block") / segment_blocks)
    asked = blocks.where("query").select("curve", "block", F.col("cid").alias("q"), F.col("v").alias("qv"), group.alias("g"))
    groups = checkpoint(asked.select("curve", "g").distinct().join(count, "curve"))
    low = F.greatest(F.col("g") * group_blocks - reach, F.lit(0))
    high = F.least((F.col("g") + 1) * group_blocks - 1 + reach, F.col("last"))
    reached = groups.select(F.col("curve").alias("_c"), F.col("g").alias("_g"), F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("_b"))
    data = blocks.where("not query")
    data = data.join(reached, (F.col("curve") == F.col("_c")) & (F.col("block") == F.col("_b"))).select("curve", F.col("_g").alias("g"), segment.alias("s"), "block", "cid", "v")
    spans = F.sequence(F.floor(F.greatest(F.col("block") - reach, F.lit(0)) / segment_blocks), F.floor(F.least(F.col("block") + reach, F.col("last")) / segment_blocks))
    asked = saved(asked.join(count, "curve").select("curve", "g", F.explode(spans).alias("s"), "block", "q", "qv"), "ann-asking")

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "cid": []}).astype("int64")
        items, at, names = _matrix(left["v"]), left["block"].to_numpy(), left["cid"].to_numpy()
        out = []
        for start in range(0, len(right), 256):
            part = right.iloc[start : start + 256]
            scores = _matrix(part["qv"]) @ items.T
            outside = np.abs(part["block"].to_numpy()[:, None] - at[None, :]) > reach
            scores[outside | (part["q"].to_numpy()[:, None] == names[None, :])] = -np.inf
            best = _best(scores, keep)
            good = np.isfinite(np.take_along_axis(scores, best, 1)).ravel()
            out.append(pd.DataFrame({"q": np.repeat(part["q"].to_numpy(), best.shape[1])[good], "cid": names[best.ravel()][good]}))
        return pd.concat(out)

    keys = ["curve", "g", "s"]
    return data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "q long, cid long").distinct()


def search(vectors: DataFrame, every: int = 20, k: int = K, *, curves: int = CURVES, dimensions: int = DIMENSIONS, bits: int = BITS,
           block_rows: int = BLOCK_ROWS, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score``: the ``k`` nearest of every id divisible by ``every``."""
    rows = valid(vectors)
    items = classes(rows, k + 1)
    asking = F.col("id") % every == 0
    wanted = saved(rows.where(asking).distinct(), "ann-queries")
    held = items.select("cid", F.col("v").alias("_v"))
    owner = saved(wanted.join(held, F.col("v") == F.col("_v")).select("id", "cid"), "ann-owners")
    queries = saved(items.join(owner.select("cid").distinct(), "cid").select("cid", "v"), "ann-asked")
    some = count_rows(items)
    fitted = _matrix(items.orderBy(F.xxhash64("cid")).limit(FIT_ROWS).select("v").toPandas()["v"]) if some else np.zeros((1, 1))
    norm = items.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0] or 1.0
    blocks = placed(items, queries, Curves(fitted, norm, curves, dimensions, bits, seed), block_rows)
    sample = queries.orderBy(F.xxhash64(F.lit("sample"), "cid")).limit(SAMPLE_QUERIES)
    reach = needed_reach(blocks, sample, items, recall, k)
    near = candidates(blocks, reach, k + SPARE)
    # A class is its own nearest candidate when it has copies.
    near = near.unionByName(queries.select(F.col("cid").alias("q"), "cid"))
    asked = queries.select(F.col("cid").alias("_q"), F.col("v").alias("qv"))
    exact = near.join(asked, F.col("q") == F.col("_q")).join(items.withColumnRenamed("cid", "_i"), F.col("cid") == F.col("_i"))
    exact = exact.select("q", "ids", F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x).alias("score"))
    top = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    exact = exact.select("q", "score", F.explode("ids").alias("vec_id")).withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= k + 1)
    best = saved(exact.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("_r", "vec_id", "score"))).alias("best")), "ann-best")
    out = owner.join(best, F.col("cid") == F.col("q")).select("id", F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("id")), 1, k).alias("best"))
    return out.select(F.col("id").alias("query_id"), F.posexplode("best").alias("_at", "_b")).select(
        "query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_b.vec_id").alias("vec_id"), F.col("_b.score").alias("score")
    )
