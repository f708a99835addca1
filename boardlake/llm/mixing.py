"""Mixing sources to target weights by Pfair scheduling.

Every source has an integer share e of the P slots of a cycle. Its i-th block in the cycle may
start at its release time floor((i - 1) P / e) and must have run by its deadline ceil(i P / e).
Slot after slot, of the released blocks the one with the earliest deadline runs (ties: larger
share, then source name). Since the shares fill the cycle, no slot is idle and no deadline is
missed, so after any number of slots every source is less than one block from its target.

The schedule repeats with the cycle, so it is worked out for one cycle only: P slots, a number
that depends on the shares and not on the rows. Block j of a source stands in cycle
(j - 1) div e at the slot of its (j - 1) mod e + 1-th block. A source that has run out leaves
its later slots empty and the others move up, keeping their shares among themselves. No row is
dropped or repeated.

Rows of a source are put in an order by a seeded digest of doc_id. They are numbered in two
steps, within slices of that order and then over the slices, so that a source with a third of
all rows is spread over many tasks.

Defined cases: rows without a source form the source null, which has a share like any other.
Sources named in ``shares`` but absent are ignored; sources not named get one share. Equal
doc_ids are ordered by their text. An empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, count_rows, packed, text_of

BLOCK_ROWS = 8
CYCLE = 1000
SLICE_ROWS = 4_000
SEED = "mix-1"


def tempered(counts: DataFrame, cycle: int = CYCLE, power: float = 0.5) -> DataFrame:
    """Shares in proportion to ``rows ** power``, rounded, at least one."""
    weight = F.sqrt("n") if power == 0.5 else F.pow("n", F.lit(power))
    total = F.sum(weight).over(Window.partitionBy(F.lit(1)))
    share = F.greatest(F.floor(weight * cycle / total + 0.5), F.lit(1)).cast("bigint")
    return counts.select("source", "n", share.alias("share"))


def given(counts: DataFrame, shares: dict[str, int]) -> DataFrame:
    """Shares as given; a source not named gets one."""
    pairs = [x for k, v in shares.items() for x in (F.lit(k), F.lit(int(v)).cast("bigint"))]
    share = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("source")), F.lit(1)) if pairs else F.lit(1)
    return counts.select("source", "n", F.greatest(share, F.lit(1)).cast("bigint").alias("share"))


def schedule(plan: DataFrame) -> DataFrame:
    """Slots of one cycle: ``slot``, ``source`` and ``turn``, the block's number in the cycle.

    The sources (one row each) are gathered in one row, and the earliest deadline is picked
    slot by slot over arrays with one entry per source.
    """
    one = plan.agg(
        F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("by"), F.coalesce("source", F.lit("")).alias("name"), "source", F.col("share").alias("e")))).alias("s"),
        F.sum("share").alias("p"),
    )
    return one.selectExpr("s", """
        aggregate(
          sequence(0, int(coalesce(p, 1)) - 1),
          named_struct('done', transform(s, x -> 0L), 'out', cast(array() as array<struct<k:int,turn:bigint>>)),
          (acc, t) -> transform(array(array_min(transform(
              filter(transform(s, (x, k) -> named_struct('due', ceil((acc.done[k] + 1) * p / x.e), 'k', k, 'e', x.e, 'n', acc.done[k])),
                     y -> y.n < y.e and floor(y.n * p / y.e) <= t),
              y -> named_struct('due', y.due, 'k', y.k, 'n', y.n)))),
            b -> named_struct(
              'done', transform(acc.done, (d, k) -> if(k = b.k, d + 1, d)),
              'out', concat(acc.out, array(named_struct('k', b.k, 'turn', b.n + 1)))))[0],
          acc -> acc.out) as slots
    """).selectExpr("s", "posexplode(slots) as (slot, pick)").selectExpr(
        "cast(slot as bigint) as slot", "s[pick.k].source as source", "pick.turn as turn"
    ).where("turn is not null")


def _order_key(seed: str) -> Column:
    """Rows without doc_id take their text's hash, so that they are spread as well."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("_doc").cast("string"), F.col("_th").cast("string"))))


def small(df: DataFrame, limit: int = 200_000) -> DataFrame:
    """``df`` to be sent to every task if its rows, some tens of bytes each, are counted and few."""
    return F.broadcast(df) if count_rows(df) <= limit else df


def numbered(docs: DataFrame, counts: DataFrame, seed: str = SEED, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``_row``, ``_source``, ``_doc`` and ``_nth``, the row's number in its source from 1.

    The digest is spread evenly, so its leading digits cut each source into slices of about
    equal size; their number follows the number of rows.
    """
    total = counts.agg(F.max("n")).first()[0] or 0
    digits = max(0, math.ceil(math.log(total / slice_rows, 16))) if total > slice_rows else 0
    rows = packed(docs, F.col("source").cast("string").alias("_source"), F.col("doc_id").alias("_doc"), F.xxhash64(text_of()).alias("_th"))
    rows = rows.withColumn("_key", _order_key(seed)).withColumn("_slice", F.substring("_key", 1, digits))
    sizes = rows.groupBy("_source", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = checkpoint(sizes.select(F.col("_source").alias("_s2"), F.col("_slice").alias("_l2"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    inside = Window.partitionBy("_source", "_slice").orderBy("_key", "_doc", "_th")
    ranked = rows.withColumn("_rn", F.row_number().over(inside).cast("bigint"))
    on = ranked["_source"].eqNullSafe(bases["_s2"]) & (ranked["_slice"] == bases["_l2"])
    return ranked.join(small(bases), on).select("_row", "_source", "_doc", (F.col("_rn") + F.col("_base")).alias("_nth"))


def _plan(docs: DataFrame, shares: dict[str, int] | None, cycle: int) -> DataFrame:
    """Size and share per source."""
    counts = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return checkpoint(given(counts, shares) if shares else tempered(counts, cycle))


def _slotted(keyed: DataFrame, plan: DataFrame, source: str, block: str) -> DataFrame:
    """Add ``cycle`` and ``slot`` of a source's block to rows that name both."""
    slots = checkpoint(
        schedule(plan).join(plan.select(F.col("source").alias("_p"), F.col("share").alias("_e")), F.col("source").eqNullSafe(F.col("_p")))
        .select(F.col("source").alias("_ss"), F.col("turn").alias("_turn"), "slot", "_e")
    )
    shares = plan.select(F.col("source").alias("_ps"), F.col("share").alias("_share"))
    rows = keyed.join(small(shares), keyed[source].eqNullSafe(shares["_ps"])).withColumn("cycle", F.floor((F.col(block) - 1) / F.col("_share")))
    turn = F.col(block) - F.col("cycle") * F.col("_share")
    return rows.join(small(slots), rows["_ps"].eqNullSafe(slots["_ss"]) & (turn == slots["_turn"])).drop("_ps", "_share", "_ss", "_turn", "_e")


def mixed(docs: DataFrame, shares: dict[str, int] | None = None, *, cycle: int = CYCLE, block_rows: int = BLOCK_ROWS, seed: str = SEED, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``doc_id``, ``source``, ``block``, ``cycle``, ``slot`` and ``position``, the row's place from 0.

    ``shares`` maps source names to integer weights; without it, shares follow the square root
    of the sources' sizes. Only tables with a row per source, slot or slice are gathered.
    """
    narrow = docs.select("doc_id", "source", F.xxhash64(text_of()).cast("string").alias("text"))
    found = with_position(narrow, shares, cycle=cycle, block_rows=block_rows, seed=seed, slice_rows=slice_rows)
    return found.select("_row.doc_id", F.col("_row.source").cast("string").alias("source"), "block", "cycle", "slot", "position")


def with_position(docs: DataFrame, shares: dict[str, int] | None = None, *, cycle: int = CYCLE, block_rows: int = BLOCK_ROWS, seed: str = SEED, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``_row``, the whole row, and its ``block``, ``cycle``, ``slot`` and ``position``."""
    plan = _plan(docs, shares, cycle)
    rows = numbered(docs, plan, seed, slice_rows).select("_row", "_source", "_nth")
    # Places of the blocks: one row per block, made from the counts alone.
    last, run = F.ceil(F.col("n") / block_rows), 10_000
    runs = plan.select(F.col("source").alias("_p"), "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((last - 1) / run))).alias("_run")).repartition("_p", "_run")
    inner = F.sequence(F.col("_run") * run + 1, F.least(last, (F.col("_run") + 1) * run))
    blocks = runs.select("_p", "n", F.explode(inner).alias("block"))
    blocks = _slotted(blocks, plan, "_p", "block").withColumn("_size", F.least(F.lit(block_rows), F.col("n") - (F.col("block") - 1) * block_rows))
    # Rows before a cycle: each source has given its share of every cycle, or all it has.
    ends = checkpoint(plan.agg(F.collect_list(F.struct("share", "n")).alias("_ends"), F.lit(0).cast("bigint").alias("_zero")))
    start = F.aggregate("_ends", F.lit(0).cast("bigint"), lambda a, s: a + F.least(s["n"], F.col("cycle") * s["share"] * block_rows))
    inside = Window.partitionBy("cycle").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.join(F.broadcast(ends), F.col("cycle") * 0 == F.col("_zero")).withColumn("_at", start + F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    placed = checkpoint(placed.select(F.col("_p").alias("_bs"), F.col("block").alias("_bb"), "cycle", "slot", "_at"))
    rows = rows.withColumn("block", F.floor((F.col("_nth") - 1) / block_rows) + 1)
    on = rows["_source"].eqNullSafe(placed["_bs"]) & (rows["block"] == placed["_bb"])
    return rows.join(placed, on).select(
        "_row", "block", "cycle", "slot",
        (F.col("_at") + F.pmod(F.col("_nth") - 1, F.lit(block_rows))).alias("position"),
    )


def in_mixed_order(docs: DataFrame, shares: dict[str, int] | None = None, *, cycle: int = CYCLE, block_rows: int = BLOCK_ROWS, seed: str = SEED, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``docs`` in the order of the mix, sorted through the partitions; no row is lost.

    Whole rows are shuffled twice, to number them and to sort them.
    """
    plan = _plan(docs, shares, cycle)
    rows = numbered(docs, plan, seed, slice_rows).withColumn("_block", F.floor((F.col("_nth") - 1) / block_rows) + 1)
    order = ["cycle", "slot", "_nth"]
    return _slotted(rows, plan, "_source", "_block").repartitionByRange(*order).sortWithinPartitions(*order).select("_row.*")
