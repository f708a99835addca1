"""Merkle manifest of a dataset: one tree per group, one tree over the groups' roots.

1. A row's leaf is a hash of its columns. The doc_ids of a group make a bitmap, cut into containers
   of 2^15 ids. Tasks build partial containers, which merge by OR; blocks of a container without
   an id are dropped, and a popcount directory holds the ids below each block. Containers of a
   group carry the rows of the containers before them.
2. A row's place among the leaves is a rank query: rows before its container, ids before its
   block, ids before its bit. No rows are sorted.
3. Places are cut into slot arrays of ``ARITY ** LEVELS``. A slot array folds that many levels
   at once; its root is a slot of the next round's arrays. The groups' roots, numbered in order of
   the groups, go through the same rounds.
4. On the way back, every slot array gets the path of its root (what stands left and right of
   the node on each level) and hands each slot its own path. The proof is the hash of a leaf's
   path; folding a leaf along the path gives the root it belongs to.

All groups are cut alike, so a group with a third of the rows is many slot arrays. A task
holds a few arrays at a time.

Defined cases: null columns are written ``-``. Rows of one group that share a doc_id stand
together, ordered by leaf hash; those without doc_id come first in their group, in the same
order, and are never tampered with. Such rows alone are numbered by sorting. Repeated rows are
leaves of their own; which of two equal leaves comes first does not matter. Null groups
come first, the others by their UTF-8 bytes. An empty table gives an empty result. Columns other
than the five are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import ordered
from .common import saved

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
#: Levels a slot array folds at once.
LEVELS = 5
CONTAINER_BITS = 15
BLOCK_BITS = 10
_POWERS = [ARITY**k for k in range(40)]
PATH = "array<struct<l:string,r:string>>"


def written(column: Column) -> Column:
    """A value with its length in bytes before it; ``-`` if null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(text: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """Hash of the fields; ``text`` stands for the last one."""
    return F.sha2(F.concat(*[written(F.col(c)) for c in fields[:-1]], written(text)).cast("binary"), 256)


def tampered_with(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(2)) == 0, F.lit(False))


def leaves(docs: DataFrame, tamper: bool = False) -> DataFrame:
    """doc_id, ``group`` (source, never null), ``leaf``, and with ``tamper`` the leaf after tampering."""
    text = F.col("text").cast("string")
    other = F.when(tampered_with(F.col("doc_id")) & F.contains(text, F.lit("\n")), leaf_hash(F.translate(text, "\n", "")))
    group = written(F.col("source"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), group.alias("group"),
        leaf_hash(text).alias("leaf"), (other if tamper else F.lit(None).cast("string")).alias("other"),
    )


# Places.
def containers(rows: DataFrame) -> DataFrame:
    """The bitmap of each group: ``high``, the blocks that hold ids, and the directory over all blocks.

    ``below`` has the ids before each block, ``held`` the blocks with ids before it, ``n_ids`` and ``n_rows`` the totals.
    """
    block = 1 << (BLOCK_BITS - 3)
    blocks = 1 << (CONTAINER_BITS - BLOCK_BITS)
    low = F.col("doc_id").bitwiseAND(F.lit((1 << CONTAINER_BITS) - 1))
    merged = rows.where("doc_id is not null").groupBy("group", F.shiftright("doc_id", CONTAINER_BITS).alias("high")).agg(
        F.bitmap_construct_agg(low).alias("bits"), F.count(F.lit(1)).alias("n_rows")
    )
    cut = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.substring(F.col("bits"), b * block + 1, F.lit(block)))
    cut = merged.select("group", "high", "n_rows", F.bitmap_count("bits").alias("n_ids"), cut.alias("cut"))
    counted = cut.withColumn("count", F.transform("cut", lambda b: F.bitmap_count(b).cast("int")))

    def before(values: Column) -> Column:
        start = F.array(F.lit(0))
        return F.aggregate(values, start, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    full = F.filter("cut", lambda b: F.bitmap_count(b) > 0)
    return counted.select(
        "group", "high", "n_rows", "n_ids", F.aggregate(full, F.lit(b""), lambda acc, b: F.concat(acc, b)).alias("blocks"),
        before(F.col("count")).alias("below"), before(F.transform("count", lambda c: (c > 0).cast("int"))).alias("held"),
    )


def rank_in(doc_id: Column) -> Column:
    """Ids of the container below this one."""
    position = doc_id.bitwiseAND(F.lit((1 << CONTAINER_BITS) - 1)).cast("int")
    b = F.shiftright(position, BLOCK_BITS)
    start = F.get("held", b) * (1 << (BLOCK_BITS - 3))
    byte = F.shiftright(position, 3).bitwiseAND(F.lit((1 << (BLOCK_BITS - 3)) - 1))
    whole = F.bitmap_count(F.substring(F.col("blocks"), start + 1, byte))
    last = F.conv(F.hex(F.substring(F.col("blocks"), start + byte + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.array(*[F.lit((1 << k) - 1) for k in range(8)])
    return F.get("below", b) + whole + F.bit_count(last.bitwiseAND(F.get(mask, position.bitwiseAND(F.lit(7)))))


def places(rows: DataFrame) -> DataFrame:
    """``rows`` (saved) with ``place``, the row's number among its group's leaves, from 0."""
    held = saved(containers(rows), "manifest-containers")
    without = rows.where("doc_id is null").groupBy(F.col("group").alias("_wg")).agg(F.count(F.lit(1)).alias("_without"))
    before = ordered(held.select("group", "high", "n_rows"), ["group"], ["high"], running={"upto": F.col("n_rows")})
    before = before.join(without, F.col("group") == F.col("_wg"), "left").select(
        F.col("group").alias("_bg"), F.col("high").alias("_bh"), (F.col("upto") - F.col("n_rows") + F.coalesce("_without", F.lit(0))).alias("start")
    )
    held = held.join(before, (F.col("group") == F.col("_bg")) & (F.col("high") == F.col("_bh"))).drop("_bg", "_bh")
    repeated = bool(held.where("n_rows > n_ids").limit(1).count())
    missing = bool(rows.where("doc_id is null").limit(1).count())
    extra = F.array().cast("array<struct<low:int,extra:bigint>>")
    if repeated:
        again = rows.where("doc_id is not null").groupBy(F.col("group").alias("_rg"), F.col("doc_id").alias("_rd")).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
        again = saved(again, "manifest-repeated")
        low = F.col("_rd").bitwiseAND(F.lit((1 << CONTAINER_BITS) - 1)).cast("int")
        lists = again.groupBy(F.col("_rg").alias("_lg"), F.shiftright("_rd", CONTAINER_BITS).alias("_lh")).agg(
            F.collect_list(F.struct(low.alias("low"), (F.col("_c") - 1).alias("extra"))).alias("_extra"))
        held = held.join(lists, (F.col("group") == F.col("_lg")) & (F.col("high") == F.col("_lh")), "left").drop("_lg", "_lh")
        extra = F.coalesce("_extra", extra)
    held = saved(held.select(F.col("group").alias("_g"), F.col("high").alias("_h"), "blocks", "below", "held", "start", extra.alias("extra")), "manifest-directory")
    there = (F.col("group") == F.col("_g")) & (F.shiftright("doc_id", CONTAINER_BITS) == F.col("_h"))
    low = F.col("doc_id").bitwiseAND(F.lit((1 << CONTAINER_BITS) - 1)).cast("int")
    more = F.aggregate(F.filter("extra", lambda e: e["low"] < low), F.lit(0).cast("bigint"), lambda acc, e: acc + e["extra"])
    place = F.col("start") + rank_in(F.col("doc_id")) + (more if repeated else F.lit(0))
    placed = rows.join(held, there).select(*rows.columns, place.cast("bigint").alias("place"))
    if repeated:
        same = (F.col("group") == F.col("_rg")) & (F.col("doc_id") == F.col("_rd"))
        twice = placed.join(again.drop("_c"), same, "left_semi")
        numbered = ordered(twice, ["group", "doc_id"], ["leaf"], number="_nth")
        placed = placed.join(again.drop("_c"), same, "left_anti").unionByName(
            numbered.withColumn("place", F.col("place") + F.col("_nth") - 1).drop("_nth"))
    if missing:
        numbered = ordered(rows.where("doc_id is null"), ["group"], ["leaf"], number="_nth")
        placed = placed.unionByName(numbered.withColumn("place", F.col("_nth") - 1).drop("_nth"))
    return placed


# Slot arrays.
def levels_of(n: Column) -> Column:
    """Levels above ``n`` nodes until one is left."""
    return F.size(F.filter(F.array(*[F.lit(p) for p in _POWERS]), lambda p: p < n))


def digest(texts: list[str]) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def folded_levels(nodes: list[str], steps: int) -> list[list[str]]:
    """A slot array and the levels above it, ``steps`` of them."""
    out = [nodes]
    for _ in range(steps):
        low = out[-1]
        out.append([digest(low[i : i + ARITY]) for i in range(0, len(low), ARITY)])
    return out


def inner_path(levels: list[list[str]], slot: int) -> list[tuple[str, str]]:
    """What stands left and right of the slot's node on each level."""
    out = []
    for level in levels[:-1]:
        first = slot - slot % ARITY
        out.append(("".join(level[first:slot]), "".join(level[slot + 1 : first + ARITY])))
        slot //= ARITY
    return out


def in_order(slots, values) -> list:
    """Values by their slots."""
    out = [None] * len(slots)
    for k, v in zip(slots, values):
        out[k] = v
    return out


def slot_arrays(nodes: DataFrame, carried: list[str], levels: int = LEVELS) -> DataFrame:
    """group, ``block``, ``steps`` and the columns of its nodes by slot (``group``, ``place``, ``left`` levels, ``node``)."""
    size = ARITY**levels
    cell = F.struct(F.pmod("place", F.lit(size)).cast("int").alias("slot"), "node", *carried)
    grouped = nodes.groupBy("group", F.floor(F.col("place") / size).cast("bigint").alias("block")).agg(
        F.collect_list(cell).alias("cells"), F.first("left").alias("left"))
    return grouped.select("group", "block", "left", F.least("left", F.lit(levels)).cast("int").alias("steps"), "cells")


def array_roots(arrays: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The roots of the slot arrays, as nodes of the next round."""

    @F.pandas_udf("string")
    def root(slots: pd.Series, nodes: pd.Series, steps: pd.Series) -> pd.Series:
        return pd.Series([folded_levels(in_order(s, n), k)[-1][0] for s, n, k in zip(slots, nodes, steps)], dtype=object)

    left = F.greatest(F.col("left") - levels, F.lit(0)).cast("int")
    return arrays.select("group", F.col("block").alias("place"), left.alias("left"), root("cells.slot", "cells.node", "steps").alias("node"))


def rounds_above(arrays: DataFrame, name: str, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """Slot arrays of all rounds, lowest first, and the groups' roots (group, ``node``)."""
    rounds = [arrays]
    while True:
        nodes = saved(array_roots(rounds[-1], levels), f"{name}-roots")
        if not (nodes.agg(F.max("place")).first()[0] or 0):
            return rounds, nodes.select("group", "node")
        rounds.append(saved(slot_arrays(nodes, [], levels), f"{name}-arrays"))


def handed_down(arrays: DataFrame, paths: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Paths of the slots (group, ``place``, ``path``), given those of the arrays."""

    @F.pandas_udf(f"array<struct<slot:int,path:{PATH}>>")
    def inner(slots: pd.Series, nodes: pd.Series, steps: pd.Series) -> pd.Series:
        out = []
        for s, n, k in zip(slots, nodes, steps):
            found = folded_levels(in_order(s, n), k)
            out.append([{"slot": i, "path": [{"l": a, "r": b} for a, b in inner_path(found, i)]} for i in range(len(n))])
        return pd.Series(out, dtype=object)

    above = paths.select(F.col("group").alias("_g"), F.col("place").alias("_b"), F.col("path").alias("above"))
    rows = arrays.join(above, (F.col("group") == F.col("_g")) & (F.col("block") == F.col("_b")))
    rows = rows.select("group", "block", "above", F.explode(inner("cells.slot", "cells.node", "steps")).alias("x"))
    return rows.select("group", (F.col("block") * ARITY**levels + F.col("x.slot")).alias("place"), F.concat("x.path", "above").alias("path"))


def paths_down(rounds: list[DataFrame], tops: DataFrame, name: str, levels: int = LEVELS) -> DataFrame:
    """Paths of the lowest arrays, given those of the groups' roots (group, ``path``)."""
    paths = tops.select("group", F.lit(0).cast("bigint").alias("place"), "path")
    for arrays in reversed(rounds[1:]):
        paths = saved(handed_down(arrays, paths, levels), f"{name}-paths")
    return paths


def proofs(arrays: DataFrame, paths: DataFrame) -> DataFrame:
    """doc_id, group, leaf, proof_sha256 and folded_root of every leaf of the lowest arrays."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for group, ids, slots, nodes, others, steps, above in zip(*[batch[c] for c in ("group", "ids", "slots", "nodes", "others", "steps", "above")]):
                leaf, other = in_order(slots, nodes), in_order(slots, others)
                found = folded_levels(leaf, steps)
                upper = [(p["l"], p["r"]) for p in above]
                shown, folded = [], []
                for i, own in enumerate(leaf):
                    path = inner_path(found, i) + upper
                    shown.append(digest([l + r for l, r in path]))
                    node = own if other[i] is None else other[i]
                    for l, r in path:
                        node = digest([l, node, r])
                    folded.append(node)
                yield pd.DataFrame({"doc_id": in_order(slots, ids), "group": group, "leaf": leaf, "proof_sha256": shown, "folded_root": folded})

    above = paths.select(F.col("group").alias("_g"), F.col("place").alias("_b"), F.col("path").alias("above"))
    both = arrays.join(above, (F.col("group") == F.col("_g")) & (F.col("block") == F.col("_b")))
    # As text, since a list of numbers with a null among them would come as floating-point numbers.
    ids = F.col("cells.doc_id").cast("array<string>").alias("ids")
    cells = [F.col(f"cells.{c}").alias(n) for c, n in (("slot", "slots"), ("node", "nodes"), ("other", "others"))]
    out = both.select("group", ids, *cells, "steps", "above").mapInPandas(rows, "doc_id string, group string, leaf string, proof_sha256 string, folded_root string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def manifest(docs: DataFrame, tamper: bool = False, levels: int = LEVELS) -> DataFrame:
    """Leaf, roots and proof of every row; ``folded_root`` comes from the tampered row if there is one."""
    rows = saved(leaves(docs, tamper), "manifest-leaves")
    groups = saved(rows.groupBy("group").agg(F.first("source").alias("source"), F.count(F.lit(1)).alias("n")), "manifest-groups")
    left = groups.select(F.col("group").alias("_lg"), levels_of(F.col("n")).alias("left"))
    nodes = places(rows).join(left, F.col("group") == F.col("_lg")).withColumn("node", F.col("leaf"))
    arrays = saved(slot_arrays(nodes, ["doc_id", "other"], levels), "manifest-arrays")
    rounds, subroots = rounds_above(arrays, "manifest", levels)

    several = groups.count()
    numbered = ordered(groups.select("group", "source"), [], ["source"], number="_nth")
    tops = subroots.join(numbered.select(F.col("group").alias("_ng"), "_nth"), F.col("group") == F.col("_ng"))
    tops = tops.select("group", F.col("node").alias("subroot"), (F.col("_nth") - 1).alias("place"))
    tops = saved(tops, "manifest-subroots")
    one = tops.select(F.lit("").alias("group"), "place", levels_of(F.lit(several)).alias("left"), F.col("subroot").alias("node"))
    top_arrays = saved(slot_arrays(one, [], levels), "manifest-top")
    top_rounds, root = rounds_above(top_arrays, "manifest-top", levels)
    top = root.first()
    nothing = root.select("group", F.array().cast(PATH).alias("path"))
    by_place = handed_down(top_arrays, paths_down(top_rounds, nothing, "manifest-top", levels), levels)
    tops = saved(tops.join(by_place.select(F.col("place").alias("_p"), "path"), F.col("place") == F.col("_p")).select("group", "subroot", "path"), "manifest-tops")

    found = proofs(rounds[0], paths_down(rounds, tops, "manifest", levels))
    found = found.join(tops.select(F.col("group").alias("_tg"), "subroot"), F.col("group") == F.col("_tg"))
    root = F.lit(top["node"] if top else None).cast("string")
    return found.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
