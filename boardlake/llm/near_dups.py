"""MinHash near-dedup with bottom-k sketches from one hash function.

1. Every whole text becomes its set of five-word shingles (63-bit hashes); equal sets form one
   class, found by a 128-bit digest. All further work is on classes.
2. A sketch is the ``K`` smallest hashes of a set. Sketch values held by one class only link
   nothing and are left out. Two linked classes share at least ``least_overlap`` sketch values
   (below), so they share one within the rarest ``size - least_overlap + 1`` values of each:
   those make the inverted lists, and very common passages drop out of them by themselves.
3. Lists of up to ``LIST_ROWS`` classes give their pairs. Longer ones do not. Their most central
   class is the pivot, lists with the same pivot form a group, and each member is compared with
   the pivot on full sets; members linked with it need no further test among themselves. For the
   others: the group's core is the pivot's shingles and all that more than ``LIST_ROWS`` members
   have. Two members share no more than the smaller of their parts in the core, and what they share
   outside it. So a pair either meets in a short list outside the core, or both have enough
   of the core for a link by itself. The latter are compared with one pivot of theirs after the
   other until few pairs are left, or a pivot no longer takes a quarter of them away, and those are asked. A member linked with a pivot is closed
   toward the others linked with it, and goes on to be asked, in a group of its own, against the
   members closed before that may still be linked with it: Jaccard distance is a metric, so their
   distances to each pivot differ by no more than a link has; and two that are connected by links
   found so far need no test. What a member alone has or lacks against the first pivot tells it from every other, so members with much
   of that go at once. Those left are compared by their differences from the first pivot, which say as much as the full sets, block
   by block of a group's members: a block of those that ask meets one of those asked in NumPy, a task never holds more, and of what
   it finds only links come out that connect what was not connected. The bounds are exact, no connection is lost.
4. Pairs pass the union-sketch estimate, then 100 * intersection >= 85 * union on full sets.
5. Links are contracted to components, round by round, in tables.

``least_overlap``: among the ``K`` smallest hashes of a union, the part in both sets follows the
similarity; at 0.85 and K = 64 fewer than 40 have a probability below 1e-5, and for small sets
the bound is exact.

Defined cases: null texts and texts without words have an empty set, component_id is their own
doc_id. Fewer than five words make one shingle. Rows with equal doc_id are judged by their own
text. A row without doc_id is never the smallest; it is kept only if its group has no doc_id at
all. Ties cannot matter: components do not depend on order. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, count_rows, packed, saved
from .hashing import batches_of_words, set_digest, shingle_set

LENGTH = 5
K = 64
LEAST_SHARED = 40
PERCENT = 85
LIST_ROWS = 64
SENT_ROWS = 500_000
PAIRS_AT_ONCE = 2_000_000
#: A turn is a pass over tables, worth taking if it saves so many comparisons, or a quarter of them.
TURN_SAVES = 200_000_000
#: Members, and values of their differences, in a block of the last comparison.
BLOCK_MEMBERS = 2_000
BLOCK_VALUES = 2_000_000
#: Groups within groups that take pivots; what is left of deeper ones is asked pair by pair.
TURNS_DEEP = 4
#: Of members whose core alone may do: in each group, those ``open`` are asked against those ``other``.
#: ``size`` is the set's, ``own`` what no other member has or lacks against the pivot, ``common`` the rest of that difference.
HEAVY = ("group", "node", "central", "open", "other", "far", "label", "size", "own", "common")


def least_shared(percent: int, k: int = K) -> int:
    """Sketch values shared at this similarity but for a probability below 1e-5; no more than ``LEAST_SHARED``."""
    p, below = percent / 100, 0.0
    for n in range(LEAST_SHARED):
        below += math.comb(k, n) * p**n * (1 - p) ** (k - n)
        if below >= 1e-5:
            return n
    return LEAST_SHARED


def small(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """``df``, a key or two per row, sent to every task if its rows are counted and few."""
    return F.broadcast(df) if count_rows(df) <= rows else df


def sketches(docs: DataFrame, length: int = LENGTH, k: int = K) -> DataFrame:
    """doc_id, ``th`` (hash of the text), n_shingles, digest and sketch of every row."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, digests, lowest = [], [], []
            for found in batches_of_words(batch["text"]):
                values = shingle_set(found, length)
                sizes.append(len(values))
                digests.append(set_digest(values) if len(values) else None)
                lowest.append(values[:k])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "th": batch["th"], "n_shingles": sizes, "digest": digests, "sketch": lowest})

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    return source.mapInPandas(rows, "doc_id long, th long, n_shingles long, digest binary, sketch array<long>")


def full_sets(docs: DataFrame, nodes: DataFrame, length: int = LENGTH) -> DataFrame:
    """``node`` and its whole set, for classes given with node, digest and first document."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            node, digests, sets = [], [], []
            for name, digest, found in zip(batch["node"], batch["digest"], batches_of_words(batch["text"])):
                values = shingle_set(found, length)
                if set_digest(values) == bytes(digest):  # another row may have the same doc_id
                    node.append(name)
                    digests.append(digest)
                    sets.append(values)
            if node:
                yield pd.DataFrame({"node": node, "set": pd.Series(sets, dtype=object)})

    wanted = nodes.select("node", "digest", F.col("first").alias("_first"), F.col("th").alias("_th"))
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.xxhash64("text").alias("_dh"), F.col("text").cast("string").alias("text"))
    # By the text's hash too: a class meets its own text, not all texts that share a doc_id or have none.
    mine = F.col("_doc").eqNullSafe(F.col("_first")) & (F.col("_dh") == F.col("_th"))
    found = texts.join(small(wanted, SENT_ROWS // 4), mine).select("node", "digest", "text")
    return found.mapInPandas(rows, "node long, set array<long>").dropDuplicates(["node"])


def shared_values(classes: DataFrame, k: int = K) -> DataFrame:
    """Sketch values that two classes or more hold: node, value, df and sketch size."""
    values = classes.select("node", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    counts = saved(values.groupBy(F.col("value").alias("_v")).agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "sketch-values")
    return values.join(counts, F.col("value") == F.col("_v")).select("node", "size", "value", "df")


def least_overlap(size: Column, k: int = K, percent: int = PERCENT, least: int = LEAST_SHARED) -> Column:
    """Sketch values a class of this sketch size shares with any class it is linked with."""
    exact = F.ceil(size * percent / 100.0)
    return F.when(size * 100 <= k * percent, exact).otherwise(F.least(exact, F.lit(least)))


def index(shared: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Inverted lists over each class's rarest values, and the centrality of each class."""
    entry = F.array_sort(F.collect_list(F.struct("df", "value")))
    held = shared.groupBy("node", "size").agg(entry.alias("held"), F.sum("df").alias("central"))
    room = F.col("size") - least_overlap(F.col("size"), percent=percent, least=least_shared(percent)) + 1 - (F.col("size") - F.size("held"))
    held = saved(held.withColumn("held", F.slice("held", F.lit(1), F.greatest(room, F.lit(0)).cast("int"))).where(F.size("held") > 0), "near-index")
    return held.select("node", F.explode("held.value").alias("value")), held.select("node", "central")


def list_pairs(lists: DataFrame, key: list[str], flag: str | None = None) -> DataFrame:
    """Distinct pairs a < b of the nodes of each short list; with ``flag``, one of them has it."""
    entry = F.struct("node", F.col(flag) if flag else F.lit(True).alias("flag"))
    grouped = lists.groupBy(*key).agg(F.collect_set(entry).alias("all"))
    left = grouped.select("all", F.explode("all").alias("x"))
    near = F.filter("all", lambda y: (y["node"] > F.col("x.node")) & (F.col("x")[flag or "flag"] | y[flag or "flag"]))
    return left.select(F.col("x.node").alias("a"), F.explode(near).alias("y")).select("a", F.col("y.node").alias("b")).distinct()


def _sized(lists: DataFrame, key: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the short lists and rows of the long ones; lists of one are gone."""
    counts = lists.groupBy(*key).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    counts = saved(counts.select(*[F.col(c).alias(f"_k_{c}") for c in key], "_c"), "list-sizes")
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_k_{c}") for c in key])
    rows = lists.join(counts, on)
    return rows.where(F.col("_c") <= limit).select(*lists.columns), rows.where(F.col("_c") > limit).select(*lists.columns)


def _both(pairs: DataFrame, facts: DataFrame, a: str, b: str, *columns: str) -> DataFrame:
    for side in (a, b):
        pairs = pairs.join(facts.select(F.col("node").alias(f"_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in columns]), F.col(side) == F.col(f"_{side}")).drop(f"_{side}")
    return pairs


def plausible(pairs: DataFrame, classes: DataFrame, k: int = K, least: int = LEAST_SHARED) -> DataFrame:
    """Pairs whose union sketch has enough values in both."""
    rows = _both(pairs, classes, "a", "b", "sketch")
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
    both = F.size(F.array_intersect("union", F.array_intersect("sketch_a", "sketch_b")))
    return rows.withColumn("union", union).where(both * k >= F.size("union") * least).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs that are similar enough on full sets."""
    rows = _both(pairs, sets, "a", "b", "set").withColumn("both", F.size(F.array_intersect("set_a", "set_b")))
    return rows.where(100 * F.col("both") >= percent * (F.size("set_a") + F.size("set_b") - F.col("both"))).select("a", "b")


def _possible(shared: Column, percent: int) -> Column:
    """Whether ``shared`` shingles can do for a link with the smallest partner there is."""
    return (100 + percent) * shared >= percent * (F.col("n") + F.greatest("low", F.ceil(F.col("n") * percent / 100.0)))


def _against(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``rows`` (``pivot``, ``node``, ...) with the set size ``n``, ``both``, ``linked``, the distance ``apart``, ``more``, what the pivot lacks, and ``less``, what it has alone."""
    held = sets.select(F.col("node").alias("_n"), "set")
    theirs = sets.select(F.col("node").alias("_p"), F.col("set").alias("pset"))
    found = rows.join(held, F.col("node") == F.col("_n")).join(theirs, F.col("pivot") == F.col("_p"))
    more, less, n = F.array_except("set", "pset"), F.array_except("pset", "set"), F.size("set")
    found = found.select(*rows.columns, n.alias("n"), F.size("pset").alias("_pn"), more.alias("more"), less.alias("less")).withColumn("both", F.col("n") - F.size("more"))
    union = F.col("n") + F.col("_pn") - F.col("both")
    return found.withColumn("linked", 100 * F.col("both") >= percent * union).withColumn("apart", 1 - F.col("both") / union).drop("_pn")


def _unconnected(heavy: DataFrame, labels: DataFrame) -> DataFrame:
    """``heavy`` without the members that are connected with all that their group still asks for."""
    named = heavy.drop("label").join(labels.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").drop("_n")
    named = saved(named.withColumn("label", F.coalesce("label", "node")), "near-labelled")
    sides = [F.when(F.col(side), F.col("label")) for side in ("open", "other")]
    ends = named.groupBy(F.col("group").alias("_g")).agg(*[f(side).alias(f"_{f.__name__}{k}") for k, side in enumerate(sides) for f in (F.min, F.max)])
    rows = named.join(small(checkpoint(ends.where("_min0 is not null and _min1 is not null"))), F.col("group") == F.col("_g"))
    known = [(F.col(f"_min{k}") == F.col(f"_max{k}")) & (F.col("label") == F.col(f"_min{k}")) for k in (0, 1)]
    rows = rows.select(*[(F.col(c) & ~known[1]).alias(c) if c == "open" else (F.col(c) & ~known[0]).alias(c) if c == "other" else F.col(c) for c in HEAVY])
    return saved(rows.where("open or other"), "near-heavy")


def _block_links(percent: int, reach: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Compares the members of a block that ask (``asks``) with those of another: links ``a``, ``b`` that connect labels not connected in the block yet."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = rows[rows["asks"]], rows[~rows["asks"]]
        a, b = [], []
        if len(x) and len(y):
            label = np.unique(np.concatenate([x["label"], y["label"]]), return_inverse=True)[1]
            root, lx, ly = np.arange(label.max() + 1), label[: len(x)], label[len(x) :]
            nx, ny = x["node"].to_numpy(np.int64), y["node"].to_numpy(np.int64)
            both_x, both_y = ((part["open"] & part["other"]).to_numpy(bool) for part in (x, y))
            far_x, far_y = np.stack(x["far"].to_list()), np.stack(y["far"].to_list())
            (size_x, own_x, common_x), (size_y, own_y, common_y) = (part[["size", "own", "common"]].to_numpy(np.int64).T for part in (x, y))
            # Members asked by the values of their differences.
            lengths = y["diff"].map(len).to_numpy(np.int64)
            values, owner = np.concatenate(y["diff"].to_list()), np.repeat(np.arange(len(y)), lengths)
            order = np.argsort(values, kind="stable")
            owner = owner[order]
            values, starts = np.unique(values[order], return_index=True)
            ends = np.append(starts[1:], len(owner))
            for i, diff in enumerate(x["diff"]):
                room = (100 - percent) * (size_y + size_x[i])
                may = (root[ly] != root[lx[i]]) & ((ny < nx[i]) | ~(both_y & both_x[i]) & (ny != nx[i]))
                may &= (own_y + own_x[i] + np.abs(common_y - common_x[i])) * (100 + percent) <= room
                may &= (np.abs(far_y - far_x[i]) <= reach).all(axis=1)
                if not may.any():
                    continue
                at = np.searchsorted(values, diff)
                at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == diff)] if len(values) else at[:0]
                met = np.concatenate([owner[starts[k] : ends[k]] for k in at]) if len(at) else owner[:0]
                differ = lengths + len(diff) - 2 * np.bincount(met, minlength=len(y))
                for k in np.flatnonzero(may & (differ * (100 + percent) <= room)):
                    if root[ly[k]] != root[lx[i]]:
                        a.append(ny[k])
                        b.append(nx[i])
                        root[root == root[ly[k]]] = root[lx[i]]
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return links


def _blocks_of(side: str, members: int = BLOCK_MEMBERS, values: int = BLOCK_VALUES) -> Column:
    """Blocks for the members of a group that are ``open`` or ``other``."""
    held = F.col(side).cast("long")
    return F.ceil(F.greatest(F.sum(held) / members, F.sum(held * (F.col("own") + F.col("common"))) / values)).cast("int")


def _asked_in_blocks(heavy: DataFrame, blocks: DataFrame, percent: int, reach: float) -> DataFrame:
    """Links of each group's open members with the others, from ``HEAVY`` and ``diff``; a pair of blocks is compared at once. ``blocks``: their numbers ``_x`` and ``_y`` for the group ``_s``."""
    dealt = heavy.join(blocks.select("_s", "_x", "_y"), F.col("group") == F.col("_s")).drop("_s")
    mine = F.xxhash64("node")
    x = dealt.where("open").withColumn("asks", F.lit(True)).withColumn("i", F.pmod(mine, F.col("_x")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("_y") - 1)))
    y = dealt.where("other").withColumn("asks", F.lit(False)).withColumn("j", F.pmod(mine, F.col("_y")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_x") - 1)))
    return x.unionByName(y).drop("_x", "_y").groupBy("group", "i", "j").applyInPandas(_block_links(percent, reach), "a long, b long")


def around_pivots(lists: DataFrame, sets: DataFrame, central: DataFrame, percent: int = PERCENT, limit: int = LIST_ROWS, at_once: int = PAIRS_AT_ONCE) -> tuple[list[DataFrame], list[DataFrame]]:
    """Links and further candidate pairs of long lists (``value``, ``node``); see the module's text."""
    if not count_rows(lists):
        return [], []
    lists = lists.join(central, "node")
    pivots = saved(lists.groupBy(F.col("value").alias("_v")).agg(F.max_by("node", F.struct("central", "node")).alias("pivot")), "near-pivots")
    # Lists with the same pivot become one group.
    groups = lists.join(pivots, F.col("value") == F.col("_v")).groupBy("pivot", "node").agg(F.max("central").alias("central"))
    rows = saved(_against(saved(groups, "near-groups"), sets, percent), "near-members")
    links = [rows.where("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b"))]
    # The pivot's shingles and those of more than ``limit`` members are the group's core; the
    # others make short lists.
    shingles = rows.select("pivot", "node", F.explode("more").alias("value"))
    counts = shingles.groupBy(F.col("pivot").alias("_p"), F.col("value").alias("_v")).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
    held = shingles.join(saved(counts, "near-counts"), (F.col("pivot") == F.col("_p")) & (F.col("value") == F.col("_v")))
    in_core = (F.col("_c") > limit).cast("long")
    sums = held.groupBy("pivot", "node").agg(F.sum(in_core).alias("core"), F.sum(1 - in_core).alias("others"))
    low = rows.groupBy("pivot").agg(F.min("n").alias("low"))
    facts = rows.select("pivot", "node", "central", "n", "both", "linked", "apart").join(sums, ["pivot", "node"], "left").join(low, "pivot")
    core = F.col("both") + F.coalesce("core", F.lit(0))
    facts = saved(facts.select(
        F.col("pivot").alias("_fp"), F.col("node").alias("_fn"), "central", "apart", (~F.col("linked")).alias("open"),
        _possible(core, percent).alias("heavy"), _possible(core + F.coalesce("others", F.lit(0)), percent).alias("alive"),
    ), "near-facts")
    short = held.where(F.col("_c") <= limit).join(facts.where("alive"), (F.col("pivot") == F.col("_fp")) & (F.col("node") == F.col("_fn")))
    pairs = [list_pairs(short.select("pivot", "value", "node", "open"), ["pivot", "value"], "open")]
    # Members whose core alone may do: pivots in turn, until the pairs left are few.
    reach = 1 - percent / 100 + 1e-9
    heavy = facts.where("heavy").select(
        "_fp", F.col("_fp").cast("string").alias("group"), F.col("_fn").alias("node"), "central", "open", F.lit(True).alias("other"),
        F.array("apart").alias("far"), F.when(F.col("open"), F.col("_fn")).otherwise(F.col("_fp")).alias("label"),
    )
    # Two members differ in all that is one's own, and in as much of the rest as one has more of than the other.
    differs = rows.join(heavy.select("_fp", F.col("node").alias("_hn")), (F.col("pivot") == F.col("_fp")) & (F.col("node") == F.col("_hn")))
    differs = saved(differs.select(F.col("pivot").alias("_dp"), F.col("node").alias("_dn"), F.col("n").alias("size"), F.concat("more", "less").alias("_d")), "near-differences")
    held_by = differs.select("_dp", "_dn", F.explode("_d").alias("_v")).groupBy("_dp", "_v").agg(F.count(F.lit(1)).alias("_c"), F.min("_dn").alias("_on"))
    alone = held_by.where("_c = 1").groupBy(F.col("_dp").alias("_op"), "_on").agg(F.count(F.lit(1)).alias("_alone"))
    own = F.coalesce("_alone", F.lit(0))
    measured = differs.join(alone, (F.col("_dp") == F.col("_op")) & (F.col("_dn") == F.col("_on")), "left").select(
        "_dp", "_dn", "size", own.alias("own"), (F.size("_d") - own).alias("common"))
    heavy = heavy.join(measured, (F.col("_fp") == F.col("_dp")) & (F.col("node") == F.col("_dn"))).select(*HEAVY)
    largest = F.col("size") * (1 + 100 / percent) * (100 - percent) / (100 + percent) + 1e-6  # difference with the largest partner there is
    heavy = saved(heavy.where(F.col("own") <= largest), "near-heavy")
    labels, before = None, None
    while True:
        asks = F.sum(F.col("open").cast("long")) * F.sum(F.col("other").cast("long"))
        sizes = checkpoint(heavy.groupBy(F.col("group").alias("_s")).agg(asks.alias("_asks"), _blocks_of("open").alias("_x"), _blocks_of("other").alias("_y")).where("_asks > 0"))
        may_turn = F.size(F.split("group", "/")) <= TURNS_DEEP
        left = sizes.withColumnRenamed("_s", "group").where(may_turn).agg(F.sum("_asks")).first()[0] or 0
        if left <= at_once or before is not None and before - left < min(before / 4, TURN_SAVES):
            break
        before = left
        heavy = saved(heavy.join(small(sizes.select("_s")), F.col("group") == F.col("_s"), "left_semi"), "near-asking")
        kept, heavy = heavy.where(~may_turn), heavy.where(may_turn)
        turn = saved(heavy.where("open").groupBy(F.col("group").alias("_g")).agg(F.max_by("node", F.struct("central", "node")).alias("pivot")), "near-turn")
        asked = heavy.join(turn, F.col("group") == F.col("_g")).select(*HEAVY, "pivot")
        asked = saved(_against(asked, sets, percent).drop("more", "less").withColumn("far", F.concat("far", F.array("apart"))), "near-asked")
        found = asked.where("linked").select(F.col("pivot").alias("a"), F.col("node").alias("b")).where("a <> b")
        links.append(found)
        not_pivot = F.col("node") != F.col("pivot")
        rest = asked.where(not_pivot).withColumn("open", F.col("open") & ~F.col("linked"))
        # Those closed now have not met the members closed before that are not linked with this pivot;
        # the next pivot is one of the latter.
        earlier = F.col("other") & ~F.col("open") & ~F.col("linked") & (F.col("apart") <= 2 * reach)
        apart = asked.where(not_pivot & ((F.col("open") & F.col("linked")) | earlier)).withColumn("other", F.col("open")).withColumn("open", ~F.col("other"))
        apart = apart.withColumn("group", F.concat_ws("/", "group", F.col("pivot").cast("string")))
        known = [x.select("a", "b") for x in ([labels.select(F.col("node").alias("a"), F.col("label").alias("b"))] if labels is not None else links[:1])]
        labels = components(reduce(DataFrame.unionByName, [*known, found]))
        heavy = _unconnected(rest.select(*HEAVY).unionByName(apart.select(*HEAVY)).unionByName(kept), labels)
    # What a member shares with another is told by their differences from the first pivot, whole sets on both sides.
    first = F.split("group", "/")[0].cast("long")
    shapes = heavy.withColumn("_root", first).join(differs.drop("size"), (F.col("_root") == F.col("_dp")) & (F.col("node") == F.col("_dn")))
    heavy = saved(shapes.select(*HEAVY, F.col("_d").alias("diff")), "near-last")
    links.append(saved(_asked_in_blocks(heavy, small(sizes), percent, reach), "near-last-links"))
    return links, pairs


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node it is connected with, for every node of a link.

    Each round, every node moves to its smallest neighbour and the links between the new places
    remain; the moves of all rounds are then followed from each node.
    """
    edges = checkpoint(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    labels = None
    while True:
        ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = checkpoint(ends.groupBy(F.col("a").alias("at")).agg(F.least(F.min("b"), F.min("a")).alias("to")))
        if labels is None:
            labels = move.select(F.col("at").alias("node"), F.col("to").alias("label"))
        else:
            labels = checkpoint(labels.join(move, F.col("label") == F.col("at"), "left").select("node", F.coalesce("to", "label").alias("label")))
        there = move.select(F.col("at").alias("at2"), F.col("to").alias("to2"))
        moved = edges.join(move, F.col("a") == F.col("at")).join(there, F.col("b") == F.col("at2"))
        edges = checkpoint(moved.select(F.least("to", "to2").alias("a"), F.greatest("to", "to2").alias("b")).where("a <> b").distinct())
        if not count_rows(edges):
            return labels


def groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, ``th``, n_shingles and component_id of every row."""
    rows = saved(sketches(docs), "near-sketches")
    # The row that stands for a class: of those with the smallest doc_id, the one with the smallest text hash.
    first = rows.where("n_shingles > 0").groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.min_by("th", F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("th"), F.first("sketch").alias("sketch"))
    classes = saved(first.withColumn("node", F.monotonically_increasing_id()), "near-classes")
    lists, central = index(shared_values(classes), percent)
    short, long = _sized(lists, ["value"], LIST_ROWS)
    pairs = saved(plausible(list_pairs(short, ["value"]), classes, least=least_shared(percent)), "near-pairs")
    long = checkpoint(long.select("value", "node"))
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(long.select("node")).distinct()
    sets = saved(full_sets(docs, checkpoint(classes.join(wanted, "node").select("node", "digest", "first", "th"))), "near-sets")
    links, more = around_pivots(long, sets, central, percent)
    found = confirmed(pairs, sets, percent)
    for extra in more:
        found = found.unionByName(confirmed(plausible(extra, classes, least=least_shared(percent)), sets, percent))
    labels = components(reduce(DataFrame.unionByName, links, found))
    named = classes.select("digest", "first", "node").join(labels.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    named = checkpoint(named.select("digest", "first", F.coalesce("label", "node").alias("label")))
    least = checkpoint(named.groupBy(F.col("label").alias("_l")).agg(F.min("first").alias("component_id")))
    named = checkpoint(named.join(least, F.col("label") == F.col("_l")).select(F.col("digest").alias("_d"), "component_id"))
    out = rows.select("doc_id", "th", "n_shingles", "digest").join(named, F.col("digest") == F.col("_d"), "left")
    return out.select("doc_id", "th", "n_shingles", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def stays() -> Column:
    return F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group left, the one with the smallest doc_id.

    Rows that repeat both doc_id and text stay once.
    """
    found = saved(groups(docs, percent), "near-groups")
    key = [F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_th")]
    gone = checkpoint(found.where(~stays()).select(F.col("doc_id").alias("_i"), F.col("th").alias("_t")).distinct())
    on = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t"))
    rows = packed(docs, *key).join(small(gone), on, "left_anti")
    again = found.where(stays() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_i"), F.col("th").alias("_t")).agg(F.count(F.lit(1)).alias("_c"))
    again = checkpoint(again.where("_c > 1"))
    if count_rows(again):
        once, many = rows.join(small(again), on, "left_anti"), rows.join(small(again), on, "left_semi")
        rows = once.unionByName(many.dropDuplicates(["_id", "_th"]))
    return rows.select("_row.*")
