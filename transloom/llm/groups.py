"""Exact similarity links inside candidate groups, without meeting pair by pair in large ones.

``members`` (key, node) are groups of nodes that may be similar; two nodes are linked if the Jaccard similarity of their
sets is NUMERATOR / DENOMINATOR or more. What is wanted are links whose closure is that of all similar pairs that share
a key. Each group first meets a hub, and what the hub connects needs no further comparison: a group of near copies
collapses in as many comparisons as it has members. Groups that still hold several components go on in tiles of bounded
size: a set travels once a tile, however many partners it has there, the sizes of all intersections are one product of
matrices, and a tile reports a forest. Groups of more than MOST_BLOCKS blocks would need too many tiles; their members meet
by an exact prefix filter. Features are ordered by how many of
those members have them, rarest first; two similar sets share one of the first fifth of theirs, so what a template puts
into all its texts selects nothing, features that one member alone has select nothing, and no link is lost. Pairs across
components that share such a feature are left, fewer again by a bound on what may still be common behind it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from transloom.llm.common import cut, drop_shuffles, written
from transloom.llm.components import components

#: Similarity 0.8 as a fraction of integers.
NUMERATOR, DENOMINATOR = 4, 5
#: Hubs that a group meets before it is compared otherwise (a second one found 2 % of the links).
HUBS = 1
#: Members of a block, and features of all its sets; a tile holds one block or two.
BLOCK, BLOCK_FEATURES = 512, 1 << 21
#: Blocks up to which a group is compared in tiles.
MOST_BLOCKS = 64
#: Features whose columns of a tile's matrix are held at once.
COLUMNS = 4096
#: Pairs of one node that meet one copy of its set (fewer, if their sets would have more than BLOCK_FEATURES features).
PAIRS_PER_COPY = 256


def close_sizes(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return DENOMINATOR * F.least(a, b) >= NUMERATOR * F.greatest(a, b)


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (u, v) of ``pairs`` whose ``sets`` (node, set) are similar enough.

    Of each pair the end that more pairs have is its base: a set travels to its base once a pair, and the base's own set once
    for each share of its pairs, so no task holds all pairs of a hub.
    """
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    sizes = sets.select("node", F.greatest(F.lit(1), F.size("set")).alias("size"))
    shares = F.ceil(F.col("n") / F.greatest(F.lit(1), F.least(F.lit(PAIRS_PER_COPY), F.floor(F.lit(BLOCK_FEATURES) / F.col("size")))))
    ends = cut(ends.join(sizes, "node").select("node", "n", shares.cast("int").alias("shares")))
    end = lambda x: ends.select(*[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "shares")])
    both = pairs.join(end("u"), F.col("u") == F.col("node_u")).join(end("v"), F.col("v") == F.col("node_v"))
    first = F.col("n_u") >= F.col("n_v")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    dealt = both.select(pick("u", "v").alias("base"), pick("v", "u").alias("node"), first.alias("first"), pick("shares_u", "shares_v").alias("shares"))
    dealt = cut(dealt.select("base", F.pmod(F.xxhash64("node"), "shares").cast("int").alias("share"), "node", "first"))
    own = dealt.select("base", "share", F.col("base").alias("node"), F.lit(None).cast("boolean").alias("first")).distinct()

    def run(table: pa.Table) -> pa.Table:
        base, others = table.filter(pc.is_null(table.column("first"))), table.filter(pc.is_valid(table.column("first")))
        has = [np.sort(np.asarray(x.values).view(np.uint64)) for x in base.column("set")][0]
        node, first = others.column("node").to_numpy(), others.column("first").to_numpy()
        size, common = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
        for i, x in enumerate(others.column("set")):
            values = np.asarray(x.values).view(np.uint64)
            size[i] = len(values)
            at = np.searchsorted(has, values)
            common[i] = (has[np.minimum(at, len(has) - 1)] == values).sum() if len(has) else 0
        near = (NUMERATOR + DENOMINATOR) * common >= NUMERATOR * (size + len(has))
        node, first, hub = node[near], first[near].astype(bool), np.full(near.sum(), base.column("base")[0].as_py())
        return pa.table({"u": np.where(first, hub, node), "v": np.where(first, node, hub)})

    rows = dealt.unionByName(own).join(sets, "node")
    return rows.groupBy("base", "share").applyInArrow(run, "u long, v long")


def _pairs(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _mixed(members: DataFrame, found: DataFrame | None, nth: int) -> DataFrame:
    """(key, node, size, root, n, hub) of the groups that hold several components; the hub is a member."""
    if found is None:
        rooted = members.select("key", "node", "size", F.col("node").alias("root"))
    else:
        closed = components(found).withColumnRenamed("node", "of")
        rooted = members.join(closed, F.col("node") == F.col("of"), "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    # the member that a group is named after goes first, then others
    order = F.struct((F.col("node") == F.col("key")) == F.lit(nth > 0), F.xxhash64("node", F.lit(nth)), F.struct("node", "size", "root").alias("hub"))
    several = rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(order)["hub"].alias("hub")).where("lo <> hi")
    return written(rooted.join(several.select("key", "n", "hub"), "key"))


def _prefix_pairs(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) across components of all pairs of ``nodes`` (node, size, root) that can be similar, by prefixes."""
    features = cut(sets.join(nodes, "node").select("node", "size", "root", F.explode("set").alias("feature")))
    shared = features.groupBy("feature").agg(F.count("*").alias("n")).where("n > 1")
    some = features.join(shared, "feature")
    # features that one node alone has come first, without being here
    place = F.row_number().over(Window.partitionBy("node").orderBy("n", "feature"))
    alone = F.col("size") - F.count("*").over(Window.partitionBy("node"))
    least = F.ceil(F.col("size") * NUMERATOR / DENOMINATOR)
    prefix = some.withColumn("place", place + alone).where(F.col("place") <= F.col("size") - least + 1)
    prefix = cut(prefix.select("feature", "node", "size", "root", "place"))
    several = prefix.groupBy("feature").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("feature")
    prefix = cut(prefix.join(several, "feature"))
    side = lambda x: prefix.select("feature", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "size", "root", "place")])
    size_a, size_b = F.col("size_a"), F.col("size_b")
    # behind the first common feature no more than what is left of either set can be common
    common = 1 + F.least(size_a - F.col("place_a"), size_b - F.col("place_b"))
    enough = (NUMERATOR + DENOMINATOR) * common >= NUMERATOR * (size_a + size_b)
    met = side("a").join(side("b"), "feature").where((F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & close_sizes(size_a, size_b) & enough)
    return met.select(F.col("node_a").alias("u"), F.col("node_b").alias("v")).distinct()


def forest(root: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Places (a, b) across components (``root``) that connect what similar sets connect, at most one a set.

    The two ends need not be similar themselves: sets between them are.
    """
    n, size = len(sets), np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(n), size)
    _, column, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = many[column] > 1  # what one set alone has is common to none
    place = np.cumsum(many > 1) - 1
    owner, column = owner[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    exact = np.float32 if size.max() < 1 << 24 else np.float64
    common = np.zeros((n, n), exact)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        some = slice(*np.searchsorted(column, [lo, lo + COLUMNS]))
        x = np.zeros((n, COLUMNS), exact)
        x[owner[some], column[some] - lo] = 1
        common += x @ x.T
    near = (NUMERATOR + DENOMINATOR) * common.astype(np.float64) >= NUMERATOR * (size[:, None] + size)
    near |= root[:, None] == root
    out, left = [], np.ones(n, bool)
    for first in range(n):
        if not left[first]:
            continue
        reached = edge = np.arange(n) == first
        while edge.any():
            edge = near[edge].any(axis=0) & ~reached
            reached = reached | edge
        left &= ~reached
        others = np.nonzero(reached & (root != root[first]))[0]
        out += [(first, int(b)) for b in others[np.unique(root[others], return_index=True)[1]]]
    return out


def _tiled(mixed: DataFrame) -> DataFrame:
    """(key, i, j, node, size, root): members of groups (with their blocks) dealt out to pairs of blocks, each pair of members
    to a tile at least."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    last = F.col("blocks") - 1
    partner = F.when(last == 0, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), last), F.col("i")))
    rows = mixed.withColumn("i", own).withColumn("partner", F.explode(partner))
    return rows.select("key", F.least("i", "partner").alias("i"), F.greatest("i", "partner").alias("j"), "node", "size", "root")


def tile_links(tiled: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v): a forest of what is similar across components in each tile (key, i, j, node, root)."""

    def run(table: pa.Table) -> pa.Table:
        node, root = table.column("node").to_numpy(), table.column("root").to_numpy()
        pairs = []
        if (root != root[0]).any():
            pairs = forest(root, [x.values.to_numpy() for x in table.column("set")])
        a, b = np.array(pairs, np.int64).reshape(-1, 2).T
        return pa.table({"u": np.minimum(node[a], node[b]), "v": np.maximum(node[a], node[b])})

    rows = tiled.select("key", "i", "j", "node", "root").join(sets, "node")
    return rows.groupBy("key", "i", "j").applyInArrow(run, "u long, v long")


def links(
    members: DataFrame, sets: DataFrame, screen: Callable[[DataFrame], DataFrame] | None = None,
    narrow: Callable[[DataFrame], DataFrame] | None = None, most_blocks: int = MOST_BLOCKS,
) -> DataFrame:
    """(u, v) links whose closure is that of all similar pairs that share a key of ``members`` (key, node, size).

    ``sets`` (node, set) holds the set of every member. ``screen`` may drop pairs (u, v) before their sets are compared;
    ``narrow`` may drop members of tiles (key, i, j, node, size, root) that have no partner in another component there.
    """
    screen = screen or (lambda pairs: pairs)
    found: DataFrame | None = None
    tried: DataFrame | None = None
    for nth in range(HUBS):
        mixed = _mixed(members, found, nth)
        if nth and mixed.isEmpty():
            return found
        asked = mixed.where((F.col("root") != F.col("hub.root")) & close_sizes(F.col("size"), F.col("hub.size"))).select(*_pairs(F.col("node"), F.col("hub.node"))).distinct()
        asked = cut(asked if tried is None else asked.join(tried, ["u", "v"], "left_anti"))
        tried = asked if tried is None else tried.unionByName(asked)
        new = cut(similar(cut(screen(asked)), sets))
        drop_shuffles(members.sparkSession)
        found = new if found is None else found.unionByName(new)
        members = mixed.select("key", "node", "size")
    mixed = _mixed(members, found, HUBS)
    if mixed.isEmpty():
        return found
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / BLOCK_FEATURES)).cast("int").alias("blocks")
    mixed = cut(mixed.join(mixed.groupBy("key").agg(blocks), "key"))
    tiled = _tiled(mixed.where(F.col("blocks") <= most_blocks))
    new = cut(tile_links(tiled if narrow is None else narrow(tiled), sets).distinct())
    found = found.unionByName(new)
    many = mixed.where(F.col("blocks") > most_blocks).select("node", "size", "root").distinct()
    if many.isEmpty():
        return found
    pairs = _prefix_pairs(many, sets).distinct().join(tried, ["u", "v"], "left_anti")
    return found.unionByName(similar(cut(screen(pairs)), sets))
