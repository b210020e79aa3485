"""A Merkle manifest of a table, with a proof for each row.

The rows of a group are numbered in order and cut into aligned blocks. A block keeps each level of its part of the tree as
one string of concatenated hex digests: a run of consecutive nodes is a substring of fixed width, and its digest is the
parent. A node's siblings are the substrings beside it in its run. The roots of a group's blocks are nodes again, numbered
by their blocks, and go through the same step until each group has one node; the groups' nodes are then one group more.
So a shuffle moves each row once to its block, the number of steps is the logarithm of the rows to the base BLOCK, and no
task holds more than a block of a group, however large the group is. All of it is SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved, shuffle_partitions

#: Levels of the tree in a block; with two nodes to a run it has up to 1024 leaves (64 KB of digests a level).
BLOCK_LEVELS = 10
#: Hex characters of a digest.
WIDE = 64
#: Key of the tree over the groups.
_TOP = "top"
#: Up to so many groups have their part of the paths broadcast (some KB each at most).
FEW_GROUPS = 10_000


def encoded(x: Column) -> Column:
    """A value as a leaf has it: `-` if null, else its bytes in UTF-8, a colon and the value."""
    text = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts end to end."""
    return F.sha2(F.concat(*parts), 256)


def numbered(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with column pos: the row's place in its group from 0, in the order given, which must tell all rows apart.

    Rows are dealt to ranges of (group, order) and stay in them, so that a group of any size has as many ranges as its rows
    need. Only the number of rows of each group in each range is summed over the ranges.
    """
    spark = df.sparkSession
    ranges = df.repartitionByRange(shuffle_partitions(spark), group, *order).withColumn("_range", F.spark_partition_id())
    kept = saved(ranges)  # ranges are the same from here on, whichever task is run again
    sizes = kept.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(group, "_range", (F.sum("_n").over(Window.partitionBy(group).orderBy("_range")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order)) - 1
    return kept.join(before, [group, "_range"]).withColumn("pos", (own + F.col("_before")).cast("long")).drop("_range", "_before")


def _levels(fan: int, at_most: int, whole: Column) -> Column:
    """array<binary> of a block's levels, from its nodes (column `level`) up to one node.

    whole: the block is its group's only one, so that its tree ends where one node is left; the last block of others, which
    may hold few nodes, goes on as far as the blocks before it do.
    """
    run = fan * WIDE

    def up(level: Column) -> Column:
        runs = F.sequence(F.lit(0), F.ceil(F.length(level) / run).cast("int") - 1)
        return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * run + 1, F.lit(run)), 256)), "").cast("binary")

    def step(levels: Column, _: Column) -> Column:
        last = F.element_at(levels, -1)
        return F.when(whole & (F.length(last) <= WIDE), levels).otherwise(F.concat(levels, F.array(up(last))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(at_most)), F.array(F.col("level")), step)


def _path(levels: Column, place: Column, fan: int) -> Column:
    """The siblings of the node at a place: for each level below the last, the substrings left and right of it in its run."""

    def beside(level: Column, j: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(float(fan)), j)).cast("int")
        start = (at - at % fan) * WIDE
        left = F.substring(level, start + 1, at % fan * WIDE)
        right = F.substring(level, (at + 1) * WIDE + 1, (fan - 1 - at % fan) * WIDE)
        return F.struct(left.cast("string").alias("left"), right.cast("string").alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), beside)


def _blocks(nodes: DataFrame, fan: int) -> DataFrame:
    """group, block, last, items, levels: one row for each aligned block of numbered nodes (group, pos, node, item).

    last: the group's last block; items: the block's (pos, item) in order.
    """
    d = nodes.withColumn("block", F.floor(F.col("pos") / fan**BLOCK_LEVELS).cast("long"))
    g = d.groupBy("group", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "node", "item"))).alias("items"))
    g = g.join(g.groupBy("group").agg(F.max("block").alias("last")), "group").withColumn("level", F.array_join("items.node", "").cast("binary"))
    return g.select("group", "block", "last", "items", _levels(fan, BLOCK_LEVELS, F.col("last") == 0).alias("levels"))


def _tree(nodes: DataFrame, fan: int) -> DataFrame:
    """group, items, levels, over, top of the blocks of numbered nodes: over has the siblings of the block's root, level by
    level up to the group's one node, which is top."""
    tip = F.element_at("levels", -1).cast("string")
    blocks = saved(_blocks(nodes, fan))
    if not blocks.where("last > 0").limit(1).count():
        return blocks.select("group", "items", "levels", F.array().cast("array<struct<left:string,right:string>>").alias("over"), tip.alias("top"))
    roots = blocks.select("group", F.col("block").alias("pos"), tip.alias("node"), F.col("block").alias("item"))
    above = _rows(_tree(roots, fan), fan).select("group", F.col("item").alias("block"), F.col("path").alias("over"), "top")
    return blocks.join(above, ["group", "block"]).select("group", "items", "levels", "over", "top")


def _rows(blocks: DataFrame, fan: int, *keep: str) -> DataFrame:
    """group, node, item, path, top of every node of the blocks."""
    d = blocks.select("group", "levels", "over", "top", *keep, F.posexplode("items").alias("at", "x"))
    return d.select("group", F.col("x.node").alias("node"), F.col("x.item").alias("item"), F.concat(_path(F.col("levels"), F.col("at"), fan), F.col("over")).alias("path"), "top", *keep)


def segments(path: Column) -> Column:
    """The siblings on a path end to end, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: digest(s["left"], node, s["right"]))


def manifest(df: DataFrame, columns: tuple[str, ...], group: str, order: str, keep: dict[str, Column], fan: int = 2) -> DataFrame:
    """The columns of keep (made from df's) and leaf, subroot, root, path of every row.

    A row's leaf is the digest of its `columns` (see encoded). The leaves of each value of group ascend by `order`, null
    first, then by leaf, so that ties have one result whatever order the rows come in; `fan` nodes and what is left at a
    level's end become a parent until one is left. These subroots, by group in the order of their UTF-8 bytes, null first, give the
    root in the same way. path: for each level from the leaf to the root, the hex digests left and right of the row's node
    among those that share its parent (both empty for a node alone). Rows that repeat are leaves of their own. Nulls and
    empty texts are values that differ; texts of any length are digested whole; other columns and their names take no part.
    A table without rows gives none.
    """
    by = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaves = df.select(by.alias("group"), F.col(order).alias("by"), digest(*[encoded(F.col(c)) for c in columns]).alias("node"), F.struct(*[c.alias(n) for n, c in keep.items()]).alias("item"))
    leaves = saved(leaves.withColumn("row", F.monotonically_increasing_id()))  # read and digested once; row is fixed from here on
    blocks = _tree(numbered(leaves, "group", ["by", "node", "row"]), fan)
    tops = blocks.select("group", "top").distinct().select(F.lit(_TOP).alias("group"), F.col("group").alias("item"), F.col("top").alias("node"))
    tops = _rows(_tree(numbered(tops, "group", ["item"]), fan), fan).select(F.col("item").alias("group"), F.col("path").alias("rest"), F.col("top").alias("root"))
    few = tops.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    rows = _rows(blocks.join(F.broadcast(tops) if few else tops, "group"), fan, "rest", "root")
    return rows.select("item.*", F.col("node").alias("leaf"), F.col("top").alias("subroot"), "root", F.concat("path", "rest").alias("path"))
