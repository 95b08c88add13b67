"""Reachability over contradiction edges, level by level."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recallgrid.session import cut_lineage


def adjacency(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows ``(position, id, related)``: each asked id, repeated as asked, with the sorted ids it has edges to, empty if none."""
    related = edges.groupBy(F.col("from_id").alias("id")).agg(F.array_sort(F.collect_set("to_id")).alias("related"))
    return ids.join(related, "id", "left").select("position", "id", F.coalesce("related", F.array().cast("array<string>")).alias("related"))


def numbered(ids: DataFrame) -> DataFrame:
    """Rows ``(position, id)``: distinct ``id`` in order, numbered from 0 over all tasks.

    Ranges of ids are counted, then numbered within; the ranges are written once, as another pass could draw them elsewhere.
    Only the counts, one row a range, come together in a task.
    """
    ranges = cut_lineage(ids.repartitionByRange("id").select("id", F.spark_partition_id().alias("part")))
    upto = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow))
    before = ranges.groupBy("part").agg(F.count("*").alias("n")).select("part", (upto - F.col("n")).alias("before"))
    own = F.row_number().over(W.partitionBy("part").orderBy("id"))
    return ranges.withColumn("own", own).join(F.broadcast(before), "part").select((F.col("before") + F.col("own") - 1).cast("bigint").alias("position"), "id")


def roots(links: DataFrame) -> DataFrame:
    """Rows ``(id, root_id, depth)``: where each chain of ``(id, parent_id)`` ends, by doubling of the distance.

    Each round joins the links with themselves, so chains of n links take log2(n) rounds; the lineage is cut each round. What
    hasn't ended after as many rounds as the number of links allows leads into a cycle: it has no root, and root and depth are
    null. A row that is its own parent ends its chain. Ids without a parent aren't listed; of rows with one id one counts.
    """
    reach = cut_lineage(links.select("id", F.col("parent_id").alias("root_id"), F.lit(1).cast("bigint").alias("depth")).dropDuplicates(["id"]))
    for _ in range(ceil(log2(reach.count() + 2)) + 1):
        onward = reach.where("root_id <> id or depth > 1").select(F.col("id").alias("root_id"), F.col("root_id").alias("next_id"), F.col("depth").alias("more"))
        joined = reach.join(onward, "root_id", "left")
        if joined.where("next_id is not null").isEmpty():
            return reach
        reach = cut_lineage(joined.select("id", F.coalesce("next_id", "root_id").alias("root_id"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    starts = reach.where("root_id <> id or depth > 1").select(F.col("id").alias("root_id"), F.lit(True).alias("_open"))
    ended = F.col("_open").isNull()
    return reach.join(starts, "root_id", "left").select("id", F.when(ended, F.col("root_id")).alias("root_id"), F.when(ended, F.col("depth")).alias("depth"))


def reachable(start: DataFrame, edges: DataFrame, keep: DataFrame, most: int) -> DataFrame:
    """Rows ``(owner_id, id, level)``: breadth first from each start over edges between kept nodes, at most ``most`` a start, smaller ids first.

    The search itself is cut: an owner with ``most`` nodes isn't followed further, and of a level only what is still wanted
    stays. A level needs no more than the ``most`` smallest new nodes, of which an owner can know ``most`` + 1 already, so of a
    node's edges the 2 ``most`` + 2 with the smallest ids are enough, however many it has.
    """
    usable = edges.join(keep.select(F.col("id").alias("to_id")), "to_id", "left_semi").select("from_id", "to_id").distinct()
    usable = usable.withColumn("_n", F.row_number().over(W.partitionBy("from_id").orderBy("to_id"))).where(F.col("_n") <= 2 * most + 2).select("from_id", "to_id")
    usable = cut_lineage(usable)
    seen = start.select(F.col("id").alias("owner_id"), "id", F.lit(0).alias("level")).distinct()
    level = 0
    while True:
        seen, level = cut_lineage(seen), level + 1
        have = seen.groupBy("owner_id").agg((F.count("*") - 1).alias("have")).where(F.col("have") < most)
        new = seen.where(F.col("level") == level - 1).join(usable, seen["id"] == usable["from_id"]).select("owner_id", F.col("to_id").alias("id")).distinct()
        new = new.join(seen.select("owner_id", "id"), ["owner_id", "id"], "left_anti").join(have, "owner_id")
        place = F.row_number().over(W.partitionBy("owner_id").orderBy("id"))
        new = cut_lineage(new.withColumn("_n", place).where(F.col("_n") <= most - F.col("have")).select("owner_id", "id", F.lit(level).alias("level")))
        if new.isEmpty():
            return seen.where("level > 0")
        seen = seen.unionByName(new)
