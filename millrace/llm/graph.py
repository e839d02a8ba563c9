"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, sized


def _renamed(table: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """``table`` with the label in ``known`` (of, root) in place of each node of ``column`` that has one."""
    joined = table.join(known, F.col(column) == F.col("of"), "left")
    return joined.withColumn(column, F.coalesce("root", column)).select(*table.columns)


def _followed(state: DataFrame, work: Scratch) -> DataFrame:
    """(node, label, old) with the label's label, and so on, in place of each label. Paths shorten by half in each round."""
    while True:
        up = sized(state.filter("node <> label").select(F.col("node").alias("of"), F.col("label").alias("far")))
        moved = state.join(up, F.col("label") == F.col("of")).select("node", F.col("far").alias("label"), F.lit(None).cast(state.schema["label"].dataType).alias("old"))
        kept = state.select("node", "label", F.col("label").alias("old"))
        old, state = state, work.stored(moved.unionByName(kept).groupBy("node").agg(F.min("label").alias("label"), F.min("old").alias("old")))
        work.drop(old)
        if state.filter("label <> old").limit(1).count() == 0:
            return state


def components(links: DataFrame, a: str = "a", b: str = "b", work: Scratch | None = None) -> DataFrame:
    """(node, label): every end of a link with the smallest node that links lead to.

    In each round every node takes the smaller one of itself and its smallest
    neighbour, and then that one's, until nothing changes. All nodes that come to
    the same one are that one in the next round: links within it are gone, and
    of equal ones one is left. So at most half of the nodes with links are left
    in each round, and links are read in few. Each round is written out in
    ``work``, in place of the one before. Labels are aggregated before they are
    shuffled, so a node with very many links is no burden to one task.
    """
    work = work or Scratch(links.sparkSession)
    ends = lambda u, v: F.struct(F.col(u).alias("node"), F.col(v).alias("to"))
    left = work.stored(links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct())
    found = None
    while found is None or left.limit(1).count():
        nearest = left.select(F.inline(F.array(ends("u", "v"), ends("v", "u")))).groupBy("node").agg(F.min("to").alias("to"))
        state = _followed(work.stored(nearest.select("node", F.least("node", "to").alias("label"), F.col("node").alias("old"))), work)
        known = sized(state.filter("node <> label").select(F.col("node").alias("of"), F.col("label").alias("root")))
        u, v = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
        before, left = left, work.stored(_renamed(_renamed(left, "u", known), "v", known).filter("u <> v").select(u, v).distinct())
        work.drop(before)
        if found is None:
            found = state
        else:
            before, found = found, work.stored(_renamed(found.select("node", "label"), "label", known))
            work.drop(before, state)
    work.drop(left)
    return found.select("node", "label")
