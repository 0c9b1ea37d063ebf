"""Consolidating pairwise matches into groups: seed-tree pruning.

Every round each vertex tells its neighbourhood (itself included) the smallest id in it. A vertex that nobody, itself
included, was told as a minimum drops out and hangs below the smallest minimum it was told (the propagation forest);
the minima told to one vertex become the next round's edges. When no edge is left, the vertices that never dropped are
the seeds, and their ids flow down the forest, last round first. A round costs joins on the surviving edges alone, and
the survivors shrink geometrically, so long chains take few rounds.

Hot vertices: a vertex may hold a third of all pairs. Minima are pre-aggregated per (vertex, salt), and the minimum
goes back to the edges by a join on (vertex, salt), so no task sees more than a salted share of a hub.

Defined results
* a null on either side links nothing, but the other id still gets a row; a pair of an id with itself likewise;
* repeated and reversed pairs count once; ids need not occur anywhere else; an empty table gives no row;
* ``group_id`` is the smallest id linked directly or indirectly, the id's own if there is none;
* other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.runtime import cut

#: Salted shares of one vertex.
SALTS = 16


def _with_min(pairs: DataFrame, own: bool) -> DataFrame:
    """``pairs`` (u, v) with ``m``, the smallest v of u (u itself counts where ``own``), by salted joins."""
    salted = pairs.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    part = salted.groupBy("u", "_s").agg(F.min("v").alias("_m"))
    whole = part.groupBy("u").agg(F.min("_m").alias("m"), F.collect_set("_s").alias("_ss"))
    if own:
        whole = whole.withColumn("m", F.least("u", "m"))
    spread = whole.select("u", "m", F.explode("_ss").alias("_s"))
    return salted.join(spread, ["u", "_s"]).select("u", "v", "m")


def connected_components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row (``entity_id``, ``group_id``) for each id named in columns ``a`` and ``b`` of ``pairs``."""
    named = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"))
    ids = named.select(F.explode(F.array("a", "b")).alias("u")).filter("u IS NOT NULL").distinct()
    one_way = named.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = cut(one_way.select(F.explode(F.expr("array(struct(a AS u, b AS v), struct(b AS u, a AS v))")).alias("e")).select("e.u", "e.v").distinct())
    forest: list[DataFrame] = []
    while not edges.isEmpty():
        told = _with_min(edges, own=True)
        # u tells m to every neighbour and to itself
        heard = told.select(F.explode(F.expr("array(struct(v AS u, m AS v), struct(u AS u, m AS v))")).alias("e")).select("e.u", "e.v").distinct()
        heard = cut(heard)
        judged = heard.groupBy("u").agg(F.min("v").alias("parent"), F.max(F.col("u") == F.col("v")).alias("stays"))
        forest.append(cut(judged.filter("NOT stays").select("u", "parent")))
        left = _with_min(heard, own=False).filter("v <> m")
        edges = cut(left.select(F.explode(F.expr("array(struct(v AS u, m AS v), struct(m AS u, v AS v))")).alias("e")).select("e.u", "e.v").distinct())
    known: DataFrame | None = None
    for tree in reversed(forest):
        if known is None:
            known = tree.select("u", F.col("parent").alias("root"))
        else:
            up = known.select(F.col("u").alias("parent"), "root")
            known = cut(known.unionByName(tree.join(up, "parent", "left").select("u", F.coalesce("root", "parent").alias("root"))))
    if known is None:
        return ids.select(F.col("u").alias("entity_id"), F.col("u").alias("group_id"))
    return ids.join(known, "u", "left").select(F.col("u").alias("entity_id"), F.coalesce("root", "u").alias("group_id"))
