"""Connected groups by Borůvka contraction: a spanning forest, kept round by round in the shared folder.

Each round every node picks its least edge (edges are ordered by a hash of their ends, then by the ends, so no two
are equal), the picked edges are forest edges, their trees are contracted to roots by pointer jumping, and the edges
are relabelled, stripped of loops and made distinct. A round at least halves the nodes that have edges left, so the
rounds are logarithmic. Only counts come to the driver. A node that a third of all edges share is a minimum under
map-side aggregation and one skewed join key, never a collected group.

Defined results: null ends, loops and repeated edges play no part; a table without edges has no nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wikiloom.durable import durable, release


def _jump(parents: DataFrame) -> DataFrame:
    """Roots of a forest of parent pointers (a root points to itself), by doubling. The given frame, a written one, is deleted."""
    while True:
        step = parents.alias("x").join(parents.select(F.col("node").alias("at"), F.col("parent").alias("up")), F.expr("x.parent = at")).select("x.node", F.col("up").alias("parent"), F.expr("x.parent != up").alias("moved"))
        step = durable(step)
        release(parents)
        parents = step.select("node", "parent")
        if not step.where("moved").limit(1).count():
            return parents


def forest(edges: DataFrame, rounds: int = 64) -> tuple[DataFrame, DataFrame]:
    """(labels: node, root of every node that has an edge; spanning: u, v, round of the forest) of edges u, v."""
    spark = edges.sparkSession
    e = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u != v").distinct()
    e = durable(e.select("u", "v", F.col("u").alias("ou"), F.col("v").alias("ov")))
    labels, spanning = None, None
    for r in range(rounds):
        if not e.limit(1).count():
            break
        ends = e.select(F.inline(F.expr("array(named_struct('node', u, 'other', v, 'w', struct(xxhash64(u, v), u, v), 'e', struct(ou, ov)), named_struct('node', v, 'other', u, 'w', struct(xxhash64(u, v), u, v), 'e', struct(ou, ov)))")))
        best = durable(ends.groupBy("node").agg(F.min_by(F.struct("other", "e"), "w").alias("m")).select("node", F.col("m.other").alias("other"), "m.e.ou", "m.e.ov"))
        picked = best.select(F.col("ou").alias("u"), F.col("ov").alias("v")).distinct().withColumn("round", F.lit(r))
        spanning = picked if spanning is None else spanning.unionByName(picked)
        # The least edges of two nodes may be one and the same: then the smaller node is the root.
        back = best.select(F.col("node").alias("n2"), F.col("other").alias("o2"))
        parents = best.join(back, F.expr("other = n2")).select("node", F.expr("if(o2 = node and node < other, node, other)").alias("parent"))
        roots = _jump(durable(parents))
        if labels is None:
            labels = roots.select("node", F.col("parent").alias("root"))
        else:
            moved = roots.select(F.col("node").alias("root"), F.col("parent").alias("to"))
            labels = labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        before = e
        a = roots.select(F.col("node").alias("u"), F.col("parent").alias("ru"))
        b = roots.select(F.col("node").alias("v"), F.col("parent").alias("rv"))
        e = e.join(a, "u").join(b, "v").where("ru != rv").groupBy(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).agg(F.min(F.struct("ou", "ov")).alias("m"))
        left = durable(e.select("u", "v", "m.ou", "m.ov"))
        release(before)
        e = left
    if labels is None:
        return spark.createDataFrame([], "node long, root long"), spark.createDataFrame([], "u long, v long, round int")
    return durable(labels), durable(spanning)


def groups(edges: DataFrame) -> DataFrame:
    """node, group of every node that has an edge; group is the smallest node of its connected group."""
    labels, _ = forest(edges)
    least = labels.groupBy("root").agg(F.min("node").alias("group"))
    return labels.join(least, "root").select("node", "group")
