"""Splits that keep related records together.

Records are linked through what they share (a page, a question). Every shared thing becomes a star of edges to its
smallest record, never all pairs of its records; pages are contracted to their smallest record at once, and only the
edges between pages go through the Borůvka forest (forest.py).

The groups are then dealt to the splits: largest size band first (a band holds the sizes of one power of two), within a band
by a hash, in a fixed pattern that repeats the proportions. Neighbours in this order have about the same size, so each
run of the pattern has the proportions in records too. The rank of a group is the number of groups in the hash buckets
before its own (a bounded table, summed on the driver's side of a window of at most BUCKETS rows a band) plus its rank in
its bucket.

Defined results: records with a null or negative shared value are not linked by it; an id that is null plays no part;
repeated rows count once; an empty table gives no rows. A group above a split's whole share still stays in one split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from wikiloom.durable import durable
from wikiloom.llm.forest import forest

#: Buckets of a band; a window ranks the groups of one bucket only.
BUCKETS = 1024


def related(records: DataFrame, shared: DataFrame) -> DataFrame:
    """id, group of all records; see spanned()."""
    return spanned(records, shared)[0]


def spanned(records: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups: id, group of all records; tree: u, v, round of the edges that tie each group together, as many as its records less one).

    records: id, page (null where the record has none); shared: id, thing. Records with an equal page or an equal thing are related, and
    so on; things of ids that are not among the records play no part. group is the smallest id of the group.
    """
    rows = durable(records.select("id", "page").where("id is not null").distinct())
    anchors = rows.where("page is not null").groupBy("page").agg(F.min("id").alias("anchor"))
    at = rows.join(anchors, "page", "left").select("id", F.coalesce("anchor", "id").alias("anchor"))
    base = durable(at.groupBy("id").agg(F.min("anchor").alias("base"), F.max("anchor").alias("top")))
    # An id on several pages ties them together.
    several = at.join(base.where("base != top").select("id", "base"), "id").select(F.col("anchor").alias("u"), F.col("base").alias("v"))
    named = shared.select("id", "thing").where("id is not null and thing is not null").distinct().join(base, "id").select("thing", "base").distinct()
    least = named.groupBy("thing").agg(F.min("base").alias("v"))
    links = named.join(least, "thing").select(F.col("base").alias("u"), "v").where("u != v")
    labels, edges = forest(several.unionByName(links))
    group = labels.groupBy("root").agg(F.min("node").alias("group"))
    of = labels.join(group, "root").select(F.col("node").alias("base"), "group")
    groups = base.join(of, "base", "left").select("id", F.coalesce("group", "base").alias("group"))
    # Records of one page hang on its smallest one (which may itself be tied to another page's by the forest); round -1 stands before the contraction.
    hung = base.where("id != base").join(anchors.select(F.col("anchor").alias("id")), "id", "left_anti").select(F.col("base").alias("u"), F.col("id").alias("v"), F.lit(-1).alias("round"))
    return groups, hung.unionByName(edges)


def broken(groups: DataFrame, splits: DataFrame) -> DataFrame:
    """id, group of the groups whose records have more than one split. groups: id, group; splits: id, split."""
    rows = groups.join(splits.select("id", "split").distinct(), "id")
    bad = rows.groupBy("group").agg(F.min("split").alias("a"), F.max("split").alias("z")).where("a != z").select("group")
    return groups.join(bad, "group", "left_semi").select("id", "group")


def pattern(shares: dict[str, float], length: int = 20) -> list[str]:
    """The splits in an order in which every prefix is as near to the shares as it can be."""
    given = dict.fromkeys(shares, 0)
    out = []
    for i in range(1, length + 1):
        name = max(shares, key=lambda s: shares[s] * i - given[s])
        given[name] += 1
        out.append(name)
    return out


def deal(groups: DataFrame, shares: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """group, size, split of every group of groups (id, group)."""
    order = pattern(shares or {"train": 0.8, "val": 0.1, "test": 0.1})
    sized = groups.groupBy("group").agg(F.count("*").alias("size"))
    sized = sized.withColumn("band", F.floor(F.log2("size")).cast("int")).withColumn("h", F.xxhash64("group", F.lit(seed)))
    sized = durable(sized.withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int")))
    # At most BUCKETS rows for each of at most 64 bands.
    before = sized.groupBy("band", "bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("band"), "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = sized.withColumn("rank", F.row_number().over(Window.partitionBy("band", "bucket").orderBy("h", "group")) - 1).join(F.broadcast(before.select("band", "bucket", "before")), ["band", "bucket"])
    choice = F.array(*map(F.lit, order))
    return ranked.select("group", "size", F.get(choice, ((F.col("before") + F.col("rank")) % len(order)).cast("int")).alias("split"))
