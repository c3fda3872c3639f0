"""Relational building blocks: band and nearest joins, votes, islands, samples.

Every choice among equals is made by an explicit total order, so results do not
depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, keys: Sequence[str], lpos: str, rpos: str, tol: int) -> DataFrame:
    """Pairs with equal keys and |lpos - rpos| <= tol.

    Positions fall into buckets of 2 * tol + 1; the right side is put into its own
    bucket and both neighbours, so that an equi-join finds each pair once and no
    nested loop is planned. Column names must not clash but for the keys."""
    width = 2 * tol + 1
    l = left.withColumn("_bucket", F.floor(F.col(lpos) / width))  # noqa: E741
    b = F.floor(F.col(rpos) / width)
    r = right.withColumn("_bucket", F.explode(F.array(b - 1, b, b + 1)))
    return l.join(r, [*keys, "_bucket"]).where(F.abs(F.col(lpos) - F.col(rpos)) <= tol).drop("_bucket")


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], a: tuple[str, str], b: tuple[str, str], width: int) -> DataFrame:
    """Pairs with equal keys whose closed intervals a of the left and b of the right meet.

    Both sides are put into every bin of ``width`` that they touch, so that an equi-join finds
    the pairs; each is kept in the first bin that both touch only. Column names must not
    clash but for the keys."""
    bins = lambda lo, hi: F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))
    l = left.where(F.col(a[0]) <= F.col(a[1])).withColumn("_bin", F.explode(bins(*a)))  # noqa: E741
    r = right.where(F.col(b[0]) <= F.col(b[1])).withColumn("_bin", F.explode(bins(*b)))
    meet = (F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1])) & (F.col("_bin") == F.floor(F.greatest(a[0], b[0]) / width))
    return l.join(r, [*keys, "_bin"]).where(meet).drop("_bin")


def chains(df: DataFrame, key: str, pos: str, gap: int, width: int = 1 << 16) -> DataFrame:
    """df with ``chain``, the first position of its chain: rows of a key whose positions follow
    each other by at most ``gap``. Only the chains of the bins of a key meet in a task."""
    runs = islands(df.select(key, F.col(pos).alias("_s"), (F.col(pos) + gap).alias("_e")).distinct(), key, "_s", "_e", width)
    bins = F.sequence(F.floor(F.col("island_start") / width), F.floor((F.col("island_end") - gap) / width))
    runs = runs.select(key, F.col("island_start").alias("chain"), F.col("island_end").alias("_end"), F.explode(bins).alias("_bin"))
    d = df.withColumn("_bin", F.floor(F.col(pos) / width)).join(runs, [key, "_bin"])
    return d.where((F.col(pos) >= F.col("chain")) & (F.col(pos) <= F.col("_end"))).drop("_bin", "_end")


def most_frequent(df: DataFrame, group: Sequence[str], item: Sequence[str]) -> DataFrame:
    """All items tied for the highest count of their group, with that count n."""
    counts = df.groupBy(*group, *item).agg(F.count("*").alias("n"))
    top = counts.groupBy(*group).agg(F.max("n").alias("n"))
    return counts.join(top, [*group, "n"])


def mode_of(df: DataFrame, group: Sequence[str], item: Sequence[str]) -> DataFrame:
    """One item of each group: the most frequent, the least of equal ones."""
    counts = df.groupBy(*group, *item).agg(F.count("*").alias("n"))
    best = counts.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("r"), *item)).alias("_b"))
    return best.select(*group, *(F.col(f"_b.{c}").alias(c) for c in item), (-F.col("_b.r")).alias("n"))


def max_rows(df: DataFrame, group: Sequence[str], value: Column) -> DataFrame:
    """The rows with the largest value of their group, ties included."""
    return df.withColumn("_r", F.rank().over(Window.partitionBy(*group).orderBy(value.desc()))).where("_r = 1").drop("_r")


def top_row(df: DataFrame, group: Sequence[str], *order: Column) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_r = 1").drop("_r")


def islands(df: DataFrame, key: str, start: str, end: str, width: int = 1 << 16) -> DataFrame:
    """(key, island_start, island_end, n) of chained intervals: an interval joins
    an island if it starts at or before the largest end before it.

    Intervals are chained inside (key, start bin) first, so that the pass over a
    whole key sees its few local islands instead of its rows."""
    counted = df.groupBy(key, F.col(start).alias("s"), F.col(end).alias("e")).agg(F.count("*").alias("n"))

    def chain(d: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
        fresh = (F.col("s") > F.coalesce(F.max("e").over(w), F.lit(-(1 << 62)))).cast("long")
        d = d.withColumn("_new", fresh)
        d = d.withColumn("_id", F.sum("_new").over(Window.partitionBy(*by).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)))
        return d.groupBy(*by, "_id").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum("n").alias("n")).drop("_id")

    local = chain(counted.withColumn("_bin", F.floor(F.col("s") / width)), [key, "_bin"]).drop("_bin")
    return chain(local, [key]).select(key, F.col("s").alias("island_start"), F.col("e").alias("island_end"), F.col("n"))


def interval_union(df: DataFrame, group: Sequence[str], start: str, end: str) -> DataFrame:
    """(group, union_start, union_end) of half-open intervals by a sweep: starts
    before ends at one position, so touching intervals merge."""
    up = df.select(*group, F.col(start).alias("pos"), F.lit(1).alias("d"))
    down = df.select(*group, F.col(end).alias("pos"), F.lit(-1).alias("d"))
    events = up.union(down).groupBy(*group, "pos", "d").agg(F.sum("d").alias("step"))
    order = Window.partitionBy(*group).orderBy("pos", F.desc("d"))
    depth = events.withColumn("depth", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    depth = depth.withColumn("before", F.col("depth") - F.col("step"))
    edges = depth.where("(before = 0 and depth > 0) or depth = 0").withColumn("union_end", F.lead("pos").over(order))
    return edges.where("depth > 0").select(*group, F.col("pos").alias("union_start"), "union_end")


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """df with gapless numbers from 0 in a total order. Rows are range-partitioned and counted by
    partition; the driver sees one count a partition."""
    from ringloom.operators.storage import materialised

    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    d = materialised(d).withColumn("_p", F.shiftright("_m", 33))
    before, offsets = 0, [(-1, 0)]
    for r in sorted(d.groupBy("_p").count().collect()):
        offsets.append((r["_p"], before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(offsets, "_p long, _o long")
    return d.join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_p", "_o", "_m")


def split_members(df: DataFrame, members: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose keys are among the members, and the others."""
    m = members.select(*keys).distinct()
    return df.join(m, list(keys), "left_semi"), df.join(m, list(keys), "left_anti")


def samples(ids: DataFrame, key: str, sizes: Sequence[int], repeats: int) -> DataFrame:
    """(sample_size, rep, key): for each size and repetition that many rows without
    replacement, by the order of md5(key, repetition), alike on every run.

    Ranks are made per (repetition, leading digits of the hash) and shifted by the
    counts of lower digits, so that no task sorts a whole repetition."""
    d = ids.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    d = d.withColumn("h", F.md5(F.concat(F.col(key).cast("string"), F.lit("_"), F.col("rep").cast("string")))).withColumn("b", F.substring("h", 1, 2))
    counts = d.groupBy("rep", "b").agg(F.count("*").alias("m"))
    w = Window.partitionBy("rep").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("rep", "b", F.coalesce(F.sum("m").over(w), F.lit(0)).alias("before"))
    r = d.withColumn("own", F.row_number().over(Window.partitionBy("rep", "b").orderBy("h", key))).join(before, ["rep", "b"])
    r = r.withColumn("sample_size", F.explode(F.array(*map(F.lit, sizes))))
    return r.where("own + before <= sample_size").select("sample_size", "rep", key)
