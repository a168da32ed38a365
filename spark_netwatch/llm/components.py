"""Connected components of links, and components of rows that share buckets, without all pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, join_by_weight, written


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """(u, v, m): ``m`` the least of u and its neighbours; a hub's edges are not sent to one task."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return join_by_weight(edges, least, "u", "n", total).select("u", "v", F.least("u", "m").alias("m"))


def _stars(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u: then every star is a component."""
    n, distinct = edges.agg(F.count(F.lit(1)), F.countDistinct("u")).first()
    return n == distinct and edges.join(edges.select(F.col("v").alias("top")).distinct(), F.col("u") == F.col("top"), "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the least id reachable.

    Alternating large and small stars; every round is written to the shared folder. Rounds grow
    with the logarithm of the longest chain.
    """
    a, b = F.col("a"), F.col("b")
    edges = written(links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while not _stars(edges):
        both = written(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        large = written(_with_least(both, both.count()).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        small = _with_least(large, large.count())
        new = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").union(small.select("u", "m")).distinct(), "edges")
        dropped(both, large, edges)
        edges = new
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return members.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def bucket_links(members: DataFrame, possible: Callable[[Column, Column], Column], verified: Callable[[DataFrame], DataFrame],
                 shared: Callable[[Column, Column], Column] = lambda a, b: F.lit(1),
                 rest: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Links (a, b) whose components are those of all verified pairs that share a bucket.

    ``members``: bucket, id, weight, and what ``possible`` reads from a struct of a member's
    columns; ``verified`` keeps the pairs (a, b) that are links (``rest``: the same for pairs without a
    hub, few of which are links); links share ``shared`` buckets at
    least in which they are possible. First each bucket's heaviest member, its hub, is tried
    against the others, which joins a group of copies by one link each. Then only other members
    that are still in different components are paired: a pair within one component could not
    change the result, and a bucket of two has no such pair.
    """
    row = F.struct(*members.columns)
    in_bucket = Window.partitionBy("bucket")
    placed = members.withColumn("hub", F.max(F.struct("weight", F.col("id"), row.alias("row"))).over(in_bucket)["row"])
    others = written(placed.filter(F.col("id") != F.col("hub.id")), "others")
    pair = [F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")]
    near = others.filter(possible(row, F.col("hub"))).select(*pair, shared(row, F.col("hub")).alias("least"))
    counted = written(near.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("least").alias("least")), "hub-pairs")
    tried = counted.filter("n >= least").select("a", "b")
    first = written(verified(tried), "hub-links")
    label = components(first)
    open_ = others.drop("hub").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = (open_.withColumn("low", F.min("component").over(in_bucket)).withColumn("high", F.max("component").over(in_bucket))
             .filter("low != high").drop("low", "high"))
    open_ = written(open_, "open")
    x, y = open_.alias("x"), open_.alias("y")
    side = lambda s: F.struct(*[F.col(f"{s}.{c}").alias(c) for c in members.columns])
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.id") < F.col("y.id"))
                   & (F.col("x.component") != F.col("y.component")) & possible(side("x"), side("y")))
    pairs = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.lit(1).cast("long").alias("n"), shared(side("x"), side("y")).alias("least"))
    pairs = pairs.unionByName(counted.filter("n < least")).groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("least").alias("least"))
    pairs = written(pairs.filter("n >= least").select("a", "b").join(tried, ["a", "b"], "left_anti"), "open-pairs")
    second = written((rest or verified)(pairs), "open-links")
    dropped(label, others, counted, open_, pairs)
    return first.unionByName(second)
