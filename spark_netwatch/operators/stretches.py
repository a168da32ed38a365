"""Running state per key without a task that holds a whole key.

``deal`` cuts the rows of each heavy key (more than one part in ``parts`` of all rows; there are fewer
than ``parts`` such keys) into stretches of time of about that size, at quantiles of its own times; rows
of one instant stay together. Windows run over (key, stretch), so every key, however hot, is spread over
tasks, and light keys are one stretch. What a stretch needs from the ones before it is a carry: a row per
(key, later stretch), at most ``2 * parts`` rows in all, written once and broadcast. There is one plan for
all inputs; the cuts come from the data, and carries that have no stretch to go to are not computed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

PART = "_part"
#: percentile_approx: a cut is off by at most one row in so many of the key's rows.
ACCURACY = 100_000


@dataclass
class Dealt:
    """Rows with ``_part`` and the heavy keys (``_heavy``, ``_cuts``)."""
    rows: DataFrame
    heavy: DataFrame
    key: str
    cut: bool = True        # False: no key is heavy, so no stretch is a later one and nothing is carried

    def kept(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` about later stretches, written; known to be none when no key is cut."""
        if self.cut:
            return staged(rows, name)
        none = rows.sparkSession.range(1).filter(F.lit(False))
        return none.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])

    def of_heavy(self, rows: DataFrame) -> DataFrame:
        """The rows of heavy keys."""
        return rows.join(F.broadcast(self.heavy.select("_heavy")), F.col(self.key).eqNullSafe(F.col("_heavy")), "left_semi")

    def carry(self, rows: DataFrame, keys: list[str], values: dict[str, tuple[Callable, Column]]) -> DataFrame:
        """(keys, _part, values): each value's aggregate over all earlier stretches of the keys.

        ``keys`` starts with the dealt key. ``rows`` of light keys are left out: they have no later stretch.
        """
        totals = self.of_heavy(rows).groupBy(*keys, PART).agg(*[agg(c).alias(n) for n, (agg, c) in values.items()])
        return self.kept(earlier(totals, keys, {n: agg for n, (agg, _) in values.items()}), "carry")


def earlier(totals: DataFrame, keys: list[str], aggregates: dict[str, Callable]) -> DataFrame:
    """Combine one row per (keys, stretch) over the stretches before it; first stretches go."""
    order = Window.partitionBy(*keys).orderBy(PART)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    out = totals.select(*keys, PART, *[agg(n).over(before).alias(n) for n, agg in aggregates.items()], F.row_number().over(order).alias("_at"))
    return out.filter("_at > 1").drop("_at")


def with_carry(rows: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the carry of their stretch, null in a first one; a null key equals itself."""
    names = {k: f"_on{i}" for i, k in enumerate([*keys, PART])}
    small = carry.select(*[F.col(k).alias(n) for k, n in names.items()], *[c for c in carry.columns if c not in names])
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return rows.join(F.broadcast(small), on, "left").drop(*names.values())


def deal(df: DataFrame, key: str, ts: str, parts: int | None = None) -> Dealt:
    """Add ``_part``, the number of the row's stretch within its ``key`` in the order of ``ts``."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = staged(df.groupBy(F.col(key).alias("_heavy")).agg(F.count(F.lit(1)).alias("_dealt_n")), "counts")
    total, most = counts.agg(F.coalesce(F.sum("_dealt_n"), F.lit(0)), F.coalesce(F.max("_dealt_n"), F.lit(0))).first()
    if most * parts <= total:
        return Dealt(df.withColumn(PART, F.lit(0)), counts.limit(0), key, False)
    heavy = counts.filter(F.col("_dealt_n") * parts > total).select("_heavy", F.ceil(F.col("_dealt_n") * parts / total).cast("int").alias("_dealt_k"))
    grid = F.array(*[F.lit((i + 1) / parts) for i in range(parts)])
    rows = df.select(key, ts).join(F.broadcast(heavy), F.col(key).eqNullSafe(F.col("_heavy")))
    quantiles = rows.groupBy("_heavy").agg(F.max("_dealt_k").alias("_dealt_k"), F.percentile_approx(ts, grid, F.lit(ACCURACY)).alias("_dealt_q"))
    step = F.lit(float(parts)) / F.col("_dealt_k")
    chosen = F.transform(F.sequence(F.lit(1), F.col("_dealt_k")), lambda i: F.element_at("_dealt_q", F.greatest(F.lit(1), F.round(i * step)).cast("int")))
    heavy = staged(quantiles.select("_heavy", F.array_distinct(chosen).alias("_cuts")), "cuts")
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(ts))), F.lit(0))
    dealt = df.join(F.broadcast(heavy), F.col(key).eqNullSafe(F.col("_heavy")), "left").withColumn(PART, part)
    return Dealt(dealt.drop("_heavy", "_cuts"), heavy, key)


def deal_all(df: DataFrame, ts: str, parts: int | None = None) -> Dealt:
    """``deal`` for one order over all rows, of no key."""
    return deal(df.withColumn("_all", F.lit(0)), "_all", ts, parts)


def running(dealt: Dealt, values: dict[str, tuple[Callable, Column]], order: list[str], peers: bool = False) -> DataFrame:
    """The dealt rows with running aggregates (inclusive) of their key; ``peers``: rows of one instant count for one another."""
    frame = Window.partitionBy(dealt.key, PART).orderBy(*order)
    frame = (frame.rangeBetween if peers else frame.rowsBetween)(Window.unboundedPreceding, 0)
    carry = dealt.carry(dealt.rows, [dealt.key], {f"_c_{n}": v for n, v in values.items()})
    local = dealt.rows.select("*", *[agg(c).over(frame).alias(f"_l_{n}") for n, (agg, c) in values.items()])
    return with_carry(local, carry, [dealt.key]).select(
        *dealt.rows.columns, *[both(agg, F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n, (agg, _) in values.items()])


def both(agg: Callable, carried: Column, local: Column) -> Column:
    """An aggregate over the stretches before and the rows so far."""
    if agg is F.sum:
        return F.when(carried.isNull(), local).when(local.isNull(), carried).otherwise(carried + local)
    return (F.greatest if agg is F.max else F.least)(carried, local)       # these skip nulls
