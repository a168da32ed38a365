"""Greedy per-key acceptance: an event is accepted when it comes at least
``gap`` after the previous *accepted* event of its key (alert cooldown W6,
block TTL W7).

The dependency on the last accepted event rules out a plain window frame, and
folding each key's events in one task breaks when one key holds a large share
of the rows. The job here is exact and spreads every key over many tasks:

1. successor: ``nxt(e)`` = first event of the key at or after ``t(e) + gap``.
   Events and probes (each event's ``t + gap``) are put in one order, from the
   latest down; the successor is the running minimum of (time, id) there, over
   the stretches of the key (``stretches``), so that no task holds all of a
   key's events, nor all of one gap's.
2. chain: accepted = the chain ``head, nxt(head), nxt(nxt(head)) ...`` from
   each key's first event, marked by pointer doubling: round k joins the
   marked set with the 2^k-jump table and squares the table. Joins are on
   unique event ids (no skew); rounds = log2(longest possible chain), bounded
   up front by the largest per-key time span / gap. Every third round is
   checkpointed to the session's checkpoint folder, so lineage stays short and
   a lost executor recomputes at most three rounds.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stretches import deal, running


def _checkpoint(df: DataFrame) -> DataFrame:
    from ..session import checkpoint
    return checkpoint(df)


def successors(events: DataFrame, key: str, ts: str, eid: str, gap: int, parts: int | None = None) -> DataFrame:
    """(id, k, t, nxt): next event id at or after ts + gap within the key, null if none."""
    ev = events.select(F.col(key).alias("k"), F.col(ts).alias("t"), F.col(eid).alias("id"))
    marks = ev.select("k", F.explode(F.array(F.lit(False), F.lit(True))).alias("probe"), "t", "id")
    marks = marks.withColumn("at", -F.when(F.col("probe"), F.col("t") + gap).otherwise(F.col("t")))
    first = F.when(~F.col("probe"), F.struct("t", "id"))
    rows = running(deal(marks, "k", "at", parts), {"nxt": (F.min, first)}, ["at"], peers=True)
    return rows.filter("probe").select("id", "k", "t", F.col("nxt.id").alias("nxt"))


def accepted_ids(events: DataFrame, key: str, ts: str, eid: str, gap: int, parts: int | None = None) -> DataFrame:
    """(id) of each accepted event (event ids must be unique)."""
    succ = _checkpoint(successors(events, key, ts, eid, gap, parts))
    # accepted events are at least ``gap`` apart, so no chain is longer than span / gap + 1:
    # that bounds the doubling rounds up front (one small aggregate instead of a check per round)
    span = succ.groupBy("k").agg((F.max("t") - F.min("t")).alias("s")).agg(F.max("s")).first()[0] or 0
    rounds = max(1, math.ceil(math.log2(span // gap + 2)))
    heads = succ.groupBy("k").agg(F.min_by("id", F.struct("t", "id")).alias("id")).select("id")
    jump = succ.select("id", "nxt").filter(F.col("nxt").isNotNull())
    marked = heads
    for r in range(rounds):
        # marked holds every chain node within distance < 2**r of its head; one 2**r jump doubles that
        # the new nodes sit at distances 2**r .. 2**(r+1)-1 from the head: disjoint from marked
        # (times strictly increase along a chain), so a plain union needs no distinct
        step = marked.join(jump, "id").select(F.col("nxt").alias("id"))
        marked = marked.unionByName(step)
        if r + 1 < rounds:
            j2 = jump.alias("a").join(jump.alias("b"), F.col("a.nxt") == F.col("b.id"))
            jump = j2.select(F.col("a.id").alias("id"), F.col("b.nxt").alias("nxt"))
        if (r + 1) % 3 == 0:
            marked, jump = _checkpoint(marked), _checkpoint(jump)
    return marked


def greedy_accept(events: DataFrame, key: str, ts: str, eid: str, gap: int, parts: int | None = None) -> DataFrame:
    """``events`` plus boolean ``accepted``."""
    ids = accepted_ids(events, key, ts, eid, gap, parts).select(F.col("id").alias(eid), F.lit(True).alias("accepted"))
    return events.join(ids, eid, "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))
