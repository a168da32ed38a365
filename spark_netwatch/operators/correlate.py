"""Multi-stage correlation.

For each analysable event (P4) the set of distinct non-``Unknown`` tactics the
same source showed in the trailing window (inclusive; events of one instant
are peers) decides escalation. A tactic is in the set when the last time it was
seen so far lies in the window: one running maximum per tactic, over the
stretches of a source (``stretches``), so a source that holds all rows is spread
over tasks. The names of the tactics (a fixed matrix) are read first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .stretches import PART, Dealt, deal, running
from .threats import analysable

US = 1_000_000


def correlation_tactics(dealt: Dealt, ts: str, tactic: Column, mask: Column, vocab: list[str],
                        window_s: int = C.CORRELATION_WINDOW_SECONDS, out: str = "corr_tactics") -> DataFrame:
    """The dealt rows with the tactics of ``vocab`` that rows of ``mask`` showed in the window, in its order; null elsewhere."""
    last = {f"_last{i}": (F.max, F.when(mask & (tactic == t), F.col(ts))) for i, t in enumerate(vocab)}
    rows = running(dealt, last, [ts], peers=True)
    seen = [F.when(F.col(f"_last{i}") >= F.col(ts) - window_s * US, F.lit(t)) for i, t in enumerate(vocab)]
    return rows.withColumn(out, F.when(mask, F.array_compact(F.array(*seen).cast("array<string>")))).drop(*last)


def correlate(events: DataFrame, ip: str = "source_ip", ts: str = "ts_us", eid: str = "event_id",
              tactic: str = "mitre_tactic", severity: str = "severity", confidence: str = "confidence",
              window_s: int = C.CORRELATION_WINDOW_SECONDS, min_stages: int = C.CORRELATION_MIN_STAGES,
              parts: int | None = None) -> DataFrame:
    """W5 over analysable events: adds tactics, stages, escalated and the escalated values."""
    base = analysable(events, ip, severity).withColumn(
        "_tac", F.coalesce(F.col(tactic), F.lit("Unknown")))
    vocab = sorted(r[0] for r in base.select("_tac").distinct().collect() if r[0] != "Unknown")
    out = correlation_tactics(deal(base, ip, ts, parts), ts, F.col("_tac"), F.lit(True), vocab, window_s, "tactics")
    out = out.drop(PART).withColumn("stages", F.size("tactics"))
    esc = F.col("stages") >= min_stages
    return out.select(
        *[F.col(c) for c in events.columns],
        "tactics", "stages", esc.alias("escalated"),
        F.when(esc, F.least(F.lit(10.0), F.col(severity) + F.col("stages") * 1.5)).otherwise(F.col(severity)).alias("corr_severity"),
        F.when(esc, F.least(F.lit(100.0), F.col(confidence) + 20)).otherwise(F.col(confidence)).alias("corr_confidence"),
        F.when(esc, F.concat(F.lit("Multi-Stage: "), F.array_join("tactics", ", "))).otherwise(F.col("_tac")).alias("corr_tactic"),
        F.when(esc, F.lit("Correlated & Escalated")).alias("action_taken"),
    )
