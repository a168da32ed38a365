"""Response layer: alert gate with per-source cooldown (W6, A25, P13), block
intervals (W7, W8, A24, J2), playbook actions (D5, J11), block audit (A28, T5).

The reference applies these to each event as it arrives; here they are
open-loop (SURVEY Q12): every threat is detected first, then the responses are
derived as tables from the verdicts.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.net import is_internal_prefix, subnet24
from ..session import staged
from .greedy import accepted_ids
from .stretches import deal, running
from .threats import severity_label

US = 1_000_000


def alert_gate(threats: DataFrame, key: str = "source_ip", ts: str = "ts_us", eid: str = "event_id",
               severity: str = "severity", cooldown_s: int = C.ALERT_COOLDOWN_SECONDS,
               threshold: float | None = C.ALERT_SEVERITY_THRESHOLD) -> DataFrame:
    """``alert_status`` = below_threshold | sent | suppressed for every row."""
    gated = threats if threshold is None else threats.filter(F.col(severity) >= threshold)
    sent = accepted_ids(gated.select(key, ts, eid), key, ts, eid, cooldown_s * US)
    out = threats.join(sent.select(F.col("id").alias(eid), F.lit(True).alias("_sent")), eid, "left")
    reached = F.lit(True) if threshold is None else F.coalesce(F.col(severity) >= threshold, F.lit(False))
    status = F.when(~reached, "below_threshold").when(F.col("_sent"), "sent").otherwise("suppressed")
    return out.withColumn("alert_status", status).drop("_sent")


def alert_counters(gated: DataFrame) -> DataFrame:
    """Sent / suppressed / below-threshold counts."""
    return gated.groupBy("alert_status").agg(F.count(F.lit(1)).alias("alerts"))


def alert_payload(df: DataFrame, version: str = "2.0.0") -> DataFrame:
    """Alert payload with nested ``mitre_attack``; missing values -> ``N/A``."""
    def na(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("N/A")) if c in df.columns else F.lit("N/A")

    def opt(c, default=""):
        return F.coalesce(F.col(c).cast("string"), F.lit(default)) if c in df.columns else F.lit(default)
    return df.select(
        F.lit("stealth_recon_detection").alias("alert_type"),
        severity_label("severity").alias("severity"),
        F.col("severity").alias("severity_score"),
        na("event_id").alias("event_id"),
        na("timestamp").alias("timestamp"),
        na("source_ip").alias("source_ip"),
        na("destination_ip").alias("destination_ip"),
        na("detection_method").alias("detection_method"),
        na("confidence").alias("confidence"),
        na("intel").alias("threat_intel"),
        F.struct(opt("mitre_technique").alias("technique"), opt("mitre_tactic").alias("tactic")).alias("mitre_attack"),
        na("firewall_status").alias("firewall_action"),
        F.lit(version).alias("system_version"),
    )


def block_intervals(threats: DataFrame, key: str = "source_ip", ts: str = "ts_us", eid: str = "event_id",
                    ttl_s: int = C.BLOCK_TTL_SECONDS) -> DataFrame:
    """First threat blocks the source for ``ttl_s``; threats while blocked are absorbed.

    One row per block: ip, from_us, until_us, action (BLOCK or QUARANTINE for
    internal prefixes), reason, event_id that opened it.
    """
    opened = threats.join(accepted_ids(threats.select(key, ts, eid), key, ts, eid, ttl_s * US).withColumnRenamed("id", eid), eid)
    lab = F.when(F.col("severity") >= 9.0, "CRITICAL").otherwise("HIGH")
    return opened.select(
        F.col(key).alias("ip"), F.col(ts).alias("from_us"), (F.col(ts) + ttl_s * US).alias("until_us"),
        F.when(is_internal_prefix(F.col(key)), "QUARANTINE").otherwise("BLOCK").alias("action"),
        F.concat(lab, F.lit(" Playbook: "), F.coalesce(F.col("mitre_tactic"), F.lit("Unknown"))).alias("reason"),
        F.col(eid).alias("event_id"),
    )


def block_rate(blocks: DataFrame, limit: int = C.MAX_BLOCKS_PER_MINUTE) -> DataFrame:
    """W8 (as a report): blocks opened per minute, flagged when over the limit."""
    minute = F.floor(F.col("from_us") / (60 * US)).cast("bigint")
    return (blocks.groupBy(minute.alias("minute")).agg(F.count(F.lit(1)).alias("blocks"))
            .withColumn("over_limit", F.col("blocks") > limit))


def trailing_block_rate(blocks: DataFrame, limit: int = C.MAX_BLOCKS_PER_MINUTE, window_s: int = 60, parts: int | None = None) -> DataFrame:
    """With each block, the blocks of all sources in the ``window_s`` up to it (its own instant included).

    A block is a mark of +1 at its time and one of -1 just after its window; the count is their running sum in the
    order of time, over stretches (``stretches``). A sliding frame would go through its whole window for each row.
    Blocks without a time count for one another alone.
    """
    own = staged(blocks.select("event_id", "ip", "from_us"), "blocks")
    begin = F.struct(F.col("from_us").alias("_at"), F.lit(1).cast("long").alias("_by"))
    end = F.struct((F.col("from_us") + window_s * US + 1).alias("_at"), F.lit(-1).cast("long").alias("_by"))
    marks = own.select("*", F.col("from_us").isNull().alias("_undated"), F.inline(F.array(begin, end))).filter("_by > 0 OR NOT _undated")
    counts = running(deal(marks, "_undated", "_at", parts), {"recent_blocks": (F.sum, F.col("_by"))}, ["_at"], peers=True).filter("_by > 0")
    return counts.select("event_id", "ip", "from_us", "recent_blocks", (F.col("recent_blocks") > limit).alias("over_limit"))


def active_blocks(blocks: DataFrame, as_of_us: int) -> DataFrame:
    """Blocks in force at ``as_of_us`` with their remaining seconds."""
    return (blocks.filter((F.col("from_us") <= as_of_us) & (F.col("until_us") > as_of_us))
            .select("ip", "action", F.greatest(F.lit(0), (F.col("until_us") - as_of_us) / US).alias("remaining_s")))


def playbook(events: DataFrame, ip: str = "source_ip", severity: str = "severity",
             method: str = "detection_method", tactic: str = "mitre_tactic") -> DataFrame:
    """Response actions per event, one row per action (explode of an action array)."""
    src, sev = F.col(ip), F.col(severity)
    tac = F.coalesce(F.col(tactic), F.lit("Unknown"))
    internal = is_internal_prefix(src)

    def act(step: int, action, target: Column, delta: int, details: Column):
        a = F.lit(action) if isinstance(action, str) else action
        return F.struct(F.lit(step).alias("step"), a.alias("action"), target.alias("target"),
                        F.lit(delta).alias("delta"), details.alias("details"))

    def isolate(level):
        return act(1, F.when(internal, "QUARANTINE").otherwise("BLOCK"), src, 0,
                   F.concat(F.lit(f"{level} Playbook: "), tac))
    sub = subnet24(src)
    critical = [
        isolate("CRITICAL"),
        act(2, "BLOCK_CIDR", sub, 0, F.concat(F.lit("CRITICAL Subnet isolation for "), src)),
        act(3, "ALERT", src, 0, F.lit("")),
        act(4, "REPUTATION", src, C.PLAYBOOK_DELTAS["critical"], tac),
    ]
    high = [isolate("HIGH"), act(2, "ALERT", src, 0, F.lit("")),
            act(3, "REPUTATION", src, C.PLAYBOOK_DELTAS["high"], tac)]
    medium = [act(1, "REPUTATION", src, C.PLAYBOOK_DELTAS["medium"], tac)]
    level5 = act(0, "AUTO_SIGNATURE", src, 0, F.lit("Level 5 Auto-Generated Rule"))
    crit_arr = F.filter(F.array(*critical), lambda a: a["target"].isNotNull())
    ueba = F.coalesce(F.col(method), F.lit("")).contains("UEBA Predictive Engine")
    actions = (F.when(src.isNull() | (src == "") | (src == "127.0.0.1"), F.array())
               .when(ueba, F.concat(F.array(level5), crit_arr))
               .when(sev >= 9.0, crit_arr)
               .when(sev >= 7.0, F.array(*high))
               .when(sev >= 5.0, F.array(*medium))
               .otherwise(F.array()))
    level = (F.when(ueba, "LEVEL5").when(sev >= 9.0, "CRITICAL").when(sev >= 7.0, "HIGH")
             .when(sev >= 5.0, "MEDIUM").otherwise("NONE"))
    keep = [c for c in ["event_id", "ts_us", "timestamp"] if c in events.columns]
    return events.select(*keep, src.alias("source_ip"), level.alias("level"), tac.alias("tactic"),
                         F.explode(actions).alias("a")).select("*", "a.*").drop("a")


def block_audit(actions: DataFrame) -> DataFrame:
    """Audit rows (action, target, details) for isolation actions."""
    return actions.filter(F.col("action").isin("BLOCK", "QUARANTINE", "BLOCK_CIDR")).select(
        "event_id", "ts_us", "action", "target", "details")


def audit_counts(audit: DataFrame) -> DataFrame:
    """Rows per action."""
    return audit.groupBy("action").agg(F.count(F.lit(1)).alias("entries"))


def as_of_micros(as_of: str) -> int:
    t = dt.datetime.fromisoformat(as_of).replace(tzinfo=dt.timezone.utc)
    return int(t.timestamp() * US)
