"""Threat-intelligence lookups as joins: IOC feeds (S6, U3, J1), block lists
(J2, J3), vendor reputation fusion (J4, J5), geo ranges (J6), subnet
escalation (A17).

Dimension sizes come from data, so no join here carries a broadcast hint:
AQE measures the built side at run time and switches to a broadcast join only
when it is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``. Range
lookups are running minima or maxima over ranges and addresses in one order
(``stretches``), linear in both; no address is paired with a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.net import ip_long, is_private, subnet24
from .stretches import deal_all, running

# ---------------------------------------------------------------- IOC feeds


def read_ioc_feed(lines: DataFrame, col: str = "value") -> DataFrame:
    """Trim, drop blank and ``#`` lines, distinct addresses."""
    t = F.regexp_replace(F.col(col), r"^\s+|\s+$", "")
    return lines.select(t.alias("ip")).filter((F.col("ip") != "") & ~F.col("ip").startswith("#")).distinct()


def refresh_iocs(current: DataFrame, *feeds: DataFrame) -> DataFrame:
    """Union of feeds, distinct; an empty refresh keeps the current set."""
    fresh = feeds[0]
    for f in feeds[1:]:
        fresh = fresh.unionByName(f)
    fresh = fresh.distinct()
    return current if fresh.isEmpty() else fresh


def ioc_match(df: DataFrame, iocs: DataFrame, ip: str = "src_ip", flag: str = "ioc_hit") -> DataFrame:
    """J1 (flag form): left join on the address, flag = matched."""
    keys = iocs.select(F.col("ip").alias("_ioc")).distinct()
    return df.join(keys, F.col(ip) == F.col("_ioc"), "left").withColumn(flag, F.col("_ioc").isNotNull()).drop("_ioc")


def ioc_semi(df: DataFrame, iocs: DataFrame, ip: str = "src_ip") -> DataFrame:
    """J1 (semi form): rows whose address is in the IOC set."""
    return df.join(iocs.select(F.col("ip").alias(ip)).distinct(), ip, "left_semi")

# ---------------------------------------------------------------- block lists


def drop_blocked(packets: DataFrame, blocks: DataFrame, ip: str = "src_ip", ts: str = "ts_us", slice_s: int = C.BLOCK_TTL_SECONDS) -> DataFrame:
    """Anti-join on the address with the packet time inside ``[from_us, until_us)``.

    A block is a row for each slice of ``slice_s`` that it touches, and packets meet it in their own
    slice: a source's packets are spread over its slices, each of which has few blocks.
    """
    width = slice_s * 1_000_000
    b = blocks.select(F.col("ip").alias("_bip"), F.col("from_us").alias("_from"), F.col("until_us").alias("_until")).filter("_from < _until")
    first, last = F.floor(F.col("_from") / F.lit(width)), F.floor((F.col("_until") - 1) / F.lit(width))
    b = b.select("*", F.explode(F.sequence(first, last)).alias("_bslice"))
    cond = ((F.col(ip) == F.col("_bip")) & (F.floor(F.col(ts) / F.lit(width)) == F.col("_bslice"))
            & (F.col(ts) >= F.col("_from")) & (F.col(ts) < F.col("_until")))
    return packets.join(b, cond, "left_anti")


def cidr_bounds(cidr: Column) -> tuple[Column, Column]:
    base = ip_long(F.substring_index(cidr, "/", 1))
    bits = F.substring_index(cidr, "/", -1).cast("int")
    size = F.pow(F.lit(2.0), 32 - bits).cast("bigint")
    lo = base - F.pmod(base, size)
    return lo, lo + size - 1


def in_blocked_cidr(df: DataFrame, cidrs: DataFrame, ip: str = "src_ip", flag: str = "cidr_blocked", parts: int | None = None) -> DataFrame:
    """Address inside any blocked CIDR.

    Networks and distinct addresses are put in one order; an address is inside when the furthest end of
    the networks that start before it reaches it. No address is paired with a network.
    """
    lo, hi = cidr_bounds(F.col("cidr"))
    marks = (cidrs.select(lo.alias("at"), hi.alias("hi")).filter("at IS NOT NULL")
             .unionByName(df.select(ip_long(ip).alias("at")).distinct().filter("at IS NOT NULL"), allowMissingColumns=True))
    rows = running(deal_all(marks, "at", parts), {"_end": (F.max, F.col("hi"))}, ["at"], peers=True)
    hits = rows.filter("hi IS NULL AND _end >= at").select(F.col("at").alias("_ipl"), F.lit(True).alias(flag))
    probe = df.withColumn("_ipl", ip_long(ip))
    return probe.join(hits, "_ipl", "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False))).drop("_ipl")

# ---------------------------------------------------------------- vendor fusion


def _bool_text(c: Column) -> Column:
    return F.when(c, "True").otherwise("False")


def vendor_scores(raw: DataFrame) -> DataFrame:
    """One row per (ip, vendor) that answered: score x10 (integer), weight (percent), tags, detail."""
    w = {k: int(round(v * 100)) for k, v in C.VENDOR_WEIGHTS.items()}
    abuse = raw.filter(F.col("abuse_score").isNotNull()).select(
        "ip", F.lit(0).alias("vendor_order"), F.lit("abuseipdb").alias("vendor"),
        (F.col("abuse_score") * 10).cast("bigint").alias("score10"), F.lit(w["abuseipdb"]).alias("weight"),
        F.array_compact(F.array(F.when(F.col("abuse_score") > 50, F.lit("AbuseIPDB-Flagged")),
                                F.when(F.col("abuse_reports") > 0, F.concat(F.lit("Reports:"), F.col("abuse_reports").cast("string"))))).alias("tags"),
        F.format_string("AbuseIPDB: score=%s, reports=%s", F.col("abuse_score").cast("string"),
                        F.col("abuse_reports").cast("string")).alias("detail"))
    total = F.coalesce(F.col("vt_total"), F.lit(0))
    vt_score = F.round(F.col("vt_malicious") / F.greatest(total, F.lit(1)) * 100, 1)
    vt = raw.filter(F.col("vt_malicious").isNotNull()).select(
        "ip", F.lit(1).alias("vendor_order"), F.lit("virustotal").alias("vendor"),
        F.round(vt_score * 10).cast("bigint").alias("score10"), F.lit(w["virustotal"]).alias("weight"),
        F.when(F.col("vt_malicious") > 0, F.array(F.lit("VirusTotal-Malicious"),
                                                   F.concat(F.lit("VT-Detections:"), F.col("vt_malicious").cast("string"))))
         .otherwise(F.array().cast("array<string>")).alias("tags"),
        F.format_string("VirusTotal: %s/%s detections", F.col("vt_malicious").cast("string"),
                        total.cast("string")).alias("detail"))
    gn_score = (F.when(F.col("gn_class") == "malicious", 90).when(F.col("gn_noise"), 60)
                .when(F.col("gn_riot"), 5).otherwise(0))
    gn_tag = (F.when(F.col("gn_class") == "malicious", "GreyNoise-Malicious").when(F.col("gn_noise"), "Internet-Scanner")
              .when(F.col("gn_riot"), "Known-Benign"))
    gn = raw.filter(F.col("gn_class").isNotNull()).select(
        "ip", F.lit(2).alias("vendor_order"), F.lit("greynoise").alias("vendor"),
        (gn_score * 10).cast("bigint").alias("score10"), F.lit(w["greynoise"]).alias("weight"),
        F.array_compact(F.array(gn_tag)).alias("tags"),
        F.format_string("GreyNoise: %s, noise=%s, riot=%s", F.col("gn_class"), _bool_text(F.col("gn_noise")),
                        _bool_text(F.col("gn_riot"))).alias("detail"))
    return abuse.unionByName(vt).unionByName(gn)


def fuse_reputation(scores: DataFrame) -> DataFrame:
    """Weighted mean over vendors that answered, capped at 100, half-up to 0.1.

    Integer score x10 and weight in percent keep the sum exact; the group per
    address holds at most one row per vendor.
    """
    g = scores.groupBy("ip").agg(
        F.sum(F.col("score10") * F.col("weight")).alias("_num"),
        F.sum("weight").alias("_den"),
        F.count(F.lit(1)).alias("vendors"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"),
        F.sort_array(F.collect_list(F.struct("vendor_order", "detail"))).alias("_details"),
    )
    fused10 = F.floor((F.col("_num") * 2 + F.col("_den")) / (F.col("_den") * 2.0))
    score = F.least(fused10 / 10.0, F.lit(100.0))
    return g.select(
        "ip", score.alias("threat_score"), (score > C.OSINT_FLAG_SCORE).alias("is_flagged"), "tags",
        F.concat(F.lit("Checked by "), F.col("vendors").cast("string"), F.lit(" vendors. "),
                 F.array_join(F.transform("_details", lambda d: d["detail"]), " | ")).alias("vendor_reports"),
        "vendors",
    )

# ---------------------------------------------------------------- geo


def geo_lookup(df: DataFrame, ranges: DataFrame, ip: str = "src_ip", parts: int | None = None) -> DataFrame:
    """Private -> Local/Internal/0/0; in a range -> its place; else Unknown/0/0.

    Ranges, at their ends, and distinct public addresses are put in one order, from the highest down. Of
    the ranges that end at or after an address, the one of the lowest start is the running minimum
    there; the address lies in it, or in none. No address is paired with a range.
    """
    private = is_private(F.col(ip))
    keys = df.filter(~private).select(F.col(ip).alias("_ip")).distinct()
    ranges = ranges.filter("ip_lo <= ip_hi")
    marks = (ranges.select((-F.col("ip_hi")).alias("at"), "ip_lo")
             .unionByName(keys.select((-ip_long(F.col("_ip"))).alias("at"), "_ip").filter("at IS NOT NULL"), allowMissingColumns=True))
    rows = running(deal_all(marks, "at", parts), {"_lo": (F.min, F.col("ip_lo"))}, ["at"], peers=True)
    places = ranges.groupBy(F.col("ip_lo").alias("_lo")).agg(F.max_by(F.struct("country", "city", "lat", "lon"), "ip_hi").alias("_g"))
    hit = rows.filter("_ip IS NOT NULL AND _lo <= -at").select("_ip", "_lo").join(places, "_lo")
    out = df.join(hit, F.col(ip) == F.col("_ip"), "left")
    return out.select(
        *[F.col(c) for c in df.columns],
        F.when(private, "Local").otherwise(F.coalesce(F.col("_g.country"), F.lit("Unknown"))).alias("country"),
        F.when(private, "Internal").otherwise(F.coalesce(F.col("_g.city"), F.lit("Unknown"))).alias("city"),
        F.when(private, 0.0).otherwise(F.coalesce(F.col("_g.lat"), F.lit(0.0))).alias("lat"),
        F.when(private, 0.0).otherwise(F.coalesce(F.col("_g.lon"), F.lit(0.0))).alias("lon"),
    )

# ---------------------------------------------------------------- subnets


def subnet_escalation(attackers: DataFrame, ip: str = "source_ip",
                      threshold: int = C.SUBNET_ESCALATION_SOURCES) -> DataFrame:
    """/24 networks with at least ``threshold`` distinct attacking addresses."""
    return (attackers.select(F.col(ip).alias("ip")).filter(subnet24(F.col("ip")).isNotNull())
            .groupBy(subnet24(F.col("ip")).alias("subnet"))
            .agg(F.countDistinct("ip").alias("unique_ips"), F.array_sort(F.collect_set("ip")).alias("ips"))
            .filter(F.col("unique_ips") >= threshold))
