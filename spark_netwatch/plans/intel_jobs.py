"""Registered intel jobs: S6, U3, J1, J3-J6, F21, F22, A15, A17."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.net import ip_long, is_internal_prefix, is_private, subnet24
from ..operators import intel, report
from .registry import job, v, w
from .sqlgen import ip_long_sql, is_private_sql, subnet24_sql

IOC_SQL = "ioc AS (SELECT DISTINCT regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS ip FROM ioc_feed WHERE regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> '' AND NOT starts_with(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '#'))"


def _iocs(spark, sf):
    return intel.read_ioc_feed(v(spark, sf, "ioc_feed"), "line")


@job("S6_ioc_feed", w("ioc_feed") + ", " + IOC_SQL + "\nSELECT ip FROM ioc")
def s6_ioc(spark, sf):
    return _iocs(spark, sf)


@job("U3_ioc_refresh", w("ioc_feed", "vendor_raw") + ", " + IOC_SQL + """
SELECT ip FROM ioc UNION SELECT ip FROM vendor_raw WHERE gn_class = 'malicious'""")
def u3_refresh(spark, sf):
    feed_b = v(spark, sf, "vendor_raw").filter(F.col("gn_class") == "malicious").select("ip")
    current = _iocs(spark, sf).limit(0)
    return intel.refresh_iocs(current, _iocs(spark, sf), feed_b)


@job("J1_ioc_match", w("net_packets", "ioc_feed") + ", " + IOC_SQL + """
SELECT packet_id, src_ip, ioc.ip IS NOT NULL AS ioc_hit FROM net_packets LEFT JOIN ioc ON net_packets.src_ip = ioc.ip""")
def j1_match(spark, sf):
    return intel.ioc_match(v(spark, sf, "net_packets"), _iocs(spark, sf)).select("packet_id", "src_ip", "ioc_hit")


@job("J1_ioc_semi", w("net_packets", "ioc_feed") + ", " + IOC_SQL + """
SELECT src_ip, CAST(count(*) AS BIGINT) AS packets FROM net_packets WHERE src_ip IN (SELECT ip FROM ioc) GROUP BY src_ip""")
def j1_semi(spark, sf):
    hit = intel.ioc_semi(v(spark, sf, "net_packets"), _iocs(spark, sf))
    return hit.groupBy("src_ip").agg(F.count(F.lit(1)).alias("packets"))


ATTACK = "SELECT source_ip FROM threat_events WHERE label = 1 AND severity >= 7.0"


@job("A17_subnet_escalation", w("threat_events") + f"""SELECT {subnet24_sql('source_ip')} AS subnet,
  CAST(count(DISTINCT source_ip) AS BIGINT) AS unique_ips, list_sort(list_distinct(list(source_ip))) AS ips
FROM ({ATTACK}) WHERE {subnet24_sql('source_ip')} IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source_ip) >= 3""")
def a17_subnets(spark, sf):
    t = v(spark, sf, "threat_events").filter("label = 1 AND severity >= 7.0")
    return intel.subnet_escalation(t)


@job("J3_cidr_blocked", w("net_packets", "threat_events") + f""", sub AS (SELECT {subnet24_sql('source_ip')} AS subnet
  FROM ({ATTACK}) GROUP BY 1 HAVING count(DISTINCT source_ip) >= 3),
nets AS (SELECT {ip_long_sql("split_part(subnet, '/', 1)")} AS lo FROM sub)
SELECT packet_id, EXISTS (SELECT 1 FROM nets WHERE {ip_long_sql('src_ip')} BETWEEN nets.lo AND nets.lo + 255) AS cidr_blocked
FROM net_packets""")
def j3_cidr(spark, sf):
    t = v(spark, sf, "threat_events").filter("label = 1 AND severity >= 7.0")
    cidrs = intel.subnet_escalation(t).select(F.col("subnet").alias("cidr"))
    return intel.in_blocked_cidr(v(spark, sf, "net_packets"), cidrs).select("packet_id", "cidr_blocked")


VENDOR_SQL = """, vs AS (
  SELECT ip, 0 AS vendor_order, 'abuseipdb' AS vendor, CAST(abuse_score * 10 AS BIGINT) AS score10, 40 AS weight,
    list_filter([CASE WHEN abuse_score > 50 THEN 'AbuseIPDB-Flagged' END,
                 CASE WHEN abuse_reports > 0 THEN 'Reports:' || CAST(abuse_reports AS VARCHAR) END], lambda x: x IS NOT NULL) AS tags,
    'AbuseIPDB: score=' || CAST(abuse_score AS VARCHAR) || ', reports=' || CAST(abuse_reports AS VARCHAR) AS detail
  FROM vendor_raw WHERE abuse_score IS NOT NULL
  UNION ALL
  SELECT ip, 1, 'virustotal', CAST(round(round(vt_malicious / greatest(COALESCE(vt_total, 0), 1) * 100, 1) * 10) AS BIGINT), 35,
    CASE WHEN vt_malicious > 0 THEN ['VirusTotal-Malicious', 'VT-Detections:' || CAST(vt_malicious AS VARCHAR)] ELSE [] END,
    'VirusTotal: ' || CAST(vt_malicious AS VARCHAR) || '/' || CAST(COALESCE(vt_total, 0) AS VARCHAR) || ' detections'
  FROM vendor_raw WHERE vt_malicious IS NOT NULL
  UNION ALL
  SELECT ip, 2, 'greynoise',
    CAST((CASE WHEN gn_class = 'malicious' THEN 90 WHEN gn_noise THEN 60 WHEN gn_riot THEN 5 ELSE 0 END) * 10 AS BIGINT), 25,
    list_filter([CASE WHEN gn_class = 'malicious' THEN 'GreyNoise-Malicious' WHEN gn_noise THEN 'Internet-Scanner'
                      WHEN gn_riot THEN 'Known-Benign' END], lambda x: x IS NOT NULL),
    'GreyNoise: ' || gn_class || ', noise=' || CASE WHEN gn_noise THEN 'True' ELSE 'False' END
      || ', riot=' || CASE WHEN gn_riot THEN 'True' ELSE 'False' END
  FROM vendor_raw WHERE gn_class IS NOT NULL)
"""

FUSE_SQL = """, f AS (SELECT ip, sum(score10 * weight) AS num, sum(weight) AS den, count(*) AS vendors,
  list_sort(list_distinct(flatten(list(tags)))) AS tags,
  string_agg(detail, ' | ' ORDER BY vendor_order) AS details FROM vs GROUP BY ip)
SELECT ip, least(floor((num * 2 + den) / (den * 2.0)) / 10.0, 100.0) AS threat_score,
  least(floor((num * 2 + den) / (den * 2.0)) / 10.0, 100.0) > 50 AS is_flagged, tags,
  'Checked by ' || CAST(vendors AS VARCHAR) || ' vendors. ' || details AS vendor_reports, CAST(vendors AS BIGINT) AS vendors
FROM f"""


@job("J5_vendor_scores", w("vendor_raw") + VENDOR_SQL + "SELECT ip, vendor, score10 / 10.0 AS score, weight, tags, detail FROM vs")
def j5_scores(spark, sf):
    s = intel.vendor_scores(v(spark, sf, "vendor_raw"))
    return s.select("ip", "vendor", (F.col("score10") / 10.0).alias("score"), "weight", "tags", "detail")


@job("J4_osint_fusion", w("vendor_raw") + VENDOR_SQL + FUSE_SQL)
def j4_fusion(spark, sf):
    return intel.fuse_reputation(intel.vendor_scores(v(spark, sf, "vendor_raw")))


GEO_SQL = f""", k AS (SELECT DISTINCT src_ip FROM net_packets),
g AS (SELECT k.src_ip, arg_min(r.country, r.ip_lo) AS country, arg_min(r.city, r.ip_lo) AS city,
  arg_min(r.lat, r.ip_lo) AS lat, arg_min(r.lon, r.ip_lo) AS lon
  FROM k JOIN geo_ranges r ON {ip_long_sql('k.src_ip')} BETWEEN r.ip_lo AND r.ip_hi GROUP BY k.src_ip),
geo AS (SELECT k.src_ip,
  CASE WHEN {is_private_sql('k.src_ip')} THEN 'Local' ELSE COALESCE(g.country, 'Unknown') END AS country,
  CASE WHEN {is_private_sql('k.src_ip')} THEN 'Internal' ELSE COALESCE(g.city, 'Unknown') END AS city,
  CASE WHEN {is_private_sql('k.src_ip')} THEN 0.0 ELSE COALESCE(g.lat, 0.0) END AS lat,
  CASE WHEN {is_private_sql('k.src_ip')} THEN 0.0 ELSE COALESCE(g.lon, 0.0) END AS lon
  FROM k LEFT JOIN g ON k.src_ip = g.src_ip)
"""


@job("J6_geo_lookup", w("net_packets", "geo_ranges") + GEO_SQL + "SELECT * FROM geo")
def j6_geo(spark, sf):
    keys = v(spark, sf, "net_packets").select("src_ip").distinct()
    return intel.geo_lookup(keys, v(spark, sf, "geo_ranges"))


@job("A15_geo_counts", w("net_packets", "geo_ranges", "threat_events") + GEO_SQL.replace(
    "SELECT DISTINCT src_ip FROM net_packets", "SELECT DISTINCT source_ip AS src_ip FROM threat_events") + """
SELECT country, city, lat, lon, CAST(count(*) AS BIGINT) AS threats FROM threat_events t JOIN geo ON t.source_ip = geo.src_ip
WHERE COALESCE(regexp_matches(t.detection_method, '(?i)GenAI|DPI'), false) GROUP BY ALL""")
def a15_geo(spark, sf):
    t = report.report_threats(v(spark, sf, "threat_events"))
    g = intel.geo_lookup(t, v(spark, sf, "geo_ranges"), ip="source_ip")
    return report.geo_counts(g)


@job("F21_subnet24", w("threat_events") + f"""SELECT DISTINCT source_ip, {subnet24_sql('source_ip')} AS subnet,
  {ip_long_sql('source_ip')} AS ip_long FROM threat_events""")
def f21_subnet(spark, sf):
    t = v(spark, sf, "threat_events").select("source_ip").distinct()
    return t.select("source_ip", subnet24("source_ip").alias("subnet"), ip_long("source_ip").alias("ip_long"))


@job("F22_private_class", w("threat_events") + f"""SELECT DISTINCT source_ip, {is_private_sql('source_ip')} AS is_private,
  (starts_with(source_ip, '10.') OR starts_with(source_ip, '192.168.') OR starts_with(source_ip, '172.')) AS is_internal
FROM threat_events""")
def f22_private(spark, sf):
    t = v(spark, sf, "threat_events").select("source_ip").distinct()
    return t.select("source_ip", is_private("source_ip").alias("is_private"), is_internal_prefix("source_ip").alias("is_internal"))
