"""Results do not depend on the number of stretches into which heavy keys are cut."""

import random

from pyspark.sql import functions as F

from spark_netwatch.operators import flows, intel, respond, threats, verdict
from spark_netwatch.operators.correlate import correlate
from spark_netwatch.operators.stretches import PART, deal, deal_all, running

T0 = 1_700_000_000_000_000
STATE = ["packet_id", "sess", "n", "unique_ports", "start_us", "bytes", "syn_count", "ack_count", "risk10", "duration", "connection_interval",
         "jitter", "byte_rate", "log_rate", "size_anomaly", "flag_high_rate", "flag_size", "flag_ports"]


def rows_of(df, *cols):
    return sorted(tuple(map(str, r)) for r in df.select(*cols).collect())


def packets(spark):
    # one source holds most packets: two sessions, ports that come again late, few packets with a size
    rows = []
    for i in range(1500):
        ts = T0 + i * 250_000 + (400_000_000 if i >= 1000 else 0)
        rows.append((i, "6.6.6.6", ts, 80 + (i % 13) * (1 + i // 350), 0 if i % 9 else 40 + (i * 7) % 1500, 2 if i % 3 == 0 else 16))
    rows += [(10_000 + i, "1.1.1.1", T0 + i * 9_000_000, 443, 60, 16) for i in range(50)]
    return spark.createDataFrame(rows, "packet_id long, src_ip string, ts_us long, dst_port int, packet_size long, tcp_flags int")


def test_flow_state(spark):
    df = packets(spark)
    want = rows_of(flows.flow_state(df, parts=1), *STATE)
    for parts in (6, 300):
        assert rows_of(flows.flow_state(df, parts=parts), *STATE) == want
    assert rows_of(flows.sessionize(df, parts=50), "packet_id", "sess") == [(r[0], r[1]) for r in want]


def test_a_heavy_source_is_spread_and_planned_once(spark):
    df = packets(spark)
    dealt = deal(df, "src_ip", "ts_us", 20)
    sizes = [r["count"] for r in dealt.rows.groupBy("src_ip", PART).count().collect()]
    assert max(sizes) <= 2 * 1550 / 20 and sum(sizes) == 1550
    plan = flows.flow_state(df, parts=20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "CartesianProduct" not in plan


def test_running_aggregates_of_no_key_and_of_a_null_key(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", None, None, "b"]), rng.randrange(300), rng.choice([None, rng.randrange(50)])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, k string, t long, x long")
    values = {"s": (F.sum, F.col("x")), "m": (F.max, F.col("x")), "l": (F.min, F.col("x"))}
    for dealt in (lambda n: deal(df, "k", "t", n), lambda n: deal_all(df, "t", n)):
        for peers, order in ((True, ["t"]), (False, ["t", "id"])):
            want = rows_of(running(dealt(1), values, order, peers), "id", "s", "m", "l")
            assert rows_of(running(dealt(25), values, order, peers), "id", "s", "m", "l") == want
    assert running(deal(df.limit(0), "k", "t"), values, ["t"]).count() == 0


def test_correlation_and_reputation_of_one_source(spark):
    rng = random.Random(2)
    names = ["Discovery", "Execution", "Impact", "Unknown", None]
    rows = [(i, "9.9.9.9", T0 + rng.randrange(4000) * 1_000_000, rng.choice(names), 5.0, rng.randrange(100) / 2) for i in range(500)]
    df = spark.createDataFrame(rows, "event_id long, source_ip string, ts_us long, mitre_tactic string, severity double, confidence double")
    got = {r.event_id: r.tactics for r in correlate(df, parts=30).collect()}
    for i, _, ts, *_ in rows:
        seen = {t for _, _, at, t, *_ in rows if ts - 600_000_000 <= at <= ts and t not in ("Unknown", None)}
        assert got[i] == sorted(seen)
    cols = ("event_id", "running_avg_confidence", "running_max_severity")
    assert rows_of(threats.running_reputation(df, parts=30), *cols) == rows_of(threats.running_reputation(df, parts=1), *cols)


def test_ranges_that_overlap(spark):
    rng = random.Random(3)
    base = (8 << 24) + (8 << 16)
    ranges = []
    for i in range(40):
        lo = base + rng.randrange(60_000)
        ranges.append((lo, lo + rng.choice([0, 5, 3000, 40_000]), f"c{i}", f"t{i}", float(i), -float(i)))
    addresses = [base + rng.randrange(70_000) for _ in range(300)] + [10 << 24]
    texts = [".".join(str(a >> s & 255) for s in (24, 16, 8, 0)) for a in addresses] + ["no address", None]
    df = spark.createDataFrame([(t,) for t in texts], "src_ip string")
    places = spark.createDataFrame(ranges, "ip_lo long, ip_hi long, country string, city string, lat double, lon double")
    got = {r.src_ip: r.country for r in intel.geo_lookup(df, places, parts=20).collect()}
    for a, t in zip(addresses, texts):
        holding = [r for r in ranges if r[0] <= a <= r[1]]
        if a == 10 << 24:
            assert got[t] == "Local"
        else:
            assert got[t] in ({r[2] for r in holding if r[0] == min(h[0] for h in holding)} if holding else {"Unknown"})
    assert got["no address"] == got[None] == "Local" and intel.geo_lookup(df, places).count() == len(texts)
    nets = spark.createDataFrame([("8.8.16.0/20",), ("8.8.0.0/25",), ("8.8.17.0/24",)], "cidr string")
    flags = {r.src_ip: r.cidr_blocked for r in intel.in_blocked_cidr(df, nets, parts=20).collect()}
    assert all(flags[t] == (base + 4096 <= a < base + 8192 or base <= a < base + 128) for a, t in zip(addresses, texts))


def test_blocked_packets_by_slice(spark):
    blocks = [("1.1.1.1", T0, T0 + 3_600_000_000), ("1.1.1.1", T0 + 9_000_000_000, T0 + 12_600_000_000), ("2.2.2.2", T0, T0)]
    packets = [(i, ip, T0 + i * 7_000_000) for i in range(2000) for ip in ("1.1.1.1", "2.2.2.2")]
    df = spark.createDataFrame(packets, "packet_id long, src_ip string, ts_us long")
    b = spark.createDataFrame(blocks, "ip string, from_us long, until_us long")
    want = sorted((str(i), ip) for i, ip, ts in packets if not any(x == ip and lo <= ts < hi for x, lo, hi in blocks))
    assert rows_of(intel.drop_blocked(df, b), "packet_id", "src_ip") == want


def test_blocks_over_a_minute_edge_are_flagged(spark):
    edge = T0 - T0 % 60_000_000 + 60_000_000
    times = [edge - 25_000_000 + i * 900_000 for i in range(60)]
    df = spark.createDataFrame([(i, f"5.5.5.{i}", t) for i, t in enumerate(times)], "event_id long, ip string, from_us long")
    got = {r.event_id: (r.recent_blocks, r.over_limit) for r in respond.trailing_block_rate(df).collect()}
    assert got == {i: (i + 1, i + 1 > 50) for i in range(60)}


def test_counters(spark):
    rows = [(i, f"7.7.7.{i % 3}", 0 if i < 60 else 1, T0 + (i if i < 60 else i + 400) * 1_000_000, i % 20 == 7) for i in range(90)]
    df = spark.createDataFrame(rows, "packet_id long, src_ip string, sess long, ts_us long, is_threat boolean")
    got = {r.packet_id: (r.active_flows, r.threat_sources) for r in verdict.running_counters(df, parts=12).collect()}
    for i, _, _, ts, _ in rows:
        flows_ = {(s, k) for _, s, k, _, _ in rows if min(t for _, a, b, t, _ in rows if (a, b) == (s, k)) <= ts
                  <= max(t for _, a, b, t, _ in rows if (a, b) == (s, k)) + 300_000_000}
        assert got[i] == (len(flows_), len({s for _, s, _, t, threat in rows if threat and t <= ts}))
