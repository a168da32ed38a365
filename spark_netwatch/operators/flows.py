"""Flow state as window frames: sessions (W0), running flow state (W1),
interval frames (W2), size anomaly (W3), risk accumulation (W4), flow
summaries (A1-A5) and the per-packet feature vector (D1).

All windows share one partitioning: ``src_ip`` and the stretch of its rows (see ``stretches``),
so Spark plans a single exchange and later frames on ``(src_ip, stretch, sess)`` reuse it (hash
partitioning on a prefix satisfies the clustering). Frames are bounded (99 and
50 rows) except the running counters, which stream through the sorted
partition without buffering it.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.net import decode_flags
from ..functions.text import byte_entropy
from .stretches import PART, Dealt, both, deal, with_carry

US = 1_000_000


def round4_seconds(num_us, den=None):
    """num_us / den microseconds as seconds, rounded half-up to 4 places in integer arithmetic.

    Exact decimal inputs hit rounding ties often; integer rounding gives the
    same double in every engine. ``num_us`` must be non-negative.
    """
    num = F.col(num_us) if isinstance(num_us, str) else num_us
    d = F.lit(1) if den is None else (F.col(den) if isinstance(den, str) else den)
    return F.floor((num * 2 + d * 100) / (d * 200.0)) / 10000.0


ORDER = ["ts_us", "packet_id"]


#: Rows of a source before a stretch that the bounded frames (99 and 50 rows) of its first rows reach back to.
_TAILS = {"_tail": (C.MAX_TIMESTAMPS_PER_FLOW, "true"), "_sized": (C.SIZE_WINDOW, "coalesce(packet_size > 0, false)")}


def _halo(dealt: Dealt) -> DataFrame:
    """Earlier packets that a later stretch needs: the source's last ones for the bounded frames, and the
    newest one of each port that the stretch meets again."""
    fields = [*ORDER, "dst_port", "packet_size"]
    rows = dealt.of_heavy(dealt.rows).select("src_ip", PART, *fields)
    newest = Window.partitionBy("src_ip", PART).orderBy(F.desc("ts_us"), F.desc("packet_id")).rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.withColumns({n: F.expr(cond) & (F.sum(F.expr(cond).cast("int")).over(newest) <= size) for n, (size, cond) in _TAILS.items()})
    row = F.struct(*fields)
    lists = kept.groupBy("src_ip", PART).agg(*[F.array_sort(F.collect_list(F.when(F.col(n), row))).alias(n) for n in _TAILS])
    # a list of ``size`` rows reaches back over ``size`` stretches that have rows of its kind at most
    order = Window.partitionBy("src_ip").orderBy(PART)
    lists = lists.withColumns({f"{n}_at": F.sum((F.size(n) > 0).cast("int")).over(order) for n in _TAILS})
    for name, (size, _) in _TAILS.items():
        reach = Window.partitionBy("src_ip").orderBy(f"{name}_at").rangeBetween(-size, 0)
        near = F.collect_list(F.when(F.size(name) > 0, F.struct(F.col(PART).alias("part"), F.col(name).alias("rows")))).over(reach)
        before = F.flatten(F.transform(F.filter(near, lambda x: x["part"] < F.col(PART)), lambda x: x["rows"]))
        lists = lists.withColumn(f"{name}_before", F.slice(F.reverse(F.array_sort(before)), 1, size))
    tails = lists.select("src_ip", PART, F.inline(F.concat(*[f"{n}_before" for n in _TAILS])))
    ports = rows.groupBy("src_ip", "dst_port", PART).agg(F.max(row).alias("row"))
    met = ports.select("src_ip", PART, F.lag("row").over(Window.partitionBy("src_ip", "dst_port").orderBy(PART)).alias("row"))
    return dealt.kept(tails.unionByName(met.filter("row IS NOT NULL").select("src_ip", PART, "row.*")).distinct(), "halo")


def _sessions(dealt: Dealt, halo: DataFrame | None, ts: str, tie: str, idle_seconds: int) -> DataFrame:
    """The dealt rows with ``sess`` and ``_iv_us``, the time since the session's packet before.

    Rows of ``halo`` are taken along, flagged ``_halo``; those of another session than the one that their
    stretch begins in get the session -1. Without a halo only the packet before a stretch is carried.
    """
    key = dealt.key
    order = Window.partitionBy(key, PART).orderBy(ts, tie)
    rows, gap = dealt.rows.withColumn("_halo", F.lit(False)), F.col(ts) - F.lag(ts).over(order)
    if halo is None:
        last = dealt.carry(dealt.rows, [key], {"_last": (F.max, F.col(ts))})
        rows, gap = with_carry(rows, last, [key]), F.coalesce(gap, F.col(ts) - F.col("_last"))
    else:
        rows = rows.unionByName(halo.withColumn("_halo", F.lit(True)), allowMissingColumns=True)
    rows = rows.withColumn("_gap", gap)
    new = F.when(~F.col("_halo") & (F.col("_gap") > idle_seconds * US), 1).otherwise(0)
    begin = F.when(~F.col("_halo") & F.coalesce(F.col("_gap") > idle_seconds * US, F.lit(True)), F.col(ts))
    before = dealt.carry(rows, [key], {"_sess": (F.sum, new), "_begin": (F.max, begin)})
    df = with_carry(rows, before, [key])
    sess = F.coalesce("_sess", F.lit(0)) + F.sum(new).over(order.rowsBetween(Window.unboundedPreceding, 0))
    sess = F.when(~F.col("_halo") | (F.col(ts) >= F.col("_begin")), sess).otherwise(-1)
    return df.withColumns({"sess": sess.cast("bigint"), "_iv_us": F.when(F.col("_gap") <= idle_seconds * US, F.col("_gap"))}).drop(
        "_gap", "_sess", "_begin", "_last")


def sessionize(packets: DataFrame, key: str = "src_ip", ts: str = "ts_us", tie: str = "packet_id",
               idle_seconds: int = C.FLOW_IDLE_SECONDS, parts: int | None = None) -> DataFrame:
    """``sess`` = number of > ``idle_seconds`` gaps before this packet for the key."""
    return _sessions(deal(packets, key, ts, parts), None, ts, tie, idle_seconds).drop(PART, "_iv_us", "_halo")


def flow_state(packets: DataFrame, parts: int | None = None) -> DataFrame:
    """Running per-packet flow state.

    Adds sess, n, unique_ports, start_us, dur_s, rate, log_rate, risk10, the flag totals, byte totals,
    interval statistics and the size-anomaly flag. Windows run over (src_ip, stretch, session); see
    ``stretches`` for what they get from the stretches before (``parts``: stretches of all rows).
    """
    return dealt_flow_state(deal(packets, "src_ip", "ts_us", parts)).rows.drop(PART)


def dealt_flow_state(dealt: Dealt) -> Dealt:
    """``flow_state`` of dealt packets, dealt the same way."""
    keys, own = ["src_ip", "sess"], ~F.col("_halo")
    df = _sessions(dealt, _halo(dealt), *ORDER, C.FLOW_IDLE_SECONDS)
    flags = decode_flags("tcp_flags")
    first_port = Window.partitionBy("src_ip", PART, "sess", "dst_port").orderBy(*ORDER)
    df = df.select("*", *[c.alias(n) for n, c in flags.items()], (own & (F.row_number().over(first_port) == 1)).cast("int").alias("_port_first"))
    counts = {"n": F.lit(1), "bytes": F.col("packet_size"), "unique_ports": F.col("_port_first"), **{f"{n}_count": F.col(f"is_{n}") for n in C.TCP_FLAG_BITS}}
    carry = dealt.carry(df.filter(own), keys, {f"_c_{n}": (F.sum, c) for n, c in counts.items()} | {"_c_start": (F.min, F.col("ts_us"))})
    columns = [c for c in df.columns if c not in ("_halo", "_port_first")]
    df = with_carry(df, carry, keys)
    w = Window.partitionBy("src_ip", PART, "sess").orderBy(*ORDER)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    so_far = {n: (F.sum(F.when(own, c)).over(run) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).cast("bigint") for n, c in counts.items()}
    df = df.withColumns(so_far | {"start_us": F.coalesce("_c_start", F.min(F.when(own, F.col("ts_us"))).over(run))})
    iv = w.rowsBetween(-(C.MAX_TIMESTAMPS_PER_FLOW - 2), 0)
    # Sizes > 0 only, last 50 including the current one
    sized = Window.partitionBy("src_ip", PART, "sess", F.col("packet_size") > 0).orderBy(*ORDER).rowsBetween(-(C.SIZE_WINDOW - 1), 0)
    df = df.withColumns({
        "_iv_sum": F.sum("_iv_us").over(iv), "_iv_cnt": F.count("_iv_us").over(iv), "_iv_sd": F.stddev_pop("_iv_us").over(iv),
        "_sz_cnt": F.count("packet_size").over(sized), "_sz_avg": F.avg("packet_size").over(sized),
    }).filter(own)
    dur_us = F.col("ts_us") - F.col("start_us")
    dur = dur_us / F.lit(float(US))
    size_anom = F.coalesce((F.col("packet_size") > 0) & (F.col("_sz_cnt") >= C.SIZE_MIN_SAMPLES) &
                           (F.col("packet_size") > F.col("_sz_avg") * 3) & (F.col("packet_size") > 1000), F.lit(False))
    u_rate = F.when(dur_us > 1000, F.col("n") / dur).otherwise(F.col("n") * 1000.0)
    df = df.select(
        *columns, "n", "unique_ports", "start_us", "bytes", *[f"{n}_count" for n in C.TCP_FLAG_BITS],
        dur.alias("dur_s"),
        F.when(dur_us > 0, F.col("n") / dur).otherwise(F.col("n").cast("double")).alias("rate"),
        F.round(F.when(dur_us > 0, F.col("n") / dur).otherwise(F.lit(1.0)), 2).alias("log_rate"),
        size_anom.alias("size_anomaly"),
        (u_rate > 150).cast("int").alias("_hr"), size_anom.cast("int").alias("_sz"), (F.col("unique_ports") > 10).cast("int").alias("_pt"),
        round4_seconds(dur_us).alias("duration"),
        F.when(F.col("n") < 2, 0.0).otherwise(round4_seconds("_iv_sum", "_iv_cnt")).alias("connection_interval"),
        F.when(F.col("n") < 3, 0.0).otherwise(F.round(F.col("_iv_sd") / US, 4)).alias("jitter"),
        F.when(dur_us > 0, F.round(F.col("bytes") / dur, 4)).otherwise(F.col("bytes").cast("double")).alias("byte_rate"),
    )
    inc = F.col("_hr") + F.col("_sz") * 2 + F.col("_pt") * 5
    risks = {"risk10": (F.sum, inc), "flag_high_rate": (F.max, F.col("_hr")), "flag_size": (F.max, F.col("_sz")), "flag_ports": (F.max, F.col("_pt"))}
    risk_carry = dealt.carry(df, keys, {f"_c_{n}": v for n, v in risks.items()})
    df = with_carry(df.withColumns({n: agg(c).over(run) for n, (agg, c) in risks.items()}), risk_carry, keys)
    combined = {n: both(agg, F.col(f"_c_{n}"), F.col(n)) for n, (agg, _) in risks.items()}
    df = df.withColumns({n: c.cast("bigint") if n == "risk10" else c == 1 for n, c in combined.items()})
    return replace(dealt, rows=df.drop("_iv_us", "_hr", "_sz", "_pt", *[f"_c_{n}" for n in risks]))


def flow_summary(packets: DataFrame) -> DataFrame:
    """A1-A3: one row per (src_ip, sess) with packets, distinct ports, times, flag and byte totals.

    Plain aggregate: partial aggregation happens map-side before the shuffle.
    """
    df = packets if "sess" in packets.columns else sessionize(packets)
    flags = decode_flags("tcp_flags")
    agg = df.groupBy("src_ip", "sess").agg(
        F.count(F.lit(1)).alias("packets"),
        F.countDistinct("dst_port").alias("unique_ports"),
        F.min("ts_us").alias("start_us"),
        F.max("ts_us").alias("last_us"),
        F.sum("packet_size").cast("bigint").alias("bytes"),
        *[F.sum(c).cast("bigint").alias(f"{n[3:]}_count") for n, c in flags.items()],
    )
    dur_us = F.col("last_us") - F.col("start_us")
    dur = dur_us / F.lit(float(US))
    return agg.select(
        "*",
        round4_seconds(dur_us).alias("duration"),
        F.round(F.when(dur_us > 0, F.col("packets") / dur).otherwise(F.col("packets").cast("double")), 4).alias("rate"),
        F.when(dur_us > 0, F.round(F.col("bytes") / dur, 4)).otherwise(F.col("bytes").cast("double")).alias("byte_rate"),
    )


def extract_features(packets: DataFrame, payload_col: str = "payload") -> DataFrame:
    """The 10 model features plus 13 extra features for every packet."""
    st = flow_state(packets)
    hour = F.hour("wall_ts")
    payload_len = F.coalesce(F.octet_length(payload_col), F.lit(0)).cast("bigint")
    return st.select(
        "packet_id", "src_ip", "sess", "ts_us", "wall_ts", "dst_port",
        F.col("n").alias("Connection_Count"),
        F.col("duration").alias("Duration"),
        F.round("rate", 4).alias("Rate"),
        F.col("unique_ports").alias("Unique_Ports"),
        (F.col("unique_ports") > C.UNIQUE_PORT_THRESHOLD).cast("int").alias("Is_Port_Scan"),
        ((hour >= C.NIGHT_START_HOUR) | (hour <= C.NIGHT_END_HOUR)).cast("int").alias("Is_Night"),
        byte_entropy(payload_col).alias("Payload_Entropy"),
        F.col("packet_size").alias("Packet_Size"),
        F.col("connection_interval").alias("Connection_Interval"),
        F.col("syn_count").alias("SYN_Count"),
        F.col("ack_count").alias("ACK_Count"),
        F.col("fin_count").alias("FIN_Count"),
        F.col("rst_count").alias("RST_Count"),
        F.col("psh_count").alias("PSH_Count"),
        F.col("urg_count").alias("URG_Count"),
        F.col("ttl").alias("TTL_Value"),
        F.col("window_size").alias("Window_Size"),
        payload_len.alias("Payload_Size"),
        payload_len.alias("Payload_Length"),
        hour.alias("Hour"),
        F.round("rate", 4).alias("Packets_Per_Second"),
        F.col("jitter").alias("Jitter"),
        F.col("byte_rate").alias("Byte_Rate"),
        # running state the verdict cascade needs
        "risk10", "log_rate", "flag_high_rate", "flag_size", "flag_ports", "start_us",
    )
