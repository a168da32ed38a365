"""S11 packet source and S13 evidence table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import payload_pool, view


def read_packets(packets: DataFrame) -> DataFrame:
    """Keep rows carrying both the IP and TCP layers."""
    return packets.filter((F.col("protocol") == "TCP") & F.col("src_ip").isNotNull())


def packets_with_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter packets joined with their payload bytes.

    The payload pool is a fixed 31-row table, so the broadcast is bounded.
    """
    pk = read_packets(view(spark, sf_dir, "net_packets"))
    pool = F.broadcast(payload_pool(spark).select("payload_id", "payload_text", "payload"))
    # the given tables have one row group each: deal the packets out before payloads are attached, so that
    # what reads payloads runs on all cores and no payload is shuffled
    pk = pk.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "packet_id")
    return pk.join(pool, "payload_id", "left")


def evidence(packets: DataFrame, verdicts: DataFrame, out_path: str | None = None) -> DataFrame:
    """Raw payloads of threat packets, partitioned by date when written."""
    ev = (packets.select("packet_id", "wall_ts", "src_ip", "dst_port", "payload")
          .join(verdicts.filter("is_threat").select("packet_id", "method", "rule_id"), "packet_id")
          .withColumn("date", F.to_date("wall_ts")))
    if out_path:
        ev.write.mode("append").partitionBy("date").parquet(out_path)
        return ev.sparkSession.read.schema(ev.schema).parquet(out_path)
    return ev
