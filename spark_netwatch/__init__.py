"""spark_netwatch: network-security event analytics as Spark DataFrame jobs."""

__version__ = "0.1.0"
