"""Sources (S1, S6, S7) and model invariants (M1, M4/M5)."""

import json

from pyspark.sql import functions as F

from conftest import SF001
from spark_netwatch.operators import dpi, intel
from spark_netwatch.sources import logs


def test_read_event_log_skips_long_rows(spark, tmp_path):
    p = tmp_path / "log.csv"
    p.write_text("a,b,c\n1,2,3\n4,5\n6,7,8,9\n")
    rows = logs.read_event_log(spark, str(p), ["a", "b", "c"]).collect()
    assert [(r.a, r.b, r.c) for r in rows] == [("1", "2", "3"), ("4", "5", None)]


def test_ioc_feed(spark):
    lines = spark.createDataFrame([(" 1.2.3.4 ",), ("# c",), ("",), ("1.2.3.4",), ("5.6.7.8",)], "value string")
    assert sorted(r.ip for r in intel.read_ioc_feed(lines).collect()) == ["1.2.3.4", "5.6.7.8"]


def test_custom_signatures_union(spark, tmp_path):
    p = tmp_path / "sigs.json"
    p.write_text(json.dumps([{"id": "C-1", "name": "Custom Foo", "regex": "foo[0-9]+", "severity": "Low"}]))
    sigs = dpi.load_signatures(spark, str(p))
    assert sigs.count() == 11
    c = sigs.filter("id = 'C-1'").first()
    assert (c.confidence, c.cwe, c.pattern, c.sig_order) == (100.0, "Custom", "foo[0-9]+", 10)
    df = spark.createDataFrame([("x foo42",)], "t string")
    assert dpi.dpi_scan(df, "t", sigs=sigs).first().dpi_rule_id == "C-1"


def test_isolation_forest_invariants(spark):
    from spark_netwatch.operators import isoforest
    rows = [(i, float(i % 7), float((i * 13) % 11), 1.0 if i % 50 == 0 else 0.0) for i in range(1200)]
    df = spark.createDataFrame(rows, "rid long, Connection_Count double, Duration double, Rate double")
    m1 = isoforest.train_isolation(df, "rid", n_trees=20, psi=128)
    m2 = isoforest.train_isolation(df, "rid", n_trees=20, psi=128)
    assert m1.offset == m2.offset
    scored = isoforest.score_isolation(m1, df)
    frac = scored.filter("_iso_anom").count() / 1200
    assert 0.02 <= frac <= 0.08
    assert scored.agg(F.max("_iso_conf")).first()[0] <= 100.0


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() >= 0
    assert "is_threat" in df.columns
