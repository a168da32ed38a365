"""The trailing block rate without a sliding frame."""

from __future__ import annotations

from spark_netwatch.operators import respond

S = 1_000_000


def test_trailing_rate_counts_each_window(spark):
    times = [0, 0, 10 * S, 60 * S, 60 * S + 1, 70 * S, 130 * S, 130 * S + 1, None, None]
    blocks = spark.createDataFrame([(f"e{i}", "10.0.0.1", t) for i, t in enumerate(times)], "event_id string, ip string, from_us bigint")
    out = respond.trailing_block_rate(blocks, limit=3, parts=3)
    got = {r["event_id"]: (r["recent_blocks"], r["over_limit"]) for r in out.collect()}
    want = {f"e{i}": sum(1 for u in times if (u is None) == (t is None) and (t is None or t - 60 * S <= u <= t)) for i, t in enumerate(times)}
    assert got == {k: (n, n > 3) for k, n in want.items()}
    assert "RangeFrame, -" not in out._jdf.queryExecution().optimizedPlan().toString()
