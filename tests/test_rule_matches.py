"""All matching rules from one inspected text a row."""

from __future__ import annotations

from spark_netwatch.operators import dpi


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_page_is_inspected_once_for_all_rules(spark):
    pages = spark.createDataFrame([(1, "<script>../"), (2, "plain"), (3, None), (4, "eval(x) <SCRIPT>"), (5, "")], "page_id int, html string")
    hits = dpi.all_hits(pages, "html")
    assert {r["rule_id"]: r["hits"] for r in hits.collect()} == {"DPI-003": 2, "DPI-004": 1, "DPI-005": 1}
    assert plan(hits).count("union\\s+select") == 1
    rows = {r["page_id"]: r["matched_rules"] for r in dpi.all_matches(pages, "html").collect()}
    assert rows == {1: ["DPI-003", "DPI-005"], 2: [], 3: [], 4: ["DPI-003", "DPI-004"], 5: []}
