"""Registered DPI and classifier jobs: D2, J8, J9, A27, F23, F24, P18, D3, J7."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from ..operators import classify, dpi
from ..session import spread
from ..sources.packets import packets_with_payload
from .registry import job, w
from .sqlgen import classify_sql, dpi_sql, first_rule_case, q, white_trim

TRIMMED = white_trim("payload_text")
DPI_COLS = ["dpi_is_threat", "dpi_reason", "dpi_snippet", "dpi_severity", "dpi_confidence", "dpi_base64",
            "dpi_rule_id", "dpi_cwe", "dpi_technique"]
PKT = w("net_packets", "payloads") + ", pk AS (SELECT packet_id, payload_text FROM net_packets JOIN payloads USING (payload_id))\n"


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@job("D2_dpi_packets", PKT + dpi_sql("pk", "payload_text", "packet_id"))
def d2_packets(spark, sf):
    return dpi.dpi_scan(packets_with_payload(spark, sf)).select("packet_id", *DPI_COLS)


@job("D2_dpi_packets_compat", PKT + dpi_sql("pk", "payload_text", "packet_id", compat=True))
def d2_packets_compat(spark, sf):
    return dpi.dpi_scan(packets_with_payload(spark, sf), compat=True).select("packet_id", *DPI_COLS)


@job("D2_dpi_pages", dpi_sql("pages", "html", "page_id"))
def d2_pages(spark, sf):
    return dpi.dpi_scan(_table(spark, sf, "pages"), "html").select("page_id", *DPI_COLS)


@job("D2_dpi_documents", dpi_sql("documents", "text", "doc_id"))
def d2_documents(spark, sf):
    return dpi.dpi_scan(_table(spark, sf, "documents"), "text").select("doc_id", *DPI_COLS)


@job("D2_dpi_conversations", dpi_sql("conversations", "text", "conv_id, turn"))
def d2_conversations(spark, sf):
    return dpi.dpi_scan(_table(spark, sf, "conversations"), "text").select("conv_id", "turn", *DPI_COLS)


@job("J8_first_match_packets", PKT + f"""SELECT packet_id, sig.id AS rule_id FROM
  (SELECT packet_id, {first_rule_case('t')} AS idx FROM (
    SELECT packet_id, CASE WHEN length({TRIMMED}) >= 16 AND regexp_matches({TRIMMED}, '^[A-Za-z0-9+/]+={{0,2}}$')
      AND length({TRIMMED}) % 4 = 0 AND regexp_matches(try(decode(from_base64({TRIMMED}))), '\\p{{L}}')
      THEN try(decode(from_base64({TRIMMED}))) ELSE payload_text END AS t FROM pk)) x
LEFT JOIN (SELECT * FROM (VALUES {", ".join(f"({i}, {q(s[0])})" for i, s in enumerate(C.SIGNATURES))}) AS v(sig_order, id)) sig
  ON x.idx = sig.sig_order""")
def j8_first_match(spark, sf):
    p = packets_with_payload(spark, sf)
    rules = dpi.compile_rules()
    text, _ = dpi.inspect_text(F.col("payload"))
    idx = dpi.first_match_index(text, rules)
    ids = F.array(*[F.lit(r["id"]) for r in rules])
    # guard the lookup: element_at on a literal array with a null index is not reliably null
    return p.select("packet_id", F.when(idx.isNotNull(), F.element_at(ids, idx + 1)).alias("rule_id"))


ALL_RULES = "(VALUES " + ", ".join(f"({q(sid)}, {q(pat)})" for sid, *_, pat in C.SIGNATURES) + ") AS r(rule_id, pattern)"


@job("J9_all_matches_pages", f"""SELECT r.rule_id, CAST(count(*) AS BIGINT) AS hits FROM pages
JOIN {ALL_RULES} ON regexp_matches(pages.html, r.pattern) GROUP BY r.rule_id""")
def j9_all_matches(spark, sf):
    return dpi.all_hits(spread(_table(spark, sf, "pages"), "page_id"), "html")


@job("J9_all_matches_packets", PKT + f"""SELECT r.rule_id, CAST(count(*) AS BIGINT) AS hits FROM pk
JOIN {ALL_RULES} ON regexp_matches(CASE WHEN length({TRIMMED}) >= 16 AND regexp_matches({TRIMMED}, '^[A-Za-z0-9+/]+={{0,2}}$')
      AND length({TRIMMED}) % 4 = 0 AND regexp_matches(try(decode(from_base64({TRIMMED}))), '\\p{{L}}')
      THEN try(decode(from_base64({TRIMMED}))) ELSE payload_text END, r.pattern) GROUP BY r.rule_id""")
def j9_all_packets(spark, sf):
    return dpi.all_hits(packets_with_payload(spark, sf), "payload")


@job("A27_rule_hit_counts", PKT + f"""SELECT dpi_rule_id AS rule_id, dpi_severity AS severity, dpi_cwe AS cwe,
  CAST(count(*) AS BIGINT) AS hits FROM ({dpi_sql("pk", "payload_text", "packet_id")}) WHERE dpi_is_threat GROUP BY 1, 2, 3""")
def a27_hits(spark, sf):
    return dpi.rule_hit_counts(dpi.dpi_scan(packets_with_payload(spark, sf)))


@job("F23_base64_unwrap", PKT + f"""SELECT packet_id, CASE WHEN ok THEN dec ELSE payload_text END AS text, COALESCE(ok, false) AS base64_detected
FROM (SELECT *, (length(tt) >= 16 AND regexp_matches(tt, '^[A-Za-z0-9+/]+={{0,2}}$') AND length(tt) % 4 = 0
        AND dec IS NOT NULL AND regexp_matches(dec, '\\p{{L}}')) AS ok
      FROM (SELECT *, {TRIMMED} AS tt, CASE WHEN length({TRIMMED}) >= 16 AND length({TRIMMED}) % 4 = 0
        AND regexp_matches({TRIMMED}, '^[A-Za-z0-9+/]+={{0,2}}$') THEN try(decode(from_base64({TRIMMED}))) END AS dec FROM pk))""")
def f23_unwrap(spark, sf):
    p = packets_with_payload(spark, sf)
    text, flag = dpi.inspect_text(F.col("payload"))
    return p.select("packet_id", text.alias("text"), flag.alias("base64_detected"))


@job("F24_decode_payload", PKT + """SELECT packet_id, payload_text AS text, CAST(length(payload_text) AS INTEGER) AS chars FROM pk""")
def f24_decode(spark, sf):
    from ..functions.text import decode_utf8_ignore
    p = packets_with_payload(spark, sf)
    t = decode_utf8_ignore(F.col("payload"))
    return p.select("packet_id", t.alias("text"), F.length(t).alias("chars"))


@job("P18_dpi_input_shaping", """SELECT page_id, substr(html, 1, 50) AS snippet, substr(html, 1, 100) AS ai_text,
  length(html) > 10 AS ai_eligible FROM pages""")
def p18_shaping(spark, sf):
    pages = _table(spark, sf, "pages")
    # the cut is this query's feature: what the text model is shown of a page
    text, _ = dpi.inspect_text(F.col("html"), is_binary=False)
    return pages.select("page_id", F.substring(text, 1, 50).alias("snippet"), F.substring(text, 1, 100).alias("ai_text"),
                        (F.length(text) > 10).alias("ai_eligible"))


CLS_COLS = ["is_threat", "threat_type", "method", "confidence", "explanation", "raw_ai_label", "severity",
            "technique_id", "technique_name", "tactic"]


@job("D3_classify_conversations", f"SELECT conv_id, turn, {', '.join(CLS_COLS)} FROM ({classify_sql('conversations', 'text', 'conv_id, turn')})")
def d3_conversations(spark, sf):
    return classify.classify_text(_table(spark, sf, "conversations"), "text").select("conv_id", "turn", *CLS_COLS)


@job("D3_classify_documents", f"SELECT doc_id, {', '.join(CLS_COLS)} FROM ({classify_sql('documents', 'text', 'doc_id')})")
def d3_documents(spark, sf):
    return classify.classify_text(_table(spark, sf, "documents"), "text").select("doc_id", *CLS_COLS)


@job("J7_mitre_lookup", PKT + f"""SELECT threat_type, technique_id, tactic, severity, CAST(count(*) AS BIGINT) AS packets
FROM ({classify_sql('pk', 'payload_text', 'packet_id')}) GROUP BY ALL""")
def j7_mitre(spark, sf):
    """Threat type of every packet payload text -> MITRE technique, tactic and severity."""
    p = packets_with_payload(spark, sf)
    c = classify.classify_text(p, "payload_text")
    return c.groupBy("threat_type", "technique_id", "tactic", "severity").agg(F.count(F.lit(1)).alias("packets"))
