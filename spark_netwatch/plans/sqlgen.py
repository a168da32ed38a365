"""DuckDB SQL fragments for oracle twins, generated from the same constants
the Spark operators use (classifier keywords, signatures, MITRE map)."""

from __future__ import annotations

from .. import constants as C


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_contains(low: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({low}, {q(w)})" for w in words) + ")"


MITRE_VALUES = "(VALUES " + ", ".join(
    "({}, {}, {}, {}, {})".format(q(t), "NULL" if tid is None else q(tid), "NULL" if tn is None else q(tn),
                                  "NULL" if ta is None else q(ta), repr(float(sev)))
    for t, tid, tn, ta, sev in C.MITRE_MAP) + ") AS m(threat_type, technique_id, technique_name, tactic, mitre_severity)"


def classify_sql(src: str, text_expr: str, keep: str = "*") -> str:
    """Subquery over ``src`` adding the D3 columns for ``text_expr``."""
    low = f"lower({text_expr})"
    flags = f"""SELECT {keep}, {any_contains(low, C.NEGATIVE_KEYWORDS)} AS _neg, {any_contains(low, C.RECON_KEYWORDS)} AS _recon,
  {any_contains(low, C.PAYLOAD_KEYWORDS)} AS _payload, {any_contains(low, C.CMD_KEYWORDS)} AS _cmd,
  {any_contains(low, C.WEB_KEYWORDS)} AS _web, {any_contains(low, C.ANOMALY_KEYWORDS)} AS _anom FROM {src}"""
    e = C.EXPLANATIONS
    other = q(e["other"]).replace("{label}", "' || (CASE WHEN _neg THEN 'NEGATIVE' ELSE 'POSITIVE' END) || '")
    typed = f"""SELECT *, (_neg OR _kw) AS is_threat,
  CASE WHEN NOT (_neg OR _kw) THEN 'Normal Traffic' WHEN _cmd THEN 'Remote Code Execution Attempt'
       WHEN _web THEN 'Web Application Attack' WHEN _payload THEN 'Malicious Payload Delivery'
       WHEN _recon THEN 'Stealth Reconnaissance' WHEN _anom THEN 'High-Frequency Anomalous Traffic'
       ELSE 'Anomalous AI-Detected Threat' END AS threat_type,
  CASE WHEN _neg AND NOT _kw THEN 'GenAI Threat Intel' ELSE 'Heuristic Check' END AS method,
  CASE WHEN _kw AND (CASE WHEN _neg THEN 95.0 ELSE 85.0 END) < 90 THEN 92.0 + ((CASE WHEN _neg THEN 95.0 ELSE 85.0 END) % 7)
       ELSE (CASE WHEN _neg THEN 95.0 ELSE 85.0 END) END AS confidence,
  CASE WHEN NOT (_neg OR _kw) THEN {q(e['normal'])} WHEN _cmd THEN {q(e['cmd'])} WHEN _web THEN {q(e['web'])}
       WHEN _recon THEN {q(e['recon'])} WHEN _payload THEN {q(e['payload'])} WHEN _anom THEN {q(e['anomaly'])}
       ELSE {other} END AS _explain,
  CASE WHEN _neg THEN 'NEGATIVE' ELSE 'POSITIVE' END AS raw_ai_label
FROM (SELECT *, (_recon OR _payload OR _cmd OR _web OR _anom) AS _kw FROM ({flags}))"""
    return f"""SELECT c.* EXCLUDE (_neg, _recon, _payload, _cmd, _web, _anom, _kw, _explain),
  _explain || CASE WHEN c.is_threat AND m.technique_id IS NOT NULL
                   THEN ' [MITRE ATT&CK: ' || m.technique_id || ' - ' || m.technique_name || ']' ELSE '' END AS explanation,
  m.mitre_severity AS severity, m.technique_id, m.technique_name, m.tactic
FROM ({typed}) c LEFT JOIN {MITRE_VALUES} ON c.threat_type = m.threat_type"""


def first_rule_case(text: str, value: str = "idx") -> str:
    """CASE expression: 0-based index of the first matching built-in signature."""
    parts = [f"WHEN regexp_matches({text}, {q(pat)}) THEN {i}" for i, (*_, pat) in enumerate(C.SIGNATURES)]
    return "CASE " + " ".join(parts) + " END"


SIG_VALUES = "(VALUES " + ", ".join(
    "({}, {}, {}, {}, {}, {}, {}, [{}])".format(i, q(sid), q(name), q(sev), repr(conf), q(cwe), q(tech),
                                                ", ".join(q(r) for r in refs))
    for i, (sid, name, sev, conf, cwe, tech, refs, _p) in enumerate(C.SIGNATURES)
) + ") AS sig(sig_order, id, name, severity, confidence, cwe, mitre_technique, refs)"


def white_trim(text: str) -> str:
    """DuckDB: ``text`` without white space at its ends."""
    from ..functions.text import WHITE_SPACE
    return f"trim({text}, {' || '.join(f'chr({ord(c)})' for c in WHITE_SPACE)})"


def dpi_sql(src: str, text_expr: str, key: str, compat: bool = False) -> str:
    """Subquery over ``src`` giving ``key`` plus the D2 ``dpi_*`` columns (text input)."""
    base = f"""SELECT {key}, {text_expr} AS _t0, {white_trim(text_expr)} AS _tt FROM {src}"""
    unwrap = f"""SELECT *, CASE WHEN _ok THEN _dec ELSE _t0 END AS dpi_text, COALESCE(_ok, false) AS _b64 FROM (
  SELECT *, (_cand AND _dec IS NOT NULL AND regexp_matches(_dec, '\\p{{L}}')) AS _ok FROM (
    SELECT *, (length(_tt) >= 16 AND regexp_matches(_tt, '^[A-Za-z0-9+/]+={{0,2}}$') AND length(_tt) % 4 = 0) AS _cand,
      CASE WHEN length(_tt) >= 16 AND regexp_matches(_tt, '^[A-Za-z0-9+/]+={{0,2}}$') AND length(_tt) % 4 = 0
           THEN try(decode(from_base64(_tt))) END AS _dec FROM ({base})))"""
    ai_text = "dpi_text"
    if compat:
        ai_text = f"'Payload content detected: ' || {ai_text}"
    matched = f"SELECT *, {first_rule_case('dpi_text')} AS _idx FROM ({unwrap})"
    cls = classify_sql(f"({matched})", ai_text)
    suffix = "CASE WHEN _b64 THEN ' (Base64 Encoded)' ELSE '' END"
    return f"""SELECT {key}, (_hit OR _ai) AS dpi_is_threat,
  CASE WHEN _hit THEN 'DPI matched signature for ' || sig.name || {suffix}
       WHEN _ai THEN 'GenAI identified malicious payload intent' || {suffix} END AS dpi_reason,
  CASE WHEN _hit OR _ai THEN substr(dpi_text, 1, 50) END AS dpi_snippet,
  CASE WHEN _hit THEN sig.severity WHEN _ai THEN 'High' END AS dpi_severity,
  CASE WHEN _hit THEN sig.confidence WHEN _ai THEN x.confidence END AS dpi_confidence,
  CASE WHEN _hit OR _ai THEN _b64 END AS dpi_base64,
  CASE WHEN _hit THEN sig.id WHEN _ai THEN 'DPI-AI' END AS dpi_rule_id,
  CASE WHEN _hit THEN sig.cwe WHEN _ai THEN 'N/A' END AS dpi_cwe,
  CASE WHEN _hit THEN sig.mitre_technique WHEN _ai THEN COALESCE(x.technique_id, 'T1595') END AS dpi_technique
FROM (SELECT *, _idx IS NOT NULL AS _hit, (_idx IS NULL AND length(dpi_text) > 10 AND is_threat) AS _ai FROM ({cls})) x
LEFT JOIN {SIG_VALUES} ON x._idx = sig.sig_order"""


def ip_long_sql(col: str) -> str:
    """DuckDB twin of ``functions.net.ip_long``."""
    parts = " + ".join(f"TRY_CAST(split_part({col}, '.', {i + 1}) AS BIGINT) * {256 ** (3 - i)}" for i in range(4))
    return f"(CASE WHEN regexp_matches({col}, {q(C.IPV4_PATTERN)}) THEN {parts} END)"


def _ipv(text: str) -> int:
    a, b, c, d = (int(x) for x in text.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def is_private_sql(col: str) -> str:
    v = ip_long_sql(col)
    ranges = " OR ".join(f"{v} BETWEEN {_ipv(lo)} AND {_ipv(hi)}" for lo, hi in C.PRIVATE_RANGES)
    return f"(CASE WHEN {v} IS NULL THEN true ELSE ({ranges}) END)"


def subnet24_sql(col: str) -> str:
    return f"(CASE WHEN len(string_split({col}, '.')) = 4 THEN split_part({col}, '.', 1) || '.' || split_part({col}, '.', 2) || '.' || split_part({col}, '.', 3) || '.0/24' END)"


def greedy_sql(src: str, k: str, t: str, i: str, gap: int, p: str = "g") -> str:
    """CTEs ``{p}_acc(id)``: greedy acceptance per key (recursive walk over successor pointers).

    The enclosing query must start with ``WITH RECURSIVE``.
    """
    return f"""{p}_ev AS (SELECT {k} AS k, {t} AS t, {i} AS id FROM {src}),
{p}_nx AS (SELECT e.id, arg_min(n.id, (n.t, n.id)) AS nid FROM {p}_ev e JOIN {p}_ev n ON n.k = e.k AND n.t >= e.t + {gap} GROUP BY e.id),
{p}_heads AS (SELECT arg_min(id, (t, id)) AS id FROM {p}_ev GROUP BY k),
{p}_acc(id) AS (SELECT id FROM {p}_heads UNION ALL SELECT {p}_nx.nid FROM {p}_acc JOIN {p}_nx ON {p}_acc.id = {p}_nx.id)"""


# ------------------------------------------------------------------ cleaner twin
def _ws(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _nl(v: str) -> str:
    inner = _ws(f"COALESCE({v}, '')")
    return f"(lower({inner}) IN ({', '.join(q(x) for x in C.NULL_LIKE)}))"


def _sf(v: str) -> str:
    d = f"TRY_CAST(regexp_replace({_ws(v)}, '[%,]', '', 'g') AS DOUBLE)"
    return f"(CASE WHEN isfinite({d}) THEN {d} END)"


def _si(v: str) -> str:
    d = f"TRY_CAST(regexp_replace({_ws(v)}, ',', '', 'g') AS DOUBLE)"
    return f"(CASE WHEN isfinite({d}) AND abs({d}) < 9.2e18 THEN CAST(trunc({d}) AS BIGINT) END)"


_DUCK_FMT = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%d/%m/%Y %H:%M:%S", "%m/%d/%Y %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f"]


def clean_cell_sql(column: str, v: str, row_id: str, as_of: str) -> tuple[str, str, str]:
    """(value, missing, invalid) DuckDB expressions for one column, mirroring functions.cleaning."""
    from ..functions.cleaning import column_class
    kind = column_class(column)
    nl = _nl(v)
    if kind == "timestamp":
        parsed = "COALESCE(" + ", ".join(f"try_strptime({v}, {q(f)})" for f in _DUCK_FMT) + ")"
        norm = f"(CASE WHEN {nl} THEN '' WHEN {parsed} IS NOT NULL THEN strftime({parsed}, '%Y-%m-%d %H:%M:%S') ELSE {v} END)"
        inv = f"(CASE WHEN {norm} <> {v} THEN 1 ELSE 0 END)"
        if column in C.REQUIRED_FIELDS:
            fill = _nl(norm)
            return f"(CASE WHEN {fill} THEN {q(as_of)} ELSE {norm} END)", f"(CASE WHEN {fill} THEN 1 ELSE 0 END)", inv
        return norm, "0", inv
    if kind == "boolean":
        yes, no = ("True", "False") if column in C.TRUE_FALSE_COLUMNS else ("Yes", "No")
        norm = (f"(CASE WHEN lower({v}) IN ({', '.join(q(x) for x in C.TRUE_WORDS)}) THEN {q(yes)} "
                f"WHEN lower({v}) IN ({', '.join(q(x) for x in C.FALSE_WORDS)}) THEN {q(no)} ELSE {v} END)")
        return (f"(CASE WHEN {nl} THEN {q(no)} ELSE {norm} END)", f"(CASE WHEN {nl} THEN 1 ELSE 0 END)",
                f"(CASE WHEN NOT {nl} AND {norm} <> {v} THEN 1 ELSE 0 END)")
    if kind == "flag":
        iv = f"COALESCE({_si(v)}, -1)"
        bad = f"({iv} NOT IN (0, 1))"
        val = (f"(CASE WHEN {nl} THEN '0' WHEN {bad} AND lower({v}) IN ('yes', 'true', 'y') THEN '1' "
               f"WHEN {bad} THEN '0' ELSE CAST({iv} AS VARCHAR) END)")
        return val, f"(CASE WHEN {nl} THEN 1 ELSE 0 END)", \
            f"(CASE WHEN NOT {nl} AND ({bad} OR CAST({iv} AS VARCHAR) <> {v}) THEN 1 ELSE 0 END)"
    if kind == "ip":
        okip = f"regexp_matches({v}, {q(C.IPV4_PATTERN)})"
        if column == "Blocked_IP":
            return f"(CASE WHEN {nl} THEN '' ELSE {v} END)", "0", f"(CASE WHEN NOT {nl} AND NOT {okip} THEN 1 ELSE 0 END)"
        return (f"(CASE WHEN {nl} THEN '0.0.0.0' ELSE {v} END)", f"(CASE WHEN {nl} THEN 1 ELSE 0 END)",
                f"(CASE WHEN NOT {nl} AND NOT {okip} THEN 1 ELSE 0 END)")
    if kind == "port":
        iv = f"COALESCE({_si(v)}, -1)"
        val = f"(CASE WHEN {nl} THEN '0' WHEN {iv} > 65535 THEN '65535' WHEN {iv} < 0 THEN '0' ELSE CAST({iv} AS VARCHAR) END)"
        return val, f"(CASE WHEN {nl} THEN 1 ELSE 0 END)", \
            f"(CASE WHEN NOT {nl} AND ({iv} < 0 OR {iv} > 65535 OR CAST({iv} AS VARCHAR) <> {v}) THEN 1 ELSE 0 END)"
    if kind == "confidence":
        fv = f"COALESCE({_sf(v)}, -1.0)"
        val = f"(CASE WHEN {nl} THEN '0.0' WHEN {fv} < 0 THEN '0.0' ELSE CAST(round(least({fv}, 100.0), 2) AS VARCHAR) END)"
        return val, f"(CASE WHEN {nl} THEN 1 ELSE 0 END)", \
            f"(CASE WHEN NOT {nl} AND ({fv} < 0 OR {fv} > 100) THEN 1 ELSE 0 END)"
    if kind == "packet_count":
        iv = f"COALESCE({_si(v)}, -1)"
        val = f"(CASE WHEN {nl} THEN '0' WHEN {iv} < 0 THEN '0' ELSE CAST({iv} AS VARCHAR) END)"
        return val, f"(CASE WHEN {nl} THEN 1 ELSE 0 END)", \
            f"(CASE WHEN NOT {nl} AND ({iv} < 0 OR CAST({iv} AS VARCHAR) <> {v}) THEN 1 ELSE 0 END)"
    if kind == "numeric":
        fv = _sf(v)
        val = (f"(CASE WHEN {nl} THEN '0' WHEN {fv} IS NULL THEN '0' "
               f"WHEN {fv} = floor({fv}) AND NOT contains({v}, '.') THEN CAST(CAST({fv} AS BIGINT) AS VARCHAR) "
               f"ELSE CAST(round({fv}, 4) AS VARCHAR) END)")
        return val, f"(CASE WHEN {nl} THEN 1 ELSE 0 END)", f"(CASE WHEN NOT {nl} AND {fv} IS NULL THEN 1 ELSE 0 END)"
    if kind == "categorical":
        canon, default = C.CATEGORICAL_MAP[column]
        norm = "(CASE " + " ".join(f"WHEN lower({v}) = {q(c.lower())} THEN {q(c)}" for c in canon) + f" ELSE {v} END)"
        return (f"(CASE WHEN {nl} THEN {q(default)} ELSE {norm} END)", f"(CASE WHEN {nl} THEN 1 ELSE 0 END)",
                f"(CASE WHEN NOT {nl} AND {norm} <> {v} THEN 1 ELSE 0 END)")
    if kind == "required":
        if column == "Event_ID":
            return (f"(CASE WHEN {nl} THEN 'EVT-RECOVERED-' || CAST({row_id} AS VARCHAR) ELSE {v} END)",
                    f"(CASE WHEN {nl} THEN 1 ELSE 0 END)", "0")
        return v, f"(CASE WHEN {nl} THEN 1 ELSE 0 END)", "0"
    return v, "0", "0"


def clean_cells_sql(src: str, cols: list[str], row_id: str, as_of: str) -> str:
    """SELECT over ``src``: row id, cleaned columns, _missing, _invalid, _dirty."""
    ctrl = q(C.CONTROL_CHARS)
    vals = ", ".join(f"nfc_normalize(regexp_replace({_ws(f'COALESCE(CAST({c} AS VARCHAR), {q(str())})')}, {ctrl}, '', 'g')) AS _v_{c}"
                     for c in cols)
    origs = ", ".join(f"COALESCE(CAST({c} AS VARCHAR), '') AS _o_{c}" for c in cols)
    cells = {c: clean_cell_sql(c, f"_v_{c}", row_id, as_of) for c in cols}
    body = ", ".join(f"{cells[c][0]} AS {c}" for c in cols)
    miss = " + ".join(cells[c][1] for c in cols)
    inv = " + ".join(cells[c][2] for c in cols)
    dirty = " OR ".join(f"{cells[c][0]} <> _o_{c}" for c in cols)
    return (f"SELECT {row_id}, {body}, CAST({miss} AS INTEGER) AS _missing, CAST({inv} AS INTEGER) AS _invalid, ({dirty}) AS _dirty "
            f"FROM (SELECT {row_id}, {origs}, {vals} FROM {src})")
