"""Per-cell log-cleaning rules (F1-F13) as column expressions.

Every rule returns ``Cell(value, missing, invalid)``: the cleaned text and two
0/1 counters. Inputs are the raw text columns of the event log; ``val`` is the
cell after F2 (trim, control characters removed).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


@dataclass
class Cell:
    value: Column
    missing: Column
    invalid: Column


def _i(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


# whitespace stripped from both ends (the six ASCII whitespace characters) and the
# control characters the cleaner deletes, as plain character sets
_WS = " \t\n\r\x0b\x0c"
_CONTROL = "".join(chr(c) for c in [*range(0x00, 0x09), 0x0b, 0x0c, *range(0x0e, 0x20), *range(0x7f, 0xa0)])


def strip_ws(c: Column) -> Column:
    return F.trim(c, F.lit(_WS))


def clean_string(raw: Column) -> Column:
    """F2 (without NFC, applied per row elsewhere): trim whitespace, drop control characters.

    Built-in ``trim``/``translate`` instead of regular expressions: the same
    character sets, without a regex pass per cell.
    """
    return F.translate(strip_ws(F.coalesce(raw, F.lit(""))), _CONTROL, "")


def null_like(v: Column) -> Column:
    """F1."""
    return F.lower(strip_ws(F.coalesce(v, F.lit("")))).isin(C.NULL_LIKE)


def safe_float(v: Column) -> Column:
    """strip, drop ``%`` and ``,``, parse; null when unparsable or not finite."""
    d = F.translate(strip_ws(v), "%,", "").try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def safe_int(v: Column) -> Column:
    """int(float(text)) with ``,`` removed (``%`` kept); null when unparsable or not finite."""
    d = F.translate(strip_ws(v), ",", "").try_cast("double")
    ok = ~F.isnan(d) & (F.abs(d) < 9.2e18)
    return F.when(ok, d.cast("bigint"))


def parse_log_timestamp(val: Column) -> Column:
    """The five log formats, tried in order; only formats whose separators fit the
    text's shape are attempted (the parser is strict on literals, so the result
    equals trying all five, without a failed parse per miss)."""
    iso, iso_t, dmy, mdy, frac = [F.try_to_timestamp(val, F.lit(f)) for f in C.TIMESTAMP_FORMATS]
    sep10, sep2, sep19 = F.substring(val, 11, 1), F.substring(val, 3, 1), F.substring(val, 20, 1)
    return (F.when(sep2 == "/", F.coalesce(dmy, mdy))
            .when(sep10 == "T", iso_t)
            .when(sep19 == ".", frac)
            .when(sep10 == " ", iso))


def timestamp_cell(val: Column, required: bool, as_of_text: str) -> Cell:
    """five formats in order -> ``yyyy-MM-dd HH:mm:ss``; unparsable kept; required+missing -> as_of."""
    parsed = parse_log_timestamp(val)
    norm = F.when(null_like(val), F.lit("")).when(parsed.isNotNull(), F.date_format(parsed, "yyyy-MM-dd HH:mm:ss")).otherwise(val)
    invalid = _i(norm != val)
    if required:
        fill = null_like(norm)
        return Cell(F.when(fill, F.lit(as_of_text)).otherwise(norm), _i(fill), invalid)
    return Cell(norm, F.lit(0), invalid)


def boolean_cell(val: Column, true_false: bool) -> Cell:
    """Yes/No (or True/False) style; missing -> No/False; other text kept."""
    yes, no = ("True", "False") if true_false else ("Yes", "No")
    low = F.lower(val)
    miss = null_like(val)
    norm = F.when(low.isin(C.TRUE_WORDS), F.lit(yes)).when(low.isin(C.FALSE_WORDS), F.lit(no)).otherwise(val)
    return Cell(F.when(miss, F.lit(no)).otherwise(norm), _i(miss), _i(~miss & (norm != val)))


def flag_cell(val: Column) -> Cell:
    """0/1; missing -> 0; other numbers -> 0 unless the text is yes/true/y."""
    miss = null_like(val)
    iv = F.coalesce(safe_int(val), F.lit(-1))
    bad = ~iv.isin(0, 1)
    out = F.when(miss, "0").when(bad & F.lower(val).isin("yes", "true", "y"), "1").when(bad, "0").otherwise(iv.cast("string"))
    inv = ~miss & (bad | (iv.cast("string") != val))
    return Cell(out, _i(miss), _i(inv))


def ip_cell(val: Column, column: str) -> Cell:
    """strict dotted quad; missing -> 0.0.0.0 (Blocked_IP -> ''); invalid kept and counted."""
    miss = null_like(val)
    if column == "Blocked_IP":
        return Cell(F.when(miss, F.lit("")).otherwise(val), F.lit(0), _i(~miss & ~val.rlike(C.IPV4_PATTERN)))
    return Cell(F.when(miss, F.lit("0.0.0.0")).otherwise(val), _i(miss), _i(~miss & ~val.rlike(C.IPV4_PATTERN)))


def port_cell(val: Column) -> Cell:
    """F8: missing / negative / unparsable -> 0, above 65535 -> 65535."""
    miss = null_like(val)
    iv = F.coalesce(safe_int(val), F.lit(-1))
    out_of = (iv < 0) | (iv > 65535)
    out = F.when(miss, "0").when(iv > 65535, "65535").when(iv < 0, "0").otherwise(iv.cast("string"))
    inv = ~miss & (out_of | (iv.cast("string") != val))
    return Cell(out, _i(miss), _i(inv))


def confidence_cell(val: Column) -> Cell:
    """clamp to 0-100, 2 decimals, float text; missing -> 0.0."""
    miss = null_like(val)
    fv = F.coalesce(safe_float(val), F.lit(-1.0))
    out = F.when(miss, "0.0").when(fv < 0, "0.0").otherwise(F.round(F.least(fv, F.lit(100.0)), 2).cast("string"))
    return Cell(out, _i(miss), _i(~miss & ((fv < 0) | (fv > 100))))


def packet_count_cell(val: Column) -> Cell:
    """non-negative integer, else 0."""
    miss = null_like(val)
    iv = F.coalesce(safe_int(val), F.lit(-1))
    out = F.when(miss, "0").when(iv < 0, "0").otherwise(iv.cast("string"))
    return Cell(out, _i(miss), _i(~miss & ((iv < 0) | (iv.cast("string") != val))))


def numeric_cell(val: Column) -> Cell:
    """missing/unparsable -> 0; integral text without a point stays integer; else 4 decimals."""
    miss = null_like(val)
    fv = safe_float(val)
    integral = (fv == F.floor(fv)) & ~val.contains(".")
    out = (F.when(miss, "0").when(fv.isNull(), "0")
           .when(integral, fv.cast("bigint").cast("string")).otherwise(F.round(fv, 4).cast("string")))
    return Cell(out, _i(miss), _i(~miss & fv.isNull()))


def categorical_cell(val: Column, column: str) -> Cell:
    """case-insensitive match to the canonical value; per-column default when missing."""
    canon, default = C.CATEGORICAL_MAP[column]
    miss = null_like(val)
    low = F.lower(val)
    mapped = None
    for c in canon:
        mapped = F.when(low == c.lower(), F.lit(c)) if mapped is None else mapped.when(low == c.lower(), F.lit(c))
    norm = mapped.otherwise(val)
    return Cell(F.when(miss, F.lit(default)).otherwise(norm), _i(miss), _i(~miss & (norm != val)))


def required_cell(val: Column, column: str, row_id: Column) -> Cell:
    """a missing Event_ID becomes ``EVT-RECOVERED-<row id>``; other required text kept."""
    miss = null_like(val)
    if column == "Event_ID":
        return Cell(F.when(miss, F.concat(F.lit("EVT-RECOVERED-"), row_id.cast("string"))).otherwise(val), _i(miss), F.lit(0))
    return Cell(val, _i(miss), F.lit(0))


def column_class(column: str) -> str:
    """Cleaner precedence: timestamp, boolean, flag, ip, port, confidence, packet count, numeric,
    categorical, required, generic."""
    for name, members in (("timestamp", C.TIMESTAMP_COLUMNS), ("boolean", C.BOOLEAN_COLUMNS),
                          ("flag", C.FLAG_COLUMNS), ("ip", C.IP_COLUMNS), ("port", C.PORT_COLUMNS),
                          ("confidence", C.CONFIDENCE_COLUMNS), ("packet_count", C.PACKET_COUNT_COLUMNS),
                          ("numeric", C.NUMERIC_COLUMNS), ("categorical", list(C.CATEGORICAL_MAP)),
                          ("required", C.REQUIRED_FIELDS)):
        if column in members:
            return name
    return "generic"


def clean_cell(column: str, val: Column, row_id: Column, as_of_text: str) -> Cell:
    kind = column_class(column)
    if kind == "timestamp":
        return timestamp_cell(val, column in C.REQUIRED_FIELDS, as_of_text)
    if kind == "boolean":
        return boolean_cell(val, column in C.TRUE_FALSE_COLUMNS)
    if kind == "flag":
        return flag_cell(val)
    if kind == "ip":
        return ip_cell(val, column)
    if kind == "port":
        return port_cell(val)
    if kind == "confidence":
        return confidence_cell(val)
    if kind == "packet_count":
        return packet_count_cell(val)
    if kind == "numeric":
        return numeric_cell(val)
    if kind == "categorical":
        return categorical_cell(val, column)
    if kind == "required":
        return required_cell(val, column, row_id)
    return Cell(val, F.lit(0), F.lit(0))
