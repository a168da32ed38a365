"""Event-log cleaning job (D10): per-cell rules (F1-F13), exact-duplicate
removal (U1), event-id uniqueness (W9) and run statistics (A21).

One ``select`` applies every column's rule; duplicates are removed with a
grouped aggregate (map-side partial aggregation); the cleaned rows are written
once, and id suffixes come from running counts per id over their ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import clean_cell, clean_string
from ..functions.text import nfc
from ..session import staged
from .stretches import deal, running


def clean_cells(raw: DataFrame, as_of: str, row_id: str = "row_id") -> DataFrame:
    """All rows cleaned, with per-row ``_missing``, ``_invalid`` counts and ``_dirty`` flag."""
    cols = [c for c in raw.columns if c != row_id]
    texts = raw.select(row_id, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_o_{c}") for c in cols],
                       *[nfc(clean_string(F.col(c).cast("string"))).alias(f"_v_{c}") for c in cols])
    cells = {c: clean_cell(c, F.col(f"_v_{c}"), F.col(row_id), as_of) for c in cols}
    missing = reduce(lambda a, b: a + b, [cells[c].missing for c in cols])
    invalid = reduce(lambda a, b: a + b, [cells[c].invalid for c in cols])
    rows = texts.select(row_id, *[F.col(f"_o_{c}") for c in cols], *[cells[c].value.alias(c) for c in cols],
                        missing.alias("_missing"), invalid.alias("_invalid"))
    dirty = reduce(lambda a, b: a | b, [F.col(c) != F.col(f"_o_{c}") for c in cols])
    return rows.select(row_id, *cols, "_missing", "_invalid", dirty.alias("_dirty"))


def _suffix_ids(df: DataFrame, row_id: str, id_col: str = "Event_ID", parts: int | None = None) -> DataFrame:
    """2nd, 3rd ... occurrence of an id (in row order) gets ``_dup1``, ``_dup2`` ...,
    passing over numbers whose id stands in the log already.

    Counts per id run over the stretches of an id (``stretches``), so an id that a large share of the log
    repeats is spread over tasks; only (row, id) takes part, and only repeats get a new id.

    The numbers that stand in the log are rows (id, number). The i-th of an id,
    k, has k - i free numbers before it, so the suffixes from rank k - i + 1 on
    pass over it: a rank's number is the rank plus the count of these.
    """
    one = F.lit(1).cast("long")
    columns = df.columns
    # written once, as it is read three times below; row ids may repeat, so rows get a number
    df = staged(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    ids = df.select("_row", row_id, id_col)
    # cleaned ids are never empty (missing ids are recovered), so ids without a number make one
    # row of the empty id
    numbered = r"(?s)^(.*)_dup([1-9][0-9]{0,17})\z"
    taken = ids.select(F.regexp_extract(id_col, numbered, 1).alias(id_col),
                       F.expr(f"try_cast(regexp_extract({id_col}, r'{numbered}', 2) AS bigint)").alias("_k")).filter("_k IS NOT NULL").distinct()
    taken = running(deal(taken, id_col, "_k", parts), {"_i": (F.sum, one)}, ["_k"]).select(
        id_col, (F.col("_k") - F.col("_i") + 1).alias("_rank"), one.alias("_one"))
    repeats = running(deal(ids, id_col, row_id, parts), {"_rn": (F.sum, one)}, [row_id, "_row"]).filter("_rn > 1")
    repeats = staged(repeats.select("_row", id_col, (F.col("_rn") - 1).alias("_rank"), F.lit(0).cast("long").alias("_one")), "repeats")
    both = running(deal(repeats.unionByName(taken, allowMissingColumns=True), id_col, "_rank", parts), {"_past": (F.sum, F.col("_one"))}, ["_rank"], peers=True)
    suffixed = F.concat(F.col(id_col), F.lit("_dup"), (F.col("_rank") + F.col("_past")).cast("string"))
    new = both.filter("_row IS NOT NULL").select("_row", suffixed.alias("_new"))
    return (df.join(new, "_row", "left").withColumns({id_col: F.coalesce("_new", id_col), "_suffixed": F.col("_new").isNotNull()})
            .select(*columns, "_suffixed"))


def clean_event_log(raw: DataFrame, as_of: str, row_id: str = "row_id", compat: bool = False, parts: int | None = None) -> DataFrame:
    """Cleaned rows (text columns) plus ``_dirty`` and ``_suffixed``.

    Default: exact duplicates (same cleaned text in every column) are removed
    first, keeping the earliest row, then ids are made unique. ``compat=True``
    suffixes ids first, as the reference does (SURVEY Q6).
    """
    cols = [c for c in raw.columns if c != row_id]
    cells = clean_cells(raw, as_of, row_id)
    rows = cells if compat else _dedupe(cells, cols, row_id)
    rows = _suffix_ids(rows, row_id, parts=parts) if "Event_ID" in cols else rows.withColumn("_suffixed", F.lit(False))
    return _dedupe(rows, cols, row_id) if compat else rows


def _dedupe(df: DataFrame, cols: list[str], row_id: str) -> DataFrame:
    """One row per distinct cleaned content, the earliest by row id.

    The row id and the two row flags are packed into one long so the grouped
    ``min`` runs as a hash aggregate with map-side partial aggregation (row ids
    must be non-negative and below 2**61).
    """
    flags = [c for c in ("_dirty", "_suffixed") if c in df.columns]
    packed = F.col(row_id).cast("long") * 4
    for bit, f in enumerate(flags):
        packed = packed + F.col(f).cast("long") * (1 << bit)
    agg = df.groupBy(*cols).agg(F.min(packed).alias("_k"))
    return agg.select(F.shiftright("_k", 2).alias(row_id), *cols,
                      *[(F.col("_k").bitwiseAND(1 << bit) != 0).alias(f) for bit, f in enumerate(flags)])


def cleaning_stats(raw: DataFrame, as_of: str, row_id: str = "row_id", compat: bool = False) -> DataFrame:
    """Total, cleaned, duplicates removed, missing corrected, invalid corrected."""
    cells = clean_cells(raw, as_of, row_id)
    kept = clean_event_log(raw, as_of, row_id, compat)
    zero = F.lit(0).cast("bigint")
    rows = cells.select(F.lit(1).cast("bigint").alias("n"), F.col("_missing").cast("bigint").alias("m"),
                        F.col("_invalid").cast("bigint").alias("i"), zero.alias("k"), zero.alias("c"), zero.alias("s"))
    kept_rows = kept.select(zero.alias("n"), zero.alias("m"), zero.alias("i"), F.lit(1).cast("bigint").alias("k"),
                            (F.col("_dirty") | F.col("_suffixed")).cast("bigint").alias("c"),
                            F.col("_suffixed").cast("bigint").alias("s"))
    t = rows.unionByName(kept_rows).agg(*[F.sum(c).alias(c) for c in ["n", "m", "i", "k", "c", "s"]])
    return t.select(F.col("n").alias("total_rows"), F.col("c").alias("cleaned_rows"),
                    (F.col("n") - F.col("k")).alias("duplicate_rows_removed"),
                    F.col("m").alias("missing_values_corrected"), (F.col("i") + F.col("s")).alias("invalid_values_corrected"))
