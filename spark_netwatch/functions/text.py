"""Text and byte functions (A6 entropy, F2 NFC, F23 base64 unwrap, F24 decode, F14 units).

Everything except entropy is a built-in expression; entropy has no built-in
and runs as an Arrow-batched pandas UDF (a per-row helper inside tasks).
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C


#: Characters that count as white space at either end of a text.
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
               "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.DoubleType())
def _byte_entropy(data: pd.Series) -> pd.Series:
    values = [b if b is not None else b"" for b in data]
    size = np.fromiter(map(len, values), np.int64, len(values))
    row = np.repeat(np.arange(len(values)), size)
    counts = np.bincount(row * 256 + np.frombuffer(b"".join(values), np.uint8), minlength=256 * len(values)).reshape(-1, 256)
    p = counts / np.maximum(size, 1)[:, None]
    return pd.Series(-np.where(counts > 0, p * np.log2(np.where(counts > 0, p, 1.0)), 0.0).sum(1) + 0.0)


def byte_entropy(data) -> Column:
    """Shannon entropy (bits) of a binary column, 4 decimals; empty or null -> 0."""
    return F.round(_byte_entropy(_col(data)), 4)


def text_entropy(text) -> Column:
    """A6 over the UTF-8 bytes of a string column."""
    return byte_entropy(F.encode(_col(text), "UTF-8"))


def nfc(text) -> Column:
    """F2 NFC step, JVM-side: ICU's composer (shipped with Spark) through ``reflect``.

    Only values holding non-ASCII characters are normalised; ASCII text is
    already in NFC.
    """
    c = _col(text)
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))
    non_ascii = F.octet_length(c) != F.length(c)      # UTF-8 bytes differ from characters
    return F.when(non_ascii, composed).otherwise(c)


def decode_utf8_ignore(data) -> Column:
    """bytes -> text as UTF-8, dropping undecodable bytes."""
    return F.regexp_replace(F.make_valid_utf8(_col(data).cast("string")), "�", "")


def base64_unwrap(text) -> tuple[Column, Column]:
    """(text after unwrap, unwrapped flag).

    Trimmed text of >= 16 base64 characters that decodes strictly and holds a
    letter is replaced by its decoded text.
    """
    t = F.regexp_replace(_col(text), f"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+$", "")
    candidate = (F.length(t) >= 16) & t.rlike(r"^[A-Za-z0-9+/]+={0,2}$") & (F.length(t) % 4 == 0)
    decoded = decode_utf8_ignore(F.try_to_binary(t, F.lit("base64")))
    ok = candidate & decoded.isNotNull() & decoded.rlike(r"\p{L}")
    return F.when(ok, decoded).otherwise(_col(text)), F.coalesce(ok, F.lit(False))


def strip_units(text, units: list[str]) -> Column:
    """remove unit suffixes (``%``, ``s``, `` pps``) then parse; bad -> 0.0."""
    c = _col(text).cast("string")
    for u in units:
        c = F.replace(c, F.lit(u), F.lit(""))
    return F.coalesce(F.trim(c).try_cast("double"), F.lit(0.0))


def control_strip(text) -> Column:
    """F2 first half: trim, drop control characters."""
    return F.regexp_replace(F.trim(_col(text)), C.CONTROL_CHARS, "")
