"""Hashed word-shingle sets of texts, by whole Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RANDOM = np.random.default_rng(5)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_VALUE = np.where(_BLANK, np.uint64(0), _BYTE[_FOLD])
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = [np.uint64(int(x) | 1) for x in _RANDOM.integers(1 << 62, 1 << 63, 4, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingles(texts: pa.Array, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each shingle, repeats included, text by text.

    Words are what blanks (space, tab to carriage return) part, with A-Z lower-cased; a text with
    fewer words than ``width`` has its whole sequence as one shingle, one without words none.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    joined = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())).cast(pa.large_binary())
    ends = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset:joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    ends = ends - ends[0]
    blank = _BLANK[data]
    begins = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    place = np.zeros(len(data), np.int64)
    place[begins[0]:] = np.arange(begins[0], len(data)) - np.repeat(begins, np.diff(np.append(begins, len(data))))
    place[blank] = 0
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(place.max()), _STEP | np.uint64(1))]), dtype=np.uint64)
    word = mix(np.add.reduceat(_VALUE[data] * powers[place], begins))
    doc = np.searchsorted(ends, begins, side="right") - 1
    n = np.bincount(doc, minlength=len(texts))
    whole = np.arange(len(word))[doc == np.append(doc[width - 1:], np.full(width - 1, -1))] if len(word) >= width else np.zeros(0, np.int64)
    value = np.zeros(len(whole), np.uint64)
    for k in range(width):
        value = value * _ODD[0] + mix(word[whole + k] + _ODD[1])
    out, out_doc = mix(value), doc[whole]
    few = np.flatnonzero((n > 0) & (n < width))
    if len(few):
        short, at = _ODD[2] * n[few].astype(np.uint64), (np.cumsum(n) - n)[few]
        for k in range(width - 1):
            has = n[few] > k
            short[has] = short[has] * _ODD[0] + mix(word[at[has] + k] + _ODD[3])
        out, out_doc = np.concatenate([out, mix(short)]), np.concatenate([out_doc, few])
        order = np.argsort(out_doc, kind="stable")
        out, out_doc = out[order], out_doc[order]
    return out, out_doc


def ordered_sets(texts: pa.Array, weight: np.ndarray, bits: int, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles by text in the global order (weight of the hash's top ``bits``, hash), and set sizes."""
    value, doc = shingles(texts, width)
    order = np.lexsort((value, weight[value >> np.uint64(64 - bits)], doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.bincount(doc[new], minlength=len(texts))
