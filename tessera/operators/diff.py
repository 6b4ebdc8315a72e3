"""Word-level comparison of two texts: longest common subsequence and its segments."""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word pairs beyond which similarity does not compare texts.
MAX_GRID = 120_000
_SEGMENTS = "struct<left:array<struct<text:string,kind:string>>,right:array<struct<text:string,kind:string>>>"
_RUNS = pa.list_(pa.struct([("text", pa.string()), ("kind", pa.string())]))
_ARROW = pa.struct([("left", _RUNS), ("right", _RUNS)])
#: Rows whose segments are Python objects at once.
SLICE = 128


def lcs_length(a: list[str], b: list[str]) -> int:
    """Bit-parallel: one bit for each word of b, one integer step for each word of a."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for w in a:
        u = v & places.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def _merged(parts: list[tuple[str, str]]) -> list[dict]:
    out: list[dict] = []
    for word, kind in parts:
        if out and out[-1]["kind"] == kind:
            out[-1]["text"] += " " + word
        else:
            out.append({"text": word, "kind": kind})
    return out


def segments(a: list[str], b: list[str]) -> dict:
    """Both sides as runs of unchanged and deleted (left) or added (right) words, whatever their lengths.

    The table of longest common subsequences is kept as bits: bit j - 1 of row i is unset where the value rises from column j - 1 to j. The
    way back needs no more, since of unequal words the left cell is the lesser one just where the value rises. Of every root-of-n-th row the
    bits are stored, and those between are made again when the way back comes to them; so are the places of words that are rare in b.
    """
    n, m = len(a), len(b)
    full, width, step = (1 << m) - 1, m // 8 + 1, math.isqrt(n) + 1
    at: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        at.setdefault(w, []).append(j)

    def places(w: str) -> int:
        bits = bytearray(width)
        for j in at.get(w, ()):
            bits[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(bits, "little")

    often = {w: places(w) for w, found in at.items() if len(found) ** 2 > m}

    def below(v: int, w: str) -> int:
        u = v & (often[w] if w in often else places(w))
        return ((v + u) | (v - u)) & full

    kept, v = [full], full
    for i, w in enumerate(a, 1):
        v = below(v, w)
        if i % step == 0:
            kept.append(v)
    i, j, left, right, rows, here = n, m, [], [], [], b""
    while i or j:
        if i and not here:
            if not rows:
                first = (i - 1) // step
                v = kept[first]
                for w in a[first * step : i]:
                    v = below(v, w)
                    rows.append(v)
            here = rows.pop().to_bytes(width, "little")
        if i and j and a[i - 1] == b[j - 1]:
            i, j, here = i - 1, j - 1, b""
            left.append((a[i], "unchanged"))
            right.append((b[j], "unchanged"))
        elif j and (not i or here[j - 1 >> 3] >> (j - 1 & 7) & 1):
            j -= 1
            right.append((b[j], "add"))
        else:
            i, here = i - 1, b""
            left.append((a[i], "delete"))
    return {"left": _merged(left[::-1]), "right": _merged(right[::-1])}


def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length((x or "").split(), (y or "").split()) for x, y in zip(a, b)], dtype="int32")


def _diff(a: pa.Array, b: pa.Array) -> pa.Array:
    """Segments of a batch, made SLICE rows at a time: between slices only Arrow's compact form of them is kept."""
    made = []
    for at in range(0, len(a), SLICE):
        pairs = zip(a.slice(at, SLICE).to_pylist(), b.slice(at, SLICE).to_pylist())
        made.append(pa.array([segments((x or "").split(), (y or "").split()) for x, y in pairs], _ARROW))
    return pa.concat_arrays(made) if made else pa.array([], _ARROW)


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def similarity(a: Column, b: Column, most: int = MAX_GRID) -> Column:
    """2 LCS / (n + m): 1 for two empty texts, 0 where n m exceeds the grid. Large pairs never reach Python."""
    n, m = _words(a), _words(b)
    small = n * m <= most
    lcs = F.pandas_udf(_lcs, "int")(F.when(small, a), F.when(small, b))
    return F.when(n + m == 0, F.lit(1.0)).when(~small, F.lit(0.0)).otherwise(2.0 * lcs / (n + m))


def diff_segments(a: Column, b: Column) -> Column:
    return F.arrow_udf(_diff, _SEGMENTS)(a, b)
