"""How alike two texts are, by their longest common subsequence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quire.functions.text import normalize_text, sorted_tokens


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence: one row of the table is the bits of an integer."""
    if len(a) > len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """2 LCS / (|a| + |b|); 1 for two empty texts."""
    return 2 * common_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def set_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The best ratio among the common words, those with the words of a alone, and those with the words of b alone; one below least may come out lower."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 1.0
    with_x, with_y = (f"{both} {" ".join(sorted(z - (x & y)))}".strip() for z in (x, y))
    # the common words begin both texts: they are all that they have in common with either
    best = 2 * len(both) / (len(both) + min(len(with_x), len(with_y)))
    most = 2 * min(len(with_x), len(with_y)) / (len(with_x) + len(with_y))
    return max(best, ratio(with_x, with_y)) if most > best and most >= least else best


def _places(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, and for each character of all texts its text, its place there and its code point."""
    n = np.array([len(t) for t in texts], dtype=np.int64)
    which = np.repeat(np.arange(len(texts)), n)
    return n, which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n), np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def common_lengths(left: list[str], right: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """common_length of left[i] and right[j] for arrays of places; texts of left up to 64 characters go side by side, a word of bits each."""
    (n, which, at, chars), (m, which_b, at_b, chars_b) = _places(left), _places(right)
    found, fits = np.zeros(len(i), dtype=np.int64), n[i] <= 64
    known, codes = np.unique(chars, return_inverse=True)
    bits, short = np.zeros((len(left), len(known) + 1), dtype=np.uint64), n[which] <= 64
    np.bitwise_or.at(bits, (which[short], codes[short]), np.uint64(1) << at[short].astype(np.uint64))
    spelled = np.full((len(right), max(m, default=0)), len(known))  # the last code is no character of left
    code_b = np.searchsorted(known, chars_b)
    held = code_b < len(known)
    held[held] = known[code_b[held]] == chars_b[held]
    spelled[which_b[held], at_b[held]] = code_b[held]
    full = np.where(n < 64, (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1), ~np.uint64(0))
    for part in np.array_split(np.flatnonzero(fits), int(fits.sum()) // 8192 + 1):
        row, p, q, all_bits = full[i[part]], i[part], j[part], full[i[part]]
        for s in range(max(m[q], default=0)):
            hit = row & bits[p, spelled[q, s]]
            row = (row + hit | row - hit) & all_bits
        found[part] = n[p] - np.bitwise_count(row)
    for k in np.flatnonzero(~fits):
        found[k] = common_length(left[i[k]], right[j[k]])
    return found


def shared_letters(left: list[str], right: list[str]) -> np.ndarray:
    """How many characters every two texts share, each as often as both have it: a product of matrices."""
    n, which, _, chars = _places(left + right)
    if not len(chars):
        return np.zeros((len(left), len(right)), dtype=np.float32)
    order = np.lexsort((chars, which))
    row, char = which[order], chars[order]
    first = np.r_[True, (row[1:] != row[:-1]) | (char[1:] != char[:-1])]
    nth = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
    kinds, column = np.unique(char.astype(np.int64) << 32 | nth, return_inverse=True)
    has = np.zeros((len(n), len(kinds)), dtype=np.float32)
    has[row, column] = 1
    return has[: len(left)] @ has[len(left) :].T


def alike_places(left: list[str], right: list[str], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all texts with 200 LCS / (|a| + |b|) >= percent.

    A common subsequence is no longer than the characters that two texts share; the texts that these leave are compared exactly.
    """
    n, m = (np.array([len(t) for t in texts], dtype=np.int64) for texts in (left, right))
    least = percent * (n[:, None] + m[None, :])
    i, j = np.nonzero(200 * shared_letters(left, right) >= least - 0.5)
    same = 200 * common_lengths(left, right, i, j) >= least[i, j]
    return i[same], j[same]


@F.pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of code points; null if either is null."""
    out, known = pd.Series([None] * len(a), dtype="Int32"), np.flatnonzero((a.notna() & b.notna()).to_numpy())
    for part in np.array_split(known, len(known) // 2048 + 1):
        x, y = a.iloc[part].to_numpy(), b.iloc[part].to_numpy()
        turned = a.iloc[part].str.len().to_numpy() > b.iloc[part].str.len().to_numpy()
        (i, left), (j, right) = pd.factorize(np.where(turned, y, x)), pd.factorize(np.where(turned, x, y))  # each text once
        out.iloc[part] = common_lengths(list(left), list(right), i, j)
    return out


def at_least(a: Column, b: Column, percent: int) -> Column:
    """Whether 200 LCS / (|a| + |b|) reaches percent, exactly; two empty texts are alike."""
    return 200 * lcs_length(a, b) >= percent * (F.char_length(a) + F.char_length(b))


def comparable(text: Column) -> Column:
    """A text as token_sort compares it: normalised, its tokens in order."""
    return sorted_tokens(normalize_text(text))
