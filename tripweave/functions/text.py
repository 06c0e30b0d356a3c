"""String columns: names, keys, numbers in text, tags."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def clean_name(c: Column) -> Column:
    """Newlines to spaces, runs of spaces squeezed, ends trimmed; NULL becomes ''."""
    one_line = F.regexp_replace(F.regexp_replace(c, "\n", " "), " +", " ")
    return F.coalesce(F.regexp_replace(one_line, r"^\s+|\s+$", ""), F.lit(""))


def norm_key(c: Column) -> Column:
    """Upper-cased, trimmed join key; NULL stays NULL."""
    return F.upper(F.trim(c))


def strict_double(c: Column) -> Column:
    """Plain decimal text to double, anything else NULL (no ``1d``, ``NaN`` or hex)."""
    return F.when(F.trim(c).rlike(NUMBER), F.trim(c).try_cast("double"))


def parse_number(c: Column, dash_is_zero: bool = False, bad: float | None = None) -> Column:
    """``'1,563'`` -> 1563.0; unparsable text gives ``bad``."""
    text = F.regexp_replace(c, "[, ]", "")
    value = strict_double(text)
    if dash_is_zero:
        value = F.when(F.trim(c) == "-", F.lit(0.0)).otherwise(value)
    return value if bad is None else F.coalesce(value, F.lit(float(bad)))


def parse_latlon(c: Column) -> Column:
    """``'lat,lon'`` or ``'(lat, lon)'`` to ``struct<lat, lon>`` of doubles."""
    parts = F.split(F.regexp_replace(c, r"[()\s]", ""), ",")
    return F.struct(
        strict_double(F.get(parts, F.lit(0))).alias("lat"),
        strict_double(F.get(parts, F.lit(1))).alias("lon"),
    )


def surrogate_key(prefix: str, *cols: Column, digits: int = 64) -> Column:
    """Repeatable ``PREFIX_`` + SHA-256 of the identifying columns, in ``digits`` hex digits.

    Parts are marked ``=`` (NULL: ``~``) and joined by bars, with bars and backslashes inside
    escaped, so different values never make the same text. Fewer digits can collide.
    """
    def part(c: Column) -> Column:
        plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
        return F.coalesce(F.concat(F.lit("="), plain), F.lit("~"))

    digest = F.sha2(F.concat_ws("|", *[part(c) for c in cols]), 256)
    return F.concat(F.lit(f"{prefix}_"), F.substring(digest, 1, digits))


def padded_id(prefix: str, n: Column, width: int = 7) -> Column:
    """``P_0000012`` style ids. Numbers wider than ``width`` are kept whole."""
    digits = n.cast("string")
    return F.concat(F.lit(f"{prefix}_"), F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0")))


def key_part(c: Column, index: int = 0, sep: str = "_") -> Column:
    """One part of a composite key."""
    return F.get(F.split(c, sep), F.lit(index))


def numeric_suffix(c: Column, prefix: str) -> Column:
    """Number after ``prefix_`` in an id, else NULL; feed to ``max`` to resume numbering."""
    return F.regexp_extract(c, rf"{prefix}_(\d+)", 1).try_cast("bigint")


def format_tags(**tags: Column) -> Column:
    """``building=yes | shop=mall`` from the tags that are present."""
    parts = [F.when(c.isNotNull(), F.concat(F.lit(f"{name}="), c)) for name, c in tags.items()]
    joined = F.concat_ws(" | ", *parts)
    return F.when(joined == "", F.lit("no tags")).otherwise(joined)


def _common_subsequence(a: str, b: str) -> int:
    """Letters of the longest common subsequence: one bit a letter of ``a``, one step a letter of ``b``."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    open_bits = full
    for ch in b:
        hit = open_bits & places.get(ch, 0)
        open_bits = ((open_bits + hit) | (open_bits - hit)) & full
    return len(a) - open_bits.bit_count()


#: The array path takes pairs whose shorter text fits one machine word and whose longer is no longer than this.
WORD_BITS, LONGEST = 64, 256
#: Cells of one table of letter places.
TABLE_CELLS = 1 << 21


def common_letters(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """``_common_subsequence`` of many pairs at once: a machine word a pair, a NumPy step a letter position.

    Pairs that do not fit go one by one, with integers of any length.
    """
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]
    out = np.zeros(len(pairs), dtype=np.int64)
    fits = [i for i, (x, y) in enumerate(pairs) if len(x) <= WORD_BITS and len(y) <= LONGEST]
    for i in set(range(len(pairs))).difference(fits):
        out[i] = _common_subsequence(*pairs[i])
    letters = {ch for i in fits for ch in pairs[i][0]}
    code = {ch: k for k, ch in enumerate(sorted(letters), 1)}  # 0: a letter of no shorter text
    step = max(TABLE_CELLS // (len(code) + 1), 1)
    for start in range(0, len(fits), step):
        rows = np.array(fits[start:start + step])
        short, long = [pairs[i][0] for i in rows], [pairs[i][1] for i in rows]
        n_short, n_long = np.array([len(x) for x in short]), np.array([len(y) for y in long])
        place = np.zeros((len(rows), len(code) + 1), dtype=np.uint64)
        for i in range(n_short.max()):
            at = np.flatnonzero(n_short > i)
            place[at, [code[short[r][i]] for r in at]] |= np.uint64(1 << i)
        open_bits = np.full(len(rows), ~np.uint64(0))
        for j in range(n_long.max()):
            at = np.flatnonzero(n_long > j)
            now = open_bits[at]
            hit = now & place[at, [code.get(long[r][j], 0) for r in at]]
            open_bits[at] = (now + hit) | (now - hit)
        used = np.array([(1 << n) - 1 for n in n_short.tolist()], dtype=np.uint64)
        out[rows] = np.bitwise_count(~open_bits & used)
    return out


def token_set_score(a: str | None, b: str | None) -> float:
    """0-100 similarity of two names by shared and unshared words."""
    words_a, words_b = set((a or "").lower().split()), set((b or "").lower().split())
    if not words_a or not words_b:
        return 0.0
    shared = " ".join(sorted(words_a & words_b))
    only_a = " ".join(sorted(words_a - words_b))
    only_b = " ".join(sorted(words_b - words_a))
    if shared and (not only_a or not only_b):
        return 100.0
    gap = 1 if shared else 0
    long_a, long_b = len(shared) + gap + len(only_a), len(shared) + gap + len(only_b)
    edits = len(only_a) + len(only_b) - 2 * _common_subsequence(only_a, only_b)
    best = 1 - edits / (long_a + long_b)
    if shared:
        best = max(
            best,
            1 - (gap + len(only_a)) / (len(shared) + long_a),
            1 - (gap + len(only_b)) / (len(shared) + long_b),
        )
    return 100.0 * best


@F.pandas_udf(T.LongType())
def _common_letters_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    open_rows = a.notna() & b.notna()
    out = pd.Series(pd.NA, index=a.index, dtype="Int64")
    out[open_rows] = common_letters(a[open_rows].tolist(), b[open_rows].tolist())
    return out


def _word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+"), lambda w: w != ""))


def token_set_ratio(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Name similarity, 0-100, by shared and unshared words.

    Words are compared in the JVM, which settles names without words (0) and names whose words are
    all in the other (100). Letters are compared, in Arrow batches, only for pairs whose lengths
    let them reach ``at_least``; the others get the score of their shared words alone, which is below it.
    """
    x, y = _word_set(a), _word_set(b)

    def text_of(words: Column) -> Column:
        return F.array_join(F.array_sort(words), " ")

    shared, only_a, only_b = text_of(F.array_intersect(x, y)), text_of(F.array_except(x, y)), text_of(F.array_except(y, x))
    n, n_a, n_b = F.length(shared), F.length(only_a), F.length(only_b)
    gap = F.when(n > 0, 1).otherwise(0)
    long_a, long_b = n + gap + n_a, n + gap + n_b
    settled = F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).when((n > 0) & ((n_a == 0) | (n_b == 0)), 100.0)
    by_words = F.when(n > 0, F.greatest(1 - F.try_divide(gap + n_a, n + long_a), 1 - F.try_divide(gap + n_b, n + long_b))).otherwise(0.0)

    def by_letters(common: Column) -> Column:
        return 1 - F.try_divide(n_a + n_b - 2 * common, long_a + long_b)

    within_reach = settled.isNull() & (100.0 * by_letters(F.least(n_a, n_b)) >= at_least)
    common = _common_letters_udf(F.when(within_reach, only_a), F.when(within_reach, only_b))
    return F.coalesce(settled, 100.0 * F.greatest(by_words, by_letters(common)))
