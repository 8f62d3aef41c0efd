"""Pair similarities: set features as expressions, edit kernels as Arrow functions.

Conventions for empty strings: ratio and partial ratio of two empty strings are 100, of one 0;
token-set ratio is 0 if a side has no tokens; Jaro-Winkler of two empty strings is 1.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kinfold.functions.text import digit_runs


def common_subsequence(a: str, b: str) -> int:
    """Longest common subsequence, a machine word of columns at a time."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    """100 x twice the common subsequence over both lengths."""
    n = len(a) + len(b)
    return 200.0 * common_subsequence(a, b) / n if n else 100.0


def token_set(a: str, b: str) -> float:
    """The best indel ratio among the shared tokens and the shared tokens with either rest."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    gap = 1 if both else 0
    ab, ba = len(both) + gap + len(left), len(both) + gap + len(right)
    apart = len(left) + len(right) - 2 * common_subsequence(left, right)
    best = 100.0 * (1 - apart / (ab + ba))
    if both:
        best = max(best, *(100.0 * (1 - (n - len(both)) / (n + len(both))) for n in (ab, ba)))
    return best


def partial(a: str, b: str) -> float:
    """The best indel ratio of the shorter string and a window of the longer, cut off at its ends."""
    short, long_ = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long_ else 0.0
    n = len(short)

    def over(x: str, y: str) -> float:
        return max(indel(x, y[max(0, i) : i + n]) for i in range(1 - n, len(y)))

    return max(over(short, long_), over(long_, short) if len(short) == len(long_) else 0.0)


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    """Jaro similarity, raised by the common prefix (up to 4) where it is over 0.7."""
    if not a and not b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    free, own = [True] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + max(reach, 0) + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                own.append(c)
                break
    if not own:
        return 0.0
    other = [c for j, c in enumerate(b) if not free[j]]
    m, swapped = len(own), sum(x != y for x, y in zip(own, other, strict=True)) // 2
    s = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return s + prefix * weight * (1 - s) if s > 0.7 else s


def _arrow(kernel):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for pair in zip(a.fillna(""), b.fillna(""), strict=True):
            if pair not in known:
                known[pair] = kernel(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return run


indel_ratio, token_set_ratio, partial_ratio, jaro_winkler_similarity = map(_arrow, (indel, token_set, partial, jaro_winkler))


def length_ratio(a: Column, b: Column) -> Column:
    return F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def jaccard(x: Column, y: Column) -> Column:
    """Of two token arrays; 0 if both are empty."""
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def token_jaccard(a: Column, b: Column) -> Column:
    return jaccard(_tokens(a), _tokens(b))


def digit_features(a: Column, b: Column) -> dict[str, Column]:
    """Of two blank-joined digit views: Jaccard, first-number state (1 equal, -1 not, 0 missing), counts."""
    x, y = _tokens(a), _tokens(b)
    both = (F.size(x) > 0) & (F.size(y) > 0)
    return {
        "digit_jacc": F.when(both, jaccard(x, y)).otherwise(0.0),
        "house_state": F.when(~both, 0).when(F.get(x, F.lit(0)) == F.get(y, F.lit(0)), 1).otherwise(-1),
        "n_digits_s1": F.size(x),
        "n_digits_rec": F.size(y),
    }


def number_features(a: Column, b: Column, name_a: Column, name_b: Column) -> dict[str, Column]:
    """Numbers on one side only; a conflict needs some on both sides."""
    x, y = F.array_distinct(_tokens(a)), F.array_distinct(_tokens(b))
    u, v = F.array_distinct(digit_runs(name_a)), F.array_distinct(digit_runs(name_b))
    left, right, nl, nr = F.array_except(x, y), F.array_except(y, x), F.size(F.array_except(u, v)), F.size(F.array_except(v, u))

    def longest(t: Column) -> Column:
        return F.array_max(F.transform(t, F.length))

    return {
        "num_only_s1": F.size(left),
        "num_only_rec": F.size(right),
        "num_conflict": F.least(F.size(left), F.size(right)),
        "num_conflict_len": F.coalesce(F.when((F.size(left) > 0) & (F.size(right) > 0), F.least(longest(left), longest(right))), F.lit(0)),
        "name_num_conflict": F.least(nl, nr),
        "name_num_diff": nl + nr,
    }


def string_block(left: str = "a_", right: str = "b_") -> dict[str, Column]:
    """All features of pairs whose normalised views stand in columns with these prefixes."""
    a, b = (lambda c: F.col(left + c)), (lambda c: F.col(right + c))
    return {
        "name_ratio": indel_ratio(a("name_n"), b("name_n")),
        "name_tset": token_set_ratio(a("name_n"), b("name_n")),
        "name_partial": partial_ratio(a("name_n"), b("name_n")),
        "name_jw": jaro_winkler_similarity(a("name_n"), b("name_n")),
        "name_len_ratio": length_ratio(a("name_n"), b("name_n")),
        "legal_ratio": indel_ratio(a("name_legal"), b("name_legal")),
        "nospace_ratio": indel_ratio(a("name_nospace"), b("name_nospace")),
        "translit_ratio": token_set_ratio(a("name_tr"), b("name_tr")),
        "addr_ratio": indel_ratio(a("addr_n"), b("addr_n")),
        "addr_tset": token_set_ratio(a("addr_n"), b("addr_n")),
        "addr_partial": partial_ratio(a("addr_n"), b("addr_n")),
        "addr_len_ratio": length_ratio(a("addr_n"), b("addr_n")),
        "rec_addr_empty": (b("addr_n") == "").cast("int"),
        "rec_indic": (b("script") > 0).cast("int"),
        **digit_features(a("addr_digits"), b("addr_digits")),
        **number_features(a("addr_digits"), b("addr_digits"), a("name_n"), b("name_n")),
    }
