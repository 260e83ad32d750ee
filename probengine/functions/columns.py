"""Scalar column expressions (P8-P21 and friends).

All of these are native Catalyst expressions: they stay inside whole-stage
codegen and never start a Python worker.

Null rules (pandas -> Spark): a pandas comparison against NaN is False, a
Spark comparison is NULL. Every boolean that becomes a 0/1 flag therefore goes
through ``flag`` which turns NULL into 0.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Fixed values that must equal the reference's for equal results.
PROB_EPS = 1e-6            # probability clip  [1e-6, 1 - 1e-6]
SAFE_FALLBACK_PROB = 0.5   # used for every row when any probability is not finite
DECISION_THRESHOLD = 0.5   # class decision p >= 0.5


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(cond: Column) -> Column:
    """Boolean -> int 0/1 with NULL -> 0 (pandas ``astype(int)`` semantics)."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def eq_flag(c: ColumnOrName, value) -> Column:
    return flag(_c(c) == F.lit(value))


def isin_flag(c: ColumnOrName, values: Sequence) -> Column:
    return flag(_c(c).isin(list(values)))


def le_flag(c: ColumnOrName, threshold) -> Column:
    return flag(_c(c) <= F.lit(threshold))


def not_equal_keep_null(c: ColumnOrName, value) -> Column:
    """pandas ``s != v``: NULL/NaN rows are kept (they are "not equal")."""
    return ~_c(c).eqNullSafe(F.lit(value))


def normalise_text(c: ColumnOrName) -> Column:
    """pandas ``str.strip().str.lower()``; strip removes all leading/trailing
    whitespace, not only blanks."""
    return F.lower(F.regexp_replace(_c(c), r"^\s+|\s+$", ""))


def recode(c: ColumnOrName, mapping: Mapping[str, str]) -> Column:
    """Dictionary recode; values not in the mapping pass through, NULL stays
    NULL. A literal map lookup, so one expression regardless of rows."""
    if not mapping:
        return _c(c)
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.element_at(m, _c(c)), _c(c))


def contains_flag(c: ColumnOrName, needle: str) -> Column:
    return flag(_c(c).contains(needle))


def rlike_flag(c: ColumnOrName, pattern: str) -> Column:
    return flag(_c(c).rlike(pattern))


def pick(a: ColumnOrName, b: ColumnOrName, if_equal: ColumnOrName,
         otherwise: ColumnOrName) -> Column:
    """``x if a == b else y`` per row; a NULL comparison takes the else branch."""
    return F.when(_c(a) == _c(b), _c(if_equal)).otherwise(_c(otherwise))


def safe_ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """``num / den.replace(0, 1)``: zero denominators divide by one."""
    d = _c(den)
    return _c(num) / F.when(d == 0, F.lit(1)).otherwise(d)


def clip_prob(p: ColumnOrName, eps: float = PROB_EPS) -> Column:
    return F.greatest(F.least(_c(p), F.lit(1.0 - eps)), F.lit(eps))


def not_finite(p: ColumnOrName) -> Column:
    """TRUE for NULL, NaN and +-inf."""
    x = _c(p)
    return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def lenient_double(c: ColumnOrName) -> Column:
    """pandas ``to_numeric(errors='coerce')``; ANSI mode would raise on
    ``cast``, ``try_cast`` yields NULL instead."""
    return _c(c).try_cast("double")


def decision(p: ColumnOrName, threshold: float = DECISION_THRESHOLD) -> Column:
    return (_c(p) >= F.lit(threshold)).cast("int")


def hash_uniform(tag: str, key: ColumnOrName, bits: int = 32) -> Column:
    """Portable uniform in [0, 1): first ``bits`` (a multiple of four) bits of
    md5(tag|key) / 2^bits.

    DuckDB computes the same value with
    ``('0x' || substr(md5(tag || '|' || key), 1, 8))::BIGINT / 4294967296.0``.
    Used for folds, bootstrap multiplicities and the synthetic probability
    columns of the test bindings: deterministic, so a recomputed partition
    after an executor loss yields identical rows."""
    h = F.md5(F.concat(F.lit(f"{tag}|"), _c(key).cast("string")))
    return F.conv(F.substring(h, 1, bits // 4), 16, 10).cast("bigint") / F.lit(float(1 << bits))


def linspace_bin(x: ColumnOrName, n_bins: int, closed_last: bool) -> Column:
    """Bin index of ``x`` on the edges ``numpy.linspace(0, 1, n_bins + 1)``.

    Edges are the doubles ``i * (1 / n_bins)`` as numpy builds them
    (0.30000000000000004 for i=3 of 10), so ``floor(x * n)`` is only a first
    guess corrected against the neighbouring edges. Bins are ``[lo, hi)``;
    with ``closed_last`` the value 1.0 falls in the last bin (histogram
    semantics), otherwise in none (ECE semantics). Outside [0, 1] -> NULL."""
    v = _c(x)
    step = F.lit(1.0 / n_bins)
    g = F.floor(v * F.lit(float(n_bins)))
    b = (F.when(v < g * step, g - 1)
         .when(v >= (g + 1) * step, g + 1)
         .otherwise(g))
    upper_ok = (v <= F.lit(1.0)) if closed_last else (v < F.lit(1.0))
    b = F.least(b, F.lit(n_bins - 1)) if closed_last else b
    return F.when((v >= F.lit(0.0)) & upper_ok, b.cast("int"))


def round_half_up(c: ColumnOrName, digits: int) -> Column:
    return F.round(_c(c), digits)
