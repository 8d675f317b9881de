"""Column expressions shared by the operators. No user-defined functions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from renewscope.config import StudyConfig

# Usage seconds are summed as whole microseconds: integer sums do not depend on
# the order in which partitions arrive, so labels are reproducible on any cluster,
# and a window is an exact difference of two running totals.
MICROS = 1_000_000


def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def parse_yyyymmdd(col: Column, strict: bool = True) -> Column:
    """Integer yyyyMMdd to a date; the lenient form gives NULL for bad values."""
    text = col.cast("string")
    fmt = F.lit("yyyyMMdd")
    return F.to_date(text, "yyyyMMdd") if strict else F.try_to_date(text, "yyyyMMdd")


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def clip(col: Column, low: float, high: float) -> Column:
    """Limit to [low, high]; NULL stays NULL (least and greatest would skip it)."""
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(low)), F.lit(high)))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den where den > 0, else NULL; never NaN or infinity."""
    return F.when(den > 0, num / den)


def keep_between(col: Column, low, high) -> Column:
    return F.when(col.between(low, high), col)


def finite(col: Column) -> Column:
    """NaN and infinities become NULL."""
    bad = F.isnan(col) | col.isin(float("inf"), float("-inf"))
    return F.when(~bad, col)


def paid_renewal(amount: Column, is_cancel: Column) -> Column:
    return ((amount > 0) & (is_cancel == 0)).cast("int")


def flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def to_micros(secs: Column) -> Column:
    return F.round(secs * MICROS).cast("long")


def from_micros(micros: Column) -> Column:
    return micros.cast("double") / MICROS


def movement_class(ratio: Column, low: float, high: float) -> Column:
    """Band rule; both edges belong to STABLE."""
    return (
        F.when(ratio < low, F.lit("CONTRACTION"))
        .when(ratio > high, F.lit("EXPANSION"))
        .otherwise(F.lit("STABLE"))
    )


def trajectory_label(cfg: StudyConfig, pre_days="pre_n_days", renewed="renewed",
                     post_secs="post_total_secs", ratio="vol_ratio") -> Column:
    """Evidence, then renewal, then silence, then the volume band."""
    r = F.col(ratio)
    return (
        F.when(F.col(pre_days) < cfg.min_days, F.lit("INSUFFICIENT_DATA"))
        .when(F.col(renewed) == 0, F.lit("CHURN"))
        .when(F.col(post_secs) == 0, F.lit("CONTRACTION"))
        .when(r.isNull(), F.lit("INSUFFICIENT_DATA"))
        .otherwise(movement_class(r, cfg.vol_low, cfg.vol_high))
    )


def md5_mod(text: Column, m: int) -> Column:
    """md5 read as one 128-bit number, modulo m, in 32-bit steps of 64-bit arithmetic."""
    if m > 2**30:
        raise ValueError("modulus too large for 64-bit steps")
    digest = F.md5(text)
    shift = pow(2, 32, m)
    acc = F.lit(0).cast("long")
    for start in (1, 9, 17, 25):
        block = F.conv(F.substring(digest, start, 8), 16, 10).cast("long")
        acc = F.pmod(acc * F.lit(shift) + block, F.lit(m).cast("long"))
    return acc


def user_uniform(user: Column, salt: Column | str) -> Column:
    """Value in [0, 1) that depends only on the salt and the user."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    return md5_mod(F.concat_ws(":", salt, user), 1_000_000) / F.lit(1_000_000)


def code_of(col: Column, levels: Sequence[str]) -> Column:
    """Position of a class name in its fixed order, NULL when it is not listed."""
    pairs = chain.from_iterable((F.lit(v), F.lit(i)) for i, v in enumerate(levels))
    return F.try_element_at(F.create_map(*pairs), col)


def name_of(code: Column, levels: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in levels]), code)


def argmax_index(vector: Column) -> Column:
    """0-based index of the largest entry, the first one on ties."""
    return (F.array_position(vector, F.array_max(vector)) - 1).cast("int")


def mean_se_text(mean: Column, se: Column, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits}f ± %.{digits}f", mean, se)


def category_text(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit("NA"))


def numeric_or(col: Column, default: float) -> Column:
    return F.coalesce(col.cast("string").try_cast("double"), F.lit(default))


def array_of(values: Iterable) -> Column:
    return F.array(*[F.lit(v) for v in values])
