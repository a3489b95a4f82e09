"""Column helpers shared by all operator families."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_KEY = ["artifact_id", "page"]


def py_round(value: Column, digits: int) -> Column:
    """Half-even rounding of the binary double, as ``round`` does in Python.

    ``F.round``/``F.bround`` round the shortest decimal rendering; the number
    formatter behind ``format_number`` rounds the exact binary value. It is slow,
    so it is only asked near a tie; elsewhere scaling and ``rint`` give the same
    double, because the quotient of two exact numbers is correctly rounded.
    """
    scale = F.lit(float(10 ** digits))
    scaled = value * scale
    nearest = F.rint(scaled)
    clear = (F.abs(scaled) < 1e12) & (F.abs(scaled - nearest) < 0.4999)
    exact = F.regexp_replace(F.format_number(value, digits), ",", "").cast("double")
    # the formatter takes half of the last place for an exact tie even where the binary value is above it
    half = float(f"5e-{digits + 1}")
    exact = F.when(F.abs(value) == F.lit(half), F.signum(value) * F.lit(float(round(half, digits)))).otherwise(exact)
    return F.when(clear, nearest / scale).otherwise(exact) + F.lit(0.0)


def reasons(*pairs: tuple[Column, str]) -> Column:
    """Array of the labels whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(label)) for cond, label in pairs]))


def first_reason(*pairs: tuple[Column, str], default: str | None = None) -> Column:
    """Label of the first condition that holds."""
    cases = [F.when(cond, F.lit(label)) for cond, label in pairs]
    return F.coalesce(*cases, F.lit(default))


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def all_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return all_of([left[k] == right[k] for k in keys])


def prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    """Rename every column but ``keep`` with a prefix (for self joins)."""
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def sha(*cols: Column, sep: str = "|") -> Column:
    return F.sha2(F.concat_ws(sep, *cols), 256)


def multiset_digest(row_hash: Column) -> Column:
    """Order-free digest of a group of row hashes, as a plain aggregate.

    Each 256-bit row hash is cut into four 60-bit limbs that are summed. Sums
    combine on the map side, so a group of any size needs neither a sort nor
    a collected list. Equal groups give equal digests and repeats count.
    """
    limbs = [
        F.sum(F.conv(F.substring(row_hash, 1 + 15 * i, 15), 16, 10).cast("decimal(19,0)")).cast("string")
        for i in range(4)
    ]
    return F.sha2(F.concat_ws("|", F.count(row_hash).cast("string"), *limbs), 256)


def let(value: Column, body) -> Column:
    """Evaluate an expression once and use it several times inside an array function."""
    return F.element_at(F.transform(F.array(value), body), 1)
