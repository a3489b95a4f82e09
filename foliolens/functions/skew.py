"""Skew-proof building blocks: grid joins, banded neighbours and running values.

A page, task or document may hold a large part of all rows, so nothing here
brings one key into one task. A key is cut into *bands* by a monotone
expression of its order column; work is done per (key, band) and the few
band-edge values are carried across bands through a small summary.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import geometry as geo
from .common import all_of

CELL_W, CELL_H = 512.0, 128.0
CROWD = 256  # rows of one key up to which its pairs are built without a grid


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size)).cast("long")


def grown(df: DataFrame) -> DataFrame:
    """A table of many more rows than the files below it: Spark's size estimate leaves out what ``explode`` multiplies.

    Joined by sort and merge, such a table is never broadcast whole through the driver.
    """
    return df.hint("merge")


def to_cells(df: DataFrame, prefix: str = "", pad_x: float = 0.0, pad_y: float = 0.0,
             cell_w: float = CELL_W, cell_h: float = CELL_H) -> DataFrame:
    """One row per grid cell a (padded) box reaches: adds ``cx`` and ``cy``."""
    x0, y0, x1, y1 = geo.cols(prefix)
    xs = F.sequence(_cell(x0 - pad_x, cell_w), _cell(F.greatest(x1, x0) + pad_x, cell_w))
    ys = F.sequence(_cell(y0 - pad_y, cell_h), _cell(F.greatest(y1, y0) + pad_y, cell_h))
    return df.withColumn("cx", F.explode(xs)).withColumn("cy", F.explode(ys))


def _meet(lp: str, rp: str, pad_x: float, pad_y: float) -> Column:
    return (
        (F.col(lp + "x0") - pad_x <= F.col(rp + "x1")) & (F.col(rp + "x0") <= F.col(lp + "x1") + pad_x)
        & (F.col(lp + "y0") - pad_y <= F.col(rp + "y1")) & (F.col(rp + "y0") <= F.col(lp + "y1") + pad_y)
    )


def box_pairs(left: DataFrame, right: DataFrame, keys: list[str], lp: str = "a_", rp: str = "b_",
              pad_x: float = 0.0, pad_y: float = 0.0, cell_w: float = CELL_W, cell_h: float = CELL_H,
              residual: Column | None = None) -> DataFrame:
    """Pairs of boxes of one key that meet after padding the left box.

    Columns of ``left``/``right`` other than ``keys`` must already carry the
    prefixes. The join is an equi-join on key and grid cell; each pair is kept
    only in the cell that holds the upper-left corner of its meeting, so no
    ``distinct`` is needed and a crowded page spreads over its cells.
    """
    a = to_cells(left, lp, pad_x, pad_y, cell_w, cell_h)
    b = to_cells(right, rp, 0.0, 0.0, cell_w, cell_h)
    corner_x = F.greatest(F.col(lp + "x0") - pad_x, F.col(rp + "x0"))
    corner_y = F.greatest(F.col(lp + "y0") - pad_y, F.col(rp + "y0"))
    owner = (F.col("cx") == _cell(corner_x, cell_w)) & (F.col("cy") == _cell(corner_y, cell_h))
    meet = _meet(lp, rp, pad_x, pad_y)
    cond = owner & meet if residual is None else owner & meet & residual
    return grown(a).join(grown(b), [*keys, "cx", "cy"]).where(cond).drop("cx", "cy")


def crowds(keys: list[str], *tables: DataFrame, limit: int = CROWD) -> DataFrame | None:
    """Keys with more than ``limit`` rows in one of the tables; none where there are no such keys.

    Most pages hold a few rows: their work stays where the page is, and only crowded ones are cut into cells or bands.
    The rows are counted at once, so the plan of the few is left out where it has nothing to do.
    """
    many = [t.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*keys) for t in tables]
    found = cut_lineage(reduce(DataFrame.unionByName, many).distinct())
    return None if found.isEmpty() else found


def by_crowd(keys: list[str], crowd: DataFrame | None, plain, spread, *tables: DataFrame) -> DataFrame:
    """``plain`` of the tables without the crowded keys, and ``spread`` of their crowded ones."""
    if crowd is None:
        return plain(*tables)
    return plain(*[t.join(crowd, keys, "left_anti") for t in tables]).unionByName(
        spread(*[t.join(crowd, keys, "left_semi") for t in tables]))


def page_pairs(left: DataFrame, right: DataFrame, keys: list[str], crowd: DataFrame | None, lp: str = "a_", rp: str = "b_",
               pad_x: float = 0.0, pad_y: float = 0.0, residual: Column | None = None) -> DataFrame:
    """The pairs of ``box_pairs``: by key alone where that is not crowded, so no row is repeated per cell."""
    meet = _meet(lp, rp, pad_x, pad_y)
    cond = meet if residual is None else meet & residual
    return by_crowd(keys, crowd, lambda a, b: a.join(b, keys).where(cond),
                    lambda a, b: box_pairs(a, b, keys, lp, rp, pad_x, pad_y, residual=residual), left, right)


def interval_pairs(left: DataFrame, right: DataFrame, keys: list[str], l_lo: str, l_hi: str,
                   r_lo: str, r_hi: str, step: float, residual: Column | None = None) -> DataFrame:
    """Pairs whose closed intervals meet on one axis, by equi-join on bands."""
    def bands(df: DataFrame, lo: str, hi: str) -> DataFrame:
        return df.withColumn("cb", F.explode(F.sequence(
            _cell(F.col(lo), step), _cell(F.greatest(F.col(hi), F.col(lo)), step))))

    meet = (F.col(l_lo) <= F.col(r_hi)) & (F.col(r_lo) <= F.col(l_hi))
    owner = F.col("cb") == _cell(F.greatest(F.col(l_lo), F.col(r_lo)), step)
    cond = owner & meet if residual is None else owner & meet & residual
    return grown(bands(left, l_lo, l_hi)).join(grown(bands(right, r_lo, r_hi)), [*keys, "cb"]).where(cond).drop("cb")


def shift(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], offset: int,
          band: Column) -> DataFrame:
    """Add the values of the previous (-1) or next (+1) row of the same key.

    ``order`` must be a total order within the key and ``band`` a
    non-decreasing function of it.
    """
    work = df.withColumn("_band", band)
    packed = F.struct(*[v.alias(n) for n, v in values.items()])
    step = F.lag if offset < 0 else F.lead
    edge_of = F.max_by if offset < 0 else F.min_by
    position = F.struct(*[F.col(o) for o in order])
    within = work.withColumn(
        "_near", step(packed).over(Window.partitionBy(*keys, "_band").orderBy(*order)))
    edges = work.groupBy(*keys, "_band").agg(edge_of(packed, position).alias("_edge"))
    edges = edges.withColumn("_edge", step("_edge").over(Window.partitionBy(*keys).orderBy("_band")))
    edges = edges.where(F.col("_edge").isNotNull())
    near = F.coalesce(F.col("_near"), F.col("_edge"))
    kept = [F.col(c) for c in df.columns if c not in values]
    return within.join(edges, [*keys, "_band"], "left").select(
        *kept, *[near[n].alias(n) for n in values])


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]],
            band: Column, inclusive: bool = True) -> DataFrame:
    """Add running ``sum``/``max``/``min`` values per key in two levels.

    ``values`` maps a new column to (aggregate name, expression). Rows before
    the current one count, and the current one too when ``inclusive``.
    """
    aggs = {"sum": F.sum, "max": F.max, "min": F.min}
    work = df.withColumn("_band", band)
    for name, (_, expr) in values.items():
        work = work.withColumn("_v_" + name, expr)
    last = 0 if inclusive else -1
    inner = Window.partitionBy(*keys, "_band").orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    prior = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    totals = work.groupBy(*keys, "_band").agg(
        *[aggs[a]("_v_" + n).alias("_t_" + n) for n, (a, _) in values.items()])
    totals = totals.select(*keys, "_band", *[
        aggs[a]("_t_" + n).over(prior).alias("_p_" + n) for n, (a, _) in values.items()])
    totals = totals.where(F.coalesce(*[F.col("_p_" + n) for n in values]).isNotNull())
    out = work
    for name, (agg, _) in values.items():
        out = out.withColumn("_w_" + name, aggs[agg]("_v_" + name).over(inner))
    out = out.join(totals, [*keys, "_band"], "left")

    def combine(name: str, agg: str) -> Column:
        here, before = F.col("_w_" + name), F.col("_p_" + name)
        if agg == "sum":
            return F.when(here.isNull() & before.isNull(), None).otherwise(
                F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0)))
        return (F.greatest if agg == "max" else F.least)(here, before)

    kept = [F.col(c) for c in df.columns if c not in values]
    return out.select(*kept, *[combine(n, a).alias(n) for n, (a, _) in values.items()])


def number_rows(df: DataFrame, keys: list[str], order: list[str], band: Column, name: str = "rn") -> DataFrame:
    """``row_number`` per key computed in bands."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("long"))}, band)


def quantiles(df: DataFrame, keys: list[str], value: str, weight: Column, fractions: list[float], band: Column) -> DataFrame:
    """Exact weighted quantiles per key as ``q0``, ``q1``, ...: between two values they are interpolated by position.

    Rows are counted by (key, value), which combines before the shuffle; counts are
    accumulated in bands of the value and each quantile is picked by rank. Nulls and weights of 0 do not count.
    """
    counts = df.where(F.col(value).isNotNull() & (weight > 0)).groupBy(*keys, value).agg(F.sum(weight).cast("long").alias("_n"))
    upto = running(counts, keys, [value], {"_upto": ("sum", F.col("_n"))}, band)
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    rows, picks, out = upto.join(total, keys), [], []
    for i, p in enumerate(fractions):
        at = F.lit(p) * (F.col("_total") - 1)
        picks += [F.min(F.when(F.col("_upto") > F.floor(at), F.col(value))).alias(f"_lo{i}"), F.min(F.when(F.col("_upto") > F.ceil(at), F.col(value))).alias(f"_hi{i}")]
        low, high = F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double")
        out.append(F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(f"q{i}"))
    return rows.groupBy(*keys).agg(*picks, F.max("_total").alias("_total")).select(*keys, *out)


def medians(df: DataFrame, keys: list[str], bands: dict[str, float]) -> DataFrame:
    """Exact medians per key of several columns, as ``<name>_median``; ``bands`` gives each column's band width."""
    measure = F.explode(F.array(*[F.struct(F.lit(n).alias("_measure"), F.col(n).cast("double").alias("_value")) for n in bands]))
    rows = df.select(*keys, measure.alias("_m")).select(*keys, "_m.*")
    width = F.coalesce(*[F.when(F.col("_measure") == n, F.lit(float(w))) for n, w in bands.items()])
    found = quantiles(rows, [*keys, "_measure"], "_value", F.lit(1), [0.5], F.floor(F.col("_value") / width))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_measure") == n, F.col("q0"))).alias(n + "_median") for n in bands])


def equal_columns(a: str, b: str, names: list[str]) -> Column:
    return all_of([F.col(a + n).eqNullSafe(F.col(b + n)) for n in names])
